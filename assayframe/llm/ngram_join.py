"""N-gram Jaccard join with adaptive multi-match prefixes; components of near copies.

A document's set are its distinct shingles of ``width`` words (lower-cased A-Z, words between blanks), as 64-bit
hashes. Two sets link if 100 * intersection >= percent * union. Documents with equal sets form a class, named by a
64-bit hash of the set (among 10**10 different sets some 3 pairs are expected to share one, and would count as copies),
and only classes are joined.

Prefixes. All sets are ordered by an estimate of how many documents hold a shingle (a count sketch of fixed size over
all documents), then by hash. With a = ceil(percent * n / 100), sets that link share at least l of the first
n - a + l shingles of each, for any l up to a; with different l for both, at least the smaller. In the first pass a set
takes l = 1 + n // MATCH_STEP + log2(1 + cost), the cost being the mean estimate over its prefix of one match: the more
candidates a set is estimated to meet, the longer its prefix and the more of it partners have to share. Sets that
share fewer shingles than they ask for, or than the least demanding set that they meet asks for, go at once. For pairs
that are left, l grows with the candidates that a set was really found to meet, by floor(sqrt(cost)), to a at most. A
pair, of a hub or not, has to share min(l, l') of these longer prefixes before its whole sets are compared.

Order of work. (1) In each bucket of a prefix shingle, members are compared with the bucket's hub, the member
that meets most others; the links found give components. (2) Only pairs of different components that meet in a
bucket can still change anything; they are filtered by size, by place (linked sets meet at the first shingle they
share, and only shingles from there on can be shared), by a parity bitmap (bits that differ are shingles that differ,
so too many rule a link out), by the prefix test, and then compared. So a large group of near
copies costs a comparison for each member and bucket hub, not one for each pair, and no link that joins two
components is missed. (3) Then all links are listed: they lie inside components, and linked classes meet at a place.
The classes of a component are put in blocks by the place where most others are met. Blocks of a component that meet
at a place are compared, all their pairs at once: first by the longer prefixes, then those left by whole sets.
``links`` has every pair of linked classes, and ``n_links`` the other documents each document is linked with. Links of
a group of near copies grow with the square of its size. Components alone (``keep_one_of_each``) need no third step.

Buckets whose shingle is frequent are salted into ``SALTS`` parts with a hub each, compared in turn with the hubs' hub.

Defined cases: a null or empty text, or one without words, has an empty set, is linked with nothing and its own
component; texts under ``width`` words have one shingle; equal doc_ids with different texts are rows of their own, and
component ids are doc_ids; repeated rows come back as often as they came; a null doc_id is kept, and names a component
only if no member has an id; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayframe.llm import _counts
from assayframe.llm._components import connected_components, looked_up
from assayframe.llm._shared import bounded_batches, give_back, written
from assayframe.llm._words import NOT_SPACE, Words, mix, rolling, slices, string_buffers

WIDTH, PERCENT = 5, 75
#: counters of the sketch
SKETCH_BITS = 21
#: a shingle is frequent from this estimate on, or from this multiple of the sketch's mean load
HOT, HOT_MEANS, SALTS, PARTS = 20_000, 8, 64, 16
PARITY_LONGS, FOLDED = 16, 4
#: shingles of a set for each prefix shingle that it has to share beyond the first
MATCH_STEP = 16
#: sets, and shingles, that a block of a component is meant to have
BLOCK_SETS, BLOCK_SHINGLES = 256, 1 << 16
#: shingles counted in one product of matrices
_COLUMNS = 4096
_CHUNK = 1 << 18


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted set) of every text of a column."""
    raw, offsets = string_buffers(column)
    for i, j in slices(offsets, _CHUNK):
        words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], NOT_SPACE)
        hashes = words.hashes()
        rolled = rolling(hashes, width)
        first = words.first.tolist()
        for row in range(i, j):
            a, b = first[row - i], first[row - i + 1]
            if b - a >= width:
                own = np.sort(rolled[a : b - width + 1])
                yield row, own[np.concatenate([[True], own[1:] != own[:-1]])]
            else:
                yield row, rolling(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def _class_of(own: np.ndarray) -> int | None:
    """A hash of a set, as a signed long; null for the empty set."""
    if not len(own):
        return None
    a = mix(own * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    b = mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    both = mix(np.array([a], np.uint64) ^ mix(np.array([b + np.uint64(len(own))], np.uint64)))
    return int(both.view(np.int64)[0])


def _parity(own: np.ndarray) -> np.ndarray:
    """Which of 1024 buckets an odd number of shingles falls in. Two sets whose bitmaps differ in k bits differ in k shingles at least."""
    odd = np.bincount((own & np.uint64(64 * PARITY_LONGS - 1)).astype(np.int64), minlength=64 * PARITY_LONGS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def _least(n: int, percent: int) -> int:
    """Shingles that a set of n shares at least with any set it links to."""
    return -(-percent * n // 100)


def _matches(n: int, cost: float, percent: int) -> int:
    """Prefix shingles that a set asks its partners for: more for a larger set, and for one that is estimated to meet many."""
    return min(_least(n, percent), 1 + n // MATCH_STEP + int(np.log2(1 + cost)))


def _bucket(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _even_lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))


def _text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"].cast("string"))


def set_classes(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, a hash of its text, n_shingles, class, parity) of every document, and the sketch of shingle counts over all documents."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["doc_id", "same", "n_shingles", "class", "parity", "part", "slice", "counts"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            sizes, classes, held = [0] * batch.num_rows, [None] * batch.num_rows, []
            parity = np.zeros((batch.num_rows, PARITY_LONGS), np.int64)
            for row, own in _sets(batch.column("text"), width):
                sizes[row], classes[row], parity[row] = len(own), _class_of(own), _parity(own)
                held.append(_bucket(own))
                if len(held) == 256:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts)).astype(np.uint32)
                    held = []
            if held:
                counts += np.bincount(np.concatenate(held), minlength=len(counts)).astype(np.uint32)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("same"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), _even_lists(parity), *(pa.nulls(n, k) for k in kinds[5:])], names)
        give_back()
        sums = _counts.columns(counts)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(sums[0]), k) for k in kinds[:5]), *sums], names)

    plain = docs.select(F.col("doc_id").cast("bigint"), _text_hash(docs).alias("same"), F.col("text").cast("string"))
    scanned = written(plain.mapInArrow(scan, "doc_id bigint, same bigint, n_shingles bigint, class bigint, parity array<bigint>, part int, slice int, counts binary"), "classes")

    sketch = _counts.total(scanned.where("slice is not null").select("part", "slice", "counts"), 1 << SKETCH_BITS).astype(np.float32)
    return scanned.where("slice is null").select("doc_id", "same", "n_shingles", "class", "parity"), sketch


def _ordered(own: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set in the global order, and the estimates."""
    estimate = sketch[_bucket(own)]
    order = np.argsort(estimate, kind="stable")
    return own[order], estimate[order]


def _postings(docs: DataFrame, shared: Broadcast, hot: float, width: int, percent: int) -> DataFrame:
    """(token, salt, class, place, need) for every shingle of prefixes of _matches, which is need; salt is -1 but for shingles of an estimate of hot or more, place counts from 0 in the prefix of one match and is -1 beyond it. A class comes once a task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        met: set[int] = set()
        for batch in batches:
            tokens, salts, classes, places, needs = [], [], [], [], []
            for _, own in _sets(batch.column("text"), width):
                name = _class_of(own)
                if name is None or name in met:
                    continue
                met.add(name)
                own, estimate = _ordered(own, sketch)
                shorter = len(own) - _least(len(own), percent) + 1
                need = _matches(len(own), float(estimate[:shorter].mean()), percent)
                p = shorter + need - 1
                needs.append(np.full(p, need, np.int32))
                tokens.append(own[:p])
                places.append(np.where(np.arange(p) < shorter, np.arange(p), -1).astype(np.int32))
                salts.append(np.where(estimate[:p] >= hot, name % SALTS, -1).astype(np.int32))
                classes.append(np.full(p, name, np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(salts)), pa.array(np.concatenate(classes)), pa.array(np.concatenate(places)), pa.array(np.concatenate(needs))], ["token", "salt", "class", "place", "need"])
        give_back()

    return docs.select(F.col("text").cast("string")).mapInArrow(scan, "token bigint, salt int, class bigint, place int, need int")


def _whole_sets(docs: DataFrame, wanted: DataFrame, order: Broadcast, width: int) -> DataFrame:
    """(class, n, tokens in global order) of the classes in wanted (class, doc_id of one member).

    A bitmap over hashed doc_ids, of 16 bits for each wanted one and 2**28 (32 MB) at most, lets other documents be skipped
    where they are read.
    """
    spark = docs.sparkSession
    bits = min(28, max(20, (16 * wanted.count()).bit_length()))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))  # the bitmap functions count from 1
    rows = wanted.select((bit + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    bitmap = np.zeros(1 << bits - 3, np.uint8)
    for row in rows:  # rows of 4 kB, as many as the bitmap has
        at = (row["n"] - 1) * 4096
        own = np.frombuffer(row["bits"], np.uint8)
        bitmap[at : at + len(own)] = own
    shared = spark.sparkContext.broadcast(bitmap)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sketch = shared.value, order.value
        met: set[int] = set()
        for batch in batches:
            at = batch.column("bit").to_numpy()
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7)) & 1).cast(pa.bool_()))
            classes, tokens, size = [], [], 0

            def flush() -> pa.RecordBatch:
                sizes = np.array([len(t) for t in tokens], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(tokens).view(np.int64)))
                return pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sizes), lists], ["class", "n", "tokens"])

            for _, own in _sets(batch.column("text"), width):
                name = _class_of(own)
                if name is None or name in met:
                    continue
                met.add(name)
                classes.append(name)
                tokens.append(_ordered(own, sketch)[0])
                size += len(own)
                if size >= 1 << 20:
                    yield flush()
                    classes, tokens, size = [], [], 0
            if classes:
                yield flush()
        give_back()

    plain = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).withColumn("bit", bit)
    # other documents that the bitmap lets through do no harm: nothing is joined with their classes
    return plain.mapInArrow(scan, "class bigint, n bigint, tokens array<bigint>")


def _may_link(n, m, differ, percent: int):
    """False if sizes or bits that differ rule a link out: 100 (n + m - d) / 2 < percent (n + m + d) / 2 for d shingles in one set only."""
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (differ * (100 + percent) <= (100 - percent) * (n + m))


def _may_start(left, right, both, percent: int):
    """False if a shingle can't be the first that linked sets share: no more than the shingles from it on, left and right, can be shared."""
    return (100 + percent) * F.least(left, right) >= percent * both


def _differ(x: list, y: list):
    return sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(x, y)), F.lit(0))


def _near(pairs: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of classes that their sizes and whole bitmaps (class, n, parity) do not rule out."""
    bits = [[F.col(f"{side}.parity")[i] for i in range(PARITY_LONGS)] for side in "xy"]
    joined = pairs.join(light.select(F.col("class").alias("a"), F.struct("n", "parity").alias("x")), "a").join(light.select(F.col("class").alias("b"), F.struct("n", "parity").alias("y")), "b")
    return joined.where(_may_link(F.col("x.n"), F.col("y.n"), _differ(*bits), percent)).select(*pairs.columns)


def _need(percent: int, cost: str):
    """Shingles that a set of n asks for once the candidates it meets are counted."""
    least = F.ceil(F.lit(percent) * F.col("n") / 100)
    return F.least(least, F.lit(1) + F.floor(F.col("n") / MATCH_STEP) + F.floor(F.sqrt(cost))), least


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b, cost_a, cost_b) of classes that pass the prefix test, with prefixes lengthened by cost, and whose whole sets link."""
    sides = []
    for side, tokens in (("a", "x"), ("b", "y")):
        need, least = _need(percent, f"cost_{side}")
        own = (sides[0] if sides else pairs).join(sets.select(F.col("class").alias(side), "n", "tokens"), side)
        prefix = F.slice("tokens", F.lit(1), (F.col("n") - least + need).cast("int"))
        sides.insert(0, own.select(*[c for c in own.columns if c not in ("n", "tokens")], need.alias(f"need_{side}"), prefix.alias(f"prefix_{side}"), F.col("tokens").alias(tokens)))
    passed = sides[0].where(F.size(F.array_intersect("prefix_a", "prefix_b")) >= F.least("need_a", "need_b"))
    shared = F.size(F.array_intersect("x", "y"))
    return passed.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b").distinct()


def _shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of x shares with each set of y."""
    out = np.zeros((len(x), len(y)), np.float32)
    flat = [np.concatenate(side) for side in (x, y)]
    both = np.intersect1d(*flat)
    if not len(both):
        return out.astype(np.int64)
    entries = []
    for side, tokens in zip((x, y), flat):
        at = np.searchsorted(both, tokens)
        at[at == len(both)] = 0
        held = both[at] == tokens
        column, row = at[held], np.repeat(np.arange(len(side)), [len(t) for t in side])[held]
        order = np.argsort(column, kind="stable")
        entries.append((column[order], row[order]))
    for i in range(0, len(both), _COLUMNS):
        parts = []
        for side, (column, row) in zip((x, y), entries):
            a, b = np.searchsorted(column, [i, i + _COLUMNS])
            part = np.zeros((len(side), min(_COLUMNS, len(both) - i)), np.float32)
            part[row[a:b], column[a:b] - i] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def _links_between(x: list[tuple], y: list[tuple], percent: int) -> np.ndarray:
    """Which sets of x link to which of y; rows are (class, copies, need, prefix, tokens)."""
    need = np.minimum.outer([r[2] for r in x], [r[2] for r in y])
    found = _shared_counts([r[4][: r[3]] for r in x], [r[4][: r[3]] for r in y]) >= need
    a, b = np.flatnonzero(found.any(axis=1)), np.flatnonzero(found.any(axis=0))
    if len(a):
        shared = _shared_counts([x[i][4] for i in a], [y[i][4] for i in b])
        total = np.add.outer([len(x[i][4]) for i in a], [len(y[i][4]) for i in b])
        found[np.ix_(a, b)] &= 100 * shared >= percent * (total - shared)
    return found


def _compared(blocks: DataFrame, percent: int) -> DataFrame:
    """(class, others, linked): linked classes greater than class, and the documents of all linked classes, for every pair of blocks (low, high) that a class is in."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, classes, others, linked, size = ["class", "others", "linked"], [], [], [], 0

        def compare(key: tuple, sides: tuple[dict, dict]) -> int:
            x = list(sides[0].values())
            y = x if key[0] == key[1] else list(sides[1].values())
            if not x or not y or (x is y and len(x) < 2):
                return 0
            found = _links_between(x, y, percent)
            if x is y:
                np.fill_diagonal(found, False)
            n = 0
            for left, right, links in ((x, y, found),) if x is y else ((x, y, found), (y, x, found.T)):
                ids, copies = np.array([r[0] for r in right], np.int64), np.array([r[1] for r in right], np.int64)
                for i in np.flatnonzero(links.any(axis=1)):
                    own = ids[links[i]]
                    classes.append(left[i][0])
                    others.append(own[own > left[i][0]])
                    linked.append(int(copies[links[i]].sum()))
                    n += len(own)
            return n

        def flush() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(o) for o in others])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(others)))
            return pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), lists, pa.array(linked, pa.int64())], names)

        key, sides = None, ({}, {})
        for batch in batches:
            low, high, block, name, copies, need, prefix = (batch.column(c).to_numpy().tolist() for c in ("low", "high", "block", "class", "copies", "need", "prefix"))
            lists = batch.column("tokens")
            offsets, tokens = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i in range(batch.num_rows):
                if (low[i], high[i]) != key:
                    if key:
                        size += compare(key, sides)
                        if size >= 1 << 18:
                            yield flush()
                            classes, others, linked, size = [], [], [], 0
                    key, sides = (low[i], high[i]), ({}, {})
                # a set may come from several tasks
                sides[int(block[i] != low[i])][name[i]] = (name[i], copies[i], need[i], prefix[i], tokens[offsets[i] : offsets[i + 1]].copy())
        if key:
            compare(key, sides)
        if classes:
            yield flush()
        give_back()

    dealt = blocks.repartition("low", "high").sortWithinPartitions("low", "high")
    return dealt.mapInArrow(scan, "class bigint, others array<bigint>, linked bigint")


def _grouped(docs: DataFrame, width: int, percent: int) -> tuple:
    """Every document with its component, and what _all_links goes on from."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    classes, sketch = set_classes(docs, width)
    hot, order = max(HOT, HOT_MEANS * float(sketch.mean())), docs.sparkSession.sparkContext.broadcast(sketch)
    del sketch
    give_back()
    one = F.min(F.struct("doc_id", "n_shingles", "parity")).alias("one")
    members = written(classes.where("class is not null").groupBy("class").agg(one, F.min("doc_id").alias("name"), F.count("*").alias("copies")).select("class", "name", "one.doc_id", F.col("one.n_shingles").alias("n"), "one.parity", "copies"), "members")
    light = members.select("class", "n", "parity")

    # places where linked sets must meet: prefix shingles that two classes share
    spot = Window.partitionBy("token", "salt")
    met = _postings(docs, order, hot, width, percent).repartition("token", "salt")
    met = met.select("token", "salt", "class", "place", "need", F.min("need").over(spot).alias("least"), F.min("class").over(spot).alias("low"), F.max("class").over(spot).alias("high"), F.count("*").over(spot).alias("members"))
    met = met.where("low <> high or salt >= 0").groupBy("token", "salt", "class").agg(F.max("place").alias("place"), F.max("members").alias("members"), F.max("need").alias("need"), F.min("least").alias("least"))
    shared = written(met, "shared")
    # a set goes unless it shares as many as it asks for itself, or as the least demanding set that it meets, or the smallest it could link to, asks for
    smallest = F.ceil(F.lit(percent) * F.col("n") / 100)
    counted = shared.groupBy("class").agg(F.count("*").alias("met"), F.sum(F.when(F.col("place") >= 0, F.col("members")).otherwise(0)).alias("weight"), F.least(F.max("need"), F.min("least")).alias("asked"))
    enough = counted.join(light.select("class", "n"), "class").where(F.col("met") >= F.greatest("asked", F.lit(1) + F.floor(smallest / MATCH_STEP)))
    places = shared.where("place >= 0").join(enough.select("class", "weight"), "class").select("token", "salt", "class", "place", "weight", "members")

    # hubs: the members that meet most others
    hub = F.max(F.struct("weight", "class")).over(spot)
    weighed = written(places.select("token", "salt", "class", "place", "weight", "members", hub["class"].alias("hub"), hub["weight"].alias("hub_weight")), "places")
    hubs = weighed.where("salt >= 0 and class = hub").select("token", "class", "weight")
    over = hubs.groupBy("token").agg(F.max(F.struct("weight", "class")).alias("over"))
    spokes = weighed.select(F.col("class").alias("a"), F.col("hub").alias("b"), F.col("weight").alias("cost_a"), F.col("hub_weight").alias("cost_b"))
    spokes = spokes.unionAll(hubs.join(over, "token").select(F.col("class").alias("a"), F.col("over.class").alias("b"), F.col("weight").alias("cost_a"), F.col("over.weight").alias("cost_b")))
    turned = F.col("a") > F.col("b")
    spokes = spokes.where("a <> b").select(*[F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("cost_a", "cost_b"), ("cost_b", "cost_a"))])
    spokes = spokes.groupBy("a", "b").agg(F.max("cost_a").alias("cost_a"), F.max("cost_b").alias("cost_b"))

    def sets_of(pairs: DataFrame) -> DataFrame:
        named = pairs.select(F.col("a").alias("class")).unionAll(pairs.select(F.col("b").alias("class"))).distinct()
        wanted = written(members.select("class", "doc_id").join(named, "class", "left_semi"), "wanted")
        return written(_whole_sets(docs, wanted, order, width), "sets")

    near = written(_near(spokes, light, percent), "near")
    links = written(_linked(near, sets_of(near), percent), "links")
    components = connected_components(links)

    # what is left: pairs of different components
    named = weighed.join(components, F.col("class") == F.col("id"), "left").select("token", "salt", "class", "place", F.coalesce("component", "class").alias("component"), "weight")
    several = named.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    mixed = looked_up(named, several, "token", "class")
    # bitmaps folded to 256 bits are enough to rule out most pairs where they meet
    folded = [reduce(Column.bitwiseXOR, (F.col("parity")[i] for i in range(k, PARITY_LONGS, FOLDED))).alias(f"bits{k}") for k in range(FOLDED)]
    left = written(mixed.join(light.select("class", "n", *folded), "class"), "left")
    # the members of a frequent shingle are dealt to PARTS tasks, in each of which they meet all members
    part = F.when(F.col("salt") >= 0, F.pmod(F.xxhash64("class"), F.lit(PARTS))).otherwise(0)
    every = F.when(F.col("salt") >= 0, F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    x, y = left.withColumn("meet", part).alias("x"), left.withColumn("meet", F.explode(every)).alias("y")
    bits = [[F.col(f"{side}.bits{k}") for k in range(FOLDED)] for side in "xy"]
    pairs = x.join(
        y,
        (F.col("x.token") == F.col("y.token"))
        & (F.col("x.meet") == F.col("y.meet"))
        & (F.col("x.class") < F.col("y.class"))
        & (F.col("x.component") != F.col("y.component"))
        & _may_start(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"), F.col("x.n") + F.col("y.n"), percent)
        & _may_link(F.col("x.n"), F.col("y.n"), _differ(*bits), percent),
    )
    pairs = pairs.groupBy(F.col("x.class").alias("a"), F.col("y.class").alias("b")).agg(F.max("x.weight").alias("cost_a"), F.max("y.weight").alias("cost_b"))
    pairs = written(_near(pairs, light, percent), "pairs")
    more = written(_linked(pairs, sets_of(pairs), percent), "links")
    if more.limit(1).count():
        # only components that the new links join have to be followed
        of = components.withColumnRenamed("component", "of")
        joined = more.join(of.withColumnRenamed("id", "a"), "a", "left").withColumn("a", F.coalesce("of", "a")).drop("of")
        joined = joined.join(of.withColumnRenamed("id", "b"), "b", "left").withColumn("b", F.coalesce("of", "b")).drop("of")
        merged = connected_components(joined.where("a <> b").distinct())
        over = merged.select(F.col("id").alias("component"), F.col("component").alias("over"))
        grown = components.join(over, "component", "left").select("id", F.coalesce("over", "component").alias("component"))
        components = written(grown.unionAll(merged.join(components.select("id"), "id", "left_anti").select("id", "component")), "components")

    # names of components: the smallest doc_id of all members
    joined = members.join(components, F.col("class") == F.col("id"), "left").select("class", F.coalesce("component", "class").alias("component"), "name")
    smallest = joined.groupBy("component").agg(F.min("name").alias("component_id"))
    final = looked_up(joined, smallest, "component", "class").select("class", "component_id")
    out = looked_up(classes, final, "class", "doc_id", "left").select("doc_id", "same", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "class")
    return out, members, weighed, components, sets_of


def _all_links(members: DataFrame, weighed: DataFrame, components: DataFrame, sets_of, percent: int) -> DataFrame:
    """(class, others, linked) of every pair of blocks, as _compared has them."""
    spots = weighed.join(components, F.col("class") == F.col("id")).select("token", "class", F.col("component"), "weight", "members")
    # a class belongs to the place where most others are met
    anchors = spots.groupBy("class", "component").agg(F.max(F.struct("members", "token"))["token"].alias("anchor"), F.max("weight").alias("weight"))
    anchors = written(anchors.join(members.select("class", "n", "copies"), "class"), "anchors")
    parts = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).alias("parts")
    large = anchors.groupBy("component", "anchor").agg(parts).where("parts > 1")
    part = F.pmod(F.xxhash64("class"), F.coalesce("parts", F.lit(1)))
    need, least = _need(percent, "weight")
    blocks = anchors.join(large, ["component", "anchor"], "left").select("class", F.xxhash64("component", "anchor", part).alias("block"), "copies", need.alias("need"), (F.col("n") - least + need).alias("prefix"))
    blocks = written(blocks, "blocks")

    at = written(spots.join(blocks.select("class", "block"), "class").select("token", "component", "block").distinct(), "at")
    x, y = at.withColumnRenamed("block", "low"), at.withColumnRenamed("block", "high")
    pairs = x.join(y, ["token", "component"]).where("low <= high").select("low", "high").distinct()
    pairs = pairs.select("low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    named = blocks.select(F.col("class").alias("a"), F.col("class").alias("b"))
    return written(_compared(pairs.join(blocks, "block").join(sets_of(named).select("class", "tokens"), "class"), percent), "links")


def near_copies(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, component_id, class, n_links) of every document, and all links (a, b), a < b, between classes.

    ``n_links`` counts the other documents that link to a document, those of its own class too.
    """
    found, members, *rest = _grouped(docs, width, percent)
    listed = _all_links(members, *rest, percent)
    others = listed.groupBy("class").agg(F.sum("linked").alias("linked"))
    counts = members.select("class", "copies").join(others, "class", "left").select("class", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = looked_up(found, counts, "class", "doc_id", "left").select("doc_id", "n_shingles", "component_id", "class", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    return out, listed.select(F.col("class").alias("a"), F.explode("others").alias("b"))


def keep_one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs without the documents of a component that has a smaller doc_id; all columns as they were.

    Rows of one doc_id are judged by their texts; repeated rows with the same text stay once. Rows without a doc_id stay.
    """
    found = _grouped(docs, width, percent)[0]
    gone = found.where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("_gone"), F.col("same").alias("_same")).distinct()
    kept = docs.join(gone, (docs["doc_id"].cast("bigint") == gone["_gone"]) & (_text_hash(docs) == gone["_same"]), "left_anti")
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    return kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(kept.where("doc_id is null")) if repeated else kept
