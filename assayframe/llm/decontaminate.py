"""Benchmark decontamination with suffix arrays of the training text.

Every task turns its documents into shards of about ``SHARD_WORDS`` words (documents stay whole) and builds a suffix
array over each shard's words. Words that no benchmark item has are one symbol that matches nothing, as are document
ends, and suffixes that meet one before the shortest window's length are left out of the array, as no window can
start there. Every suffix of every benchmark item is then binary-searched in the array by the window it begins with.
Suffixes that begin with equal windows are searched once, so a place of the text meets at most one window of each
length, however often items and text repeat themselves. Hits are marked from those places, items are named from the
distinct (document, window) pairs. The longest verbatim matches follow from the benchmark's own suffix array: from the
first hit place of a document on, the longest match that begins there, then the next place whose window reaches beyond
it, and so on; each match names one item that has it, and where.

The benchmark's suffix array is built once, by prefix doubling, and sent to the executors as arrays, in blocks of about ``BLOCK_BYTES`` of text. Blocks are
run one after the other, each written before the next begins, so a larger benchmark costs more passes but no more memory, on no machine.

A window is ``width`` consecutive words of an item, or the whole item if it has fewer (but at least one). A document
word inside any occurrence is hit. A document is contaminated if 0 < n_hit and 20 * n_hit >= n_words.

Defined cases: a null or empty text has no words, is not hit and stays; items without words or with null text have no
window; an item with a null item_id hits words but is not listed; repeated rows give repeated results; equal item_ids
are listed once; an empty table gives no row; extra columns pass through ``remove_contaminated`` unchanged; a column
in ``keep`` that is called as a result is comes back as ``kept_`` and its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm._shared import bounded_batches, give_back, written
from assayframe.llm._words import ALNUM, Words, slices, spread, string_buffers

WIDTH = 13
SHARD_WORDS, BLOCK_BYTES = 1 << 19, 32 << 20
#: bytes of text turned into words, and (document, window) pairs turned into items, at a time
_CHUNK, _PAIRS = 1 << 18, 1 << 20
#: symbols compared at a time
_COMPARED = 1 << 20
FOUND = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, item_ids array<bigint>, matches array<struct<item_id:bigint,item_word:bigint,doc_word:bigint,n_words:bigint>>"
RESULTS = ("n_words", "n_hit", "item_ids", "matches", "contaminated")


class Benchmark:
    """The words of some items as symbols from 1 up, with 0 after each item; its suffix array, and its distinct windows.

    ``order`` has all suffixes that have a whole window, sorted, so equal windows lie side by side: window w is
    ``order[edge[w]:edge[w + 1]]``.
    """

    def __init__(self, items: list[tuple[int | None, str]], width: int):
        items = sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        raw, offsets = string_buffers(pa.array([t for _, t in items], pa.large_string()))
        words = Words(raw, offsets, ALNUM)
        hashes = words.hashes()
        self.known = np.unique(hashes)
        counts = np.diff(words.first)
        place = words.first[:-1] + np.arange(len(items))  # a 0 after every item
        self.symbols = np.zeros(len(hashes) + len(items) + 1, np.int32)
        owner = np.repeat(np.arange(len(items)), counts)
        self.symbols[np.arange(len(hashes)) + owner] = np.searchsorted(self.known, hashes) + 1
        # every suffix that has a whole window: its place, that window's length, its item
        lengths = np.minimum(counts, width)
        n = np.where(counts > 0, counts - lengths + 1, 0)
        item = np.repeat(np.arange(len(items)), n)
        word = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = place[item] + word
        order = np.argsort(suffix_ranks(self.symbols)[at], kind="stable")
        self.item, self.word, self.at, self.length = (x[order].astype(np.int32) for x in (item, word, at, lengths[item]))
        new = np.ones(len(order), bool)
        new[1:] = self.length[1:] != self.length[:-1]
        for d in range(width):
            inside = np.flatnonzero(~new & (self.length > d))
            new[inside] = self.symbols[self.at[inside] + d] != self.symbols[self.at[inside - 1] + d]
        self.first = np.flatnonzero(new).astype(np.int32)
        self.edge = np.append(self.first, np.int32(len(order)))
        self.window_at, self.window_length = self.at[self.first], self.length[self.first]
        self.ids = np.array([i if i is not None else -1 for i, _ in items], np.int64)
        self.named = np.array([i is not None for i, _ in items], bool)
        self.least = int(self.length.min()) if len(order) else 0
        self.most = int(self.length.max()) if len(order) else 1

    def symbols_of(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, hashes)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == hashes, at + 1, 0).astype(np.int32) if len(self.known) else np.zeros(len(hashes), np.int32)

    def longest(self, symbols: np.ndarray, place: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For places of a text that begin with the given windows: the item suffix with the longest match, and its length."""
        low, high = self.edge[window].copy(), self.edge[window + 1].copy()
        best, most = low.copy(), np.zeros(len(place), np.int64)
        # binary search for where the text's suffix belongs; the best is the longest met on the way there
        open_ = np.arange(len(place))
        while len(open_):
            mid = (low[open_] + high[open_]) // 2
            same = agreement(symbols, place[open_], self.symbols, self.at[mid].astype(np.int64), self.window_length[window[open_]].astype(np.int64))
            less = symbols[place[open_] + same] > self.symbols[self.at[mid] + same]
            better = (same > most[open_]) | ((same == most[open_]) & (mid < best[open_]))
            best[open_[better]], most[open_[better]] = mid[better], same[better]
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
            open_ = open_[low[open_] < high[open_]]
        return best, most


def agreement(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, done: np.ndarray) -> np.ndarray:
    """How long the symbols from each place of a and of b agree, up to the first 0; they do for ``done`` symbols. Widths double, so long matches take few steps."""
    same, live, width = done.copy(), np.arange(len(done)), 4
    while len(live):
        w = max(1, min(width, _COMPARED // len(live)))
        ahead = same[live, None] + np.arange(w)
        x, y = a[np.minimum(a_at[live, None] + ahead, len(a) - 1)], b[np.minimum(b_at[live, None] + ahead, len(b) - 1)]
        on = (x == y) & (x > 0)
        whole = on.all(axis=1)
        same[live] += np.where(whole, w, on.argmin(axis=1))
        live, width = live[whole], 2 * width
    return same


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """The place of every suffix among all, sorted; a 0 ends an item, and ends of earlier items come first. Compared lengths double, so n log(n)**2 steps do for any text."""
    n, zero = len(symbols), symbols == 0
    rank = np.where(zero, np.cumsum(zero) - 1, np.count_nonzero(zero) + symbols.astype(np.int64))
    width = 1
    while True:
        key = rank * (n + int(symbols.max(initial=0)) + 2)
        key[: max(0, n - width)] += rank[width:] + 1
        found, rank = np.unique(key, return_inverse=True)
        if len(found) == n or width >= n:
            return rank
        width *= 2


def suffix_array(symbols: np.ndarray, starts: np.ndarray, depth: int, n_symbols: int) -> np.ndarray:
    """``starts`` sorted by the first ``depth`` symbols that follow; symbols must end in 0, which goes on for ever."""
    bits = max(1, int(n_symbols).bit_length())
    each = max(1, 62 // bits)

    last = len(symbols) - 1

    def key(at: np.ndarray, done: int) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for k in range(each):
            out = (out << bits) | symbols[np.minimum(at + (done + k), last)]
        return out

    first = key(starts, 0)
    order = np.argsort(first, kind="stable")
    sorted_key = first[order]
    group = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
    done = each
    while done < depth and len(order):
        tied = np.zeros(len(order), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        where = np.flatnonzero(tied)
        if not len(where):
            break
        more = key(starts[order[where]], done)
        again = np.lexsort((more, group[where]))
        order[where] = order[where][again]
        more = more[again]
        step = np.zeros(len(order), np.int64)
        step[where[1:]] = (group[where[1:]] == group[where[:-1]]) & (more[1:] != more[:-1])
        new = np.concatenate([[0], group[1:] != group[:-1]]).astype(np.int64) | step
        group = np.cumsum(new)
        done += each
    return starts[order]


def search(symbols: np.ndarray, array: np.ndarray, patterns: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals [low, high) of the suffix array that begin with patterns[at:at+length], for many at once."""

    def compare(mid: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Sign of suffix minus pattern over the pattern's length."""
        out = np.zeros(len(which), np.int64)
        left = np.arange(len(which))
        d = 0
        while len(left):
            diff = symbols[array[mid[left]] + d].astype(np.int64) - patterns[at[which[left]] + d]
            out[left] = np.sign(diff)
            d += 1
            left = left[(diff == 0) & (length[which[left]] > d)]
        return out

    bounds = []
    for upper in (False, True):
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(array), np.int64)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) // 2
            sign = compare(mid, open_)
            right = sign <= 0 if upper else sign < 0
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]
            open_ = open_[low[open_] < high[open_]]
        bounds.append(low)
    return bounds[0], bounds[1]


class Shard:
    """The words of some documents against a benchmark: where which windows occur."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, bench: Benchmark):
        self.bench, n_docs = bench, len(counts)
        self.begin = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) + np.arange(n_docs)
        self.total = int(counts.sum()) + n_docs
        self.symbols = np.zeros(self.total + bench.most + 1, np.int32)
        self.symbols[np.arange(len(hashes)) + np.repeat(np.arange(n_docs), counts)] = bench.symbols_of(hashes)
        # suffixes of known words that are as long as the shortest window
        change = np.flatnonzero(np.diff(np.concatenate([[0], (self.symbols > 0).view(np.int8), [0]])))
        start, size = change[::2], change[1::2] - change[::2] - max(1, bench.least) + 1
        starts = spread(start[size > 0], size[size > 0])
        array = suffix_array(self.symbols, starts, bench.most, len(bench.known) + 1)
        low, high = search(self.symbols, array, bench.symbols, bench.window_at, bench.window_length)
        self.window = np.repeat(np.arange(len(low)), high - low)
        self.place = array[spread(low, high - low)]

    def doc(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, place, side="right") - 1

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of hit words start and end."""
        edge = np.bincount(self.place, minlength=self.total + 1) - np.bincount(self.place + self.bench.window_length[self.window], minlength=self.total + 1)
        hit = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
        change = np.flatnonzero(hit[1:] != hit[:-1])  # separators are never hit
        return change[::2], change[1::2]

    def items(self) -> np.ndarray:
        """Distinct (document, item id) pairs, sorted."""
        bench, n = self.bench, len(self.bench.first)
        pairs = np.unique(self.doc(self.place) * n + self.window) if n else np.zeros(0, np.int64)
        doc, window = pairs // max(n, 1), pairs % max(n, 1)
        sizes = bench.edge[window + 1] - bench.edge[window]
        found, ends = [np.zeros((2, 0), np.int64)], np.concatenate([[0], np.cumsum(sizes)])
        i = 0
        while i < len(pairs):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + _PAIRS, side="right")) - 1)
            item = bench.item[spread(bench.edge[window[i:j]], sizes[i:j])]
            both = np.stack([np.repeat(doc[i:j], sizes[i:j]), bench.ids[item]])[:, bench.named[item]]
            found.append(np.unique(both, axis=1))
            i = j
        return np.unique(np.concatenate(found, axis=1), axis=1)

    def matches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the longest matches in order, their item suffixes and lengths."""
        bench = self.bench
        # the longest window of each place
        order = np.lexsort((bench.window_length[self.window], self.place))
        place, window = self.place[order], self.window[order]
        last = np.append(place[1:] != place[:-1], True)[: len(place)]
        place, window = place[last], window[last]
        reach = np.maximum.accumulate(place + bench.window_length[window]) if len(place) else place
        doc = self.doc(place)
        at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])[: len(place)])
        found = []
        while len(at):
            suffix, n = bench.longest(self.symbols, place[at], window[at])
            found.append((place[at], suffix, n))
            # the next place whose window goes beyond this match
            after = np.maximum(np.searchsorted(reach, place[at] + n, side="right"), at + 1)
            ok = after < len(place)
            ok[ok] = doc[after[ok]] == doc[at[ok]]
            at = after[ok]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        place, suffix, n = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(place, kind="stable")
        return place[order], suffix[order], n[order]


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), values)


def _findings(hashes: np.ndarray, counts: np.ndarray, bench: Benchmark) -> dict[str, pa.Array]:
    """The columns of FOUND for the documents of one shard."""
    shard, n = Shard(hashes, counts, bench), len(counts)
    start, end = shard.spans()
    owner = shard.doc(start)
    spans = pa.StructArray.from_arrays([pa.array(start - shard.begin[owner]), pa.array(end - shard.begin[owner])], ["start", "end"])
    pairs = shard.items()
    place, suffix, length = shard.matches()
    doc, item = shard.doc(place), bench.item[suffix]
    matches = pa.StructArray.from_arrays(
        [pa.array(bench.ids[item], pa.int64(), mask=~bench.named[item]), pa.array(bench.word[suffix], pa.int64()), pa.array(place - shard.begin[doc]), pa.array(length)],
        ["item_id", "item_word", "doc_word", "n_words"],
    )
    return {"n_words": pa.array(counts), "spans": _lists(owner, n, spans), "item_ids": _lists(pairs[0], n, pa.array(pairs[1])), "matches": _lists(doc, n, matches)}


def _scan(rows: DataFrame, items: list[tuple[int | None, str]], width: int) -> DataFrame:
    """rows (_row, _text) to _row and FOUND."""
    shared = rows.sparkSession.sparkContext.broadcast(Benchmark(items, width))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        rows: list[pa.Array] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found = _findings(np.concatenate(held), np.concatenate(counts), bench)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(rows), *found.values()], ["_row", *found])

        for batch in batches:
            raw, offsets = string_buffers(batch.column("_text"))
            for i, j in slices(offsets, _CHUNK):
                words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
                held.append(words.hashes())
                counts.append(np.diff(words.first))
                rows.append(batch.column("_row").slice(i, j - i))
                size += len(held[-1])
                if size >= SHARD_WORDS:
                    yield flush()
                    held, counts, rows, size = [], [], [], 0
        if rows:
            yield flush()
        give_back()

    return rows.mapInArrow(shards, f"_row {rows.schema['_row'].dataType.simpleString()}, {FOUND}")


def _covered(spans):
    """Words in the union of spans."""
    grown = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["end"]).alias("end"), (s["n"] + F.greatest(F.lit(0).cast("bigint"), x["end"] - F.greatest(x["start"], s["end"]))).alias("n")),
    )
    return grown["n"]


def _by_blocks(docs: DataFrame, items: DataFrame, passes: int, width: int) -> DataFrame:
    """docs (_row, _text) with the findings of all blocks together, one block at a time."""
    rows = written(docs.withColumn("_id", F.monotonically_increasing_id()), "rows")
    texts = rows.select(F.struct("_id").alias("_row"), "_text")
    every = None
    for i in range(passes):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i)
        found = written(_scan(texts, [tuple(r) for r in block.collect()], width), "block")
        every = found if every is None else every.unionAll(found)
    merged = every.groupBy("_row._id").agg(
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.flatten(F.collect_list("item_ids")).alias("item_ids"),
        F.flatten(F.collect_list("matches")).alias("matches"),
    )
    return rows.select("_id", "_row").join(merged, "_id").drop("_id")


def _found(docs: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """docs (_row, _text) to _row and the columns of RESULTS."""
    bounded_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("text is not null")
    bytes_ = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-bytes_ // BLOCK_BYTES) or 1
    found = _scan(docs, [tuple(r) for r in items.collect()], width) if passes == 1 else _by_blocks(docs, items, passes, width)
    n_hit = _covered(F.col("spans"))
    return found.select(
        "_row",
        "n_words",
        n_hit.alias("n_hit"),
        F.array_sort(F.array_distinct(F.transform("item_ids", lambda i: i.cast("string")))).alias("item_ids"),
        "matches",
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id (and the columns in keep), n_words, n_hit, item_ids (as strings, sorted), matches, contaminated."""
    names = ["doc_id", *(c for c in keep if c != "doc_id")]
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), docs["text"].cast("string").alias("_text"))
    kept = [F.col("_row").getField(c).alias(f"kept_{c}" if c in RESULTS else c) for c in names]
    return _found(rows, benchmark, width).select(*kept, *RESULTS)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs without contaminated rows, all columns as they were."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["text"].cast("string").alias("_text"))
    return _found(rows, benchmark, width).where("not contaminated").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
