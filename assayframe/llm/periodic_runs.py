"""Periodic runs: maximal stretches of words that repeat with a period at least three times.

A run is a stretch of words with smallest period q and a length of at least LEAST words and TIMES * q, which no neighbouring word extends
keeping period q. Word i and word i + q are equal from a run's first word on for length - q places, so a run is a maximal interval of such places,
of at least max(LEAST - q, 2 * q) of them.

Periods are searched by octave: scale k >= 4 has periods of 2**k to 2**(k+1) - 1, the first scale those below 16. A scale sets a boundary every
C words (C = 2**k, or 8); the interval of a run covers a whole block of C words from one boundary on. Each boundary is a problem of its own, of
a window of a few C words: the screen keeps the periods at which its block stands again, forward and backward Z-values (the lengths to
which the text after and before the boundary agrees with itself a period on, found by block doubling) give the fragment of the interval
that lies in the window, and a fragment is kept if it is at least q long and q is the smallest period of what it spans. In a run every
boundary's fragment is, and multiples of a smaller period are not, so each scale keeps a few fragments for each boundary at most.
Fragments of one document and period that touch are stitched into whole intervals.

A text of up to SPAN characters is one tile of every scale: its fragments are stitched where they are made. A longer one is exploded into
overlapping tiles for each scale, of those boundaries only that the screen leaves; tiles are dealt to all tasks, solved on their own, and their fragments are
shuffled by document and period and stitched by a window. So is one text spread over a cluster, while most never leave their task. Copies of
a long text are solved once. Words are compared by 64-bit hashes, blocks by 64-bit hashes of these, which are mixed at every doubling; two
blocks that differ agree with a probability of 2**-64.

Work is n log(n) word operations for a text of n words, memory some 8 * log(n) bytes a word of about SLICE bytes of text or one long text.

Defined cases: a null or empty text has no words and no runs; words are runs of what is no ASCII white space and differ by case. Ties and repeated
rows are kept as they are. Only the text is read: ids may be null or repeated, and other columns, whatever their names, are kept.
An empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from assayframe.llm._components import looked_up
from assayframe.llm._shared import bounded_batches
from assayframe.llm._words import NOT_SPACE, Words, mix, slices, string_buffers

LEAST, TIMES = 24, 3
#: characters up to which a text is one tile
SPAN = 1 << 16
#: bytes of text that are solved at a time, and words that a tile of a longer text has boundaries in, at least
SLICE, TILE = 1 << 20, 1 << 14
#: the first scale's boundaries and largest period
FIRST, FIRST_PERIOD = 8, 15

RUNS = T.ArrayType(T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")]))
_SPACE = re.compile("[ \t-\r]+")
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _doubled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of blocks of 2 * width from those of width."""
    out = h[width:] * _P1
    out ^= h[:-width]
    out *= _P2
    out ^= out >> np.uint64(32)
    return out


class Levels:
    """Hashes of all blocks of 1, 2, 4, ... words of one sequence."""

    def __init__(self, words: np.ndarray):
        self.blocks = [words]

    def __getitem__(self, j: int) -> np.ndarray:
        while len(self.blocks) <= j:
            last, width = self.blocks[-1], 1 << (len(self.blocks) - 1)
            self.blocks.append(_doubled(last, width) if len(last) > width else np.zeros(0, np.uint64))
        return self.blocks[j]

    def cut(self, n: int) -> None:
        """From now on only the first n words."""
        self.blocks = [b[: max(0, n - (1 << j) + 1)] for j, b in enumerate(self.blocks)]

    def same(self, j: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the blocks of 2**j words at a and b, of which b is later, are equal; False where one is not inside."""
        block = self[j]
        out = (a >= 0) & (b < len(block))
        out[out] = block[a[out]] == block[b[out]]
        return out


def _spf(n: int) -> np.ndarray:
    """The smallest prime factor of each number below n."""
    out = np.arange(n)
    for p in range(2, int(n**0.5) + 1):
        if out[p] == p:
            out[p * p :: p] = np.minimum(out[p * p :: p], p)
    return out


def screened(levels: Levels, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(boundary, period) of scale k (3: the first) where the boundary's block stands again a period on."""
    if k == 3:
        block = levels[3]
        at, period = [], []
        for q in range(1, FIRST_PERIOD + 1):
            found = np.flatnonzero(block[: max(0, len(block) - q) : FIRST] == block[q::FIRST]) * FIRST
            at.append(found)
            period.append(np.full(len(found), q))
        return np.concatenate(at), np.concatenate(period)
    width, block = 1 << k, levels[k]
    rows = len(block) // width
    grid = block[: rows * width].reshape(rows, width)
    row, column = np.nonzero(grid[1:] == grid[:-1, :1])
    at, period = row * width, column + width
    last = np.arange(rows * width, len(block))  # places behind the last whole row, which belong to its boundary
    if rows and len(last):
        more = last[block[last] == block[(rows - 1) * width]]
        at, period = np.concatenate([at, np.full(len(more), (rows - 1) * width)]), np.concatenate([period, more - (rows - 1) * width])
    return at, period


def fragments(levels: Levels, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, first, last + 1) of the parts of intervals that boundaries of scale k see; places of the sequence."""
    at, q = screened(levels, k)
    if not len(at):
        return at, at, at
    top = k + 1 if k > 3 else 5
    ahead, back = np.zeros_like(at), np.zeros_like(at)
    for j in range(top, -1, -1):  # Z-values forward and backward, up to four blocks
        ahead += levels.same(j, at + ahead, at + q + ahead) * (1 << j)
        back += levels.same(j, at - back - (1 << j), at + q - back - (1 << j)) * (1 << j)
    first, end = at - back, at + ahead
    keep = end - first >= q  # in a run the part in the window is never shorter
    q, first, end = q[keep], first[keep], end[keep]
    if not len(q):
        return q, first, end
    # a period that a prime part of it already is goes; the fragment spans two periods at least, so one period tells
    factor, rest, smallest = _spf(int(q.max()) + 1), q.copy(), np.ones(len(q), bool)
    while (open_ := rest > 1).any():
        p = factor[rest]
        part = q // np.maximum(p, 1)
        width = q - part
        level = np.frexp(np.maximum(width, 1))[1] - 1
        for j in np.unique(level[open_]):
            i = np.flatnonzero(open_ & (level == j))
            a, b = first[i], first[i] + part[i]
            shift = width[i] - (1 << int(j))
            smallest[i] &= ~(levels.same(int(j), a, b) & levels.same(int(j), a + shift, b + shift))
        while (again := open_ & (rest > 1) & (rest % np.maximum(p, 1) == 0)).any():
            rest[again] //= p[again]
    return q[smallest], first[smallest], end[smallest]


def stitched(q: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of one period that touch as one; sorted by period and place."""
    if not len(q):
        return q, first, end
    order = np.lexsort((first, q))
    q, first, end = q[order], first[order], end[order]
    new = np.ones(len(q), bool)
    high = int(end.max()) + 1
    reach = np.maximum.accumulate(end + q * high) - q * high  # the furthest end so far of this period
    new[1:] = (q[1:] != q[:-1]) | (first[1:] > reach[:-1])
    start = np.flatnonzero(new)
    return q[start], first[start], np.maximum.reduceat(end, start)


def scales(n: int) -> range:
    """The scales that a text of n words has periods of."""
    return range(3, max(4, (n // TIMES).bit_length())) if n >= LEAST else range(0)


def _sequence(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, start of each text, words of each text, rows from long to short): the words of all texts, a word of its own behind each text."""
    words = Words(raw, offsets, NOT_SPACE, fold=False)
    n = np.diff(words.first)
    rows = np.argsort(-n, kind="stable")
    size = n[rows] + 1
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint64)
    ends = start + size - 1
    inside = np.ones(len(out), bool)
    inside[ends] = False
    from_ = np.repeat(words.first[:-1][rows] - start, size) + np.arange(len(out))
    out[inside] = words.hashes()[from_[inside]]
    out[ends] = mix(np.arange(len(ends), dtype=np.uint64) + np.uint64(0xA0761D6478BD642F))
    return out, start, n[rows], rows


def runs_of(column: pa.Array, most: int = SLICE) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, by start and period."""
    raw, offsets = string_buffers(column)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
    for i, j in slices(offsets, most):
        hashes, start, n, rows = _sequence(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        levels, found = Levels(hashes), []
        for k in scales(int(n[0])):
            if k > 3:  # texts too short for these periods are at the end
                levels.cut(int((n[n >= TIMES << k] + 1).sum()))
            found.append(fragments(levels, k))
        if not found:
            continue
        q, first, end = stitched(*map(np.concatenate, zip(*found)))
        length = end - first + q
        keep = length >= np.maximum(LEAST, TIMES * q)
        q, first, length = q[keep], first[keep], length[keep]
        text = np.searchsorted(start, first, side="right") - 1
        for t, s, l, p in sorted(zip(text.tolist(), (first - start[text]).tolist(), length.tolist(), q.tolist())):
            out[i + int(rows[t])].append((s, l, p))
    return out


def collapsed_text(text: str, runs: list[tuple[int, int, int]]) -> str:
    """The words of a text joined by one space, of each run only the first period."""
    words = [w for w in _SPACE.split(text) if w]
    mark = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        mark[start + period] += 1
        mark[start + length] -= 1
    kept = np.cumsum(mark[:-1]) == 0
    return " ".join([w for w, k in zip(words, kept.tolist()) if k])


_STRUCT = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _listed(runs: list) -> pa.Array:
    return pa.array([[{"start": s, "length": l, "period": p} for s, l, p in own] for own in runs], pa.list_(_STRUCT))


@F.arrow_udf(T.StructType([T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]))
def _solved(texts: pa.Array) -> pa.Array:
    runs = runs_of(texts)
    shorter = [collapsed_text(t.as_py(), r) if r else None for t, r in zip(texts, runs)]
    return pa.StructArray.from_arrays([_listed(runs), pa.array(shorter, pa.string())], ["runs", "collapsed"])


@F.arrow_udf(T.StringType())
def _collapsed(texts: pa.Array, runs: pa.Array) -> pa.Array:
    return pa.array([collapsed_text(t.as_py() or "", [(x["start"], x["length"], x["period"]) for x in r.as_py() or []]) for t, r in zip(texts, runs)], pa.string())


TILES = "digest string, scale int, place bigint, words binary"


def _tiles(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[pa.RecordBatch]:
    """Long texts to overlapping tiles of each scale that the screen leaves boundaries in."""
    for batch in batches:
        for i in range(batch.num_rows):
            raw, offsets = string_buffers(batch.column("text").slice(i, 1))
            words = Words(raw, offsets, NOT_SPACE, fold=False).hashes()
            levels, digest = Levels(words), batch.column("digest")[i].as_py()
            for k in scales(len(words)):
                width = 1 << k
                span = max(tile, 8 * width)
                for t in np.unique(screened(levels, k)[0] // span).tolist():
                    low = max(0, t * span - 4 * width)
                    window = words[low : (t + 1) * span + 8 * width]
                    yield pa.RecordBatch.from_arrays([pa.array([digest]), pa.array([k], pa.int32()), pa.array([low], pa.int64()), pa.array([window.tobytes()], pa.binary())], ["digest", "scale", "place", "words"])


def _solved_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            low = batch.column("place")[row].as_py()
            words = np.frombuffer(batch.column("words")[row].as_py(), np.uint64)
            q, first, end = stitched(*fragments(Levels(words), batch.column("scale")[row].as_py()))
            digest = pa.array([batch.column("digest")[row].as_py()] * len(q), pa.string())
            yield pa.RecordBatch.from_arrays([digest, pa.array(q, pa.int64()), pa.array(first + low, pa.int64()), pa.array(end + low, pa.int64())], ["digest", "period", "first", "end"])


def tiled_runs(texts: DataFrame, tile: int = TILE) -> DataFrame:
    """(digest, runs) of those of ``texts`` (digest, text) that have runs, each text spread over tasks by tiles."""
    tiles = texts.mapInArrow(lambda b: _tiles(b, tile), TILES)
    dealt = tiles.groupBy("digest", "scale", "place").agg(F.first("words").alias("words"))  # tiles of copies once, and each on its own
    parts = dealt.mapInArrow(_solved_tiles, "digest string, period bigint, first bigint, end bigint")
    own = Window.partitionBy("digest", "period").orderBy("first", "end")
    reach = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = parts.withColumn("new", F.when(F.col("first") <= reach, 0).otherwise(1)).withColumn("nth", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    whole = marked.groupBy("digest", "period", "nth").agg(F.min("first").alias("start"), F.max("end").alias("end"))
    runs = whole.select("digest", "start", (F.col("end") - F.col("start") + F.col("period")).alias("length"), "period").where(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("period")))
    return runs.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct(F.col("start"), F.col("length"), F.col("period")))).alias("runs"))


def _one_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))


def find_runs(docs: DataFrame, text: str = "text", span: int = SPAN, tile: int = TILE) -> DataFrame:
    """docs with ``runs`` (by start, then period) and ``collapsed``, the text's words without repeats of a run's first period.

    (row, runs, collapsed): ``row`` holds the columns of docs.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text].alias("text"))
    long = F.length("text") > span
    short = rows.where(~F.coalesce(long, F.lit(False))).withColumn("found", _solved("text"))
    solved = short.select("row", F.coalesce("found.runs", F.array().cast(RUNS)).alias("runs"), F.coalesce("found.collapsed", _one_spaced(F.col("text"))).alias("collapsed"))
    longer = rows.where(long).withColumn("digest", F.sha2("text", 256))
    spread = looked_up(longer, tiled_runs(longer.select("digest", "text"), tile), "digest", F.col("row"), "left")
    told = spread.select("row", F.coalesce("runs", F.array().cast(RUNS)).alias("runs"), "text")
    return solved.unionByName(told.select("row", "runs", _collapsed("text", "runs").alias("collapsed")))
