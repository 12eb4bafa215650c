"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents confirmed as toxic. All documents that may be learnt from, these among them, are taken as
unlabelled, so the class prior is that of the whole corpus; what other labels say is not used but for the prior. Features are the words of a whole text (lower-cased A-Z) and their beginnings of ``PREFIXES`` bytes, hashed into
2**HASH_BITS buckets, each at three levels: there, there twice or more, and in that case at least every ``DENSE``-th word.

(1) One pass over all learning documents counts, for each bucket and level, the positives and the unlabelled documents
that have it; the number of counters is fixed. (2) Features become inputs of a linear model by their
evidence for toxicity, the log-likelihood ratio under the class prior. Its bounds follow the data: at most a share
``FALSE`` of the features taken may be there by chance, of as many as were looked at (Benjamini and Hochberg's rule), and
each has to save ``NATS`` for every positive. Where that leaves fewer than ``FEWEST``, the ``FEWEST`` with most evidence
are taken, so a few positives suffice for a model. (3) All learning documents are turned into the list of those features they have, and equal lists are counted
together, positives and unlabelled. (4) The model minimises the non-negative risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with logistic loss over all of that table: risk and gradient are
summed up in its partitions by numpy, and the driver takes quasi-Newton steps from the sums; steps that would make the
inner term negative are shortened. (5) The cut that scores of 0.7 stand for is where recall**2 over the rate of
predicted positives is best, which needs no negatives, from counts of all learning documents by their value. (6) Scores
of all documents come from one more pass. Nothing is sampled.

The class prior is the share of positives among labelled learning rows, which the caller may state instead. Of more than ``POSITIVES`` confirmed
positives an even share by hash of their ids is learnt from, so their ids can be sent to every executor and no text is shuffled.

Defined cases: null and empty texts have no features and get the model's base score; documents without a learning
label are unlabelled; labels of null are none; repeated label rows of a document count as toxic if any is; without
positives every score is 0; an empty table gives no row; extra columns pass through, and one that is called ``score``
comes back from ``score`` as ``kept_score``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm import _counts
from assayframe.llm._shared import bounded_batches, give_back, written
from assayframe.llm._words import ALNUM, Words, slices, string_buffers

HASH_BITS, LEVELS = 19, 3
PREFIXES = (4, 5, 6, 7, 8)
DENSE = 100
#: features that may be there by chance, as a share of those taken; nats that a feature saves for each positive; features that are taken at least
FALSE, NATS, FEWEST = 0.01, 0.12, 36
#: confirmed positives that are learnt from at most: 16 bytes each in every executor
POSITIVES = 2_000_000
STEPS, MEMORY, DECAY = 20, 8, 1e-3
THRESHOLD = 0.7
#: values of the linear model are counted in bins of this width, from -_RANGE to _RANGE
_BIN, _RANGE = 0.02, 40.0
#: bytes of text handled at a time: temporaries are about 100 times that
_CHUNK = 1 << 18
N_FEATURES = LEVELS << HASH_BITS
#: features that are weighed at a time
_SLICE = 1 << 16


def features_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, rows, features) of rows i to j of a column: the features that each row has, once each, by row."""
    raw, offsets = string_buffers(column)
    for i, j in slices(offsets, _CHUNK):
        words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
        n_words = np.diff(words.first)
        row = np.repeat(np.arange(j - i), n_words) << HASH_BITS
        salted = (words.hashes() if not k else words.hashes(k) * np.uint64(2 * k + 3) for k in (0, *PREFIXES))
        keys = np.sort(np.concatenate([row | (h >> np.uint64(64 - HASH_BITS)).astype(np.int64) for h in salted]))
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        times = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        rows, bucket = keys >> HASH_BITS, keys & ((1 << HASH_BITS) - 1)
        twice = np.flatnonzero(times >= 2)
        dense = twice[times[twice] * DENSE >= n_words[rows[twice]]]
        rows, found = np.concatenate([rows, rows[twice], rows[dense]]), np.concatenate([bucket, bucket[twice] + (1 << HASH_BITS), bucket[dense] + (2 << HASH_BITS)])
        order = np.argsort(rows, kind="stable")
        yield i, j, rows[order] + i, found[order]


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, held_out: Callable) -> tuple[DataFrame, float]:
    """(text, positive) of the documents that may be learnt from, and the share of positives among labelled ones."""
    kept = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    state = kept.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("state")).where(~held_out(F.col("doc_id")))
    state = written(state, "states")
    share = state.agg(F.avg((F.col("state") == 1).cast("int"))).first()[0]
    plain = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    confirmed = state.where("state = 1").select("doc_id", F.lit(True).alias("positive"))
    share_kept = -(-confirmed.count() // POSITIVES)
    if share_kept > 1:
        confirmed = confirmed.where(F.pmod(F.xxhash64("doc_id"), F.lit(share_kept)) == 0)
    return plain.join(F.broadcast(confirmed), "doc_id", "left").select("text", F.coalesce("positive", F.lit(False)).alias("positive")), float(share or 0.0)


def count_features(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Documents with each feature among positives and unlabelled rows (text, positive), and how many rows there are."""
    slots = N_FEATURES + (1 << _counts.SLICE_BITS)  # the last slice counts the rows themselves

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, slots), np.uint32)
        for batch in batches:
            kind = batch.column("positive").to_numpy(zero_copy_only=False).astype(np.int64)
            for _, _, row, feature in features_of(batch.column("text")):
                for k in (0, 1):
                    np.add.at(counts[k], feature[kind[row] == k], 1)
            for k in (0, 1):
                counts[k, N_FEATURES] += int((kind == k).sum())
        yield pa.RecordBatch.from_arrays(_counts.columns(counts), [f for f, _ in _counts.FIELDS])
        give_back()

    found = _counts.total(written(rows.mapInArrow(scan, _counts.SCHEMA), "counts"), 2 * slots).reshape(2, slots)
    return found[1, :N_FEATURES].astype(float), found[0, :N_FEATURES].astype(float), int(found[1, N_FEATURES]), int(found[0, N_FEATURES])


def choose_features(positive: np.ndarray, unlabelled: np.ndarray, n_p: int, n_u: int, prior: float) -> np.ndarray:
    """Features by their log-likelihood ratio statistic, positives against all documents less the positives hidden in them, as the module says."""
    known, gains, looked_at = [], [], 0
    for i in range(0, len(positive), _SLICE):
        own, other = positive[i : i + _SLICE], unlabelled[i : i + _SLICE]
        looked_at += int(np.count_nonzero(own + other))
        p = (own + 0.5) / (n_p + 1)
        u = (own + other + 0.5) / (n_p + n_u + 1)
        q = np.maximum((u - prior * p) / max(1 - prior, 1e-9), 0.5 / (n_p + n_u + 1))
        at = np.flatnonzero((p > q) & (own >= 1))
        p, q = p[at], q[at]
        known.append(at + i)
        gains.append(n_p * (p * np.log(p / q) + (1 - p) * np.log((1 - p) / np.maximum(1 - q, 1e-9))))
    known, gain, looked_at = np.concatenate(known), np.concatenate(gains), max(1, looked_at)
    several = positive[known] >= 2  # what one positive has may be no more than its own, but is better than nothing
    if several.any():
        known, gain = known[several], gain[several]
    order = np.argsort(-gain, kind="stable")
    order, gain = known[order], gain[order]
    real = np.flatnonzero(np.exp(-gain) * looked_at <= FALSE * np.arange(1, len(gain) + 1))
    n = min(int(real[-1]) + 1 if len(real) else 0, int((gain >= NATS * n_p).sum()))
    return np.sort(order[: max(n, FEWEST)])


def _kept(features: np.ndarray) -> np.ndarray:
    """The place of each feature among those chosen, or -1."""
    place = np.full(N_FEATURES, -1, np.int32)
    place[features] = np.arange(len(features), dtype=np.int32)
    return place


def patterns(rows: DataFrame, features: np.ndarray) -> DataFrame:
    """(found, n_p, n_u): the lists of chosen features that documents have, with how many positives and unlabelled have just these."""
    shared = rows.sparkSession.sparkContext.broadcast(features)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _kept(shared.value)
        for batch in batches:
            lists = []
            for i, j, row, feature in features_of(batch.column("text")):
                at = place[feature]
                row, at = row[at >= 0], at[at >= 0]
                at = at[np.lexsort((at, row))]
                lists.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(i, j + 1)).astype(np.int32)), pa.array(at, pa.int32())))
            if lists:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(lists), batch.column("positive")], ["found", "positive"])
        give_back()

    found = rows.mapInArrow(scan, "found array<int>, positive boolean")
    return written(found.groupBy("found").agg(F.count_if("positive").alias("n_p"), F.count_if(~F.col("positive")).alias("n_u")), "patterns")


def _values(batch: pa.RecordBatch, w: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values of the linear model, features of all rows, row of each feature)."""
    lists = batch.column("found")
    flat = lists.flatten().to_numpy()
    row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    return b + np.bincount(row, weights=w[flat], minlength=batch.num_rows), flat, row


def _sums(table: DataFrame, w: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all documents: (positives: l(-z), l(z); unlabelled: l(z)), and gradients by weights and bias (positives: -l(-z)', l(z)'; unlabelled: l(z)')."""
    shared, n = table.sparkSession.sparkContext.broadcast((w, b)), len(w)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        risk, grad = np.zeros(3), np.zeros((3, n + 1))
        for batch in batches:
            z, flat, row = _values(batch, w, b)
            n_p, n_u = batch.column("n_p").to_numpy(), batch.column("n_u").to_numpy()
            up = 1 / (1 + np.exp(-np.clip(z, -_RANGE, _RANGE)))
            risk += [(n_p * np.logaddexp(0, -z)).sum(), (n_p * np.logaddexp(0, z)).sum(), (n_u * np.logaddexp(0, z)).sum()]
            for k, own in enumerate((n_p * (up - 1), n_p * up, n_u * up)):
                grad[k, :n] += np.bincount(flat, weights=own[row], minlength=n)
                grad[k, n] += own.sum()
        yield _counts.floats([risk, grad])

    risk, grad = _counts.total_floats(table.mapInArrow(scan, _counts.SCHEMA), [(3,), (3, n + 1)])  # three for each feature, whatever the input
    shared.unpersist()
    return risk, grad


def fit(table: DataFrame, n_features: int, n_p: int, n_u: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk over patterns, by limited-memory quasi-Newton steps."""

    def risk(x: np.ndarray) -> tuple[float, np.ndarray, float]:
        (p_pos, p_neg, u_neg), grad = _sums(table, x[:-1], float(x[-1]))
        inner = (u_neg + p_neg) / (n_u + n_p) - prior * p_neg / n_p
        slope = prior * grad[0] / n_p + (((grad[2] + grad[1]) / (n_u + n_p) - prior * grad[1] / n_p) if inner >= 0 else 0)
        slope[:-1] += DECAY * x[:-1]
        return prior * p_pos / n_p + max(0.0, inner) + DECAY / 2 * float(x[:-1] @ x[:-1]), slope, inner

    x = np.append(np.zeros(n_features), np.log(prior / (1 - prior)))
    value, slope, _ = risk(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    asked = 1
    while asked < STEPS:
        move, weights = -slope, []
        for s, y in reversed(pairs):
            a = (s @ move) / (s @ y)
            move = move - a * y
            weights.append(a)
        if pairs:
            s, y = pairs[-1]
            move = move * (s @ y) / (y @ y)
        else:
            move = move * (4.0 / max(np.abs(move).sum(), 1e-12))  # no value of a document changes by more
        for (s, y), a in zip(pairs, reversed(weights)):
            move = move + s * (a - (y @ move) / (s @ y))
        step = 1.0
        while asked < STEPS:
            new = x + step * move
            new_value, new_slope, inner = risk(new)
            asked += 1
            if inner >= 0 and new_value <= value + 1e-4 * step * float(slope @ move):
                break
            step *= 0.3
        else:
            break
        s, y = new - x, new_slope - slope
        gain, x, value, slope = value - new_value, new, new_value, new_slope
        if s @ y > 1e-12:
            pairs = [*pairs[1 - MEMORY :], (s, y)]
        if gain < 1e-6 * max(value, 1e-9):
            break
    return x[:-1], float(x[-1])


def _cut(table: DataFrame, w: np.ndarray, b: float) -> tuple[float, float]:
    """The value that maximises recall**2 / rate of positives, a stand-in for F1 that needs no negatives, in the widest gap near the best; and the largest distance of a positive from it."""
    shared = table.sparkSession.sparkContext.broadcast((w, b))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in batches:
            z = np.clip(_values(batch, w, b)[0], -_RANGE, _RANGE)
            yield pa.RecordBatch.from_arrays([pa.array(np.floor((z + _RANGE) / _BIN).astype(np.int64)), batch.column("n_p"), batch.column("n_u")], ["bin", "n_p", "n_u"])

    rows = table.select("found", "n_p", "n_u").mapInArrow(scan, "bin bigint, n_p bigint, n_u bigint").groupBy("bin").agg(F.sum("n_p").alias("n_p"), F.sum("n_u").alias("n_u")).orderBy("bin").collect()
    bins, n_p, n_u = (np.array([r[k] for r in rows], float) for k in ("bin", "n_p", "n_u"))
    every = n_p + n_u
    recall, rate = np.cumsum(n_p[::-1])[::-1] / n_p.sum(), np.cumsum(every[::-1])[::-1] / every.sum()
    value = recall**2 / rate
    good = np.flatnonzero(value >= 0.995 * value.max())  # everything from bins[i] on is called positive
    gaps = bins[good] - bins[np.maximum(good - 1, 0)]
    best = good[int(gaps.argmax())]
    cut = (bins[best] + bins[max(best - 1, 0)] + 1) / 2 * _BIN - _RANGE
    return float(cut), float(np.abs(bins[n_p > 0] * _BIN - _RANGE - cut).max(initial=1.0))


class Model:
    """A linear model over chosen features."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias

    def scores(self, column: pa.Array) -> np.ndarray:
        if not len(self.features):
            return np.zeros(len(column))
        out = np.full(len(column), self.bias)
        place = _kept(self.features)
        for i, j, row, feature in features_of(column):
            at = place[feature]
            out[i:j] += np.bincount(row[at >= 0] - i, weights=self.weights[at[at >= 0]], minlength=j - i)
        return 1 / (1 + np.exp(-np.clip(out, -_RANGE, _RANGE)))


NOTHING = Model(np.zeros(0, np.int64), np.zeros(0), -np.inf)


def train(docs: DataFrame, labels: DataFrame, held_out: Callable, label: str = "toxic", prior: float | None = None) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, label); rows where held_out(doc_id) is true are not learnt from."""
    bounded_batches(docs.sparkSession)
    rows, share = learning_rows(docs, labels, label, held_out)
    positive, unlabelled, n_p, n_u = count_features(rows)
    if not n_p or not n_u:
        return NOTHING
    prior = min(max(share if prior is None else prior, 1e-4), 0.5)
    features = choose_features(positive, unlabelled, n_p, n_u, prior)
    del positive, unlabelled
    give_back()
    if not len(features):
        return NOTHING
    table = patterns(rows, features)
    w, b = fit(table, len(features), n_p, n_u, prior)
    cut, far = _cut(table, w, b)
    scale = min(1.0, 8.0 / far)
    return Model(features, w * scale, float((b - cut) * scale + np.log(THRESHOLD / (1 - THRESHOLD))))


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs (_row, _text) to _row and score."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.bias))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(own.scores(batch.column("_text")))], ["_row", "score"])
        give_back()

    return docs.mapInArrow(scan, f"_row {docs.schema['_row'].dataType.simpleString()}, score double")


def _rows_of(docs: DataFrame, names: list[str]) -> DataFrame:
    return docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), docs["text"].cast("string").alias("_text"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs but text, with score."""
    names = [c for c in docs.columns if c != "text"]
    kept = [F.col("_row").getField(c).alias("kept_score" if c == "score" else c) for c in names]
    return _scored(_rows_of(docs, names), model).select(*kept, "score")


def held_out(doc_id):
    """Documents never learnt from: crc32 of the id as text has remainder 1 by 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose score stays under the threshold, all columns as they were."""
    model = train(docs, labels, held_out)
    return _scored(_rows_of(docs, docs.columns), model).where(F.col("score") < THRESHOLD).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
