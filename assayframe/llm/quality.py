"""Quality classifier by co-training of two views of a document.

The text view is what the whole text says: counted features (shares of capitals, symbols, digits, doubled words, word
lengths, repetition of words and lines, ...) and its words, hashed into ``WORD_BUCKETS`` shares. The metadata view has
what a page is known by apart from its text: language, source and length, hashed and bucketed. Each view has a logistic
model of its own, fitted by numpy.

(1) One pass over all documents computes both views; the small numeric table is written out. (2) Both models are fitted
on labelled documents, at most ``FIT_ROWS``, by the task that chose them; they are written out too, and the driver gets models and sums only. (3) In each round both models judge every distinct unlabelled text, and the
share each is surest of (``SHARE`` of all in each round more, by class in proportion, found by a histogram of all) become
pseudo-labels for the other view, if the other does not contradict them. Both are refitted by Newton steps, whose sums
over all pseudo-labelled texts are added up in the partitions; no pseudo-labelled row comes to the driver. (4) Each view
is calibrated by a logistic curve on held-out labelled rows, and the combined score of all documents is the average of
both views' calibrated log-odds, weighted by what each view explains beyond the base rate.

Defined cases: null and empty texts, which hold nothing to learn from, get the features of an empty text; null lang or
source is a value of its own; a null n_chars is taken from the text; labels of null are none; of repeated label rows
of a document the lowest counts; without any label every score is 0.5 and ``reject_poor`` keeps all; with labels of one
class only, every score is that class's share; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import copy
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm import _counts
from assayframe.llm._shared import bounded_batches, give_back, written
from assayframe.llm._words import NOT_SPACE, Words, field, slices, string_buffers, whole_rows

#: labelled rows fitted at most; rounds, and the share of unlabelled texts that each adds to the pseudo-labels
FIT_ROWS, ROUNDS, SHARE = 20_000, 3, 0.1
#: weight of all pseudo-labels against all labels, Newton steps a round, bins of the histogram of certainty
PSEUDO, NEWTON, BINS = 0.5, 2, 2_000
#: a pseudo-label needs this probability from its own view, and at least this from the other
SURE, NOT_AGAINST = 0.95, 0.35
THRESHOLD = 0.5
META_BUCKETS, META_STEPS, WORD_BUCKETS = 64, 14, 128
#: bytes of text handled at a time: temporaries are about 30 times that
_CHUNK = 1 << 18
#: rows of features that a model expands at a time
_ROWS = 1 << 11
TEXT_FEATURES = (
    "log_bytes", "log_words", "capitals", "digits", "symbols", "exclamation", "pipes", "non_ascii", "word_bytes", "long_words",
    "doubled_words", "distinct_words", "top_word", "short_lines", "distinct_lines", "log_lines", "ends_in_stop", "words_per_line",
)

_IS = {
    "capitals": np.isin(np.arange(256), np.arange(65, 91)),
    "digits": np.isin(np.arange(256), np.arange(48, 58)),
    "symbols": np.isin(np.arange(256), [ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]),
    "exclamation": np.arange(256) == 33,
    "pipes": np.arange(256) == 124,
    "non_ascii": np.arange(256) >= 128,
}


def text_features(column: pa.Array) -> np.ndarray:
    """TEXT_FEATURES and roots of the shares of hashed words, of every text of a column."""
    raw, offsets = string_buffers(column)
    n_own = len(TEXT_FEATURES)
    out = np.zeros((len(offsets) - 1, n_own + WORD_BUCKETS), np.float32)
    for i, j in slices(offsets, _CHUNK):
        own, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        n = np.maximum(np.diff(at), 1)
        words = Words(own, at, NOT_SPACE)
        hashes, sizes = words.hashes(), words.end - words.start
        counts = np.diff(words.first)
        some = np.maximum(counts, 1)
        doc = np.repeat(np.arange(j - i), counts)
        share = {k: (lambda c: (c[at[1:]] - c[at[:-1]]) / n)(np.concatenate([[0], np.cumsum(is_[own])])) for k, is_ in _IS.items()}
        doubled = np.bincount(doc[1:][(hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])], minlength=j - i) if len(doc) else np.zeros(j - i)
        # distinct words and the most frequent one, by sorting (document, word)
        keys = np.sort((doc << 48) | (hashes >> np.uint64(16)).astype(np.int64))
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        runs, d = np.diff(np.append(new, len(keys))), keys[new] >> 48
        distinct = np.bincount(d, minlength=j - i)
        top = np.zeros(j - i)
        np.maximum.at(top, d, runs)
        buckets = np.bincount(doc * WORD_BUCKETS + (hashes & np.uint64(WORD_BUCKETS - 1)).astype(np.int64), minlength=(j - i) * WORD_BUCKETS)
        out[i:j, n_own:] = np.sqrt(buckets.reshape(-1, WORD_BUCKETS) / some[:, None])
        ends = np.concatenate([[0], np.cumsum(own == 10)])
        lines = ends[at[1:]] - ends[at[:-1]] + 1
        for row in range(i, j):
            text = own[at[row - i] : at[row - i + 1]].tobytes()
            parts = text.split(b"\n")
            out[row, 13] = sum(len(p) < 40 for p in parts) / len(parts)
            out[row, 14] = len(set(parts)) / len(parts)
            out[row, 16] = text.rstrip()[-1:] in (b".", b"!", b"?")
        out[i:j, 0], out[i:j, 1] = np.log1p(np.diff(at)), np.log1p(counts)
        for k, name in enumerate(_IS):
            out[i:j, 2 + k] = share[name]
        if len(doc):
            out[i:j, 8] = np.bincount(doc, weights=sizes, minlength=j - i) / some
            out[i:j, 9] = np.bincount(doc, weights=sizes > 24, minlength=j - i) / some
        out[i:j, 10], out[i:j, 11], out[i:j, 12] = doubled / some, distinct / some, top / some
        out[i:j, 15], out[i:j, 17] = np.log1p(lines), np.log1p(counts / lines)
    return out


def meta_features(lang: list, source: list, n_chars: np.ndarray) -> np.ndarray:
    """The places of what is 1 in a row of the metadata view: language, source, both together, and the length in steps."""
    known: dict[tuple, list[int]] = {}
    out = np.zeros((len(lang), 4), np.int32)
    for i, pair in enumerate(zip(lang, source)):
        if pair not in known:
            a, b = pair
            known[pair] = [zlib.crc32(key.encode()) % META_BUCKETS for key in (f"l{a}", f"s{b}", f"l{a} s{b}")]
        out[i, :3] = known[pair]
    out[:, 3] = META_BUCKETS + np.minimum(np.log2(1 + np.maximum(n_chars, 0)).astype(np.int64), META_STEPS - 1)
    return out


def _meta_rows(places: np.ndarray) -> np.ndarray:
    out = np.zeros((len(places), META_BUCKETS + META_STEPS), np.float32)
    for column in places.T:
        out[np.arange(len(places)), column] += 1
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Logistic:
    """A logistic model on standardised features; the first ``binned`` of them also by steps at their quantiles."""

    def __init__(self, bins: int, binned: int):
        self.bins, self.binned = bins, binned

    def prepare(self, x: np.ndarray) -> Logistic:
        self.edges = np.quantile(x[:, : self.binned], np.linspace(0, 1, self.bins + 1)[1:-1], axis=0) if self.bins else np.zeros((0, self.binned))
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.w = np.zeros(1 + x.shape[1] + self.edges.size)
        return self

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        binned = [(x[:, : self.binned] > edge).astype(np.float64) for edge in self.edges]
        return np.concatenate([np.ones((len(x), 1)), z, *binned], axis=1)

    def sums(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and second derivatives of the weighted loss."""
        grad, hess = np.zeros(len(self.w)), np.zeros((len(self.w),) * 2)
        for i in range(0, len(x), _ROWS):
            z, own, label = self.expand(x[i : i + _ROWS]), weight[i : i + _ROWS], y[i : i + _ROWS]
            p = _sigmoid(z @ self.w)
            grad += z.T @ (own * (p - label))
            hess += (z * (own * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z
        return grad, hess

    def step(self, grad: np.ndarray, hess: np.ndarray) -> float:
        ridge = 1e-3 * np.eye(len(self.w))
        move = np.linalg.solve(hess + ridge, grad + ridge @ self.w)
        self.w = self.w - move * min(1.0, 5.0 / (np.abs(move).max() + 1e-12))
        return float(np.abs(move).max())

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(np.clip(self.expand(x[i : i + _ROWS]) @ self.w, -30, 30) for i in range(0, len(x), _ROWS))])


def _balanced(y: np.ndarray) -> np.ndarray:
    """Row weights with which both classes weigh alike, 1 in all."""
    return np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))


def _curve(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from logits to labels."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - y) * z).mean() + 1e-3 * (a - 1), (p - y).mean()])
        q = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(q * z * z).mean() + 1e-3, (q * z).mean()], [(q * z).mean(), q.mean() + 1e-9]])
        move = np.linalg.solve(h, g)
        a, b = a - float(np.clip(move[0], -1, 1)), b - float(np.clip(move[1], -2, 2))
    return max(a, 0.0), b


class CoTrained:
    """Both views' models, their curves and weights."""

    def __init__(self, text: Logistic, meta: Logistic):
        self.views = (text, meta)
        self.curves = [(1.0, 0.0), (1.0, 0.0)]
        self.weights, self.base = [0.5, 0.5], 0.0

    def calibrate(self, x: list[np.ndarray], y: np.ndarray) -> None:
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
        self.base = float(np.log(share / (1 - share)))
        plain = -(y * np.log(share) + (1 - y) * np.log(1 - share)).mean()
        gains = []
        for k, (model, own) in enumerate(zip(self.views, x)):
            z = model.logits(own)
            self.curves[k] = a, b = _curve(z, y)
            p = np.clip(1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))), 1e-9, 1 - 1e-9)
            gains.append(max(plain + (y * np.log(p) + (1 - y) * np.log(1 - p)).mean(), 1e-6))
        self.weights = [g / sum(gains) for g in gains]

    def score(self, x: list[np.ndarray]) -> np.ndarray:
        z = sum(w * (a * m.logits(own) + b) for w, (a, b), m, own in zip(self.weights, self.curves, self.views, x))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


_VIEWS = "text_view array<float>, meta_view array<int>"


def _both_views(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> list[np.ndarray]:
    length = n_chars.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    if (length < 0).any():
        length = np.where(length < 0, pc.fill_null(pc.utf8_length(text), 0).to_numpy(zero_copy_only=False), length)
    return [text_features(text), meta_features(lang.to_pylist(), source.to_pylist(), length)]


def _given(docs: DataFrame) -> DataFrame:
    """docs with all the columns that the views are made of."""
    missing = {c: F.lit(None).cast(t) for c, t in (("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")) if c not in docs.columns}
    return docs.withColumns(missing) if missing else docs


def views(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text and both views of every document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = _both_views(*(batch.column(c) for c in ("text", "lang", "source", "n_chars")))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.reshape(-1))) for v in both]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("same"), *lists], ["doc_id", "same", "text_view", "meta_view"])
        give_back()

    bounded_batches(docs.sparkSession)
    plain = _given(docs).select(F.col("doc_id").cast("bigint"), F.xxhash64(F.col("text").cast("string")).alias("same"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("bigint"))
    return plain.mapInArrow(scan, f"doc_id bigint, same bigint, {_VIEWS}")


def _arrays(batch) -> list[np.ndarray]:
    text, meta = (np.array(batch.column(c).flatten()).reshape(batch.num_rows, -1) for c in ("text_view", "meta_view"))
    return [text, _meta_rows(meta)]


#: a labelled row, its weight in fitting (0: none) and whether it is for calibration, or a model, pickled
_FITTED = f"{_VIEWS}, label double, weight double, held boolean, model binary"


def _fitted(table: DataFrame, known: DataFrame) -> DataFrame:
    """FIT_ROWS labelled documents at most, those with the smallest hashes of their ids, and in one more row the model fitted on them, or the share of good ones if labels have one class; no row without labels."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["text_view", "meta_view", "label", "weight", "held", "model"], [pa.list_(pa.float32()), pa.list_(pa.int32()), pa.float64(), pa.float64(), pa.bool_(), pa.binary()]
        rows = [batch for batch in batches if batch.num_rows]
        if not rows:
            return
        y = np.concatenate([batch.column("label").to_numpy(zero_copy_only=False) for batch in rows]).astype(np.float64)
        weight, held = np.zeros(len(y)), np.zeros(len(y), bool)
        if y.min() == y.max():
            model = float(y.mean())
        else:
            keep_out = np.arange(len(y)) % 4 == 0  # for calibration
            if len(np.unique(y[~keep_out])) < 2 or len(np.unique(y[keep_out])) < 2:
                keep_out[:] = False
            held = keep_out if keep_out.any() else ~keep_out
            weight[~keep_out] = _balanced(y[~keep_out])
            x = [np.concatenate(view) for view in zip(*map(_arrays, rows))]
            views_ = [Logistic(8, len(TEXT_FEATURES)).prepare(x[0][~keep_out]), Logistic(0, 0).prepare(x[1][~keep_out])]
            for view, own in zip(views_, x):
                own = own[~keep_out]
                for _ in range(25):
                    if view.step(*view.sums(own, y[~keep_out], weight[~keep_out])) < 1e-4:
                        break
            model = CoTrained(*views_)
            model.calibrate([v[held] for v in x], y[held])
        at = 0
        for batch in rows:
            own = slice(at, at := at + batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(k) for c, k in zip(names[:2], kinds)), pa.array(y[own]), pa.array(weight[own]), pa.array(held[own]), pa.nulls(batch.num_rows, kinds[5])], names)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds[:5]), pa.array([pickle.dumps(model)], pa.binary())], names)
        give_back()

    order = F.xxhash64("doc_id", F.lit("fit"))
    few = known.orderBy(order, "doc_id").limit(FIT_ROWS)
    got = table.join(F.broadcast(few), "doc_id").orderBy(order, "same", "meta_view").limit(FIT_ROWS).select("text_view", "meta_view", "label")
    return written(got.mapInArrow(fit, _FITTED), "fitted")  # a limit leaves one partition, in order


def _calibrated(labelled: DataFrame, model: CoTrained) -> CoTrained:
    """The model with curves and weights by the rows held for that, FIT_ROWS at most."""
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [batch for batch in batches if batch.num_rows]
        if rows:
            own = shared.value
            own.calibrate([np.concatenate(view) for view in zip(*map(_arrays, rows))], np.concatenate([batch.column("label").to_numpy() for batch in rows]))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], ["model"])
        give_back()

    out = pickle.loads(labelled.where("held").select("text_view", "meta_view", "label").coalesce(1).mapInArrow(scan, "model binary").first()[0])
    shared.unpersist()
    return out


def train(table: DataFrame, labels: DataFrame, label: str = "quality", rounds: int = ROUNDS) -> CoTrained | float:
    """A co-trained model from views (doc_id, same, text_view, meta_view); the share of good documents if labels have one class, 0.5 without labels."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min(F.col(label).cast("int")).alias("label"))
    fitted = _fitted(table, known)
    row = fitted.where("model is not null").select("model").first()
    model = pickle.loads(row[0]) if row else 0.5
    if isinstance(model, float):
        return model
    labelled = fitted.where("model is null").drop("model")
    distinct = table.join(known.select("doc_id"), "doc_id", "left_anti").groupBy("same").agg(F.min("text_view").alias("text_view"), F.min("meta_view").alias("meta_view"))  # of copies with other metadata always the same one
    distinct = written(distinct.drop("same"), "distinct")
    for number in range(1, rounds + 1):
        cuts, taken = _surest(distinct, model, min(1.0, number * SHARE))
        if not taken.any():
            break
        teacher = copy.deepcopy(model)
        for _ in range(NEWTON):
            for view, sums in zip(model.views, _pseudo_sums(distinct, teacher, model, cuts, taken, labelled)):
                view.step(*sums)
        model = _calibrated(labelled, model)
    return model


def _certain(model: CoTrained, x: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(view, label, rows, bins of certainty from SURE to 1) of what a view is sure of and the other does not contradict."""
    good = float(_sigmoid(np.array(model.base)))
    p = [_sigmoid(a * m.logits(v) + b) for (a, b), m, v in zip(model.curves, model.views, x)]
    for k in (0, 1):
        for label in (0, 1):
            mine, other = (p[k], p[1 - k]) if label else (1 - p[k], 1 - p[1 - k])
            rows = np.flatnonzero((mine >= SURE) & (other >= NOT_AGAINST * (good if label else 1 - good)))
            # by log-odds, which tell the surest apart
            odds = np.log(mine[rows] / np.maximum(1 - mine[rows], 1e-14))
            yield k, label, rows, np.clip((odds / 32 * BINS).astype(np.int64), 0, BINS - 1)


def _surest(distinct: DataFrame, model: CoTrained, share: float) -> tuple[np.ndarray, np.ndarray]:
    """For each view and label the least bin of certainty that is taken, and how many texts that gives: the surest, up to ``share`` of all by class."""
    shared = distinct.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 2, BINS))
        n = 0
        for batch in batches:
            n += batch.num_rows
            if batch.num_rows:
                for k, label, _, bins in _certain(shared.value, _arrays(batch)):
                    counts[k, label] += np.bincount(bins, minlength=BINS)
        yield _counts.floats([counts, np.array([n])])

    counts, n = _counts.total_floats(distinct.mapInArrow(scan, _counts.SCHEMA), [(2, 2, BINS), (1,)])
    good = float(_sigmoid(np.array(model.base)))
    above = np.cumsum(counts[:, :, ::-1], axis=2)[:, :, ::-1]
    cuts, taken = np.full((2, 2), BINS), np.zeros((2, 2))
    for k in (0, 1):
        for label in (0, 1):
            most = max(1.0, share * float(n[0]) * (good if label else 1 - good))
            # at least the surest bin that has any
            some = np.flatnonzero(counts[k, label])
            if len(some):
                cuts[k, label] = min(int(some[-1]), int((above[k, label] > most).sum()))
                taken[k, label] = above[k, label, cuts[k, label]]
    return cuts, taken


def _pseudo_sums(distinct: DataFrame, teacher: CoTrained, model: CoTrained, cuts: np.ndarray, taken: np.ndarray, labelled: DataFrame | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Gradient and second derivatives of each view over the texts that the other is surest of, and over labelled rows (text_view, meta_view, label, weight)."""
    shared = distinct.sparkSession.sparkContext.broadcast((teacher, model))
    shapes = [s for view in model.views for s in ((len(view.w),), (len(view.w),) * 2)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        teacher, model = shared.value
        out = [np.zeros(s) for s in shapes]
        for batch in batches:
            x = _arrays(batch) if batch.num_rows else None
            for k, label, rows, bins in _certain(teacher, x) if x else ():
                rows = rows[bins >= cuts[k, label]]
                if len(rows):
                    weight = np.full(len(rows), PSEUDO / 2 / max(taken[k, label], 1))
                    grad, hess = model.views[1 - k].sums(x[1 - k][rows], np.full(len(rows), float(label)), weight)
                    out[2 * (1 - k)] += grad
                    out[2 * (1 - k) + 1] += hess
        yield _counts.floats(out)

    def own_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, model = shared.value
        out = [np.zeros(s) for s in shapes]
        for batch in batches:
            for k, x in enumerate(_arrays(batch) if batch.num_rows else ()):
                grad, hess = model.views[k].sums(x, batch.column("label").to_numpy(), batch.column("weight").to_numpy())
                out[2 * k] += grad
                out[2 * k + 1] += hess
        yield _counts.floats(out)

    sums = distinct.mapInArrow(scan, _counts.SCHEMA)
    if labelled is not None:
        sums = sums.unionAll(labelled.where("weight > 0").select("text_view", "meta_view", "label", "weight").mapInArrow(own_labels, _counts.SCHEMA))
    found = _counts.total_floats(sums, shapes)
    shared.unpersist()
    return [(found[0], found[1]), (found[2], found[3])]


def score(table: DataFrame, model: CoTrained | float) -> DataFrame:
    """doc_id and score of every row of views."""
    if isinstance(model, float):
        return table.select("doc_id", F.lit(model).alias("score"))
    shared = table.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = own.score(_arrays(batch)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return table.mapInArrow(scan, "doc_id bigint, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of every document."""
    table = written(views(docs), "views")
    return score(table, train(table, labels))


def reject_poor(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose score reaches the threshold, all columns as they were."""
    model = train(written(views(docs), "views"), labels)
    if isinstance(model, float):
        return docs if model >= threshold else docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = whole_rows(_given(docs))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if batch.num_rows:
                text, meta = _both_views(*(field(batch, c) for c in ("text", "lang", "source", "n_chars")))
                yield batch.filter(pa.array(own.score([text, _meta_rows(meta)]) >= threshold))
        give_back()

    return rows.mapInArrow(scan, rows.schema).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
