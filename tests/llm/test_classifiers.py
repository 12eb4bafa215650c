import re
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from assayframe.llm import _counts, quality, toxicity
from assayframe.llm._shared import written


def _auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def _labelled(spark, scored, label, path="/root/testdata/sf0.01"):
    got = scored.join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").select("doc_id", "score", label).toPandas()
    return got["score"].to_numpy(), got[label].to_numpy()


def test_quality_separates_held_out_rows(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    scored = quality.quality_scores(docs, labels.where(~held)).where(held)
    score, label = _labelled(spark, scored, "quality", path)
    assert _auc(score, label) > 0.99
    assert ((score >= quality.THRESHOLD) == label).mean() > 0.97


def test_toxicity_separates_held_out_rows(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels, toxicity.held_out)).where(toxicity.held_out(F.col("doc_id")))
    score, label = _labelled(spark, scored, "toxic", path)
    called = score >= toxicity.THRESHOLD
    assert _auc(score, label) > 0.9
    assert (called & (label == 1)).sum() / called.sum() > 0.9 and (called & (label == 1)).sum() / label.sum() >= 0.9


def test_held_out_labels_are_not_learnt_from(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x, toxicity.held_out) for x in (labels, turned))
    assert (a.features == b.features).all() and np.allclose(a.weights, b.weights) and np.isclose(a.bias, b.bias)


def test_the_risk_stays_non_negative(spark):
    rng = np.random.default_rng(0)
    rows = [([0, *np.flatnonzero(rng.integers(0, 2, 3)) + 1], 1, 0) for _ in range(50)]
    rows += [([*([0] if rng.random() < 0.1 else []), *np.flatnonzero(rng.integers(0, 2, 3)) + 1], 0, 1) for _ in range(500)]
    rows = [([int(x) for x in found], p, u) for found, p, u in rows]
    table = spark.createDataFrame(rows, "found array<int>, n_p bigint, n_u bigint")
    w, b = toxicity.fit(table, 4, 50, 500, 0.15)
    z = np.array([b + w[found].sum() for found, _, _ in rows])
    assert np.logaddexp(0, z).mean() - 0.15 * np.logaddexp(0, z[:50]).mean() >= 0
    assert w[0] > abs(w[1:]).max() and z[:50].min() > np.median(z[50:])
    (p_pos, p_neg, u_neg), grad = toxicity._sums(table, w, b)
    up = 1 / (1 + np.exp(-z))
    assert np.allclose([p_pos, p_neg, u_neg], [np.logaddexp(0, -z[:50]).sum(), np.logaddexp(0, z[:50]).sum(), np.logaddexp(0, z[50:]).sum()])
    assert np.allclose(grad[2], [*(sum(u for u, r in zip(up[50:], rows[50:]) if k in r[0]) for k in range(4)), up[50:].sum()])


def test_features_against_brute_force():
    texts = ["Idiot idiots, IDIOTE x", None, "", "a " * 150 + "moron moron", "mörder mörder"]
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) for t in texts]
    got = {i: [] for i in range(5)}
    for _, _, row, feature in toxicity.features_of(pa.array(texts)):
        for r, f in zip(row.tolist(), feature.tolist()):
            got[r].append(f)
    for r, own in enumerate(words):
        counts = {}
        for w in own:
            for k in (0, *toxicity.PREFIXES):
                key = (k, w.encode()[: k or None])
                counts[key] = counts.get(key, 0) + 1
        twice = [c for c in counts.values() if c >= 2]
        assert len(got[r]) == len(set(got[r])) == len(counts) + len(twice) + sum(c * toxicity.DENSE >= len(own) for c in twice)


def test_all_rows_are_counted(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, share = toxicity.learning_rows(docs, labels, "toxic", toxicity.held_out)
    p, u, n_p, n_u = toxicity.count_features(rows)
    own = rows.toPandas()
    assert (n_p, n_u) == (own["positive"].sum(), (~own["positive"]).sum()) and 0 < share < 1
    table = toxicity.patterns(rows, np.arange(0, toxicity.N_FEATURES, 1000))
    assert tuple(table.groupBy().sum("n_p", "n_u").first()) == (n_p, n_u)
    assert table.selectExpr("sum(size(found) * (n_p + n_u))").first()[0] == (p + u)[::1000].sum()


def test_score_may_be_a_column_already(spark, odd_docs):
    scored = toxicity.score(odd_docs, toxicity.NOTHING)
    assert "kept_score" in scored.columns and scored.where("score = 0").count() == 11


def test_pseudo_labels_follow_the_unlabelled(spark):
    """Sums over partitions are those of all rows at once, and quotas are shares of all distinct texts."""
    rng = np.random.default_rng(1)
    n = 400
    x = [rng.normal(size=(n, len(quality.TEXT_FEATURES) + quality.WORD_BUCKETS)).astype(np.float32), rng.integers(0, 70, (n, 4)).astype(np.int32)]
    y = (x[0][:, 0] + rng.normal(size=n) * 0.1 > 0).astype(float)
    both = [x[0], quality._meta_rows(x[1])]
    views = [quality.Logistic(8, len(quality.TEXT_FEATURES)).prepare(both[0]), quality.Logistic(0, 0).prepare(both[1])]
    for view, own in zip(views, both):
        for _ in range(10):
            view.step(*view.sums(own, y, quality._balanced(y)))
    model = quality.CoTrained(*views)
    model.calibrate(both, y)
    table = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(*x)], "text_view array<float>, meta_view array<int>").repartition(5)
    cuts, taken = quality._surest(table, model, 0.1)
    assert 0 < taken[0].sum() <= 0.1 * n + 2
    got = quality._pseudo_sums(table, model, model, cuts, taken)
    for k, label, rows, bins in quality._certain(model, both):
        assert (bins >= cuts[k, label]).sum() == taken[k, label]
    grad, hess = np.zeros(len(views[1].w)), np.zeros((len(views[1].w),) * 2)
    for k, label, rows, bins in quality._certain(model, both):
        rows = rows[bins >= cuts[k, label]]
        if k == 0 and len(rows):
            own = views[1].sums(both[1][rows], np.full(len(rows), float(label)), np.full(len(rows), quality.PSEUDO / 2 / taken[k, label]))
            grad, hess = grad + own[0], hess + own[1]
    assert np.allclose(got[1][0], grad) and np.allclose(got[1][1], hess)


def test_without_labels_all_stay(spark, docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.reject_poor(docs, labels).count() == docs.count()


def test_text_features_by_hand():
    out = quality.text_features(pa.array(["AB cd cd\ncd!", None, "é|"]))
    row = dict(zip(quality.TEXT_FEATURES, out[0]))
    assert np.allclose([row[k] for k in ("capitals", "doubled_words", "distinct_words", "top_word", "exclamation")], [2 / 12, 1 / 4, 3 / 4, 2 / 4, 1 / 12])
    assert np.isclose((out[0][len(quality.TEXT_FEATURES) :] ** 2).sum(), 1) and not out[1][len(quality.TEXT_FEATURES) :].any()
    assert out[1][0] == 0 and np.allclose(out[2][[quality.TEXT_FEATURES.index(k) for k in ("non_ascii", "pipes")]], [2 / 3, 1 / 3])


def test_odd_rows(spark, odd_docs, no_docs):
    schema = "doc_id bigint, quality int, toxic int, text string"
    labels = spark.createDataFrame([(1, 1, 1, "a"), (1, 0, 0, "b"), (3, None, None, None), (None, 1, 1, None), (7, 1, 0, None), (8, 0, 1, None), (5, 1, 0, None), (6, 0, 1, None)], schema)
    for have in (labels, labels.limit(0), labels.where("quality = 1 and toxic = 1"), labels.where("toxic = 0")):
        assert quality.quality_scores(odd_docs, have).where("score between 0 and 1").count() == 11
        model = toxicity.train(odd_docs, have, toxicity.held_out)
        assert toxicity.score(odd_docs.select("doc_id", "text"), model).where("score between 0 and 1").count() == 11
    assert quality.quality_scores(no_docs, labels).count() == 0
    assert toxicity.score(no_docs.select("doc_id", "text"), toxicity.train(no_docs, labels, toxicity.held_out)).count() == 0
    for kept in (quality.reject_poor(odd_docs, labels), toxicity.reject_toxic(odd_docs, labels)):
        assert kept.columns == odd_docs.columns and kept.count() <= 11


def test_without_positives_nothing_is_toxic(spark, docs):
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, toxicity.held_out)
    assert toxicity.score(docs.select("doc_id", "text"), model).where("score > 0").count() == 0


def _found_at(spark, sf):
    path = f"/root/testdata/{sf}"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels, toxicity.held_out)).where(toxicity.held_out(F.col("doc_id")))
    score, label = _labelled(spark, scored, "toxic", path)
    called = score >= toxicity.THRESHOLD
    return int((called & (label == 1)).sum()), int(called.sum()), int(label.sum()), len(set(score))


def test_toxicity_at_small_sizes(spark):
    right, called, all_, values = _found_at(spark, "sf0.001")
    assert right >= 2 and called == right and values > 1
    right, called, all_, _ = _found_at(spark, "sf0.01")
    assert right / all_ >= 0.8 and right / called >= 0.9


def test_texts_are_not_shuffled_to_be_learnt_from(spark, sf_dir, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows, _ = toxicity.learning_rows(docs, labels, "toxic", toxicity.held_out)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    whole = rows.where("positive").count()
    monkeypatch.setattr(toxicity, "POSITIVES", 2)
    few, _ = toxicity.learning_rows(docs, labels, "toxic", toxicity.held_out)
    assert few.where("positive").count() < whole and few.count() == rows.count()


def _pieces(text):
    """What a text has, word by word: {(piece, kind): level} with the levels there, twice and dense."""
    words = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
    counts = {}
    for w in words:
        for k in (0, *toxicity.PREFIXES):
            bucket = _bucket(w[:k] if k else w, k)
            counts[bucket] = counts.get(bucket, 0) + 1
    out = set(counts)
    out |= {b + (1 << toxicity.HASH_BITS) for b, n in counts.items() if n >= 2}
    return out | {b + (2 << toxicity.HASH_BITS) for b, n in counts.items() if n >= 2 and n * toxicity.DENSE >= len(words)}


def _bucket(piece, k):
    from assayframe.llm._words import ALNUM, Words

    h = Words(np.frombuffer(piece, np.uint8), np.array([0, len(piece)]), ALNUM).hashes()
    return int((h * np.uint64(2 * k + 3) if k else h)[0] >> np.uint64(64 - toxicity.HASH_BITS))


def test_counts_risk_and_cut_match_brute_force(spark):
    rng = np.random.default_rng(1)
    names = ["foul", "fouler", "Nasty", "nice", "été", "a", "longerwordsthanall", "x1"]
    texts = [" ".join(rng.choice(names, rng.integers(0, 9))) for _ in range(60)]
    rows = [(t, bool("foul" in t.split() and i % 2)) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "text string, positive boolean").repartition(3)
    positive, unlabelled, n_p, n_u = toxicity.count_features(table)
    for own, kind, n in ((positive, True, n_p), (unlabelled, False, n_u)):
        want = np.zeros(toxicity.N_FEATURES)
        for t, p in rows:
            if p == kind:
                want[list(_pieces(t))] += 1
        assert (own == want).all() and n == sum(p == kind for _, p in rows)
    features = np.flatnonzero(positive + unlabelled > 0)[::3]
    place = {int(f): i for i, f in enumerate(features)}
    w, b = np.log((positive[features] + 0.1) / (unlabelled[features] + 1)), 0.3
    z = np.array([b + sum(w[place[f]] for f in _pieces(t) if f in place) for t, _ in rows])
    kind = np.array([p for _, p in rows])
    found = toxicity.patterns(table, features)
    risk, grad = toxicity._sums(found, w, b)
    assert np.allclose(risk, [np.logaddexp(0, -z[kind]).sum(), np.logaddexp(0, z[kind]).sum(), np.logaddexp(0, z[~kind]).sum()])
    up = 1 / (1 + np.exp(-z))
    assert np.isclose(grad[1, -1], up[kind].sum()) and np.isclose(grad[2, -1], up[~kind].sum())
    some = next(iter(place))
    has = np.array([some in _pieces(t) for t, _ in rows])
    assert np.isclose(grad[2, place[some]], up[~kind & has].sum())
    cut, _ = toxicity._cut(found, w, b)
    values = [(np.mean(z[kind] > c) ** 2 / max(np.mean(z > c), 1e-9), c) for c in np.unique(z) - toxicity._BIN]
    reached = np.mean(z[kind] > cut) ** 2 / np.mean(z > cut)
    assert reached >= 0.98 * max(v for v, _ in values)


def test_quality_does_not_depend_on_the_order_of_rows(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    copies = docs.unionByName(docs.where("doc_id % 3 = 0").withColumns({"doc_id": F.col("doc_id") + 1_000_000, "lang": F.lit("xx"), "source": F.lit("other"), "n_chars": F.lit(1).cast("bigint")}))
    a, b = (quality.quality_scores(d, labels).select("doc_id", "score").toPandas().sort_values("doc_id")["score"].to_numpy() for d in (copies.repartition(3, F.rand(1)), copies.orderBy(F.desc("n_chars")).repartition(5, F.rand(2))))
    assert np.allclose(a, b, atol=1e-9)


def test_labelled_rows_do_not_come_to_the_driver(spark, monkeypatch):
    path = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    table = written(quality.views(docs), "views")
    came = []
    frame = type(table)
    for name in ("toArrow", "toPandas", "collect"):

        def seen(self, *args, _plain=getattr(frame, name)):
            came.append(self.columns)
            return _plain(self, *args)

        monkeypatch.setattr(frame, name, seen)
    model = quality.train(table, labels)
    assert isinstance(model, quality.CoTrained) and came
    assert not [columns for columns in came if {"text_view", "meta_view", "doc_id"} & set(columns)]


def test_models_expand_few_rows_at_a_time():
    rng = np.random.default_rng(5)
    x, y, weight = rng.random((5000, 6), np.float32), (rng.random(5000) > 0.4).astype(float), rng.random(5000)
    model = quality.Logistic(3, 4).prepare(x)
    model.w = rng.standard_normal(len(model.w))
    z = model.expand(x)
    p = 1 / (1 + np.exp(-np.clip(z @ model.w, -30, 30)))
    sizes, plain = [], model.expand
    model.expand = lambda own: sizes.append(len(own)) or plain(own)
    grad, hess = model.sums(x, y, weight)
    assert np.allclose(grad, z.T @ (weight * (p - y))) and np.allclose(hess, (z * (weight * p * (1 - p))[:, None]).T @ z)
    assert np.allclose(model.logits(x), np.clip(z @ model.w, -30, 30)) and model.logits(x[:0]).shape == (0,)
    assert max(sizes) <= quality._ROWS < len(x)


def test_features_are_chosen_in_little_memory():
    rng = np.random.default_rng(6)
    positive, unlabelled = (rng.poisson(m, toxicity.N_FEATURES).astype(float) for m in (0.02, 1.0))
    positive[1000:1040] = 90
    tracemalloc.start()
    chosen = toxicity.choose_features(positive, unlabelled, 100, 2000, 0.05)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert list(chosen) == list(range(1000, 1040))
    assert peak < 2 * positive.nbytes


def test_sums_of_arrays_take_few_tasks(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shapes = [(3,), (2, 5)]

    def scan(batches):
        n = sum(batch.num_rows for batch in batches)
        yield _counts.floats([np.full(s, float(n)) for s in shapes])

    try:
        spark.sparkContext.setJobGroup("sums of arrays", "")
        got = _counts.total_floats(spark.range(0, 1000, 1, 5).mapInArrow(scan, _counts.SCHEMA), shapes)
        tracker = spark.sparkContext.statusTracker()
        stages = {s for job in tracker.getJobIdsForGroup("sums of arrays") for s in tracker.getJobInfo(job).stageIds}
        tasks = sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert [g.tolist() for g in got] == [np.full(s, 1000.0).tolist() for s in shapes]
    assert 5 <= tasks <= 5 + _counts.ADDERS + 1
