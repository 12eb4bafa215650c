import numpy as np
import pytest
from pyspark.sql import functions as F

from assayframe.llm import pivot_topk as m


def brute(rows, k):
    good = {}
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.setdefault(i, []).append([int(np.floor(256 * x)) for x in v])
    out = []
    for q in sorted(x for x in good if x % 50 == 0):
        score = {c: max(sum(a * b for a, b in zip(good[q][0], v)) for v in vs) for c, vs in good.items() if c != q}
        best = sorted(score.items(), key=lambda s: (-s[1], s[0]))[:k]
        out += [(q, n, c, s) for n, (c, s) in enumerate(best, 1)]
    return sorted(out)


def ours(spark, rows, k=5):
    vectors = m.usable(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int, score string"))
    return sorted(tuple(r) for r in m.top_k(vectors, vectors.where(F.pmod("vec_id", F.lit(50)) == 0), k).collect())


@pytest.mark.parametrize("blocks", [(16384, 2048), (40, 3)])
def test_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(m, "BLOCK", blocks[0])
    monkeypatch.setattr(m, "QUERY_BLOCK", blocks[1])
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(400, 12)) * rng.random((400, 1))).astype(np.float32)
    x[100:150] = x[50]  # ties
    rows = [(int(i), [float(v) for v in x[i]], 1, "s") for i in range(400)]
    assert ours(spark, rows) == brute([(r[0], r[1]) for r in rows], 5)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1, None), (1, None, 1, None), (2, [1.0, None], 1, None), (3, [float("nan"), 1.0], 1, None), (4, [float("inf"), 1.0], 1, None), (5, [-1.0, 0.5], None, "s"), (50, [0.0, 0.0], 1, None), (6, [], 1, None), (7, [3.0], 1, None), (7, [3.0], 1, None)]
    assert ours(spark, rows) == brute([(r[0], r[1]) for r in rows], 5)
    assert ours(spark, [(1, [1.0], 1, None)]) == []
    assert ours(spark, rows[:1]) == []


def test_elimination_leaves_candidates_out():
    rng = np.random.default_rng(2)
    centres = rng.integers(-2000, 2000, (20, 8))
    x = (centres[rng.integers(0, 20, 4000)] + rng.integers(-20, 20, (4000, 8))).astype(np.int64)
    ids = np.arange(4000)
    most = float((x.astype(float) ** 2).sum(axis=1).max())
    pivots = m.choose_pivots(x[:500], 16)
    seen = []
    q_ids, found, scores = m.eliminate(x[:5], ids[:5], x, ids, m.pivot_table(x, pivots, most), pivots, most, 5, chunk=64, seen=seen)
    assert len(seen) == 5 and max(seen) < 0.5 * len(x)  # clustered vectors: most candidates are never compared
    for i in range(5):
        s = x @ x[i]
        want = sorted((j for j in ids if j != i), key=lambda j: (-s[j], j))[:5]
        assert found[q_ids == i].tolist() == want


def test_queries_repeated_with_other_vectors(spark):
    vectors = spark.createDataFrame([(1, [1, 0]), (2, [0, 9]), (3, [9, 0])], "vec_id bigint, v array<bigint>")
    for order in ([(7, [5, 0]), (7, [0, 5])], [(7, [0, 5]), (7, [5, 0])]):
        asked = spark.createDataFrame(order, "vec_id bigint, v array<bigint>").coalesce(1)
        got = m.top_k(vectors, asked, 1).collect()
        assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(7, 2, 45)]


def test_components_beyond_exact_scores_are_an_error(spark):
    make = lambda x: spark.createDataFrame([(1, [1.0, 2.0]), (2, [x, 0.0])], "vec_id bigint, embedding array<double>")
    assert m.usable(make(5e6)).count() == 2 and sum(r["v"][0] for r in m.usable(make(5e6)).collect()) == 256 + 1_280_000_000
    for x in (1e300, -6.1e6, 8388608.0):
        with pytest.raises(Exception, match="vector 2 are too large"):
            m.usable(make(x)).collect()
