import random
from itertools import permutations
from math import factorial

from assayframe.llm import filter_audit as fa

COLUMNS = "part mask n good toxic".split()


def brute(counts, filters):
    """Every document through every order."""
    out = {}
    for part in {c[0] for c in counts}:
        docs = [c for c in counts if c[0] == part]
        shapley = dict.fromkeys(range(len(filters)), 0)
        rows = []
        for order in permutations(range(len(filters))):
            left, gone = docs, 0
            for step, f in enumerate(order, 1):
                out_now = [d for d in left if d[1] >> f & 1]
                left = [d for d in left if not d[1] >> f & 1]
                removed = sum(d[2] for d in out_now)
                failing = sum(d[2] for d in docs if d[1] >> f & 1)
                shapley[f] += removed
                rows.append(("".join(filters[g] for g in order), step, f, sum(d[2] for d in left), removed, failing - removed, sum(d[2] for d in docs if d[1] == 1 << f), sum(d[3] for d in out_now), sum(d[4] for d in out_now)))
        for order, step, f, *told in rows:
            out[part, order, step] = (*told, shapley[f])
    return out


def test_audit_matches_brute_force(spark):
    rng = random.Random(3)
    for k in (1, 2, 3, 5):
        counts = [(p, m, rng.randrange(1, 50), rng.randrange(5), rng.randrange(5)) for p in ("", "a", "b") for m in range(1 << k) if rng.random() < 0.7]
        filters = tuple("VWXYZ"[:k])
        got = fa.audit(spark.createDataFrame(counts, "part string, mask int, n bigint, good bigint, toxic bigint"), filters).collect()
        assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == brute(counts, filters)
        assert len(got) == len({c[0] for c in counts}) * factorial(k) * k


def test_lattice_counts_every_order_once():
    edges = fa.lattice_edges(5)
    assert len(edges) == 5 * 16
    for size in range(5):  # each order takes one edge of each step
        assert sum(n for s, _, n in edges if s.bit_count() == size) == 120


DOCS = [
    (3, "good " * 150 + "words here " * 60, "a"), (1, "same", "a"), (1, "same", "b"), (2, "same", "a"), (2, "same", "a"), (None, "same", "a"), (None, "same", None),
    (5, None, None), (4, "", ""), (6, "LOUD $ TEXT", "a"), (7, " \n\t ", "a"), (8, "ünï " * 300, "a"),
]


def test_failures_of_odd_rows(spark):
    docs = spark.createDataFrame([(*d, "clash") for d in DOCS], "doc_id bigint, text string, source string, mask string")
    labels = spark.createDataFrame([(2, 1, None), (2, 0, 1), (None, 1, 1), (6, None, 0), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = {(r["part"], r["mask"]): (r["n"], r["good"], r["toxic"]) for r in fa.failure_counts(docs, labels).collect()}
    a, b, c, d, e = 1, 2, 4, 8, 16
    want = {("a", 2): (2, 0, 0), ("a", a): (3, 0, 0), ("b", a): (1, 0, 0), ("a", a + e): (2, 2, 2), ("", a): (2, 0, 0), ("", a + e): (1, 0, 0), ("a", a + c + d): (1, 0, 0)}
    # "" of 4 is the original of the null text of 5; the null id's "same" is nobody's copy; white space is no copy of ""
    assert got == want
    assert fa.failure_counts(docs).agg({"toxic": "sum"}).first()[0] == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert fa.audit(fa.failure_counts(docs, labels)).collect() == []
    one = spark.createDataFrame([(1, "x", "s")], docs.schema)
    assert {r["kept"] for r in fa.audit(fa.failure_counts(one, labels)).collect()} == {0, 1}
