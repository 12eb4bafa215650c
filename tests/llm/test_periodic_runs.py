import hashlib
import random
import re
import zlib
from fractions import Fraction

import pyarrow as pa
import pytest

from assayframe.llm import periodic_runs, queries

SPACE = re.compile("[^ \t-\r]+")


def brute_runs(words):
    """Every maximal stretch, period by period; the smallest period of a stretch stays."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((start, length, q) for (start, length), q in found.items())


def brute_collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs))


def periodic_texts(n, seed=7):
    rng = random.Random(seed)
    for _ in range(n):
        words = [f"w{rng.randrange(rng.choice([1, 2, 3, 5, 60]))}" for _ in range(rng.randrange(350))]
        kind = rng.randrange(5)
        if kind < 2 and words:
            a = rng.randrange(len(words))
            p = 1 + rng.randrange(max(1, (len(words) - a) // 3))
            words = [words[i if i < a else a + (i - a) % p] for i in range(len(words))]
        elif kind == 2:
            root = [f"r{rng.randrange(3)}" for _ in range(rng.randrange(1, 70))]
            words = words[:40] + root * rng.randrange(2, 6) + root[: rng.randrange(len(root))] + words[40:]
        elif kind == 3:
            words = (["a"] * rng.randrange(1, 40) + ["b"]) * rng.randrange(2, 8) + words[:30]
        yield words


@pytest.mark.parametrize("most", [500, 20_000, 1 << 20])
def test_runs_match_brute_force(most):
    texts = list(periodic_texts(300))
    got = periodic_runs.runs_of(pa.array([" ".join(w) for w in texts]), most)
    assert got == [brute_runs(w) for w in texts]
    assert sum(map(len, got)) > 100


def test_collapse_keeps_first_periods():
    for words in periodic_texts(60, 8):
        runs = brute_runs(words)
        assert periodic_runs.collapsed_text(" \n".join(words), runs) == brute_collapsed(words, runs)


def test_long_periodic_texts_take_linear_steps():
    n = 200_000
    assert periodic_runs.runs_of(pa.array([" ".join(["a"] * n)])) == [[(0, n, 1)]]
    assert periodic_runs.runs_of(pa.array([" ".join(f"w{i % 60_000}" for i in range(n))])) == [[(0, n, 60_000)]]


@pytest.mark.parametrize("tile", [64, 1024])
def test_tiles_of_long_texts_are_stitched(spark, tile):
    texts = [" ".join(w) for w in periodic_texts(60, 9)]
    texts += texts[:5] + [" ".join(f"x{i % 700}" for i in range(5000)), " ".join(["b"] * 3000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    found = periodic_runs.find_runs(docs, span=100, tile=tile).select("row.doc_id", "runs", "collapsed").collect()
    assert sorted(r["doc_id"] for r in found) == list(range(len(texts)))
    for r in found:
        words = SPACE.findall(texts[r["doc_id"]])
        runs = brute_runs(words)
        assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == runs
        assert r["collapsed"] == brute_collapsed(words, runs)


def test_odd_rows(spark, odd_docs, no_docs):
    found = periodic_runs.find_runs(odd_docs).select("row.*", "runs", "collapsed").collect()
    assert len(found) == odd_docs.count() and {r["score"] for r in found} == {"x", None}
    by_text = {r["text"]: r for r in found}
    assert by_text[None]["runs"] == [] and by_text[None]["collapsed"] == "" == by_text[" \n\t "]["collapsed"] == by_text[""]["collapsed"]
    long = max((t for t in by_text if t), key=len)
    assert by_text[long]["collapsed"] == " ".join(SPACE.findall(long))
    assert periodic_runs.find_runs(no_docs).collect() == []


def contract(doc_id, text):
    words = SPACE.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(brute_collapsed(words, runs)))


def test_query_follows_its_contract(spark, sf_dir):
    got = sorted(tuple(r) for r in queries.op11_periodic_runs(spark, sf_dir).collect())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    short = {r["doc_id"]: r["text"] for r in docs if len(r["text"] or "") < 12_000}
    assert len(got) == len(docs) and len(short) > 180
    assert [r for r in got if r[0] in short] == sorted(contract(*x) for x in short.items())
    assert sum(r[1] > 0 for r in got) > 5
