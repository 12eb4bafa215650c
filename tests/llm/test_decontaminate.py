import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from assayframe.llm import decontaminate as m

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOW))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, named = words(text), set(), set()
        for item_id, t in items:
            own = words(t)
            n = min(len(own), 13)
            windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    named.add(str(item_id)) if item_id is not None else None
        out.append((doc_id, len(w), len(hit), sorted(named), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def ours(spark, docs, items):
    found = m.find_contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in found.collect()), key=str)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(12)] + ["Über", "N1"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([0, 2, 5, 12, 13, 14, 30, 60])))) for i in range(12)] + [(3, "v1 v2 v3 v4 v5 v6"), (None, "v9 v9 v9 v9"), (50, None)]
    docs = []
    for d in range(60):
        text = [r.choice(vocab) for _ in range(r.choice([0, 3, 40, 200]))]
        if r.random() < 0.5:
            own = (r.choice(items)[1] or "").split()
            at = r.randint(0, len(text))
            cut = r.randint(0, 3)
            text[at:at] = own[cut:] if r.random() < 0.5 else own
        docs.append((d, ", ".join(text)))
    return docs + [(1, docs[1][1]), (None, docs[2][1]), (99, None)], items


@pytest.mark.parametrize("seed,shard", [(1, 1 << 20), (2, 100), (3, 700)])
def test_against_brute_force(spark, monkeypatch, seed, shard):
    monkeypatch.setattr(m, "SHARD_WORDS", shard)
    docs, items = corpus(seed)
    assert ours(spark, docs, items) == brute(docs, items)


def test_more_blocks_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_BYTES", 300)
    docs, items = corpus(4)
    assert ours(spark, docs, items) == brute(docs, items)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    symbols = np.concatenate([rng.integers(0, 3, 500), np.zeros(200, np.int64)])
    got = m.suffix_array(symbols, np.arange(500), 40, 3)
    keys = [tuple(symbols[i : i + 40]) for i in got]
    assert keys == sorted(keys) and sorted(got) == list(range(500))


def test_longest_matches(spark):
    item = " ".join(f"q{i}" for i in range(30))
    docs = [(1, "x " + " ".join(f"q{i}" for i in range(5, 28)) + " y")]
    found = m.find_contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(7, item)], "item_id bigint, text string")).first()
    assert [tuple(x) for x in found["matches"]] == [(7, 5, 1, 23)] and found["n_hit"] == 23


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "the cat sat on the mat and then it went away home")], "item_id bigint, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert ours(spark, rows, [(1, "the cat sat on the mat and then it went away home")]) == brute(rows, [(1, "the cat sat on the mat and then it went away home")])
    kept = m.remove_contaminated(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == 9
    assert m.remove_contaminated(odd_docs, items.limit(0)).count() == 11
    assert m.remove_contaminated(no_docs, items).count() == 0


def test_repetitive_texts_cost_no_more():
    """A text of one word against an item of that word: 19,000 places by 900 suffixes, in linear memory."""
    import tracemalloc

    bench = m.Benchmark([(1, "go " * 1000), (2, "go " * 40 + "stop")], 13)
    raw, offsets = m.string_buffers(pa.array(["go " * 20_000, "stop go"]))
    words = m.Words(raw, offsets, m.ALNUM)
    tracemalloc.start()
    found = m._findings(words.hashes(), np.diff(words.first), bench)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 << 20
    assert found["spans"].to_pylist() == [[{"start": 0, "end": 20_000}], []]
    assert found["item_ids"].to_pylist() == [[1, 2], []]
    matches = found["matches"].to_pylist()[0]
    assert matches[0] == {"item_id": 1, "item_word": 0, "doc_word": 0, "n_words": 1000} and len(matches) == 21


def test_longest_of_several_items(spark):
    a, b = " ".join(f"q{i}" for i in range(20)), " ".join(f"q{i}" for i in range(3, 40))
    found = m.find_contamination(spark.createDataFrame([(1, "z " + b)], "doc_id bigint, text string"), spark.createDataFrame([(1, a), (2, b)], "item_id bigint, text string")).first()
    assert [tuple(x) for x in found["matches"]] == [(2, 0, 1, 37)] and found["item_ids"] == ["1", "2"]


def test_kept_columns_may_be_called_anything(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x", "y")], "doc_id bigint, text string, n_words int, _row string, _text string")
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    found = m.find_contamination(docs, items, keep=("n_words", "_row", "_text")).first()
    assert (found["kept_n_words"], found["_row"], found["_text"], found["n_words"], found["contaminated"]) == (5, "x", "y", 2, True)
    assert m.remove_contaminated(docs, items).columns == docs.columns


def test_ranks_are_those_of_sorted_suffixes():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 60, 200):
        symbols = np.append(rng.integers(0, 3, n), 0).astype(np.int32)
        ends = np.flatnonzero(symbols == 0)
        # an end is smaller than any word, and of two ends the earlier
        named = [tuple((1, s) if s else (0, int(np.searchsorted(ends, i + d))) for d, s in enumerate(symbols[i:].tolist())) for i in range(len(symbols))]
        want = sorted(range(len(symbols)), key=lambda i: named[i])
        assert np.argsort(m.suffix_ranks(symbols)).tolist() == want


def test_repetitive_benchmarks_take_few_steps():
    began = time.time()
    bench = m.Benchmark([(1, "go " * 1_000_000), *((i, f"w{i} x{i} y{i % 7} " * 6) for i in range(2, 3000))], 13)
    assert time.time() - began < 30 and len(bench.at) > 1_000_000
    a = np.append(np.ones(300_000, np.int32), 0)
    assert m.agreement(a, np.array([0, 5]), a, np.array([1, 299_000]), np.array([0, 0])).tolist() == [299_999, 1000]
