import random
import re

import pytest

from assayframe.llm import ngram_join as m
from assayframe.llm._components import connected_components

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOW))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    names = {}
    for i, (doc_id, _) in enumerate(rows):
        names.setdefault(top(i), []).append(doc_id)
    return sorted((d, len(s), min((x for x in names[top(i)] if x is not None), default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets)) if d is not None)


def ours(spark, rows):
    found, _ = m.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string"))
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect() if r["doc_id"] is not None)


def corpus(seed, n=150):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passages = [[r.choice(vocab) for _ in range(60)] for _ in range(4)]
    texts = []
    for _ in range(n):
        kind = r.random()
        if texts and kind < 0.5:
            words = list(r.choice(texts))
            for _ in range(r.randint(0, 1 + len(words) // 25)):
                words[r.randrange(len(words))] = r.choice(vocab)
        else:
            words = [r.choice(vocab) for _ in range(r.choice([1, 3, 5, 6, 20, 80, 200]))]
        if kind > 0.8:
            words = words + r.choice(passages)
        texts.append(words)
    return [(i * 7 % n, " ".join(w)) for i, w in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert ours(spark, rows) == brute(rows)


def test_frequent_shingles_are_salted(spark, monkeypatch):
    monkeypatch.setattr(m, "HOT", 3)
    monkeypatch.setattr(m, "HOT_MEANS", 0)
    monkeypatch.setattr(m, "SALTS", 3)
    rows = corpus(4)
    assert ours(spark, rows) == brute(rows)


def test_a_chain_of_copies_is_one_component(spark):
    words = [f"x{i}" for i in range(120)]
    rows = []
    for i in range(40):
        words[i * 3] = f"new{i}"
        rows.append((100 - i, " ".join(words)))
    assert ours(spark, rows) == brute(rows)


@pytest.mark.parametrize("block", [256, 3])
def test_every_link_is_listed(spark, monkeypatch, block):
    monkeypatch.setattr(m, "BLOCK_SETS", block)
    words = [f"x{i}" for i in range(120)]
    rows = corpus(5, 80) + [(100 + i, " ".join(words[: i * 4] + [f"new{i}"] + words[i * 4 + 1 :])) for i in range(25)] + [(200, " ".join(words)), (201, " ".join(words).upper())]
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} for d, t in rows if (w := t.translate(_LOW).split()) or True}
    linked = {d: {e for e in sets if e != d and 100 * len(sets[d] & sets[e]) >= 75 * len(sets[d] | sets[e])} for d in sets}
    found, links = m.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = found.collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == {d: len(e) for d, e in linked.items()}
    named = {r["doc_id"]: r["class"] for r in got}
    expected = {tuple(sorted((named[d], named[e]))) for d in linked for e in linked[d] if named[d] != named[e]}
    listed = [(r["a"], r["b"]) for r in links.collect()]
    assert len(listed) == len(set(listed)) and set(listed) == expected


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert ours(spark, rows) == brute(rows)
    found, links = m.near_copies(no_docs)
    assert found.count() == 0 and links.count() == 0
    kept = m.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 9]


def test_a_copy_without_an_id_names_nothing(spark):
    words = [f"x{i}" for i in range(120)]
    one, near = " ".join(words), " ".join(["new"] + words[1:])
    docs = spark.createDataFrame([(None, one), (5, one), (7, one), (6, near)], "doc_id bigint, text string")
    found = m.keep_one_of_each(docs).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in found) == [(0, one), (5, one)]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(10, 60)] + [(3, 90), (90, 91), (5, 5)], "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in connected_components(links).collect()}
    assert all(got[i] == 10 for i in range(10, 61)) and got[91] == got[90] == 3 and got[5] == 5
