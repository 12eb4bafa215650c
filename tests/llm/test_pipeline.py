import re

import corpus_pipeline
from assayframe.llm._shared import written


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == first.columns
    assert counts[:4] == sorted(counts[:4], reverse=True) and 0 < counts[3] < first.count()
    assert docs.select("doc_id").distinct().count() == counts[3]
    run = corpus_pipeline.run(spark, sf_dir)
    assert run.columns == docs.columns and run.count() == docs.count()


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "ngram_join", "decontamination", "packing"]
    assert re.search("ORACLE_SQL", open(corpus_pipeline.__file__).read()) and corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, columns called as an operator's own are, and empty tables: every stage gives a result."""
    rows = [(1, "The cat sat on the mat and went home", "en", "s", 10, "x", 1), (1, "The cat sat on the mat and went home", "en", "s", 10, "x", 1), (2, None, None, None, None, None, None)]
    rows += [(3, "", "en", "s", 0, "x", 2), (None, "no id here", "de", "t", 5, "x", 3), (4, "one two", "fr", "t", 7, "y", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, n_words int")
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([(1, "one two"), (None, "x"), (2, None)], "item_id bigint, text string")
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", items)):
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
        table.limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    own = docs
    for name, stage in corpus_pipeline.STAGES:
        own = written(stage(spark, own, str(tmp_path)), name)
        if name != "packing":
            assert own.columns == docs.columns
    # the copy of 1 goes, and 4 is a benchmark item as a whole
    assert sorted((r["doc_id"] or 0, r["length"] > 0) for r in own.collect()) == [(0, True), (1, True), (2, True), (3, True)]
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
