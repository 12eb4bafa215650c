"""The numbered queries over the test tables, with their SQL where SQL can express them."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.llm import _tokens, chat_format, decontaminate, filter_audit, html_extract, license_scan, ngram_join, packing, periodic_runs, pivot_topk, quality, token_file, toxicity, url_filter
from assayframe.llm._shared import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    messages = rows.unionByName(extra).withColumn("content", chat_format.text_parts(F.col("text")))
    chats = chat_format.format_chats(messages)
    turns = chats.withColumn("read", F.arrays_zip(chat_format.read_back(F.col("formatted")).alias("turn"), F.col("turns").alias("mask")))
    digested = F.array_join(F.transform("read", lambda t: F.concat(t["turn"]["role"], F.lit("\n"), t["turn"]["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("read", lambda t: t["mask"]["loss"]), lambda t: t["turn"]["text"]), "")
    return turns.select("conv_id", F.size("read").cast("bigint").alias("n_turns"), digested.alias("digested"), learnt.alias("learnt"), "formatted").select(
        "conv_id",
        "n_turns",
        F.sha2("digested", 256).alias("turns_sha256"),
        F.length("learnt").cast("bigint").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v),
formed AS (SELECT *, replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g') AS r, replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g') AS t FROM rows)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length('<turn ' || r || '>' || t || '</turn>') + 1) AS BIGINT) AS formatted_chars
FROM formed GROUP BY conv_id"""


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = ngram_join.near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = pivot_topk.usable(table(spark, sf_dir, "embeddings"))
    return pivot_topk.top_k(vectors, vectors.where(F.pmod("vec_id", F.lit(50)) == 0), 5)


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS t
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes)),
hits AS (SELECT doc_id, item_id, i, p.n FROM places p JOIN windows USING (n, t)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)"""


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), _tokens.default_path())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.held_out)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "ids")
    token_file.write_ids(table(spark, sf_dir, "documents"), path, _tokens.default_path())
    return token_file.read_ids(spark, path, with_ids=False)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


_NO_SPACE = re.compile("[^ \t-\r]+")


@F.arrow_udf(T.StringType())
def _with_repeats(texts: pa.Array, g: pa.Array) -> pa.Array:
    """Texts whose words from a on are the first p of these over and over; g says what a and p are."""

    def one(text: str, g: int) -> str:
        words = _NO_SPACE.findall(text)
        if not words:
            return text
        n = len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return " ".join(words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a])

    return pa.array([one(t.as_py(), x.as_py()) for t, x in zip(texts, g)], pa.string())


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with repeats written into a tenth of the texts, as the query's contract has them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    return texts.where(~chosen).unionByName(texts.where(chosen).select("doc_id", _with_repeats("text", F.floor(h / 10)).alias("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(repeated(table(spark, sf_dir, "documents")))
    longer = lambda x, y: y["length"] * x["period"] - x["length"] * y["period"]
    order = F.array_sort("runs", lambda x, y: F.when(longer(x, y) != 0, F.signum(longer(x, y)).cast("int")).when(x["start"] != y["start"], F.signum(x["start"] - y["start"]).cast("int")).otherwise(F.signum(x["period"] - y["period"]).cast("int")))
    best = F.get(order, 0)
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    lines = F.array_join(F.transform("runs", line), "")
    return found.select("row.doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.failure_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def queries() -> dict:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_ngram_join": op2_ngram_join,
        "op3_quality": op3_quality,
        "op4_pivot_topk": op4_pivot_topk,
        "op5_chat_format": op5_chat_format,
        "op6_decontamination": op6_decontamination,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_toxicity": op8_toxicity,
        "op9_token_file": op9_token_file,
        "op10_html_extract": op10_html_extract,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_url_filter": op12_url_filter,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict:
    return {"op1_license_scan": license_scan.oracle(), "op4_pivot_topk": OP4_SQL, "op5_chat_format": OP5_SQL, "op6_decontamination": OP6_SQL, "op12_url_filter": url_filter.SQL, "op13_filter_audit": filter_audit.SQL}
