"""Queries of the library's operators over the test tables, with equal SQL.

Views take the place of recorded runs: events are samples of cases (one case for each user), documents are answers,
benchmark items are cases, and skill documents, transcripts and verdicts are built from them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayframe.functions import metrics, schema, text, verdicts
from assayframe.operators import grading, lint, numbering, rounds, samples, status, transcripts
from assayframe.plans import runners
from assayframe.shared import shared_dir
from assayframe.sources.store import ResultStore

K = 3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return events.select(
        F.concat(F.lit("u"), "user_id").alias("case_source"),
        "user_id",
        "event_id",
        nth.alias("iteration"),
        (F.col("value") >= 20).alias("passed"),
        (F.col("event_id") % 4 == 0).alias("cached"),
        (F.col("event_type") == "error").alias("infra_failure"),
        F.col("event_type").alias("tool"),
        "props",
        "value",
    )


RUNS = """runs AS (SELECT concat('u', user_id) AS case_source, user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS iteration,
    value >= 20 AS passed, event_id % 4 = 0 AS cached, event_type = 'error' AS infra_failure, event_type AS tool, props, value FROM events)"""


def plain_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """runs without the ordinal, for queries that only count: no window, so no shuffle of single rows."""
    return _table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id").alias("case_source"), "user_id", "event_id", (F.col("value") >= 20).alias("passed"), (F.col("event_id") % 4 == 0).alias("cached"), (F.col("event_type") == "error").alias("infra_failure"), F.col("event_type").alias("tool")
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("response"))


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A skill document of every text, with faults chosen by its id."""
    d = F.col("doc_id")
    name = F.when(d % 7 == 0, "").when(d % 7 == 1, "Bad Name").when(d % 7 == 2, "claude-helper").otherwise(F.concat(F.lit("skill-"), d))
    description = F.when(d % 5 == 0, "").when(d % 5 == 1, F.repeat(F.lit("long "), 210)).when(d % 5 == 2, "uses <b> tags").otherwise("does things")
    extra = F.when(d % 3 == 0, "license: MIT\n").when(d % 3 == 1, "license: MIT\ncompatibility: all\nmetadata: x\n").otherwise("")
    close = F.when(d % 11 == 0, "").otherwise("---\n")
    head = F.when(d % 13 == 0, "").otherwise(F.concat(F.lit("---\nname: "), name, F.lit("\ndescription: "), description, F.lit("\n"), extra, close))
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.lit("## Goals\n1. first\n2. second\n\n## Prohibitions\n- never\n* ever\n\n```python\nx = 1\n```\n"), F.col("text")).alias("content"))
    front, body = text.split_frontmatter(F.col("content"))
    folder = F.when(d % 4 == 0, F.concat(F.lit("skill-"), d)).when(d % 4 == 1, "Some_Folder").otherwise("other")
    return docs.select(
        F.concat(F.lit("skills/"), d).alias("path"),
        "doc_id",
        "content",
        F.when(d % 6 == 0, "skill.md").otherwise("SKILL.md").alias("filename"),
        folder.alias("folder"),
        (d % 9 == 0).alias("has_readme"),
        F.coalesce(text.simple_fields(front), F.create_map().cast("map<string,string>")).alias("fields"),
        body.alias("body"),
    )


_HEAD = """CASE WHEN doc_id % 13 = 0 THEN '' ELSE '---' || chr(10) || 'name: ' || name || chr(10) || 'description: ' || description || chr(10) || extra || CASE WHEN doc_id % 11 = 0 THEN '' ELSE '---' || chr(10) END END"""
_BODY = "'## Goals' || chr(10) || '1. first' || chr(10) || '2. second' || chr(10) || chr(10) || '## Prohibitions' || chr(10) || '- never' || chr(10) || '* ever' || chr(10) || chr(10) || '```python' || chr(10) || 'x = 1' || chr(10) || '```' || chr(10) || text"
SKILLS = f"""parts AS (SELECT doc_id, text,
    CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'Bad Name' WHEN 2 THEN 'claude-helper' ELSE 'skill-' || doc_id END AS name,
    CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN repeat('long ', 210) WHEN 2 THEN 'uses <b> tags' ELSE 'does things' END AS description,
    CASE doc_id % 3 WHEN 0 THEN 'license: MIT' || chr(10) WHEN 1 THEN 'license: MIT' || chr(10) || 'compatibility: all' || chr(10) || 'metadata: x' || chr(10) ELSE '' END AS extra FROM documents),
skills AS (SELECT 'skills/' || doc_id AS path, doc_id, {_HEAD} || {_BODY} AS content, doc_id % 13 <> 0 AS opens, doc_id % 13 <> 0 AND doc_id % 11 <> 0 AS fronted,
    CASE WHEN doc_id % 6 = 0 THEN 'skill.md' ELSE 'SKILL.md' END AS filename, CASE doc_id % 4 WHEN 0 THEN 'skill-' || doc_id WHEN 1 THEN 'Some_Folder' ELSE 'other' END AS folder, doc_id % 9 = 0 AS has_readme,
    CASE WHEN doc_id % 13 <> 0 AND doc_id % 11 <> 0 THEN name ELSE '' END AS name, CASE WHEN doc_id % 13 <> 0 AND doc_id % 11 <> 0 THEN rtrim(description) ELSE '' END AS description,
    CASE WHEN doc_id % 13 <> 0 AND doc_id % 11 <> 0 THEN extra ELSE '' END AS extra, {_BODY} AS body0 FROM parts),
bodies AS (SELECT *, CASE WHEN fronted OR NOT opens THEN body0 ELSE content END AS body FROM skills)"""

_LINT = {
    "frontmatter-valid": ("name = ''", "'Frontmatter missing required field: name'", "warning", 1),
    "frontmatter-valid ": ("description = ''", "'Frontmatter missing required field: description'", "warning", 1),
    "frontmatter-delimiters": ("NOT opens", "'File must start with --- frontmatter delimiter'", "error", 1),
    "frontmatter-delimiters ": ("opens AND NOT fronted", "'Missing closing --- frontmatter delimiter'", "error", 1),
    "frontmatter-no-xml": ("fronted AND contains(description, '<')", "'Frontmatter must not contain XML angle brackets (< >)'", "error", None),
    "filename-case": ("filename <> 'SKILL.md'", "'File should be named SKILL.md, got ' || filename", "warning", None),
    "folder-kebab-case": ("folder = 'Some_Folder'", "'Folder name must be kebab-case, got ''' || folder || ''''", "warning", None),
    "name-kebab-case": ("name = 'Bad Name'", "'Name must be kebab-case, got ''Bad Name'''", "warning", None),
    "name-matches-folder": ("name <> '' AND name <> folder", "'Name ''' || name || ''' does not match folder ''' || folder || ''''", "warning", None),
    "name-no-reserved": ("name = 'claude-helper'", "'Name must not contain reserved word ''claude'''", "error", None),
    "description-length": ("length(description) > 1024", "'Description is ' || length(description) || ' chars (max 1024)'", "warning", None),
    "body-word-count": ("len(regexp_extract_all(body, '[^\\s\\p{Z}]+')) > 5000", "'Body is ' || len(regexp_extract_all(body, '[^\\s\\p{Z}]+')) || ' words (recommended max 5,000)'", "warning", None),
    "no-readme": ("has_readme", "'Skill folder should not contain a README.md'", "warning", None),
    "field-license": ("NOT contains(extra, 'license')", "'Missing recommended field: license'", "warning", None),
    "field-compatibility": ("NOT contains(extra, 'compatibility')", "'Missing recommended field: compatibility'", "warning", None),
    "field-metadata": ("NOT contains(extra, 'metadata')", "'Missing recommended field: metadata'", "warning", None),
}


def _lint_sql(rule: str | None = None) -> str:
    found = [
        f"SELECT path, '{name.strip()}' AS rule, {message} AS message, '{severity}' AS severity, {'NULL' if line is None else line}::INTEGER AS line FROM bodies WHERE {condition}"
        for name, (condition, message, severity, line) in _LINT.items()
        if rule in (None, name.strip())
    ]
    return f"WITH {SKILLS} " + " UNION ALL ".join(found)


def _lint_query(rule: str | None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lint.lint(skills(spark, sf_dir), None if rule is None else [rule]).drop("ord")

    return query


def block_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transcript for each user: one line for each event, some malformed, some no object."""
    e = F.col("event_id")
    line = (
        F.when(e % 6 == 0, F.concat(F.lit('{"type":"assistant","message":{"content":[{"type":"text","text":"t'), e, F.lit(' "}]}}')))
        .when(e % 6 == 1, F.concat(F.lit('{"type":"assistant","message":{"content":[{"type":"tool_use","name":"'), F.col("event_type"), F.lit('","input":'), F.col("props"), F.lit("}]}}")))
        .when(e % 6 == 2, F.concat(F.lit('{"type":"system","subtype":"init","session_id":"s'), e, F.lit('"}')))
        .when(e % 6 == 3, F.concat(F.lit('{"type":"result","result":"r'), e, F.lit('"}')))
        .when(e % 6 == 4, F.lit("{broken"))
        .otherwise(F.lit("[1, 2]"))
    )
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("task_key"), F.lit(0).alias("turn"), F.col("event_id").alias("line_no"), line.alias("raw"))


def item_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    line = (
        F.when(e % 5 == 0, F.concat(F.lit('{"type":"item.completed","item":{"id":"i","type":"agent_message","text":"m'), e, F.lit('"}}')))
        .when(e % 5 == 1, F.concat(F.lit('{"type":"item.completed","item":{"id":"i","type":"command_execution","status":"ok","command":"c'), e, F.lit('"}}')))
        .when(e % 5 == 2, F.concat(F.lit('{"type":"thread.started","thread_id":"h'), e, F.lit('"}')))
        .when(e % 5 == 3, F.concat(F.lit('{"type":"turn.failed","error":{"message":"f'), e, F.lit('"}}')))
        .otherwise(F.lit(""))
    )
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("task_key"), F.lit(0).alias("turn"), F.col("event_id").alias("line_no"), line.alias("raw"))


_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def _round(c: Column | str) -> Column:
    return F.round(c, 9)


@_query(f"WITH {RUNS} SELECT count(*) AS total_runs, count(*) FILTER (passed) AS total_pass, count(*) FILTER (cached) AS cached_count, count(*) FILTER (NOT cached) AS fresh_count, round(100.0 * count(*) FILTER (passed) / count(*), 9) AS pass_rate FROM runs")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.summary(plain_runs(spark, sf_dir)).withColumn("pass_rate", _round("pass_rate"))


_NC = f"WITH {RUNS}, g AS (SELECT case_source, count(*) AS n, count(*) FILTER (passed) AS c, {K} AS k FROM runs GROUP BY 1)"


@_query(f"{_NC} SELECT case_source, n, c, round(CASE WHEN n = 0 OR k > n THEN NULL WHEN c = 0 THEN 0.0 ELSE 1 - greatest(n-c, 0)::DOUBLE/n * greatest(n-c-1, 0)/(n-1) * greatest(n-c-2, 0)/(n-2) END, 9) AS pass_at_k FROM g")
def per_eval_pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.per_case(plain_runs(spark, sf_dir), K).select("case_source", "n", "c", _round("pass_at_k").alias("pass_at_k"))


@_query(f"{_NC} SELECT case_source, n, c, round(CASE WHEN n = 0 OR k > n THEN NULL WHEN c < k THEN 0.0 ELSE c::DOUBLE/n * (c-1)/(n-1) * (c-2)/(n-2) END, 9) AS pass_pow_k FROM g")
def per_eval_pass_pow_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.per_case(plain_runs(spark, sf_dir), K).select("case_source", "n", "c", _round("pass_pow_k").alias("pass_pow_k"))


def _assertion(kind: str, value: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        holds = grading.check(kind, F.col("response"), F.array().cast("array<string>"), F.lit(value))
        return answers(spark, sf_dir).select("doc_id", holds.alias("holds"))

    return query


for _kind, _value, _sql in (
    ("contains", "The", "contains(lower(text), 'the')"),
    ("not_contains", "Und", "NOT contains(lower(text), 'und')"),
    ("starts_with", "T", "starts_with(lower(text), 't')"),
    ("ends_with", "N.", "ends_with(regexp_replace(lower(text), '\\s+$', ''), 'n.')"),
):
    _QUERIES[f"assert_{_kind}"] = _assertion(_kind, _value)
    _SQL[f"assert_{_kind}"] = f"SELECT doc_id, {_sql} AS holds FROM documents"


@_query("SELECT doc_id, regexp_matches(text, '[A-Z][a-z]+ing\\b') AS passed FROM documents")
def assert_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir).withColumn("tools", F.array().cast("array<string>")).withColumn("assertions", F.array(F.struct(F.lit("regex").alias("type"), F.lit(r"[A-Z][a-z]+ing\b").alias("value"))))
    return grading.grade(rows).select("doc_id", F.col("judgment.pass").alias("passed"))


_TOOLS = f"WITH {RUNS} SELECT case_source, list_contains(list(DISTINCT tool), 'error') AS holds FROM runs GROUP BY 1"


@_query(_TOOLS)
def assert_tool_called(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = plain_runs(spark, sf_dir).groupBy("case_source").agg(F.collect_set("tool").alias("tools"))
    return tools.select("case_source", grading.check("tool_called", F.lit(""), F.col("tools"), F.lit("error")).alias("holds"))


@_query(_TOOLS.replace("list_contains", "NOT list_contains"))
def assert_tool_not_called(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = plain_runs(spark, sf_dir).groupBy("case_source").agg(F.collect_set("tool").alias("tools"))
    return tools.select("case_source", grading.check("tool_not_called", F.lit(""), F.col("tools"), F.lit("error")).alias("holds"))


_ALL = (("contains", "THE"), ("not_contains", "und"), ("starts_with", "o"), ("ends_with", "."), ("tool_called", "Bash"), ("tool_not_called", "Write"))


@_query(
    """WITH m AS (SELECT doc_id, concat_ws('; ', CASE WHEN NOT contains(lower(text), 'the') THEN 'contains: expected response to contain ''THE''' END,
    CASE WHEN contains(lower(text), 'und') THEN 'not_contains: expected response NOT to contain ''und''' END,
    CASE WHEN NOT starts_with(lower(text), 'o') THEN 'starts_with: expected response to start with ''o''' END,
    CASE WHEN NOT ends_with(regexp_replace(text, '\\s+$', ''), '.') THEN 'ends_with: expected response to end with ''.''' END,
    CASE WHEN doc_id % 2 = 0 THEN 'tool_called: expected tool ''Bash'' to be called' END,
    CASE WHEN doc_id % 3 = 0 THEN 'tool_not_called: expected tool ''Write'' NOT to be called' END) AS s FROM documents)
    SELECT doc_id, s = '' AS passed, CASE WHEN s = '' THEN 'All assertions passed' ELSE s END AS reasoning FROM m"""
)
def assert_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    tools = F.array_compact(F.array(F.when(d % 2 == 1, "Bash"), F.when(d % 3 == 0, "Write")))
    asked = F.array(*[F.struct(F.lit(k).alias("type"), F.lit(v).alias("value")) for k, v in _ALL])
    rows = answers(spark, sf_dir).withColumn("tools", tools).withColumn("assertions", asked)
    return grading.grade(rows, python_regex=False).select("doc_id", F.col("judgment.pass").alias("passed"), F.col("judgment.reasoning").alias("reasoning"))


@_query("SELECT item_id, i::INTEGER AS iteration, 3::INTEGER AS total_iterations FROM benchmark, range(1, 4) t(i)")
def expand_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.expand(_table(spark, sf_dir, "benchmark").select("item_id"), 3)


_KEY = "replace('item-' || item_id || '.yaml', '.yaml', '') || '-' || substr(sha256(text), 1, 12)"


@_query(f"SELECT item_id, {_KEY} AS case_key FROM benchmark")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat(F.lit("item-"), "item_id", F.lit(".yaml"))
    return _table(spark, sf_dir, "benchmark").select("item_id", text.case_cache_key(source, F.col("text")).alias("case_key"))


def _cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _table(spark, sf_dir, "documents").select("doc_id"), _table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("passed"))


@_query("SELECT doc_id, quality = 1 AS passed, quality IS NOT NULL AS cached FROM documents LEFT JOIN labels USING (doc_id)")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.with_cache(*_cache(spark, sf_dir), keys=("doc_id",))


@_query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.not_cached(*_cache(spark, sf_dir), keys=("doc_id",))


@_query("SELECT o_custkey, substr(sha256(string_agg(o_orderkey || ':' || o_orderpriority, chr(10) ORDER BY CAST(o_orderkey AS VARCHAR))), 1, 12) AS dir_hash FROM orders GROUP BY 1")
def dir_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("rel"), F.col("o_orderpriority").alias("content"))
    return samples.directory_hash(files, "o_custkey")


@_query("SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 5")
def limit_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.limit_per_category(_table(spark, sf_dir, "documents").select("lang", "doc_id"), 5, "lang", "doc_id")


@_query("SELECT doc_id, lang AS domain FROM documents WHERE lang IN ('en', 'fr')")
def domain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.in_domains(_table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain")), ["en", "fr"])


@_query(f"WITH {RUNS} SELECT event_id, case_source FROM runs WHERE NOT passed")
def failures_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.failures(plain_runs(spark, sf_dir)).select("event_id", "case_source")


@_query(f"WITH {RUNS} SELECT event_id, case_source FROM runs WHERE NOT infra_failure")
def cacheable_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.cacheable(plain_runs(spark, sf_dir)).select("event_id", "case_source")


def _rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select(F.col("user_id").alias("run"), F.col("iteration").alias("round"), F.col("value").alias("pass_rate"))


@_query(f"WITH {RUNS} SELECT user_id AS run, arg_max(iteration, (value, iteration))::BIGINT AS best_round, max(value) AS best_rate FROM runs GROUP BY 1")
def best_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.best_round(_rounds(spark, sf_dir)).withColumn("best_round", F.col("best_round").cast("bigint"))


@_query(f"WITH {RUNS} SELECT user_id AS run, iteration::BIGINT AS round, value AS pass_rate, max(value) OVER w AS best_rate, (arg_max(iteration, (value, iteration)) OVER w)::BIGINT AS best_round FROM runs WINDOW w AS (PARTITION BY user_id ORDER BY iteration ROWS UNBOUNDED PRECEDING)")
def best_round_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.running_best(_rounds(spark, sf_dir)).withColumns({c: F.col(c).cast("bigint") for c in ("round", "best_round")})


@_query(f"WITH {RUNS} SELECT user_id AS run, (min(iteration) FILTER (value >= 60))::BIGINT AS stop_round FROM runs GROUP BY 1")
def first_target_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.first_at_target(_rounds(spark, sf_dir), 60.0).withColumn("stop_round", F.col("stop_round").cast("bigint"))


@_query(f"WITH {RUNS} SELECT user_id AS run, arg_min(value, iteration) AS baseline, max(value) AS best, round(max(value) - arg_min(value, iteration), 9) AS gain FROM runs GROUP BY 1")
def baseline_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.gain(_rounds(spark, sf_dir)).withColumn("gain", _round("gain"))


@_query(f"WITH {RUNS} SELECT event_id, NOT cached AND (value > max(CASE WHEN NOT cached THEN value END) OVER w OR max(CASE WHEN NOT cached THEN value END) OVER w IS NULL) AS is_best FROM runs WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def trial_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = _table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("trial"), F.col("value").alias("score"), (F.col("event_id") % 4 != 0).alias("is_full"))
    return rounds.mark_best_trials(trials).select(F.col("trial").alias("event_id"), "is_best")


@_query(f"WITH {RUNS} SELECT tool AS parameters, round(avg(value), 9) AS mean_score, count(*) AS n FROM runs GROUP BY 1")
def scores_by_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = _table(spark, sf_dir, "events").select(F.col("event_type").alias("parameters"), F.col("value").alias("score"))
    return rounds.mean_by_parameters(trials).withColumn("mean_score", _round("mean_score"))


@_query(f"WITH {RUNS} SELECT user_id AS run, iteration::BIGINT AS round FROM runs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY iteration DESC) <= 3")
def history_last_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.last_rounds(_rounds(spark, sf_dir), 3).select("run", F.col("round").cast("bigint"))


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _table(spark, sf_dir, "conversations").where("role = 'user'")
    listed = users.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda x: x["text"]).alias("prompt"))


@_query("SELECT conv_id, string_agg('Turn ' || n || ': ' || text, chr(10) ORDER BY n) AS prompt FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations WHERE role = 'user') GROUP BY 1")
def multi_turn_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir).select("conv_id", text.format_prompt(F.col("prompt")).alias("prompt"))


@_query("SELECT conv_id, arg_max(text, turn) AS answer, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def last_turn_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.array("role").alias("tool_calls"))
    return transcripts.whole_answers(turns, "conv_id").select("conv_id", F.col("text").alias("answer"), F.array_join("tool_calls", ",").alias("roles"))


@_query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS tools FROM events GROUP BY 1")
def tool_calls_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("turn"), F.lit("x").alias("text"), F.array("event_type").alias("tool_calls"))
    return transcripts.whole_answers(turns, "user_id").select("user_id", F.array_join("tool_calls", ",").alias("tools"))


@_query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_tool_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.try_variant_get(transcripts.decode(F.col("props")), "$.k", "string").alias("k"))


@_query(
    """SELECT user_id AS task_key, CASE WHEN t <> '' THEN t ELSE coalesce(r, '') END AS text, n AS n_tools, tools, s AS session_id FROM (SELECT user_id,
    coalesce(trim(string_agg('t' || event_id || ' ', '' ORDER BY event_id) FILTER (event_id % 6 = 0)), '') AS t, 'r' || max(event_id) FILTER (event_id % 6 = 3) AS r,
    count(*) FILTER (event_id % 6 = 1) AS n, coalesce(string_agg(event_type, ',' ORDER BY event_id) FILTER (event_id % 6 = 1), '') AS tools, 's' || max(event_id) FILTER (event_id % 6 = 2) AS s
    FROM events WHERE event_id % 6 < 4 GROUP BY 1)"""
)
def block_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = transcripts.block_stream(block_lines(spark, sf_dir))
    return turns.select("task_key", "text", F.size("tool_calls").cast("bigint").alias("n_tools"), F.array_join(F.transform("tool_calls", lambda t: t["name"]), ",").alias("tools"), "session_id")


@_query(
    """SELECT user_id AS task_key, coalesce('m' || max(event_id) FILTER (event_id % 5 = 0), '') AS text, 'h' || max(event_id) FILTER (event_id % 5 = 2) AS thread_id, 'f' || max(event_id) FILTER (event_id % 5 = 3) AS error,
    coalesce(string_agg('{"command": "c' || event_id || '"}', ',' ORDER BY event_id) FILTER (event_id % 5 = 1), '') AS inputs FROM events WHERE event_id % 5 < 4 GROUP BY 1"""
)
def item_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = transcripts.item_stream(item_lines(spark, sf_dir))
    return turns.select("task_key", "text", "thread_id", "error", F.array_join(F.transform("tool_calls", lambda t: t["input"]), ",").alias("inputs"))


_VERDICT = "concat('Here: ', CASE WHEN doc_id % 3 = 0 THEN '```json' || chr(10) ELSE '' END, '{\"', CASE WHEN doc_id % 2 = 0 THEN 'pass' ELSE 'passed' END, '\": ', CASE WHEN quality = 1 THEN 'true' ELSE 'false' END, ', \"reasoning\": \"d', doc_id, '\"}', CASE WHEN doc_id % 3 = 0 THEN chr(10) || '```' ELSE ' done' END)"


@_query("SELECT doc_id, quality = 1 AS passed, 'd' || doc_id AS reasoning FROM labels")
def verdict_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _table(spark, sf_dir, "labels").select("doc_id", F.expr(_VERDICT.replace("chr(10)", "'\\n'")).alias("answer"))
    return said.select("doc_id", verdicts.plain_verdict(F.col("answer")).alias("v")).select("doc_id", F.col("v.pass").alias("passed"), F.col("v.reasoning").alias("reasoning"))


@_query("SELECT doc_id, quality = 1 AS passed FROM labels")
def verdict_lax(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.format_string('verdict {"passed": "%s"}', F.when(F.col("quality") == 1, "Yes").otherwise("off"))
    return _table(spark, sf_dir, "labels").select("doc_id", verdicts.verdict(answer)["pass"].alias("passed"))


@_query("SELECT doc_id, len(regexp_extract_all(text, '[^\\s\\p{Z}]+')) AS words FROM documents")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


@_query("SELECT doc_id, left(text, 500) AS preview, left(text, 200) || '...' AS snippet FROM documents")
def truncate_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.truncate_response(F.col("text")).alias("preview"), text.snippet(F.col("text"), 200).alias("snippet"))


@_query("SELECT doc_id, coalesce(nullif(trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}\\p{M}_-]', '-', 'g'), '-+', '-', 'g'), '-'), ''), 'candidate-' || (doc_id + 1)) AS name FROM documents")
def name_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.name_part(F.col("text"), F.col("doc_id")).alias("name"))


@_query(f"WITH {RUNS}, g AS (SELECT case_source, 100.0 * count(*) FILTER (passed) / count(*) AS r FROM runs GROUP BY 1) SELECT case_source, CASE WHEN r >= 80 THEN 'green' WHEN r >= 50 THEN 'yellow' ELSE 'red' END AS colour FROM g")
def rate_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = plain_runs(spark, sf_dir).groupBy("case_source").agg(metrics.pass_rate(F.count_if("passed"), F.count("*")).alias("r"))
    return rate.select("case_source", metrics.rate_colour(F.col("r")).alias("colour"))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    state = F.when(F.col("event_id") % 4 == 0, "cached").when(F.col("event_id") % 7 == 0, "running").when(F.col("event_id") % 11 == 0, "pending").otherwise("done")
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("case_idx"), kind.alias("iteration"), state.alias("state"), (F.col("value") >= 20).alias("passed"), F.col("event_id").alias("seq"))


_STATES = "states AS (SELECT user_id AS case_idx, event_type AS iteration, event_id AS seq, CASE WHEN event_id % 4 = 0 THEN 'cached' WHEN event_id % 7 = 0 THEN 'running' WHEN event_id % 11 = 0 THEN 'pending' ELSE 'done' END AS state, value >= 20 AS passed FROM events), latest AS (SELECT case_idx, iteration, arg_max(state, seq) AS state, arg_max(passed, seq) AS passed FROM states GROUP BY 1, 2)"


@_query(f"WITH {_STATES} SELECT * FROM latest")
def status_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.latest_state(_states(spark, sf_dir))


@_query(f"WITH {_STATES} SELECT count(*) FILTER (state = 'done' AND passed) AS n_pass, count(*) FILTER (state = 'done' AND NOT passed) AS n_fail, count(*) FILTER (state = 'running') AS n_running, count(*) FILTER (state = 'cached') AS n_cached, count(*) FILTER (state = 'pending') AS n_pending FROM latest")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.state_counts(status.latest_state(_states(spark, sf_dir)))


@_query(f"WITH {_STATES}, g AS (SELECT case_idx, count(*) AS total, count(*) FILTER (state IN ('done', 'cached')) AS done, count(*) FILTER (state IN ('done', 'cached') AND passed) AS good FROM latest GROUP BY 1) SELECT case_idx, total, done, CASE WHEN done = total THEN round(100.0 * good / total, 9) END AS percent FROM g")
def eval_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.case_percent(status.latest_state(_states(spark, sf_dir)), final=False).withColumn("percent", _round("percent"))


@_query(f"WITH {_STATES} SELECT round(100.0 * count(*) FILTER (state = 'done' AND passed) / count(*) FILTER (state = 'done'), 9) AS percent FROM latest")
def compact_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.compact_percent(status.latest_state(_states(spark, sf_dir))).withColumn("percent", _round("percent"))


@_query("SELECT p_name AS source, 'setup' AS kind, p_brand AS script FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_name, 'teardown', p_type FROM part WHERE p_size % 3 = 0")
def scripts_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _table(spark, sf_dir, "part").select(F.col("p_name").alias("source"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("setup"), F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise("").alias("teardown"))
    return samples.scripts(cases)


@_query("SELECT doc_id, concat_ws(', ', CASE WHEN doc_id % 2 = 0 THEN 'expected' END, CASE WHEN doc_id % 3 = 0 THEN 'name' END, CASE WHEN doc_id % 5 = 0 THEN 'prompt' END, CASE WHEN doc_id % 7 = 0 THEN 'timestamp' END) AS missing FROM documents")
def required_fields_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array_compact(F.array(*[F.when(F.col("doc_id") % k != 0, name) for k, name in ((2, "expected"), (3, "name"), (5, "prompt"), (7, "timestamp"))], F.lit("extra")))
    return _table(spark, sf_dir, "documents").select("doc_id", samples.missing_fields(keys).alias("missing"))


@_query(f"WITH {SKILLS} SELECT doc_id, 'first,second' AS goals, 'never,ever' AS prohibitions FROM bodies")
def section_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills(spark, sf_dir).select("doc_id", F.array_join(text.section_items(F.col("body"), "Goals"), ",").alias("goals"), F.array_join(text.section_items(F.col("body"), "prohibitions"), ",").alias("prohibitions"))


@_query(f"WITH {SKILLS} SELECT doc_id, array_to_string(regexp_extract_all(body, '(?s)```\\w*\\n(.*?)```', 1), '|') AS examples FROM bodies")
def code_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills(spark, sf_dir).select("doc_id", F.array_join(text.code_examples(F.col("body")), "|").alias("examples"))


@_query(f"WITH {SKILLS} SELECT doc_id, name, description, length(body) AS body_chars FROM bodies")
def frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = lambda name: F.coalesce(F.col("fields")[name], F.lit("")).alias(name)
    return skills(spark, sf_dir).select("doc_id", field("name"), field("description"), F.length("body").cast("bigint").alias("body_chars"))


@_query("SELECT doc_id, 'Doc ' || doc_id || ' in ' || lang || ' costs $5, $unknown' AS prompt FROM documents")
def safe_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.template("Doc $doc_id in ${lang} costs $$5, $unknown", doc_id=F.col("doc_id"), lang=F.col("lang")).alias("prompt"))


@_query(f"WITH {RUNS}, a AS (SELECT case_source, 100.0 * count(*) FILTER (passed) / count(*) AS r FROM runs WHERE cached GROUP BY 1), b AS (SELECT case_source, 100.0 * count(*) FILTER (passed) / count(*) AS r FROM runs WHERE NOT cached GROUP BY 1) SELECT case_source, round(a.r, 9) AS base_rate, round(b.r, 9) AS other_rate, round(b.r - a.r, 9) AS delta FROM a FULL JOIN b USING (case_source)")
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plain_runs(spark, sf_dir)
    return samples.compare_runs(rows.where("cached"), rows.where("not cached")).withColumns({c: _round(c) for c in ("base_rate", "other_rate", "delta")})


@_query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE doc_id % 3 WHEN 0 THEN 'Skill' WHEN 1 THEN 'Skill,Bash' ELSE 'Bash,Skill' END ELSE CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Bash' ELSE 'Bash,Skill' END END AS tools FROM documents")
def tool_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    given = F.when(d % 3 == 1, F.array(F.lit("Bash"))).when(d % 3 == 2, F.array(F.lit("Bash"), F.lit("Skill")))
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(samples.allowed_tools(given, d % 2 == 0, ["Skill"]), ",").alias("tools"))


@_query("SELECT doc_id, CASE WHEN lang IN ('en') THEN 'functional' WHEN lang = 'de' THEN 'triggering' END AS domain FROM documents")
def domain_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("lang") == "en", "\t\u00a0Functional\n").when(F.col("lang") == "de", "TRIGGERING").otherwise("other")
    return _table(spark, sf_dir, "documents").select("doc_id", text.parse_domain(said).alias("domain"))


@_query("SELECT conv_id, arg_max(text, turn) AS prompt FROM conversations WHERE role = 'user' GROUP BY 1")
def last_user_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return turns.where(F.exists("m", lambda m: m["role"] == "user")).select("conv_id", text.last_user_prompt(F.col("m"), F.lit("")).alias("prompt"))


@_query("SELECT 10::BIGINT AS n_rows, 10::BIGINT AS n_items, 10::BIGINT AS n_known, 0 AS first_idx, 9 AS last_idx, count(*) AS n_all FROM benchmark")
def sample_evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 10 cases is 10 different known cases, numbered anew; a sample of 10**6 is all of them."""
    cases = _table(spark, sf_dir, "benchmark").select("item_id")
    few = samples.sample_cases(cases, 10, seed=7).join(cases.withColumn("known", F.lit(1)), "item_id", "left")
    counted = few.agg(F.count("*").alias("n_rows"), F.countDistinct("item_id").alias("n_items"), F.count("known").alias("n_known"), F.min("case_idx").alias("first_idx"), F.max("case_idx").alias("last_idx"))
    return counted.crossJoin(samples.sample_cases(cases, 10**6).agg(F.count("*").alias("n_all")))


_MIDDLE = """WITH d AS (SELECT doc_id, lower(text) AS t, doc_id % 2 = 1 AS bash FROM documents),
told AS (SELECT doc_id, [CASE WHEN NOT contains(t, 'the') THEN 'contains: expected response to contain ' || chr(39) || 'the' || chr(39) END,
    CASE WHEN NOT regexp_matches(t, 'w[aeiou]+t') THEN 'regex: pattern ' || chr(39) || '(?i)w[aeiou]+t' || chr(39) || ' did not match' END,
    CASE WHEN NOT bash THEN 'tool_called: expected tool ' || chr(39) || 'Bash' || chr(39) || ' to be called' END] AS m FROM d)
SELECT doc_id, array_to_string(list_filter(m, lambda x: x IS NOT NULL), '; ') AS told FROM told"""


@_query(_MIDDLE)
def assert_all_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions of which a regular expression is in the middle: failures are told in their order."""
    asked = F.array(*[F.struct(F.lit(k).alias("type"), F.lit(v).alias("value")) for k, v in (("contains", "the"), ("regex", "(?i)w[aeiou]+t"), ("tool_called", "Bash"))])
    rows = answers(spark, sf_dir).withColumn("tools", F.array_compact(F.array(F.when(F.col("doc_id") % 2 == 1, "Bash")))).withColumn("assertions", asked)
    return grading.grade(rows).select("doc_id", F.when(F.col("judgment.pass"), "").otherwise(F.col("judgment.reasoning")).alias("told"))


@_query(f"WITH {RUNS} SELECT count(DISTINCT case_source) AS n_cases, count(DISTINCT case_source) FILTER (NOT passed) AS n_failing, sum(CASE WHEN cached THEN 0 ELSE 1 END)::BIGINT AS n_calls, avg(passed::INT) AS score FROM runs")
def case_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.case_totals(plain_runs(spark, sf_dir))


@_query("SELECT doc_id, array_to_string((string_split(text, chr(10)))[1:10], '|') AS head, greatest(len(string_split(text, chr(10))) - 10, 0)::BIGINT AS n_more FROM documents")
def script_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    head, more = text.first_lines(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(head, "|").alias("head"), more.cast("bigint").alias("n_more"))


@_query("SELECT page_id, list_last(string_split(rtrim(url, '/'), '/')) AS name, array_to_string(list_transform(string_split(replace(url, '/', ' , '), ','), lambda x: trim(x)), '|') AS parts FROM pages")
def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return pages.select("page_id", text.last_part(F.col("url")).alias("name"), F.array_join(text.comma_list(F.replace("url", F.lit("/"), F.lit(" , "))), "|").alias("parts"))


_JUDGED = "CASE WHEN event_id % 5 = 0 THEN '(no tools used)' ELSE '- ' || event_type || ': ' || CASE WHEN event_id % 5 = 1 THEN '{}' ELSE '{' || chr(10) || '  \"k\": ' || json_extract_string(props, '$.k') || chr(10) || '}' END END"


@_query(
    f"""SELECT event_id, 'Decide whether the response meets the expectation.' || chr(10) || chr(10) || 'Prompt:' || chr(10) || CASE WHEN event_id % 2 = 0 THEN 'Turn 1: a' || chr(10) || 'Turn 2: b' ELSE 'a' END || chr(10) || chr(10)
    || 'Response:' || chr(10) || 'r' || event_id || chr(10) || chr(10) || 'Tools used:' || chr(10) || {_JUDGED} || chr(10) || chr(10) || 'Expected:' || chr(10) || event_type || chr(10) || chr(10)
    || 'Answer with a JSON object {{"pass": true or false, "reasoning": text}}.' AS judge_prompt FROM events"""
)
def judge_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    call = F.struct(F.col("event_type").alias("name"), F.when(e % 5 != 1, F.col("props")).alias("input"))
    rows = _table(spark, sf_dir, "events").select(
        "event_id",
        F.array(F.lit("a"), F.lit("b")).alias("prompt"),
        (e % 2 == 0).alias("prompt_is_list"),
        F.concat(F.lit("r"), e).alias("response"),
        F.when(e % 5 == 0, F.array().cast("array<struct<name:string,input:string>>")).otherwise(F.array(call)).alias("tool_calls"),
        F.col("event_type").alias("expected"),
    )
    return runners.judge_prompt(rows).select("event_id", "judge_prompt")


@_query("SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) - 1 AS number FROM events")
def global_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.numbered(_table(spark, sf_dir, "events").select("event_id", "value"), F.desc("value"), "event_id").select("event_id", "number")


@_query(f"WITH {RUNS} SELECT case_source, row_number() OVER (ORDER BY min(event_id)) - 1 AS case_order, count(*) AS n, count(*) FILTER (passed) AS c FROM runs GROUP BY 1")
def per_case_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.per_case_in_order(plain_runs(spark, sf_dir), K, "event_id").select("case_source", "case_order", "n", "c")


@_query("SELECT doc_id, quality = 1 AS passed, CASE WHEN quality IS NOT NULL THEN 'q' || quality END AS response, quality IS NOT NULL AS cached FROM documents LEFT JOIN labels USING (doc_id)")
def stored_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels recorded in a store, all documents looked up in it."""
    store = ResultStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", buckets=8)
    judged = F.struct((F.col("quality") == 1).alias("pass"), F.lit("").alias("reasoning"))
    calls = F.array().cast("array<struct<name:string,input:string>>").alias("tool_calls")
    names = [F.lit("s").alias("set_name"), F.lit("a").alias("agent"), F.lit("b").alias("skill_key")]
    key = F.col("doc_id").cast("string").alias("case_key")
    store.record(_table(spark, sf_dir, "labels").select(*names, key, F.lit(1).alias("iteration"), F.concat(F.lit("q"), "quality").alias("response"), calls, judged.alias("judgment"), F.lit(False).alias("infra_failure")))
    tasks = _table(spark, sf_dir, "documents").select("doc_id", key, F.lit(1).alias("iteration"))
    return store.look_up(tasks, "s", "a", "b").select("doc_id", F.col("judgment.pass").alias("passed"), "response", "cached")


_SCHEMA = {
    "type": "object",
    "required": ["kind", "who", "tags"],
    "properties": {
        "kind": {"enum": ["click", "view", "purchase"]},
        "who": {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer", "minimum": 10}}},
        "tags": {"type": "array", "maxItems": 2, "items": {"type": "string", "maxLength": 6}},
    },
}


@_query(
    """WITH bad AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN ['$ is not JSON'] ELSE
    list_concat(CASE WHEN event_id % 3 = 0 THEN ['$ has no who'] ELSE [] END, CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN ['$.kind is not one of "click", "view", "purchase"'] ELSE [] END,
    CASE WHEN event_id % 3 = 1 AND user_id < 10 THEN ['$.who.id is less than 10'] WHEN event_id % 3 = 2 THEN ['$.who has no id'] ELSE [] END,
    CASE WHEN length(event_type) > 6 THEN ['$.tags[1] is longer than 6'] ELSE [] END) END AS p FROM events)
    SELECT event_id, array_to_string(p, '; ') AS problems, len(p) = 0 AS valid FROM bad"""
)
def schema_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as JSON in prose, checked by a schema with nested required fields, an enum and bounds."""
    e = F.col("event_id")
    who = F.when(e % 3 == 1, F.concat(F.lit(',"who":{"id":'), "user_id", F.lit("}"))).when(e % 3 == 2, F.lit(',"who":{}')).otherwise("")
    answer = F.concat(F.lit('Here: {"kind":"'), "event_type", F.lit('"'), who, F.lit(',"tags":["a","'), "event_type", F.lit('"]} - done'))
    rows = _table(spark, sf_dir, "events").select("event_id", F.when(e % 7 == 0, F.lit("none")).otherwise(answer).alias("answer"))
    wrong = schema.problems(text.json_in_prose(F.col("answer")), _SCHEMA)
    return rows.select("event_id", wrong.alias("p")).select("event_id", F.array_join("p", "; ").alias("problems"), (F.size("p") == 0).alias("valid"))


@_query(
    """WITH placed AS (SELECT event_type AS parameters, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS place FROM events)
    SELECT parameters, CAST(place // 100 AS BIGINT) AS chunk, count(*) AS n, sha256(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id)) AS trials, arg_min(value, event_id) AS first_score, arg_max(value, event_id) AS last_score
    FROM placed GROUP BY ALL"""
)
def score_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = _table(spark, sf_dir, "events").select(F.col("event_type").alias("parameters"), F.col("event_id").alias("trial"), F.col("value").alias("score"))
    lists = rounds.score_lists(trials, 100)
    told = F.sha2(F.array_join(F.col("trials").cast("array<string>"), ","), 256)
    return lists.select("parameters", "chunk", F.size("trials").cast("bigint").alias("n"), told.alias("trials"), F.col("scores")[0].alias("first_score"), F.element_at("scores", -1).alias("last_score"))


@_query(f"WITH found AS ({_lint_sql()}) SELECT path, count(*) AS n_findings, count(*) FILTER (severity = 'error') AS n_errors, count(*) FILTER (severity = 'warning') AS n_warnings FROM found GROUP BY 1")
def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.finding_counts(lint.lint(skills(spark, sf_dir)), "path")


@_query("SELECT * FROM (SELECT 'setup' AS kind, count(*) AS n_scripts, count(DISTINCT doc_id) AS n_cases FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'teardown', count(*), count(DISTINCT doc_id) FROM documents WHERE doc_id % 3 = 0)")
def script_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    cases = _table(spark, sf_dir, "documents").select(d.cast("string").alias("source"), F.when(d % 2 == 0, "x").otherwise("").alias("setup"), F.when(d % 3 == 0, "y").alias("teardown"))
    return samples.script_counts(cases)


@_query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || '-' || doc_id ELSE 'sets/' || lang || '/' || source || '-' || doc_id END AS cache_name FROM documents")
def cache_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    name = F.concat(F.lit("sets/"), "lang", F.lit("/"), "source", F.lit("-"), "doc_id", F.when(F.col("doc_id") % 4 == 0, "/").otherwise(""))
    return docs.select("doc_id", text.cache_name(name, F.col("doc_id") % 2 == 0).alias("cache_name"))


@_query(
    f"""WITH {_STATES}, marked AS (SELECT *, CASE WHEN state = 'done' THEN CASE WHEN passed THEN '✓' ELSE '✗' END WHEN state = 'cached' THEN '●' WHEN state = 'running' THEN '◐' WHEN state = 'pending' THEN '○' ELSE '?' END AS s FROM latest)
    SELECT CAST(row_number() OVER (ORDER BY case_idx) AS BIGINT) AS line, case_idx, string_agg(s, ' ' ORDER BY iteration) AS symbols,
    CASE WHEN count(*) FILTER (state IN ('done', 'cached')) = count(*) THEN round(count(*) FILTER (state IN ('done', 'cached') AND passed) * 100.0 / count(*), 9) END AS percent FROM marked GROUP BY case_idx"""
)
def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.report(status.latest_state(_states(spark, sf_dir))).withColumn("percent", _round("percent"))


def queries() -> dict:
    out = dict(_QUERIES)
    for rule in dict.fromkeys(name.strip() for name in _LINT):
        out[f"lint_{rule.replace('-', '_')}"] = _lint_query(rule)
    out["lint_all"] = _lint_query(None)
    return out


def oracle_sql() -> dict[str, str]:
    out = dict(_SQL)
    for rule in dict.fromkeys(name.strip() for name in _LINT):
        out[f"lint_{rule.replace('-', '_')}"] = _lint_sql(rule)
    out["lint_all"] = _lint_sql()
    return out
