"""URL filters: a list of rules first, and for the rest what combinations of URL tokens say by association rules.

A listed rule (host, path, verdict) fits its host and all subdomains of it, where the URL's path starts with the rule's; the longest rule wins.
URLs that a rule judges are labelled examples. FP-growth mines the token combinations that are frequent among them; a combination whose
examples mostly have one verdict becomes a rule, pruned by support and confidence. Mined rules are kept in an inverted index under their rarest
token, so a URL looks up its own tokens, checks the rest of each rule found, and follows the surest one.

Tokens are words of the host (``h:``), the path (``p:``), the scheme (``s:``) and the rest (``q:``). Tokens that stand in exactly the same examples
are one token, named by the smallest: parameters that only occur together would make every subset of them a combination.

Only distinct URLs are judged; whole rows and other columns never move. Rules are broadcast behind a check of their number, as is the index.

Defined cases: the host of a null URL, and of one without ``://``, is empty, as is its path; no listed rule fits it. Equal rules count once, of rules of
one length the smaller (host, path) wins, and where one rule is listed with both verdicts ``block`` does. Where no mined rule fits, the verdict is
``DEFAULT``; with no examples nothing is mined. Repeated rows and rows without page_id are judged as any other. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.llm._shared import written

#: share of the labelled URLs that a rule's tokens and its verdict must be found in, and share of its URLs that have the verdict
SUPPORT, CONFIDENCE = 0.02, 0.75
DEFAULT = "allow"
#: rules that are sent to every executor; more of them are joined by a shuffle
BROADCAST_RULES = 20_000

_TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_VERDICT = "verdict="


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL, each with the part it is in."""
    low = F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER)
    parts = {"s:": r"^((?s:.*?))://", "h:": r"^(?s:.*?)://([^/?#]*)", "p:": r"^(?s:.*?)://[^/?#]*([^?#]*)", "q:": r"^(?s:.*?)://[^?#]*((?s:.*))$"}

    def words(prefix: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.regexp_extract(low, pattern, 1), F.lit(_TOKEN), F.lit(0)), lambda w: F.concat(F.lit(prefix), w))

    return F.array_distinct(F.concat(*[words(*x) for x in parts.items()]))


def _small(rules: DataFrame) -> DataFrame:
    """``rules`` with a hint to broadcast them if they are few."""
    return F.broadcast(rules) if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else rules


def listed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``urls`` (url) that a rule of ``rules`` (host, path, verdict) fits: (url, rule, verdict)."""
    depth = rules.agg(F.max(F.size(F.split("host", "[.]")))).first()[0] or 0
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    labels = F.split("host", "[.]", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(depth, 1)))), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    asked = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("of_url")).where(F.col("host") != "")
    fits = asked.select("url", "of_url", F.explode(suffixes).alias("host")).join(_small(rules), "host").where(F.startswith("of_url", "path"))
    longest = F.struct((-F.length("host") - F.length("path")).alias("l"), F.col("host").alias("h"), F.col("path").alias("p"), F.col("verdict").alias("v"))
    best = fits.groupBy("url").agg(F.min(longest).alias("r"))
    return best.select("url", F.concat("r.h", "r.p").alias("rule"), F.col("r.v").alias("verdict"))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (tokens, verdict, confidence, n, token) from ``labelled`` distinct URLs (url, verdict); ``token`` is the rarest of a rule's tokens.

    n counts the examples that have all tokens and the verdict. A rule has at least one token, n >= support * examples, and confidence as asked for.
    """
    spark = labelled.sparkSession
    empty = spark.range(0).select(F.array(F.lit("")).alias("tokens"), F.lit("").alias("verdict"), F.lit(0.0).alias("confidence"), F.lit(0).cast("bigint").alias("n"), F.lit("").alias("token"))
    examples = written(labelled.select("url", "verdict", tokens_of(F.col("url")).alias("tokens")), "url-examples")
    n = examples.count()
    if not n:
        return empty
    least = -int(-support * n // 1)
    each = examples.select("tokens", F.xxhash64("url").alias("x"), F.xxhash64("url", F.lit(1)).alias("y")).select(F.explode("tokens").alias("token"), "x", "y")
    counts = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where(F.col("n") >= least)
    kept = counts.groupBy("n", "x", "y").agg(F.min("token").alias("token")).select("token", "n")
    kept = written(kept, "url-tokens")  # at most tokens of a URL / support of them, whatever the input
    names = [r["token"] for r in kept.select("token").collect()]
    if not names:
        return empty
    items = examples.select(F.array_append(F.filter("tokens", lambda t: t.isin(names)), F.concat(F.lit(_VERDICT), "verdict")).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items).associationRules
    rules = found.where(F.startswith(F.col("consequent")[0], F.lit(_VERDICT)) & ~F.exists("antecedent", lambda t: F.startswith(t, F.lit(_VERDICT))))
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], len(_VERDICT) + 1, 1 << 30).alias("verdict"), "confidence", F.round(F.col("support") * n).cast("bigint").alias("n"))
    # under its rarest token a rule is looked up least often
    rules = rules.withColumn("_id", F.struct("tokens", "verdict"))
    rarest = rules.select("_id", F.explode("tokens").alias("token")).join(kept.withColumnRenamed("n", "of_token"), "token").groupBy("_id").agg(F.min(F.struct("of_token", "token")).alias("k"))
    return written(rules.join(rarest, "_id").select("tokens", "verdict", "confidence", "n", F.col("k.token").alias("token")), "url-rules")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``urls`` that a mined rule fits, with the verdict of the surest, then most frequent, then shortest: (url, verdict, tokens, confidence)."""
    known = [r["t"] for r in rules.select(F.explode("tokens").alias("t")).distinct().collect()]  # some of the tokens that ``mine`` keeps
    own = urls.select("url", F.filter(tokens_of(F.col("url")), lambda t: t.isin(known)).alias("own"))
    asked = own.select("url", "own", F.explode("own").alias("token")).join(_small(rules), "token").where(F.size(F.array_except("tokens", "own")) == 0)
    surest = F.struct((-F.col("confidence")).alias("c"), (-F.col("n")).alias("n"), F.size("tokens").alias("size"), F.col("tokens").alias("tokens"), F.col("verdict").alias("verdict"))
    return asked.groupBy("url").agg(F.min(surest).alias("r")).select("url", F.col("r.verdict").alias("verdict"), F.col("r.tokens").alias("tokens"), (-F.col("r.c")).alias("confidence"))


def judge(pages: DataFrame, rules: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, tokens, confidence) of every row of ``pages``; tokens and confidence are those of a mined rule."""
    urls = pages.select("url").where("url IS NOT NULL").distinct()
    by_list = written(listed(urls, rules), "url-listed")
    mined = mine(by_list.select("url", "verdict"), support, confidence)
    rest = urls.join(by_list, "url", "left_anti")
    nothing = F.lit(None)
    judged = by_list.select("url", "rule", "verdict", nothing.cast("array<string>").alias("tokens"), nothing.cast("double").alias("confidence")).unionByName(
        matched(rest, mined).select("url", nothing.cast("string").alias("rule"), "verdict", "tokens", "confidence")
    )
    out = pages.select("page_id", "url").join(judged, "url", "left")
    return out.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", F.coalesce("verdict", F.lit(DEFAULT)).alias("verdict"), "tokens", "confidence")


#: the rules of the registered query: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def rule_table(spark, rules=RULES) -> DataFrame:
    """A list of rules as the table that ``judge`` takes."""
    listed_rules = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    return spark.range(1).select(F.inline(listed_rules))


_LOW = f"translate(url, '{_UPPER}', '{_LOWER}')"
_SQL_TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _sql_words(prefix: str, pattern: str) -> str:
    return f"list_transform(regexp_extract_all(regexp_extract({_LOW}, '{pattern}', 1), '{_SQL_TOKEN}'), lambda w: '{prefix}' || w)"


_SQL_TOKENS = "list_distinct(list_concat(" + ", ".join(_sql_words(*x) for x in (("s:", "^((?s:.*?))://"), ("h:", "^(?s:.*?)://([^/?#]*)"), ("p:", "^(?s:.*?)://[^/?#]*([^?#]*)"), ("q:", "^(?s:.*?)://[^?#]*((?s:.*))$"))) + "))"
_SQL_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
SQL = rf"""
WITH RECURSIVE rules(h, p, v) AS (VALUES {_SQL_RULES}),
urls AS (SELECT DISTINCT url, {_SQL_TOKENS} AS tokens, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages WHERE url IS NOT NULL),
fits AS (SELECT url, tokens, h || p AS rule, v AS verdict, row_number() OVER (PARTITION BY url ORDER BY length(h) + length(p) DESC, h, p) AS place
    FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) WHERE host <> ''),
labelled AS (SELECT * FROM fits WHERE place = 1),
least AS (SELECT ceil({SUPPORT} * count(*)) AS least FROM labelled),
counts AS (SELECT token, count(*) AS n, list(url ORDER BY url) AS stands FROM (SELECT url, unnest(tokens) AS token FROM labelled) GROUP BY 1 HAVING count(*) >= (SELECT least FROM least)),
kept AS (SELECT min(token) AS token FROM counts GROUP BY stands),
owned AS (SELECT l.url, l.verdict, list(k.token ORDER BY k.token) AS items FROM (SELECT url, verdict, unnest(tokens) AS token FROM labelled) l JOIN kept k USING (token) GROUP BY 1, 2),
sets(url, verdict, items, chosen, place) AS (SELECT url, verdict, items, []::VARCHAR[], 0 FROM owned
    UNION ALL SELECT url, verdict, items, list_append(chosen, items[i]), i FROM (SELECT *, unnest(range(place + 1, len(items) + 1)) AS i FROM sets)),
verdicts AS (SELECT chosen, verdict, count(*) AS n FROM sets WHERE len(chosen) > 0 GROUP BY 1, 2),
mined AS (SELECT chosen, verdict, n, n / sum(n) OVER (PARTITION BY chosen) AS confidence FROM verdicts),
used AS (SELECT * FROM mined WHERE n >= (SELECT least FROM least) AND confidence >= {CONFIDENCE}),
matches AS (SELECT url, verdict, row_number() OVER (PARTITION BY url ORDER BY confidence DESC, n DESC, len(chosen), chosen, verdict) AS place
    FROM urls JOIN used ON list_has_all(tokens, chosen) WHERE url NOT IN (SELECT url FROM labelled))
SELECT page_id, translate(regexp_extract(coalesce(p.url, ''), '^(?s:.*?)://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(p.url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path,
    rule, coalesce(l.verdict, m.verdict, '{DEFAULT}') AS verdict
FROM pages p LEFT JOIN labelled l ON p.url = l.url LEFT JOIN matches m ON p.url = m.url AND m.place = 1"""
