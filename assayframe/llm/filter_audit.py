"""Filter interaction audit: what each filter of a corpus removes in every order that the filters can be applied in.

A document is a set of filters that it fails, so a corpus is at most 2**k counts for each part of it. An order of the k filters is a path
through the lattice of their subsets, from no filter to all of them; the edge from subset S to S with filter f removes the documents that
fail f and nothing in S. Forward counts say how many orders reach a state, backward counts how many lead on from it to the end; their
product over an edge's ends is the number of orders that take this edge, so removals weighted with it add up to a filter's Shapley sum over
all orders. The steps of one order are read from the same edges.

Only the counts are shuffled, combined in each task first; a hot part or text adds to few rows. Texts never leave their task: a copy is told
by a 256-bit digest of its text.

Defined cases: a null text is empty, a null part is the empty string. A document without id is no smaller than any and has no smaller one, so
it is never a copy and makes none; rows that repeat an id are rows of their own, and neither is a copy of the other. Labels of an id that stands
in several rows of ``labels`` hold if one of them says so; null and missing labels say nothing. An empty table has no parts. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD_BREAKS = r"[\x20\x09-\x0D]+"
#: filters that are counted at most: 2**8 states and 8! orders
MOST = 8
FILTERS = ("A", "B", "C", "D", "E")


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions that need one text: few words, repeated words, many capitals, markup signs."""
    words = F.array_remove(F.split(text, WORD_BREAKS), "")
    n = F.size(words)
    return {
        "A": n < 200,
        "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(50) * n,
        "C": F.lit(100) * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > F.lit(2) * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_counts(docs: DataFrame, labels: DataFrame | None = None, part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters A to E that they fail, filter number i being bit 2**i."""
    text = F.coalesce(F.col("text"), F.lit(""))
    mask = sum((F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(text_failures(F.col("t")).values())), F.lit(0))
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), text.alias("t"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), mask.alias("mask"))
    if labels is not None:
        known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
        rows = rows.join(known, "doc_id", "left")
    else:
        rows = rows.withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    kind = ["digest", "mask", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")]
    # rows of one id first, then of one text: at most a few for each part, however many copies there are
    by_id = rows.groupBy("doc_id", *kind).agg(F.count("*").alias("c"))
    kinds = by_id.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("c").alias("n"), F.min("doc_id").alias("first"), F.min_by("c", "doc_id").alias("n_first"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("c"))), F.lit(0)).alias("n_null")
    )
    smallest = F.min("first").over(Window.partitionBy("digest"))
    originals = F.col("n_null") + F.when(F.col("first") == F.col("smallest"), F.col("n_first")).otherwise(0)
    split = kinds.withColumn("smallest", smallest).withColumn("originals", originals)
    both = F.explode(F.array(F.struct(F.col("mask"), F.col("originals").alias("n")), F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - F.col("originals")).alias("n"))))
    parts = split.select("part", "good", "toxic", both.alias("x")).select("part", "good", "toxic", "x.*")
    return parts.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("good"), F.col("n"))), F.lit(0)).alias("good"), F.coalesce(F.sum(F.when(F.col("toxic"), F.col("n"))), F.lit(0)).alias("toxic")).where("n > 0")


def lattice_edges(k: int) -> list[tuple[int, int, int]]:
    """(state, filter, number of orders through it) of every edge, by counting paths from no filter forward and from all filters backward."""
    full = (1 << k) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for state in range(full + 1):  # a state's predecessors have smaller numbers
        for f in range(k):
            if not state >> f & 1:
                reach[state | 1 << f] += reach[state]
    for state in range(full, -1, -1):
        leave[state] += sum(leave[state | 1 << f] for f in range(k) if not state >> f & 1)
    return [(s, f, reach[s] * leave[s | 1 << f]) for s in range(full + 1) for f in range(k) if not s >> f & 1]


def audit(counts: DataFrame, filters: tuple[str, ...] = FILTERS) -> DataFrame:
    """Every step of every order of the filters, for every part of ``counts`` (part, mask, n, good, toxic).

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley); a part is one row until its orders
    are listed, so the only shuffle is that of its at most 2**k counts.
    """
    k = len(filters)
    if not 0 < k <= MOST:
        raise ValueError(f"an audit takes 1 to {MOST} filters")
    zero = F.lit(0).cast("bigint")
    counted = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("counted"))  # at most 2**k entries
    by_mask = F.sequence(F.lit(0), F.lit((1 << k) - 1))

    def vector(column: str) -> Column:
        """Counts by mask, missing ones 0."""
        return F.transform(by_mask, lambda m: F.coalesce(F.col("counted")[m][column], zero)).alias(column)

    rows = counted.select("part", *map(vector, ("n", "good", "toxic")))

    def total(column: str, keep) -> Column:
        """The sum of those counts whose mask is kept."""
        return F.aggregate(F.filter(column, lambda x, m: keep(m)), zero, lambda sum_, x: sum_ + x)

    def passed(m: Column, state: Column) -> Column:
        return m.bitwiseAND(state) == 0

    # edges, at place state * k + filter; those from a state that has the filter stand for nothing and carry no order
    orders = {(s, f): n for s, f, n in lattice_edges(k)}
    drawn = F.expr("array(" + ", ".join(f"named_struct('state', {s}, 'bit', {1 << f}, 'orders', {orders.get((s, f), 0)}L)" for s in range(1 << k) for f in range(k)) + ")")

    def removed(e: Column, column: str) -> Column:
        return total(column, lambda m: passed(m, e["state"]) & ~passed(m, e["bit"])).alias(column)

    def failing(f: int) -> Column:
        return total("n", lambda m: ~passed(m, F.lit(1 << f)))

    def shapley(f: int) -> Column:
        return F.aggregate(F.filter("edges", lambda e: e["bit"] == 1 << f), zero, lambda sum_, e: sum_ + e["weighed"])

    rows = rows.withColumn("edges", F.transform(drawn, lambda e: F.struct(e["bit"].alias("bit"), (e["orders"] * removed(e, "n")).alias("weighed"), *[removed(e, c) for c in ("n", "good", "toxic")])))
    rows = rows.withColumns(
        {
            "survivors": F.transform(by_mask, lambda state: total("n", lambda m: passed(m, state))),
            "failing": F.array(*map(failing, range(k))),
            "shapley": F.array(*map(shapley, range(k))),
            "path": F.array().cast("array<int>"),
        }
    )
    for _ in filters:  # every order, grown by a filter at a time
        rows = rows.withColumn("path", F.explode(F.transform(F.array_except(F.array(*map(F.lit, range(k))), "path"), lambda f: F.array_append("path", f))))
    rows = rows.select("*", F.posexplode("path").alias("place", "f"))
    before = F.aggregate(F.slice("path", F.lit(1), F.col("place")), F.lit(0), lambda state, f: state.bitwiseOR(F.element_at(F.array(*[F.lit(1 << g) for g in range(k)]), f + 1)))
    rows = rows.withColumn("before", before).withColumn("edge", F.col("edges")[F.col("before") * k + F.col("f")])
    bit = F.col("edge")["bit"]
    return rows.select(
        "part",
        F.array_join(F.transform("path", lambda f: F.element_at(F.array(*map(F.lit, filters)), f + 1)), "").alias("filter_order"),
        (F.col("place") + 1).alias("step"),
        F.col("survivors")[F.col("before").bitwiseOR(bit)].alias("kept"),
        F.col("edge")["n"].alias("removed"),
        (F.col("failing")[F.col("f")] - F.col("edge")["n"]).alias("redundant"),
        F.col("n")[bit].alias("unique_fails"),
        F.col("edge")["good"].alias("good_lost"),
        F.col("edge")["toxic"].alias("toxic_lost"),
        F.col("shapley")[F.col("f")].alias("shapley"),
    )


SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS original FROM docs),
failed AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(s.doc_id > original, false) AS e
    FROM split s LEFT JOIN known USING (doc_id)),
masks AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY 1, 2),
parts AS (SELECT DISTINCT part FROM masks),
letters AS (SELECT unnest(range(5)) AS f),
orders AS (SELECT v.f AS f1, w.f AS f2, x.f AS f3, y.f AS f4, z.f AS f5 FROM letters v, letters w, letters x, letters y, letters z
    WHERE len(list_distinct([v.f, w.f, x.f, y.f, z.f])) = 5),
steps AS (SELECT array_to_string(list_transform(o, lambda f: chr(CAST(65 + f AS INTEGER))), '') AS filter_order, CAST(step AS INTEGER) AS step, o[step] AS f,
    CAST(coalesce(list_sum(list_transform(o[:step - 1], lambda f: 1 << CAST(f AS INTEGER))), 0) AS INTEGER) AS before
    FROM (SELECT [f1, f2, f3, f4, f5] AS o, unnest(range(1, 6)) AS step FROM orders)),
told AS (SELECT p.part, filter_order, step, f,
    coalesce(sum(n) FILTER (mask & (before | (1 << CAST(f AS INTEGER))) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & (1 << CAST(f AS INTEGER)) <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & before <> 0 AND mask & (1 << CAST(f AS INTEGER)) <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = 1 << CAST(f AS INTEGER)), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & (1 << CAST(f AS INTEGER)) <> 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & (1 << CAST(f AS INTEGER)) <> 0), 0) AS toxic_lost
    FROM parts p JOIN masks m USING (part), steps GROUP BY 1, 2, 3, 4, before)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM told"""
