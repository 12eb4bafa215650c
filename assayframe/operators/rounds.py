"""Rounds of an improvement loop: (run, round, pass_rate, skill) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayframe.operators.numbering import numbered


def best_round(rounds: DataFrame) -> DataFrame:
    """The round with the highest rate of each run, the latest of equals."""
    return rounds.groupBy("run").agg(F.max_by(F.struct("round", "pass_rate"), F.struct("pass_rate", "round")).alias("b")).select("run", F.col("b.round").alias("best_round"), F.col("b.pass_rate").alias("best_rate"))


def running_best(rounds: DataFrame) -> DataFrame:
    """The best round so far at each round, the latest of equals."""
    so_far = Window.partitionBy("run").orderBy("round").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rounds.select("run", "round", "pass_rate", F.max("pass_rate").over(so_far).alias("best_rate"), F.max_by("round", F.struct("pass_rate", "round")).over(so_far).alias("best_round"))


def first_at_target(rounds: DataFrame, target: float) -> DataFrame:
    """The first round of each run that reaches the target, null if none does."""
    return rounds.groupBy("run").agg(F.min(F.when(F.col("pass_rate") >= target, F.col("round"))).alias("stop_round"))


def gain(rounds: DataFrame) -> DataFrame:
    """First and best rate of each run, and the gain."""
    both = rounds.groupBy("run").agg(F.min_by("pass_rate", "round").alias("baseline"), F.max("pass_rate").alias("best"))
    return both.withColumn("gain", F.col("best") - F.col("baseline"))


def mark_best_trials(trials: DataFrame) -> DataFrame:
    """is_best: a full trial that beats every full trial before it; partial trials never do."""
    before = Window.partitionBy("run").orderBy("trial").rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(F.when(F.col("is_full"), F.col("score"))).over(before)
    return trials.withColumn("is_best", F.col("is_full") & (best.isNull() | (F.col("score") > best)))


def mean_by_parameters(trials: DataFrame) -> DataFrame:
    return trials.groupBy("parameters").agg(F.avg("score").alias("mean_score"), F.count("*").alias("n"))


#: scores in one row of a list: half a megabyte
CHUNK = 1 << 16


def score_lists(trials: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """All scores of each combination of parameters in order of their trials, in rows of at most ``chunk``: (parameters, chunk, trials, scores).

    Trials are dealt by ranges of (parameters, trial), so a combination with very many of them is spread over tasks, and no row grows with it.
    """
    placed = numbered(trials.select("parameters", "trial", "score"), "parameters", "trial", name="_at")
    first = placed.groupBy(F.col("parameters").alias("_of")).agg(F.min("_at").alias("_first"))
    at = placed.join(first, F.col("parameters").eqNullSafe(F.col("_of"))).select("parameters", "trial", "score", F.floor((F.col("_at") - F.col("_first")) / chunk).alias("chunk"))
    lists = at.groupBy("parameters", "chunk").agg(F.array_sort(F.collect_list(F.struct("trial", "score"))).alias("l"))
    return lists.select("parameters", "chunk", F.col("l.trial").alias("trials"), F.col("l.score").alias("scores"))


def last_rounds(rounds: DataFrame, n: int) -> DataFrame:
    """The last n rounds of each run."""
    place = Window.partitionBy("run").orderBy(F.desc("round"))
    return rounds.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= n).drop("_n")
