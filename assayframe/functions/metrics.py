"""Success metrics over n samples with c passes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _share(top: Column, n: Column, k: Column) -> Column:
    """C(top, k) / C(n, k) as a product of k quotients, 1 for k = 0."""
    steps = F.when(k > 0, F.sequence(F.lit(0).cast("bigint"), k.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.lit(1.0), lambda acc, i: acc * (F.greatest(top - i, F.lit(0)).cast("double") / (n - i).cast("double")))


def _column(x: Column | str | int) -> Column:
    return F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x


def pass_at_k(n: Column | str, c: Column | str, k: Column | str | int) -> Column:
    """Chance that k of the n samples, drawn without replacement, hold a pass; null if n = 0 or k > n."""
    n, c, k = _column(n), _column(c), _column(k)
    return F.when((n == 0) | (k > n), F.lit(None).cast("double")).when(c == 0, F.lit(0.0)).otherwise(1.0 - _share(n - c, n, k))


def pass_pow_k(n: Column | str, c: Column | str, k: Column | str | int) -> Column:
    """Chance that k of the n samples, drawn without replacement, all pass; null if n = 0 or k > n."""
    n, c, k = _column(n), _column(c), _column(k)
    return F.when((n == 0) | (k > n), F.lit(None).cast("double")).when(c < k, F.lit(0.0)).otherwise(_share(c, n, k))


def pass_rate(passed: Column, total: Column) -> Column:
    """Percentage of passes; 0 without samples."""
    return F.when(total > 0, passed.cast("double") / total.cast("double") * 100.0).otherwise(F.lit(0.0))


def percent_text(rate: Column) -> Column:
    """A percentage without decimals, halves to even."""
    return F.concat(F.bround(rate, 0).cast("bigint").cast("string"), F.lit("%"))


def rate_colour(rate: Column) -> Column:
    return F.when(rate >= 80, "green").when(rate >= 50, "yellow").otherwise("red")
