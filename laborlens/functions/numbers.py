"""Column expressions for shares, growth, ranks and calendar windows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent; null of nothing."""
    return F.round(100.0 * part / F.when(whole != 0, whole), digits)


def growth_pct(now: Column, before: Column) -> Column:
    """Growth in percent: from nothing to something is 100, from nothing to nothing unknown."""
    rise = F.round((now - before) / F.when(before != 0, before) * 100.0, 1)
    return F.when(before == 0, F.when(now > 0, F.lit(100.0))).otherwise(rise)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def top(df: DataFrame, k: int, by: list[Column], within: list[str]) -> DataFrame:
    """The first ``k`` rows of each group, with their 1-based ``rank``."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*within).orderBy(*by))).filter(F.col("rank") <= k)


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """By ``keys``, the value at index min(floor(n p), n - 1) of the sorted non-null values, for each named p.

    Equal values are counted before they are ranked, so that a group moves as a histogram.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.partitionBy(*keys).orderBy(value))
    total = F.sum("c").over(W.partitionBy(*keys))
    ranked = counts.withColumn("upto", upto).withColumn("total", total)
    index = lambda p: F.least(F.floor(F.col("total") * p), F.col("total") - 1)
    return ranked.groupBy(*keys).agg(*(F.min(F.when(F.col("upto") > index(p), F.col(value))).alias(name) for name, p in shares.items()))


def iso_week_start(c: Column) -> Column:
    """Monday of the ISO week."""
    return F.date_trunc("week", c).cast("date")


def first_of_month(day: date, back: int = 0) -> date:
    """First day of the month ``back`` months before that of ``day``."""
    at = day.year * 12 + day.month - 1 - back
    return date(at // 12, at % 12 + 1, 1)
