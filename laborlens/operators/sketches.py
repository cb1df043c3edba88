"""Distinct counts from mergeable sketches (A13): counted once at the finest level, rolled up to any coarser one.

A HyperLogLog sketch of 4096 registers has a standard error of 1.6 %. Sketches of parts merge into that of the whole, so
a table of sketches by skill, role and month, kept up by the month, answers for every coarser level without the postings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.operators.trends import monthly
from laborlens.params import Params
from laborlens.star import Star

#: Binary logarithm of a sketch's registers.
LG_K = 12


def sketched(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, sketch): a sketch of the distinct ``value`` of each key; nulls count for nothing."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(value, F.lit(LG_K)).alias("sketch"))


def rolled_up(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of coarser ``keys``; with those of other tables of the same kind, a union of tables will do."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimated(sketches: DataFrame, name: str) -> DataFrame:
    """Sketches as their estimates."""
    return sketches.withColumn(name, F.hll_sketch_estimate("sketch")).drop("sketch")


def employer_sketches(star: Star, p: Params = Params()) -> DataFrame:
    """(skill_id, role_id, month, sketch) of the tracked companies with open postings."""
    rows = monthly(star, p).join(star.job_skills.select("job_id", "skill_id"), F.col("id") == F.col("job_id"))
    return sketched(rows, ["skill_id", "role_id", "month"], "company_id")


def employers(sketches: DataFrame) -> DataFrame:
    """(level, key, month, employers): by skill, by role and of all, from ``employer_sketches``."""
    levels = [("skill", F.col("skill_id")), ("role", F.col("role_id")), ("all", F.lit(None))]
    each = sketches.withColumn("l", F.explode(F.array(*(F.struct(F.lit(n).alias("level"), k.cast("long").alias("key")) for n, k in levels)))).select("l.*", "month", "sketch")
    return estimated(rolled_up(each, ["level", "key", "month"]), "employers")
