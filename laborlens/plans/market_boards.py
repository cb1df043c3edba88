"""The weekly market run: all boards as rows of one table, written by week."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.operators import trends
from laborlens.params import Params
from laborlens.star import Star


def week_of(day: date) -> date:
    return day - timedelta(days=day.weekday())


def market_boards(star: Star, p: Params = Params(), families: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """(week_start, kind, scope, rank, label, growth) of role, skill, in-demand and emerging boards."""
    movers = trends.role_movers(star, p, families).select("label", "sector", "growth")
    if families is not None:
        grouped = trends.family_movers(star, families.select("role_id", "family"), p)
        movers = movers.unionByName(grouped.select(F.concat("family", F.lit(" (family)")).alias("label"), "sector", "growth"))
    columns = ["kind", "scope", "rank", "label", "growth"]
    rows = trends.boards(movers, p).select(*columns)
    rows = rows.unionByName(trends.skill_boards(trends.skill_movers(star, p), p).withColumn("scope", F.lit("overall")).select(*columns))
    if candidates is not None:
        young = trends.emerging_skills(candidates, p).withColumn("rank", F.lit(0)).select(F.lit("emerging_skill").alias("kind"), F.lit("overall").alias("scope"), "rank", F.col("name").alias("label"), F.lit(None).cast("double").alias("growth"))
        rows = rows.unionByName(young)
    return rows.withColumn("week_start", F.lit(week_of(p.as_of)))
