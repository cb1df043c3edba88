"""The weekly snapshot of everybody's score, drivers and matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.operators import people
from laborlens.operators.maintain import upsert_weeks
from laborlens.params import Params
from laborlens.plans.market_boards import week_of
from laborlens.star import Star


def snapshot(star: Star, p: Params = Params()) -> DataFrame:
    """(person_id, week_start, position_score, matches, best_job, drivers) of people with skills and a role in demand."""
    drivers = people.score_drivers(star, p).groupBy("person_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]), "; ").alias("drivers"))
    found = people.match_summary(star, p).select("person_id", F.col("total_count").alias("matches"), "best_job")
    rows = people.position_scores(star, p).join(found, "person_id", "left").join(drivers, "person_id", "left")
    return rows.select("person_id", F.lit(week_of(p.as_of)).alias("week_start"), F.col("score").alias("position_score"), F.coalesce("matches", F.lit(0)).alias("matches"), "best_job", "drivers")


def next_weeks(star: Star, p: Params = Params()) -> DataFrame:
    """The history with this week's scores; a rerun of the week takes the place of its rows."""
    return upsert_weeks(star.person_weeks, snapshot(star, p).select("person_id", "week_start", "position_score"))
