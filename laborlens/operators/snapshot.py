"""The demand snapshot: volumes, mixes, leaders, and what rises and fades by share of recent postings."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborlens.functions.numbers import percent
from laborlens.operators.filters import active, with_ai
from laborlens.params import Params
from laborlens.star import Star


def volume(star: Star) -> DataFrame:
    """Postings, active ones, companies and roles behind them."""
    return star.jobs.agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if("is_active").alias("active_jobs"), F.countDistinct("company_id").alias("companies"), F.countDistinct("role_id").alias("roles"), F.count_if(F.col("is_active") & F.col("role_id").isNotNull()).alias("with_role")
    )


def top_roles(star: Star, k: int = 20) -> DataFrame:
    """Roles by active postings."""
    n = active(star).groupBy(F.col("role_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(star.roles, "id").select("id", "normalized_title", "category", "n").orderBy(F.desc("n"), "id").limit(k)


def categories(star: Star) -> DataFrame:
    """Active postings by role category."""
    return active(star).join(star.roles.select(F.col("id").alias("role_id"), "category"), "role_id").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def seniority_mix(star: Star) -> DataFrame:
    """Active postings by seniority with their share. The total is one row beside the groups, not a window."""
    jobs = star.jobs.filter("is_active")
    groups = jobs.groupBy("seniority_level").agg(F.count(F.lit(1)).alias("n"))
    return groups.join(jobs.agg(F.count(F.lit(1)).alias("total"))).select("seniority_level", "n", percent(F.col("n"), F.col("total")).alias("pct"))


def remote_share(star: Star) -> DataFrame:
    """Share of remote postings."""
    return star.jobs.filter("is_active").agg(percent(F.count_if("location_is_remote"), F.count(F.lit(1))).alias("remote_pct"))


def top_places(star: Star, k: int = 15) -> DataFrame:
    """Places of active postings that aren't remote."""
    return star.jobs.filter("is_active and not location_is_remote").groupBy(F.col("location_raw").alias("place")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "place").limit(k)


def top_companies(star: Star, k: int = 15) -> DataFrame:
    """Companies by active postings."""
    n = star.jobs.filter("is_active").groupBy(F.col("company_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(k)
    return n.join(star.companies.select("id", "name"), "id")


def top_skills(star: Star, k: int = 20) -> DataFrame:
    """Skills by distinct active postings."""
    jobs = star.jobs.filter("is_active").select(F.col("id").alias("job_id"))
    n = star.job_skills.join(jobs, "job_id", "left_semi").groupBy(F.col("skill_id").alias("id")).agg(F.countDistinct("job_id").alias("n")).orderBy(F.desc("n"), "id").limit(k)
    return n.join(star.skills.select("id", "name"), "id")


def _windows(p: Params, recent: int = 14, before: int = 60) -> tuple[Column, Column]:
    """Posted in the last days up to ``as_of``, and in the window before."""
    edge, start = p.as_of - timedelta(days=recent), p.as_of - timedelta(days=recent + before)
    posted = F.col("posted_at")
    return (posted >= F.lit(edge)) & (posted <= F.lit(p.as_of)), (posted >= F.lit(start)) & (posted < F.lit(edge))


def role_shares(star: Star, p: Params = Params()) -> DataFrame:
    """By role, recent and earlier postings, their shares of all (those without a role too) and the shares' ratio."""
    recent, before = _windows(p)
    jobs = star.jobs.filter(recent | before)
    n = jobs.groupBy("role_id").agg(F.count_if(recent).alias("recent_n"), F.count_if(before).alias("base_n"))
    totals = jobs.agg(F.count_if(recent).alias("rt"), F.count_if(before).alias("bt"))
    rows = n.filter("role_id is not null").join(totals)
    share = lambda c, t: 100.0 * c / F.when(F.col(t) != 0, F.col(t))
    base = F.when(F.col("base_n") == 0, 1).otherwise(F.col("base_n"))
    return rows.select("role_id", "recent_n", "base_n", F.round(share(F.col("recent_n"), "rt"), 2).alias("recent_pct"), F.round(share(F.col("base_n"), "bt"), 2).alias("base_pct"), (share(F.col("recent_n"), "rt") / share(base, "bt")).alias("ratio"))


def rising_roles(star: Star, p: Params = Params(), least: int = 15, k: int = 20) -> DataFrame:
    """Roles of enough recent postings by how far their share rose."""
    return role_shares(star, p).filter(F.col("recent_n") >= least).withColumn("ratio", F.round("ratio", 2)).orderBy(F.desc_nulls_last("ratio"), "role_id").limit(k)


def fading_roles(star: Star, p: Params = Params(), least: int = 30, k: int = 15) -> DataFrame:
    """Roles of enough earlier postings by how far their share fell."""
    return role_shares(star, p).filter(F.col("base_n") >= least).orderBy(F.asc_nulls_first("ratio"), "role_id").limit(k).drop("ratio")


def rising_skills(star: Star, p: Params = Params(), least: int = 30, k: int = 20) -> DataFrame:
    """Skills by how far their share of all mentions rose; totals are of mentions, not of postings."""
    recent, before = _windows(p)
    rows = star.jobs.filter(recent | before).join(star.job_skills, F.col("id") == F.col("job_id"))
    n = rows.groupBy("skill_id").agg(F.count_if(recent).alias("recent_n"), F.count_if(before).alias("base_n"))
    both = n.join(n.agg(F.sum("recent_n").alias("rt"), F.sum("base_n").alias("bt"))).filter(F.col("recent_n") >= least)
    base = F.when(F.col("base_n") == 0, 1).otherwise(F.col("base_n"))
    ratio = F.round((100.0 * F.col("recent_n") / F.col("rt")) / (100.0 * base / F.when(F.col("bt") != 0, F.col("bt"))), 2)
    return both.select("skill_id", "recent_n", "base_n", ratio.alias("ratio")).orderBy(F.desc_nulls_last("ratio"), "skill_id").limit(k)


def ai_league(star: Star, p: Params = Params(), least: int = 500, k: int = 12) -> DataFrame:
    """Roles of enough active postings by the share with an AI skill."""
    jobs = active(star).join(with_ai(star, p.ai_subcategory).withColumn("ai", F.lit(True)), F.col("id") == F.col("job_id"), "left")
    n = jobs.groupBy("role_id").agg(F.count(F.lit(1)).alias("jobs"), F.count_if("ai").alias("ai")).filter(F.col("jobs") >= least)
    return n.withColumn("ai_pct", percent(F.col("ai"), F.col("jobs"))).orderBy(F.desc("ai_pct"), "role_id").limit(k)


def named_skills(star: Star, names: list[str]) -> DataFrame:
    """Active postings that mention each of the named skills."""
    chosen = star.skills.filter(F.lower("name").isin([n.lower() for n in names])).select(F.col("id").alias("skill_id"), "name")
    jobs = star.jobs.filter("is_active").select(F.col("id").alias("job_id"))
    return star.job_skills.join(chosen, "skill_id").join(jobs, "job_id", "left_semi").groupBy("name").agg(F.countDistinct("job_id").alias("n"))


def freshness(star: Star) -> DataFrame:
    """When data last came in, over active companies."""
    live = star.companies.filter("is_active").select(F.col("id").alias("company_id"))
    return star.jobs.join(live, "company_id", "left_semi").agg(F.max("scraped_at").alias("fresh_at"))


def due_companies(star: Star, p: Params = Params(), days: int = 30) -> DataFrame:
    """Active companies never scraped, or not since the cut-off."""
    last = star.jobs.filter(F.col("scraped_at") <= F.lit(p.as_of)).groupBy(F.col("company_id").alias("id")).agg(F.max("scraped_at").alias("last_scraped"))
    rows = star.companies.filter("is_active").join(last, "id", "left")
    return rows.filter(F.col("last_scraped").isNull() | (F.col("last_scraped") < F.lit(p.as_of - timedelta(days=days)))).select("id", "last_scraped")


def mix_cube(star: Star) -> DataFrame:
    """Active postings by seniority and remoteness, with all subtotals, in one pass."""
    jobs = star.jobs.filter("is_active").select(F.coalesce("seniority_level", F.lit("none")).alias("seniority"), "location_is_remote")
    return jobs.cube("seniority", "location_is_remote").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level")).withColumnRenamed("location_is_remote", "remote")
