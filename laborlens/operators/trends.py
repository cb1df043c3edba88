"""Cohort-locked trends and the market boards that rest on them.

Postings are counted by month while open, among companies that were tracked before the window began, so that new
sources can't pass for growth. The calendar has a handful of rows and is broadcast; every posting meets it once, and
all series of all roles and skills come from that one join.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laborlens.functions.numbers import clamp, first_of_month, growth_pct, percent, top
from laborlens.operators.demand import job_date
from laborlens.operators.filters import active, with_ai
from laborlens.params import Params
from laborlens.star import Star


def calendar(star: Star, p: Params) -> DataFrame:
    """(month, start, stop, partial): the window's months; the last one ends the day after ``as_of``."""
    rows = []
    for back in range(p.months - 1, -1, -1):
        start = first_of_month(p.as_of, back)
        stop = p.as_of + timedelta(days=1) if back == 0 else first_of_month(p.as_of, back - 1)
        rows.append((p.months - 1 - back, start, stop, back == 0))
    return star.jobs.sparkSession.createDataFrame(rows, "month int, start date, stop date, partial boolean")


def cohort_cutoff(p: Params):
    return first_of_month(p.as_of, p.months - 1) - timedelta(days=p.cohort_buffer_days)


def tracked_companies(star: Star, p: Params) -> DataFrame:
    """Companies first seen early enough, (company_id): the market's cohort."""
    first = star.jobs.filter("company_id is not null").groupBy("company_id").agg(F.min("scraped_at").alias("first"))
    return first.filter(F.col("first") <= F.lit(cohort_cutoff(p))).select("company_id")


def cohorts(star: Star, p: Params = Params()) -> DataFrame:
    """(role_id, company_id) of tracked companies that ever posted the role, for all roles."""
    posted = star.jobs.filter("role_id is not null").select("role_id", "company_id").distinct()
    return posted.join(tracked_companies(star, p), "company_id", "left_semi").select("role_id", "company_id")


def open_in_month(p: Params) -> Column:
    """open during a month, and if never closed, seen lately enough."""
    fresh = F.col("closed_at").isNotNull() | (F.col("last_seen_at") >= F.date_sub("stop", p.stale_days))
    return (job_date() < F.col("stop")) & (F.col("closed_at").isNull() | (F.col("closed_at") >= F.col("start"))) & fresh


def monthly(star: Star, p: Params) -> DataFrame:
    """Tracked companies' postings in every month in which they were open."""
    jobs = star.jobs.join(tracked_companies(star, p), "company_id", "left_semi")
    return jobs.join(F.broadcast(calendar(star, p)), open_in_month(p))  # as many rows as months


def open_span(p: Params) -> tuple[Column, Column]:
    """The same rule as ``open_in_month`` without the calendar: the first and the last month in which a posting is open;
    it never is if the last comes first. Months count from the window's start."""
    start = first_of_month(p.as_of, p.months - 1)
    index = lambda d: ((F.year(d) - start.year) * 12 + F.month(d) - start.month).cast("int")
    until = F.date_add(F.col("last_seen_at").cast("date"), p.stale_days)
    unseen = F.when(until >= F.lit(p.as_of + timedelta(days=1)), p.months - 1).otherwise(F.least(index(until) - 1, F.lit(p.months - 2)))
    begun = F.when(job_date() < F.lit(p.as_of + timedelta(days=1)), F.greatest(index(job_date()), F.lit(0))).otherwise(p.months)
    return begun.cast("int"), F.least(F.coalesce(index(F.col("closed_at")), unseen), F.lit(p.months - 1)).cast("int")


def swept(jobs: DataFrame, p: Params, keys: list[str], **values: Column) -> DataFrame:
    """By ``keys`` and month, the sums of ``values`` over the postings that are open: each posting is two events, one more
    at its first month and one less after its last, summed up along the months. Months of no change are not told."""
    first, last = open_span(p)
    rows = jobs.select(*keys, *(v.alias(n) for n, v in values.items()), first.alias("first"), last.alias("last")).filter("first <= last")
    event = lambda at, sign: F.struct(at.alias("month"), *((sign * F.col(n)).alias(n) for n in values))
    events = rows.select(*keys, F.explode(F.array(event(F.col("first"), 1), event(F.col("last") + 1, -1))).alias("e"))
    return events.select(*keys, "e.*").groupBy(*keys, "month").agg(*(F.sum(n).alias(n) for n in values))


def _summed(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Changes by month as levels."""
    upto = W.partitionBy(*keys).orderBy("month").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumns({n: F.sum(F.coalesce(n, F.lit(0))).over(upto) for n in names})


def _role_series(star: Star, p: Params, changes: DataFrame, levels: list[str], counts: list[str] = ()) -> DataFrame:
    """By month from ``changes``, for the roles whose cohort is large enough: ``levels`` summed up, ``counts`` as they are."""
    sizes = cohorts(star, p).groupBy("role_id").agg(F.count(F.lit(1)).alias("cohort")).filter(F.col("cohort") >= p.min_cohort)
    grid = sizes.join(F.broadcast(calendar(star, p)))
    rows = _summed(grid.join(changes, ["role_id", "month"], "left"), ["role_id"], levels)
    return rows.select("role_id", "cohort", "month", "start", "partial", *levels, *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))


def _chosen(star: Star, p: Params, jobs: DataFrame | None) -> DataFrame:
    """Tracked companies' postings with a role, or those of ``jobs``, a user's choice among the star's postings."""
    rows = star.jobs if jobs is None else jobs
    return rows.filter("role_id is not null").join(tracked_companies(star, p), "company_id", "left_semi")


def role_trend(star: Star, p: Params = Params(), jobs: DataFrame | None = None) -> DataFrame:
    """By role and month, open postings of its cohort, and those with a verified AI skill.

    ``jobs``: the postings that a user's filters leave (seniority, places, companies: U02). The cohort stays that of all
    postings, so chosen companies outside it give bars of zero, and a role whose cohort is too small has none.
    """
    rows = _chosen(star, p, jobs).join(with_ai(star, p.ai_subcategory).withColumn("ai", F.lit(1)), F.col("id") == F.col("job_id"), "left")
    return _role_series(star, p, swept(rows, p, ["role_id"], count=F.lit(1), ai_count=F.coalesce("ai", F.lit(0))), ["count", "ai_count"])


def stock_and_flow(star: Star, p: Params = Params(), jobs: DataFrame | None = None) -> DataFrame:
    """By role and month, postings open during it (stock) and posted within it (flow)."""
    rows = _chosen(star, p, jobs)
    first, last = open_span(p)
    new = rows.filter((first <= last) & (job_date() >= F.lit(first_of_month(p.as_of, p.months - 1)))).groupBy("role_id", first.alias("month")).agg(F.count(F.lit(1)).alias("flow"))
    changes = swept(rows, p, ["role_id"], stock=F.lit(1)).join(new, ["role_id", "month"], "full")
    return _role_series(star, p, changes, ["stock"], ["flow"])


def ends(series: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """First and last full month of each series: ``first_`` and ``last_`` each value, and the number of full months."""
    full = series.filter(~F.col("partial"))
    aggs = [f(v, "month").alias(f"{n}_{v}") for v in values for f, n in ((F.min_by, "first"), (F.max_by, "last"))]
    return full.groupBy(*keys).agg(F.count(F.lit(1)).alias("full_months"), *aggs)


def market_trend(star: Star, p: Params = Params(), jobs: DataFrame | None = None) -> DataFrame:
    """By role, growth of the last full month on the one before. ``jobs`` as in ``role_trend``."""
    full = role_trend(star, p, jobs).filter(~F.col("partial"))
    two = full.groupBy("role_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("month", "count")))).alias("m"))
    now, before = F.get("m", F.lit(0))["count"], F.get("m", F.lit(1))["count"]
    return two.filter(F.size("m") >= 2).select("role_id", now.alias("current"), before.alias("previous"), growth_pct(now, before).alias("postings_growth_pct"))


def ai_exposure(star: Star, p: Params = Params(), jobs: DataFrame | None = None) -> DataFrame:
    """By role, AI share of active postings, and the change of the cohort's share over the full months. ``jobs`` as in
    ``role_trend``."""
    now_open = active(star if jobs is None else replace(star, jobs=jobs)).join(with_ai(star, p.ai_subcategory).withColumn("ai", F.lit(True)), F.col("id") == F.col("job_id"), "left")
    now = now_open.groupBy("role_id").agg(F.count_if("ai").alias("ai_job_count"), percent(F.count_if("ai"), F.count(F.lit(1))).alias("current_pct"))
    shares = role_trend(star, p, jobs).filter("count > 0").withColumn("share", percent(F.col("ai_count"), F.col("count")))
    at = ends(shares, ["role_id"], "share").filter("full_months >= 2")
    return now.join(at, "role_id", "left").select("role_id", "ai_job_count", "current_pct", F.round(F.col("last_share") - F.col("first_share"), 1).alias("delta_pct_points"))


def trend_coverage(star: Star, p: Params = Params(), jobs: DataFrame | None = None) -> DataFrame:
    """C11: by role, cohort companies, and the active postings that are theirs. ``jobs`` as in ``role_trend``."""
    members = cohorts(star, p)
    sizes = members.groupBy("role_id").agg(F.count(F.lit(1)).alias("cohort_companies"))
    now_open = active(star if jobs is None else replace(star, jobs=jobs)).join(members.withColumn("covered", F.lit(True)), ["role_id", "company_id"], "left")
    counts = now_open.groupBy("role_id").agg(F.count_if("covered").alias("covered_jobs"), percent(F.count_if("covered"), F.count(F.lit(1))).alias("covered_pct"))
    return counts.join(sizes, "role_id", "left").select("role_id", F.coalesce("cohort_companies", F.lit(0)).alias("cohort_companies"), "covered_jobs", "covered_pct")


def confidence(active_: Column, cohort: Column, share: Column, p: Params) -> Column:
    """Of volume, breadth and evenness, between 0 and 1."""
    blend = 0.4 * F.least(F.lit(1.0), active_ / 200.0) + 0.4 * F.least(F.lit(1.0), cohort / 30.0) + 0.2 * clamp(1 - share / p.qualify_top_share, 0.0, 1.0)
    return F.round(clamp(blend, 0.0, 1.0), 2)


def reasons(active_: Column, cohort: Column, share: Column, p: Params) -> Column:
    """Why a role doesn't qualify; none if it does."""
    checks = F.array(F.when(active_ < p.qualify_active, "volume"), F.when(cohort < p.qualify_cohort, "breadth"), F.when(share > p.qualify_top_share, "concentration"))
    return F.array_compact(checks)


def qualification(star: Star, p: Params = Params()) -> DataFrame:
    """Of every role, whether its figures can be trusted, and why not."""
    members = cohorts(star, p)
    own = active(star).groupBy("role_id", "company_id").agg(F.count(F.lit(1)).alias("n"))
    volume = own.groupBy("role_id").agg(F.sum("n").alias("active"))
    shares = own.join(members, ["role_id", "company_id"], "left_semi").groupBy("role_id").agg((F.max("n") / F.sum("n")).alias("top_share"))
    sizes = members.groupBy("role_id").agg(F.count(F.lit(1)).alias("cohort"))
    all_ = star.roles.select(F.col("id").alias("role_id")).join(volume, "role_id", "left").join(sizes, "role_id", "left").join(shares, "role_id", "left")
    all_ = all_.select("role_id", F.coalesce("active", F.lit(0)).alias("active"), F.coalesce("cohort", F.lit(0)).alias("cohort"), F.coalesce("top_share", F.lit(1.0)).alias("share"))
    three = (F.col("active"), F.col("cohort"), F.col("share"), p)
    why = reasons(*three)
    return all_.select("role_id", "active", "cohort", F.round("share", 3).alias("top_share"), (F.size(why) == 0).alias("qualified"), F.array_join(why, ",").alias("reasons"), confidence(*three).alias("confidence"))


def sectors(star: Star, p: Params = Params()) -> DataFrame:
    """By job family, active postings, roles, and roles of enough volume."""
    n = active(star).groupBy(F.col("role_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    roles = star.roles.join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return roles.groupBy(F.coalesce("job_family", F.lit("Other")).alias("sector")).agg(F.sum("n").alias("active"), F.count(F.lit(1)).alias("roles"), F.count_if(F.col("n") >= p.qualify_active).alias("qualified_roles"))


def market_summary(star: Star, p: Params = Params()) -> DataFrame:
    """The whole market's series ends, and its growth."""
    counts = monthly(star, p).groupBy("month").agg(F.count(F.lit(1)).alias("stock"))
    series = calendar(star, p).join(counts, "month", "left").withColumn("stock", F.coalesce("stock", F.lit(0)))
    companies = tracked_companies(star, p).agg(F.count(F.lit(1)).alias("cohort"))
    return ends(series, [], "stock").join(companies).select("first_stock", "last_stock", growth_pct(F.col("last_stock"), F.col("first_stock")).alias("growth"), "cohort")


def _moves(series_ends: DataFrame, p: Params) -> DataFrame:
    """Series whose stock and flow agree in direction and whose stock moved far enough."""
    rise = lambda v: F.signum(F.col(f"last_{v}") - F.col(f"first_{v}"))
    growth = growth_pct(F.col("last_stock"), F.col("first_stock"))
    agree = (rise("stock") == rise("flow")) & growth.isNotNull()
    return series_ends.filter(agree & (F.abs(F.col("last_stock") - F.col("first_stock")) >= p.min_abs_delta)).withColumn("growth", growth)


def role_movers(star: Star, p: Params = Params(), families: DataFrame | None = None) -> DataFrame:
    """Qualified roles of no family that moved, against the market.

    ``families``: role_id, family. Roles of a family never show alone, so that a new name for a role is no move.
    """
    at = ends(stock_and_flow(star, p), ["role_id", "cohort"], "stock", "flow")
    if families is not None:
        at = at.join(families, "role_id", "left_anti")
    fine = qualification(star, p).filter("qualified").select("role_id", "confidence")
    market = market_summary(star, p).select(F.col("growth").alias("market"))
    moved = _moves(at.join(fine, "role_id"), p).join(star.roles.select(F.col("id").alias("role_id"), F.col("normalized_title").alias("label"), F.coalesce("job_family", F.lit("Other")).alias("sector")), "role_id")
    return moved.join(market).select("role_id", "label", "sector", "first_stock", "last_stock", "growth", F.round(F.col("growth") - F.col("market"), 1).alias("vs_market"), "cohort", "confidence")


def family_movers(star: Star, families: DataFrame, p: Params = Params()) -> DataFrame:
    """Families of synonymous roles as one series each; sector by the member with most active postings."""
    series = stock_and_flow(star, p).join(families, "role_id")
    sums = series.groupBy("family", "month", "partial").agg(F.sum("stock").alias("stock"), F.sum("flow").alias("flow"))
    with_series = series.select("role_id").distinct()
    breadth = cohorts(star, p).join(with_series, "role_id", "left_semi").join(families, "role_id").groupBy("family").agg(F.countDistinct("company_id").alias("cohort"))
    volume = active(star).groupBy("role_id").agg(F.count(F.lit(1)).alias("n")).join(families, "role_id").join(with_series, "role_id", "left_semi")
    volume = volume.join(star.roles.select(F.col("id").alias("role_id"), F.coalesce("job_family", F.lit("Other")).alias("sector")), "role_id").groupBy("family", "sector").agg(F.sum("n").alias("n"))
    sector = volume.groupBy("family").agg(F.min(F.struct(-F.col("n"), F.col("sector").alias("s")))["s"].alias("sector"))
    at = ends(sums, ["family"], "stock", "flow").join(breadth.filter(F.col("cohort") >= p.qualify_cohort), "family").join(sector, "family", "left")
    sure = F.round(F.least(F.lit(1.0), F.col("cohort") / 30.0), 2)
    return _moves(at, p).select("family", F.coalesce("sector", F.lit("Other")).alias("sector"), "first_stock", "last_stock", "growth", "cohort", sure.alias("confidence"))


def boards(movers: DataFrame, p: Params = Params()) -> DataFrame:
    """Rising and declining boards, overall and for sectors of enough movers. ``movers``: label, sector, growth.

    Every mover is on one or two scopes, so all boards come from one pass.
    """
    many = F.count(F.lit(1)).over(W.partitionBy("sector")) >= p.sector_min
    scopes = F.array_compact(F.array(F.lit("overall"), F.when(F.col("many"), F.col("sector"))))
    scoped = movers.withColumn("many", many).filter("growth <> 0").withColumn("scope", F.explode(scopes))
    kind = F.when(F.col("growth") > 0, "rising_role").otherwise("declining_role")
    ranked = top(scoped.withColumn("kind", kind), p.top_n, [F.desc(F.abs("growth")), F.asc("label")], ["scope", "kind"])
    return ranked.select("kind", "scope", "rank", "label", "sector", "growth")


def in_demand_roles(star: Star, p: Params = Params(), first: int = 80) -> DataFrame:
    """The first ten qualified among the largest roles, with their series as a list."""
    large = active(star).groupBy("role_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "role_id").limit(first)
    fine = large.join(qualification(star, p).filter("qualified").select("role_id", "confidence"), "role_id").orderBy(F.desc("n"), "role_id").limit(p.top_n)
    full = role_trend(star, p).filter(~F.col("partial"))
    trend = full.groupBy("role_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("month", "count"))), lambda s: s["count"].cast("string")), ",").alias("trend"))
    return fine.join(trend, "role_id", "left").select("role_id", "n", "confidence", "trend")


def emerging_skills(candidates: DataFrame, p: Params = Params()) -> DataFrame:
    """Young candidate skills of enough companies. ``candidates``: name, first_seen, company_count, job_count."""
    young = candidates.filter((F.col("first_seen") >= F.lit(p.as_of - timedelta(days=p.emerging_days))) & (F.col("company_count") >= p.emerging_companies))
    return young.orderBy(F.desc("company_count"), F.desc("job_count"), "name").limit(p.top_n)


def skill_months(star: Star, p: Params = Params()) -> DataFrame:
    """By skill and month, the tracked companies' open postings that mention it, where there are any."""
    jobs = star.jobs.join(tracked_companies(star, p), "company_id", "left_semi").join(star.job_skills.select("job_id", "skill_id"), F.col("id") == F.col("job_id"))
    changes = swept(jobs, p, ["skill_id"], count=F.lit(1))
    grid = changes.select("skill_id").distinct().join(F.broadcast(calendar(star, p)))
    return _summed(grid.join(changes, ["skill_id", "month"], "left"), ["skill_id"], ["count"]).filter("count > 0").select("skill_id", "month", "partial", "count")


def _by_employer(star: Star, p: Params) -> DataFrame:
    """By skill and month, postings, distinct employers and the largest one's share."""
    rows = monthly(star, p).join(star.job_skills.select("job_id", "skill_id"), F.col("id") == F.col("job_id"))
    own = rows.groupBy("skill_id", "month", "company_id").agg(F.count(F.lit(1)).alias("n"))
    return own.groupBy("skill_id", "month").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("companies"), (F.max("n") / F.sum("n")).alias("top_share"))


def concentration(star: Star, p: Params = Params()) -> DataFrame:
    """By skill and month, distinct employers and the largest one's share of the postings."""
    return _by_employer(star, p).drop("count")


def skill_movers(star: Star, p: Params = Params()) -> DataFrame:
    """Skills whose share of the market moved, broadly enough in the first and in the last full month."""
    jobs = active(star).select("id")
    volume = star.job_skills.join(jobs, F.col("job_id") == F.col("id"), "left_semi").groupBy("skill_id").agg(F.count(F.lit(1)).alias("jobs"))
    known = star.skills.filter("is_verified and category in ('technical', 'soft')").join(volume, F.col("id") == F.col("skill_id")).filter(F.col("jobs") >= p.skill_min_jobs).select("skill_id", F.col("name").alias("label"))
    months = calendar(star, p)
    totals = months.join(monthly(star, p).groupBy("month").agg(F.count(F.lit(1)).alias("total")), "month", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    base = ends(totals, [], "total").filter("full_months >= 2 and first_total > 0 and last_total > 0").select("first_total", "last_total")
    # A skill that passes has postings in both months, so no month needs filling with zero.
    last = p.months - 2
    at = lambda c, month: F.max(F.when(F.col("month") == month, F.col(c)))
    sides = [at(c, m).alias(f"{w}_{c}") for c in ("count", "companies", "top_share") for w, m in (("first", 0), ("last", last))]
    pairs = _by_employer(star, p).filter(F.col("month").isin(0, last)).groupBy("skill_id").agg(*sides).join(known, "skill_id").join(base)
    share = lambda w: F.col(f"{w}_count") / F.col(f"{w}_total") * 100
    wide = lambda w: (F.col(f"{w}_companies") >= p.skill_min_companies) & (F.col(f"{w}_top_share") <= p.skill_max_concentration)
    moved = pairs.filter((F.col("first_count") >= p.skill_min_base) & wide("first") & wide("last")).withColumn("from_share", share("first")).withColumn("to_share", share("last"))
    moved = moved.filter(F.abs(F.col("to_share") - F.col("from_share")) >= p.skill_min_share_delta)
    return moved.select(
        "skill_id", "label", growth_pct(F.col("to_share"), F.col("from_share")).alias("growth"), F.col("first_count").alias("from_count"), F.col("last_count").alias("to_count"),
        F.round("from_share", 2).alias("from_share"), F.round("to_share", 2).alias("to_share"), F.col("last_companies").alias("companies"),
    )


def skill_boards(movers: DataFrame, p: Params = Params()) -> DataFrame:
    """Rising and falling skills. ``movers`` as from ``skill_movers``."""
    kind = F.when(F.col("growth") > 0, "rising_skill").otherwise("falling_skill")
    ranked = top(movers.filter("growth <> 0").withColumn("kind", kind), p.top_n, [F.desc(F.abs("growth")), F.asc("skill_id")], ["kind"])
    return ranked.select("kind", "rank", "skill_id", "label", "growth")
