"""What is in demand: skills, companies, salaries and growth, for all roles in one plan."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborlens.functions.places import parse as parse_place
from laborlens.functions.numbers import first_of_month, growth_pct, nearest_rank, percent, top
from laborlens.operators.filters import active, with_ai
from laborlens.params import Params
from laborlens.star import Star

JOB_DATE = ("posted_at", "scraped_at")


def job_date() -> Column:
    return F.coalesce(*JOB_DATE)


def open_between(start: date, end: date) -> Column:
    """Posted before ``end`` and not closed before ``start``."""
    return F.coalesce((job_date() < F.lit(end)) & (F.col("closed_at").isNull() | (F.col("closed_at") >= F.lit(start))), F.lit(False))


def role_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("role_id").agg(F.count(F.lit(1)).alias("role_jobs"))


def tagged(jobs: DataFrame, star: Star, verified: bool = True) -> DataFrame:
    """Postings with their skills, one row a pair: (job columns, skill_id, is_required, name, category, subcategory)."""
    skills = star.skills.filter("is_verified") if verified else star.skills
    tags = star.job_skills.join(skills.select(F.col("id").alias("skill_id"), "name", "category", "subcategory"), "skill_id")
    return jobs.join(tags, F.col("id") == F.col("job_id"))


def skill_demand(star: Star, p: Params = Params(), jobs: DataFrame | None = None) -> DataFrame:
    """By role, its verified skills by number of postings, with shares of required and preferred mentions."""
    jobs = active(star) if jobs is None else jobs
    counts = tagged(jobs, star).groupBy("role_id", "skill_id", "name", "category").agg(F.count(F.lit(1)).alias("job_count"), F.count_if("is_required").alias("required"))
    shares = counts.join(role_jobs(jobs), "role_id").select(
        "role_id", "skill_id", "name", "category", "job_count",
        percent(F.col("job_count"), F.col("role_jobs")).alias("demand_pct"),
        percent(F.col("required"), F.col("job_count"), 0).alias("required_pct"),
        percent(F.col("job_count") - F.col("required"), F.col("job_count"), 0).alias("preferred_pct"),
    )
    return top(shares, p.top_skills, [F.desc("job_count"), F.asc("skill_id")], ["role_id"])


def skill_growth(star: Star, p: Params = Params(), window: int = 30, least: int = 5) -> DataFrame:
    """By role and skill, growth of its share of the postings open in the last window against the one before."""
    mid, old = p.as_of - timedelta(days=window), p.as_of - timedelta(days=2 * window)
    jobs = star.jobs.filter("role_id is not null").withColumns({"now": open_between(mid, p.as_of), "before": open_between(old, mid)}).filter("now or before")
    totals = jobs.groupBy("role_id").agg(F.count_if("now").alias("t_now"), F.count_if("before").alias("t_before"))
    counts = jobs.join(star.job_skills, F.col("id") == F.col("job_id")).groupBy("role_id", "skill_id").agg(F.count_if("now").alias("n_now"), F.count_if("before").alias("n_before"))
    share = lambda w: F.col(f"n_{w}") / F.when(F.col(f"t_{w}") > 0, F.col(f"t_{w}")) * 100
    known = (F.col("n_before") >= least) & (F.col("t_now") > 0)
    return counts.join(totals, "role_id").select("role_id", "skill_id", "n_now", "n_before", F.when(known, growth_pct(share("now"), share("before"))).alias("growth_pct"))


def company_growth(star: Star, p: Params = Params(), window: int = 30) -> DataFrame:
    """By role and company, growth of open postings; unknown below 1 % of the role's largest company, or 3."""
    mid, old = p.as_of - timedelta(days=window), p.as_of - timedelta(days=2 * window)
    jobs = star.jobs.filter("role_id is not null").withColumns({"now": open_between(mid, p.as_of), "before": open_between(old, mid)}).filter("now or before")
    counts = jobs.groupBy("role_id", "company_id").agg(F.count_if("now").alias("n_now"), F.count_if("before").alias("n_before"))
    floors = counts.groupBy("role_id").agg(F.greatest(F.lit(3), F.floor(F.max("n_before") * 0.01)).alias("least"))
    growth = F.when(F.col("n_before") >= F.col("least"), growth_pct(F.col("n_now"), F.col("n_before")))
    return counts.join(floors, "role_id").select("role_id", "company_id", "n_now", "n_before", growth.alias("growth_pct"))


def role_growth(star: Star, p: Params = Params()) -> DataFrame:
    """By role, postings open in the last full month against the month before."""
    end, mid, old = (first_of_month(p.as_of, k) for k in (0, 1, 2))
    jobs = star.jobs.filter("role_id is not null")
    counts = jobs.groupBy("role_id").agg(F.count_if(open_between(mid, end)).alias("n_now"), F.count_if(open_between(old, mid)).alias("n_before"))
    return counts.select("role_id", "n_now", "n_before", growth_pct(F.col("n_now"), F.col("n_before")).alias("growth_pct"))


def role_salaries(star: Star) -> DataFrame:
    """By role, mean salary bounds of active postings that state one, cut to whole dollars."""
    paid = active(star).filter("salary_min_usd > 0")
    return paid.groupBy("role_id").agg(F.avg("salary_min_usd").cast("int").alias("avg_min"), F.avg("salary_max_usd").cast("int").alias("avg_max"), F.count(F.lit(1)).alias("n"))


def salary_band(star: Star, p: Params = Params()) -> DataFrame:
    """By role, 25th percentile of minima, 75th of maxima (else of minima), median minimum; null for few rows."""
    jobs = active(star)
    paid = jobs.filter("salary_min_usd > 0")
    low = nearest_rank(paid, ["role_id"], "salary_min_usd", {"p25": 0.25, "p50": 0.5, "p75_min": 0.75})
    high = nearest_rank(paid, ["role_id"], "salary_max_usd", {"p75_max": 0.75})
    counts = jobs.groupBy("role_id").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("salary_min_usd") > 0).alias("n"))
    enough = lambda c: F.when(F.col("n") >= p.min_salaries, c)
    return counts.join(low, "role_id", "left").join(high, "role_id", "left").select(
        "role_id", "n", enough(F.col("p25")).alias("band_low"), enough(F.coalesce("p75_max", "p75_min")).alias("band_high"), enough(F.col("p50")).alias("median"), percent(F.col("n"), F.col("jobs")).alias("coverage_pct")
    )


def hiring_companies(star: Star, p: Params = Params()) -> DataFrame:
    """By role, its companies by active postings, with their growth and the role's number of companies."""
    counts = active(star).groupBy("role_id", "company_id").agg(F.count(F.lit(1)).alias("job_count"))
    n = counts.groupBy("role_id").agg(F.count(F.lit(1)).alias("n_companies"))
    ranked = top(counts, p.top_companies, [F.desc("job_count"), F.asc("company_id")], ["role_id"])
    names = star.companies.select(F.col("id").alias("company_id"), "name", "industry")
    return ranked.join(names, "company_id").join(n, "role_id").join(company_growth(star, p).select("role_id", "company_id", "growth_pct"), ["role_id", "company_id"], "left")


def companies_of_skills(star: Star, k: int = 10) -> DataFrame:
    """By role and verified skill, the ``k`` companies with most active postings of it."""
    counts = tagged(active(star), star).groupBy("role_id", "skill_id", "company_id").agg(F.count(F.lit(1)).alias("job_count"))
    return top(counts, k, [F.desc("job_count"), F.asc("company_id")], ["role_id", "skill_id"])


def remote_split(star: Star) -> DataFrame:
    """C14: by role, remote and other active postings."""
    return active(star).groupBy("role_id").agg(F.count_if("location_is_remote").alias("remote"), F.count_if(~F.col("location_is_remote")).alias("onsite"))


#: Skills that are worth a remark on the cards of roles of a category, first rule first.
CALLOUTS = [
    ("sql", "product"),
    ("sql", "marketing"),
    ("sql", "design"),
    ("sql", "operations"),
    ("sql", "finance"),
    ("sql", "sales"),
    ("sql", "people"),
    ("excel", "data science"),
    ("communication", "engineering"),
    ("communication", "data science"),
    ("figma", "design"),
    ("typescript", "engineering"),
    ("kubernetes", "engineering"),
    ("python", "marketing"),
    ("python", "finance"),
]


def role_cards(star: Star, p: Params = Params(), k: int = 8, callouts: list[tuple[str, str]] = CALLOUTS, within: int = 6, jobs: DataFrame | None = None) -> DataFrame:
    """C17: by role, its ``k`` leading skills with their share in whole percent, and the skill, rank and share of the
    first call-out rule (skill, category of the role) that holds among the leading six. ``jobs``: active postings after
    filters."""
    shown = skill_demand(star, p, jobs).filter(F.col("rank") <= k).withColumn("pct", F.least(F.round("demand_pct", 0), F.lit(100.0)))
    rules = star.skills.sparkSession.createDataFrame([(i, n.lower(), c.lower()) for i, (n, c) in enumerate(callouts)], "rule int, rule_name string, rule_category string")
    of_roles = star.roles.select(F.col("id").alias("role_id"), F.lower(F.trim(F.coalesce("category", F.lit("")))).alias("rule_category")).join(F.broadcast(rules), "rule_category")  # written by hand
    met = shown.filter(F.col("rank") <= within).withColumn("rule_name", F.lower("name")).join(of_roles, ["role_id", "rule_name"])
    first = met.groupBy("role_id").agg(F.min(F.struct("rule", "name", "rank", "pct")).alias("c"))
    return shown.join(first, "role_id", "left").select("role_id", "rank", "skill_id", "pct", F.col("c.name").alias("callout"), F.col("c.rank").alias("callout_rank"), F.col("c.pct").alias("callout_pct"))


def role_details(star: Star) -> DataFrame:
    """Roles with their number of active postings."""
    n = active(star).groupBy(F.col("role_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return star.roles.join(n, "id", "left").select("id", "normalized_title", "category", "job_family", F.coalesce("n", F.lit(0)).alias("active_jobs"))


def available_roles(star: Star, least: int) -> DataFrame:
    """Roles with enough active postings."""
    return role_details(star).filter(F.col("active_jobs") >= least)


def role_index(star: Star, p: Params = Params()) -> DataFrame:
    """Titles of roles that have a page, in order."""
    return available_roles(star, p.min_role_jobs).select("id", "normalized_title", "active_jobs").orderBy("normalized_title", "id")


def skill_directory(star: Star) -> DataFrame:
    """Verified skills by category, names in order."""
    return star.skills.filter("is_verified").groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))


def skill_detail(star: Star, k: int = 5) -> DataFrame:
    """By skill, active postings that have a role, and its ``k`` leading roles and companies as lists of ids."""
    rows = tagged(active(star), star, verified=False)
    total = rows.groupBy("skill_id").agg(F.count(F.lit(1)).alias("total_jobs"))

    def leading(by: str, name: str) -> DataFrame:
        best = top(rows.groupBy("skill_id", by).agg(F.count(F.lit(1)).alias("n")), k, [F.desc("n"), F.asc(by)], ["skill_id"])
        listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", by))), lambda s: s[by].cast("string"))
        return best.groupBy("skill_id").agg(F.array_join(listed, ",").alias(name))

    return total.join(leading("role_id", "top_roles"), "skill_id").join(leading("company_id", "top_companies"), "skill_id")


def co_occurrence(star: Star, least: int = 5, first: int = 30, most_pct: float = 60.0, k: int = 8) -> DataFrame:
    """By role and skill, the skills most often beside it, without those that most of the role's postings have.

    The self-join is on the posting, whose skills are few; pairs are summed map-side.
    """
    rows = tagged(active(star), star).select("role_id", "job_id", "skill_id")
    sizes = rows.groupBy("role_id", "skill_id").agg(F.count(F.lit(1)).alias("n"))
    other = rows.select("job_id", F.col("skill_id").alias("other_id"))
    pairs = rows.join(other, "job_id").filter("skill_id <> other_id").groupBy("role_id", "skill_id", "other_id").agg(F.count(F.lit(1)).alias("both"))
    pairs = pairs.join(sizes.filter(F.col("n") >= least), ["role_id", "skill_id"])
    near = top(pairs, first, [F.desc("both"), F.asc("other_id")], ["role_id", "skill_id"]).drop("rank")
    base = sizes.select("role_id", F.col("skill_id").alias("other_id"), F.col("n").alias("other_n")).join(role_jobs(active(star)), "role_id")
    near = near.join(base, ["role_id", "other_id"]).withColumn("base_pct", percent(F.col("other_n"), F.col("role_jobs"))).filter(F.col("base_pct") <= most_pct)
    near = near.withColumn("pct", percent(F.col("both"), F.col("n")))
    return top(near, k, [F.desc("both"), F.asc("other_id")], ["role_id", "skill_id"]).select("role_id", "skill_id", "other_id", "both", "pct", "base_pct", "rank")


def companies(star: Star, least: int = 0) -> DataFrame:
    """Companies with at least so many active postings; those without any are kept for 0."""
    n = star.jobs.filter("is_active").groupBy(F.col("company_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    counted = star.companies.filter("is_active").join(n, "id", "left").withColumn("job_count", F.coalesce("n", F.lit(0)))
    return counted.filter(F.col("job_count") >= least).select("id", "name", "industry", "job_count")


def company_roles(star: Star, k: int = 10) -> DataFrame:
    """By company, its active postings and its ``k`` leading roles."""
    counts = star.jobs.filter("is_active").groupBy("company_id", "role_id").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("company_id").agg(F.sum("n").alias("active_jobs"))
    return top(counts.filter("role_id is not null"), k, [F.desc("n"), F.asc("role_id")], ["company_id"]).join(total, "company_id")


def company_skill_demand(star: Star, role_id: int | None = None, k: int = 20) -> DataFrame:
    """By company, the skills of its active postings, verified or not; optionally of one role."""
    jobs = star.jobs.filter("is_active") if role_id is None else star.jobs.filter(F.col("is_active") & (F.col("role_id") == role_id))
    counts = tagged(jobs, star, verified=False).groupBy("company_id", "skill_id").agg(F.count(F.lit(1)).alias("n"))
    total = jobs.groupBy("company_id").agg(F.count(F.lit(1)).alias("jobs"))
    ranked = top(counts, k, [F.desc("n"), F.asc("skill_id")], ["company_id"])
    return ranked.join(total, "company_id").select("company_id", "skill_id", "n", percent(F.col("n"), F.col("jobs")).alias("pct"), "rank")


def job_stats(star: Star) -> DataFrame:
    """Active postings in all and by seniority, and the ten leading cities, as (kind, label, n)."""
    jobs = star.jobs.filter("is_active")
    total = jobs.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("kind"), F.lit("all").alias("label"), "n")
    levels = jobs.groupBy(F.coalesce("seniority_level", F.lit("none")).alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("seniority").alias("kind"), "label", "n")
    cities = jobs.groupBy("location_raw").agg(F.count(F.lit(1)).alias("n")).withColumn("label", parse_place(F.col("location_raw"))["city"]).filter("label <> ''").groupBy("label").agg(F.sum("n").alias("n"))
    cities = cities.orderBy(F.desc("n"), "label").limit(10)
    return total.unionByName(levels).unionByName(cities.select(F.lit("city").alias("kind"), "label", "n"))


def role_pages(star: Star, p: Params = Params(), skills: int = 12, firms: int = 6) -> DataFrame:
    """By role, the facts of its page: postings, companies, leading skills and companies, AI and remote shares."""
    jobs = active(star).join(with_ai(star, p.ai_subcategory).withColumn("ai", F.lit(True)), F.col("id") == F.col("job_id"), "left")
    facts = jobs.groupBy("role_id").agg(F.count(F.lit(1)).alias("jobs"), F.countDistinct("company_id").alias("companies"), F.count_if("ai").alias("ai"), F.count_if("location_is_remote").alias("remote"))
    listed = lambda df, by, name: df.groupBy("role_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", by))), lambda s: s[by].cast("string")), ",").alias(name))
    best = listed(skill_demand(star, p).filter(F.col("rank") <= skills), "skill_id", "top_skills")
    counts = active(star).groupBy("role_id", "company_id").agg(F.count(F.lit(1)).alias("n"))
    largest = listed(top(counts, firms, [F.desc("n"), F.asc("company_id")], ["role_id"]), "company_id", "top_companies")
    return facts.join(best, "role_id", "left").join(largest, "role_id", "left").select(
        "role_id", "jobs", "companies", percent(F.col("ai"), F.col("jobs"), 0).alias("ai_pct"), percent(F.col("remote"), F.col("jobs"), 0).alias("remote_pct"), "top_skills", "top_companies"
    )


def industries(star: Star) -> DataFrame:
    """F16: distinct industries of active companies, in order."""
    return star.companies.filter("is_active and industry is not null").select("industry").distinct().orderBy("industry")


def skill_weeks(star: Star) -> DataFrame:
    """The weekly series of skill demand by skill and role: postings, required ones, companies, mean salaries."""
    rows = star.jobs.filter("role_id is not null").join(star.job_skills, F.col("id") == F.col("job_id"))
    week = F.date_trunc("week", job_date()).cast("date").alias("period_date")
    return rows.groupBy("skill_id", "role_id", week).agg(
        F.count(F.lit(1)).alias("job_count"), F.count_if("is_required").alias("required_count"), F.countDistinct("company_id").alias("company_count"),
        F.avg("salary_min_usd").alias("avg_salary_min"), F.avg("salary_max_usd").alias("avg_salary_max"),
    )


def surging_companies(star: Star, p: Params, least: float) -> DataFrame:
    """(role_id, surging_company, surge_pct): of a role's leading companies, the one that grows most, from ``least`` on."""
    grown = hiring_companies(star, p).filter(F.col("growth_pct") >= least)
    best = grown.groupBy("role_id").agg(F.max(F.struct("growth_pct", (-F.col("rank")).alias("r"), "company_id")).alias("b"))
    return best.select("role_id", F.col("b.company_id").alias("surging_company"), F.col("b.growth_pct").alias("surge_pct"))


def _plain_skills(star: Star, p: Params, intrinsic: DataFrame) -> DataFrame:
    """Skill demand by role, with ``plain``: not ``intrinsic`` (role_id, skill_id) to it."""
    marked = skill_demand(star, p).join(intrinsic.select("role_id", "skill_id").distinct().withColumn("goes", F.lit(True)), ["role_id", "skill_id"], "left")
    return marked.withColumn("plain", F.col("goes").isNull()).drop("goes")


def role_verdicts(star: Star, intrinsic: DataFrame, p: Params = Params(), covered: int = 20) -> DataFrame:
    """By role, facts of its verdict: the four leading AI skills; the leverage skill (the first of 40 to 95 % demand
    that doesn't go without saying, else the first such, else the first); the one company that surges by 100 %; and the
    rounded growth with its direction, unless the trend covers under 20 postings. ``intrinsic``: role_id, skill_id."""
    from laborlens.operators.trends import market_trend, trend_coverage

    ai = star.skills.filter(F.col("subcategory") == p.ai_subcategory).select(F.col("id").alias("skill_id"), F.lit(True).alias("ai"))
    rows = _plain_skills(star, p, intrinsic).join(ai, "skill_id", "left")
    first = F.slice(F.array_sort(F.array_compact(F.collect_list(F.when(F.col("ai"), F.struct("rank", "skill_id"))))), 1, 4)
    choice = F.when(F.col("plain") & (F.col("demand_pct") >= 40) & (F.col("demand_pct") < 95), 0).when(F.col("plain"), 1).otherwise(2)
    facts = rows.groupBy("role_id").agg(F.array_join(F.transform(first, lambda s: s["skill_id"].cast("string")), ",").alias("top_ai_skills"), F.min(F.struct(choice.alias("c"), "rank", "skill_id"))["skill_id"].alias("leverage_skill"))
    facts = facts.join(surging_companies(star, p, 100.0), "role_id", "left").join(trend_coverage(star, p).select("role_id", "covered_jobs"), "role_id", "left").join(market_trend(star, p).select("role_id", "postings_growth_pct"), "role_id", "left")
    reliable = F.coalesce(F.col("covered_jobs") >= covered, F.lit(True))
    growth = F.when(reliable, F.round("postings_growth_pct", 0))
    verdict = F.when(~reliable, "building history").when(growth > 0, "growing").when(growth < 0, "cooling").otherwise("steady")
    return facts.select("role_id", "top_ai_skills", "leverage_skill", "surging_company", "surge_pct", growth.alias("growth"), verdict.alias("verdict"))


def person_verdicts(star: Star, intrinsic: DataFrame, p: Params = Params(), first: int = 15) -> DataFrame:
    """By person with skills, the share of the target role's leading 15 skills that they have, and the most asked-for
    skill that they lack and that doesn't go without saying."""
    has = star.person_skills.filter("status = 'have'").select("person_id", "skill_id", F.lit(True).alias("has")).distinct()
    people = star.persons.select("person_id", F.col("target_role_id").alias("role_id")).join(has.select("person_id").distinct(), "person_id", "left_semi")
    rows = people.join(_plain_skills(star, p, intrinsic), "role_id").join(has, ["person_id", "skill_id"], "left")
    lead, lacks = F.col("rank") <= first, F.col("has").isNull() & F.col("plain")
    covered = F.round(F.count_if(lead & F.col("has")) / F.count_if(lead) * 100, 0)
    return rows.groupBy("person_id").agg(covered.alias("coverage_pct"), F.min(F.when(lacks, F.struct("rank", "skill_id")))["skill_id"].alias("gap_skill"))
