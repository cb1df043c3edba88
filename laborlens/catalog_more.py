"""Lookups, review and taxonomy operators as queries over the given tables, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from laborlens.catalog_demand import ACTIVE, DEMAND, SERIES, P, growth, pct
from laborlens.catalog_people import DRIVEN, MATCHES, POSITION, SKILL_GROWTH
from laborlens.catalog_upkeep import CANDIDATES, candidates, star_query
from laborlens.functions import numbers
from laborlens.operators import demand, filters, maintain, sketches, trends
from laborlens.plans import role_insights, week_snapshots
from laborlens.sources import tables
from laborlens.star import Star, sql
from laborlens.streaming import jobs as streams


def asked_roles(s: Star):
    """Names to look up: titles of roles, of variations, parts of titles, and strangers."""
    exact = s.roles.select(F.upper("normalized_title").alias("name"))
    known = s.jobs.filter("role_id is not null").select("title").distinct().select(F.col("title").alias("name"))
    parts = s.roles.select(F.substring_index("normalized_title", " ", 1).alias("name"))
    return exact.unionByName(known).unionByName(parts).unionByName(s.roles.limit(1).select(F.lit("stranger").alias("name")))


def bridge(s: Star):
    rows = s.job_skills.join(s.jobs.select(F.col("id").alias("job_id"), "company_id"), "job_id").join(s.skills.select(F.col("id").alias("skill_id"), "name"), "skill_id")
    return rows.select(F.concat(F.lit("new "), "name").alias("name"), "job_id", "company_id")


def reviewed(s: Star):
    """Decisions on titles: urgent ones are mapped, remote ones become roles, senior ones are rejected."""
    t = s.jobs.filter("role_id is null").select("title").distinct()
    action = F.when(F.col("title").startswith("Lead"), "map").when(F.col("title").startswith("Senior"), "reject").when(F.col("title").contains("Remote"), "new_role")
    to = F.when(F.col("title").startswith("Lead"), F.regexp_replace("title", r"^Lead | \(Remote\)$", "")).otherwise(F.concat(F.lit("Far "), F.regexp_extract("title", r"NATION_\d", 0)))
    return t.select(F.col("title").alias("raw_title"), action.alias("action"), to.alias("role_title")).filter("action is not null")


QUEUED = "SELECT title AS raw_title, 'pending' AS status FROM jobs WHERE role_id IS NULL GROUP BY title"
DECIDED = {
    "decided": """SELECT title AS raw_title, CASE WHEN title LIKE 'Lead%' THEN 'map' WHEN title LIKE 'Senior%' THEN 'reject' ELSE 'new_role' END AS action,
       CASE WHEN title LIKE 'Lead%' THEN regexp_replace(title, '^Lead | \\(Remote\\)$', '', 'g') ELSE 'Far ' || regexp_extract(title, 'NATION_[0-9]') END AS role_title
       FROM (SELECT DISTINCT title FROM jobs WHERE role_id IS NULL) WHERE title LIKE 'Lead%' OR title LIKE 'Senior%' OR title LIKE '%Remote%'""",
    "fresh": "SELECT role_title AS normalized_title, 9 + row_number() OVER (ORDER BY role_title) AS id FROM (SELECT DISTINCT role_title FROM decided WHERE action = 'new_role')",
    "next_roles": "SELECT id, normalized_title FROM roles UNION ALL SELECT id, normalized_title FROM fresh",
}

def sketched_employers(s: Star):
    """Employers by skill, role and of all, exactly and whether the sketches come within 8 % (five standard errors) of it."""
    told = sketches.employers(sketches.employer_sketches(s, P)).withColumnRenamed("employers", "told")
    rows = trends.monthly(s, P).join(s.job_skills.select("job_id", "skill_id"), F.col("id") == F.col("job_id"))
    levels = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), k.cast("long").alias("key")) for n, k in (("skill", F.col("skill_id")), ("role", F.col("role_id")), ("all", F.lit(None))))))
    exact = rows.select(levels.alias("l"), "month", "company_id").groupBy("l.level", "l.key", "month").agg(F.count_distinct("company_id").alias("exact"))
    same = (F.col("t.level") == F.col("e.level")) & F.col("t.key").eqNullSafe(F.col("e.key")) & (F.col("t.month") == F.col("e.month"))
    return exact.alias("e").join(told.alias("t"), same, "left").select("e.level", "e.key", "e.month", "exact", F.coalesce(F.abs(F.col("told") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.08 * F.col("exact")), F.lit(False)).alias("close"))


#: A user's filters on one role.
CHOSEN = {"seniority": "senior", "locations": ["NATION_1", "NATION_2", "NATION_3", "NATION_4", "NATION_5"], "industries": ["BUILDING", "MACHINERY", "HOUSEHOLD"]}
FILTERED = {
    **ACTIVE, **SERIES,
    "chosen": """SELECT * FROM jobs WHERE role_id = 4 AND lower(seniority_level) IN ('senior', 'sr', 'iii', '3') AND company_id IN (SELECT id FROM companies WHERE is_active AND industry IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD'))
      AND (location_country IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4', 'NATION_5') OR regexp_matches(lower(location_raw), 'nation_[1-5]'))""",
    "chosen_months": """SELECT j.role_id, m.month, count(*) AS "count", count(*) FILTER (WHERE id IN (SELECT job_id FROM ai)) AS ai_count FROM chosen j JOIN months m ON coalesce(posted_at, scraped_at) < stop AND (closed_at IS NULL OR closed_at >= "start")
      AND (closed_at IS NOT NULL OR last_seen_at >= stop - INTERVAL 90 DAY) WHERE company_id IN (SELECT company_id FROM tracked) GROUP BY j.role_id, m.month""",
}

ENTRIES: dict[str, tuple] = {
    "f09_find_role": (
        star_query(lambda s: filters.find_role(asked_roles(s), s.roles, s.jobs.filter("role_id is not null").groupBy(F.col("title").alias("original_title")).agg(F.min("role_id").alias("role_id")))),
        sql(
            """SELECT upper(normalized_title) AS name, id AS role_id, 'title' AS how FROM roles UNION ALL SELECT title, coalesce(any_value(r.id), min(role_id)), CASE WHEN any_value(r.id) IS NOT NULL THEN 'title' ELSE 'variation' END FROM jobs LEFT JOIN roles r ON lower(r.normalized_title) = lower(title) WHERE role_id IS NOT NULL GROUP BY title
            UNION ALL SELECT n, min(id), 'substring' FROM (SELECT DISTINCT string_split(normalized_title, ' ')[1] AS n FROM roles) JOIN roles ON contains(lower(normalized_title), lower(n)) GROUP BY n"""
        ),
    ),
    "f10_suggest_roles": (
        star_query(lambda s: filters.suggest_roles(s.roles.limit(1).select(F.explode(F.array(F.lit("nation_1"), F.lit("engineer"), F.lit("stranger"))).alias("name")), s.roles, demand.role_jobs(filters.active(s)).withColumnRenamed("role_jobs", "n"))),
        sql(
            """SELECT name, role_id, row_number() OVER (PARTITION BY name ORDER BY n DESC, role_id) AS rank FROM (VALUES ('nation_1'), ('engineer'), ('stranger')) a(name) JOIN (SELECT r.id AS role_id, lower(normalized_title) AS t, count(a.id) AS n FROM roles r LEFT JOIN active a ON a.role_id = r.id GROUP BY ALL) r
            ON contains(t, name) OR name = 'stranger' QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, role_id) <= 5""",
            ACTIVE,
        ),
    ),
    "c45_qualified_roles": (star_query(lambda s: demand.available_roles(s, P.qualify_active).select("id", "active_jobs").orderBy(F.desc("active_jobs"), "id")), sql("SELECT role_id AS id, count(*) AS active_jobs FROM active GROUP BY role_id HAVING count(*) >= 50", ACTIVE)),
    "c53_emerging_skills": (
        star_query(lambda s: trends.emerging_skills(candidates(s).withColumn("first_seen", F.date_add("first_seen", 2350)), P)),
        sql("SELECT name, job_count, company_count, first_seen + 2350 AS first_seen, last_seen FROM k WHERE first_seen + 2350 >= DATE '2001-05-01' AND company_count >= 3 ORDER BY company_count DESC, job_count DESC, name LIMIT 10", {"k": CANDIDATES.format(some='true')}),
    ),
    "c72_role_insights_skills": (
        star_query(lambda s: role_insights.role_insights(s, 4, P, seniority="senior", locations=["NATION_1", "NATION_2"], industries=["BUILDING", "MACHINERY", "HOUSEHOLD"])["skills"]),
        sql(
            """SELECT CAST(4 AS BIGINT) AS role_id, q.*, growth_pct FROM (SELECT s.id AS skill_id, s.name, s.category, count(*) AS job_count, round(100.0 * count(*)::DOUBLE / (SELECT count(*) FROM f), 1) AS demand_pct, round(100.0 * count(*) FILTER (WHERE is_required)::DOUBLE / count(*), 0) AS required_pct,
            round(100.0 * count(*) FILTER (WHERE NOT is_required)::DOUBLE / count(*), 0) AS preferred_pct, row_number() OVER (ORDER BY count(*) DESC, s.id) AS rank FROM f JOIN job_skills js ON js.job_id = f.id JOIN skills s ON s.id = js.skill_id WHERE s.is_verified GROUP BY s.id, s.name, s.category) q LEFT JOIN (SELECT skill_id, growth_pct FROM grown WHERE role_id = 4) USING (skill_id)""",
            {**ACTIVE, "grown": SKILL_GROWTH, "f": "SELECT * FROM jobs WHERE is_active AND role_id = 4 AND lower(seniority_level) IN ('senior', 'sr', 'iii', '3') AND (location_country IN ('NATION_1', 'NATION_2') OR location_raw ILIKE '%nation_1%' OR location_raw ILIKE '%nation_2%') AND company_id IN (SELECT id FROM companies WHERE is_active AND industry IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD'))"},
        ),
    ),
    "a13_sketched_employers": (
        star_query(sketched_employers),
        sql(
            """SELECT level, key, month, count(DISTINCT company_id) AS exact, true AS close FROM (SELECT unnest(['skill', 'role', 'all']) AS level, unnest([skill_id, role_id, NULL]) AS key, month, company_id FROM monthly JOIN job_skills ON job_id = id) GROUP BY ALL""",
            SERIES,
        ),
    ),
    "c72_role_insights_trend": (
        star_query(lambda s: role_insights.role_insights(s, 4, P, **CHOSEN)["trend"]),
        sql('SELECT role_id, cohort, month, "start", partial, coalesce("count", 0) AS "count", coalesce(ai_count, 0) AS ai_count FROM cohort_n CROSS JOIN months LEFT JOIN chosen_months USING (role_id, month) WHERE role_id = 4', FILTERED),
    ),
    "c72_role_insights_market": (
        star_query(lambda s: role_insights.role_insights(s, 4, P, **CHOSEN)["market"]),
        sql(f"""SELECT role_id, "current", previous, {growth('"current"', 'previous')} AS postings_growth_pct FROM (SELECT role_id, coalesce(max("count") FILTER (WHERE month = 2), 0) AS "current", coalesce(max("count") FILTER (WHERE month = 1), 0) AS previous
            FROM cohort_n CROSS JOIN months LEFT JOIN chosen_months USING (role_id, month) WHERE role_id = 4 GROUP BY role_id)""", FILTERED),
    ),
    "c72_role_insights_ai": (
        star_query(lambda s: role_insights.role_insights(s, 4, P, **CHOSEN)["ai"]),
        sql(f"""SELECT role_id, ai_job_count, current_pct, delta_pct_points FROM (SELECT role_id, count(*) FILTER (WHERE id IN (SELECT job_id FROM ai)) AS ai_job_count, {pct('count(*) FILTER (WHERE id IN (SELECT job_id FROM ai))', 'count(*)')} AS current_pct FROM chosen WHERE is_active GROUP BY role_id)
            LEFT JOIN (SELECT role_id, round(max_by(share, month) - min_by(share, month), 1) AS delta_pct_points FROM (SELECT role_id, month, {pct('ai_count', '"count"')} AS share FROM chosen_months WHERE month < 3) GROUP BY role_id HAVING count(*) >= 2) USING (role_id)""", FILTERED),
    ),
    "c72_role_insights_coverage": (
        star_query(lambda s: role_insights.role_insights(s, 4, P, **CHOSEN)["coverage"]),
        sql(f"""SELECT CAST(4 AS BIGINT) AS role_id, (SELECT count(*) FROM cohort WHERE role_id = 4) AS cohort_companies, count(c.company_id) AS covered_jobs, {pct('count(c.company_id)', 'count(*)')} AS covered_pct
            FROM chosen a LEFT JOIN cohort c ON c.role_id = 4 AND c.company_id = a.company_id WHERE a.is_active""", FILTERED),
    ),
    "c74_sorted_skills": (
        star_query(lambda s: role_insights.sorted_skills(demand.skill_demand(s, P).filter("role_id = 2").drop("rank").join(demand.skill_growth(s, P).select("role_id", "skill_id", "growth_pct"), ["role_id", "skill_id"], "left"), "Technical", "growth_pct").select("skill_id", "growth_pct", "demand_pct")),
        sql("SELECT skill_id, growth_pct, demand_pct FROM ranked LEFT JOIN (" + SKILL_GROWTH + ") g USING (role_id, skill_id) WHERE role_id = 2 AND category = 'technical' AND rank <= 150", DEMAND),
    ),
    "m19_promotable": (
        star_query(lambda s: maintain.promotable(bridge(s).select("name").distinct().withColumn("status", F.when(F.col("name") < "new c", "approved").otherwise("pending")), bridge(s), 1000, 700)),
        sql("SELECT name, count(DISTINCT job_id) AS jobs, count(DISTINCT company_id) AS companies FROM b WHERE name >= 'new c' GROUP BY name HAVING count(DISTINCT job_id) >= 1000 AND count(DISTINCT company_id) >= 700", {"b": "SELECT 'new ' || s.name AS name, job_id, company_id FROM job_skills JOIN jobs j ON j.id = job_id JOIN skills s ON s.id = skill_id"}),
    ),
    "m20_promote": (
        star_query(lambda s: maintain.promote(s.skills, s.job_skills, bridge(s), bridge(s).select("name").distinct())[1]),
        sql(
            "SELECT job_id, skill_id, is_required FROM job_skills UNION ALL SELECT DISTINCT job_id, (SELECT max(id) FROM skills) + dense_rank() OVER (ORDER BY name), true FROM b",
            {"b": "SELECT 'new ' || s.name AS name, job_id, company_id FROM job_skills JOIN jobs j ON j.id = job_id JOIN skills s ON s.id = skill_id"},
        ),
    ),
    "m21_decided_jobs": (
        star_query(lambda s: maintain.apply_decisions(s.jobs.select("id", "title", "role_id"), s.jobs.filter("role_id is null").select(F.col("title").alias("raw_title")).distinct().withColumn("status", F.lit("pending")), reviewed(s), s.roles.select("id", "normalized_title"))[0]),
        sql("SELECT j.id, j.title, coalesce(j.role_id, r.id) AS role_id FROM jobs j LEFT JOIN decided d ON lower(d.raw_title) = lower(j.title) AND d.action <> 'reject' LEFT JOIN next_roles r ON lower(r.normalized_title) = lower(d.role_title)", DECIDED),
    ),
    "m21_decided_queue": (
        star_query(lambda s: maintain.apply_decisions(s.jobs.select("id", "title", "role_id"), s.jobs.filter("role_id is null").select(F.col("title").alias("raw_title")).distinct().withColumn("status", F.lit("pending")), reviewed(s), s.roles.select("id", "normalized_title"))[1]),
        sql("SELECT q.raw_title, CASE action WHEN 'reject' THEN 'rejected' WHEN 'map' THEN 'approved' WHEN 'new_role' THEN 'approved' ELSE 'pending' END AS status FROM (" + QUEUED + ") q LEFT JOIN decided USING (raw_title)", DECIDED),
    ),
    "m26_sync_companies": (
        star_query(lambda s: maintain.sync_companies(*(s.companies.filter(c).select(F.col("region").alias("ats"), F.col("id").cast("string").alias("slug"), "name", F.when(F.col("industry") == "BUILDING", "TBD").otherwise(F.col("industry")).alias("industry")) for c in ("id % 3 <> 1", "id % 2 = 1")))),
        sql("SELECT region AS ats, CAST(id AS VARCHAR) AS slug, name, CASE WHEN industry <> 'BUILDING' THEN industry WHEN id % 3 <> 1 THEN 'TBD' END AS industry FROM companies WHERE id % 3 <> 1 OR id % 2 = 1"),
    ),
    "m31_import_skills": (
        star_query(lambda s: maintain.import_skills(*(s.skills.filter(c).select((F.upper("name") if up else F.col("name")).alias("name"), "category", (F.col("id") * k).cast("int").alias("job_count"), F.when(F.col("id") % 3 == 0, F.array(F.lit(tag))).alias("aliases")) for c, up, k, tag in (("id < 40", False, 2, "old"), ("id >= 20", True, 3, "new"))))),
        sql(
            """SELECT CASE WHEN id < 40 THEN name ELSE upper(name) END AS name, category, CAST(id * CASE WHEN id >= 20 THEN 3 ELSE 2 END AS INT) AS job_count, CASE WHEN id % 3 = 0 THEN [CASE WHEN id < 40 THEN 'old' ELSE 'new' END] END AS aliases FROM skills"""
        ),
    ),
    "m33_shortlist": (
        star_query(lambda s: maintain.shortlist(candidates(s).withColumn("status", F.lit("pending")), s.skills.filter("id % 2 = 0").select(F.upper("name").alias("name"), "category"))),
        sql("SELECT s.category, k.name, company_count, job_count, row_number() OVER (PARTITION BY s.category ORDER BY company_count DESC, job_count DESC, k.name) AS rank FROM k JOIN skills s ON lower(s.name) = k.name WHERE s.id % 2 = 0", {"k": CANDIDATES.format(some='true')}),
    ),
    "m34_alias_conflicts": (
        star_query(lambda s: maintain.alias_conflicts(s.skills.join(s.skills.select((F.col("id") + 1).alias("id"), F.upper("name").alias("before")), "id", "left").withColumn("aliases", F.array("before", F.lit("own"))))),
        sql("SELECT a.id, upper(b.name) AS alias, b.id AS other_id FROM skills a JOIN skills b ON b.id = a.id - 1 WHERE b.is_verified"),
    ),
    "s08_new_skills": (
        star_query(
            lambda s: tables.new_skills(
                s.skills.groupBy("category", "subcategory").agg(F.collect_list(F.struct("name", F.col("id").cast("string").alias("external_id"))).alias("children")).groupBy("category").agg(F.collect_list(F.struct(F.col("subcategory").alias("name"), "children")).alias("children")).withColumnRenamed("category", "name"),
                s.skills.filter("id % 5 = 0").select(F.upper("name").alias("name")), skip_categories=["soft"], skip_pairs=[("domain", "Group 1")],
            )
        ),
        sql("SELECT name, category, subcategory, CAST(id AS VARCHAR) AS external_id FROM skills WHERE id % 5 <> 0 AND category <> 'soft' AND NOT (category = 'domain' AND subcategory = 'Group 1')"),
    ),
    "st6_live_postings": (star_query(lambda s: streams.live(s.jobs, P.as_of).select("id", "last_seen_at")), sql("SELECT id, last_seen_at FROM jobs WHERE closed_at IS NULL AND last_seen_at >= DATE '2001-04-16'")),
    "st2_since_last_run": (
        star_query(lambda s: streams.since_last_run(s.jobs.filter("id < 3").select(F.col("posted_at").alias("started_at"), F.when(F.col("is_active"), "completed").otherwise("failed").alias("status")), s.jobs.select("id", "scraped_at"), "scraped_at", P.as_of)),
        sql("SELECT id, scraped_at FROM jobs WHERE scraped_at > (SELECT max(posted_at) FROM jobs WHERE id < 3 AND is_active)"),
    ),
    "c37_next_weeks": (
        star_query(lambda s: week_snapshots.next_weeks(s, P)),
        sql("SELECT person_id, week_start, position_score FROM person_weeks WHERE (person_id, week_start) NOT IN (SELECT (person_id, DATE '2001-07-09') FROM position) UNION ALL SELECT person_id, DATE '2001-07-09', score FROM position", POSITION),
    ),
    "c37_week_snapshots": (
        star_query(lambda s: week_snapshots.snapshot(s, P)),
        sql(
            """SELECT person_id, DATE '2001-07-09' AS week_start, score AS position_score, coalesce(matches, 0) AS matches, best_job, drivers FROM position LEFT JOIN (SELECT person_id, max(total_count) AS matches, arg_min(job_id, rank) AS best_job FROM matches GROUP BY person_id) USING (person_id)
            LEFT JOIN (SELECT person_id, string_agg(text, '; ' ORDER BY rank) AS drivers FROM driven GROUP BY person_id) USING (person_id)""",
            {**POSITION, **MATCHES, **DRIVEN},
        ),
    ),
    "x41_weeks": (star_query(lambda s: s.jobs.groupBy(numbers.iso_week_start(F.col("posted_at")).alias("week")).agg(F.count(F.lit(1)).alias("n"))), sql("SELECT CAST(date_trunc('week', posted_at) AS DATE) AS week, count(*) AS n FROM jobs GROUP BY ALL")),
}


def queries() -> dict:
    return {name: run for name, (run, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in ENTRIES.items() if text}
