"""Demand and trend operators as queries over the given tables, each with SQL of its own."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from laborlens.operators import demand as d
from laborlens.operators import filters as f
from laborlens.operators import trends as t
from laborlens.params import Params
from laborlens.plans import role_insights
from laborlens.star import from_tables, sql

#: The smallest tables hold few postings a role: what must move is lower than the product's 30.
P = replace(Params(), min_abs_delta=5)
GROWTH = "CASE WHEN {b} = 0 THEN CASE WHEN {a} > 0 THEN 100.0 END ELSE round(({a} - {b}) / {b} * 100.0, 1) + 0.0 END"


def growth(a: str, b: str) -> str:
    return GROWTH.format(a=f"CAST({a} AS DOUBLE)", b=f"CAST({b} AS DOUBLE)")


def pct(a: str, b: str, n: int = 1) -> str:
    return f"round(100.0 * CAST({a} AS DOUBLE) / {b}, {n})"


ACTIVE = {"active": "SELECT * FROM jobs WHERE is_active AND role_id IS NOT NULL"}
ROLE_JOBS = {"role_jobs": "SELECT role_id, count(*) AS role_jobs FROM active GROUP BY role_id"}
DEMAND = {
    **ACTIVE,
    **ROLE_JOBS,
    "demand": """SELECT a.role_id, s.id AS skill_id, s.name, s.category, s.subcategory, count(*) AS job_count, count(*) FILTER (WHERE is_required) AS req
       FROM active a JOIN job_skills ON job_id = a.id JOIN skills s ON s.id = skill_id WHERE s.is_verified GROUP BY ALL""",
    "ranked": f"""SELECT d.*, {pct("job_count", "role_jobs")} AS demand_pct, row_number() OVER (PARTITION BY d.role_id ORDER BY job_count DESC, skill_id) AS rank
       FROM demand d JOIN role_jobs r USING (role_id)""",
}
AI = {"ai": "SELECT DISTINCT job_id FROM job_skills JOIN skills s ON s.id = skill_id WHERE is_verified AND subcategory = 'AI & Machine Learning'"}
MONTHS = {
    "months": """SELECT * FROM (VALUES (0, DATE '2001-04-01', DATE '2001-05-01', false), (1, DATE '2001-05-01', DATE '2001-06-01', false),
       (2, DATE '2001-06-01', DATE '2001-07-01', false), (3, DATE '2001-07-01', DATE '2001-07-16', true)) m(month, "start", stop, partial)""",
    "tracked": "SELECT company_id FROM jobs GROUP BY company_id HAVING min(scraped_at) <= DATE '2001-03-18'",
    "cohort": "SELECT DISTINCT role_id, company_id FROM jobs WHERE role_id IS NOT NULL AND company_id IN (SELECT company_id FROM tracked)",
    "monthly": """SELECT * FROM jobs JOIN months ON coalesce(posted_at, scraped_at) < stop AND (closed_at IS NULL OR closed_at >= "start")
       AND (closed_at IS NOT NULL OR last_seen_at >= stop - INTERVAL 90 DAY) WHERE company_id IN (SELECT company_id FROM tracked)""",
}
SERIES = {
    **MONTHS,
    **AI,
    "cohort_n": "SELECT role_id, count(*) AS cohort FROM cohort GROUP BY role_id HAVING count(*) >= 5",
    "counted": """SELECT role_id, month, count(*) AS stock, count(*) FILTER (WHERE coalesce(posted_at, scraped_at) >= "start") AS flow,
       count(*) FILTER (WHERE id IN (SELECT job_id FROM ai)) AS ai_count FROM monthly WHERE role_id IS NOT NULL GROUP BY role_id, month""",
    "series": """SELECT role_id, cohort, m.month, "start", partial, coalesce(stock, 0) AS stock, coalesce(flow, 0) AS flow, coalesce(ai_count, 0) AS ai_count
       FROM cohort_n CROSS JOIN months m LEFT JOIN counted USING (role_id, month)""",
}
QUALIFIED = {
    **ACTIVE,
    "own": "SELECT role_id, company_id, count(*) AS n FROM active GROUP BY role_id, company_id",
    "volume": "SELECT role_id, sum(n) AS active FROM own GROUP BY role_id",
    "shares": "SELECT role_id, max(n) / sum(n) AS share FROM own JOIN cohort USING (role_id, company_id) GROUP BY role_id",
    "sizes": "SELECT role_id, count(*) AS cohort FROM cohort GROUP BY role_id",
    "q0": """SELECT r.id AS role_id, coalesce(active, 0) AS active, coalesce(cohort, 0) AS cohort, coalesce(share, 1.0)::DOUBLE AS share
       FROM roles r LEFT JOIN volume v ON v.role_id = r.id LEFT JOIN sizes z ON z.role_id = r.id LEFT JOIN shares s ON s.role_id = r.id""",
    "qualification": """SELECT role_id, CAST(active AS BIGINT) AS active, cohort, round(share, 3) AS top_share, active >= 50 AND cohort >= 10 AND share <= 0.3 AS qualified,
       concat_ws(',', CASE WHEN active < 50 THEN 'volume' END, CASE WHEN cohort < 10 THEN 'breadth' END, CASE WHEN share > 0.3 THEN 'concentration' END) AS reasons,
       round(least(1.0, 0.4 * least(1.0, active::DOUBLE / 200.0) + 0.4 * least(1.0, cohort / 30.0) + 0.2 * greatest(0.0, least(1.0, 1 - share / 0.3))), 2) AS confidence FROM q0""",
}
MARKET = {
    "market": f"""SELECT first_stock, last_stock, {growth("last_stock", "first_stock")} AS growth, (SELECT count(*) FROM tracked) AS cohort FROM (
       SELECT count(*) FILTER (WHERE month = 0) AS first_stock, count(*) FILTER (WHERE month = 2) AS last_stock FROM monthly)"""
}
MOVERS = {
    **SERIES,
    **QUALIFIED,
    **MARKET,
    "at_ends": """SELECT role_id, cohort, min_by(stock, month) AS first_stock, max_by(stock, month) AS last_stock, min_by(flow, month) AS first_flow, max_by(flow, month) AS last_flow
       FROM series WHERE NOT partial GROUP BY role_id, cohort""",
    "movers": f"""SELECT e.role_id, r.normalized_title AS label, r.job_family AS sector, e.first_stock, e.last_stock, {growth("e.last_stock", "e.first_stock")} AS growth, e.cohort, q.confidence
       FROM at_ends e JOIN qualification q USING (role_id) JOIN roles r ON r.id = e.role_id
       WHERE q.qualified AND sign(last_stock - first_stock) = sign(last_flow - first_flow) AND abs(last_stock - first_stock) >= 5 AND NOT (first_stock = 0 AND last_stock = 0)""",
}
FAMILIES = [(1, "Odd"), (3, "Odd"), (5, "Odd"), (2, "Even"), (4, "Even")]
SKILL_MOVES = {
    **MONTHS,
    **ACTIVE,
    "totals": "SELECT count(*) FILTER (WHERE month = 0) AS t0, count(*) FILTER (WHERE month = 2) AS t2 FROM monthly",
    "per": """SELECT skill_id, company_id, month, count(*) AS n FROM monthly m JOIN job_skills js ON js.job_id = m.id GROUP BY ALL""",
    "known": """SELECT s.id AS skill_id, s.name AS label FROM skills s JOIN (SELECT skill_id, count(*) AS n FROM job_skills WHERE job_id IN (SELECT id FROM active) GROUP BY skill_id) v
       ON v.skill_id = s.id WHERE is_verified AND category IN ('technical', 'soft') AND n >= 50""",
    "moved": """SELECT skill_id, label, coalesce(sum(n) FILTER (WHERE month = 0), 0) AS c0, coalesce(sum(n) FILTER (WHERE month = 2), 0) AS c2,
       count(*) FILTER (WHERE month = 0) AS k0, count(*) FILTER (WHERE month = 2) AS k2, max(n) FILTER (WHERE month = 0) AS m0, max(n) FILTER (WHERE month = 2) AS m2
       FROM known JOIN per USING (skill_id) GROUP BY ALL""",
    "skill_movers": f"""SELECT skill_id, label, {growth("c2 / t2 * 100", "c0 / t0 * 100")} AS growth, CAST(c0 AS BIGINT) AS from_count, CAST(c2 AS BIGINT) AS to_count,
       round(c0 / t0 * 100, 2) AS from_share, round(c2 / t2 * 100, 2) AS to_share, k2 AS companies FROM moved CROSS JOIN totals
       WHERE c0 >= 20 AND t0 > 0 AND t2 > 0 AND abs(c2 / t2 * 100 - c0 / t0 * 100) >= 0.3 AND k0 >= 8 AND k2 >= 8 AND m0 / c0 <= 0.5 AND m2 / c2 <= 0.5""",
}


def top_list(table: str, by: str, name: str, keys: str, k: int) -> str:
    return f"SELECT {keys}, string_agg(CAST({by} AS VARCHAR), ',' ORDER BY n DESC, {by}) AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, {by}) AS rk FROM {table}) WHERE rk <= {k} GROUP BY {keys}"


def open_(start: str, stop: str) -> str:
    return f"(coalesce(posted_at, scraped_at) < DATE '{stop}' AND (closed_at IS NULL OR closed_at >= DATE '{start}'))"


NOW, BEFORE = open_("2001-06-15", "2001-07-15"), open_("2001-05-16", "2001-06-15")

HIRING = {
    **ACTIVE,
    "hiring": f"""SELECT role_id, company_id, job_count, rank, name, industry, n_companies, growth_pct FROM (
            SELECT *, row_number() OVER (PARTITION BY role_id ORDER BY job_count DESC, company_id) AS rank, count(*) OVER (PARTITION BY role_id) AS n_companies FROM (SELECT role_id, company_id, count(*) AS job_count FROM active GROUP BY role_id, company_id))
            JOIN companies c ON c.id = company_id LEFT JOIN (
            SELECT role_id, company_id, CASE WHEN n_before >= greatest(3, floor(max(n_before) OVER (PARTITION BY role_id) * 0.01)) THEN {growth('n_now', 'n_before')} END AS growth_pct FROM (
            SELECT role_id, company_id, count(*) FILTER (WHERE {NOW}) AS n_now, count(*) FILTER (WHERE {BEFORE}) AS n_before FROM jobs WHERE role_id IS NOT NULL AND ({NOW} OR {BEFORE}) GROUP BY role_id, company_id)) USING (role_id, company_id) WHERE rank <= 100""",
}
INTRINSIC = {
    **DEMAND,
    **SERIES,
    **HIRING,
    "goes": "SELECT DISTINCT r.id AS role_id, s.id AS skill_id FROM roles r JOIN skills s ON lower(s.name) = 'small ring' OR s.id % 10 = r.id",
    "plain_skills": "SELECT k.*, g.skill_id IS NULL AS plain, k.subcategory = 'AI & Machine Learning' AS ai FROM ranked k LEFT JOIN goes g ON g.role_id = k.role_id AND g.skill_id = k.skill_id WHERE k.rank <= 150",
    "surge": "SELECT role_id, arg_max(company_id, (growth_pct, -rank)) AS surging_company, max(growth_pct) AS surge_pct FROM hiring WHERE growth_pct >= {least} GROUP BY role_id",
}


def intrinsic(s):
    """A listed skill goes without saying for every role, and every tenth for each."""
    pairs = s.roles.select(F.col("id").alias("role_id")).join(s.skills.select(F.col("id").alias("skill_id"), "name"), (F.lower("name") == "small ring") | (F.col("skill_id") % 10 == F.col("role_id")))
    return pairs.select("role_id", "skill_id")


FAMILY_MOVES = {
    **SERIES,
    **ACTIVE,
    "fam": "SELECT * FROM (VALUES (1, 'Odd'), (3, 'Odd'), (5, 'Odd'), (2, 'Even'), (4, 'Even')) f(role_id, family)",
    "family_movers": f"""SELECT family, sector, first_stock, last_stock, {growth('last_stock', 'first_stock')} AS growth, cohort, round(least(1.0, cohort / 30.0), 2) AS confidence FROM (
            SELECT family, CAST(sum(stock) FILTER (WHERE month = 0) AS BIGINT) AS first_stock, CAST(sum(stock) FILTER (WHERE month = 2) AS BIGINT) AS last_stock, sum(flow) FILTER (WHERE month = 0) AS f0, sum(flow) FILTER (WHERE month = 2) AS f2 FROM series JOIN fam USING (role_id) GROUP BY family)
            JOIN (SELECT family, count(DISTINCT company_id) AS cohort FROM cohort JOIN fam USING (role_id) GROUP BY family HAVING count(DISTINCT company_id) >= 10) USING (family)
            JOIN (SELECT family, arg_max(sector, (n, sector)) AS sector FROM (SELECT family, job_family AS sector, count(*) AS n FROM active a JOIN fam USING (role_id) JOIN roles r ON r.id = a.role_id GROUP BY ALL) GROUP BY family) USING (family)
            WHERE sign(last_stock - first_stock) = sign(f2 - f0) AND abs(last_stock - first_stock) >= 5""",
}


ENTRIES: dict[str, tuple] = {
    "c01_skill_demand": (lambda s: d.skill_demand(s, P), sql(f"SELECT role_id, skill_id, name, category, job_count, demand_pct, {pct('req', 'job_count', 0)} AS required_pct, {pct('job_count - req', 'job_count', 0)} AS preferred_pct, rank FROM ranked WHERE rank <= 150", DEMAND)),
    "c02_skill_growth": (
        lambda s: d.skill_growth(s, P),
        sql(
            f"""SELECT role_id, skill_id, n_now, n_before, CASE WHEN n_before >= 5 AND t_now > 0 THEN {growth('n_now / t_now * 100', 'n_before / t_before * 100')} END AS growth_pct FROM (
            SELECT role_id, skill_id, count(*) FILTER (WHERE {NOW}) AS n_now, count(*) FILTER (WHERE {BEFORE}) AS n_before FROM jobs JOIN job_skills ON job_id = id
            WHERE role_id IS NOT NULL AND ({NOW} OR {BEFORE}) GROUP BY role_id, skill_id) JOIN (
            SELECT role_id, count(*) FILTER (WHERE {NOW}) AS t_now, count(*) FILTER (WHERE {BEFORE}) AS t_before FROM jobs WHERE role_id IS NOT NULL GROUP BY role_id) USING (role_id)"""
        ),
    ),
    "c03_company_growth": (
        lambda s: d.company_growth(s, P),
        sql(
            f"""SELECT role_id, company_id, n_now, n_before, CASE WHEN n_before >= greatest(3, floor(max(n_before) OVER (PARTITION BY role_id) * 0.01)) THEN {growth('n_now', 'n_before')} END AS growth_pct FROM (
            SELECT role_id, company_id, count(*) FILTER (WHERE {NOW}) AS n_now, count(*) FILTER (WHERE {BEFORE}) AS n_before FROM jobs WHERE role_id IS NOT NULL AND ({NOW} OR {BEFORE}) GROUP BY role_id, company_id)"""
        ),
    ),
    "c04_role_growth": (
        lambda s: d.role_growth(s, P),
        sql(f"SELECT *, {growth('n_now', 'n_before')} AS growth_pct FROM (SELECT role_id, count(*) FILTER (WHERE {open_('2001-06-01', '2001-07-01')}) AS n_now, count(*) FILTER (WHERE {open_('2001-05-01', '2001-06-01')}) AS n_before FROM jobs WHERE role_id IS NOT NULL GROUP BY role_id)"),
    ),
    "c05_role_salaries": (lambda s: d.role_salaries(s), sql("SELECT role_id, CAST(trunc(avg(salary_min_usd)) AS INT) AS avg_min, CAST(trunc(avg(salary_max_usd)) AS INT) AS avg_max, count(*) AS n FROM active WHERE salary_min_usd > 0 GROUP BY role_id", ACTIVE)),
    "c06_salary_band": (
        lambda s: d.salary_band(s, P),
        sql(
            f"""SELECT role_id, n, CASE WHEN n >= 30 THEN lo[least(CAST(floor(n * 0.25) AS INT), n - 1) + 1] END AS band_low, CASE WHEN n >= 30 THEN hi[least(CAST(floor(n * 0.75) AS INT), n - 1) + 1] END AS band_high,
            CASE WHEN n >= 30 THEN lo[least(CAST(floor(n * 0.5) AS INT), n - 1) + 1] END AS median, {pct('n', 'all_')} AS coverage_pct FROM (
            SELECT role_id, count(*) AS all_, count(*) FILTER (WHERE salary_min_usd > 0) AS n, list_sort(list(salary_min_usd) FILTER (WHERE salary_min_usd > 0)) AS lo, list_sort(list(salary_max_usd) FILTER (WHERE salary_min_usd > 0)) AS hi FROM active GROUP BY role_id)""",
            ACTIVE,
        ),
    ),
    "c07_cohorts": (lambda s: t.cohorts(s, P), sql("SELECT role_id, company_id FROM cohort", MONTHS)),
    "c08_role_trend": (lambda s: t.role_trend(s, P), sql('SELECT role_id, cohort, month, "start", partial, stock AS "count", ai_count FROM series', SERIES)),
    "c09_market_trend": (lambda s: t.market_trend(s, P), sql(f"SELECT role_id, \"current\", previous, {growth('\"current\"', 'previous')} AS postings_growth_pct FROM (SELECT role_id, max(stock) FILTER (WHERE month = 2) AS \"current\", max(stock) FILTER (WHERE month = 1) AS previous FROM series GROUP BY role_id)", SERIES)),
    "c10_ai_exposure": (
        lambda s: t.ai_exposure(s, P),
        sql(
            f"""SELECT role_id, ai_job_count, current_pct, delta_pct_points FROM (
            SELECT role_id, count(*) FILTER (WHERE id IN (SELECT job_id FROM ai)) AS ai_job_count, {pct('count(*) FILTER (WHERE id IN (SELECT job_id FROM ai))', 'count(*)')} AS current_pct FROM active GROUP BY role_id) LEFT JOIN (
            SELECT role_id, round(max_by(share, month) - min_by(share, month), 1) AS delta_pct_points FROM (SELECT role_id, month, {pct('ai_count', 'stock')} AS share FROM series WHERE stock > 0 AND NOT partial) GROUP BY role_id HAVING count(*) >= 2) USING (role_id)""",
            {**SERIES, **ACTIVE},
        ),
    ),
    "c11_trend_coverage": (
        lambda s: t.trend_coverage(s, P),
        sql(
            f"""SELECT a.role_id, coalesce(any_value(n), 0) AS cohort_companies, count(c.company_id) AS covered_jobs, {pct('count(c.company_id)', 'count(*)')} AS covered_pct
            FROM active a LEFT JOIN cohort c ON a.role_id = c.role_id AND a.company_id = c.company_id LEFT JOIN (SELECT role_id, count(*) AS n FROM cohort GROUP BY role_id) z ON z.role_id = a.role_id GROUP BY a.role_id""",
            {**MONTHS, **ACTIVE},
        ),
    ),
    "c12_hiring_companies": (lambda s: d.hiring_companies(s, P), sql("SELECT * FROM hiring", HIRING)),
    "c13_companies_of_skills": (
        lambda s: d.companies_of_skills(s),
        sql("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY role_id, skill_id ORDER BY job_count DESC, company_id) AS rank FROM (SELECT role_id, skill_id, company_id, count(*) AS job_count FROM active a JOIN job_skills ON job_id = a.id JOIN skills s ON s.id = skill_id WHERE s.is_verified GROUP BY ALL)) WHERE rank <= 10", ACTIVE),
    ),
    "c14_remote_split": (lambda s: d.remote_split(s), sql("SELECT role_id, count(*) FILTER (WHERE location_is_remote) AS remote, count(*) FILTER (WHERE NOT location_is_remote) AS onsite FROM active GROUP BY role_id", ACTIVE)),
    "c17_role_cards": (
        lambda s: d.role_cards(s, P, callouts=[("Small Ring", "Africa"), ("red widget", "america"), ("blue bolt", "AMERICA"), ("large gear", "asia"), ("small bolt", "africa"), ("red gear", "europe"), ("blue ring", "middle east")], within=30, k=30),
        sql(
            """SELECT r.role_id, rank, skill_id, pct, c.name AS callout, c.rank_ AS callout_rank, c.pct_ AS callout_pct FROM (SELECT *, least(round(demand_pct, 0), 100.0) AS pct FROM ranked WHERE rank <= 30) r LEFT JOIN (
            SELECT role_id, arg_min(k.name, rule) AS name, arg_min(k.rank, rule) AS rank_, arg_min(least(round(k.demand_pct, 0), 100.0), rule) AS pct_ FROM ranked k JOIN roles o ON o.id = k.role_id
            JOIN (VALUES (0, 'small ring', 'africa'), (1, 'red widget', 'america'), (2, 'blue bolt', 'america'), (3, 'large gear', 'asia'), (4, 'small bolt', 'africa'), (5, 'red gear', 'europe'), (6, 'blue ring', 'middle east')) c(rule, n, cat) ON lower(k.name) = n AND lower(o.category) = cat
            WHERE k.rank <= 30 GROUP BY role_id) c ON c.role_id = r.role_id""",
            DEMAND,
        ),
    ),
    "c18_role_details": (lambda s: d.role_details(s), sql("SELECT r.*, (SELECT count(*) FROM active a WHERE a.role_id = r.id) AS active_jobs FROM roles r", ACTIVE)),
    "c23_available_roles": (lambda s: d.available_roles(s, 925), sql("SELECT r.*, n AS active_jobs FROM roles r JOIN (SELECT role_id, count(*) AS n FROM active GROUP BY role_id HAVING count(*) >= 925) a ON a.role_id = r.id", ACTIVE)),
    "c24_skill_directory": (lambda s: d.skill_directory(s), sql("SELECT category, count(*) AS n, string_agg(name, ', ' ORDER BY name) AS names FROM skills WHERE is_verified GROUP BY category")),
    "c25_skill_detail": (
        lambda s: d.skill_detail(s),
        sql(
            "SELECT skill_id, total_jobs, top_roles, top_companies FROM (SELECT skill_id, count(*) AS total_jobs FROM tagged GROUP BY skill_id) JOIN by_role USING (skill_id) JOIN by_company USING (skill_id)",
            {**ACTIVE, "tagged": "SELECT * FROM active JOIN job_skills ON job_id = id", "nr": "SELECT skill_id, role_id, count(*) AS n FROM tagged GROUP BY ALL", "nc": "SELECT skill_id, company_id, count(*) AS n FROM tagged GROUP BY ALL", "by_role": top_list("nr", "role_id", "top_roles", "skill_id", 5), "by_company": top_list("nc", "company_id", "top_companies", "skill_id", 5)},
        ),
    ),
    "c26_co_occurrence": (
        lambda s: d.co_occurrence(s),
        sql(
            f"""SELECT role_id, skill_id, other_id, both_ AS both, pct, base_pct, row_number() OVER (PARTITION BY role_id, skill_id ORDER BY both_ DESC, other_id) AS rank FROM (
            SELECT p.role_id, p.skill_id, other_id, both_, {pct('both_', 'n.n')} AS pct, {pct('o.n', 'role_jobs')} AS base_pct FROM (
              SELECT *, row_number() OVER (PARTITION BY role_id, skill_id ORDER BY both_ DESC, other_id) AS rk FROM (
                SELECT a.role_id, a.skill_id, b.skill_id AS other_id, count(*) AS both_ FROM tagged a JOIN tagged b ON a.job_id = b.job_id AND a.skill_id <> b.skill_id GROUP BY ALL)
                WHERE (role_id, skill_id) IN (SELECT (role_id, skill_id) FROM n WHERE n >= 5)) p
            JOIN n ON n.role_id = p.role_id AND n.skill_id = p.skill_id JOIN n o ON o.role_id = p.role_id AND o.skill_id = other_id JOIN role_jobs r ON r.role_id = p.role_id WHERE rk <= 30)
            WHERE base_pct <= 60 QUALIFY rank <= 8""",
            {**ACTIVE, **ROLE_JOBS, "tagged": "SELECT role_id, job_id, skill_id FROM active a JOIN job_skills ON job_id = a.id JOIN skills s ON s.id = skill_id WHERE s.is_verified", "n": "SELECT role_id, skill_id, count(*) AS n FROM tagged GROUP BY ALL"},
        ),
    ),
    "c27_companies": (lambda s: d.companies(s, 0), sql("SELECT c.id, c.name, c.industry, count(j.id) AS job_count FROM companies c LEFT JOIN jobs j ON j.company_id = c.id AND j.is_active WHERE c.is_active GROUP BY ALL")),
    "c28_company_roles": (
        lambda s: d.company_roles(s),
        sql("SELECT company_id, role_id, n, rank, active_jobs FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY n DESC, role_id) AS rank FROM (SELECT company_id, role_id, count(*) AS n FROM active GROUP BY ALL)) JOIN (SELECT company_id, count(*) AS active_jobs FROM jobs WHERE is_active GROUP BY company_id) USING (company_id) WHERE rank <= 10", ACTIVE),
    ),
    "c29_company_skill_demand": (
        lambda s: d.company_skill_demand(s, 3),
        sql(
            f"""SELECT company_id, skill_id, n, {pct('n', 'jobs')} AS pct, rank FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY n DESC, skill_id) AS rank FROM (SELECT company_id, skill_id, count(*) AS n FROM active a JOIN job_skills ON job_id = a.id WHERE role_id = 3 GROUP BY ALL))
            JOIN (SELECT company_id, count(*) AS jobs FROM active WHERE role_id = 3 GROUP BY company_id) USING (company_id) WHERE rank <= 20""",
            ACTIVE,
        ),
    ),
    "c31_job_stats": (
        lambda s: d.job_stats(s),
        sql("SELECT 'total' AS kind, 'all' AS label, count(*) AS n FROM jobs WHERE is_active UNION ALL SELECT 'seniority', coalesce(seniority_level, 'none'), count(*) FROM jobs WHERE is_active GROUP BY ALL UNION ALL SELECT * FROM (SELECT 'city', trim(string_split(location_raw, ',')[1]) AS city, count(*) AS n FROM jobs WHERE is_active AND NOT location_is_remote GROUP BY ALL ORDER BY n DESC, city LIMIT 10)"),
    ),
    "c32_companies_with_jobs": (lambda s: d.companies(s, 1), sql("SELECT c.id, c.name, c.industry, count(*) AS job_count FROM companies c JOIN jobs j ON j.company_id = c.id WHERE j.is_active AND c.is_active GROUP BY ALL")),
    "c33_role_pages": (
        lambda s: d.role_pages(s, P),
        sql(
            f"""SELECT a.role_id, count(*) AS jobs, count(DISTINCT company_id) AS companies, {pct('count(*) FILTER (WHERE a.id IN (SELECT job_id FROM ai))', 'count(*)', 0)} AS ai_pct, {pct('count(*) FILTER (WHERE location_is_remote)', 'count(*)', 0)} AS remote_pct,
            any_value(top_skills) AS top_skills, any_value(top_companies) AS top_companies FROM active a LEFT JOIN best_skills b ON b.role_id = a.role_id LEFT JOIN best_companies k ON k.role_id = a.role_id GROUP BY a.role_id""",
            {**DEMAND, **AI, "ns": "SELECT role_id, skill_id, job_count AS n FROM demand", "nc": "SELECT role_id, company_id, count(*) AS n FROM active GROUP BY ALL", "best_skills": top_list("ns", "skill_id", "top_skills", "role_id", 12), "best_companies": top_list("nc", "company_id", "top_companies", "role_id", 6)},
        ),
    ),
    "c34_role_index": (lambda s: d.role_index(s, P), sql("SELECT r.id, normalized_title, count(*) AS active_jobs FROM roles r JOIN active a ON a.role_id = r.id GROUP BY ALL HAVING count(*) >= 30", ACTIVE)),
    "c44_qualification": (lambda s: t.qualification(s, P), sql("SELECT * FROM qualification", {**MONTHS, **QUALIFIED})),
    "c46_sectors": (lambda s: t.sectors(s, P), sql("SELECT job_family AS sector, CAST(sum(n) AS BIGINT) AS active, count(*) AS roles, count(*) FILTER (WHERE n >= 50) AS qualified_roles FROM (SELECT r.job_family, r.id, count(a.id) AS n FROM roles r LEFT JOIN active a ON a.role_id = r.id GROUP BY ALL) GROUP BY job_family", ACTIVE)),
    "c47_skill_weeks": (
        lambda s: d.skill_weeks(s),
        sql("SELECT skill_id, role_id, CAST(date_trunc('week', coalesce(posted_at, scraped_at)) AS DATE) AS period_date, count(*) AS job_count, count(*) FILTER (WHERE is_required) AS required_count, count(DISTINCT company_id) AS company_count, avg(salary_min_usd) AS avg_salary_min, avg(salary_max_usd) AS avg_salary_max FROM jobs JOIN job_skills ON job_id = id WHERE role_id IS NOT NULL GROUP BY ALL"),
    ),
    "c48_stock_and_flow": (lambda s: t.stock_and_flow(s, P), sql('SELECT role_id, cohort, month, "start", partial, stock, flow FROM series', SERIES)),
    "c49_role_movers": (lambda s: t.role_movers(s, P), sql("SELECT m.role_id, label, sector, m.first_stock, m.last_stock, m.growth, round(m.growth - k.growth, 1) AS vs_market, m.cohort, confidence FROM movers m CROSS JOIN market k", MOVERS)),
    "c50_family_movers": (lambda s: t.family_movers(s, s.jobs.sparkSession.createDataFrame(FAMILIES, "role_id long, family string"), P), sql("SELECT * FROM family_movers", FAMILY_MOVES)),
    "c51_boards": (
        lambda s: t.boards(t.role_movers(s, P), replace(P, sector_min=1)),
        sql(
            """SELECT kind, scope, rank, label, sector, growth FROM (
            SELECT CASE WHEN growth > 0 THEN 'rising_role' ELSE 'declining_role' END AS kind, scope, label, sector, growth, row_number() OVER (PARTITION BY scope, growth > 0 ORDER BY abs(growth) DESC, label) AS rank
            FROM (SELECT *, 'overall' AS scope FROM movers UNION ALL SELECT *, sector AS scope FROM movers) WHERE growth <> 0) WHERE rank <= 10""",
            MOVERS,
        ),
    ),
    "c52_in_demand_roles": (
        lambda s: t.in_demand_roles(s, P),
        sql("SELECT role_id, active AS n, confidence, trend FROM qualification JOIN (SELECT role_id, string_agg(CAST(stock AS VARCHAR), ',' ORDER BY month) AS trend FROM series WHERE NOT partial GROUP BY role_id) USING (role_id) WHERE qualified ORDER BY active DESC, role_id LIMIT 10", {**SERIES, **QUALIFIED}),
    ),
    "c54_skill_months": (lambda s: t.skill_months(s, P), sql('SELECT skill_id, month, partial, count(DISTINCT id) AS "count" FROM monthly JOIN job_skills ON job_id = id GROUP BY ALL', MONTHS)),
    "c55_concentration": (lambda s: t.concentration(s, P), sql("SELECT skill_id, month, count(*) AS companies, max(n) / sum(n) AS top_share FROM per GROUP BY ALL", SKILL_MOVES)),
    "c56_skill_movers": (lambda s: t.skill_movers(s, P), sql("SELECT * FROM skill_movers", SKILL_MOVES)),
    "c57_skill_boards": (
        lambda s: t.skill_boards(t.skill_movers(s, P), P),
        sql("SELECT kind, rank, skill_id, label, growth FROM (SELECT CASE WHEN growth > 0 THEN 'rising_skill' ELSE 'falling_skill' END AS kind, skill_id, label, growth, row_number() OVER (PARTITION BY growth > 0 ORDER BY abs(growth) DESC, skill_id) AS rank FROM skill_movers WHERE growth <> 0) WHERE rank <= 10", SKILL_MOVES),
    ),
    "c58_market_summary": (lambda s: t.market_summary(s, P), sql("SELECT * FROM market", {**MONTHS, **MARKET})),
    "c73_role_verdicts": (
        lambda s: d.role_verdicts(s, intrinsic(s), P, 600),
        sql(
            f"""SELECT k.role_id, coalesce(string_agg(CAST(skill_id AS VARCHAR), ',' ORDER BY rank) FILTER (WHERE ai AND ar <= 4), '') AS top_ai_skills,
            coalesce(arg_min(skill_id, rank) FILTER (WHERE plain AND demand_pct >= 40 AND demand_pct < 95), arg_min(skill_id, rank) FILTER (WHERE plain), arg_min(skill_id, rank)) AS leverage_skill, any_value(surging_company) AS surging_company, any_value(surge_pct) AS surge_pct,
            any_value(CASE WHEN coalesce(covered, 0) >= 600 THEN round(g, 0) + 0.0 END) AS growth, any_value(CASE WHEN coalesce(covered, 0) < 600 THEN 'building history' WHEN round(g, 0) > 0 THEN 'growing' WHEN round(g, 0) < 0 THEN 'cooling' ELSE 'steady' END) AS verdict
            FROM (SELECT *, row_number() OVER (PARTITION BY role_id, ai ORDER BY rank) AS ar FROM plain_skills) k LEFT JOIN surge s ON s.role_id = k.role_id LEFT JOIN (SELECT role_id, count(*) AS covered FROM active JOIN cohort USING (role_id, company_id) GROUP BY role_id) c ON c.role_id = k.role_id
            LEFT JOIN (SELECT role_id, {growth('max(stock) FILTER (WHERE month = 2)', 'max(stock) FILTER (WHERE month = 1)')} AS g FROM series GROUP BY role_id) t ON t.role_id = k.role_id GROUP BY k.role_id""",
            {**INTRINSIC, "surge": INTRINSIC["surge"].format(least=100)},
        ),
    ),
    "c73_person_verdicts": (
        lambda s: d.person_verdicts(s, intrinsic(s), P),
        sql(
            """SELECT p.person_id, round(count(*) FILTER (WHERE rank <= 15 AND h.skill_id IS NOT NULL) / count(*) FILTER (WHERE rank <= 15) * 100, 0) AS coverage_pct, arg_min(k.skill_id, rank) FILTER (WHERE h.skill_id IS NULL AND plain) AS gap_skill
            FROM persons p JOIN plain_skills k ON k.role_id = p.target_role_id LEFT JOIN hs h ON h.person_id = p.person_id AND h.skill_id = k.skill_id WHERE p.person_id IN (SELECT person_id FROM hs) GROUP BY p.person_id""",
            {**INTRINSIC, "surge": "SELECT 1", "hs": "SELECT DISTINCT person_id, skill_id FROM person_skills WHERE status = 'have'"},
        ),
    ),
    "c74_sorted_employers": (
        lambda s: role_insights.sorted_employers(d.hiring_companies(s, P).filter("role_id = 2"), "Building", "growth_pct").select("company_id", "job_count", "growth_pct"),
        sql("SELECT company_id, job_count, growth_pct FROM hiring WHERE role_id = 2 AND industry = 'BUILDING'", HIRING),
    ),
    "f02_seniority_bucket": (lambda s: s.jobs.filter(f.seniority("lead")).groupBy("seniority_level").agg(F.count(F.lit(1)).alias("n")), sql("SELECT seniority_level, count(*) AS n FROM jobs WHERE lower(seniority_level) IN ('lead', 'principal', 'staff', 'director', 'head', 'iv', '4', '5') GROUP BY ALL")),
    "f04_place": (lambda s: s.jobs.filter(f.place(["nation_1"])).select("id", "location_raw"), sql("SELECT id, location_raw FROM jobs WHERE lower(location_country) = 'nation_1' OR location_raw ILIKE '%nation_1%'")),
    "f05_near_or_remote": (lambda s: s.jobs.filter(f.near_or_remote("City NATION_2")).select("id"), sql("SELECT id FROM jobs WHERE location_is_remote OR location_raw ILIKE '%city nation_2%'")),
    "f06_industry": (lambda s: f.by_industry(s.jobs, s, ["BUILDING", "MACHINERY"]).select("id", "company_id"), sql("SELECT id, company_id FROM jobs WHERE company_id IN (SELECT id FROM companies WHERE is_active AND industry IN ('BUILDING', 'MACHINERY'))")),
    "f11_search": (lambda s: f.search(s.jobs, "senior nation_4", "NATION_4").select("id", "title"), sql("SELECT id, title FROM jobs WHERE is_active AND title ILIKE '%senior nation_4%' AND (location_is_remote OR location_raw ILIKE '%nation_4%') ORDER BY posted_at DESC, id LIMIT 50")),
    "f12_ai_postings": (lambda s: f.active(s).join(f.with_ai(s, P.ai_subcategory), F.col("id") == F.col("job_id"), "left_semi").select("id", "role_id"), sql("SELECT id, role_id FROM active WHERE id IN (SELECT job_id FROM ai)", {**ACTIVE, **AI})),
    "f16_industries": (lambda s: d.industries(s), sql("SELECT DISTINCT industry FROM companies WHERE is_active AND industry IS NOT NULL")),
}


def queries() -> dict:
    return {name: (lambda spark, sf_dir, run=run: run(from_tables(spark, sf_dir))) for name, (run, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in ENTRIES.items() if text}
