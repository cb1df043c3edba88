"""Snapshot, matching and scoring operators as queries over the given tables, each with SQL of its own."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from laborlens.catalog_demand import ACTIVE, AI, BEFORE, DEMAND, HIRING, NOW, P, ROLE_JOBS, SERIES, growth, pct
from laborlens.operators import people as h
from laborlens.operators import snapshot as n
from laborlens.star import Star, from_tables, sql

HAVE = {"have": "SELECT person_id, skill_id FROM person_skills WHERE status = 'have'"}
RECENT = "posted_at >= DATE '2001-07-01' AND posted_at <= DATE '2001-07-15'"
EARLIER = "posted_at >= DATE '2001-05-02' AND posted_at < DATE '2001-07-01'"
SHARES = {
    "counted": f"SELECT role_id, count(*) FILTER (WHERE {RECENT}) AS recent_n, count(*) FILTER (WHERE {EARLIER}) AS base_n FROM jobs WHERE {RECENT} OR {EARLIER} GROUP BY role_id",
    "totals": "SELECT sum(recent_n) AS rt, sum(base_n) AS bt FROM counted",
    "role_shares": """SELECT role_id, recent_n, base_n, round(100.0 * recent_n::DOUBLE / rt, 2) AS recent_pct, round(100.0 * base_n::DOUBLE / bt, 2) AS base_pct,
       (100.0 * recent_n::DOUBLE / rt) / (100.0 * greatest(base_n, 1)::DOUBLE / bt) AS ratio FROM counted CROSS JOIN totals WHERE role_id IS NOT NULL""",
}
MATCHES = {
    **ACTIVE,
    **HAVE,
    "tags": "SELECT a.role_id, a.id AS job_id, posted_at, skill_id FROM active a JOIN job_skills js ON js.job_id = a.id JOIN skills s ON s.id = skill_id WHERE s.is_verified",
    "totals": "SELECT job_id, count(*) AS total_skills FROM tags GROUP BY job_id HAVING count(*) >= 3",
    "scored": """SELECT p.person_id, t.job_id, any_value(posted_at) AS posted_at, any_value(total_skills) AS total_skills, count(*) AS matched FROM persons p JOIN tags t ON t.role_id = p.target_role_id
       JOIN have h ON h.person_id = p.person_id AND h.skill_id = t.skill_id JOIN totals o ON o.job_id = t.job_id GROUP BY ALL HAVING count(*) >= 0.6 * any_value(total_skills)""",
    "matches": """SELECT person_id, job_id, row_number() OVER (PARTITION BY person_id ORDER BY round(matched / total_skills, 4) DESC, posted_at DESC NULLS LAST, job_id) AS rank, total_skills, matched, round(matched / total_skills, 4) AS match_pct,
       posted_at >= DATE '2001-07-08' AS is_new, count(*) OVER (PARTITION BY person_id) AS total_count, count(*) FILTER (WHERE posted_at >= DATE '2001-07-08') OVER (PARTITION BY person_id) AS new_count FROM scored QUALIFY rank <= 50""",
}
NEEDS = {
    **ACTIVE,
    **ROLE_JOBS,
    "needs": f"""SELECT q.*, {pct('job_count', 'role_jobs')} AS demand, row_number() OVER (PARTITION BY role_id ORDER BY job_count DESC, skill_id) AS rank FROM (
       SELECT role_id, s.id AS skill_id, s.category, count(*) AS job_count FROM active a JOIN job_skills js ON js.job_id = a.id JOIN skills s ON s.id = skill_id GROUP BY ALL) q JOIN role_jobs USING (role_id)""",
    "owned": "SELECT DISTINCT person_id, skill_id FROM person_skills",
    "gap": """SELECT p.person_id, r.role_id, r.skill_id, r.category, demand, job_count, rank, CASE WHEN demand >= 40 THEN 'high' WHEN demand >= 20 THEN 'medium' ELSE 'low' END AS priority,
       CASE WHEN o.skill_id IS NULL THEN 'missing' ELSE 'have' END AS status FROM persons p JOIN needs r ON r.role_id = p.target_role_id LEFT JOIN owned o ON o.person_id = p.person_id AND o.skill_id = r.skill_id""",
    "gap_heads": f"""SELECT person_id, {pct("sum(CASE WHEN rank <= 15 AND status = 'have' THEN demand ELSE 0 END)", "sum(CASE WHEN rank <= 15 THEN demand END)")} AS match_score, count(*) FILTER (WHERE status = 'have') AS skills_matched,
       count(*) FILTER (WHERE status <> 'have' AND priority <> 'low') AS skills_to_learn FROM gap GROUP BY person_id""",
}
FEW_NEEDS = {**NEEDS, "active": "SELECT * FROM jobs WHERE is_active AND role_id IS NOT NULL AND lower(seniority_level) = 'lead' AND (contains(lower(location_raw), 'nation_3') OR location_is_remote)"}


def with_few(s):
    """A third of the roles with postings of one level and remote ones only, a third without remote ones."""
    remote, third = F.col("location_is_remote"), F.col("role_id") % 3
    return replace(s, jobs=s.jobs.filter((third == 0) | (remote & (third == 1) & (F.col("seniority_level") == "mid")) | ((third == 2) & ~remote)))


SKILL_GROWTH = f"""SELECT role_id, skill_id, CASE WHEN n_before >= 5 AND t_now > 0 THEN {growth('n_now / t_now * 100', 'n_before / t_before * 100')} END AS growth_pct FROM (
   SELECT role_id, skill_id, count(*) FILTER (WHERE {NOW}) AS n_now, count(*) FILTER (WHERE {BEFORE}) AS n_before FROM jobs JOIN job_skills ON job_id = id WHERE role_id IS NOT NULL AND ({NOW} OR {BEFORE}) GROUP BY role_id, skill_id) JOIN (
   SELECT role_id, count(*) FILTER (WHERE {NOW}) AS t_now, count(*) FILTER (WHERE {BEFORE}) AS t_before FROM jobs WHERE role_id IS NOT NULL GROUP BY role_id) USING (role_id)"""
PER_ROLE = {**ACTIVE, **ROLE_JOBS, "rs": "SELECT role_id, skill_id, count(*) AS n FROM active a JOIN job_skills ON job_id = a.id GROUP BY ALL"}
EXPOSURE = {
    **SERIES,
    **DEMAND,
    "trend": f"SELECT role_id, {growth('max(stock) FILTER (WHERE month = 2)', 'max(stock) FILTER (WHERE month = 1)')} AS growth FROM series GROUP BY role_id",
    "ai_now": f"SELECT role_id, {pct('count(*) FILTER (WHERE id IN (SELECT job_id FROM ai))', 'count(*)')} AS ai_pct FROM active GROUP BY role_id",
}
HISTORY = {
    "ranked_weeks": "SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY week_start DESC) AS n FROM person_weeks",
    "history": """SELECT person_id, max(position_score) FILTER (WHERE n = 1) AS now, max(position_score) FILTER (WHERE n = 2) AS before, max(position_score) FILTER (WHERE n = 1) - max(position_score) FILTER (WHERE n = 2) AS delta,
       string_agg(CAST(position_score AS VARCHAR), ',' ORDER BY week_start) AS history, count(*) >= 2 AS tracking FROM ranked_weeks WHERE n <= 12 GROUP BY person_id""",
}
ROLLUP = {
    **HISTORY,
    "rollup": """SELECT cohort_id, p.person_id, now AS latest, before AS previous, delta, (SELECT count(*) FROM person_skills s WHERE s.person_id = p.person_id AND status = 'learning') AS learning,
       (SELECT count(*) FROM person_weeks w WHERE w.person_id = p.person_id) AS weeks_tracked FROM persons p LEFT JOIN history h ON h.person_id = p.person_id""",
}
POSITION = {
    **EXPOSURE,
    **HAVE,
    "position": """SELECT person_id, role_id, round(coverage, 4) AS coverage, round(momentum, 4) AS momentum, round(ai_norm, 4) AS ai_norm, CAST(greatest(0, least(100, round(55 * coverage + 25 * momentum + 20 * (1 - ai_norm), 0))) AS INT) AS score FROM (
            SELECT p.person_id, p.target_role_id AS role_id, coalesce(got, 0) / total AS coverage, (greatest(-20, least(20, coalesce(growth, 0))) + 20) / 40 AS momentum, greatest(0, least(1, coalesce(ai_pct, 0) / 100)) AS ai_norm
            FROM persons p JOIN (SELECT role_id, sum(demand_pct) AS total FROM ranked WHERE rank <= 30 GROUP BY role_id) t ON t.role_id = p.target_role_id LEFT JOIN trend m ON m.role_id = p.target_role_id LEFT JOIN ai_now a ON a.role_id = p.target_role_id
            LEFT JOIN (SELECT p.person_id, sum(demand_pct) AS got FROM persons p JOIN have USING (person_id) JOIN ranked r ON r.role_id = p.target_role_id AND r.skill_id = have.skill_id WHERE rank <= 30 GROUP BY p.person_id) g ON g.person_id = p.person_id
            WHERE p.person_id IN (SELECT person_id FROM have))""",
}
DRIVEN = {
    **DEMAND,
    **HAVE,
    "grown": SKILL_GROWTH,
    "driven": """SELECT person_id, row_number() OVER (PARTITION BY person_id ORDER BY coalesce(growth_pct, 0) DESC, demand_pct DESC, skill_id) AS rank, skill_id, growth_pct, demand_pct, CASE WHEN growth_pct >= 1 THEN name || ' grows' ELSE name || ' is asked for' END AS text
            FROM persons p JOIN ranked r ON r.role_id = p.target_role_id LEFT JOIN grown g USING (role_id, skill_id) WHERE r.rank <= 30 AND category <> 'soft' AND person_id IN (SELECT person_id FROM have)
            AND NOT EXISTS (SELECT 1 FROM have h WHERE h.person_id = p.person_id AND h.skill_id = r.skill_id) QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY coalesce(growth_pct, 0) DESC, demand_pct DESC, skill_id) <= 3""",
}
BEST15 = "SELECT role_id, skill_id, name, category, demand_pct, rank FROM ranked"


def curricula(s: Star):
    """Two skills of three, for every role."""
    return s.skills.filter("id % 3 <> 1").select(F.col("id").alias("skill_id")).join(s.roles.select(F.col("id").alias("role_id"), F.col("id").alias("curriculum_id")))


def started(s: Star):
    """Everybody's learning began half a year before, or as many weeks as the skill's id is over 0."""
    return s.person_skills.filter("status = 'learning'").select("person_id", "skill_id", F.expr("date_sub(DATE '2001-07-15', cast(7 * (skill_id % 26) as int))").alias("started"))


def spread(table: str, keys: str, order: str, k: int) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rank FROM (SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY {keys}, category ORDER BY {order}) <= 2) QUALIFY rank <= {k}"""


FACTS = {
    "paid": "SELECT role_id AS paid_role, CAST(trunc(avg(salary_min_usd)) AS INT) AS avg_min, CAST(trunc(avg(salary_max_usd)) AS INT) AS avg_max, count(*) AS paid FROM active WHERE salary_min_usd > 0 GROUP BY role_id",
    "grows": f"""SELECT role_id AS grown_role, {growth('count(*) FILTER (WHERE now)', 'count(*) FILTER (WHERE before)')} AS growth_pct FROM (SELECT role_id, coalesce(posted_at, scraped_at) < DATE '2001-07-01' AND (closed_at IS NULL OR closed_at >= DATE '2001-06-01') AS now,
       coalesce(posted_at, scraped_at) < DATE '2001-06-01' AND (closed_at IS NULL OR closed_at >= DATE '2001-05-01') AS before FROM jobs WHERE role_id IS NOT NULL) GROUP BY role_id""",
}


def alternatives(table: str, key: str, other: str, columns: str) -> str:
    """SQL of alternatives with their leading shared and new skills (from ``sides``), mean salaries and growth."""
    listed = lambda rows, k, name: f"(SELECT {key}, {other}, string_agg(CAST(skill_id AS VARCHAR), ',' ORDER BY place) AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY {key}, {other} ORDER BY share DESC, skill_id) AS place FROM ({rows})) WHERE place <= {k} GROUP BY {key}, {other})"
    new = f"SELECT * FROM (SELECT *, max(share >= 0.1) OVER (PARTITION BY {key}, {other}) AS wide FROM sides WHERE NOT has) WHERE share >= 0.1 OR NOT wide"
    return f"""SELECT {key}, {other}, {columns}, shared_skills, new_skills, avg_min, avg_max, paid, growth_pct FROM {table} LEFT JOIN {listed('SELECT * FROM sides WHERE has', 8, 'shared_skills')} USING ({key}, {other}) LEFT JOIN {listed(new, 6, 'new_skills')} USING ({key}, {other})
    LEFT JOIN paid ON paid_role = {other} LEFT JOIN grows ON grown_role = {other}"""


ENTRIES: dict[str, tuple] = {
    "c15_alternative_roles": (
        lambda s: h.alternative_roles(s, P),
        sql(
            alternatives("best", "role_id", "other_id", "category, shared, new, coverage_pct, jaccard, other_jobs, rank"),
            {
                **PER_ROLE,
                **FACTS,
                "sizes": "SELECT role_id, count(*) AS k, any_value(role_jobs) AS jobs FROM rs JOIN role_jobs USING (role_id) WHERE role_jobs >= 30 GROUP BY role_id",
                "pairs": f"""SELECT a.role_id, b.role_id AS other_id, r.category, count(*) AS shared, any_value(y.jobs) AS other_jobs, any_value(y.k) - count(*) AS new, {pct('count(*)', 'any_value(x.k)', 0)} AS coverage_pct, round(count(*) / (any_value(x.k) + any_value(y.k) - count(*)), 3) AS jaccard
                   FROM rs a JOIN rs b ON a.skill_id = b.skill_id AND a.role_id <> b.role_id JOIN sizes x ON x.role_id = a.role_id JOIN sizes y ON y.role_id = b.role_id JOIN roles r ON r.id = b.role_id GROUP BY a.role_id, b.role_id, r.category HAVING count(*) >= 3""",
                "best": spread("pairs", "role_id", "shared DESC, coverage_pct DESC, other_jobs DESC, other_id", 5),
                "theirs": "SELECT role_id AS other_id, skill_id, n / role_jobs AS share FROM rs JOIN role_jobs USING (role_id) WHERE role_jobs >= 30",
                "sides": "SELECT b.role_id, b.other_id, t.skill_id, t.share, o.skill_id IS NOT NULL AS has FROM best b JOIN theirs t USING (other_id) LEFT JOIN rs o ON o.role_id = b.role_id AND o.skill_id = t.skill_id",
            },
        ),
    ),
    "c16_person_alternatives": (
        lambda s: h.person_alternatives(s, P),
        sql(
            alternatives("best", "person_id", "role_id", "category, shared, coverage_pct, fit, role_jobs, rank"),
            {
                **PER_ROLE,
                **FACTS,
                **HAVE,
                "placed": """SELECT role_id, skill_id, n / role_jobs AS demand, row_number() OVER (PARTITION BY role_id ORDER BY n DESC, skill_id) AS place, count(*) FILTER (WHERE n / role_jobs >= 0.05) OVER (PARTITION BY role_id) AS wide, count(*) OVER (PARTITION BY role_id) AS k
                   FROM rs JOIN role_jobs USING (role_id) WHERE role_jobs >= 30""",
                "core": "SELECT * FROM placed WHERE k >= 10 AND place <= CASE WHEN wide < 15 THEN 30 ELSE least(wide, 40) END",
                "fits": """SELECT h.person_id, c.role_id, r.category, count(*) AS shared, any_value(role_jobs) AS role_jobs, sum(c.demand) / any_value(d.d) AS cov, count(*) / any_value(m.m) AS br FROM have h JOIN core c USING (skill_id) JOIN persons p ON p.person_id = h.person_id AND p.target_role_id <> c.role_id
                   JOIN (SELECT role_id, sum(demand) AS d FROM core GROUP BY role_id) d ON d.role_id = c.role_id JOIN (SELECT person_id, count(*) AS m FROM have GROUP BY person_id) m ON m.person_id = h.person_id JOIN roles r ON r.id = c.role_id JOIN role_jobs j ON j.role_id = c.role_id GROUP BY h.person_id, c.role_id, r.category HAVING count(*) >= 3""",
                "rounded": "SELECT *, round(cov * 100, 0) AS coverage_pct, round(2 * cov * br / (cov + br) * 100, 0) AS fit FROM fits",
                "best": spread("rounded", "person_id", "shared DESC, coverage_pct DESC, role_jobs DESC, role_id", 5),
                "sides": "SELECT b.person_id, b.role_id, c.skill_id, c.demand AS share, h.skill_id IS NOT NULL AS has FROM best b JOIN core c USING (role_id) LEFT JOIN have h ON h.person_id = b.person_id AND h.skill_id = c.skill_id",
            },
        ),
    ),
    "c19_matched_jobs": (lambda s: h.matched_jobs(s, P), sql("SELECT * FROM matches", MATCHES)),
    "c20_skill_split": (
        lambda s: h.skill_split(s, P),
        sql(
            """SELECT person_id, job_id, coalesce(string_agg(name, ', ' ORDER BY name) FILTER (WHERE has), '') AS matched_names, coalesce(string_agg(name, ', ' ORDER BY name) FILTER (WHERE NOT has AND place <= 5), '') AS missing_names FROM (
            SELECT m.person_id, m.job_id, s.name, h.skill_id IS NOT NULL AS has, row_number() OVER (PARTITION BY m.person_id, m.job_id, h.skill_id IS NOT NULL ORDER BY s.name) AS place FROM matches m JOIN job_skills js ON js.job_id = m.job_id JOIN skills s ON s.id = js.skill_id AND s.is_verified
            LEFT JOIN have h ON h.person_id = m.person_id AND h.skill_id = js.skill_id) GROUP BY ALL""",
            MATCHES,
        ),
    ),
    "c21_match_summary": (lambda s: h.match_summary(s, P), sql("SELECT person_id, max(total_count) AS total_count, max(new_count) AS new_count, min_by(job_id, rank) AS best_job, max(match_pct) AS best_pct FROM matches GROUP BY person_id", MATCHES)),
    "c22_skill_gap": (lambda s: h.skill_gap(s), sql("SELECT * FROM gap", NEEDS)),
    "c22_filtered_gap": (lambda s: h.skill_gap(s, True, "lead", "NATION_3"), sql("SELECT * FROM gap", FEW_NEEDS)),
    "c22_gap_failures": (
        lambda s: h.gap_failures(with_few(s), "lead", "Atlantis").orderBy("role_id"),
        sql("""SELECT role_id, concat_ws(' and ', CASE WHEN a = 0 THEN 'lead level' END, CASE WHEN (CASE WHEN a = 0 THEN b ELSE c END) = 0 THEN 'Atlantis' END) AS ignored FROM (
            SELECT role_id, count(*) FILTER (WHERE lower(seniority_level) = 'lead') AS a, count(*) FILTER (WHERE location_is_remote) AS b, count(*) FILTER (WHERE lower(seniority_level) = 'lead' AND location_is_remote) AS c FROM active
            WHERE role_id % 3 = 0 OR location_is_remote AND role_id % 3 = 1 AND seniority_level = 'mid' OR role_id % 3 = 2 AND NOT location_is_remote GROUP BY role_id) WHERE a = 0 OR (CASE WHEN a = 0 THEN b ELSE c END) = 0""", ACTIVE),
    ),
    "c22_gap_scores": (lambda s: h.gap_scores(s), sql("SELECT * FROM gap_heads", NEEDS)),
    "c35_position_scores": (lambda s: h.position_scores(s, P), sql("SELECT * FROM position", POSITION)),
    "c36_score_drivers": (lambda s: h.score_drivers(s, P), sql("SELECT * FROM driven", DRIVEN)),
    "c38_score_history": (lambda s: h.score_history(s.person_weeks), sql("SELECT * FROM history", HISTORY)),
    "c39_cohort_rollup": (lambda s: h.cohort_rollup(s, P), sql("SELECT r.*, d.skill_id AS top_gap FROM rollup r LEFT JOIN (SELECT person_id, skill_id FROM driven WHERE rank = 1) d USING (person_id)", {**ROLLUP, **DRIVEN})),
    "c39_cohort_averages": (lambda s: h.cohort_averages(s), sql("SELECT cohort_id, count(*) AS clients, round(avg(latest), 1) AS avg_score, round(avg(delta), 1) + 0.0 AS avg_delta FROM rollup GROUP BY cohort_id", ROLLUP)),
    "c40_curriculum_fit": (
        lambda s: h.curriculum_fit(s, curricula(s), P),
        sql(
            """SELECT role_id AS curriculum_id, kind, place, skill_id, demand FROM (SELECT *, row_number() OVER (PARTITION BY role_id, kind ORDER BY demand DESC, skill_id) AS place FROM (
            SELECT n.*, CASE WHEN skill_id % 3 <> 1 THEN 'covered' WHEN rank <= 40 AND growth_pct >= 5 THEN 'emerging' WHEN demand >= 20 THEN 'missing' END AS kind FROM needs n LEFT JOIN grown USING (role_id, skill_id)) WHERE kind IS NOT NULL)
            WHERE place <= CASE kind WHEN 'covered' THEN 40 WHEN 'missing' THEN 15 ELSE 8 END""",
            {**NEEDS, "grown": SKILL_GROWTH},
        ),
    ),
    "c41_client_view": (
        lambda s: h.client_view(s, P),
        sql(
            """SELECT p.person_id, p.cohort_id, k.have, k.learning, match_score, now, history, total_count, best_job, top_missing, top_jobs FROM persons p LEFT JOIN (SELECT person_id, count(*) FILTER (WHERE status = 'have') AS have, count(*) FILTER (WHERE status = 'learning') AS learning FROM person_skills GROUP BY person_id) k USING (person_id)
            LEFT JOIN gap_heads USING (person_id) LEFT JOIN (SELECT person_id, now, history FROM history) USING (person_id) LEFT JOIN (SELECT person_id, max(total_count) AS total_count, min_by(job_id, rank) AS best_job, string_agg(CAST(job_id AS VARCHAR), ',' ORDER BY rank) FILTER (WHERE rank <= 10) AS top_jobs FROM matches GROUP BY person_id) USING (person_id)
            LEFT JOIN (SELECT person_id, string_agg(CAST(skill_id AS VARCHAR), ',' ORDER BY n) AS top_missing FROM (SELECT person_id, skill_id, row_number() OVER (PARTITION BY person_id ORDER BY job_count DESC, skill_id) AS n FROM gap WHERE status = 'missing') WHERE n <= 8 GROUP BY person_id) USING (person_id)""",
            {**NEEDS, **HISTORY, **MATCHES, "owned": "SELECT DISTINCT person_id, skill_id FROM person_skills WHERE status = 'have'"},
        ),
    ),
    "c42_clients_per_cohort": (lambda s: h.clients_per_cohort(s), sql("SELECT cohort_id, count(DISTINCT person_id) AS clients FROM persons GROUP BY cohort_id")),
    "c43_learning_tracker": (
        lambda s: h.learning_tracker(s, started(s), P),
        sql(
            f"""SELECT l.person_id, l.skill_id, CAST(floor((DATE '2001-07-15' - l.started) / 7) AS BIGINT) AS weeks, any_value(demand_pct) AS demand_pct,
            CASE WHEN count(w.period) >= 2 AND min_by(w.n, w.period) > 0 THEN {growth('max_by(w.n, w.period)', 'min_by(w.n, w.period)')} END AS demand_growth_pct
            FROM (SELECT person_id, skill_id, DATE '2001-07-15' - CAST(7 * (skill_id % 26) AS INT) AS started FROM person_skills WHERE status = 'learning') l JOIN persons p USING (person_id) LEFT JOIN ranked r ON r.role_id = p.target_role_id AND r.skill_id = l.skill_id AND r.rank <= 150
            LEFT JOIN (SELECT role_id, skill_id, CAST(date_trunc('week', posted_at) AS DATE) AS period, count(*) AS n FROM jobs JOIN job_skills ON job_id = id WHERE role_id IS NOT NULL GROUP BY ALL) w
            ON w.role_id = p.target_role_id AND w.skill_id = l.skill_id AND w.period >= l.started AND w.period <= DATE '2001-07-15' GROUP BY l.person_id, l.skill_id, l.started""",
            DEMAND,
        ),
    ),
    "c69_digests": (
        lambda s: h.digests(s, P),
        sql(
            """SELECT p.person_id, p.target_role_id AS role_id, growth, ai_pct, rising_skills, surging_company, surge_pct, first_missing, delta, learning FROM persons p LEFT JOIN surge u ON u.role_id = p.target_role_id LEFT JOIN learns l ON l.person_id = p.person_id LEFT JOIN trend t ON t.role_id = p.target_role_id LEFT JOIN ai_now a ON a.role_id = p.target_role_id
            LEFT JOIN (SELECT role_id, string_agg(CAST(skill_id AS VARCHAR), ',' ORDER BY k) AS rising_skills FROM (SELECT role_id, skill_id, row_number() OVER (PARTITION BY role_id ORDER BY growth_pct DESC, skill_id) AS k FROM ranked JOIN grown USING (role_id, skill_id) WHERE rank <= 150 AND category <> 'soft' AND growth_pct >= 3 AND demand_pct >= 3) WHERE k <= 3 GROUP BY role_id) r ON r.role_id = p.target_role_id
            LEFT JOIN (SELECT p.person_id, min_by(r.skill_id, r.rank) AS first_missing FROM persons p JOIN ranked r ON r.role_id = p.target_role_id AND r.rank <= 15 WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.person_id = p.person_id AND h.skill_id = r.skill_id) GROUP BY p.person_id) m ON m.person_id = p.person_id
            LEFT JOIN history y ON y.person_id = p.person_id""",
            {
                **EXPOSURE,
                **HAVE,
                **HISTORY,
                **HIRING,
                "grown": SKILL_GROWTH,
                "surge": "SELECT role_id, arg_max(company_id, (growth_pct, -rank)) AS surging_company, max(growth_pct) AS surge_pct FROM hiring WHERE growth_pct >= 50 GROUP BY role_id",
                "learns": "SELECT p.person_id, string_agg(CAST(l.skill_id AS VARCHAR) || coalesce('=' || CAST(demand_pct AS VARCHAR), ''), ',' ORDER BY l.skill_id) AS learning FROM persons p JOIN (SELECT DISTINCT person_id, skill_id FROM person_skills WHERE status = 'learning') l USING (person_id) LEFT JOIN ranked r ON r.role_id = p.target_role_id AND r.skill_id = l.skill_id AND rank <= 150 GROUP BY p.person_id",
            },
        ),
    ),
    "c59_volume": (lambda s: n.volume(s), sql("SELECT count(*) AS jobs, count(*) FILTER (WHERE is_active) AS active_jobs, count(DISTINCT company_id) AS companies, count(DISTINCT role_id) AS roles, count(*) FILTER (WHERE is_active AND role_id IS NOT NULL) AS with_role FROM jobs")),
    "c60_top_roles": (lambda s: n.top_roles(s), sql("SELECT r.id, normalized_title, category, count(*) AS n FROM active a JOIN roles r ON r.id = a.role_id GROUP BY ALL ORDER BY n DESC, r.id LIMIT 20", ACTIVE)),
    "c60_categories": (lambda s: n.categories(s), sql("SELECT category, count(*) AS n FROM active a JOIN roles r ON r.id = a.role_id GROUP BY category", ACTIVE)),
    "c61_seniority_mix": (lambda s: n.seniority_mix(s), sql("SELECT seniority_level, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM jobs WHERE is_active GROUP BY seniority_level")),
    "c61_remote_share": (lambda s: n.remote_share(s), sql("SELECT round(100.0 * count(*) FILTER (WHERE location_is_remote) / count(*), 1) AS remote_pct FROM jobs WHERE is_active")),
    "c62_top_places": (lambda s: n.top_places(s), sql("SELECT location_raw AS place, count(*) AS n FROM jobs WHERE is_active AND NOT location_is_remote GROUP BY ALL ORDER BY n DESC, place LIMIT 15")),
    "c63_top_companies": (lambda s: n.top_companies(s), sql("SELECT c.id, c.name, count(*) AS n FROM jobs j JOIN companies c ON c.id = j.company_id WHERE j.is_active GROUP BY ALL ORDER BY n DESC, c.id LIMIT 15")),
    "c63_top_skills": (lambda s: n.top_skills(s), sql("SELECT s.id, s.name, count(DISTINCT j.id) AS n FROM jobs j JOIN job_skills js ON js.job_id = j.id JOIN skills s ON s.id = js.skill_id WHERE j.is_active GROUP BY s.id, s.name ORDER BY n DESC, s.id LIMIT 20")),
    "c64_rising_roles": (lambda s: n.rising_roles(s, P, least=5), sql("SELECT * REPLACE (round(ratio, 2) AS ratio) FROM role_shares WHERE recent_n >= 5 ORDER BY round(ratio, 2) DESC NULLS LAST, role_id LIMIT 20", SHARES)),
    "c65_fading_roles": (lambda s: n.fading_roles(s, P), sql("SELECT * EXCLUDE (ratio) FROM role_shares WHERE base_n >= 30 ORDER BY ratio ASC NULLS FIRST, role_id LIMIT 15", SHARES)),
    "c66_rising_skills": (
        lambda s: n.rising_skills(s, P, least=10),
        sql(
            """SELECT skill_id, recent_n, base_n, round((100.0 * recent_n / rt) / (100.0 * greatest(base_n, 1) / bt), 2) AS ratio FROM k CROSS JOIN (SELECT sum(recent_n) AS rt, sum(base_n) AS bt FROM k) WHERE recent_n >= 10 ORDER BY ratio DESC NULLS LAST, skill_id LIMIT 20""",
            {"k": f"SELECT skill_id, count(*) FILTER (WHERE {RECENT}) AS recent_n, count(*) FILTER (WHERE {EARLIER}) AS base_n FROM jobs JOIN job_skills ON job_id = id WHERE ({RECENT}) OR ({EARLIER}) GROUP BY skill_id"},
        ),
    ),
    "c67_ai_league": (lambda s: n.ai_league(s, P), sql(f"SELECT role_id, count(*) AS jobs, count(*) FILTER (WHERE id IN (SELECT job_id FROM ai)) AS ai, {pct('count(*) FILTER (WHERE id IN (SELECT job_id FROM ai))', 'count(*)')} AS ai_pct FROM active GROUP BY role_id HAVING count(*) >= 500 ORDER BY ai_pct DESC, role_id LIMIT 12", {**ACTIVE, **AI})),
    "c68_named_skills": (lambda s: n.named_skills(s, ["small ring", "RED widget", "none"]), sql("SELECT s.name, count(DISTINCT j.id) AS n FROM jobs j JOIN job_skills js ON js.job_id = j.id JOIN skills s ON s.id = js.skill_id WHERE j.is_active AND lower(s.name) IN ('small ring', 'red widget', 'none') GROUP BY s.name")),
    "c70_freshness": (lambda s: n.freshness(s), sql("SELECT max(scraped_at) AS fresh_at FROM jobs WHERE company_id IN (SELECT id FROM companies WHERE is_active)")),
    "c71_due_companies": (lambda s: n.due_companies(s, P), sql("SELECT c.id, max(scraped_at) AS last_scraped FROM companies c LEFT JOIN jobs j ON j.company_id = c.id AND scraped_at <= DATE '2001-07-15' WHERE c.is_active GROUP BY c.id HAVING max(scraped_at) IS NULL OR max(scraped_at) < DATE '2001-06-15'")),
    "a12_mix_cube": (lambda s: n.mix_cube(s), sql("SELECT seniority, remote, count(*) AS n, CAST(grouping(seniority) * 2 + grouping(remote) AS BIGINT) AS level FROM (SELECT coalesce(seniority_level, 'none') AS seniority, location_is_remote AS remote FROM jobs WHERE is_active) GROUP BY CUBE (seniority, remote)")),
}


def queries() -> dict:
    return {name: (lambda spark, sf_dir, run=run: run(from_tables(spark, sf_dir))) for name, (run, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in ENTRIES.items() if text}
