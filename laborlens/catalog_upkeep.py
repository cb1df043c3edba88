"""Maintenance and enrichment operators as queries over the given tables, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.catalog_demand import ACTIVE, FAMILIES, FAMILY_MOVES, MOVERS, SKILL_MOVES, P
from laborlens.functions import markup, places, titles
from laborlens.operators import enrich as e
from laborlens.operators import maintain as m
from laborlens.plans import market_boards, week_snapshots
from laborlens.sources import tables
from laborlens.star import Star, from_tables, sql

# Postings of a scrape: the newest event of a type and user; its props are the description.


def scraped(events: DataFrame, parts: list[int]) -> DataFrame:
    own = events.filter(F.pmod("event_id", F.lit(2)).isin(parts))
    rows = own.select(F.col("event_type").alias("source_ats"), F.col("user_id").cast("string").alias("source_job_id"), (F.col("user_id") % 7).alias("company_id"), F.concat("event_type", F.lit(" job")).alias("title"), F.lit("x").alias("location_raw"), F.lit("d").alias("department"), F.col("props").alias("description"), F.col("ts").alias("posted_at"), F.col("ts").alias("seen_at"), "event_id")
    return m.newest(rows, m.KEY, F.desc("seen_at"), F.desc("event_id")).drop("event_id")


def postings(events: DataFrame, parts: list[int]) -> DataFrame:
    rows = scraped(events, parts)
    return rows.select(*m.KEY, *m.ATTRIBUTES, "posted_at", F.col("seen_at").alias("scraped_at"), F.col("seen_at").alias("last_seen_at"), F.when(F.col("company_id") == 3, F.col("seen_at")).alias("closed_at"), (F.col("company_id") != 3).alias("is_active"), F.lit(False).alias("skills_dirty"))


def _newest(parts: str) -> str:
    return f"""SELECT event_type AS source_ats, CAST(user_id AS VARCHAR) AS source_job_id, user_id % 7 AS company_id, event_type || ' job' AS title, props AS description, ts FROM events WHERE event_id % 2 IN ({parts})
      QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1"""


UPSERT = {"cur": _newest("0"), "bat": _newest("1")}


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def non_english(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", F.when(F.col("lang") == "en", "US").otherwise(F.upper("lang")).alias("country"))
    return e.non_english(docs, ["US", "UK", "Canada"])


def page_domains(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").groupBy(markup.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


def page_texts(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", markup.html_to_text(F.col("html")).alias("text"))


def upsert(spark, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return m.upsert_postings(postings(events, [0]), scraped(events, [1])).drop("location_raw", "department")


def close(spark, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return m.close_absent(postings(events, [0]), scraped(events, [1]), F.lit("2024-02-01").cast("timestamp")).select(*m.KEY, "company_id", "is_active", "closed_at")


def star_query(run):
    return lambda spark, sf_dir: run(from_tables(spark, sf_dir))


def variations(s: Star) -> DataFrame:
    return s.jobs.filter("role_id is not null").groupBy(F.col("title").alias("original_title"), "role_id").agg(F.count(F.lit(1)).alias("frequency"))


def queue(s: Star) -> DataFrame:
    """Titles of two thirds of the postings without a role; those of urgent ones are approved."""
    old = s.jobs.filter("role_id is null and id % 3 <> 0")
    return old.groupBy(F.col("title").alias("raw_title")).agg(F.when(F.max("seniority_level") == "lead", "approved").otherwise("pending").alias("status"), F.count(F.lit(1)).alias("occurrence_count"), F.min("posted_at").alias("first_seen"), F.max("posted_at").alias("last_seen"))


def new_titles(s: Star) -> DataFrame:
    return s.jobs.filter("role_id is null and id % 3 = 0").select("title", F.col("posted_at").alias("seen_at"))


def aliased(s: Star) -> DataFrame:
    return s.skills.withColumn("aliases", F.array(F.concat(F.lit("alias "), F.col("id").cast("string"))))


def merges(s: Star) -> DataFrame:
    return s.skills.filter("id % 8 = 3").select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"))


def mentions(s: Star) -> DataFrame:
    """Skills named in postings, in two spellings, as candidates."""
    rows = s.job_skills.join(s.jobs, F.col("job_id") == F.col("id")).join(s.skills.select(F.col("id").alias("skill_id"), "name"), "skill_id")
    spelled = F.when(F.col("job_id") % 3 == 0, F.upper("name")).otherwise(F.col("name"))
    return rows.select(spelled.alias("name"), "job_id", "company_id", F.to_date("posted_at").alias("seen"), F.when(F.col("is_required"), "ctx").otherwise("list").alias("method"))


def candidates(s: Star, half: int | None = None) -> DataFrame:
    """Rolled-up candidates of all postings, or of those with even or odd ids (two batches)."""
    some = mentions(s) if half is None else mentions(s).filter(F.col("job_id") % 2 == half)
    rolled = m.roll_up_candidates(some, s.skills.filter("id % 4 = 3").select("name"))
    return rolled.select(F.lower("name").alias("name"), "job_count", "company_count", "first_seen", "last_seen")


RANK = "CASE " + " ".join(f"WHEN regexp_matches(l, '{p}') THEN '{n}'" for p, n in titles.LEVELS) + " ELSE 'mid' END"
CANDIDATES = """SELECT lower(s.name) AS name, count(DISTINCT job_id) AS job_count, count(DISTINCT company_id) AS company_count, min(CAST(posted_at AS DATE)) AS first_seen, max(CAST(posted_at AS DATE)) AS last_seen
   FROM job_skills JOIN jobs j ON j.id = job_id JOIN skills s ON s.id = skill_id WHERE skill_id % 4 <> 3 AND {some} GROUP BY lower(s.name) HAVING count(DISTINCT company_id) >= 2"""
ENTRIES: dict[str, tuple] = {
    "m01_upsert_postings": (
        upsert,
        sql(
            """SELECT coalesce(b.source_ats, c.source_ats) AS source_ats, coalesce(b.source_job_id, c.source_job_id) AS source_job_id, coalesce(b.company_id, c.company_id) AS company_id, coalesce(b.title, c.title) AS title, coalesce(b.description, c.description) AS description,
            coalesce(c.ts, b.ts) AS posted_at, coalesce(c.ts, b.ts) AS scraped_at, coalesce(b.ts, c.ts) AS last_seen_at, CASE WHEN b.ts IS NULL AND c.company_id = 3 THEN c.ts END AS closed_at, b.ts IS NOT NULL OR c.company_id <> 3 AS is_active,
            c.ts IS NULL OR (b.ts IS NOT NULL AND b.description IS DISTINCT FROM c.description) AS skills_dirty FROM cur c FULL JOIN bat b USING (source_ats, source_job_id)""",
            UPSERT,
        ),
    ),
    "m02_close_absent": (
        close,
        sql(
            """SELECT c.source_ats, c.source_job_id, c.company_id, c.company_id <> 3 AND NOT gone AS is_active, CASE WHEN gone THEN TIMESTAMP '2024-02-01' WHEN c.company_id = 3 THEN ts END AS closed_at FROM (
            SELECT *, company_id <> 3 AND (source_ats, company_id) IN (SELECT (source_ats, company_id) FROM bat) AND (source_ats, source_job_id) NOT IN (SELECT (source_ats, source_job_id) FROM bat) AS gone FROM cur) c""",
            UPSERT,
        ),
    ),
    "m03_resolve_roles": (
        star_query(lambda s: m.resolve_roles(s.jobs.select("id", F.regexp_replace("title", "^(Lead|Senior) ", "").alias("title")), s.roles, variations(s).filter("original_title like 'Junior%'"))),
        sql(
            """SELECT j.id, j.title, coalesce(r.id, v.role_id) AS role_id FROM (SELECT id, regexp_replace(title, '^(Lead|Senior) ', '') AS title FROM jobs) j LEFT JOIN roles r ON lower(r.normalized_title) = lower(j.title)
            LEFT JOIN (SELECT lower(title) AS t, min(role_id) AS role_id FROM jobs WHERE role_id IS NOT NULL AND title LIKE 'Junior%' GROUP BY lower(title)) v ON v.t = lower(j.title)"""
        ),
    ),
    "m04_queue_titles": (
        star_query(lambda s: m.queue_titles(queue(s), new_titles(s))),
        sql(
            """SELECT coalesce(q.title, n.title) AS raw_title, coalesce(status, 'pending') AS status, CASE WHEN coalesce(status, 'pending') = 'pending' AND n.title IS NOT NULL THEN coalesce(q.k, 0) + n.k ELSE q.k END AS occurrence_count, coalesce(q.f, n.f) AS first_seen,
            CASE WHEN coalesce(status, 'pending') = 'pending' AND n.title IS NOT NULL THEN greatest(coalesce(q.l, n.l), n.l) ELSE q.l END AS last_seen
            FROM (SELECT title, CASE WHEN max(seniority_level) = 'lead' THEN 'approved' ELSE 'pending' END AS status, count(*) AS k, min(posted_at) AS f, max(posted_at) AS l FROM jobs WHERE role_id IS NULL AND id % 3 <> 0 GROUP BY title) q
            FULL JOIN (SELECT title, count(*) AS k, min(posted_at) AS f, max(posted_at) AS l FROM jobs WHERE role_id IS NULL AND id % 3 = 0 GROUP BY title) n ON n.title = q.title"""
        ),
    ),
    "m05_backfill_queue": (
        star_query(lambda s: m.backfill_queue(queue(s).filter("status = 'approved'"), s.jobs)),
        sql("SELECT title AS raw_title, count(*) AS occurrence_count, count(DISTINCT company_id) AS company_count, min(CAST(posted_at AS DATE)) AS first_seen, max(CAST(posted_at AS DATE)) AS last_seen FROM jobs WHERE role_id IS NULL AND title NOT IN (SELECT title FROM jobs WHERE role_id IS NULL AND id % 3 <> 0 GROUP BY title HAVING max(seniority_level) = 'lead') GROUP BY title"),
    ),
    "m06_count_variations": (
        star_query(lambda s: m.count_variations(variations(s), s.jobs.filter("role_id = 3").select("title", "role_id"))),
        sql("SELECT title AS original_title, role_id, CAST(count(*) * CASE WHEN role_id = 3 THEN 2 ELSE 1 END AS BIGINT) AS frequency FROM jobs WHERE role_id IS NOT NULL GROUP BY title, role_id"),
    ),
    "m07_replace_tags": (
        star_query(lambda s: m.replace_tags(s.job_skills, s.jobs.filter("id % 4 = 1").select(F.col("id").alias("job_id")), s.job_skills.withColumn("skill_id", F.col("skill_id") % 10))),
        sql("SELECT job_id, skill_id, is_required FROM job_skills WHERE job_id % 4 <> 1 UNION ALL SELECT job_id, skill_id % 10, bool_or(is_required) FROM job_skills WHERE job_id % 4 = 1 GROUP BY ALL"),
    ),
    "m08_cap_tags": (
        star_query(lambda s: m.cap_tags(s.job_skills.withColumn("confidence", F.when(F.col("is_required"), 95).otherwise(70)), 3)),
        sql("SELECT job_id, skill_id, is_required, CASE WHEN is_required THEN 95 ELSE 70 END AS confidence FROM job_skills QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY is_required DESC, skill_id) <= 3"),
    ),
    "m09_add_missing_tags": (
        star_query(lambda s: m.add_missing_tags(s.job_skills, s.jobs.filter("id % 3 = 0").select(F.col("id").alias("job_id"), F.lit(7).cast("long").alias("skill_id")))),
        sql("SELECT * FROM job_skills UNION ALL SELECT id, 7, true FROM jobs WHERE id % 3 = 0 AND id NOT IN (SELECT job_id FROM job_skills WHERE skill_id = 7)"),
    ),
    "m10_skill_counts": (star_query(lambda s: m.skill_counts(s.skills, s.job_skills, s.jobs)), sql("SELECT s.id, s.name, count(DISTINCT a.id) AS total_job_count FROM skills s LEFT JOIN job_skills js ON js.skill_id = s.id LEFT JOIN active a ON a.id = js.job_id WHERE s.is_verified GROUP BY s.id, s.name", ACTIVE)),
    "m11_role_counts": (star_query(lambda s: m.role_counts(s.roles, s.jobs)), sql("SELECT r.id, r.normalized_title, count(a.id) AS total_active_jobs FROM roles r LEFT JOIN active a ON a.role_id = r.id GROUP BY ALL", ACTIVE)),
    "m12_dedupe_tags": (
        star_query(lambda s: m.dedupe_tags(s.job_skills.select((F.col("job_id") * 100 + F.col("skill_id")).alias("id"), "job_id", (F.col("skill_id") % 5).alias("skill_id")))),
        sql("SELECT min(job_id * 100 + skill_id) AS id, job_id, skill_id % 5 AS skill_id FROM job_skills GROUP BY job_id, skill_id % 5"),
    ),
    "m13_merge_skills": (
        star_query(lambda s: m.merge_skills(s.job_skills, aliased(s), merges(s))[0]),
        sql("SELECT job_id, CASE WHEN skill_id % 8 = 3 THEN skill_id - 1 ELSE skill_id END AS skill_id, bool_or(is_required) AS is_required FROM job_skills GROUP BY ALL"),
    ),
    "m14_merge_roles": (
        star_query(lambda s: m.merge_roles(s.roles, variations(s), s.jobs, s.roles.filter("id in (7, 8)").select(F.col("id").alias("src"), F.lit(2).cast("long").alias("dst")))[1]),
        sql("SELECT title AS original_title, CASE WHEN role_id IN (7, 8) THEN 2 ELSE role_id END AS role_id, count(*) AS frequency FROM jobs WHERE role_id IS NOT NULL GROUP BY ALL"),
    ),
    "m15_remap_titles": (
        star_query(lambda s: m.remap_titles(s.jobs.select("id", "title", "role_id"), s.jobs.filter("role_id = 4").select(F.upper("title").alias("title"), F.when(F.col("seniority_level") == "senior", 9).cast("long").alias("role_id"), F.lit(1).alias("priority")).distinct())),
        sql("SELECT id, title, CASE WHEN title IN (SELECT title FROM jobs WHERE role_id = 4) THEN CASE WHEN title LIKE 'Senior%' THEN 9 END ELSE role_id END AS role_id FROM jobs"),
    ),
    "m16_rebuild_roles": (
        star_query(lambda s: m.rebuild_roles(s.jobs, s.jobs.select("title", F.regexp_extract("title", r"NATION_\d", 0).alias("canonical")))[1]),
        sql("SELECT title AS original_title, dense_rank() OVER (ORDER BY regexp_extract(title, 'NATION_[0-9]')) AS role_id, count(*) AS frequency FROM jobs GROUP BY title"),
    ),
    "m17_upsert_candidates": (
        star_query(lambda s: m.upsert_candidates(candidates(s, 0).withColumn("status", F.when(F.col("name") < "d", "rejected").otherwise("pending")), candidates(s, 1))),
        sql(
            """SELECT coalesce(a.name, b.name) AS name, coalesce(a.st, 'pending') AS status, CASE WHEN coalesce(a.st, 'pending') = 'pending' THEN greatest(a.job_count, b.job_count) ELSE a.job_count END AS job_count, CASE WHEN coalesce(a.st, 'pending') = 'pending' THEN greatest(a.company_count, b.company_count) ELSE a.company_count END AS company_count,
            coalesce(a.first_seen, b.first_seen) AS first_seen, CASE WHEN coalesce(a.st, 'pending') = 'pending' THEN greatest(a.last_seen, b.last_seen) ELSE a.last_seen END AS last_seen FROM (SELECT *, CASE WHEN name < 'd' THEN 'rejected' ELSE 'pending' END AS st FROM a0) a FULL JOIN a1 b USING (name)""",
            {"a0": CANDIDATES.format(some="job_id % 2 = 0"), "a1": CANDIDATES.format(some="job_id % 2 = 1")},
        ),
    ),
    "m18_roll_up_candidates": (
        star_query(lambda s: m.roll_up_candidates(mentions(s), s.skills.filter("id % 4 = 3").select("name"))),
        sql(
            """SELECT f.* EXCLUDE (key), g.name FROM (SELECT lower(name) AS key, count(DISTINCT job_id) AS job_count, count(DISTINCT company_id) AS company_count, min(seen) AS first_seen, max(seen) AS last_seen, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM men GROUP BY lower(name)) f
            JOIN (SELECT lower(name) AS key, name FROM men GROUP BY name QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY count(*) DESC, name) = 1) g USING (key) WHERE company_count >= 2 AND key NOT IN (SELECT lower(name) FROM skills WHERE id % 4 = 3)""",
            {"men": "SELECT CASE WHEN job_id % 3 = 0 THEN upper(s.name) ELSE s.name END AS name, job_id, company_id, CAST(posted_at AS DATE) AS seen, CASE WHEN is_required THEN 'ctx' ELSE 'list' END AS method FROM job_skills JOIN jobs j ON j.id = job_id JOIN skills s ON s.id = skill_id"},
        ),
    ),
    "m25_apply_mapping": (
        star_query(lambda s: m.apply_mapping(s.companies.select("id", "industry"), s.companies.select(F.col("id").alias("key"), F.when(F.col("id") % 2 == 0, "BUILDING").otherwise("OTHER").alias("value"), F.lit(1).alias("priority")).filter("key % 3 = 0"), "id", "industry")[1]),
        sql("SELECT id AS key, industry AS \"old\", CASE WHEN id % 2 = 0 THEN 'BUILDING' ELSE 'OTHER' END AS \"new\" FROM companies WHERE id % 3 = 0 AND industry <> CASE WHEN id % 2 = 0 THEN 'BUILDING' ELSE 'OTHER' END"),
    ),
    "m27_sync_person_skills": (
        star_query(lambda s: m.sync_person_skills(s.person_skills, s.person_skills.filter("person_id % 2 = 0").select("person_id", ((F.col("skill_id") + F.col("person_id")) % 64 + 1).alias("skill_id")))[0]),
        sql(
            """SELECT coalesce(c.person_id, w.person_id) AS person_id, coalesce(c.skill_id, w.skill_id) AS skill_id, CASE WHEN w.skill_id IS NOT NULL THEN 'have' ELSE status END AS status FROM person_skills c FULL JOIN w ON w.person_id = c.person_id AND w.skill_id = c.skill_id
            WHERE w.skill_id IS NOT NULL OR c.status = 'learning' OR c.person_id NOT IN (SELECT person_id FROM w)""",
            {"w": "SELECT DISTINCT person_id, (skill_id + person_id) % 64 + 1 AS skill_id FROM person_skills WHERE person_id % 2 = 0"},
        ),
    ),
    "m28_replace_person_skills": (
        star_query(lambda s: m.replace_person_skills(s.person_skills, s.person_skills.filter("person_id % 3 = 0 and skill_id % 3 = 0"))),
        sql("SELECT * FROM person_skills WHERE person_id NOT IN (SELECT person_id FROM person_skills WHERE person_id % 3 = 0 AND skill_id % 3 = 0) UNION ALL SELECT person_id, skill_id, 'have' FROM person_skills WHERE person_id % 3 = 0 AND skill_id % 3 = 0"),
    ),
    "m29_upsert_weeks": (
        star_query(lambda s: m.upsert_weeks(s.person_weeks, s.person_weeks.filter("person_id % 2 = 1").select("person_id", "week_start", (F.col("position_score") + 1).alias("position_score")))),
        sql("SELECT person_id, week_start, position_score + person_id % 2 AS position_score FROM person_weeks"),
    ),
    "s06_registry_stats": (
        star_query(lambda s: tables.registry_stats(s.companies.select(F.col("region").alias("ats"), "industry"))),
        sql("SELECT region AS ats, industry, count(*) AS n FROM companies GROUP BY GROUPING SETS ((region, industry), (region), (industry), ())"),
    ),
    "u04_market_boards": (
        star_query(lambda s: market_boards.market_boards(s, P, s.jobs.sparkSession.createDataFrame(FAMILIES, "role_id long, family string"))),
        sql(
            """SELECT DATE '2001-07-09' AS week_start, kind, scope, rank, label, growth FROM (
            SELECT CASE WHEN growth > 0 THEN 'rising_role' ELSE 'declining_role' END AS kind, scope, label, growth, row_number() OVER (PARTITION BY scope, growth > 0 ORDER BY abs(growth) DESC, label) AS rank
            FROM (SELECT *, 'overall' AS scope FROM counted_movers UNION ALL SELECT *, sector AS scope FROM counted_movers WHERE many >= 3) WHERE growth <> 0
            UNION ALL SELECT CASE WHEN growth > 0 THEN 'rising_skill' ELSE 'falling_skill' END, 'overall', label, growth, row_number() OVER (PARTITION BY growth > 0 ORDER BY abs(growth) DESC, skill_id) FROM skill_movers WHERE growth <> 0) WHERE rank <= 10""",
            {
                **MOVERS,
                **SKILL_MOVES,
                **FAMILY_MOVES,
                "counted_movers": "SELECT *, count(*) OVER (PARTITION BY sector) AS many FROM (SELECT label, sector, growth FROM movers WHERE role_id NOT IN (SELECT role_id FROM fam) UNION ALL SELECT family || ' (family)', sector, growth FROM family_movers)",
            },
        ),
    ),
    "c30_location_rollup": (
        star_query(lambda s: e.location_rollup(s.jobs.filter("is_active"), s.companies.filter("location <> 'NATION_3'").select(F.col("location").alias("country"), "region").distinct())),
        sql("SELECT coalesce(region, 'Unmatched') AS region, CASE WHEN region IS NOT NULL THEN location_country END AS country, count(*) AS n FROM jobs LEFT JOIN (SELECT DISTINCT location, region FROM companies WHERE location <> 'NATION_3') ON location = location_country WHERE is_active GROUP BY ALL"),
    ),
    "x01_page_texts": (
        page_texts,
        sql(
            r"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(
            regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', chr(10), 'g'),
            '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&apos;', ''''), '&amp;', '&'), '[ \t\r\f\x0B]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS text FROM pages"""
        ),
    ),
    "x34_to_usd": (
        star_query(lambda s: e.to_usd(s.jobs.select("id", F.col("salary_min_usd").alias("salary_min"), F.col("salary_max_usd").alias("salary_max"), F.when(F.col("id") % 2 == 0, "EUR").otherwise("").alias("currency")), s.jobs.sparkSession.createDataFrame([("USD", 1.0), ("EUR", 1.04)], "currency string, rate double"))),
        sql(
            """SELECT id, mn AS min_usd, CASE WHEN mx BETWEEN 10000 AND 3000000 THEN mx END AS max_usd FROM (SELECT id, CAST(trunc(salary_min_usd * CASE WHEN id % 2 = 0 THEN 1.04::DOUBLE ELSE 1 END) AS INT) AS mn, CAST(trunc(salary_max_usd * CASE WHEN id % 2 = 0 THEN 1.04::DOUBLE ELSE 1 END) AS INT) AS mx FROM jobs) WHERE mn BETWEEN 10000 AND 3000000"""
        ),
    ),
    "x36_non_english": (
        non_english,
        sql("SELECT doc_id AS id, round(pct, 1) AS pct FROM (SELECT doc_id, lang, (strlen(text) - length(text)) * 100.0::DOUBLE / strlen(text) AS pct FROM documents WHERE length(text) > 100) WHERE pct > 5 OR (pct BETWEEN 2 AND 5 AND lang <> 'en')"),
    ),
    "x39_page_domains": (page_domains, sql("SELECT regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*://)?(?:www\\.)?([^/?#:]+)', 1) AS domain, count(*) AS n FROM pages GROUP BY ALL")),
    "x42_migration_matrix": (star_query(lambda s: e.migration_matrix(s.jobs)), sql(f"SELECT seniority_level AS \"old\", {RANK} AS \"new\", count(*) AS n FROM (SELECT *, lower(title) AS l FROM jobs) GROUP BY ALL")),
}


def queries() -> dict:
    return {name: run for name, (run, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in ENTRIES.items() if text}
