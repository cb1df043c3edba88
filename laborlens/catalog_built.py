"""Enrichment and upkeep operators over whole tables that other catalogs don't register, each with SQL by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens.catalog_enrich import VOCABULARY, _nth, star_query, vocabulary
from laborlens.catalog_rules import SECTIONS, with_headers
from laborlens.operators import enrich as e
from laborlens.operators import maintain as m
from laborlens.star import Star, sql
from laborlens.streaming import runs


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills of all documents read as resumes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return e.extract_skills(docs, vocabulary(spark, sf_dir), whole=True)


def required_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What states requirements in all documents with headers set in; invented prose has no paragraph that hints at any."""
    return e.requirements(with_headers(spark, sf_dir)).select("id", F.sha2("text", 256).alias("text"), "used_fallback")


REQUIRED = {
    **SECTIONS,
    "parts": "SELECT id, n, name, string_agg(line, chr(10) ORDER BY i, half) AS body FROM placed WHERE header IS NULL GROUP BY id, n, name HAVING trim(string_agg(line, chr(10) ORDER BY i, half), ' ') <> ''",
    "stated": "SELECT id, string_agg(body, chr(10) ORDER BY n) AS t FROM parts WHERE name IN ('requirements', 'preferred') GROUP BY id",
    "other": "SELECT id, string_agg(body, chr(10) || chr(10) ORDER BY n) AS t FROM parts WHERE name NOT IN ('benefits', 'about_company', 'boilerplate') GROUP BY id",
    "whole": "SELECT id, string_agg(line, chr(10) ORDER BY i, half) AS t FROM laid GROUP BY id",
}

# Paragraphs of all orders, a statement by the key, with the score of each by hand.
PARAGRAPHS = [
    ("5+ years of experience with SQL", 5.5), ("Proficient in SQL and knowledge of Spark", 4.5), ("A bachelor degree is required", 3.5), ("- ability to listen\n- familiar with Java\n- SQL", 6.5), ("Dental and vision, salary and equity", -4.0), ("We are an equal opportunity employer", -7.0),
    ("Founded in 2010, we offer a proven track record", -1.5), ("Nothing to score", 0.0), ("* one\nplain\nplain two", 1.0), ("Experience in sales. Must travel. We provide cars", 2.5),
]


def scored_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), _nth([p for p, _ in PARAGRAPHS], F.col("o_orderkey")).alias("p"))
    return rows.select("id", e.paragraph_score(F.col("p")).alias("score"))


# Candidates made from skills: equal, longer, a part, misspelt, and strangers.
MADE = ["{}", "{} tools", "xx{}", "the-{}-kit"]


def made_candidates(s: Star) -> DataFrame:
    shapes = F.array(*(F.replace(F.lit(x), F.lit("{}"), F.upper("name")) for x in MADE), F.translate("name", "aeiou", "eioua"), F.concat(F.left("name", F.lit(2)), F.lit("#"), F.substring("name", 3, 99)), F.left("name", F.lit(6)), F.concat(F.lit("q"), F.col("id").cast("string")))
    return s.skills.select(F.explode(shapes).alias("name")).distinct()


CANDIDATES = {
    "made": "SELECT DISTINCT unnest([upper(name), upper(name) || ' tools', 'xx' || upper(name), 'the-' || upper(name) || '-kit', translate(name, 'aeiou', 'eioua'), left(name, 2) || '#' || substr(name, 3), left(name, 6), 'q' || id]) AS name FROM skills",
    "pairs": """SELECT c.name, k.name AS known, CASE WHEN lower(c.name) = lower(k.name) THEN 1 WHEN length(k.name) >= 4 AND contains(lower(c.name), lower(k.name)) OR length(c.name) >= 4 AND contains(lower(k.name), lower(c.name)) THEN 2
       WHEN abs(length(c.name) - length(k.name)) <= 15 AND 1 - levenshtein(lower(c.name), lower(k.name)) / greatest(length(c.name), length(k.name)) >= 0.88 THEN 3 END AS how FROM made c CROSS JOIN (SELECT name FROM skills WHERE id % 2 = 0) k""",
}


ENTRIES: dict[str, tuple] = {
    "st3_extract_stream": (
        lambda spark, sf_dir: runs.extracted(spark, f"{sf_dir}/documents.parquet", vocabulary(spark, sf_dir)),
        sql("SELECT id, skill_id, n, CASE WHEN n >= 3 THEN 85 WHEN n = 2 THEN 75 ELSE 60 END AS confidence, n >= 3 AS is_required FROM tagged", VOCABULARY),
    ),
    "st4_events_once": (lambda spark, sf_dir: runs.events_once(spark, f"{sf_dir}/events.parquet"), "SELECT event_id, ts, user_id, event_type FROM events"),
    "st5_closed_weeks": (
        lambda spark, sf_dir: runs.closed_weeks(spark, f"{sf_dir}/events.parquet").withColumn("total", F.round("total", 2)),
        """SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events
        WHERE date_trunc('week', ts) + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL""",
    ),
    "x03_requirements": (
        required_texts,
        sql("SELECT id, sha256(coalesce(s.t, o.t, w.t)) AS text, s.t IS NULL AS used_fallback FROM whole w LEFT JOIN stated s USING (id) LEFT JOIN other o USING (id)", REQUIRED),
    ),
    "x04_paragraph_scores": (scored_paragraphs, f"SELECT o_orderkey AS id, [{', '.join(str(s) for _, s in PARAGRAPHS)}][CAST(o_orderkey % {len(PARAGRAPHS)} AS INT) + 1]::DOUBLE AS score FROM orders"),
    "x11_extracted_skills": (
        extracted,
        sql("SELECT id, skill_id, n, CASE WHEN n >= 3 THEN 95 WHEN n = 2 THEN 85 ELSE 70 END AS confidence, n >= 2 AS is_required FROM tagged", VOCABULARY),
    ),
    "x15_in_taxonomy": (
        star_query(lambda s: e.in_taxonomy(made_candidates(s), s.skills.filter("id % 2 = 0"))),
        sql("SELECT name, arg_min(known, (how, known)) AS known, CASE min(how) WHEN 1 THEN 'exact' WHEN 2 THEN 'substring' ELSE 'similar' END AS how FROM pairs WHERE how IS NOT NULL GROUP BY name", CANDIDATES),
    ),
    "s14_extraction_profile": (
        star_query(lambda s: e.extraction_profile(s.jobs, s.job_skills, 2_000_000_000)),
        sql("SELECT k // 5 * 5 AS bin, count(*) AS n, min(k) AS least, max(k) AS most FROM (SELECT j.id, count(job_id) AS k FROM jobs j LEFT JOIN job_skills ON job_id = j.id GROUP BY j.id) GROUP BY 1"),
    ),
    "m32_unmatched_keys": (
        star_query(lambda s: m.unmatched_keys(s.companies.filter("is_active"), s.companies.select(F.lower("name").alias("key")).unionByName(s.companies.select(F.col("name").alias("key"))), "name")),
        sql("SELECT lower(name) AS key FROM companies WHERE lower(name) NOT IN (SELECT name FROM companies WHERE is_active) UNION SELECT name FROM companies WHERE NOT is_active"),
    ),
}


def queries() -> dict:
    return {name: run for name, (run, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in ENTRIES.items() if text}
