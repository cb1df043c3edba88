"""Sources, dictionaries, small enrichment steps and upkeep as queries over whole tables, each with SQL of its own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.catalog_enrich import FIELDS, LEVEL_WORDS, PLACES, ROLES, TT, _case, _nth, _sql_nth, order_titles, star_query
from laborlens.functions import markup, titles
from laborlens.operators import enrich as e
from laborlens.operators import filters, maintain, salary
from laborlens.sources import postings, tables
from laborlens.star import sql

COMMITMENTS = ["Full Time", "part-time", "Contract", "Internship", "temp", "seasonal", ""]


def all_places(raw: dict[str, DataFrame]) -> DataFrame:
    """(location) of all postings, wherever their source has it."""
    fields = {"greenhouse": "location.name", "lever": "categories.location", "ashby": "locationName", "workable": "location"}
    return reduce(DataFrame.unionByName, (raw[source].select(F.col(field).alias("location")) for source, field in fields.items()))


def raw_postings(spark, sf_dir: str) -> dict[str, DataFrame]:
    """All orders as raw postings, a quarter of them in the shape of each of the four sources."""
    k = F.col("o_orderkey")
    title = F.trim(F.concat_ws(" ", _nth(LEVEL_WORDS, k), _nth(FIELDS, k), _nth(ROLES, k)))
    place = F.replace(_nth(PLACES, k), F.lit("%s"), F.concat(F.lit("NATION_"), (k % 25).cast("string")))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("k"), k.cast("string").alias("id"), title.alias("title"), place.alias("place"), "o_orderpriority", "o_orderstatus", _nth(COMMITMENTS, k).alias("kind"), day.alias("day"))
    part = lambda i: rows.filter(F.col("k") % 4 == i)
    text = lambda c: F.col(c) if isinstance(c, str) else c
    none = F.lit(None).cast("string")
    listed = F.array(F.struct(F.col("o_orderpriority").alias("text"), F.lit("<li>x</li>").alias("content")))
    return {
        "greenhouse": part(0).select("id", F.concat(F.lit("u/"), "id").alias("absolute_url"), "title", F.struct(F.col("place").alias("name")).alias("location"), F.array(F.struct(F.col("o_orderpriority").alias("name"))).alias("departments"),
                                     F.concat(F.lit("<p>"), "o_orderstatus", F.lit("</p><b>&amp;</b>")).alias("content"), text("day").alias("updated_at")),
        "lever": part(1).select("id", F.concat(F.lit("u/"), "id").alias("hostedUrl"), F.col("title").alias("text"), (F.unix_timestamp("day", "yyyy-MM-dd") * 1000).cast("string").alias("createdAt"), F.col("o_orderstatus").alias("descriptionPlain"), none.alias("additional"),
                                F.struct(F.col("place").alias("location"), F.col("o_orderpriority").alias("team"), F.col("kind").alias("commitment")).alias("categories"), listed.alias("lists")),
        "ashby": part(2).select("id", F.lit("acme").alias("slug"), "title", F.lit("").alias("location"), F.col("place").alias("locationName"), F.struct(none.alias("name")).alias("jobLocation"), none.alias("department"), F.col("o_orderpriority").alias("team"),
                                none.alias("departmentName"), none.alias("employmentType"), F.col("kind").alias("type"), none.alias("descriptionHtml"), F.lit("").alias("description"), F.concat("o_orderstatus", F.lit(" plain")).alias("descriptionPlain"), none.alias("jobUrl"), none.alias("applyUrl"),
                                F.col("day").alias("publishedAt"), none.alias("createdAt"), none.alias("postedAt")),
        "workable": part(3).select("id", F.concat(F.lit("S"), "id").alias("shortcode"), "title", F.col("place").alias("location"), (F.col("k") % 5 == 0).alias("remote"), none.alias("url"), F.concat(F.lit("a/"), "id").alias("application_url"), F.col("o_orderpriority").alias("department"),
                                   F.col("kind").alias("worktype"), F.concat(F.lit("<b>"), "o_orderstatus", F.lit("</b>")).alias("description"), F.col("day").alias("published_on"), none.alias("created_at")),
    }


def all_postings(spark, sf_dir: str) -> DataFrame:
    out = None
    for name, raw in raw_postings(spark, sf_dir).items():
        one = postings.SOURCES[name][1](raw).select(*postings.RECORD)
        out = one if out is None else out.unionByName(one)
    return out


K = "o_orderkey"
POSTINGS = {
    "po": f"""SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS id, trim(concat_ws(' ', {_sql_nth(LEVEL_WORDS, K)}, {_sql_nth(FIELDS, K)}, {_sql_nth(ROLES, K)})) AS title, replace({_sql_nth(PLACES, K)}, '%s', 'NATION_' || CAST(o_orderkey % 25 AS VARCHAR)) AS place,
      o_orderpriority AS p, o_orderstatus AS s, {_sql_nth(COMMITMENTS, K)} AS kind, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS day FROM orders""",
    "pp": "SELECT *, regexp_matches(place, '(?i)\\b(remote|anywhere|distributed|worldwide)\\b') AS away, list_transform(string_split(place, ','), lambda x: trim(x)) AS parts FROM po".replace("\\\\b", "\\b"),
    "pq": """SELECT *, CASE WHEN away THEN '' ELSE parts[1] END AS city, CASE WHEN away THEN '' WHEN len(parts) >= 3 THEN parts[2] ELSE '' END AS state,
      CASE WHEN away THEN CASE WHEN contains(place, ' - ') THEN trim(string_split(place, ' - ')[2]) WHEN contains(place, ', ') THEN trim(string_split(place, ', ')[-1]) ELSE '' END WHEN len(parts) >= 3 THEN parts[3] WHEN len(parts) = 2 THEN parts[2] ELSE '' END AS country,
      CASE WHEN kind = '' THEN '' WHEN lower(kind) LIKE '%full%' THEN 'full-time' WHEN lower(kind) LIKE '%part%' THEN 'part-time' WHEN lower(kind) LIKE '%contract%' THEN 'contract' WHEN lower(kind) LIKE '%intern%' THEN 'internship' WHEN lower(kind) LIKE '%temp%' THEN 'temporary' ELSE kind END AS employment FROM pp""",
}
LEVEL = _case("lower(title)", titles.LEVELS, "'mid'")
SKILLS3 = "SELECT id, name, is_verified, CASE WHEN id % 3 = 0 THEN [upper(name), name || ' tool'] END AS aliases FROM skills"


def aliased(s) -> DataFrame:
    return s.skills.withColumn("aliases", F.when(F.col("id") % 3 == 0, F.array(F.upper("name"), F.concat("name", F.lit(" tool")))))


def learned(spark, sf_dir: str) -> DataFrame:
    t = order_titles(spark, sf_dir)
    known = t.filter("title like '%Engineer%'").select(F.lower("title").alias("alias"), F.lit("e").alias("canonical_id"))
    return maintain.learn_aliases(known, t.filter("title like '%Data%'").select(F.lower("title").alias("title"), F.lit("d").alias("canonical_id")))


def spaced(spark, sf_dir: str) -> DataFrame:
    """Titles with blanks doubled and in capitals against approved ones."""
    t = order_titles(spark, sf_dir)
    return maintain.fix_whitespace(t.select(F.upper(F.concat(F.lit(" "), F.replace("title", F.lit(" "), F.lit("  ")))).alias("title")), t.filter("title like '%Manager%'").select(F.col("title").alias("raw_title"), F.char_length("title").cast("long").alias("role_id")))


def dates(spark, sf_dir: str) -> DataFrame:
    shapes = F.element_at(F.array(F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), (F.unix_timestamp("ts") * 1000).cast("string"), F.lit("soon")), (F.col("event_id") % 4).cast("int") + 1)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", markup.parse_date(shapes).alias("at"))


def distinct_people(spark, sf_dir: str) -> DataFrame:
    """Exact and estimated numbers of people by type of event. Pairs are made distinct first: in one aggregation with an
    exact distinct count, Spark keeps a sketch for each pair."""
    pairs = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "user_id").distinct()
    counts = pairs.groupBy("event_type").agg(F.count("user_id").alias("exact"), F.approx_count_distinct("user_id", 0.02).alias("about"))
    return counts.select("event_type", "exact", (F.abs(F.col("about") - F.col("exact")) <= 0.1 * F.col("exact")).alias("near"))


CURRENCIES = [("NATION_1", "EUR"), ("NATION_2", "GBP"), ("Lisbon", "EUR"), ("Springfield", "USD"), ("Porto", "EUR"), ("office", "CHF")]
CODES = ["USD", "EUR", "GBP", "INR", "XXX"]
PATTERNS = [(1, r"(?i)\bsmall\s+(?:ring|gear)\b"), (1, r"(?i)\blarge\s+ring\b"), (2, r"(?i)red$"), (3, r"(?i)^blue\b")]

ENTRIES: dict[str, tuple] = {
    "s05_postings": (
        all_postings,
        sql(
            f"""SELECT ['greenhouse', 'lever', 'ashby', 'workable'][k % 4 + 1] AS source_ats, CASE WHEN k % 4 = 3 THEN 'S' || id ELSE id END AS source_job_id, CASE k % 4 WHEN 2 THEN 'https://jobs.ashbyhq.com/acme/' || id WHEN 3 THEN 'a/' || id ELSE 'u/' || id END AS source_url,
            title, place AS location_raw, CASE WHEN k % 4 = 0 THEN nullif(city, '') ELSE city END AS location_city, CASE WHEN k % 4 = 0 THEN nullif(state, '') ELSE state END AS location_state, CASE WHEN k % 4 = 0 THEN nullif(country, '') ELSE country END AS location_country,
            away OR (k % 4 = 3 AND k % 5 = 0) AS location_is_remote, p AS department, {LEVEL} AS seniority_level, CASE WHEN k % 4 = 0 THEN '' ELSE employment END AS employment_type,
            CASE k % 4 WHEN 0 THEN '<p>' || s || '</p><b>&amp;</b>' WHEN 1 THEN '<p>' || s || '</p>' || chr(10) || '<h3>' || p || '</h3>' || chr(10) || '<li>x</li>' WHEN 2 THEN '<p>' || s || ' plain</p>' ELSE '<b>' || s || '</b>' END AS description,
            CASE k % 4 WHEN 0 THEN s || chr(10) || '&' WHEN 1 THEN s || chr(10) || p || chr(10) || 'x' WHEN 2 THEN s || ' plain' ELSE s END AS description_text, day AS posted_at FROM pq""",
            POSTINGS,
        ),
    ),
    "s12_latest_boards": (
        star_query(
            lambda s: tables.latest_boards(
                s.person_weeks.groupBy("week_start").agg(F.max("position_score").cast("double").alias("growth"), F.count(F.lit(1)).cast("int").alias("rank")).select("week_start", F.lit("overall").alias("scope"), F.when(F.dayofyear("week_start") % 2 == 0, "even").otherwise("odd").alias("kind"), "rank", F.lit("all").alias("label"), "growth"),
                "overall",
            ).select("week_start", "kind", F.get_json_object("entries", "$[0].rank").cast("int").alias("rank"), F.get_json_object("entries", "$[0].growth").cast("double").alias("growth"))
        ),
        sql("SELECT week_start, CASE WHEN dayofyear(week_start) % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, CAST(count(*) AS INT) AS rank, CAST(max(position_score) AS DOUBLE) AS growth FROM person_weeks WHERE week_start = (SELECT max(week_start) FROM person_weeks) GROUP BY week_start"),
    ),
    "f07_companies": (star_query(lambda s: filters.by_company(s.jobs, [7, 11, 70]).select("id", "company_id")), sql("SELECT id, company_id FROM jobs WHERE company_id IN (7, 11, 70)")),
    "x05_skill_terms": (
        star_query(lambda s: e.skill_terms(aliased(s), strict=["small ring"], banned=["red gear"])),
        sql("SELECT DISTINCT lower(trim(t)) AS term, id AS skill_id FROM (SELECT id, unnest(list_concat([name], coalesce(aliases, []))) AS t, lower(name) AS lead FROM sk WHERE is_verified) WHERE lead <> 'small ring' AND length(trim(t)) >= 2 AND lower(trim(t)) <> 'red gear'", {"sk": SKILLS3}),
    ),
    "x06_valid_skills": (
        star_query(lambda s: s.skills.select("id", F.explode(F.array("name", F.concat("name", F.lit("_x")), F.left("name", F.lit(1)), F.lit("R"), F.lit("c "), F.repeat("name", F.lit(15)), F.col("id").cast("string"))).alias("n")).filter(e.is_valid_skill(F.col("n")))),
        sql("SELECT id, n FROM (SELECT id, unnest([name, name || '_x', name[1:1], 'R', 'c ', repeat(name, 15), CAST(id AS VARCHAR)]) AS n FROM skills) WHERE lower(trim(n)) IN ('r', 'c') OR (length(trim(n)) BETWEEN 2 AND 100 AND regexp_matches(trim(n), '\\p{L}') AND NOT contains(n, '_'))"),
    ),
    "x09_strict_skills": (
        lambda spark, sf_dir: e.strict_skills(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), PATTERNS),
        sql("SELECT * FROM (SELECT p_partkey AS id, unnest([1, 2, 3])::BIGINT AS skill_id, unnest([" + ", ".join(" + ".join(f"len(regexp_extract_all(p_name, '{p}'))" for k, p in PATTERNS if k == i) for i in (1, 2, 3)) + "])::BIGINT AS n FROM part) WHERE n > 0"),
    ),
    "x22_currencies": (
        lambda spark, sf_dir: salary.currencies_of(all_places(raw_postings(spark, sf_dir)), spark.createDataFrame(CURRENCIES, "place string, currency string")),
        sql(
            "SELECT location, arg_min(currency, (NOT whole, -length(place), place, currency)) AS currency FROM (SELECT location, c.place, currency, lower(trim(location)) = c.place AS whole FROM (SELECT DISTINCT place AS location FROM po) JOIN (VALUES "
            + ", ".join(f"('{p.lower()}', '{c}')" for p, c in CURRENCIES)
            + ") c(place, currency) ON list_contains(list_concat([lower(trim(location))], regexp_split_to_array(lower(trim(location)), '\\s*[,;|/]\\s*'), regexp_split_to_array(lower(trim(location)), '[^\\p{L}]+')), c.place)) GROUP BY location",
            POSTINGS,
        ),
    ),
    "x33_valid_salaries": (
        star_query(lambda s: s.jobs.filter("salary_min_usd is not null").withColumn("cur", _nth(CODES, F.col("id"))).filter(salary.is_valid(F.col("salary_min_usd").cast("double"), F.col("salary_max_usd").cast("double"), F.col("cur"))).select("id", "cur")),
        sql(
            "SELECT id, cur FROM (SELECT *, " + _sql_nth(CODES, "id") + " AS cur FROM jobs WHERE salary_min_usd IS NOT NULL) JOIN (VALUES " + ", ".join(f"('{c}', {salary.YEARLY.get(c, salary.YEARLY['USD'])[0]}, {salary.YEARLY.get(c, salary.YEARLY['USD'])[1]})" for c in CODES)
            + ") l(c, low, high) ON c = cur WHERE salary_min_usd >= low AND salary_max_usd <= high * 1.1::DOUBLE AND salary_min_usd <= salary_max_usd AND salary_max_usd <= 4 * salary_min_usd"
        ),
    ),
    "x35_coverage_report": (
        star_query(lambda s: e.coverage_report(s.jobs.filter("salary_min_usd is not null").select(_nth(CODES, F.col("id")).alias("currency"), F.col("salary_min_usd").alias("salary_min"), (F.col("id") % 4 == 1).alias("is_hourly")))),
        sql("SELECT " + _sql_nth(CODES, "id") + " AS currency, count(*) AS n, round(100.0 * count(*) FILTER (WHERE id % 4 = 1)::DOUBLE / count(*), 1) AS hourly_pct, count(*) FILTER (WHERE salary_min_usd > 350000) AS high FROM jobs WHERE salary_min_usd IS NOT NULL GROUP BY ALL"),
    ),
    "x38_dates": (
        dates,
        sql("SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('day', ts)::TIMESTAMP WHEN 3 THEN NULL ELSE date_trunc('second', ts)::TIMESTAMP END AS at FROM events"),
    ),
    "m22_learned_aliases": (learned, sql("SELECT l AS alias, CASE WHEN title LIKE '%Engineer%' THEN 'e' ELSE 'd' END AS canonical_id FROM tt WHERE title LIKE '%Engineer%' OR title LIKE '%Data%'", TT)),
    "m23_fixed_titles": (spaced, sql("SELECT upper(' ' || replace(title, ' ', '  ')) AS title, length(title)::BIGINT AS role_id FROM tt WHERE title LIKE '%Manager%'", TT)),
    "m24_changed_aliases": (
        star_query(lambda s: maintain.change_aliases(aliased(s).select("id", "aliases"), s.skills.select("id", F.explode(F.array(F.struct(F.concat("name", F.lit(" TOOL")).alias("alias"), (F.col("id") % 2 == 0).alias("add")), F.struct(F.lit("new").alias("alias"), F.lit(True).alias("add")))).alias("c")).select("id", "c.*"))),
        sql(
            """SELECT id, list_sort(CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN [upper(name), name || ' tool', 'new'] WHEN id % 3 = 0 THEN [upper(name), 'new'] WHEN id % 2 = 0 THEN [name || ' TOOL', 'new'] ELSE ['new'] END) AS aliases FROM skills"""
        ),
    ),
    "w09_deduped_jobs": (
        lambda spark, sf_dir: maintain.dedupe_jobs(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.col("event_type").alias("source_ats"), F.col("user_id").cast("string").alias("source_job_id"))),
        "SELECT max(event_id) AS id, event_type AS source_ats, CAST(user_id AS VARCHAR) AS source_job_id FROM events GROUP BY event_type, user_id",
    ),
    "a13_distinct_people": (
        distinct_people,
        "SELECT event_type, count(DISTINCT user_id) AS exact, true AS near FROM events GROUP BY event_type",
    ),
}


def queries() -> dict:
    return {name: run for name, (run, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in ENTRIES.items() if text}
