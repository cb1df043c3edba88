"""The star schema that the operators work on, and how the given tables stand in for it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Star:
    """Postings with their companies, roles and skills, and the people who look for them.

    companies: id, name, industry, is_active, location, region
    roles: id, normalized_title, category, job_family
    skills: id, name, category, subcategory, is_verified
    jobs: id, company_id, role_id, title, seniority_level, location_country, location_raw, location_is_remote,
        salary_min_usd, salary_max_usd, posted_at, scraped_at, last_seen_at, closed_at, is_active
    job_skills: job_id, skill_id, is_required (one row a pair)
    persons: person_id, target_role_id, cohort_id
    person_skills: person_id, skill_id, status (have or learning)
    person_weeks: person_id, week_start, position_score
    """

    companies: DataFrame
    roles: DataFrame
    skills: DataFrame
    jobs: DataFrame
    job_skills: DataFrame
    persons: DataFrame
    person_skills: DataFrame
    person_weeks: DataFrame


def _pick(c: Column, cases: dict[str, str], other: str | None = None) -> Column:
    out = F.lit(None).cast("string")
    for i, (k, v) in enumerate(cases.items()):
        out = F.when(c == k, v) if i == 0 else out.when(c == k, v)
    return out.otherwise(other) if other is not None else out


def _numbered(names: DataFrame) -> DataFrame:
    """(name, id) with ids in order of name: counted within names of equal beginnings, after those of all before."""
    each = names.withColumn("start", F.left("name", F.lit(3)))
    before = F.coalesce(F.sum("n").over(W.orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a beginning
    starts = each.groupBy("start").agg(F.count(F.lit(1)).alias("n")).select("start", before.alias("before"))
    return each.withColumn("k", F.row_number().over(W.partitionBy("start").orderBy("name"))).join(starts, "start").select("name", (F.col("before") + F.col("k")).cast("long").alias("id"))


#: Parts of the tags for each input split of their table.
PARTS_A_SPLIT = 8


def from_tables(spark: SparkSession, sf_dir: str) -> Star:
    """Orders as postings, customers as companies, nations as roles, parts as skills, events as people's doings."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    customer, nation, region, orders, part, events = map(read, ("customer", "nation", "region", "orders", "part", "events"))
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    homes = customer.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    companies = homes.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("industry"), (F.col("c_acctbal") >= 0).alias("is_active"), F.col("n_name").alias("location"), F.col("r_name").alias("region")
    )
    roles = places.filter("n_nationkey < 10").select(
        F.col("n_nationkey").cast("long").alias("id"), F.concat("n_name", F.lit(" Engineer")).alias("normalized_title"), F.col("r_name").alias("category"), F.col("r_name").alias("job_family")
    )
    names = _numbered(part.select(F.col("p_name").alias("name")).distinct())
    group = F.when(F.col("id") % 8 == 0, "AI & Machine Learning").otherwise(F.concat(F.lit("Group "), (F.col("id") % 8).cast("string")))
    kind = F.when(F.col("id") % 4 == 0, "soft").when(F.col("id") % 4 == 1, "domain").otherwise("technical")
    skills = names.select("id", "name", kind.alias("category"), group.alias("subcategory"), (F.col("id") % 10 != 9).alias("is_verified"))
    key, priority, when = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderdate")
    prefix = _pick(priority, {"1-URGENT": "Lead ", "2-HIGH": "Senior ", "5-LOW": "Junior "}, "")
    seen = when + F.make_dt_interval((key % 150).cast("int"))
    paid = key % 3 == 0
    jobs = orders.join(homes.select("c_custkey", "n_name"), F.col("c_custkey") == F.col("o_custkey")).select(
        key.alias("id"),
        F.col("o_custkey").alias("company_id"),
        F.when(key % 13 != 12, key % 10).alias("role_id"),
        F.concat(prefix, F.lit("NATION_"), (key % 10).cast("string"), F.lit(" Engineer"), F.when(key % 7 == 0, " (Remote)").otherwise("")).alias("title"),
        _pick(priority, {"1-URGENT": "lead", "2-HIGH": "senior", "3-MEDIUM": "mid", "5-LOW": "junior"}).alias("seniority_level"),
        F.col("n_name").alias("location_country"),
        F.when(key % 5 == 0, F.concat(F.lit("Remote - "), "n_name")).otherwise(F.concat(F.lit("City "), "n_name", F.lit(", "), "n_name")).alias("location_raw"),
        (key % 5 == 0).alias("location_is_remote"),
        F.when(paid, F.floor("o_totalprice").cast("int")).alias("salary_min_usd"),
        F.when(paid, F.floor(F.col("o_totalprice") * 1.25).cast("int")).alias("salary_max_usd"),
        when.alias("posted_at"),
        when.alias("scraped_at"),
        seen.alias("last_seen_at"),
        F.when(F.col("o_orderstatus") == "F", seen).alias("closed_at"),
        (F.col("o_orderstatus") != "F").alias("is_active"),
    )
    ids = part.join(names, F.col("name") == F.col("p_name")).select("p_partkey", F.col("id").alias("skill_id"))
    # Dealt by posting, in parts that follow the number of input splits, so that a task's share doesn't grow with the table.
    lines = read("lineitem")
    tagged = lines.join(ids, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("job_id"), "skill_id", (F.col("l_returnflag") != "N").alias("is_required"))
    job_skills = tagged.repartition(PARTS_A_SPLIT * lines.rdd.getNumPartitions(), "job_id").groupBy("job_id", "skill_id").agg(F.max("is_required").alias("is_required"))
    user = F.col("user_id").alias("person_id")
    persons = events.select(user, (F.col("user_id") % 10).alias("target_role_id"), (F.col("user_id") % 5).alias("cohort_id")).distinct()
    status = F.min(F.when(F.col("event_type") == "purchase", "have").otherwise("learning"))
    person_skills = events.filter("event_type in ('purchase', 'signup')").groupBy(user, (F.col("event_id") % 64 + 1).alias("skill_id")).agg(status.alias("status"))
    # Added in the events' order: a mean that is a whole number falls on either side of it, as the values are added.
    values = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("event_id", "value"))))
    mean = F.aggregate(values, F.lit(0.0), lambda total, x: total + x["value"]) / F.nullif(F.size(values), F.lit(0))
    weeks = events.groupBy(user, F.date_trunc("week", "ts").cast("date").alias("week_start")).agg((F.floor(mean).cast("int") % 101).alias("position_score"))
    return Star(companies, roles, skills, jobs, job_skills, persons, person_skills, weeks)


#: The same schema as SQL for a check by another engine; each text is the body of a common table expression.
SQL = {
    "companies": """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS industry, c_acctbal >= 0 AS is_active, n_name AS location, r_name AS region
      FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "roles": """SELECT CAST(n_nationkey AS BIGINT) AS id, concat(n_name, ' Engineer') AS normalized_title, r_name AS category, r_name AS job_family
      FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey < 10""",
    "skill_names": """SELECT CAST(row_number() OVER (ORDER BY p_name) AS BIGINT) AS id, p_name AS name FROM (SELECT DISTINCT p_name FROM part) d""",
    "skills": """SELECT id, name, CASE id % 4 WHEN 0 THEN 'soft' WHEN 1 THEN 'domain' ELSE 'technical' END AS category,
      CASE WHEN id % 8 = 0 THEN 'AI & Machine Learning' ELSE concat('Group ', CAST(id % 8 AS VARCHAR(10))) END AS subcategory, id % 10 <> 9 AS is_verified FROM skill_names""",
    "jobs": """SELECT o_orderkey AS id, o_custkey AS company_id, CASE WHEN o_orderkey % 13 = 12 THEN NULL ELSE o_orderkey % 10 END AS role_id,
      concat(CASE o_orderpriority WHEN '1-URGENT' THEN 'Lead ' WHEN '2-HIGH' THEN 'Senior ' WHEN '5-LOW' THEN 'Junior ' ELSE '' END,
             'NATION_', CAST(o_orderkey % 10 AS VARCHAR(10)), ' Engineer', CASE WHEN o_orderkey % 7 = 0 THEN ' (Remote)' ELSE '' END) AS title,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'lead' WHEN '2-HIGH' THEN 'senior' WHEN '3-MEDIUM' THEN 'mid' WHEN '5-LOW' THEN 'junior' END AS seniority_level,
      n_name AS location_country, CASE WHEN o_orderkey % 5 = 0 THEN concat('Remote - ', n_name) ELSE concat('City ', n_name, ', ', n_name) END AS location_raw,
      o_orderkey % 5 = 0 AS location_is_remote, CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_totalprice) AS INT) END AS salary_min_usd,
      CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_totalprice * 1.25) AS INT) END AS salary_max_usd, o_orderdate AS posted_at, o_orderdate AS scraped_at,
      o_orderdate + (o_orderkey % 150) * INTERVAL '1' DAY AS last_seen_at,
      CASE WHEN o_orderstatus = 'F' THEN o_orderdate + (o_orderkey % 150) * INTERVAL '1' DAY END AS closed_at, o_orderstatus <> 'F' AS is_active
      FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""",
    "job_skills": """SELECT l_orderkey AS job_id, skill_names.id AS skill_id, max(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END) = 1 AS is_required
      FROM lineitem JOIN part ON p_partkey = l_partkey JOIN skill_names ON skill_names.name = p_name GROUP BY l_orderkey, skill_names.id""",
    "persons": """SELECT DISTINCT user_id AS person_id, user_id % 10 AS target_role_id, user_id % 5 AS cohort_id FROM events""",
    "person_skills": """SELECT user_id AS person_id, event_id % 64 + 1 AS skill_id, min(CASE WHEN event_type = 'purchase' THEN 'have' ELSE 'learning' END) AS status
      FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY user_id, event_id % 64 + 1""",
    "person_weeks": """SELECT user_id AS person_id, CAST(date_trunc('week', ts) AS DATE) AS week_start, CAST(floor(avg(value)) AS INT) % 101 AS position_score
      FROM events GROUP BY user_id, date_trunc('week', ts)""",
}


def sql(body: str, more: dict[str, str] | None = None) -> str:
    """``body`` (a SELECT) after the star schema, and ``more`` named texts, as common table expressions."""
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in {**SQL, **(more or {})}.items()) + "\n" + body
