"""Registries, taxonomies, decision files, and the sinks for boards and candidate lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPANIES = "slug string, name string, ats string, industry string"
TAXONOMY = "name string, children array<struct<name:string,children:array<struct<name:string,external_id:string>>>>"
BOARD = "kind string, scope string, rank int, label string, growth double"


def company_registry(spark: SparkSession, path: str) -> DataFrame:
    """Companies as (slug, name, ats, industry) from CSV with a header."""
    return spark.read.schema(COMPANIES).option("header", True).csv(path)


def registry_stats(companies: DataFrame) -> DataFrame:
    """Companies by system and industry, with totals of each, as (ats, industry, n); null stands for all."""
    return companies.groupingSets([["ats", "industry"], ["ats"], ["industry"], []], "ats", "industry").agg(F.count(F.lit(1)).alias("n"))


def role_taxonomy(spark: SparkSession, roles: str, aliases: str) -> tuple[DataFrame, DataFrame]:
    """Canonical roles (JSON lines: id, title, category, job_family) and the alias map (alias, canonical_id)."""
    return spark.read.schema("id string, title string, category string, job_family string").json(roles), spark.read.schema("alias string, canonical_id string").json(aliases)


def new_skills(taxonomy: DataFrame, known: DataFrame, skip_names: list[str] = (), skip_categories: list[str] = (), skip_pairs: list[tuple[str, str]] = ()) -> DataFrame:
    """Leaves of a three-level ``taxonomy`` that are new by lower-cased name, once each.

    Names that are empty or over 100 characters, and skipped names, categories and (category, subcategory) pairs, stay
    out.
    """
    subs = taxonomy.select(F.col("name").alias("category"), F.explode("children").alias("s"))
    leaves = subs.select("category", F.col("s.name").alias("subcategory"), F.explode("s.children").alias("leaf")).select("category", "subcategory", F.trim("leaf.name").alias("name"), "leaf.external_id").withColumn("key", F.lower("name"))
    fine = (F.char_length("name").between(1, 100)) & ~F.col("key").isin(list(skip_names)) & ~F.col("category").isin(list(skip_categories))
    for category, sub in skip_pairs:
        fine = fine & ~((F.col("category") == category) & (F.col("subcategory") == sub))
    return leaves.filter(fine).join(known.select(F.lower("name").alias("key")), "key", "left_anti").groupBy("key").agg(F.min(F.struct("name", "category", "subcategory", "external_id")).alias("s")).select("s.*")


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """Review decisions (raw_title, action, role_title) from CSV or JSON files, told apart by their ending."""
    schema = "raw_title string, action string, role_title string"
    if path.endswith(".csv"):
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.schema(f"decisions array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(path).select(F.explode("decisions").alias("d")).select("d.*")


def write_candidates(candidates: DataFrame, path: str) -> None:
    """Candidates by companies and postings, as JSON lines in order."""
    candidates.orderBy(F.desc("company_count"), F.desc("job_count"), "name").write.mode("overwrite").json(path)


def write_boards(rows: DataFrame, path: str) -> None:
    """``rows`` with a week_start take the place of those weeks' rows only, so that a rerun changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week_start").parquet(path)


def latest_boards(rows: DataFrame, scope: str) -> DataFrame:
    """The newest week of a scope by kind, entries in order of rank, as JSON."""
    own = rows.filter(F.col("scope") == scope)
    newest = own.join(own.agg(F.max("week_start").alias("week_start")), "week_start", "left_semi")
    return newest.groupBy("week_start", "kind").agg(F.to_json(F.array_sort(F.collect_list(F.struct("rank", "label", "growth")))).alias("entries"))


def scopes(rows: DataFrame) -> DataFrame:
    """Scopes that have boards."""
    return rows.select("scope").distinct()
