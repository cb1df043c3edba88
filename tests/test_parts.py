"""What a task holds: tags dealt by splits, sketches by group only."""

from __future__ import annotations

from laborlens import catalog_intake, star

SF = "/root/testdata/sf0.01"


def test_tags_are_dealt_by_posting_in_parts_that_follow_the_input(spark):
    parts = spark.read.parquet(f"{SF}/lineitem.parquet").rdd.getNumPartitions() * star.PARTS_A_SPLIT
    tags = star.from_tables(spark, SF).job_skills
    assert tags.rdd.getNumPartitions() == parts
    plan = tags.groupBy("job_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(job_id") == 1  # once dealt, postings stay where they are


def test_sketches_are_kept_by_type_only(spark):
    plan = catalog_intake.distinct_people(spark, SF)._jdf.queryExecution().executedPlan().toString()
    sketched = [line for line in plan.splitlines() if "approx_count_distinct" in line]
    assert sketched and all("user_id" not in line.split("keys=")[1].split("]")[0] for line in sketched if "keys=" in line)
