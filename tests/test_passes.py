"""How often texts are read, and how many batches a stream of them is."""

from __future__ import annotations

import re

from laborlens.operators import enrich
from laborlens.streaming import runs

TEXTS = [(i, f"Requirements\nmachine learning engineer number {i}\nBenefits\nmachine c++") for i in range(9)]


def scans(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_texts_are_tagged_and_cut_in_one_pass(spark, tmp_path):
    spark.createDataFrame(TEXTS, "id long, text string").repartition(9).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    terms = spark.createDataFrame([("machine learning", 1), ("machine learning engineer", 2), ("machine", 3), ("c++", 4)], "term string, skill_id long")
    tagged = enrich.tag_skills(docs, terms)
    assert scans(tagged) <= 3 and scans(enrich.requirements(docs)) <= 2  # counts stand twice in the plan, and terms with signs meet the text again
    assert {tuple(r)[1:] for r in tagged.collect()} == {(1, 1), (2, 1), (3, 2), (4, 1)} and tagged.count() == 36


def test_small_files_are_one_batch(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(9).write.parquet(str(tmp_path / "docs"))
    terms = spark.createDataFrame([("machine", 3)], "term string, skill_id long")
    found = runs.extracted(spark, str(tmp_path / "docs"), terms)
    assert found.count() == 9 and len({re.search("batch=[0-9]+", f).group() for f in found.inputFiles()}) == 1
