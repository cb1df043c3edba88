"""From raw documents to a training mix: STAGES in order, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens.llm import decontam, lang_id, line_dedup, mixing, near_dedup
from laborlens.llm.common import drop_table, new_table
from laborlens.llm.queries import learned, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no language has half of the letters, or that have no letters, go."""
    return lang_id.keep_identified(docs, learned(docs)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents share stay in the one with the largest id; n_chars follows the text."""
    cleaned = line_dedup.dedup_lines(docs.select(*COLUMNS), 3, 20)
    return cleaned.withColumn("text", F.col("kept")).withColumn("n_chars", F.char_length("kept").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id."""
    return near_dedup.drop_near_duplicates(docs, 5, 80).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are words of benchmark passages go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), 13).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: documents with the times that each goes in; documents that it takes nothing of go."""
    found = mixing.mixed(docs.select(*COLUMNS), weights=(5, 2, 1), share=1.0, most=3.0).filter("taken > 0")
    return found.select(*(F.col("row").getField(c).alias(c) for c in COLUMNS), "size", "source_size", "target", "taken", "times")


STAGES = [("language ID", language), ("line dedup", lines), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("mixing", mixture)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table; those of earlier stages are removed once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_table(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_table(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


#: Language ID is a trained model and near-dedup's graph is recursive: tests hold the stages against brute force.
ORACLE_SQL = None
