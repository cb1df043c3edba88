"""Streams run to their end over a given table, with state and results in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from laborlens.streaming import jobs


#: Bytes of files that a batch takes where batches needn't be many: each plans its joins anew.
BATCH_BYTES = 512 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that spark.checkpoint.dir names; only a local master may do without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="laborlens-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/laborlens/{name}-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, path: str, limit: tuple[str, int] = ("maxFilesPerTrigger", 4)) -> DataFrame:
    """The table at ``path``, a folder or a file, as a stream of its files; ``limit`` bounds a batch."""
    schema = spark.read.parquet(path).schema
    pattern = re.sub("[^/]+$", lambda name: f"{{{name[0]}}}", path.rstrip("/"))  # a single file is taken by a pattern only
    rows = spark.readStream.schema(schema).option(*limit).parquet(pattern)
    zoneless = [f.name for f in schema if f.dataType.typeName() == "timestamp_ntz"]  # watermarks take instants
    return rows.withColumns({c: rows[c].cast("timestamp") for c in zoneless})


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """What ``stream`` emits until its source has no more, as a table. A run that is cut off goes on from its checkpoint."""
    spark = stream.sparkSession
    path = shared_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def events_once(spark: SparkSession, path: str) -> DataFrame:
    """ST4: the events of a source that delivers each twice, each once."""
    twice = stream_of(spark, path).select("event_id", "ts", "user_id", "event_type").unionByName(stream_of(spark, path).select("event_id", "ts", "user_id", "event_type"))
    return run_to_end(jobs.without_repeats(twice, ["event_id"], "3650 days"), "events-once")


def closed_weeks(spark: SparkSession, path: str) -> DataFrame:
    """ST5: counts of the weeks that are over by the last event."""
    return run_to_end(jobs.weekly_counts(stream_of(spark, path)), "closed-weeks")


def extracted(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """ST3: skills of a stream of descriptions (doc_id, text)."""
    out = shared_path(spark, "extracted")
    docs = stream_of(spark, path, ("maxBytesPerTrigger", BATCH_BYTES)).selectExpr("doc_id as id", "text")
    jobs.extract_stream(docs, terms, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("batch")
