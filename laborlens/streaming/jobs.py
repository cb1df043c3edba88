"""Incremental jobs as Structured Streaming queries over file sources.

Each takes a streaming DataFrame and returns a query or a streaming DataFrame; state lives in the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from laborlens.operators.enrich import requirements, tag_requirements
from laborlens.operators.maintain import KEY, close_absent, newest, upsert_postings

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, per_batch: int = 1) -> DataFrame:
    """A folder of event files as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_batch).parquet(folder)


def _folded(spark: SparkSession, table: str, before: int | None) -> int:
    """The batch up to which the latest usable base was folded; -1 if there is none."""
    try:
        bases = spark.read.schema("upto int").parquet(f"{table}/base")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1
    usable = bases if before is None else bases.filter(F.col("upto") < before)
    return (lambda upto: -1 if upto is None else upto)(usable.agg(F.max("upto")).first()[0])


def current_postings(spark: SparkSession, table: str, start: DataFrame, before: int | None = None) -> DataFrame:
    """The postings that ``upsert_stream`` keeps below ``table``, or as the batches before one left them.

    They are a base and the deltas after it; of a posting's rows the newest counts. The base meets the deltas' keys only.
    """
    if before == 0:
        return start
    upto = _folded(spark, table, before)
    base = spark.read.schema(StructType([*start.schema.fields, StructField("upto", IntegerType())])).parquet(f"{table}/base").filter(F.col("upto") == upto).drop("upto") if upto >= 0 else start
    deltas = spark.read.schema(StructType([*start.schema.fields, StructField("batch", IntegerType())])).parquet(f"{table}/deltas").filter(F.col("batch") > upto)
    deltas = deltas if before is None else deltas.filter(F.col("batch") < before)
    newer = newest(deltas, KEY, F.desc("batch")).select(*start.columns)
    return base.join(deltas.select(*KEY).distinct(), KEY, "left_anti").select(*start.columns).unionByName(newer)


def fold(spark: SparkSession, table: str, start: DataFrame, before: int) -> None:
    """A new base of all batches before one. Deltas and bases that it takes in are no longer read, and may be removed."""
    current_postings(spark, table, start, before).write.mode("overwrite").parquet(f"{table}/base/upto={before - 1}")


def upsert_stream(batches: DataFrame, table: str, start: DataFrame, checkpoint: str, fold_every: int = 100) -> StreamingQuery:
    """ST1: scrape batches (as ``upsert_postings`` takes them) into the postings below ``table``.

    Batch n writes only the postings that it changes, as delta n: those that it has, and those of the companies that it
    scraped which it no longer has, which are closed. So a batch's writes follow its own size, and a posting may change
    its company. If a batch runs again after a failure, it reads the same earlier deltas and replaces its own. Every
    ``fold_every`` batches the deltas before are folded into a new base.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if n and n % fold_every == 0:
            fold(spark, table, start, n)
        earlier = current_postings(spark, table, start, n)
        named, scraped = batch.select(*KEY).distinct(), batch.select("source_ats", "company_id").distinct()
        known = earlier.join(named, KEY, "left_semi")
        absent = earlier.filter("is_active").join(scraped, ["source_ats", "company_id"], "left_semi").join(named, KEY, "left_anti")
        at = batch.agg(F.max("seen_at").alias("at"))
        closed = close_absent(absent.join(F.broadcast(at)), batch, F.col("at"))  # one row
        changed = upsert_postings(known.unionByName(closed.select(*start.columns)), batch)
        changed.select(*start.columns).write.mode("overwrite").parquet(f"{table}/deltas/batch={n}")

    return batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def since_last_run(runs: DataFrame, rows: DataFrame, column: str, as_of, lookback_days: int = 90) -> DataFrame:
    """ST2's batch twin: ``rows`` newer than the start of the last completed run (``runs``: started_at, status), or of
    the last 90 days if there is none."""
    mark = runs.filter("status = 'completed'").agg(F.max("started_at").alias("mark"))
    floor = F.coalesce("mark", F.date_sub(F.lit(as_of), lookback_days).cast("timestamp"))
    return rows.join(F.broadcast(mark)).filter(F.col(column) > floor).drop("mark")  # one row


def extract_stream(docs: DataFrame, terms: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """ST3: new descriptions (id, text) to skill tags, a folder a batch; a batch that runs again replaces its own."""

    def write(batch: DataFrame, n: int) -> None:
        text = requirements(batch).persist(StorageLevel.DISK_ONLY)
        tag_requirements(text, terms).write.mode("overwrite").parquet(f"{path}/batch={n}")
        text.unpersist()

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_repeats(events: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """ST4: the first of each key within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def weekly_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """ST5: rows and values by ISO week and type, emitted when the week is over. Windows start on Mondays."""
    week = F.window("ts", "7 days", startTime="4 days")
    counts = events.withWatermark("ts", delay).groupBy(week.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").cast("date").alias("week_start"), "event_type", "n", "total")


def live(postings: DataFrame, as_of, days: int = 90) -> DataFrame:
    """ST6's batch twin: open, and seen in the last 90 days."""
    return postings.filter(F.col("closed_at").isNull() & (F.col("last_seen_at") >= F.date_sub(F.lit(as_of), days)))


CLOSED = "source_ats string, source_job_id string, last_seen_at timestamp, closed_at timestamp"


def liveness_stream(seen: DataFrame, days: int = 90, delay: str = "1 day") -> DataFrame:
    """ST6: sightings (source_ats, source_job_id, ts) as postings that close, once each has gone unseen for so many days
    of event time. The state of a posting is its last sighting; one that comes back is open again."""
    span = days * 86_400_000

    def of(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            gaps = [state.get[0]]
            state.remove()
        else:
            times = sorted({int(t.timestamp() * 1000) for f in frames for t in f.ts} | ({state.get[0]} if state.exists else set()))
            gaps = [a for a, b in zip(times[:-1], times[1:], strict=True) if b - a > span]
            state.update((times[-1],))
            state.setTimeoutTimestamp(max(times[-1] + span, state.getCurrentWatermarkMs() + 1))
        if gaps:
            last = pd.to_datetime(pd.Series(gaps), unit="ms")
            yield pd.DataFrame({"source_ats": key[0], "source_job_id": key[1], "last_seen_at": last, "closed_at": last + pd.Timedelta(days=days)})

    keyed = seen.select("source_ats", "source_job_id", "ts").withWatermark("ts", delay).groupBy("source_ats", "source_job_id")
    return keyed.applyInPandasWithState(of, CLOSED, "last long", "append", GroupStateTimeout.EventTimeTimeout)
