"""Small helpers that the corpus operators share."""

from __future__ import annotations

import operator
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITESPACE = " \t\n\x0b\x0c\r"
#: A run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="laborlens-")
        spark.sparkContext.setCheckpointDir(folder)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_table(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder for a written table."""
    return f"{shared_folder(spark).rstrip('/')}/laborlens/{name}-{uuid.uuid4().hex}"


def drop_table(spark: SparkSession, path: str) -> None:
    """Removes a table that ``new_table`` named."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: columnar and compressed, for wide rows."""
    path = new_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys that hold more than one in so many of the rows are met map-side, so that there are no more of them than that.
HOT = 1000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """``rows`` with what ``table`` holds under their ``keys``, however many rows share a key. ``how``: inner or left.

    ``table`` has one row a key and, as ``n``, the number of ``rows`` that have it; ``total`` is their number, or more.
    Keys of over ``total`` / HOT rows, HOT at most, are broadcast; all others are shuffled. Null keys meet nothing.
    """
    least = max(total // HOT, 1)
    added = [c for c in table.columns if c not in keys]
    none = [F.lit(None).cast(table.schema[c].dataType).alias(c) for c in added]
    whole = reduce(operator.and_, (F.col(k).isNotNull() for k in keys))
    met = rows.filter(whole).join(F.broadcast(table.filter(F.col("n") > least)), keys, "left")
    out = met.filter("n is not null").unionByName(met.filter("n is null").drop(*added).join(table.filter(F.col("n") <= least), keys, how))
    return out.unionByName(rows.filter(~whole).select(*rows.columns, *none)) if how == "left" else out


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else untouched. ``lower`` does that faster for texts that are ASCII only."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def word_count(c: Column) -> Column:
    """Words of a text as long; none in a null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
