"""Filter interaction audit: what each filter of a cascade removes in every order, kept up to date as a stream.

Which filters a document fails is a mask. Four filters look at the text alone (``text_failures``); the last one, copies,
depends on the other documents: a text fails it if a document with a smaller id has the same text, removed or not.
``advance`` reads files as available-now micro-batches and keeps, in a table keyed by text, the smallest id that has come
and the rows that hold it. A row with a larger id counts as a copy at once; when a smaller id arrives, the rows that were
first until then are retracted (-1 without the copy's bit) and counted as copies (+1). So the sum of all changes is the
number of documents of each part and mask after every batch, and no document is read twice. Progress is in the stream's
checkpoint, state and changes lie beside it by batch: a job that is cut off goes on where it was. State grows by a row
whenever a text's smallest id changes; a batch reads the state of its own texts only after a join with all of it.

Equal rows are counted before they are joined, and texts that many rows of a batch share are met map-side, so that a text
that a third of all rows share is no task's own.

``interactions`` turns the counts, 32 masks a part, into the audit of all 120 orders: a filter removes what fails it and
no filter before it; its Shapley sum over all orders is 120 / (number of failed filters) for each document that fails it.

Defined results: a null text is empty; a null source is the part ''; a document without an id is no copy and makes none;
rows that share id and text count each, and fail the copies filter only by a smaller id; labels of an id are merged by
their largest values; documents without labels are neither good nor toxic; an empty table has no parts. Other columns of
the documents are ignored whatever their names.
"""

from __future__ import annotations

import itertools
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens.llm.common import cut, lookup, new_table, require, word_count

LETTERS = "ABCDE"
#: Bit of the filter that looks for copies.
COPY = 1 << LETTERS.index("E")
WORDS_APART = r"[\x20\x09-\x0D]+"
COUNTS = "part string, mask int, good boolean, toxic boolean, n long"


def text_failures(text: Column) -> Column:
    """The bits of A to D: few words, few distinct words, many capitals, or one of the characters #$%&*|."""
    words = word_count(text)
    distinct = F.size(F.array_distinct(F.filter(F.split(text, WORDS_APART), lambda w: w != "")))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    fails = [words < 200, 100 * distinct < 50 * words, 100 * capitals > 2 * F.char_length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0)).cast("int")


ROW = "text binary, doc_id long, part string, mask int, good boolean, toxic boolean, n long"
OWN = ["part", "mask", "good", "toxic"]


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, doc_id, part, mask, good, toxic, n) of the documents, a text as 128 bits of SHA-256; equal rows as one."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text_failures(text).alias("mask"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    text = F.when(F.col("doc_id").isNotNull(), F.col("text"))  # a document without an id is like no other
    return rows.withColumn("text", text).groupBy("text", "doc_id", *OWN).agg(F.count(F.lit(1)).alias("n"))


def _copies(rows: DataFrame, sign: int = 1) -> DataFrame:
    """``rows`` as counts of documents that fail the copies filter too."""
    return rows.select("part", F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), "good", "toxic", (sign * F.col("n")).alias("n"))


def _firsts(rows: DataFrame, sign: int = 1) -> DataFrame:
    return rows.select(*OWN, (sign * F.col("n")).alias("n"))


def take_in(rows: DataFrame, earlier: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes of the counts, rows of state) by a batch of ``judged`` rows. ``earlier``: the rows of state before it.

    State has the rows that held their text's smallest id when they came; those of the smallest one are what counts.
    """
    arrived = rows.filter("text is not null")
    least = arrived.groupBy("text").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    met = earlier.join(least.select("text", F.col("least").alias("new")), "text")
    held = met.groupBy("text").agg(F.min("doc_id").alias("old"))
    least = cut(least.join(held, "text", "left").select("text", F.least("least", F.coalesce("old", "least")).alias("least"), "old", "n"))
    total = least.agg(F.sum("n")).first()[0] or 0
    now = lookup(arrived.withColumnRenamed("n", "rows"), least.select("text", "least", "n"), ["text"], total).select("text", "doc_id", *OWN, F.col("rows").alias("n"), "least")
    firsts = now.filter("doc_id = least")
    passed = met.drop("new").join(least.filter("least < old"), "text").filter("doc_id = old").select(*OWN, met["n"])  # first until now
    changes = [_firsts(rows.filter("text is null")), _firsts(firsts), _copies(now.filter("doc_id > least")), _firsts(passed, -1), _copies(passed)]
    changes = reduce(DataFrame.unionByName, changes).groupBy(*OWN).agg(F.sum("n").alias("n")).filter("n <> 0")
    return changes, firsts.select("text", "doc_id", *OWN, "n")


def advance(docs: DataFrame, labels: DataFrame, folder: str) -> None:
    """Takes in the files of the stream ``docs`` that ``folder`` has not seen yet, and returns when that is done.

    A batch writes changes and state below its own number and reads the state of those before it; if it runs again after
    a failure, it replaces what it had written.
    """

    def take(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        path = f"{folder}/rows"
        judged(batch, labels).write.mode("overwrite").parquet(path)
        rows = spark.read.schema(ROW).parquet(path)
        earlier = spark.read.schema(f"{ROW}, batch int").parquet(f"{folder}/state").filter(F.col("batch") < n).drop("batch") if n else rows.filter("false")
        changes, state = take_in(rows, earlier)
        state.write.mode("overwrite").parquet(f"{folder}/state/batch={n}")
        changes.coalesce(1).write.mode("overwrite").parquet(f"{folder}/changes/batch={n}")

    docs.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def counted(spark: SparkSession, folder: str) -> DataFrame:
    """(part, mask, good, toxic, n) of all documents that ``folder`` has taken in."""
    changes = spark.read.schema(f"{COUNTS}, batch int").parquet(f"{folder}/changes")
    return changes.groupBy(*OWN).agg(F.sum("n").alias("n")).filter("n > 0")


ORDERS = ["".join(p) for p in itertools.permutations(LETTERS)]


def interactions(counts: DataFrame) -> DataFrame:
    """The audit of every part, order of the filters and step, from its counts by mask."""
    per_mask = counts.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    parts = per_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 at most
    steps = F.explode(F.array(*(F.lit(o) for o in ORDERS))).alias("filter_order")
    rows = parts.select("part", "masks", steps).select("part", "masks", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    bit = lambda c: F.pow(F.lit(2), F.ascii(c) - ord(LETTERS[0])).cast("int")
    before = F.aggregate(F.sequence(F.lit(1), F.lit(len(LETTERS))), F.lit(0), lambda a, k: a + F.when(k < F.col("step"), bit(F.substring(F.col("filter_order"), k, F.lit(1)))).otherwise(0))
    rows = rows.select("part", "masks", "filter_order", "step", before.alias("before"), bit(F.substring(F.col("filter_order"), F.col("step"), F.lit(1))).alias("own"))

    def total(what: str, which) -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda a, m: a + F.when(which(m["mask"]), m[what]).otherwise(0))

    own, earlier = F.col("own"), F.col("before")
    removed = lambda m: ((m.bitwiseAND(own)) != 0) & (m.bitwiseAND(earlier) == 0)
    share = F.aggregate("masks", F.lit(0).cast("long"), lambda a, m: a + F.when(m["mask"].bitwiseAND(own) != 0, m["n"] * F.floor(F.lit(len(ORDERS)) / F.bit_count(m["mask"]))).otherwise(0))
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(earlier.bitwiseOR(own)) == 0).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(earlier) != 0)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        share.alias("shapley"),
    )


def audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = 4) -> DataFrame:
    """The audit of the documents in the files at ``path``, read as about ``batches`` micro-batches."""
    files = spark.read.parquet(path)
    require(files, "doc_id", "text", "source")
    per_batch = max(1, -(-len(files.inputFiles()) // batches))
    pattern = re.sub("[^/]+$", lambda name: f"{{{name[0]}}}", path.rstrip("/"))  # streams take a single file by a pattern only
    docs = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", per_batch).parquet(pattern)
    folder = new_table(spark, "filter-audit")
    if files.isEmpty():
        return interactions(spark.createDataFrame([], COUNTS))
    advance(docs, labels, folder)
    return interactions(counted(spark, folder))
