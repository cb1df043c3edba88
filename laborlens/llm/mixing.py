"""Mixing sources to target weights by nested hash thresholds.

Every document gets a hash of its id. A histogram of sizes by source and hash bucket tells in which bucket a
source's budget ends; only that bucket is split further, level by level. The result is one threshold a source, and
the mix is a filter on the hash: nothing is sorted, and a smaller budget always takes a subset of a larger one.

Defined results: a null text has size 0; a null source is a source of its own and comes last; rows that repeat an id
share its hash and are taken or left together; an empty table gives an empty mix; columns that are not used, whatever
their names, pass through ``mixed`` untouched, within its struct. A source of size 0 has target 0. Documents of equal hash form one
group, which is taken if that brings the source nearer to its target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laborlens.llm.common import cut, lookup, word_count

#: Bits of the hash and how many of them each level of the histogram looks at.
BITS, STEP = 24, 8


def id_hash(c: Column) -> Column:
    """24 bits that depend on the id alone, so that reruns and other engines agree."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Targets by source of ``sizes`` (source, source_size, n): ``share`` of all words, by weight, below a ceiling.

    Sources in code point order, null last, take the weights in turn. A target stops at ``most`` times its source's
    size and the excess goes to the others by weight. That is a common level: with sources in order of ceiling over
    weight, those whose ceiling lies under the level of the rest stop at it. One row a source is small enough for
    one task.
    """
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), F.pmod("nth", F.lit(len(weights))).cast("int") + 1)
    ranked = sizes.withColumn("nth", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", w).withColumn("ceiling", most * F.col("source_size").cast("double"))
    order = W.orderBy(F.col("ceiling") / F.col("weight"), "nth")
    before = F.coalesce(F.sum("ceiling").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    budget = F.lit(share) * F.sum(F.col("source_size").cast("double")).over(W.partitionBy())
    level = (budget - before) / rest
    stops = F.col("level") * F.col("weight") >= F.col("ceiling")
    ranked = ranked.withColumn("level", level).withColumn("stops", stops)
    common = F.min(F.when(~F.col("stops"), F.struct("nth_level", "level"))).over(W.partitionBy())["level"]
    return (
        ranked.withColumn("nth_level", F.row_number().over(order))
        .withColumn("common", common)
        .select("source", "source_size", "n", F.when(F.col("stops"), F.col("ceiling")).otherwise(F.col("common") * F.col("weight")).alias("target"))
    )


def thresholds(docs: DataFrame, goals: DataFrame) -> DataFrame:
    """The hash below which each source's documents fill its budget: (source, cut_at) for ``goals`` (source, budget).

    ``docs`` (source, h, size). Each level splits one bucket a source into 2**STEP, so that a level reads only the
    documents of the open buckets, and no task sees more than 2**STEP histogram rows of a source. Beside the first
    hash of the open bucket (``low``) goes the number of words under it (``below``).
    """
    bounds = goals.select(F.col("source").alias("b_source"), "budget", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("below"))
    same = F.col("source").eqNullSafe(F.col("b_source"))
    for level in range(BITS // STEP):
        width = 1 << (BITS - STEP * (level + 1))
        histogram = (
            docs.join(bounds, same & (F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + (width << STEP)))
            .groupBy("source", "budget", "low", "below", F.floor((F.col("h") - F.col("low")) / width).alias("slot"))
            .agg(F.sum("size").alias("words"))
            .withColumn("upto", F.col("below") + F.sum("words").over(W.partitionBy("source").orderBy("slot")))
        )
        first = F.struct((F.col("low") + F.col("slot") * width).alias("low"), (F.col("upto") - F.col("words")).alias("below"), "upto")
        boundary = histogram.groupBy("source").agg(F.min(F.when(F.col("upto") > F.col("budget"), first)).alias("at"))
        # No boundary: the budget holds everything, and the open bucket is the empty one past the last hash.
        past = F.when(F.col("at").isNotNull(), F.col("at.low")).otherwise(F.lit(1 << BITS) if level == 0 else F.col("low"))
        bounds = cut(
            bounds.join(boundary, same, "left").select(
                "b_source", "budget", past.cast("long").alias("low"), F.coalesce("at.below", "below").alias("below"), F.col("at.upto").alias("upto")
            )
        )
    nearer = F.coalesce(F.col("below") + F.col("upto") <= 2 * F.col("budget"), F.lit(False))
    return bounds.select(F.col("b_source").alias("source"), (F.col("low") + nearer.cast("long")).alias("cut_at"))


#: Sources up to which their goals, a few numbers each, are broadcast; beyond, frequent sources alone are.
MAP_SIDE_SOURCES = 100_000


def _sized(size: Column | None) -> list[Column]:
    return [(word_count(F.col("text")) if size is None else size).cast("long").alias("size"), id_hash(F.col("doc_id")).alias("h")]


def _times(rows: DataFrame, docs: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``docs`` (source, size, h, ...) with source_size, target and times, as ``rows`` (source, size, h) decide.

    A target over its source's size takes whole passes over the source, and the hash threshold decides on the last,
    partial one.
    """
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, share, most)
    goals = goals.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goals = cut(goals.withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size")))
    at = thresholds(rows, goals).withColumnRenamed("source", "t_source")
    goals = goals.join(at, F.col("source").eqNullSafe(F.col("t_source")), "left")
    # A source and whether it is null: keys that meet as they are.
    key = [F.coalesce("source", F.lit("")).alias("key"), F.col("source").isNull().alias("none")]
    goals = cut(goals.select(*key, "source_size", "target", "passes", "cut_at", "n"))
    keyed = docs.select("*", *key)
    if goals.count() <= MAP_SIDE_SOURCES:
        met = keyed.join(F.broadcast(goals), ["key", "none"])
    else:
        met = lookup(keyed, goals, ["key", "none"], goals.agg(F.sum("n")).first()[0])
    return met.withColumn("times", (F.col("passes") + F.when(F.col("h") < F.col("cut_at"), 1).otherwise(0)).cast("int"))


def mix(docs: DataFrame, size: Column | None = None, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """How often each row of ``docs`` (doc_id, source, text) goes into the mix.

    Returns doc_id, size, source_size, target, taken (words, repeats counted).
    """
    rows = cut(docs.select("doc_id", "source", *_sized(size)))
    return _times(rows, rows, weights, share, most).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed(docs: DataFrame, size: Column | None = None, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """The mix itself: (row, size, source_size, target, taken, times) with each row of ``docs`` as the struct ``row``."""
    own = _sized(size)
    whole = docs.select(F.struct("*").alias("row"), "source", *own)
    found = _times(cut(docs.select("source", *own)), whole, weights, share, most)
    return found.select("row", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")
