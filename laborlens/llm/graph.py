"""Connected components of an undirected graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.llm.common import cut, lookup


def _minimum(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minimum(both).withColumn("m", F.least("m", "u"))
    return lookup(both, least, ["u"], 2 * rows).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _minimum(down)
    moved = lookup(down, least, ["u"], rows).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


#: Rows of a partition of edges between steps.
ROWS = 200_000


def _packed(edges: DataFrame, rows: int) -> DataFrame:
    """``edges`` in about as few partitions as ``rows`` of them need, so that small graphs take few tasks and files."""
    return edges.coalesce(max(1, rows // ROWS))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v), root the smallest node it reaches.

    Each round hangs neighbours under their smallest neighbour, until a round changes nothing: then all edges are stars.
    Rounds are compared by the number and the sum of hashes of their edges. Self-loops and nulls are ignored, and an
    edge may come twice or both ways round. A centre of any number of edges is spread over tasks.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v"))
    mark = [F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hashes"), F.sum(F.xxhash64(F.lit(1), "u", "v").cast("decimal(38,0)")).alias("more")]
    told = now.agg(*mark).first()
    rows = told["rows"]
    while True:
        before = told
        hung = cut(_packed(_large_star(now, rows), rows))  # the next step reads it four times: its plan would hold this one as often
        now = cut(_packed(_small_star(hung, rows), rows))
        told = now.agg(*mark).first()
        if told == before:
            break
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
