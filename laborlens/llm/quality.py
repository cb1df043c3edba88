"""Quality rules: fixed rules, and robust outliers among the texts of a language and source.

Five statistics of a text, as counts; four ratios of them, log-transformed, are the vector that is judged. Repeated
lines count as -log(1 - share): a share is bounded, and so would be its distance, below the quantile.
Repeated words count as a share, which rejects no text alone: from 30 % on the fixed rules do. Each group
of language and source gets a minimum-covariance-determinant estimate of centre and scatter over all of its rows.
Three starts (medians and deviations; all rows; the rows nearest to the medians of all coordinates by rank) take two
concentration steps each: the share h = 75 % with the least distances is estimated anew. The start with the least
determinant then takes further steps until its determinant no longer falls. Distances are scaled so that their median
is that of the chi-squared law. A text whose squared distance lies beyond the law's quantile is rejected.

Moments are sums and quantiles are read off histograms, so a step is an aggregation with map-side sums whatever the
size of the largest group, and no rows are sampled; a histogram has a few thousand slots a group at most. Coordinates
are rounded to 1 / GRID, so that their sums are exact and reruns agree. Statistics that are 0 for most texts would make
a scatter singular; ``LEAST`` is the standard deviation that every coordinate has at least, added to every scatter.
Texts of groups of under ``MIN_ROWS`` rows are judged by the estimate of their whole language, and those of languages
that small by that of the whole corpus; only where that is as small there is no estimate, and its texts pass.

Defined results: a null text has no words and fails the rules; null languages and sources are groups of their own;
repeated rows and ties each get the same verdict; an empty table gives none; other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laborlens.llm.common import cut
from laborlens.llm.shingles import WordHashes, small_batches, texts, windows

SPACES_AND_TAILS = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
RUN = 8
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Coordinates of the vector and the least standard deviation of each.
LEAST = {"x0": 0.1, "x1": 0.4, "x2": 1.0, "x3": 1.0}
D = len(LEAST)
MIN_ROWS, SHARE, LEVEL = 100, 0.75, 0.9999
#: Starts, their steps, and further steps of the best at most.
STARTS, STEPS, MORE_STEPS = 3, 2, 12
GRID = 1024


def statistics_of(text: bytes | None, cache: WordHashes) -> tuple[int, ...]:
    """The counts of one text, in the order of STATISTICS."""
    text = text or b""
    words = text.split()
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    repeats = 0
    for line in lines:
        if line.strip():
            repeats += line in seen
            seen.add(line)
    runs = windows(cache.of(words), RUN)
    _, which, count = np.unique(runs, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[which] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + RUN, -1)
    return len(words), len(text.translate(None, SPACES_AND_TAILS)), len(text) - len(text.translate(None, SYMBOLS)), repeats, int((np.cumsum(edge) > 0).sum()), len(lines)


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source) and the counts of every whole text."""
    keys = ["doc_id", "lang", "source"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in small_batches(batches, "text"):
            counts = zip(*(statistics_of(t, cache) for t in texts(batch, "text")), strict=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(c, pa.int64()) for c in counts)], [*keys, *STATISTICS])

    schema = T.StructType([docs.schema[k] for k in keys])
    for name in STATISTICS:
        schema = schema.add(name, "long")
    return docs.select(*keys, "text").mapInArrow(of, schema)


def _vector() -> dict[str, Column]:
    rate = lambda a, b: F.log1p(100.0 * F.col(a) / F.greatest(F.col(b), F.lit(1)))
    free = lambda a, b: F.log1p(-100.0 * F.log(1 - F.col(a) / F.greatest(F.col(b), F.lit(1))))
    out = {"x0": F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)), "x1": rate("n_symbols", "word_chars"), "x2": free("n_dup_lines", "n_lines"), "x3": rate("n_repeat_words", "n_words")}
    return {name: F.round(x * GRID) / GRID for name, x in out.items()}


def _grouped(rows: DataFrame, min_rows: int) -> DataFrame:
    """``rows`` with ``group``, by whose estimate they are judged (null without one), and ``feeds``, all groups whose
    estimate they are part of. A row a language and source, which is what the windows run over, is a small table."""
    sizes = rows.groupBy("lang", "source").agg(F.count_if(~F.col("base_failed")).alias("n"))
    of_lang, of_all = F.sum("n").over(W.partitionBy("lang")), F.sum("n").over(W.partitionBy())
    level = F.when(F.col("n") >= min_rows, 2).when(of_lang >= min_rows, 1).when(of_all >= min_rows, 0)
    sizes = sizes.withColumn("level", level)
    name = lambda n: F.to_json(F.struct(F.lit(n).alias("level"), *([F.col("lang")] if n else []), *([F.col("source")] if n == 2 else [])))
    asked = {2: F.col("level") == 2, 1: F.max(F.col("level") == 1).over(W.partitionBy("lang")), 0: F.max(F.col("level") == 0).over(W.partitionBy())}
    feeds = F.array_compact(F.array(*(F.when(asked[n], name(n)) for n in (2, 1, 0))))
    group = F.coalesce(*(F.when(F.col("level") == n, name(n)) for n in (2, 1, 0)))
    sizes = cut(sizes.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), group.alias("group"), feeds.alias("feeds")))
    same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    return rows.join(sizes, same, "left").drop("g_lang", "g_source")


def _quantiles(rows: DataFrame, keys: list[str], slot: Column, share: float) -> DataFrame:
    """By ``keys``, the histogram slot up to which ``share`` of the rows lie, as ``at``; slots are counted map-side."""
    return rows.groupBy(*keys).agg(F.ceil(F.percentile(slot, share)).alias("at"))


def _medians(rows: DataFrame) -> DataFrame:
    """(group, mu, prec): medians and squared inverse deviations of each coordinate, on a grid of LEAST / 4."""
    dims = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (F.col(x) / (least / 4)).alias("v")) for i, (x, least) in enumerate(LEAST.items()))))
    long = rows.select("group", dims.alias("d")).select("group", "d.i", "d.v")
    middle = cut(_quantiles(long, ["group", "i"], F.floor("v"), 0.5).withColumnRenamed("at", "m"))
    away = long.join(middle, ["group", "i"]).withColumn("a", F.abs(F.col("v") - F.col("m") - 0.5))
    wide = _quantiles(away, ["group", "i"], F.floor("a"), 0.5).join(middle, ["group", "i"])
    of = lambda e: F.transform(F.array_sort(F.collect_list(F.struct("i", e.alias("e")))), lambda s: s["e"])
    unit = F.element_at(F.array(*(F.lit(least / 4) for least in LEAST.values())), F.col("i") + 1)
    floor = F.element_at(F.array(*map(F.lit, LEAST.values())), F.col("i") + 1)
    sd = F.greatest(1.4826 * (F.col("at") + 0.5) * unit, floor)
    both = wide.groupBy("group").agg(of((F.col("m") + 0.5) * unit).alias("mu"), of(1 / (sd * sd)).alias("inv"))
    flat = F.flatten(F.array(*(F.array(*(F.get("inv", F.lit(i)) if i == j else F.lit(0.0) for j in range(D))) for i in range(D))))
    return both.select("group", "mu", flat.alias("prec"))


def _starts(rows: DataFrame) -> DataFrame:
    """(group, start, mu, prec): the medians; the moments of all rows; those of the half that no coordinate sets apart."""
    medians = cut(_medians(rows))
    far = rows.join(_near(medians), "group")
    worst = F.greatest(*(F.get("prec", F.lit(i * D + i)) * F.pow(F.col(x) - F.get("mu", F.lit(i)), 2) for i, x in enumerate(LEAST)))
    near = far.withColumn("d2", worst)
    within = _quantiles(near, ["group"], _slot(), 0.5)
    inner = _estimate(near.join(within, "group").filter(_slot() <= F.col("at")), ["group"])
    all_ = _estimate(rows, ["group"])
    starts = [medians, all_.drop("logdet"), inner.drop("logdet")]
    return reduce(DataFrame.unionByName, (s.withColumn("start", F.lit(i)) for i, s in enumerate(starts)))


def _distance() -> Column:
    d = [F.col(x) - F.get("mu", F.lit(i)) for i, x in enumerate(LEAST)]
    return sum((F.get("prec", F.lit(i * D + j)) * d[i] * d[j] for i in range(D) for j in range(D)), F.lit(0.0))


def _slot() -> Column:
    return F.floor(F.log(F.col("d2") + 1e-6) * 64)


def _estimate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mu, prec, logdet) from all ``rows`` of each group: moments are summed in Spark, a row a group is inverted."""
    pairs = [(i, j) for i in range(D) for j in range(i, D)]
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.array(*(F.sum(x) for x in LEAST)).alias("s"), F.array(*(F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs)).alias("q")
    )

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floor = np.diag(np.square(list(LEAST.values())))
        for frame in frames:
            out = []
            for *key, n, s, q in frame.itertuples(index=False):
                mu, second = np.array(s) / n, np.zeros((D, D))
                for (i, j), v in zip(pairs, q, strict=True):
                    second[i, j] = second[j, i] = v / n
                scatter = second - np.outer(mu, mu) + floor
                out.append((*key, mu.tolist(), np.linalg.inv(scatter).ravel().tolist(), float(np.linalg.slogdet(scatter)[1])))
            yield pd.DataFrame(out, columns=[*keys, "mu", "prec", "logdet"])

    schema = T.StructType([rows.schema[k] for k in keys]).add("mu", T.ArrayType(T.DoubleType())).add("prec", T.ArrayType(T.DoubleType())).add("logdet", "double")
    return sums.mapInPandas(of, schema)


#: Groups up to which their estimates, some thirty numbers each, are broadcast.
MAP_SIDE_GROUPS = 100_000


def _near(at: DataFrame) -> DataFrame:
    """``at``, a row a group and checkpointed, for a join with the rows of groups of any size."""
    return F.broadcast(at) if at.count() <= MAP_SIDE_GROUPS else at


def concentrate(rows: DataFrame, at: DataFrame, keys: list[str]) -> DataFrame:
    """One step: the estimate of the SHARE of each group's ``rows`` that lie nearest to the estimate ``at``."""
    far = rows.join(_near(at.select(*keys, "mu", "prec")), "group").withColumn("d2", _distance())
    within = _quantiles(far, keys, _slot(), SHARE)
    return cut(_estimate(far.join(within, keys).filter(_slot() <= F.col("at")), keys))


def chi2_quantile(p: float, k: int) -> float:
    """For an even ``k``, whose law is e^(-x/2) times a sum of k/2 powers; by bisection."""
    low, high = 0.0, 1e3
    for _ in range(100):
        x = (low + high) / 4
        above = math.exp(-x) * sum(x**i / math.factorial(i) for i in range(k // 2))
        low, high = (low, 2 * x) if above < 1 - p else (2 * x, high)
    return low


def robust_estimates(rows: DataFrame) -> DataFrame:
    """(group, mu, prec, logdet) of the least determinant found for each group of ``rows`` (group, x0 ...)."""
    at = cut(_starts(rows))
    for _ in range(STEPS):
        at = concentrate(rows, at, ["group", "start"])
    done, open_ = None, at.groupBy("group").agg(F.min_by(F.struct("mu", "prec", "logdet"), F.struct("logdet", "start")).alias("b")).select("group", "b.*")
    open_ = cut(open_)
    for _ in range(MORE_STEPS):
        after = concentrate(rows.join(open_.select("group"), "group", "left_semi"), open_, ["group"])
        both = open_.join(after.withColumnsRenamed({"mu": "mu2", "prec": "prec2", "logdet": "logdet2"}), "group")
        falls = F.col("logdet2") < F.col("logdet") - 1e-4
        stops = both.filter(~falls).select("group", "mu", "prec", "logdet")
        done = stops if done is None else done.unionByName(stops)
        open_ = cut(both.filter(falls).select("group", F.col("mu2").alias("mu"), F.col("prec2").alias("prec"), F.col("logdet2").alias("logdet")))
        if open_.isEmpty():
            break
    return cut(done.unionByName(open_))


def robust_distances(rows: DataFrame) -> DataFrame:
    """(group, mu, prec, scale) of each group of ``rows`` (group, x0 ...)."""
    at = robust_estimates(rows)
    middle = _quantiles(rows.join(_near(at), "group").withColumn("d2", _distance()), ["group"], _slot(), 0.5)
    typical = F.exp((F.col("at") + 0.5) / 64)
    return cut(at.join(middle, "group").select("group", "mu", "prec", F.greatest(typical / chi2_quantile(0.5, D), F.lit(1.0)).alias("scale")))


def judge(docs: DataFrame, min_rows: int = MIN_ROWS, level: float = LEVEL) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang, source): the counts, base_failed, d2 (null without estimate), kept."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = text_statistics(docs).withColumn("base_failed", failed).withColumns(_vector())
    rows = cut(_grouped(cut(rows), min_rows))
    counted = cut(rows.filter("not base_failed").select(F.explode("feeds").alias("group"), *LEAST))
    at = robust_distances(counted)
    d2 = F.when(~F.col("base_failed"), _distance() / F.col("scale"))
    out = rows.join(_near(at), "group", "left").withColumn("d2", d2)
    kept = ~F.col("base_failed") & (F.col("d2").isNull() | (F.col("d2") <= chi2_quantile(level, D)))
    return out.select("doc_id", *STATISTICS[:5], "base_failed", kept.alias("kept"), "d2")
