"""Benchmark decontamination as a prefix-filtered set join.

A window is ``window`` consecutive words of a benchmark item (a shorter item is one window), and holds a set of
shingles at fixed offsets. One scan finds the places in the documents where a shingle of any window stands; words are
compared there, not only hashes. An occurrence must hold all of a window's shingles, so for exact containment a prefix
of one shingle is necessary: the window's rarest, by counts over the whole corpus. Documents and windows meet only at
these; the offset then fixes where the window must start (positional bound), the window must fit between the
document's ends (length bound), and all of its other shingles must stand at their places.

The shingles of the windows are hash-joined map-side if they fit a stated size, so that only their places leave the
scan; beyond that size positions are shuffled by shingle. Places of a shingle, a window or a document that is frequent
are spread over tasks.

Defined results: null or empty texts have no words and are clean; items without words never occur; repeated items and
rows count once; rows that share an id but not a text are judged each by its own text; an empty benchmark leaves all
documents clean; other columns may have any name.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laborlens.llm.common import HOT, ascii_lower, cut, lookup

BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words in a shingle; windows of fewer words have shingles of that many.
SHINGLE = 3
#: Shingles of windows that take fewer bytes than this are joined map-side.
MAP_SIDE_BYTES = 32 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(BENCH_WORD), F.lit(0))


def _shingle(array: Column, at: Column, k: int) -> list[Column]:
    """The ``k`` words from the 0-based position ``at``; nulls past the end."""
    return [F.get(array, at + i) for i in range(k)]


def windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct windows with their items: (wid, w words, k shingle length, item)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("iw")).filter(F.size("iw") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("iw") - window + 1, F.lit(1)))
    each = items.select("item", F.explode(F.transform(starts, lambda s: F.slice("iw", s, window))).alias("w")).distinct()
    return each.withColumn("wid", F.sha2(F.array_join("w", " "), 256)).withColumn("k", F.least(F.size("w"), F.lit(SHINGLE)))


def places(docs: DataFrame, shingles: DataFrame, k: int, map_side_bytes: int) -> DataFrame:
    """(key, n, pos, token) wherever one of ``shingles`` (token, w0 ...) of ``k`` words stands in ``docs`` (key, text),
    and at position 0 of every document that has ``n`` words, token or not."""
    each = docs.select("key", words(F.col("text")).alias("dw")).select("key", "dw", F.posexplode("dw").alias("pos", "word"))
    parts = _shingle(F.col("dw"), F.col("pos"), k)
    each = each.select("key", F.size("dw").alias("n"), "pos", F.xxhash64(*parts).alias("h"), *(c.alias(f"d{i}") for i, c in enumerate(parts)))
    asked = cut(shingles.withColumn("h", F.xxhash64(*(f"w{i}" for i in range(k)))))
    size = asked.agg(F.sum(sum((F.octet_length(f"w{i}") for i in range(k)), F.lit(64)))).first()[0] or 0
    same = reduce(operator.and_, (F.col(f"d{i}") == F.col(f"w{i}") for i in range(k)))
    met = each.join(F.broadcast(asked) if size <= map_side_bytes else asked, "h", "left")
    return met.select("key", "n", "pos", F.when(same, F.col("token")).alias("token")).filter("token is not null or pos = 0")


#: Parts over which the places of a frequent shingle are spread.
SALTS = 64


def occurrences(docs: DataFrame, wins: DataFrame, map_side_bytes: int = MAP_SIDE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(key, start, stop, wid) of every window in ``docs`` (key, text), and (key, n) of all with words."""
    found = sizes = None
    for k in sorted(r.k for r in wins.select("k").distinct().collect()):  # 1 to SHINGLE
        own = wins.filter(F.col("k") == k).select("wid", "w").distinct()
        parts = own.select("wid", F.size("w").alias("len"), (F.size("w") - k + 1).alias("m"), F.explode(F.sequence(F.lit(0), F.size("w") - k)).alias("offset"), "w")
        parts = parts.select("wid", "len", "m", "offset", *(c.alias(f"w{i}") for i, c in enumerate(_shingle(F.col("w"), F.col("offset"), k))))
        text = [f"w{i}" for i in range(k)]
        tokens = cut(parts.select(*text).distinct().withColumn("token", F.monotonically_increasing_id()))
        parts = cut(parts.join(tokens, text).select("wid", "len", "m", "offset", "token"))
        at = cut(places(docs, tokens, k, map_side_bytes))
        sizes = at.filter("pos = 0").select("key", "n").distinct() if sizes is None else sizes
        at = at.filter("token is not null")
        rarity = cut(at.groupBy("token").agg(F.count(F.lit(1)).alias("seen")))
        prefix = parts.join(rarity, "token", "left").groupBy("wid", "len", "m").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token", "offset")).alias("p"))
        least = (rarity.agg(F.sum("seen")).first()[0] or 0) // HOT
        salts = F.when(F.col("p.seen") > least, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        prefix = prefix.filter("p.seen > 0").select("wid", "len", "m", "p.token", "p.offset", F.explode(salts).alias("salt"))
        hot = rarity.filter(F.col("seen") > least).select("token", F.lit(True).alias("hot"))  # HOT rows at most
        salted = at.join(F.broadcast(hot), "token", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("key", "pos"), F.lit(SALTS))).otherwise(0).cast("int"))
        start = F.col("pos") - F.col("offset")
        near = cut(salted.join(prefix, ["token", "salt"]).select("key", start.alias("start"), "n", "wid", "len", "m").filter("start >= 0 and start + len <= n").distinct())
        # A window has 64 parts at most.
        others = parts.groupBy("wid").agg(F.collect_list(F.struct("offset", F.col("token").alias("part"))).alias("parts"))
        others = others.join(near.groupBy("wid").agg(F.count(F.lit(1)).alias("n")), "wid")
        met = lookup(near.select("key", "start", "wid", "len", "m"), cut(others), ["wid"], near.count()).select("key", "start", "wid", "len", "m", F.inline("parts"))
        met = met.withColumn("place", F.col("start") + F.col("offset"))
        there = at.select(F.col("key").alias("k2"), F.col("pos").alias("place"), F.col("token").alias("part"))
        met = met.join(there, (F.col("key") == F.col("k2")) & (met["place"] == there["place"]) & (met["part"] == there["part"]))
        whole = met.groupBy("key", "start", "wid", "len", "m").agg(F.bit_or(F.expr("shiftleft(1L, offset)")).alias("bits"))
        whole = whole.filter(F.bit_count("bits") == F.col("m")).select("key", "start", (F.col("start") + F.col("len")).alias("stop"), "wid")
        found = whole if found is None else found.unionByName(whole)
    return found, sizes


def _items(occ: DataFrame, wins: DataFrame) -> DataFrame:
    """(key, items): the items of which windows occur, sorted."""
    each = cut(occ.select("key", "wid").distinct())
    named = wins.groupBy("wid").agg(F.collect_set("item").alias("of")).join(each.groupBy("wid").agg(F.count(F.lit(1)).alias("n")), "wid")
    met = lookup(each, cut(named), ["wid"], each.count())
    return met.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("of")))).alias("items"))


def _key(docs: DataFrame) -> Column:
    """A row's id and a hash of its text."""
    return F.struct(docs["doc_id"], F.xxhash64(docs["text"]).alias("t"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, map_side_bytes: int = MAP_SIDE_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items, contaminated.

    A word is hit inside any occurrence of a window; ``items`` are those with occurring windows, as sorted strings.
    Contaminated: at least one word in twenty is hit.
    """
    return _judged(docs, benchmark, window, map_side_bytes).drop("key")


def _judged(docs: DataFrame, benchmark: DataFrame, window: int, map_side_bytes: int) -> DataFrame:
    if window - SHINGLE + 1 > 64:
        raise ValueError("a window has 64 shingles at most")
    keyed = docs.select("doc_id", _key(docs).alias("key"), "text")
    wins = cut(windows(benchmark, window))
    if wins.isEmpty():
        sizes = keyed.select("doc_id", "key", F.coalesce(F.regexp_count("text", F.lit(RAW_WORD)), F.lit(0)).cast("long").alias("n_words"))
        hit = sizes.select("key").limit(0).withColumns({"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>")})
    else:
        occ, n = occurrences(keyed.select("key", "text").filter("text is not null"), wins, map_side_bytes)
        occ = cut(occ)
        n = n.select(F.col("key").alias("n_key"), F.col("n").cast("long").alias("n_words"))
        sizes = keyed.select("doc_id", "key").join(n, F.col("key") == F.col("n_key"), "left").select("doc_id", "key", F.coalesce("n_words", F.lit(0).cast("long")).alias("n_words"))
        spans = occ.groupBy("key", "start").agg(F.max("stop").alias("stop"))
        before = F.max("stop").over(W.partitionBy("key").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
        fresh = F.greatest(F.col("stop") - F.greatest("start", F.coalesce(before, F.lit(0))), F.lit(0))
        covered = spans.select("key", fresh.alias("fresh")).groupBy("key").agg(F.sum("fresh").alias("n_hit"))
        hit = covered.join(_items(occ, wins), "key")
    hit = hit.withColumnRenamed("key", "k2")
    n_hit, items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    out = sizes.join(hit, F.col("key").eqNullSafe(F.col("k2")), "left").select("key", "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """``docs`` without its contaminated rows, all columns kept."""
    bad = _judged(docs, benchmark, window, MAP_SIDE_BYTES).filter("contaminated").select(F.col("key").alias("bad_key")).distinct()
    return docs.join(bad, _key(docs).eqNullSafe(bad["bad_key"]), "left_anti")
