"""Reversible line deduplication: exact reference counts, and sharded cuckoo filters of the repeated keys.

A line's key is the line stripped and A-Z lower-cased. The reference table holds each (key, document) once, and the
count table how many documents hold a key and the largest of them, so counts are exact and a document can be taken out
again. The filters hold the keys that at least ``min_docs`` documents share; keys enter and leave as batches of
documents are inserted or deleted. To clean documents, their distinct keys are looked up in the filter of their shard;
only what a filter may hold meets the exact counts, and only confirmed keys meet the documents again.

Keys travel as 128-bit hashes. Shards follow the number of keys, so that a task holds a bounded part of a filter; a
frequent line is one key there, whatever the number of its documents, and its references are spread over tasks.

Defined results: a null or empty text is one empty line; rows that share an id are one document; a row without an id
counts for no key, and loses all its repeated lines; in an empty table nothing is repeated. Columns other than doc_id
and text pass through ``clean`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laborlens.llm.common import WHITESPACE, ascii_lower, cut, lookup, written
from laborlens.llm.cuckoo import Cuckoo
from laborlens.llm.shingles import FOLD

KEYS_PER_SHARD = 20_000
FILTERS = "shard int, keys long, table binary"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITESPACE)))


def _hashed(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("k1"), F.xxhash64(F.lit("second"), key).alias("k2"))


def references(docs: DataFrame, min_chars: int) -> DataFrame:
    """(k1, k2, doc_id): each key of at least ``min_chars`` code points, once a document."""
    keys = F.array_distinct(F.filter(F.transform(lines(F.col("text")), line_key), lambda k: F.char_length(k) >= min_chars))
    return docs.filter("doc_id is not null").select("doc_id", F.explode(keys).alias("key")).select("doc_id", _hashed(F.col("key")).alias("k")).select("k.k1", "k.k2", "doc_id").distinct()


def _counts(refs: DataFrame) -> DataFrame:
    return refs.groupBy("k1", "k2").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("keeper"))


@dataclass(frozen=True)
class State:
    """refs: who holds a key. counts: (k1, k2, n, keeper) of every key. filters: a cuckoo filter a shard."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int = 3
    min_chars: int = 20

    def shard(self) -> Column:
        return F.pmod(F.xxhash64("k2"), F.lit(self.shards)).cast("int").alias("shard")


def _filters(repeated: DataFrame, state: State) -> DataFrame:
    """New filters of ``repeated`` keys."""

    def build(key: tuple, keys: pd.DataFrame) -> pd.DataFrame:
        k1, k2 = keys.k1.to_numpy(np.int64), keys.k2.to_numpy(np.int64)
        size = len(keys)
        while not (f := Cuckoo.sized(size)).insert(k1, k2):
            size *= 2
        return pd.DataFrame({"shard": [key[0]], "keys": [len(keys)], "table": [f.dump()]})

    return repeated.select("k1", "k2", state.shard()).groupBy("shard").applyInPandas(build, FILTERS)


def build(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> State:
    refs = written(references(docs, min_chars), "line-refs")
    counts = written(_counts(refs), "line-counts")
    state = State(refs, counts, refs, int(max(64, -(-counts.count() // KEYS_PER_SHARD))), min_docs, min_chars)
    return replace(state, filters=written(_filters(counts.filter(F.col("n") >= min_docs), state), "line-filters"))


def _changed(state: State, counts: DataFrame, refs: DataFrame, touched: DataFrame) -> State:
    """The state with ``refs`` and ``counts``, its filters updated for those of the ``touched`` keys that cross the
    threshold."""

    def many(t: DataFrame, name: str) -> DataFrame:
        return t.filter(F.col("n") >= state.min_docs).join(touched, ["k1", "k2"], "left_semi").select("k1", "k2", F.lit(True).alias(name))

    crossed = many(state.counts, "was").join(many(counts, "is_"), ["k1", "k2"], "full").filter("was is null or is_ is null")
    crossed = crossed.select("k1", "k2", F.col("is_").isNotNull().alias("enters"), state.shard())

    def update(key: tuple, old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        f = Cuckoo.load(old.table[0]) if len(old) else Cuckoo.sized(len(keys))
        held = int(old["keys"].sum())
        enters, leaves = keys[keys.enters], keys[~keys.enters]
        f.delete(leaves.k1.to_numpy(np.int64), leaves.k2.to_numpy(np.int64))
        full = not f.insert(enters.k1.to_numpy(np.int64), enters.k2.to_numpy(np.int64))
        return pd.DataFrame({"shard": [key[0]], "keys": [held + len(enters) - len(leaves)], "table": [None if full else f.dump()]})

    filters = written(state.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(update, FILTERS), "line-filters")
    if not filters.filter("table is null").isEmpty():  # a shard overflowed: anew from the exact counts
        filters = written(_filters(counts.filter(F.col("n") >= state.min_docs), state), "line-filters")
    return replace(state, refs=refs, counts=counts, filters=filters)


def insert(state: State, docs: DataFrame) -> State:
    """The state with ``docs`` counted as well; documents that it holds already change nothing."""
    new = written(references(docs, state.min_chars).join(state.refs, ["k1", "k2", "doc_id"], "left_anti"), "line-refs")
    counts = state.counts.unionByName(_counts(new)).groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))
    return _changed(state, written(counts, "line-counts"), state.refs.unionByName(new), new.select("k1", "k2").distinct())


def delete(state: State, ids: DataFrame) -> State:
    """The state as if the documents ``ids`` (doc_id) had never come."""
    ids = ids.select("doc_id").distinct()
    gone = written(state.refs.join(ids, "doc_id", "left_semi").select("k1", "k2", "doc_id"), "line-refs")
    refs = written(state.refs.join(ids, "doc_id", "left_anti").select("k1", "k2", "doc_id"), "line-refs")
    touched = cut(gone.select("k1", "k2").distinct())
    before = state.counts.join(touched, ["k1", "k2"], "left_semi").select("k1", "k2", "n")
    again = _counts(lookup(refs, cut(before), ["k1", "k2"], state.refs.count()).select("k1", "k2", "doc_id"))
    counts = written(state.counts.join(touched, ["k1", "k2"], "left_anti").unionByName(again), "line-counts")
    return _changed(state, counts, refs, touched)


def maybe_repeated(state: State, keys: DataFrame) -> DataFrame:
    """Those of ``keys`` (k1, k2; distinct) that the filters may hold: all repeated ones and a few others."""

    def probe(_: tuple, held: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(keys):
            return keys[:0][["k1", "k2"]]
        return keys[Cuckoo.load(held.table[0]).contains(keys.k1.to_numpy(np.int64), keys.k2.to_numpy(np.int64))][["k1", "k2"]]

    keys = keys.select("k1", "k2", state.shard())
    return state.filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(probe, "k1 long, k2 long")


#: Lines times dropped keys of a document up to which each line is held against the list of keys; beyond, a set is built.
SMALL = 1_000_000


def _hash(data: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(data, seed)


#: Spark's seed, and what it hashes the mark of the second key to.
SEED = 42
SECOND = _hash(b"second", SEED)


@F.pandas_udf(T.StructType([T.StructField("kept", T.StringType()), T.StructField("n", T.LongType())]))
def _without(text: pd.Series, k1: pd.Series, k2: pd.Series) -> pd.DataFrame:
    """Long texts without the lines of their keys, and the number of lines left; null texts stay null."""
    out = []
    for t, a, b in zip(text, k1, k2, strict=True):
        if t is None:
            out.append((None, None))
            continue
        drop = set(zip(np.asarray(a, np.int64).view(np.uint64).tolist(), np.asarray(b, np.int64).view(np.uint64).tolist(), strict=True))
        keys = (x.strip(WHITESPACE).encode().translate(FOLD) for x in t.split("\n"))
        left = [x for x, k in zip(t.split("\n"), keys, strict=True) if (_hash(k, SEED), _hash(k, SECOND)) not in drop]
        out.append(("\n".join(left), len(left)))
    return pd.DataFrame(out, columns=["kept", "n"])


def _drops(state: State, refs: DataFrame, counts: DataFrame, keeps: bool = True) -> DataFrame:
    """(drop_id, drop_keys): the keys of which a document loses the lines. ``counts``: how many ``refs`` hold a key."""
    maybe = maybe_repeated(state, counts.select("k1", "k2"))
    repeated = state.counts.filter(F.col("n") >= state.min_docs).join(maybe, ["k1", "k2"], "left_semi").select("k1", "k2", "keeper")
    repeated = cut(repeated.join(counts.select("k1", "k2", "n"), ["k1", "k2"]))
    met = lookup(refs, repeated, ["k1", "k2"], repeated.agg(F.sum("n")).first()[0] or 0)
    lost = met.filter(F.col("doc_id") != F.col("keeper")) if keeps else met
    return lost.groupBy(F.col("doc_id").alias("drop_id")).agg(F.collect_set(F.struct("k1", "k2")).alias("drop_keys"))


def clean(state: State, docs: DataFrame, refs: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """``docs`` with three columns more, or anew: n_lines, n_dropped, kept (the text without its repeated lines).

    A key that ``min_docs`` documents of the state share keeps its lines only in the one with the largest id.
    ``refs`` and ``counts``: those of ``docs``, where they are at hand.
    """
    refs = references(docs, state.min_chars) if refs is None else refs
    counts = refs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    whole = docs.select(F.struct("*").alias("row"))  # so that no column's name can clash with ours
    named = whole.filter("row.doc_id is not null").join(_drops(state, refs, counts), F.col("row.doc_id") == F.col("drop_id"), "left")
    nameless = docs.filter("doc_id is null").select(F.coalesce(F.xxhash64("text"), F.lit(0)).alias("doc_id"), "text")
    by_text = cut(references(nameless, state.min_chars))
    by_text = _drops(state, by_text, by_text.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")), keeps=False)
    met = named.drop("drop_id").unionByName(whole.filter("row.doc_id is null").join(by_text, F.xxhash64("row.text") == F.col("drop_id"), "left").drop("drop_id"))
    all_ = lines(F.col("row.text"))
    large = F.coalesce(F.size(all_).cast("long") * F.size("drop_keys") > SMALL, F.lit(False))
    stays = F.when(F.col("drop_keys").isNull() | large, all_).otherwise(F.filter(all_, lambda line: ~F.array_contains("drop_keys", _hashed(line_key(line)))))
    alone = _without(F.when(large, F.col("row.text")), F.when(large, F.col("drop_keys.k1")), F.when(large, F.col("drop_keys.k2")))
    out = met.select("row", F.size(all_).cast("long").alias("n_lines"), stays.alias("stays"), alone.alias("alone"))
    added = [F.col("n_lines"), (F.col("n_lines") - F.coalesce("alone.n", F.size("stays"))).alias("n_dropped"), F.coalesce("alone.kept", F.array_join("stays", "\n")).alias("kept")]
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped", "kept")]
    return out.select(*own, *added)


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """``docs`` against themselves: see ``clean``."""
    state = build(docs, min_docs, min_chars)
    return clean(state, docs, state.refs, state.counts)
