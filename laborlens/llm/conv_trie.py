"""Prefix trie of conversations by vertical bitmaps: which beginnings conversations share, and what sharing them saves.

Conversations are dealt by ranges of their ids to shards of a bounded number of turns. In a shard each (position, turn)
has a bitset of the conversations that have that turn there. A node is the bitset of the conversations that begin with
its turns; depth first, it is intersected with the bitsets of its members' next turns, which yields its children, their
popcounts and smallest members, and, with the bitset of conversations of that length, the list of those that end in it.

A node's name is a digest of its path, so the same node has the same name in every shard, and counts and smallest
members add up over shards. As ranges follow the ids, the smallest member of a node lies in the first shard that has the
node, and that shard has all nodes above it too. Sums over subtrees are therefore taken shard by shard: each node's own
values enter at its first shard, run up that shard's trie in one pass, and the shards' sums are added. Lists of ends
stay in chunks; ordered by shard they are ascending, and their digest is taken as they stream by.

Only digests (128 bits) and sizes of turns travel between tasks once the turns are numbered. A conversation's turns lie
in one task, as a document's words do.

Defined results: turns are ordered by turn (null first), role, text; a null role or text is empty, and equal rows are
turns of their own; rows without an id belong to no conversation; a conversation without turns ends in the root; an
empty table has no nodes. Columns beside conv_id, turn, role and text are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laborlens.llm.common import cut, lookup, require, written

#: Turns of a shard, about.
ROWS_PER_SHARD = 20_000
#: Conversations of a chunk of an end list.
CHUNK = 256
NODES = "shard int, seq int, above int, node binary, parent binary, depth long, conv_id long, n long, bytes long, ends array<string>"


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, k1, k2, bytes): the turns of each conversation from 1 on, by digest and size of the text."""
    require(conversations, "conv_id", "turn", "role", "text")
    rows = conversations.filter("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.row_number().over(order).cast("long").alias("pos"), F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit("second"), "role", "text").alias("k2"), F.octet_length("text").cast("long").alias("bytes"))


def grafted(turns: DataFrame, period: int = 5, most: int = 8) -> DataFrame:
    """The rebuilt conversations: h turns of the conversation c - c % ``period``, then c's own after its first h.

    h = crc32(c) % (``most`` + 1). Each conversation has a row at position 0 besides, so that none without turns is lost.
    """
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most + 1))
    convs = convs.select("conv_id", "n_turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % period).alias("base"))
    bases = convs.filter("conv_id = base").select("base", F.col("n_turns").alias("n_base"))
    convs = convs.join(bases, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"))
    first = turns.filter((F.col("pos") <= most) & (F.col("conv_id") % period == 0)).withColumnRenamed("conv_id", "base")
    heads = first.join(convs, "base").filter("pos <= h").select("conv_id", "pos", "k1", "k2", "bytes")
    tails = turns.join(convs, "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "k1", "k2", "bytes")
    tops = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).cast("long").alias("bytes"))
    return heads.unionByName(tails).unionByName(tops)


def _members(bits: int) -> list[int]:
    """The positions of the set bits, ascending."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(-(-bits.bit_length() // 8), "little"), np.uint8), bitorder="little")).tolist()


def _bitset(members: np.ndarray, size: int) -> int:
    flags = np.zeros(size, np.uint8)
    flags[members] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _shard_trie(shard: int, rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one shard in preorder. ``rows``: (conv_id, pos, k1, k2, bytes) in the order of conv_id and pos."""
    ids, starts, sizes = np.unique(rows.conv_id.to_numpy(), return_index=True, return_counts=True)
    lengths = sizes - 1  # without the row at position 0
    turns, which = np.unique(rows[["k1", "k2"]].to_numpy(np.int64), axis=0, return_inverse=True)
    which = which.reshape(-1)
    member, pos = np.repeat(np.arange(len(ids)), sizes), rows.pos.to_numpy()
    order = np.lexsort((which, pos))
    breaks = np.flatnonzero(np.diff(pos[order], prepend=-1) | np.diff(which[order], prepend=-1))
    postings = {(int(pos[g[0]]), int(which[g[0]])): _bitset(member[g], len(ids)) for g in np.split(order, breaks[1:])}
    ends = {int(n): _bitset(np.flatnonzero(lengths == n), len(ids)) for n in np.unique(lengths)}
    size_of = rows.bytes.to_numpy()
    out: list[tuple] = []
    stack = [((1 << len(ids)) - 1, 0, -1, hashlib.blake2b(digest_size=16).digest(), None, 0)]
    while stack:
        bits, depth, above, node, parent, size = stack.pop()
        seq, lowest = len(out), (bits & -bits).bit_length() - 1
        ended = bits & ends.get(depth, 0)
        here = [str(ids[i]) for i in _members(ended)] if ended else []
        out.append((shard, seq, above, node, parent, depth, int(ids[lowest]), bits.bit_count(), size, [",".join(here[i : i + CHUNK]) for i in range(0, len(here), CHUNK)]))
        rest, children = bits & ~ended, []
        while rest:
            at = starts[(rest & -rest).bit_length() - 1] + depth + 1
            child = bits & postings[depth + 1, int(which[at])]
            rest &= ~child
            name = hashlib.blake2b(node + turns[which[at]].tobytes(), digest_size=16).digest()
            children.append((child, depth + 1, seq, name, node, int(size_of[at])))
        stack += reversed(children)
    return pd.DataFrame(out, columns=["shard", "seq", "above", "node", "parent", "depth", "conv_id", "n", "bytes", "ends"])


def _tries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = list(frames)  # a shard
    if rows:
        rows = pd.concat(rows)
        yield _shard_trie(int(rows["shard"].iloc[0]), rows)


def _summed_up(nodes: pd.DataFrame) -> pd.DataFrame:
    """A shard's sums over the subtrees of its nodes, of the values that enter in this shard."""
    nodes = nodes.sort_values("seq")
    leaves, saved, above = nodes.leaf.tolist(), nodes.saved.tolist(), nodes.above.tolist()
    for i in range(len(above) - 1, 0, -1):  # in preorder a node comes after the one above it
        leaves[above[i]] += leaves[i]
        saved[above[i]] += saved[i]
    return pd.DataFrame({"node": nodes.node, "n_leaves": leaves, "saved_tokens": saved})


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One digest a node, of its chunks in order; holds one node's state at a time."""
    node, state, done = None, None, []
    for f in frames:
        for n, ids in zip(f.node, f.ids, strict=True):
            n = bytes(n)
            if n != node:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pd.DataFrame(done, columns=["node", "ends_sha256"])
            done = []
    if node is not None:
        yield pd.DataFrame([(node, state.hexdigest())], columns=["node", "ends_sha256"])


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, pos, k1, k2, bytes), each with a row at position 0.

    Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, and over its subtree n_leaves and
    saved_tokens (bytes of last turns that members share); ends_sha256 of the ids of those that end in it.
    """
    rows = written(rows, "trie-turns")
    shards = max(1, -(-rows.count() // ROWS_PER_SHARD))
    dealt = rows.repartitionByRange(shards, "conv_id").sortWithinPartitions("conv_id", "pos").withColumn("shard", F.spark_partition_id())
    found = written(dealt.mapInPandas(_tries, NODES), "trie-shards")

    least = F.min(F.struct("shard", "conv_id", "parent", "depth", "bytes"))
    nodes = cut(found.groupBy("node").agg(least.alias("m"), F.sum("n").alias("n_convs")).select("node", F.col("m.shard").alias("owner"), "m.conv_id", "m.parent", "m.depth", "m.bytes", "n_convs"))
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))

    own = nodes.select("node", F.col("owner").alias("shard"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    valued = found.select("shard", "seq", "above", "node").join(own, ["node", "shard"], "left").fillna(0, ["leaf", "saved"])
    sums = valued.groupBy("shard").applyInPandas(_summed_up, "node binary, n_leaves long, saved_tokens long").groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

    chunks = found.filter(F.size("ends") > 0).select("node", "shard", F.posexplode("ends").alias("chunk", "ids"))
    ends = chunks.repartition("node").sortWithinPartitions("node", "shard", "chunk").select("node", "ids").mapInPandas(_digests, "node binary, ends_sha256 string")

    parents = nodes.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    whole = lookup(nodes.drop("owner", "bytes"), parents, ["parent"], nodes.count(), "left")
    out = whole.join(sums, "node").join(ends, "node", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
