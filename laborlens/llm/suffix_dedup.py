"""Repeated passages by a distributed difference-cover suffix array, and documents without all but the first of each.

Every byte that a string of LENGTH bytes covers which also starts earlier (in a document of a smaller id, or earlier in
the same document) is removed. Strings are judged on the texts as they came, and never cross documents.

Before anything is sorted, what can't matter is put aside without loss. Each string of LENGTH bytes holds the smallest
hash of the GRAM-byte strings inside it; strings whose smallest hash occurs once can't repeat. Of the others, neighbours
with the same smallest hash are a piece. Of equal pieces only the first is kept, since every string of the others starts
earlier; and equal strings lie in pieces of the same hash, so where all pieces of a hash are equal, and none holds it
twice, the first is put aside as well (copies of whole documents cost nothing further). What is left are segments of
the texts: passages in different surroundings, and texts that repeat themselves.

The segments lie in blocks in the order of ids and offsets, and are sorted as the difference-cover algorithm (mod 3)
does. The triples (of SYMBOL-byte symbols) at the positions i % 3 in (1, 2) of a block are sorted and named by rank; the
recursion sorts triples of names, until a name stands for the first LENGTH - 2 bytes of its suffix. LENGTH bounds how
deep that goes, so all sampled positions take part at each depth and no depth needs a merge of its own. The remaining
suffixes (i % 3 = 0) are merged by their first byte and the rank behind it, or the first two and the rank behind these.
In the merged order neighbours are compared on LENGTH bytes: ranks and the bytes beside them tell that exactly.

Keys are packed: a block sends each range of keys one row, with each of its keys once, so a passage that a third of all
rows share is one key a block. Ranges are cut at quantiles of a bounded sample of keys, which affects balance only.
The driver holds one number a range. Every step is a written table; those of earlier steps are removed, and so are the
shuffle files of a step as soon as its table is written.

Defined results: a null text is empty; rows that repeat both id and text have the same result and don't count as earlier
than each other; texts that share an id are documents of their own, in the order of a hash, and so are those without an
id, after all others; in an empty table nothing repeats. Columns beside doc_id and text pass whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laborlens.llm.common import drop_table, new_table, require

LENGTH = 100
#: Bytes of the strings whose smallest hash stands for LENGTH bytes.
GRAM = 68
SPAN = LENGTH - GRAM + 1
SYMBOL = 4
#: Bytes of a block, keys of a range, hashes of a shard, about.
BLOCK, KEYS, HASHES = 1 << 20, 1 << 20, 1 << 20
LAST = (1 << 63) - 1
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Steps:
    """The tables of a run, each removed once its successors are written."""

    def __init__(self, spark) -> None:
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a written table, whose shuffle files go once it is written: nothing else reads them."""
        path, before = new_table(self.spark, name), self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            drop_table(self.spark, self.paths.pop(id(t))[1])


# Hashes of strings


BASE = 0x9E3779B97F4A7C15


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of BASE below the ``n``-th, and their inverses, mod 2 ** 64."""
    return tuple(np.cumprod(np.array([1] + [b] * (n - 1), np.uint64)) for b in (BASE, pow(BASE, -1, 1 << 64)))


def _hashes(text: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes from each position on; short by width - 1."""
    powers, inverses = _powers(1 << len(text).bit_length())
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(0x51ED270B)) * powers[: len(text)], out=sums[1:])
    out = sums[width:] - sums[:-width]
    out *= inverses[: len(out)]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def _sliding(a: np.ndarray, width: int, of: Callable) -> np.ndarray:
    """``of`` (minimum or maximum) of the ``width`` values from each on; short by width - 1."""
    size = 1
    while size * 2 <= width:
        a = of(a[:-size], a[size:])
        size *= 2
    rest = width - size
    return of(a[: len(a) - rest], a[rest:]) if rest else a


# Blocks


SEGMENT = "id long, th long, begin long, end long"
PACKED = "block long, ids binary, ths binary, begins binary, ends binary, text binary"


def _pack(block: int, rows: list[tuple]) -> dict:
    ids, ths, begins, ends, texts = zip(*rows, strict=True)
    return {"block": block, **{k: np.array(v, np.int64).tobytes() for k, v in (("ids", ids), ("ths", ths), ("begins", begins), ("ends", ends))}, "text": b"".join(texts)}


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts in blocks; longer ones in parts that hold each string of LENGTH bytes once."""
    rows, size, block = [], 0, None
    for f in frames:
        for part, doc, th, text in zip(f["part"], f.id, f.th, f.text, strict=True):
            raw, block = text.encode(), part << 32 if block is None else block
            for a in range(0, len(raw) - LENGTH + 1, BLOCK):
                b = min(a + BLOCK, len(raw) - LENGTH + 1)
                if rows and size + b - a > BLOCK:
                    yield pd.DataFrame([_pack(block, rows)])
                    rows, size, block = [], 0, block + 1
                rows.append((doc, th, a, b, raw[a : b + LENGTH - 1]))
                size += b - a + LENGTH - 1
    if rows:
        yield pd.DataFrame([_pack(block, rows)])


class Block:
    """A block's text, padded, with the bounds of its segments."""

    def __init__(self, row) -> None:
        self.ids, self.ths, self.begins, self.ends = (np.frombuffer(row[k], np.int64) for k in ("ids", "ths", "begins", "ends"))
        self.starts = self.ends - self.begins  # strings of LENGTH bytes of each segment
        sizes = self.starts + LENGTH - 1
        self.size = int(sizes.sum())
        self.text = np.concatenate([np.frombuffer(row["text"], np.uint8), np.zeros(2 * LENGTH, np.uint8)])
        self.segment = np.repeat(np.arange(len(sizes)), sizes)
        self.first = np.cumsum(sizes) - sizes
        self.left = np.repeat(np.cumsum(sizes), sizes) - np.arange(self.size)  # bytes to the segment's end

    def holding(self, width: int) -> np.ndarray:
        """The positions from which ``width`` bytes lie in the segment."""
        return np.flatnonzero(self.left >= width)

    def breaks(self, starts: np.ndarray) -> np.ndarray:
        """Which of the ascending start positions don't follow the one before."""
        return (np.diff(starts, prepend=-2) != 1) | (np.diff(self.segment[starts], prepend=-1) != 0)

    def cut(self, run: tuple) -> bytes:
        """The text of a run."""
        return self.text[run[4] : run[4] + run[3] - run[2] + LENGTH - 1].tobytes()

    def runs(self, starts: np.ndarray) -> list[tuple]:
        """Maximal runs of the ascending start positions as (id, th, begin, end, position)."""
        if not len(starts):
            return []
        new = self.breaks(starts)
        a = starts[new]
        b = starts[np.append(np.flatnonzero(new)[1:], len(starts)) - 1]
        s = self.segment[a]
        shift = self.begins[s] - self.first[s]
        return list(zip(self.ids[s].tolist(), self.ths[s].tolist(), (a + shift).tolist(), (b + shift + 1).tolist(), a.tolist(), strict=True))


# Strings that can't repeat, and copies


def _smallest(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The starts of a block, the smallest hash of each, and the hashes at all positions that are some start's smallest."""
    held = block.left >= LENGTH
    h = _hashes(block.text[: block.size + LENGTH], GRAM)
    least = _sliding(h, SPAN, np.minimum)[: block.size]
    judged = np.zeros(block.size + 2 * SPAN, np.uint64)
    judged[SPAN - 1 : SPAN - 1 + block.size] = np.where(held, least, np.uint64(0))  # a position is taken if the largest of the minima over it is its own hash
    taken = h[: block.size + SPAN - 1][(over := _sliding(judged, SPAN, np.maximum)[: block.size + SPAN - 1]) == h[: block.size + SPAN - 1]]
    assert len(over) == block.size + SPAN - 1
    return np.flatnonzero(held), least[held], taken


def _sent_hashes(bits: int) -> Callable:
    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.to_dict("records"):
                u = np.unique(_smallest(Block(row))[2])
                shards = (u >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(u), np.int64)
                low = (u << np.uint64(bits) >> np.uint64(32)).astype("<u4")
                edges = np.append(np.flatnonzero(np.diff(shards, prepend=-1)), len(u))
                yield pd.DataFrame([{"shard": int(shards[a]), "block": row["block"], "keys": low[a:b].tobytes()} for a, b in zip(edges[:-1], edges[1:], strict=True)], columns=["shard", "block", "keys"])

    return send


def _shared(frame: pd.DataFrame) -> pd.DataFrame:
    """Which of the hashes that blocks sent, other blocks sent as well; a bit each."""
    parts = [np.frombuffer(k, "<u4") for k in frame["keys"]]
    u, inverse, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    flags = np.split((n > 1)[inverse.reshape(-1)], np.cumsum([len(p) for p in parts])[:-1])
    return pd.DataFrame({"shard": frame["shard"], "block": frame.block, "n": [len(p) for p in parts], "bits": [np.packbits(x).tobytes() for x in flags]})


def _candidates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What is left of blocks: the segments whose strings may repeat."""
    for f in frames:
        for row in f.to_dict("records"):
            block = Block(row)
            starts, least, taken = _smallest(block)
            u, n = np.unique(taken, return_counts=True)
            shared = np.concatenate([np.unpackbits(np.frombuffer(p["bits"], np.uint8), count=p["n"]) for p in row["parts"]])
            many = (n > 1) | shared.astype(bool)
            runs = block.runs(starts[many[np.searchsorted(u, least)]])
            if runs:
                yield pd.DataFrame([_pack(row["block"], [(*r[:4], block.cut(r)) for r in runs])])


class Pieces:
    """The runs of starts of a block with the same smallest hash, and the first of each kind, in the order of hashes."""

    def __init__(self, block: Block) -> None:
        starts, least, taken = _smallest(block)
        new = block.breaks(starts)
        new[1:] |= least[1:] != least[:-1]
        at = np.flatnonzero(new)
        self.starts, self.sizes = starts, np.diff(np.append(at, len(starts)))
        begin, m, raw = starts[at], least[at], block.text.tobytes()
        digests = b"".join([hashlib.blake2b(raw[a : a + n + LENGTH - 1], digest_size=16).digest() for a, n in zip(begin.tolist(), self.sizes.tolist(), strict=True)])
        d, s = np.frombuffer(digests, "<u8").reshape(-1, 2), block.segment[begin]
        # a hash at more positions than pieces: some piece holds it twice, so that its own strings may be equal
        twice = [np.searchsorted(x, m, "right") - np.searchsorted(x, m, "left") for x in (np.sort(taken), np.sort(m))]
        keys = [m, d[:, 0], d[:, 1], block.ids[s], block.ths[s], begin - block.first[s] + block.begins[s], (twice[0] != twice[1]).view(np.uint8)]
        self.order = np.lexsort(keys[5::-1])
        keys = [k[self.order] for k in keys]
        _, self.kind, self.own, self.first = _kinds(keys)
        self.keys = [k[self.first] for k in keys]

    def judged(self, codes: np.ndarray) -> np.ndarray:
        """A code for each start, from one for the first piece of each kind."""
        out = np.empty(len(self.order), np.uint8)
        out[self.order] = np.where(self.own, codes[self.kind], COPY)
        return np.repeat(out, self.sizes)


#: What becomes of a piece: put aside, sorted, or removed as a copy.
ASIDE, SORTED, COPY = range(3)
KEY = ("<u8", "<u8", "<u8", "<i8", "<i8", "<i8", "u1")


def _kinds(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys: the hash each has (by number), its kind of piece, whether it stands where its kind's first does,
    and the first of each kind."""
    m, d1, d2, doc, th, begin, _ = keys
    other = np.append(True, m[1:] != m[:-1])[: len(m)]
    new = other.copy()
    new[1:] |= (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
    kind, first = np.cumsum(new) - 1, np.flatnonzero(new)
    f = first[kind]
    return np.cumsum(other) - 1, kind, (doc == doc[f]) & (th == th[f]) & (begin == begin[f]), first


def _sent_pieces(bits: int) -> Callable:
    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.to_dict("records"):
                keys = Pieces(Block(row)).keys
                shards = (keys[0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys[0]), np.int64)
                edges = np.append(np.flatnonzero(np.diff(shards, prepend=-1)), len(shards))
                yield pd.DataFrame([{"shard": int(shards[a]), "block": row["block"], "words": [k[a:b].astype(t).tobytes() for k, t in zip(keys, KEY, strict=True)]} for a, b in zip(edges[:-1], edges[1:], strict=True)], columns=["shard", "block", "words"])

    return send


def _judged(frame: pd.DataFrame) -> pd.DataFrame:
    """What becomes of the pieces that blocks sent; a byte each."""
    parts = [[np.frombuffer(w, t) for w, t in zip(words, KEY, strict=True)] for words in frame["words"]]
    keys = [np.concatenate(k) for k in zip(*parts, strict=True)]
    order = np.lexsort(keys[5::-1])
    keys = [k[order] for k in keys]
    group, _, own, first = _kinds(keys)
    many = (np.bincount(group[first]) > 1) | (np.bincount(group, keys[6]) > 0)
    codes = np.empty(len(order), np.uint8)
    codes[order] = np.where(own, np.where(many[group], SORTED, ASIDE), COPY)
    cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
    return pd.DataFrame({"shard": frame["shard"], "block": frame.block, "codes": [c.tobytes() for c in np.split(codes, cuts)]})


def _segments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The runs of starts that are sorted, with their texts, and those of copies, without."""
    for f in frames:
        for row in f.to_dict("records"):
            block = Block(row)
            pieces = Pieces(block)
            codes = pieces.judged(np.concatenate([np.frombuffer(p["codes"], np.uint8) for p in row["parts"]]))
            out = [(*r[:4], block.cut(r)) for r in block.runs(pieces.starts[codes == SORTED])]
            out += [(*r[:4], None) for r in block.runs(pieces.starts[codes == COPY])]
            if out:
                yield pd.DataFrame(out, columns=["id", "th", "begin", "end", "text"])


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition as one block; partitions are ranges of ids. Rows that repeat both id and text come once."""
    rows, block = [], 0
    for f in frames:
        for row in zip(f.id, f.th, f.begin, f.end, f.text, strict=True):
            if not rows or rows[-1][:3] != row[:3]:
                rows.append(row)
        block = int(f["block"].iloc[0]) if len(f) else block
    if rows:
        yield pd.DataFrame([_pack(block, rows)])


# Sorting and naming


def _lowest(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys (columns of words, most significant first), and for each key in it, whether it is a new one."""
    order = np.lexsort(words[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for w in words:
        new[1:] |= w[order][1:] != w[order][:-1]
    return order, new


def _keys(row: dict, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sampled positions of a block that are named at ``depth``, and their keys: three symbols, then three names,
    and at last names and bytes that make up LENGTH - 2 bytes."""
    block = Block(row)
    width = (3 * SYMBOL, 9 * SYMBOL, LENGTH - 2)[depth]
    at = block.holding(width)
    at = at[at % 3 != 0]
    if depth == 0:
        t = block.text
        four = (t[:-3].astype(np.uint64) << np.uint64(24)) | (t[1:-2].astype(np.uint64) << np.uint64(16)) | (t[2:-1].astype(np.uint64) << np.uint64(8)) | t[3:].astype(np.uint64)
        return at, [(four[at] << np.uint64(32)) | four[at + SYMBOL], four[at + 2 * SYMBOL]]
    before = width_before = (3 * SYMBOL, 9 * SYMBOL)[depth - 1]
    names = np.zeros(len(block.text), np.uint64)
    known = block.holding(width_before)
    known = known[known % 3 != 0]
    names[known] = np.frombuffer(row["names"], np.uint64)
    if depth == 1:
        return at, [names[at], names[at + before], names[at + 2 * before]]
    reach = LENGTH - 4 - before  # the last name that ends four bytes before LENGTH, at the same place mod 3
    reach -= reach % 3
    tail = [block.text[at + k].astype(np.uint64) for k in range(reach + before, width)]
    last = sum((t << np.uint64(8 * (len(tail) - 1 - k)) for k, t in enumerate(tail)), np.zeros(len(at), np.uint64))
    return at, [names[at], names[at + before], names[at + reach], last]


def _sampled(depth: int, each: int) -> Callable:
    def sample(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.to_dict("records"):
                words = _keys(row, depth)[1]
                n = -(-len(row["text"]) * each // BLOCK)  # by bytes, however many blocks hold them
                some = np.random.default_rng(row["block"]).integers(0, len(words[0]), n) if len(words[0]) else []
                yield pd.DataFrame({"words": [[int(w[i].view(np.int64)) for w in words] for i in some]})

    return sample


def _edges(words: list[np.ndarray], cuts: list[tuple]) -> list[int]:
    """Where the ranges between ``cuts`` begin in sorted keys."""
    out = [0]
    for cut in cuts:
        a, b = 0, len(words[0])
        for w, c in zip(words, cut, strict=True):
            part = w[a:b]
            a, b = a + int(np.searchsorted(part, np.uint64(c), "left")), a + int(np.searchsorted(part, np.uint64(c), "right"))
        out.append(a)
    return [*out, len(words[0])]


def _sent_keys(depth: int, cuts: list[tuple]) -> Callable:
    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.to_dict("records"):
                words = _keys(row, depth)[1]
                order, new = _lowest(words)
                words = [w[order][new] for w in words]
                edges = _edges(words, cuts)
                yield pd.DataFrame([{"range": k, "block": row["block"], "words": [_narrow(w[a:b]) for w in words]} for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a], columns=["range", "block", "words"])

    return send


def _narrow(w: np.ndarray) -> bytes:
    """Words as 4 bytes each where they fit, else 8; the first byte says which."""
    small = not len(w) or int(w.max()) < 1 << 32
    return b"\4" + w.astype("<u4").tobytes() if small else b"\10" + w.astype("<u8").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.uint64)


def _ranked(frame: pd.DataFrame) -> pd.DataFrame:
    """The ranks, within a range, of the keys that blocks sent."""
    parts = [[_wide(w) for w in words] for words in frame["words"]]
    words = [np.concatenate(w) for w in zip(*parts, strict=True)]
    order, new = _lowest(words)
    ranks = np.empty(len(order), np.uint64)
    ranks[order] = np.cumsum(new) - 1
    cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
    return pd.DataFrame({"range": frame["range"], "block": frame.block, "distinct": int(new.sum()), "ranks": [_narrow(r) for r in np.split(ranks, cuts)]})


def _named(depth: int, base: dict[int, int]) -> Callable:
    def name(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.to_dict("records"):
                order, new = _lowest(_keys(row, depth)[1])
                ranks = [_wide(p["ranks"]) + np.uint64(base[p["range"]]) for p in row["parts"]]
                names = np.empty(len(order), np.uint64)
                if len(order):
                    names[order] = np.concatenate(ranks)[np.cumsum(new) - 1]
                yield pd.DataFrame([{k: row[k] for k in ("block", "ids", "ths", "begins", "ends", "text")} | {"names": names.tobytes()}])

    return name


STATE = f"{PACKED}, names binary"


def _quantiles(rows: list[tuple], n: int) -> list[tuple]:
    rows = sorted(rows)
    return sorted({rows[len(rows) * k // n] for k in range(1, n)}) if rows else []


def _naming(steps: Steps, blocks: DataFrame, depth: int, n_blocks: int, n_bytes: int) -> DataFrame:
    """``blocks`` with the names of ``depth``."""
    ranges, cuts = -(-n_bytes * 2 // 3 // KEYS), []
    if ranges > 1:
        some = blocks.filter(F.xxhash64("block") % max(1, n_blocks // 100) == 0)  # for the cuts alone
        cuts = _quantiles([tuple(x % (1 << 64) for x in r["words"]) for r in some.mapInPandas(_sampled(depth, 500), "words array<long>").collect()], ranges)
    sent = blocks.mapInPandas(_sent_keys(depth, cuts), "range int, block long, words array<binary>")
    ranked = steps.keep(sent.groupBy("range").applyInPandas(_ranked, "range int, block long, distinct long, ranks binary"), "suffix-ranks")
    base, total = {}, 0
    for r in sorted(ranked.groupBy("range").agg(F.max("distinct").alias("n")).collect(), key=lambda r: r["range"]):
        base[r["range"]], total = total, total + r["n"]
    parts = ranked.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("range", "ranks"))).alias("parts"))
    out = steps.keep(blocks.join(parts, "block", "left").withColumn("parts", F.coalesce("parts", F.array())).mapInPandas(_named(depth, base), STATE), "suffix-names")
    steps.drop(ranked, blocks)
    return out


# Merging


def _suffixes(row: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each place mod 3: the starts of a block, two keys of each that hold its LENGTH bytes exactly, and their order.

    Sampled places: rank and last two bytes. Place 0 and 1: first byte, rank behind it, last byte. Place 0 and 2: first
    two bytes and rank behind them. The keys of a place come in the same order.
    """
    block = Block(row)
    ranks, t = np.zeros(len(block.text), np.uint64), block.text.astype(np.uint64)
    known = block.holding(LENGTH - 2)
    known = known[known % 3 != 0]
    ranks[known] = np.frombuffer(row["names"], np.uint64)
    starts = block.holding(LENGTH)
    for place in range(3):
        i = starts[starts % 3 == place]
        sampled = (ranks[i] << np.uint64(16)) | (t[i + LENGTH - 2] << np.uint64(8)) | t[i + LENGTH - 1]
        one = (t[i] << np.uint64(56)) | (ranks[i + 1] << np.uint64(8)) | t[i + LENGTH - 1]
        two = (t[i] << np.uint64(56)) | (t[i + 1] << np.uint64(48)) | ranks[i + 2]
        yield place, i, *((one, two), (sampled, one), (sampled, two))[place]


def _cut_keys(each: int) -> Callable:
    def sample(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.to_dict("records"):
                for place, i, x, y in _suffixes(row):
                    if place == 1 and len(i):
                        some = np.random.default_rng(row["block"]).integers(0, len(i), -(-len(row["text"]) * each // BLOCK))
                        yield pd.DataFrame({"x": x[some].view(np.int64), "y": y[some].view(np.int64)})

    return sample


def _sent_suffixes(cuts: list[tuple]) -> Callable:
    """Each block's first suffix of each kind of LENGTH bytes and place, by range. ``cuts``: suffixes at place 1."""
    by = [np.array([c[k] for c in cuts], np.uint64) for k in (0, 1)]

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.to_dict("records"):
                out = []
                for place, i, x, y in _suffixes(row):
                    u, first = np.unique(x, return_index=True)
                    edges = [0, *np.searchsorted(u, by[1 if place == 0 else 0], "left").tolist(), len(u)]
                    out += [{"range": k, "block": row["block"], "place": place, "x": _narrow(u[a:b]), "y": _narrow(y[first[a:b]]), "at": i[first[a:b]].astype("<u4").tobytes()} for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
                yield pd.DataFrame(out, columns=["range", "block", "place", "x", "y", "at"])

    return send


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    """A range of suffixes in order; a bit each that sent one: whether it is the earliest of those with its LENGTH bytes."""
    frame = frame.sort_values(["block", "place"]).reset_index(drop=True)
    x, y = ([_wide(v) for v in frame[c]] for c in ("x", "y"))
    sizes = np.array([len(v) for v in x])
    place = np.repeat(frame["place"].to_numpy(), sizes)
    row, at = np.repeat(np.arange(len(frame)), sizes), np.concatenate([np.frombuffer(a, "<u4") for a in frame["at"]])
    x, y = np.concatenate(x), np.concatenate(y)
    rest, sample = np.flatnonzero(place == 0), np.flatnonzero(place != 0)
    rest, sample = rest[np.argsort(x[rest], kind="stable")], sample[np.argsort(x[sample], kind="stable")]
    ones, twos = sample[place[sample] == 1], sample[place[sample] == 2]
    # of the sampled suffixes, those at 1 are compared by the first byte and the rank behind it, those at 2 by two bytes
    spot = np.arange(len(rest)) + np.searchsorted(y[ones], x[rest], "left") + np.searchsorted(y[twos], y[rest], "left")
    order = np.empty(len(x), np.int64)
    free = np.ones(len(x), bool)
    free[spot] = False
    order[spot], order[free] = rest, sample
    a, b = order[:-1], order[1:]
    same = np.where(place[a] == 0, np.where(place[b] == 0, x[a] == x[b], np.where(place[b] == 1, x[a] == y[b], y[a] == y[b])), (place[b] != 0) & (x[a] == x[b]))
    begins = np.flatnonzero(np.append(True, ~same))
    block = frame.block.to_numpy()[row]
    when = np.empty(len(x), np.int64)
    when[np.lexsort((at, block))] = np.arange(len(x))
    kind = np.cumsum(np.append(True, ~same)) - 1
    early = np.empty(len(x), bool)
    early[order] = np.minimum.reduceat(when[order], begins)[kind] == when[order]
    return pd.DataFrame({"block": frame.block, "place": frame["place"], "range": frame["range"], "n": sizes, "bits": [np.packbits(e).tobytes() for e in np.split(early, np.cumsum(sizes)[:-1])]})


def _repeats(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The runs of strings that start earlier somewhere."""
    for f in frames:
        for row in f.to_dict("records"):
            block, found = Block(row), []
            for place, i, x, _ in _suffixes(row):
                bits = [np.unpackbits(np.frombuffer(p["bits"], np.uint8), count=p["n"]) for p in row["parts"] if p["place"] == place]
                if not bits:
                    continue
                _, first, inverse = np.unique(x, return_index=True, return_inverse=True)
                stays = np.zeros(len(i), bool)
                stays[first[np.concatenate(bits).astype(bool)]] = True
                found.append(i[~stays])
            runs = block.runs(np.sort(np.concatenate(found))) if found else []
            if runs:
                yield pd.DataFrame([r[:4] for r in runs], columns=["id", "th", "begin", "end"])


def _bits(blocks: DataFrame, each: int) -> int:
    """Bits that tell shards apart, of about HASHES keys, where one key comes in ``each`` bytes."""
    size = blocks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(0, (size // each // HASHES).bit_length())


def repeated(docs: DataFrame) -> DataFrame:
    """(id, th, begin, end): runs of places where strings of LENGTH bytes start that also start earlier.

    ``docs``: id, th, text; id and th (a hash of the text) order the documents.
    """
    spark = docs.sparkSession
    steps = Steps(spark)
    numbered = docs.select("id", "th", "text").withColumn("part", F.spark_partition_id().cast("long"))
    blocks = steps.keep(numbered.mapInPandas(_blocks, PACKED), "suffix-blocks")
    bits = _bits(blocks, 8)
    sent = blocks.mapInPandas(_sent_hashes(bits), "shard int, block long, keys binary")
    shared = steps.keep(sent.groupBy("shard").applyInPandas(_shared, "shard int, block long, n int, bits binary"), "suffix-shared")
    parts = shared.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "n", "bits"))).alias("parts"))
    left = steps.keep(blocks.join(parts, "block").mapInPandas(_candidates, PACKED), "suffix-candidates")
    steps.drop(shared, blocks)

    sent = left.mapInPandas(_sent_pieces(_bits(left, 16)), "shard int, block long, words array<binary>")
    judged = steps.keep(sent.groupBy("shard").applyInPandas(_judged, "shard int, block long, codes binary"), "suffix-judged")
    parts = judged.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "codes"))).alias("parts"))
    judged_runs = steps.keep(left.join(parts, "block").mapInPandas(_segments, f"{SEGMENT}, text binary"), "suffix-segments")
    steps.drop(judged, left)

    copied, segments = judged_runs.filter("text is null").select("id", "th", "begin", "end"), judged_runs.filter("text is not null")
    n_bytes = segments.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not n_bytes:
        return copied
    n_blocks = -(-n_bytes // BLOCK)
    ordered = segments.repartitionByRange(n_blocks, "id", "th", "begin").sortWithinPartitions("id", "th", "begin").withColumn("block", F.spark_partition_id().cast("long"))
    state = steps.keep(ordered.mapInPandas(_packed, PACKED).withColumn("names", F.lit(None).cast("binary")), "suffix-state")
    for depth in range(3):
        state = _naming(steps, state, depth, n_blocks, n_bytes)

    ranges, cuts = -(-n_bytes // KEYS), []
    if ranges > 1:
        some = state.filter(F.xxhash64("block") % max(1, n_blocks // 100) == 0)  # for the cuts alone
        cuts = _quantiles([(r.x % (1 << 64), r.y % (1 << 64)) for r in some.mapInPandas(_cut_keys(500), "x long, y long").collect()], ranges)
    sent = state.mapInPandas(_sent_suffixes(cuts), "range int, block long, place int, x binary, y binary, at binary")
    merged = steps.keep(sent.groupBy("range").applyInPandas(_merged, "block long, place int, range int, n int, bits binary"), "suffix-merged")
    parts = merged.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "range", "n", "bits"))).alias("parts"))
    found = steps.keep(state.join(parts, "block").mapInPandas(_repeats, SEGMENT), "suffix-repeats")
    steps.drop(merged, state)
    return copied.unionByName(found)


DONE = T.StructType().add("n_removed", "long").add("n_spans", "long").add("kept", "binary")


@F.pandas_udf(DONE)
def _without(text: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.DataFrame:
    """Texts without the bytes that the strings of LENGTH bytes at begins..ends - 1 cover. Null texts stay away."""
    out = []
    for t, a, b in zip(text, begins, ends, strict=True):
        if t is None:
            out.append((0, 0, None))
            continue
        raw = t.encode()
        a, b = np.asarray(a, np.int64), np.asarray(b, np.int64) + LENGTH - 1
        order = np.argsort(a, kind="stable")
        a, b = a[order], np.maximum.accumulate(b[order])
        new = np.append(True, a[1:] > b[:-1])
        begin, end = a[new], b[np.append(np.flatnonzero(new)[1:], len(a)) - 1]
        kept = b"".join(raw[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(raw)], strict=True))
        out.append((int((end - begin).sum()), len(begin), kept))
    return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept"])


def dedup_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes that stay) more, or anew."""
    require(docs, "doc_id", "text")
    rows = docs.select(F.struct("*").alias("row")).select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(LAST)).alias("id"), F.coalesce("row.text", F.lit("")).alias("text"))
    rows = rows.select("row", "id", F.xxhash64("text").alias("th"), "text")
    spans = repeated(rows.select("id", "th", "text"))
    spans = spans.groupBy("id", "th").agg(F.collect_set(F.struct("begin", "end")).alias("s")).select("id", "th", F.col("s.begin").alias("begins"), F.col("s.end").alias("ends"))
    text = F.coalesce("row.text", F.lit(""))
    met = rows.drop("text").join(spans, ["id", "th"], "left").select("row", _without(F.when(F.col("begins").isNotNull(), text), "begins", "ends").alias("done"))
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept")]
    return met.select(*own, F.octet_length(text).cast("long").alias("n_bytes"), "done.n_removed", "done.n_spans", F.coalesce("done.kept", text.cast("binary")).alias("kept"))
