"""Near-duplicate documents: fast similarity sketches, banding, exact verification, connected components.

A sketch has T coordinates. In rounds, every shingle is hashed to a bin and a value, and a coordinate keeps the value
of the first round that reaches it; from round T on, all shingles go to one named bin a round, so every coordinate is
filled after 2T rounds at most, while the agreement of two sketches stays concentrated around their similarity as if
the coordinates were independent. Bands of ROWS coordinates make candidates: at similarity 0.8 a pair shares none of
the 24 bands with probability 3e-6.

Equal shingle sets are one class from the start (by a 128-bit digest), so copies cost nothing further. Each band's
bucket ties its classes to its smallest one, which is linear in its size; the groups so tied are then joined exactly:
in a task, what any two sets of a group, or of a block of a large one, have in common is counted. A large group first
meets its first block; only classes outside its largest component then meet all other blocks. So a large group that
hangs together is linear in its number of blocks, and no link between different texts is left out.

A class goes by its least row, an id with a hash of the text, so that rows that share an id but not a text are classes
of their own.

Defined results: texts without words, and null texts, are linked with nothing; a row without an id is left out of the
comparison, has a null component and is kept. For ``near_duplicates``, rows that share an id are one document, and are
in one component; ``drop_near_duplicates`` judges each by its own text. An empty table gives an empty result. Other
columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laborlens.llm.common import cut, lookup, written
from laborlens.llm.graph import connected
from laborlens.llm.shingles import FOLD, U, WordHashes, mix, shingle_set, small_batches, texts

COORDINATES, ROWS = 96, 4
#: Shingles of one block of a group, 8 bytes each. Small sets weigh as much as LEAST shingles, so that the pairs of a
#: block are bounded as well.
BLOCK, LEAST = 1_000_000, 250
#: An element that more than one in OFTEN of a block's sets hold counts as frequent; pairs that are compared at once.
OFTEN, PART = 12, 1 << 22
EMPTY = U(0xFFFFFFFFFFFFFFFF)


def sketch(flat: np.ndarray, owner: np.ndarray, n: int, t: int = COORDINATES) -> np.ndarray:
    """(n, t) sketches of ``n`` sets that aren't empty; ``flat`` holds all their elements, ``owner`` whose they are."""
    s = np.full(n * t, EMPTY)
    for i in range(2 * t):
        h = mix(flat + U((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        slot = ((h >> U(32)) * U(t) >> U(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(s, owner * t + slot, (U(i) << U(32)) | (h & U(0xFFFFFFFF)))
        open_ = ~(s.reshape(n, t) != EMPTY).all(1)
        if not open_.any():
            break
        if i == 0 or open_.sum() < len(open_):
            keep = open_[owner]
            flat, owner = flat[keep], owner[keep]
    return s.reshape(n, t)


def bands(s: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(n, t / rows) band keys as signed integers."""
    n, t = s.shape
    h = np.broadcast_to(np.arange(t // rows, dtype=U), (n, t // rows)).copy()
    for i in range(rows):
        h = mix(h * U(0x9E3779B97F4A7C15) + s[:, i::rows])
    return h.view(np.int64)


def _digest(s: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist())


def _sets(batch: pa.RecordBatch, cache: WordHashes, k: int) -> list[np.ndarray]:
    return [shingle_set(cache.of(t.translate(FOLD).split()) if t else np.empty(0, U), k) for t in texts(batch, "text")]


def _row(docs: DataFrame) -> DataFrame:
    """(doc_id, t, text): ``t`` tells apart texts that share an id."""
    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text")


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, t, n_shingles, s1, s2, bands): the digest and bands are null for texts without words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in small_batches(batches, "text"):
            sets = _sets(batch, cache, k)
            full = [i for i, s in enumerate(sets) if len(s)]
            digests, keys = [(None, None)] * len(sets), [None] * len(sets)
            if full:
                b = bands(sketch(np.concatenate([sets[i] for i in full]), np.repeat(np.arange(len(full)), [len(sets[i]) for i in full]), len(full)))
                for row, i in zip(b.tolist(), full, strict=True):
                    digests[i], keys[i] = _digest(sets[i]), row
            s1, s2 = zip(*digests, strict=True)
            columns = [batch.column("doc_id"), batch.column("t"), pa.array([len(s) for s in sets], pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "n_shingles", "s1", "s2", "bands"])

    schema = T.StructType([docs.schema["doc_id"]]).add("t", "long").add("n_shingles", "long").add("s1", "long").add("s2", "long").add("bands", T.ArrayType(T.LongType()))
    return _row(docs).mapInArrow(of, schema)


def _members(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``wanted`` (rep, root, blocks, block) with their sets as bytes, from the documents' whole texts.

    Rows that share both id and text give one set a task.
    """
    kept = ["rep", "root", "blocks", "block"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = WordHashes(), set()
        for batch in small_batches(batches, "text"):
            names = [(*r["rep"].values(), *r["root"].values(), r["block"]) for r in batch.select(["rep", "root", "block"]).to_pylist()]
            new = [i for i, name in enumerate(names) if name not in seen and not seen.add(name)]
            batch = batch.take(pa.array(new, pa.int64()))
            sets = _sets(batch, cache, k)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([s.tobytes() for s in sets], pa.binary())], [*kept, "set"])

    asked = wanted.select(F.col("rep.doc_id").alias("asked_id"), F.col("rep.t").alias("asked_t"), *kept)
    met = _row(docs).join(asked, (F.col("doc_id") == F.col("asked_id")) & (F.col("t") == F.col("asked_t")))
    met = met.select(*kept, "text")
    return met.mapInArrow(of, T.StructType([met.schema[c] for c in kept]).add("set", "binary"))


def _similar(token: np.ndarray, row: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(x, the sets before x that are similar to it) for each set x; set ``row[k]`` holds element ``token[k]``.

    Common elements are counted for all pairs: those that many sets hold by a product of matrices, all others by going
    through the sets that hold them. Sets come in parts, so that memory follows the elements of the sets.
    """
    m = len(sizes)
    order = np.lexsort((row, token))
    row = row[order]
    _, begin, held = np.unique(token[order], return_index=True, return_counts=True)
    element, often = np.repeat(np.arange(len(held)), held), held > max(1, m / OFTEN)
    place = np.arange(len(row)) - begin[element]  # how many sets before this one hold the element
    frequent = often[element]
    dense = np.zeros((m, int(often.sum())), np.float32 if sizes.max() < 1 << 24 else np.float64)
    dense[row[frequent], (np.cumsum(often) - 1)[element[frequent]]] = 1
    rare = np.flatnonzero(~frequent & (place > 0))
    rare = rare[np.argsort(row[rare], kind="stable")]
    edge = np.searchsorted(row[rare], np.arange(m + 1))
    work = np.concatenate([[0], np.cumsum(place[rare])])[edge]
    a = 0
    while a < m:
        b = max(a + 1, min(a + max(1, PART // m), int(np.searchsorted(work, work[a] + PART, "right")) - 1))
        some = rare[edge[a] : edge[b]]
        n = place[some]
        before = np.repeat(some - np.cumsum(n), n) + np.arange(n.sum())
        common = np.bincount(np.repeat(row[some] - a, n) * b + row[before], minlength=(b - a) * b).reshape(b - a, b)
        common += (dense[a:b] @ dense[:b].T).astype(np.int64)
        similar = (100 + percent) * common >= percent * (sizes[a:b, None] + sizes[:b])
        for x in range(a, b):
            yield x, np.flatnonzero(similar[x - a, :x])
        a = b


def local_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Index pairs that link all sets which chains of similar pairs connect; similar: 100 * common >= percent * union.

    An element that one set alone holds is common to no pair, so sets of equal size and equal other elements compare
    alike with all others; one of them is compared for all. A set is linked once with each component that it meets.
    """
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[token] > 1
    token, owner = token[shared], owner[shared]
    token = token[np.lexsort((token, owner))]
    start = np.searchsorted(owner, np.arange(len(sets) + 1))
    alike: dict[tuple[int, bytes], list[int]] = {}
    for x, size in enumerate(sizes.tolist()):
        alike.setdefault((size, token[start[x] : start[x + 1]].tobytes()), []).append(x)
    first = np.array([same[0] for same in alike.values()])
    lengths = start[first + 1] - start[first]
    ends = np.cumsum(lengths)
    places = np.repeat(start[first] - (ends - lengths), lengths) + np.arange(ends[-1])
    part, links = np.arange(len(first)), []
    for x, near in _similar(token[places], np.repeat(np.arange(len(first)), lengths), sizes[first], percent):
        while len(near):
            links.append((int(first[x]), int(first[near[0]])))
            met = part[near[0]]
            near = near[part[near] != met]
            part[part == met] = x
    linked = dict(links) | {y: x for x, y in links}
    for (size, held), (x, *others) in alike.items():
        common = len(held) // token.itemsize
        to = x if 100 * common >= percent * (2 * size - common) else linked.get(x)
        links += [(other, to) for other in others if to is not None]
    return links


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """(u, v) links within each task's sets; ``rows`` (root, i, j, rep, set)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(reps: list, sets: list, kind: pa.DataType) -> pa.RecordBatch:
            unique = list({(r["doc_id"], r["t"]): (r, s) for r, s in zip(reps, sets, strict=True)}.values())
            found = local_links([np.frombuffer(s, U) for _, s in unique], percent) if len(unique) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([unique[x][0] for x, _ in found], kind), pa.array([unique[y][0] for _, y in found], kind)], ["u", "v"])

        key, reps, sets, kind = None, [], [], None
        for batch in batches:
            kind = batch.schema.field("rep").type
            for k, r, s in zip(zip(*(batch.column(c).to_pylist() for c in ("r_id", "r_t", "i", "j")), strict=True), batch.column("rep").to_pylist(), batch.column("set").to_pylist(), strict=True):
                if k != key and reps:
                    yield joined(reps, sets, kind)
                    reps, sets = [], []
                key = k
                reps.append(r)
                sets.append(s)
        if reps:
            yield joined(reps, sets, kind)

    keys = ["r_id", "r_t", "i", "j"]
    dealt = rows.select(F.col("root.doc_id").alias("r_id"), F.col("root.t").alias("r_t"), "i", "j", "rep", "set").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(of, T.StructType().add("u", rows.schema["rep"].dataType).add("v", rows.schema["rep"].dataType))


def _pairs_of_blocks(members: DataFrame) -> DataFrame:
    """Tasks of the first round: each block of a group beside the group's first block."""
    all_ = F.sequence(F.lit(0), F.col("blocks") - 1)
    return members.withColumn("i", F.lit(0)).withColumn("j", F.explode(F.when(F.col("block") == 0, all_).otherwise(F.array("block"))))


def _weight(n: Column) -> Column:
    return F.greatest(n, F.lit(LEAST))


def _classes(rows: DataFrame) -> DataFrame:
    """(s1, s2, rep, n, weight, bands) of distinct sets; ``n`` counts their rows."""
    rep = F.min(F.struct("doc_id", "t"))
    return rows.filter("s1 is not null and doc_id is not null").groupBy("s1", "s2").agg(rep.alias("rep"), F.count(F.lit(1)).alias("n"), F.min(_weight(F.col("n_shingles"))).alias("weight"), F.min_by("bands", F.struct("doc_id", "t")).alias("bands"))


def _linked(docs: DataFrame, classes: DataFrame, shingle: int, percent: int, block: int) -> DataFrame:
    """(u, v) links of similar ``classes``, as many as connect what chains of similar classes connect."""
    total = classes.count()
    keys = classes.select("rep", F.explode("bands").alias("band"))
    buckets = keys.groupBy("band").agg(F.min("rep").alias("leader"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("n")).filter("leader <> last").drop("last")
    tied = connected(lookup(keys, buckets, ["band"], total * COORDINATES // ROWS).select(F.col("rep").alias("u"), F.col("leader").alias("v")))
    groups = cut(classes.select("rep", "weight").join(tied.withColumnRenamed("node", "rep"), "rep"))
    blocks = groups.groupBy("root").agg(F.ceil(F.sum("weight") / block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n"))
    wanted = lookup(groups, blocks, ["root"], total).select("rep", "root", "blocks", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"))
    members = written(_members(docs, wanted, shingle), "near-sets")
    links = cut(_links(_pairs_of_blocks(members), percent))
    large = members.filter("blocks > 1")
    if large.isEmpty():
        return links
    labels = cut(large.select("rep", "root").distinct().join(connected(links).select(F.col("node").alias("rep"), F.col("root").alias("part")), "rep", "left").withColumn("part", F.coalesce("part", "rep")))
    parts = labels.groupBy("root", "part").agg(F.count(F.lit(1)).alias("k"))
    main = parts.groupBy("root").agg(F.max_by("part", F.struct("k", "part")).alias("main"), F.sum("k").alias("n"))
    apart = cut(lookup(labels, main, ["root"], total).filter("part <> main").select("rep", F.lit(True).alias("apart")))
    more = large.join(apart, "rep", "left").withColumn("apart", F.coalesce("apart", F.lit(False)))
    weight = F.sum(F.when(F.col("apart"), _weight(F.octet_length("set") / 8)))
    n_apart = more.groupBy("root").agg(F.ceil(weight / block).cast("int").alias("rows"), F.count(F.lit(1)).alias("n")).filter("rows > 0")
    more = lookup(more, n_apart, ["root"], total)
    across = more.filter("apart").select("root", "rep", "set", F.pmod(F.xxhash64(F.lit(1), "rep"), "rows").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    down = more.select("root", "rep", "set", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.col("block").alias("j"))
    return cut(links.unionByName(_links(across.unionByName(down), percent)))


def _shared_ids(rows: DataFrame, named: DataFrame) -> DataFrame | None:
    """(u, v) that tie the classes of which rows share an id, if any do; ``named``: s1, s2, rep."""
    of_ids = rows.filter("s1 is not null and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("s1", "s2")).alias("lo"), F.max(F.struct("s1", "s2")).alias("hi")).filter("lo <> hi").select("doc_id", "lo")
    of_ids = cut(of_ids)
    if of_ids.isEmpty():
        return None
    ties = rows.select("doc_id", "s1", "s2").join(of_ids, "doc_id").distinct()
    ties = ties.join(named, ["s1", "s2"]).select("lo", F.col("rep").alias("u"))
    return ties.join(named.select(F.struct("s1", "s2").alias("lo"), F.col("rep").alias("v")), "lo").select("u", "v")


def _judged(docs: DataFrame, shingle: int, percent: int, block: int, by_id: bool) -> DataFrame:
    """(doc_id, t, n_shingles, rep, root) of every row: its class and the least class reachable; null without a set."""
    rows = cut(sketches(docs, shingle))
    classes = cut(_classes(rows))
    links = _linked(docs, classes, shingle, percent, block)
    if by_id and (ties := _shared_ids(rows, classes.select("s1", "s2", "rep"))) is not None:
        links = links.unionByName(ties)
    found = connected(links).select(F.col("node").alias("rep"), "root")
    classes = classes.select("s1", "s2", "rep", "n").join(found, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    no_id = rows.filter("doc_id is null").select("doc_id", "t", "n_shingles", F.lit(None).cast(classes.schema["rep"].dataType).alias("rep"), F.lit(None).cast(classes.schema["rep"].dataType).alias("root"))
    return lookup(rows.filter("doc_id is not null").drop("bands"), cut(classes), ["s1", "s2"], rows.count(), "left").select(*no_id.columns).unionByName(no_id)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (smallest reachable doc_id), kept."""
    component = F.coalesce("root.doc_id", "doc_id")
    return _judged(docs, shingle, percent, block, by_id=True).select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, all columns kept: that with the least id (and hash of the text).

    Of rows that share both id and text one stays, the first by all columns as JSON.
    """
    own = F.struct("doc_id", "t")
    found = cut(_judged(docs, shingle, percent, BLOCK, by_id=False).filter("doc_id is not null").select("doc_id", "t", (F.col("root").isNull() | (F.col("root") == own)).alias("stays")))
    gone = found.filter("not stays").select(own.alias("gone_key")).distinct()
    again = found.filter("stays").groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(own.alias("again_key"))
    key = F.struct(docs["doc_id"], F.xxhash64(docs["text"]).alias("t"))
    left = docs.join(gone, key == gone["gone_key"], "left_anti")
    if again.isEmpty():
        return left
    once = left.join(again, key == again["again_key"], "left_anti")
    repeats = left.join(again, key == again["again_key"], "left_semi").select(key.alias("k"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    one = repeats.groupBy("k").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return once.unionByName(one.select("row.*"))
