"""WARC records, and a Merkle audit of replicas.

``records`` lays pages out as WARC files with offsets; ``write_files`` and ``read_files`` go to and from real files.
The audit hashes each record. A leaf is a range of RANGE bytes of a file and hashes its records, with their offsets,
in order; FANOUT neighbouring ranges form a node of the next level, up to one root a file. Replicas are compared from
the roots down: a level only looks below nodes that differed one level above, and only records in differing leaves are
compared themselves.

Every level is one aggregation by file and range with a bounded number of children, so a long file is spread over
many tasks. Lost and added records, and changed lengths, shift the offsets of what follows; that shows as records
without a counterpart.

Defined results: null urls and pages are empty; pages without an id lie in files of their own, by a hash of the url and
in the order of urls; pages that repeat an id stand next to each other; a file that only one replica has differs from
its root down; empty replicas agree. Columns other than page_id, url and html are not read.

``read_files`` reads plain and gzipped files as a stream of records, so neither a file nor more than a record is held
in memory. Every record comes back with its bytes; one that can't be read says why in ``status``, and those after it
come back all the same.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laborlens.llm.common import cut

RANGE, FANOUT = 1 << 16, 16
EPOCH = "1970-01-01T00:00:00Z"
#: Files of pages without an id, numbered down from -NAMELESS: no id comes there by division.
NAMELESS, NAMELESS_FILES = 10**17, 1 << 16


def record_text(url: Column, html: Column) -> Column:
    """A WARC resource record of a page."""
    html = F.coalesce(html, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit(f"\r\nWARC-Date: {EPOCH}\r\nContent-Type: text/html\r\nContent-Length: "))
    return F.concat(head, F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"))


def _file(pages_per_file: int) -> Column:
    nameless = -NAMELESS - F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(NAMELESS_FILES))
    return F.coalesce(F.floor(F.col("page_id") / pages_per_file), nameless).cast("long").alias("file")


def records(pages: DataFrame, pages_per_file: int = 1000) -> DataFrame:
    """(file, offset, length, page_id, digest) of ``pages`` (page_id, url, html), in files by ranges of page ids."""
    text = record_text(F.col("url"), F.col("html"))
    named = F.when(F.col("page_id").isNull(), F.col("url")).alias("url")
    out = pages.select(_file(pages_per_file), "page_id", named, F.octet_length(text).cast("long").alias("length"), F.sha2(text, 256).alias("digest"))
    end = F.sum("length").over(W.partitionBy("file").orderBy("page_id", "url", "digest").rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn("offset", end - F.col("length")).select("file", "offset", "length", "page_id", "digest")


def height(*replicas: DataFrame) -> int:
    """Levels above the leaves that the longest file of the replicas needs."""
    last = max(r.agg(F.max("offset")).first()[0] or 0 for r in replicas) // RANGE
    levels = 0
    while last > 0:
        last //= FANOUT
        levels += 1
    return levels


def tree(recs: DataFrame, levels: int) -> list[DataFrame]:
    """Levels (file, node, digest) from the leaf ranges to the roots."""
    listed = F.array_sort(F.collect_list(F.struct("offset", "length", "digest")))
    told = F.array_join(F.transform(listed, lambda r: F.concat_ws(":", r["offset"].cast("string"), r["length"].cast("string"), r["digest"])), ",")
    out = [cut(recs.groupBy("file", F.floor(F.col("offset") / RANGE).alias("node")).agg(F.sha2(told, 256).alias("digest")))]
    for _ in range(levels):
        children = F.array_sort(F.collect_list(F.struct(F.col("node").alias("child"), "digest")))
        told = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["child"].cast("string"), c["digest"])), ",")
        out.append(cut(out[-1].groupBy("file", F.floor(F.col("node") / FANOUT).alias("parent")).agg(F.sha2(told, 256).alias("digest")).withColumnRenamed("parent", "node")))
    return out


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of which the digests aren't equal in both."""
    both = a.select(*keys, F.col("digest").alias("da")).join(b.select(*keys, F.col("digest").alias("db")), keys, "full")
    return both.filter(~F.col("da").eqNullSafe(F.col("db")))


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, offset, page_id, status, digest_a, digest_b) of every record of which the replicas disagree.

    ``a`` and ``b`` as from ``records`` or ``filed``. status: changed, missing (not in b) or extra (not in a).
    """
    levels = height(a, b)
    ta, tb = tree(a, levels), tree(b, levels)
    suspects = _differing(ta[-1], tb[-1], ["file", "node"]).select("file", "node")
    for la, lb in zip(ta[-2::-1], tb[-2::-1], strict=True):
        under = suspects.withColumnsRenamed({"node": "parent"})
        below = lambda level, u=under: level.withColumn("parent", F.floor(F.col("node") / FANOUT)).join(u, ["file", "parent"], "left_semi")
        suspects = cut(_differing(below(la), below(lb), ["file", "node"]).select("file", "node"))
    inside = lambda recs: recs.withColumn("node", F.floor(F.col("offset") / RANGE)).join(suspects, ["file", "node"], "left_semi")
    side = lambda recs, s: inside(recs).select("file", "offset", F.col("page_id").alias(f"page_{s}"), F.col("digest").alias(f"digest_{s}"))
    both = side(a, "a").join(side(b, "b"), ["file", "offset"], "full").filter(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
    status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("changed")
    return both.select("file", "offset", F.coalesce("page_a", "page_b").alias("page_id"), status.alias("status"), "digest_a", "digest_b")


def write_files(pages: DataFrame, path: str, pages_per_file: int = 1000, compression: str = "none") -> None:
    """``pages`` as WARC files below ``path``, a folder a file, records in order of offset."""
    text = pages.select(_file(pages_per_file), "page_id", F.when(F.col("page_id").isNull(), F.col("url")).alias("url"), record_text(F.col("url"), F.col("html")).alias("value"))
    order = ["file", "page_id", "url", "digest"]
    text = text.withColumn("digest", F.sha2("value", 256)).repartition("file").sortWithinPartitions(*order)
    # The writer ends each record with the line feed that is its last character.
    text.select("file", F.regexp_replace("value", r"\n\z", "").alias("value")).write.partitionBy("file").option("lineSep", "\n").option("compression", compression).text(path)


START, END = b"WARC/1.", b"\r\n\r\n"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")


def parse(record: bytes) -> tuple[str | None, bytes | None, str]:
    """(url, body, status) of a record's bytes; status is ok, or what is wrong with it."""
    head, found, rest = record.partition(END)
    if not VERSION.match(record) or not found:
        return None, None, "no header"
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    url = fields.get(b"warc-target-uri", b"").decode("utf-8", "replace")
    length = fields.get(b"content-length", b"")
    if not length.isdigit():
        return url, None, "no length"
    if int(length) + len(END) != len(rest):
        return url, rest, "wrong length"
    return url, rest[: int(length)], "ok"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, length, url, body, digest, status) of the records in the WARC files at ``path``.

    Records are told apart by an empty line before a version line; a body that holds both comes back in parts of status
    ``wrong length`` and ``no header``. Large plain files are split among tasks. Offsets are those of the uncompressed
    file, whose records pass through one task in order.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [b if b.startswith(START) else START + b for b in batch.column("value").to_pylist()]
            raw = [b if b.endswith(END) else b + END for b in raw]
            url, body, status = zip(*map(parse, raw), strict=True)
            columns = [pa.array([len(b) for b in raw], pa.int64()), pa.array(url, pa.string()), pa.array(body, pa.binary()), pa.array([hashlib.sha256(b).hexdigest() for b in raw]), pa.array(status)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "block", "at")), *columns], ["path", "block", "at", "length", "url", "body", "digest", "status"])

    text = spark.read.option("recursiveFileLookup", "true").option("lineSep", (END + START).decode()).text(path)
    pieces = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("value"))
    found = pieces.mapInArrow(of, "path string, block long, at long, length long, url string, body binary, digest string, status string")
    end = F.sum("length").over(W.partitionBy("path").orderBy("block", "at").rowsBetween(W.unboundedPreceding, 0))
    return found.withColumn("offset", end - F.col("length")).select("path", "offset", "length", "url", "body", "digest", "status")


def filed(read: DataFrame) -> DataFrame:
    """Records of ``read_files`` as ``audit`` takes them; files go by their name below a folder ``file=``."""
    file = F.regexp_extract("path", r"file=(-?\d+)/[^/]*$", 1).cast("long")
    return read.select(file.alias("file"), "offset", "length", F.lit(None).cast("long").alias("page_id"), "digest")
