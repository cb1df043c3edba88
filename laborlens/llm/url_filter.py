"""URL rules by lookup of host-suffix and path-prefix expressions.

A URL is expanded into every host suffix at a label boundary times every path prefix of a length that some rule has.
Expressions meet rules on the first 32 bits of their digests; full digests confirm, and the longest rule wins (the
longer host, then blocking, where lengths tie). Each distinct host and path is judged once, and the pages of a frequent
one are spread over tasks. Only suffixes of as many labels as some rule's host has are made, so that a host of very
many labels costs no more than its length.

Defined results: a null URL or one without ``://`` has empty host and path, fits no rule and gets the default verdict;
repeated pages are judged alike; an empty rule table leaves everything to the default; of repeated rules, blocking
wins. Only page_id and url are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborlens.llm.common import LOWER, UPPER, cut, lookup

PREFIX_HEX = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/?#``, A-Z lower-cased; path: from there up to ``?#``."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.locate("://", u) > 0, u.substr(F.locate("://", u) + 3, F.length(u)))
    host = F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def expressions(host: Column, path: Column, lengths: list[int], labels_: int) -> Column:
    """All expressions of a URL as structs of host length and text, for rule hosts of up to so many labels and rule
    paths of the given lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.size(labels) - labels_ + 1, F.lit(1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(path))
    both = F.flatten(F.transform(suffixes, lambda s: F.transform(fits, lambda n: F.struct(F.length(s).alias("host_len"), F.concat(s, F.lit("\n"), path.substr(F.lit(1), n)).alias("text")))))
    return F.when(host != "", both).otherwise(F.array().cast("array<struct<host_len:int,text:string>>"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict. ``rules``: host, path, action."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    full = F.sha2(F.concat(F.translate("host", UPPER, LOWER), F.lit("\n"), "path"), 256)
    rules = rules.filter("host is not null and path is not null and action is not null").select(
        F.concat("host", "path").alias("rule"), "action", F.length("path").alias("path_len"), full.alias("r_full"), F.substring(full, 1, PREFIX_HEX).alias("short"), F.length(F.concat("host", "path")).alias("len"), F.size(F.split("host", r"\.")).alias("labels")
    )
    # No more lengths than the longest rule path has characters.
    lengths = sorted(r.path_len for r in rules.select("path_len").distinct().collect())
    labels = rules.agg(F.max("labels")).first()[0] or 1
    each = parsed.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    met = (
        each.select("host", "path", "n", F.explode(expressions(F.col("host"), F.col("path"), lengths, labels)).alias("e"))
        .withColumn("full", F.sha2("e.text", 256))
        .withColumn("short", F.substring("full", 1, PREFIX_HEX))
        .join(rules, "short")
        .filter("full = r_full")
        .groupBy("host", "path")
        .agg(F.max(F.struct("len", F.col("e.host_len").alias("host_len"), (F.col("action") == "block").alias("blocks"), "rule", "action")).alias("best"), F.first("n").alias("n"))
    )
    met = cut(met)
    total = met.agg(F.sum("n")).first()[0] or 0
    return lookup(parsed, met, ["host", "path"], total, "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )
