"""HTML, dates, employment types and URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities that are undone, the ampersand last.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&amp;", "&")]


def html_to_text(html: Column) -> Column:
    """Text of a page, a line a piece: scripts, styles, comments and tags go, entities are undone."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "\n")
    for name, sign in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(sign))
    t = F.regexp_replace(t, r"[ \t\r\f\x0B]+", " ")
    return F.btrim(F.regexp_replace(t, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def commitment(c: Column) -> Column:
    """Employment type; an unknown one stays as it is."""
    t = F.lower(c)
    out = F.when(F.coalesce(c, F.lit("")) == "", "")
    for part, name in (("full", "full-time"), ("part", "part-time"), ("contract", "contract"), ("intern", "internship"), ("temp", "temporary")):
        out = out.when(t.contains(part), name)
    return out.otherwise(c)


def parse_date(c: Column) -> Column:
    """ISO times, dates alone, or milliseconds since 1970; null for anything else."""
    millis = F.when(c.rlike(r"^\d{11,14}$"), F.timestamp_millis(c.try_cast("long")))
    return F.coalesce(millis, F.try_to_timestamp(c))


def domain(url: Column) -> Column:
    """Host of a URL without ``www.``; null without one."""
    host = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*://)?(?:www\.)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def foreign_share(text: Column) -> Column:
    """Share in percent of bytes beyond one a character."""
    return (F.octet_length(text) - F.char_length(text)) * 100.0 / F.when(F.octet_length(text) > 0, F.octet_length(text))
