"""Ordered rule tables at size: regular expressions that texts meet by what they must contain, not pair by pair.

A rule table has a row a rule: scope, priority, pattern, and what the rule says (any other columns). ``indexed`` gives
each rule a set of literals of which every match of its pattern holds at least one, each under its rarest triple of
characters; a pattern of alternatives has a literal for each. Texts meet rules by equi-join on triples; only where the
whole literal stands in the text is the pattern tried, rule by rule, so that it is compiled once a rule and task. The
first rule in order of priority tells. Work follows the texts' triples and their survivors, not texts times rules.
"""

from __future__ import annotations

from re import _constants as sre
from re import _parser as sre_parse
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Characters by which texts and literals meet.
TRIPLE = 3


def required_literals(pattern: str) -> list[str] | None:
    """Lower-cased literals of which every match of ``pattern`` holds one; None if there is nothing that it must hold.

    >>> required_literals(r"(?:ml|machine learning)\\s+engineer")
    ['engineer']
    >>> sorted(required_literals("golang|rust"))
    ['golang', 'rust']
    """

    def better(a: list[str] | None, b: list[str] | None) -> list[str] | None:
        rate = lambda s: (min(map(len, s)), -len(s)) if s else (0, 0)
        return a if rate(a) >= rate(b) else b

    def of(items) -> list[str] | None:
        best, run = None, ""
        for kind, value in [*items, (sre.ANY, None)]:
            if kind is sre.LITERAL:
                run += chr(value).lower()
                continue
            if kind is sre.AT:
                continue
            best, run = better(best, [run] if run else None), ""
            if kind is sre.SUBPATTERN:
                best = better(best, of(value[3]))
            elif kind is sre.BRANCH:
                each = [of(x) for x in value[1]]
                best = better(best, None if None in each else sorted({y for x in each for y in x}))
            elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
                best = better(best, of(value[2]))
        return best

    return of(sre_parse.parse(pattern))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule file (CSV with a header: scope, priority, pattern, and what the rules say) as a table."""
    rules = spark.read.option("header", True).option("escape", '"').csv(path)
    return rules.withColumn("priority", F.col("priority").cast("int"))


def _runs(c: Column, n: int) -> Column:
    """Runs of ``n`` characters; a shorter text is one run."""
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(c) - n + 1, F.lit(1)))
    return F.transform(starts, lambda i: c.substr(i, F.lit(n)))


def indexed(rules: DataFrame) -> DataFrame:
    """``rules`` with a row for each required literal: literal, and the triple under which it is looked up.

    A literal of fewer characters than TRIPLE is looked up as a whole; a pattern that requires none meets all texts of
    its scope, so a table should have few of these.
    """
    schema = StructType([*rules.schema.fields, StructField("literals", ArrayType(StringType()))])

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [required_literals(p) or [""] for p in f["pattern"]]
            yield f.assign(literals=found)

    each = rules.mapInPandas(of, schema).withColumn("literal", F.explode("literals")).drop("literals")
    spots = each.select("scope", "priority", "literal", F.explode(_runs(F.col("literal"), TRIPLE)).alias("triple"))
    often = spots.groupBy("triple").agg(F.count(F.lit(1)).alias("often"))
    rarest = spots.join(often, "triple").groupBy("scope", "priority", "literal").agg(F.min(F.struct("often", "triple"))["triple"].alias("triple"))
    return each.join(rarest, ["scope", "priority", "literal"])


def matches(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """All (scope, text) of ``texts`` with all of ``rules`` (indexed) of that scope whose pattern is found in the text.

    Texts are compared in lower case; patterns are written in lower case.
    """
    each = texts.select("scope", "text").distinct().withColumn("low", F.lower("text"))
    keys = F.array_distinct(F.concat(F.array(F.lit("")), *(_runs(F.col("low"), n + 1) for n in range(TRIPLE))))
    spots = each.select("scope", "text", "low", F.explode(keys).alias("triple"))
    near = spots.join(rules, ["scope", "triple"]).filter(F.contains("low", "literal")).drop("triple", "literal").distinct()
    return near.sortWithinPartitions("pattern").filter("low rlike pattern").drop("low")


def first_match(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(scope, text) of ``texts`` with what the first of ``rules`` (indexed) by priority says; without those that none fits."""
    told = [c for c in rules.columns if c not in ("scope", "triple", "literal")]
    best = matches(texts, rules).groupBy("scope", "text").agg(F.min(F.struct("priority", *(c for c in told if c != "priority"))).alias("b"))
    return best.select("scope", "text", *(F.col("b")[c].alias(c) for c in told))


# Titles by legacy rules


#: What a title loses before rules are tried.
PLACE_TAIL = r"\s*[|–-]\s*(?:remote|hybrid|amer|emea|apac|latam|anz|us|usa|uk|eu|nordics|central|east|west|north|south)\b.*$"
SEASON = r"\s*\(?(?:summer|fall|winter|spring)?\s*(?:19|20)\d\d\)?|\(?\d+[- ]month[^)]*\)?"
BRACKETS = r"\s*\([^)]{0,30}\)"
#: Titles "X Manager" in which X is a field rather than a role.
FIELD_MANAGERS = [
    "product", "account", "engineering", "sales", "marketing", "project", "design", "operations", "data", "program", "general", "office", "partner", "community", "content", "finance", "brand", "growth",
]
#: Special forms in order: scope of the rules for what stands behind or before them, how it is found, and the title if
#: no rule fits.
FORMS = [
    ("manager", r"^manager\s*,\s*([^,]+)", "{} Manager"),
    ("head", r"\bhead of\s+([^,]+)", "Head of {}"),
    ("director", r"^(?:senior\s+)?director\s*(?:,|of)+\s*([^,(]+)", "Director of {}"),
    ("associate", r"^associate\s*,\s*([^,]+)", "{} Associate"),
]
MANAGED = r"^(.+?)[\s,.-]+managers?$"


def bare_title(title: Column) -> Column:
    """A title without place tails, seasons and short brackets, in lower case."""
    t = F.lower(F.translate(title, "‘’–—", "''--"))
    for pattern in (PLACE_TAIL, SEASON, BRACKETS):
        t = F.regexp_replace(t, pattern, "")
    return F.btrim(F.regexp_replace(t, r"\s+", " "), F.lit(" ,-|"))


def legacy_titles(raw: DataFrame, rules: DataFrame, levels) -> DataFrame:
    """(title, canonical, category, family, seniority, how) of distinct ``raw`` titles (title).

    ``rules`` (indexed): scope, priority, pattern, canonical, category, family. A title in a special form (Manager, X;
    Head of X; Director of X; Associate, X) is told by the rules of that scope for X, else named after X. Others are
    told by the rules of scope ``title``: "X Manager" by those for X, as its manager; then the part before the first
    comma; then the whole. What is left keeps its name, with the category of the first rule of scope ``category``.
    ``levels`` takes the level word out of a title: a function to (level, rest), as ``titles.strip_level``.
    """
    each = raw.select("title").distinct().withColumn("bare", bare_title(F.col("title")))
    level, rest = levels(F.col("bare"))
    each = each.select("title", level.alias("seniority"), rest.alias("rest"))
    form, x, named = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for scope, pattern, default in reversed(FORMS):
        part = F.trim(F.regexp_extract("rest", pattern, 1))
        hit = part != ""
        form, x = F.when(hit, scope).otherwise(form), F.when(hit, part).otherwise(x)
        front, back = default.split("{}")
        named = F.when(hit, F.concat(F.lit(front), F.initcap(part), F.lit(back))).otherwise(named)
    each = each.withColumns({"form": form, "x": x, "named": named})
    managed = F.regexp_extract("rest", MANAGED, 1)
    managed = F.when((managed != "") & ~managed.isin(FIELD_MANAGERS), managed)
    ask = lambda step, scope, text: F.struct(F.lit(step).alias("step"), F.lit(scope).alias("scope") if isinstance(scope, str) else scope.alias("scope"), text.alias("text"))
    free = F.array(ask(1, "title", managed), ask(2, "title", F.trim(F.substring_index("rest", ",", 1))), ask(3, "title", F.col("rest")), ask(4, "category", F.col("rest")))
    asked = each.select("title", "seniority", "rest", "named", F.explode(F.when(F.col("form").isNotNull(), F.array(ask(0, F.col("form"), F.col("x")))).otherwise(free)).alias("a"))
    asked = asked.select("title", "seniority", "rest", "named", "a.step", "a.scope", "a.text")
    told = first_match(asked.filter("text is not null"), rules)
    met = asked.join(told, ["scope", "text"], "left")
    said = F.when(F.col("canonical").isNotNull() | F.col("category").isNotNull(), F.struct("step", "canonical", "category", "family"))
    best = met.groupBy("title", "seniority", "rest", "named").agg(F.min(said).alias("b"))
    own = F.col("b.canonical")
    canonical = F.when((F.col("b.step") == 1) & ~F.lower(own).endswith("manager"), F.concat(own, F.lit(" Manager"))).otherwise(F.coalesce(own, "named", F.initcap("rest")))
    how = F.when(F.col("named").isNotNull(), F.when(own.isNotNull(), "form").otherwise("form by name")).otherwise(F.coalesce(F.get(F.array(*map(F.lit, ("", "manager of", "head", "whole", "keyword"))), F.col("b.step")), F.lit("none")))
    category = F.coalesce("b.category", F.when(F.col("named").isNotNull(), "Leadership").otherwise("Other"))
    return best.select("title", canonical.alias("canonical"), category.alias("category"), F.coalesce("b.family", category).alias("family"), "seniority", how.alias("how"))


def industries(companies: DataFrame, postings: DataFrame, rules: DataFrame, renamed: dict[str, str], intro_chars: int = 1200) -> DataFrame:
    """(id, industry, how) of ``companies`` (id, name, website, industry).

    ``rules`` (indexed; scope, priority, pattern, industry): those of scope ``name`` are tried on the name, then
    ``site`` on the host of the website, then ``intro`` on the beginning of the company's latest active posting
    (``postings``: company_id, text, posted_at, id). A company that no rule fits keeps its old industry under its present
    name (``renamed``: at most some dozens), if it has one, else it is Other.
    """
    last = postings.groupBy("company_id").agg(F.max_by(F.left("text", F.lit(intro_chars)), F.struct("posted_at", "id")).alias("intro"))
    intro = F.regexp_replace(F.regexp_replace("intro", "<[^>]+>", " "), r"\s+", " ")
    host = F.regexp_extract(F.lower("website"), r"^(?:https?://)?(?:www\.)?([^/?#]+)", 1)
    each = companies.join(last, F.col("id") == F.col("company_id"), "left").select("id", "industry", F.col("name").alias("n"), host.alias("s"), intro.alias("i"))
    ways = F.array(*(F.struct(F.lit(k).alias("step"), F.lit(scope).alias("scope"), F.col(c).alias("text")) for k, (scope, c) in enumerate((("name", "n"), ("site", "s"), ("intro", "i")))))
    asked = each.select("id", F.explode(ways).alias("w")).select("id", "w.*").filter("text <> ''")
    told = first_match(asked, rules).select("scope", "text", F.col("industry").alias("told"))
    best = asked.join(told, ["scope", "text"]).groupBy("id").agg(F.min(F.struct("step", "told", "scope")).alias("b"))
    old = F.coalesce(F.create_map(*(F.lit(x) for p in renamed.items() for x in p))[F.col("industry")], F.col("industry")) if renamed else F.col("industry")
    return each.join(best, "id", "left").select("id", F.coalesce("b.told", old, F.lit("Other")).alias("industry"), F.coalesce("b.scope", F.when(old.isNotNull(), "kept").otherwise("none")).alias("how"))
