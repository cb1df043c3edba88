"""Predicates over postings: role, seniority bucket, place, industry, company."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborlens.functions.places import US_STATES
from laborlens.star import Star

#: Words for a level that each bucket takes in.
SENIORITY = {
    "entry": ["entry", "junior", "associate", "i", "1", "intern"],
    "mid": ["mid", "middle", "ii", "2", "intermediate"],
    "senior": ["senior", "sr", "iii", "3"],
    "lead": ["lead", "principal", "staff", "director", "head", "iv", "4", "5"],
}


def is_all(value: str | Sequence[str] | None) -> bool:
    """No value, ``all`` in any case, or a list of nothing or with ``all`` in it: no filter."""
    if value is None or isinstance(value, str):
        return not value or value.lower() == "all"
    return not value or any(v.lower() == "all" for v in value)


def seniority(level: str | None, bucket_words: dict[str, list[str]] | None = None) -> Column:
    if is_all(level):
        return F.lit(True)
    words = (bucket_words or SENIORITY).get(level, [level])
    return F.coalesce(F.lower("seniority_level").isin([w.lower() for w in words]), F.lit(False))


#: Codes and names of provinces, and words for two more countries.
PROVINCES = {
    "ON": "Ontario", "QC": "Quebec", "BC": "British Columbia", "AB": "Alberta", "MB": "Manitoba", "SK": "Saskatchewan", "NS": "Nova Scotia", "NB": "New Brunswick", "NL": "Newfoundland and Labrador", "PE": "Prince Edward Island",
    "NT": "Northwest Territories", "YT": "Yukon", "NU": "Nunavut",
}
UK_WORDS = ["uk", "u.k.", "england", "scotland", "wales", "gbr", "great britain"]
INDIA_WORDS = ["ind", "india", "karnataka", "telangana", "maharashtra", "bengaluru", "bangalore", "hyderabad", "mumbai", "pune", "delhi"]


def _any(tests: list[Column]) -> Column:
    return F.coalesce(reduce(Column.__or__, tests), F.lit(False)) if tests else F.lit(False)


def place(locations: Sequence[str] | None, aliases: dict[str, str] | None = None, states: dict[str, str] | None = None, cities: Sequence[str] = ()) -> Column:
    """postings in any of the places: the country is the place or one of its ``aliases`` (alias: country), or holds
    it, or the raw location holds it; any case. Codes of states and provinces count for the United States and Canada at
    the country's start or end, before or after a blank, semicolon, bar or dash, as do their names (``states``: code to
    name); words for the United Kingdom and India likewise; ``cities`` of the United States in the raw location."""
    if is_all(locations):
        return F.lit(True)
    country, raw = F.lower("location_country"), F.lower("location_raw")
    tests = []
    for asked in (x for x in locations if x.lower() != "all"):
        names = [asked, *(a for a, c in (aliases or {}).items() if c == asked)]
        tests += [_any([country.contains(n.lower()) for n in names]), F.coalesce(raw.contains(asked.lower()), F.lit(False))]
        codes, named, edges = [], [], ""
        if asked == "United States":
            codes, named, edges = US_STATES, list((states or {}).values()), r"(?:{0}|{0}[ ;|-].*|.* {0})"
            tests.append(_any([raw.contains(c.lower()) for c in cities]))
        elif asked == "Canada":
            codes, named, edges = list(PROVINCES), list(PROVINCES.values()), r"(?:{0}|{0}[; ].*)"
        elif asked == "United Kingdom":
            tests.append(_any([country.contains(w) for w in UK_WORDS]))
        elif asked == "India":
            codes, edges = INDIA_WORDS, r"(?:{0}|{0}[; ].*)"
        if codes:
            any_code = "(?:" + "|".join(c.lower() for c in codes) + ")"
            tests.append(F.coalesce(country.rlike("(?s)^" + edges.format(any_code) + "$"), F.lit(False)))
            tests.append(F.coalesce(country.isin([n.lower() for n in named]), F.lit(False)))
    return _any(tests) if tests else F.lit(True)


def near_or_remote(location: str | None) -> Column:
    """Raw location holding the words, or remote; whole countries and 'remote' itself don't narrow."""
    if is_all(location) or location.lower() in ("united states", "remote", "global"):
        return F.lit(True)
    return F.col("location_is_remote") | F.coalesce(F.lower("location_raw").contains(location.lower()), F.lit(False))


def by_industry(jobs: DataFrame, star: Star, industries: Sequence[str] | None) -> DataFrame:
    """Postings of active companies in the industries; no such company, no postings."""
    if is_all(industries):
        return jobs
    chosen = star.companies.filter(F.col("is_active") & F.col("industry").isin(list(industries)))
    return jobs.join(chosen.select(F.col("id").alias("company_id")), "company_id", "left_semi")


def by_company(jobs: DataFrame, company_ids: Sequence[int] | None) -> DataFrame:
    return jobs.filter(F.col("company_id").isin(list(company_ids))) if company_ids else jobs


def active(star: Star) -> DataFrame:
    """Active postings that have a role."""
    return star.jobs.filter("is_active and role_id is not null")


def with_ai(star: Star, subcategory: str) -> DataFrame:
    """Ids of postings with a verified skill of the AI subcategory, once each."""
    skills = star.skills.filter(F.col("is_verified") & (F.col("subcategory") == subcategory)).select(F.col("id").alias("skill_id"))
    return star.job_skills.join(skills, "skill_id", "left_semi").select("job_id").distinct()


def titles_holding(names: DataFrame, roles: DataFrame, least: int = 3) -> DataFrame:
    """(name, role_id) wherever a role's title holds a name, by the first three characters of each; shorter names, of
    which there are few, are held against every title."""
    from laborlens.operators.enrich import holding

    titles = roles.select(F.col("normalized_title").alias("name"), F.col("id").alias("role_id"))
    long = holding(titles, names.select(F.col("name").alias("part")), least).join(titles, "name").select(F.col("part").alias("name"), "role_id")
    short = names.select(F.col("name").alias("part")).distinct().filter(F.char_length("part") < least).join(titles, F.lower("name").contains(F.lower("part")))
    return long.unionByName(short.select(F.col("part").alias("name"), "role_id")).distinct()


def find_role(names: DataFrame, roles: DataFrame, variations: DataFrame) -> DataFrame:
    """(name, role_id, how) for ``names`` (name): equal title, else a known variation, else a title that holds the name.

    ``variations``: original_title, role_id. Substrings are only tried for names that nothing equals.
    """
    key = F.lower("name")
    asked = names.select("name").distinct()
    exact = asked.join(roles, key == F.lower("normalized_title")).select("name", F.col("id").alias("role_id"), F.lit(1).alias("p"))
    known = asked.join(variations, key == F.lower("original_title")).select("name", "role_id", F.lit(2).alias("p"))
    equal = exact.unionByName(known)
    rest = asked.join(equal.select("name").distinct(), "name", "left_anti")
    parts = titles_holding(rest, roles).withColumn("p", F.lit(3))
    best = equal.unionByName(parts).groupBy("name").agg(F.min(F.struct("p", "role_id")).alias("b"))
    how = F.element_at(F.array(F.lit("title"), F.lit("variation"), F.lit("substring")), F.col("b.p"))
    return best.select("name", F.col("b.role_id").alias("role_id"), how.alias("how"))


def suggest_roles(names: DataFrame, roles: DataFrame, volumes: DataFrame, k: int = 5) -> DataFrame:
    """(name, role_id, rank): up to ``k`` roles whose title holds the name; if there is none, the busiest.

    ``volumes``: role_id, n.
    """
    from laborlens.functions.numbers import top

    asked = names.select("name").distinct()
    ranked = roles.select(F.col("id").alias("role_id"), "normalized_title").join(volumes, "role_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    hits = titles_holding(asked, roles).join(ranked, "role_id")
    hits = top(hits, k, [F.desc("n"), F.asc("role_id")], ["name"])
    busiest = ranked.orderBy(F.desc("n"), F.asc("role_id")).limit(k)
    others = top(asked.join(hits.select("name").distinct(), "name", "left_anti").join(busiest), k, [F.desc("n"), F.asc("role_id")], ["name"])
    return hits.unionByName(others).select("name", "role_id", "rank")


def search(jobs: DataFrame, words: str, location: str | None, k: int = 50) -> DataFrame:
    """Active postings whose title holds the words, newest first."""
    hits = jobs.filter(F.col("is_active") & F.lower("title").contains(words.lower()) & near_or_remote(location))
    return hits.orderBy(F.col("posted_at").desc_nulls_last(), "id").limit(k)
