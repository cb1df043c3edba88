"""Text and number expressions on golden rows."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from laborlens.functions import markup, numbers, places, titles


def values(spark, expression, rows, kind="string"):
    table = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in table.select(expression(F.col("v")).alias("r"), "i").orderBy("i").select("r").collect()]


def test_seniority(spark):
    cases = {
        "Software Engineering Intern": "intern", "VP of Principal Engineering": "director", "CTO": "director", "Principal Engineer": "principal", "Sr. Staff Engineer": "senior-staff", "Staff Nurse": "staff", "Sr Developer": "senior",
        "Engineer III": "senior", "Engineer 3": "senior", "Tech Lead": "lead", "Analyst II": "mid", "New Grad Engineer": "entry", "Engineer I": "entry", "Jr. Designer": "junior", "Sales Associate": "associate", "Engineer": "mid", "": "mid",
    }
    assert values(spark, titles.seniority, cases) == list(cases.values())
    assert values(spark, titles.seniority, [None]) == ["mid"]


def test_titles_lose_their_tails(spark):
    cases = {
        "Software Engineer (Remote) (Contract)": "software engineer", "Data Analyst II": "data analyst", "Account Executive - EMEA": "account executive", "Lead Game Designer - Monopoly GO!": "lead game designer", "Customer Success": "customer success",
        "Engineer, Remote - US": "engineer", "  Product  Manager – London ": "product manager",
    }
    assert values(spark, titles.delevel, cases) == list(cases.values())


def test_level_words_are_stripped(spark):
    rows = ["Senior Engineer", "Tech Lead, Payments", "Lead Engineer", "Staff Senior Writer", "Writer"]
    assert values(spark, lambda c: titles.strip_level(c)[0], rows) == ["senior", None, "lead", "staff", None]
    assert values(spark, lambda c: titles.strip_level(c)[1], rows) == ["engineer", "tech lead, payments", "engineer", "senior writer", "writer"]


def test_noise_titles(spark):
    rows = ["Engineer", "x", "General Application", "工程师工程师", "a" * 121, "Join our Talent Pool", "Don’t see a role"]
    assert values(spark, titles.is_noise, rows) == [False, True, True, True, True, True, False]
    assert values(spark, titles.is_skipped, rows) == [False, False, True, False, False, True, True]
    assert values(spark, titles.slug, ["Senior C++ Engineer / Remote"]) == ["senior-c-engineer-remote"]


def test_places(spark):
    cases = {
        "Remote - US": ("", "", "US", True), "Remote, Canada": ("", "", "Canada", True), "Anywhere": ("", "", "", True), "San Francisco, CA": ("San Francisco", "CA", "US", False), "Paris, France": ("Paris", "", "France", False),
        "Toronto, ON, Canada": ("Toronto", "ON", "Canada", False), "Berlin": ("Berlin", "", "", False), "": ("", "", "", False),
    }
    assert [tuple(r) for r in values(spark, places.parse, cases)] == list(cases.values())


def test_markup(spark):
    html = "<div><h1>Title</h1><script>x < y</script><p>One&nbsp;&amp;lt; two</p>\n\n<!-- no --><p> three</p></div>"
    assert values(spark, markup.html_to_text, [html]) == ["Title\nOne &lt; two\nthree"]
    assert values(spark, markup.commitment, ["Full-time", "PART time", "", None, "Contractor", "Volunteer"]) == ["full-time", "part-time", "", "", "contract", "Volunteer"]
    assert values(spark, markup.parse_date, ["2024-05-01", "1714521600000", "soon", None]) == [datetime(2024, 5, 1), datetime(2024, 5, 1), None, None]
    assert values(spark, markup.domain, ["https://www.Example.com/x", "example.org", "", None]) == ["example.com", "example.org", None, None]
    assert values(spark, markup.foreign_share, ["ab", "éé", ""]) == [0.0, 50.0, None]


def test_growth_rules(spark):
    rows = [(0, 0), (5, 0), (0, 4), (5, 4), (None, 4)]
    got = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a int, b int").select("i", numbers.growth_pct(F.col("a"), F.col("b")).alias("g")).orderBy("i").collect()
    assert [r.g for r in got] == [None, 100.0, -100.0, 25.0, None]


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_nearest_rank(spark, n):
    values_ = [(i * 7) % 11 for i in range(n)]
    got = numbers.nearest_rank(spark.createDataFrame([("k", v) for v in values_] + [("k", None)], "k string, v int"), ["k"], "v", {"a": 0.25, "b": 0.5, "c": 1.0}).first()
    at = lambda p: sorted(values_)[min(int(n * p), n - 1)]
    assert (got.a, got.b, got.c) == (at(0.25), at(0.5), at(1.0))


def test_months():
    assert numbers.first_of_month(date(2001, 1, 31), 3) == date(2000, 10, 1)
    assert numbers.first_of_month(date(2001, 7, 15)) == date(2001, 7, 1)
