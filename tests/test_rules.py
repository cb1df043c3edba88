"""Ordered rule tables: what patterns require, titles and industries typed by hand, plans without nested loops."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from laborlens import catalog_rules as c
from laborlens.functions import titles
from laborlens.operators import rules


@pytest.mark.parametrize(
    ("pattern", "literals"),
    [(r"data (?:engineer|scientist)", ["engineer", "scientist"]), ("golang|rust", ["golang", "rust"]), (r"\bml\b", ["ml"]), ("[0-9]+", [""]), (r"a?(?:node\.?js)+", ["node"]), ("(?:x|yy)z{2,}", ["z"])],
)
def test_required_literals(pattern, literals):
    found = rules.required_literals(pattern) or [""]
    assert sorted(found) == literals


def test_every_match_holds_a_required_literal():
    texts = [" ".join(random.Random(i).choices("data ml engineer developer back-end full stack manager machine learning ios".split(), k=4)) for i in range(300)]
    for _, _, pattern, *_ in c.TITLE_RULES:
        literals = rules.required_literals(pattern)
        assert all(any(x in t for x in literals) for t in texts if re.search(pattern, t))


def test_first_rule_in_order_tells(spark, tmp_path):
    (tmp_path / "rules.csv").write_text('scope,priority,pattern,label\nt,2,"data",broad\nt,1,"data (?:engineer|scientist)",narrow\nu,0,"data",elsewhere\nt,9,"[^ -~]",foreign\nt,3,"ml",short\n')
    table = rules.indexed(rules.read_rules(spark, str(tmp_path / "rules.csv")))
    texts = spark.createDataFrame([("t", "Data Engineer"), ("t", "Big DATA"), ("t", "Élève"), ("t", "ml"), ("t", ""), ("t", None), ("t", "x"), ("t", "Big DATA")], "scope string, text string")
    assert {r.text: (r.priority, r.label) for r in rules.first_match(texts, table).collect()} == {"Data Engineer": (1, "narrow"), "Big DATA": (2, "broad"), "Élève": (9, "foreign"), "ml": (3, "short")}
    plan = rules.first_match(texts, table)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_legacy_titles_by_hand(spark):
    want = {
        "Senior Machine Learning Engineer": ("Machine Learning Engineer", "Engineering", "Software", "senior", "head"),
        "Golang Developer": ("Golang Developer", "Engineering", "Engineering", None, "keyword"),
        "Manager, Sales Development": ("Sales Development Manager", "Sales", "Sales", None, "form"),
        "Head of Content Marketing, AMER": ("Head of Content Marketing", "Marketing", "Marketing", None, "form"),
        "Head of Beekeeping": ("Head of Beekeeping", "Leadership", "Leadership", None, "form by name"),
        "Director, Tax (Berlin)": ("Director of Tax", "Finance", "Finance", None, "form"),
        "Associate, Supply Chain": ("Supply Chain Associate", "Operations", "Operations", None, "form"),
        "Full Stack Developer Manager": ("Full Stack Engineer Manager", "Engineering", "Software", None, "manager of"),
        "Product Manager": ("Product Manager", "Product", "Product", None, "head"),
        "Threat Detection Researcher (Windows/Linux)": ("Threat Detection Researcher", "Other", "Other", None, "none"),
        "Backend Developer (Summer 2026)": ("Backend Engineer", "Engineering", "Software", None, "head"),
        "Payments, Data Scientist | Germany": ("Data Scientist", "Engineering", "Software", None, "whole"),
    }
    raw = spark.createDataFrame([(t,) for t in [*want, "Product Manager"]], "title string")
    found = rules.legacy_titles(raw, rules.indexed(spark.createDataFrame(c.TITLE_RULES, c.TITLE_RULE)), titles.strip_level)
    assert {r.title: (r.canonical, r.category, r.family, r.seniority, r.how) for r in found.collect()} == want


def test_industries_by_hand(spark):
    companies = spark.createDataFrame(
        [(1, "Acme Therapeutics", "https://acme.com", None), (2, "Acme", "http://www.acme.ai/x", "BUILDING"), (3, "Acme", None, "BUILDING"), (4, "Acme", "acme.com", "BUILDING"), (5, None, None, None), (6, "Gridlock", None, "Retail")],
        "id long, name string, website string, industry string",
    )
    postings = spark.createDataFrame([(3, "<b>We run</b> clinical\ntrials", "2024-01-02", 1), (3, "Our payments platform", "2024-01-01", 2), (4, "x" * 1300 + "payments platform", "2024-01-01", 3)], "company_id long, text string, posted_at string, id long")
    found = rules.industries(companies, postings, rules.indexed(spark.createDataFrame(c.SECTOR_RULES, c.SECTOR_RULE)), c.RENAMED)
    assert {r.id: (r.industry, r.how) for r in found.collect()} == {1: ("Biotech & Pharma", "name"), 2: ("AI", "site"), 3: ("Biotech & Pharma", "intro"), 4: ("Construction", "kept"), 5: ("Other", "none"), 6: ("Retail", "kept")}


def test_rules_over_many_titles_stay_joined_by_keys(spark):
    raw = spark.range(2000).select(F.concat(F.lit("Backend Engineer "), F.col("id").cast("string")).alias("title"))
    plan = rules.legacy_titles(raw, rules.indexed(spark.createDataFrame(c.TITLE_RULES, c.TITLE_RULE)), titles.strip_level)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and len(c.TITLE_RULES) > 300
