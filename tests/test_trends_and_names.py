"""Sweeps against counting month by month, filters on trends, names by matching blocks, sections and tries of terms."""

from __future__ import annotations

import difflib
import itertools
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from laborlens.catalog_demand import P
from laborlens.functions.skills import display_name
from laborlens.operators import enrich, people, sketches, trends
from laborlens.star import from_tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("months", [4, 60])
def test_sweep_counts_as_month_by_month(spark, months):
    star, p = from_tables(spark, SF), replace(P, months=months, min_cohort=1)
    rows = trends.monthly(star, p).filter("role_id is not null")
    want = {(r.role_id, r.month): (r.stock, r.flow) for r in rows.groupBy("role_id", "month").agg(F.count(F.lit(1)).alias("stock"), F.count_if(trends.job_date() >= F.col("start")).alias("flow")).collect()}
    found = trends.stock_and_flow(star, p).collect()
    assert {(r.role_id, r.month): (r.stock, r.flow) for r in found if r.stock} == want
    assert len(found) == months * len({r.role_id for r in found})
    skills = trends.monthly(star, p).join(star.job_skills, F.col("id") == F.col("job_id")).groupBy("skill_id", "month").count()
    assert {(r.skill_id, r.month): r["count"] for r in trends.skill_months(star, p).collect()} == {(r.skill_id, r.month): r["count"] for r in skills.collect()}


def test_chosen_companies_outside_the_cohort_give_bars_of_zero(spark):
    star, p = from_tables(spark, SF), replace(P, min_cohort=1)
    late = star.jobs.join(trends.tracked_companies(star, p), "company_id", "left_anti")
    chosen = trends.role_trend(star, p, late.limit(0).unionByName(star.jobs.filter("company_id = -1")))
    whole = trends.role_trend(star, p)
    assert chosen.count() == whole.count() and chosen.filter("count > 0 or ai_count > 0").count() == 0
    seniors = star.jobs.filter("seniority_level = 'senior'")
    by_hand = trends.role_trend(replace(star, jobs=star.jobs.withColumn("role_id", F.when(F.col("seniority_level") == "senior", F.col("role_id")))), replace(p, min_cohort=0))
    counts = lambda df: {(r.role_id, r.month): r["count"] for r in df.filter("count > 0").collect()}
    assert counts(trends.role_trend(star, p, seniors)) == counts(by_hand)


def test_matching_blocks_like_brute_force(spark):
    r = random.Random(5)
    base = ["".join(r.choices("abcde ", k=r.randint(4, 25))) for _ in range(60)]
    names = {*base, *(b[: len(b) // 2] + "x" + b[len(b) // 2 :] for b in base), *(b[2:] + b[:2] for b in base), "ABCDE abcde", "abcde ABCDE", "", "é"}
    for least in (0.75, 0.88):
        want = {}
        for a, b in itertools.combinations(sorted(names), 2):
            ratio = difflib.SequenceMatcher(None, a.lower(), b.lower(), autojunk=False).ratio()
            if ratio >= least and abs(len(a) - len(b)) <= 20:
                want[a, b] = round(ratio, 4)
        found = enrich.similar_names(spark.createDataFrame([(n,) for n in names], "name string"), least, measure="blocks").collect()
        assert {(x.a, x.b): x.ratio for x in found} == want and len(want) > 30


def test_terms_of_many_words_and_signs(spark):
    terms = spark.createDataFrame([("machine learning", 1), ("machine learning engineer in the loop", 2), ("machine", 3), ("c++", 4), ("c", 5), ("node.js", 6), ("learning", 1), ("!!", 7)], "term string, skill_id long")
    docs = spark.createDataFrame([(1, "Machine learning, machine-learning engineer in the loop; C++ and node.js"), (2, "machine machine learning engineer in the pool c"), (3, None), (4, "")], "id long, text string")
    want = {(1, 1): 4, (1, 2): 1, (1, 3): 2, (1, 4): 1, (1, 5): 1, (1, 6): 1, (2, 1): 2, (2, 3): 2, (2, 5): 1}
    assert {(r.id, r.skill_id): r.n for r in enrich.tag_skills(docs, terms).collect()} == want
    assert enrich.tag_skills(docs, terms.filter("skill_id = 7")).count() == 0


def test_sections_have_places(spark):
    text = "Intro\n\nHere’s what you'll do:\nBuild.\n\n**Requirements**\n- Python\nNice to have (bonus)\n- Rust\n" + "Requirements of our clients that we read every day and never forget to tell you about"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "no header")], "id long, text string")
    rows = enrich.sections(docs).orderBy("id", "n").collect()
    assert [(r.id, r.name) for r in rows] == [(1, "unknown"), (1, "responsibilities"), (1, "requirements"), (1, "preferred"), (4, "unknown")]
    straight = text.replace("’", "'")
    assert all(r.body == straight[r.start : r.stop] for r in rows if r.id == 1)


def test_names_and_kinds_by_hand(spark):
    shown = {"pytorch": "PyTorch", "ios": "iOS", ".net": ".NET", "c++": "C++", "power bi": "Power BI", "docker": "Docker", "ci/cd": "CI/CD", "scikit-learn": "scikit-learn", "aws lambda": "AWS Lambda", "state of the art": "State of the Art", "RUST": "Rust", "go-to-market": "Go-to-Market"}
    got = spark.createDataFrame([(n,) for n in shown], "name string").select("name", display_name(F.col("name")).alias("shown")).collect()
    assert {r.name: r.shown for r in got} == shown
    kinds = {"Kafka Streams": "technical", "Terraform": "technical", "Restaurants": "technical", "Stakeholder Management": "soft", "Problem solving": "soft", "Phoenix db": "technical", "Erlang": "technical", "Machine Learning": "domain", "Security": "domain", "Presentation": "domain", "": "domain"}
    got = spark.createDataFrame([(n,) for n in kinds], "name string").select("name", enrich.candidate_kind(F.col("name")).alias("kind")).collect()
    assert {r.name: r.kind for r in got} == kinds


def test_gaps_under_filters_that_leave_nothing(spark):
    star = from_tables(spark, SF)
    few = replace(star, jobs=star.jobs.filter("role_id <> 3 or seniority_level = 'mid'").filter("role_id <> 4 or not location_is_remote"))
    assert {r.role_id: r.ignored for r in people.gap_failures(few, "senior", "Atlantis").filter("role_id in (3, 4)").collect()} == {3: "senior level and Atlantis", 4: "Atlantis"}  # no remote posting of role 3 either
    assert people.gap_failures(few, None, "Remote").count() == 0
    told = {r.role_id for r in people.skill_gap(few, True, "senior", "Atlantis").select("role_id").distinct().collect()}
    assert told and not told & {3, 4}


def test_sketches_merge_within_their_error(spark):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("part"), (F.col("id") % 3).alias("group"), (F.col("id") * 7919 % 30_011).alias("value"))
    fine = sketches.sketched(rows, ["part", "group"], "value")
    told = {r["group"]: r.n for r in sketches.estimated(sketches.rolled_up(fine, ["group"]), "n").collect()}
    exact = {r["group"]: r.n for r in rows.groupBy("group").agg(F.count_distinct("value").alias("n")).collect()}
    assert told.keys() == exact.keys() and all(abs(told[k] - exact[k]) <= 0.08 * exact[k] for k in exact)
    nothing = sketches.estimated(sketches.sketched(rows.select("part", F.lit(None).cast("long").alias("value")), ["part"], "value"), "n")
    assert {r.n for r in nothing.collect()} == {0}


def test_mapped_candidates_read_their_titles_once(spark, tmp_path):
    rows = [("Data Engineer",), ("data engineer (Remote)",), ("Lead data engineers",), ("Big data office",), ("Intern",), ("abc",), ("Nothing here",), (None,), ("Machine Learnings",), ("Head of Pay Desk",), ("A pay desk B",)]
    spark.createDataFrame(rows, "title string").write.parquet(f"{tmp_path}/t")
    roles = spark.createDataFrame([(1, "Data Engineer"), (2, "Machine Learning"), (3, "Pay Desk")], "id long, normalized_title string")
    explicit = spark.createDataFrame([("data off", 7), ("off", 8)], "pattern string, role_id long")
    found = enrich.mapped_candidates(spark.read.parquet(f"{tmp_path}/t"), roles, explicit)
    assert {r.title: (r.verdict, r.role_id, r.how) for r in found.collect()} == {
        "Data Engineer": ("mapped", 1, "equal"), "data engineer (Remote)": ("mapped", 1, "equal"), "Lead data engineers": ("mapped", 1, "substring"), "Big data office": ("mapped", 7, "explicit"), "Intern": ("rejected", None, None), "abc": ("rejected", None, None),
        "Nothing here": ("unmapped", None, None), None: ("unmapped", None, None), "Machine Learnings": ("mapped", 2, "prefix"), "Head of Pay Desk": ("unmapped", None, None), "A pay desk B": ("unmapped", None, None),
    }
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [title") == 1


def test_names_without_a_common_triple_are_found_if_so_little_is_asked(spark):
    found = lambda names, least, measure: [tuple(r) for r in enrich.similar_names(spark.createDataFrame([(n,) for n in names], "name string"), least, measure=measure).collect()]
    assert found(["abcdef", "1a2b3c4d5e6f"], 0.6, "blocks") == [("1a2b3c4d5e6f", "abcdef", 0.6667)]
    assert found(["xbcxexgh", "abcdefgi"], 0.5, "edits") == [("abcdefgi", "xbcxexgh", 0.5)]
    r = random.Random(6)
    names = {"".join(r.choices("abcd", k=r.randint(1, 9))) for _ in range(150)}
    for least in (0.5, 0.7, 0.88):
        want = {(a, b) for a, b in itertools.combinations(sorted(names), 2) if difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= least}
        assert {(a, b) for a, b, _ in found(names, least, "blocks")} == want
