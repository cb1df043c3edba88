"""Posting sources, sinks and streams end to end."""

from __future__ import annotations

import json
import random
from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from laborlens.operators import enrich, filters, maintain
from laborlens.sources import postings, tables
from laborlens.streaming import jobs


def write(path, rows) -> str:
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def test_four_sources_come_to_one_record(spark, tmp_path):
    paths = {
        "greenhouse": write(tmp_path / "g.json", [{"id": 1, "title": "Senior Engineer", "location": {"name": "Austin, TX"}, "departments": [{"name": "R&D"}, {"name": "Other"}], "content": "<p>Hi</p>", "updated_at": "2024-01-02T00:00:00Z", "absolute_url": "u"}, {"id": 2, "title": "Clerk"}]),
        "lever": write(tmp_path / "l.json", [{"id": "a", "text": "Designer", "categories": {"location": "Remote - UK", "team": "T", "commitment": "Full Time"}, "createdAt": 1704153600000, "descriptionPlain": "Intro", "lists": [{"text": "Need", "content": "<li>x</li>"}, {"text": "", "content": ""}]}]),
        "ashby": write(tmp_path / "a.json", [{"id": "z", "slug": "acme", "title": "VP Sales", "location": "", "locationName": "Paris, France", "team": "Sales", "employmentType": "Contract", "descriptionPlain": "Plain text", "publishedAt": "2024-01-02"}]),
        "workable": write(tmp_path / "w.json", [{"id": "9", "shortcode": "S9", "title": "Writer", "location": "Berlin", "remote": True, "url": "w", "worktype": "part_time", "description": "<b>d</b>", "created_on": "x", "published_on": "2024-01-02"}]),
    }
    got = {(r.source_ats, r.source_job_id): r for r in postings.read_postings(spark, paths).collect()}
    g, l, a, w = got["greenhouse", "1"], got["lever", "a"], got["ashby", "z"], got["workable", "S9"]
    assert (g.location_city, g.location_state, g.location_country, g.department, g.seniority_level, g.description_text) == ("Austin", "TX", "US", "R&D", "senior", "Hi")
    assert got["greenhouse", "2"].location_city is None and got["greenhouse", "2"].department == ""
    assert l.description == "<p>Intro</p>\n<h3>Need</h3>\n<li>x</li>" and l.employment_type == "full-time" and (l.location_country, l.location_is_remote) == ("UK", True)
    assert (a.location_city, a.department, a.description, a.description_text, a.source_url, a.seniority_level) == ("Paris", "Sales", "<p>Plain text</p>", "Plain text", "https://jobs.ashbyhq.com/acme/z", "director")
    assert w.location_is_remote and w.employment_type == "part-time"
    assert {r.posted_at for r in (g, l, a, w)} == {datetime(2024, 1, 2)}


def test_taxonomy_leaves(spark):
    rows = [("Tech", [("Web", [("Django", "1"), (" django ", "2"), ("React", "3"), ("", "4"), ("x" * 101, "5")]), ("Old", [("Cobol", "6")])]), ("Skip", [("S", [("Z", "7")])])]
    taxonomy = spark.createDataFrame(rows, tables.TAXONOMY)
    known = spark.createDataFrame([("REACT",)], "name string")
    got = tables.new_skills(taxonomy, known, skip_categories=["Skip"], skip_pairs=[("Tech", "Old")]).collect()
    assert [(r.name, r.subcategory) for r in got] == [("Django", "Web")]


def test_boards_are_rewritten_by_week(spark, tmp_path):
    path = str(tmp_path / "boards")
    rows = lambda day, label: spark.createDataFrame([("rising_role", "overall", 1, label, 5.0, day)], tables.BOARD + ", week_start date")
    for day, label in ((date(2024, 1, 1), "a"), (date(2024, 1, 8), "b"), (date(2024, 1, 8), "c")):
        tables.write_boards(rows(day, label), path)
    kept = spark.read.parquet(path)
    assert {(r.week_start, r.label) for r in kept.collect()} == {(date(2024, 1, 1), "a"), (date(2024, 1, 8), "c")}
    assert json.loads(tables.latest_boards(kept, "overall").first().entries) == [{"rank": 1, "label": "c", "growth": 5.0}]
    assert [r.scope for r in tables.scopes(kept).collect()] == ["overall"]


def test_decisions_and_candidates(spark, tmp_path):
    (tmp_path / "d.csv").write_text("raw_title,action,role_title\nDev,map,Engineer\n")
    (tmp_path / "d.json").write_text(json.dumps({"decisions": [{"raw_title": "Dev", "action": "map", "role_title": "Engineer"}]}))
    assert tables.decisions(spark, str(tmp_path / "d.csv")).collect() == tables.decisions(spark, str(tmp_path / "d.json")).collect()
    tables.write_candidates(spark.createDataFrame([("a", 1, 2), ("b", 3, 2), ("c", 1, 9)], "name string, job_count int, company_count int"), str(tmp_path / "c"))
    assert {r.name for r in spark.read.json(str(tmp_path / "c")).collect()} == {"a", "b", "c"}


POSTING = "source_ats string, source_job_id string, company_id long, title string, location_raw string, department string, description string, posted_at timestamp, seen_at timestamp"
STATE = "source_ats string, source_job_id string, company_id long, title string, location_raw string, department string, description string, posted_at timestamp, scraped_at timestamp, last_seen_at timestamp, closed_at timestamp, is_active boolean, skills_dirty boolean"


def posting(job, day, description="d", company=1):
    at = datetime(2024, 1, day)
    return ("g", job, company, "t", "l", "x", description, at, at)


@pytest.mark.parametrize("fold_every", [2, 100])
def test_upsert_stream_keeps_and_closes(spark, tmp_path, fold_every):
    source, table, start = tmp_path / "in", str(tmp_path / "table"), spark.createDataFrame([], STATE)
    batches = [[posting("1", 1), posting("2", 1)], [posting("1", 2, "new"), posting("3", 2)], [posting("9", 3, company=2)], [posting("3", 4, company=2), posting("9", 4, company=2)], [posting("1", 5)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, POSTING).coalesce(1).write.parquet(str(source / str(i)))
        stream = spark.readStream.schema(POSTING).parquet(f"{source}/*")
        jobs.upsert_stream(stream, table, start, str(tmp_path / "checkpoint"), fold_every).awaitTermination()
        if i == 2:
            got = {r.source_job_id: r for r in jobs.current_postings(spark, table, start).collect()}
            assert len(got) == 4
            assert (got["1"].posted_at, got["1"].last_seen_at, got["1"].description, got["1"].skills_dirty) == (datetime(2024, 1, 1), datetime(2024, 1, 2), "new", True)
            assert not got["2"].is_active and got["2"].closed_at == datetime(2024, 1, 2)
            assert got["3"].is_active and got["9"].is_active and got["1"].is_active
    assert {r.source_job_id for r in jobs.current_postings(spark, table, start, 1).collect()} == {"1", "2"}
    changed = spark.read.parquet(f"{table}/deltas").groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in changed} == {0: 2, 1: 3, 2: 1, 3: 2, 4: 1}  # what a batch has, and what it closes
    got = {r.source_job_id: r for r in jobs.current_postings(spark, table, start).collect()}
    assert len(got) == 4 and got["3"].company_id == 2 and got["3"].is_active  # moved, and open in its new company
    assert (tmp_path / "table/base").exists() == (fold_every == 2)


def test_a_batch_that_runs_again_replaces_its_delta(spark, tmp_path):
    source, table, start = tmp_path / "in", str(tmp_path / "table"), maintain.upsert_postings(spark.createDataFrame([], STATE), spark.createDataFrame([posting("7", 1)], POSTING))
    for i, rows in enumerate([[posting("7", 2)], [posting("8", 3)]]):
        spark.createDataFrame(rows, POSTING).coalesce(1).write.parquet(str(source / str(i)))
    run = lambda checkpoint: jobs.upsert_stream(spark.readStream.schema(POSTING).option("maxFilesPerTrigger", 1).parquet(f"{source}/*"), table, start, str(tmp_path / checkpoint)).awaitTermination()
    run("a")
    once = sorted(jobs.current_postings(spark, table, start).collect())
    run("b")  # all batches again, from a checkpoint of their own
    assert sorted(jobs.current_postings(spark, table, start).collect()) == once and len(once) == 2


def test_upsert_is_idempotent(spark):
    first = maintain.upsert_postings(spark.createDataFrame([], STATE), spark.createDataFrame([posting("1", 1), posting("1", 1), posting("2", 1)], POSTING))
    batch = spark.createDataFrame([posting("1", 2)], POSTING)
    once = maintain.upsert_postings(first, batch)
    assert sorted(maintain.upsert_postings(once, batch).collect()) == sorted(once.collect()) and once.count() == 2


def test_weekly_counts_and_repeats(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.unionByName(events.limit(50)).repartition(1).write.parquet(str(tmp_path / "events"))
    end = spark.createDataFrame([(10**9, datetime(2024, 6, 1), 1, "end", 0.0, "{}")], jobs.EVENTS)
    end.write.mode("append").parquet(str(tmp_path / "events"))
    stream = jobs.read_events(spark, str(tmp_path / "events"), 10)
    query = jobs.without_repeats(stream, ["event_id"], "200 days").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("once").count() == events.count() + 1
    query = jobs.weekly_counts(jobs.read_events(spark, str(tmp_path / "events"), 10).filter("event_id < 1000000000 or event_type = 'end'")).writeStream.format("memory").queryName("weeks").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.week_start, r.event_type): r.n for r in spark.table("weeks").collect()}
    want = events.unionByName(events.limit(50)).groupBy(F.date_trunc("week", "ts").cast("date").alias("w"), "event_type").count().collect()
    assert got == {(r.w, r.event_type): r["count"] for r in want}


def test_postings_unseen_for_long_close(spark, tmp_path):
    at = lambda day: datetime(2024, 1, 1) + timedelta(days=day)
    for i, rows in enumerate([[("1", 0), ("2", 0), ("3", 5)], [("1", 60), ("4", 120)], [("2", 130), ("5", 400)], [("6", 401)]]):
        spark.createDataFrame([("a", k, at(d)) for k, d in rows], "source_ats string, source_job_id string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    seen = spark.readStream.schema("source_ats string, source_job_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    jobs.liveness_stream(seen).writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.source_job_id, r.last_seen_at, r.closed_at) for r in spark.table("closed").collect())
    assert got == [("1", at(60), at(150)), ("2", at(0), at(90)), ("2", at(130), at(220)), ("3", at(5), at(95)), ("4", at(120), at(210))]


def test_since_last_run(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, d),) for d in range(1, 11)], "at timestamp")
    runs = spark.createDataFrame([(datetime(2024, 1, 4), "completed"), (datetime(2024, 1, 8), "failed")], "started_at timestamp, status string")
    assert jobs.since_last_run(runs, rows, "at", date(2024, 1, 12)).count() == 6
    assert jobs.since_last_run(runs.limit(0), rows, "at", date(2024, 4, 4), 90).count() == 5
    assert jobs.live(spark.createDataFrame([(None, datetime(2024, 1, 1)), (None, datetime(2023, 1, 1)), (datetime(2024, 1, 1), datetime(2024, 1, 1))], "closed_at timestamp, last_seen_at timestamp"), date(2024, 1, 2)).count() == 1


def test_skill_extraction(spark, tmp_path):
    text = "About us\nWe use Python.\n\nRequirements:\n- Python, C++ and Node.js; python again\n- machine learning (python)\n\nBenefits\nJava coffee"
    docs = spark.createDataFrame([(1, text), (2, "5 years of experience with Java required\n\nWe offer benefits"), (3, "nothing"), (4, None)], "id long, text string")
    skills = spark.createDataFrame([(1, "Python", True, ["py"]), (2, "C++", True, None), (3, "Node.js", True, None), (4, "Machine Learning", True, None), (5, "Java", True, None), (6, "Rust", False, None)], "id long, name string, is_verified boolean, aliases array<string>")
    terms = enrich.skill_terms(skills)
    got = {(r.id, r.skill_id): (r.n, r.confidence, r.is_required) for r in enrich.extract_skills(docs, terms).collect()}
    assert got == {(1, 1): (3, 95, True), (1, 2): (1, 70, False), (1, 3): (1, 70, False), (1, 4): (1, 70, False), (2, 5): (1, 60, False)}
    assert (1, 5) in {(r.id, r.skill_id) for r in enrich.extract_skills(docs, terms, whole=True).collect()}
    assert [(r.n, r.name) for r in enrich.sections(docs.filter("id = 1")).orderBy("n").collect()] == [(1, "about_company"), (2, "requirements"), (3, "benefits")]
    docs.coalesce(1).write.parquet(str(tmp_path / "docs"))
    jobs.extract_stream(spark.readStream.schema("id long, text string").parquet(str(tmp_path / "docs")), terms, str(tmp_path / "tags"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "tags")).count() == len(got)


def test_candidates_are_mined_and_known_ones_found(spark):
    docs = spark.createDataFrame([(1, "Experience with Apache Kafka, knowledge of the Terraform and proficiency in SQL")], "id long, text string")
    assert {(r.name, r.method) for r in enrich.mine_candidates(docs).collect()} == {("Apache Kafka", "ctx_exp"), ("Terraform", "ctx_know"), ("SQL", "ctx_prof")}
    text = "Skills:\n- Apache Spark\n• manage the team\n* lower case thing\n- Docker.\nBuilt with React, Vue, Node.js and expertise in strong SQL skills; tools like git, Jira (board), certified in AWS Cloud\n"
    legal = "We are an equal opportunity employer with experience with Pottery. " + "x" * 120 + " familiar with Ceramics"
    docs = spark.createDataFrame([(1, text), (2, legal), (3, None), (4, "")], "id long, text string")
    got = {(r.id, r.name, r.method) for r in enrich.mine_candidates(docs).collect()}
    assert got == {(1, "Apache Spark", "bullet"), (1, "Docker", "bullet"), (1, "Vue", "ctx_list"), (1, "Node.js", "ctx_list"), (1, "React", "ctx_built"), (1, "SQL", "ctx_exp2"), (1, "AWS Cloud", "ctx_cert"), (2, "Ceramics", "ctx_fam")}
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    got = {r.name: (r.known, r.how) for r in enrich.in_taxonomy(names("kafka", "Apache Kafka Streams", "Kubernetis", "Cooking"), names("Kafka", "Kubernetes")).collect()}
    assert got == {"kafka": ("Kafka", "exact"), "Apache Kafka Streams": ("Kafka", "substring"), "Kubernetis": ("Kubernetes", "similar")}
    kinds = names("Docker Swarm", "Public communication", "CoffeeScript", "Baking").select(enrich.candidate_kind(F.col("name")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["technical", "soft", "domain", "domain"]  # no word of a kind in CoffeeScript, nor such an ending


def test_terms_of_any_length_are_tagged(spark):
    terms = spark.createDataFrame([("natural language processing toolkit", 1), ("natural language", 2), ("c++", 3), ("toolkit", 1)], "term string, skill_id long")
    docs = spark.createDataFrame([(1, "A Natural-Language processing toolkit, and natural  language; C++ not c+"), (2, "natural"), (3, None)], "id long, text string")
    assert {(r.id, r.skill_id): r.n for r in enrich.tag_skills(docs, terms).collect()} == {(1, 1): 2, (1, 2): 2, (1, 3): 1}


def test_fallback_paragraphs(spark):
    """Without a requirements section: scoring paragraphs of other sections, else all text but benefits and the like."""
    guess = "Intro text here\n\n- SQL\n- knowledge of Excel\n- Python\n\nBenefits\nexperience with dental plans, knowledge of fun"
    none = "Plain words only\n\nBenefits\ndental"
    docs = spark.createDataFrame([(1, guess), (2, none), (3, None)], "id long, text string")
    got = {r.id: (r.text, r.used_fallback) for r in enrich.requirements(docs).collect()}
    assert got[1] == ("- SQL\n- knowledge of Excel\n- Python", True)
    assert got[2][0].strip() == "Plain words only" and got[3] == (None, True)


def test_names_in_names_and_similar_names_like_brute_force(spark):
    r = random.Random(5)
    names = sorted({"".join(r.choices("abcde ", k=r.randint(1, 14))).strip() + r.choice(["", "É", " Kafka", " kafka stream"]) for _ in range(150)})
    table = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(x.name, x.part) for x in enrich.holding(table, table.withColumnRenamed("name", "part"), 4).collect()}
    assert got == {(a, b) for a in names for b in names if len(b) >= 4 and b.lower() in a.lower()}

    def edits(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
        return row[-1]

    near = {(x.a, x.b) for x in enrich.similar_names(table, 0.8).collect()}
    assert near == {(a, b) for a in names for b in names if a < b and abs(len(a) - len(b)) <= 20 and 1 - edits(a.lower(), b.lower()) / max(len(a), len(b)) >= 0.8}


def test_places_of_countries(spark):
    rows = [("CA", "x"), ("United States", "x"), ("TX - Austin", "x"), ("Texas", "x"), ("Ontario", "x"), ("ON; CA", "x"), ("Deutschland", "x"), (None, "Berlin, Germany"), ("great britain", None), ("Karnataka; x", ""), ("Bandwidth", "x"), (None, None), ("x", "Boston office")]
    jobs_ = spark.createDataFrame(rows, "location_country string, location_raw string")
    of = lambda *where, **more: [r.location_country or r.location_raw for r in jobs_.filter(filters.place(list(where), **more)).collect()]
    assert of("United States", states={"TX": "Texas"}, cities=["boston"]) == ["CA", "United States", "TX - Austin", "Texas", "ON; CA", "x"]
    assert of("Canada") == ["ON; CA", "Ontario"] or of("Canada") == ["Ontario", "ON; CA"]
    assert of("Germany", aliases={"deutschland": "Germany"}) == ["Deutschland", "Berlin, Germany"]
    assert of("United Kingdom") == ["great britain"] and of("India") == ["Karnataka; x"]
    assert len(of()) == len(of("all")) == len(rows)


def test_cards_remark_by_category_of_the_role(spark):
    from laborlens.operators import demand
    from laborlens.star import from_tables

    star = from_tables(spark, "/root/testdata/sf0.001")
    lead = star.skills.select(F.lower("name").alias("name")).first().name
    star = replace(star, roles=star.roles.withColumn("category", F.when(F.col("id") == 3, " Engineering ").otherwise("Sales")))
    cards = demand.role_cards(star, callouts=[(lead, "engineering")], within=150, k=150).select("role_id", "callout", "callout_rank").distinct().collect()
    assert {r.role_id: (r.callout or "").lower() for r in cards} == {i: lead if i == 3 else "" for i in range(10)} and all((r.callout_rank is not None) == (r.role_id == 3) for r in cards)
    assert ("excel", "data science") in demand.CALLOUTS and ("sql", "technical") not in demand.CALLOUTS


def test_countries(spark):
    rows = [("Remote",), ("Berlin, Germany",), ("USA",), ("Munich",), ("somewhere in usa maybe",), ("Atlantis",), (None,)]
    aliases = spark.createDataFrame([("usa", "United States"), ("germany", "Germany")], "alias string, country string")
    cities = spark.createDataFrame([("munich", "Germany")], "city string, country string")
    got = {r.location: (r.country, r.how) for r in enrich.countries(spark.createDataFrame(rows, "location string"), aliases, cities).collect()}
    assert got == {"Remote": ("Remote", "remote"), "Berlin, Germany": ("Germany", "part"), "USA": ("United States", "alias"), "Munich": ("Germany", "city"), "somewhere in usa maybe": ("United States", "word"), "Atlantis": (None, None), None: (None, None)}
