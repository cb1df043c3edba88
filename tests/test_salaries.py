"""Golden rows of stated salaries, and upkeep operators that no query covers."""

from __future__ import annotations

from pyspark.sql import functions as F

from laborlens.operators import demand, enrich, filters, maintain, salary

PLACES = [("united states", "USD"), ("usa", "USD"), ("us", "USD"), ("uk", "GBP"), ("germany", "EUR"), ("india", "INR"), ("karnataka", "INR"), ("canada", "CAD"), ("australia", "AUD")]
#: Text, place, expected minimum, maximum and currency.
CASES = [
    ("$143,675 to $176,000", "United States", (143675, 176000, "USD")),
    ("$120k - $150k", "USA", (120000, 150000, "USD")),
    ("£50,000 - £70,000", "UK", (50000, 70000, "GBP")),
    ("€60,000 - €80,000", "Germany", (60000, 80000, "EUR")),
    ("10-15 LPA", "India", (1000000, 1500000, "INR")),
    ("$90,000 - $120,000", "Canada", (90000, 120000, "CAD")),
    ("$100,000 - $140,000", "Australia", (100000, 140000, "AUD")),
    ("8L - 12L", "Karnataka", (800000, 1200000, "INR")),
    ("Salary: $150,000 - $200,000 per year", "US", (150000, 200000, "USD")),
    ("Base compensation: $180K - $220K", "US", (180000, 220000, "USD")),
    ("$55/hr", "US", (114400, 114400, "USD")),
    ("Hourly rate: $75 per hour", "US", (156000, 156000, "USD")),
    ("$496M raised", "US", None),
    ("raised $300m in funding", "US", None),
    ("Series B of $50M", "US", None),
    ("backed by $100M", "US", None),
    ("$1.2B valuation", "US", None),
    ("We've raised $286 million", "US", None),
    ("40+ countries 15+ languages $496M raised 430,000+ community members", "US", None),
    ("managing budgets greater than $500K", "US", None),
    ("$2M budget for marketing", "US", None),
    ("experience with $1M+ budgets", "US", None),
    ("$10M ARR", "US", None),
    ("revenue of $50M", "US", None),
    ("driving $5M in pipeline", "US", None),
    ("$50 gift card", None, None),
    ("$500 learning stipend", "US", None),
    ("$1000 referral bonus", "US", None),
    ("Compensation range: $200,000-$300,000 annually", "US", (200000, 300000, "USD")),
    ("We have 10 to 15 people. Pay is $60,000 to $80,000.", "US", (60000, 80000, "USD")),
    ("", "US", None),
    (None, "US", None),
]


def test_salaries(spark):
    docs = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(CASES)], "id long, text string, location string")
    got = {r.id: (r.salary_min, r.salary_max, r.currency) for r in salary.stated_salaries(docs, spark.createDataFrame(PLACES, "place string, currency string")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(CASES) if want}


def test_role_lookup(spark):
    roles = spark.createDataFrame([(1, "Data Engineer"), (2, "Engineer"), (3, "Nurse")], "id long, normalized_title string")
    variations = spark.createDataFrame([("DE", 1), ("nurse", 2)], "original_title string, role_id long")
    names = spark.createDataFrame([("engineer",), ("de",), ("Nurse",), ("data",), ("none",)], "name string")
    got = {r.name: (r.role_id, r.how) for r in filters.find_role(names, roles, variations).collect()}
    assert got == {"engineer": (2, "title"), "de": (1, "variation"), "Nurse": (3, "title"), "data": (1, "substring")}
    volumes = spark.createDataFrame([(1, 5), (2, 9), (3, 1)], "role_id long, n long")
    tips = filters.suggest_roles(names.filter("name in ('engineer', 'none')"), roles, volumes, 2).collect()
    assert {(r.name, r.role_id, r["rank"]) for r in tips} == {("engineer", 2, 1), ("engineer", 1, 2), ("none", 2, 1), ("none", 1, 2)}
    assert filters.is_all("ALL") and filters.is_all([]) and filters.is_all(["x", "all"]) and not filters.is_all(["x"])


def test_decisions_make_and_map_roles(spark):
    jobs = spark.createDataFrame([(1, "Dev", None), (2, "dev", 7), (3, "Chef", None), (4, "Spam", None)], "id long, title string, role_id long")
    queue = spark.createDataFrame([("Dev", "pending"), ("Chef", "pending"), ("Spam", "pending"), ("Other", "pending")], "raw_title string, status string")
    decisions = spark.createDataFrame([("Dev", "map", "engineer"), ("Chef", "new_role", "Cook"), ("Spam", "reject", None)], "raw_title string, action string, role_title string")
    roles = spark.createDataFrame([(7, "Engineer")], "id long, normalized_title string")
    next_jobs, next_queue, next_roles = maintain.apply_decisions(jobs, queue, decisions, roles)
    assert {(r.id, r.role_id) for r in next_jobs.collect()} == {(1, 7), (2, 7), (3, 8), (4, None)}
    assert dict(next_queue.collect()) == {"Dev": "approved", "Chef": "approved", "Spam": "rejected", "Other": "pending"}
    assert dict(next_roles.collect()) == {7: "Engineer", 8: "Cook"}


def test_skills_merge_with_aliases(spark):
    tags = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, False)], "job_id long, skill_id long, is_required boolean")
    skills = spark.createDataFrame([(1, "JS", ["js"]), (2, "JavaScript", None)], "id long, name string, aliases array<string>")
    next_tags, next_skills = maintain.merge_skills(tags, skills, spark.createDataFrame([(1, 2)], "src long, dst long"))
    assert {tuple(r) for r in next_tags.collect()} == {(1, 2, True), (2, 2, False)}
    assert [tuple(r) for r in next_skills.collect()] == [(2, "JavaScript", ["JS", "js"])]
    changed = maintain.change_aliases(next_skills, spark.createDataFrame([(2, "JS", False), (2, "ECMA", True), (2, "ecma", True)], "id long, alias string, add boolean"))
    assert changed.first().aliases[0] in ("ECMA", "ecma") and "js" not in changed.first().aliases
    both = spark.createDataFrame([(1, "Go", True, ["Golang"]), (2, "Golang", True, [])], "id long, name string, is_verified boolean, aliases array<string>")
    assert [tuple(r) for r in maintain.alias_conflicts(both).collect()] == [(1, "Golang", 2)]


def test_promotion_tags_history(spark):
    skills = spark.createDataFrame([(5, "Go", True)], "id long, name string, is_verified boolean")
    tags = spark.createDataFrame([(1, 5, True)], "job_id long, skill_id long, is_required boolean")
    bridge = spark.createDataFrame([("Rust", 1, 1), ("Rust", 2, 2), ("Rust", 3, 3), ("Zig", 1, 1), ("go", 9, 1)], "name string, job_id long, company_id long")
    candidates = spark.createDataFrame([("Rust", "pending"), ("Zig", "pending"), ("go", "approved")], "name string, status string")
    chosen = maintain.promotable(candidates, bridge)
    assert [r.name for r in chosen.collect()] == ["Rust"]
    next_skills, next_tags = maintain.promote(skills, tags, bridge, chosen.select("name").union(spark.createDataFrame([("GO",)], "name string")))
    assert {(r.id, r.name) for r in next_skills.collect()} == {(5, "Go"), (6, "Rust")}
    assert {tuple(r) for r in next_tags.collect()} == {(1, 5, True), (1, 6, True), (2, 6, True), (3, 6, True)}


def test_imports_and_registries(spark):
    skills = spark.createDataFrame([("SQL", "technical", 5, None), ("Go", "technical", 9, ["golang"])], "name string, category string, job_count int, aliases array<string>")
    curated = spark.createDataFrame([("sql", "x", 7, ["structured"]), ("GO", "x", 1, ["g"]), ("Zen", "soft", 2, None)], "name string, category string, job_count int, aliases array<string>")
    got = {r.name: (r.category, r.job_count, r.aliases) for r in maintain.import_skills(skills, curated).collect()}
    assert got == {"SQL": ("technical", 7, ["structured"]), "Go": ("technical", 9, ["golang"]), "Zen": ("soft", 2, None)}
    current = spark.createDataFrame([("g", "a", "A", "X")], "ats string, slug string, name string, industry string")
    registry = spark.createDataFrame([("g", "a", "AA", "Y"), ("g", "b", "B", "TBD"), ("l", "a", "C", "Z")], current.schema)
    assert {tuple(r) for r in maintain.sync_companies(current, registry).collect()} == {("g", "a", "A", "X"), ("g", "b", "B", None), ("l", "a", "C", "Z")}
    weeks = maintain.fix_whitespace(spark.createDataFrame([(" Data  engineer",), ("x",)], "title string"), spark.createDataFrame([("data Engineer", 4)], "raw_title string, role_id long"))
    assert [tuple(r) for r in weeks.collect()] == [(" Data  engineer", 4)]
    known = spark.createDataFrame([("a", "1")], "alias string, canonical_id string")
    assert {tuple(r) for r in maintain.learn_aliases(known, spark.createDataFrame([("a", "2"), ("b", "3")], "title string, canonical_id string")).collect()} == {("a", "1"), ("b", "3")}
    listed = maintain.shortlist(spark.createDataFrame([("Rust", "pending", 2, 3), ("Zig", "pending", 5, 1), ("Ada", "rejected", 9, 9)], "name string, status string, company_count int, job_count int"), spark.createDataFrame([("rust", "t"), ("zig", "t"), ("ada", "t")], "name string, category string"))
    assert {(r.name, r["rank"]) for r in listed.collect()} == {("Zig", 1), ("Rust", 2)}


def test_mapping_precedence_and_log(spark):
    table = spark.createDataFrame([(1, "A"), (2, "B"), (3, None)], "id long, industry string")
    mapping = spark.createDataFrame([(1, "X", 2), (1, "Y", 1), (2, "B", 1), (3, "Z", 1), (9, "Q", 1)], "key long, value string, priority int")
    after, log = maintain.apply_mapping(table, mapping, "id", "industry")
    assert dict(after.collect()) == {1: "Y", 2: "B", 3: "Z"}
    assert {tuple(r) for r in log.collect()} == {(1, "A", "Y"), (3, None, "Z")}
    assert [r.key for r in maintain.unmatched_keys(table, mapping, "id").collect()] == [9]


def test_late_companies_leave_a_locked_trend_alone(spark):
    from dataclasses import replace
    from datetime import datetime

    from laborlens.operators import trends
    from laborlens.params import Params
    from laborlens.star import from_tables

    star = from_tables(spark, "/root/testdata/sf0.001")
    late = star.jobs.filter("role_id = 1").limit(20).withColumn("company_id", F.lit(10**6).cast("long")).withColumns({c: F.lit(datetime(2001, 5, 5)) for c in ("posted_at", "scraped_at")}).withColumn("id", F.col("id") + 10**7)
    more = replace(star, jobs=star.jobs.unionByName(late))
    assert sorted(trends.role_trend(star, Params()).collect()) == sorted(trends.role_trend(more, Params()).collect())
    mix = demand.remote_split(more).filter("role_id = 1").first()
    assert mix.remote + mix.onsite == star.jobs.filter("role_id = 1 and is_active").count() + late.filter("is_active").count()


def test_taxonomy_titles_and_rules(spark):
    titles = ["Manager, Product", "Senior Full Stack Developer - Payments", "Widget Polisher Specialist", "General Application", "Machine Learning Research Engineer II", "Head of Growth Marketing", "Unknown thing"]
    aliases = spark.createDataFrame([("product manager", "pm"), ("full stack developer", "fsd"), ("machine learning", "ml"), ("growth marketing manager", "gm"), ("junk title", None)], "alias string, canonical_id string")
    defaults = spark.createDataFrame([("specialist", "spec")], "suffix string, canonical_id string")
    got = {r.title: (r.canonical_id, r.how) for r in enrich.canonical_titles(spark.createDataFrame([(t,) for t in titles], "title string"), aliases, defaults).collect()}
    assert got == {
        "Manager, Product": ("pm", "key"), "Senior Full Stack Developer - Payments": ("fsd", "key"), "Widget Polisher Specialist": ("spec", "suffix"), "Machine Learning Research Engineer II": ("ml", "substring"), "Head of Growth Marketing": ("gm", "key"), "Unknown thing": (None, None),
    }


def test_what_stands_around_an_amount(spark):
    far = "We like what we do and take our time for it. " * 4
    cases = [
        ("Managing $750,000. Pay is $60,000 to $80,000", None),
        (f"Managing $750,000. {far}Pay is $60,000 to $80,000", (60000, 80000)),
        ("Pay is $60 million", None),
        ("See https://jobs.example/$60,000 for the salary", None),
        ("#li-ab1 salary $60,000", None),
        ("Prize of $60,000", None),
        ("Salary of $60,000 and stock", (60000, 60000)),
        ("equity grant of $60,000", None),
        ("base plus an equity grant of $60,000", (60000, 60000)),
        ("$25 per hour", (52000, 52000)),
        ("3 years of experience, $500 per hour", None),
        ("Compensation: $60,000 with 2,000 employees and 30 countries", (60000, 60000)),
        ("$90,000 - $70,000 salary", (70000, 90000)),
    ]
    docs = spark.createDataFrame([(i, t, "US") for i, (t, _) in enumerate(cases)], "id long, text string, location string")
    got = {r.id: (r.salary_min, r.salary_max) for r in salary.stated_salaries(docs, spark.createDataFrame(PLACES, "place string, currency string")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases) if want}


def test_a_text_is_read_once(spark):
    docs = spark.createDataFrame([(i, CASES[i % 3][0], (None, "UK", "usa")[i % 2]) for i in range(90)], "id long, text string, location string").repartition(6)
    found = salary.stated_salaries(docs, spark.createDataFrame(PLACES, "place string, currency string"))
    assert found.count() == 90
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FUNDING_REMOVED" not in "".join(line for line in plan.splitlines() if "id#" in line)  # the reading knows no posting
