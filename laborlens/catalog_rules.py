"""Rule tables of hundreds of rows as queries over titles of all orders and all companies, each with SQL that tries every
rule on every text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens.catalog_enrich import _nth, _quoted, _sql_nth, _stripped
from laborlens.functions import titles
from laborlens.operators import enrich, rules, salary
from laborlens.star import from_tables, sql

# Rules are made from fields and nouns: a field with a noun is a role, and a field alone is what a manager, head,
# director or associate is one of. Fields of one group share category and nouns.
GROUPS = {
    "Engineering": (
        ["machine learning|ml", "deep learning", "computer vision", "data platform", "data", "backend|back[- ]end", "frontend|front[- ]end", "full[- ]?stack", "site reliability", "embedded", "firmware", "android", "ios", "mobile", "cloud", "security", "network", "hardware", "quality|test", "release", "software"],
        ["engineer|developer", "architect", "researcher", "scientist", "technician"],
    ),
    "Product": (["technical product", "growth product", "platform product", "product"], ["manager", "owner", "analyst", "designer"]),
    "Sales": (["enterprise sales", "inside sales", "field sales", "sales development", "sales operations", "partner sales", "sales"], ["representative|rep", "manager", "engineer", "associate", "specialist"]),
    "Marketing": (["content marketing", "brand", "demand generation|demand gen", "lifecycle", "communications", "marketing"], ["manager", "specialist", "strategist", "coordinator", "writer"]),
    "People": (["talent acquisition|talent", "compensation", "recruiting", "human resources|people"], ["partner", "specialist", "coordinator", "manager", "analyst"]),
    "Finance": (["treasury", "accounting", "revenue", "tax", "finance"], ["analyst", "manager", "accountant", "controller", "specialist"]),
    "Operations": (["supply chain", "logistics", "customer support|support", "facilities", "business operations", "operations"], ["analyst", "manager", "specialist", "coordinator", "associate"]),
}
#: What tells the category of a title that no role fits.
HINTS = {
    "Engineering": ["engineer", "developer", "architect", "infrastructure"], "Legal": ["counsel", "attorney", "paralegal", "compliance"], "Design": ["design", "creative", "illustrat"],
    "Finance": ["finance", "accountant", "audit"], "Sales": ["sales", "account exec"], "People": ["recruit", "talent"], "Leadership": ["chief", "president", "officer"], "Operations": ["operations", "support", "specialist"],
}
TITLE_RULE = "scope string, priority int, pattern string, canonical string, category string, family string"


def _name(pattern: str) -> str:
    """The display name of a field or noun: its first spelling, without signs of the pattern."""
    plain = pattern.split("|")[0].replace("[- ]?", " ").replace("[- ]", " ")
    return {"ios": "iOS"}.get(plain, plain.title())


def title_rules() -> list[tuple]:
    """(scope, priority, pattern, canonical, category, family): some 330 rules, roles of earlier fields first."""
    rows, k = [], 0
    for category, (fields, nouns) in GROUPS.items():
        for field in fields:
            for noun in nouns:
                k += 1
                rows.append(("title", k, rf"\b(?:{field})\s+(?:[a-z]+\s+)?(?:{noun})\b", f"{_name(field)} {_name(noun)}", category, _name(fields[-1])))
            for scope, shape in (("manager", "{} Manager"), ("head", "Head of {}"), ("director", "Director of {}"), ("associate", "{} Associate")):
                rows.append((scope, k, field, shape.format(_name(field)), category, _name(fields[-1])))
    for category, words in HINTS.items():
        k += 1
        rows.append(("category", k, "|".join(words), None, category, category))
    return rows


TITLE_RULES = title_rules()
FORMED = ["{} Engineer", "{} Manager", "Manager, {}", "Head of {}, EMEA", "Director of {} (Berlin)", "Associate, {}", "Senior {} Architect | Remote", "{} Specialist - US", "Lead {} Analyst, Payments", "Chief {} Officer", "{} Developer Manager", "{} Scientist (Summer 2026)", "{}", "Junior {} Gardener"]
MARKS = ["Machine Learning", "Data", "Back-End", "Frontend", "Full Stack", "iOS", "Enterprise Sales", "Sales", "Brand", "Talent", "Treasury", "Tax", "Supply Chain", "Customer Support", "Product", "Growth Product", "Beekeeping", "Security", "Deep Learning", "Office", "Network Test", "People"]
PREFIXES = ["", "Acme", "Remote", "Global", "Regional", "New", "Interim", "Deputy", "Night", "Field"]


def legacy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    field = F.trim(F.concat_ws(" ", _nth(PREFIXES, F.floor(key / 32)), _nth(MARKS, F.floor(key / 7))))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.replace(_nth(FORMED, key), F.lit("{}"), field).alias("title")).distinct()


def legacy_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.legacy_titles(legacy_names(spark, sf_dir), rules.indexed(spark.createDataFrame(TITLE_RULES, TITLE_RULE)), titles.strip_level)


def _first(scope: str, column: str, table: list[tuple]) -> str:
    """SQL for the number of the first rule of a scope that fits."""
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {_quoted(r[2])}) THEN {k}" for k, r in enumerate(table) if r[0] == scope) + " END"


def _values(table: list[tuple]) -> str:
    quote = lambda x: "NULL" if x is None else _quoted(x)
    return "SELECT * FROM (VALUES " + ", ".join(f"({k}, {', '.join(map(quote, r[3:]))})" for k, r in enumerate(table)) + ")"


_initcap = lambda x: f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
LEGACY = {
    "named": f"SELECT DISTINCT replace({_sql_nth(FORMED, 'o_orderkey')}, '{{}}', trim(concat_ws(' ', {_sql_nth(PREFIXES, '(o_orderkey // 32)')}, {_sql_nth(MARKS, '(o_orderkey // 7)')}))) AS title FROM orders",
    "bared": r"""SELECT title, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), '\s*[|–-]\s*(?:remote|hybrid|amer|emea|apac|latam|anz|us|usa|uk|eu|nordics|central|east|west|north|south)\b.*$', ''),
      '\s*\(?(?:summer|fall|winter|spring)?\s*(?:19|20)\d\d\)?|\(?\d+[- ]month[^)]*\)?', '', 'g'), '\s*\([^)]{0,30}\)', '', 'g'), '\s+', ' ', 'g'), ' ,-|') AS l FROM named""",
    "leveled": f"SELECT title, {_stripped('l')[0]} AS seniority, {_stripped('l')[1]} AS rest FROM bared",
    "formed": r"""SELECT *, trim(regexp_extract(rest, '^manager\s*,\s*([^,]+)', 1)) AS m, trim(regexp_extract(rest, '\bhead of\s+([^,]+)', 1)) AS h,
      trim(regexp_extract(rest, '^(?:senior\s+)?director\s*(?:,|of)+\s*([^,(]+)', 1)) AS d, trim(regexp_extract(rest, '^associate\s*,\s*([^,]+)', 1)) AS a, regexp_extract(rest, '^(.+?)[\s,.-]+managers?$', 1) AS g FROM leveled""",
    "ruled": f"""SELECT title, seniority, rest,
      CASE WHEN m <> '' THEN {_initcap('m')} || ' Manager' WHEN h <> '' THEN 'Head of ' || {_initcap('h')} WHEN d <> '' THEN 'Director of ' || {_initcap('d')} WHEN a <> '' THEN {_initcap('a')} || ' Associate' END AS named,
      CASE WHEN m <> '' THEN {_first('manager', 'm', TITLE_RULES)} WHEN h <> '' THEN {_first('head', 'h', TITLE_RULES)} WHEN d <> '' THEN {_first('director', 'd', TITLE_RULES)} WHEN a <> '' THEN {_first('associate', 'a', TITLE_RULES)} END AS k0,
      CASE WHEN g <> '' AND g NOT IN ('product', 'account', 'engineering', 'sales', 'marketing', 'project', 'design', 'operations', 'data', 'program', 'general', 'office', 'partner', 'community', 'content', 'finance', 'brand', 'growth') THEN {_first('title', 'g', TITLE_RULES)} END AS k1,
      {_first('title', "trim(split_part(rest, ',', 1))", TITLE_RULES)} AS k2, {_first('title', 'rest', TITLE_RULES)} AS k3, {_first('category', 'rest', TITLE_RULES)} AS k4 FROM formed""",
    "stepped": """SELECT *, CASE WHEN named IS NOT NULL THEN k0 ELSE coalesce(k1, k2, k3, k4) END AS k,
      CASE WHEN named IS NOT NULL THEN CASE WHEN k0 IS NOT NULL THEN 'form' ELSE 'form by name' END WHEN k1 IS NOT NULL THEN 'manager of' WHEN k2 IS NOT NULL THEN 'head' WHEN k3 IS NOT NULL THEN 'whole' WHEN k4 IS NOT NULL THEN 'keyword' ELSE 'none' END AS how FROM ruled""",
    "v(k, canonical, category, family)": _values(TITLE_RULES),
}

# Industries: words of names, ends of hosts and phrases of postings.
SECTORS = {
    "Biotech & Pharma": (["therapeutics", "genomics", "biotech", "pharma"], [r"\.bio$"], ["clinical trials", "drug discovery"]),
    "Fintech": (["payments", "lending", "capital", "fintech"], [r"\bbank\b"], ["payments platform", "banking platform"]),
    "Security": (["security", "cyber"], [r"\bsecure"], ["threat detection", "identity platform"]),
    "Logistics": (["freight", "logistics", "shipping"], [r"\bcargo"], ["supply chain platform", "last[- ]mile"]),
    "Climate & Energy": (["solar", "energy", "climate", r"\bgrid\b"], [r"\.energy$"], ["carbon removal", "clean energy"]),
    "Healthcare": (["health", "medical", "clinic", r"\bcare\b"], [r"\.health$"], ["patient care", "health plans?"]),
    "Media": (["studios?", "media", "games?"], [r"\.tv$"], ["streaming service", "mobile games"]),
    "AI": ([r"\b(?:neural|cognitive)\b", "robotics"], [r"\.ai$"], ["foundation models?", "generative ai"]),
}
SECTOR_RULE = "scope string, priority int, pattern string, industry string"
EXTRA = {"name": ["labs", "systems", "holdings"], "intro": ["software company", "consulting firm"]}


def sector_rules() -> list[tuple]:
    rows = [(scope, i * 20 + j, p, name) for i, (name, ways) in enumerate(SECTORS.items()) for scope, patterns in zip(("name", "site", "intro"), ways, strict=True) for j, p in enumerate(patterns)]
    return rows + [(scope, 500 + k, p, f"Other {p.title()}") for scope, ps in EXTRA.items() for k, p in enumerate(ps)]


SECTOR_RULES = sector_rules()
NAMES = ["Solar Union", "Northern Freight", "Care Bears", "Neural Nets", "Blue Medical Games", "Plain Co", "Cyberia", "Old Capital", "Grid Iron", "Studio Nine", "Just Us", "Gridlock Inc", "Umbrella Holdings"]
SITES = ["https://www.{}.com/about", "{}.ai", "http://{}.bio?x=1", "https://{}.energy", None, "www.secure{}.io", "https://{}.tv/shows"]
INTROS = ["<p>We build a <b>payments   platform</b> for banks.</p>", "A consulting firm.", "Our clinical trials software", "We serve", "Last-mile and last mile delivery", "generative AI for all", "Health plan sales", "A software company", "nothing to say"]
RENAMED = {"BUILDING": "Construction", "FURNITURE": "Retail"}


def sector_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = from_tables(spark, sf_dir)
    companies = s.companies.select("id", F.concat(_nth(NAMES, F.col("id")), F.lit(" "), F.col("id").cast("string")).alias("name"), F.replace(_nth([x or "" for x in SITES], F.floor(F.col("id") / 3)), F.lit("{}"), F.concat(F.lit("c"), F.col("id").cast("string"))).alias("website"), F.when(F.col("id") % 4 > 0, F.col("industry")).alias("industry"))
    postings = s.jobs.filter("is_active").select("id", "company_id", "posted_at", F.concat(_nth(INTROS, F.col("id")), F.lit(" "), "title").alias("text"))
    return rules.industries(companies, postings, rules.indexed(spark.createDataFrame(SECTOR_RULES, SECTOR_RULE)), RENAMED)


_by_priority = sorted(SECTOR_RULES, key=lambda r: r[1])
SECTORED = {
    "c": f"""SELECT id, {_sql_nth(NAMES, 'id')} || ' ' || id AS n, replace({_sql_nth([x or '' for x in SITES], '(id // 3)')}, '{{}}', 'c' || id) AS site, CASE WHEN id % 4 > 0 THEN industry END AS industry FROM companies""",
    "latest": f"""SELECT company_id, {_sql_nth(INTROS, 'arg_max(id, (posted_at, id))')} || ' ' || arg_max(title, (posted_at, id)) AS intro FROM jobs WHERE is_active GROUP BY company_id""",
    "texts": r"""SELECT id, industry, lower(n) AS n, regexp_extract(lower(site), '^(?:https?://)?(?:www\.)?([^/?#]+)', 1) AS s, lower(regexp_replace(regexp_replace(left(intro, 1200), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS i FROM c LEFT JOIN latest ON company_id = id""",
    "tried": f"SELECT id, industry, {_first('name', 'n', _by_priority)} AS kn, {_first('site', 's', _by_priority)} AS ks, {_first('intro', 'i', _by_priority)} AS ki FROM texts",
    "w(k, told)": _values(_by_priority),
}

# Descriptions with pay, made from orders: statements in which A and B are thousands by the key, with what is expected.
STATEMENTS = [
    ("Salary: ${A},000 - ${B},000 per year", "a", "b", "USD"),
    ("We've raised $5M in funding this year. Pay: ${A},000 - ${B},000", "a", "b", "USD"),
    ("You will be managing budgets of $750,000. Pay is ${A},000 to ${B},000", None, None, None),
    ("You will be managing budgets of $750,000. {F} Pay is ${A},000 to ${B},000", "a", "b", "USD"),
    ("£{A}k-£{B}k a year in London", "a", "b", "GBP"),
    ("€{A},000 to €{B}k is what we pay", "a", "b", "EUR"),
    ("CTC: {A} lakhs to {B} lakhs", "100 * a", "100 * b", "INR"),
    ("Base salary: ${A}K", "a", "a", "USD"),
    ("We raised ${A}M", None, None, None),
    ("A stipend of ${A},000 for learning", None, None, None),
    ("An offer of {A},000 CAD waits", "a", "a", "CAD"),
    ("C${A}k to C${B}k", "a", "b", "CAD"),
    ("40 countries, 2,000 employees and ${A},000", None, None, None),
    ("Our prize is ${A},000", None, None, None),
    ("Compensation of ${A},000, ten years of experience asked for", "a", "a", "USD"),
    ("See https://x.example/${A},000 for the salary", None, None, None),
    ("equity grant of ${A},000", None, None, None),
    ("salary plus an equity grant of ${A},000", "a", "a", "USD"),
    ("no figures at all", None, None, None),
    ("Annual revenue of ${A},000", None, None, None),
]
FILLER = "We build things that people like to use every day, and we take our time for doing so. " * 3
PLACE = [("london", "GBP"), ("canada", "CAD")]


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    low = F.col("o_custkey") % 80 + 40
    text = _nth([s for s, *_ in STATEMENTS], key)
    for mark, value in (("{A}", low.cast("string")), ("{B}", (low + 30).cast("string")), ("{F}", F.lit(FILLER))):
        text = F.replace(text, F.lit(mark), value)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("id"), F.concat(F.lit("The role. "), text, F.lit(". Apply now.")).alias("text"), F.lit("somewhere").alias("location"))


def stated_salaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return salary.stated_salaries(described(spark, sf_dir), spark.createDataFrame(PLACE, "place string, currency string"))


_said = [(k, *s[1:]) for k, s in enumerate(STATEMENTS) if s[1]]
STATED = f"""SELECT id, CAST(1000 * CASE k {' '.join(f'WHEN {k} THEN {a}' for k, a, _, _ in _said)} END AS BIGINT) AS salary_min, CAST(1000 * CASE k {' '.join(f'WHEN {k} THEN {b}' for k, _, b, _ in _said)} END AS BIGINT) AS salary_max,
  CASE k {' '.join(f"WHEN {k} THEN '{c}'" for k, _, _, c in _said)} END AS currency, false AS is_hourly FROM (SELECT o_orderkey AS id, o_orderkey % {len(STATEMENTS)} AS k, o_custkey % 80 + 40 AS a, o_custkey % 80 + 70 AS b FROM orders) WHERE k IN ({', '.join(str(k) for k, *_ in _said)})"""

# All documents with headers set in before every ninth line, the third first, of all classes and some that are none.
LINES = [
    ("## Minimum Qualifications:", "requirements"), ("Here's what you'll do", "responsibilities"), ("**Nice to have**", "preferred"), ("  Who we are", "about_company"), ("About the team", "about_company"), ("Perks & more", "benefits"), ("EEO statement", "boilerplate"),
    ("What you’ll need to succeed", "requirements"), (":star: Our mission", "about_company"), ("Skills we like, and requirements", None), ("Your day-to-day", "responsibilities"), ("Background", "requirements"), ("Backgrounds of noise", None), ("Privacy notice for applicants", "boilerplate"),
    ("Something else entirely (nonessential)", "preferred"), ("requirements " + "x" * 70, None), ("", None), ("# Salary", "benefits"), ("Perks", "benefits"),
]
EVERY = 9


def with_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.split("text", "\n", -1).alias("lines"))
    put = lambda line, i: F.when(i % EVERY == 2, F.concat(_nth([x for x, _ in LINES], F.col("id") + F.floor(i / EVERY)), F.lit("\n"), line)).otherwise(line)
    return docs.select("id", F.array_join(F.transform("lines", put), "\n").alias("text"))


_names = [(k, name) for k, (_, name) in enumerate(LINES) if name]
_straight = "translate({}, '‘’', concat(chr(39), chr(39)))"
SECTIONS = {
    "put": "SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents",
    "laid": f"""SELECT id, i, 1 AS half, {_straight.format('line')} AS line, NULL AS k FROM put UNION ALL
      SELECT id, i, 0, {_straight.format(_sql_nth([x for x, _ in LINES], f'(id + i // {EVERY})'))}, (id + i // {EVERY}) % {len(LINES)} FROM put WHERE i % {EVERY} = 2""",
    "named": f"""SELECT id, i, half, line, CASE k {' '.join(f"WHEN {k} THEN '{n}'" for k, n in _names)} END AS header FROM laid""",
    "placed": """SELECT *, sum(length(line) + 1) OVER o AS stop, count(header) OVER o AS n, coalesce(last_value(header IGNORE NULLS) OVER o, 'unknown') AS name FROM named WINDOW o AS (PARTITION BY id ORDER BY i, half ROWS UNBOUNDED PRECEDING)""",
}

ENTRIES = {
    "x02_sections": (
        lambda spark, sf_dir: enrich.sections(with_headers(spark, sf_dir)).withColumn("body", F.sha2("body", 256)),
        sql(
            """SELECT id, n, name, CAST(min(stop - length(line) - 1) AS BIGINT) AS start, CAST(max(stop) - 1 AS BIGINT) AS stop, sha256(string_agg(line, chr(10) ORDER BY i, half)) AS body FROM placed WHERE header IS NULL
            GROUP BY id, n, name HAVING trim(string_agg(line, chr(10) ORDER BY i, half), ' ') <> ''""",
            SECTIONS,
        ),
    ),
    "x32_stated_salaries": (stated_salaries, STATED),
    "x27_legacy_titles": (
        legacy_titles,
        sql(
            f"""SELECT title, CASE WHEN how = 'manager of' AND NOT ends_with(lower(canonical), 'manager') THEN canonical || ' Manager' ELSE coalesce(canonical, named, {_initcap('rest')}) END AS canonical,
            coalesce(category, CASE WHEN named IS NOT NULL THEN 'Leadership' ELSE 'Other' END) AS category, coalesce(family, category, CASE WHEN named IS NOT NULL THEN 'Leadership' ELSE 'Other' END) AS family, seniority, how FROM stepped LEFT JOIN v USING (k)""",
            LEGACY,
        ),
    ),
    "x31_industries": (
        sector_companies,
        sql(
            """SELECT id, coalesce(told, CASE industry WHEN 'BUILDING' THEN 'Construction' WHEN 'FURNITURE' THEN 'Retail' ELSE industry END, 'Other') AS industry,
            CASE WHEN kn IS NOT NULL THEN 'name' WHEN ks IS NOT NULL THEN 'site' WHEN ki IS NOT NULL THEN 'intro' WHEN industry IS NOT NULL THEN 'kept' ELSE 'none' END AS how FROM tried LEFT JOIN w ON w.k = coalesce(kn, ks, ki)""",
            SECTORED,
        ),
    ),
}


def queries() -> dict:
    return {name: run for name, (run, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in ENTRIES.items() if text}
