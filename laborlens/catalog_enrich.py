"""Enrichment operators as queries over whole tables, on titles, places and names in which every rule is met, each with
SQL that works the rules out anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laborlens.functions import places, skills, titles
from laborlens.operators import enrich as e
from laborlens.operators import filters
from laborlens.star import Star, from_tables, sql

# Titles of all orders: a level, a field, a noun and a tail by remainders of the key.
LEVEL_WORDS = ["", "Senior", "Sr.", "Lead", "Staff", "Principal", "Junior", "Jr", "Entry-Level", "Internship:", "Mid-Level", "Distinguished", "Senior Staff", "New Grad", "Associate", "Head of", "VP,", "Director of", "Manager,", "Chief", "Graduate", "Tech Lead,", "Level 3"]
FIELDS = ["Data", "Product", "Machine Learning", "Sales Operations", "Général Élève", "Talent Pool", "Quality / Test"]
ROLES = ["Engineer", "Analyst II", "Officer", "Manager", "Specialist 3", "Scientist - Payments"]
TAILS = ["", " (Remote)", " (Contract) (Berlin)", " - New York", ", USA", " III", " - Remote - US", " | EMEA", " - sign-on bonus available", " – London", " volunteer"]


def _nth(words: list[str], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (key % len(words)).cast("int") + 1)


def _sql_nth(words: list[str], key: str) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + f"][CAST({key} % {len(words)} AS INT) + 1]"


def order_titles(spark, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    head = F.concat_ws(" ", _nth(LEVEL_WORDS, key), _nth(FIELDS, key), _nth(ROLES, key))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.trim(head), _nth(TAILS, key)).alias("title")).distinct()


K = "o_orderkey"
TT = {"tt": f"SELECT title, lower(title) AS l FROM (SELECT DISTINCT trim(concat_ws(' ', {_sql_nth(LEVEL_WORDS, K)}, {_sql_nth(FIELDS, K)}, {_sql_nth(ROLES, K)})) || {_sql_nth(TAILS, K)} AS title FROM orders)"}


def _case(column: str, rules: list[tuple[str, str]], other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for p, n in rules) + f" ELSE {other} END"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


TRIMMED = "trim(regexp_replace({x}, {p}, ''), ' ,-')"
_tail = _quoted(rf"[,\-|]\s*(?:{titles.TAILS})\s*$")
DELEVEL = {
    "dl1": "SELECT title, trim(regexp_replace(lower(translate(trim(title), '‘’–—', '''''--')), '(?:\\s*\\([^)]*\\)\\s*){1,3}$', '')) AS x FROM tt",
    "dl2": f"SELECT title, trim(regexp_replace(x, {_quoted(titles.EMPLOYMENT)}, '', 'g')) AS x FROM dl1",
    "dl3": f"SELECT title, {TRIMMED.format(x=TRIMMED.format(x=TRIMMED.format(x='x', p=_tail), p=_tail), p=_tail)} AS x FROM dl2",
    "dl4": "SELECT title, " + TRIMMED.format(x="x", p=_quoted(r"(?:\s+|[-,]\s*)(?:i{1,3}v?|iv|v|[1-5])\s*$")) + " AS x FROM dl3",
    "dl": rf"SELECT title, trim(regexp_replace(regexp_replace(x, {_quoted(rf"^((?:.*\s)?(?:{titles.NOUNS})(?:\s[^-]*?)?)\s+-\s+[a-z0-9&'!,.\s/-]+$")}, '\1'), '\s+', ' ', 'g'), ' ,-') AS plain FROM dl4",
}
NO_LEAD = "NOT (" + " OR ".join(f"contains({{x}}, '{p}')" for p in titles.LEAD_ROLES) + ")"


def _stripped(x: str) -> tuple[str, str]:
    """SQL of the level word of ``x`` and of what is left without it."""
    hits = [(p, n, f"regexp_matches({x}, {_quoted(p)})" + (" AND " + NO_LEAD.format(x=x) if n == "lead" else "")) for p, n in titles.STRIPPED]
    level = "CASE " + " ".join(f"WHEN {hit} THEN '{n}'" for _, n, hit in hits) + " END"
    rest = "CASE " + " ".join(f"WHEN {hit} THEN regexp_replace({x}, {_quoted(p)}, ' ', 'g')" for p, _, hit in hits) + f" ELSE {x} END"
    return level, f"trim(regexp_replace({rest}, '\\s+', ' ', 'g'), ' ,-')"


ALIASES = [
    ("data engineer", "r1"), ("data analyst", "r2"), ("product manager", "r3"), ("machine learning engineer", "r4"), ("sales operations manager", "r5"), ("data director", "r6"), ("quality / test officer", None), ("sales operations specialist", "r7"),
    ("machine learning scientist", "r8"), ("operations director", "r13"), ("learning", "r9"), ("élève", "r14"),
]
DEFAULTS = [("officer", "r10"), ("specialist", "r11"), ("manager", "r12")]
REWRITES = [
    (r"^manager,\s+(.+)$", r"\1 manager"), (r"^director,\s+(.+)$", r"\1 director"), (r"^director of\s+(.+)$", r"director of \1"), (r"^head of\s+(.+)$", r"\1 manager"), (r"^head,\s+(.+)$", r"\1 manager"),
    (r"^(?:vp|svp|evp|gvp|avp)(?:,| of)?\s+(.+)$", r"\1 director"), (r"^(?:area\s+)?vice president(?:,| of)?\s+(.+)$", r"\1 director"), (r"^chief\s+(.+?)\s+officer$", r"\1 director"), (r"^team lead,?\s+(.+)$", r"\1 manager"),
    (r"^tech lead,?\s+(.+)$", r"\1 engineer"), (r"^associate,?\s+(.+)$", r"\1 associate"), (r"^manager\s+(.+)$", r"\1 manager"), (r"^director\s+(.+)$", r"\1 director"),
]
_head = lambda x, s: f"CASE WHEN contains({x}, '{s}') THEN trim(string_split({x}, '{s}')[1]) END"
CANONICAL = {
    **TT,
    **DELEVEL,
    "forms0": f"SELECT title, plain, {_stripped('plain')[0]} AS seniority, {_stripped('plain')[1]} AS bare FROM dl WHERE NOT ("
    + " OR ".join(f"contains(translate(lower(title), '‘’', ''''''), '{p.replace(chr(39), chr(39) * 2)}')" for p in titles.SKIPPED) + ")",
    "forms": "SELECT title, 0 AS form, plain AS x FROM forms0 UNION ALL SELECT title, 1, bare FROM forms0",
    "turned": "SELECT *, CASE " + " ".join(f"WHEN regexp_matches(x, {_quoted(p)}) THEN regexp_replace(x, {_quoted(p)}, '{to}')" for p, to in REWRITES) + " END AS r FROM forms",
    "targets": f"SELECT title, form, unnest([0, 1, 2, 3]) AS i, string_split(unnest([x, {_head('x', ',')}, r, {_head('r', ',')}]), ' ') AS w FROM turned",
    "found_keys": f"SELECT title, form, unnest([0, 1, 2, 3, 4]) AS p, unnest([x, {_head('x', ',')}, {_head('x', ' - ')}, r, {_head('r', ',')}]) AS key FROM turned UNION ALL "
    f"SELECT title, form, 5 + 4 * i + 5 - n, array_to_string(w[len(w) - n + 1:], ' ') FROM targets, (VALUES (5), (4), (3), (2)) c(n) WHERE len(w) >= n AND regexp_matches(array_to_string(w, ' '), '{e.SUFFIXES}')",
    "aliases": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', {repr(c) if c else 'NULL'})" for a, c in ALIASES) + ") a(alias, canonical_id)",
    "by_key": "SELECT title, arg_min(coalesce(canonical_id, ''), form * 100 + p) AS c FROM found_keys JOIN aliases ON alias = key GROUP BY title",
    "by_part": "SELECT title, arg_min(canonical_id, (-length(alias), alias)) AS c FROM forms0 JOIN aliases ON length(alias) >= 6 AND canonical_id IS NOT NULL AND contains(plain, alias) WHERE title NOT IN (SELECT title FROM by_key) GROUP BY title",
    "by_end": "SELECT title, arg_max(c.id, length(c.s)) AS c FROM forms0 JOIN (VALUES " + ", ".join(f"('{s}', '{c}')" for s, c in DEFAULTS) + ") c(s, id) ON plain = c.s OR ends_with(plain, ' ' || c.s) "
    "WHERE title NOT IN (SELECT title FROM by_key) AND title NOT IN (SELECT title FROM by_part) GROUP BY title",
}
TITLE_RULES = [(1, r"^(?:vp|chief|head of)\b", "executive"), (2, r"\bintern(?:ship)?\b", "intern"), (3, r"machine learning.*(?:engineer|scientist)", "research"), (4, r"\bdata\b", "data"), (5, r"(?:manager|officer)\b", "management"), (6, r"[^ -~]", "foreign")]


def title_query(run):
    return lambda spark, sf_dir: run(order_titles(spark, sf_dir))


def star_query(run):
    return lambda spark, sf_dir: run(from_tables(spark, sf_dir))


# Places of all customers: eight shapes by remainders of the key.
PLACES = ["Remote", "%s", "Springfield, %s", "%s - Springfield", "Remote - %s", "Lisbon", "near %s today", "Porto / Lisbon (office)", "nowhere", "greater Lisbon area"]
CITIES = [("lisbon", "Portugal"), ("porto", "Portugal")]


def customer_places(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    rows = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.replace(_nth(PLACES, F.col("c_custkey")), F.lit("%s"), F.col("n_name")).alias("location")).distinct()


PL = {"pl": f"SELECT DISTINCT replace({_sql_nth(PLACES, 'c_custkey')}, '%s', n_name) AS location FROM customer JOIN nation ON n_nationkey = c_nationkey"}


def countries(spark, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("alias"), F.col("n_name").alias("country"))
    return e.countries(customer_places(spark, sf_dir), names, spark.createDataFrame(CITIES, "city string, country string"))


STATES, SOME_STATES = [("tx", "United States"), ("on", "Canada")], ["TX", "", "ON", "ZZ", "tx"]


def normalized(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    rows = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    place = lambda key: F.replace(_nth(PLACES, key), F.lit("%s"), F.col("n_name"))
    rows = rows.select(F.concat(place(F.col("c_custkey") * 7 + 4), F.when(F.col("c_custkey") % 6 == 1, " (remote)").otherwise("")).alias("location_country"), _nth(SOME_STATES, F.col("c_custkey")).alias("location_state"), F.when(F.col("c_custkey") % 4 < 2, place(F.col("c_custkey"))).otherwise("nowhere").alias("location_raw"))
    names = read("nation").select(F.col("n_name").alias("alias"), F.col("n_name").alias("country"))
    return e.normalized_countries(rows, names, spark.createDataFrame(CITIES, "city string, country string"), spark.createDataFrame(STATES, "state string, country string"))


WIDE = f"""SELECT replace({_sql_nth(PLACES, '(c_custkey * 7 + 4)')}, '%s', n_name) || CASE WHEN c_custkey % 6 = 1 THEN ' (remote)' ELSE '' END AS location_country, {_sql_nth(SOME_STATES, 'c_custkey')} AS location_state,
  CASE WHEN c_custkey % 4 < 2 THEN replace({_sql_nth(PLACES, 'c_custkey')}, '%s', n_name) ELSE 'nowhere' END AS location_raw FROM customer JOIN nation ON n_nationkey = c_nationkey"""
PLACED = {
    "parts_of": "SELECT location, unnest(regexp_split_to_array(lower(location), '\\s*[,/|;()]\\s*|\\s+-\\s+')) AS part FROM pl",
    "placed": """SELECT location, arg_min(country, p * 1000 - k) AS country, CASE min(p) WHEN 0 THEN 'remote' WHEN 1 THEN 'alias' WHEN 2 THEN 'part' WHEN 3 THEN 'city' WHEN 4 THEN 'inside' WHEN 5 THEN 'word' END AS how FROM (
      SELECT location, NULL AS country, NULL AS p, 0 AS k FROM pl UNION ALL
      SELECT location, 'Remote', 0, 0 FROM pl WHERE regexp_matches(location, '(?i)\\b(remote|anywhere|distributed|worldwide)\\b') AND NOT regexp_matches(location, '[-,(]') UNION ALL
      SELECT location, n_name, 1, length(n_name) FROM pl JOIN nation ON lower(location) = lower(n_name) UNION ALL
      SELECT location, n_name, 2, length(n_name) FROM parts_of JOIN nation ON part = lower(n_name) AND part <> lower(location) UNION ALL
      SELECT location, c.country, 3, length(c.city) FROM parts_of JOIN (VALUES ('lisbon', 'Portugal'), ('porto', 'Portugal')) c(city, country) ON part = c.city UNION ALL
      SELECT location, c.country, 4, length(c.city) FROM pl JOIN (VALUES ('lisbon', 'Portugal'), ('porto', 'Portugal')) c(city, country) ON contains(lower(location), c.city) UNION ALL
      SELECT location, n_name, 5, length(n_name) FROM (SELECT location, unnest(regexp_split_to_array(lower(location), '[^\\p{L}\\p{N}.]+')) AS part FROM pl) JOIN nation ON part = lower(n_name)) GROUP BY location""",
}


# Words and runs of words of all documents.


def words_of_documents(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", "lang", e.tokens(F.col("text")).alias("w"))


def vocabulary(spark, sf_dir: str) -> DataFrame:
    """(term, skill_id): runs of one to six words from every fifth word of all benchmark items, single ones of six letters
    or more, as a skill dictionary."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", e.tokens(F.col("text")).alias("w"))
    spots = items.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(5))).alias("p")).withColumn("n", (F.col("p") / 5 % 6 + 1).cast("int")).filter(F.size("w") >= F.col("p") + F.col("n"))
    terms = spots.select(F.array_join(F.slice("w", F.col("p") + 1, F.col("n")), " ").alias("term"), F.col("p").cast("long").alias("skill_id"), "n")
    return terms.filter("n > 1 or char_length(term) >= 6").select("term", "skill_id").distinct()


WORDS = {
    "dw": "SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS w FROM documents",
    "spots": "SELECT doc_id, lang, w, unnest(w) AS t, generate_subscripts(w, 1) AS pos FROM dw",
}
VOCABULARY = {
    **WORDS,
    "items": "SELECT list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS bw FROM benchmark",
    "starts": "SELECT bw, unnest(range(0, len(bw), 5)) AS p FROM items",
    "vocab": "SELECT DISTINCT array_to_string(bw[p + 1:p + p // 5 % 6 + 1], ' ') AS term, p // 5 % 6 + 1 AS k, p AS skill_id FROM starts WHERE len(bw) >= p + p // 5 % 6 + 1 AND (p // 5 % 6 > 0 OR length(bw[p + 1]) >= 6)",
    "tagged": "SELECT doc_id AS id, skill_id, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT doc_id, skill_id FROM spots JOIN vocab ON k = {k} AND len(w) >= pos + {k - 1} AND array_to_string(w[pos:pos + {k - 1}], ' ') = term" for k in range(1, 7)) + ") GROUP BY ALL",
}


def tag_documents(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return e.tag_skills(docs, vocabulary(spark, sf_dir))


def similar_words(spark, sf_dir: str) -> DataFrame:
    """All words of the documents and names of parts, against each other."""
    words = words_of_documents(spark, sf_dir).select(F.explode("w").alias("name"))
    return e.similar_names(words.unionByName(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("name"))), 0.88)


# Names of skills in many shapes.
ENDINGS = [" api", " leadership", " server", "db", "script", " tools", " Communication skills", " and SQL", "/ci", "-of-the-art", " REST", "  KAFKA"]


def shaped_names(s: Star) -> DataFrame:
    each = s.skills.select("id", "name", F.explode(F.array(*map(F.lit, ENDINGS))).alias("ending"))
    return each.select("id", F.concat("name", "ending").alias("name"))


SHAPED = {"shaped": "SELECT id, name || unnest([" + ", ".join(f"'{x}'" for x in ENDINGS) + "]) AS name FROM skills"}
#: The kind of each of ENDINGS, by hand; the skills' own names are words of neither kind.
KINDS = """CASE WHEN ends_with(name, ' api') OR ends_with(name, ' and SQL') OR ends_with(name, ' REST') OR ends_with(name, 'KAFKA') OR ends_with(name, 'db') THEN 'technical'
  WHEN ends_with(name, ' leadership') OR ends_with(name, ' Communication skills') THEN 'soft' ELSE 'domain' END"""


def _cased(w: str) -> str:
    return "CASE lower(" + w + ") " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in skills.CASING.items()) + " END"


def _in(w: str, words: list[str]) -> str:
    return f"lower({w}) IN (" + ", ".join(f"'{x}'" for x in words) + ")"


_capital = lambda w: f"upper({w}[1]) || lower({w}[2:])"
_titled = lambda w: f"CASE WHEN {w} = upper({w}) AND {w} <> lower({w}) THEN {_capital(w)} ELSE upper({w}[1]) || {w}[2:] END"
_word = lambda w, small: f"coalesce({_cased(w)}, CASE WHEN {_in(w, skills.ACRONYMS)} THEN upper({w}) {small} ELSE {_titled(w)} END)"
_small = lambda w: f"WHEN i > 1 AND {_in(w, skills.SMALL_WORDS)} THEN lower({w})"
DISPLAY = {
    **SHAPED,
    "tidy": "SELECT id, name, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS n FROM shaped",
    "pieces": "SELECT id, name, n, CASE WHEN contains(n, '/') THEN '/' WHEN contains(n, '-') AND NOT contains(n, ' ') THEN '-' ELSE ' ' END AS sep FROM tidy",
    "each_piece": "SELECT *, unnest(string_split(n, sep)) AS w, generate_subscripts(string_split(n, sep), 1) AS i FROM pieces",
    "shown": f"""SELECT id, name, n, sep, i, CASE sep WHEN '/' THEN {_word('trim(w)', '')} WHEN '-' THEN CASE WHEN {_in('w', skills.ACRONYMS)} THEN upper(w) {_small('w')} ELSE {_capital('w')} END ELSE {_word('w', _small('w'))} END AS piece FROM each_piece""",
}
CLEAN = {
    **SHAPED,
    "cl1": f"SELECT name, trim(regexp_replace(trim(regexp_replace(trim('the strong ' || name || ' (any)'), '\\s*\\(.*?\\)\\s*$', '', 'g')), '{skills.FRONT}', '', 'g')) AS c FROM shaped",
    "cl2": f"SELECT name, c, trim(regexp_replace(c, '{skills.END}', '', 'g')) AS s FROM cl1",
    "cl3": "SELECT name, regexp_replace(trim(CASE WHEN length(s) >= 2 THEN s ELSE c END), '\\.+$', '') AS c FROM cl2",
}

ENTRIES: dict[str, tuple] = {
    "x07_display_names": (
        star_query(lambda s: shaped_names(s).select("id", "name", skills.display_name(F.col("name")).alias("shown"))),
        sql(f"SELECT id, name, coalesce({_cased('n')}, CASE WHEN {_in('n', skills.ACRONYMS)} THEN upper(n) ELSE CASE sep WHEN '/' THEN string_agg(piece, '/' ORDER BY i) WHEN '-' THEN string_agg(piece, '-' ORDER BY i) ELSE string_agg(piece, ' ' ORDER BY i) END END) AS shown FROM shown GROUP BY id, name, n, sep", DISPLAY),
    ),
    "x08_tag_documents": (tag_documents, sql("SELECT * FROM tagged", VOCABULARY)),
    "x10_confidence": (
        lambda spark, sf_dir: tag_documents(spark, sf_dir).select("id", "skill_id", e.confidence(F.col("n"), F.col("id") % 2 == 0).alias("confidence")),
        sql("SELECT id, skill_id, CASE WHEN n >= 3 THEN 95 WHEN n = 2 THEN 85 ELSE 70 END - CASE WHEN id % 2 = 0 THEN 10 ELSE 0 END AS confidence FROM tagged", VOCABULARY),
    ),
    "x13_clean_candidates": (
        star_query(lambda s: shaped_names(s).select("name", skills.clean_candidate(F.concat(F.lit("the strong "), "name", F.lit(" (any)"))).alias("clean"))),
        sql(
            "SELECT name, CASE WHEN NOT (length(c) NOT BETWEEN 2 AND 50 OR NOT regexp_matches(c, '[A-Za-z]') OR len(regexp_split_to_array(c, '\\s+')) > 6 OR lower(c) IN (" + ", ".join(f"'{x}'" for x in skills.NOT_SKILLS) + ")"
            + "".join(f" OR regexp_matches(c, '{p}')" for p in skills.NO_NAME) + ") THEN c END AS clean FROM cl3",
            CLEAN,
        ),
    ),
    "x14_noise_candidates": (
        star_query(lambda s: shaped_names(s).unionByName(s.skills.select("id", F.concat(F.lit("Design a "), "name").alias("name"))).unionByName(s.skills.select("id", F.concat("name", F.lit(" preferred")).alias("name"))).filter(~skills.is_noise_candidate(F.col("name")))),
        sql(
            "SELECT * FROM (SELECT * FROM shaped UNION ALL SELECT id, 'Design a ' || name FROM skills UNION ALL SELECT id, name || ' preferred' FROM skills) WHERE length(trim(name)) BETWEEN 3 AND 70 AND NOT regexp_matches(trim(name), '(?i)^(?:"
            + skills.DUTIES + f")\\b') AND NOT regexp_matches(trim(name), '{skills.FRAGMENTS}') AND NOT regexp_matches(trim(name), {_quoted(skills.OFF_TOPIC)}) AND len(regexp_split_to_array(trim(name), '\\s+')) <= 8",
            SHAPED,
        ),
    ),
    "x16_candidate_kinds": (star_query(lambda s: shaped_names(s).select("name", e.candidate_kind(F.col("name")).alias("kind"))), sql(f"SELECT name, {KINDS} AS kind FROM shaped", SHAPED)),
    "x17_matching_names": (lambda spark, sf_dir: e.similar_names(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat("p_name", F.lit(" "), F.col("p_type")).alias("name")), 0.93, measure="blocks"), None),
    "x17_similar_names": (similar_words, None),
    "x18_canonical_names": (
        star_query(lambda s: e.canonical_names(shaped_names(s).select("name"), s.skills.filter("id % 4 <> 0").select(F.upper(F.concat("name", F.lit(" API"))).alias("synonym"), F.concat(F.lit("set "), F.floor(F.col("id") / 3).cast("string")).alias("canonical")))),
        sql("SELECT s.name, coalesce('set ' || CAST(k.id // 3 AS VARCHAR), lower(s.name)) AS canonical FROM shaped s LEFT JOIN skills k ON k.id % 4 <> 0 AND lower(k.name || ' api') = lower(s.name)", SHAPED),
    ),
    "x19_parse_locations": (
        lambda spark, sf_dir: customer_places(spark, sf_dir).select("location", places.parse(F.col("location")).alias("p")).select("location", "p.*"),
        sql(
            """SELECT location, CASE WHEN away THEN '' ELSE parts[1] END AS city, CASE WHEN away THEN '' WHEN len(parts) >= 3 THEN parts[2] WHEN code THEN upper(parts[2]) ELSE '' END AS state,
            CASE WHEN away THEN CASE WHEN len(string_split(location, ' - ')) > 1 THEN trim(string_split(location, ' - ')[2]) WHEN len(string_split(location, ', ')) > 1 THEN trim(string_split(location, ', ')[-1]) ELSE '' END
            WHEN len(parts) >= 3 THEN parts[3] WHEN code THEN 'US' WHEN len(parts) = 2 THEN parts[2] ELSE '' END AS country, away AS is_remote FROM (SELECT *, coalesce(upper(parts[2]) IN ("""
            + ", ".join(f"'{x}'" for x in places.US_STATES)
            + """), false) AS code FROM (SELECT location, regexp_matches(location, '(?i)\\b(remote|anywhere|distributed|worldwide)\\b') AS away, list_transform(string_split(location, ','), lambda x: trim(x)) AS parts FROM pl))""",
            PL,
        ).replace("\\\\b", "\\b"),
    ),
    "x20_countries": (countries, sql("SELECT location, country, how FROM placed", {**PL, **PLACED})),
    "x20_normalized_countries": (
        normalized,
        sql(
            """SELECT DISTINCT location_country, location_state, location_raw, coalesce(r.country, v.n_name, CASE lower(trim(regexp_replace(location_country, '(?i)(?: \\((?:hybrid|remote)\\)| - (?:hybrid|remote)| (?:hybrid|remote))$', ''))) WHEN 'lisbon' THEN 'Portugal' WHEN 'porto' THEN 'Portugal' END, c.country,
            CASE upper(location_state) WHEN 'TX' THEN 'United States' WHEN 'ON' THEN 'Canada' END) AS country FROM wide LEFT JOIN placed r ON r.location = location_raw LEFT JOIN placed c ON c.location = location_country
            LEFT JOIN nation v ON lower(v.n_name) = lower(trim(regexp_replace(location_country, '(?i)(?: \\((?:hybrid|remote)\\)| - (?:hybrid|remote)| (?:hybrid|remote))$', '')))""",
            {"wide": WIDE, "pl": "SELECT DISTINCT location FROM (SELECT location_raw AS location FROM wide UNION ALL SELECT location_country FROM wide)", **PLACED},
        ),
    ),
    "x23_seniority": (title_query(lambda t: t.select("title", titles.seniority(F.col("title")).alias("level"))), sql(f"SELECT title, {_case('l', titles.LEVELS, repr('mid'))} AS level FROM tt", TT)),
    "x24_delevel": (title_query(lambda t: t.select("title", titles.delevel(F.col("title")).alias("plain"))), sql("SELECT title, plain FROM dl", {**TT, **DELEVEL})),
    "x25_strip_level": (
        title_query(lambda t: t.select("title", titles.strip_level(F.col("title"))[0].alias("level"), titles.strip_level(F.col("title"))[1].alias("bare"))),
        sql(f"SELECT title, {_stripped('l')[0]} AS level, {_stripped('l')[1]} AS bare FROM tt", TT),
    ),
    "x26_canonical_titles": (
        title_query(lambda t: e.canonical_titles(t, t.sparkSession.createDataFrame(ALIASES, "alias string, canonical_id string"), t.sparkSession.createDataFrame(DEFAULTS, "suffix string, canonical_id string"))),
        sql(
            """SELECT f.title, nullif(coalesce(a.c, b.c, d.c), '') AS canonical_id, CASE WHEN a.c IS NOT NULL THEN 'key' WHEN b.c IS NOT NULL THEN 'substring' WHEN d.c IS NOT NULL THEN 'suffix' END AS how, seniority
            FROM forms0 f LEFT JOIN by_key a USING (title) LEFT JOIN by_part b USING (title) LEFT JOIN by_end d USING (title)""",
            CANONICAL,
        ),
    ),
    "x27_rule_titles": (
        title_query(lambda t: e.rule_titles(t, t.sparkSession.createDataFrame(TITLE_RULES, "priority int, pattern string, label string"))),
        sql("SELECT title, " + _case("l", [(p, n) for _, p, n in TITLE_RULES]) + " AS label, CAST(" + _case("l", [(p, str(i)) for i, p, _ in TITLE_RULES]) + " AS INT) AS rule FROM tt WHERE label IS NOT NULL", TT),
    ),
    "x28_noise_titles": (
        title_query(lambda t: t.filter(titles.is_noise(F.col("title")))),
        sql(f"SELECT title FROM tt WHERE length(trim(title)) NOT BETWEEN 3 AND 120 OR length(regexp_replace(title, '[\\x00-\\x7F]', '', 'g')) / length(title) > 0.3 OR regexp_matches(title, {_quoted(titles.NOISE)})", TT),
    ),
    "x29_preclassified": (
        title_query(
            lambda t: e.preclassified(t, t.sparkSession.createDataFrame([("volunteer",), ("Élève",)], "phrase string"), t.sparkSession.createDataFrame([(1, "data engineer", "Data Engineer"), (2, "manager", "Manager"), (3, "data", "Analyst")], "priority int, phrase string, role string"))
        ),
        sql(
            """SELECT title, action, CASE WHEN action = 'map_to' THEN role END AS role FROM (SELECT title, role, CASE WHEN length(regexp_replace(title, '[\\x00-\\x7F]', '', 'g')) / length(title) > 0.15 OR contains(l, 'volunteer') OR contains(l, 'élève') THEN 'skip' WHEN role IS NOT NULL THEN 'map_to' ELSE 'review' END AS action
            FROM (SELECT *, CASE WHEN contains(l, 'data engineer') THEN 'Data Engineer' WHEN contains(l, 'manager') THEN 'Manager' WHEN contains(l, 'data') THEN 'Analyst' END AS role FROM tt))""",
            TT,
        ),
    ),
    "x30_mapped_candidates": (
        title_query(
            lambda t: e.mapped_candidates(
                t, t.sparkSession.createDataFrame([(1, "Data Engineer"), (2, "Product Manager"), (3, "Machine Learning"), (4, "Sales Operations")], "id long, normalized_title string"),
                t.sparkSession.createDataFrame([("quality / test", 5), ("senior data", 6), ("data officer", 7)], "pattern string, role_id long"), ["general", "talent pool"],
            )
        ),
        sql(
            """SELECT title, verdict, CAST(CASE WHEN verdict = 'mapped' THEN role_id END AS BIGINT) AS role_id, CASE WHEN verdict = 'mapped' THEN how END AS how FROM (SELECT *, CASE WHEN length(regexp_replace(title, '[\\x00-\\x7F]', '', 'g')) / length(title) > 0.15 OR regexp_matches(l, '\\bintern\\b') OR contains(l, 'general') OR contains(l, 'talent pool') OR length(trim(title)) < 4 THEN 'rejected' WHEN role_id IS NOT NULL THEN 'mapped' ELSE 'unmapped' END AS verdict
            FROM (SELECT title, l, CASE WHEN contains(l, 'quality / test') THEN 5 WHEN contains(l, 'data officer') THEN 7 WHEN contains(l, 'senior data') THEN 6 WHEN n = 'data engineer' THEN 1 WHEN n = 'product manager' THEN 2 WHEN starts_with(n, 'sales operations') OR starts_with(n, 'machine learning') OR starts_with(n, 'product manager') OR starts_with(n, 'data engineer') THEN CASE n[1] WHEN 's' THEN 4 WHEN 'm' THEN 3 WHEN 'p' THEN 2 ELSE 1 END
              WHEN contains(n, 'machine learning') THEN 3 WHEN contains(n, 'sales operations') THEN 4 WHEN contains(n, 'product manager') THEN 2 WHEN contains(n, 'data engineer') THEN 1 END AS role_id,
              CASE WHEN contains(l, 'quality / test') OR contains(l, 'data officer') OR contains(l, 'senior data') THEN 'explicit' WHEN n IN ('data engineer', 'product manager', 'machine learning', 'sales operations') THEN 'equal' WHEN regexp_matches(n, '^(?:sales operations|machine learning|product manager|data engineer)') THEN 'prefix' ELSE 'substring' END AS how
              FROM (SELECT *, lower(trim(regexp_replace(regexp_replace(title, '\\([^)]*\\)', ' ', 'g'), '\\s+', ' ', 'g'))) AS n FROM tt)))""",
            TT,
        ),
    ),
    "x43_intrinsic": (
        star_query(lambda s: e.intrinsic(s.skills, s.roles.join(s.skills.select((F.col("id") - 1).alias("id"), "name"), "id").withColumn("normalized_title", F.concat("name", F.lit(" Engineer"))), ["small ring"])),
        sql(
            """SELECT DISTINCT role_id, s.id AS skill_id FROM (SELECT r.id AS role_id, unnest(string_split(lower(k.name || ' Engineer'), ' ')) AS word FROM roles r JOIN skills k ON k.id = r.id + 1) JOIN skills s ON lower(s.name) = 'small ring' OR (length(word) > 3 AND contains(lower(s.name), word))"""
        ),
    ),
    "f03_places": (
        lambda spark, sf_dir: customer_places(spark, sf_dir).select(F.col("location").alias("location_country"), F.col("location").alias("location_raw")).filter(filters.place(["NATION_1", "Portugal"], aliases={"lisbon": "Portugal"})).select("location_raw"),
        sql("SELECT location AS location_raw FROM pl WHERE contains(lower(location), 'nation_1') OR contains(lower(location), 'portugal') OR contains(lower(location), 'lisbon')", PL),
    ),
}


def queries() -> dict:
    return {name: run for name, (run, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in ENTRIES.items() if text}
