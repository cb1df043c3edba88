"""Bulk enrichment: sections, skill tags, candidate skills, canonical titles, locations, salaries.

Rules run on the distinct titles, places or texts and are joined back, so that frequent values are worked out once.
Rule and alias tables are small; Spark broadcasts them if their size allows.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laborlens.functions import places, titles
from laborlens.functions.headers import HEADERS, header
from laborlens.functions.markup import foreign_share
from laborlens.functions.skills import DUTIES, clean_candidate
from laborlens.operators import rules

#: What makes a paragraph likely to state requirements, and unlikely, with weights.
HINTS = [
    (r"\b\d+\+?\s*years?\s+of\s+experience\b", 3.0),
    (r"\bexperience\s+(?:with|in)\b", 2.5),
    (r"\bproficien(?:t|cy)\s+in\b", 2.5),
    (r"\bknowledge\s+of\b", 2.0),
    (r"\bfamili(?:ar|arity)\s+with\b", 2.0),
    (r"\b(?:bachelor|master|phd|m\.s|b\.s|degree|certification)\b", 2.0),
    (r"\b(?:must|required?)\b", 1.5),
    (r"\bability\s+to\b", 1.5),
    (r"\bunderstand(?:ing)?\s+of\b", 1.0),
    (r"\btrack\s+record\b", 1.0),
    (r"\bproven\b", 1.0),
    (r"\b(?:salary|equity|vacation|pto|dental|vision|401k|parental\s+leave|health\s+insurance|stock\s+options)\b", -4.0),
    (r"\b(?:equal\s+opportunity|disability|accommodation|eeo|affirmative\s+action)\b", -4.0),
    (r"\b(?:we\s+are|our\s+mission|who\s+we\s+are|about\s+us|our\s+team|our\s+culture)\b", -3.0),
    (r"\b(?:founded|headquartered|series\s+[a-e]|venture|funding|investors?)\b", -2.0),
    (r"\b(?:join\s+us|come\s+work|we\s+offer|we\s+provide|we\s+believe)\b", -1.5),
]


def sections(docs: DataFrame, headers: dict[str, list[str]] = HEADERS) -> DataFrame:
    """``docs`` (id, text) as (id, n, name, start, stop, body): what stands under each header, ``unknown`` before any.

    A header is a line that begins, behind signs and white space, with a pattern of ``headers``, and goes on for no more
    than 60 characters; the first class that fits gives the name, so no two headers overlap. start and stop are the
    section's place in the text, in code points.
    """
    text = F.translate("text", "‘’\u00a0", "'' ")
    lines = docs.select("id", F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    name = F.lit(None).cast("string")
    for label, patterns in reversed(headers.items()):
        name = F.when(F.col("line").rlike(header(patterns)), label).otherwise(name)
    order = W.partitionBy("id").orderBy("pos")
    lines = lines.withColumn("header", name).withColumn("end", F.sum(F.char_length("line") + 1).over(order))
    lines = lines.withColumn("n", F.count("header").over(order)).withColumn("name", F.coalesce(F.last("header", ignorenulls=True).over(order), F.lit("unknown")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n")
    start = F.min(F.col("end") - F.char_length("line") - 1)
    parts = lines.filter("header is null").groupBy("id", "n", "name").agg(start.alias("start"), (F.max("end") - 1).alias("stop"), body.alias("body"))
    return parts.filter("trim(body) <> ''").select("id", "n", "name", "start", "stop", "body")


def paragraph_score(p: Column) -> Column:
    """Sum of the hints, more for paragraphs of mostly bullets."""
    rows = F.filter(F.transform(F.split(p, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    n = F.greatest(F.size(rows), F.lit(1))
    bullets = F.size(F.filter(rows, lambda x: x.rlike(r"^[-•*·]"))) / n
    width = F.aggregate(rows, F.lit(0), lambda a, x: a + F.char_length(x)) / n
    score = sum((F.when(p.rlike("(?i)" + pattern), w).otherwise(0.0) for pattern, w in HINTS), F.lit(0.0))
    return score + F.when(bullets > 0.5, bullets * 2.0).otherwise(0.0) + F.when((width < 80) & (bullets > 0.3), 1.0).otherwise(0.0)


def requirements(docs: DataFrame, least: float = 2.0) -> DataFrame:
    """(id, text, used_fallback): requirement and preferred sections; failing these, paragraphs that score
    enough, of sections other than benefits, company and legal ones; failing these too, all text of those sections."""
    # A row a text with its sections in order, so that texts are cut into sections once.
    each = sections(docs).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "name", "body"))).alias("s"))
    joined = lambda parts, sep: F.when(F.size(parts) > 0, F.array_join(parts, sep))
    bodies = lambda names, has: F.transform(F.filter("s", lambda x: x["name"].isin(names) == has), lambda x: x["body"])
    stated = joined(bodies(["requirements", "preferred"], F.lit(True)), "\n")
    others = bodies(["benefits", "about_company", "boilerplate"], F.lit(False))
    paragraphs = F.flatten(F.transform(others, lambda x: F.transform(F.split(x, r"\n\s*\n"), lambda p: F.btrim(p, F.lit(" \t\r\n")))))
    scored = joined(F.filter(paragraphs, lambda p: paragraph_score(p) >= least), "\n\n")
    found = each.select("id", stated.isNull().alias("guess"), F.coalesce(stated, scored, joined(others, "\n\n")).alias("found"))
    return docs.join(found, "id", "left").select("id", F.coalesce("found", "text").alias("text"), F.coalesce("guess", F.lit(True)).alias("used_fallback"))


def is_valid_skill(name: Column) -> Column:
    """Between 2 and 100 characters with a letter and no underscore; r and c are skills as well."""
    n = F.trim(name)
    fine = F.char_length(n).between(2, 100) & n.rlike(r"\p{L}") & ~n.contains("_")
    return F.coalesce(F.lower(n).isin("r", "c") | fine, F.lit(False))


def skill_terms(skills: DataFrame, strict: list[str] = (), banned: list[str] = ()) -> DataFrame:
    """(term, skill_id) of verified skills' names and aliases, lower-cased, of two characters at least."""
    named = skills.filter("is_verified").select("id", F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("names"), F.lower("name").alias("lead"))
    terms = named.filter(~F.col("lead").isin(list(strict))).select(F.col("id").alias("skill_id"), F.explode("names").alias("name"))
    return terms.select(F.lower(F.trim("name")).alias("term"), "skill_id").filter((F.char_length("term") >= 2) & ~F.col("term").isin(list(banned))).distinct()


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


#: Nodes up to which a trie is sent to all tasks.
SMALL_TRIE = 200_000


def term_trie(terms: DataFrame) -> tuple[DataFrame, int]:
    """``terms`` (term) as a trie by words, and its depth. A node is the run of words that leads to it: (depth, run,
    goes_on, ends), telling whether longer terms begin with it and whether one ends there."""
    plain = terms.withColumn("w", tokens(F.col("term"))).filter(F.size("w") > 0).select("w").distinct()
    prefixes = plain.select(F.size("w").alias("words"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice("w", F.lit(1), i), " ").alias("run")))).alias("p"))
    nodes = prefixes.groupBy("p.depth", "p.run").agg(F.max(F.col("words") > F.col("p.depth")).alias("goes_on"), F.max(F.col("words") == F.col("p.depth")).alias("ends"))
    size = nodes.agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n")).first()
    return F.broadcast(nodes) if size.n <= SMALL_TRIE else nodes, size.depth or 0


def tag_skills(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, skill_id, n): whole-word occurrences of the terms in ``docs`` (id, text).

    A word is a run of letters, digits and underscores. The terms are a trie by words, a table of a row a node. Words of
    the texts, each with those behind it, meet its first level; where a longer term begins, one more word meets the trie a
    level: no run of words is built before its beginning has met. All levels are met in one pass over the texts. A term with signs in it (c++, node.js) is compared again as written, in the texts that have its words.
    """
    nodes, depth = term_trie(terms)
    if not depth:
        return docs.select("id", F.lit(None).cast("long").alias("skill_id"), F.lit(0).cast("long").alias("n")).filter("false")
    level = lambda k: nodes.filter(F.col("depth") == k).select(F.col("run").alias(f"run_{k}"), F.col("goes_on").alias("goes_on"), F.col("ends").alias(f"ends_{k}"))
    w = tokens(F.col("text"))
    met = docs.select("id", w.alias("w")).filter(F.size("w") > 0)
    met = met.select("id", F.explode(F.transform("w", lambda x, i: F.slice("w", i + 1, depth))).alias("words")).withColumn("run_1", F.get("words", F.lit(0))).join(level(1), "run_1")
    for k in range(2, depth + 1):
        word = F.get("words", F.lit(k - 1))
        # No node's run begins with a blank: what goes no further meets nothing, and lies with its first word.
        run = F.when(F.col("goes_on") & word.isNotNull(), F.concat_ws(" ", f"run_{k - 1}", word)).otherwise(F.concat(F.lit(" "), "run_1"))
        met = met.withColumn(f"run_{k}", run).drop("goes_on").join(level(k), f"run_{k}", "left")
    ended = F.filter(F.array(*(F.when(F.col(f"ends_{k}"), F.col(f"run_{k}")) for k in range(1, depth + 1))), lambda r: r.isNotNull())
    ended = met.select("id", F.explode(ended).alias("run")).groupBy("id", "run").agg(F.count(F.lit(1)).alias("n"))
    named = terms.select("term", "skill_id", F.array_join(tokens(F.col("term")), " ").alias("run"))
    counts = ended.join(named, "run").withColumn("exact", F.col("run") == F.col("term"))
    signed = counts.filter("not exact").join(docs.select("id", F.lower("text").alias("lower")), "id")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), F.regexp_replace("term", r"([^\p{L}\p{N}_\s])", r"\\$1"), F.lit(r"(?![\p{L}\p{N}_])"))
    checked = signed.withColumn("n", F.regexp_count("lower", pattern).cast("long")).filter("n > 0")
    both = counts.filter("exact").select("id", "skill_id", "n").unionByName(checked.select("id", "skill_id", "n"))
    return both.groupBy("id", "skill_id").agg(F.sum("n").alias("n"))


def strict_skills(docs: DataFrame, rules: list[tuple[int, str]]) -> DataFrame:
    """(id, skill_id, n) for skills that only count in context: occurrences of each skill's patterns added up."""
    by: dict[int, list[str]] = {}
    for skill, pattern in rules:
        by.setdefault(skill, []).append(pattern)
    counts = F.array(*(F.struct(F.lit(s).cast("long").alias("skill_id"), sum((F.regexp_count("text", F.lit(p)) for p in ps), F.lit(0)).cast("long").alias("n")) for s, ps in by.items()))
    return docs.select("id", F.explode(counts).alias("c")).select("id", "c.skill_id", "c.n").filter("n > 0")


def confidence(n: Column, used_fallback: Column) -> Column:
    """95, 85 or 70 by occurrences; ten less, and 50 at least, if the text was a guess."""
    sure = F.when(n >= 3, 95).when(n == 2, 85).otherwise(70)
    return F.when(used_fallback, F.greatest(sure - 10, F.lit(50))).otherwise(sure)


def extract_skills(docs: DataFrame, terms: DataFrame, whole: bool = False) -> DataFrame:
    """(id, skill_id, n, confidence, is_required). ``whole``: tag the text itself, as for resumes."""
    if whole:
        return _rated(tag_skills(docs.select("id", F.regexp_replace("text", r"\s+", " ").alias("text")), terms), F.lit(False))
    return tag_requirements(requirements(docs), terms)


def tag_requirements(text: DataFrame, terms: DataFrame) -> DataFrame:
    """Skills of what ``requirements`` gives; it is read more than once."""
    return _rated(tag_skills(text.select("id", "text"), terms).join(text.select("id", "used_fallback"), "id"), F.col("used_fallback"))


def _rated(tagged: DataFrame, guess: Column) -> DataFrame:
    sure = confidence(F.col("n"), guess)
    return tagged.select("id", "skill_id", "n", sure.alias("confidence"), (sure >= 80).alias("is_required"))


#: Leads after which a skill is named, and how long the name may be.
CONTEXTS = [
    ("ctx_exp", r"\bexperience\s+(?:with|in|using)\s+", 50),
    ("ctx_prof", r"\bproficien(?:t|cy)\s+(?:in|with)\s+", 50),
    ("ctx_know", r"\bknowledge\s+of\s+", 50),
    ("ctx_fam", r"\bfamili(?:ar(?:ity)?)\s+with\s+", 50),
    ("ctx_exp2", r"\bexpertise\s+in\s+", 50),
    ("ctx_hands", r"\bhands[- ]on\s+experience\s+with\s+", 50),
    ("ctx_built", r"\b(?:written|built|implemented|developed)\s+(?:in|with|using)\s+", 40),
    ("ctx_tools", r"\btools?\s+(?:like|such as|including)\s+", 50),
    ("ctx_tech", r"\btechnolog(?:y|ies)\s+(?:like|such as|including)\s+", 50),
    ("ctx_fw", r"\b(?:frameworks?|libraries|platforms?|languages?)\s+(?:like|such as|including)\s+", 50),
    ("ctx_wk", r"\bworking\s+knowledge\s+of\s+", 50),
    ("ctx_und", r"\bunderstanding\s+of\s+", 50),
    ("ctx_expo", r"\bexposure\s+to\s+", 50),
    ("ctx_cert", r"\b(?:certified\s+in|certification\s+in)\s+", 60),
]
#: A list of proper names; equal-opportunity wording, near which nothing is named; bullets.
PROPER = r"[A-Z]\w{1,30}(?:\.\w+)?"
LISTED = rf"\b(?i:using|with)\s+{PROPER}\s*,\s*({PROPER}(?:\s*,\s*{PROPER}){{0,5}})"
EQUAL = r"(?i)\b(?:equal\s+opportunity|affirmative\s+action|eeo|protected\s+class|unlawful\s+discriminat|applicable\s+law|criminal\s+histor|applicants?\s+with\s+disabilities)\b"
BULLET = r"^\s*[-•*·▪▸►✓✔○●]\s*(.+)"
BEFORE, AFTER = 100, 50


def _named(text: Column, pattern: str) -> Column:
    """What the first group of ``pattern`` catches in ``text``, unless equal-opportunity wording stands about it."""
    around = rf"(?s)(?<=(\A.{{0,{BEFORE - 1}}}|.{{{BEFORE}}})){pattern}(?=(.{{0,{AFTER}}}))"
    each = [F.regexp_extract_all(text, F.lit(around), F.lit(i)) for i in (1, 0, 3, 2)]
    near = F.filter(F.arrays_zip(*(e.alias(n) for e, n in zip(each, "abcd", strict=True))), lambda z: ~F.concat(z["a"], z["b"], z["c"]).rlike(EQUAL))
    return F.when(text.rlike(EQUAL), F.transform(near, lambda z: z["d"])).otherwise(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def _bullets(text: Column) -> Column:
    """Bullets that name something: one to eight words, the first with a capital, none of a duty's verbs."""
    items = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, BULLET, 1)), r"\.+$", ""))
    return F.filter(items, lambda x: x.rlike(r"^[^\p{Ll}]") & x.rlike(r"^(?:\S{2,}|\S+(?:\s+\S+){1,7})$") & ~x.rlike(rf"(?i)^(?:{DUTIES})\b"))


def _tagged(tag: str):
    return lambda n: F.struct(n.alias("raw"), F.lit(tag).alias("method"))


def mine_candidates(docs: DataFrame) -> DataFrame:
    """(id, name, method) of what ``docs`` (id, text) name as a skill, cleaned; lists are split."""
    text = F.col("text")
    named = rf"([A-Za-z0-9][A-Za-z0-9+#.\-/ ]{{1,%d}}?)(?=\s*[,;()\n]|$|\band\b|\bor\b)"
    found = [(tag, _named(text, "(?i)" + lead + named % most)) for tag, lead, most in CONTEXTS] + [("ctx_list", _named(text, LISTED)), ("bullet", _bullets(text))]
    each = F.flatten(F.array(*(F.transform(names, _tagged(tag)) for tag, names in found)))
    raw = docs.select("id", F.explode(each).alias("c")).select("id", F.explode(F.split("c.raw", r"[,;]\s+")).alias("raw"), "c.method")
    return raw.select("id", clean_candidate(F.col("raw")).alias("name"), "method").filter("name is not null").distinct()


#: What the name of a technical skill holds, what that of a soft one holds, and how technical ones end.
TECHNICAL = [
    "python", "java", "javascript", "typescript", "golang", "rust", "c++", "c#", "ruby", "scala", "kotlin", "swift", "php", "aws", "azure", "gcp", "kubernetes", "docker", "terraform", "ansible", "linux", "sql", "nosql", "spark", "kafka",
    "airflow", "dbt", "pytorch", "tensorflow", "scikit", "pandas", "numpy", "snowflake", "databricks", "bigquery", "redshift", "postgres", "mysql", "mongodb", "elasticsearch", "redis", "git", "ci/cd", "devops", "mlops", "api", "rest", "graphql",
    "grpc", "microservices", "agile", "scrum", "tdd", "siem", "firewall", "vpn", "tcp/ip", "iam", "oauth", "saml", "sdk", "llm", "nlp", "neural", "cloud", "serverless", "container", "firmware", "fpga", "pcb", "cad", "matlab", "plc", "tableau",
    "power bi", "looker", "salesforce", "hubspot", "marketo", "jira", "sap", "oracle", "workday", "network engineer", "hardware design", "hardware test", "cloud-native", "cloud native", "security scanning", "api development",
]
SOFT = ["communication", "leadership", "collaboration", "teamwork", "problem", "critical thinking", "emotional", "time management", "adaptability", "negotiation", "mentoring", "coaching", "storytelling", "stakeholder", "influencing"]
TECHNICAL_ENDS = ["js", ".js", "db", "ops", "sql", "sdk", "api", "net", "lang"]


def candidate_kind(name: Column) -> Column:
    """Technical or soft by what the name holds, technical by its ending, else domain."""
    n = F.lower(name)
    some = lambda tests: reduce(Column.__or__, tests)
    holds = lambda words: some(F.contains(n, F.lit(w)) for w in words)
    return F.when(holds(TECHNICAL), "technical").when(holds(SOFT), "soft").when(some(F.endswith(n, F.lit(w)) for w in TECHNICAL_ENDS), "technical").otherwise("domain")


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance as a share of the longer name."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b), F.lit(1))


#: Characters of the longest runs by which similar names meet.
GRAM = 6


def _padded_grams(c: Column, q: int) -> Column:
    """The distinct runs of ``q`` characters of a name, in any case, between spaces."""
    padded = F.concat(F.lit(" " * (q - 1)), F.lower(c), F.lit(" " * (q - 1)))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(padded) - q + 1), lambda i: padded.substr(i, F.lit(q))))


def block_ratio(least: float):
    """A column function (a, b): twice the characters in matching blocks as a share of both names' characters: the longest
    common block, then those before and behind it. Null below ``least``, which counts of characters tell first."""

    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        out, matcher, last = [], SequenceMatcher(autojunk=False), None
        for x, y in zip(a, b, strict=True):
            if y != last:
                matcher.set_seq2(y)  # what it keeps is kept for the second
                last = y
            matcher.set_seq1(x)
            out.append(matcher.ratio() if matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least else None)
        return pd.Series(out, dtype="float64")

    return of


def similar_names(names: DataFrame, least: float = 0.88, gap: int = 20, measure: str = "edits") -> DataFrame:
    """(a, b, ratio) of distinct ``names`` (name), a before b, at least so similar, in any case, by ``measure``: edits
    (one less the edit distance as a share of the longer) or blocks (matching blocks as a share of both).

    Only names that share one of their rarest runs of q characters are compared. A name of n characters has n + q - 1,
    spaces around it counted; an edit spoils q, and so does a character outside matching blocks, of which both names
    together have no more than 2 n (1 - least) / least; similar names agree in one of the rarest q times that + 1. Runs
    are as long, up to GRAM, as leaves one unspoilt whatever the name's length.
    """
    share = (1 - least) * (2 if measure == "blocks" else 1)
    q = max(int(1 / max(share, 1 / GRAM) + 1e-9), 1)
    each = names.select("name").distinct().withColumn("len", F.char_length(F.lower("name")))
    grams = each.select("name", "len", F.explode(_padded_grams(F.col("name"), q)).alias("g"))
    counts = grams.groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    spoilt = F.floor(F.lit(share) * (F.col("len") / F.lit(least)) + 1e-9)
    ranked = grams.join(counts, "g").withColumn("r", F.row_number().over(W.partitionBy("name").orderBy("c", "g"))).filter(F.col("r") <= q * spoilt + 1)
    # Lengths tell most pairs apart, and do so where they meet: an edit changes a length by one at most.
    side = lambda n: ranked.select(F.col("name").alias(n), "g", F.col("len").alias(f"l_{n}"))
    x, y = F.col("l_a"), F.col("l_b")
    alike = (2 * F.least(x, y) >= least * (x + y) - 1e-9) if measure == "blocks" else (F.abs(x - y) <= (1 - least) * F.greatest(x, y) + 1e-9)
    met = side("a").join(side("b"), "g").filter((F.col("a") < F.col("b")) & alike & (F.abs(F.char_length("a") - F.char_length("b")) <= gap))
    if measure == "blocks":
        close = met.select("a", "b").distinct().withColumn("ratio", block_ratio(least)(F.lower("a"), F.lower("b"))).filter(F.col("ratio") >= least)
    else:  # few of those that meet are similar
        close = met.select("a", "b", similarity(F.lower("a"), F.lower("b")).alias("ratio")).filter(F.col("ratio") >= least).distinct()
    return close.withColumn("ratio", F.round("ratio", 4))


def _grams(text: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters of a text, or the text itself if it is shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(text) - n + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: text.substr(i, F.lit(n))))


def holding(names: DataFrame, parts: DataFrame, least: int) -> DataFrame:
    """(name, part) wherever a part of ``least`` characters at least stands in a name, in any case.

    ``names`` (name), ``parts`` (part). Both meet on a part's first ``least`` characters and are compared then, so the
    work follows the places at which a part may begin.
    """
    each = names.select("name").distinct().select("name", F.explode(_grams(F.lower("name"), least)).alias("gram"))
    short = parts.select("part").distinct().filter(F.char_length("part") >= least).select("part", F.lower(F.substring("part", 1, least)).alias("gram"))
    return each.join(short, "gram").filter(F.lower("name").contains(F.lower("part"))).select("name", "part").distinct()


def in_taxonomy(candidates: DataFrame, known: DataFrame, least: float = 0.88) -> DataFrame:
    """(name, known, how): equal, one inside the other (the shorter of four characters at least), or similar."""
    c, k = candidates.select("name").distinct(), known.select(F.col("name").alias("known")).distinct()
    exact = c.join(k, F.lower("name") == F.lower("known")).withColumn("how", F.lit(1))
    rest = c.join(exact.select("name"), "name", "left_anti")
    inside = holding(rest, k.withColumnRenamed("known", "part"), 4).withColumnRenamed("part", "known")
    around = holding(k.withColumnRenamed("known", "name"), rest.withColumnRenamed("name", "part"), 4).select(F.col("part").alias("name"), F.col("name").alias("known"))
    parts = inside.unionByName(around).withColumn("how", F.lit(2))
    near = similar_names(c.unionByName(k.withColumnRenamed("known", "name")), least, 15)
    both = near.select(F.col("a").alias("name"), F.col("b").alias("known")).unionByName(near.select(F.col("b").alias("name"), F.col("a").alias("known")))
    close = both.join(c, "name", "left_semi").join(k, "known", "left_semi").select("name", "known", F.lit(3).alias("how"))
    all_ = exact.unionByName(parts).unionByName(close)
    best = all_.groupBy("name").agg(F.min(F.struct("how", "known")).alias("b"))
    return best.select("name", F.col("b.known").alias("known"), F.element_at(F.array(F.lit("exact"), F.lit("substring"), F.lit("similar")), F.col("b.how")).alias("how"))


def canonical_names(names: DataFrame, synonyms: DataFrame) -> DataFrame:
    """``names`` (name) with the canonical name of their synonym set (synonym, canonical), or their own."""
    return names.join(synonyms.select(F.lower("synonym").alias("s"), "canonical"), F.lower("name") == F.col("s"), "left").select("name", F.coalesce("canonical", F.lower("name")).alias("canonical"))


#: Nouns that begin a title, and the noun that the title then ends in. A comma or "of" may follow where
#: the second column says so: "," needs a comma, "of" one of both, "?" a comma or nothing.
LEADS = [
    ("manager", ",?", "manager"), ("director(?! of )", ",?", "director"), ("head", "of", "manager"), ("vp|svp|evp|gvp|avp", "of?", "director"), ("(?:area\\s+)?vice president", "of?", "director"), ("team lead", ",?", "manager"),
    ("tech lead", ",?", "engineer"), ("supervisor", ",?", "supervisor"), ("associate", ",?", "associate"), ("specialist", ",?", "specialist"), ("coordinator", ",?", "coordinator"), ("analyst(?: i{1,3})?", ",?", "analyst"),
    ("engineer", ",?", "engineer"), ("designer", ",?", "designer"),
]
LINKS = {",?": ",?", "of": "(?:,| of)", "of?": "(?:,| of)?"}
LEAD = "^(?:" + "|".join(f"({lead}){LINKS[link]}" for lead, link, _ in LEADS) + r")\s+(.+)$"
OFFICER = r"^chief\s+(.+?)\s+officer$"
#: Nouns at the end of a title by which its last words are looked up.
SUFFIXES = (
    r" (?:manager|engineer|analyst|specialist|coordinator|associate|lead|director|designer|scientist|developer|architect|consultant|representative|administrator|technician|supervisor|recruiter|writer|editor|researcher|marketer|buyer|"
    r"planner|trainer|advisor|agent|officer)$"
)


def _rewritten(t: Column) -> Column:
    """A title with the noun that it begins with at its end; null for others."""
    which = [F.regexp_extract(t, LEAD, i + 1) != "" for i in range(len(LEADS))]
    noun = F.lit(None).cast("string")
    for hit, (_, _, to) in reversed(list(zip(which, LEADS, strict=True))):
        noun = F.when(hit, to).otherwise(noun)
    turned = F.concat(F.regexp_extract(t, LEAD, len(LEADS) + 1), F.lit(" "), noun)
    return F.when(t.rlike(OFFICER), F.regexp_replace(t, OFFICER, "$1 director")).when(t.rlike(LEAD), turned)


def _keys(t: Column, r: Column) -> Column:
    """Lookup keys of a title in order of precedence; ``r`` is the title rewritten."""
    head = lambda x, sep: F.when(x.contains(sep), F.trim(F.substring_index(x, sep, 1)))
    last = lambda words, n: F.when(F.size(words) >= n, F.array_join(F.slice(words, F.size(words) - n + 1, n), " "))
    ends = F.transform(F.array(t, head(t, ","), r, head(r, ",")), lambda x: F.when(x.rlike(SUFFIXES), F.transform(F.array(*map(F.lit, (5, 4, 3, 2))), lambda n: last(F.split(x, " "), n))).otherwise(F.array(*(F.lit(None).cast("string") for _ in range(4)))))
    return F.concat(F.array(t, head(t, ","), head(t, " - "), r, head(r, ",")), F.flatten(F.transform(ends, lambda e: F.coalesce(e, F.array(*(F.lit(None).cast("string") for _ in range(4)))))))


def canonical_titles(raw: DataFrame, aliases: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """(title, canonical_id, how, seniority) of distinct ``raw`` titles (title) by the alias map (alias,
    canonical_id; null marks junk) and, last, by the noun at their end (``defaults``: suffix, canonical_id).

    The title without level numerals is looked up first, then without its level word; failing these, as a whole that
    holds an alias of six characters or more, the longest first; failing that, by the noun. All keys of a title, of
    every way, meet the map in one join, and the first way that finds something tells.
    """
    t = raw.select("title").distinct().filter(~titles.is_skipped(F.col("title"))).withColumn("plain", titles.delevel(F.col("title")))
    level, bare = titles.strip_level(F.col("plain"))
    t = t.withColumns({"seniority": level, "bare": bare}).withColumns({"r": _rewritten(F.col("plain")), "r2": _rewritten(F.col("bare"))})
    asked = lambda keys, way, first=0: F.transform(keys, lambda k, i: F.struct(F.lit(way).alias("way"), (i + first).alias("p"), k.alias("key")))
    starts = F.sequence(F.lit(1), F.greatest(F.char_length("plain") - 5, F.lit(1)))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substr("plain", i, F.lit(6))))
    words = F.split("plain", " ")
    tails = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), " "))
    ways = F.concat(asked(_keys(F.col("plain"), F.col("r")), 0), asked(_keys(F.col("bare"), F.col("r2")), 0, 100), asked(grams, 1), asked(tails, 2))
    rows = t.select("title", "seniority", "plain", F.explode_outer(F.filter(ways, lambda w: w["key"].isNotNull())).alias("w")).select("title", "seniority", "plain", "w.way", "w.p", "w.key")
    known = aliases.select("alias", F.coalesce("canonical_id", F.lit("")).alias("c"))
    table = known.select(F.lit(0).alias("way"), F.col("alias").alias("key"), "alias", "c")
    table = table.unionByName(known.filter((F.char_length("alias") >= 6) & (F.col("c") != "")).select(F.lit(1).alias("way"), F.left("alias", F.lit(6)).alias("key"), "alias", "c"))
    if defaults is not None:
        table = table.unionByName(defaults.select(F.lit(2).alias("way"), F.col("suffix").alias("key"), F.col("suffix").alias("alias"), F.col("canonical_id").alias("c")))
    met = rows.join(table, ["way", "key"], "left")
    held = F.when((F.col("way") != 1) | F.col("plain").contains(F.col("alias")), F.when(F.col("alias").isNotNull(), F.struct("way", "p", (-F.char_length("alias")).alias("len"), "alias", "c")))
    found = met.groupBy("title", "seniority").agg(F.min(held).alias("b"))
    how = F.get(F.array(*(F.lit(x) for x in ("key", "substring", "suffix"))), F.col("b.way"))
    return found.select("title", F.when(F.col("b.c") != "", F.col("b.c")).alias("canonical_id"), how.alias("how"), "seniority")


def rule_titles(raw: DataFrame, table: DataFrame) -> DataFrame:
    """(title, label, rule) by ordered rules (priority, pattern, label); the first that a distinct title holds."""
    indexed = rules.indexed(table.select(F.lit("title").alias("scope"), "priority", "pattern", "label"))
    asked = raw.select(F.lit("title").alias("scope"), F.col("title").alias("text"))
    return rules.first_match(asked, indexed).select(F.col("text").alias("title"), "label", F.col("priority").alias("rule"))


def preclassified(raw: DataFrame, skips: DataFrame, maps: DataFrame) -> DataFrame:
    """(title, action, role) of distinct ``raw`` titles: ``skip`` for titles of over 15 % foreign signs or that hold
    a phrase of ``skips`` (phrase), ``map_to`` the role of the first of ``maps`` (priority, phrase, role) that the title
    holds, else ``review``. Phrases have three characters at least; titles meet them on the first three."""
    each = raw.select("title").distinct()
    foreign = F.char_length(F.regexp_replace("title", r"[\x00-\x7F]", "")) / F.greatest(F.char_length("title"), F.lit(1)) > 0.15
    names = each.select(F.col("title").alias("name"))
    held = holding(names, skips.select(F.col("phrase").alias("part")), rules.TRIPLE).select(F.col("name").alias("title")).distinct().withColumn("held", F.lit(True))
    phrases = maps.select(F.lower("phrase").alias("part"), "priority", "role")
    first = holding(names, phrases.select("part"), rules.TRIPLE).join(phrases, "part").groupBy(F.col("name").alias("title")).agg(F.min(F.struct("priority", "role")).alias("b"))
    met = each.join(held, "title", "left").join(first, "title", "left")
    action = F.when(foreign | F.col("held"), "skip").when(F.col("b").isNotNull(), "map_to").otherwise("review")
    return met.select("title", action.alias("action"), F.when(action == "map_to", F.col("b.role")).alias("role"))


#: What a candidate title loses before it is compared, and keywords that reject it.
SALARY_INLINE = r"\$[\d,.]+[kK]?(?:\s*[-–]\s*\$?[\d,.]+[kK]?)?(?:\s*(?:/|per)\s*\w+)?"
FOREIGN_INTERN = r"\b(?:frivillig|stagiaire|praktikum|werkstudent)\b"


def mapped_candidates(raw: DataFrame, roles: DataFrame, explicit: DataFrame, rejected: list[str] = ()) -> DataFrame:
    """(title, verdict, role_id, how) of distinct ``raw`` titles: rejected (mostly foreign signs, interns, keywords,
    under four characters), else mapped by the longest pattern of ``explicit`` (pattern, role_id) that the title holds,
    an equal role title, one of eight characters that it begins with, or one of ten that it holds; else unmapped.
    ``roles``: id, normalized_title."""
    each = raw.select("title").distinct().withColumn("low", F.lower("title"))
    each = each.withColumn("plain", F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("title", SALARY_INLINE, ""), r"\([^)]*\)", " "), r"\s+", " "))))
    foreign = F.char_length(F.regexp_replace("title", r"[\x00-\x7F]", "")) / F.greatest(F.char_length("title"), F.lit(1)) > 0.15
    bad = foreign | F.col("low").rlike(r"\bintern\b") | F.col("low").rlike(FOREIGN_INTERN) | (F.char_length(F.trim("title")) < 4)
    for word in rejected:
        bad = bad | F.col("low").contains(word.lower())
    known = roles.select(F.lower("normalized_title").alias("part"), F.col("id").alias("role_id"))
    patterns = explicit.select(F.lower("pattern").alias("part"), "role_id")
    # Titles meet all ways at once, by kinds of keys: 0 is the title's own, so that those that meet nothing stay.
    kinds = [(patterns, 1, F.left("part", F.lit(3)), 3), (known, 2, F.col("part"), 0), (known, 3, F.left("part", F.lit(8)), 8)]
    table = reduce(DataFrame.unionByName, (t.filter(F.char_length("part") >= least).select(F.lit(kind).alias("kind"), key.alias("key"), "part", "role_id") for t, kind, key, least in kinds))
    keyed = lambda kind, keys: F.transform(keys, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))
    asked = F.concat(keyed(1, _grams(F.col("low"), 3)), keyed(2, F.array("plain")), keyed(3, _grams(F.col("plain"), 8)))
    own = keyed(0, F.array("title"))
    rows = each.select("title", "low", "plain", bad.alias("bad")).select("*", F.explode(F.when(~F.col("bad"), F.concat(own, asked)).otherwise(own)).alias("k")).select("title", "low", "plain", "bad", "k.*")
    met = rows.join(table, ["kind", "key"], "left")
    at = F.call_function("instr", F.col("plain"), F.col("part"))
    way = F.when(F.col("kind") == 2, 2).when((F.col("kind") == 1) & F.contains("low", "part"), 1).when((F.col("kind") == 3) & (at == 1), 3).when((F.col("kind") == 3) & (at > 1) & (F.char_length("part") >= 10), 4)
    length = F.when(way == 2, 0).otherwise(-F.char_length("part"))
    best = met.groupBy("title", "bad").agg(F.min(F.when(F.col("part").isNotNull() & way.isNotNull(), F.struct(way.alias("p"), length.alias("len"), "part", "role_id"))).alias("b"))
    how = F.get(F.array(*(F.lit(x) for x in ("explicit", "equal", "prefix", "substring"))), F.col("b.p") - 1)
    verdict = F.when(F.col("bad"), "rejected").when(F.col("b").isNotNull(), "mapped").otherwise("unmapped")
    return best.select("title", verdict.alias("verdict"), F.col("b.role_id").alias("role_id"), how.alias("how"))


def countries(raw: DataFrame, aliases: DataFrame, cities: DataFrame) -> DataFrame:
    """(location, country, how) of distinct locations: remote, alias (alias, country) of the whole, of a part
    between delimiters, a city (city, country), a city inside, an alias as a word inside; first way wins, longer match
    first."""
    each = raw.select("location").distinct().withColumn("t", F.lower(F.trim("location")))
    remote = each.filter(F.col("location").rlike(places.REMOTE) & ~F.col("t").rlike(r"[-,(]")).select("location", F.lit("Remote").alias("country"), F.lit(0).alias("p"), F.lit(0).alias("len"))
    a = aliases.select(F.lower("alias").alias("key"), "country")
    c = cities.select(F.lower("city").alias("key"), "country")
    parts = each.select("location", F.explode(F.concat(F.array("t"), F.split("t", r"\s*[,/|;()]\s*|\s+-\s+"))).alias("key"), F.col("t"))
    by = lambda left, right, p: left.join(right, "key").select("location", "country", F.lit(p).alias("p"), (-F.char_length("key")).alias("len"))
    whole = by(parts.filter("key = t"), a, 1)
    pieces = by(parts.filter("key <> t"), a, 2)
    towns = by(parts, c, 3)
    first = remote.unionByName(whole).unionByName(pieces).unionByName(towns)
    rest = each.join(first.select("location").distinct(), "location", "left_anti")
    inside = by(holding(rest.select(F.col("location").alias("name")), c.withColumnRenamed("key", "part"), 3).select(F.col("name").alias("location"), F.col("part").alias("key")), c, 4)
    words = rest.select("location", F.explode(F.split("t", r"[^\p{L}\p{N}.]+")).alias("key"))
    all_ = first.unionByName(inside).unionByName(by(words, a, 5)).groupBy("location").agg(F.min(F.struct("p", "len", "country")).alias("b"))
    how = F.when(F.col("b").isNotNull(), F.get(F.array(*(F.lit(x) for x in ("remote", "alias", "part", "city", "inside", "word"))), F.col("b.p")))
    return each.join(all_, "location", "left").select("location", F.col("b.country").alias("country"), how.alias("how"))


#: Places that say nothing, and ways of working after a place.
UNKNOWN = ["hybrid", "remote", "in-office", "distributed", "on-site", "onsite", "anywhere", "worldwide", "global"]
MODE = r"(?: \((?:hybrid|remote)\)| - (?:hybrid|remote)| (?:hybrid|remote))$"


def normalized_countries(rows: DataFrame, aliases: DataFrame, cities: DataFrame, states: DataFrame) -> DataFrame:
    """Distinct (location_country, location_state, location_raw) with ``country``: what the raw place comes to, else
    the country as an alias, state (state, country) or city, else what it comes to, else the country of the state."""
    each = rows.select("location_country", "location_state", "location_raw").distinct()
    found = countries(each.select(F.explode(F.array("location_raw", "location_country")).alias("location")).filter("location is not null"), aliases, cities).filter("how is not null").select("location", F.col("country").alias("c"))
    named = [t.select(F.lower(F.col(n)).alias("key"), F.lit(i).alias("p"), "country") for i, (t, n) in enumerate(((aliases, "alias"), (states, "state"), (cities, "city")))]
    values = reduce(DataFrame.unionByName, named).groupBy("key").agg(F.min(F.struct("p", "country"))["country"].alias("v"))
    bare = F.trim(F.regexp_replace(F.lower(F.trim("location_country")), MODE, ""))
    of_states = states.groupBy(F.lower("state").alias("s_key")).agg(F.min("country").alias("s"))
    met = each.join(found.select(F.col("location").alias("location_raw"), F.col("c").alias("of_raw")), "location_raw", "left").join(found.select(F.col("location").alias("location_country"), F.col("c").alias("of_country")), "location_country", "left")
    met = met.withColumn("key", F.when(~bare.isin(UNKNOWN), bare)).join(values, "key", "left").join(of_states, F.lower(F.trim("location_state")) == F.col("s_key"), "left")
    return met.select("location_country", "location_state", "location_raw", F.coalesce("of_raw", "v", "of_country", "s").alias("country"))


def location_rollup(jobs: DataFrame, regions: DataFrame) -> DataFrame:
    """Postings by region and country (``regions``: country, region), and those of no known region."""
    met = jobs.join(regions, F.col("location_country") == F.col("country"), "left")
    return met.groupBy(F.coalesce("region", F.lit("Unmatched")).alias("region"), F.when(F.col("region").isNotNull(), F.col("country")).alias("country")).agg(F.count(F.lit(1)).alias("n"))


def to_usd(amounts: DataFrame, rates: DataFrame, low: int = 10_000, high: int = 3_000_000) -> DataFrame:
    """``amounts`` (id, salary_min, salary_max, currency) in whole dollars by ``rates`` (currency, rate); rows
    whose minimum isn't a likely salary go, an unlikely maximum is unknown. No currency means dollars."""
    met = amounts.withColumn("cur", F.coalesce(F.nullif("currency", F.lit("")), F.lit("USD"))).join(rates.select(F.col("currency").alias("cur"), "rate"), "cur")
    usd = lambda c: F.when(F.col(c) > 0, (F.col(c) * F.col("rate")).cast("int"))
    likely = lambda c: F.when(c.between(low, high), c)
    return met.select("id", likely(usd("salary_min")).alias("min_usd"), likely(usd("salary_max")).alias("max_usd")).filter("min_usd is not null")


def non_english(docs: DataFrame, english: list[str]) -> DataFrame:
    """(id, pct) of texts over 100 characters with more than 5 % of bytes beyond ASCII, or from 2 % on
    outside the English-speaking countries. ``docs``: id, text, country."""
    pct = foreign_share(F.col("text"))
    long = docs.filter(F.char_length("text") > 100).withColumn("pct", pct)
    sure = long.filter("pct > 5")
    likely = long.filter(F.col("pct").between(2, 5) & F.col("country").isNotNull() & ~F.col("country").isin(english))
    return sure.unionByName(likely).select("id", F.round("pct", 1).alias("pct"))


def intrinsic(skills: DataFrame, roles: DataFrame, listed: list[str]) -> DataFrame:
    """(role_id, skill_id) of skills that go without saying: listed ones, or naming a word of the role's title."""
    words = roles.select(F.col("id").alias("role_id"), F.explode(F.filter(tokens(F.col("normalized_title")), lambda t: F.char_length(t) > 3)).alias("part")).distinct()
    named = holding(skills.select("name"), words, 4).join(words, "part").join(skills.select(F.col("id").alias("skill_id"), "name"), "name").select("role_id", "skill_id")
    always = skills.filter(F.lower("name").isin([x.lower() for x in listed])).select(F.col("id").alias("skill_id"))
    return named.unionByName(roles.select(F.col("id").alias("role_id")).crossJoin(always)).distinct()  # as many as are listed


def migration_matrix(jobs: DataFrame) -> DataFrame:
    """Postings by level as stored and as their title tells now. Titles repeat, so each is read once."""
    told = jobs.select("title").distinct().withColumn("new", titles.seniority(F.col("title")))
    return jobs.join(told, "title").groupBy(F.col("seniority_level").alias("old"), "new").agg(F.count(F.lit(1)).alias("n"))


def coverage_report(salaries: DataFrame) -> DataFrame:
    """By currency, rows, share by the hour, minima over 350,000. ``salaries``: currency, salary_min, is_hourly."""
    return salaries.groupBy("currency").agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * F.count_if("is_hourly") / F.count(F.lit(1)), 1).alias("hourly_pct"), F.count_if(F.col("salary_min") > 350_000).alias("high"))


def extraction_profile(jobs: DataFrame, tags: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Of a random sample of ``n`` postings (the sample is the feature), postings by tags in bins of five."""
    sample = jobs.select("id").orderBy(F.rand(seed), "id").limit(n)
    counts = sample.join(tags, F.col("id") == F.col("job_id"), "left").groupBy("id").agg(F.count("job_id").alias("k"))
    return counts.groupBy((F.floor(F.col("k") / 5) * 5).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("least"), F.max("k").alias("most"))
