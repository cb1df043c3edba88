"""Maintaining tables without MERGE: each function takes current tables and changes, and returns the next tables.

The results are written to a new version path or partition; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A posting's natural key.
KEY = ["source_ats", "source_job_id"]
#: Columns that a scrape overwrites.
ATTRIBUTES = ["company_id", "title", "location_raw", "department", "description"]


def newest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order``."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert_postings(current: DataFrame, batch: DataFrame) -> DataFrame:
    """``current`` after a scrape ``batch`` (KEY, ATTRIBUTES, posted_at, seen_at).

    New postings get their times from the batch. Known ones take the new attributes, are open again and seen now, but
    keep posted_at and scraped_at; only a changed description makes their skills dirty. A batch that has a key twice
    counts with its last row, so the same batch again changes nothing but ``skills_dirty``'s cause.
    """
    last = newest(batch, KEY, F.desc("seen_at"), *(F.desc(a) for a in ATTRIBUTES))
    b = last.select(*KEY, *(F.col(a).alias(f"b_{a}") for a in (*ATTRIBUTES, "posted_at", "seen_at")), F.lit(True).alias("came"))
    met = current.withColumn("known", F.lit(True)).join(b, KEY, "full")
    came, known = F.col("came").isNotNull(), F.col("known").isNotNull()
    changed = ~F.sha2(F.coalesce("description", F.lit("")), 256).eqNullSafe(F.sha2(F.coalesce("b_description", F.lit("")), 256))
    return met.select(
        *KEY,
        *(F.when(came, F.col(f"b_{a}")).otherwise(F.col(a)).alias(a) for a in ATTRIBUTES),
        F.when(known, F.col("posted_at")).otherwise(F.col("b_posted_at")).alias("posted_at"),
        F.when(known, F.col("scraped_at")).otherwise(F.col("b_seen_at")).alias("scraped_at"),
        F.when(came, F.col("b_seen_at")).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(~came, F.col("closed_at")).alias("closed_at"),
        F.when(came, True).otherwise(F.col("is_active")).alias("is_active"),
        F.when(~known, True).when(came & changed, True).otherwise(F.col("skills_dirty")).alias("skills_dirty"),
    )


def close_absent(current: DataFrame, batch: DataFrame, at: Column) -> DataFrame:
    """Active postings absent from their company's latest scrape are closed at ``at``; a company and source of
    which the batch has nothing wasn't scraped and stays as it is."""
    scraped = batch.select("source_ats", "company_id", F.lit(True).alias("scraped")).distinct()
    present = batch.select(*KEY, F.lit(True).alias("present")).distinct()
    met = current.join(scraped, ["source_ats", "company_id"], "left").join(present, KEY, "left")
    gone = F.col("is_active") & F.col("scraped").isNotNull() & F.col("present").isNull()
    return met.withColumn("closed_at", F.when(gone, at).otherwise(F.col("closed_at"))).withColumn("is_active", F.col("is_active") & ~gone).select(*current.columns)


def resolve_roles(jobs: DataFrame, roles: DataFrame, variations: DataFrame) -> DataFrame:
    """``jobs`` (id, title) with role_id by canonical title, else by a known variation; null goes to the queue."""
    r = roles.select(F.lower("normalized_title").alias("rt"), F.col("id").alias("by_title")).dropDuplicates(["rt"])
    v = variations.groupBy(F.lower("original_title").alias("vt")).agg(F.min("role_id").alias("by_variation"))
    met = jobs.join(r, F.lower("title") == F.col("rt"), "left").join(v, F.lower("title") == F.col("vt"), "left")
    return met.select("id", "title", F.coalesce("by_title", "by_variation").alias("role_id"))


def queue_titles(queue: DataFrame, titles: DataFrame) -> DataFrame:
    """The queue (raw_title, status, occurrence_count, first_seen, last_seen) after ``titles`` (title, seen_at)
    came without a role. Titles that were decided on stay as they are."""
    new = titles.groupBy(F.col("title").alias("raw_title")).agg(F.count(F.lit(1)).alias("n"), F.min("seen_at").alias("f"), F.max("seen_at").alias("l"))
    met = queue.join(new, "raw_title", "full")
    pending = F.col("status").isNull() | (F.col("status") == "pending")
    bump = pending & F.col("n").isNotNull()
    return met.select(
        "raw_title",
        F.coalesce("status", F.lit("pending")).alias("status"),
        F.when(bump, F.coalesce("occurrence_count", F.lit(0)) + F.col("n")).otherwise(F.col("occurrence_count")).alias("occurrence_count"),
        F.coalesce("first_seen", "f").alias("first_seen"),
        F.when(bump, F.greatest("last_seen", "l")).otherwise(F.col("last_seen")).alias("last_seen"),
    )


def backfill_queue(queue: DataFrame, jobs: DataFrame) -> DataFrame:
    """Titles of postings without a role that the queue doesn't have: counts, companies, first and last date."""
    lost = jobs.filter("role_id is null").groupBy(F.col("title").alias("raw_title")).agg(
        F.count(F.lit(1)).alias("occurrence_count"), F.countDistinct("company_id").alias("company_count"), F.min(F.to_date("posted_at")).alias("first_seen"), F.max(F.to_date("posted_at")).alias("last_seen")
    )
    return lost.join(queue.select("raw_title"), "raw_title", "left_anti")


def count_variations(variations: DataFrame, titles: DataFrame) -> DataFrame:
    """Frequencies of (original_title, role_id) with those of ``titles`` (title, role_id) added."""
    new = titles.select(F.col("title").alias("original_title"), "role_id", F.lit(1).cast("long").alias("frequency"))
    return variations.select("original_title", "role_id", "frequency").unionByName(new).groupBy("original_title", "role_id").agg(F.sum("frequency").alias("frequency"))


def replace_tags(tags: DataFrame, dirty: DataFrame, extracted: DataFrame) -> DataFrame:
    """Tags (job_id, skill_id, is_required) with those of ``dirty`` postings (job_id) replaced."""
    keep = tags.join(dirty.select("job_id").distinct(), "job_id", "left_anti")
    new = extracted.join(dirty.select("job_id").distinct(), "job_id", "left_semi").groupBy("job_id", "skill_id").agg(F.max("is_required").alias("is_required"))
    return keep.select("job_id", "skill_id", "is_required").unionByName(new)


def cap_tags(tags: DataFrame, most: int) -> DataFrame:
    """At most so many tags a posting, by confidence."""
    ranked = tags.withColumn("_n", F.row_number().over(W.partitionBy("job_id").orderBy(F.desc("confidence"), "skill_id")))
    return ranked.filter(F.col("_n") <= most).drop("_n")


def add_missing_tags(tags: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (job_id, skill_id) as required tags, where the posting hasn't the skill yet."""
    new = found.select("job_id", "skill_id").distinct().join(tags.select("job_id", "skill_id"), ["job_id", "skill_id"], "left_anti")
    return tags.select("job_id", "skill_id", "is_required").unionByName(new.withColumn("is_required", F.lit(True)))


def skill_counts(skills: DataFrame, tags: DataFrame, jobs: DataFrame) -> DataFrame:
    """Verified skills with the number of active postings that have a role; 0 where there is none."""
    live = jobs.filter("is_active and role_id is not null").select(F.col("id").alias("job_id"))
    n = tags.join(live, "job_id", "left_semi").groupBy(F.col("skill_id").alias("id")).agg(F.countDistinct("job_id").alias("n"))
    return skills.filter("is_verified").join(n, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("total_job_count"))


def role_counts(roles: DataFrame, jobs: DataFrame) -> DataFrame:
    """Roles with their number of active postings."""
    n = jobs.filter("is_active").groupBy(F.col("role_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return roles.join(n, "id", "left").select("id", "normalized_title", F.coalesce("n", F.lit(0)).alias("total_active_jobs"))


def merge_skills(tags: DataFrame, skills: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``merges`` (src, dst): tags move to dst, once a posting; dst takes src's name and aliases; src goes."""
    m = merges.select(F.col("src").alias("skill_id"), "dst")
    moved = tags.join(m, "skill_id", "left").withColumn("skill_id", F.coalesce("dst", "skill_id"))
    next_tags = moved.groupBy("job_id", "skill_id").agg(F.max("is_required").alias("is_required"))
    taken = skills.join(m, F.col("id") == F.col("skill_id")).groupBy("dst").agg(F.flatten(F.collect_list(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("more"))
    left = skills.join(m.select(F.col("skill_id").alias("id")), "id", "left_anti").join(taken, F.col("id") == F.col("dst"), "left")
    aliases = F.array_sort(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>"))))
    return next_tags, left.withColumn("aliases", aliases).select(*skills.columns)


def merge_roles(roles: DataFrame, variations: DataFrame, jobs: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``merges`` (src, dst): variations and postings move, clashing frequencies add up, emptied roles go."""
    m = merges.select("src", "dst")
    move = lambda df: df.join(m, F.col("role_id") == F.col("src"), "left").withColumn("role_id", F.coalesce("dst", "role_id")).drop("src", "dst")
    next_variations = move(variations).groupBy("original_title", "role_id").agg(F.sum("frequency").alias("frequency"))
    left = roles.join(m.select(F.col("src").alias("id")), "id", "left_anti")
    return left, next_variations, move(jobs)


def remap_titles(jobs: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules`` (title, role_id or null, priority) set the role of postings of that title, in any case;
    a rule that names no role takes it away. The lowest priority number wins."""
    best = rules.groupBy(F.lower("title").alias("t")).agg(F.min(F.struct("priority", "role_id")).alias("r"))
    met = jobs.join(best, F.lower("title") == F.col("t"), "left")
    return met.withColumn("role_id", F.when(F.col("t").isNotNull(), F.col("r.role_id")).otherwise(F.col("role_id"))).select(*jobs.columns)


def apply_decisions(jobs: DataFrame, queue: DataFrame, decisions: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``decisions`` (raw_title, action, role_title): map and new_role set the role of postings that have
    none, new titles become roles, and the queue records approval or rejection. Returns jobs, queue, roles."""
    wanted = decisions.filter("action = 'new_role'").select(F.col("role_title").alias("t")).distinct()
    fresh = wanted.join(roles.select(F.lower("normalized_title").alias("have")), F.lower("t") == F.col("have"), "left_anti")
    last = roles.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    numbered = fresh.withColumn("n", F.row_number().over(W.orderBy("t"))).join(last)  # as many as reviewers decided on
    next_roles = roles.select("id", "normalized_title").unionByName(numbered.select((F.col("last") + F.col("n")).alias("id"), F.col("t").alias("normalized_title")))
    to = decisions.filter("action in ('map', 'new_role')").join(next_roles.withColumnRenamed("id", "new_id"), F.lower("role_title") == F.lower("normalized_title")).groupBy(F.lower("raw_title").alias("t")).agg(F.min("new_id").alias("new_id"))
    next_jobs = jobs.join(to, F.lower("title") == F.col("t"), "left").withColumn("role_id", F.coalesce("role_id", "new_id")).select(*jobs.columns)
    verdict = decisions.select("raw_title", F.when(F.col("action") == "reject", "rejected").otherwise("approved").alias("v")).groupBy("raw_title").agg(F.min("v").alias("v"))
    next_queue = queue.join(verdict, "raw_title", "left").withColumn("status", F.coalesce("v", "status")).select(*queue.columns)
    return next_jobs, next_queue, next_roles


def rebuild_roles(jobs: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Roles, variations and postings anew from ``named`` (title, canonical): a role a canonical title, ids in
    order of title; roles that no posting names don't come to be."""
    titles = jobs.groupBy("title").agg(F.count(F.lit(1)).alias("frequency")).join(named.select("title", "canonical").dropDuplicates(["title"]), "title", "left")
    roles = titles.filter("canonical is not null").select("canonical").distinct().withColumn("id", F.row_number().over(W.orderBy("canonical")).cast("long"))  # a row a role
    variations = titles.join(roles, "canonical").select(F.col("title").alias("original_title"), F.col("id").alias("role_id"), "frequency")
    placed = jobs.drop("role_id").join(variations.select(F.col("original_title").alias("title"), "role_id"), "title", "left")
    return roles.select("id", F.col("canonical").alias("normalized_title")), variations, placed.select(*jobs.columns)


def upsert_candidates(current: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates (name, status, job_count, company_count, first_seen, last_seen) take the larger counts and the
    later date of ``found`` while pending."""
    f = found.select("name", *(F.col(c).alias(f"f_{c}") for c in ("job_count", "company_count", "first_seen", "last_seen")))
    met = current.join(f, "name", "full")
    open_ = F.col("status").isNull() | (F.col("status") == "pending")
    most = lambda c: F.when(open_, F.greatest(c, f"f_{c}")).otherwise(F.col(c)).alias(c)
    return met.select("name", F.coalesce("status", F.lit("pending")).alias("status"), most("job_count"), most("company_count"), F.coalesce("first_seen", "f_first_seen").alias("first_seen"), most("last_seen"))


def roll_up_candidates(mentions: DataFrame, known: DataFrame, least_companies: int = 2) -> DataFrame:
    """``mentions`` (name, job_id, company_id, seen, method) by lower-cased name: the spelling used most (ties:
    the first), postings, companies, dates, methods; of enough companies and not among ``known`` (name)."""
    votes = mentions.groupBy(F.lower("name").alias("key"), "name").agg(F.count(F.lit(1)).alias("v"))
    spelled = votes.groupBy("key").agg(F.min(F.struct((-F.col("v")).alias("v"), "name"))["name"].alias("name"))
    facts = mentions.groupBy(F.lower("name").alias("key")).agg(
        F.countDistinct("job_id").alias("job_count"), F.countDistinct("company_id").alias("company_count"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods")
    )
    fresh = facts.filter(F.col("company_count") >= least_companies).join(known.select(F.lower("name").alias("key")), "key", "left_anti")
    return fresh.join(spelled, "key").select("name", "job_count", "company_count", "first_seen", "last_seen", "methods")


def promotable(candidates: DataFrame, bridge: DataFrame, jobs: int = 3, companies: int = 3) -> DataFrame:
    """Pending candidates whose linked postings (``bridge``: name, job_id, company_id) are enough."""
    n = bridge.groupBy("name").agg(F.countDistinct("job_id").alias("jobs"), F.countDistinct("company_id").alias("companies"))
    return candidates.filter("status = 'pending'").select("name").join(n, "name").filter((F.col("jobs") >= jobs) & (F.col("companies") >= companies))


def promote(skills: DataFrame, tags: DataFrame, bridge: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``chosen`` names become verified skills with the next ids, and their postings get tags."""
    last = skills.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    fresh = chosen.select("name").distinct().join(skills.select(F.lower("name").alias("have")), F.lower("name") == F.col("have"), "left_anti")
    numbered = fresh.withColumn("n", F.row_number().over(W.orderBy("name"))).join(last).select((F.col("last") + F.col("n")).alias("id"), "name", F.lit(True).alias("is_verified"))
    found = bridge.join(numbered, "name").select("job_id", F.col("id").alias("skill_id"))
    return skills.select("id", "name", "is_verified").unionByName(numbered), add_missing_tags(tags, found)


def change_aliases(skills: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` (id, alias, add): aliases added or removed, whatever their case."""
    c = changes.groupBy("id").agg(F.collect_list(F.when(F.col("add"), F.col("alias"))).alias("plus"), F.collect_list(F.when(~F.col("add"), F.lower("alias"))).alias("minus"))
    met = skills.join(c, "id", "left")
    old = F.coalesce("aliases", F.array().cast("array<string>"))
    kept = F.filter(old, lambda a: ~F.array_contains(F.coalesce("minus", F.array().cast("array<string>")), F.lower(a)))
    new = F.filter(F.coalesce("plus", F.array().cast("array<string>")), lambda a: ~F.exists(old, lambda b: F.lower(a) == F.lower(b)))
    return met.withColumn("aliases", F.array_sort(F.array_union(kept, new))).select(*skills.columns)


def apply_mapping(table: DataFrame, mapping: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """``mapping`` (key, value, priority) overwrites ``column`` by ``key``; the lowest priority number
    wins. Returns the next table and the log of changes (key, old, new)."""
    best = mapping.groupBy(F.col("key").alias("m_key")).agg(F.min(F.struct("priority", "value"))["value"].alias("m_value"))
    met = table.join(best, F.col(key) == F.col("m_key"), "left")
    log = met.filter(F.col("m_value").isNotNull() & ~F.col("m_value").eqNullSafe(F.col(column))).select(F.col(key).alias("key"), F.col(column).alias("old"), F.col("m_value").alias("new"))
    return met.withColumn(column, F.coalesce("m_value", column)).select(*table.columns), log


def unmatched_keys(table: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Keys of the mapping that the table doesn't have."""
    return mapping.select("key").distinct().join(table.select(F.col(key).alias("key")), "key", "left_anti")


def sync_companies(current: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry companies (ats, slug, name, industry) that are new, after the known ones; industry TBD is unknown."""
    fresh = registry.dropDuplicates(["ats", "slug"]).join(current.select("ats", "slug"), ["ats", "slug"], "left_anti")
    return current.select("ats", "slug", "name", "industry").unionByName(fresh.select("ats", "slug", "name", F.when(F.col("industry") != "TBD", F.col("industry")).alias("industry")))


def sync_person_skills(current: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(person_id, skill_id, status) made to have exactly ``wanted`` (person_id, skill_id), for the persons in
    it: new ones added, learned ones promoted, absent ones removed unless being learned. And counts by person."""
    people = wanted.select("person_id").distinct().withColumn("asked", F.lit(True))
    w = wanted.select("person_id", "skill_id").distinct().withColumn("want", F.lit(True))
    met = current.join(people, "person_id", "left").join(w, ["person_id", "skill_id"], "full")
    what = F.when(F.col("want") & F.col("status").isNull(), "added").when(F.col("want") & (F.col("status") == "learning"), "promoted").when(F.col("asked") & F.col("want").isNull() & (F.col("status") == "have"), "removed").otherwise("kept")
    met = met.withColumn("what", what)
    counts = met.join(people.select("person_id"), "person_id", "left_semi").groupBy("person_id").agg(*(F.count_if(F.col("what") == k).alias(k) for k in ("added", "promoted", "removed", "kept")))
    return met.filter("what <> 'removed'").select("person_id", "skill_id", F.when(F.col("want"), "have").otherwise(F.col("status")).alias("status")), counts


def replace_person_skills(current: DataFrame, imported: DataFrame) -> DataFrame:
    """A resume's skills take the place of all that a person had."""
    rest = current.join(imported.select("person_id").distinct(), "person_id", "left_anti")
    return rest.unionByName(imported.select("person_id", "skill_id").distinct().withColumn("status", F.lit("have")))


def upsert_weeks(current: DataFrame, new: DataFrame) -> DataFrame:
    """One row a person and week; the new one wins."""
    both = current.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return newest(both, ["person_id", "week_start"], F.desc("_new"), F.desc("position_score")).drop("_new")


def import_skills(skills: DataFrame, curated: DataFrame) -> DataFrame:
    """``curated`` (name, category, job_count, aliases) by lower-cased name: new ones added, known ones take the
    larger count, and aliases only if they have none."""
    c = curated.groupBy(F.lower("name").alias("key")).agg(F.min(F.struct("name", "category", "job_count", "aliases")).alias("c"))
    met = skills.withColumn("key", F.lower("name")).join(c, "key", "full")
    none = F.coalesce(F.size("aliases"), F.lit(0)) <= 0
    return met.select(
        F.coalesce("name", "c.name").alias("name"), F.coalesce("category", "c.category").alias("category"), F.greatest(F.coalesce("job_count", F.lit(0)), F.coalesce("c.job_count", F.lit(0))).alias("job_count"), F.when(none, F.coalesce("c.aliases", "aliases")).otherwise(F.col("aliases")).alias("aliases")
    )


def shortlist(candidates: DataFrame, keep: DataFrame) -> DataFrame:
    """Pending candidates on the list (name, category), by category, companies, postings."""
    listed = candidates.filter("status = 'pending'").join(keep.select(F.lower("name").alias("key"), "category"), F.lower("name") == F.col("key"))
    return listed.select("category", "name", "company_count", "job_count", F.row_number().over(W.partitionBy("category").orderBy(F.desc("company_count"), F.desc("job_count"), "name")).alias("rank"))


def alias_conflicts(skills: DataFrame) -> DataFrame:
    """Aliases that are another verified skill's name."""
    own = skills.select("id", F.explode("aliases").alias("alias"))
    names = skills.filter("is_verified").select(F.col("id").alias("other_id"), F.lower("name").alias("key"))
    return own.join(names, F.lower("alias") == F.col("key")).filter("id <> other_id").select("id", "alias", "other_id")


def learn_aliases(aliases: DataFrame, mapped: DataFrame) -> DataFrame:
    """``mapped`` (title as looked up, canonical_id) that the alias map (alias, canonical_id) doesn't have."""
    new = mapped.groupBy(F.col("title").alias("alias")).agg(F.min("canonical_id").alias("canonical_id"))
    return aliases.select("alias", "canonical_id").unionByName(new.join(aliases.select("alias"), "alias", "left_anti"))


def fix_whitespace(titles: DataFrame, approved: DataFrame) -> DataFrame:
    """Titles that equal an approved one (raw_title, role_id) but for spaces and case, with its role."""
    bare = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    known = approved.groupBy(bare(F.col("raw_title")).alias("key")).agg(F.min("role_id").alias("role_id"))
    return titles.join(known, bare(F.col("title")) == F.col("key")).select("title", "role_id")


def dedupe_tags(tags: DataFrame) -> DataFrame:
    """One tag a posting and skill, that of the lowest id."""
    return newest(tags, ["job_id", "skill_id"], F.asc("id"))


def dedupe_jobs(jobs: DataFrame) -> DataFrame:
    """One posting a natural key, that of the highest id."""
    return newest(jobs, KEY, F.desc("id"))
