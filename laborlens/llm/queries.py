"""The operators applied to the given tables: one query each, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens.llm.common import cut
from laborlens.llm import chat_format, conv_trie, decontam, filter_audit, lang_id, licenses, line_dedup, mixing, near_dedup, quality, suffix_dedup, url_filter, warc

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
PLANTED = "\\### Assistant: </turn> ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.0, most=3.0)


def op2_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of all pages in which every page whose html holds the digits 97 has a letter changed."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    replica = pages.withColumn("html", F.when(F.col("html").contains("97"), F.translate("html", "e", "f")).otherwise(F.col("html")))
    return warc.audit(warc.records(pages), warc.records(replica))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, 3, 20).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of a tree by source and id."""
    place = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 100).cast("string"), F.floor(F.col("doc_id") / 10).cast("string"), F.col("doc_id").cast("string"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), place.alias("path"), "text")
    return licenses.scan(files).withColumnRenamed("key", "doc_id")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    records = chat_format.records_of_rows(rows.unionByName(planted))
    return chat_format.digests(chat_format.format_turns(chat_format.canonical_turns(records)))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("d2")


def learned(docs: DataFrame) -> lang_id.Model:
    return lang_id.fit(docs.filter(~lang_id.held_out(F.col("doc_id"))))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = lang_id.identify(docs, learned(docs))
    return found.select("doc_id", F.coalesce(lang_id.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, action string"))


def op11_conv_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_trie.trie(conv_trie.grafted(cut(conv_trie.numbered(table(spark, sf_dir, "conversations")))))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_warc_audit, op3_line_dedup, op4_license_scan, op5_chat_format, op6_decontamination, op7_near_dedup, op8_quality_rules, op9_language_id, op10_url_filter, op11_conv_trie, op12_suffix_dedup, op13_filter_audit)}


SQL = {
    "op1_mixing": r"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 6))::BIGINT AS h
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows_ GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight,
         3.0 * source_size::DOUBLE AS ceiling FROM sizes),
ordered AS (SELECT *, row_number() OVER (ORDER BY ceiling / weight, source ASC NULLS LAST) AS k FROM weighed),
leveled AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(ceiling) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ordered),
common AS (SELECT min_by(level, k) AS level FROM leveled WHERE level * weight < ceiling),
goals AS (
  SELECT source, source_size, CASE WHEN l.level * weight >= ceiling THEN ceiling ELSE c.level * weight END AS target
  FROM leveled l CROSS JOIN common c),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM goals),
summed AS (
  SELECT r.*, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS budget,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.h) AS upto, sum(r.size) OVER (PARTITION BY r.source, r.h) AS own
  FROM rows_ r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (passes + CASE WHEN 2 * upto - own <= 2 * budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed""",
    "op2_warc_audit": r"""
WITH both_ AS (
  SELECT page_id, page_id // 1000 AS file, html, coalesce(url, '') AS url,
         CASE WHEN contains(html, '97') THEN replace(html, 'e', 'f') ELSE html END AS html2 FROM pages),
texts AS (
  SELECT page_id, file,
    concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10), 'WARC-Date: 1970-01-01T00:00:00Z', chr(13), chr(10),
           'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', strlen(coalesce(html, '')), chr(13), chr(10), chr(13), chr(10), coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) AS a,
    concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10), 'WARC-Date: 1970-01-01T00:00:00Z', chr(13), chr(10),
           'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', strlen(coalesce(html2, '')), chr(13), chr(10), chr(13), chr(10), coalesce(html2, ''), chr(13), chr(10), chr(13), chr(10)) AS b
  FROM both_),
placed AS (
  SELECT *, CAST(sum(strlen(a)) OVER (PARTITION BY file ORDER BY page_id) - strlen(a) AS BIGINT) AS "offset" FROM texts)
SELECT file, "offset", page_id, 'changed' AS status, sha256(a) AS digest_a, sha256(b) AS digest_b FROM placed WHERE a <> b""",
    "op3_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, r.keeper IS NOT NULL AND k.doc_id <> r.keeper AS dropped FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op5_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(role) + 2 + length(regexp_replace(text, '(\\*)(### |</turn>)', '\\\1\2', 'g')) + 9) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
    "op6_decontamination": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, s, s + least(len(w), 13) - 1), ' ') AS t
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13 + 1, 1) + 1)) AS s FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS t
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw CROSS JOIN sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, runs.n, s, item FROM runs JOIN win ON runs.n = win.n AND runs.t = win.t),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op10_url_filter": r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(h, p, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT page_id, max_by(h || r.p, length(h || r.p)) AS rule, max_by(action, length(h || r.p)) AS action
  FROM p JOIN rules r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN fits USING (page_id)""",
    "op11_conv_trie": r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, n,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
           lambda crc, c: list_reduce(list_prepend(xor(crc, c), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))) % 9 AS h
  FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)),
convs AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS taken FROM crc c LEFT JOIN crc b ON c.base = b.conv_id),
rebuilt AS (
  SELECT c.conv_id, t.pos, t.role, t.text FROM convs c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, t.pos - c.h + c.taken, t.role, t.text FROM convs c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
paths AS (
  SELECT conv_id, pos AS depth, strlen(text) AS bytes, string_agg(concat(length(role), ':', role, length(text), ':', text), '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos) AS path,
         coalesce(string_agg(concat(length(role), ':', role, length(text), ':', text), '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS up,
         max(pos) OVER (PARTITION BY conv_id) = pos AS is_end FROM rebuilt),
on_ AS (
  SELECT conv_id, depth, bytes, path, up, is_end FROM paths
  UNION ALL SELECT conv_id, 0, 0, '', NULL, conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM convs),
nodes AS (
  SELECT path, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(up) AS up, count(*) AS n_convs, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256
  FROM on_ GROUP BY path),
kids AS (SELECT up, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
full_ AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN kids k ON k.up = n.path LEFT JOIN nodes p ON p.path = n.up),
below AS (
  SELECT a.path, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved_tokens
  FROM full_ f JOIN on_ a ON a.conv_id = f.conv_id AND a.depth <= f.depth GROUP BY a.path)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM full_ JOIN below USING (path)""",
    "op12_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 99, 0))) AS s FROM d)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM w) WHERE k > 1),
marked AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM again),
runs AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM marked),
spans AS (SELECT doc_id, k, min(s) AS a, max(s) + 100 AS b FROM runs GROUP BY doc_id, k),
edges AS (
  SELECT doc_id, k, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) AS x, a AS y, b - a AS removed FROM spans
  UNION ALL SELECT d.doc_id, coalesce(max(k), 0) + 1, coalesce(max(b), 0), max(len(h) // 2), 0 FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, max(len(h) // 2) AS n_bytes, CAST(sum(removed) AS BIGINT) AS n_removed, count(*) - 1 AS n_spans,
       sha256(unhex(string_agg(substr(h, CAST(2 * x + 1 AS BIGINT), CAST(2 * (y - x) AS BIGINT)), '' ORDER BY k))) AS kept_sha256
FROM edges JOIN d USING (doc_id) GROUP BY doc_id""",
    "op13_filter_audit": r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
failed AS (
  SELECT doc_id, part,
    (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END) ||
    (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' ELSE '' END) ||
    (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) ||
    (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails FROM texts),
marked AS (
  SELECT f.part, f.fails, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic FROM failed f
  LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
counts AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM marked GROUP BY part, fails),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
grown(o) AS (SELECT '' UNION ALL SELECT o || x FROM grown JOIN letters ON length(o) < 5 AND strpos(o, x) = 0),
steps AS (SELECT o, s, substr(o, s, 1) AS x, substr(o, 1, s - 1) AS before FROM grown CROSS JOIN (SELECT unnest(range(1, 6))::INT AS s) WHERE length(o) = 5),
judged AS (
  SELECT part, o, s, x, n, good, toxic, fails, strpos(fails, x) > 0 AS own,
         CASE WHEN fails = '' OR before = '' THEN false ELSE regexp_matches(fails, '[' || before || ']') END AS earlier
  FROM counts CROSS JOIN steps),
summed AS (
  SELECT part, o, s, x, sum(n) FILTER (WHERE NOT own AND NOT earlier) AS kept, sum(n) FILTER (WHERE own AND NOT earlier) AS removed,
         sum(n) FILTER (WHERE own AND earlier) AS redundant, sum(n) FILTER (WHERE fails = x) AS unique_fails,
         sum(good) FILTER (WHERE own AND NOT earlier) AS good_lost, sum(toxic) FILTER (WHERE own AND NOT earlier) AS toxic_lost
  FROM judged GROUP BY part, o, s, x)
SELECT part, o AS filter_order, s AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
       coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, x), 0)::BIGINT AS shapley
FROM summed""",
}


def oracle_sql() -> dict[str, str]:
    return SQL
