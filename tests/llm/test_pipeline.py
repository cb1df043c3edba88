"""The pipeline on the smallest tables, each stage against what it may and may not do."""

from __future__ import annotations

import hashlib
import re
import string

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_corpus_operators import components_by_hand, dedup_by_hand, targets_by_hand

from laborlens.llm import decontam, lang_id, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """Input and output of each stage, as written tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "src1", 0), (10**6 + 2, "12 34", "en", "src1", 5)], docs.schema)
    docs, out = docs.unionByName(odd), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_keep_the_columns(staged):
    for _, before, after in staged[:-1]:
        assert after.columns == list(corpus_pipeline.COLUMNS)
        assert after.dtypes == before.select(*after.columns).dtypes


def test_language_drops_what_has_no_letters(staged):
    _, before, after = staged[0]
    gone = {r.doc_id for r in before.join(after, "doc_id", "left_anti").collect()}
    assert {10**6, 10**6 + 1, 10**6 + 2} <= gone and len(gone) < 0.02 * before.count() + 4


def test_lines_change_texts_only(staged):
    _, before, after = staged[1]
    assert after.count() == before.count()
    assert after.filter(F.col("n_chars") != F.char_length("text")).count() == 0
    assert before.agg(F.sum(F.length("text"))).first()[0] > after.agg(F.sum(F.length("text"))).first()[0]


def as_rows(df) -> list[tuple]:
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()]


def test_lines_like_brute_force(staged):
    _, before, after = staged[1]
    want = dedup_by_hand(as_rows(before))
    assert {r.doc_id: r.text for r in after.collect()} == {i: kept for i, (_, _, kept) in want.items()}


def test_near_duplicates_like_brute_force(staged):
    _, before, after = staged[2]
    rows = as_rows(before)
    want = components_by_hand(rows, 5)
    assert sorted(as_rows(after)) == sorted(r for r in rows if want[r[0]][0] == r[0]) and len(rows) > after.count()


def test_contamination_like_brute_force(staged, spark):
    _, before, after = staged[3]
    split = lambda t: re.findall(decontam.BENCH_WORD, "".join(c.lower() if c in string.ascii_uppercase else c for c in t or ""))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = split(r.text)
        windows |= {tuple(w[i : i + 13]) for i in range(max(len(w) - 12, 1))} if w else set()

    def contaminated(text: str) -> bool:
        words = split(text)
        hit = {i + j for n in {len(w) for w in windows} for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in windows for j in range(n)}
        return bool(hit) and 20 * len(hit) >= len(words)

    rows = as_rows(before)
    assert sorted(as_rows(after)) == sorted(r for r in rows if not contaminated(r[1])) and len(rows) > after.count()


def test_mix_like_brute_force(staged):
    _, before, after = staged[4]
    rows = as_rows(before)
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in rows}
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size[r[0]]
    want, got = targets_by_hand(sizes), after.collect()
    assert {(r.doc_id, r.text, r.source) for r in got} <= {(r[0], r[1], r[3]) for r in rows}
    for s, total in sizes.items():
        own = [r for r in rows if r[3] == s]
        hashed = sorted((int(hashlib.md5(str(r[0]).encode()).hexdigest()[:6], 16), r[0]) for r in own)
        passes, budget, times, upto = int(want[s] // total) if total else 0, want[s] % total if total else 0, {}, 0
        for _, i in hashed:
            times[i] = passes + (2 * (upto + size[i]) - size[i] <= 2 * budget)
            upto += size[i]
        assert {r.doc_id: (r.times, r.taken, r.size) for r in got if r.source == s} == {i: (n, n * size[i], size[i]) for i, n in times.items() if n * size[i]}


def test_stages_take_empty_tables_repeats_and_clashing_columns(spark, staged):
    docs = staged[0][1]
    clash = {"row": "x", "t": 1, "size": 2, "kept": False, "key": "k", "rep": 3, "times": 4, "bad_key": 5, "n_lines": 6}
    some = docs.filter("doc_id < 40").withColumns({k: F.lit(v) for k, v in clash.items()})
    again = some.unionByName(some.filter("doc_id < 5")).unionByName(some.filter("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == [], name
        plain, odd = stage(spark, again, SF), stage(spark, again.drop(*clash), SF)
        assert plain.columns == odd.columns and sorted(map(repr, plain.collect())) == sorted(map(repr, odd.collect())), name


def test_mix_comes_near_its_targets(staged):
    _, before, after = staged[4]
    by = after.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("largest")).collect()
    assert by and all(abs(r.taken - r.target) <= max(r.largest, 1) + 1 for r in by if r.target >= r.largest)


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op9_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang_pred <> 'und'")
    assert got.filter(F.col("lang") == F.col("lang_pred")).count() > 0.97 * got.count()
    assert lang_id.fit(docs, per_lang=50).langs == ["de", "en", "es", "fr"]
