"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from laborlens import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each shape; the driver runs all of them.
NAMES = [
    "c01_skill_demand", "c02_skill_growth", "c03_company_growth", "c06_salary_band", "c08_role_trend", "c10_ai_exposure", "c15_alternative_roles", "c16_person_alternatives", "c19_matched_jobs", "c22_gap_scores", "c26_co_occurrence",
    "c35_position_scores", "c39_cohort_rollup", "c44_qualification", "c55_concentration", "c64_rising_roles", "a12_mix_cube", "m01_upsert_postings", "m02_close_absent", "m04_queue_titles", "m17_upsert_candidates", "m27_sync_person_skills",
    "x01_page_texts", "x08_tag_documents", "x07_display_names", "x13_clean_candidates", "x20_countries", "x24_delevel", "x26_canonical_titles", "x30_mapped_candidates", "x36_non_english", "c17_role_cards", "u04_market_boards", "c37_week_snapshots", "f09_find_role",
]


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v)
    return round(float(v), 6)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_registry_is_consistent(spark):
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
