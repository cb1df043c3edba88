"""Weekly scores, however the events are dealt to files and tasks."""

from __future__ import annotations

import os

import duckdb

from laborlens import star

SF = "/root/testdata/sf0.1"


def test_scores_do_not_follow_the_files(spark, tmp_path):
    for name in os.listdir(SF):
        if name.endswith(".parquet") and name != "events.parquet":
            os.symlink(f"{SF}/{name}", tmp_path / name)
    spark.read.parquet(f"{SF}/events.parquet").repartition(7).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    want = {(p, str(w)): s for p, w, s in con.execute(star.SQL["person_weeks"]).fetchall()}
    assert {(r.person_id, str(r.week_start)): r.position_score for r in star.from_tables(spark, str(tmp_path)).person_weeks.collect()} == want
