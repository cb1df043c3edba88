"""Blocks of postings and people against counting pair by pair."""

from __future__ import annotations

import random

import pyarrow as pa

from laborlens.functions import matching


def test_blocks_keep_counts_and_best_like_brute_force(monkeypatch):
    monkeypatch.setattr(matching, "STEP_POSTINGS", 7)
    monkeypatch.setattr(matching, "STEP_PEOPLE", 3)
    r = random.Random(3)
    some = lambda n: sorted(r.sample(range(100, 200), n))
    jobs = [(i, r.choice([None, 5, 6, 7]), some(r.randint(3, 9)), r.randint(1, 4), r.randint(0, 1)) for i in range(60)]
    people = [(1000 + i, sorted({*r.choice(jobs)[2], *some(30)} | {7})) for i in range(11)] + [(2000, [1, 2])]
    left = pa.table({"job_id": [j[0] for j in jobs], "posted_at": pa.array([j[1] for j in jobs], pa.int64()), "asked": pa.array([j[2] for j in jobs], pa.list_(pa.int64())), "total_skills": [len(j[2]) for j in jobs], "n": [j[3] for j in jobs], "n_new": [j[4] for j in jobs]})
    right = pa.table({"group_id": [p[0] for p in people], "own": pa.array([p[1] for p in people], pa.list_(pa.int64()))})
    rows = matching.best_of_block(0.6, 4)(left, right).to_pylist()
    for person, own in people:
        hits = [(len({*j[2]} & {*own}), j) for j in jobs if len({*j[2]} & {*own}) >= 0.6 * len(j[2])]
        best = sorted(hits, key=lambda h: (-round(h[0] / len(h[1][2]), 4), h[1][1] is None, -(h[1][1] or 0), h[1][0]))[:4]
        mine = [x for x in rows if x["group_id"] == person]
        assert [(x["class_id"], x["matched"], x["total_skills"]) for x in mine if x["class_id"] >= 0] == [(h[1][0], h[0], len(h[1][2])) for h in best]
        assert [(x["total_count"], x["new_count"]) for x in mine if x["class_id"] < 0] == ([(sum(h[1][3] for h in hits), sum(h[1][4] for h in hits))] if hits else [])
    assert matching.best_of_block(0.6, 4)(left.slice(0, 0), right).num_rows == 0
