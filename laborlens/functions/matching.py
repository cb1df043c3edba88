"""Sets compared in blocks inside tasks: classes of postings with classes of people, by bits."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of the library

#: Classes of postings, and of people, that one task compares, and how many of them at once.
MANY_POSTINGS, MANY_PEOPLE = 65_536, 8_192
STEP_POSTINGS, STEP_PEOPLE = 4_096, 256
BLOCK_TYPES = dict.fromkeys(("group_id", "class_id", "total_skills", "matched", "total_count", "new_count"), pa.int64())


def _bits(skills: pa.ListArray, known: np.ndarray) -> np.ndarray:
    """Sets of skills as rows of bits, a bit for each of the sorted ``known`` skills; others are left out."""
    row, skill = np.repeat(np.arange(len(skills)), skills.value_lengths()), skills.flatten().to_numpy()
    at = np.minimum(np.searchsorted(known, skill), len(known) - 1)
    row, at = row[known[at] == skill], at[known[at] == skill]
    out = np.zeros((len(skills), -(-len(known) // 64)), np.uint64)
    np.bitwise_or.at(out, (row, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    return out


def best_of_block(threshold: float, k: int):
    """Compares classes of postings with classes of people, all with all, by counts of common bits; keeps of each class of
    people the counts and the first ``k`` by share, then by the postings' own order."""

    def of(postings: pa.Table, people: pa.Table) -> pa.Table:
        if not (postings.num_rows and people.num_rows):
            return pa.table({f: pa.array([], t) for f, t in BLOCK_TYPES.items()})
        postings = postings.sort_by([("posted_at", "descending"), ("job_id", "ascending")])  # nulls come last
        column = lambda t, name: t.column(name).combine_chunks()
        asked, own = column(postings, "asked"), column(people, "own")
        known = np.unique(asked.flatten().to_numpy())
        asked, own = _bits(asked, known), _bits(own, known)
        job, total, weight = column(postings, "job_id").to_numpy(), column(postings, "total_skills").to_numpy(), np.stack([column(postings, c).to_numpy() for c in ("n", "n_new")], 1).astype(float)
        need, person = np.ceil(threshold * total), column(people, "group_id").to_numpy()
        parts = []
        for p in range(0, len(person), STEP_PEOPLE):
            mine = own[p : p + STEP_PEOPLE]
            counts, least = np.zeros((len(mine), 2)), np.full(len(mine), -1, np.int64)
            kept = [np.zeros(0, np.int64)] * 4  # row, order (greater is better), posting, matched
            for j in range(0, len(job), STEP_POSTINGS):
                matched = sum(np.bitwise_count(mine[:, None, i] & asked[None, j : j + STEP_POSTINGS, i]).astype(np.uint16) for i in range(asked.shape[1]))
                hit = matched >= need[j : j + STEP_POSTINGS].astype(np.uint16)
                counts += hit @ weight[j : j + STEP_POSTINGS]
                row, at = np.nonzero(hit)
                order = np.floor(matched[row, at] / total[j + at] * 10_000 + 0.5).astype(np.int64) * len(job) + (len(job) - 1 - j - at)
                better = order > least[row]
                row, at, order = row[better], at[better], order[better]
                if len(row):
                    kept = [np.concatenate(x) for x in zip(kept, (row, order, j + at, matched[row, at].astype(np.int64)), strict=True)]
                    by = np.lexsort((-kept[1], kept[0]))
                    kept = [x[by] for x in kept]
                    rank = np.arange(len(by)) - np.searchsorted(kept[0], kept[0])
                    full = rank == k - 1
                    least[kept[0][full]] = kept[1][full]
                    kept = [x[rank < k] for x in kept]
            # A row a class of people with its counts, then one for each of its best classes of postings.
            found = np.nonzero(counts[:, 0])[0]
            none = np.full(len(found), -1, np.int64)
            parts.append((person[p + np.concatenate([found, kept[0]])], np.concatenate([none, job[kept[2]]]), np.concatenate([none, total[kept[2]]]), np.concatenate([none, kept[3]]), *(np.concatenate([counts[found, i].astype(np.int64), np.zeros(len(kept[0]), np.int64)]) for i in (0, 1))))
        return pa.table({f: pa.array(np.concatenate(x).astype(np.int64)) for f, x in zip(BLOCK_TYPES, zip(*parts, strict=True), strict=True)})

    return of
