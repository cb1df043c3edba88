"""Conversation trie, repeated passages and filter audit against brute force; records and rows that once broke operators."""

from __future__ import annotations

import contextlib
import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from laborlens.llm import chat_format, conv_trie, filter_audit, lang_id, near_dedup, suffix_dedup

rng = random.Random(11)
CLASH = {"node": "x", "shard": 1, "id": 5, "th": 6, "n_bytes": 7, "kept": "k", "row": 2, "part": "p", "key": 3}


# Conversations


def conversations() -> list[tuple]:
    rows = []
    for c in range(60):
        if c % 7 == 3:
            continue  # some bases are absent
        for t in range(rng.randint(1, 9) if c % 11 else 1):
            rows.append((c, t, rng.choice(["user", "assistant", None]), f"t{rng.randint(0, 1)}" if t else rng.choice(["hallo", "grüß dich", None])))
    rows += [(200, None, "user", "first"), (200, 0, "user", "second"), (200, 0, "user", "second"), (200, 0, "assistant", None), (None, 0, "user", "nobody's"), (-5, 1, "user", "below zero")]
    return rows + [(300 + i, t, "user", f"long {t}") for i in range(3) for t in range(40)]


def trie_by_hand(rows: list[tuple]) -> list[tuple]:
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    nodes = defaultdict(list)
    ends = defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        path = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
        ends[path].append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(q[: len(p)] == p and len(q) > len(p) for q in nodes) for p in below)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        digest = hashlib.sha256(",".join(map(str, ends.get(path, []))).encode()).hexdigest()
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children), leaves, saved, digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [20_000, 25])
def test_trie_like_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(conv_trie, "ROWS_PER_SHARD", shard)
    monkeypatch.setattr(conv_trie, "CHUNK", 3)
    rows = conversations()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({k: F.lit(v) for k, v in CLASH.items()}).repartition(3)
    found = conv_trie.trie(conv_trie.grafted(conv_trie.numbered(table))).collect()
    assert sorted((tuple(r) for r in found), key=str) == trie_by_hand(rows)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conv_trie.trie(conv_trie.grafted(conv_trie.numbered(none))).collect() == []


# Passages


def passages_by_hand(rows: list[tuple]) -> dict:
    """By (id, text): rows as the operator orders them, ids first, none last; equal rows are no copies of each other."""
    seen, out = {}, {}
    for key in sorted({(i is None, i or 0, th, t or "") for i, th, t in rows}, key=lambda k: k[:3]):
        raw = key[3].encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.setdefault(raw[s : s + 100], key)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[None if key[0] else key[1], key[3]] = len(raw), sum(gone), spans, bytes(x for x, g in zip(raw, gone, strict=True) if not g)
    return out


def passages() -> list[tuple]:
    words = ["".join(rng.choices("abcdeéß ", k=rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    shared, rows = prose(40), []
    for i in range(60):
        text = prose(rng.randint(5, 120))
        if i % 4 == 0:
            text = prose(rng.randint(0, 30)) + shared[rng.randint(0, 60) :] + text
        rows.append((i, text))
    for i in range(20):  # near copies, copies, parts
        w = rows[i][1].split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows += [(100 + i, " ".join(w)), (150 + i, rows[i][1]), (200 + i, rows[i][1][7:])]
    rows += [(300, "a" * 700), (301, "ab" * 300), (302, "a" * 99), (303, "a" * 100), (304, prose(3) + "a" * 260), (305, None), (306, ""), (307, "xyz" * 40 + prose(20) + "xyz" * 41)]
    rows += [(400, shared), (400, prose(30) + shared), (None, shared + prose(9)), (None, prose(30)), (5, rows[5][1]), (5, rows[5][1]), (-3, rows[8][1][3:200])]
    return rows


@pytest.mark.parametrize("size", [1 << 20, 3000])
def test_passages_like_brute_force(spark, monkeypatch, size):
    for name in ("BLOCK", "KEYS", "HASHES"):
        monkeypatch.setattr(suffix_dedup, name, size)
    table = spark.createDataFrame(passages(), "doc_id long, text string").withColumns({k: F.lit(v) for k, v in CLASH.items()}).repartition(3)
    ordered = table.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text").collect()
    want = passages_by_hand([tuple(r) for r in ordered])
    found = suffix_dedup.dedup_passages(table)
    assert set(found.columns) == {*table.columns, "n_removed", "n_spans"}
    got = found.select("doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert len(got) == len(ordered) and sum(r.n_removed for r in got) > 10_000
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id, r.text or ""]


def test_copies_are_not_sorted_and_shuffle_files_go(spark, monkeypatch):
    """Near copies leave the pieces around what differs to be sorted; a step leaves no shuffle files."""
    own = random.Random(5)
    word = lambda: "".join(own.choices("abcdefgh", k=own.randint(2, 9)))
    texts = [[word() for _ in range(400)] for _ in range(12)]
    rows = [(100 * k + i, " ".join([*t[: 30 * k], "changed", *t[30 * k :]] if k else t)) for k in range(6) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "id long, text string").select("id", F.xxhash64("text").alias("th"), "text")
    dirs = [Path(d.getPath()) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f: f.stat().st_size for d in dirs for f in d.rglob("shuffle_*.data")}
    before, left, sorted_bytes, keep = files(), None, {}, suffix_dedup.Steps.keep

    def kept(self, df, name):
        out = keep(self, df, name)
        if "text" in out.columns:
            sorted_bytes[name] = out.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        return out

    monkeypatch.setattr(suffix_dedup.Steps, "keep", kept)
    found = suffix_dedup.repeated(docs)
    for _ in range(50):
        with contextlib.suppress(OSError):  # a file may go meanwhile
            if (left := sum(n for f, n in files().items() if f not in before)) < 10_000:  # sums, but no texts
                break
        time.sleep(0.2)
    assert left < 10_000
    assert 0 < sorted_bytes["suffix-state"] < sum(len(t) for _, t in rows) / 4
    want = passages_by_hand([(r.id, r.th, r.text) for r in docs.collect()])
    spans = docs.join(found, ["id", "th"]).groupBy("id", "text").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("s")).collect()
    assert {r.id: len({x for b, e in r.s for x in range(b, e + 99)}) for r in spans} == {i: w[1] for (i, _), w in want.items() if w[1]}


def test_hashes_tell_strings_apart():
    text = np.frombuffer(random.Random(3).randbytes(5000), np.uint8)
    h = suffix_dedup._hashes(np.concatenate([text, text]), suffix_dedup.GRAM)
    assert len(h) == 10_001 - suffix_dedup.GRAM and len(set(h[:5000].tolist())) == 5000
    assert (h[: len(h) - 5000] == h[5000:]).all()


def test_passages_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.dedup_passages(none).collect() == []


# Filters


def audit_by_hand(rows: list[tuple], labels: list[tuple]) -> dict:
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = defaultdict(list)
    for i, text, source in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and least[t] < i]
        docs[source or ""].append(({x for x, f in zip("ABCDE", fails, strict=True) if f}, i in good, i in toxic))
    out = {}
    for part, all_ in docs.items():
        total = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, x in enumerate(order):
                before, gone = set(order[:k]), [d for d in all_ if x in d[0] and not d[0] & set(order[:k])]
                total[x] += len(gone)
                out[part, order, k + 1] = [sum(not d[0] & {*before, x} for d in all_), len(gone), sum(x in d[0] and bool(d[0] & before) for d in all_), sum(d[0] == {x} for d in all_), sum(d[1] for d in gone), sum(d[2] for d in gone), x]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = total[row[-1]]
    return out


def filtered() -> tuple[list[tuple], list[tuple]]:
    texts = ["", "one two three", "Shouting LOUD " * 30, " ".join(f"w{i}" for i in range(220)), "again " * 230, "a $ sign\tand more\x0b" * 20, None]
    rows = [(rng.randint(0, 200), rng.choice(texts), rng.choice(["s1", "s2", None])) for _ in range(150)]
    rows += [(None, "one two three", "s1"), (None, "one two three", "s2"), (7, "one two three", "s1"), (7, "one two three", "s1")]
    labels = [(i, rng.randint(0, 1), rng.choice([0, 1, None])) for i in range(0, 200, 2)] + [(4, 1, 1), (None, 1, 1)]
    return rows, labels


FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_like_brute_force_batch_by_batch(spark, tmp_path):
    rows, labels = filtered()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    folder = str(tmp_path / "state")
    for k in range(3):  # later files hold smaller ids too, so that earlier verdicts are retracted
        upto = rows[: len(rows) * (k + 1) // 3]
        part = spark.createDataFrame(rows[len(rows) * k // 3 : len(upto)], "doc_id long, text string, source string").withColumns({"mask": F.lit(1), "n": F.lit(2)})
        part.repartition(2).write.mode("append").parquet(str(tmp_path / "docs"))
        stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "docs"))
        filter_audit.advance(stream, marks, folder)
        got = filter_audit.interactions(filter_audit.counted(spark, folder)).collect()
        want = audit_by_hand(upto, labels)
        assert {(r["part"], r.filter_order, r.step): [r[f] for f in FIELDS] for r in got} == want and len(got) == len(want)
    changes = spark.read.parquet(f"{folder}/changes")
    assert changes.filter("n < 0").count() > 0


def test_audit_of_files_and_of_nothing(spark, tmp_path):
    rows, labels = filtered()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.repartition(5).write.parquet(str(tmp_path / "docs.parquet"))
    got = filter_audit.audit(spark, str(tmp_path / "docs.parquet"), marks, batches=3).collect()
    assert {(r["part"], r.filter_order, r.step): [r[f] for f in FIELDS] for r in got} == audit_by_hand(rows, labels)
    docs.filter("false").write.parquet(str(tmp_path / "none.parquet"))
    assert filter_audit.audit(spark, str(tmp_path / "none.parquet"), marks).collect() == []


# What once broke an operator


def test_records_with_half_surrogates_or_deep_nesting(spark):
    deep = '{"messages":' + "[" * 5000 + "]" * 5000 + "}"
    below = '{"messages":[{"role":"user","content":' + '{"a":' * 900 + "1" + "}" * 900 + "}]}"
    half = '{"messages":[{"role":"us\\ud800er","content":"x\\udfffy \\ud83d\\ude00"}],"\\ud801":1}'
    records = spark.createDataFrame([(1, deep), (2, half), (3, below), (4, '{"\\ud800":1}')], "conv_id long, record string")
    found = {r.conv_id: r for r in chat_format.canonical_turns(records).collect()}
    assert found[1].layout is None and found[1].turns is None
    assert [tuple(t) for t in found[2].turns] == [("us�er", "x�y \U0001f600")]
    assert found[3].layout in (None, "messages")
    assert found[4].layout is None and found[4].paths == ["�"]
    assert len(chat_format.format_turns(chat_format.canonical_turns(records)).collect()) >= 1


def test_repeated_rows_give_one_set(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, text)] * 200 + [(2, text + " more")], "doc_id long, text string")
    rep = lambda r: F.struct(F.col("doc_id"), F.col("t"))
    wanted = near_dedup._row(docs).select("doc_id", "t").distinct().select(rep(0).alias("rep"), rep(0).alias("root"), F.lit(1).alias("blocks"), F.lit(0).alias("block"))
    assert 2 <= near_dedup._members(docs, wanted, 5).count() <= 2 * docs.rdd.getNumPartitions()
    assert {r.component_id for r in near_dedup.near_duplicates(docs, 5, 80).collect()} == {1}


def test_a_model_of_no_language_keeps_all(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert lang_id.keep_identified(docs, lang_id.fit(docs)).count() == 2
