"""Each operator against brute force on small tables, with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import json
import random
import re
import string
import time
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from laborlens.llm import chat_format, decontam, graph, lang_id, licenses, line_dedup, mixing, near_dedup, quality, url_filter, warc
from laborlens.llm.common import lookup, shared_folder
from laborlens.llm.cuckoo import Cuckoo
from laborlens.llm.graph import connected

DOCS = "doc_id long, text string, lang string, source string, n_chars int"
#: Columns whose names are those that operators use inside.
CLASH = {"key": "k", "size": 1, "h": 2, "k1": 3, "b_source": "b", "target": 0.5, "rep": 9, "root": 8, "n_lines": 7, "bad_id": 6}
rng = random.Random(7)
WORDS = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 8))) for _ in range(400)]


def sentence(n: int) -> str:
    return " ".join(rng.choices(WORDS, k=n))


def corpus() -> list[tuple]:
    base = [sentence(rng.randint(30, 120)) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t)) for i, t in enumerate(base)]
    for i in range(20):  # near copies
        words = base[i].split()
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = "changed"
        rows.append((100 + i, " ".join(words), "en", "s0", 0))
    shared = "A line that many of the documents share, word by word"
    rows += [(200 + i, f"{sentence(25)}\n  {shared.upper() if i % 2 else shared} \n{sentence(25)}", None, "s1", 0) for i in range(6)]
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, " \n\t\n", "en", "s2", 0), (303, sentence(30_000), "de", "s2", 0)]
    return rows + [rows[0], rows[0], rows[85]]


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({k: F.lit(v) for k, v in CLASH.items()}).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# Helpers


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_of_hot_and_null_keys(spark, how):
    keys = ["hot"] * 3000 + [f"k{i % 700}" for i in range(1400)] + ["alone", None, None]
    rows = spark.createDataFrame([(k, i % 2, i) for i, k in enumerate(keys)], "k string, side int, i int")
    table = spark.createDataFrame([(k, 0, n, f"v{k}") for k, n in Counter(keys).items() if k not in ("alone", "k3")], "k string, side int, n long, v string")
    met = lookup(rows, table, ["k", "side"], len(keys), how)
    assert met.columns == ["k", "side", "i", "n", "v"]
    want = {(i, f"v{k}" if k not in (None, "alone", "k3") and i % 2 == 0 else None) for i, k in enumerate(keys)}
    assert {(r.i, r.v) for r in met.collect()} == (want if how == "left" else {w for w in want if w[1]})


def test_a_folder_that_executors_share_is_needed(monkeypatch):
    conf = SimpleNamespace(get=lambda key, default: default)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)


# Mixing


def targets_by_hand(sizes: dict, most: float = 3.0) -> dict:
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, budget, out = set(sizes), float(sum(sizes.values())), {}
    while left:
        level = budget / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > most * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in left}
        out |= {s: most * sizes[s] for s in over}
        budget -= sum(most * sizes[s] for s in over)
        left -= over
    return out


def test_mix_reaches_targets(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    source = {r[0]: r[3] for r in rows}
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size[r[0]]
    want, taken = targets_by_hand(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[s])
        assert r.target == pytest.approx(want[s])
        assert r.taken in (r.size * k for k in range(4))
        taken[s] += r.taken
    for s, n in taken.items():
        largest = max((size[d] for d in size if source[d] == s), default=0)
        assert abs(n - want[s]) <= largest, s
    assert sorted(got) == sorted(mixing.mix(docs.repartition(3)).collect())


@pytest.mark.parametrize("map_side", [mixing.MAP_SIDE_SOURCES, 0])
def test_mixed_rows_keep_their_columns(docs, rows, map_side, monkeypatch):
    monkeypatch.setattr(mixing, "MAP_SIDE_SOURCES", map_side)
    got = mixing.mixed(docs).collect()
    assert sorted((r.row.doc_id, r.row.text, r.row.source) for r in got if r.row.text) == sorted((r[0], r[1], r[3]) for r in rows if r[1])
    assert all(r.row.key == "k" and r.row.target == 0.5 and r.taken == r.size * r.times for r in got) and len(got) == len(rows)
    assert sorted((r.row.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mixing.mix(docs).collect())


def test_smaller_budget_takes_a_subset(docs):
    less = {r.doc_id for r in mixing.mix(docs, share=0.3, most=1.0).collect() if r.taken}
    more = {r.doc_id for r in mixing.mix(docs, share=0.6, most=1.0).collect() if r.taken}
    assert less < more


def test_mix_of_nothing(none, spark):
    assert mixing.mix(none).collect() == []
    empty = spark.createDataFrame([(1, None, None, None, None), (2, "", None, "a", 0)], DOCS)
    assert {(r.size, r.target, r.taken) for r in mixing.mix(empty).collect()} == {(0, 0.0, 0)}


# WARC


def test_audit_finds_every_difference(spark):
    pages = [(i, f"http://h{i}/", "x" * (i * 37 % 5000) + str(i)) for i in range(300)] + [(5000, None, None)]
    a = spark.createDataFrame(pages, "page_id long, url string, html string")
    changed = {3, 77, 250}
    b = a.withColumn("html", F.when(F.col("page_id").isin(changed), F.translate("html", "x0123456789", "y9876543210")).otherwise(F.col("html")))
    found = warc.audit(warc.records(a, 100), warc.records(b, 100)).collect()
    assert {r.page_id for r in found} == changed and {r.status for r in found} == {"changed"}
    assert warc.audit(warc.records(a, 100), warc.records(a.repartition(7), 100)).count() == 0
    lost = warc.records(a, 100).filter("page_id <> 150")
    assert [(r.page_id, r.status) for r in warc.audit(warc.records(a, 100), lost).collect()] == [(150, "missing")]
    assert [(r.page_id, r.status) for r in warc.audit(lost, warc.records(a, 100)).collect()] == [(150, "extra")]
    assert warc.audit(warc.records(a.limit(0)), warc.records(a.limit(0))).count() == 0


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_files_come_back_as_records(spark, tmp_path, compression):
    pages = [(i, f"http://h{i}/", "\r\n\r\n" * (i % 3) + "ü" * (i * 37 % 500) + str(i)) for i in range(250)] + [(5000, None, None), (None, "http://no-id/", "a"), (7, "http://again/", "b")]
    a = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write_files(a, str(tmp_path / "w"), 100, compression)
    read = warc.read_files(spark, str(tmp_path / "w"))
    assert sorted((r.url, r.body.decode(), r.status) for r in read.collect()) == sorted((u or "", h or "", "ok") for _, u, h in pages)
    assert warc.audit(warc.records(a, 100), warc.filed(read)).collect() == []
    other = a.withColumn("html", F.when(F.col("page_id") == 77, F.translate("html", "7", "8")).otherwise(F.col("html")))
    assert [(r.page_id, r.status) for r in warc.audit(warc.records(other, 100), warc.filed(read)).collect()] == [(77, "changed")]


def test_bad_records_are_reported(spark, tmp_path):
    good = lambda n: b"WARC/1.0\r\nWARC-Target-URI: u%d\r\nContent-Length: 2\r\n\r\nok\r\n\r\n" % n
    raw = b"\xff\xfe\x00 not utf-8"
    odd = b"WARC/1.1\r\nwarc-target-uri: raw\r\ncontent-length: %d\r\n\r\n%s\r\n\r\n" % (len(raw), raw)
    parts = [good(1), good(2), b"a line that belongs to no record\r\n\r\n", good(3), b"WARC/1.0\r\nno length here\r\n\r\nx\r\n\r\n", b"WARC/1.0\r\nContent-Length: 99\r\n\r\nshort\r\n\r\n", odd, good(4)]
    (tmp_path / "x.warc").write_bytes(b"".join(parts))
    got = warc.read_files(spark, str(tmp_path)).orderBy("offset").collect()
    assert [r.status for r in got] == ["ok", "wrong length", "ok", "no length", "wrong length", "ok", "ok"]
    assert [r.url for r in got if r.status == "ok"] == ["u1", "u3", "raw", "u4"] and got[5].body == raw
    assert all(r.digest == hashlib.sha256((tmp_path / "x.warc").read_bytes()[r.offset : r.offset + r.length]).hexdigest() for r in got)


def test_audit_of_nulls_repeats_and_clashes(spark):
    pages = [(None, f"u{i % 5}", f"page {i}") for i in range(40)] + [(None, None, None), (1, "a", "x"), (1, "a", "x"), (1, "b", "y"), (-3, "c", "z")]
    a = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"file": F.lit(1), "offset": F.lit(2), "digest": F.lit("d"), "node": F.lit(0)})
    swap = lambda c: a.withColumn("html", F.when(c, F.translate("html", "pxz", "qyw")).otherwise(F.col("html")))
    found = lambda b: sorted((str(r.page_id), r.status) for r in warc.audit(warc.records(a), warc.records(b)).collect())
    assert found(a.repartition(3)) == []
    assert found(swap(F.col("html") == "page 39")) == [("None", "changed")]
    assert found(swap(F.col("page_id") == -3)) == [("-3", "changed")]
    assert found(a.filter("html <> 'z' or html is null")) == [("-3", "missing")]


# Line dedup


def dedup_by_hand(rows: list[tuple]) -> dict:
    def key(line: str) -> str:
        return "".join(c.lower() if c in string.ascii_uppercase else c for c in line.strip(" \t\n\x0b\x0c\r"))

    held: dict = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 20:
                held.setdefault(key(line), set()).add(r[0])
    drop = {k: max(d for d in ids) for k, ids in held.items() if len(ids) >= 3}
    out = {}
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if drop.get(key(x), r[0]) == r[0]]
        out[r[0]] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_lines_like_brute_force(docs, rows, none):
    got = line_dedup.dedup_lines(docs.withColumns({"drop_id": F.lit(1), "row": F.lit(2), "stays": F.lit(3)})).collect()
    want = dedup_by_hand(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in got} == want
    assert sum(n for _, n, _ in want.values()) == 5
    assert line_dedup.dedup_lines(none).collect() == []


def test_line_dedup_is_reversible(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).select("doc_id", "text")
    late = [(i, f"{sentence(8)}\nthis is the line that comes in late") for i in range(900, 904)]
    more = spark.createDataFrame(late, "doc_id long, text string")
    first = line_dedup.build(docs)
    second = line_dedup.insert(line_dedup.insert(first, more), more)
    state = lambda s: {(r.k1, r.k2, r.doc_id) for r in s.refs.collect()}
    held = lambda s: s.filters.agg(F.sum("keys")).first()[0]
    assert held(second) == held(first) + 1
    assert line_dedup.clean(second, more).filter("n_dropped = 1").count() == 3
    two = line_dedup.delete(second, more.filter("doc_id < 902"))
    assert line_dedup.clean(two, more).filter("n_dropped > 0").count() == 0
    back = line_dedup.delete(second, more)
    assert state(back) == state(first) and held(back) == held(first)


def test_long_documents_of_repeated_lines(spark):
    """Where lines times keys are many, and where they are few, the same lines go; rows without an id lose all."""
    shared = [f"line number {i} of the long shared text" for i in range(2500)]
    rows = [(i, "\n".join([f"own first line of document {i}", *(x.upper() if i % 2 else f" {x}\t" for x in shared), "é" * 25])) for i in range(4)]
    rows += [(10, "\n".join(shared[:40])), (None, "\n".join(["a line that nobody else has got", *shared[:3]])), (None, "\n".join(shared)), (None, None)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = dedup_by_hand([r for r in rows if r[0] is not None])
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in got if r.doc_id is not None} == want
    assert sorted((r.n_lines, r.n_dropped, r.kept) for r in got if r.doc_id is None) == [(1, 0, ""), (4, 3, "a line that nobody else has got"), (2500, 2500, "")]
    assert want[0][1] == 2501 and line_dedup.SMALL < 2500 * 2500


def test_cuckoo_filter_holds_and_releases():
    r = np.random.default_rng(1)
    k1, k2 = (r.integers(-(2**63), 2**63 - 1, 20_000) for _ in range(2))
    f = Cuckoo.sized(20_000)
    assert f.insert(k1[:15_000], k2[:15_000])
    assert f.contains(k1[:15_000], k2[:15_000]).all()
    assert f.contains(k1[15_000:], k2[15_000:]).mean() < 0.01
    f.delete(k1[:5_000], k2[:5_000])
    assert f.contains(k1[5_000:15_000], k2[5_000:15_000]).all()
    assert f.contains(k1[:5_000], k2[:5_000]).mean() < 0.01
    assert (Cuckoo.load(f.dump()).table == f.table).all()
    small = Cuckoo.sized(8)
    assert not small.insert(k1[:200], k2[:200])


# Licences


def test_licenses_and_inheritance(spark, none):
    files = [
        ("a/b/c.txt", "First words here\nReleased under the MIT License.\nmore"),
        ("a/b/d/e/f.txt", "nothing to see in this file"),
        ("a/x.txt", "Licensed under the Apache License, Version 2.0."),
        ("a/y/z.txt", None),
        ("q.txt", ""),
        (None, "License"),
        ("a/b/g.txt", "this work is licensed under the GNU general public license, version 3."),
        ("a/b/h.txt", "Released under the MIT License."),
        ("long.txt", sentence(20_000)),
    ]
    table = spark.createDataFrame([(i, *f, 1) for i, f in enumerate(files)], "key long, path string, text string, score int")
    got = {r.key: r for r in licenses.scan(table).collect()}
    assert [got[i].own_license for i in range(9)] == ["MIT", None, "Apache-2.0", None, None, None, "GPL-3.0", "MIT", None]
    assert (got[1].license, got[1].license_dir) == ("MIT", "a/b")
    assert (got[3].license, got[3].license_dir) == ("Apache-2.0", "a")
    assert got[4].license is None and got[5].license is None
    assert got[6].license == "GPL-3.0" and got[6].license_dir is None
    assert licenses.scan(none.select(F.col("doc_id").alias("key"), F.col("source").alias("path"), "text")).collect() == []


def cosine_by_hand(texts: list, line: str, template: str, capped: bool = False) -> float:
    words = lambda t: re.findall(licenses.TOKEN, t.lower())
    held = [set(words(t or "")) for t in texts]
    idf = lambda w: np.log((len(texts) + 1) / (sum(w in h for h in held) + 1)) + 1
    a, b = words(line), words(template)
    cap = np.median([idf(w) for w in set(b)]) if capped else np.inf
    va, vb = ({w: x.count(w) * min(idf(w), cap) for w in x} for x in (a, b))
    return sum(va[w] * vb.get(w, 0) for w in va) / np.sqrt(sum(v * v for v in va.values()) * sum(v * v for v in vb.values())) if a else 0.0


def licenses_by_hand(files: list[tuple], least: float) -> list[tuple]:
    """(key, own, license, license_dir) by all passages and all templates, and by walking up the directories."""
    known = licenses.TEMPLATES
    texts = [t for _, _, t in files]

    def own(text: str | None) -> str | None:
        rows = (text or "").split("\n")
        passages = {"\n".join(rows[a : b + 1]) for a in range(len(rows)) for b in range(a, min(len(rows), a + licenses.WINDOW))} | {text or ""}
        best = max(((round(cosine_by_hand(texts, p, t, True), 9), -i, n) for p in passages for i, (n, t) in enumerate(sorted(known.items()))))
        return best[2] if best[0] >= least else None

    found = {t: own(t) for t in {*texts}}
    directory = lambda path: path.rpartition("/")[0] if path else ""
    stated: dict = {}
    for _, path, text in files:
        if found[text]:
            stated.setdefault(directory(path), Counter())[found[text]] += 1
    out = []
    for key, path, text in files:
        at, where = directory(path), None
        while where is None:
            if at in stated:
                where = at
            elif not at:
                break
            at = directory(at)
        license = found[text] or (where is not None and min(stated[where], key=lambda n: (-stated[where][n], n))) or None
        out.append((key, found[text], license, where if not found[text] else None))
    return out


def test_scan_like_brute_force(spark):
    r = random.Random(9)
    plain = ["some words of code", "license of nobody", "x = 1", "the work is public", "version 2 of the general idea"]
    files = []
    for i in range(120):
        path = "/".join(r.choices("abc", k=r.randint(0, 4)) + [f"f{i}"])
        rows = r.choices(plain, k=r.randint(0, 4)) + r.choices(sorted(licenses.TEMPLATES.values()), k=r.random() < 0.25)
        if r.random() < 0.1:  # a statement over two lines
            rows += licenses.TEMPLATES["MPL-2.0"].split(" the ", 1)
        r.shuffle(rows)
        files.append((i if i % 9 else None, path if i % 13 else None, "\n".join(rows) if i % 17 else None))
    files += [files[0], files[5], files[5]]
    table = spark.createDataFrame(files, "key long, path string, text string").withColumns({c: F.lit("x") for c in ("dir", "above", "license", "score", "row", "token")})
    got = licenses.scan(table, licenses.TEMPLATES).collect()
    nulls = lambda rows: sorted(rows, key=lambda x: [str(v) for v in x])
    want = licenses_by_hand(files, 0.75)
    assert nulls((x.key, x.own_license, x.license, x.license_dir) for x in got) == nulls(want)
    assert len({w[1] for w in want}) > 5 and sum(w[2] is not None and w[1] is None for w in want) > 20 and any(w[0] is None and w[1] for w in want)


def test_license_scores_are_cosines(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "this work is licensed under the General Public License version 3", "license", sentence(40), None, "under the of"]
    table = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    got = {r.key: (r.license, r.score) for r in licenses.own_licenses(table, least=0.3).collect()}
    for i, t in enumerate(texts):
        scores = {n: cosine_by_hand(texts, t or "", s) if t else 0.0 for n, s in licenses.TEMPLATES.items()}
        best = max(sorted(scores), key=scores.get)
        if scores[best] >= 0.3:
            assert got[i][0] == best and got[i][1] == pytest.approx(scores[best], abs=1e-6)
        else:
            assert i not in got


def test_statements_outlast_a_growing_corpus(spark):
    """A template's word that few files or none hold doesn't push true statements under the threshold."""
    for n in (400, 20_000):
        plain = spark.range(n).select("id", F.lit("all the words of a plain file").alias("text"))
        stated = spark.range(n, n + n // 100).select("id", F.lit("some words\nAll rights reserved.").alias("text"))
        table = plain.unionByName(stated).select(F.col("id").alias("key"), F.lit("a/b").alias("path"), "text")
        for templates in (None, {"Proprietary": "Copyright. All rights reserved."}):
            assert licenses.scan(table, templates).filter("own_license = 'Proprietary'").count() == n // 100


def test_notices_and_licence_texts(spark):
    texts = dict((p, t) for p, t in licenses.known_texts() if t.count("\n") > 5)
    notice = "\n".join(f"# {' '.join(w)}" for w in (lambda t: [t[i : i + 9] for i in range(0, len(t), 9)])(licenses.NOTICES[0][1].split()))
    code = "\n".join(sentence(6) for _ in range(150))
    files = [(i, f"d{i}/LICENSE", t, p) for i, (p, t) in enumerate(sorted(texts.items()))]
    files += [(50, "x/a.py", f"#!/bin/sh\n{notice}\n{code}", "Apache-2.0"), (51, "x/b.py", f"{code}\n{texts['MIT']}\n{code}", "MIT"), (52, "y/c.py", code, None)]
    got = {r.key: r.own_license for r in licenses.scan(spark.createDataFrame(files, "key long, path string, text string, want string")).collect()}
    assert got == {f[0]: f[3] for f in files} and len(texts) >= 8


# Chat


def test_layouts_become_turns(spark):
    records = {
        1: {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "id": 5},
        2: {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        3: {"instruction": "do", "input": "this", "output": "b"},
        4: {"instruction": "a", "output": "b", "system": "be good"},
        5: {"prompt": "a", "completion": "b"},
        6: {"question": "a", "answer": "b", "meta": {"x": [1]}},
        7: {"unknown": 1},
        8: [1, 2],
    }
    table = spark.createDataFrame([(k, json.dumps(v)) for k, v in records.items()] + [(9, None), (10, "{broken")], "conv_id long, record string")
    got = {r.conv_id: r for r in chat_format.canonical_turns(table).collect()}
    plain = [("user", "a"), ("assistant", "b")]
    turns = {k: [tuple(t) for t in r.turns] if r.turns is not None else None for k, r in got.items()}
    assert turns[1] == turns[2] == turns[5] == turns[6] == plain
    assert turns[3] == [("user", "do\n\nthis"), ("assistant", "b")]
    assert turns[4] == [("system", "be good"), *plain]
    assert all(turns[k] is None for k in (7, 8, 9, 10))
    assert got[3].fingerprint != got[4].fingerprint and got[1].fingerprint != got[2].fingerprint


def test_no_record_is_lost(spark):
    records = {
        1: {"messages": [{"role": "user", "content": "a"}], "prompt": "of another layout"},
        2: {"messages": []},
        3: {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image", "url": "x"}, "b"]}, {"role": "assistant", "content": None}]},
        4: {"question": "q", "context": "c", "answer": "b"},
        5: {"instruction": "do", "context": "this", "response": "b", "category": "qa"},
        6: {"messages": [{"role": "user", "content": ""}], "system": ""},
        7: {"text": "plain"},
        8: {"text": "plain too"},
        9: {"prompt": "no answer"},
        10: {"messages": [{"text": "other fields"}]},
    }
    table = spark.createDataFrame([(k, json.dumps(v)) for k, v in records.items()] + [(11, "[]"), (12, None)], "conv_id long, record string").withColumn("layout", F.lit("clash"))
    canonical = chat_format.canonical_turns(table)
    got = {r.conv_id: r for r in canonical.collect()}
    turns = {k: [tuple(t) for t in r.turns] for k, r in got.items() if r.turns is not None}
    assert turns == {
        1: [("user", "a")],
        2: [],
        3: [("user", 'a\n{"type": "image", "url": "x"}\nb'), ("assistant", "")],
        4: [("user", "c\n\nq"), ("assistant", "b")],
        5: [("user", "do\n\nthis"), ("assistant", "b")],
        6: [("system", ""), ("user", "")],
    }
    unknown = {tuple(r.paths): r.n for r in chat_format.unknown_layouts(canonical).collect()}
    assert unknown == {("text",): 2, ("prompt",): 1, ("messages[].text",): 1, (): 2}
    formatted = {r.conv_id: r.formatted for r in chat_format.format_turns(canonical).collect()}
    assert sorted(formatted) == [1, 2, 3, 4, 5, 6] and formatted[2] == ""


def test_rows_take_several_layouts(spark):
    rows = [(c, t, r, f"{c} {t}") for c in range(40) for t, r in enumerate(["user", "assistant", "user"][: 1 + c % 3])]
    records = chat_format.records_of_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = chat_format.canonical_turns(records).collect()
    assert {r.layout for r in got} == {"messages", "turns", "prompt"}
    assert {(r.conv_id, i, t.role, t.text) for r in got for i, t in enumerate(r.turns)} == set(rows)


def test_template_round_trip():
    pieces = ["### ", "</turn>", "\\", "\n", "assistant:", "#", "<", "é", "ok", ":\n", "\n</turn>\n"]
    r = random.Random(3)
    for _ in range(3000):
        turns = [(r.choice(["user", "assistant", "a\\n\nb:", ""]), "".join(r.choices(pieces, k=r.randint(0, 8)))) for _ in range(r.randint(0, 4))]
        text, spans = chat_format.render(turns)
        assert chat_format.read_back(text) == turns
        assert [chat_format.unescape(text[a:b]) for a, b in spans] == [t for role, t in turns if role == "assistant"]


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, None, "é" * 50_000), (3, 0, "assistant", None), (3, 0, "assistant", None), (None, 0, "user", "x")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, record string")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_turns(chat_format.canonical_turns(chat_format.records_of_rows(table)))).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nassistant\nb\n") and (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (2, 1, sha("b"))
    assert got[2].loss_chars == 0 and got[2].formatted_chars == 50_000 + 4 + 2 + 9
    assert got[3].n_turns == 2 and len(got) == 4
    empty = chat_format.records_of_rows(table.limit(0))
    assert chat_format.digests(chat_format.format_turns(chat_format.canonical_turns(empty))).count() == 0


# Decontamination


def contamination_by_hand(text: str | None, items: list[tuple], window: int) -> tuple:
    split = lambda t: re.findall(decontam.BENCH_WORD, "".join(c.lower() if c in string.ascii_uppercase else c for c in t or ""))
    words, hit, found = split(text), set(), set()
    for item, t in items:
        w = split(t)
        for s in range(max(len(w) - window + 1, 1) if w else 0):
            part = w[s : s + window]
            for at in range(len(words) - len(part) + 1):
                if words[at : at + len(part)] == part:
                    hit |= set(range(at, at + len(part)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("map_side", [1 << 20, 0])
def test_contamination_like_brute_force(spark, map_side):
    a, b = sentence(40), sentence(20)
    items = [(1, a), (2, b), (10, a), (3, "two words"), (4, ""), (5, None), (6, "lone"), (1, a), (7, "! ,")]
    texts = [f"{sentence(50)} {a} {sentence(10)}", f"x {b.upper()}, {b}", " ".join(a.split()[5:18]), " ".join(a.split()[5:17]), "Two, WORDS and lone", None, "", "lone", sentence(3000) + " lone", sentence(600)]
    odd = [(0, texts[0]), (0, "other text, same id lone"), (None, texts[0]), (None, "clean text without an id")]
    table = spark.createDataFrame([*enumerate(texts), *odd], "doc_id long, text string").withColumns({"key": F.lit(1), "wid": F.lit(2), "item": F.lit("x")})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit("clash"))
    got = decontam.contamination(table, bench, 13, map_side).collect()
    want = [contamination_by_hand(t, items, 13) for t in [*texts, *(t for _, t in odd)]]
    assert sorted((r.n_words, r.n_hit, r["items"], r.contaminated) for r in got) == sorted(want)
    assert decontam.contamination(table, bench.limit(0)).filter("contaminated or n_hit > 0").count() == 0
    assert decontam.contamination(table.limit(0), bench).count() == 0
    table = table.withColumn("bad_id", F.lit(1))
    kept = decontam.decontaminate(table, bench)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {3, 5, 6, 8, 9, None}


# Near duplicates


def components_by_hand(rows: list[tuple], k: int, percent: int = 80) -> dict:
    def shingles(t: str | None) -> frozenset:
        w = "".join(c.lower() if c in string.ascii_uppercase else c for c in t or "").split()
        return frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))) if w else frozenset()

    sets: dict = {}
    for r in rows:
        sets.setdefault(r[0], set()).add(shingles(r[1]))
    ids, least = sorted(sets), {i: i for i in sets}
    links = [(a, b) for a in ids for b in ids if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b])]
    for _ in ids:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return {i: (least[i], {len(s) for s in sets[i]}) for i in ids}


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 300])
def test_components_like_brute_force(spark, docs, rows, block):
    base = sentence(60).split()
    chain = [(500 + i, " ".join(base[i:] + WORDS[:i])) for i in range(12)] + [(600 + i, " ".join(rng.choices(WORDS, k=2) + base)) for i in range(9)]
    short = [(700, "one two"), (701, "One  TWO"), (702, "one two three"), (703, "one")]
    more = [(i, t, "en", "s", 0) for i, t in chain + short]
    table = spark.createDataFrame([*rows, *more], DOCS).withColumns({k: F.lit(v) for k, v in CLASH.items()})
    got = near_dedup.near_duplicates(table, 4, 80, block).collect()
    want = components_by_hand([*rows, *more], 4)
    assert len(got) == len(rows) + len(more)
    assert {r.doc_id: (r.component_id, r.kept) for r in got} == {i: (c, c == i) for i, (c, _) in want.items()}
    assert all(r.n_shingles in want[r.doc_id][1] for r in got)


def test_near_duplicates_of_nothing(spark, none):
    assert near_dedup.near_duplicates(none).collect() == []
    got = near_dedup.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, "")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, None, True), (1, 1, True), (2, 2, True), (3, 3, True)}


def test_one_document_of_a_group_stays(spark):
    long = sentence(50)
    rows = [(1, long), (2, long), (2, long), (3, sentence(50)), (3, "other text, same id"), (None, long), (4, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"gone_id": F.lit(1), "again_id": F.lit(1), "kept": F.lit(1)})
    left = near_dedup.drop_near_duplicates(table)
    assert left.columns == table.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "3", "3", "4", "None"]


def test_texts_that_share_an_id(spark):
    a, b = sentence(60), sentence(60)
    near = " ".join([*a.split()[:-1], "changed"])
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, n int")
    rows = [(3, a, 0), (3, b, 0), (7, near, 0)]
    for some in (rows, [*rows, (1, a, 0)], [(9, b, 0), *rows, (2, near, 0)]):
        got = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.near_duplicates(table(some)).collect()}
        assert got == {i: (c, c == i) for i, (c, _) in components_by_hand(some, 5).items()}
        texts = sorted({t for _, t, _ in some}, key=lambda t: t != near)
        left = near_dedup.drop_near_duplicates(table(some)).collect()
        assert sorted(r.text == b for r in left) == [False, True] and len(texts) == 3
        assert min(i for i, t, _ in some if t != b) in {r.doc_id for r in left}
    again = [(5, a, n) for n in (3, 1, 2)]
    assert [(r.doc_id, r.n) for r in near_dedup.drop_near_duplicates(table(again)).collect()] == [(5, 1)]


def test_local_links_like_brute_force():
    r = np.random.default_rng(3)
    for _ in range(60):
        base = r.integers(0, 40, r.integers(3, 25)).astype(np.uint64)
        sets = []
        for _ in range(int(r.integers(2, 50))):
            s, k = base.copy(), r.integers(0, 4)
            s[r.integers(0, len(s), k)] = r.integers(0, 2000, k).astype(np.uint64)
            sets.append(np.unique(s[: max(1, len(s) - r.integers(0, 3))]))
        least = {i: i for i in range(len(sets))}
        both = [set(s.tolist()) for s in sets]
        true = [(i, j) for i in least for j in range(i) if 100 * len(both[i] & both[j]) >= 80 * len(both[i] | both[j])]
        got = near_dedup.local_links(sets, 80)
        assert {(max(p), min(p)) for p in got} <= set(true)

        def roots(links: list) -> list:
            root = dict(least)
            for _ in root:
                for a, b in links:
                    root[a] = root[b] = min(root[a], root[b])
            return list(root.values())

        assert roots(got) == roots(true)


def test_near_copies_in_one_task_take_linear_time():
    r = np.random.default_rng(0)
    base = r.integers(0, 2**62, 12).astype(np.uint64)
    sets = [np.unique(np.where(np.arange(12) == i % 12, np.uint64(2**62 + i), base)) for i in range(20_000)]
    began = time.time()
    assert len(near_dedup.local_links(sets, 80)) == 20_000 - 12 and time.time() - began < 5


def test_a_large_cluster_of_loose_copies_takes_little_time():
    """Copies of one text with some words changed: about as many pairs are similar as not, and all hold most elements."""
    r = np.random.default_rng(2)
    base, sets = r.integers(0, 2**62, 400).astype(np.uint64), []
    for i in range(1500):
        s = base.copy()
        for at in r.integers(0, 397, r.integers(0, 25)):
            s[at : at + 4] = r.integers(0, 2**62, 4).astype(np.uint64)
        sets.append(np.unique(s))
    began = time.time()
    got = near_dedup.local_links(sets, 80)
    assert time.time() - began < 5
    held = {x: i for i, x in enumerate(np.unique(np.concatenate(sets)).tolist())}
    table = np.zeros((len(sets), len(held)), np.float32)
    for i, s in enumerate(sets):
        table[i, [held[x] for x in s.tolist()]] = 1
    common, sizes = table @ table.T, table.sum(1)
    similar = 100 * common >= 80 * (sizes[:, None] + sizes - common)
    assert all(similar[a, b] for a, b in got) and 0.1 < similar.mean() < 0.9
    part = np.arange(len(sets))
    for a, b in got:
        part[part == part[a]] = part[b]
    apart = part[:, None] != part
    assert len(np.unique(part)) > 1 and not (similar & apart).any()


def test_pairs_at_the_threshold_are_found(spark):
    """Recall of the bands: pairs of similarity 0.80 to 0.85."""
    rows, linked = [], {}
    for i in range(150):
        words, n = [f"w{i}x{j}" for j in range(100)], 96
        other = words[: 100 - (14 + i % 10)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        linked[2 * i + 1] = 100 * (len(other) - 4) >= 80 * n
    got = {r.doc_id: r.kept for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert {i for i, link in linked.items() if link} == {i for i in linked if not got[i]} and 0 < sum(linked.values()) < len(linked)


def test_sketches_fill_and_estimate():
    r = np.random.default_rng(5)
    a = r.integers(0, 2**63, 900).astype(np.uint64)
    b = np.concatenate([a[:800], r.integers(0, 2**63, 100).astype(np.uint64)])
    sets = [a, b, a[:1], a[:3]]
    s = near_dedup.sketch(np.concatenate(sets), np.repeat(np.arange(4), [len(x) for x in sets]), 4, 2048)
    assert (s != near_dedup.EMPTY).all()
    assert (s[0] == s[1]).mean() == pytest.approx(0.8, abs=0.04)


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5), (200, 150), (None, 3)]
    got = dict(connected(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 150: 150, 200: 150}
    assert connected(spark.createDataFrame([], "u long, v long")).collect() == []
    hub = [(7, i) for i in range(8, 4000)] + [(i, i + 1) for i in range(5000, 5100)] + [(3999, 5000)]
    assert dict(connected(spark.createDataFrame(hub, "u long, v long")).collect()) == {i: 7 for i in [*range(7, 4000), *range(5000, 5101)]}


def test_plans_of_a_round_stay_small(spark, monkeypatch):
    joins, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join ")) or cut(df))
    assert dict(graph.connected(spark.createDataFrame([(2, 1), (3, 2), (4, 3)], "u long, v long")).collect()) == {i: 1 for i in range(1, 5)}
    assert max(joins) <= 4  # each step meets its table of least neighbours twice over two readings of its rows


# Quality


def statistics_by_hand(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    dup = sum(bool(x.strip(" \t\n\x0b\x0c\r")) and x in lines[:i] for i, x in enumerate(lines))
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {i + j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_statistics_like_brute_force(spark):
    texts = [sentence(60), f"{sentence(10)}\n" * 3, "é# $a\u00a0b\n\né# $a\u00a0b\n \n ", None, "", f"{(s := sentence(9))} x {s} y {s}", "a b c d e f g h i " * 4]
    table = spark.createDataFrame([(i, t, None, None, 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, d2 int")
    got = {r.doc_id: r for r in quality.judge(table).collect()}
    for i, t in enumerate(texts):
        n = statistics_by_hand(t)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == n
        assert got[i].base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert got[i].kept == (not got[i].base_failed)  # too few rows for an estimate
    assert quality.judge(table.limit(0)).collect() == []


def test_outliers_of_a_group_go(spark):
    r = random.Random(2)
    clean = [(i, " ".join(r.choices(WORDS, k=80)), "en", None) for i in range(400)]
    odd = [(1000 + i, " ".join(w + "$$$" for w in r.choices(WORDS, k=80)), "en", None) for i in range(60)]
    rare = [(2000, " ".join(["#" * 9] * 3 + r.choices(WORDS, k=30)), "xx", "s")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(clean + odd + rare, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(got[i[0]].kept for i in clean) >= 398
    assert not any(got[i[0]].kept for i in odd)
    assert not got[2000].kept and got[2000].d2 is not None  # judged by the whole corpus, as its language has one row


def test_small_groups_are_judged_by_language_or_corpus(spark):
    r = random.Random(6)
    text = lambda: " ".join(r.choices(WORDS, k=60))
    odd = lambda: " ".join(w + "$$$" for w in r.choices(WORDS, k=60))
    rows = [("en", "a", text()) for _ in range(200)] + [("en", "b", text()) for _ in range(20)] + [("en", "b", odd()), ("de", "a", odd()), ("de", "a", text()), (None, None, odd()), (None, None, text())]
    rows += [rows[-2]] * 3 + [("en", "a", rows[0][2])] * 3  # repeated rows
    table = spark.createDataFrame([(i, t, lang, s) for i, (lang, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x for x in quality.judge(table).collect()}
    assert [i for i in sorted(got) if not got[i].kept] == [i for i, (_, _, t) in enumerate(rows) if "$" in t]
    assert all(x.d2 is not None for x in got.values()) and {got[i].d2 for i in (0, -3 + len(rows))} == {got[0].d2}
    assert all(x.d2 is None and x.kept for x in quality.judge(table.limit(90)).collect())


def test_estimates_have_the_least_determinant(spark):
    """Against FAST-MCD on numpy: random starts with exact order statistics, and the clean rows' own moments."""
    r = np.random.default_rng(12)
    clean = r.normal(size=(600, 4)) @ np.diag([0.4, 1.2, 2.0, 1.5]) + [1.6, 2, 3, 1]
    clean[:, 1] += 0.8 * clean[:, 2]
    bad = r.normal(size=(150, 4)) * 0.3 + [4, 14, -6, 8]
    groups = {"mixed": np.vstack([clean, bad]), "clean": clean}
    floor = np.diag(np.square(list(quality.LEAST.values())))

    def moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x.mean(0), np.cov(x.T, bias=True) + floor

    def distances(x: np.ndarray, mu: np.ndarray, scatter: np.ndarray) -> np.ndarray:
        return np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(scatter), x - mu)

    rows = spark.createDataFrame([(g, *map(float, v)) for g, x in groups.items() for v in x], "group string, x0 double, x1 double, x2 double, x3 double")
    got = {x.group: x for x in quality.robust_estimates(rows).collect()}
    for g, x in groups.items():
        best = None
        for _ in range(40):
            mu, scatter = moments(x[r.choice(len(x), 12, replace=False)])
            for _ in range(30):
                mu, scatter = moments(x[np.argsort(distances(x, mu, scatter))[: int(np.ceil(quality.SHARE * len(x)))]])
            best = min(best or (np.inf,), (np.linalg.slogdet(scatter)[1], *mu.tolist()))
        assert got[g].logdet == pytest.approx(best[0], abs=0.05)
        assert np.allclose(got[g].mu, best[1:], atol=0.1)
    # Steps never raise the determinant, and none lowers that of a result.
    after = {x.group: x.logdet for x in quality.concentrate(rows, quality.robust_estimates(rows), ["group"]).collect()}
    assert all(after[g] >= got[g].logdet - 1e-6 for g in groups)
    at = {x.group: x for x in quality.robust_distances(rows).collect()}["mixed"]
    d2 = distances(groups["mixed"], np.array(at.mu), np.linalg.inv(np.array(at.prec).reshape(4, 4))) / at.scale
    limit = quality.chi2_quantile(quality.LEVEL, 4)
    assert (d2[600:] > limit).all() and (d2[:600] > limit).mean() < 0.005


def test_each_coordinate_rejects_alone(spark):
    """Words in repeated runs (x3) fail the fixed rules first."""
    r = random.Random(4)
    words = lambda n: r.choices(WORDS, k=n)
    clean = [" ".join(words(80)) for _ in range(300)]
    odd = {
        "x0": " ".join(w * 6 for w in words(80)),
        "x1": " ".join(w + "#$" for w in words(80)),
        "x2": "\n".join([" ".join(words(12)) for _ in range(2)] + [m for m in sorted(set(WORDS))[:12] for _ in range(6)]),
    }
    rows = [(i, t, "en", "s") for i, t in enumerate([*clean, *odd.values()])]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i in range(len(clean)))
    assert [(x, got[len(clean) + i].base_failed, got[len(clean) + i].kept) for i, x in enumerate(odd)] == [(x, False, False) for x in odd]


def test_estimate_is_the_covariance_of_its_rows(spark):
    x = np.random.default_rng(3).normal(size=(500, 4))
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "group string, x0 double, x1 double, x2 double, x3 double")
    at = quality._estimate(rows, ["group"]).first()
    assert np.allclose(at.mu, x.mean(0))
    assert np.allclose(np.linalg.inv(np.array(at.prec).reshape(4, 4)), np.cov(x.T, bias=True) + np.diag(np.square(list(quality.LEAST.values()))))
    assert at.logdet == pytest.approx(np.linalg.slogdet(np.linalg.inv(np.array(at.prec).reshape(4, 4)))[1])
    assert quality.chi2_quantile(0.95, 4) == pytest.approx(9.488, abs=0.02)


# Language


def spoken(r: random.Random, lang: str, n: int) -> str:
    parts = {"en": ["the", "tion", "wh", "ing", "er"], "de": ["sch", "ung", "ich", "keit", "ei"], "ru": ["ова", "ени", "ств", "про", "ать"]}[lang]
    return " ".join("".join(r.choices(parts, k=r.randint(1, 3))) for _ in range(n))


def test_language_of_held_out_texts(spark):
    r = random.Random(4)
    rows = [(i, spoken(r, lang, r.randint(5, 60)), lang) for i, lang in enumerate(["en", "de", "ru"] * 100)]
    table = spark.createDataFrame([*rows, (1000, None, "en"), (1001, "12 34 !", "de"), (1002, "words here", None), (1003, "½ ²", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = lang_id.fit(table.filter(~lang_id.held_out(F.col("doc_id"))))
    got = {x.doc_id: x for x in lang_id.identify(table, model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows]) > 0.98
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1000, 1001, 1003))
    assert all(0 <= x.score <= 1 for x in got.values())
    mixed = f"{spoken(r, 'en', 40)} {spoken(r, 'de', 25)} {spoken(r, 'ru', 20)}"
    spans = lang_id.identify(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first().spans
    assert [s.lang for s in spans] == ["en", "de", "ru"]
    assert abs(spans[0].stop - 40) <= 3 and abs(spans[1].stop - 65) <= 3 and spans[2].stop == 85
    kept = lang_id.keep_identified(table, model)
    assert {1000, 1001, 1003}.isdisjoint(x.doc_id for x in kept.collect()) and kept.columns == table.columns
    assert lang_id.identify(table, lang_id.fit(table.limit(0))).filter("lang_pred <> 'und'").count() == 0
    assert lang_id.identify(table.limit(0), model).count() == 0


def test_viterbi_like_brute_force():
    r = np.random.default_rng(8)
    lengths = np.array([1, 7, 30, 3])
    scores = r.normal(size=(41, 3)).astype(np.float32) * 3
    got, at = lang_id.viterbi(scores, lengths, 4.0), 0
    assert lang_id.viterbi(np.eye(300, dtype=np.float32)[[280, 280, 280]] * 9, np.array([3]), 4.0).tolist() == [280] * 3
    for n in lengths:
        s = scores[at : at + n].astype(float)
        value, back = s[0], []
        for t in range(1, n):
            step = value[:, None] - 4.0 * (1 - np.eye(3))
            back.append(step.argmax(0))
            value = step.max(0) + s[t]
        path = [int(value.argmax())]
        for b in back[::-1]:
            path.append(int(b[path[-1]]))
        assert got[at : at + n].tolist() == path[::-1]
        at += n


def test_prediction_like_brute_force(spark):
    """Counts, script step, word scores, Viterbi and shares, word by word; ties, repeated rows and odd texts among them."""
    from math import log

    r = random.Random(11)
    known = [(i, spoken(r, lang, 12), lang) for i, lang in enumerate(["en", "de", "ru"] * 4)] + [(90, "हिन्दी में", "hi"), (91, None, "en"), (92, "x", None)]
    u = lambda n: np.array([n], np.uint64)
    key = lambda g: int(lang_id.mix(u((ord(g[0]) * 0x110000 + ord(g[1]) + (1 << 60)) % 2**64) if len(g) == 2 else u(((ord(g[0]) * 0x110000 + ord(g[1])) * 0x110000 + ord(g[2])) % 2**64))[0]) % lang_id.BUCKETS
    grams = lambda w: [key(b[i : i + n]) for b in [f"\x02{w}\x03"] for n in (2, 3) for i in range(len(b) - n + 1)]
    counts: dict = {lang: Counter() for lang in ("de", "en", "hi", "ru")}
    scripts: dict = {lang: Counter() for lang in counts}
    for _, text, lang in known:
        if text and lang:
            for w in text.split():
                counts[lang].update(grams(w))
                scripts[lang][lang_id.script(w)] += 1
    langs = sorted(counts)

    def score(w: str, lang: str) -> float:
        total = sum(counts[lang].values()) + 0.5 * lang_id.BUCKETS
        competes = scripts[lang][lang_id.script(w)] > 0.001 * sum(scripts[lang].values()) or not any(scripts[x][lang_id.script(w)] for x in langs)
        return sum(log((counts[lang][g] + 0.5) / total) for g in grams(w)) - (0 if competes else 1000)

    def predicted(text: str | None) -> tuple:
        words = re.findall(r"[a-zäöüа-яё\u0900-\u097f]+", (text or "").lower())
        if not words:
            return "und", 0.0
        value, back = [score(words[0], x) for x in langs], []
        for w in words[1:]:
            step = [[value[i] - (lang_id.PENALTY if i != j else 0) for i in range(len(langs))] for j in range(len(langs))]
            back.append([max(range(len(langs)), key=lambda i: (step[j][i], -i)) for j in range(len(langs))])
            value = [max(step[j]) + score(w, x) for j, x in enumerate(langs)]
        path = [max(range(len(langs)), key=lambda i: (value[i], -i))]
        for b in back[::-1]:
            path.append(b[path[-1]])
        weight = Counter()
        for w, i in zip(words, path[::-1], strict=True):
            weight[i] += sum(map(str.isalpha, w))
        best = max(weight, key=lambda i: (weight[i], -i))
        return langs[best], weight[best] / sum(weight.values())

    texts = [*(t for _, t, _ in known), "Schichung THE ing ова", f"{spoken(r, 'en', 15)} {spoken(r, 'ru', 9)} {spoken(r, 'de', 12)}", "", " 12", "zz qq", "में the", spoken(r, "de", 40), spoken(r, "de", 40)]
    rows = [(i, t) for i, t in enumerate([*texts, texts[0]])]
    model = lang_id.fit(spark.createDataFrame(known, "doc_id long, text string, lang string"))
    assert model.langs == langs
    got = {x.doc_id: (x.lang_pred, x.score) for x in lang_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, t in rows:
        want = predicted(t)
        assert got[i][0] == want[0] and got[i][1] == pytest.approx(want[1]), t
    assert got[len(texts)] == got[0]


def test_every_language_is_sampled(spark):
    rows = [(i, "en") for i in range(20_000)] + [(i, "xx") for i in range(30)]
    got = Counter(r.lang for r in lang_id.sample(spark.createDataFrame(rows, "doc_id long, lang string"), 500).collect())
    assert got["xx"] == 30 and 400 < got["en"] < 600


def test_held_out_is_crc32(spark):
    import zlib

    got = spark.range(200).select("id", lang_id.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


# URLs


def test_urls_like_brute_force(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("com", "/de/", "allow"), ("b.example.org", "", "block")]
    urls = ["http://a.example.org/en/12?x", "HTTP://EXAMPLE.org/es/", "x://myexample.org/es/", "http://org", "http://org/", "https://w.com/fr/a#b", "https://com/de/", "https://b.example.org", "no scheme", "", None, "http:///a", "a://b.com?/fr/", "u://x.com:80/fr/", "a://B.Example.Org/en/1\nb/c", "http://" + "a." * 200 + "com/de/" + "p" * 5000]
    table = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(0, urls[0], 1)] * 30 + [(10, None, 1)], "page_id long, url string, rule int")
    table = table.withColumns({c: F.lit(1) for c in ("host", "path", "n", "best", "is_hot_key", "verdict")})
    got = url_filter.judge(table, spark.createDataFrame(rules, "host string, path string, action string")).collect()
    assert len(got) == len(urls) + 31
    for r in got:
        u = urls[r.page_id] or ""
        rest = u[u.index("://") + 3 :] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c in string.ascii_uppercase else c for c in host)
        fits = [(len(h + p), len(h), a == "block", h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, False, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[3], best[4]), u
    assert url_filter.judge(table.limit(0), spark.createDataFrame(rules, "host string, path string, action string")).count() == 0
    assert url_filter.judge(table, spark.createDataFrame([], "host string, path string, action string"), "block").filter("verdict = 'block'").count() == len(urls) + 31
