"""Licence scans: sparse TF-IDF cosine of passages to licence templates, then inheritance down the directory tree.

Passages are lines, windows of up to ``WINDOW`` neighbouring lines, and whole files; templates are one-line statements,
the notices that stand at the head of files, and licence texts (``license_texts/``; those of the Creative Commons BY
licences are not among them). Document frequencies of all words are counted over all files. In ``scan`` no token weighs
more, for a template, than the median token of that template: a token that few files or none hold would else outweigh
all others as the corpus grows, and statements without it would be lost.

By the Cauchy-Schwarz inequality a passage reaches the threshold only if it holds some of the template's leading words:
the rarest, down to where the rest of the template weighs less than the threshold; how many it takes follows from their
weights. Windows begin and end with lines that hold a leading word of some template, and only passages with enough of a
template's leading words are scored; no other can pass. The best passage makes a file's own licence. Directories take
the licence that most of their licensed files state (ties by name), and a file without one takes that of its nearest
ancestor directory.

Defined results: null or empty texts and paths have no licence of their own; a file without a key is judged like any
other; a file at the root, or without a path, inherits from the root directory ``""``; repeated rows count as often as
they come; an empty table gives none. Ties between templates go to the first by name. Other columns may have any name.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from functools import reduce
from pathlib import Path
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborlens.llm.common import LOWER, UPPER, ascii_lower, cut, lookup

TOKEN = r"[a-z0-9][a-z0-9.+-]*[a-z0-9]|[a-z0-9]"
#: Statements by which files name their licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "Copyright. All rights reserved.",
}

#: Notices at the head of files, and shorter forms of statements.
NOTICES = [
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("Proprietary", "All rights reserved."),
    *((f"{gpl}-{n}.0", f"""This program is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation; either version {n} of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details.
        You should have received a copy of the GNU {kind}General Public License along with this program; if not, see <https://www.gnu.org/licenses/>.""") for gpl, n, kind in (("GPL", 2, ""), ("GPL", 3, ""), ("LGPL", 3, "Lesser "))),
]
#: Lines of a window at most; longer passages are met as whole files.
WINDOW = 40


def known_texts() -> list[tuple[str, str]]:
    """(license, text) of all statements, notices and licence texts."""
    whole = [(p.stem, p.read_text(encoding="utf-8")) for p in (Path(__file__).parent / "license_texts").glob("*.txt")]
    return sorted([*TEMPLATES.items(), *NOTICES, *whole])


def tokens(line: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(line), F.lit(TOKEN), F.lit(0))


def _holds(words: Column, wanted: list[str]) -> Column:
    return F.exists(words, lambda t: t.isin(wanted))


def _those(words: Column | str, wanted: list[str]) -> Column:
    return F.filter(words, lambda t: t.isin(wanted))


def _frequencies(docs: DataFrame) -> DataFrame:
    """(token, n): the files that hold each token. Tokens are counted map-side."""
    return cut(docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")))


def _idf(files: int, n: Column) -> Column:
    return F.log((files + 1) / (n + 1)) + 1


def _leading(weight: dict[str, float], idf: dict[str, float], least: float) -> tuple[list[str], int]:
    """Tokens without which no passage reaches ``least``, and how many of them it holds at least."""
    total = sum(w * w for w in weight.values())
    rest, leading = total, []
    for t in sorted(weight, key=lambda t: (-idf[t], t)):
        if rest < least * least * total * (1 - 1e-9):
            break
        leading.append(t)
        rest -= weight[t] ** 2
    n = 0
    for w in sorted((weight[t] for t in leading), reverse=True):
        if rest >= least * least * total * (1 - 1e-9):
            break
        rest += w * w
        n += 1
    return leading, max(n, 1)


def own_licenses(docs: DataFrame, templates: dict[str, str] | list[tuple[str, str]] = TEMPLATES, least: float = 0.75, capped: bool = False) -> DataFrame:
    """(key, license, score) for those of ``docs`` (key, text) that state a licence in some passage.

    With ``capped``, no token weighs more for a template than the median of the template's tokens.
    """
    spark = docs.sparkSession
    pairs = sorted(templates.items()) if isinstance(templates, dict) else templates
    python_tokens = [(name, re.findall(TOKEN, text.translate(str.maketrans(UPPER, LOWER)))) for name, text in pairs]
    known = [(name, words) for name, words in python_tokens if words]
    if not known:
        return docs.select("key").limit(0).withColumns({"license": F.lit(None).cast("string"), "score": F.lit(None).cast("double")})
    vocabulary = sorted({t for _, words in known for t in words})
    frequency, files = _frequencies(docs), docs.count()
    # As large as the templates.
    seen = {r.token: r.n for r in frequency.filter(F.col("token").isin(vocabulary)).collect()}
    idf = {t: math.log((files + 1) / (seen.get(t, 0) + 1)) + 1 for t in vocabulary}
    caps = [median(idf[t] for t in set(words)) if capped else math.inf for _, words in known]
    weights = [{t: n * min(idf[t], cap) for t, n in Counter(words).items()} for (_, words), cap in zip(known, caps, strict=True)]
    norms = [math.sqrt(sum(w * w for w in weight.values())) for weight in weights]
    leading = [_leading(weight, idf, least) for weight in weights]
    leads = sorted({t for words, _ in leading for t in words})

    found = docs.select("key", "text").filter(_holds(tokens(F.col("text")), leads)).withColumn("lines", F.transform(F.split("text", "\n"), tokens))
    led = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: _holds(F.get("lines", i), leads))
    found = found.select("key", "lines", led.alias("led"))
    spans = F.flatten(F.transform("led", lambda a: F.transform(F.filter("led", lambda b: (b >= a) & (b < a + WINDOW)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    spans = F.array_union(spans, F.array(F.struct(F.lit(0).alias("a"), (F.size("lines") - 1).alias("b"))))
    passages = found.select("key", F.explode(F.transform(spans, lambda s: F.flatten(F.slice("lines", s["a"] + 1, s["b"] - s["a"] + 1)))).alias("t"))
    passages = passages.withColumn("held", F.array_distinct(_those("t", leads)))
    enough = [F.size(_those("held", words)) >= n for words, n in leading]
    passages = passages.filter(reduce(operator.or_, enough)).select("key", "t").withColumn("line", F.monotonically_increasing_id())
    terms = passages.select("key", "line", F.explode("t").alias("token")).groupBy("key", "line", "token").agg(F.count(F.lit(1)).alias("tf"))
    terms = cut(terms)
    used = terms.groupBy("token").agg(F.count(F.lit(1)).alias("n")).join(frequency.withColumnRenamed("n", "df"), "token")
    used = cut(used.select("token", "n", _idf(files, F.col("df")).alias("idf")))
    terms = lookup(terms, used, ["token"], used.agg(F.sum("n")).first()[0] or 0)
    # Bounded by the templates: one row a token.
    table = spark.createDataFrame([(t, [w.get(t, 0.0) for w in weights]) for t in vocabulary], "v string, w array<double>")
    terms = terms.join(F.broadcast(table), F.col("token") == F.col("v"), "left")
    own = [F.col("tf") * F.least("idf", F.lit(c)) for c in caps]
    sums = [e for i, o in enumerate(own) for e in (F.sum(o * F.get("w", F.lit(i))).alias(f"d{i}"), F.sum(o * o).alias(f"n{i}"))]
    scored = terms.groupBy("key", "line").agg(*sums)
    score = [F.round(F.coalesce(F.col(f"d{i}"), F.lit(0.0)) / F.sqrt(f"n{i}") / norms[i], 9) for i in range(len(known))]
    best = F.array_max(F.array(*(F.struct(x.alias("score"), F.lit(-i).alias("i")) for i, x in enumerate(score))))
    names = F.array(*(F.lit(name) for name, _ in known))
    found = scored.select("key", best.alias("best")).filter(F.col("best.score") >= least).groupBy("key").agg(F.max("best").alias("best"))
    return found.select("key", F.element_at(names, 1 - F.col("best.i")).alias("license"), F.col("best.score").alias("score"))


def directory(path: Column) -> Column:
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"^(.*)/[^/]*$", 1)


def scan(files: DataFrame, templates: dict[str, str] | list[tuple[str, str]] | None = None, least: float = 0.75) -> DataFrame:
    """Per row of ``files`` (key, path, text): key, path, own license and score, license, license_dir.

    ``license`` is the file's own, or that of the nearest directory at or above it; ``license_dir`` is that directory,
    null where the licence is the file's own or there is none. Without ``templates``, all known texts are looked for.
    """
    templates = known_texts() if templates is None else templates
    row = F.struct("key", "path", F.xxhash64("text").alias("t"))  # equal in all parts, null or not
    own = cut(own_licenses(files.select(row.alias("key"), "text"), templates, least, capped=True)).select(F.col("key").alias("own_key"), F.col("license").alias("own_license"), "score")
    placed = files.select(row.alias("row"), directory(F.col("path")).alias("dir"))
    met = cut(placed.join(own, F.col("row") == F.col("own_key"), "left").select(F.col("row.key").alias("key"), F.col("row.path").alias("path"), "dir", "own_license", "score"))
    stated = met.filter("own_license is not null").groupBy("dir", "own_license").count()
    by_dir = stated.groupBy(F.col("dir").alias("above")).agg(F.min(F.struct(-F.col("count"), F.col("own_license").alias("l"))).alias("m")).select("above", F.col("m.l").alias("inherited"))
    # Every directory once, with all directories above it: as many rows as paths are deep.
    dirs = met.groupBy("dir").agg(F.count(F.lit(1)).alias("n"))
    parts = F.split("dir", "/")
    above = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
    up = cut(dirs.select("dir", F.col("n").alias("files"), F.explode(above).alias("above")))
    known = cut(up.groupBy("above").agg(F.count(F.lit(1)).alias("n")).join(by_dir, "above"))
    nearest = lookup(up, known, ["above"], up.count()).groupBy("dir").agg(F.max(F.struct(F.length("above").alias("n"), "above", "inherited")).alias("a"), F.first("files").alias("n"))
    nearest = cut(nearest.select("dir", "n", F.col("a.above").alias("license_dir"), "a.inherited"))
    out = lookup(met, nearest, ["dir"], met.count(), "left")
    return out.select("key", "path", "own_license", "score", F.coalesce("own_license", "inherited").alias("license"), F.when(F.col("own_license").isNull(), F.col("license_dir")).alias("license_dir"))
