"""Language identification of mixed text: script ranges, word scores, Viterbi with a switching penalty.

A word's score for a language is the log probability of its character pairs and triples (hashed to BUCKETS), counted
in labelled texts. Only languages in which the word's script was seen compete for it. Viterbi over the words of a
text, paying ``PENALTY`` for each change of language, gives labelled spans; the language with most letters is the
prediction, and its share of the letters the score.

The model is fitted on about ``per_lang`` labelled documents of each language, chosen by a hash of the id, or on all of
a language that has no more; every text is labelled whole. The model's size is fixed by BUCKETS and the number of
languages, so it goes to the driver and from there to the tasks. All texts of a batch advance through Viterbi
together, word by word; batches shrink as languages grow in number.

Defined results: a null text, or one without letters, is ``und`` with score 0, as is everything if no labelled text
was given; ties go to the first language by name; rows that repeat are labelled alike; an empty table gives an empty
result. A text is held in memory whole, with a byte a word and language. Only doc_id, text and, to learn, lang are read.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laborlens.llm.shingles import U, mix, small_batches

BUCKETS = 1 << 15
PENALTY = 8.0
PER_LANG = 5_000


def _marks() -> str:
    """Combining marks as ranges of a character class: vowel signs and accents belong to the word they stand in."""
    points = [c for c in range(0x20000) if unicodedata.category(chr(c)).startswith("M")]
    runs = [list(g) for _, g in groupby(points, key=lambda c, n=count(): c - next(n))]
    return "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in runs)


LETTERS = re.compile(r"[^\W\d_]+")
WORD = re.compile(rf"[^\W\d_]+(?:[{_marks()}]+[^\W\d_]*)*")
#: From the first mark on.
HIGH = re.compile("[\u0300-\U0010ffff]")


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased, with the marks that stand in them; most texts have none to look for."""
    text = text.lower()
    return (LETTERS if text.isascii() or not HIGH.search(text) else WORD).findall(text)


#: First code points of script ranges, in order; what lies before a named range's end belongs to it.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "indic"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"),
]
STARTS, NAMES = [s for s, _ in SCRIPTS], sorted({n for _, n in SCRIPTS})


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def script(word: str) -> int:
    return NAMES.index(SCRIPTS[bisect(STARTS, ord(word[0])) - 1][1])


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the pairs and triples of all words, and the word that each belongs to; words stand between bounds."""
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(U)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    two = mix(points[:-1] * U(0x110000) + points[1:] + U(1 << 60)) % U(BUCKETS)
    three = mix((points[:-2] * U(0x110000) + points[1:-1]) * U(0x110000) + points[2:]) % U(BUCKETS)
    in2, in3 = owner[:-1] == owner[1:], owner[:-2] == owner[2:]
    return np.concatenate([two[in2], three[in3]]).astype(np.int64), np.concatenate([owner[:-1][in2], owner[:-2][in3]])


@dataclass(frozen=True)
class Model:
    """langs in order of name; scores (BUCKETS, langs) log probabilities; scripts (scripts, langs) who competes."""

    langs: list[str]
    scores: np.ndarray
    scripts: np.ndarray


def sample(labelled: DataFrame, per_lang: int) -> DataFrame:
    """About ``per_lang`` rows of each language of ``labelled`` (doc_id, lang, ...), by a hash of the id."""
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row a language
    shares = {lang: per_lang / n for lang, n in sizes.items() if n > per_lang}
    if not shares:
        return labelled
    share = F.coalesce(F.create_map(*(F.lit(x) for pair in shares.items() for x in pair))[F.col("lang")], F.lit(1.0))
    return labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)) < share * float(1 << 53))


def fit(labelled: DataFrame, per_lang: int = PER_LANG) -> Model:
    """The model of ``labelled`` (doc_id, text, lang); null texts and languages teach nothing."""
    labelled = sample(labelled.select("doc_id", "text", "lang").filter("text is not null and lang is not null"), per_lang)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            by: dict[str, list[str]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                by.setdefault(lang, []).extend(words_of(text))
            for lang, words in by.items():
                if words:
                    c = np.bincount(features(words)[0], minlength=BUCKETS)
                    s = np.bincount([script(w) for w in words], minlength=len(NAMES))
                    c = np.concatenate([c, s])
                    at = np.flatnonzero(c)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(c[at])], ["lang", "at", "n"])

    counts = labelled.mapInArrow(tally, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts.lang.unique())
    table = np.zeros((BUCKETS + len(NAMES), len(langs)))
    for i, lang in enumerate(langs):
        own = counts[counts.lang == lang]
        table[own["at"].to_numpy(np.int64), i] = own["n"].to_numpy(float)
    grams, seen = table[:BUCKETS] + 0.5, table[BUCKETS:]
    scripts = seen > 0.001 * seen.sum(0)
    scripts[~scripts.any(1)] = True
    return Model(langs, np.log(grams / grams.sum(0)).astype(np.float32), scripts)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word: ``scores`` (words, labels) of texts one after the other, of given lengths > 0."""
    order = np.argsort(-lengths, kind="stable")
    start, lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
    live = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # texts with more than t words
    best = np.zeros(len(scores), np.int32)
    stays = np.ones(scores.shape, bool)
    value = scores[start].astype(np.float64)
    for t in range(1, lengths[0]):
        m = live[t]
        at, v = start[:m] + t, value[:m]
        top = v.argmax(1)
        other = v[np.arange(m), top][:, None] - penalty
        best[at], stays[at] = top, v >= other
        v = np.maximum(v, other) + scores[at]
        value[:m] = v - v.max(1, keepdims=True)
    label = np.zeros(len(scores), np.int32)
    now = value.argmax(1)
    for t in range(lengths[0] - 1, -1, -1):
        m = live[t]
        at = start[:m] + t
        label[at] = now[:m]
        now[:m] = np.where(stays[at, now[:m]], now[:m], best[at])
    return label


def _batch_bytes(langs: int) -> int:
    """Bytes of text a batch: 4 MiB up to 8 languages."""
    return max(1 << 16, (32 << 20) // max(langs, 8))


class Labeller:
    """Labels batches of texts; remembers the scores of words while they fit."""

    LIMIT = 300_000
    #: Words that are learned in one call.
    AT_ONCE = 20_000

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.scores, self.letters = np.zeros((0, len(self.model.langs)), np.float32), np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if not new:
            return
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        buckets, owner = features(new)
        s = np.stack([np.bincount(owner, self.model.scores[buckets, i], len(new)) for i in range(len(self.model.langs))], 1)
        s[~self.model.scripts[[script(w) for w in new]]] -= 1000.0
        self.scores = np.concatenate([self.scores, s.astype(np.float32)])
        self.letters = np.concatenate([self.letters, [sum(map(str.isalpha, w)) for w in new]])

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, list]]:
        if len(self.index) > self.LIMIT:
            self.forget()
        out: list = [("und", 0.0, [])] * len(texts)
        if not self.model.langs:
            return out
        words = [words_of(t) if t else [] for t in texts]
        new = [w for w in dict.fromkeys(w for own in words for w in own) if w not in self.index]
        for i in range(0, len(new), self.AT_ONCE):
            self.learn(new[i : i + self.AT_ONCE])
        full = [i for i, w in enumerate(words) if w]
        if not full:
            return out
        at = np.fromiter((self.index[w] for i in full for w in words[i]), np.int64)
        lengths = np.array([len(words[i]) for i in full])
        label, letters = viterbi(self.scores[at], lengths, self.penalty), self.letters[at]
        for i, stop, n in zip(full, np.cumsum(lengths), lengths, strict=True):
            own, weight = label[stop - n : stop], letters[stop - n : stop]
            by = np.bincount(own, weight, len(self.model.langs))
            if by.sum() > 0:
                edges = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [n]]).tolist()
                spans = [{"start": a, "stop": b, "lang": self.model.langs[own[a]]} for a, b in zip(edges[:-1], edges[1:], strict=True)]
                out[i] = (self.model.langs[int(by.argmax())], float(by.max() / by.sum()), spans)
        return out


def _shared(docs: DataFrame, model: Model) -> Broadcast:
    """The parts of a model, of a size that BUCKETS and the number of languages fix."""
    return docs.sparkSession.sparkContext.broadcast((model.langs, model.scores, model.scripts))


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, lang_pred, score, spans of words (start, stop, lang)."""
    shared = _shared(docs, model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(Model(*shared.value), penalty)
        for batch in small_batches(batches, "text", _batch_bytes(len(labeller.model.langs))):
            lang, score, spans = zip(*labeller(batch.column("text").to_pylist()), strict=True)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang), pa.array(score, pa.float64()), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"])

    schema = T.StructType([docs.schema["doc_id"]]).add("lang_pred", "string").add("score", "double")
    schema = schema.add("spans", T.ArrayType(T.StructType().add("start", "integer").add("stop", "integer").add("lang", "string")))
    return docs.select("doc_id", "text").mapInArrow(of, schema)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5, penalty: float = PENALTY) -> DataFrame:
    """``docs`` without those whose language can't be told: no letters, or under ``least`` of them in one language.

    A model that has learned no language tells nothing, and all documents stay.
    """
    if not model.langs:
        return docs
    shared = _shared(docs, model)

    @F.pandas_udf("boolean")
    def told(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
        labeller = Labeller(Model(*shared.value), penalty)
        for part in text:
            verdict = []
            for batch in small_batches(iter([pa.RecordBatch.from_arrays([pa.array(part, pa.string())], ["text"])]), "text", _batch_bytes(len(labeller.model.langs))):
                verdict += [lang != "und" and score >= least for lang, score, _ in labeller(batch.column("text").to_pylist())]
            yield pd.Series(verdict)

    return docs.filter(told("text"))
