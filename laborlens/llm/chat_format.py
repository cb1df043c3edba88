"""Chat formatting: records of many layouts become canonical turns, and turns become training texts.

A record's schema is known by a fingerprint: the hash of its nested field paths, as far as any mapping speaks of them.
Each fingerprint selects a declarative mapping once: the first whose required paths it has, optional ones or fields of
other mappings beside them or not. A record whose fingerprint selects none comes back without turns, with its
fingerprint and paths, and is counted in ``unknown_layouts``, so that a mapping can be written for it.

The template marks a turn as ``### role:``, the text, and ``</turn>``. Wherever a text holds ``### `` or ``</turn>``,
one backslash goes before it and before the backslashes that already stand there, so every marker in a text follows
a backslash, no marker of the template does, and dropping one backslash gives the text back. The loss mask covers the
assistants' texts, as spans of code points.

Defined results: null texts and roles are empty; an empty list of messages is a conversation without turns; a text that
is a list of parts is their texts joined by line feeds, parts without one as JSON; fields that no mapping knows are
left out; a null or broken record has no layout; turns of equal number are ordered by role and text; a conversation
is as large as one row, and is one row of the result; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Layouts, in order of precedence. A list of messages is read by its role and text fields; else fields become turns in
#: the order given, the fields of a turn joined by an empty line. Optional fields may be absent.
MAPPINGS: dict[str, dict] = {
    "messages": {"list": ("messages", "role", "content"), "optional": ("system",)},
    "conversations": {"list": ("conversations", "from", "value"), "roles": True, "optional": ("system",)},
    "turns": {"list": ("turns", "role", "text"), "optional": ("system",)},
    "instruction": {"fields": (("user", ("instruction", "input")), ("assistant", ("output",))), "optional": ("input", "system")},
    "grounded": {"fields": (("user", ("instruction", "context")), ("assistant", ("response",))), "optional": ("context", "system")},
    "prompt": {"fields": (("user", ("prompt",)), ("assistant", ("completion",))), "optional": ("system",)},
    "response": {"fields": (("user", ("prompt",)), ("assistant", ("response",))), "optional": ("system",)},
    "question": {"fields": (("user", ("context", "question")), ("assistant", ("answer",))), "optional": ("system", "context")},
}
#: What roles of layouts with names of their own are called in canonical turns.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURNS = "array<struct<role:string,text:string>>"
HALVES = re.compile("[\ud800-\udfff]")
CONTROL = re.compile(r"(\\*)(### |</turn>)")
ESCAPED = re.compile(r"\\(\\*)(### |</turn>)")


def _required(mapping: dict) -> list[str]:
    if "list" in mapping:
        name, role, text = mapping["list"]
        return [f"{name}[].{role}", f"{name}[].{text}"]
    return [f for _, fields in mapping["fields"] for f in fields if f not in mapping["optional"]]


KNOWN = {p for m in MAPPINGS.values() for p in (*_required(m), *m["optional"])} | {f"{m['list'][0]}[:0]" for m in MAPPINGS.values() if "list" in m}


def field_paths(value: object) -> set[str]:
    """Paths of all leaves: objects add ``.name``, lists ``[]``, empty lists ``[:0]``."""
    found, left = set(), [("", value)]
    while left:
        at, value = left.pop()
        if isinstance(value, dict):
            left += [(f"{at}.{k}" if at else k, v) for k, v in value.items()]
        elif isinstance(value, list) and value:
            left += [(f"{at}[]", v) for v in value]
        elif at:
            found.add(f"{at}[:0]" if value == [] else at)
    return found


def known_paths(paths: set[str]) -> list[str]:
    """Paths as mappings name them: whatever lies below a known one is that one."""
    known = set()
    for p in paths:
        stems = [p[:i] for i in range(1, len(p)) if p[i] in "[."] + [p]
        known |= KNOWN.intersection(stems)
    return sorted(known)


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(paths).encode()).hexdigest()[:16]


def select_layout(paths: list[str]) -> str | None:
    """The first mapping whose required paths are there, or whose list of messages is empty."""
    for name, m in MAPPINGS.items():
        if set(_required(m)) <= set(paths) or ("list" in m and f"{m['list'][0]}[:0]" in paths):
            return name
    return None


def _text(value: object) -> str:
    if isinstance(value, list):
        return "\n".join(v if isinstance(v, str) else v["text"] if isinstance(v, dict) and isinstance(v.get("text"), str) else json.dumps(v, ensure_ascii=False) for v in value)
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def valid(text: str) -> str:
    """``text`` with U+FFFD in place of halves of surrogate pairs, which no encoding has."""
    return HALVES.sub("\ufffd", text)


def read_record(text: str | None, layouts: dict[str, str | None]) -> tuple[str, str | None, list[dict] | None, list[str] | None]:
    """(fingerprint, layout, turns, paths) of a record. One that is no JSON object, or nested too deeply to be read, has
    no layout. ``layouts``: what earlier fingerprints selected."""
    try:
        record = json.loads(text) if text is not None else None
        paths = field_paths(record)
        known = known_paths(paths)
        mark = fingerprint(known)
        if mark not in layouts:
            layouts[mark] = select_layout(known)
        layout = layouts[mark] if isinstance(record, dict) else None
        turns = [{k: valid(v) for k, v in t.items()} for t in turns_of(record, MAPPINGS[layout])] if layout else None
    except (ValueError, RecursionError):
        return fingerprint([]), None, None, []
    return mark, layout, turns, None if layout else sorted(map(valid, paths))


def turns_of(record: dict, mapping: dict) -> list[dict]:
    turns = [{"role": "system", "text": _text(record["system"])}] if "system" in record else []
    if "list" in mapping:
        name, role, text = mapping["list"]
        names = ROLES if mapping.get("roles") else {}
        return turns + [{"role": names.get(_text(m.get(role)), _text(m.get(role))), "text": _text(m.get(text))} if isinstance(m, dict) else {"role": "", "text": _text(m)} for m in record[name]]
    return turns + [{"role": role, "text": "\n\n".join(_text(record[f]) for f in fields if record.get(f) is not None)} for role, fields in mapping["fields"]]


def canonical_turns(records: DataFrame) -> DataFrame:
    """``records`` (conv_id, record as JSON) to conv_id, fingerprint, layout, turns, and paths.

    layout and turns are null for a record of no known layout; paths, its leaves, are null for all others.
    """

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        layouts: dict[str, str | None] = {}
        for frame in frames:
            out = []
            out += [(conv_id, *read_record(text, layouts)) for conv_id, text in zip(frame.conv_id, frame.record, strict=True)]
            yield pd.DataFrame(out, columns=["conv_id", "fingerprint", "layout", "turns", "paths"])

    schema = f"conv_id {records.schema['conv_id'].dataType.simpleString()}, fingerprint string, layout string, turns {TURNS}, paths array<string>"
    return records.select("conv_id", "record").mapInPandas(of, schema)


def unknown_layouts(canonical: DataFrame) -> DataFrame:
    """(fingerprint, paths, n) of the records that have no layout: what ``format_turns`` can't format."""
    return canonical.filter("layout is null").groupBy("fingerprint", "paths").agg(F.count(F.lit(1)).alias("n"))


def render(turns: list) -> tuple[str, list[tuple[int, int]]]:
    """The training text of turns (role, text) and its loss spans."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        name = role.replace("\\", "\\\\").replace("\n", "\\n")
        body = CONTROL.sub(r"\\\1\2", text)
        head, tail = f"### {name}:\n", "\n</turn>\n"
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(parts), spans


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2", text)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a training text."""
    turns, at = [], 0
    while at < len(formatted):
        head = formatted.index("\n", at)
        end = formatted.index("\n</turn>\n", head)
        name = re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", formatted[at + 4 : head - 1])
        turns.append((name, unescape(formatted[head + 1 : end])))
        at = end + len("\n</turn>\n")
    return turns


def format_turns(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turns) to conv_id, formatted, loss_spans; null turns are in ``unknown_layouts``."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [render([(t["role"] or "", t["text"] or "") for t in turns]) for turns in frame.turns]
            yield pd.DataFrame({"conv_id": frame.conv_id, "formatted": [f for f, _ in done], "loss_spans": [[{"start": a, "stop": b} for a, b in s] for _, s in done]})

    schema = f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, formatted string, loss_spans array<struct<start:int,stop:int>>"
    return conversations.filter("turns is not null").select("conv_id", "turns").mapInPandas(of, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """What the training texts hold, read back from them: turns and masked text as digests."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for conv_id, text, spans in zip(frame.conv_id, frame.formatted, frame.loss_spans, strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
                told = "".join(f"{role}\n{body}\n" for role, body in turns)
                out.append((conv_id, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.mapInPandas(of, schema)


def records_of_rows(rows: DataFrame) -> DataFrame:
    """A record for each conversation of a table of turns (conv_id, turn, role, text), in one of three layouts.

    A user's turn and an assistant's make a prompt and its completion; other conversations are lists of messages, half
    of them (by a hash of the id) under the one name and half under the other.
    """
    each = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    whole = rows.groupBy("conv_id").agg(each.alias("m"))
    pair = (F.size("m") == 2) & (F.get("m", F.lit(0))["role"] == "user") & (F.get("m", F.lit(1))["role"] == "assistant")
    listed = lambda name: F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias(name)))
    prompt = F.to_json(F.struct(F.get("m", F.lit(0))["text"].alias("prompt"), F.get("m", F.lit(1))["text"].alias("completion")))
    messages, turns = F.to_json(F.struct(listed("content").alias("messages"))), F.to_json(F.struct(listed("text").alias("turns")))
    return whole.select("conv_id", F.when(pair, prompt).when(F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 0, messages).otherwise(turns).alias("record"))
