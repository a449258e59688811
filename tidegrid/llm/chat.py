"""Chat formatting: schema fingerprints select declarative mappings to canonical turns; a reversible template follows.

Records are JSON objects of any layout. A record's fingerprint is a hash of its sorted set of nested field paths, where an
array adds `[]` and every leaf its path; so equal layouts share a fingerprint whatever their values. A `Mapping` names the
paths of its layout and how they become turns: fixed fields with a role each (prompt and response, instruction, input
and output), or a list of messages with a role field and a text field, and role names to translate. The mapping is chosen
once a fingerprint, from the small table of fingerprints that occur; layouts that no mapping covers, and records whose
values do not fit their mapping (no JSON, a message that is no object, a role or text of another kind than a string, a number, or for
texts a list of parts; half a surrogate pair, or nesting too deep to walk), get null turns and their fingerprint, so that they can be listed.

Template: `<s>[INST]` role `[/INST]` text `</s>` a turn. Inside roles and texts a backslash is put into every control
string after its first character (one more if some are there), which is undone on reading; so no control string can
occur inside a text and `parse` gives back the very turns. Loss spans are the texts of assistant turns.

Null texts and roles count as empty. Turns are ordered by turn number, ties by role and text; repeated rows are turns
of their own; a null turn number comes first. A conversation without turns formats to an empty text. Texts may have any length: a
conversation is one value, as its format is. Extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: fixed values: the control strings of the template
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\])")
_CONTROL_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """A layout. `fields`: (path, role) in order; or `items`, a path of a list, with its `role` and `text` fields."""

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = "role"
    text: str = "content"
    optional: frozenset[str] = frozenset()
    roles: dict[str, str] = field(default_factory=lambda: dict(ROLES), hash=False)

    def paths(self) -> frozenset[str]:
        own = {p for p, _ in self.fields}
        return frozenset(own | ({f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"} if self.items else set()))

    def covers(self, paths: frozenset[str]) -> bool:
        """All needed paths occur (an empty list shows only its own path)."""
        if self.items and f"{self.items}[]" in paths and not self.fields:
            return True
        heads = {p.split("[]")[0] + "[]" for p in paths if p.startswith(f"{self.items}[].{self.text}[]")} if self.items else set()
        held = paths | {f"{self.items}[].{self.text}" for _ in heads}  # a list of parts stands for its text
        return self.paths() - self.optional <= held

    def turns(self, record: dict) -> list[tuple[str, str]]:
        out = [(role, v) for path, role in self.fields if (v := _at(record, path)) is not None and (v != "" or path not in self.optional)]
        items = (_at(record, self.items) if self.items else None) or []
        if not isinstance(items, list) or not all(isinstance(x, dict) for x in items):
            raise TypeError("messages must be a list of objects")
        for item in items:
            role = item.get(self.role)
            if role is not None and not isinstance(role, str):
                raise TypeError("a role must be a string")
            out.append((self.roles.get(role, role) or "", item.get(self.text)))
        return [(r, _text(t)) for r, t in out]


def _text(value) -> str:
    """A text, or the joined texts of a list of parts; numbers as they are written in JSON."""
    if isinstance(value, list):
        parts = [p.get("text", p.get("content")) if isinstance(p, dict) else p for p in value]
        if not all(isinstance(p, str) for p in parts):
            raise TypeError("a part of a text must be a string")
        return "".join(parts)
    if isinstance(value, dict):
        raise TypeError("a text must be a string")
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


#: fixed values: layouts in the order in which they are tried
MAPPINGS = (
    Mapping("messages", items="messages"),
    Mapping("conversation", items="conversations", role="from", text="value"),
    Mapping("instruction", (("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")), optional=frozenset({"system", "input"})),
    Mapping("prompt", (("system", "system"), ("prompt", "user"), ("response", "assistant")), optional=frozenset({"system"})),
    Mapping("completion", (("prompt", "user"), ("completion", "assistant"))),
    Mapping("question", (("context", "user"), ("question", "user"), ("answer.text", "assistant")), optional=frozenset({"context"})),
)


def _at(record, path: str):
    for part in path.split("."):
        if not isinstance(record, dict):
            return None
        record = record.get(part)
    return record


def field_paths(value, prefix: str = "") -> set[str]:
    """Nested field paths of a JSON value; an empty list or object is a leaf of its own."""
    if isinstance(value, dict) and value:
        return {p for k, v in value.items() for p in field_paths(v, f"{prefix}.{k}" if prefix else k)}
    if isinstance(value, list):
        inner = {p for v in value for p in field_paths(v, f"{prefix}[]")}
        return inner or {f"{prefix}[]"}
    return {prefix}


def fingerprint(paths) -> str:
    import hashlib

    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def choose(paths: frozenset[str], mappings=MAPPINGS) -> Mapping | None:
    """The mapping with most covered paths, the first of equals."""
    fit = [m for m in mappings if m.covers(paths)]
    return max(fit, key=lambda m: len(m.paths() & paths), default=None)


def canonical_turns(records: DataFrame, key: str, record: str = "record", mappings=MAPPINGS) -> DataFrame:
    """(key, layout string, fingerprint string, turns array<struct<role, text>>) of JSON records."""
    kind = records.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, layout string, fingerprint string, turns array<struct<role:string,text:string>>"
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches):
        chosen: dict[str, Mapping | None] = {}
        for b in batches:
            out = []
            for raw in b.column(1).to_pylist():
                try:
                    value = json.loads(raw) if raw else {}
                    paths = frozenset(field_paths(value))
                except (ValueError, RecursionError):  # no JSON, or nested too deep to walk
                    value, paths = {}, frozenset(field_paths({}))
                f = fingerprint(paths)
                if f not in chosen:
                    chosen[f] = choose(paths, mappings)
                m, turns = chosen[f], None
                try:
                    turns = m.turns(value) if m else None
                    "".join(x for t in turns or () for x in t).encode()
                except (TypeError, UnicodeEncodeError, RecursionError):  # the values do not fit the mapping, or are no text, as half a surrogate pair
                    m = None
                out.append((m.name if m else None, f, [{"role": r, "text": t} for r, t in turns] if m else None))
            names, prints, turns = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(names, pa.string()), pa.array(prints, pa.string()), pa.array(turns, turn)],
                names=[key, "layout", "fingerprint", "turns"],
            )

    return records.select(key, record).mapInArrow(run, schema)


def records_of_rows(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, record): rows by turn as JSON records. A conversation of one user and one assistant turn becomes a record of
    prompt and response, any other one a list of messages; so both kinds of layout pass through their mapping."""
    one = F.struct(
        F.col(turn).alias("n"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content")
    )
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("m"))
    m = F.col("m")
    pair = (F.size(m) == 2) & (m[0]["role"] == "user") & (F.get(m, F.lit(1))["role"] == "assistant")
    prompt = F.to_json(F.struct(m[0]["content"].alias("prompt"), F.get(m, F.lit(1))["content"].alias("response")))
    messages = F.to_json(F.struct(F.transform(m, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")))
    return lists.select(key, F.when(pair, prompt).otherwise(messages).alias("record"))


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _CONTROL_ESCAPED.sub(r"\1\2\3", text)


def render(turns) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and its loss spans (code points, end exclusive)."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<s>[INST]{escape(role)}[/INST]", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}</s>")
        at += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns = []
    for part in formatted.split("</s>")[:-1]:
        role, _, text = part.removeprefix("<s>[INST]").partition("[/INST]")
        turns.append((unescape(role), unescape(text)))
    return turns


def format_chats(canonical: DataFrame, key: str) -> DataFrame:
    """(key, layout, fingerprint, formatted string, loss array<struct<start, end>>)."""
    kind = canonical.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, layout string, fingerprint string, formatted string, loss array<struct<start:int,end:int>>"
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            done = [render([(t["role"], t["text"]) for t in turns or []]) for turns in b.column(3).to_pylist()]
            loss = [[{"start": s, "end": e} for s, e in spans] for _, spans in done]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array([f for f, _ in done], pa.string()), pa.array(loss, span)],
                names=[key, "layout", "fingerprint", "formatted", "loss"],
            )

    return canonical.select(key, "layout", "fingerprint", "turns").mapInArrow(run, schema)


def read_back(formatted: DataFrame, key: str) -> DataFrame:
    """(key, turns, loss_text, formatted_chars) as read from the formatted text and its loss spans alone."""
    kind = formatted.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, turns array<struct<role:string,text:string>>, loss_text string, formatted_chars bigint"
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches):
        for b in batches:
            texts, spans = b.column(1).to_pylist(), b.column(2).to_pylist()
            turns = [[{"role": r, "text": t} for r, t in parse(f)] for f in texts]
            loss = ["".join(unescape(f[s["start"] : s["end"]]) for s in own) for f, own in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(turns, turn), pa.array(loss, pa.string()), pa.array([len(f) for f in texts], pa.int64())],
                names=[key, "turns", "loss_text", "formatted_chars"],
            )

    return formatted.select(key, "formatted", "loss").mapInArrow(run, schema)
