"""Chat formatting: heterogeneous conversation records into one template with a loss mask.

``canonical_turns`` fingerprints each record: the nested paths of those of its fields that any mapping knows, sorted and
hashed; further fields don't matter. A fingerprint selects a declarative mapping (``MAPPINGS``) that says where roles and
texts stand; an empty list of messages is a conversation without turns. Records of unknown layout keep a null ``mapping``
and no turns: ``unmapped`` counts them by fingerprint. Roles stay as they are, but where a mapping renames them. ``format_turns`` writes each turn as ``<|im_start|>role\\ntext<|im_end|>\\n`` with the part of
it under the loss mask (texts of assistants), escaping control strings inside texts and roles; ``read_back`` parses
that output again. Conversations are streamed in order through a task, never held whole.

Null texts and roles are empty strings; a null or malformed record has no turns. Turns of equal number are ordered by
role and text; repeated rows are repeated turns; rows of null conversation are one. Texts of any length are read whole,
one slice at a time. Empty tables give empty tables. Columns named like a new one are replaced, all others pass through
``canonical_turns``; later steps keep those of conversations and turns only.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, with_python_columns

cloudpickle.register_pickle_by_value(sys.modules[__name__])

START, STOP = "<|im_start|>", "<|im_end|>"

#: Other names of roles, where the key ``from`` holds them.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Layouts: the fields a record has, and how turns come from it. ``each`` names a list of messages; otherwise ``turns``
#: lists (role, fields), whose non-empty texts are joined by an empty line.
MAPPINGS = [
    {"name": "message", "fields": ["role", "text"], "turns": [("@role", ["text"])]},
    {"name": "content", "fields": ["role", "content"], "turns": [("@role", ["content"])]},
    {"name": "messages", "fields": ["messages", "messages[].role", "messages[].content"], "each": "messages", "role": "role", "text": "content"},
    {"name": "conversations", "fields": ["conversations", "conversations[].from", "conversations[].value"], "each": "conversations", "role": "from", "text": "value", "roles": ROLES},
    {"name": "prompt_completion", "fields": ["prompt", "completion"], "turns": [("user", ["prompt"]), ("assistant", ["completion"])]},
    {"name": "prompt_response", "fields": ["prompt", "response"], "turns": [("user", ["prompt"]), ("assistant", ["response"])]},
    {"name": "question_answer", "fields": ["question", "answer"], "turns": [("user", ["question"]), ("assistant", ["answer"])]},
    {"name": "instruction", "fields": ["instruction", "output"], "turns": [("user", ["instruction"]), ("assistant", ["output"])]},
    {"name": "instruction_input", "fields": ["instruction", "input", "output"], "turns": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    {"name": "system_prompt_response", "fields": ["system", "prompt", "response"], "turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
]


def field_paths(value, at: str = "") -> set[str]:
    """Paths of all fields below a value; list elements share the path ``[]``."""
    if isinstance(value, dict):
        inner = [(f"{at}.{k}" if at else k, v) for k, v in value.items()]
        return {p for p, _ in inner}.union(*(field_paths(v, p) for p, v in inner))
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value))
    return set()


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: dict, mapping: dict) -> list[tuple[str, str]]:
    if "each" in mapping:
        rows = [m if isinstance(m, dict) else {} for m in record[mapping["each"]] or []]
        out = [(_text(m.get(mapping["role"])), _text(m.get(mapping["text"]))) for m in rows]
    else:
        out = []
        for role, fields in mapping["turns"]:
            parts = [_text(record[f]) for f in fields]
            out.append((_text(record[role[1:]]) if role[0] == "@" else role, "\n\n".join([p for p in parts if p] or [""])))
    roles = mapping.get("roles", {})
    return [(roles.get(r, r), t) for r, t in out]


def canonical_turns(df: DataFrame, record: str = "record", mappings: list[dict] = MAPPINGS) -> DataFrame:
    """Add ``fingerprint``, ``mapping`` and ``turns`` (an array of structs role, text) from a JSON record."""
    by_print = {fingerprint(m["fields"]): m for m in mappings} | {fingerprint([m["each"]]): m for m in mappings if "each" in m}
    known = {p for m in mappings for p in m["fields"]}

    def make():
        def one(text):
            try:
                value = json.loads(text) if text is not None else None
            except ValueError:
                value = None
            if not isinstance(value, dict):
                return None, None, "[]"
            mark = fingerprint(field_paths(value) & known)
            m = by_print.get(mark)
            turns = turns_of(value, m) if m else []
            return mark, m and m["name"], json.dumps([{"role": r, "text": t} for r, t in turns])

        return lambda texts: zip(*map(one, texts), strict=True)

    out = with_python_columns(df, [record], {"fingerprint": "string", "mapping": "string", "turns": "string"}, make)
    return out.withColumn("turns", F.from_json("turns", "array<struct<role:string,text:string>>"))


def unmapped(turns: DataFrame) -> DataFrame:
    """(fingerprint, n): how many records of ``canonical_turns`` have no mapping; a null fingerprint is no JSON object."""
    return turns.filter(F.col("mapping").isNull()).groupBy("fingerprint").agg(F.count("*").alias("n"))


def escape(text: str) -> str:
    """One more backslash in each control string's opening, so that none is left; ``unescape`` takes it away."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's part of the output, and where in it the loss mask begins and ends (equal: none)."""
    head = f"{START}{escape(role).replace('%', '%25').replace(chr(10), '%0A')}\n"
    body = escape(text)
    return f"{head}{body}{STOP}\n", len(head), len(head) + len(body) if role == "assistant" else len(head)


def parse_turn(segment: str) -> tuple[str, str]:
    head, body = segment[len(START) :].split("\n", 1)
    return unescape(head.replace("%0A", "\n").replace("%25", "%")), unescape(body[: -len(STOP) - 1])


def ordered_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, turn, sub, role, text) from ``canonical_turns``, each conversation in order in one partition."""
    rows = df.select(conv, turn, F.posexplode("turns").alias("sub", "t")).select(conv, turn, "sub", "t.role", "t.text")
    return rows.repartition(conv).sortWithinPartitions(conv, turn, "sub", "role", "text")


def format_turns(turns: DataFrame) -> DataFrame:
    """Add ``segment``, ``loss_start`` and ``loss_end``; segments of a conversation, in order, are its formatted text."""

    def make():
        return lambda roles, texts: zip(*(format_turn(r or "", t or "") for r, t in zip(roles, texts, strict=True)), strict=True)

    return with_python_columns(turns, ["role", "text"], {"segment": "string", "loss_start": "bigint", "loss_end": "bigint"}, make).drop("role", "text")


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, from its segments as they stand in order: turns, loss text and sizes, as counts and digests."""
    kind = formatted.schema[conv].dataType.simpleString()
    schema = f"{conv} {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    names = [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        none = object()
        now, n, chars, loss, turns_hash, loss_hash, out = none, 0, 0, 0, None, None, []

        def done():
            return (now, n, turns_hash.hexdigest(), loss, loss_hash.hexdigest(), chars)

        for batch in batches:
            types = batch.schema.field(conv).type
            for part in slices(batch, ["segment"]):
                cols = [part.column(c).to_pylist() for c in (conv, "segment", "loss_start", "loss_end")]
                for c, segment, a, b in zip(*cols, strict=True):
                    if now is none or c != now:
                        if now is not none:
                            out.append(done())
                        now, n, chars, loss, turns_hash, loss_hash = c, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                    role, text = parse_turn(segment)
                    turns_hash.update(f"{role}\n{text}\n".encode())
                    masked = unescape(segment[a:b])
                    loss_hash.update(masked.encode())
                    n, chars, loss = n + 1, chars + len(segment), loss + len(masked)
                if out:
                    yield _batch(out, names, types)
                    out = []
        if now is not none:
            yield _batch([done()], names, types)

    return formatted.mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], first: pa.DataType) -> pa.RecordBatch:
    kinds = [first, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
