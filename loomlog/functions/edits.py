"""Edits of single lines that keep key order and unknown keys.

A rewrite is planned with joins; only the touched lines pass through this
helper, in Arrow batches. Untouched lines keep their original text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomlog.session import ship_by_value

ship_by_value(__name__)

EDIT_TYPE = "array<struct<op:string,path:string,value:string>>"

THINKING = ("thinking", "redacted_thinking")


def no_edits() -> Column:
    return F.array().cast(EDIT_TYPE)


def edit(op: str, path: str = "", value: Column | None = None) -> Column:
    """One edit: set, rename, thinking_first, strip_thinking, merge or tombstone."""
    return F.struct(
        F.lit(op).alias("op"), F.lit(path).alias("path"),
        (F.lit(None) if value is None else value).cast("string").alias("value"),
    )


def set_string(path: str, text: Column) -> Column:
    """Set a string, or the JSON null when ``text`` is NULL."""
    quoted = F.to_json(F.to_variant_object(F.array(text)))
    return edit("set", path, F.coalesce(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit("null")))


# Numbers pass through as their own text, behind a mark that texts do not hold.
_MARK = "\ue000number\x00"
_MARKED = re.compile(r'"\ue000number\\u0000([-+.0-9eE]+)"')
_SURROGATE = re.compile("[\ud800-\udfff]")


def _loads(text: str):
    keep = lambda number: _MARK + number
    return json.loads(text, parse_float=keep, parse_int=keep)


def _dumps(value) -> str:
    text = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return _SURROGATE.sub(lambda m: f"\\u{ord(m.group()):04x}", _MARKED.sub(r"\1", text))


def _blocks(value: dict) -> list[dict]:
    message = value.get("message")
    content = message.get("content") if isinstance(message, dict) else None
    return [b for b in content if isinstance(b, dict)] if isinstance(content, list) else []


def _thinking_first(blocks: list[dict]) -> list[dict]:
    return sorted(blocks, key=lambda b: b.get("type") not in THINKING)


def _apply(raw: str, edits, others) -> str:
    value = _loads(raw)
    for step in edits:
        op, path, arg = step["op"], step["path"], step["value"]
        if op in ("set", "rename"):
            *parents, last = path.split(".")
            holder = value
            for name in parents:
                holder = holder[name]
            if op == "set":
                holder[last] = _loads(arg)
            else:
                holder[arg] = holder.pop(last)
        elif op == "thinking_first":
            value["message"]["content"] = _thinking_first(_blocks(value))
        elif op == "merge":
            earlier = [b for text in others for b in _blocks(_loads(text))]
            value["message"]["content"] = _thinking_first(earlier + _blocks(value))
        elif op == "strip_thinking":
            rest = [b for b in _blocks(value) if b.get("type") not in THINKING]
            value["message"]["content"] = rest or [{"type": "text", "text": arg}]
        elif op == "tombstone" and isinstance(value.get("message"), dict):
            message = value["message"]
            message["content"] = [{"type": "text", "text": arg}] if message.get("role") == "assistant" else arg
    return _dumps(value)


def _apply_batches(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for raw, edits, others in batches:
        yield pd.Series([
            r if e is None or len(e) == 0 else _apply(r, e, () if o is None else o)
            for r, e, o in zip(raw, edits, others)
        ], dtype="object")


def apply_edits(raw: Column, edits: Column, others: Column | None = None) -> Column:
    """Edited text of a line; ``others`` are the lines merged into it, root first."""
    extra = F.array().cast("array<string>") if others is None else others
    return F.pandas_udf(_apply_batches, "string")(raw, edits, extra)
