"""Text projections of entries, blocks and log rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomlog.functions import jsonv as J

# Marker strings of an initial-context message (fixed values).
INITIAL_CONTEXT_MARKERS = ("<environment_context>", "AGENTS.md", "<INSTRUCTIONS>", "Codex CLI")

CALL_TYPES = ("function_call", "custom_tool_call", "local_shell_call")
OUTPUT_TYPES = ("function_call_output", "custom_tool_call_output")


def entry_text(content_text: Column, blocks: Column) -> Column:
    """P5: string content, else the non-empty text blocks joined by one space."""
    parts = F.transform(
        F.filter(blocks, lambda b: (b["type"] == "text") & (F.length(b["text"]) > 0)), lambda b: b["text"]
    )
    return F.coalesce(content_text, F.array_join(parts, " "), F.lit(""))


def _typed_texts(v: Column, path: str, types: tuple[str, ...]) -> Column:
    items = F.filter(
        F.coalesce(J.as_array(v, path), F.array().cast("array<variant>")),
        lambda x: J.as_string(x, "$.type").isin(*types) & (F.length(J.as_string(x, "$.text")) > 0),
    )
    return F.transform(items, lambda x: J.as_string(x, "$.text"))


def message_text(payload: Column) -> Column:
    """Input and output texts of a flat-format message, joined with nothing."""
    return F.array_join(_typed_texts(payload, "$.content", ("input_text", "output_text")), "")


def reasoning_text(payload: Column) -> Column:
    """Summaries first, then reasoning texts, one per line."""
    return F.array_join(
        F.concat(
            _typed_texts(payload, "$.summary", ("summary_text",)),
            _typed_texts(payload, "$.content", ("reasoning_text", "text")),
        ),
        "\n",
    )


def prompt_text_linked(v: Column) -> Column:
    """One labelled block per linked-format entry, NULL when nothing is left."""

    def block(b: Column) -> Column:
        kind = J.as_string(b, "$.type")
        name = J.as_string(b, "$.name")
        tool = F.concat(
            F.lit("[tool: "), name, F.lit("]\n"),
            F.when(J.has_key(b, "$.input"), F.concat(F.to_json(J.get(b, "$.input")), F.lit("\n"))).otherwise(""),
        )
        result = F.concat(
            F.lit("[result: "),
            F.coalesce(J.as_string(b, "$.content"), F.to_json(J.get(b, "$.content")), F.lit("undefined")),
            F.lit("]\n"),
        )
        return F.coalesce(
            F.when(kind == "text", F.concat(J.as_string(b, "$.text"), F.lit("\n")))
            .when(kind == "thinking", F.concat(J.as_string(b, "$.thinking"), F.lit("\n")))
            .when(kind == "tool_use", tool)
            .when(kind == "tool_result", result),
            F.lit(""),
        )

    content = J.get(v, "$.message.content")
    text = J.js_trim(
        F.coalesce(
            J.as_string(content), F.array_join(F.transform(J.as_array(content), block), ""), F.lit("")
        )
    )
    kind = J.as_id(v, "$.type")
    label = F.coalesce(J.as_string(v, "$.message.role"), kind)
    usable = kind.isNotNull() & (kind != "file-history-snapshot") & J.has_key(v, "$.message") & (F.length(text) > 0)
    return F.when(usable, F.concat(F.lit("["), label, F.lit("]: "), text))


def prompt_text_flat(payload: Column) -> Column:
    """Message, tool call or tool output of the flat format as a labelled block."""
    kind = J.as_id(payload, "$.type")
    role = J.as_id(payload, "$.role")
    text = J.js_trim(message_text(payload))
    body = F.to_json(payload)
    call_id = J.as_id(payload, "$.call_id")
    return (
        F.when(
            kind == "message",
            F.when(role.isNotNull() & (F.length(text) > 0), F.concat(F.lit("["), role, F.lit("]: "), text)),
        )
        .when(
            kind.isin(*CALL_TYPES),
            F.concat(F.lit("[assistant]: [tool: "), F.coalesce(J.as_string(payload, "$.name"), kind), F.lit("]\n"), body),
        )
        .when(
            kind.isin(*OUTPUT_TYPES),
            F.concat(F.lit("[assistant]: [result: "), F.concat_ws(" ", kind, call_id), F.lit("]\n"), body),
        )
    )


def contains_any(text: Column, keywords: list[str]) -> Column:
    """lower-cased haystack, keywords used as given."""
    if not keywords:
        return F.lit(False)
    low = F.lower(text)
    hit = F.lit(False)
    for word in keywords:
        hit = hit | F.contains(low, F.lit(word))
    return hit


def looks_like_initial_context(text: Column) -> Column:
    """F8."""
    hit = F.lit(False)
    for marker in INITIAL_CONTEXT_MARKERS:
        hit = hit | F.contains(text, F.lit(marker))
    return hit


def fixed1(x: Column) -> Column:
    """One decimal, nearest to the exact binary value, ties upward.

    Whether x lies above the middle of two tenths is decided on the exact
    product 20 * x (its rounding error is recovered by splitting x).
    """
    tenths = F.floor(x * 10)
    product = x * 20
    high = x * 134217729.0 - (x * 134217729.0 - x)
    error = (high * 20 - product) + (x - high) * 20
    up = (product - (tenths * 2 + 1)) + error >= 0
    n = tenths + F.when(up, 1).otherwise(0)
    return F.concat(F.floor(n / 10).cast("bigint").cast("string"), F.lit("."), (n % 10).cast("bigint").cast("string"))


def format_k(value: Column, rounded: bool = False) -> Column:
    """Below 1000 as is, below 10k with one decimal, else whole thousands."""
    d = value.cast("double")
    small = F.floor(d + 0.5).cast("string") if rounded else F.when(d == F.floor(d), F.floor(d).cast("string")).otherwise(d.cast("string"))
    return (
        F.when(d.isNull() | F.isnan(d) | (d < 0), F.lit("?"))
        .when(d < 1000, small)
        .when(d < 10000, F.concat(fixed1(d / 1000), F.lit("k")))
        .otherwise(F.concat(F.floor(d / 1000 + 0.5).cast("string"), F.lit("k")))
    )


def format_bytes(value: Column) -> Column:
    b = F.when(value >= 0, value.cast("double")).otherwise(F.lit(0.0))
    kb, mb, gb = b / 1024, b / 1024 / 1024, b / 1024 / 1024 / 1024
    return (
        F.when(b < 1024, F.concat(F.floor(b).cast("string"), F.lit(" B")))
        .when(kb < 1024, F.concat(fixed1(kb), F.lit(" KB")))
        .when(mb < 1024, F.concat(fixed1(mb), F.lit(" MB")))
        .otherwise(F.concat(fixed1(gb), F.lit(" GB")))
    )


def progress_bar(current: Column, threshold: Column, width: int = 8) -> Column:
    """Filled and empty cells in brackets, NULL without a usable threshold."""
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), current / threshold))
    filled = F.floor(ratio * width).cast("int")
    bar = F.concat(F.lit("["), F.repeat(F.lit("█"), filled), F.repeat(F.lit("▒"), F.lit(width) - filled), F.lit("]"))
    return F.when(current.isNotNull() & (threshold > 0), bar)


def log_line(row: dict[str, Column]) -> Column:
    """One readable line per compaction log event."""
    cleaned = J.js_trim(F.regexp_replace(row["error"], r"[\s\u00A0\uFEFF]+", " "))
    error = F.when(F.length(cleaned) > 0, F.to_json(F.to_variant_object(F.array(cleaned))))
    quoted = F.substring(error, F.lit(2), F.length(error) - 2)

    def part(label: str, value: Column) -> Column:
        return F.when(F.length(value) > 0, F.concat(F.lit(label + "="), value))

    after = (
        F.when(row["tokens_after_is_null"], F.lit("->?"))
        .when(row["tokens_after"].isNotNull(), F.concat(F.lit("->"), format_k(row["tokens_after"], rounded=True)))
        .otherwise("")
    )
    return F.concat_ws(
        " ",
        F.coalesce(row["ts_raw"], F.lit("?")),
        F.concat(F.lit("result="), F.coalesce(row["result"], F.lit("?"))),
        F.concat(F.lit("tokens="), format_k(row["tokens"], rounded=True), after),
        F.concat(F.lit("threshold="), format_k(row["threshold"], rounded=True)),
        part("amount", row["amount"]),
        part("mode", row["amount_mode"]),
        part("keepLast", row["keep_last"]),
        part("model", row["model"]),
        part("stage", row["stage"]),
        part("error", quoted),
    )
