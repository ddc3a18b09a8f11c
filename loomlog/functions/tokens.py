"""Token estimates and plans' token specifications."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomlog.functions import jsonv as J

# Placeholder counted for an image (fixed value).
IMAGE_STUB = "[image]\n"

# A counter maps an array of text segments to a whole number of tokens. A
# pandas_udf over array<string> fits, so users can bring their own tokenizer.
TokenCounter = Callable[[Column], Column]


def approx_tokens(text: Column) -> Column:
    """P10: a quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / F.lit(4)).cast("bigint")


def approx_counter(segments: Column) -> Column:
    return F.aggregate(segments, F.lit(0).cast("bigint"), lambda acc, s: acc + F.coalesce(approx_tokens(s), F.lit(0)))


def with_newline(text: Column) -> Column:
    return F.when(F.length(text) == 0, text).when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def _strings(*values: Column) -> Column:
    """Array of the given strings without NULLs and empty ones."""
    return F.filter(F.array(*values), lambda s: F.length(s) > 0)


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def _parts(items: Column, with_json: bool) -> Column:
    def one(p: Column) -> Column:
        kind = J.as_string(p, "$.type")
        text = F.when(kind == "text", with_newline(J.as_string(p, "$.text"))).when(kind == "image", F.lit(IMAGE_STUB))
        if with_json:
            text = text.when(kind == "json", F.concat(F.to_json(J.get(p, "$.json")), F.lit("\n")))
        return text

    return F.filter(F.transform(items, one), lambda s: F.length(s) > 0)


def _side_file(v: Column) -> Column:
    return _strings(with_newline(J.as_string(v, "$.toolUseResult.file.content")))


def _side_field(v: Column) -> Column:
    side = J.get(v, "$.toolUseResult")

    def field(name: str) -> Column:
        return J.as_id(side, f"$.{name}")

    streams = _strings(with_newline(field("stdout")), with_newline(field("stderr")))
    return F.coalesce(
        F.when(J.kind_of(side) == "STRING", _strings(with_newline(J.as_string(side)))),
        _parts(J.as_array(side), with_json=False),
        F.when(field("content").isNotNull(), _strings(with_newline(field("content")))),
        F.when(field("text").isNotNull(), _strings(with_newline(field("text")))),
        F.when(F.size(streams) > 0, streams),
        _side_file(v),
        _no_strings(),
    )


def token_segments(v: Column, for_plan: bool = False) -> Column:
    """The strings of a linked-format message that count as context.

    Planning differs from measuring in two details of the source tools: it
    skips top-level images and counts nothing for an empty string content.
    """

    def block(b: Column) -> Column:
        kind = J.as_string(b, "$.type")
        name = J.as_id(b, "$.name")
        thinking = F.coalesce(J.as_string(b, "$.thinking"), J.as_string(b, "$.text"))
        tool = F.when(
            name.isNotNull(),
            F.concat(
                F.array(F.concat(F.lit("[tool: "), name, F.lit("]\n"))),
                _strings(F.when(J.has_key(b, "$.input"), F.concat(F.to_json(J.get(b, "$.input")), F.lit("\n")))),
            ),
        )
        result = F.coalesce(
            F.when(J.kind_of(b, "$.content") == "STRING", _strings(J.as_string(b, "$.content"))),
            _parts(J.as_array(b, "$.content"), with_json=True),
        )
        out = F.when(kind == "text", _strings(with_newline(J.as_string(b, "$.text")))).when(
            kind.isin("thinking", "redacted_thinking"), _strings(with_newline(thinking))
        )
        if not for_plan:
            out = out.when(kind == "image", F.array(F.lit(IMAGE_STUB)))
        return F.coalesce(out.when(kind == "tool_use", tool).when(kind == "tool_result", result), _no_strings())

    text = J.as_string(v, "$.message.content")
    items = J.as_array(v, "$.message.content")
    has_result = F.exists(items, lambda b: F.coalesce(J.as_string(b, "$.type") == "tool_result", F.lit(False)))
    plain = with_newline(text) if for_plan else F.when(F.length(text) == 0, F.lit("\n")).otherwise(with_newline(text))
    counted = (
        F.when(text.isNotNull(), F.concat(_strings(plain), _side_field(v)))
        .when(
            items.isNotNull(),
            F.concat(
                F.flatten(F.transform(items, block)),
                F.when(has_result, _side_file(v)).otherwise(_side_field(v)),
            ),
        )
    )
    is_message = J.as_string(v, "$.type").isin("user", "assistant")
    return F.coalesce(F.when(is_message, counted), _no_strings())


def payload_tokens(payload: Column) -> Column:
    """P10 for the flat format: the serialised payload counts."""
    return F.coalesce(approx_tokens(F.to_json(payload)), F.lit(0).cast("bigint"))


def threshold_from_window(tokens: int | None, percent: float | None, window: Column) -> Column:
    """Fixed tokens, a share of the window, else seven tenths of it."""
    usable = window > 0
    share = F.lit(None).cast("bigint")
    if tokens is not None:
        share = F.lit(int(tokens)).cast("bigint")
    elif percent is not None:
        share = F.when(usable, F.floor(window * percent / 100).cast("bigint"))
    return F.coalesce(share, F.when(usable, F.floor(window * 7 / 10).cast("bigint")))


# Trigger threshold of the flat format when no window is known (fixed value).
FALLBACK_THRESHOLD = 90_000
