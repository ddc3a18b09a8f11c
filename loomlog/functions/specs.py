"""Argument specifications, as plan-time values and as columns."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Amount:
    """A count of items or tokens, or a percentage of them."""

    kind: str  # "count" | "tokens" | "percent"
    value: float

    def take(self, total: Column) -> Column:
        """How many of ``total`` to take: percent is rounded down, counts are capped."""
        if self.kind == "percent":
            return F.floor(total * F.lit(self.value / 100)).cast("bigint")
        return F.least(F.lit(int(self.value)).cast("bigint"), total)


def _percent(text: str) -> float | None:
    if not text.endswith("%"):
        return None
    try:
        value = float(text[:-1].strip() or 0)
    except ValueError as exc:
        raise ValueError(f"not a percentage: {text!r}") from exc
    if not 0 <= value <= 100:
        raise ValueError(f"percentage outside 0..100: {text!r}")
    return value


def count_or_percent(text: str) -> Amount:
    text = text.strip()
    percent = _percent(text)
    if percent is not None:
        return Amount("percent", percent)
    try:
        value = float(text or 0)
    except ValueError as exc:
        raise ValueError(f"not a count: {text!r}") from exc
    if not math.isfinite(value) or value < 0 or value != int(value):
        raise ValueError(f"not a whole count: {text!r}")
    return Amount("count", int(value))


def token_threshold(text: str) -> int:
    match = re.fullmatch(r"(\d+(?:\.\d+)?)(k)?", text.strip().lower())
    if match is None:
        raise ValueError(f"not a token amount such as 30000 or 30k: {text!r}")
    return math.floor(float(match[1]) * (1000 if match[2] else 1))


def tokens_or_percent(text: str) -> Amount:
    text = text.strip()
    if not text:
        raise ValueError("empty token amount")
    percent = _percent(text)
    return Amount("percent", percent) if percent is not None else Amount("tokens", token_threshold(text))


def duration_ms(text: str) -> int:
    match = re.fullmatch(r"(\d+(?:\.\d+)?)(ms|s)", text.strip())
    if match is None:
        raise ValueError(f"not a duration such as 250ms or 10s: {text!r}")
    return math.floor(float(match[1]) * (1 if match[2] == "ms" else 1000))


def line_numbers(text: str) -> list[int]:
    """``1,2,5-7`` as a sorted list of distinct lines."""
    if not text.strip():
        raise ValueError("empty line specification")
    found: set[int] = set()
    for part in (p.strip() for p in text.split(",")):
        if not part:
            continue
        match = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", part)
        if match is None or int(match[1]) < 1 or (match[2] is not None and int(match[2]) < int(match[1])):
            raise ValueError(f"not a line or line range: {part!r}")
        found.update(range(int(match[1]), int(match[2] or match[1]) + 1))
    return sorted(found)


def explode_line_specs(specs: DataFrame, spec: str = "spec") -> DataFrame:
    """Lines named by a specification column; malformed parts are kept with a NULL line."""
    part = F.trim(F.col("part"))
    low = F.regexp_extract(part, r"^(\d+)\s*(?:-\s*\d+)?$", 1).try_cast("bigint")
    high = F.coalesce(F.regexp_extract(part, r"^\d+\s*-\s*(\d+)$", 1).try_cast("bigint"), low)
    valid = (low >= 1) & (high >= low)
    return (
        specs.withColumn("part", F.explode(F.split(spec, ",")))
        .where(F.length(F.trim("part")) > 0)
        .withColumn("line", F.explode_outer(F.when(valid, F.sequence(low, high))))
        .drop("part")
        .distinct()
    )


def token_amount_column(text: Column) -> Column:
    """``12.5k`` / ``800`` as a number of tokens, NULL when malformed."""
    clean = F.lower(F.trim(text))
    number = F.regexp_extract(clean, r"^(\d+(?:\.\d+)?)(k)?$", 1).try_cast("double")
    return F.floor(number * F.when(clean.endswith("k"), 1000).otherwise(1)).cast("bigint")


def duration_ms_column(text: Column) -> Column:
    clean = F.trim(text)
    number = F.regexp_extract(clean, r"^(\d+(?:\.\d+)?)(ms|s)$", 1).try_cast("double")
    return F.floor(number * F.when(clean.endswith("ms"), 1).otherwise(1000)).cast("bigint")
