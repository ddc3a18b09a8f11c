"""U-D3, X16, A15: adapters per format, guarded rewrites and the full report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions import tokens as K
from loomlog.operators import checks as C
from loomlog.operators import rewrite_flat as RF
from loomlog.operators import rewrite_linked as RL
from loomlog.operators import stats as S
from loomlog.operators.monitor import flat_estimate
from loomlog.operators.rewrite import Rewrite, renumber
from loomlog.session import cut
from loomlog.sources.lines import detect_format, flat_lines, linked_lines, parse_lines, tool_refs


@dataclass(frozen=True)
class Adapter:
    """The functions of one format; each maps DataFrames to DataFrames."""

    agent: str
    typed: Callable[[DataFrame], DataFrame]
    parse_issues: Callable[[DataFrame], DataFrame]
    validate: Callable[[DataFrame], DataFrame]
    fix: Callable[[DataFrame], Rewrite]
    trim: Callable[..., Rewrite]
    remove: Callable[..., Rewrite]
    clean: Callable[..., tuple[Rewrite, DataFrame]]
    export: Callable[..., DataFrame]

    def issues(self, typed: DataFrame) -> DataFrame:
        """Parse issues and validation issues."""
        return self.parse_issues(typed).unionByName(self.validate(typed))


def _validate_linked(linked: DataFrame) -> DataFrame:
    return C.validate_linked(linked, tool_refs(linked))


LINKED = Adapter("claude", linked_lines, C.parse_issues_linked, _validate_linked, RL.fix, RL.trim, RL.remove, RL.clean, RL.export)
FLAT = Adapter("codex", flat_lines, C.parse_issues_flat, C.validate_flat, RF.fix, RF.trim, RF.remove, RF.clean, RF.export)
ADAPTERS = {"claude": LINKED, "codex": FLAT}


def by_agent(parsed: DataFrame) -> dict[str, DataFrame]:
    """Typed lines per adapter; the detected agent of a session chooses."""
    agents = cut(detect_format(parsed).select("session_id", "agent"))
    return {
        name: adapter.typed(parsed.join(agents.where(F.col("agent") == name).select("session_id"), "session_id", "left_semi"))
        for name, adapter in ADAPTERS.items()
    }


def dispatch(parsed: DataFrame, work: Callable[[Adapter, DataFrame], DataFrame]) -> DataFrame:
    """U-D3: run ``work`` per format and union the results."""
    return C.union_all([work(ADAPTERS[name], cut(typed)) for name, typed in by_agent(parsed).items()])


def guarded_apply(adapter: Adapter, typed: DataFrame, rewrite: Rewrite, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Keep the old session where a rewrite would add errors.

    Returns (session_id, line, raw) and the verdict (session_id, errors_before,
    errors_after, worse, wrote).
    """
    before = adapter.issues(typed)
    rewritten = cut(renumber(rewrite.lines))
    retyped = cut(adapter.typed(parse_lines(rewritten)))
    sessions = typed.select("session_id").distinct()
    delta = C.error_delta(before, adapter.issues(retyped), sessions)
    verdict = cut(delta.withColumn("wrote", F.lit(force) | ~F.col("worse")))
    wrote = verdict.where("wrote").select("session_id")
    lines = rewritten.join(wrote, "session_id", "left_semi").unionByName(
        typed.select("session_id", "line", "raw").join(wrote, "session_id", "left_anti"))
    return lines, verdict


def lint_fix(adapter: Adapter, typed: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Check, migrate legacy sessions, repair, check again, decide: lines, verdict, changes."""
    if adapter is FLAT:
        moved = RF.migrate(typed)
        ready = cut(flat_lines(parse_lines(renumber(moved.lines))))
        fixed = RF.fix(ready)
        changes = moved.changes.unionByName(fixed.changes)
    else:
        fixed = adapter.fix(typed)
        changes = fixed.changes
    lines, verdict = guarded_apply(adapter, typed, fixed, force)
    return lines, verdict, changes


def report_linked(
    linked: DataFrame, detected: DataFrame, issues: DataFrame, chain: DataFrame | None = None,
    counter: K.TokenCounter = K.approx_counter,
) -> DataFrame:
    """A15 for the linked format: one row per session."""
    sessions = linked.select("session_id").distinct()
    invalid = linked.groupBy("session_id").agg(F.count_if(F.col("kind") == "invalid_json").alias("invalid_json"))
    tokens = S.session_tokens(S.message_tokens(linked, chain, counter))
    out = sessions.join(detected.select("session_id", "agent", "format", "confidence"), "session_id", "left")
    for part in (S.session_stats(linked), S.identity_summary(linked), invalid, tokens, C.by_severity(issues)):
        out = out.join(part, "session_id", "left")
    return out.na.fill(0)


def report_flat(flat: DataFrame, detected: DataFrame, issues: DataFrame) -> DataFrame:
    """A15 for the flat format, with the estimate of its tokens and the last reading."""
    reading = S.last_token_reading(flat, need_tokens=True).select("session_id", F.col("tokens").alias("last_tokens"))
    out = detected.select("session_id", "agent", "confidence").join(S.flat_summary(flat), "session_id")
    for part in (S.call_stats(flat), S.compacted_stats(flat).withColumnRenamed("total", "compacted"), flat_estimate(flat), reading, C.by_severity(issues)):
        out = out.join(part, "session_id", "left")
    return out.na.fill(0)
