"""Transcripts as numbered, parsed, classified lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.functions import jsonv as J
from loomlog.functions import paths as P
from loomlog.functions import text as T
from loomlog.functions import tokens as K
from loomlog.operators.ordered import first_rows, with_session_values
from loomlog.session import configure, cut

LINE_BREAK = r"\r\n|\n|\r"

# Known entry types of the linked format (fixed values).
LINKED_TYPES = ("assistant", "user", "system", "summary", "file-history-snapshot")


def split_lines(texts: DataFrame, text: str = "value") -> DataFrame:
    """Whole texts to numbered lines; blank lines are dropped but counted."""
    rest = [c for c in texts.columns if c != text]
    return (
        texts.select(*rest, F.posexplode(F.split(text, LINE_BREAK)).alias("_pos", "raw"))
        .withColumn("line", (F.col("_pos") + 1).cast("bigint"))
        .drop("_pos")
        .where(~J.blank(F.col("raw")))
    )


def read_session_lines(spark: SparkSession, paths: str | list[str], whole_up_to: int | None = None) -> DataFrame:
    """JSONL files to (session_id, path, mtime, size, line, raw).

    Files are read in splits; the line numbers of a split continue the counts of
    the splits before it. Uncompressed files up to ``whole_up_to`` bytes, if
    given, are read whole instead, one row each and with no exchange; a
    compressed file's size says nothing of its text, so it never is. Both ways
    number alike.
    """
    configure(spark)
    packed = F.col("_metadata.file_name").rlike(r"\.(gz|bz2|zst|lz4|snappy|deflate|xz)$")
    takes_whole = F.lit(False) if whole_up_to is None else (F.col("_metadata.file_size") <= whole_up_to) & ~packed
    small = spark.read.text(paths, wholetext=True, recursiveFileLookup=True)
    large = spark.read.text(paths, recursiveFileLookup=True)
    meta = {
        "path": F.col("_metadata.file_path"),
        "mtime": F.col("_metadata.file_modification_time"),
        "size": F.col("_metadata.file_size"),
    }
    named = [c.alias(n) for n, c in meta.items()]
    whole = split_lines(small.where(takes_whole).select("value", *named))

    split = large.where(~takes_whole).select(
        F.col("value").alias("raw"), *named, F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    within = split.withColumn(
        "_n", F.row_number().over(Window.partitionBy("path", "_start").orderBy("_seq")).cast("bigint")
    )
    offsets = (
        split.groupBy("path", "_start").agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(
            Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)))
        .drop("_rows")
    )
    big = (
        within.join(offsets, ["path", "_start"])
        .withColumn("line", F.col("_n") + F.coalesce("_before", F.lit(0)))
        .where(~J.blank(F.col("raw")))
    )
    columns = ["path", "mtime", "size", "line", "raw"]
    both = big.select(*columns) if whole_up_to is None else whole.select(*columns).unionByName(big.select(*columns))
    return (
        both.withColumn("session_id", P.session_id_from_path(F.col("path")))
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """Add ``v`` and ``json_kind``: object, other, invalid."""
    configure(lines.sparkSession)
    return J.with_parsed(lines.where(~J.blank(F.col("raw"))), J.js_trim(F.col("raw"))).withColumn(
        "json_kind",
        F.when(F.col("v").isNull(), "invalid").when(J.is_object(F.col("v")), "object").otherwise("other"),
    )


def head(parsed: DataFrame, n: int | None = None) -> DataFrame:
    """First ``n`` objects and invalid lines (all, if not given); other JSON values are free."""
    rows = parsed.where(F.col("json_kind") != "other")
    return rows if n is None else first_rows(rows, n, [F.col("line").asc()])


def tail(parsed: DataFrame, n: int | None = None) -> DataFrame:
    """Last ``n`` non-blank lines (all, if not given)."""
    return parsed if n is None else first_rows(parsed, n, [F.col("line").desc()])


def invalid_counts(parsed: DataFrame) -> DataFrame:
    """Invalid lines of the whole file (not only of its tail)."""
    return parsed.groupBy("session_id").agg(F.count_if(F.col("json_kind") == "invalid").alias("invalid_lines"))


# --- linked format (format A) -------------------------------------------------

_BLOCKS = "array<struct<type: variant, id: variant, tool_use_id: variant, text: variant>>"


def _blocks(content: Column) -> Column:
    """Object members of an array content, typed; other members are NULL in ``content``."""
    def read(b: Column, i: Column) -> Column:
        names = ("type", "id", "tool_use_id", "text")
        return F.struct(i.alias("pos"), *[J.string_of(b[n]).alias(n) for n in names])

    def typed(b: Column) -> Column:
        return F.struct(
            b["pos"].alias("pos"),
            b["type"].alias("type"),
            J.non_empty(b["id"]).alias("id"),
            J.non_empty(b["tool_use_id"]).alias("tool_use_id"),
            b["text"].alias("text"),
            F.coalesce(b["type"].isin("thinking", "redacted_thinking"), F.lit(False)).alias("is_thinking"),
        )

    items = F.filter(content, lambda b: b.isNotNull())
    return F.coalesce(F.transform(F.transform(items, read), typed), F.array().cast(
        "array<struct<pos:int,type:string,id:string,tool_use_id:string,text:string,is_thinking:boolean>>"))


def linked_lines(parsed: DataFrame) -> DataFrame:
    """Typed columns of the linked format.

    ``kind`` is entry, invalid_json or non_object. Only entries take part in
    the conversation; the other two kinds only produce issues.
    """
    read = J.members(
        F.col("v"), "type", "subtype", "uuid", "parentUuid", "requestId", "sessionId", "agentId", "cwd", "timestamp",
        "isApiErrorMessage", "isMeta", "isSidechain", message=f"struct<role: variant, id: variant, content: {_BLOCKS}>")
    o = lambda name: F.col(f"_o.{name}")
    content = o("message.content")
    typed = parsed.select("session_id", "line", "raw", "v", "json_kind", J.held(read, "_o")).select(
        "session_id", "line", "raw", "v",
        F.when(F.col("json_kind") == "object", "entry").when(F.col("json_kind") == "other", "non_object")
        .otherwise("invalid_json").alias("kind"),
        J.string_of(o("type")).alias("type"),
        J.string_of(o("subtype")).alias("subtype"),
        J.id_of(o("uuid")).alias("uuid"),
        J.id_of(o("parentUuid")).alias("parent_uuid"),
        (o("parentUuid").isNull() | F.is_variant_null(o("parentUuid"))).alias("parent_absent"),
        J.string_of(o("message.role")).alias("role"),
        F.coalesce(J.id_of(o("message.id")), J.id_of(o("requestId"))).alias("merge_key"),
        J.true_of(o("isApiErrorMessage")).alias("is_api_error"),
        J.true_of(o("isMeta")).alias("is_meta"),
        J.true_of(o("isSidechain")).alias("is_sidechain"),
        J.id_of(o("sessionId")).alias("log_session_id"),
        J.id_of(o("agentId")).alias("agent_id"),
        J.id_of(o("cwd")).alias("cwd"),
        J.string_of(o("timestamp")).alias("ts_raw"),
        F.when(content.isNull(), J.as_string(F.col("v"), "$.message.content")).alias("content_text"),
        _blocks(content).alias("blocks"),
    )
    return typed.withColumn("ts", F.try_to_timestamp("ts_raw")).withColumn(
        "is_message", F.coalesce(F.col("type").isin("user", "assistant"), F.lit(False))
    ).withColumn(
        "is_boundary",
        F.coalesce((F.col("type") == "system") & (F.col("subtype") == "compact_boundary"), F.lit(False)),
    )


def entries(linked: DataFrame) -> DataFrame:
    return linked.where(F.col("kind") == "entry")


def tool_refs(linked: DataFrame) -> DataFrame:
    """One row per tool_use and tool_result block with an id."""
    return (
        entries(linked)
        .select("session_id", "line", F.explode("blocks").alias("b"))
        .select(
            "session_id", "line", F.col("b.pos").alias("pos"),
            F.when(F.col("b.type") == "tool_use", "use").when(F.col("b.type") == "tool_result", "result").alias("side"),
            F.when(F.col("b.type") == "tool_use", F.col("b.id")).otherwise(F.col("b.tool_use_id")).alias("tool_id"),
        )
        .where(F.col("side").isNotNull() & F.col("tool_id").isNotNull())
    )


def thinking_first(blocks: Column) -> Column:
    """Stable partition, thinking blocks first."""
    return F.concat(
        F.filter(blocks, lambda b: b["is_thinking"]), F.filter(blocks, lambda b: ~b["is_thinking"])
    )


def has_thinking(blocks: Column) -> Column:
    return F.exists(blocks, lambda b: b["is_thinking"])


def starts_with_thinking(blocks: Column) -> Column:
    return F.coalesce(F.try_element_at(blocks, F.lit(1))["is_thinking"], F.lit(False))


def linked_text(linked: DataFrame) -> Column:
    return T.entry_text(linked["content_text"], linked["blocks"])


# --- flat format (format B) ---------------------------------------------------

def _with_members(parsed: DataFrame, columns: list[str], *names: str) -> DataFrame:
    """Columns, and the members by which layouts are told apart as ``_o``."""
    read = J.members(F.col("v"), "id", "timestamp", "type", *names, payload="struct<type: variant, call_id: variant, role: variant>")
    return parsed.select(*columns, "v", J.held(read, "_o"))


def _texts(*names: str) -> list[Column]:
    return [F.schema_of_variant(F.col(f"_o.{n}")) == "STRING" for n in names]


def _wrapped_rule() -> Column:
    stamp, kind = _texts("timestamp", "type")
    return F.coalesce(stamp & kind & (F.col("_o.payload").isNotNull() | J.has_key(F.col("v"), "$.payload")), F.lit(False))


def _legacy_rule() -> Column:
    name, stamp, kind = _texts("id", "timestamp", "type")
    return F.coalesce(name & stamp & ~F.coalesce(kind, F.lit(False)), F.lit(False))


def flat_formats(parsed: DataFrame) -> DataFrame:
    """S3, first half: (session_id, format), NULL format when no line matches."""
    rule = F.when(_wrapped_rule(), "wrapped").when(_legacy_rule(), "legacy")
    flagged = _with_members(parsed, ["session_id", "line"]).select("session_id", "line", rule.alias("rule"))
    return flagged.groupBy("session_id").agg(
        F.min_by("rule", F.when(F.col("rule").isNotNull(), F.col("line"))).alias("format")
    )


def _flat_members(parsed: DataFrame) -> DataFrame:
    """What the rows say by themselves: the layout they would be of, and the columns of an item in either layout."""
    o = lambda name: F.col(f"_o.{name}")
    rule = F.when(_wrapped_rule(), 0).when(_legacy_rule(), 1)
    stamped = J.id_of(o("id")).isNotNull() & J.id_of(o("timestamp")).isNotNull()
    return _with_members(parsed, ["session_id", "line", "raw", "json_kind"], "record_type", "call_id", "role").select(
        "session_id", "line", "raw", "v", "json_kind",
        F.when(rule.isNotNull(), F.struct("line", rule.alias("rule"))).alias("_rule"),
        F.when(stamped, F.col("line")).alias("_meta"),
        J.string_of(o("timestamp")).alias("_ts"),
        J.string_of(o("type")).alias("_type"),
        J.id_of(o("record_type")).alias("_record_type"),
        o("payload").isNotNull().alias("_payload_is_object"),
        *[J.id_of(o(f"payload.{n}")).alias(f"_payload_{n}") for n in ("type", "call_id", "role")],
        *[J.id_of(o(n)).alias(f"_own_{n}") for n in ("type", "call_id", "role")],
    )


def flat_lines(parsed: DataFrame) -> DataFrame:
    """S3: typed columns and line kinds of the flat format.

    ``kind`` is wrapped, legacy_meta, legacy_record, unknown_json, non_object or
    invalid_json. Sessions in neither layout keep a NULL format and kind. The
    rows are read twice, for the layout of their session and for themselves, so
    what they say is stored in between: the input need not be.
    """
    known = with_session_values(
        cut(_flat_members(parsed), "members"), {"_first": ("min", F.col("_rule")), "_meta_line": ("min", F.col("_meta"))}
    )
    layout = F.when(F.col("_first.rule") == 0, "wrapped").when(F.col("_first.rule") == 1, "legacy")
    envelope = J.non_empty(F.col("_ts")).isNotNull() & J.non_empty(F.col("_type")).isNotNull()
    kind = (
        F.when(layout.isNull(), None)
        .when(F.col("json_kind") == "invalid", "invalid_json")
        .when(F.col("json_kind") == "other", "non_object")
        .when(layout == "wrapped", F.when(envelope, "wrapped").otherwise("unknown_json"))
        .when(F.col("line") == F.col("_meta_line"), "legacy_meta")
        .when(F.col("line") > F.col("_meta_line"), "legacy_record")
        .otherwise("unknown_json")
    )
    wrapped, legacy = F.col("kind") == "wrapped", F.col("kind") == "legacy_record"
    of_item = lambda name: F.when(wrapped, F.col(f"_payload_{name}")).when(legacy, F.col(f"_own_{name}"))
    return (
        known.withColumn("format", layout)
        .withColumn("kind", kind)
        .select(
            "session_id", "line", "raw", "v", "format", "kind",
            F.when(wrapped, J.get(F.col("v"), "$.payload")).when(legacy, F.col("v")).alias("item"),
            F.when(wrapped | legacy, F.col("_type")).alias("type"),
            F.when(wrapped, F.col("_ts")).alias("ts_raw"),
            F.when(legacy, F.col("_record_type")).alias("record_type"),
            F.coalesce((wrapped & F.col("_payload_is_object")) | legacy, F.lit(False)).alias("item_is_object"),
            of_item("type").alias("item_type"),
            of_item("call_id").alias("call_id"),
            of_item("role").alias("role"),
        )
        .withColumn("ts", F.try_to_timestamp("ts_raw"))
    )


def is_history_item(flat: DataFrame | None = None) -> Column:
    """Rows that carry a response item with an object payload, in either layout."""
    wrapped = (F.col("kind") == "wrapped") & (F.col("type") == "response_item") & F.col("item_is_object")
    legacy = (F.col("kind") == "legacy_record") & F.col("record_type").isNull()
    return F.coalesce(wrapped | legacy, F.lit(False))


# --- detection ----------------------------------------------------------------

def detect_format(parsed: DataFrame, sample: int | None = None) -> DataFrame:
    """Agent, layout, confidence and notes from all non-blank lines, or from the first ``sample`` ones."""
    session, uuid = _texts("sessionId", "uuid")
    rule = (
        F.when(_wrapped_rule(), 1)
        .when(_legacy_rule(), 2)
        .when(session & uuid, 3)
        .when(J.string_of(F.col("_o.type")).isin(*LINKED_TYPES), 4)
    )
    flagged = _with_members(parsed, ["session_id", "line", "json_kind"], "sessionId", "uuid").select(
        "session_id", "line", "json_kind", rule.alias("rule"))
    seen = flagged if sample is None else first_rows(flagged, sample, [F.col("line").asc()])
    found = seen.groupBy("session_id").agg(
        F.min(F.when(F.col("rule").isNotNull(), F.struct("line", "rule"))).alias("hit"),
        F.min(F.when(F.col("json_kind") == "invalid", F.col("line"))).alias("bad_line"),
    )
    number = F.col("hit.rule")
    note_bad = F.concat(F.lit("saw invalid JSON at line "), F.col("bad_line").cast("string"))
    note_type = F.when(
        number == 4, F.concat(F.lit("matched entry type at line "), F.col("hit.line").cast("string"))
    ).when(number.isNull() & F.col("bad_line").isNull(), F.lit("no known signature in the first lines"))
    return found.select(
        "session_id",
        F.when(number.isin(1, 2), "codex").when(number.isin(3, 4), "claude").otherwise("unknown").alias("agent"),
        F.when(number == 1, "wrapped").when(number == 2, "legacy").when(number.isin(3, 4), "jsonl").alias("format"),
        F.when(number.isNull(), "low")
        .when((number == 4) | F.col("bad_line").isNotNull(), "medium")
        .otherwise("high").alias("confidence"),
        F.concat_ws("; ", note_bad, note_type).alias("notes"),
    )
