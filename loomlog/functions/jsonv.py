"""Type-guarded access to parsed JSON.

The transcripts' tools test a value's JSON type instead of casting it, so the
number 5 is never the string "5". ``schema_of_variant`` of one scalar answers
that test without a cast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters the source tools strip from both ends of a line (fixed values):
# tab, LF, VT, FF, CR, space, NBSP, ogham space, en/em spaces, line and
# paragraph separators, narrow/medium/ideographic spaces, BOM.
JS_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def js_trim(text: Column) -> Column:
    """The text without spaces at both ends; braces at both ends, as on most lines, leave nothing to look for."""
    return F.when(text.startswith("{") & text.endswith("}"), text).otherwise(F.trim(text, F.lit(JS_SPACE)))


def blank(text: Column) -> Column:
    return F.length(js_trim(text)) == 0


def non_empty(text: Column) -> Column:
    """NULL for the empty string, which the source tools treat as missing."""
    return F.nullif(text, F.lit(""))


def get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind_of(v: Column, path: str = "$") -> Column:
    """JSON type name of the value: STRING, BIGINT, BOOLEAN, VOID, ARRAY<..>, OBJECT<..>."""
    return F.schema_of_variant(get(v, path))


def is_string(v: Column, path: str) -> Column:
    return F.coalesce(kind_of(v, path) == "STRING", F.lit(False))


def as_string(v: Column, path: str = "$") -> Column:
    return F.when(kind_of(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def as_id(v: Column, path: str) -> Column:
    """A string usable as an identifier: present, a JSON string, not empty."""
    return non_empty(as_string(v, path))


def members(v: Column, *names: str, **nested: str) -> Column:
    """Named members of an object as a struct of variants in one pass, NULL for other values.

    A member named in ``nested`` gets that type instead. Reading each path from
    the whole value goes through all of its keys and rebuilds what it finds.
    """
    fields = [f"`{n}`: variant" for n in names] + [f"`{n}`: {kind}" for n, kind in nested.items()]
    return F.try_variant_get(v, "$", f"struct<{', '.join(fields)}>")


def string_of(value: Column) -> Column:
    """The text of a variant that is a JSON string."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def id_of(value: Column) -> Column:
    return non_empty(string_of(value))


def number_of(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(numeric, F.try_variant_get(value, "$", "double"))


def true_of(value: Column) -> Column:
    is_bool = F.schema_of_variant(value) == "BOOLEAN"
    return F.coalesce(F.when(is_bool, F.try_variant_get(value, "$", "boolean")), F.lit(False))


def as_number(v: Column, path: str = "$") -> Column:
    kind = kind_of(v, path)
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(numeric, F.try_variant_get(v, path, "double"))


def as_bool(v: Column, path: str) -> Column:
    return F.when(kind_of(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def is_true(v: Column, path: str) -> Column:
    return F.coalesce(as_bool(v, path), F.lit(False))


def as_array(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def is_array(v: Column, path: str = "$") -> Column:
    return as_array(v, path).isNotNull()


def is_object(v: Column, path: str = "$") -> Column:
    return F.coalesce(F.try_variant_get(v, path, "map<string,variant>").isNotNull(), F.lit(False))


def has_key(v: Column, path: str) -> Column:
    """True when the path exists, also when its value is the JSON null."""
    return get(v, path).isNotNull()


def is_null_or_absent(v: Column, path: str) -> Column:
    value = get(v, path)
    return value.isNull() | F.is_variant_null(value)


def _framed(raw: Column) -> Column:
    """The value before a marker only this text can produce: its own 64-bit hash."""
    return F.try_parse_json(F.concat(F.lit("["), raw, F.lit(","), F.xxhash64(raw).cast("string"), F.lit("]")))


def _first_of(framed: Column, raw: Column) -> Column:
    whole = F.try_variant_get(framed, "$[1]", "bigint") == F.xxhash64(raw)
    return F.when(whole, F.try_variant_get(framed, "$[0]", "variant"))


def strict_parse(raw: Column) -> Column:
    """Variant of a line that is exactly one JSON value, else NULL.

    The parser alone accepts text after the value. The line is therefore placed
    in an array before its marker, which has to come back as the second element.
    """
    return _first_of(_framed(raw), raw)


def held(column: Column, name: str) -> Column:
    """A column evaluated once: the one element of an exploded array.

    The optimizer copies a plain expression into everything that reads it.
    """
    return F.explode(F.array(column)).alias(name)


def with_parsed(rows: DataFrame, text: Column, name: str = "v") -> DataFrame:
    """Rows with :func:`strict_parse` of a text, which is parsed once however often the variant is read."""
    columns = [F.col(f"`{c}`") for c in rows.columns]
    given = rows.select(*columns, held(text, "_text"))
    framed = given.select(*columns, "_text", held(_framed(F.col("_text")), "_framed"))
    return framed.select(*columns, held(_first_of(F.col("_framed"), F.col("_text")), name))
