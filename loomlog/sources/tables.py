"""Canonical tables on disk.

Parsing is done once: the typed lines go to Parquet and every operator reads
the columns it needs from there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomlog.session import cut

_known: dict[tuple[str, str, str], DataFrame] = {}


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and return the DataFrame that reads it back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Store ``build()`` on first use by this application, then reuse it."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _known:
        _known[key] = cut(build(), name, "zstd")  # written once and read by many
    return _known[key]
