"""F4 for keyword tables: which of many keywords a text holds.

One automaton finds all keywords of a table in one pass over a text, so the plan does not grow with them. A task holds
the automaton of at most ``max_bytes`` of keywords; a larger table takes further passes, dealt by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.session import cut, ship_by_value

ship_by_value(__name__)

MAX_BYTES = 8 << 20  # of keywords broadcast at a time


def keyword_hits(rows: DataFrame, keywords: DataFrame, text: str = "text", keyword: str = "keyword", first_only: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``rows`` without ``text``, with ``keyword``: a row for each keyword found, or for one of them with ``first_only``.

    Texts are lower-cased, keywords used as given, like the list form. Null and empty keywords are found nowhere; a
    null text holds nothing. Needs pyahocorasick on the executors.
    """
    spark = rows.sparkSession
    words = cut(keywords.select(F.col(keyword).alias("keyword")).where(F.length("keyword") > 0).distinct(), "keywords")
    size = words.agg(F.sum(F.octet_length("keyword"))).first()[0] or 0
    passes = -(-size // max_bytes)
    rest = [f for f in rows.schema.fields if f.name != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["keyword string"])
    given = rows.select(*[F.col(f"`{f.name}`") for f in rest], F.lower(F.col(text)).alias("_text")).where(F.length("_text") > 0)

    def found_in(some: DataFrame) -> DataFrame:
        known = spark.sparkContext.broadcast([r["keyword"] for r in some.toLocalIterator()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for word in known.value:
                automaton.add_word(word, word)
            automaton.make_automaton()
            for batch in batches:
                at, hits = [], []
                for i, value in enumerate(batch.column("_text").to_pylist()):
                    if first_only:
                        words = [w for _, w in zip(range(1), (w for _, w in automaton.iter(value)))]
                    else:
                        words = sorted({w for _, w in automaton.iter(value)})
                    at += [i] * len(words)
                    hits += words
                if at:
                    kept = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*(kept.column(f.name) for f in rest), pa.array(hits, pa.string())], [*(f.name for f in rest), "keyword"])

        return given.mapInArrow(run, schema)

    out = spark.createDataFrame([], schema)
    for k in range(passes):
        out = out.unionByName(found_in(words if passes == 1 else words.where(F.pmod(F.xxhash64("keyword"), F.lit(passes)) == k)))
    if first_only and passes > 1:
        names = [f.name for f in rest]
        out = out.groupBy(*names).agg(F.min("keyword").alias("keyword"))
    return out
