"""The corpus pipeline: quality rules, line dedup, near-duplicate join, mixing, encoding.

Each stage takes the documents that the one before has kept and, but for the last, returns their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import jaccard, line_dedup, mixing, perplexity, pieces
from loomlog.llm.queries import tokenizer_path
from loomlog.session import configure, cut


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the perplexity band of their language."""
    rest = [c for c in docs.columns if c != "text"]
    judged = perplexity.judge(docs, rest, with_text=True, stored=True).where("kept")
    return judged.select(*["text" if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of ten documents or more; every document stays."""
    kept = line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1).withColumn("n_chars", F.char_length("text").cast("long"))
    return kept.select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8. The smallest doc_id stays.

    Rows are linked by their texts, so rows without an id or with a repeated one are told apart. Documents without
    words are in no group and stay.
    """
    return jaccard.keep_one(docs, words=5, percent=80).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the copies that the mix takes; weights 5, 2, 1 by source, three copies at most."""
    rows, _, _ = mixing.mix(docs, F.array("source"), docs.columns)
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return rows.where("copies > 0").select("row", copies).select("row.*")


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every row of the mix."""
    coded = pieces.round_trip(docs, tokenizer_path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", one_of_each),
    ("mixing", mix_sources),
    ("sentence pieces", to_pieces),
]
ORACLE_SQL = None  # perplexity and the tokenizer have no SQL form; tests compare with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, "stage")
    return docs
