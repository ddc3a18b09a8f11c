"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the operators rely on. Duplicate JSON keys follow the "last one wins"
# rule of the transcripts' writer; the skew rule may add an exchange because a
# single session or id can hold a large share of all rows. Parsed values are
# stored whole: inferring and writing columns for their keys costs more than
# the later reads of single keys gain.
RUNTIME_SETTINGS = {
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.variant.inferShreddingSchema": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def ship_by_value(module_name: str) -> None:
    """Send a module's functions to the workers as code, so they need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session; safe to call repeatedly."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``.

    Only a local master without that setting (tests) gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        context.setCheckpointDir(named)
        return
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="loomlog-checkpoint-"))


def store_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a table under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/loomlog/{name}-{uuid.uuid4().hex}"


SPLIT_ROWS = 2_000_000  # rows of a split at which a large scan is even enough


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan whose rows lie in fewer splits than there are cores, or unevenly; otherwise no exchange.

    For row-wise work that is heavy per byte, such as parsing. The number of
    splits says little: a file is split by bytes, but a row group goes whole to
    one split and leaves others empty. The rows of the splits are counted, for
    which Parquet only reads footers.
    """
    counts = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"))
    most, rows = counts.agg(F.max("n"), F.sum("n")).first()
    if not rows:
        return df
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // SPLIT_ROWS))
    return df if 2 * most * wanted <= 3 * rows else df.repartition(wanted)


def cut(df: DataFrame, name: str = "step", codec: str | None = None) -> DataFrame:
    """Cut the lineage of an iterated DataFrame with a table in the shared folder.

    Unlike an RDD checkpoint the table is columnar and has a known size, so the
    next round prunes columns and only broadcasts what is small enough.
    """
    spark = df.sparkSession
    path = store_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)
