"""Incremental fold of residual batches into a stored sketch table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import sketches


def fold_batch(path: str, keys: tuple[str, ...] = ()):
    """``foreachBatch`` function: adds one batch of (actual, pred, sigma) rows to ``path``.

    Every batch writes its own ``batch_id`` partition and overwrites only that one, so a
    batch that is retried after a failure is not counted twice. Readers merge the
    partitions with :func:`stored_sketch`.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        part = sketches.residual_sketch(sketches.with_residual(batch), keys)
        (part.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))

    return write


def stored_sketch(spark: SparkSession, path: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """All batches of a sketch table as one sketch per key."""
    parts = spark.read.parquet(path)
    return parts.groupBy(*keys).agg(
        F.call_function("kll_merge_agg_double", F.col("sketch")).alias("sketch"),
        F.sum("n").alias("n"))
