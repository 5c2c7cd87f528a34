"""Session settings used by the tests and the benchmark."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8,
                  app: str = "panelspark") -> SparkSession:
    """A local session with the settings the results rely on (UTC, ANSI, AQE)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PANELSPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for clusters that don't have it installed.

    Functions that run in Python workers are pickled by reference to their module. Once per
    context; an installed copy is found first.
    """
    context = spark.sparkContext
    if getattr(context, "_panelspark_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="panelspark-package-"), "panelspark")
    context.addPyFile(shutil.make_archive(base, "zip", root, "panelspark"))
    context._panelspark_shipped = True


def use_checkpoint_dir(spark: SparkSession) -> str | None:
    """Point checkpoints at the shared folder the cluster names in spark.checkpoint.dir.

    Where none is set, a temporary folder is made in local mode only.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not context.getCheckpointDir():
            context.setCheckpointDir(configured)
        return configured
    if not context.getCheckpointDir() and context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="panelspark-checkpoint-"))
    return context.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written once as Parquet in the shared folder and read again.

    Ends the lineage: what is built on it scans the files, however often it uses them.
    """
    base = use_checkpoint_dir(df.sparkSession)
    if base is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{base.rstrip('/')}/panel-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
