"""Tables written as a season folder of CSV files, the layout that ``tree`` reads.

A file of the layout is a folder of part files under the file's name, which a scan of that
name reads as one. A table with a period is written in one job, dealt into period folders
by the writer; the folders then get their names. Names are as many as there are periods.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession

PERIOD = "__period"


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def make_folder(spark: SparkSession, path: str) -> None:
    fs, target = _file_system(spark, path)
    fs.mkdirs(target)


def write_file(df: DataFrame, path: str) -> None:
    """All rows under one name, with a header; an existing one is replaced."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_periods(df: DataFrame, period: Column, base: str, name: str) -> list[int]:
    """Rows of each period as ``base/GW{n}/name``; the periods written, ascending.

    Columns are all columns of ``df``. A period whose file exists already is an error, rows
    without a period are one too: the layout has no place for them.
    """
    spark = df.sparkSession
    staging = f"{base}/_staging-{uuid.uuid4().hex}"
    (df.withColumn(PERIOD, period.cast("long")).write.partitionBy(PERIOD)
     .option("header", True).option("escape", '"').csv(staging))
    fs, root = _file_system(spark, staging)
    path = spark._jvm.org.apache.hadoop.fs.Path
    folders = {status.getPath().getName().removeprefix(f"{PERIOD}="): status.getPath()
               for status in fs.listStatus(root) if status.isDirectory()}
    placed = {value: path(f"{base}/GW{value}/{name}") for value in folders}
    for value, target in placed.items():
        if not value.isdigit():
            raise ValueError(f"rows of {name} without a period")
        if fs.exists(target):
            raise FileExistsError(target.toString())
    for value, folder in folders.items():
        fs.mkdirs(placed[value].getParent())
        if not fs.rename(folder, placed[value]):
            raise OSError(f"cannot place {placed[value].toString()}")
    fs.delete(root, True)
    return sorted(map(int, folders))
