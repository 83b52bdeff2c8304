"""Writing result tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, StructType


def write(
    df: DataFrame, path: str, fmt: str, partition_by: Sequence[str] = (), dynamic: bool = False
) -> None:
    """Overwrite ``path``. With ``dynamic`` only the partitions present in ``df`` are replaced.

    Partitioned output is rebalanced on its partition columns first: AQE merges the small ones into few files
    and splits a partition value that holds a large share of the rows over several tasks.
    """
    writer = (df.hint("rebalance", *partition_by) if partition_by else df).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer = writer.option("partitionOverwriteMode", "dynamic" if dynamic else "static")
    if fmt == "csv":
        writer = writer.option("header", True).option("quote", '"').option("escape", '"')
    writer.format(fmt).save(path)


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), lambda name: spark._jvm.org.apache.hadoop.fs.Path(path, name)


def _swap(fs, old, new) -> None:
    """One partition's folder takes another's place."""
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{new} could not be moved to {old}")


def finish_partitions(spark: SparkSession, path: str) -> list[str]:
    """Put in place the partitions that a run has written whole but not moved; returns their folders.

    A run that stopped while it wrote has left nothing to move: its unfinished folder is deleted.
    """
    fs, at = _folder(spark, path)
    moved: list[str] = []
    if not fs.exists(at(".")):
        return moved
    for status in fs.listStatus(at(".")):
        name = status.getPath().getName()
        if not name.startswith("_new-"):
            continue
        # The folder's success mark is written last, so a marked folder holds all its partitions.
        if fs.exists(at(f"{name}/_SUCCESS")):
            for part in fs.listStatus(at(name)):
                folder = part.getPath().getName()
                if part.isDirectory() and "=" in folder:
                    _swap(fs, at(folder), part.getPath())
                    moved.append(folder)
        fs.delete(at(name), True)
    return moved


def write_by_month(df: DataFrame, path: str, month: str = "purchase_month") -> None:
    """One Parquet partition per month; months absent from ``df`` keep their files.

    All months are first written whole beside the old ones, in a folder that readers skip, and then moved into place one by
    one. A run that ends early leaves every month as it was or as it should be; ``finish_partitions``, with which each
    run starts, moves what is left. Moving is renaming, so use it where folders can be renamed.
    """
    spark = df.sparkSession
    named = df.withColumn("purchase_ym", F.date_format(month, "yyyy-MM")).filter(F.col("purchase_ym").isNotNull())
    finish_partitions(spark, path)
    write(named, f"{path}/_new-{uuid.uuid4().hex}", "parquet", ["purchase_ym"])
    finish_partitions(spark, path)


def _finite(value: Column, kind: DataType) -> Column:
    if isinstance(kind, (DoubleType, FloatType)):
        infinite = value.isin(float("inf"), float("-inf"))
        return F.when(~(F.isnan(value) | infinite), value)
    if isinstance(kind, StructType):
        fields = [_finite(value.getField(f.name), f.dataType).alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def write_json(df: DataFrame, path: str) -> None:
    """JSON has no NaN or infinity, so those are written as null; keys with null values are kept."""
    clean = df.select([_finite(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])
    clean.write.mode("overwrite").option("ignoreNullFields", False).json(path)
