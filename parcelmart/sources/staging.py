"""Cut lineage by writing a Parquet table under the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="parcelmart-")
        context.setCheckpointDir(root)
    return root


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write once, read many: later operators scan only the columns they use and survive lost executors."""
    return _written(df, fresh_path(df.sparkSession, name))


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop_staged(spark: SparkSession) -> None:
    """Delete all that this application has staged; its results must have been written by then."""
    _delete(spark, f"{checkpoint_root(spark).rstrip('/')}/{spark.sparkContext.applicationId}")


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A path under the checkpoint folder, deleted at the end of the block."""
    path = fresh_path(spark, name)
    try:
        yield path
    finally:
        _delete(spark, path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A ``stage`` whose tables are deleted at the end of the block."""
    paths: list[str] = []

    def staged(df: DataFrame, name: str) -> DataFrame:
        paths.append(fresh_path(spark, name))
        return _written(df, paths[-1])

    try:
        yield staged
    finally:
        for path in paths:
            _delete(spark, path)
