"""Spark sessions for tests, the bench and local runs, and the settings a cluster should carry."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Skewed joins are split and small shuffles coalesced at run time; partition counts start high on a
# cluster so that one shuffle partition stays near 128 MB even when a scan reads terabytes.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    # Otherwise the target size below gives way to as many partitions as there are cores.
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.session.timeZone": "UTC",
    "spark.driver.memory": "8g",
    # No Python call-site capture for every column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.dataFrameQueryContext.enabled": "false",
    # Long sessions generate much code: keep the compiled classes, and room for their machine code.
    "spark.sql.codegen.cache.maxEntries": "4000",
    "spark.driver.extraJavaOptions": "-XX:ReservedCodeCacheSize=1g",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def cluster_session(app: str = "parcelmart", conf: dict[str, str] | None = None) -> SparkSession:
    """A session of the cluster that spark-submit names, with the settings above."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**CLUSTER_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(app: str = "parcelmart", cores: str | int = "*", conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**LOCAL_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
