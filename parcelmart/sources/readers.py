"""Reading source tables and earlier results, and describing what was read."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import files

CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}

# Tables with free text, whose quoted fields may hold line breaks.
FREE_TEXT_TABLES = ("reviews",)


def require_sources(spark: SparkSession, paths: Iterable[str]) -> None:
    """Fail before planning, naming every missing input, on whatever file system the path lives."""
    jvm = spark.sparkContext._jvm
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    missing = []
    for path in paths:
        location = jvm.org.apache.hadoop.fs.Path(path)
        if not location.getFileSystem(hadoop).exists(location):
            missing.append(path)
    if missing:
        raise FileNotFoundError(f"missing source tables: {', '.join(missing)}")


def _by_header(spark: SparkSession, reader: DataFrameReader, path: str, declared: StructType) -> dict[tuple[str, ...], list[str]]:
    """The files of a path by their header; one job reads the first record of all of them.

    On a file system that tasks cannot open themselves, Spark reads one line of each file, a job a file. A path
    without records has one header, its own; if all files agree, the path stands for them.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    if files.mounted(spark, path):
        for row in files.csv_headers(files.listing(spark, path)).filter("header is not null").collect():
            groups.setdefault(tuple(row["header"]), []).append(row["path"])
    else:
        for file in reader.csv(path).inputFiles():
            groups.setdefault(tuple(reader.csv(file).columns), []).append(file)
    if len(groups) < 2:
        groups = {next(iter(groups)) if groups else tuple(reader.csv(path).columns): [path]}
    for header in groups:
        missing = [name for name in declared.names if name not in header]
        if missing:
            raise ValueError(f"{path} lacks columns: {', '.join(missing)}")
    return groups


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def _split_records(spark: SparkSession, path: str) -> DataFrame | None:
    if not files.mounted(spark, path):
        return None
    found = files.listing(spark, path)
    packed = found.filter(F.lower("path").rlike(r"\.(gz|bz2|zst|lz4|snappy|deflate)$")).limit(1).count()
    return None if packed else files.quoted_records(found)


def scan_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    ts_format: str | None = None,
    multi_line: bool = False,
    unread: str | None = None,
) -> DataFrame:
    """Headed CSV with declared types, matched by column name; unreadable values become NULL.

    Files of one path may have their columns in different orders, or further columns, which pass through as text.
    Without a schema the types are inferred, which costs a second read of the data. ``unread`` names a further column: the
    names of the columns whose text could not be read, per row, or NULL. It comes from the same pass: Spark keeps the text of
    such records, and only these are taken apart again.
    """
    reader = spark.read.options(**CSV_OPTIONS).option("multiLine", multi_line)
    if ts_format:
        reader = reader.option("timestampNTZFormat", ts_format)
    if schema is None:
        return reader.option("inferSchema", True).option("prefersDate", True).csv(path)
    groups = _by_header(spark, reader, path, schema)
    # Files with quoted line breaks are split by their quotes, where tasks can open them and they are not compressed.
    records = _split_records(spark, path) if multi_line else None
    options = {k: str(v) for k, v in CSV_OPTIONS.items() if k != "header"} | {"multiLine": str(multi_line)}
    options |= {"timestampNTZFormat": ts_format} if ts_format else {}
    parts = []
    for header, paths in groups.items():
        typed = StructType([schema[n] if n in schema.names else StructField(n, StringType()) for n in header])
        kept = StructType([*typed, StructField(unread, StringType())]) if unread else typed
        if unread:
            options["columnNameOfCorruptRecord"] = unread
        if records is None:
            part = reader.options(**options).option("header", True).schema(kept).csv(paths)
        else:
            own = records if len(groups) == 1 else records.filter(F.col("path").isin(paths))
            part = own.select(F.from_csv("value", _ddl(kept), options).alias("row")).select("row.*")
        if unread:
            text = F.from_csv(unread, ", ".join(f"`{n}` string" for n in header), {k: v for k, v in options.items() if "Corrupt" not in k})
            lost = [F.when(text[n].isNotNull() & F.col(f"`{n}`").isNull(), F.lit(n)) for n in schema.names if n in header]
            part = part.withColumn(unread, F.when(F.col(unread).isNotNull(), F.array_compact(F.array(*lost))))
        parts.append(part)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def unread_counts(df: DataFrame, unread: str = "_unread") -> DataFrame:
    """(column, n): how many values of each column could not be read; ``df`` is a ``scan_csv`` with that column."""
    named = df.select(F.explode(unread).alias("column"))
    return named.groupBy("column").agg(F.count(F.lit(1)).alias("n"))


def scan_parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Parquet, with partition folders typed as ``schema`` says; without one Spark guesses their types from the names."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def scan_json(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read
    return (reader.schema(schema) if schema else reader).json(path)


def read_tables(
    spark: SparkSession,
    directory: str,
    schemas: Mapping[str, StructType],
    fmt: str = "csv",
    ts_format: str | None = None,
    filenames: Mapping[str, str] | None = None,
    unread: str | None = None,
) -> dict[str, DataFrame]:
    """One DataFrame per table found as ``directory/<name>.<fmt>`` (or the name given in ``filenames``).

    ``unread``: see ``scan_csv``."""
    paths = {
        name: f"{directory.rstrip('/')}/{(filenames or {}).get(name, f'{name}.{fmt}')}" for name in schemas
    }
    require_sources(spark, paths.values())
    if fmt == "csv":
        return {
            name: scan_csv(spark, path, schemas[name], ts_format, name in FREE_TEXT_TABLES, unread)
            for name, path in paths.items()
        }
    return {name: spark.read.schema(schemas[name]).format(fmt).load(path) for name, path in paths.items()}


def is_timestamp_name(column: str) -> bool:
    return column.endswith(("_timestamp", "_date")) or column == "order_approved_at"


def coerce_timestamps(df: DataFrame, columns: Iterable[str] | None = None, fmt: str | None = None) -> DataFrame:
    """Turn text columns into zone-free timestamps; text that does not parse becomes NULL.

    Without ``columns`` the name rule picks them. ``fmt`` parses one explicit pattern, read as UTC and rebuilt
    from its epoch microseconds, so the session time zone never moves a value.
    """
    if columns is None:
        columns = [f.name for f in df.schema if is_timestamp_name(f.name) and isinstance(f.dataType, StringType)]
    parsed = {}
    for name in columns:
        if fmt is None:
            parsed[name] = F.col(name).try_cast("timestamp_ntz")
        else:
            text = F.concat(F.col(name), F.lit(" +00:00"))
            micros = F.unix_micros(F.try_to_timestamp(text, F.lit(f"{fmt} XXX")))
            seconds = (micros / F.lit(1_000_000)).cast("decimal(20,6)")
            parsed[name] = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(
                F.lit(0), F.lit(0), F.lit(0), seconds
            )
    return df.withColumns(parsed)


def raw_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, df in tables.items()
    ]
    result = counts[0]
    for part in counts[1:]:
        result = result.unionByName(part)
    return result


def register(tables: Mapping[str, DataFrame], prefix: str = "raw_") -> list[str]:
    """Replaceable temporary views, one per table."""
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in tables]


def source_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """SHA-256 of every file, hashed in the task that reads it, in pieces of a few megabytes.

    On a file system that tasks cannot open themselves, Spark reads each file whole, and refuses those of 2 GB and more.
    """
    if files.mounted(spark, path):
        hashed = files.sha256_of_files(files.listing(spark, path, glob))
    else:
        whole = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
        hashed = whole.select("path", "length", F.sha2("content", 256).alias("sha256"))
    return hashed.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), "sha256")
