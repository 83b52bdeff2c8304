"""Whole files as streams: one Spark job for any number of files of any size, a few megabytes of each held at a time."""

from __future__ import annotations

import csv
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CHUNK = 8 << 20


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length) of the files that Spark reads under a path. Its scan deals them to tasks by size; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length")


def mounted(spark: SparkSession, path: str) -> bool:
    """Whether the path is on a file system that all machines mount, so that tasks can open its files themselves."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() == "file"


def _open(uri: str) -> str:
    return unquote(urlparse(uri).path)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for uri in batch.column("path").to_pylist():
            digest = hashlib.sha256()
            with open(_open(uri), "rb") as file:
                while chunk := file.read(_CHUNK):
                    digest.update(chunk)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(found, pa.string())], names=["path", "length", "sha256"])


def sha256_of_files(files: DataFrame) -> DataFrame:
    """(path, length, sha256) of mounted files."""
    return files.mapInArrow(_hashes, "path string, length long, sha256 string")


def _first_record(uri: str) -> list[str] | None:
    path = _open(uri)
    with pa.input_stream(path, compression="detect") as raw, io.TextIOWrapper(raw, "utf-8-sig", errors="replace", newline="") as text:
        return next((record for record in csv.reader(text) if record), None)


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.string())
    for batch in batches:
        found = [_first_record(uri) for uri in batch.column("path").to_pylist()]
        named = [None if r is None else [name or f"_c{i}" for i, name in enumerate(r)] for r in found]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(named, kind)], names=["path", "header"])


def csv_headers(files: DataFrame) -> DataFrame:
    """(path, header) of mounted CSV files: the first record of each, which may hold quoted line breaks; NULL of an empty file."""
    return files.mapInArrow(_headers, "path string, header array<string>")


# Quoted records of large files: a line break ends a record if an even number of quotes stands before it.


def _quotes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for uri, k in zip(batch.column("path").to_pylist(), batch.column("piece").to_pylist()):
            with open(_open(uri), "rb") as file:
                file.seek(k * size)
                found.append(file.read(size).count(b'"') % 2)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=[*batch.schema.names, "odd"])


def _ends(data: bytes, odd: int) -> np.ndarray:
    """Places of the line breaks outside quotes; ``odd``: whether the data starts inside."""
    octets = np.frombuffer(data, np.uint8)
    inside = np.cumsum(octets == 34, dtype=np.uint8) + np.uint8(odd)
    return np.flatnonzero((octets == 10) & (inside & 1 == 0))


def _records(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The records that start in each piece; the last one is followed beyond the piece's end."""
    for batch in batches:
        for uri, k, odd in zip(*(batch.column(c).to_pylist() for c in ("path", "piece", "before"))):
            with open(_open(uri), "rb") as file:
                # One byte earlier, to see whether a record starts with the piece; a quote there is already counted.
                first = max(0, k * size - 1)
                file.seek(first)
                data = file.read(size + (k > 0))
                odd ^= int(k > 0 and data[:1] == b'"')
                ends = _ends(data, odd)
                starts = np.concatenate([[0] if k == 0 else [], ends + 1]).astype(np.int64)
                starts = starts[starts < len(data)]
                if not len(starts):
                    continue
                if not len(ends) or ends[-1] < starts[-1]:
                    parts, odd = [data], (odd + data.count(b'"')) % 2
                    while more := file.read(1 << 20):
                        parts.append(more)
                        if len(found := _ends(more, odd)):
                            parts[-1] = more[: found[0] + 1]
                            break
                        odd = (odd + more.count(b'"')) % 2
                    data = b"".join(parts)
            stops = np.append(starts[1:], len(data) + (not data.endswith(b"\n"))) - 1
            for at in range(0, len(starts), 4096):
                texts = [data[i:j].removesuffix(b"\r").decode("utf-8", "replace") for i, j in zip(starts[at : at + 4096], stops[at : at + 4096])]
                if k == 0 and at == 0:
                    texts[0] = texts[0].removeprefix("﻿")
                    texts = texts[next((i for i, t in enumerate(texts) if t), len(texts) - 1) + 1 :]  # the header
                texts = [t for t in texts if t]
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(texts), pa.string()), pa.array(texts, pa.string())], names=["path", "value"])


def quoted_records(files: DataFrame, size: int = 16 << 20) -> DataFrame:
    """(path, value): the records of mounted, uncompressed CSV files without their headers, quoted line breaks included.

    Files are cut into pieces of ``size`` bytes. A first pass counts the quotes of each piece; the pieces before tell whether one
    starts inside quotes, and then every task finds the records that start in its piece. Empty lines are no records.
    """
    pieces = files.filter("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / F.lit(size)))).alias("piece"))
    # As many tasks as pieces: rows this small would otherwise be gathered in one.
    tasks = max(1, files.agg(F.sum(F.ceil(F.col("length") / F.lit(size)))).first()[0] or 1)
    dealt = pieces.repartition(int(tasks), "path", "piece")
    counted = dealt.mapInArrow(lambda batches: _quotes(batches, size), "path string, piece long, odd int")
    before = Window.partitionBy("path").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    known = counted.select("path", "piece", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int").alias("before"))
    return known.repartition(int(tasks), "path", "piece").mapInArrow(lambda batches: _records(batches, size), "path string, value string")
