"""Sorted hash arrays in the shared folder: tables that tasks write in shards, by ranges of 64-bit keys, and workers map."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.staging import fresh_path

#: Packed numbers on their way to the shard that adds them up.
BLOB = "kind int, shard int, n long, body binary"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, as a path: mapping needs a file system that all machines mount."""
    uri = fresh_path(spark, name)
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"workers map files: spark.checkpoint.dir must be a mounted folder, not {uri}")
    folder = unquote(parts.path)
    os.makedirs(folder, exist_ok=True)
    return folder


def shard_count(source: DataFrame) -> int:
    """Shards in proportion to the input's splits, so that a shard's size does not depend on the input's."""
    return max(8, 4 * source.rdd.getNumPartitions())


def bounds(shards: int) -> np.ndarray:
    return np.array([(i << 64) // shards for i in range(shards)] + [(1 << 64) - 1], dtype=np.uint64)


def pack(arrays: Sequence[np.ndarray], widths: Sequence[int]) -> bytes:
    """The low ``widths`` bytes of each array, byte position after byte position: equal bytes stand together."""
    return b"".join(
        np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes() for a, w in zip(arrays, widths)
    )


def unpack(body: bytes, n: int, widths: Sequence[int]) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(body, np.uint8), 0, []
    for w in widths:
        whole = np.zeros((n, 8), np.uint8)
        whole[:, :w] = raw[at : at + n * w].reshape(w, n).T
        out.append(whole.reshape(-1).view("<u8").astype(np.uint64))
        at += n * w
    return out


def unpack_all(blobs: Sequence[tuple[int, bytes]], widths: Sequence[int]) -> list[np.ndarray]:
    parts = [unpack(body, n, widths) for n, body in blobs]
    return [np.concatenate([p[k] for p in parts]) for k in range(len(widths))]


def send(kind: int, key: np.ndarray, arrays: Sequence[np.ndarray], widths: Sequence[int], shards: int) -> Iterator[tuple]:
    """Rows ordered by key as one blob for each shard."""
    cuts = np.searchsorted(key, bounds(shards), "left")
    cuts[-1] = len(key)
    for shard, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
        if j > i:
            yield kind, shard, int(j - i), pack([a[i:j] for a in arrays], widths)


def batches_of(rows: Iterator[tuple], limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())

    def batch() -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in held], t) for i, t in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names=["kind", "shard", "n", "body"])

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3])
        if size > limit:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple[int, bytes]]]]:
    """(kind, shard, blobs) from rows that arrive ordered by kind and shard."""
    now, held = None, []
    for batch in batches:
        for kind, shard, n, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (kind, shard) != now:
                if held:
                    yield *now, held
                now, held = (kind, shard), []
            held.append((n, body))
    if held:
        yield *now, held


def to_shards(sent: DataFrame, shards: int) -> DataFrame:
    return sent.repartition(shards, "kind", "shard").sortWithinPartitions("kind", "shard")


def save(folder: str, table: str, shard: int, **arrays: np.ndarray) -> None:
    """Each array to a file of its own, under its final name only when whole: a task that runs twice does no harm."""
    for part, array in arrays.items():
        path = os.path.join(folder, f"{table}-{shard}-{part}.npy")
        own = f"{path}.{os.getpid()}-{np.random.default_rng().integers(1 << 62)}"
        with open(own, "wb") as file:
            np.save(file, array)
        os.replace(own, path)


class Tables:
    """The tables of a folder as one worker sees them: mapped files, opened when first needed."""

    def __init__(self, folder: str, shards: int) -> None:
        self.folder, self.bounds = folder, bounds(shards)
        self.open: dict[str, np.ndarray | None] = {}

    def _file(self, name: str) -> np.ndarray | None:
        if name not in self.open:
            path = os.path.join(self.folder, f"{name}.npy")
            self.open[name] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self.open[name]

    def lookup(self, table: str, keys: np.ndarray, parts: dict[str, int], kind=np.float64) -> tuple[np.ndarray, ...]:
        """(found, value of each part) for keys in any order; ``parts`` gives widths. Unknown keys have zeros."""
        distinct, back = np.unique(keys, return_inverse=True)
        found = np.zeros(len(distinct), bool)
        out = [np.zeros((len(distinct), width), kind) for width in parts.values()]
        cuts = np.searchsorted(distinct, self.bounds, "left")
        cuts[-1] = len(distinct)
        for shard, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
            stored = self._file(f"{table}-{shard}-key") if j > i else None
            if stored is None or not len(stored):
                continue
            place = np.minimum(np.searchsorted(stored, distinct[i:j]), len(stored) - 1)
            hit = np.flatnonzero(stored[place] == distinct[i:j])
            found[i + hit] = True
            for array, part in zip(out, parts):
                array[i + hit] = self._file(f"{table}-{shard}-{part}")[place[hit]].reshape(len(hit), array.shape[1])
        return found[back], *(v[back] for v in out)
