"""Near-duplicate texts by ProbMinHash signatures of weighted word shingles, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .components import connected_components
from .textbytes import LOWER, RangeHash, blocks, flat_utf8, mix, words

SHINGLE_WORDS = 5
SIMILARITY = 0.8
REGISTERS = 128
BAND_ROWS = 5
#: Classes of a bucket that are compared at once, with as many others.
BLOCK_CLASSES = 1024
#: Registers of the longer signatures that blocks compare.
BLOCK_REGISTERS = 512
#: Deviations under the similarity from which a block's estimate drops a pair: 1 true pair in 37,000 in both lengths.
BLOCK_MARGIN = 4.5
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray, hasher: RangeHash, width: int = SHINGLE_WORDS):
    """(row, hash, weight) of the distinct shingles of each text, ordered; a shorter text with words is one shingle.

    The weight of a shingle is how often it stands in the text.
    """
    low = LOWER[data]
    start, end, row = words(low, offsets)
    word = hasher.ranges(hasher.sums(low), start, end)
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(count)])
    place = np.arange(len(word)) - first[row]
    own = np.minimum(width, count[row])
    head = place <= count[row] - own
    at = np.flatnonzero(head)
    value = np.zeros(len(at), np.uint64)
    for k in range(width):
        inside = k < own[at]
        step = mix(value * _GOLD + word[np.minimum(at + k, len(word) - 1)] + np.uint64(k + 1)) if len(word) else value
        value = np.where(inside, step, value)
    rows = row[at]
    order = np.lexsort((value, rows))
    rows, value = rows[order], value[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    weight = np.diff(np.concatenate([at, [len(rows)]]))
    return rows[at], value[at], weight


def signatures(rows: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signatures (n x m): registers of two texts agree with the probability of their probability Jaccard.

    A shingle of weight w visits the registers in an order of its own; its arrivals are those of exponentials of rate w
    / m, spaced for visits without return. Each register keeps the shingle that arrives first. All shingles make one step
    at a time, and one ends as soon as its next arrival comes after every register of its text is taken for good.
    """
    time = np.full(n * m, np.inf)
    owner = np.zeros(n * m, np.uint64)
    seed = mix(value ^ np.uint64(0x5851F42D4C957F2D))
    first = (seed >> np.uint64(8)) % np.uint64(m)
    stride = (mix(seed + _GOLD) % np.uint64(m // 2)) * np.uint64(2) + np.uint64(1)
    arrival = np.zeros(len(value))
    live = np.arange(len(value))
    for i in range(m):
        draw = mix(value[live] + np.uint64(int(_GOLD) * (2 * i + 1) % (1 << 64)))
        u = ((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
        arrival[live] -= np.log(u) / weight[live] * (m / (m - i))
        latest = time.reshape(n, m).max(axis=1)
        live = live[arrival[live] < latest[rows[live]]]
        if not len(live):
            break
        register = ((first[live] + np.uint64(i) * stride[live]) % np.uint64(m)).astype(np.int64)
        cell = rows[live] * m + register
        order = np.lexsort((value[live], arrival[live], cell))
        cell, who = cell[order], live[order]
        best = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        cell, who = cell[best], who[best]
        better = arrival[who] < time[cell]
        time[cell[better]] = arrival[who[better]]
        owner[cell[better]] = value[who[better]]
    return owner.reshape(n, m)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact probability Jaccard of two weighted sets (sorted distinct hashes and their weights)."""
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    wa, wb = wa.astype(float), wb.astype(float)
    x, y = wa[i], wb[j]
    # For a shared shingle d: 1 / sum over e of max(A(e) / A(d), B(e) / B(d)). With r = B(d) / A(d) the sum is that of
    # max(A(e), B(e) / r) / A(d); shared shingles ordered by B(e) / A(e) give it from two running sums.
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    ratio, x, y = ratio[order], x[order], y[order]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    run_x = np.concatenate([[0.0], np.cumsum(x)])
    run_y = np.concatenate([[0.0], np.cumsum(y)])
    upto = np.searchsorted(ratio, ratio, "right")
    total = only_a + only_b / ratio + run_x[upto] + (run_y[-1] - run_y[upto]) / ratio
    return float(np.sum(x / total))


def classes_of(rows: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int) -> list[bytes]:
    """128 bits for each text that depend on its weighted shingles alone; copies share them."""
    pair = mix(value + _GOLD * weight.astype(np.uint64))
    sums = np.zeros((n, 2), np.uint64)
    np.add.at(sums[:, 0], rows, pair)
    np.add.at(sums[:, 1], rows, mix(pair + _GOLD))
    return [s.tobytes() for s in sums]


def _sign(batches: Iterator[pa.RecordBatch], key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    hasher = RangeHash()
    bands = REGISTERS // BAND_ROWS
    for batch in batches:
        data, offsets = flat_utf8(batch.column("text"))
        for start, stop in blocks(offsets):
            cut = offsets[start : stop + 1]
            rows, value, weight = shingles(data[cut[0] : cut[-1]], cut - cut[0], hasher)
            n = stop - start
            owner = signatures(rows, value, weight, n)
            some = np.bincount(rows, minlength=n) > 0
            at = np.flatnonzero(some)
            text_class = classes_of(rows, value, weight, n)
            band = np.zeros((n, bands), np.uint64)
            for k in range(bands * BAND_ROWS):
                band[:, k // BAND_ROWS] = mix(band[:, k // BAND_ROWS] * _GOLD + owner[:, k] + np.uint64(k + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").slice(start, n).take(pa.array(at)).cast(key_type),
                    pa.array([text_class[i] for i in at], pa.binary()),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(at) + 1, dtype=np.int32) * bands), pa.array(band[at].view(np.int64).reshape(-1))
                    ),
                ],
                names=["key", "c", "bands"],
            )


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = RangeHash()
    for batch in batches:
        data, offsets = flat_utf8(batch.column("text"))
        for start, stop in blocks(offsets):
            cut = offsets[start : stop + 1]
            rows, value, weight = shingles(data[cut[0] : cut[-1]], cut - cut[0], hasher)
            n = stop - start
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
            asked = batch.column("c").slice(start, n)
            out = pa.RecordBatch.from_arrays(
                [
                    asked,
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(value.view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(weight.astype(np.int32))),
                ],
                names=["c", "value", "weight"],
            )
            # Where several documents share a key, only a text of the class that was asked for counts.
            own = [a == b for a, b in zip(asked.to_pylist(), classes_of(rows, value, weight, n))]
            yield out.filter(pa.array(own, pa.bool_()))


def _verify(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    def lists(column):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths().fill_null(0)))])
        return [flat[i:j] for i, j in zip(ends[:-1], ends[1:])]

    for batch in batches:
        sides = [lists(batch.column(c)) for c in ("value_a", "weight_a", "value_b", "weight_b")]
        good = []
        for va, wa, vb, wb in zip(*sides):
            # Probability Jaccard has no scale: a text and the same text twice are near 1, so total weights bound nothing.
            good.append(probability_jaccard(va.view(np.uint64), wa, vb.view(np.uint64), wb) >= least)
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _resign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures of classes from their shingles: the low 32 bits of each register's owner."""
    for batch in batches:
        lists = batch.column("value")
        count = np.asarray(lists.value_lengths())
        value = lists.flatten().to_numpy().view(np.uint64)
        weight = batch.column("weight").flatten().to_numpy()
        owner = signatures(np.repeat(np.arange(len(count)), count), value, weight, len(count), BLOCK_REGISTERS).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array([o.tobytes() for o in owner], pa.binary())], names=["c", "registers"])


def _block_pairs(similarity: float):
    """Pairs of one or two blocks of a bucket that lie in different components and whose signatures come near ``similarity``."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        low, high = int(block["low"].iloc[0]), int(block["high"].iloc[0])
        sides = [block[block["own"] == low], block[block["own"] == high]]
        a, b = (
            (
                np.frombuffer(b"".join(x["registers"]), np.uint32).reshape(-1, BLOCK_REGISTERS),
                np.stack(x["bands"].to_list()) if len(x) else np.zeros((0, 1), np.int64),
                np.array([bytes(c) for c in x["c"]], object),
                np.array([bytes(c) for c in x["component"]], object),
            )
            for x in sides
        )
        band = int(block["band"].iloc[0])
        out = []
        for i in range(len(a[0])):
            # A pair is settled in the first bucket it shares, and once.
            open_pair = (b[3] != a[3][i]) & ~(b[1][:, :band] == a[1][i, :band]).any(axis=1)
            if low == high:
                open_pair &= b[2] > a[2][i]
            at = np.flatnonzero(open_pair)
            for n, sure in ((REGISTERS, BLOCK_MARGIN), (BLOCK_REGISTERS, BLOCK_MARGIN)):
                floor = similarity - sure * np.sqrt(similarity * (1 - similarity) / n)
                at = at[(b[0][at, :n] == a[0][i, :n]).sum(axis=1) >= floor * n]
            out += [(min(a[2][i], c), max(a[2][i], c)) for c in b[2][at]]
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def _verified(pairs: DataFrame, content: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose probability Jaccard is at least ``similarity``."""
    side = lambda s: content.select(F.col("c").alias(s), F.col("value").alias(f"value_{s}"), F.col("weight").alias(f"weight_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.mapInArrow(lambda batches: _verify(batches, similarity), "a binary, b binary")


def _placed(rows: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``rows`` (with c) and the component of c."""
    component = stage(connected_components(links).select(F.col("node").alias("c"), "component"), name)
    return rows.join(component, "c", "left").withColumn("component", F.coalesce("component", "c"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, class_id (smallest key of its group), kept (key = class_id).

    Documents are linked if the probability Jaccard of their 5-word shingles (A-Z lower-cased, weighted by how
    often they occur) is at least ``similarity``; groups are the components. Copies of one shingle set are one class from the start.
    Classes that share a band are candidates; 25 bands of 5 registers find a pair at 0.8 but for 1 in 20,000.

    Within a bucket pairs are not all made. First its hub, the class with the most company in its buckets, is
    verified against the others, and components are formed. What a bucket then holds of different components is dealt into blocks; pairs of
    blocks compare signatures, and only pairs of different components that come within ``BLOCK_MARGIN`` deviations of
    ``similarity`` are verified too. So a large group of near copies costs one pair a member, and no task holds a bucket.

    A text with one to four words is a single shingle; NULL texts and texts without words are linked with nothing. Rows that
    repeat a key are documents of their own; a NULL key names a group only if no other does. An empty table gives no rows.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_type = pa.int64() if source.schema["key"].dataType.simpleString() in ("bigint", "int") else pa.string()
    key_sql = "long" if key_type == pa.int64() else "string"
    source = source.withColumn("key", F.col("key").cast(key_sql))
    signed = stage(
        source.mapInArrow(lambda batches: _sign(batches, key_type), f"key {key_sql}, c binary, bands array<long>"), "text-signatures"
    )
    classes = stage(signed.groupBy("c").agg(F.min("key").alias("least"), F.first("bands").alias("bands")), "text-classes")
    entries = classes.select("c", F.posexplode("bands").alias("band", "value"))
    buckets = entries.select(F.xxhash64("band", "value").alias("bucket"), "band", "c")
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = stage(buckets.join(sizes, "bucket"), "text-buckets")
    company = stage(shared.groupBy("c").agg(F.sum("size").alias("company")), "text-company")

    # Shingles of one text of each candidate class.
    first_key = classes.join(company, "c", "left_semi").select("c", "least")
    one = source.join(first_key, F.col("key").eqNullSafe(F.col("least"))).select("c", "text")
    content = stage(one.mapInArrow(_shingle_rows, "c binary, value array<long>, weight array<int>").dropDuplicates(["c"]), "text-shingles")

    hubs = shared.join(company, "c").groupBy("bucket").agg(F.max(F.struct("company", "c"))["c"].alias("hub"))
    stars = shared.join(hubs, "bucket").filter("c <> hub")
    stars = stars.select(F.least("c", "hub").alias("a"), F.greatest("c", "hub").alias("b")).distinct()
    links = stage(_verified(stars, content, similarity), "text-star-links")

    members = stage(_placed(shared, links, "text-star-components"), "text-members")
    mixed = members.groupBy("bucket").agg(
        (F.min("component") != F.max("component")).alias("several"), F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES).cast("int").alias("blocks")
    )
    rest = members.join(mixed.filter("several").drop("several"), "bucket")
    registers = content.join(rest.select("c"), "c", "left_semi").mapInArrow(_resign, "c binary, registers binary")
    detail = stage(registers.join(classes.select("c", "bands"), "c"), "text-registers")
    own = F.pmod(F.xxhash64("c"), F.col("blocks"))
    dealt = (
        rest.select("bucket", "band", "c", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("bucket", "band", "c", "component", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
        .join(detail, "c")
    )
    pairs = dealt.groupBy("bucket", "low", "high").applyInPandas(_block_pairs(similarity), "a binary, b binary")
    more = stage(_verified(stage(pairs, "text-pairs"), content, similarity), "text-block-links")

    placed = _placed(classes.select("c", "least"), links.unionByName(more), "text-components")
    named = placed.groupBy("component").agg(F.min("least").alias("class_id"))
    grouped = signed.select("key", "c").join(placed.join(named, "component").select("c", "class_id"), "c").select("key", "class_id")
    # Texts without words have no signature.
    wordless = source.filter(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).select("key", F.col("key").alias("class_id"))
    out = grouped.unionByName(wordless)
    return out.select(F.col("key").alias(key), "class_id", F.col("key").eqNullSafe(F.col("class_id")).alias("kept"))
