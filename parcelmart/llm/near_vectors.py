"""Near-duplicate vectors by counting window collisions on sorted projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .columns import held
from .components import connected_components

_SKETCH_BITS = 64


def _normal_tail(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def _normal_quantile(tail: float) -> float:
    low, high = 0.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _normal_tail(mid) > tail else (low, mid)
    return low


def _binomial_tail(n: int, p: float, least: int) -> float:
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least, n + 1))


def calibrate(cosine: float, projections: int, probes: int, window: float, recall: float) -> tuple[int, float]:
    """(least count, floor of stored values).

    On random directions a unit vector has independent normal values. Given the query's value v, that of a vector at
    ``cosine`` is normal around cosine * v with deviation sqrt(1 - cosine^2), so the chance p that it falls into
    [v - window, v + window] is known, and the count over the query's ``probes`` windows is binomial. The least
    count is the largest that keeps ``recall``. Both vectors of a pair are queries, so real recall is higher.
    """
    v = _normal_quantile(probes / (2 * projections))
    spread = math.sqrt(1 - cosine * cosine)
    gap = (1 - cosine) * v
    p = 1 - _normal_tail((gap + window) / spread) - _normal_tail((window - gap) / spread)
    least = max([k for k in range(1, probes + 1) if _binomial_tail(probes, p, k) >= recall], default=0)
    if not least:
        raise ValueError("no count reaches the recall: more probes or a wider window are needed")
    return least, v - window


def _directions(dim: int, projections: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, projections]).standard_normal((dim, projections), np.float32)


def _project(batches: Iterator[pa.RecordBatch], projections: int, probes: int, floor: float, seed: int) -> Iterator[pa.RecordBatch]:
    """Of each vector: the ``probes`` projections on which it stands farthest out, and all others above ``floor``."""
    made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        vectors = [np.asarray(v, np.float64) for v in batch.column("_v").to_pylist()]
        for dim in sorted({len(v) for v in vectors}):
            if dim not in made:
                made[dim] = _directions(dim, projections, seed), _directions(dim, _SKETCH_BITS, seed + 1)
            rows = [i for i, v in enumerate(vectors) if len(v) == dim]
            for at in range(0, len(rows), 512):
                some = rows[at : at + 512]
                x = np.stack([vectors[i] for i in some])
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                value = x.astype(np.float32) @ made[dim][0]
                size = np.abs(value)
                top = np.partition(size, -probes, axis=1)[:, -probes, None] if probes < projections else size[:, :1] * 0
                sketch = ((x @ made[dim][1]) > 0).astype(np.uint64) @ (np.uint64(1) << np.arange(_SKETCH_BITS, dtype=np.uint64))
                row, line = np.nonzero((size >= floor) | (size >= top))
                found = value[row, line]
                yield pa.RecordBatch.from_pydict(
                    {
                        "c": batch.column("c").take(pa.array(np.asarray(some)[row])),
                        "line": pa.array((line * 2 + (found < 0)).astype(np.int64) + np.int64(dim) * (2 * projections)),
                        "value": pa.array(np.abs(found).astype(np.float64)),
                        "probe": pa.array(size[row, line] >= top[row, 0]),
                        "sketch": pa.array(sketch[row].view(np.int64)),
                    }
                )


def vector_classes(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(key, c, _v) of every row: the vector in double precision, and a class shared by exact copies; NULL class if unusable."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    usable = F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))
    tidy = F.transform(v, lambda x: x + F.lit(0.0))
    return vectors.select(F.col(key).alias("key"), F.when(usable, tidy).alias("_v")).select(
        "key", F.unhex(F.md5(F.array_join("_v", ",").cast("binary"))).alias("c"), "_v"
    )


def near_links(
    classes: DataFrame,
    cosine: float = 0.9,
    projections: int | None = None,
    probes: int = 12,
    window: float = 0.4,
    recall: float = 0.99,
    seed: int = 2,
) -> DataFrame:
    """(a, b) with a < b: pairs of classes (c, _v) found with a cosine of at least ``cosine``.

    Values on each projection are sorted into cells as wide as the window. A vector queries the projections on which it stands
    farthest out, where few unrelated vectors stand: every vector within ``window`` of the query's value
    collides with it. Pairs with the calibrated number of collisions are verified in double precision. With the number of
    projections growing as the square root of the vectors, windows stay short. A 64-bit sign sketch, which
    a pair at ``cosine`` passes but for about one in a million, drops most unrelated collisions before they are counted.
    Vectors of unlike length are not compared.
    """
    if projections is None:
        projections = 1 << max(10, math.ceil(math.log2(32 * math.sqrt(max(1, classes.count())))))
    least, floor = calibrate(cosine, projections, probes, window, recall)
    entries = classes.mapInArrow(
        lambda batches: _project(batches, projections, probes, floor, seed), "c binary, line long, value double, probe boolean, sketch long"
    )
    entries = stage(entries, "vector-entries").withColumn("cell", F.floor(F.col("value") / F.lit(window)))
    queries = entries.filter("probe").select(
        F.col("c").alias("q"), F.col("value").alias("at"), F.col("sketch").alias("own"), "line",
        F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"),
    )
    angle = math.acos(cosine) / math.pi * _SKETCH_BITS
    most = math.ceil(angle + 5 * math.sqrt(angle * (1 - angle / _SKETCH_BITS)))
    close = (
        (F.col("q") != F.col("c"))
        & (F.abs(F.col("at") - F.col("value")) <= F.lit(window))
        & (F.bit_count(F.col("own").bitwiseXOR(F.col("sketch"))) <= most)
    )
    hits = queries.join(entries.select("c", "line", "cell", "value", "sketch"), ["line", "cell"]).filter(close)
    pairs = (
        hits.groupBy(F.least("q", "c").alias("a"), F.greatest("q", "c").alias("b"))
        .agg(F.count_if(F.col("q") < F.col("c")).alias("n"), F.count_if(F.col("q") > F.col("c")).alias("m"))
        .filter(F.greatest("n", "m") >= least)
        .select("a", "b")
    )
    # Scaled by the power of two below the greatest entry, which is exact: products can neither overflow nor vanish.
    power = F.pow(F.lit(2.0), F.least(F.lit(1023), F.floor(F.log2(F.array_max(F.transform("_v", lambda x: F.abs(x)))))))
    sized = classes.withColumn("_p", held(power))
    unit = lambda side: sized.select(F.col("c").alias(side), F.transform("_v", lambda x: x / F.col("_p")).alias(f"_{side}"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    norm = F.sqrt(dot("_a", "_a")) * F.sqrt(dot("_b", "_b"))
    return (
        pairs.join(unit("a"), "a").join(unit("b"), "b").filter(dot("_a", "_b") / norm >= F.lit(cosine)).select("a", "b")
    )


def link_vectors(vectors: DataFrame, cosine: float = 0.9, key: str = "vec_id", embedding: str = "embedding", **how) -> DataFrame:
    """One row per vector: key, n_links (other rows linked directly), component_id (smallest key reachable), kept.

    Exact copies are one class: they link with each other and share all links, without their pairs being made. A
    NULL or zero vector, or one with NULL or non-finite components, links with nothing and is its own component, as is any
    vector without links. Rows that repeat a key are vectors of their own; a NULL key names a component only if no other does.
    An empty table gives no rows.
    """
    rows = stage(vector_classes(vectors, key, embedding), "vector-rows")
    classes = stage(
        rows.filter("c is not null").groupBy("c").agg(
            F.first("_v").alias("_v"), F.count(F.lit(1)).alias("n"), F.min("key").alias("least")
        ),
        "vector-classes",
    )
    links = stage(near_links(classes.select("c", "_v"), cosine, **how), "vector-links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beside = both.join(classes.select(F.col("c").alias("b"), "n"), "b").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("others"))
    component = connected_components(links).select(F.col("node").alias("c"), "component")
    placed = classes.select("c", "n", "least").join(component, "c", "left").withColumn("component", F.coalesce("component", "c"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    found = placed.join(least, "component").join(beside, "c", "left").select(
        "c", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("_links"), "component_id"
    )
    own = F.col("c").isNull()
    return rows.select("key", "c").join(found, "c", "left").select(
        F.col("key").alias(key),
        F.coalesce("_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(own, F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
        (own | F.col("key").eqNullSafe(F.col("component_id"))).alias("kept"),
    )
