"""Whitening by the eigenvectors of an exact covariance, found in single precision and refined by Ogita-Aishima iterations."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Components of less than this share of the largest variance, times the dimension, are not told from zero.
_ZERO = 2.0**-50
#: Largest size of a fixed-point entry; a vector with a larger one has no place in a long.
_LARGEST = 2.0**62
_MASK = np.int64(2**32 - 1)
#: Rows of a matrix that one task adds up at a time, and groups of tasks that are added up first.
_ROWS, _FIRST = 32, 16

# Exact sums of integer arrays, as limbs of 32 bits of which only the last has a sign. Limbs are added up apart.


def limbs(values: np.ndarray) -> np.ndarray:
    """(limbs, *shape) of an integer array, of Python's integers too."""
    out = []
    while True:
        if values.dtype == object:
            if all(-(2**62) <= v < 2**62 for v in values.flat):
                values = values.astype(np.int64)
                continue
            out.append(np.array([v & (2**32 - 1) for v in values.flat], np.int64).reshape(values.shape))
            values = np.array([v >> 32 for v in values.flat], object).reshape(values.shape)
            continue
        out += [values & _MASK, values >> 32]
        return np.stack(out)


def whole(parts: np.ndarray) -> np.ndarray:
    """Python's integers from limbs, or from sums of limbs."""
    return sum(part.astype(object) << (32 * k) for k, part in enumerate(parts))


def gram(y: np.ndarray) -> np.ndarray:
    """y' y of integers, exact: blocks whose products and sums a double holds, and digits of 21 bits where numbers are large."""
    most = int(np.abs(y).max(initial=0))
    dim = y.shape[1]
    if most < 2**21:
        step = max(1, 2**52 // max(1, most * most))
        total = np.zeros((dim, dim), np.int64)
        for at in range(0, len(y), step):
            part = y[at : at + step].astype(np.float64)
            total += (part.T @ part).astype(np.int64)
        return total
    digits, rest = [], y
    while rest.dtype == object or np.any(rest):
        if rest.dtype == object and not any(rest.flat):
            break
        low = rest & (2**21 - 1)
        # The digit nearest to zero ends the series for negative numbers too.
        low = np.where(low >= 2**20, low - 2**21, low)
        rest = (rest - low) >> 21
        digits.append(low.astype(np.float64))
    total = np.zeros((dim, dim), object)
    step = 2**10
    for at in range(0, len(y), step):
        for i, a in enumerate(digits):
            for j, b in enumerate(digits):
                total += (a[at : at + step].T @ b[at : at + step]).astype(np.int64).astype(object) << (21 * (i + j))
    return total


def _blob(values: np.ndarray) -> tuple[int, bytes]:
    parts = limbs(values)
    return len(parts), parts.astype("<i8").tobytes()


_PARTS = "dim int, at int, salt int, n long, k int, body binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["dim", "at", "salt", "n", "k", "body"])


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, fixed-point vectors) of the batch's rows, length by length."""
    column = batch.column("x")
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy()
    for dim in np.unique(sizes[sizes > 0]):
        places = np.flatnonzero(sizes == dim)
        start = column.offsets.to_numpy()[places]
        yield places, flat[start[:, None] + np.arange(dim)]


def _salt() -> int:
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() if TaskContext.get() else 0) % _FIRST


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for batch in batches:
        for places, x in _by_length(batch):
            own = found.setdefault(x.shape[1], [0, np.zeros((3, x.shape[1]), np.int64)])
            own[0] += len(places)
            own[1][:2] += np.stack([x & _MASK, x >> 32]).sum(axis=1)
    if found:
        yield _batch([(dim, 0, _salt(), n, 3, total.astype("<i8").tobytes()) for dim, (n, total) in found.items()])


def _centred(x: np.ndarray, centre: list[int]) -> np.ndarray:
    if max(int(np.abs(x).max(initial=0)), *(abs(c) for c in centre)) < 2**61:
        return x - np.array(centre, np.int64)
    return x.astype(object) - np.array(centre, object)


def _grams(batches: Iterator[pa.RecordBatch], centres: dict[int, list[int]]) -> Iterator[pa.RecordBatch]:
    """Sums of products of this task's vectors, less the integer next to their mean, in rows of a matrix."""
    found: dict[int, list] = {}
    for batch in batches:
        for places, x in _by_length(batch):
            y = _centred(x, centres[x.shape[1]])
            own = found.setdefault(x.shape[1], [0, np.zeros((x.shape[1],) * 2, np.int64)])
            product = gram(y)
            if own[1].dtype != object and (product.dtype == object or int(np.abs(own[1]).max()) + int(np.abs(product).max()) >= 2**62):
                own[1] = own[1].astype(object)
            own[0], own[1] = own[0] + len(places), own[1] + product
    for dim, (n, total) in found.items():
        for at in range(0, dim, _ROWS):
            yield _batch([(dim, at, _salt(), n, *_blob(total[at : at + _ROWS]))])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that arrive ordered by (dim, at, salt), added up as they come: one matrix at a time is held."""
    now, n, total = None, 0, None

    def row() -> pa.RecordBatch:
        parts = limbs(whole(total))
        return _batch([(*now, n, len(parts), parts.astype("<i8").tobytes())])

    for batch in batches:
        for dim, at, salt, m, k, body in zip(*(c.to_pylist() for c in batch.columns)):
            own = np.frombuffer(body, "<i8").astype(np.int64).reshape(k, -1)
            if (dim, at, salt) != now:
                if now is not None:
                    yield row()
                now, n, total = (dim, at, salt), 0, np.zeros_like(own)
            if len(total) < k:
                total = np.concatenate([total, np.zeros((k - len(total), own.shape[1]), np.int64)])
            n += m
            total[:k] += own
    if now is not None:
        yield row()


def _reduced(parts: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """(rows, exact sums) of every length: tasks' sums are added in ``_FIRST`` groups for each piece, and then these.

    What comes to the driver is one matrix of dim * dim numbers, whatever the number of rows.
    """
    for salt in ("salt", F.lit(0).alias("salt")):
        parts = parts.select("dim", "at", salt, "n", "k", "body").repartition("dim", "at", "salt").sortWithinPartitions("dim", "at", "salt")
        parts = parts.mapInArrow(_added, _PARTS)
    out: dict[int, tuple[int, list]] = {}
    for r in sorted(parts.collect(), key=lambda r: (r["dim"], r["at"])):
        n, values = out.setdefault(r["dim"], (r["n"], []))
        values.append(whole(np.frombuffer(r["body"], "<i8").astype(np.int64).reshape(r["k"], -1)))
    return {dim: (n, np.concatenate(values)) for dim, (n, values) in out.items()}


# Eigenvectors: products of matrices in about twice the double precision, from exact products of slices.


def _slices(a: np.ndarray, axis: int, bits: int, count: int = 6) -> list[np.ndarray]:
    """Addends of ``a`` of at most so many bits below the largest entry of each line along ``axis``."""
    out = []
    while len(out) < count and a.any():
        top = np.abs(a).max(axis=axis, keepdims=True)
        sigma = np.where(top > 0, np.exp2(np.ceil(np.log2(np.where(top > 0, top, 1.0))) + 53 - bits), 0.0)
        part = (a + sigma) - sigma
        out.append(part)
        a = a - part
    return out


def _two_sum(hi: np.ndarray, lo: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = hi + x
    t = s - hi
    return s, lo + ((hi - (s - t)) + (x - t))


def accurate_product(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(value, remainder) of sum(a) @ sum(b). Products of slices are exact in double precision, and so are added up with their errors."""
    inner = a[0].shape[1]
    bits = (53 - math.ceil(math.log2(max(2, inner)))) // 2
    hi, lo = np.zeros((a[0].shape[0], b[0].shape[1])), np.zeros((a[0].shape[0], b[0].shape[1]))
    left = [(np.abs(s).max(), s) for x in a for s in _slices(x, 1, bits)]
    right = [(np.abs(s).max(), s) for x in b for s in _slices(x, 0, bits)]
    least = max((m for m, _ in left), default=0.0) * max((m for m, _ in right), default=0.0) * 2.0**-108
    for m, x in left:
        for k, y in right:
            if m * k > least:
                hi, lo = _two_sum(hi, lo, x @ y)
    return _two_sum(hi, np.zeros_like(lo), lo)


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Runs of falling eigenvalues that follow each other within ``gap``, of two or more."""
    order = np.argsort(-values, kind="stable")
    ends = np.flatnonzero(np.abs(np.diff(values[order])) > gap) + 1
    return [run for run in np.split(order, ends) if len(run) > 1]


def _steps(a: list[np.ndarray], x: np.ndarray, size: float, steps: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, eigenvectors, gap): eigenvalues nearer than the gap are not told apart."""
    last = math.inf
    for _ in range(steps):
        ax = accurate_product(a, [x])
        (s, s_low), (g, g_low) = accurate_product([x.T], list(ax)), accurate_product([x.T], [x])
        r = (np.eye(x.shape[1]) - g) - g_low
        values = (np.diag(s) + np.diag(s_low)) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s)) + (s_low - np.diag(np.diag(s_low)))
        gap = 2 * (np.linalg.norm(off, 2) + size * np.linalg.norm(r, 2))
        apart = values[None, :] - values[:, None]
        near = np.abs(apart) <= gap
        e = np.where(near, r / 2, (off + values[None, :] * r) / np.where(near, 1.0, apart))
        change = np.abs(e).max()
        x = x + x @ e
        if change < 2.0**-53 or change > last / 2 and change < 2.0**-46:
            break
        last = change
    return values, x, gap


def refine(a: list[np.ndarray], x: np.ndarray, steps: int = 12, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) of the symmetric sum of ``a`` from approximate eigenvectors ``x``.

    Each step takes R = I - X'X and S = X'AX in higher precision, and adds X E, where E brings X nearer both to being orthogonal
    and to diagonalising A: the error is squared. Within a cluster, eigenvalues closer than the error, E only makes X
    orthogonal. The vectors of a cluster span the right space by then; a problem of the cluster's size, less the
    cluster's value and so with differences at full scale, is solved in single precision and refined in turn. Steps
    over all vectors follow, which now tell the cluster's values apart.
    """
    size = np.linalg.norm(sum(a), 2) if x.size else 0.0
    if not size:
        return np.zeros(x.shape[1]), x
    values, x, gap = _steps(a, x, size, steps)
    clusters = _clusters(values, max(gap, size * 2.0**-30)) if depth < 4 else []
    for run in clusters:
        own = x[:, run]
        shifted = [*a, -float(np.mean(values[run])) * np.eye(len(x))]
        inner = accurate_product([own.T], list(accurate_product(shifted, [own])))
        inner = [(m + m.T) / 2 for m in inner]
        scale = np.abs(inner[0]).max()
        if scale > size * 2.0**-90:
            start = np.linalg.eigh((inner[0] / scale).astype(np.float32))[1].astype(np.float64)
            x[:, run] = own @ refine([m / scale for m in inner], start, steps, depth + 1)[1]
    if clusters:
        values, x, _ = _steps(a, x, size, steps)
    return values, x


def eigen(n: int, sums: np.ndarray, products: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(trace, falling eigenvalues, eigenvectors in columns) of the covariance, divisor n, of integers y.

    ``sums`` and ``products`` are the exact sums of y and y y'. The covariance is the double next to its exact value and
    the double next to the rest.
    """
    dim = len(sums)
    exact = n * products.reshape(dim, dim) - np.multiply.outer(sums, sums)
    high = np.array([v / (n * n) for v in exact.flat], np.float64).reshape(dim, dim)
    low = np.array([float(Fraction(v, n * n) - Fraction(h)) for v, h in zip(exact.flat, high.flat)], np.float64).reshape(dim, dim)
    trace = float(Fraction(int(np.trace(exact)), n * n))
    size = np.abs(high).max()
    scaled = high / (2.0 ** math.frexp(size)[1]) if size else high
    start = np.linalg.eigh(scaled.astype(np.float32))[1].astype(np.float64)
    values, vectors = refine([high, low], start)
    order = np.argsort(-values, kind="stable")
    return trace, values[order], vectors[:, order]


def _project(batches: Iterator[pa.RecordBatch], models: dict[int, dict]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        deviation: list[int | None] = [None] * batch.num_rows
        whitened: list[np.ndarray | None] = [None] * batch.num_rows
        for places, x in _by_length(batch):
            m = models[x.shape[1]]
            values = (_centred(x, m["centre"]).astype(np.float64) - m["rest"]) @ m["axes"]
            spread = _deviations(x, m["n"], m["sums"])
            for i, place in enumerate(places):
                deviation[place], whitened[place] = spread[i], values[i]
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("dim"), pa.array(deviation, pa.int64()), pa.array(whitened, pa.list_(pa.float64()))],
            names=["key", "dim", "deviation", "w"],
        )


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n x - S)^2 of every row, exact; None where no long holds it."""
    about = ((n * x.astype(np.float64) - np.array(sums, np.float64)) ** 2).sum(axis=1)
    most = max(n * int(np.abs(x).max(initial=0)), *(abs(s) for s in sums))
    if most < 2**61 and about.max(initial=0) < 2.0**62:
        return (((n * x - np.array(sums, np.int64))) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) if a < 2.0**64 else 2**64 for row, a in zip(x, about)]
    return [v if v < 2**63 else None for v in exact]


def fixed_point(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(key, dim, x): usable vectors, each entry c as the long floor(1024 c) + 100000."""
    v = F.col(embedding).cast("array<double>")
    usable = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c * F.lit(float(SCALE))) < F.lit(_LARGEST)), F.lit(False)))
    kept = vectors.select(F.col(key).alias("key"), v.alias("v")).filter(F.coalesce(usable, F.lit(False)) & (F.size("v") > 0))
    return kept.select("key", F.size("v").alias("dim"), F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE))).cast("long") + F.lit(SHIFT)).alias("x"))


def whiten(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector and component: key, component, n, deviation, whitened, explained, identity_error.

    Vectors that are NULL or hold NULL, non-finite or unrepresentable entries (2^62 / 1024 and more) are left out, and so are
    empty ones. Vectors of unlike length are fitted apart: n, components and identity_error are those of a vector's length. Sums and
    covariance are exact integers, added up by tasks over all rows; only dim * dim numbers reach the driver. A component without
    variance (fewer rows than dimensions, like rows, constant entries) has whitened NULL and explained 0 and stays out of
    identity_error, which is NULL if none is left. ``deviation`` is NULL where a long cannot hold it. Repeated rows and NULL keys are
    rows of their own; an empty table gives no rows.
    """
    rows = fixed_point(vectors, key, embedding)
    summed = _reduced(rows.select("x").mapInArrow(_sums, _PARTS))
    sums = {dim: (n, [int(v) for v in s]) for dim, (n, s) in summed.items()}
    # The integer next to the mean: what is left of the mean after centring, at most a half, comes off exactly in eigen().
    centres = {dim: [(2 * s + n) // (2 * n) for s in own] for dim, (n, own) in sums.items()}
    products = _reduced(rows.select("x").mapInArrow(lambda b: _grams(b, centres), _PARTS))
    models, shares = {}, []
    for dim, (n, own) in sums.items():
        rest = np.array([s - n * c for s, c in zip(own, centres[dim])], object)
        trace, values, axes = eigen(n, rest, products[dim][1])
        k = min(components, dim)
        live = values[:k] > max(values[0], 0.0) * dim * _ZERO
        scaled = axes[:, :k] / np.sqrt(np.where(live, values[:k], 1.0))
        models[dim] = {"n": n, "sums": own, "centre": centres[dim], "rest": np.array([float(Fraction(int(r), n)) for r in rest]), "axes": scaled}
        shares += [(dim, i + 1, n, bool(live[i]), float(values[i] / trace) if live[i] else 0.0) for i in range(k)]
    spark = vectors.sparkSession
    shown = rows.select("key", "dim", "x").mapInArrow(lambda b: _project(b, models), _schema(rows))
    shown = stage(shown, "whitened")
    # At most ``components`` rows for each length of a vector, for which the driver holds a model already: broadcast, or
    # all vectors of a length would meet in one task.
    component = spark.createDataFrame(shares, "dim int, component int, n long, live boolean, explained double")
    of_length = component.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("component", "n", "live", "explained"))).alias("of"))
    wide = shown.join(F.broadcast(of_length), "dim")
    live = lambda i: F.get("of", F.lit(i))["live"]
    entry = lambda i: F.when(live(i), F.get("w", F.lit(i)))
    errors = [
        F.abs(F.covar_pop(entry(i), entry(j)) - F.lit(float(i == j))) for i in range(components) for j in range(i, components)
    ]
    greatest = F.array_max(F.array(*errors)) if errors else F.lit(None).cast("double")
    identity = wide.groupBy("dim").agg(greatest.alias("identity_error"))
    measured = identity.join(F.broadcast(of_length), "dim")
    long = shown.join(F.broadcast(measured), "dim").select("key", "deviation", "w", "identity_error", F.explode("of").alias("c"))
    return long.select(
        F.col("key").alias(key),
        F.col("c.component").alias("component"),
        F.col("c.n").alias("n"),
        "deviation",
        F.when(F.col("c.live"), F.get("w", F.col("c.component") - 1)).alias("whitened"),
        F.col("c.explained").alias("explained"),
        "identity_error",
    )


def _schema(rows: DataFrame) -> str:
    return f"key {dict(rows.dtypes)['key']}, dim int, deviation long, w array<double>"
