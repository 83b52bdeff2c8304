"""Merkle manifest of a table: blocks of aligned subtrees in van Emde Boas order, and recursion over the roots of blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage

#: Children of a node.
FAN = 16
#: Levels of a block above its leaves: a block is an aligned subtree of FAN ** HEIGHT leaves, and one row of a table.
HEIGHT = 3
BLOCK = FAN**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEPS = "array<struct<pos:int,siblings:binary>>"


def node_count(leaves, levels: int):
    """Nodes of ``levels`` levels over so many leaves, the leaves included."""
    return sum(-(-leaves // FAN**i) for i in range(levels))


def address(level: int, index: np.ndarray, leaves, levels: int) -> np.ndarray:
    """Where nodes ``index`` of a level (0: leaves) stand in the van Emde Boas order of a tree with so many leaves and levels.

    The tree is cut at half its levels: first the upper half, then the subtrees below one after the other, each in the same
    order again. All subtrees but the last are complete, so places follow from counts alone, without pointers
    and without knowing how large a page or a cache line is.
    """
    index, start = np.asarray(index, np.int64), np.int64(0)
    while levels > 1:
        bottom = levels // 2
        top, upper = levels - bottom, -(-leaves // FAN**bottom)
        if level >= bottom:
            level, leaves, levels = level - bottom, upper, top
        else:
            own, width = FAN ** (bottom - 1), FAN ** (bottom - 1 - level)
            tree = index // width
            start = start + node_count(upper, top) + tree * node_count(own, bottom)
            leaves, index, levels = np.minimum(own, leaves - tree * own), index - tree * width, bottom
    return start + index


def height_of(leaves: int) -> int:
    """Levels above the leaves until one node remains."""
    height = 0
    while FAN**height < leaves:
        height += 1
    return height


def build_block(digests: np.ndarray, height: int) -> np.ndarray:
    """All nodes (rows of 32 bytes) over the given leaves, ``height`` levels up, in van Emde Boas order."""
    m, levels = len(digests), height + 1
    body = np.zeros((node_count(m, levels), 32), np.uint8)
    body[address(0, np.arange(m), m, levels)] = digests
    for level in range(1, levels):
        n = -(-m // FAN**level)
        below = level_of(body, level - 1, m, height).tobytes().hex().encode()
        parents = b"".join(hashlib.sha256(below[i * 64 * FAN : (i + 1) * 64 * FAN]).digest() for i in range(n))
        body[address(level, np.arange(n), m, levels)] = np.frombuffer(parents, np.uint8).reshape(n, 32)
    return body


def level_of(body: np.ndarray, level: int, leaves: int, height: int) -> np.ndarray:
    return body[address(level, np.arange(-(-leaves // FAN**level)), leaves, height + 1)]


def siblings(body: np.ndarray, level: int, index: int, leaves: int, height: int) -> tuple[int, bytes]:
    """(place in its run, digests of the run's other nodes) of one node, read from their addresses."""
    first = index // FAN * FAN
    last = min(first + FAN, -(-leaves // FAN**level))
    others = [i for i in range(first, last) if i != index]
    return index - first, body[address(level, np.array(others, np.int64), leaves, height + 1)].tobytes()


def block_steps(body: np.ndarray, leaves: int, height: int) -> list[list[tuple[int, bytes]]]:
    """Per level of a block below its root, of every node: its place in its run and the run's other digests."""
    out = []
    for level in range(height):
        rows = level_of(body, level, leaves, height).tobytes()
        n, steps = len(rows) // 32, []
        for first in range(0, n, FAN):
            run = rows[32 * first : 32 * min(first + FAN, n)]
            steps += [(p, run[: 32 * p] + run[32 * (p + 1) :]) for p in range(len(run) // 32)]
        out.append(steps)
    return out


def fold(leaf: str, steps: Sequence[tuple[int, str]]) -> str:
    """The root that a leaf and its siblings (all in hexadecimal) lead to."""
    for pos, others in steps:
        leaf = hashlib.sha256((others[: 64 * pos] + leaf + others[64 * pos :]).encode()).hexdigest()
    return leaf


# Leaves and their places.


def leaf_digest(fields: Sequence[Column]) -> Column:
    """sha256 over the fields, each ``-`` if NULL, else its bytes' number, a colon and its value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def folded_case(fields: Sequence[str], text: str = "text") -> list[Column]:
    """The fields, A-Z of the text in lower case."""
    return [F.translate(F.col(f), _UPPER, _LOWER) if f == text else F.col(f) for f in fields]


def group_key(source: Column) -> Column:
    """A string that is never NULL and orders groups as asked: NULL first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("1"), source), F.lit("0"))


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with idx, their rank from 0 in their group (column grp) by ``order``, and total, the group's size.

    Rows are cut into ranges of (grp, order) and written in order, so a large group is spread over many tasks. A range that
    holds a part of a group starts where the group's earlier ranges end.
    """
    cut = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    cut = stage(cut.withColumn("_at", F.monotonically_increasing_id()), "merkle-ranges")
    cut = cut.withColumn("_range", F.shiftright("_at", 33))
    parts = cut.groupBy("grp", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("grp")
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        "grp", "_range",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(group).alias("total"),
    )
    placed = cut.join(starts, ["grp", "_range"])
    return placed.withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


# Blocks.


def _block_rows(batches: Iterator[pa.RecordBatch], payload: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """One row per block from nodes ordered by (grp, idx). A block's rows are all that is held beside one batch."""

    def made(rows: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        digests = np.frombuffer(b"".join(rows.column("digest").to_pylist()), np.uint8).reshape(-1, 32)
        totals, bodies, roots = rows.column("total").to_numpy(), [], []
        for i, j in zip(cuts[:-1], cuts[1:]):
            body = build_block(digests[i:j], min(HEIGHT, height_of(int(totals[i]))))
            bodies.append(body.tobytes())
            roots.append(body[0].tobytes())
        first = pa.array(cuts[:-1])
        columns = [rows.column(c).combine_chunks().take(first) for c in ("grp", "block", "total")]
        columns += [pa.array(np.diff(cuts)), pa.array(roots, pa.binary()), pa.array(bodies, pa.binary())]
        for c in payload:
            columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rows.column(c).combine_chunks()))
        return pa.RecordBatch.from_arrays(columns, names=["grp", "block", "total", "n", "root", "body", *payload])

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        grp, block = rows.column("grp").to_numpy(), rows.column("block").to_numpy()
        new = np.flatnonzero((grp[1:] != grp[:-1]) | (block[1:] != block[:-1])) + 1
        if len(new):
            yield made(rows.slice(0, new[-1]), np.concatenate([[0], new]))
        held = rows.slice(new[-1]) if len(new) else rows
    if held is not None:
        yield made(held, np.array([0, held.num_rows]))


def blocks(nodes: DataFrame, payload: Sequence[str] = ()) -> DataFrame:
    """(grp, block, total, n, root, body, payload arrays) of nodes (grp, idx, total, digest, payload).

    ``body`` holds the nodes of the block in van Emde Boas order, 32 bytes each, the root first.
    """
    numbered = nodes.select("grp", "total", "digest", *payload, "idx", F.floor(F.col("idx") / BLOCK).cast("long").alias("block"))
    types = dict(nodes.dtypes)
    schema = "grp string, block long, total long, n long, root binary, body binary" + "".join(f", {c} array<{types[c]}>" for c in payload)
    dealt = numbered.repartition("grp", "block").sortWithinPartitions("grp", "idx")
    return dealt.mapInArrow(lambda batches: _block_rows(batches, payload), schema)


@dataclass(frozen=True)
class Forest:
    """Trees of all groups: ``tiers[0]`` has the blocks over the leaves, ``tiers[t]`` those over the roots of ``tiers[t - 1]``."""

    tiers: list[DataFrame]

    @property
    def roots(self) -> DataFrame:
        """(grp, tier, digest): one row per group."""
        out = None
        for t, tier in enumerate(self.tiers):
            own = tier.filter(F.col("total") <= BLOCK).select("grp", F.lit(t).alias("tier"), F.col("root").alias("digest"))
            out = own if out is None else out.unionByName(own)
        return out


def forest(nodes: DataFrame, payload: Sequence[str] = ()) -> Forest:
    """Blocks over nodes (grp, idx, total, digest), then over their roots, until each group has one root."""
    tiers = [stage(blocks(nodes, payload), "merkle-blocks")]
    # The largest group decides the number of tiers: the logarithm of its size to the base of 4096.
    most = tiers[0].agg(F.max("total").alias("most")).first()["most"] or 0
    while most > BLOCK:
        most = -(-most // BLOCK)
        below = tiers[-1].filter(F.col("total") > BLOCK)
        upper = below.select(
            "grp", F.col("block").alias("idx"), F.ceil(F.col("total") / BLOCK).cast("long").alias("total"), F.col("root").alias("digest")
        )
        tiers.append(stage(blocks(upper), "merkle-blocks"))
    return Forest(tiers)


# Proofs, from the root down.


def _steps_of(row_steps: list[dict]) -> list[tuple[int, bytes]]:
    return [(s["pos"], s["siblings"]) for s in row_steps]


def _open_block(body: bytes, n: int, total: int) -> tuple[np.ndarray, list[list[tuple[int, bytes]]]]:
    height = min(HEIGHT, height_of(total))
    nodes = np.frombuffer(body, np.uint8).reshape(-1, 32)
    return level_of(nodes, 0, n, height), block_steps(nodes, n, height)


def _node_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each node under a block: the steps to the group's root and on."""
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("siblings", pa.binary())]))
    for batch in batches:
        for row in batch.to_pylist():
            _, inner = _open_block(row["body"], row["n"], row["total"])
            above = _steps_of(row["steps"])
            steps = [[*(level[i // FAN**k] for k, level in enumerate(inner)), *above] for i in range(row["n"])]
            idx = row["block"] * BLOCK + np.arange(row["n"], dtype=np.int64)
            for at in range(0, row["n"], 512):
                part = [[{"pos": p, "siblings": s} for p, s in x] for x in steps[at : at + 512]]
                size = len(part)
                columns = [pa.array([row["grp"]] * size, pa.string()), pa.array(idx[at : at + 512])]
                columns += [pa.array([row["subroot"]] * size, pa.binary()), pa.array(part, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=["grp", "idx", "subroot", "steps"])


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each leaf: digest of its siblings up to the root, and the root that the leaf as it is now leads to."""
    for batch in batches:
        for row in batch.to_pylist():
            leaves, inner = _open_block(row["body"], row["n"], row["total"])
            leaves = [x.tobytes().hex() for x in leaves]
            inner = [[(p, s.hex()) for p, s in level] for level in inner]
            above = [(p, s.hex()) for p, s in _steps_of(row["steps"])]
            tail = "".join(s for _, s in above)
            proof, folded = [], []
            for i, (leaf, changed) in enumerate(zip(leaves, row["changed"])):
                own = [level[i // FAN**k] for k, level in enumerate(inner)]
                proof.append(hashlib.sha256(("".join(s for _, s in own) + tail).encode()).hexdigest())
                folded.append(fold(leaf if changed is None else changed.hex(), [*own, *above]))
            n = row["n"]
            columns = [pa.array(row["id"], pa.int64()), pa.array(leaves), pa.array([row["subroot"].hex()] * n), pa.array(proof), pa.array(folded)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "leaf", "subroot", "proof_sha256", "folded_root"])


def _above(trees: Forest, tier: int, root_steps: DataFrame, inner: DataFrame | None) -> DataFrame:
    """(grp, block, subroot, steps): what lies above the blocks of a tier."""
    ends = root_steps.filter(F.col("tier") == tier).select("grp", F.lit(0).cast("long").alias("block"), "subroot", "steps")
    if inner is None:
        return ends
    return ends.unionByName(inner.select("grp", F.col("idx").alias("block"), "subroot", "steps"))


def _descend(trees: Forest, root_steps: DataFrame) -> DataFrame:
    """Blocks over the leaves, each with the group's root (subroot) and the steps above the block.

    ``root_steps``: (grp, tier, subroot, steps) of every group's root.
    """
    inner = None
    for t in range(len(trees.tiers) - 1, 0, -1):
        here = trees.tiers[t].join(_above(trees, t, root_steps, inner), ["grp", "block"])
        here = here.select("grp", "block", "total", "n", "body", "subroot", "steps")
        inner = stage(here.mapInArrow(_node_steps, f"grp string, idx long, subroot binary, steps {_STEPS}"), "merkle-steps")
    return trees.tiers[0].join(_above(trees, 0, root_steps, inner), ["grp", "block"])


@dataclass(frozen=True)
class Manifest:
    """``groups``: trees over the rows of each group; ``top``: the tree over the groups' roots; ``root``: one row (root)."""

    groups: Forest
    top: Forest
    root: DataFrame


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "source", changed: Column | None = None, now: Sequence[Column] = ()
) -> Manifest:
    """The trees over ``docs``: rows ascend by ``key`` in their ``group``, groups by name, NULL first in both.

    Every row is a leaf, rows that repeat a key too: these are ordered by their digest, and like rows are interchangeable. Each
    node is over 16 neighbours. Where ``changed`` holds, the digest of the fields ``now`` is kept beside the leaf
    for ``prove``. Texts are read once and never shuffled: a leaf is its key and 32 bytes, two digests where it is changed. An
    empty table has no root. Any NULL is a value of its own; other columns do not matter.
    """
    first = leaf_digest([F.col(f) for f in fields])
    second = F.when(changed, leaf_digest(now)) if changed is not None else F.lit(None).cast("binary")
    leaves = docs.select(
        group_key(F.col(group).cast("string")).alias("grp"), F.col(key).cast("long").alias("id"), first.alias("digest"), second.alias("changed")
    )
    # The last order column tells like rows apart, so that a range can end between them.
    leaves = stage(leaves.withColumn("_tie", F.monotonically_increasing_id()), "merkle-leaves")
    groups = forest(ranked(leaves, ["id", "digest", "_tie"]), ["id", "changed"])
    subroots = groups.roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
    top = forest(ranked(subroots, ["name"]), ["name"])
    return Manifest(groups, top, top.roots.select(F.lower(F.hex("digest")).alias("root")))


def prove(made: Manifest) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, the changed ones folded from what they are now."""
    top_roots = made.top.roots.select("grp", "tier", F.col("digest").alias("subroot"), F.array().cast(_STEPS).alias("steps"))
    above = _descend(made.top, top_roots).select("grp", "block", "total", "n", "body", "subroot", "steps")
    steps = above.mapInArrow(_node_steps, f"grp string, idx long, subroot binary, steps {_STEPS}")
    # The top tree's leaves by their places: block and place in the block.
    names = made.top.tiers[0].select("block", F.posexplode("name").alias("at", "name"))
    names = names.select((F.col("block") * BLOCK + F.col("at")).alias("idx"), "name")
    of_group = names.join(steps.select("idx", "steps"), "idx").select(F.col("name").alias("grp"), "steps")
    root_steps = stage(
        made.groups.roots.join(of_group, "grp").select("grp", "tier", F.col("digest").alias("subroot"), "steps"), "merkle-roots"
    )
    rows = _descend(made.groups, root_steps).select("total", "n", "body", "id", "changed", "subroot", "steps")
    found = rows.mapInArrow(_proofs, "id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    found = found.withColumn("root", made.root.select("root").scalar())
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
