"""Shards by a hierarchical weighted hash tree: region, rack and shard are drawn level by level. Only DataFrame functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage
from .columns import held

#: Hexadecimal digits of a draw: 52 bits, which a double holds exactly.
DIGITS = 13
#: Rows of a shard that are numbered in one cell, about.
CELL_ROWS = 10_000
#: Equal rows that one row stands for, at most, until its slots are dealt out.
RUN = 4_096


@dataclass(frozen=True)
class Leaf:
    """A shard and the path to it. ``epoch`` 0 is the tree as first built; a shard that joins later has an epoch of its own."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0
    epoch: int = 0


Tree = tuple[Leaf, ...]


def base_tree(shards: int = 8, per_rack: int = 2, racks: int = 2) -> Tree:
    """``shards`` of weight 1, so many to a rack and so many racks to a region."""
    return tuple(Leaf(f"g{s // per_rack // racks}", f"k{s // per_rack}", s) for s in range(shards))


def grow(tree: Tree, leaf: Leaf) -> Tree:
    """The tree and one more shard, which takes rows from all the others and moves none between them."""
    epoch = max((x.epoch for x in tree), default=-1) + 1
    return (*tree, Leaf(leaf.region, leaf.rack, leaf.shard, leaf.weight, epoch))


def tree_for(shards: int, base: int = 8) -> Tree:
    """The tree of a number of shards: up to ``base`` as first built, the others joined one after the other."""
    tree = base_tree(min(shards, base))
    for s in range(base, shards):
        tree = grow(tree, Leaf(f"g{s // 4}", f"k{s // 2}", s))
    return tree


@dataclass(frozen=True)
class _Node:
    label: str
    weight: float
    leaf: Leaf
    children: tuple[_Node, ...]


def _nodes(leaves: Sequence[Leaf], level: int = 0, above: str = "") -> tuple[_Node, ...]:
    """Children of a node: the root's are regions, told apart by epoch too; then racks; then shards."""
    name = (lambda x: f"{x.epoch}/{x.region}", lambda x: x.rack, lambda x: str(x.shard))[level]
    groups: dict[str, list[Leaf]] = {}
    for leaf in leaves:
        if leaf.weight > 0:
            groups.setdefault(name(leaf), []).append(leaf)
    return tuple(
        _Node(f"{above}/{label}", sum(x.weight for x in own), own[0], _nodes(own, level + 1, f"{above}/{label}") if level < 2 else ())
        for label, own in sorted(groups.items())
    )


def levels(tree: Tree) -> list[list[list[tuple[int, str, float]]]]:
    """Per level and node of the level above (in order): its children as (number in their level, label, weight)."""
    shards = [x.shard for x in tree]
    if len(set(shards)) < len(shards):
        raise ValueError("a shard stands at two places")
    now, out = [_nodes(tree)], []
    if not now[0]:
        raise ValueError("a tree needs a shard of positive weight")
    for _ in range(3):
        start, numbered, below = 0, [], []
        for children in now:
            numbered.append([(start + i, x.label, x.weight) for i, x in enumerate(children)])
            below += [x.children for x in children]
            start += len(children)
        out.append(numbered)
        now = below
    return out


def leaves_in_order(tree: Tree) -> list[Leaf]:
    return [x.leaf for region in _nodes(tree) for rack in region.children for x in rack.children]


def key_text(key: Column) -> Column:
    """What draws see of a key; a NULL key is a key of its own."""
    return F.coalesce(key.cast("string"), F.lit("null"))


def _uniform(key: Column, label: Column) -> Column:
    digits = F.substring(F.md5(F.concat(key, label).cast("binary")), 1, DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**DIGITS))


def descend(key: Column, tree: Tree) -> Column:
    """The number of the shard in ``leaves_in_order``: at each level the child of least -ln(u) / weight.

    ``u`` hashes the key and the child's path. A child wins with its share of its siblings' weights. If a
    weight changes, draws of all other nodes stay, so rows move only to or from the subtrees that hold the change.
    """
    at = F.lit(0)
    for level in levels(tree):
        children = F.array(
            *(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(label).alias("label"), F.lit(float(w)).alias("w")) for i, label, w in own)) for own in level)
        )
        draws = F.transform(F.get(children, at), lambda c: F.struct((-F.log(_uniform(key, c["label"])) / c["w"]).alias("draw"), c["i"].alias("i")))
        at = F.array_min(draws)["i"]
    return at


def place(rows: DataFrame, tree: Tree, key: str = "doc_id", names: tuple[str, str, str] = ("region", "rack", "shard")) -> DataFrame:
    """``rows`` with the region, rack and shard of each; columns of these names are replaced.

    The key and the tree alone decide: equal keys share a shard, NULL keys are one key. No shuffle. An empty table gives no rows.
    """
    order = leaves_in_order(tree)
    # The key is one column of its own, or every draw inside the lambdas would format it again.
    found = rows.withColumn("_key", held(key_text(F.col(key))))
    found = found.withColumn("_at", held(descend(F.col("_key"), tree)))
    parts = [F.get(F.array(*(F.lit(v) for v in values)), F.col("_at")) for values in zip(*((x.region, x.rack, x.shard) for x in order))]
    return found.withColumns(dict(zip(names, parts))).drop("_key", "_at")


def movement(rows: DataFrame, old: Tree, new: Tree, key: str = "doc_id") -> DataFrame:
    """(from_shard, to_shard, n): how many rows a change of the tree moves, rows that stay included."""
    both = place(rows.select(key), old, key, ("_g", "_k", "from_shard"))
    both = place(both, new, key, ("_h", "_l", "to_shard"))
    return both.groupBy("from_shard", "to_shard").agg(F.count(F.lit(1)).alias("n"))


def slots(placed: DataFrame, columns: Sequence[str], shard: str = "shard") -> DataFrame:
    """``columns`` (the shard among them) and slot: 0, 1, 2, ... inside each shard, in the order of a hash of ``columns``.

    Rows alike in ``columns`` are added up before the shuffle and interchangeable; every ``RUN`` of them are one row with a
    hash of its own, so no key is hot. Each shard is cut by the hash into cells of about ``CELL_ROWS`` such rows, which
    are numbered inside the cell; a cell starts where those before it end. Hashes that agree are ordered by ``columns``.
    """
    counted = placed.select(*columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / F.lit(RUN)))).alias("_run")
    runs = counted.select(*columns, "_n", run)
    text = F.concat_ws(":", *(key_text(F.col(c)) for c in columns), F.col("_run").cast("string"))
    runs = runs.select(
        *columns,
        F.least(F.lit(RUN), F.col("_n") - F.col("_run") * RUN).alias("_n"),
        F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long").alias("_h"),
    )
    runs = stage(runs, "shard-runs")
    most = runs.groupBy(shard).count().agg(F.coalesce(F.max("count"), F.lit(1)).alias("most")).scalar()
    bits = F.greatest(F.lit(0), F.ceil(F.log2(most / F.lit(float(CELL_ROWS))))).cast("int")
    cells = runs.withColumn("_cell", F.floor(F.col("_h") / F.pow(F.lit(2.0), F.lit(4 * DIGITS) - bits)).cast("long"))
    sizes = cells.groupBy(shard, "_cell").agg(F.sum("_n").alias("_size"))
    before = Window.partitionBy(shard).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(shard).alias("_s"), F.col("_cell").alias("_c"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(shard, "_cell").orderBy("_h", *columns).rowsBetween(Window.unboundedPreceding, -1)
    numbered = cells.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    numbered = numbered.join(starts, (F.col(shard) == F.col("_s")) & (F.col("_cell") == F.col("_c")))
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_step")
    return numbered.select(*columns, (F.col("_start") + F.col("_before")).alias("_first"), step).select(
        *columns, (F.col("_first") + F.col("_step")).alias("slot")
    )


def write_shards(docs: DataFrame, tree: Tree, path: str, key: str = "doc_id") -> None:
    """``docs`` as Parquet under ``path``/region=/rack=/shard=; large shards are split over several tasks and files."""
    placed = place(docs, tree, key)
    placed.hint("rebalance", "region", "rack", "shard").write.partitionBy("region", "rack", "shard").parquet(path)
