"""Mixing sources to target weights by pivotal dependent rounding of fractional copy numbers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage

#: Documents of one source are dealt into blocks of about this many for the first rounding.
BLOCK_ROWS = 4_000
#: Left-over fractions that one task of the reduction tree combines.
FAN_IN = 1_000
#: Like rows that one row stands for, at most, until they are numbered.
RUN = 4_096


def source_targets(
    sized: DataFrame, weights: Sequence[float], share: float, most: float, source: str = "source", size: str = "size"
) -> DataFrame:
    """One row per source: n_docs, source_size, weight, target.

    Sources in code-point order, NULL last, take ``weights`` in turn and share ``share`` times all sizes by them. A
    target stops at ``most`` times its source's size and the excess goes to the others by weight: with sources in order
    of size per weight, the level is what is left over the weight that is left. Only one row per source is ordered.
    """
    every = sized.groupBy(F.col(source).alias("_source")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(size).alias("source_size")
    )
    place = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    rows = every.withColumn("weight", weight).withColumn("_cap", cap).withColumn("_fill", F.col("_cap") / F.col("weight"))
    order = Window.orderBy("_fill", F.col("_source").asc_nulls_last())
    all_rows = Window.partitionBy(F.lit(1))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    )
    rows = rows.withColumn("_level", level).withColumn("_open", F.col("_level") < F.col("_fill"))
    first_open = F.min(F.when(F.col("_open"), F.struct("_fill", F.col("_source").isNull(), "_source", "_level"))).over(all_rows)
    target = F.when(first_open.isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("weight") * first_open["_level"]))
    return rows.withColumn("target", target).select("_source", "n_docs", "source_size", "weight", "target")


def pivotal(p: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Round fractions in order. Two at a time meet; one becomes 0 or 1, the other carries the rest of their mass.

    Returns the rounded fractions and the place of the one that is still fractional, or -1.
    """
    out = p.copy()
    held = -1
    for i in range(len(out)):
        if not 1e-12 < out[i] < 1 - 1e-12:
            out[i] = round(out[i])
            continue
        if held < 0:
            held = i
            continue
        a, b, u = out[held], out[i], draws[i]
        total = a + b
        if total < 1:
            stays, other = (held, i) if u * total < a else (i, held)
            out[other], out[stays] = 0.0, total
        else:
            goes, stays = (held, i) if u * (2 - total) < 1 - b else (i, held)
            out[goes], out[stays] = 1.0, total - 1
        held = stays
        if not 1e-12 < out[held] < 1 - 1e-12:
            out[held] = round(out[held])
            held = -1
    return out, held


def _round_block(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values(["size", "_draw"], ascending=False, kind="stable")
    fraction, held = pivotal(block["_fraction"].to_numpy(float), block["_draw"].to_numpy(float))
    block["_fraction"] = fraction
    block["_open"] = False
    if held >= 0:
        block.iloc[held, block.columns.get_loc("_open")] = True
    return block


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 8,
    source: str = "source",
    size: str = "size",
    key: str = "doc_id",
) -> DataFrame:
    """One row per document: ``key``, size, source_size, target, copies, taken (size times copies).

    ``docs`` holds key, source and a size that is not negative. Within a source each document is due
    target / source_size copies. Whole copies are given, fractions rounded by the pivotal method: documents are dealt
    into blocks by hash, each block rounds its documents from the longest down (so that mass moves between
    documents of like size, and ends in a short one), and the one fraction that a block leaves goes up a tree whose tasks take ``FAN_IN`` of
    them, until a source has one. That one is rounded by its own draw. So no task holds a whole source, a
    source's number of copies is right to one document, and reruns agree: draws are hashes of key, source, size and
    a number that tells like rows apart, which are interchangeable. NULL sources form one source; repeated rows are documents of their own; an empty table gives no rows; a source of
    size 0 has target 0 and its documents no copies.
    """
    spark = docs.sparkSession
    like = docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.col(size).cast("long").alias("size"))
    like = like.groupBy("_key", "_source", "size").agg(F.count(F.lit(1)).alias("_n"))
    # Like rows are counted and numbered, so that each has a draw and a block of its own; long runs are written out piece by piece.
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / F.lit(RUN)))).alias("_run")
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(RUN), F.col("_n") - F.col("_run") * RUN) - 1)).alias("_step")
    numbered = like.select("*", run).select("_key", "_source", "size", "_run", step)
    sized = stage(numbered.select("_key", "_source", "size", (F.col("_run") * RUN + F.col("_step")).alias("_number")), "mix-sizes")
    targets = stage(source_targets(sized, weights, share, most, "_source"), "mix-targets")
    same = sized["_source"].eqNullSafe(targets["_source"])
    due = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    joined = sized.join(targets, same).select(
        "_key", sized["_source"], "size", "_number", "source_size", "target", "n_docs", due.alias("_due")
    )
    hashed = F.xxhash64(F.lit(seed), "_key", "_source", "size", "_number")
    start = joined.select(
        "*",
        F.floor("_due").alias("_whole"),
        (F.col("_due") - F.floor("_due")).alias("_fraction"),
        (F.pmod(F.xxhash64(F.lit(seed + 1), hashed), F.lit(1 << 52)) / F.lit(float(1 << 52))).alias("_draw"),
        F.pmod(hashed, F.ceil(F.col("n_docs") / BLOCK_ROWS)).alias("_block"),
        F.lit(True).alias("_open"),
    ).drop("n_docs", "_due", "_number")
    schema = start.schema
    done, level = [], 0
    blocks = targets.agg(F.max(F.ceil(F.col("n_docs") / BLOCK_ROWS))).first()[0] or 0
    current = start
    while True:
        rounded = stage(current.groupBy("_source", "_block").applyInPandas(_round_block, schema), f"mix-round-{level}")
        done.append(rounded.filter("not _open"))
        current = rounded.filter("_open").withColumn("_block", F.floor(F.col("_block") / FAN_IN).cast(schema["_block"].dataType))
        level += 1
        if blocks <= 1:
            break
        blocks = -(-blocks // FAN_IN)
    done.append(current.withColumn("_fraction", (F.col("_draw") < F.col("_fraction")).cast("double")))
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    copies = (F.col("_whole") + F.round("_fraction")).cast("long")
    return every.select(
        F.col("_key").alias(key),
        F.col("_source").alias(source),
        "size",
        "source_size",
        F.col("target").cast("double").alias("target"),
        copies.alias("copies"),
        (F.col("size") * copies).alias("taken"),
    )
