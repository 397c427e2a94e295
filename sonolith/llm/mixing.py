"""Mixing sources to target weights by cube-method balanced sampling.

Every document is taken a whole number of times: the whole part of target / size of its source, and once
more with the fractional part as inclusion probability. The extra draws are balanced on document and
token totals: the flight phase moves the probabilities of three documents at a time along the one
direction that changes neither total, until one of them is 0 or 1. Blocks of a source fly on their own
(at most two documents stay undecided in each); what is left flies again, block after block, until a
source has one block, where a small landing problem picks the outcome nearest to the target.

Rows alike (one id, source and size) are first moved among themselves, which changes neither total: of n
such rows with probability p, floor(n * p) are taken, one keeps the rest as its probability and flies, the
others are left. So a block never holds more than one of them, however often a row repeats.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

#: Weights of the sources in order, repeating; share of all words that the mix has; most repeats.
WEIGHTS, VOLUME, MOST = (3, 1, 2), 1.5, 2
#: Documents that fly in one task; a memory bound.
BLOCK = 4096
_NEAR = 1e-9


def source_targets(sizes: DataFrame, weights=WEIGHTS, volume: float = VOLUME, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size) rows; sources in order of code points, null last.

    The sources share ``volume`` times all words by weight; none gets over ``most`` times its own words, and
    the excess is shared again. That is one water level: targets are min(most * size, level * weight), and
    the level follows from running sums in the order in which sources fill up. Only the table of sources,
    a row each after map-side sums, is ordered.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    in_order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    rows = by_source.withColumn("weight", weight).withColumn("full", F.col("source_size") * F.lit(float(most)))
    filling = Window.partitionBy(F.lit(0)).orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumns(
        {
            "total": F.sum("source_size").over(Window.partitionBy(F.lit(0))) * F.lit(float(volume)),
            "filled": F.coalesce(F.sum("full").over(before), F.lit(0.0)),
            "rest": F.sum("weight").over(after),
        }
    )
    # The level that holds if every source before this one is full and none from here on is.
    level = (F.col("total") - F.col("filled")) / F.col("rest")
    rows = rows.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("full"))
    first = F.min(F.when(F.col("open"), F.struct(F.col("full") / F.col("weight"), F.col("level").alias("level"))))
    rows = rows.withColumn("water", first.over(Window.partitionBy(F.lit(0)))["level"])
    target = F.when(F.col("water").isNull(), F.col("full")).otherwise(F.least("full", F.col("water") * F.col("weight")))
    return rows.select("source", "source_size", target.alias("target"))


def fly(chance: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase: moves probabilities, keeping their sum and the sum of chance * size, until at most
    two are left between 0 and 1."""
    p, x = [float(v) for v in chance], [float(v) for v in size]
    waiting = [i for i, v in enumerate(p) if _NEAR < v < 1 - _NEAR]
    draws = iter(rng.random(len(waiting) + 1).tolist())
    trio: list[int] = []
    waiting.reverse()
    while True:
        while len(trio) < 3 and waiting:
            trio.append(waiting.pop())
        if len(trio) < 3:
            break
        i, j, k = trio
        u = (x[k] - x[j], x[i] - x[k], x[j] - x[i])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for v, q in zip(u, (p[i], p[j], p[k]), strict=True):
            if v > 0:
                up, down = min(up, (1 - q) / v), min(down, q / v)
            elif v < 0:
                up, down = min(up, -q / v), min(down, (q - 1) / v)
        move = up if next(draws) < down / (up + down) else -down
        rest = []
        for v, m in zip(u, trio, strict=True):
            q = p[m] + move * v
            p[m] = 0.0 if q < _NEAR else 1.0 if q > 1 - _NEAR else q
            if 0 < p[m] < 1:
                rest.append(m)
        trio = rest
    return np.array([0.0 if v <= _NEAR else 1.0 if v >= 1 - _NEAR else v for v in p])


def land(chance: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decides the few that are left: the outcome whose words come nearest, then whose count does."""
    left = np.flatnonzero((chance > 0) & (chance < 1))
    done = chance.copy()
    if len(left):
        wanted = chance[left] @ size[left]
        choices = product((0.0, 1.0), repeat=len(left))
        done[left] = min(choices, key=lambda c: (abs(np.dot(c, size[left]) - wanted), abs(sum(c) - chance[left].sum()), c))
    return done


def _among_alike(rows: DataFrame) -> DataFrame:
    """Moves the chances of rows alike among themselves, until at most one of them is between 0 and 1."""
    alike = Window.partitionBy("no_id", "doc_id", "source", "size")
    # Row i of n gets what n * chance leaves after i - 1 whole ones.
    rest = F.count("*").over(alike) * F.col("chance") - (F.row_number().over(alike.orderBy("draw")) - 1)
    return rows.withColumn("chance", F.greatest(F.lit(0.0), F.least(F.lit(1.0), rest)))


def _flight(seed: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["draw", "doc_id", "no_id", "size"], kind="stable")
        key = np.random.SeedSequence([seed, int(block["blocks"].iloc[0]), int(block["draw"].iloc[0]) & (2**63 - 1)])
        chance = fly(block["chance"].to_numpy(), block["size"].to_numpy(float), np.random.default_rng(key))
        if block["blocks"].iloc[0] == 1:
            chance = land(chance, block["size"].to_numpy(float))
        return block.assign(chance=chance)

    return run


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, volume: float = VOLUME, most: int = MOST, seed: int = 17, block: int = BLOCK,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), a row for each row of ``docs``.

    ``size`` is the number of words (0 for null), ``copies`` how often the mix takes the document (0 to
    ``most``), ``taken`` = copies * size. Draws hang on a hash of doc_id, size and ``seed``: reruns agree
    whatever the partitioning; rows that repeat an id, source and size are alike, so either may be drawn. A null
    source is a source of its own, a null id a value like others. A source without words has target 0.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col).cast("string")).alias("size"),
    )
    rows = written(rows, "sizes")
    targets = written(source_targets(rows, weights, volume, most), "targets")
    counts = rows.groupBy("source").agg(F.count("*").alias("n"))
    ratio = F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0))
    stats = targets.join(counts, targets.source.eqNullSafe(counts.source)).select(
        targets.source.alias("s"), "source_size", "target", "n", ratio.alias("ratio")
    )
    # Some rows a source: the table is small against the rows, and the planner broadcasts it by its size.
    known = rows.join(stats, rows.source.eqNullSafe(stats.s)).withColumns(
        {
            "whole": F.floor("ratio").cast("int"), "chance": F.col("ratio") - F.floor("ratio"),
            "draw": F.xxhash64("doc_id", "size", F.lit(seed)), "no_id": F.col("doc_id").isNull(),
            "doc_id": F.coalesce("doc_id", F.lit(0)),  # pandas would make nullable longs floats
        }
    ).select("doc_id", "no_id", "source", "size", "source_size", "target", "whole", "chance", "draw", "n")
    known = _among_alike(known)
    sure = known.where((F.col("chance") <= _NEAR) | (F.col("chance") >= 1 - _NEAR))
    settled = [sure.withColumn("chance", F.round("chance"))]
    open_rows = known.where((F.col("chance") > _NEAR) & (F.col("chance") < 1 - _NEAR))
    while True:
        blocks = F.greatest(F.ceil(F.col("n") / F.lit(float(block))), F.lit(1)).cast("long")
        flown = open_rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("draw", "blocks"), F.col("blocks")))
        flown = written(
            flown.groupBy("source", "block").applyInPandas(
                _flight(seed),
                "doc_id long, no_id boolean, source string, size long, source_size long, target double, whole int, chance double, draw long, n long, blocks long, block long",
            ),
            "flown",
        ).drop("block")
        undecided = (F.col("chance") > 0) & (F.col("chance") < 1)
        settled.append(flown.where(~undecided).drop("blocks"))
        # Up to two of each block are left; a source with one block has landed.
        open_rows = flown.where(undecided).withColumn("n", F.col("blocks") * 2).drop("blocks")
        if open_rows.isEmpty():
            break
    every = settled[0]
    for more in settled[1:]:
        every = every.unionByName(more)
    copies = (F.col("whole") + F.col("chance").cast("int")).cast("int")
    return every.withColumn("copies", copies).select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )
