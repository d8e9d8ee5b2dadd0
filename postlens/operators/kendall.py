"""Kendall's tau-b, exact, without pairing rows.

Equal (y_true, y_pred) pairs fold into weighted cells. A group of cells that is small is counted by one task. In a larger
one, the a axis and the b axis are each cut into blocks of about equal numbers of cells, never through a value; a value
that fills a block alone gets its own. Every pair of the group's cells is then counted in exactly one of these groups,
which are split in turn while they are large:

  matrix  different a blocks and different b blocks: the totals of block pairs, as many as there are blocks squared
  column  same b block, different a blocks: per b block, the totals of (a block, b)
  row     same a block: per a block, its cells

A block that holds one value has no ordered pairs inside, so a hot value is skipped, not collected. A round makes groups
smaller by about the number of blocks, so three rounds do for 10^11 cells. Pairs are counted in whole numbers.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.special import normal_two_sided
from postlens.operators.ordering import running_weight
from postlens.session import cut_lineage

BLOCKS = 128
MOST_CELLS = 100_000
INT64_WEIGHT = 1 << 31  # up to this weight of a group, its pairs are counted in 64 bits


def ordered_pairs(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[int, int]:
    """Weight of concordant and of discordant pairs, ties in either coordinate left out; O(n log^2 n).

    Each pair with a differing is met at the highest bit where the dense ranks of a differ.
    """
    a = np.unique(a, return_inverse=True)[1]
    b = np.unique(b, return_inverse=True)[1]
    by_b = np.argsort(b, kind="stable")
    w = w.astype("int64")
    a, b, w = a[by_b], b[by_b], w[by_b].astype(object if int(w.sum()) > INT64_WEIGHT else "int64")
    concordant = discordant = 0
    for level in range(int(a.max()).bit_length() if len(a) else 0):
        block = a >> (level + 1)
        order = np.argsort(block, kind="stable")
        g, bb, ww, upper = block[order], b[order], w[order], ((a[order] >> level) & 1).astype(bool)
        low = np.concatenate((np.zeros(1, ww.dtype), np.cumsum(np.where(upper, 0, ww))))
        new_group = np.concatenate(([True], g[1:] != g[:-1]))
        new_run = new_group | np.concatenate(([True], bb[1:] != bb[:-1]))
        group_of, run_of = np.cumsum(new_group) - 1, np.cumsum(new_run) - 1
        group_at = np.append(np.flatnonzero(new_group), len(g))
        run_at = np.append(np.flatnonzero(new_run), len(g))
        below = low[run_at[run_of]] - low[group_at[group_of]]
        above = low[group_at[group_of + 1]] - low[run_at[run_of + 1]]
        concordant += int(np.sum(ww[upper] * below[upper]))
        discordant += int(np.sum(ww[upper] * above[upper]))
    return concordant, discordant


def _count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    c, d = ordered_pairs(rows["a"].to_numpy(), rows["b"].to_numpy(), rows["w"].to_numpy())
    return pd.DataFrame({"task": [key[0]], "concordant": [str(c)], "discordant": [str(d)]})


def _folded(cells: DataFrame, value: str) -> DataFrame:
    return cells.groupBy("task", value).agg(F.sum("w").alias("rows"))


def _blocks(cells: DataFrame, value: str, blocks: int) -> DataFrame:
    """task, path, value, block number, and whether the block holds this value alone."""
    counts = cells.groupBy("task", "path", value).agg(F.count(F.lit(1)).alias("cells"))
    placed = running_weight(counts, ["task", "path"], [value], F.col("cells"))
    size = F.greatest(F.lit(1), F.ceil(F.col("total") / blocks))
    alone = F.col("cells") >= size
    number = 2 * F.floor(F.col("before") / size) + alone.cast("bigint")
    return placed.select("task", "path", value, number.alias(f"{value}_block"), alone.alias(f"{value}_alone"))


def _piece(kind: str, block: Column, a: str, b: str) -> Column:
    path = F.concat(F.col("path"), F.lit(f"/{kind}"), block.cast("string"))
    return F.struct(path.alias("path"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))


def split(cells: DataFrame, blocks: int) -> DataFrame:
    """One round: task, path, a, b, w of the groups that count the pairs of these groups."""
    placed = cells.join(_blocks(cells, "a", blocks), ["task", "path", "a"]).join(_blocks(cells, "b", blocks), ["task", "path", "b"])
    pieces = F.array_compact(F.array(
        _piece("m", F.lit(""), "a_block", "b_block"),
        F.when(~F.col("b_alone"), _piece("c", F.col("b_block"), "a_block", "b")),
        F.when(~F.col("a_alone"), _piece("r", F.col("a_block"), "a", "b")),
    ))
    # Matrix and column entries fold here, map side first.
    return placed.select("task", "w", F.inline(pieces)).groupBy("task", "path", "a", "b").agg(F.sum("w").alias("w"))


def small_groups(cells: DataFrame, blocks: int, most_cells: int) -> list[DataFrame]:
    """Groups of at most most_cells cells, by round; each round is written to the checkpoint folder."""
    parts, left = [], cells.withColumn("path", F.lit(""))
    while True:
        sizes = left.groupBy("task", "path").agg((F.count(F.lit(1)) > most_cells).alias("large"))
        large = sizes.where("large").select("task", "path")
        if large.isEmpty():
            return [*parts, left]
        parts.append(left.join(large, ["task", "path"], "left_anti"))
        left = cut_lineage(split(left.join(large, ["task", "path"], "left_semi"), blocks))


def _tie_sums(folded: DataFrame, prefix: str) -> DataFrame:
    t, whole = F.col("rows").cast("double"), F.col("rows").cast("decimal(18,0)")
    return folded.groupBy("task").agg(
        F.sum((whole * (whole - 1)).cast("decimal(38,0)")).alias(f"{prefix}tie2"),
        F.sum(t * (t - 1) * (t - 2)).alias(f"{prefix}0"),
        F.sum(t * (t - 1) * (2 * t + 5)).alias(f"{prefix}1"),
        F.sum("rows").alias(f"{prefix}n"),
    ).withColumn(f"{prefix}tie", F.col(f"{prefix}tie2").cast("double") / 2)


def kendall_tau(
    predictions: DataFrame, with_p: bool = True, blocks: int = BLOCKS, most_cells: int = MOST_CELLS
) -> DataFrame:
    """task, valid_samples, concordant and discordant (whole numbers), kendall_tau and the normal-approximation p value
    with tie correction."""
    if blocks < 4:
        raise ValueError("groups get smaller with four blocks or more")
    most_cells = max(most_cells, 4 * blocks * blocks)  # a matrix group has two numbers a block on each axis
    rows = predictions.where(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())
    cells = rows.groupBy("task", F.col("y_true").cast("double").alias("a"), F.col("y_pred").cast("double").alias("b")).agg(
        F.count(F.lit(1)).alias("w"))
    cells = cut_lineage(cells)
    groups = reduce(DataFrame.unionByName, small_groups(cells, blocks, most_cells))
    counted = groups.groupBy("task", "path").applyInPandas(_count, "task string, concordant string, discordant string")
    pairs = counted.groupBy("task").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).cast("decimal(38,0)").alias(c) for c in ("concordant", "discordant")))
    xs, ys = _folded(cells, "a"), _folded(cells, "b")
    t = _tie_sums(xs, "x").join(_tie_sums(ys, "y"), "task").join(pairs, "task")
    n = F.col("xn").cast("double")
    total, gap = n * (n - 1) / 2, (F.col("concordant") - F.col("discordant")).cast("double")
    width = F.sqrt(total - F.col("xtie")) * F.sqrt(total - F.col("ytie"))
    out = t.withColumn("kendall_tau", F.when(width > 0, gap / F.when(width > 0, width)))
    columns = ["task", F.col("xn").alias("valid_samples"), "concordant", "discordant", "kendall_tau"]
    if with_p:
        m = n * (n - 1)
        var = (
            (m * (2 * n + 5) - F.col("x1") - F.col("y1")) / 18
            + F.when(m > 0, 2 * F.col("xtie") * F.col("ytie") / F.when(m > 0, m)).otherwise(0.0)
            + F.when(n > 2, F.col("x0") * F.col("y0") / F.when(n > 2, 9 * m * (n - 2))).otherwise(0.0)
        )
        columns.append(normal_two_sided(F.when(var > 0, gap / F.sqrt(F.when(var > 0, var)))).alias("kendall_p"))
    return out.select(*columns)
