"""Global order without a single-partition sort (W1, W4, W9 and exact quantiles).

Rows are cut into buckets of the global order (groups, then order columns). The cut points are taken
from a keyed-hash sample of the distinct keys, so they depend on the data alone and come out the same
however often the plan is evaluated. One window per bucket gives the position inside it, and the
bucket totals (at most buckets + groups rows) give the offset. A group of any size, or one value held
by a third of the rows, is spread over buckets or folded into one weighted row before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _bucket_count(df: DataFrame) -> tuple[int, int]:
    """Buckets, and sampled keys per bucket.

    Buckets follow the cluster's shuffle partitions. Every task offers buckets x keys candidates to one
    task that keeps the smallest hashes, so their product is bounded, whatever the size of the data.
    """
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(2048, max(16, 2 * shuffle))
    return buckets, 8 if buckets <= 512 else 4


def _with_bucket(rows: DataFrame, key_columns: Sequence[str]) -> DataFrame:
    """Adds `_bucket`: how many cut points are at or below the row's key, found by halving.

    Every halving is a projection of its own, so that the place found so far is computed once; all of them
    run in generated code.
    """
    buckets, every = _bucket_count(rows)
    key = "struct(" + ", ".join(f"`{c}`" for c in key_columns) + ")"
    # The weight is read along so that this plan and the main one need the same columns and share one shuffle.
    cuts = (
        rows.select(F.expr(key).alias("k"), F.xxhash64(*key_columns).alias("h"), "_w")
        .orderBy("h", "k", "_w")
        .limit(buckets * every)
        .agg(F.expr(f"filter(array_sort(collect_list(k)), (_, i) -> (i + 1) % {every} = 0)"))
    )
    placed = rows.withColumn("_cuts", cuts.scalar()).withColumn("_key", F.expr(key)).withColumn("_bucket", F.lit(0))
    step = 1 << (buckets.bit_length() - 1)
    while step:
        # `get` is NULL past the end, and a NULL comparison leaves the place as it is. The place itself is never
        # NULL: a null check on the join key would be pushed below the pre-aggregation, to every input row.
        placed = placed.withColumn("_bucket", F.expr(f"_bucket + IF(get(_cuts, _bucket + {step - 1}) <= _key, {step}, 0)"))
        step >>= 1
    return placed.drop("_cuts", "_key")


def running_weight(
    rows: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    weight: Column | None = None,
    keep_bucket: Column | None = None,
) -> DataFrame:
    """Adds `before` (weight of earlier rows of the group) and `total` (weight of the group).

    (groups, order) must be unique and groups must not be NULL. `keep_bucket`, a predicate on
    _offset, _sum and total, drops whole buckets before they are sorted.
    """
    weight = F.lit(1) if weight is None else weight
    groups, order = list(groups), list(order)
    key = ["_bucket", *groups]
    placed = _with_bucket(rows.withColumn("_w", weight.cast("bigint")), [*groups, *order])
    sums = placed.groupBy(*key).agg(F.sum("_w").alias("_sum"))
    per_group = Window.partitionBy(*(groups or [F.lit(0)]))
    earlier = per_group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumns({
        "_offset": F.coalesce(F.sum("_sum").over(earlier), F.lit(0)),
        "total": F.sum("_sum").over(per_group),
    })
    if keep_bucket is not None:
        offsets = offsets.where(keep_bucket)
    inside = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(offsets, key)
        .withColumn("before", F.col("_offset") + F.coalesce(F.sum("_w").over(inside), F.lit(0)))
        .drop("_bucket", "_w", "_sum", "_offset")
    )


def value_counts(df: DataFrame, groups: Sequence[str], value: str, *extra: Column) -> DataFrame:
    """Distinct non-NULL values with their row count `n`; repeated values fold before the shuffle."""
    return df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"), *extra)


def weighted_ranks(df: DataFrame, groups: Sequence[str], value: str, weight: str, name: str) -> DataFrame:
    """Average rank of every distinct value, where a row stands for `weight` equal rows; `total` rows per group."""
    folded = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.sum(weight).alias("_n"))
    ranked = running_weight(folded, groups, [value], F.col("_n"))
    return ranked.select(*groups, value, (F.col("before") + (F.col("_n") + 1) / 2).alias(name), "total")


def average_ranks(df: DataFrame, groups: Sequence[str], value: str, name: str = "avg_rank") -> DataFrame:
    """The average rank of every distinct value, ties sharing the mean of their positions."""
    return weighted_ranks(value_counts(df, groups, value), groups, value, "n", name)


def dense_positions(df: DataFrame, groups: Sequence[str], value: str, name: str = "position") -> DataFrame:
    """0-based place of each distinct non-NULL value in the sorted values of its group."""
    distinct = df.where(F.col(value).isNotNull()).select(*groups, value).distinct()
    return running_weight(distinct, groups, [value]).select(*groups, value, F.col("before").alias(name))


def number_rows(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str = "row") -> DataFrame:
    """1-based row number inside each group; the order must be unique. A long group is split, not sorted in one task."""
    return running_weight(df, groups, order).withColumn(name, F.col("before") + 1).drop("before", "total")


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Linear-interpolation quantiles per group as an array column `quantiles`; NULLs are left out.

    Only buckets that hold a wanted position are sorted.
    """
    def covers(start: str, size: str, total: str) -> list[str]:
        """For each probability: whether the position below it, and the one above it, lies in [start, start + size)."""
        spots = [f"({total} - 1) * {float(p)!r}D" for p in probs]
        return [f"{start} <= {f}({at}) AND {f}({at}) < {start} + {size}" for at in spots for f in ("floor", "ceil")]

    counts = value_counts(df, groups, value)
    wanted = F.expr(" OR ".join(f"({c})" for c in covers("_offset", "_sum", "total")))
    placed = running_weight(counts, groups, [value], F.col("n"), wanted)
    picks = [
        F.expr(f"max(CASE WHEN {c} THEN CAST(`{value}` AS DOUBLE) END) AS _v{i}")
        for i, c in enumerate(covers("before", "n", "total"))
    ]
    picked = placed.groupBy(*groups).agg(F.first("total").alias("_t"), *picks)
    values = []
    for i, p in enumerate(probs):
        at, lo, hi = f"(_t - 1) * {float(p)!r}D", f"_v{2 * i}", f"_v{2 * i + 1}"
        values.append(f"{lo} + ({hi} - {lo}) * ({at} - floor({at}))")
    return picked.select(*groups, F.expr(f"array({', '.join(values)}) AS quantiles"))


def median(df: DataFrame, value: str) -> DataFrame:
    """One row, one column `median`."""
    return exact_quantiles(df, [], value, [0.5]).select(F.col("quantiles")[0].alias("median"))
