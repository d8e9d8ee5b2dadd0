"""Linear models of many targets from one pass over the rows (M8).

Rows with the same known targets share one table of centred sums: number, means, and sums of products of features and
targets. Tasks fold their rows into such tables; a row of a table is one row of a DataFrame, so what a task sends and what
meets in one place does not depend on the number of rows. A target's own sums are those of all tables that know it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.literals import literal_rows

TABLES_HELD = 16
MODEL = "task string, n bigint, intercept double, coefficients array<double>"


def merged(a: np.ndarray, b: np.ndarray, i: int) -> np.ndarray:
    """Row i of the centred sums of two groups, each as [n, means..., sums...]."""
    width = (len(a) - 1) // 2
    n, shift = a[0] + b[0], b[1 : width + 1] - a[1 : width + 1]
    means = a[1 : width + 1] + shift * (b[0] / n)
    return np.concatenate([[n], means, a[width + 1 :] + b[width + 1 :] + shift[i] * shift * (a[0] * b[0] / n)])


def _as_array(df: DataFrame, features: str) -> Column:
    kind = df.schema[features].dataType.typeName()
    return F.col(features).cast("array<double>") if kind == "array" else vector_to_array(features)


def centred_sums(df: DataFrame, features: str, targets: Sequence[str]) -> DataFrame:
    """known (bits of the targets that a row has), line, sums ([n, means..., line of the sums of products]).

    Rows without features are left out, as are rows that know no target."""
    known = sum((F.when(F.col(t).isNotNull() & ~F.isnan(F.col(t).cast("double")), F.lit(1 << i)).otherwise(0) for i, t in enumerate(targets)), F.lit(0))
    values = [F.coalesce(F.nanvl(F.col(t).cast("double"), F.lit(0.0)), F.lit(0.0)) for t in targets]
    rows = df.where(F.col(features).isNotNull()).select(known.cast("bigint").alias("known"), F.concat(_as_array(df, features), F.array(*values)).alias("v")).where("known > 0")

    def table(key: int, x: np.ndarray) -> pa.RecordBatch:
        n, means = len(x), x.mean(axis=0)
        return np.column_stack([np.full(x.shape[1], n), np.tile(means, (x.shape[1], 1)), (x - means).T @ (x - means)])

    def sent(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for key, lines in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(lines), pa.int64()), pa.array(range(len(lines)), pa.int32()), pa.array(list(lines))], names=["known", "line", "sums"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            keys, flat = batch.column("known").to_numpy(), batch.column("v").flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(len(keys), -1) if len(keys) else np.zeros((0, 0))
            for key in sorted(set(keys.tolist())):
                new = table(key, x[keys == key])
                held[key] = np.array([merged(a, b, i) for i, (a, b) in enumerate(zip(held[key], new, strict=True))]) if key in held else new
            if len(held) > TABLES_HELD:
                yield from sent(held)
                held = {}
        yield from sent(held)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        for batch in batches:
            for key, line, sums in zip(*(batch.column(c).to_pylist() for c in ("known", "line", "sums")), strict=True):
                if (key, line) == last:
                    total = merged(total, np.array(sums), line)
                    continue
                if last is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]], pa.int32()), pa.array([total])], names=["known", "line", "sums"])
                last, total = (key, line), np.array(sums)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]], pa.int32()), pa.array([total])], names=["known", "line", "sums"])

    schema = "known long, line int, sums array<double>"
    parts = rows.mapInArrow(fold, schema)
    # Parts of one line meet in two steps, so that no task gets one of every task.
    some = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64))).repartition("known", "line", "part").sortWithinPartitions("known", "line", "part")
    return some.select("known", "line", "sums").mapInArrow(join, schema).repartition("known", "line").sortWithinPartitions("known", "line").mapInArrow(join, schema)


def fit_ridge(df: DataFrame, features: str, targets: Mapping[str, str], penalty: float = 0.01) -> DataFrame:
    """M8: task, n, intercept, coefficients of the least mean square plus penalty x variance-weighted squared coefficients.

    `targets` maps tasks to columns; absent columns and tasks without rows give no line. The rows are read once. A feature
    that does not vary has coefficient 0. The driver gets one table of (features + targets)^2 sums per target."""
    present = {t: c for t, c in targets.items() if c in df.columns}
    names, held = list(present.values()), {}
    for row in centred_sums(df, features, names).toLocalIterator() if names else []:
        line, sums = row["line"], np.array(row["sums"])
        for i, task in enumerate(present):
            if row["known"] >> i & 1:
                at = held.setdefault(task, {})
                at[line] = merged(at[line], sums, line) if line in at else sums
    lines = []
    for i, task in enumerate(present):
        if task not in held:
            continue
        table = np.array([held[task][k] for k in sorted(held[task])])
        width = table.shape[0]
        d, n, means, sums = width - len(names), table[0, 0], table[0, 1 : width + 1], table[:, width + 1 :] / table[0, 0]
        cov, own = sums[:d, :d].copy(), np.diag(sums)[:d]
        cov[np.diag_indices(d)] += np.where(own > 1e-12 * max(own.max(initial=0), 1e-300), penalty * own, 1.0)
        steady = own <= 1e-12 * max(own.max(initial=0), 1e-300)
        cov[steady, :], cov[:, steady] = 0, 0
        cov[steady, steady] = 1
        b = np.linalg.lstsq(cov, np.where(steady, 0, sums[:d, d + i]), rcond=None)[0]
        lines.append((task, int(n), float(means[d + i] - means[:d] @ b), [float(x) for x in b]))
    return literal_rows(df.sparkSession, lines, MODEL)


def predict(df: DataFrame, features: str, model: DataFrame, suffix: str = "_raw") -> DataFrame:
    """df with `{task}{suffix}` for every task of the model: one product of matrices a batch. A row without features gets nulls."""
    rows = model.collect()
    weights, shift = np.array([r["coefficients"] for r in rows]).T, np.array([r["intercept"] for r in rows])
    names = [f"{r['task']}{suffix}" for r in rows]
    columns = [c for c in df.columns if c not in (*names, "_x")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, out = batch.column("_x"), np.full((batch.num_rows, len(names)), np.nan)
            there = np.array(x.is_valid())
            if there.any():
                out[there] = x.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(int(there.sum()), -1) @ weights + shift
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array(v, from_pandas=True) for v in out.T)], names=[*columns, *names])

    kept = df.select(*columns)
    fields = ", ".join([kept.schema.toDDL(), *(f"`{n}` double" for n in names)])
    return df.select(*columns, _as_array(df, features).alias("_x")).mapInArrow(score, fields)
