"""K-means for several numbers of clusters and several starts, trained together (M1).

Each round reads the rows once for all models: their centres are sent to the tasks, and what comes back is a sum per
cluster. Starts are drawn by k-means||: rows join a start's candidates with a chance that grows with their squared
distance, as an exponential race over a hash of the key, so that a task that runs again draws the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.operators.folding import sum_arrays

STARTS, DRAWS, ITERATIONS, TOLERANCE = 10, 3, 40, 1e-4
MOST_BYTES = 128 << 20  # of centres sent at once
DIRECT_BYTES = 16 << 20  # of sums that tasks send to the driver without a shuffle


@dataclass(frozen=True)
class Clusters:
    """k centres (some may have no rows) and the sum of squared distances of all rows to the nearest."""

    k: int
    start: int
    centers: np.ndarray
    cost: float

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return squared_distances(x, self.centers).argmin(axis=1)


def squared_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1), 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    x = (h.view(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _candidates(rows: DataFrame, starts: int, size: int, draws: int, seed: int) -> list[np.ndarray]:
    """rows: h (hash of the key), v. By start: about size x draws + 1 rows."""
    firsts = rows.agg(*(F.min_by("v", F.xxhash64("h", F.lit(seed + s))).alias(f"s{s}") for s in range(starts))).head()
    found = [np.array([firsts[s]]) for s in range(starts)]
    for draw in range(draws):
        sent = rows.sparkSession.sparkContext.broadcast(found)

        def race(batches: Iterator[pa.RecordBatch], sent=sent, draw=draw) -> Iterator[pa.RecordBatch]:
            best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * starts
            for batch in batches:
                x, h = _matrix(batch.column("v")), batch.column("h").to_numpy()
                for s, have in enumerate(sent.value):
                    far = squared_distances(x, have).min(axis=1)
                    at = np.flatnonzero(far > 1e-9 * (1 + (x * x).sum(1)))
                    time, rows_at = -np.log(_uniform(h[at], seed + 1000 * draw + s)) / far[at], x[at]
                    if best[s] is not None:
                        time, rows_at = np.concatenate([best[s][0], time]), np.concatenate([best[s][1], rows_at])
                    first = np.argsort(time, kind="stable")[:size]
                    best[s] = time[first], rows_at[first]
            for s, pair in enumerate(best):
                if pair is not None and len(pair[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair[0]), s)), pa.array(pair[0]), pa.array(list(pair[1]))], names=["start", "time", "v"])

        raced = rows.mapInArrow(race, "start long, time double, v array<double>").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
        for by in (["start", "part"], ["start"]):
            raced = raced.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("time"))).where(F.col("place") <= size)
        for r in raced.select("start", "v").toLocalIterator():
            found[r["start"]] = np.concatenate([found[r["start"]], [r["v"]]])
        sent.unpersist()
    # Ties in time would make the order of arrival count.
    return [np.unique(f, axis=0) for f in found]


def _pass(rows: DataFrame, models: Sequence[np.ndarray], tasks: int = 1 << 30) -> list[np.ndarray]:
    """By model: per centre the number of its rows, the sum of their squared distances, and the sums of their vectors.

    Where `tasks` tasks' sums are few bytes, they are added up on the driver, else in a shuffle."""
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            x = _matrix(batch.column("v"))
            sums = sums or [np.zeros((len(c), 2 + x.shape[1])) for c in sent.value]
            for total, centers in zip(sums, sent.value, strict=True):
                far = squared_distances(x, centers)
                near = far.argmin(axis=1)
                order = np.argsort(near, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], near[order][1:] != near[order][:-1]]))
                part = np.column_stack([np.ones(len(x)), far[np.arange(len(x)), near], x])[order]
                total[near[order][first]] += np.add.reduceat(part, first, axis=0)
        for m, total in enumerate(sums or []):
            some = np.flatnonzero(total[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array((m << 32) + some), pa.array(list(total[some]))], names=["key", "sums"])

    width = models[0].shape[1] + 2
    out = [np.zeros((len(c), width)) for c in models]
    parts = rows.select("v").mapInArrow(fold, "key long, sums array<double>")
    if tasks * sum(c.nbytes for c in models) <= DIRECT_BYTES:
        table = parts.toArrow().combine_chunks()
        for key, sums in zip(table.column("key").to_pylist(), _matrix(table.column("sums").combine_chunks()), strict=True):
            out[key >> 32][key & 0xFFFFFFFF] += sums
    else:
        for r in sum_arrays(parts).toLocalIterator():
            out[r["key"] >> 32][r["key"] & 0xFFFFFFFF] = r["sums"]
    sent.unpersist()
    return out


def _seeded(candidates: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the weighted candidates by k-means++; where there are fewer, some twice."""
    chosen = [int(rng.choice(len(candidates), p=weights / weights.sum()))]
    far = squared_distances(candidates, candidates[chosen]).ravel()
    while len(chosen) < k:
        chance = weights * far
        chosen.append(int(rng.choice(len(candidates), p=chance / chance.sum()) if chance.sum() > 0 else rng.integers(len(candidates))))
        far = np.minimum(far, squared_distances(candidates, candidates[chosen[-1:]]).ravel())
    return candidates[chosen]


def train_sweep(
    df: DataFrame, key: str, vector: str, counts: Sequence[int], starts: int = STARTS, draws: int = DRAWS,
    iterations: int = ITERATIONS, tolerance: float = TOLERANCE, seed: int = 42,
) -> list[Clusters]:
    """The best of `starts` clusterings for every k of 2 to one less than there are rows; no rows with a vector give none.

    df should be cheap to read again (written). A model is done when its centres move by less than `tolerance` of the
    rows' mean variance; models that are done are not sent any more. A centre without rows stays where it is."""
    rows = df.where(F.col(vector).isNotNull()).select(F.xxhash64(F.col(key)).alias("h"), F.col(vector).cast("array<double>").alias("v"))
    n, tasks = rows.count(), rows.rdd.getNumPartitions()
    counts = sorted({k for k in counts if 2 <= k < n})
    if not counts:
        return []
    candidates = _candidates(rows, starts, 2 * max(counts), draws, seed)
    weights = [s[:, 0] for s in _pass(rows, candidates, tasks)]
    rng = np.random.default_rng(seed)
    plan = [(k, s) for k in counts for s in range(starts)]
    centers = {p: _seeded(candidates[p[1]], weights[p[1]], p[0], rng) for p in plan}
    grand = _pass(rows, [np.zeros((1, centers[plan[0]].shape[1]))], tasks)[0][0]
    variance = (grand[1] / n - ((grand[2:] / n) ** 2).sum()) / len(grand[2:])
    cost = {}
    for group in _groups(plan, centers):
        active = list(group)
        for i in range(iterations + 1):
            for p, sums in zip(active, _pass(rows, [centers[p] for p in active], tasks), strict=True):
                cost[p] = float(sums[:, 1].sum())
                moved = np.where(sums[:, :1] > 0, sums[:, 2:] / np.maximum(sums[:, :1], 1), centers[p])
                if i == iterations or ((moved - centers[p]) ** 2).sum() <= tolerance * variance:
                    group.remove(p)  # the centres that the cost belongs to stay
                else:
                    centers[p] = moved
            active = list(group)
            if not active:
                break
    best = [min((p for p in plan if p[0] == k), key=lambda p: cost[p]) for k in counts]
    return [Clusters(p[0], p[1], centers[p], cost[p]) for p in best]


def _groups(plan: list[tuple[int, int]], centers: dict) -> list[list[tuple[int, int]]]:
    """Models whose centres are sent together."""
    groups, size = [[]], 0
    for p in plan:
        if groups[-1] and size + centers[p].nbytes > MOST_BYTES:
            groups.append([])
            size = 0
        groups[-1].append(p)
        size += centers[p].nbytes
    return groups


def assign(df: DataFrame, vector: str, models: Sequence[Clusters], name: str = "clusters") -> DataFrame:
    """df with an array of the nearest centre's number in each model; null without a vector."""
    sent = df.sparkSession.sparkContext.broadcast([m.centers for m in models])
    columns = [c for c in df.columns if c not in (name, "_v")]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("_v")
            x, there = _matrix(v.drop_null()), np.array(v.is_valid(), bool)
            labels = np.column_stack([squared_distances(x, c).argmin(axis=1) for c in sent.value]) if there.any() else []
            out: list = [None] * batch.num_rows
            for i, row in zip(np.flatnonzero(there).tolist(), labels, strict=True):
                out[i] = row.tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, pa.list_(pa.int32()))], names=[*columns, name])

    kept = df.select(*columns)
    return df.select(*columns, F.col(vector).cast("array<double>").alias("_v")).mapInArrow(near, f"{kept.schema.toDDL()}, `{name}` array<int>")


def sample_silhouettes(sample: np.ndarray, models: Sequence[Clusters]) -> list[float | None]:
    """Euclidean silhouettes over a bounded sample's vectors; None where all lie in one cluster."""
    far = np.sqrt(squared_distances(sample, sample))
    np.fill_diagonal(far, 0)
    out = []
    for model in models:
        label = np.unique(model.nearest(sample), return_inverse=True)[1]
        size = np.bincount(label)
        if len(size) < 2:
            out.append(None)
            continue
        reach = np.stack([far[:, label == c].sum(axis=1) for c in range(len(size))], axis=1)
        own = size[label]
        a = reach[np.arange(len(label)), label] / np.maximum(own - 1, 1)
        other = reach / size
        other[np.arange(len(label)), label] = np.inf
        b = other.min(axis=1)
        top = np.maximum(a, b)
        out.append(float(np.where((own > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0).mean()))
    return out
