"""Registration of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.catalog import fixtures as fx
from postlens.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODULES: dict[str, str] = {}

_CTES = {
    "note_info": fx.NOTE_INFO,
    "note_stats": fx.NOTE_STATS,
    "predictions": fx.PREDICTIONS,
    "epoch_history": fx.EPOCH_HISTORY,
    "batch_metrics": fx.BATCH_METRICS,
    "ocr_tokens": fx.OCR_TOKENS,
    "note_vectors": fx.NOTE_VECTORS_DUCKDB,
}
# Digits kept in compared doubles: sums run in a different order in each engine.
DIGITS = 7
COARSE = 2


def student_p_sql(t: str, dof: str) -> str:
    """Two-sided p value of Student's t by Simpson's rule over the density; beyond 40 nothing is left of it."""
    h = f"(least(abs({t}), 40) / 4000.0E0)"
    density = f"pow(1 + k * {h} * k * {h} / ({dof}), -(({dof}) + 1) / 2.0E0)"
    total = f"list_sum(list_transform(range(4001), lambda k: CASE WHEN k % 4000 = 0 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * {density}))"
    scale = f"exp(lgamma((({dof}) + 1) / 2.0E0) - lgamma(({dof}) / 2.0E0)) / sqrt(({dof}) * pi())"
    return f"greatest(0.0E0, 1 - 2 * {h} / 3 * {total} * {scale})"


def normal_p_sql(z: str) -> str:
    """Two-sided p value of a normal statistic, by Simpson's rule; beyond 40 nothing is left of it."""
    h = f"(least(abs({z}), 40) / 4000.0E0)"
    total = f"list_sum(list_transform(range(4001), lambda k: CASE WHEN k % 4000 = 0 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(k * {h}, 2) / 2)))"
    return f"greatest(0.0E0, 1 - 2 * {h} / 3 * {total} / sqrt(2 * pi()))"


def with_fixtures(body: str, *names: str) -> str:
    """Puts the logical tables in front of a statement, as common table expressions."""
    if "predictions" in names and "note_stats" not in names:
        names = ("note_stats", *names)
    parts = [f"{n} AS ({_CTES[n]})" for n in names]
    head, rest = ("WITH ", body) if not body.lstrip().startswith("WITH ") else ("WITH ", body.lstrip()[5:])
    if not parts:
        return body
    return head + ",\n".join(parts) + (",\n" if body.lstrip().startswith("WITH ") else "\n") + rest


def rounded(df: DataFrame, coarse: Sequence[str] = ()) -> DataFrame:
    """Doubles to DIGITS places, COARSE for the columns named; -0.0 becomes 0.0."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.round(F.col(c).cast("double"), COARSE if c in coarse else DIGITS) + F.lit(0.0) for c in doubles})


def register(name: str, sql: str | None = None, uses: Sequence[str] = (), doubles: Sequence[str] = (),
             coarse: Sequence[str] = ()):
    """Decorator. `uses` names logical tables of the SQL, `doubles` the columns rounded on both sides,
    `coarse` those of them with many digits before the point."""

    def add(fn: Query) -> Query:
        MODULES[name] = fn.__module__.rsplit(".", 1)[-1]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return rounded(fn(spark, sf_dir.rstrip("/")), coarse)

        QUERIES[name] = run
        if sql is not None:
            text = with_fixtures(sql, *uses)
            if doubles:
                rounds = ", ".join(f"round(CAST({c} AS DOUBLE), {COARSE if c in coarse else DIGITS}) + 0.0E0 AS {c}" for c in doubles)
                text = f"SELECT * REPLACE ({rounds}) FROM (\n{text}\n)"
            ORACLES[name] = text
        return fn

    return add
