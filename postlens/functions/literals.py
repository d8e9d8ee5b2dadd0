"""Small constant tables inside the plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal_rows(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """Rows of Python values as a table that needs no Python worker."""
    fields = T.StructType.fromDDL(schema).fields
    base = spark.range(1)
    if not rows:
        return base.where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)]) for row in rows
    ]
    return base.select(F.inline(F.array(*structs)))
