"""Connected components by alternating large and small stars, with joins and sums only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import materialise


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))")).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, component: the smallest node it is linked to over any number of edges. Nodes without an edge to another
    node, and edges with a null end, are left out.

    Each round every node's smallest neighbour is a sum per node, written and joined back to the edges: a plain join of
    two shuffles, of which Spark splits the part of a node with very many edges. Rounds are written to the shared folder."""
    both = edges.where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}")
    now = materialise(both.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    mark = _mark(now)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        # Large star: a node's larger neighbours go to the smallest of its neighbours and itself.
        least = materialise(now.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")))
        large = now.join(least, now["lo"] == least["u"], "left").select("hi", F.coalesce("m", "lo").alias("lo")).distinct()
        # Small star: its smaller neighbours and itself go to the smallest of these.
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = materialise(small.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct())
        last, mark, now = mark, _mark(after), after
        if mark == last:
            break
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(now.select(F.col("lo"), F.col("lo")).distinct())
