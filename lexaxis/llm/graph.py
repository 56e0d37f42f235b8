"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaxis.llm.common import settled


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _with_least(edges: DataFrame) -> DataFrame:
    """`edges` with m, the least v of each u: by an aggregate and a join, which adaptive execution splits for a node of very many edges."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge but isn't a root; root is its component's least node.

    `edges` has bigint columns u and v, in either order, repeated or not; loops
    and nulls are ignored. Every step is written to the shared folder, since an
    iteration's lineage would otherwise hold all steps before it. An empty table
    gives an empty result.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = settled(edges)
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select("v", "u"))
        large = _with_least(both).withColumn("m", F.least("u", "m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = _with_least(large.distinct())
        small = low.select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        edges = settled(small.distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
