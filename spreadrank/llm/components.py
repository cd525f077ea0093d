"""Connected components of an edge table, by alternating large stars and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadrank.llm.common import drop_tables, materialize


def _mark(e: DataFrame):
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node that has an edge, with the least node that it can reach.

    Nulls and edges from a node to itself are dropped, repeated edges count once. Each round joins nodes with the least
    of their neighbours, an aggregate, so a node with very many edges is combined before the shuffle and split by Spark
    in the join. Rounds grow with the logarithm of the longest path.
    """
    own = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y"))
    e = materialize(own.filter("x is not null and y is not null and a <> b").select("a", "b").distinct(), "edges")
    before = _mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large.filter("a <> b"), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = materialize(small.filter("a <> b").distinct(), "small-star")
        after = _mark(new)
        drop_tables(e, large)
        e = new
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
