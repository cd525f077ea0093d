"""Vertex states (v, x in [0, 1]): generators, and what can be said of them without a graph."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadrank.functions.draws import uniform
from spreadrank.operators.graph import Graph, dense_ids
from spreadrank.operators.traverse import nearest_source


def ramp(x: Column, y: Column) -> Column:
    return F.greatest(x - y, F.lit(0.0))


def state_stats(states: DataFrame) -> DataFrame:
    return states.agg(F.max("x").alias("max_x"), F.min("x").alias("min_x"), F.avg("x").alias("mean_x"), F.stddev_samp("x").alias("std_x"))


def ranked(states: DataFrame, cells: int = 4096) -> DataFrame:
    """(x, c, j, s): each different state, how many have it, how many are smaller and their sum.

    Equal states are counted first (a state that most vertices share is one row); running sums are taken within cells of
    [0, 1] and the sums of whole cells are added, so no task sorts all states.
    """
    groups = states.groupBy("x").agg(F.count(F.lit(1)).alias("c")).withColumn("cell", F.floor(F.col("x") * cells))
    sums = groups.groupBy("cell").agg(F.sum("c").alias("k"), F.sum(F.col("c") * F.col("x")).alias("t"))
    order = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # cells + 1 rows at most
    before = sums.select("cell", F.coalesce(F.sum("k").over(order), F.lit(0)).alias("k0"), F.coalesce(F.sum("t").over(order), F.lit(0.0)).alias("t0"))
    own = Window.partitionBy("cell").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    within = groups.withColumns({"j1": F.coalesce(F.sum("c").over(own), F.lit(0)), "s1": F.coalesce(F.sum(F.col("c") * F.col("x")).over(own), F.lit(0.0))})
    return within.join(F.broadcast(before), "cell").select("x", "c", (F.col("j1") + F.col("k0")).alias("j"), (F.col("s1") + F.col("t0")).alias("s"))


def kappa_total(states: DataFrame) -> DataFrame:
    """One row (total): the sum of ramps x_s - x_z over all pairs."""
    return ranked(states).agg(F.coalesce(F.sum(F.col("c") * (F.col("x") * F.col("j") - F.col("s"))), F.lit(0.0)).alias("total"))


def kappa_sums(states: DataFrame) -> DataFrame:
    """(v, x, total, minus_sum): total as kappa_total(), and without the pairs that v is in. Linear but for a sort of different states."""
    r = ranked(states)
    whole = r.agg(F.sum(F.col("c") * (F.col("x") * F.col("j") - F.col("s"))).alias("total"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("x")).alias("t"))
    gap = F.col("x") * (2 * F.col("j") - F.col("n")) + F.col("t") - 2 * F.col("s")  # sum of |x_u - x|
    by_x = r.crossJoin(F.broadcast(whole)).select("x", "total", (F.col("total") - gap).alias("minus_sum"))
    return states.join(by_x, "x").select("v", "x", "total", "minus_sum")


def outgoing_mass(states: DataFrame) -> DataFrame:
    """(v, x, mass): the sum of ramps from v to all others."""
    return states.join(ranked(states).select("x", (F.col("x") * F.col("j") - F.col("s")).alias("mass")), "x").select("v", "x", "mass")


def distortion(states: DataFrame, legacy: bool = False) -> DataFrame:
    """(v, d_v): total / minus_sum, null where minus_sum is 0. ``legacy`` adds the state once too often, as earlier implementations do."""
    k = kappa_sums(states)
    d = F.try_divide("total", "minus_sum") if not legacy else 1 + F.try_divide(F.col("total") - F.col("minus_sum") + F.col("x"), F.col("minus_sum"))
    return k.select("v", d.alias("d_v"))


def distortion_summary(states: DataFrame, legacy: bool = False) -> DataFrame:
    return distortion(states, legacy).agg(F.min("d_v").alias("min_d_v"), F.max("d_v").alias("max_d_v"), F.count(F.lit(1)).alias("n"))


def sampled_distortion(states: DataFrame, samples: int) -> DataFrame:
    """(v, d_v): the largest ratio, over drawn pairs (s, z) without v, of the pair's weight without v to that with v."""
    from spreadrank.operators.sampling import uniform_pairs

    pairs = uniform_pairs(states.select("v"), samples).join(states.withColumnsRenamed({"v": "s", "x": "xs"}), "s").join(states.withColumnsRenamed({"v": "z", "x": "xz"}), "z").filter("xs > xz")
    own = pairs.select(F.explode(F.array("s", "z")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("mine"))
    k = kappa_sums(states).join(own, "v", "left").crossJoin(F.broadcast(pairs.agg(F.count(F.lit(1)).alias("k"))))
    return k.select("v", F.when(F.col("k") > F.coalesce("mine", F.lit(0)), F.try_divide("total", "minus_sum")).alias("d_v"))


def log_buckets(states: DataFrame, base: float = 2.0) -> DataFrame:
    """(v, bucket): floor(log_base(min(1/x, n))) + 1."""
    n = states.agg(F.count(F.lit(1)).alias("n"))
    inverse = F.when(F.col("x") > 0, F.least(F.lit(1.0) / F.nullif(F.col("x"), F.lit(0.0)), F.col("n").cast("double"))).otherwise(F.col("n").cast("double"))
    return states.crossJoin(F.broadcast(n)).select("v", (F.floor(F.log(inverse) / F.lit(math.log(base)) + F.lit(1e-12)) + 1).cast("long").alias("bucket"))


def threshold_parts(states: DataFrame, high: float = 0.75, low: float = 0.25) -> DataFrame:
    """(v, x, part): A from high on, B up to low, C between."""
    return states.select("v", "x", F.when(F.col("x") >= high, "A").when(F.col("x") <= low, "B").otherwise("C").alias("part"))


def per_vertex_normalised(scores: DataFrame, states: DataFrame) -> DataFrame:
    """(v, pc): scores times total / minus_sum, null where that is 0."""
    return scores.join(kappa_sums(states), "v").select("v", F.try_divide(F.col("pc") * F.col("total"), F.col("minus_sum")).alias("pc"))


def pair_normalised(scores: DataFrame) -> DataFrame:
    """(v, pc): scores over n (n - 1)."""
    n = scores.agg(F.count(F.lit(1)).alias("n"))
    return scores.crossJoin(F.broadcast(n)).select("v", F.try_divide(F.col("pc"), (F.col("n") * (F.col("n") - 1)).cast("double")).alias("pc"))


def uniform_states(vertices: DataFrame, stream: int = 20) -> DataFrame:
    """A draw from [0, 1) for each vertex."""
    return vertices.select("v", uniform(F.col("v"), stream).alias("x"))


def initiator_states(vertices: DataFrame, k: int, stream: int = 21) -> DataFrame:
    """1 for k drawn vertices (fewer if there are fewer), 0 for the others."""
    chosen = vertices.select("v", uniform(F.col("v"), stream).alias("u")).orderBy("u", "v").limit(k).select("v", F.lit(1.0).alias("one"))
    return vertices.join(chosen, "v", "left").select("v", F.coalesce("one", F.lit(0.0)).alias("x"))


def spread_states(graph: Graph, k: int, max_distance: int | None, mass: float, stream: int = 22) -> DataFrame:
    """mass**-d at distance d from the nearest of k draws of vertices (with replacement), 0 beyond max_distance."""
    ids = dense_ids(graph.vertices)
    n = ids.agg(F.count(F.lit(1)).alias("n"))
    drawn = graph.edges.sparkSession.range(k).select(uniform(F.col("id"), stream).alias("u")).crossJoin(F.broadcast(n)).select(F.floor(F.col("u") * F.col("n")).alias("id"))
    near = nearest_source(graph, ids.join(drawn.distinct(), "id").select("v"), max_distance)
    return graph.vertices.join(near, "v", "left").select("v", F.coalesce(F.pow(F.lit(float(mass)), -F.col("d")), F.lit(0.0)).alias("x"))


def _cumulative(sizes: list[int]) -> list[tuple[int, int]]:
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    return list(zip([0, *ends[:-1]], ends, strict=True))


def range_states(vertices: DataFrame, ranges: list[tuple[int, float | None]], stream: int = 23) -> DataFrame:
    """States by runs of vertices in order of id: (size, value); value None draws each. Sizes must add up to all vertices."""
    ids = dense_ids(vertices)
    if sum(k for k, _ in ranges) != ids.count():
        raise ValueError("the sizes don't add up to the number of vertices")
    x = F.lit(None).cast("double")
    for (a, b), (_, value) in zip(_cumulative([k for k, _ in ranges]), ranges, strict=True):
        x = F.when((F.col("id") >= a) & (F.col("id") < b), uniform(F.col("v"), stream) if value is None else F.lit(float(value))).otherwise(x)
    return ids.select("v", x.alias("x"))


def mixed_states(vertices: DataFrame, random: int, small: int, zero: int, one: int, eps: float, stream: int = 24) -> DataFrame:
    """A drawn division of the vertices into groups with random states, eps, 0 and 1."""
    shuffled = dense_ids(vertices.select("v", uniform(F.col("v"), stream).alias("u")), "u")
    if random + small + zero + one != shuffled.count():
        raise ValueError("the sizes don't add up to the number of vertices")
    i = F.col("id")
    x = F.when(i < random, uniform(F.col("v"), stream + 1)).when(i < random + small, F.lit(float(eps))).when(i < random + small + zero, 0.0).otherwise(1.0)
    return shuffled.select("v", x.alias("x"))
