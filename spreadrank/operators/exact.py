"""Exact centralities: how much of the spread along shortest paths passes through each vertex."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadrank.functions.lineage import cut
from spreadrank.operators import blocks
from spreadrank.operators.graph import Graph, induced
from spreadrank.operators.states import kappa_sums, kappa_total, ramp
from spreadrank.operators.traverse import accumulate, levels, union_all


def _batches(sources: DataFrame, batches: int) -> list[DataFrame]:
    return [sources] if batches < 2 else [sources.filter(F.pmod(F.xxhash64("s"), F.lit(batches)) == b) for b in range(batches)]


def _dependencies(graph: Graph, sources: DataFrame, weigh, batches: int) -> DataFrame:
    """(s, v, delta) of all sources, searched in batches so that the state (sources x vertices) stays bounded."""
    return union_all([accumulate(graph, levels(graph, part), weigh) for part in _batches(sources, batches)])


def _state_array(g: blocks.Compact, states: DataFrame) -> np.ndarray:
    """States by position; NaN where a vertex has none. ``states`` are of vertices of the graph only, which is bounded."""
    rows = states.select("v", F.col("x").cast("double").alias("x")).filter("v is not null and x is not null").toArrow()
    out = np.full(len(g.ids), np.nan)
    at, known = g.places(rows["v"].to_numpy())
    out[at[known]] = rows["x"].to_numpy()[known]
    return out


def _with_all(graph: Graph, sums: DataFrame, value) -> DataFrame:
    return graph.vertices.join(sums, "v", "left").select("v", F.coalesce(value, F.lit(0.0)).alias("pc"))


def target_unnormalised(graph: Graph, states: DataFrame, batches: int = 1) -> DataFrame:
    """(v, pc): sum over s != v != z of the share of shortest s-z paths through v, times ramp(x_s, x_z)."""
    graph = graph.pinned()
    g = graph.compact
    if g is not None:
        x = _state_array(g, states.join(graph.vertices, "v", "left_semi"))
        sources = np.flatnonzero(x > np.nanmin(x)) if (~np.isnan(x)).any() else np.zeros(0, np.int64)
        return _with_all(graph, blocks.dependency_sums(graph.edges.sparkSession, g, sources, x=x), F.col("t"))
    x = cut(states.select("v", "x").filter("x is not null"))
    low = x.agg(F.min("x").alias("low"))  # a source no higher than all others adds nothing
    sources = graph.arcs.select(F.col("src").alias("v")).distinct().join(x, "v").crossJoin(F.broadcast(low)).filter("x > low").select(F.col("v").alias("s"))
    xs, xv = x.withColumnsRenamed({"v": "s", "x": "xs"}), x.withColumnRenamed("x", "xv")
    weigh = lambda level: level.join(xs, "s").join(xv, "v").select("s", "v", "d", "sigma", "delta", ramp(F.col("xs"), F.col("xv")).alias("r"))
    sums = _dependencies(graph, sources, weigh, batches).groupBy("v").agg(F.sum("delta").alias("t"))
    return _with_all(graph, sums, F.col("t"))


def target(graph: Graph, states: DataFrame, batches: int = 1) -> DataFrame:
    """(v, pc): target_unnormalised() over the sum of all ramps; null where all states are equal."""
    own = states.join(graph.vertices, "v", "left_semi")
    return target_unnormalised(graph, own, batches).crossJoin(F.broadcast(kappa_total(own))).select("v", F.try_divide("pc", "total").alias("pc"))


def target_per_vertex(graph: Graph, states: DataFrame, batches: int = 1) -> DataFrame:
    """(v, pc): target_unnormalised() over the sum of the ramps of pairs without v."""
    own = states.join(graph.vertices, "v", "left_semi")
    return target_unnormalised(graph, own, batches).join(kappa_sums(own), "v").select("v", F.try_divide("pc", "minus_sum").alias("pc"))


def classical(graph: Graph, states: DataFrame, normalization: str = "none", batches: int = 1) -> DataFrame:
    """(v, pc): sum over s of v's dependency on s, times x_s / (sum of states - x_v); normalization: none, n-2 or n(n-1)."""
    graph = graph.pinned()
    own = cut(states.join(graph.vertices, "v", "left_semi").select("v", "x"))
    ones = lambda level: level.select("s", "v", "d", "sigma", "delta", F.lit(1.0).alias("r"))
    sources = own.filter("x > 0").select(F.col("v").alias("s"))
    g = graph.compact
    if g is not None:
        x = _state_array(g, own)
        at = np.flatnonzero(x > 0)
        sums = blocks.dependency_sums(own.sparkSession, g, at, weight=x[at])
    else:
        sums = _dependencies(graph, sources, ones, batches).join(own.withColumnsRenamed({"v": "s", "x": "xs"}), "s").groupBy("v").agg(F.sum(F.col("delta") * F.col("xs")).alias("t"))
    whole = own.agg(F.sum("x").alias("total"), F.count(F.lit(1)).cast("double").alias("n"))
    by = {"none": F.lit(1.0), "n-2": F.col("n") - 2, "n(n-1)": F.col("n") * (F.col("n") - 1)}[normalization]
    raw = own.join(sums, "v", "left").crossJoin(F.broadcast(whole))
    return raw.select("v", F.try_divide(F.try_divide(F.coalesce("t", F.lit(0.0)), F.col("total") - F.col("x")), by).alias("pc"))


def betweenness(graph: Graph, batches: int = 1) -> DataFrame:
    """(v, pc): sum over ordered pairs of the share of shortest paths through v; what target() falls back to for equal states."""
    graph = graph.pinned()
    if graph.compact is not None:
        return _with_all(graph, blocks.dependency_sums(graph.edges.sparkSession, graph.compact, np.arange(len(graph.compact.ids))), F.col("t"))
    ones = lambda level: level.select("s", "v", "d", "sigma", "delta", F.lit(1.0).alias("r"))
    sums = _dependencies(graph, graph.vertices.withColumnRenamed("v", "s"), ones, batches).groupBy("v").agg(F.sum("delta").alias("t"))
    return _with_all(graph, sums, F.col("t"))


def betweenness_and_target(graph: Graph, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """betweenness() and target(), from the same searches where the graph fits in a task."""
    graph = graph.pinned()
    g = graph.compact
    if g is None:
        return betweenness(graph), target(graph, states)
    own = cut(states.join(graph.vertices, "v", "left_semi"))
    sums = cut(blocks.dependency_sums(graph.edges.sparkSession, g, np.arange(len(g.ids)), x=_state_array(g, own), plain=True))
    score = _with_all(graph, sums, F.col("t")).crossJoin(F.broadcast(kappa_total(own))).select("v", F.try_divide("pc", "total").alias("pc"))
    return _with_all(graph, sums, F.col("plain")), score


def induced_target(graph: Graph, states: DataFrame, subset: DataFrame) -> DataFrame:
    """target() of the subgraph on the vertices of ``subset``."""
    return target(induced(graph, subset), states.join(subset, "v", "left_semi"))


def exact_report(graph: Graph, states: DataFrame) -> DataFrame:
    """(v, pc, unnormalised, total, d_v): all that an exact run gives."""
    own = states.join(graph.vertices, "v", "left_semi")
    k = kappa_sums(own)
    return target_unnormalised(graph, own).join(k, "v").select("v", F.try_divide("pc", "total").alias("pc"), F.col("pc").alias("unnormalised"), "total", F.try_divide("total", "minus_sum").alias("d_v"))
