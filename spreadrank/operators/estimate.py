"""Estimators of target centrality from a given number of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadrank.functions.bounds import vc_bound
from spreadrank.functions.lineage import cut
from spreadrank.operators.graph import Graph
from spreadrank.operators.sampling import kappa_pairs, pair_fractions, path_hits, uniform_pairs, weighted
from spreadrank.operators.states import kappa_total, per_vertex_normalised
from spreadrank.operators.traverse import distance_histogram, sample_sources, shortest_paths


def _mean(graph: Graph, rows: DataFrame, samples: int, factor=None) -> DataFrame:
    sums = rows.groupBy("v").agg(F.sum("f").alias("t"))
    by = F.lit(1.0) if factor is None else factor
    return graph.vertices.join(sums, "v", "left").select("v", (F.coalesce("t", F.lit(0.0)) * by / samples).alias("pc"))


def estimate_kappa(graph: Graph, states: DataFrame, samples: int, exact_pairs: bool = False, share: float = 0.0, first: int = 0, per_vertex: bool = False) -> DataFrame:
    """(v, pc): mean over kappa pairs of a drawn path's hits, or of the exact share of paths with ``exact_pairs``. per_vertex: over the ramps of
    pairs without v, as target_per_vertex() has it."""
    own = states.join(graph.vertices, "v", "left_semi")
    pairs = kappa_pairs(own, samples, first)
    scores = _mean(graph, pair_fractions(graph, pairs) if exact_pairs else path_hits(graph, pairs, share), samples)
    return per_vertex_normalised(scores, own) if per_vertex else scores


def estimate_uniform(graph: Graph, states: DataFrame, samples: int, exact_pairs: bool = False, share: float = 0.0, first: int = 0, per_vertex: bool = False) -> DataFrame:
    """(v, pc): the same from uniform pairs, each weighed by n (n - 1) ramp / total; pairs without a ramp are not searched."""
    own = states.join(graph.vertices, "v", "left_semi")
    pairs = uniform_pairs(own.select("v"), samples, first)
    x = own.select("v", "x")
    useful = cut(pairs.join(x.withColumnsRenamed({"v": "s", "x": "xs"}), "s").join(x.withColumnsRenamed({"v": "z", "x": "xz"}), "z").filter("xs > xz").select("sample", "s", "z"))
    rows = weighted(pair_fractions(graph, useful) if exact_pairs else path_hits(graph, useful, share), useful, own, kappa_total(own))
    n = graph.vertices.count()
    scores = _mean(graph, rows, samples, F.lit(float(n) * (n - 1)))
    return per_vertex_normalised(scores, own) if per_vertex else scores


def diameter(graph: Graph, sources: int = 0) -> int:
    """The largest distance found from so many drawn sources (0: all)."""
    return distance_histogram(shortest_paths(graph, sample_sources(graph, sources))).agg(F.max("d")).first()[0] or 0


def estimate_fixed(graph: Graph, states: DataFrame, eps: float, delta: float, law: str = "kappa", diameter_sources: int = 256) -> DataFrame:
    """(v, pc, samples): one path for each of as many pairs as the VC bound asks for."""
    samples = vc_bound(eps, delta, max(2, diameter(graph, diameter_sources) + 1))
    run = estimate_kappa if law == "kappa" else estimate_uniform
    return run(graph, states, samples).withColumn("samples", F.lit(samples).cast("long"))
