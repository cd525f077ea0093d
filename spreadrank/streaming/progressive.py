"""Progressive estimators: samples come in growing increments, sums are carried on, a bound on the deviation says when to stop.

What is carried are aggregates: one row for each vertex (and trial), never the samples. The driver sees bounds and counts only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadrank.functions import bounds as B
from spreadrank.functions.lineage import cut
from spreadrank.operators.estimate import diameter
from spreadrank.operators.graph import Graph
from spreadrank.operators.sampling import kappa_pairs, pair_fractions, path_hits, sign, uniform_pairs, weighted
from spreadrank.operators.states import kappa_total
from spreadrank.operators.traverse import union_all


@dataclass
class Progress:
    """scores (v, pc), how many samples, the bound reached and the most samples that were allowed."""

    scores: DataFrame
    samples: int
    xi: float
    limit: float


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("v").agg(F.sum("f").alias("t"), F.sum(F.col("f") * F.col("f")).alias("t2"))


def _add(old: DataFrame | None, new: DataFrame, by: list[str]) -> DataFrame:
    if old is None:
        return cut(new)
    values = [c for c in new.columns if c not in by]
    return cut(old.unionByName(new).groupBy(*by).agg(*[F.sum(c).alias(c) for c in values]))


def _scores(graph: Graph, sums: DataFrame, samples: int, factor: float = 1.0) -> DataFrame:
    return graph.vertices.join(sums, "v", "left").select("v", (F.coalesce("t", F.lit(0.0)) * F.lit(factor) / samples).alias("pc"))


def peeling(graph: Graph, sums: DataFrame, samples: int, base: float = 2.0) -> DataFrame:
    """(v, part): classes of vertices by wimpy variance (sum of squares over samples), larger variances first."""
    w = graph.vertices.join(sums, "v", "left").select("v", (F.coalesce("t2", F.lit(0.0)) / samples).alias("w"))
    inverse = F.when(F.col("w") > 0, F.least(1 / F.nullif(F.col("w"), F.lit(0.0)), F.lit(float(samples)))).otherwise(F.lit(float(samples)))
    return w.select("v", (F.log(inverse) / math.log(base) + 1).cast("int").alias("part"))


def rademacher_sums(rows: DataFrame, trials: int) -> DataFrame:
    """(v, trial, t): sums of f with a sign drawn for each sample and trial."""
    each = rows.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    return each.groupBy("v", "trial").agg(F.sum(F.col("f") * sign(F.col("sample"), F.col("trial"))).alias("t"))


def mcera_bound(parts: DataFrame, sums: DataFrame, signed: DataFrame, samples: int, trials: int, delta: float) -> float:
    """The largest part's deviation bound; vertices and trials without a sample count as 0."""
    top = parts.join(sums, "v", "left").groupBy("part").agg(F.max(F.coalesce("t2", F.lit(0.0))).alias("w"), F.count(F.lit(1)).alias("n"))
    by_trial = parts.join(signed, "v").groupBy("part", "trial").agg(F.max("t").alias("m"), F.count(F.lit(1)).alias("k"))
    sup = by_trial.join(top.select("part", "n"), "part").select("part", F.when(F.col("k") < F.col("n"), F.greatest("m", F.lit(0.0))).otherwise(F.col("m")).alias("m"))
    mean = sup.groupBy("part").agg((F.sum("m") / trials).alias("m"))
    rows = top.join(mean, "part", "left").select("w", F.coalesce("m", F.lit(0.0)).alias("m")).collect()  # a row for each part
    return max((B.mcera_eps(r["w"] / samples, r["m"] / samples, delta / len(rows), samples, trials) for r in rows), default=0.0)


def progressive_mcera(graph: Graph, states: DataFrame, eps: float, delta: float, share: float = 0.1, trials: int = 25, base: float = 2.0, diameter_sources: int = 256, bootstrap_only: bool = False) -> Progress:
    """Kappa pairs, max(1, share of paths) each, until the Monte Carlo Rademacher bound is eps or the sample bound is reached.

    A bootstrap gives variance classes, the bound on samples and the first size; its samples are not used again.
    """
    graph = graph.pinned()
    own = cut(states.join(graph.vertices, "v", "left_semi").select("v", "x"))
    across = max(2, diameter(graph, diameter_sources) + 1)
    tau = B.bootstrap_size(eps, delta, across)
    draw = lambda count, first: cut(path_hits(graph, kappa_pairs(own, count, first), share))
    rows = draw(tau, 0)
    sums = cut(_sums(rows))
    parts = cut(peeling(graph, sums, tau, base))
    top, wide = sums.agg(F.coalesce(F.max("t"), F.lit(0.0)), F.coalesce(F.max("t2"), F.lit(0.0))).first()

    def limit(top: float, wide: float, count: int, share_of_delta: float, whole: float, length: DataFrame) -> float:
        """The bound on samples at delta ``whole``, from estimates that hold at ``share_of_delta`` each."""
        histogram = {int(r["k"]): r["n"] for r in length.collect()}  # a row for each length
        mean = B.mean_length_bound(share_of_delta, across, histogram, count)
        return B.samples_bound(max(B.top1_bound(top / count, share_of_delta, count), 1e-12), B.top1_bound(wide / count, share_of_delta, count), max(mean, 1e-12), eps, whole)

    lengths = lambda rows: rows.groupBy("sample").agg(F.round(F.sum("f")).cast("int").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    most = limit(top, wide, tau, delta / 8, delta / 2, lengths(rows)) or B.vc_bound(eps, delta, across)
    if bootstrap_only:
        return Progress(_scores(graph, sums, tau), tau, math.inf, most)
    size, done, sums, signed, hist, xi, iteration = float(max(1, B.first_stop(eps, delta, most, wide / tau + 1 / tau))), 0, None, None, None, math.inf, 1
    while True:
        count = int(size) - done
        if count > 0:
            rows = draw(count, tau + done)
            sums, signed = _add(sums, _sums(rows), ["v"]), _add(signed, rademacher_sums(rows, trials), ["v", "trial"])
            hist = _add(hist, lengths(rows), ["k"])
            done += count
        if done >= most:
            break
        xi = mcera_bound(parts, sums, signed, done, trials, delta / 2**iteration)
        if xi <= eps:
            break
        top, wide = sums.agg(F.coalesce(F.max("t"), F.lit(0.0)), F.coalesce(F.max("t2"), F.lit(0.0))).first()
        most = min(most, limit(top, wide, done, delta / 2**iteration, delta / 2**iteration, hist))
        size, iteration = B.next_sample(size), iteration + 1
    return Progress(_scores(graph, sums, done), done, xi, most)


def _rows(graph: Graph, own: DataFrame, count: int, first: int) -> DataFrame:
    """(sample, v, f) of uniform pairs: exact shares times ramp / total."""
    pairs = uniform_pairs(own.select("v"), count, first)
    x = own.select("v", "x")
    useful = cut(pairs.join(x.withColumnsRenamed({"v": "s", "x": "xs"}), "s").join(x.withColumnsRenamed({"v": "z", "x": "xz"}), "z").filter("xs > xz").select("sample", "s", "z"))
    return cut(weighted(pair_fractions(graph, useful), useful, own, kappa_total(own)))


def progressive_era(graph: Graph, states: DataFrame, eps: float, delta: float, factor: float = 1.2, first: int = 0, vc_limit: bool = True, b_scale: float | None = None, diameter_sources: int = 256, rounds: int = 50) -> Progress:
    """Uniform pairs, exact shares, until Massart's bound over the distinct sums of squares is eps (or the VC bound of samples is reached)."""
    graph = graph.pinned()
    own = cut(states.join(graph.vertices, "v", "left_semi").select("v", "x"))
    n = own.count()
    limit = B.vc_bound(eps, delta, max(2, diameter(graph, diameter_sources) + 1)) if vc_limit else math.inf
    start = first or B.first_sample(eps, delta)
    done, sums, xi = 0, None, math.inf
    for k in range(1, rounds + 1):
        size = min(start if k == 1 else math.floor(start * factor**k), limit)
        if size > done:
            sums = _add(sums, _sums(_rows(graph, own, int(size - done), done)), ["v"])
            done = int(size)
        squares = [r[0] for r in sums.select("t2").distinct().sort("t2").collect()] if sums.count() <= 1_000_000 else [sums.agg(F.max("t2")).first()[0]] * sums.count()
        xi = B.era_xi(squares, done, delta, k, float(n) * (n - 1) if b_scale is None else b_scale) if squares else math.inf
        if xi <= eps or done >= limit:
            break
    return Progress(_scores(graph, sums, done, float(n) * (n - 1)), done, xi, limit)


def variances(graph: Graph, sums: DataFrame, samples: int) -> DataFrame:
    """(v, variance) of f over all samples; a sample that has no row for v counts as 0."""
    t, t2 = F.coalesce("t", F.lit(0.0)), F.coalesce("t2", F.lit(0.0))
    return graph.vertices.join(sums, "v", "left").select("v", (F.greatest(t2 - t * t / samples, F.lit(0.0)) / (samples - 1)).alias("variance"))


def bernstein_bound(graph: Graph, sums: DataFrame, samples: int, eta: float) -> float:
    """The largest vertex's empirical Bernstein error."""
    top, n = variances(graph, sums, samples).agg(F.max("variance"), F.count(F.lit(1))).first()
    return B.bernstein_error(top, n, samples, eta)


def progressive_bernstein(graph: Graph, states: DataFrame, eps: float, delta: float, factor: float = 1.2, first: int = 0, rounds: int = 30, diameter_sources: int = 256) -> Progress:
    """Kappa pairs, exact shares, until the empirical Bernstein error is eps (or the VC bound of samples is reached)."""
    graph = graph.pinned()
    own = cut(states.join(graph.vertices, "v", "left_semi").select("v", "x"))
    limit = B.vc_bound(eps, delta, max(2, diameter(graph, diameter_sources) + 1))
    size, done, sums, xi = float(first or B.first_sample(eps, delta)), 0, None, math.inf
    for k in range(1, rounds + 1):
        size = min(size, limit)
        count = int(size) - done
        sums = _add(sums, _sums(pair_fractions(graph, kappa_pairs(own, count, done))), ["v"]) if count > 0 else sums
        done += max(count, 0)
        xi = bernstein_bound(graph, sums, done, delta / 2**k)
        if xi <= eps or done >= limit:
            break
        size *= factor
    return Progress(_scores(graph, sums, done), done, xi, limit)


__all__ = ["Progress", "progressive_bernstein", "progressive_era", "progressive_mcera", "union_all"]
