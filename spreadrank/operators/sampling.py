"""Pair and path samples. A sample is a row (sample, s, z); what it says of vertices are rows (sample, v, f)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadrank.functions.draws import uniform
from spreadrank.functions.lineage import cut
from spreadrank.operators import blocks
from spreadrank.operators.graph import Graph, dense_ids
from spreadrank.operators.states import outgoing_mass, ramp, ranked
from spreadrank.operators.traverse import draw_paths, paths_to_targets


def _ids(vertices: DataFrame, samples: int, first: int) -> DataFrame:
    return vertices.sparkSession.range(first, first + samples).withColumnRenamed("id", "sample")


def uniform_pairs(vertices: DataFrame, samples: int, first: int = 0) -> DataFrame:
    """(sample, s, z): ordered pairs of different vertices, all equally likely; z is drawn among the n - 1 that follow s in a ring."""
    ids = dense_ids(vertices)
    n = ids.agg(F.count(F.lit(1)).alias("n"))
    drawn = _ids(vertices, samples, first).crossJoin(F.broadcast(n)).filter("n > 1")
    drawn = drawn.withColumn("i", F.floor(uniform(F.col("sample"), 0) * F.col("n")))
    drawn = drawn.withColumn("k", F.pmod(F.col("i") + 1 + F.floor(uniform(F.col("sample"), 1) * (F.col("n") - 1)), F.col("n")))
    return drawn.join(ids.select(F.col("id").alias("i"), F.col("v").alias("s")), "i").join(ids.select(F.col("id").alias("k"), F.col("v").alias("z")), "k").select("sample", "s", "z")


def _bucketed(points: DataFrame, intervals: DataFrame, t: str, low: str, high: str, whole: str, buckets: int) -> DataFrame:
    """Rows of points and intervals with low <= t < high, by equi-join: [0, whole) is cut into buckets, an interval goes to all it meets."""
    cell = lambda c: F.least(F.floor(F.col(c) / F.col(whole) * buckets), F.lit(buckets - 1))
    wide = intervals.withColumn("cell", F.explode(F.sequence(cell(low), cell(high)))).drop(whole)
    return points.withColumn("cell", cell(t)).join(wide, "cell").filter((F.col(t) >= F.col(low)) & (F.col(t) < F.col(high))).drop("cell")


def kappa_sources(states: DataFrame, samples: int, first: int = 0, stream: int = 2, buckets: int = 4096) -> DataFrame:
    """(sample, s, xs, mass, over): sources with probability mass / total, by inverse CDF over vertices in the order of (x, v). over: what of
    the draw is left in the source's own mass.

    Vertices with equal states have equal masses: the draw finds their group's interval, then the place in it.
    """
    groups = ranked(states).withColumn("mass", F.col("x") * F.col("j") - F.col("s")).filter("mass > 0")
    cells = groups.withColumn("g", F.floor(F.col("x") * buckets))
    sums = cells.groupBy("g").agg(F.sum(F.col("c") * F.col("mass")).alias("m"))
    before = sums.select("g", (F.sum("m").over(Window.orderBy("g")) - F.col("m")).alias("m0"), F.sum("m").over(Window.partitionBy()).alias("total"))  # a row for each cell
    run = F.sum(F.col("c") * F.col("mass")).over(Window.partitionBy("g").orderBy("x"))
    cdf = cells.withColumn("run", run).join(F.broadcast(before), "g").select("x", "mass", (F.col("m0") + F.col("run") - F.col("c") * F.col("mass")).alias("low"), (F.col("m0") + F.col("run")).alias("high"), "total")
    total = sums.agg(F.sum("m").alias("total"))
    points = _ids(states, samples, first).crossJoin(F.broadcast(total)).withColumn("t", uniform(F.col("sample"), stream) * F.col("total"))
    hit = _bucketed(points, cdf, "t", "low", "high", "total", buckets).withColumn("r", F.floor((F.col("t") - F.col("low")) / F.col("mass")))
    place = states.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy("v")) - 1).select("x", "r", F.col("v").alias("s"))
    sizes = groups.select("x", (F.col("c") - 1).alias("last"))
    hit = hit.join(sizes, "x").withColumn("r", F.least("r", "last"))
    over = F.greatest(F.lit(0.0), F.col("t") - F.col("low") - F.col("r") * F.col("mass"))
    return hit.join(place, ["x", "r"]).select("sample", "s", F.col("x").alias("xs"), "mass", over.alias("over"))


def kappa_pairs(states: DataFrame, samples: int, first: int = 0, cells: int = 1024) -> DataFrame:
    """(sample, s, z): pairs with probability ramp(x_s, x_z) / total.

    z by inverse CDF over the vertices below s in the order of (x, v). The CDF at a group of equal states is j x_s - sum of
    smaller states, so the cell of states that holds the draw is found in a table of ``cells`` rows, the group by equi-join on the cell.
    """
    source = kappa_sources(states, samples, first).withColumn("t", uniform(F.col("sample"), 3) * F.col("mass"))
    return _targets(states, source, cells)


def _targets(states: DataFrame, source: DataFrame, cells: int) -> DataFrame:
    """(sample, s, z) from (sample, s, xs, t): the vertex below s whose run of ramps, in the order of (x, v), holds t."""
    groups = ranked(states).withColumn("g", F.floor(F.col("x") * cells))
    starts = groups.groupBy("g").agg(F.min(F.struct("x", "j", "s")).alias("a")).select("g", F.col("a.x").alias("x0"), F.col("a.j").alias("j0"), F.col("a.s").alias("s0"))
    reached = source.join(F.broadcast(starts), (F.col("x0") < F.col("xs")) & (F.col("j0") * F.col("xs") - F.col("s0") <= F.col("t")))
    cell = reached.groupBy("sample", "s", "xs", "t").agg(F.max("g").alias("g"))
    near = cell.join(groups.select("g", F.col("x").alias("xz"), "c", "j", F.col("s").alias("sum")), "g").filter((F.col("xz") < F.col("xs")) & (F.col("j") * F.col("xs") - F.col("sum") <= F.col("t")))
    group = near.groupBy("sample", "s", "xs", "t").agg(F.max(F.struct("xz", "c", "j", "sum")).alias("m")).select("sample", "s", "xs", "t", "m.*")
    at = group.withColumn("r", F.least(F.floor((F.col("t") - (F.col("j") * F.col("xs") - F.col("sum"))) / (F.col("xs") - F.col("xz"))), F.col("c") - 1))
    place = states.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy("v")) - 1).select(F.col("x").alias("xz"), "r", F.col("v").alias("z"))
    return at.join(place, ["xz", "r"]).select("sample", "s", "z")


def kappa_pairs_listed(states: DataFrame, samples: int, first: int = 0) -> DataFrame:
    """kappa law with one draw a sample, on the list of all pairs with a positive ramp in the order of (x_s, s, x_z, z): (sample, s, z).

    The list is not made: a source's pairs follow one another and their ramps add up to its mass, so the draw falls into the run of a
    source's mass, and what is left of it into a pair of that source.
    """
    source = kappa_sources(states, samples, first)
    return _targets(states, source.withColumn("t", F.col("over")), 1024)


def uniform_source_pairs(states: DataFrame, samples: int, first: int = 0) -> DataFrame:
    """Another law: s uniform among the vertices above the least state, z with probability ramp(x_s, x_z) / mass of s."""
    able = outgoing_mass(states).filter("mass > 0")
    ids = dense_ids(able.select("v"))
    n = ids.agg(F.count(F.lit(1)).alias("n"))
    source = _ids(states, samples, first).crossJoin(F.broadcast(n)).withColumn("id", F.floor(uniform(F.col("sample"), 2) * F.col("n"))).join(ids, "id").join(able, "v").select("sample", F.col("v").alias("s"), F.col("x").alias("xs"), (uniform(F.col("sample"), 3) * F.col("mass")).alias("t"))
    groups = ranked(states)
    near = source.join(groups.select(F.col("x").alias("xz"), "c", "j", F.col("s").alias("sum")), (F.col("xz") < F.col("xs")) & (F.col("j") * F.col("xs") - F.col("sum") <= F.col("t")))
    group = near.groupBy("sample", "s", "xs", "t").agg(F.max(F.struct("xz", "c", "j", "sum")).alias("m")).select("sample", "s", "xs", "t", "m.*")
    at = group.withColumn("r", F.least(F.floor((F.col("t") - (F.col("j") * F.col("xs") - F.col("sum"))) / (F.col("xs") - F.col("xz"))), F.col("c") - 1))
    place = states.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy("v")) - 1).select(F.col("x").alias("xz"), "r", F.col("v").alias("z"))
    return at.join(place, ["xz", "r"]).select("sample", "s", "z")


def pair_fractions(graph: Graph, pairs: DataFrame) -> DataFrame:
    """(sample, v, f): the share of shortest s-z paths with v inside, for each sample whose z can be reached."""
    if graph.compact is not None:
        return blocks.fractions(graph.compact, pairs)
    samples = cut(pairs.filter("s <> z"))
    _, on = paths_to_targets(graph, samples)
    whole = on.join(samples.select("sample", F.col("z").alias("v")), ["sample", "v"]).select("sample", F.col("sigma_s").alias("whole"), F.col("d").alias("length"))
    inner = on.join(whole, "sample").filter((F.col("d") > 0) & (F.col("d") < F.col("length")))
    return inner.select("sample", "v", (F.col("sigma_s") * F.col("sigma_z") / F.col("whole")).alias("f"))


def path_hits(graph: Graph, pairs: DataFrame, share: float = 0.0, most: int = 1 << 20) -> DataFrame:
    """(sample, v, f): the share of drawn paths with v inside. One path a pair, or max(1, floor(share * paths there are)) of them."""
    samples = cut(pairs.filter("s <> z"))
    if not share:
        return draw_paths(graph, samples).select("sample", "v", F.lit(1.0).alias("f"))
    if graph.compact is not None:
        return blocks.shares(graph.compact, samples, share, most)
    _, on = paths_to_targets(graph, samples)
    counts = on.join(samples.withColumnRenamed("z", "v"), ["sample", "v"]).select("sample", "s", F.col("v").alias("z"), F.greatest(F.lit(1), F.floor(F.lit(float(share)) * F.col("sigma_s"))).cast("long").alias("k"))
    each = counts.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).withColumn("one", F.col("sample") * most + F.col("p"))
    drawn = draw_paths(graph, each.select(F.col("one").alias("sample"), "s", "z"))
    return drawn.join(each.select(F.col("one").alias("sample"), F.col("sample").alias("of"), "k"), "sample").groupBy(F.col("of").alias("sample"), "v").agg((F.sum(F.lit(1.0)) / F.first("k")).alias("f"))


def weighted(rows: DataFrame, pairs: DataFrame, states: DataFrame, total: DataFrame) -> DataFrame:
    """(sample, v, f): rows with f times ramp(x_s, x_z) / total of its pair, for uniform pairs."""
    x = states.select("v", "x")
    w = pairs.join(x.withColumnsRenamed({"v": "s", "x": "xs"}), "s").join(x.withColumnsRenamed({"v": "z", "x": "xz"}), "z").crossJoin(F.broadcast(total)).select("sample", F.try_divide(ramp(F.col("xs"), F.col("xz")), F.col("total")).alias("w"))
    return rows.join(w.filter("w > 0"), "sample").select("sample", "v", (F.col("f") * F.col("w")).alias("f"))


def sign(sample, trial):
    """The Rademacher variable of a sample in a trial: the same for all its vertices."""
    return F.when(uniform(sample, trial + 1000) < 0.5, -1.0).otherwise(1.0)
