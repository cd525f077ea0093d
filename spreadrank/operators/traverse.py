"""Breadth-first traversal in levels: distances, shortest-path counts, eccentricities and drawn paths.

A level is a table (s, v, d, sigma): the vertices at distance d from each source with their number of shortest paths. The next level is
one join with the arcs, one aggregate and one anti join with what has been seen; each is checkpointed. Graphs that fit in a task are
searched there instead (``blocks``), with the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadrank.functions.draws import uniform
from spreadrank.functions.lineage import cut
from spreadrank.operators import blocks
from spreadrank.operators.graph import Graph


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def levels(graph: Graph, sources: DataFrame, max_distance: int | None = None, targets: DataFrame | None = None) -> list[DataFrame]:
    """Levels from each source (s). targets (s, z): a source's search ends with the level that holds its z; sources are then sample ids
    with their start in ``v``."""
    first = sources.select("s", "v") if "v" in sources.columns else sources.select("s", F.col("s").alias("v"))
    out = [cut(first.select("s", "v", F.lit(0).alias("d"), F.lit(1.0).alias("sigma")))]
    while max_distance is None or len(out) <= max_distance:
        front = out[-1]
        if targets is not None:
            front = front.join(targets.join(front.select("s", F.col("v").alias("z")), ["s", "z"]).select("s"), "s", "left_anti")
        near = front.join(graph.arcs, front.v == graph.arcs.src).groupBy("s", F.col("dst").alias("v")).agg(F.sum("sigma").alias("sigma"))
        seen = union_all([x.select("s", "v") for x in (out[-2:] if not graph.directed else out)])  # neighbours of a level are at most one level back
        new = cut(near.join(seen, ["s", "v"], "left_anti").select("s", "v", F.lit(len(out)).alias("d"), "sigma"))
        if new.isEmpty():
            break
        out.append(new)
    return out


def shortest_paths(graph: Graph, sources: DataFrame | None = None) -> DataFrame:
    """(s, v, d, sigma) of all vertices that each source reaches, itself included."""
    sources = sources if sources is not None else graph.vertices.withColumnRenamed("v", "s")
    if graph.compact is not None:
        return blocks.paths_from(graph.compact, sources)
    return union_all(levels(graph, sources.filter("s is not null")))


def nearest_source(graph: Graph, sources: DataFrame, max_distance: int | None = None) -> DataFrame:
    """(v, d): distance of each vertex from the nearest of the sources (v)."""
    one = sources.select(F.lit(0).alias("s"), "v").distinct()
    return union_all(levels(graph, one, max_distance)).select("v", "d")


def sample_sources(graph: Graph, k: int, stream: int = 30) -> DataFrame:
    """(s): k drawn vertices without replacement; all of them for k = 0."""
    if not k:
        return graph.vertices.withColumnRenamed("v", "s")
    return graph.vertices.orderBy(uniform(F.col("v"), stream), "v").limit(k).select(F.col("v").alias("s"))


def distance_histogram(paths: DataFrame) -> DataFrame:
    """(d, pairs)."""
    return paths.groupBy("d").agg(F.count(F.lit(1)).alias("pairs"))


def eccentricity(paths: DataFrame) -> DataFrame:
    """(v, ecc): the largest distance from v."""
    return paths.groupBy(F.col("s").alias("v")).agg(F.max("d").alias("ecc"))


def distance_summary(graph: Graph, paths: DataFrame) -> DataFrame:
    """(diameter, reachable, connectivity, mean_distance, rho_legacy) from the searched sources.

    reachable: ordered pairs of different vertices; connectivity: their share of those that n vertices would have; rho_legacy: the mean that
    earlier implementations give, which counts a step too few.
    """
    h = distance_histogram(paths)
    n = graph.vertices.agg(F.count(F.lit(1)).alias("n"))
    steps = F.when(F.col("d") > 0, F.col("pairs")).otherwise(0)
    sums = h.agg(F.max("d").alias("diameter"), F.sum(steps).alias("reachable"), F.sum(F.col("d") * F.col("pairs")).alias("walked"), F.sum(F.when(F.col("d") == 0, F.col("pairs")).otherwise(0)).alias("sources"))
    out = sums.crossJoin(n)
    return out.select(
        "diameter",
        "reachable",
        F.try_divide(F.col("reachable").cast("double"), F.col("sources") * (F.col("n") - 1)).alias("connectivity"),
        F.try_divide(F.col("walked").cast("double"), F.col("reachable")).alias("mean_distance"),
        F.try_divide((F.col("walked") - F.col("reachable")).cast("double"), F.col("reachable") + F.col("sources")).alias("rho_legacy"),
    )


def hop_table(paths: DataFrame) -> DataFrame:
    """(d, within): pairs at distance d at most."""
    return distance_histogram(paths).select("d", F.sum("pairs").over(Window.orderBy("d")).alias("within"))  # a row for each distance


def distances_of_hops(hops: DataFrame) -> DataFrame:
    """(d, pairs) again, from (d, within)."""
    return hops.select("d", (F.col("within") - F.lag("within", 1, 0).over(Window.orderBy("d"))).alias("pairs"))


def mean_of_hops(hops: DataFrame) -> DataFrame:
    """(mean_distance) of different vertices, from (d, within)."""
    h = distances_of_hops(hops).filter("d > 0")
    return h.agg(F.try_divide(F.sum(F.col("d") * F.col("pairs")).cast("double"), F.sum("pairs")).alias("mean_distance"))


def accumulate(graph: Graph, found: list[DataFrame], weigh) -> DataFrame:
    """(s, v, delta): dependencies, from the last level back to the first.

    ``weigh`` adds a column r, the worth of reaching v from s, to a level. delta(s, v) = sum over the next level's w that v leads to of
    sigma(v) / sigma(w) * (r(w) + delta(w)).
    """
    out, later = [], None
    for level in reversed(found):
        if later is None:
            own = level.withColumn("delta", F.lit(0.0))
        else:
            back = later.join(graph.arcs, later.v == graph.arcs.dst).select("s", F.col("src").alias("p"), ((F.col("r") + F.col("delta")) / F.col("sigma")).alias("part"))
            sums = back.groupBy("s", "p").agg(F.sum("part").alias("part"))  # the join below leaves those of this level
            own = level.join(sums.withColumnRenamed("p", "v"), ["s", "v"], "left").select("s", "v", "d", "sigma", F.coalesce(F.col("sigma") * F.col("part"), F.lit(0.0)).alias("delta"))
        later = cut(weigh(own))
        out.append(later.filter("d > 0").select("s", "v", "delta"))
    return union_all(out)


def paths_to_targets(graph: Graph, samples: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Levels of each sample's (sample, s, z) search, ended at z, and (sample, v, d, sigma_s, sigma_z) of the vertices on its shortest paths."""
    samples = cut(samples.select("sample", "s", "z"))
    found = levels(graph, samples.select(F.col("sample").alias("s"), F.col("s").alias("v")), targets=samples.select(F.col("sample").alias("s"), "z"))
    hits = cut(union_all(found).join(samples.select(F.col("sample").alias("s"), F.col("z").alias("v")), ["s", "v"]))
    step, out = None, []
    for level in reversed(found):
        own = level.join(hits.select("s", "v"), ["s", "v"], "left_semi").withColumn("back", F.lit(1.0))
        if step is not None:
            prior = step.join(graph.arcs, step.v == graph.arcs.dst).select("s", F.col("src").alias("v"), "back").groupBy("s", "v").agg(F.sum("back").alias("back"))
            own = own.unionByName(level.join(prior, ["s", "v"]).select("s", "v", "d", "sigma", "back"))
        step = cut(own.select("s", "v", "d", "sigma", "back"))
        out.append(step)
    return found, union_all(out).select(F.col("s").alias("sample"), "v", "d", F.col("sigma").alias("sigma_s"), F.col("back").alias("sigma_z"))


def draw_paths(graph: Graph, samples: DataFrame, stream: Column | int = 50) -> DataFrame:
    """(sample, v, d): inner vertices of one shortest path for each (sample, s, z) that has one, each path equally likely.

    From z back to s: of the predecessors, in order of id, the one whose run of path counts holds the draw for (sample, distance).
    """
    if graph.compact is not None:
        return blocks.drawn(graph.compact, samples, F.lit(stream) if isinstance(stream, int) else stream)
    samples = cut(samples.select("sample", "s", "z"))
    _, on = paths_to_targets(graph, samples)
    on = cut(on)
    at = on.join(samples.select("sample", F.col("z").alias("v")), ["sample", "v"]).select("sample", "v", "d", "sigma_s")
    out = []
    while True:
        prior = at.join(graph.arcs, at.v == graph.arcs.dst).select("sample", F.col("src").alias("v"), (F.col("d") - 1).alias("d"), F.col("sigma_s").alias("whole"))
        ways = prior.join(on.select("sample", "v", "d", "sigma_s"), ["sample", "v", "d"])
        run = F.sum("sigma_s").over(Window.partitionBy("sample").orderBy("v"))
        u = uniform(F.col("sample"), F.col("d") + F.lit(stream)) * F.col("whole")
        chosen = ways.withColumn("run", run).filter((u >= F.col("run") - F.col("sigma_s")) & (u < F.col("run"))).filter("d > 0")
        at = cut(chosen.select("sample", "v", "d", "sigma_s"))
        if at.isEmpty():
            break
        out.append(at.select("sample", "v", "d"))
    return union_all(out) if out else on.limit(0).select("sample", "v", "d")
