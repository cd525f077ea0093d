"""How close an estimate is to exact scores: deviations, rank overlaps, correlations and reports over runs.

Scores are (v, pc); runs are (run_id, v, pc). Rankings go by score, ties by the smaller vertex.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadrank.functions.lineage import cut

#: Blocks of ranks that pairs are counted in; their counts by pairs of blocks, 4 * BLOCKS**2 numbers at most, are added up on the driver.
BLOCKS = 512


def _both(exact: DataFrame, estimate: DataFrame) -> DataFrame:
    return exact.select("v", F.col("pc").alias("a")).join(estimate.select("v", F.col("pc").alias("b")), "v")


def sup_deviation(exact: DataFrame, estimate: DataFrame) -> DataFrame:
    return _both(exact, estimate).agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("sd"))


def mean_squared_error(exact: DataFrame, estimate: DataFrame) -> DataFrame:
    return _both(exact, estimate).agg(F.avg(F.pow(F.col("a") - F.col("b"), 2)).alias("mse"))


def top(scores: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """(by, v, rank) of the k best of each group, found in each partition first."""
    order = [F.col("pc").desc(), F.col("v")]
    if not by:
        best = scores.orderBy(*order).limit(k)
        return best.select("v", F.row_number().over(Window.orderBy(*order)).alias("rank"))
    w = Window.partitionBy(*by).orderBy(*order)
    return scores.select(*by, "v", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= k)


def min_h(exact: DataFrame, estimate: DataFrame, k: int) -> DataFrame:
    """(h): the least h so that the estimate's top h holds the exact top k: how many rank no lower than the worst of them."""
    wanted = top(exact, k).select("v").join(estimate, "v")
    worst = wanted.agg(F.min(F.struct(F.col("pc"), -F.col("v"))).alias("m")).select(F.col("m.pc").alias("p"), (-F.col("m.col2")).alias("w"))
    above = (F.col("pc") > F.col("p")) | (F.col("pc") == F.col("p")) & (F.col("v") <= F.col("w"))
    return estimate.crossJoin(F.broadcast(worst)).agg(F.sum(above.cast("long")).alias("h"))


def overlap(exact: DataFrame, estimate: DataFrame, k: int) -> DataFrame:
    """(j, common, jaccard) for each j up to k: how many vertices are in both top j."""
    spark = exact.sparkSession
    a, b = top(exact, k).withColumnRenamed("rank", "ra"), top(estimate, k).withColumnRenamed("rank", "rb")
    hits = a.join(b, "v").groupBy(F.greatest("ra", "rb").cast("long").alias("j")).agg(F.count(F.lit(1)).alias("c"))
    run = spark.range(1, k + 1).withColumnRenamed("id", "j").join(hits, "j", "left").select("j", F.sum(F.coalesce("c", F.lit(0))).over(Window.orderBy("j")).alias("common"))  # k rows
    return run.select("j", "common", (F.col("common") / (2 * F.col("j") - F.col("common"))).alias("jaccard"))


def places(values: DataFrame, c: str) -> DataFrame:
    """(c, c_n, c_before): each different value, its rows and those of smaller values. Ranges are summed first, so no task has all values."""
    n, before = f"{c}_n", f"{c}_before"
    dealt = cut(values.groupBy(c).agg(F.count(F.lit(1)).alias(n)).repartitionByRange(c).withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("part").agg(F.sum(n).alias("k"))
    first = sums.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("part_before"))  # a row for each partition
    run = F.sum(n).over(Window.partitionBy("part").orderBy(c)) - F.col(n)
    return dealt.withColumn("run", run).join(F.broadcast(first), "part").select(c, n, (F.col("part_before") + F.col("run")).alias(before))


def average_ranks(scores: DataFrame) -> DataFrame:
    """(v, r): ranks from the lowest score, the mean of their places for equals. Equal scores are counted first."""
    before = places(scores, "pc").withColumnsRenamed({"pc_n": "c", "pc_before": "before"})
    return scores.join(before, "pc").select("v", (F.col("before") + (F.col("c") + 1) / 2).alias("r"))


def inversions(y: np.ndarray, chunk: int = 256) -> int:
    """How many pairs stand in falling order, by merging sorted runs."""
    runs, total = [], 0
    for k in range(0, len(y), chunk):
        part = y[k : k + chunk]
        total += int(np.count_nonzero(np.triu(part[:, None] > part[None, :], 1)))
        runs.append(np.sort(part))
    while len(runs) > 1:
        merged = []
        for first, then in zip(runs[::2], runs[1::2], strict=False):
            total += int((len(first) - np.searchsorted(first, then, "right")).sum())
            merged.append(np.sort(np.concatenate((first, then)), kind="stable"))
        runs = merged + runs[len(runs) // 2 * 2 :]
    return total


def discordant(rows: DataFrame, n: int, blocks: int = BLOCKS) -> int:
    """How many of the pairs of ``rows`` (a_before, a_n, b_before, b_n) rise by one place and fall by the other.

    Each order is cut into blocks of n / blocks places; equals that fill a block are one of their own, within which no pair counts. Pairs of
    one a-block are counted in that block's task, others of one b-block in that one's, all others by the rows of each pair of blocks.
    """
    width = max(1024, -(-n // blocks))
    block = lambda c: (2 * F.floor(F.col(f"{c}_before") / width) + (F.col(f"{c}_n") > width).cast("int")).cast("long")
    own = cut(rows.select(F.col("a_before").alias("x"), F.col("b_before").alias("y"), block("a").alias("i"), block("b").alias("j")))

    def counted(first: str, then: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            by, y = pdf[first].to_numpy(), pdf[then].to_numpy()
            return pd.DataFrame({"k": [inversions(y[np.lexsort((y, by))])]})

        return run

    near = own.filter("i % 2 = 0").groupBy("i").applyInPandas(counted("x", "y"), "k long").unionByName(own.filter("j % 2 = 0").groupBy("j").applyInPandas(counted("i", "y"), "k long"))
    cells = own.groupBy("i", "j").agg(F.count(F.lit(1)).alias("k")).toArrow()
    at = [cells[c].to_numpy() for c in ("i", "j")]
    table = np.zeros([int(x.max()) + 1 if len(x) else 1 for x in at], np.int64)
    table[at[0], at[1]] = cells["k"].to_numpy()
    after = np.cumsum(table[::-1], axis=0)[::-1] - table  # of later a-blocks
    far = np.cumsum(after, axis=1) - after  # and of earlier b-blocks
    return int((table * far).sum()) + (near.agg(F.sum("k")).first()[0] or 0)


def tau(both: DataFrame, blocks: int = BLOCKS) -> Column:
    """Kendall's tau-b of (a, b), null if either is constant. Pairs with a null don't count."""
    pairs = lambda df, *by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("c")).agg(F.sum((F.col("c") * (F.col("c") - 1) / 2).cast("long"))).first()[0] or 0
    odd = [F.isnan(F.col(c).cast("double")) for c in "ab"]
    if both.filter(odd[0] | odd[1]).take(1):
        return F.lit(float("nan"))
    p, q = (pairs(own := both.filter(f"{c} is not null")) - pairs(own, c) for c in "ab")
    rows = both.filter("a is not null and b is not null")
    rows = cut(rows.join(places(rows, "a"), "a").join(places(rows, "b"), "b"))
    untied = pairs(rows) - pairs(rows, "a") - pairs(rows, "b") + pairs(rows, "a", "b")
    s = untied - 2 * discordant(rows, rows.count(), blocks)
    return F.try_divide(F.lit(float(s)), F.sqrt(F.lit(float(p)) * F.lit(float(q))))


def correlations(exact: DataFrame, estimate: DataFrame) -> DataFrame:
    """(pearson, spearman, kendall): Kendall's tau-b of all pairs."""
    both = cut(_both(exact, estimate))
    ranks = average_ranks(exact).withColumnRenamed("r", "a").join(average_ranks(estimate).withColumnRenamed("r", "b"), "v")
    kendall = exact.sparkSession.range(1).select(tau(both).alias("kendall"))
    return both.agg(F.corr("a", "b").alias("pearson")).crossJoin(ranks.agg(F.corr("a", "b").alias("spearman"))).crossJoin(kendall)


def error_report(exact: DataFrame, runs: DataFrame) -> DataFrame:
    """(sd, mse, sd_avg, sd_std, mse_avg, mse_std): of the runs' mean scores, and over the runs. A mean above 1 counts as 0."""
    e = exact.select("v", F.col("pc").alias("a"))
    gap = F.abs(F.col("a") - F.col("pc"))
    mean = runs.groupBy("v").agg(F.avg("pc").alias("pc")).withColumn("pc", F.when(F.col("pc") > 1, 0.0).otherwise(F.col("pc")))
    whole = mean.join(e, "v").agg(F.max(gap).alias("sd"), F.avg(gap * gap).alias("mse"))
    each = runs.join(e, "v").groupBy("run_id").agg(F.max(gap).alias("s"), F.avg(gap * gap).alias("m"))
    return whole.crossJoin(each.agg(F.avg("s").alias("sd_avg"), F.stddev_samp("s").alias("sd_std"), F.avg("m").alias("mse_avg"), F.stddev_samp("m").alias("mse_std")))


def times_report(runs: DataFrame) -> DataFrame:
    """Means and deviations of (graph, algo, time_s, sample_size, xi) records."""
    stats = [f(c).alias(f"{c}_{n}") for c in ("time_s", "sample_size", "xi") for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    return runs.groupBy("graph", "algo").agg(*stats)


def graph_report(name: str, graph, scores: DataFrame) -> DataFrame:
    """(graph, directed, nodes, edges, sum_pc, max_pc)."""
    from spreadrank.operators.graph import graph_stats

    return graph_stats(graph).crossJoin(scores.agg(F.sum("pc").alias("sum_pc"), F.max("pc").alias("max_pc"))).select(F.lit(name).alias("graph"), "directed", F.col("n_vertices").alias("nodes"), F.col("n_edges").alias("edges"), "sum_pc", "max_pc")


def distance_report(name: str, graph, summary: DataFrame, seconds: float = 0.0) -> DataFrame:
    """(graph, directed, diameter, rho, time_s)."""
    return summary.select(F.lit(name).alias("graph"), F.lit(graph.directed).alias("directed"), "diameter", F.col("mean_distance").alias("rho"), F.lit(float(seconds)).alias("time_s"))


def ranking_report(exact: DataFrame, runs: DataFrame, k: int) -> DataFrame:
    """(k, runs, intersection_mean, intersection_std, h_mean, h_std, jaccard_mean, jaccard_std) of the runs' top k."""
    best = top(exact, k).select("v")
    placed = runs.select("run_id", "v", F.row_number().over(Window.partitionBy("run_id").orderBy(F.col("pc").desc(), "v")).alias("r")).join(F.broadcast(best), "v")
    each = placed.groupBy("run_id").agg(F.sum((F.col("r") <= k).cast("long")).alias("i"), F.max("r").cast("long").alias("h"))
    each = each.withColumn("j", F.col("i") / (2 * k - F.col("i")))
    return each.agg(F.lit(k).cast("long").alias("k"), F.count(F.lit(1)).alias("runs"), *[f(c).alias(f"{n}_{m}") for c, n in (("i", "intersection"), ("h", "h"), ("j", "jaccard")) for f, m in ((F.avg, "mean"), (F.stddev_samp, "std"))])
