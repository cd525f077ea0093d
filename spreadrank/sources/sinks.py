"""Writers of states, scores, run records and edge lists. Runs are appended as typed rows with their run_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadrank.operators.graph import Graph

RUN = "run_id string, graph string, algo string, time_s double, est_time_s double, sample_size long, xi double, max_d_v double"


def write_states(states: DataFrame, path: str, text: bool = False) -> None:
    """Parquet (v, x), or one text file with a state a line in the order of v: its line is what tells a vertex."""
    if text:
        states.orderBy("v").select(F.col("x").cast("string")).coalesce(1).write.mode("overwrite").text(path)
    else:
        states.select("v", "x").write.mode("overwrite").parquet(path)


def write_scores(scores: DataFrame, path: str, run_id: str, graph: str, algo: str, append: bool = True) -> None:
    """Rows (graph, algo, v, pc) in the run's partition; without append all runs are replaced."""
    rows = scores.select(F.lit(run_id).alias("run_id"), F.lit(graph).alias("graph"), F.lit(algo).alias("algo"), "v", "pc")
    rows.write.mode("append" if append else "overwrite").partitionBy("run_id").parquet(path)


def write_run(spark, path: str, run_id: str, graph: str, algo: str, time_s: float, est_time_s: float | None = None, sample_size: int | None = None, xi: float | None = None, max_d_v: float | None = None, append: bool = True) -> None:
    """One run's time, sample size and bound; what a run does not have is null."""
    spark.createDataFrame([(run_id, graph, algo, time_s, est_time_s, sample_size, xi, max_d_v)], RUN).write.mode("append" if append else "overwrite").parquet(path)


def write_distortion(d_v: DataFrame, path: str, graph: str) -> None:
    """(graph, v, d_v), and its (graph, min, max, n) beside it."""
    d_v.select(F.lit(graph).alias("graph"), "v", "d_v").write.mode("overwrite").parquet(f"{path}/values")
    d_v.agg(F.lit(graph).alias("graph"), F.min("d_v").alias("min"), F.max("d_v").alias("max"), F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/summary")


def write_distances(spark, path: str, graph: str, diameter: int, avg_distance: float, time_s: float) -> None:
    spark.createDataFrame([(graph, diameter, avg_distance, time_s)], "graph string, diameter long, avg_distance double, time_s double").write.mode("append").parquet(path)


def save_progressive(graph_name: str, algo: str, run_id: str, progress, path: str, time_s: float, est_time_s: float | None = None, d_v: DataFrame | None = None) -> None:
    """Scores, the run's record and, if given, d_v. A run without samples leaves a record of -1 in all numbers, and no scores."""
    spark = progress.scores.sparkSession
    top = d_v.agg(F.max("d_v")).first()[0] if d_v is not None else None
    if progress.samples:
        write_scores(progress.scores, f"{path}/scores", run_id, graph_name, algo)
        write_run(spark, f"{path}/runs", run_id, graph_name, algo, time_s, est_time_s, progress.samples, progress.xi, top)
    else:
        write_run(spark, f"{path}/runs", run_id, graph_name, algo, -1.0, -1.0, -1, -1.0, top)
    if d_v is not None:
        write_distortion(d_v, f"{path}/dv/{run_id}", graph_name)


def save_exact(graph_name: str, algo: str, scores: DataFrame, path: str, time_s: float, d_v: DataFrame | None = None) -> None:
    """An exact run replaces the one before."""
    write_scores(scores, f"{path}/scores", "exact", graph_name, algo, append=False)
    write_run(scores.sparkSession, f"{path}/runs", "exact", graph_name, algo, time_s, append=False)
    if d_v is not None:
        write_distortion(d_v, f"{path}/dv", graph_name)


def write_edges(graph: Graph | DataFrame, path: str, sep: str = " ") -> None:
    """An edge list as text, an edge a line."""
    edges = graph.edges if isinstance(graph, Graph) else graph
    edges.select(F.concat_ws(sep, F.col("src").cast("string"), F.col("dst").cast("string"))).write.mode("overwrite").text(path)
