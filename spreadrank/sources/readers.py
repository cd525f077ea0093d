"""Readers of edge lists, states, scores and run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadrank.operators.graph import Graph, dense_ids


def read_graph(spark: SparkSession, path: str, directed: bool = True, sep: str = " ") -> Graph:
    """An edge list of exactly two whole numbers a line; any other line fails the read. Loops go, repeats count once."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parts = F.split("value", F.lit(rf"\Q{sep}\E"))
    ok = F.assert_true((F.size(parts) == 2) & parts[0].rlike(r"^-?\d+$") & parts[1].rlike(r"^-?\d+$"), F.concat(F.lit("not an edge: "), "value"))
    edges = lines.select(ok.alias("ok"), parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst")).filter("ok is null").select("src", "dst")
    return Graph.of(edges, directed)


def numbered_graph(graph: Graph, base: int = 1) -> tuple[Graph, DataFrame]:
    """The graph with consecutive ids in the order of the old ones, and (v, id)."""
    ids = dense_ids(graph.vertices, base=base)
    e = graph.edges.join(ids.withColumnsRenamed({"v": "src", "id": "a"}), "src").join(ids.withColumnsRenamed({"v": "dst", "id": "b"}), "dst")
    return Graph(e.select(F.col("a").alias("src"), F.col("b").alias("dst")), graph.directed), ids


def read_labelled_edges(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, dictionary): lines of two or more words; blank lines, ``#`` comments and shorter lines are skipped.

    edges (src, dst) keep repeats and loops; dictionary (label, id) numbers labels from 0 by first appearance in the file's bytes.
    """
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).withColumn("value", F.btrim("value", F.lit(" \t\r")))
    parts = lines.filter(~F.col("value").startswith("#")).select("at", F.split("value", r"\s+").alias("w")).filter(F.size("w") >= 2)
    named = parts.select("at", F.col("w")[0].alias("a"), F.col("w")[1].alias("b"))
    firsts = named.select(F.explode(F.array(F.struct(F.col("a").alias("label"), (F.col("at") * 2).alias("at")), F.struct(F.col("b").alias("label"), (F.col("at") * 2 + 1).alias("at")))).alias("e")).groupBy("e.label").agg(F.min("e.at").alias("v"))
    ids = firsts.join(dense_ids(firsts.select("v")), "v").select("label", "id")
    edges = named.join(ids.withColumnsRenamed({"label": "a", "id": "src"}), "a").join(ids.withColumnsRenamed({"label": "b", "id": "dst"}), "b").select("src", "dst")
    return edges, ids


def labelled_states(dictionary: DataFrame, states: DataFrame) -> DataFrame:
    """(v, x) of all labels of the dictionary, 0 for those without a state; a state of an unknown label fails."""
    both = dictionary.join(states.select("label", "x", F.lit(True).alias("has")), "label", "full")
    known = F.assert_true(F.col("id").isNotNull(), F.concat(F.lit("a state for an unknown label: "), "label"))
    return both.withColumn("ok", known).filter("ok is null").select(F.col("id").alias("v"), F.coalesce("x", F.lit(0.0)).alias("x"))


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """(v, x) from one number a line, v the line's number from 1 on, in a single file; a state outside [0, 1] fails."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.col("value").cast("double").alias("x"))
    ids = dense_ids(rows.select(F.col("at").alias("v")), base=1)
    return check_states(rows.join(ids.withColumnRenamed("v", "at"), "at").select(F.col("id").alias("v"), "x"))


def read_labelled_state_file(spark: SparkSession, path: str) -> DataFrame:
    """(label, x) from lines of a label and a number."""
    w = F.split(F.btrim("value", F.lit(" \t\r")), r"\s+")
    return spark.read.text(path).select(w.alias("w")).filter(F.size("w") >= 2).select(F.col("w")[0].alias("label"), F.col("w")[1].cast("double").alias("x"))


def check_states(states: DataFrame) -> DataFrame:
    ok = F.assert_true(F.coalesce(F.col("x").between(0, 1), F.lit(False)), "a state is not in [0, 1]")
    return states.withColumn("ok", ok).filter("ok is null").select("v", "x")


def read_scores(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """(run_id, v, pc) as written by sinks.write_scores(). Values from -0.1 to 0 count as 0; with a lower one the run is void."""
    df = spark.read.parquet(path)
    return clamp_scores(df if run_id is None else df.filter(F.col("run_id") == run_id))


def clamp_scores(scores: DataFrame) -> DataFrame:
    void = scores.groupBy("run_id").agg(F.min("pc").alias("m")).filter("m < -0.1").select("run_id")
    return scores.join(void, "run_id", "left_anti").withColumn("pc", F.greatest("pc", F.lit(0.0)))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records: times, sample sizes, xi and bounds."""
    return spark.read.parquet(path)


def read_times(spark: SparkSession, path: str, estimation: bool = False) -> DataFrame:
    return read_runs(spark, path).select("run_id", "graph", "algo", F.col("est_time_s" if estimation else "time_s").alias("time_s"))


def read_sample_sizes(spark: SparkSession, path: str) -> DataFrame:
    return read_runs(spark, path).select("run_id", "graph", "algo", "sample_size")


def read_xi(spark: SparkSession, path: str) -> DataFrame:
    return read_runs(spark, path).select("run_id", "graph", "algo", "xi")


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("graph", "diameter", "avg_distance", "time_s")
