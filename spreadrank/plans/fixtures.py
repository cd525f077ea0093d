"""Graphs and states derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spreadrank.operators.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def next_in_order(rows: DataFrame, value: str, part: str, order: list[str]) -> DataFrame:
    """(a, b): each row's value and that of the next row overall. ``part`` divides the order, so only the first rows of parts meet in
    one window; all else is ordered within its part."""
    w = Window.partitionBy(part).orderBy(*order)
    own = rows.select(part, F.col(value).alias("a"), F.lead(value).over(w).alias("b"), F.row_number().over(w).alias("i"))
    first = own.filter("i = 1").select(part, F.col("a").alias("first"))
    after = first.select(part, F.lead("first").over(Window.orderBy(part)).alias("next"))  # a row for each part
    return own.join(after, part).select("a", F.coalesce("b", "next").alias("b"))


def user_purchase(spark: SparkSession, sf_dir: str, above: float = 60, directed: bool = False) -> Graph:
    """Users of consecutive purchases worth more than ``above``."""
    ev = table(spark, sf_dir, "events").filter((F.col("event_type") == "purchase") & (F.col("value") > above)).select("user_id", "ts", "event_id", F.to_date("ts").alias("day"))
    pairs = next_in_order(ev, "user_id", "day", ["ts", "event_id"]).filter("b is not null")
    return Graph.of(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")), directed)


def error_rates(spark: SparkSession, sf_dir: str, graph: Graph | None = None) -> DataFrame:
    """(v, x): each user's share of events that are errors; of a graph's vertices only if one is given."""
    ev = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("v")).agg((F.sum((F.col("event_type") == "error").cast("int")).cast("double") / F.count(F.lit(1))).alias("x"))
    return ev if graph is None else ev.join(graph.vertices, "v", "left_semi")


def nation_trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations whose customers and suppliers share a line item."""
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    c = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("src"))
    s = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("dst"))
    return Graph.of(lines.join(c, "o_custkey").join(s, "l_suppkey").select("src", "dst"))
