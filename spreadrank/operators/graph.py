"""Graphs as edge tables: construction, adjacency, degrees, components, subgraphs and planted chains."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadrank.functions.draws import uniform
from spreadrank.functions.lineage import cut
from spreadrank.operators.blocks import Compact, compact


@dataclass
class Graph:
    """``edges`` (src, dst): different arcs without loops. Undirected graphs hold each edge once with src < dst."""

    edges: DataFrame
    directed: bool = False

    @classmethod
    def of(cls, edges: DataFrame, directed: bool = False) -> Graph:
        """From any (src, dst) table: loops and nulls go, repeated edges count once."""
        e = edges.select("src", "dst").filter("src <> dst")
        if not directed:
            e = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        return cls(e.distinct(), directed)

    @cached_property
    def arcs(self) -> DataFrame:
        """Every way that can be walked: both ways of an undirected edge."""
        if self.directed:
            return self.edges
        return self.edges.unionByName(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    @cached_property
    def vertices(self) -> DataFrame:
        return self.edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct()

    @cached_property
    def compact(self) -> Compact | None:
        """The graph as arrays for tasks, if it is small enough."""
        return compact(self)

    def pinned(self) -> Graph:
        """The same graph with its edges checkpointed, for loops over it."""
        return Graph(cut(self.edges), self.directed)


def adjacency(graph: Graph, incoming: bool = False) -> DataFrame:
    """(v, neighbours array): sorted ends of the arcs from v, or starts of those to v."""
    a, b = ("dst", "src") if incoming else ("src", "dst")
    return graph.arcs.groupBy(F.col(a).alias("v")).agg(F.sort_array(F.collect_set(b)).alias("neighbours"))


def degree_table(graph: Graph) -> DataFrame:
    """(v, out_degree, in_degree) of every vertex."""
    rows = graph.arcs.select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("r"))
    return rows.groupBy("r.v").agg(F.sum("r.o").alias("out_degree"), F.sum("r.i").alias("in_degree"))


def static_graph(graph: Graph) -> DataFrame:
    """(v, out, in, out_degree, in_degree): adjacency both ways in one table."""
    out, inc = adjacency(graph), adjacency(graph, incoming=True)
    none = F.array().cast("array<bigint>")
    both = out.withColumnRenamed("neighbours", "o").join(inc.withColumnRenamed("neighbours", "i"), "v", "full")
    both = both.select("v", F.coalesce("o", none).alias("out"), F.coalesce("i", none).alias("in"))
    return both.withColumns({"out_degree": F.size("out"), "in_degree": F.size("in")})


def graph_stats(graph: Graph) -> DataFrame:
    """(n_vertices, n_edges, directed)."""
    return graph.vertices.agg(F.count(F.lit(1)).alias("n_vertices")).crossJoin(graph.edges.agg(F.count(F.lit(1)).alias("n_edges"))).withColumn("directed", F.lit(graph.directed))


def dense_ids(vertices: DataFrame, order: str = "v", base: int = 0) -> DataFrame:
    """(v, id): consecutive ids in the given order. Ranges are counted first, so no task numbers all rows."""
    dealt = vertices.select("v", order).distinct() if order != "v" else vertices.select("v").distinct()
    dealt = cut(dealt.repartitionByRange(order).withColumn("p", F.spark_partition_id()))
    counts = dealt.groupBy("p").agg(F.count(F.lit(1)).alias("k"))
    before = counts.select("p", (F.sum("k").over(Window.orderBy("p")) - F.col("k")).alias("b"))  # a row for each partition
    rank = F.row_number().over(Window.partitionBy("p").orderBy(order, "v"))
    return dealt.withColumn("r", rank).join(F.broadcast(before), "p").select("v", (F.col("b") + F.col("r") - 1 + base).cast("long").alias("id"))


def components(graph: Graph) -> DataFrame:
    """(v, component): weakly connected components, named by their least vertex; labels jump to their label's label each round."""
    arcs = cut(graph.edges.unionByName(graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    label = cut(graph.vertices.withColumn("c", F.col("v")))
    while True:
        near = arcs.join(label, arcs.dst == label.v).groupBy("src").agg(F.min("c").alias("m"))
        low = label.join(near, label.v == near.src).select("v", "c", F.least("c", "m").alias("m"))
        jump = low.select(F.col("v").alias("w"), F.col("m").alias("j"))
        new = cut(low.join(jump, F.col("m") == F.col("w")).select("v", "c", F.least("m", "j").alias("n")))
        done = new.filter("n <> c").isEmpty()
        label = new.select("v", F.col("n").alias("c"))
        if done:
            return label.select("v", F.col("c").alias("component"))


def strong_components(graph: Graph) -> DataFrame:
    """(v, component): strongly connected components of a directed graph, named by their largest vertex.

    Rounds of colouring: every vertex takes the largest vertex that reaches it; those of a colour that reach the colour's own vertex make up its
    component and leave. Vertices without arcs in or out leave at once.
    """
    arcs, left, found = cut(graph.arcs), cut(graph.vertices), None
    while not left.isEmpty():
        colour = left.withColumn("c", F.col("v"))
        while True:
            got = arcs.join(colour, arcs.src == colour.v).groupBy("dst").agg(F.max("c").alias("m"))
            new = cut(colour.join(got, colour.v == got.dst, "left").select("v", "c", F.greatest("c", "m").alias("n")))
            done = new.filter("n <> c").isEmpty()
            colour = new.select("v", F.col("n").alias("c"))
            if done:
                break
        inner = cut(arcs.join(colour.withColumnsRenamed({"v": "src", "c": "a"}), "src").join(colour.withColumnsRenamed({"v": "dst", "c": "b"}), "dst").filter("a = b").select("src", "dst"))
        back = cut(colour.filter("v = c").select("v", "c"))
        step = back
        while True:
            step = inner.join(step, inner.dst == step.v).select(F.col("src").alias("v"), "c").distinct().join(back.select("v"), "v", "left_anti")
            step = cut(step)
            if step.isEmpty():
                break
            back = cut(back.unionByName(step))
        own = back.select("v", F.col("c").alias("component"))
        found = own if found is None else found.unionByName(own)
        left = cut(left.join(own, "v", "left_anti"))
        arcs = cut(arcs.join(left.withColumnRenamed("v", "src"), "src", "left_semi").join(left.withColumnRenamed("v", "dst"), "dst", "left_semi"))
    return found if found is not None else graph.vertices.withColumn("component", F.col("v"))


def largest_component(graph: Graph) -> DataFrame:
    """(v) of the largest component: connected ones of undirected graphs, strong ones of directed graphs; ties to the least name."""
    c = strong_components(graph) if graph.directed else components(graph)
    top = c.groupBy("component").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "component").limit(1)
    return c.join(F.broadcast(top.select("component")), "component", "left_semi").select("v")


def induced(graph: Graph, subset: DataFrame) -> Graph:
    """The subgraph on the vertices of ``subset`` (v)."""
    keep = subset.select("v").distinct()
    e = graph.edges.join(keep.withColumnRenamed("v", "src"), "src", "left_semi").join(keep.withColumnRenamed("v", "dst"), "dst", "left_semi")
    return Graph(e.select("src", "dst"), graph.directed)


def attach_chain(graph: Graph, k: int, anchors: str = "random", stream: int = 40) -> tuple[Graph, DataFrame]:
    """(graph, states) with a chain of k new vertices, walkable both ways; its first half has state 0, the other 1, all else 0.

    anchors: "random" ties its start both ways to floor(ln n) drawn vertices, "largest" to one of the largest component,
    "largest_in" only from that one to the chain (and not at all in an undirected graph). New ids follow the largest id.
    """
    n, top = graph.vertices.agg(F.count(F.lit(1)), F.max("v")).first()
    spark = graph.edges.sparkSession
    chain = spark.range(k).select((F.col("id") + top + 1).alias("v"), (F.col("id") >= k / 2).cast("double").alias("x"))
    links = spark.range(1, k).select((F.col("id") + top).alias("src"), (F.col("id") + top + 1).alias("dst"))
    pool = graph.vertices if anchors == "random" else largest_component(graph)
    chosen = pool.orderBy(uniform(F.col("v"), stream), "v").limit(math.floor(math.log(n)) if anchors == "random" else 1)
    ties = chosen.select(F.col("v").alias("src"), F.lit(top + 1).cast("long").alias("dst"))
    turned = lambda e: e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if anchors == "largest_in":
        ties = ties if graph.directed else ties.limit(0)
        added = links.unionByName(turned(links)).unionByName(ties)
    else:
        both = links.unionByName(ties)
        added = both.unionByName(turned(both))
    states = graph.vertices.withColumn("x", F.lit(0.0)).unionByName(chain)
    return Graph.of(graph.edges.unionByName(added), graph.directed), states
