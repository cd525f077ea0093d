"""Both ways of searching, in tasks on a copy of the graph and by joins, give the same rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadrank.functions.draws import uniform, uniform_array
from spreadrank.operators import blocks, exact, sampling, traverse
from spreadrank.operators.graph import Graph

SHAPES = {
    "random": lambda r: [(r.randrange(24), r.randrange(24)) for _ in range(50)],
    "chain": lambda r: [(k, k + 1) for k in range(6)],
    "many ways": lambda r: [(3 * k + a, 3 * k + 3 + b) for k in range(2) for a in range(3) for b in range(3)],
}


def rows(df):
    return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in df.collect())


@pytest.mark.parametrize("directed", [False, True])
@pytest.mark.parametrize("shape", SHAPES)
def test_same_as_joins(spark, monkeypatch, shape, directed):
    r = random.Random(7)
    edges = spark.createDataFrame(SHAPES[shape](r), "src long, dst long")
    ids = sorted({v for e in edges.collect() for v in e})
    states = spark.createDataFrame([(v, r.choice([0.0, 0.1, 0.4, 1.0])) for v in ids[:-1]] + [(ids[-1], None), (999, 0.5)], "v long, x double")
    pairs = spark.createDataFrame([(k, r.choice(ids), r.choice(ids)) for k in range(40)] + [(40, 999, ids[0])], "sample long, s long, z long")
    sources = spark.createDataFrame([(ids[0],), (ids[3],), (999,), (None,)], "s long")

    def all_of():
        g = Graph.of(edges, directed)
        own = states.filter("v <> 999")
        return {
            "target": rows(exact.target_unnormalised(g, own)),
            "classical": rows(exact.classical(g, own.filter("x is not null"))),
            "betweenness": rows(exact.betweenness(g)),
            "paths": rows(traverse.shortest_paths(g)),
            "some paths": rows(traverse.shortest_paths(g, sources)),
            "fractions": rows(sampling.pair_fractions(g, pairs)),
            "drawn": rows(sampling.path_hits(g, pairs)),
        }

    monkeypatch.setattr(blocks, "CELLS", 100)  # several blocks a task
    assert Graph.of(edges, directed).compact.block < 10
    fast = all_of()
    monkeypatch.setattr("spreadrank.operators.graph.compact", lambda g: None)
    slow = all_of()
    for name in fast:
        assert fast[name] == slow[name], name


def test_bound_and_types(spark):
    edges = spark.range(5).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert blocks.compact(Graph.of(edges), 4) is None
    assert len(blocks.compact(Graph.of(edges), 5).ids) == 6
    assert blocks.compact(Graph.of(edges.select(F.col("src").cast("string"), F.col("dst").cast("string")))) is None


def test_empty(spark):
    g = Graph.of(spark.createDataFrame([], "src long, dst long"))
    assert exact.target(g, spark.createDataFrame([], "v long, x double")).count() == 0
    assert exact.betweenness(g).count() == 0
    assert rows(traverse.shortest_paths(g, spark.createDataFrame([(1,)], "s long"))) == [("1", "1", "0", "1")]
    assert sampling.path_hits(g, spark.createDataFrame([(0, 1, 2)], "sample long, s long, z long")).count() == 0


def test_runs_beyond_whole_doubles():
    of = np.array([0, 0, 1, 1, 1])
    values = np.array([2.0**60, 2.0**60, 1.0, 2.0, 3.0])
    assert blocks._runs(values, of).tolist() == [2.0**60, 2.0**61, 1.0, 3.0, 6.0]


def test_same_draws(spark):
    s = np.arange(0, 10**9, 99_999_937)
    df = spark.createDataFrame([(int(x), int(x) % 17) for x in s], "s long, k long").select(uniform(F.col("s"), F.col("k")).alias("u"))
    assert [r.u for r in df.collect()] == uniform_array(s, s % 17).tolist()


def test_many_paths_a_pair_and_shared_searches(spark, monkeypatch):
    """Both within tasks, against joins."""
    r = random.Random(11)
    edges = spark.createDataFrame([(r.randint(0, 9), r.randint(10, 13)) for _ in range(60)], "src long, dst long")
    states = spark.createDataFrame([(v, r.random()) for v in range(13)] + [(13, None)], "v long, x double")
    pairs = spark.createDataFrame([(k, r.randint(0, 13), r.randint(0, 13)) for k in range(30)], "sample long, s long, z long")

    def all_of():
        g = Graph.of(edges)
        both = exact.betweenness_and_target(g, states.filter("x is not null"))
        return [rows(sampling.path_hits(g, pairs, 0.4)), *map(rows, both)], [rows(exact.betweenness(g)), rows(exact.target(g, states.filter("x is not null")))]

    fast, apart = all_of()
    assert fast[1:] == apart
    with monkeypatch.context() as m:
        m.setattr(sampling, "paths_to_targets", None)  # no joins
        assert rows(sampling.path_hits(Graph.of(edges), pairs, 0.4)) == fast[0]
    monkeypatch.setattr("spreadrank.operators.graph.compact", lambda g: None)
    assert all_of()[0] == fast
