"""Hand-sized graphs with exact answers, and invariants."""

import math
from fractions import Fraction as Q

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spreadrank.functions import bounds as B
from spreadrank.operators import exact as C
from spreadrank.operators import graph as G
from spreadrank.operators import states as X
from spreadrank.operators import traverse as T

P4 = [1, 0.5, 0.25, 0]
GRAPHS = {
    "path": ([(0, 1), (1, 2), (2, 3)], False, P4, Q(13, 4), [1, 2, 2, 1.5], [0, 1.75, 1.5, 0], [0, 9 / 5, 1, 0], [0, 4, 4, 0]),
    "diamond": ([(0, 1), (0, 2), (1, 3), (2, 3)], False, P4, Q(13, 4), [1, 2, 2, 1.5], [0.125, 0.5, 0.5, 0.125], [1 / 2, 2 / 5, 1 / 3, 3 / 14], [1, 1, 1, 1]),
    "cycle": ([(0, 1), (1, 2), (2, 3), (3, 0)], True, P4, Q(13, 4), [1, 2, 2, 1.5], [0, 1.75, 1.5, 0], [1 / 3, 8 / 5, 4 / 3, 4 / 7], [3, 3, 3, 3]),
    "star": ([(0, 1), (0, 2), (0, 3), (0, 4)], False, [0, 1, 1, 0, 0], Q(6), [4, 3, 3, 4, 4], [4, 0, 0, 0, 0], [3, 0, 0, 0, 0], [12, 0, 0, 0, 0]),
    "two parts": ([(0, 1), (1, 2), (3, 4)], False, [1, 0, 0, 1, 0], Q(6), [3, 4, 4, 3, 4], [0, 1, 0, 0, 0], [0, 0.5, 0, 0, 0], [0, 2, 0, 0, 0]),
}
DISTANCES = {"path": (3, 12, 1, 5 / 3, 1 / 2), "diamond": (2, 12, 1, 4 / 3, 1 / 4), "cycle": (3, 12, 1, 2, 3 / 4), "star": (2, 20, 1, 8 / 5, 12 / 25), "two parts": (2, 8, 2 / 5, 5 / 4, 2 / 13)}


def build(spark, edges, directed, x):
    g = G.Graph.of(spark.createDataFrame(edges, "src long, dst long"), directed)
    return g, spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "v long, x double")


def values(df, c="pc"):
    return [r[c] for r in df.orderBy("v").collect()]


@pytest.mark.parametrize("name", GRAPHS)
def test_golden(spark, name):
    edges, directed, x, total, minus, u, classical, between = GRAPHS[name]
    g, s = build(spark, edges, directed, x)
    report = C.exact_report(g, s).orderBy("v").collect()
    assert [r["unnormalised"] for r in report] == pytest.approx(u)
    assert [r["pc"] for r in report] == pytest.approx([v / float(total) for v in u])
    assert values(X.kappa_sums(s), "minus_sum") == pytest.approx(minus)
    assert values(X.distortion(s), "d_v") == pytest.approx([float(total) / m for m in minus])
    assert values(C.classical(g, s)) == pytest.approx(classical)
    assert values(C.betweenness(g)) == pytest.approx(between)
    r = T.distance_summary(g, T.shortest_paths(g)).first()
    assert (r["diameter"], r["reachable"]) == DISTANCES[name][:2]
    assert (r["connectivity"], r["mean_distance"], r["rho_legacy"]) == pytest.approx(DISTANCES[name][2:])


def test_equal_states_have_no_target_score(spark):
    g, s = build(spark, [(0, 1), (1, 2)], False, [0.5] * 3)
    assert values(C.target(g, s)) == [None] * 3
    assert values(X.distortion(s), "d_v") == [None] * 3


def test_edges_are_a_set_without_loops(spark):
    e = spark.createDataFrame([(1, 1), (2, 1), (1, 2), (2, 3), (None, 1)], "src long, dst long")
    assert sorted(map(tuple, G.Graph.of(e).edges.collect())) == [(1, 2), (2, 3)]
    assert sorted(map(tuple, G.Graph.of(e, True).edges.collect())) == [(1, 2), (2, 1), (2, 3)]


def test_shift_and_scale_of_states(spark):
    edges, directed, x, *_ = GRAPHS["diamond"]
    g, s = build(spark, edges, directed, x)
    base = values(C.target(g, s))
    assert values(C.target(g, s.withColumn("x", F.col("x") / 2 + 0.25), batches=3)) == pytest.approx(base)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(0.0001, 10), min_size=1, max_size=30))
def test_rademacher_minimum_is_no_more_than_any_value(squares):
    least = B.rademacher_minimum(squares, 20)
    for x in (0.1, 1, 3, 10, 40):
        exps = [x * x * b / 800 for b in squares]
        top = max(exps)
        assert least <= (top + math.log(sum(math.exp(e - top) for e in exps))) / x + 1e-6


def test_bounds():
    assert [B.vc_bound(e, 0.1, d) for e in (0.1, 0.05, 0.01) for d in (5, 10)] == [299, 358, 1199, 1433, 29978, 35828]
    assert [B.first_sample(e, 0.1) for e in (0.1, 0.05, 0.01)] == [210, 689, 13724]
    assert [B.bootstrap_size(e, 0.1, 10) for e in (0.1, 0.05, 0.01, 0.005)] == [100, 100, 230, 460]
    assert B.top1_bound(0.1, 0.0125, 100) == pytest.approx(0.247185004)
    assert B.mcera_eps(0.01, 0.02, 0.05, 1000, 25) == pytest.approx(0.127404316)
    assert B.mcera_eps(0, 0, 0.05, 1000, 25) == pytest.approx(0.039015628)
    assert B.samples_at(0.1, 3, 0.05, 0.05) == pytest.approx(597.986405443)
    assert B.samples_bound(0.2, 0.05, 3, 0.05, 0.05) == pytest.approx(400.160816866)


def test_components(spark):
    g, _ = build(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (4, 5), (5, 4), (6, 7)], True, [])
    assert {r.v: r.component for r in G.components(g).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 6, 7: 6}
    assert {r.v: r.component for r in G.strong_components(g).collect()} == {0: 2, 1: 2, 2: 2, 3: 3, 4: 5, 5: 5, 6: 6, 7: 7}
    assert sorted(values(G.largest_component(g), "v")) == [0, 1, 2]


def test_readers_and_sinks(spark, tmp_path):
    from spreadrank.sources import readers, sinks

    (tmp_path / "e.txt").write_text("3 1\n1 3\n2 2\n1 5\n")
    assert sorted(map(tuple, readers.read_graph(spark, str(tmp_path / "e.txt"), False).edges.collect())) == [(1, 3), (1, 5)]
    (tmp_path / "bad.txt").write_text("3 1 4\n")
    with pytest.raises(Exception, match="not an edge"):
        readers.read_graph(spark, str(tmp_path / "bad.txt")).edges.collect()
    (tmp_path / "l.txt").write_text("# note\n\nb a\na  c x\nlonely\n")
    edges, ids = readers.read_labelled_edges(spark, str(tmp_path / "l.txt"))
    assert {r.label: r.id for r in ids.collect()} == {"b": 0, "a": 1, "c": 2}
    assert sorted(map(tuple, edges.collect())) == [(0, 1), (1, 2)]
    x = spark.createDataFrame([("a", 0.5)], "label string, x double")
    assert {r.v: r.x for r in readers.labelled_states(ids, x).collect()} == {0: 0.0, 1: 0.5, 2: 0.0}
    with pytest.raises(Exception, match="unknown label"):
        readers.labelled_states(ids, spark.createDataFrame([("z", 0.5)], "label string, x double")).collect()
    (tmp_path / "s.txt").write_text("0.5\n1\n0\n")
    assert {r.v: r.x for r in readers.read_states(spark, str(tmp_path / "s.txt")).collect()} == {1: 0.5, 2: 1.0, 3: 0.0}
    (tmp_path / "t.txt").write_text("0.5\n1.5\n")
    with pytest.raises(Exception, match="not in"):
        readers.read_states(spark, str(tmp_path / "t.txt")).collect()
    scores = spark.createDataFrame([(1, 0.5), (2, -0.05)], "v long, pc double")
    path = str(tmp_path / "out")
    sinks.write_scores(scores, path, "a", "g", "x", append=False)
    sinks.write_scores(scores.withColumn("pc", F.col("pc") - 0.5), path, "b", "g", "x")
    assert {(r.run_id, r.v): r.pc for r in readers.read_scores(spark, path).collect()} == {("a", 1): 0.5, ("a", 2): 0.0}
    sinks.write_run(spark, f"{path}-runs", "a", "g", "x", 1.5, xi=0.1)
    assert readers.read_xi(spark, f"{path}-runs").first()["xi"] == 0.1
    sinks.write_distances(spark, f"{path}-d", "g", 3, 1.5, 0.1)
    assert readers.read_distances(spark, f"{path}-d").first()["diameter"] == 3


def test_estimates_come_near_exact_scores(spark):
    from spreadrank.operators.estimate import estimate_kappa, estimate_uniform

    edges, directed, x, *_ = GRAPHS["diamond"]
    g, s = build(spark, edges, directed, x)
    exact = values(C.target(g, s))
    for run in (estimate_kappa, estimate_uniform):
        assert values(run(g, s, 400, exact_pairs=True)) == pytest.approx(exact, abs=0.05)


def test_progressive_era_stops(spark):
    from spreadrank.streaming.progressive import progressive_era

    edges, directed, x, *_ = GRAPHS["path"]
    g, s = build(spark, edges, directed, x)
    p = progressive_era(g, s, 0.3, 0.1, diameter_sources=0)
    assert p.samples <= p.limit and values(p.scores) == pytest.approx(values(C.target(g, s)), abs=0.3)
