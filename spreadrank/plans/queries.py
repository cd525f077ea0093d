"""Registered queries: (SparkSession, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadrank.functions import bounds as B
from spreadrank.operators import estimate as E
from spreadrank.operators import evaluate as V
from spreadrank.operators import exact as C
from spreadrank.operators import graph as G
from spreadrank.operators import sampling as M
from spreadrank.operators import states as X
from spreadrank.operators import traverse as T
from spreadrank.plans.fixtures import error_rates, nation_trade, table, user_purchase
from spreadrank.streaming import progressive as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SAMPLES = 10_000


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def graph60(spark: SparkSession, sf_dir: str, directed: bool = False) -> G.Graph:
    return user_purchase(spark, sf_dir, 60, directed).pinned()


def graph100(spark: SparkSession, sf_dir: str, directed: bool = False) -> G.Graph:
    return user_purchase(spark, sf_dir, 100, directed).pinned()


def both(spark: SparkSession, sf_dir: str, directed: bool = False) -> tuple[G.Graph, DataFrame]:
    g = graph60(spark, sf_dir, directed)
    return g, error_rates(spark, sf_dir, g)


# Graphs


@query
def edges_undirected(spark, sf):
    return user_purchase(spark, sf).edges


@query
def edges_directed(spark, sf):
    return user_purchase(spark, sf, directed=True).edges


@query
def nation_trade_edges(spark, sf):
    return nation_trade(spark, sf).edges


@query
def adjacency(spark, sf):
    return G.adjacency(user_purchase(spark, sf)).select("v", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@query
def in_adjacency(spark, sf):
    return G.adjacency(user_purchase(spark, sf, directed=True), incoming=True).select("v", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@query
def degree_table(spark, sf):
    return rounded(G.degree_table(user_purchase(spark, sf, directed=True)))


@query
def static_graph(spark, sf):
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return rounded(G.static_graph(user_purchase(spark, sf, directed=True)).select("v", text("out"), text("in"), "out_degree", "in_degree"))


@query
def graph_stats(spark, sf):
    return G.graph_stats(user_purchase(spark, sf))


@query
def dense_ids(spark, sf):
    return G.dense_ids(user_purchase(spark, sf).vertices)


@query
def labelled_states_join(spark, sf):
    from spreadrank.sources.readers import labelled_states

    users = table(spark, sf, "events").filter("event_type = 'signup'").select(F.concat(F.lit("u"), "user_id").alias("label")).distinct()
    known = table(spark, sf, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("label"), F.col("c_custkey").alias("id"))
    states = users.join(known, "label", "left_semi").select("label", (F.length("label") / 10).alias("x"))
    return labelled_states(known, states)


@query
def components(spark, sf):
    return G.components(user_purchase(spark, sf, 130))


@query
def strong_components(spark, sf):
    return G.strong_components(user_purchase(spark, sf, 100, directed=True))


@query
def largest_component(spark, sf):
    return G.largest_component(user_purchase(spark, sf, 130))


@query
def largest_strong_component(spark, sf):
    return G.largest_component(user_purchase(spark, sf, 130, directed=True))


@query
def gadget_graph(spark, sf):
    g, x = G.attach_chain(graph60(spark, sf), 10)
    return g.edges.join(x.withColumnsRenamed({"v": "src", "x": "x_src"}), "src").join(x.withColumnsRenamed({"v": "dst", "x": "x_dst"}), "dst").select("src", "dst", "x_src", "x_dst")


@query
def gadget_lcc(spark, sf):
    return G.attach_chain(user_purchase(spark, sf, 130).pinned(), 10, "largest")[0].edges


@query
def gadget_lcc_in(spark, sf):
    return G.attach_chain(user_purchase(spark, sf, 130, directed=True).pinned(), 10, "largest_in")[0].edges


# States


@query
def state_stats(spark, sf):
    return rounded(X.state_stats(error_rates(spark, sf)))


@query
def ramp_arcs(spark, sf):
    g, x = user_purchase(spark, sf), error_rates(spark, sf)
    arcs = g.arcs.join(x.withColumnsRenamed({"v": "src", "x": "xs"}), "src").join(x.withColumnsRenamed({"v": "dst", "x": "xz"}), "dst")
    return rounded(arcs.select("src", "dst", X.ramp(F.col("xs"), F.col("xz")).alias("r")))


@query
def kappa_total(spark, sf):
    return rounded(X.kappa_total(error_rates(spark, sf)))


@query
def kappa_sums(spark, sf):
    return rounded(X.kappa_sums(error_rates(spark, sf)))


@query
def outgoing_mass(spark, sf):
    return rounded(X.outgoing_mass(error_rates(spark, sf)))


@query
def d_v(spark, sf):
    return rounded(X.distortion(error_rates(spark, sf)))


@query
def d_v_legacy(spark, sf):
    return rounded(X.distortion(error_rates(spark, sf), legacy=True))


@query
def d_v_summary(spark, sf):
    return rounded(X.distortion_summary(error_rates(spark, sf)))


@query
def d_v_sampled(spark, sf):
    return rounded(X.sampled_distortion(error_rates(spark, sf), SAMPLES))


@query
def state_log_buckets(spark, sf):
    return X.log_buckets(error_rates(spark, sf))


@query
def state_abc_partition(spark, sf):
    return rounded(X.threshold_parts(error_rates(spark, sf), 0.25, 0.15))


@query
def uniform_states(spark, sf):
    return rounded(X.uniform_states(user_purchase(spark, sf).vertices))


@query
def initiator_states(spark, sf):
    return X.initiator_states(user_purchase(spark, sf).vertices, 7)


@query
def spread_states(spark, sf):
    return rounded(X.spread_states(graph60(spark, sf), 3, 2, 4.0))


@query
def range_states(spark, sf):
    v = user_purchase(spark, sf).vertices
    return rounded(X.range_states(v, [(5, 1.0), (v.count() - 9, None), (4, 0.0)]))


@query
def mixed_states(spark, sf):
    v = user_purchase(spark, sf).vertices
    return rounded(X.mixed_states(v, v.count() - 9, 3, 2, 4, 0.01))


# Traversal


@query
def bfs_distances(spark, sf):
    return rounded(T.shortest_paths(graph60(spark, sf)).select("s", "v", "d"))


@query
def sigma_counts(spark, sf):
    return rounded(T.shortest_paths(graph60(spark, sf, True)).select("s", "v", "d", F.col("sigma").cast("long").alias("sigma")))


@query
def eccentricity(spark, sf):
    return rounded(T.eccentricity(T.shortest_paths(graph60(spark, sf))))


@query
def distance_histogram(spark, sf):
    return rounded(T.distance_histogram(T.shortest_paths(graph100(spark, sf))))


@query
def distance_summary(spark, sf):
    g = graph100(spark, sf)
    return rounded(T.distance_summary(g, T.shortest_paths(g)))


@query
def distance_summary_directed(spark, sf):
    g = graph100(spark, sf, True)
    return rounded(T.distance_summary(g, T.shortest_paths(g)))


@query
def sampled_distance_summary(spark, sf):
    g = graph100(spark, sf)
    return rounded(T.distance_summary(g, T.shortest_paths(g, T.sample_sources(g, 20))))


@query
def hop_table(spark, sf):
    hops = T.hop_table(T.shortest_paths(graph100(spark, sf)))
    return rounded(hops.join(T.distances_of_hops(hops), "d"))


@query
def hop_mean(spark, sf):
    return rounded(T.mean_of_hops(T.hop_table(T.shortest_paths(graph100(spark, sf)))))


# Exact centrality


@query
def exact_target_pc(spark, sf):
    return rounded(C.target(*both(spark, sf)))


@query
def exact_target_pc_directed(spark, sf):
    return rounded(C.target(*both(spark, sf, True)))


@query
def exact_report(spark, sf):
    return rounded(C.exact_report(*both(spark, sf)), 7)


@query
def per_vertex_pc(spark, sf):
    return rounded(C.target_per_vertex(*both(spark, sf)))


@query
def renormalised_pc(spark, sf):
    g, x = both(spark, sf)
    return rounded(X.per_vertex_normalised(C.target(g, x, batches=2), x))


@query
def classical_pc(spark, sf):
    return rounded(C.classical(*both(spark, sf)))


@query
def classical_pc_inner(spark, sf):
    return rounded(C.classical(*both(spark, sf, True), normalization="n-2"))


@query
def classical_pc_pairs(spark, sf):
    return rounded(C.classical(*both(spark, sf), normalization="n(n-1)"), 10)


@query
def betweenness(spark, sf):
    return rounded(C.betweenness(graph60(spark, sf)), 6)


@query
def pair_normalised_betweenness(spark, sf):
    return rounded(X.pair_normalised(C.betweenness(graph60(spark, sf))))


@query
def induced_target_pc(spark, sf):
    g, x = both(spark, sf)
    return rounded(C.induced_target(g, x, x.filter("x > 0").select("v")))


@query
def initiators_target_pc(spark, sf):
    g = graph60(spark, sf)
    return rounded(C.target(g, X.initiator_states(g.vertices, 7)))


# Samples


def _pairs60(spark, sf):
    g, x = both(spark, sf)
    return g, x, M.kappa_pairs(x, SAMPLES)


@query
def uniform_pairs(spark, sf):
    return M.uniform_pairs(user_purchase(spark, sf).vertices, SAMPLES)


@query
def kappa_pairs(spark, sf):
    return _pairs60(spark, sf)[2]


@query
def kappa_pairs_listed(spark, sf):
    return M.kappa_pairs_listed(both(spark, sf)[1], SAMPLES)


@query
def uniform_source_pairs(spark, sf):
    return M.uniform_source_pairs(both(spark, sf)[1], SAMPLES)


@query
def pair_fractions(spark, sf):
    g, _, pairs = _pairs60(spark, sf)
    return rounded(M.pair_fractions(g, pairs))


@query
def sampled_paths(spark, sf):
    g, _, pairs = _pairs60(spark, sf)
    return rounded(T.draw_paths(g, pairs))


# Estimators and bounds


@query
def estimate_kappa(spark, sf):
    return rounded(E.estimate_kappa(*both(spark, sf), SAMPLES))


@query
def estimate_kappa_pair_exact(spark, sf):
    return rounded(E.estimate_kappa(*both(spark, sf), SAMPLES, exact_pairs=True))


@query
def estimate_uniform(spark, sf):
    return rounded(E.estimate_uniform(*both(spark, sf), SAMPLES))


@query
def estimate_uniform_pair_exact(spark, sf):
    return rounded(E.estimate_uniform(*both(spark, sf), SAMPLES, exact_pairs=True))


@query
def estimate_kappa_per_vertex(spark, sf):
    return rounded(E.estimate_kappa(*both(spark, sf), SAMPLES, per_vertex=True))


@query
def estimate_kappa_per_vertex_pair_exact(spark, sf):
    return rounded(E.estimate_kappa(*both(spark, sf), SAMPLES, exact_pairs=True, per_vertex=True))


@query
def estimate_uniform_per_vertex(spark, sf):
    return rounded(E.estimate_uniform(*both(spark, sf), SAMPLES, per_vertex=True))


@query
def estimate_uniform_per_vertex_pair_exact(spark, sf):
    return rounded(E.estimate_uniform(*both(spark, sf), SAMPLES, exact_pairs=True, per_vertex=True))


@query
def estimate_fixed_vc(spark, sf):
    return rounded(E.estimate_fixed(*both(spark, sf), 0.2, 0.1, diameter_sources=0))


@query
def estimate_many_paths(spark, sf):
    g, x = both(spark, sf)
    return rounded(E.estimate_kappa(g, x, SAMPLES, share=0.1))


@query
def era_squares(spark, sf):
    g, x = both(spark, sf)
    own = P._rows(g, x, SAMPLES, 0)
    return rounded(own.groupBy("v").agg(F.sum("f").alias("b1"), F.sum(F.col("f") * F.col("f")).alias("b2")), 12)


@query
def sample_variances(spark, sf):
    g, _, pairs = _pairs60(spark, sf)
    return rounded(P.variances(g, P._sums(M.pair_fractions(g, pairs)), SAMPLES))


@query
def bernstein_errors(spark, sf):
    g, _, pairs = _pairs60(spark, sf)
    return rounded(spark.createDataFrame([(P.bernstein_bound(g, P._sums(M.pair_fractions(g, pairs)), SAMPLES, 0.1),)], "error double"))


@query
def peeling_partitions(spark, sf):
    g, _, pairs = _pairs60(spark, sf)
    return rounded(P.peeling(g, P._sums(M.pair_fractions(g, pairs)), SAMPLES))


@query
def rademacher_sums(spark, sf):
    g, _, pairs = _pairs60(spark, sf)
    return rounded(P.rademacher_sums(M.pair_fractions(g, pairs), 5))


@query
def bounds_table(spark, sf):
    rows = [("vc", B.vc_bound(0.05, 0.1, 10)), ("first", B.first_sample(0.05, 0.1)), ("bootstrap", B.bootstrap_size(0.01, 0.1, 10)), ("top1", B.top1_bound(0.1, 0.0125, 100)), ("mcera", B.mcera_eps(0.01, 0.02, 0.05, 1000, 25)), ("samples_at", B.samples_at(0.1, 3, 0.05, 0.05)), ("bernstein", B.bernstein_error(0.01, 100, 1000, 0.1)), ("mean_length", B.mean_length_bound(0.1, 8, {0: 10, 1: 60, 2: 25, 3: 5}, 100)), ("next", B.next_sample(100)), ("first_stop", B.first_stop(0.05, 0.1, 10_000, 0.1)), ("samples_bound", B.samples_bound(0.2, 0.05, 3, 0.05, 0.05)), ("samples_bound_even", B.samples_bound(0.6, 0.3, 3, 0.1, 0.05))]
    return rounded(spark.createDataFrame([(a, float(b)) for a, b in rows], "name string, value double"), 6)


def _progress(spark, p):
    more = spark.createDataFrame([(p.samples, float(p.xi), float(p.limit))], "samples long, xi double, sample_limit double")
    return rounded(p.scores.crossJoin(more))


@query
def progressive_era(spark, sf):
    return _progress(spark, P.progressive_era(*both(spark, sf), 0.25, 0.1, diameter_sources=0))


@query
def progressive_bernstein(spark, sf):
    return _progress(spark, P.progressive_bernstein(*both(spark, sf), 0.2, 0.1, diameter_sources=0))


@query
def progressive_mcera(spark, sf):
    return _progress(spark, P.progressive_mcera(*both(spark, sf), 0.35, 0.1, diameter_sources=0, trials=10))


@query
def mcera_sample_bound(spark, sf):
    p = P.progressive_mcera(*both(spark, sf), 0.2, 0.1, diameter_sources=0, bootstrap_only=True)
    return rounded(spark.createDataFrame([(float(p.limit), B.vc_bound(0.2, 0.1, 6))], "sample_limit double, vc_bound long"))


# Evaluation: scores of customers stand for exact ones, with a perturbed copy as estimate


def _scores(spark, sf):
    c = table(spark, sf, "customer")
    exact = c.select(F.col("c_custkey").alias("v"), ((F.col("c_acctbal") + 1000) / 12000).alias("pc"))
    return exact, c.select(F.col("c_custkey").alias("v"), ((F.col("c_acctbal") + 1000 + F.pmod(F.col("c_custkey") * 7919, F.lit(500))) / 12000).alias("pc"))


def _runs(spark, sf):
    shift = lambda r: F.pmod(F.col("c_custkey") * 7919 + r * 331, F.lit(500 + 100 * r))
    parts = [table(spark, sf, "customer").select(F.lit(f"r{r}").alias("run_id"), F.col("c_custkey").alias("v"), ((F.col("c_acctbal") + 1000 + shift(r)) / 12000).alias("pc")) for r in range(3)]
    return T.union_all(parts)


@query
def sup_deviation(spark, sf):
    return rounded(V.sup_deviation(*_scores(spark, sf)))


@query
def mean_squared_error(spark, sf):
    return rounded(V.mean_squared_error(*_scores(spark, sf)), 12)


@query
def min_h(spark, sf):
    return V.min_h(*_scores(spark, sf), 50)


@query
def topk_overlap(spark, sf):
    return rounded(V.overlap(*_scores(spark, sf), 50))


@query
def correlations(spark, sf):
    exact, estimate = _scores(spark, sf)
    return rounded(V.correlations(exact, estimate))


@query
def error_report(spark, sf):
    return rounded(V.error_report(_scores(spark, sf)[0], _runs(spark, sf)))


@query
def ranking_report(spark, sf):
    return rounded(V.ranking_report(_scores(spark, sf)[0], _runs(spark, sf), 50))


@query
def times_report(spark, sf):
    o = table(spark, sf, "orders")
    runs = o.select(F.col("o_orderstatus").alias("graph"), F.col("o_orderpriority").alias("algo"), (F.col("o_totalprice") / 1000).alias("time_s"), F.col("o_custkey").alias("sample_size"), (F.col("o_orderkey") % 97).cast("double").alias("xi"))
    return rounded(V.times_report(runs), 6)


@query
def graph_report(spark, sf):
    g, x = both(spark, sf)
    return rounded(V.graph_report("user_purchase_60", g, C.target(g, x)), 7)


@query
def distance_report(spark, sf):
    g = graph100(spark, sf)
    return rounded(V.distance_report("user_purchase_100", g, T.distance_summary(g, T.shortest_paths(g))))


# Sources and sinks


def _folder(spark, name):
    import uuid

    from spreadrank.functions.lineage import shared_folder

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query
def edge_text_round_trip(spark, sf):
    from spreadrank.sources import readers, sinks

    path = _folder(spark, "edges")
    sinks.write_edges(user_purchase(spark, sf), path, "\t")
    return readers.read_graph(spark, path, directed=False, sep="\t").edges


@query
def score_round_trip(spark, sf):
    from spreadrank.sources import readers, sinks

    path, (exact, estimate) = _folder(spark, "scores"), _scores(spark, sf)
    sinks.write_scores(exact, path, "a", "customers", "exact", append=False)
    sinks.write_scores(estimate.withColumn("pc", F.col("pc") - 0.05), path, "b", "customers", "shifted")
    return rounded(readers.read_scores(spark, path).select("run_id", "algo", "v", "pc"))


@query
def labelled_edges_round_trip(spark, sf):
    from spreadrank.sources import readers

    path, t = _folder(spark, "labelled"), table(spark, sf, "nation")
    lines = t.orderBy("n_nationkey").select(F.concat(F.lit("n"), "n_nationkey", F.lit("  r"), "n_regionkey", F.lit(" x")).alias("value"))
    notes = spark.range(1).select(F.explode(F.array(F.lit("# nations"), F.lit(""), F.lit("alone"))).alias("value"))
    notes.unionByName(lines).coalesce(1).write.text(path)
    edges, ids = readers.read_labelled_edges(spark, path)
    a, b = (ids.select(F.col("label").alias(name), F.col("id").alias(at)) for name, at in (("a", "src"), ("b", "dst")))
    return edges.join(a, "src").join(b, "dst").select("src", "a", "dst", "b")


@query
def state_text_round_trip(spark, sf):
    from spreadrank.sources import readers, sinks

    path = _folder(spark, "states")
    sinks.write_states(error_rates(spark, sf), path, text=True)
    return rounded(readers.read_states(spark, path))


@query
def labelled_state_text(spark, sf):
    from spreadrank.sources import readers

    path = _folder(spark, "labelled-states")
    error_rates(spark, sf).select(F.concat(F.lit("u"), "v", F.lit(" \t"), F.col("x").cast("string"), F.lit(" "))).write.text(path)
    return rounded(readers.read_labelled_state_file(spark, path))


def _write_status_runs(spark, sf, path):
    """A run record for each order status."""
    from spreadrank.sources import sinks

    by = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("o_totalprice").cast("double")).alias("p"))
    for r in by.orderBy("o_orderstatus").collect():  # three at most
        sinks.write_run(spark, path, r.o_orderstatus, "orders", "count", r.p / 1000, r.p / 2000, r.n, 1 / r.n)


@query
def run_records_round_trip(spark, sf):
    from spreadrank.sources import readers

    path = _folder(spark, "runs")
    _write_status_runs(spark, sf, path)
    key = ["run_id", "graph", "algo"]
    times, est = readers.read_times(spark, path), readers.read_times(spark, path, estimation=True).withColumnRenamed("time_s", "est_time_s")
    return rounded(times.join(est, key).join(readers.read_sample_sizes(spark, path), key).join(readers.read_xi(spark, path), key), 6)


@query
def distance_round_trip(spark, sf):
    from spreadrank.sources import readers, sinks

    path = _folder(spark, "distances")
    for t in (60, 100):
        g = user_purchase(spark, sf, t)
        d = T.distance_summary(g, T.shortest_paths(g)).first()
        sinks.write_distances(spark, path, f"user_purchase_{t}", d.diameter, d.mean_distance, 0.0)
    return rounded(readers.read_distances(spark, path))


@query
def d_v_round_trip(spark, sf):
    from spreadrank.sources import sinks

    path = _folder(spark, "dv")
    sinks.write_distortion(X.distortion(error_rates(spark, sf)), path, "users")
    values, summary = (spark.read.parquet(f"{path}/{part}") for part in ("values", "summary"))
    return rounded(values.join(F.broadcast(summary), "graph"))  # one row


@query
def exact_run_round_trip(spark, sf):
    from spreadrank.sources import readers, sinks

    path, (g, x) = _folder(spark, "exact"), both(spark, sf)
    between, target = C.betweenness_and_target(g, x)
    sinks.save_exact("user_purchase_60", "betweenness", between, path, 2.0)
    sinks.save_exact("user_purchase_60", "target", target, path, 1.0, d_v=X.distortion(x))
    scores = readers.read_scores(spark, f"{path}/scores").join(spark.read.parquet(f"{path}/dv/values").select("v", "d_v"), "v")
    return rounded(scores.join(readers.read_times(spark, f"{path}/runs").select("run_id", "time_s"), "run_id").select("run_id", "graph", "algo", "v", "pc", "d_v", "time_s"))


@query
def progressive_run_round_trip(spark, sf):
    from spreadrank.sources import readers, sinks

    path, (g, x) = _folder(spark, "progressive"), both(spark, sf)
    scores = E.estimate_kappa(g, x, SAMPLES)
    sinks.save_progressive("user_purchase_60", "kappa", "a", P.Progress(scores, SAMPLES, 0.25, 0.0), path, 2.0, 1.0, d_v=X.distortion(x))
    sinks.save_progressive("user_purchase_60", "kappa", "b", P.Progress(scores.limit(0), 0, 0.0, 0.0), path, 2.0)
    runs = spark.read.parquet(f"{path}/runs").select("run_id", "time_s", "est_time_s", "sample_size", "xi", "max_d_v")
    return rounded(runs.join(readers.read_scores(spark, f"{path}/scores").select("run_id", "v", "pc"), "run_id", "left"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_target_pc(spark, sf_dir)


HEADLINE = ["exact_target_pc", "exact_target_pc_directed", "estimate_kappa", "estimate_uniform", "kappa_sums", "d_v", "distance_summary", "betweenness"]
