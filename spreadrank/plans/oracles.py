"""DuckDB SQL for the registered queries, written another way than the engine works: closures, path counts and all-pairs joins."""

from __future__ import annotations


from spreadrank.functions.draws import uniform_sql as u
from spreadrank.plans.queries import SAMPLES

RAW = "events_of as (select user_id, ts, event_id from events where event_type = 'purchase' and value > {t}), nx as (select user_id a, lead(user_id) over (order by ts, event_id) b from events_of)"


def edges(above: int = 60, directed: bool = False) -> str:
    """CTEs: e0 (u, v) edges, e arcs, vx vertices."""
    e0 = "select distinct a u, b v from nx where b is not null and a <> b" if directed else "select distinct least(a, b) u, greatest(a, b) v from nx where b is not null and a <> b"
    e = "select u, v from e0" if directed else "select u, v from e0 union all select v, u from e0"
    return f"{RAW.format(t=above)}, e0 as ({e0}), e as ({e}), vx as (select u v from e0 union select v from e0)"


RATES = "xs as (select user_id v, cast(sum(case when event_type = 'error' then 1 else 0 end) as double) / count(*) x from events group by 1)"
STATES = RATES + ", st as (select v, x from xs semi join vx using (v))"
#: All-pairs sums: total, and for each vertex the sum without its pairs.
KAPPA = "tot as (select sum(greatest(a.x - b.x, 0)) t from {s} a, {s} b), own as (select a.v, sum(abs(a.x - b.x)) g from {s} a, {s} b group by 1), ms as (select s.v, s.x, t, t - g m from {s} s join own using (v), tot)"
#: Distances by closure, path counts by listing paths.
PATHS = """w(s, v, d) as (select v, v, 0 from {src} union select w.s, e.v, w.d + 1 from w join e on e.u = w.v where w.d < 14),
dist as (select s, v, min(d) d from w group by 1, 2),
p(s, v, d) as (select v, v, 0 from {src} union all select p.s, e.v, p.d + 1 from p join e on e.u = p.v join dist t on t.s = p.s and t.v = e.v and t.d = p.d + 1),
sg as (select s, v, d, count(*)::double c from p group by 1, 2, 3)"""
#: Shares of shortest s-z paths through v.
SHARES = "sh as (select a.s, b.v z, a.v, a.c * b.c / c.c f from sg a join sg b on b.s = a.v join sg c on c.s = a.s and c.v = b.v and c.d = a.d + b.d where a.d > 0 and b.d > 0)"


def whole(above: int = 60, directed: bool = False, src: str = "vx", shares: bool = True) -> str:
    return f"with recursive {edges(above, directed)}, {STATES}, {PATHS.format(src=src)}" + (f", {SHARES}" if shares else "")


def target(directed: bool = False, states: str = "st") -> str:
    return f"""{whole(60, directed)}, {KAPPA.format(s=states)}, q as (select sh.v, sum(f * (a.x - b.x)) q from sh join {states} a on a.v = s join {states} b on b.v = z where a.x > b.x group by 1),
u as (select vx.v, coalesce(q, 0) q from vx left join q using (v))"""


UNIFORM = "ids as (select v, row_number() over (order by v) - 1 i, count(*) over () n from {s}), up as (select sample, a.v s, z.v z from (select sample, floor({u0} * n)::bigint i, (floor({u0} * n)::bigint + 1 + floor({u1} * (n - 1))::bigint) % n k from range({m}) r(sample), (select max(n) n from ids)) join ids a using (i) join ids z on z.i = k)"


def uniform_pairs(source: str, m: int = SAMPLES) -> str:
    return UNIFORM.format(s=source, u0=u("sample", "0"), u1=u("sample", "1"), m=m)


def kappa_pairs(m: int = SAMPLES, source_law: str = "kappa") -> str:
    """CTE kp (sample, s, z)."""
    mass = "ma as (select a.v, a.x, sum(greatest(a.x - b.x, 0)) m from st a, st b group by 1, 2 having m > 0)"
    if source_law == "kappa":
        src = f"src as (select sample, s, xs, {u('sample', '3')} * m t from (select sample, {u('sample', '2')} * (select sum(m) from ma) t0 from range({m}) r(sample)) join (select v s, x xs, m, sum(m) over (order by x, v rows unbounded preceding) hi from ma) on t0 >= hi - m and t0 < hi)"
    else:
        src = f"src as (select sample, v s, x xs, {u('sample', '3')} * m t from range({m}) r(sample) join (select *, row_number() over (order by v) - 1 i, count(*) over () n from ma) on i = floor({u('sample', '2')} * n))"
    z = "kp as (select sample, s, v z from src join (select a.v s2, b.v, a.x - b.x g, sum(a.x - b.x) over (partition by a.v order by b.x, b.v rows unbounded preceding) hi from st a join st b on a.x > b.x) on s2 = s and t >= hi - g and t < hi)"
    return f"{mass}, {src}, {z}"


#: Samples by the VC bound at eps 0.2 and delta 0.1, from the diameter of all sources.
VC = "vc as (select floor(0.5 / pow(0.2::double, 2) * (log2(greatest(max(d), 1)) + 1 + ln(20)))::bigint k from dist)"


def drawn_by_vc() -> str:
    return kappa_pairs(0).replace("range(0) r(sample)", "(select unnest(range((select k from vc))) sample) r")


FRACTIONS = "fr as (select sample, sh.v, f from kp join sh using (s, z))"
#: Drawn paths: intervals of predecessors by id, then back from z.
WALK = f"pr as (select t.s, t.v w, q.v p, sum(q.c) over (partition by t.s, t.v order by q.v rows unbounded preceding) hi, q.c, t.c whole, q.d from sg t join e on e.v = t.v join sg q on q.s = t.s and q.v = e.u and q.d = t.d - 1), bk(sample, s, v, d) as (select sample, kp.s, z, d from kp join sg on sg.s = kp.s and sg.v = z union all select sample, bk.s, p, pr.d from bk join pr on pr.s = bk.s and pr.w = bk.v where pr.d > 0 and {u('sample', 'pr.d + 50')} * whole >= hi - c and {u('sample', 'pr.d + 50')} * whole < hi), wk as (select sample, bk.v, bk.d from bk join kp using (sample) where bk.v <> z)"
SCORES = "ex as (select c_custkey v, (c_acctbal + 1000) / 12000 pc from customer), es as (select c_custkey v, (c_acctbal + 1000 + (c_custkey * 7919) % 500) / 12000 pc from customer)"
RUNS = "ru as (" + " union all ".join(f"select 'r{r}' run_id, c_custkey v, (c_acctbal + 1000 + (c_custkey * 7919 + {r * 331}) % {500 + 100 * r}) / 12000 pc from customer" for r in range(3)) + ")"
CLOSURE = "reach(s, v) as (select v, v from vx union select reach.s, e.v from reach join e on e.u = reach.v)"
SUMMARY = """select max(d)::bigint diameter, count(*) filter (d > 0) reachable, round((count(*) filter (d > 0))::double / ((count(*) filter (d = 0)) * ((select count(*) from vx) - 1)), 9) connectivity,
round(sum(d)::double / count(*) filter (d > 0), 9) mean_distance, round((sum(d) - count(*) filter (d > 0))::double / count(*), 9) rho_legacy from dist"""


def _bounds() -> str:
    hist, m, d, dia = {0: 10, 1: 60, 2: 25, 3: 5}, 100, 0.1, 8
    mean = sum(k * n for k, n in hist.items()) / m
    var = sum(n * (k - mean) ** 2 for k, n in hist.items()) / (m - 1)
    c = "(ln(100) / 1000)"
    empirical = f"(0.02 + sqrt(4 * 0.01 * {c} / 25))"
    complexity = f"({empirical} + {c} + sqrt(2 * {c} * {empirical} + {c} * {c}))"
    rate = lambda v, eps: f"({v} * ((1 + {eps} / {v}) * ln(1 + {eps} / {v}) - {eps} / {v}))"
    at = lambda x, eps: f"(ln(2 * 3 / ({x} * 0.05)) / {rate(f'({x} * (1 - {x}))', eps)})"
    rows = {
        "vc": "floor(0.5 / (0.05 * 0.05) * (log2(9) + 1 + ln(20)))",
        "first": "floor((1 + 0.4 + sqrt(1.8) * ln(60)) / (4 * 0.0025))",
        "bootstrap": "floor(greatest(floor(greatest(ln(10) / 0.01, 100)), 18 * ln(10)))",
        "top1": "0.1 + ln(80) / 100 + sqrt(2 * ln(80) / 100 * 0.1 + pow(ln(80) / 100, 2))",
        "mcera": f"2 * {complexity} + sqrt(2 * {c} * (0.01 + {c} + sqrt({c} * {c} + 2 * {c} * 0.01) + 4 * {complexity}))",
        "samples_at": "ln(2 * 3 / (0.1 * 0.05)) / (0.09 * ((1 + 0.05 / 0.09) * ln(1 + 0.05 / 0.09) - 0.05 / 0.09))",
        "bernstein": "sqrt(2 * 0.01 * ln(4000) / 1000) + 7 * ln(4000) / 2997",
        "mean_length": f"least({mean} + {dia - 2} * ln(10) / {m} + sqrt(2 * {(dia - 2) / m} * ln(10) * {dia} + pow({(dia - 2) / m} * ln(10), 2)), {mean} + 7.0 / 3 * {dia - 2} * ln({2 / d}) / {m} + sqrt(2 * {var} * ln({2 / d}) / {m}), {dia - 2})",
        "next": "100 * 1.2",
        "first_stop": "(select min(n) from range(1, 2501) t(n) where sqrt(2 * 0.1 * ln(20) / n) + ln(20) / n / 3 <= 0.05)",
        "samples_bound": f"greatest({at('(0.5 - sqrt(0.25 - 0.05))', 0.05)}, {at('(0.999 * (0.5 - sqrt(0.25 - 0.05)))', 0.05)})",
        "samples_bound_even": f"(with recursive h(k, a, b) as (select 0, 0.2::double, 0.25::double union all select k + 1, case when {rate('((a + b) / 2)', 0.1)} > 0.02 then (a + b) / 2 else a end, case when {rate('((a + b) / 2)', 0.1)} > 0.02 then b else (a + b) / 2 end from h where k < 60), r as (select 0.5 - sqrt(0.25 - b) x from h where k = 60) select greatest({at('x', 0.1)}, {at('(0.999 * x)', 0.1)}) from r)",
    }
    return "select name, round(value::double, 6) as value from (" + " union all ".join(f"select '{k}' as name, ({v})::double as value" for k, v in rows.items()) + ")"


def estimate(rows: str, samples: int, factor: str = "1") -> str:
    """Means over samples of rows (v, f)."""
    return f"select vx.v, round(coalesce(sum(f), 0) * {factor} / {samples}, 9) pc from vx left join ({rows}) r using (v) group by 1"


NN = "(select count(*) * (count(*) - 1.0::double) from vx)"
WEIGHT = "uw as (select sample, s, z, (a.x - b.x) / t wt from up join st a on a.v = s join st b on b.v = z, tot where a.x > b.x)"
ANCHOR = f"(select v from {{c}} order by {u('v', '40')}, v limit {{k}})"
SIGNS = f"case when {u('sample', 'trial + 1000')} < 0.5::double then -1.0 else 1.0 end"


def gadget(pool: str, k: str, into_only: bool, new: int = 10) -> str:
    ties = f"ties as (select v src, (select max(v) from vx) + 1 dst from {ANCHOR.format(c=pool, k=k)})"
    chain = f"ch as (select i + (select max(v) from vx) src, i + 1 + (select max(v) from vx) dst from range(1, {new}) r(i))"
    return f"{ties}, {chain}"


def oracles() -> dict[str, str]:
    w = f"with {edges()}"
    wd = f"with {edges(60, True)}"
    lists = lambda k, v, name: f"select {k} v, string_agg({v}, ',' order by {v}) {name} from e group by 1"
    big = "big as (select c from cc group by 1 order by count(*) desc, c limit 1), lc as (select v from cc where c = (select c from big))"
    weak130 = f"with recursive {edges(130)}, {CLOSURE}, cc as (select s v, min(v) c from reach group by 1), {big}"
    strong = lambda t: f"with recursive {edges(t, True)}, {CLOSURE}, cc as (select a.s v, max(a.v) c from reach a join reach b on b.s = a.v and b.v = a.s group by 1), {big}"
    kap = f"with {RATES}, {KAPPA.format(s='xs')}"
    out = {
        "edges_undirected": f"{w} select u src, v dst from e0",
        "edges_directed": f"{wd} select u src, v dst from e0",
        "nation_trade_edges": "select distinct least(c_nationkey, s_nationkey)::bigint src, greatest(c_nationkey, s_nationkey)::bigint dst from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where c_nationkey <> s_nationkey",
        "adjacency": f"{w} {lists('u', 'v', 'neighbours')}",
        "in_adjacency": f"{wd} {lists('v', 'u', 'neighbours')}",
        "degree_table": f"{wd} select v, (select count(*) from e where u = vx.v) out_degree, (select count(*) from e where e.v = vx.v) in_degree from vx",
        "static_graph": f'{wd} select v, coalesce(o, \'\') "out", coalesce(i, \'\') "in", coalesce(od, 0) out_degree, coalesce(id, 0) in_degree from vx left join (select u v, string_agg(v, \',\' order by v) o, count(*) od from e group by 1) using (v) left join (select v, string_agg(u, \',\' order by u) i, count(*) id from e group by 1) using (v)',
        "graph_stats": f"{w} select (select count(*) from vx) n_vertices, (select count(*) from e0) n_edges, false directed",
        "dense_ids": f"{w} select v, row_number() over (order by v) - 1 id from vx",
        "labelled_states_join": "select c_custkey v, case when exists (select 1 from events where event_type = 'signup' and user_id = c_custkey) then length('u' || c_custkey) / 10.0::double else 0.0::double end x from customer",
        "components": f"{weak130} select v, c component from cc",
        "largest_component": f"{weak130} select v from lc",
        "strong_components": f"{strong(100)} select v, c component from cc",
        "largest_strong_component": f"{strong(130)} select v from lc",
        "gadget_graph": f"{w}, {gadget('vx', 'floor(ln((select count(*) from vx)))::bigint', False)}, ge as (select u src, v dst from e0 union select src, dst from ties union select src, dst from ch), gx as (select v, 0.0::double x from vx union all select (select max(v) from vx) + 1 + i, (i >= 5)::int::double from range(10) r(i)) select src, dst, a.x x_src, b.x x_dst from ge join gx a on a.v = src join gx b on b.v = dst",
        "gadget_lcc": f"{weak130}, {gadget('lc', '1', False)} select u src, v dst from e0 union select src, dst from ties union select src, dst from ch",
        "gadget_lcc_in": f"{strong(130)}, {gadget('lc', '1', True)} select u src, v dst from e0 union select src, dst from ties union select src, dst from ch union select dst, src from ch",
        "state_stats": f"with {RATES} select round(max(x), 9) max_x, round(min(x), 9) min_x, round(avg(x), 9) mean_x, round(stddev_samp(x), 9) std_x from xs",
        "ramp_arcs": f"{w}, {RATES} select u src, e.v dst, round(greatest(a.x - b.x, 0), 9) r from e join xs a on a.v = u join xs b on b.v = e.v",
        "kappa_total": f"{kap} select round(t, 9) total from tot",
        "kappa_sums": f"{kap} select v, round(x, 9) x, round(t, 9) total, round(m, 9) minus_sum from ms",
        "outgoing_mass": f"with {RATES} select a.v, round(a.x, 9) x, round(sum(greatest(a.x - b.x, 0)), 9) mass from xs a, xs b group by a.v, a.x",
        "d_v": f"{kap} select v, round(t / m, 9) d_v from ms",
        "d_v_legacy": f"{kap} select v, round(1 + (t - m + x) / m, 9) d_v from ms",
        "d_v_summary": f"{kap} select round(min(t / m), 9) min_d_v, round(max(t / m), 9) max_d_v, count(*) n from ms",
        "d_v_sampled": f"{kap}, {uniform_pairs('xs')}, po as (select s, z from up join xs a on a.v = s join xs b on b.v = z where a.x > b.x) select v, round(case when exists (select 1 from po where s <> ms.v and z <> ms.v) then t / m end, 9) d_v from ms",
        "state_log_buckets": f"with {RATES} select v, (floor(ln(case when x > 0 then least(1 / x, n) else n end) / ln(2) + 1e-12::double) + 1)::bigint bucket from xs, (select count(*)::double n from xs)",
        "state_abc_partition": f"with {RATES} select v, round(x, 9) x, case when x >= 0.25::double then 'A' when x <= 0.15::double then 'B' else 'C' end part from xs",
        "uniform_states": f"{w} select v, round({u('v', '20')}, 9) x from vx",
        "initiator_states": f"{w} select v, (row_number() over (order by {u('v', '21')}, v) <= 7)::int::double x from vx",
        "spread_states": f"with recursive {edges()}, ids as (select v, row_number() over (order by v) - 1 i, count(*) over () n from vx), c0 as (select distinct v from range(3) r(k), ids where i = floor({u('k', '22')} * n)), w(v, d) as (select v, 0 from c0 union select e.v, d + 1 from w join e on e.u = w.v where d < 2) select vx.v, round(coalesce(pow(4.0::double, -min(d)), 0), 9) x from vx left join w using (v) group by 1",
        "range_states": f"{w} select v, round(case when i <= 5 then 1.0::double when i <= n - 4 then {u('v', '23')} else 0.0::double end, 9) x from (select v, row_number() over (order by v) i, count(*) over () n from vx)",
        "mixed_states": f"{w} select v, round(case when i <= n - 9 then {u('v', '25')} when i <= n - 6 then 0.01::double when i <= n - 4 then 0.0::double else 1.0::double end, 9) x from (select v, row_number() over (order by {u('v', '24')}, v) i, count(*) over () n from vx)",
        "bfs_distances": f"{whole(shares=False)} select s, v, d::bigint d from dist",
        "sigma_counts": f"{whole(60, True, shares=False)} select s, v, d::bigint d, c::bigint sigma from sg",
        "eccentricity": f"{whole(shares=False)} select s v, max(d)::bigint ecc from dist group by 1",
        "distance_histogram": f"{whole(100, shares=False)} select d::bigint d, count(*) pairs from dist group by 1",
        "distance_summary": f"{whole(100, shares=False)} {SUMMARY}",
        "distance_summary_directed": f"{whole(100, True, shares=False)} {SUMMARY}",
        "sampled_distance_summary": f"{whole(100, src=ANCHOR.format(c='vx', k=20).replace(u('v', '40'), u('v', '30')), shares=False)} {SUMMARY}",
        "hop_table": f"{whole(100, shares=False)} select d::bigint d, (sum(count(*)) over (order by d))::bigint \"within\", count(*) pairs from dist group by d",
        "hop_mean": f"{whole(100, shares=False)} select round(sum(d)::double / count(*), 9) mean_distance from dist where d > 0",
        "exact_target_pc": f"{target()} select v, round(q / t, 9) pc from u, tot",
        "exact_target_pc_directed": f"{target(True)} select v, round(q / t, 9) pc from u, tot",
        "exact_report": f"{target()} select v, round(q / t, 7) pc, round(q, 7) unnormalised, round(t, 7) total, round(t / m, 7) d_v from u join ms using (v)",
        "per_vertex_pc": f"{target()} select v, round(q / m, 9) pc from u join ms using (v)",
        "renormalised_pc": f"{target()} select v, round(q / m, 9) pc from u join ms using (v)",
        "betweenness": f"{whole()} select vx.v, round(coalesce(sum(f), 0), 6) pc from vx left join sh using (v) group by 1",
        "pair_normalised_betweenness": f"{whole()} select vx.v, round(coalesce(sum(f), 0) / {NN}, 9) pc from vx left join sh using (v) group by 1",
        "initiators_target_pc": f"{whole()}, ini as (select v, (row_number() over (order by {u('v', '21')}, v) <= 7)::int::double x from vx), {KAPPA.format(s='ini')}, q as (select sh.v, sum(f * (a.x - b.x)) q from sh join ini a on a.v = s join ini b on b.v = z where a.x > b.x group by 1) select vx.v, round(coalesce(q, 0) / t, 9) pc from vx left join q using (v), tot",
        "uniform_pairs": f"{w}, {uniform_pairs('vx')} select sample, s, z from up",
        "kappa_pairs": f"{w}, {STATES}, {kappa_pairs()} select sample, s, z from kp",
        "kappa_pairs_listed": f"{w}, {STATES}, pw as (select a.v s, b.v z, a.x - b.x g, sum(a.x - b.x) over (order by a.x, a.v, b.x, b.v rows unbounded preceding) hi from st a join st b on a.x > b.x) select sample, s, z from (select sample, {u('sample', '2')} * (select sum(g) from pw) t from range({SAMPLES}) r(sample)) join pw on t >= hi - g and t < hi",
        "uniform_source_pairs": f"{w}, {STATES}, {kappa_pairs(source_law='uniform')} select sample, s, z from kp",
        "pair_fractions": f"{whole()}, {kappa_pairs()}, {FRACTIONS} select sample, v, round(f, 9) f from fr",
        "sampled_paths": f"{whole(shares=False)}, {kappa_pairs()}, {WALK} select sample, v, d::bigint d from wk",
        "estimate_kappa": f"{whole(shares=False)}, {kappa_pairs()}, {WALK} {estimate('select v, 1.0::double f from wk', SAMPLES)}",
        "estimate_kappa_pair_exact": f"{whole()}, {kappa_pairs()}, {FRACTIONS} {estimate('select v, f from fr', SAMPLES)}",
        "estimate_uniform": f"{whole(shares=False)}, {KAPPA.format(s='st')}, {uniform_pairs('st')}, {WEIGHT}, kp as (select sample, s, z from uw), {WALK} {estimate('select wk.v, wt f from wk join uw using (sample)', SAMPLES, NN)}",
        "estimate_uniform_pair_exact": f"{whole()}, {KAPPA.format(s='st')}, {uniform_pairs('st')}, {WEIGHT} {estimate('select sh.v, f * wt f from uw join sh using (s, z)', SAMPLES, NN)}",
        "era_squares": f"{whole()}, {KAPPA.format(s='st')}, {uniform_pairs('st')}, {WEIGHT} select sh.v, round(sum(f * wt), 12) b1, round(sum(f * wt * f * wt), 12) b2 from uw join sh using (s, z) group by 1",
        "sample_variances": f"{whole()}, {kappa_pairs()}, {FRACTIONS} select vx.v, round((coalesce(sum(f * f), 0) - pow(coalesce(sum(f), 0), 2) / {SAMPLES}) / {SAMPLES - 1}, 9) variance from vx left join fr using (v) group by 1",
        "bernstein_errors": f"{whole()}, {kappa_pairs()}, {FRACTIONS}, va as (select vx.v, (coalesce(sum(f * f), 0) - pow(coalesce(sum(f), 0), 2) / {SAMPLES}) / {SAMPLES - 1} k from vx left join fr using (v) group by 1) select round(max(sqrt(2 * k * ln(40.0 * n) / {SAMPLES}) + 7 * ln(40.0 * n) / (3 * {SAMPLES - 1})), 9) error from va, (select count(*) n from vx)",
        "peeling_partitions": f"{whole()}, {kappa_pairs()}, {FRACTIONS} select v, trunc(ln(case when k > 0 then least(1 / k, {SAMPLES}) else {SAMPLES} end) / ln(2) + 1)::bigint part from (select vx.v, coalesce(sum(f * f), 0) / {SAMPLES} k from vx left join fr using (v) group by 1)",
        "rademacher_sums": f"{whole()}, {kappa_pairs()}, {FRACTIONS} select v, trial::bigint trial, round(sum(f * {SIGNS}), 9) t from fr, range(5) r(trial) group by 1, 2",
        "estimate_fixed_vc": f"{whole(shares=False)}, {VC}, {drawn_by_vc()}, {WALK} select vx.v, round(coalesce(sum(f), 0) / (select k from vc), 9) pc, (select k from vc) samples from vx left join (select v, 1.0::double f from wk) r using (v) group by 1",
        "bounds_table": _bounds(),
        "sup_deviation": f"with {SCORES} select round(max(abs(ex.pc - es.pc)), 9) sd from ex join es using (v)",
        "mean_squared_error": f"with {SCORES} select round(avg(pow(ex.pc - es.pc, 2)), 12) mse from ex join es using (v)",
        "min_h": f"with {SCORES}, a as (select v, row_number() over (order by pc desc, v) r from ex), b as (select v, row_number() over (order by pc desc, v) q from es) select max(q) h from a join b using (v) where r <= 50",
        "topk_overlap": f"with {SCORES}, a as (select v, row_number() over (order by pc desc, v) r from ex), b as (select v, row_number() over (order by pc desc, v) q from es) select j, c common, round(c / (2 * j - c)::double, 9) jaccard from (select j, (select count(*) from a join b using (v) where r <= j and q <= j) c from range(1, 51) t(j))",
        "correlations": f"with {SCORES}, j as (select v, ex.pc a, es.pc b from ex join es using (v)), r as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0::double x, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0::double y from j), k as (select sum(sign(p.a - q.a) * sign(p.b - q.b)) / sqrt(sum(abs(sign(p.a - q.a)))::double * sum(abs(sign(p.b - q.b)))) t from j p, j q where p.v < q.v) select (select round(corr(a, b), 9) from j) pearson, (select round(corr(x, y), 9) from r) spearman, (select round(t, 9) from k) kendall",
        "error_report": f"with {SCORES}, {RUNS}, m as (select v, case when avg(pc) > 1 then 0 else avg(pc) end pc from ru group by 1), g as (select run_id, max(abs(ru.pc - ex.pc)) s, avg(pow(ru.pc - ex.pc, 2)) q from ru join ex using (v) group by 1) select (select round(max(abs(m.pc - ex.pc)), 9) from m join ex using (v)) sd, (select round(avg(pow(m.pc - ex.pc, 2)), 9) from m join ex using (v)) mse, round(avg(s), 9) sd_avg, round(stddev_samp(s), 9) sd_std, round(avg(q), 9) mse_avg, round(stddev_samp(q), 9) mse_std from g",
        "ranking_report": f"with {SCORES}, {RUNS}, a as (select v from ex order by pc desc, v limit 50), b as (select run_id, v, row_number() over (partition by run_id order by pc desc, v) q from ru), g as (select run_id, count(*) filter (q <= 50) i, max(q) h from a join b using (v) group by 1) select 50::bigint k, count(*) runs, round(avg(i), 9) intersection_mean, round(stddev_samp(i), 9) intersection_std, round(avg(h), 9) h_mean, round(stddev_samp(h), 9) h_std, round(avg(i / (100 - i)::double), 9) jaccard_mean, round(stddev_samp(i / (100 - i)::double), 9) jaccard_std from g",
        "times_report": "select o_orderstatus graph, o_orderpriority algo, round(avg(o_totalprice / 1000), 6) time_s_mean, round(stddev_samp(o_totalprice / 1000), 6) time_s_std, round(avg(o_custkey), 6) sample_size_mean, round(stddev_samp(o_custkey), 6) sample_size_std, round(avg(o_orderkey % 97), 6) xi_mean, round(stddev_samp(o_orderkey % 97), 6) xi_std from orders group by 1, 2",
        "graph_report": f"{target()} select 'user_purchase_60' graph, false directed, (select count(*) from vx) nodes, (select count(*) from e0) edges, round(sum(q / t), 7) sum_pc, round(max(q / t), 7) max_pc from u, tot",
        "distance_report": f"{whole(100, shares=False)} select 'user_purchase_100' graph, false directed, max(d)::bigint diameter, round(sum(d)::double / count(*) filter (d > 0), 9) rho, 0.0::double time_s from dist",
        "edge_text_round_trip": f"{w} select u src, v dst from e0",
        "score_round_trip": f"with {SCORES} select 'a' run_id, 'exact' algo, v, round(pc, 9) pc from ex union all select 'b', 'shifted', v, round(greatest(pc - 0.05::double, 0), 9) from es",
    }
    over = lambda rows, factor="1": f"select ms.v, round(coalesce(sum(f), 0) * {factor} / {SAMPLES} * t / m, 9) pc from ms left join ({rows}) r using (v) group by ms.v, t, m"
    states = KAPPA.format(s="st")
    out["estimate_kappa_per_vertex"] = f"{whole(shares=False)}, {states}, {kappa_pairs()}, {WALK} {over('select v, 1.0::double f from wk')}"
    out["estimate_kappa_per_vertex_pair_exact"] = f"{whole()}, {states}, {kappa_pairs()}, {FRACTIONS} {over('select v, f from fr')}"
    out["estimate_uniform_per_vertex"] = f"{whole(shares=False)}, {states}, {uniform_pairs('st')}, {WEIGHT}, kp as (select sample, s, z from uw), {WALK} {over('select wk.v, wt f from wk join uw using (sample)', NN)}"
    out["estimate_uniform_per_vertex_pair_exact"] = f"{whole()}, {states}, {uniform_pairs('st')}, {WEIGHT} {over('select sh.v, f * wt f from uw join sh using (s, z)', NN)}"
    out["labelled_edges_round_trip"] = "with l as (select 'n' || n_nationkey a, 'r' || n_regionkey b, n_nationkey k from nation), f as (select w, min(p) p from (select a w, 2 * k p from l union all select b, 2 * k + 1 from l) group by 1), i as (select w, row_number() over (order by p) - 1 id from f) select p.id src, a, q.id dst, b from l join i p on p.w = a join i q on q.w = b"
    out["state_text_round_trip"] = f"with {RATES} select row_number() over (order by v) v, round(x, 9) x from xs"
    out["labelled_state_text"] = f"with {RATES} select 'u' || v as label, round(x, 9) x from xs"
    out["run_records_round_trip"] = "select o_orderstatus run_id, 'orders' graph, 'count' algo, round(avg(o_totalprice::double) / 1000, 6) time_s, round(avg(o_totalprice::double) / 2000, 6) est_time_s, count(*) sample_size, round(1 / count(*)::double, 6) xi from orders group by 1"
    out["distance_round_trip"] = " union all ".join(f"select * from ({whole(t, shares=False)} select 'user_purchase_{t}' graph, max(d)::bigint diameter, round(sum(d)::double / count(*) filter (d > 0), 9) avg_distance, 0.0::double time_s from dist)" for t in (60, 100))
    out["d_v_round_trip"] = f"select 'users' graph, v, d_v, min(d_v) over () min, max(d_v) over () max, count(*) over () n from ({out['d_v']})"
    graph_d_v = f"({target()} select v, round(t / m, 9) d_v from ms)"
    out["exact_run_round_trip"] = f"select 'exact' run_id, 'user_purchase_60' graph, 'target' algo, v, pc, d_v, 1.0::double time_s from ({out['exact_target_pc']}) join {graph_d_v} using (v)"
    out["progressive_run_round_trip"] = f"select 'a' run_id, 2.0::double time_s, 1.0::double est_time_s, {SAMPLES}::bigint sample_size, 0.25::double xi, (select max(d_v) from {graph_d_v}) max_d_v, v, pc from ({out['estimate_kappa']}) union all select 'b', -1, -1, -1, -1, null, null, null"
    for name, directed, by in (("classical_pc", False, "1"), ("classical_pc_inner", True, "((select count(*) from vx) - 2)"), ("classical_pc_pairs", False, NN)):
        out[name] = f"{whole(60, directed)} select st.v, round(coalesce(sum(f * a.x), 0) / ((select sum(x) from st) - st.x) / {by}, {10 if name.endswith('pairs') else 9}) pc from st left join sh using (v) left join st a on a.v = s group by st.v, st.x"
    out["induced_target_pc"] = f"""with recursive {RAW.format(t=60)}, {RATES}, e9 as (select distinct least(a, b) u, greatest(a, b) v from nx where b is not null and a <> b), e0 as (select u, e9.v from e9 join xs a on a.v = u join xs b on b.v = e9.v where a.x > 0 and b.x > 0), e as (select u, v from e0 union all select v, u from e0), vx as (select u v from e0 union select v from e0), st as (select v, x from xs semi join vx using (v)), {PATHS.format(src='vx')}, {SHARES}, {KAPPA.format(s='st')}, q as (select sh.v, sum(f * (a.x - b.x)) q from sh join st a on a.v = s join st b on b.v = z where a.x > b.x group by 1) select vx.v, round(coalesce(q, 0) / t, 9) pc from vx left join q using (v), tot"""
    return out


ORACLES = oracles()
