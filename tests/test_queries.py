"""Queries against their SQL over the smallest tables; all are compared over sf0.01 by the driver."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from spreadrank.plans.oracles import ORACLES
from spreadrank.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
SOME = ["edges_directed", "static_graph", "gadget_graph", "kappa_sums", "d_v_sampled", "sigma_counts", "exact_target_pc", "exact_target_pc_directed", "classical_pc", "induced_target_pc", "kappa_pairs", "sampled_paths", "estimate_uniform", "estimate_fixed_vc", "bounds_table", "min_h", "correlations", "score_round_trip"]


def plain(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert got == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLES) <= set(QUERIES)
