"""Rows of a group of sources are written vertex by vertex, which takes a fraction of the disk."""

import pytest
from pyspark.sql import functions as F

from spreadrank.operators import blocks, traverse
from spreadrank.operators.graph import Graph


#: Bytes a row, with path counts or without.
LIMIT = {False: 1.2, True: 3.0}


def graph(spark, n) -> Graph:
    return Graph.of(spark.range(2 * n).select((F.col("id") % n).alias("src"), F.pmod(F.xxhash64("id"), F.lit(n)).alias("dst")))


def bytes_a_row(df, path) -> float:
    df.coalesce(1).write.parquet(str(path))
    return sum(f.stat().st_size for f in path.glob("*.parquet")) / df.sparkSession.read.parquet(str(path)).count()


@pytest.mark.parametrize("counts", [False, True])
def test_paths_take_little_disk(spark, tmp_path, counts):
    """Of more vertices than a store's reach; both queries' columns."""
    g, sources = graph(spark, 40_000), spark.range(128).withColumnRenamed("id", "s")
    extra = [F.col("sigma").cast("long").alias("sigma")] if counts else []
    assert bytes_a_row(traverse.shortest_paths(g, sources).select("s", "v", F.col("d").cast("long").alias("d"), *extra), tmp_path / "d") < LIMIT[counts]


def test_groups_and_batches_have_all_rows(spark, monkeypatch):
    """Groups of several blocks, of less than a block and of one source, and small batches; one source isn't in the graph."""
    sources = spark.createDataFrame([(k,) for k in range(40)] + [(9999,), (None,)], "s long")
    g = graph(spark, 3000).compact
    rows = lambda cells: sorted(map(tuple, blocks.paths_from(g, sources, cells).collect()))
    whole = rows(1 << 18)
    assert len({(s, v) for s, v, *_ in whole}) == len(whole) and (9999, 9999, 0, 1.0) in whole
    for name, value, cells in (("HELD", 1, 1 << 18), ("CELLS", 1 << 15, 100), ("TOGETHER", 7, 1000)):
        with monkeypatch.context() as m:
            m.setattr(blocks, name, value)
            assert rows(cells) == whole, name
