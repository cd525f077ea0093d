"""Results at sizes that all pairs of rows would not allow, and the faster ways against the plain ones."""

import random

import numpy as np
from pyspark.sql import functions as F

from spreadrank.functions.draws import uniform_array
from spreadrank.operators import evaluate, sampling


def test_kendall_counts_pairs_in_blocks(spark):
    r = random.Random(3)
    draw = {0: lambda: r.random(), 1: lambda: float(r.randint(0, 3)), 2: lambda: 7.0 if r.random() < 0.8 else r.random()}
    for kind in ((0, 0), (0, 1), (2, 1), (2, 2)):
        rows = [(v, draw[kind[0]](), draw[kind[1]]()) for v in range(1500)]
        sign = lambda x: (x > 0) - (x < 0)
        pairs = [(sign(a - c), sign(b - d)) for k, (_, a, b) in enumerate(rows) for _, c, d in rows[:k]]
        want = sum(x * y for x, y in pairs) / (sum(abs(x) for x, _ in pairs) * sum(abs(y) for _, y in pairs)) ** 0.5
        both = spark.createDataFrame(rows, "v long, a double, b double")
        assert abs(spark.range(1).select(evaluate.tau(both)).first()[0] - want) < 1e-12


def test_correlations_of_a_large_table(spark):
    """5e9 pairs: no join of all with all."""
    exact = spark.range(100_000).select(F.col("id").alias("v"), F.col("id").cast("double").alias("pc"))
    out = evaluate.correlations(exact, exact.withColumn("pc", -F.col("pc"))).first()
    assert abs(out.kendall + 1) < 1e-12 and abs(out.spearman + 1) < 1e-9


def test_listed_pairs_without_the_list(spark):
    """The rows of the list's running sum, from a table whose list would have 5e9 pairs, and the same by brute force on a small one."""
    r = random.Random(5)
    own = sorted((r.randint(0, 12) / 16, v) for v in range(90))
    high, pairs = 0.0, []
    for x, s in own:
        for y, z in own:
            if x > y:
                pairs.append((high, high := high + x - y, s, z))
    states = spark.createDataFrame([(v, x) for x, v in own], "v long, x double")
    got = {w.sample: (w.s, w.z) for w in sampling.kappa_pairs_listed(states, 400).collect()}
    u = uniform_array(np.arange(400), np.full(400, 2)) * high
    assert got == {k: next((s, z) for a, b, s, z in pairs if a <= t < b) for k, t in enumerate(u)}
    many = spark.range(100_000).select(F.col("id").alias("v"), (F.col("id") / 100_000).alias("x"))
    assert sampling.kappa_pairs_listed(many, 200).count() == 200
