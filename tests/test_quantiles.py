"""Sort-based quantiles equal Spark's exact percentile."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators.quantiles import exact_quantiles


def test_exact_quantiles_global_and_grouped(spark):
    rnd = np.random.default_rng(0)
    vals = np.concatenate([rnd.normal(size=4000), np.full(1500, 3.25), rnd.integers(0, 50, 800).astype(float)])
    g = rnd.integers(0, 3, len(vals))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, vals)] + [(1, None)], "g long, x double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    arr = F.array(*[F.lit(p) for p in probs])
    got = exact_quantiles(df, "x", probs)[()]
    want = df.agg(F.percentile("x", arr)).first()[0]
    assert np.allclose(got, want, rtol=0, atol=1e-12)
    grouped = exact_quantiles(df, "x", probs, by=["g"])
    for r in df.groupBy("g").agg(F.percentile("x", arr).alias("q")).collect():
        assert np.allclose(grouped[(r.g,)], r.q, rtol=0, atol=1e-12)


def test_exact_quantiles_constant_and_single(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 7.0)], "g long, x double")
    out = exact_quantiles(df, "x", [0.5, 0.9], by=["g"])
    assert out == {(1,): [2.0, 2.0], (2,): [7.0, 7.0]}


def test_infinities_nulls_and_nothing(spark):
    inf = float("inf")
    rows = [(None, -inf), (None, 1.0), (None, inf), (1, 2.0), (1, None), (2, None), (2, float("nan"))]
    df = spark.createDataFrame(rows, "g long, x double")
    assert exact_quantiles(df, "x", [0.0, 0.5, 1.0], by=["g"]) == {(None,): [-inf, 1.0, inf], (1,): [2.0, 2.0, 2.0]}
    assert exact_quantiles(df.where("g = 2"), "x", [0.5]) == {}


def test_one_value_everywhere_spreads_over_partitions(spark):
    df = spark.range(20000).select(F.lit(1).alias("g"), F.lit(5.0).alias("x"))
    assert exact_quantiles(df, "x", [0.1, 0.9], by=["g"]) == {(1,): [5.0, 5.0]}
