"""Step control of lag fits, and windows over series cut into blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.operators import lag
from tensorloom.operators.control import Control


def test_a_long_series_beside_short_ones(spark, monkeypatch):
    monkeypatch.setattr(lag, "RANGE", 40)
    rows = [("long", i, float(i % 13)) for i in range(700)] + [(f"s{k}", i, float(k + i)) for k in range(60) for i in range(k % 9)] + [(None, i, 1.0 * i) for i in range(90)]
    rows += [("long", 350, 99.0)] * 3 + [("long", None, 7.0)]  # ties, and a place unknown
    df = spark.createDataFrame(rows, "s string, t long, x double").repartition(5)
    got = lag.lag_windows(df, ["x"], 4, "t", "s", complete=False)
    monkeypatch.setattr(lag, "RANGE", 1 << 20)
    want = lag.lag_windows(df, ["x"], 4, "t", "s", complete=False)
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    monkeypatch.setattr(lag, "RANGE", 40)
    blocks = lag.ordered_ranges(df, 4, "t", "s")
    assert blocks.groupBy("__series", "__block").count().agg(F.max("count")).first()[0] <= 44
    assert [r["__row"] for r in blocks.filter("s = 'long' and not __halo").orderBy("__row").collect()] == list(range(704))
    # The plan is of one size, whatever the length of the series.
    plan = lambda n: blocks_of(spark, n)._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert plan(300) == plan(3000)
    assert lag.lag_windows(df.limit(0), ["x"], 2, "t", "s").collect() == []


def blocks_of(spark, n):
    return lag.ordered_ranges(spark.range(n).select(F.col("id").alias("t"), F.col("id").cast("double").alias("x")), 4, "t")


def test_a_diverging_poisson_fit_goes_down(spark):
    """Sparse counts with a spike and hardly any penalty: full steps overshoot, halved ones don't."""
    rng = np.random.default_rng(3)
    x = rng.random(300)
    y = rng.poisson(np.exp(-4 + 9 * (x > 0.9)))
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "t long, x double, y int")
    spec = lag.DistributedLagSpline(["x"], "y", "t", lag=2, rank=2, k=6, k_lag=3, lam=1e-6, control=Control(init_sd=2.5, pirls_maxit=40))
    m = spec.fit(df)
    values = [h["objective"] for h in m.history]
    assert len(values) > 2 and all(b <= a + 1e-8 * abs(a) for a, b in zip(values, values[1:])) and np.isfinite(m.deviance)
    assert min(h["step"] for h in m.history) < 1
    want = m.transform(df).filter("fit is not null").selectExpr("sum(2 * (case when y > 0 then y * ln(y / fit) else 0 end - (y - fit)))").first()[0]
    assert m.deviance == pytest.approx(want, rel=1e-3)


def test_gaussian_lag_fit_has_its_deviance(spark):
    df = spark.range(200).select(F.col("id").alias("t"), F.rand(1).alias("x")).withColumn("y", F.sin(5 * F.col("x")) + 0.1 * F.randn(2))
    m = lag.DistributedLagSpline(["x"], "y", "t", lag=1, family="gaussian", k=5, lam=0.1).fit(df)
    want = m.transform(df).filter("fit is not null").selectExpr("sum((y - fit) * (y - fit))").first()[0]
    assert m.deviance == pytest.approx(want, rel=1e-8)


@pytest.mark.parametrize("whole", [True, False])
def test_equations_of_additive_columns_hold_however_large_the_counts(spark, monkeypatch, whole):
    """Fitted and observed totals, plain and by the linear column, agree to far more digits than a ridge leaves."""
    if not whole:
        monkeypatch.setattr(lag, "MOMENTS", 1)
    rng = np.random.default_rng(4)
    x, z = rng.random(200), rng.integers(0, 2, 200)
    y = rng.poisson(np.exp(13 + np.sin(5 * x) + 0.3 * z))
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(x, z, y))], "t long, x double, z double, y long")
    m = lag.DistributedLagSpline(["x"], "y", "t", lag=1, k=5, k_lag=2, linear=["z"], control=Control(pirls_maxit=12)).fit(df)
    got = m.transform(df).filter("fit is not null").selectExpr("sum(fit)", "sum(y)", "sum(z * fit)", "sum(z * y)").first()
    assert got[0] == pytest.approx(got[1], rel=1e-11) and got[2] == pytest.approx(got[3], rel=1e-11)
    values = [h["objective"] for h in m.history]
    assert all(b <= a + 1e-10 * abs(a) for a, b in zip(values, values[1:]))
