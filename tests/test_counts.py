"""Exact quantiles, numbering by ranges of a hash, permutations gathered in one pass."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.functions import quantiles
from tensorloom.functions.basis import Knots
from tensorloom.operators import selection
from tensorloom.operators.control import Control
from tensorloom.operators.spline import TensorSpline


def test_quantiles_of_odd_columns(spark, monkeypatch):
    rng = np.random.default_rng(1)
    n = 3000
    data = {"even": rng.normal(0, 1, n), "heavy": np.exp(rng.normal(0, 30, n)) * rng.choice([-1, 1], n), "tied": rng.integers(0, 3, n).astype(float), "one": np.full(n, 7.0), "hot": np.where(rng.random(n) < 0.5, 0.1, rng.random(n)), "tiny": np.array([0.0, 5e-324] * (n // 2))}
    rows = [tuple(float(v[i]) for v in data.values()) + (None,) for i in range(n)] + [(None, float("nan"), float("inf"), None, None, None, None)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*data, "none"])).repartition(3)
    at = [0.0, 0.001, 0.25, 0.5, 0.731, 1.0]
    for few, bins in ((1024, 512), (3, 64)):
        monkeypatch.setattr(quantiles, "FEW", few)
        monkeypatch.setattr(quantiles, "BINS", bins)
        got = quantiles.exact_quantiles(df, [*data, "none"], at)
        for c, v in data.items():
            assert got[c] == pytest.approx(np.quantile(v, at), rel=1e-12), c
        assert got["none"] == [None] * 6
    # No task and no answer holds more than the counts of the bins.
    assert quantiles.exact_quantiles(df.limit(0), ["even"], [0.5]) == {"even": [None]}
    assert selection.reference_points(df, ["even"])["even"] == pytest.approx(np.median(data["even"]))


def test_numbering_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(selection, "BUCKET", 50)
    df = spark.range(730).withColumn("key", F.col("id") % 365).repartition(5)
    got = selection.number_rows(df.withColumn("h", F.xxhash64("key")), "h", "no", "id").collect()
    assert sorted(r["no"] for r in got) == list(range(730))
    assert [r["h"] for r in sorted(got, key=lambda r: r["no"])] == sorted(r["h"] for r in got)
    sizes = selection.balanced_folds(df, "id", 7).groupBy("fold").count().collect()
    assert {r["count"] for r in sizes} == {104, 105}


@pytest.mark.parametrize(("bucket", "b"), [(1 << 20, 9), (40, 7), (40, 39)])
def test_rotations(spark, monkeypatch, bucket, b):
    monkeypatch.setattr(selection, "BUCKET", bucket)
    df = spark.range(125).select(F.col("id").cast("double").alias("v"), (F.col("id") * 2.0).alias("w")).repartition(4)
    rows = selection.rotations(df, ["v"], b, seed=3).collect()
    after = {r["v"]: [x["v0"] for x in r["__turned"]] for r in rows}
    assert len(rows) == 125 and all(len(x) == b for x in after.values())
    order = [0.0]
    while len(order) < 125:
        order.append(after[order[-1]][0])
    assert sorted(order) == [float(i) for i in range(125)] and order != sorted(order)
    assert all(after[v] == [order[(i + k) % 125] for k in range(1, b + 1)] for i, v in enumerate(order))


def test_permutations_in_one_pass(spark):
    X = ["x1", "x2", "x3"]
    df = spark.range(400).select(*[F.rand(i).alias(c) for i, c in enumerate(X)]).withColumn("y", F.sin(6 * F.col("x1")) + F.col("x2") * F.col("x1") + 0.4 * F.randn(9)).cache()
    spec = TensorSpline(X, rank=1, k=4, lam=0.5, knots=[Knots(0.0, 1.0, 4)] * 3, control=Control(compute_edf=False))
    turned = selection.permuted_moments(df, spec, 19, seed=4)
    assert {c: len(v) for c, v in turned.items()} == dict.fromkeys(X, 19)
    # One of them against the same dealing made by hand.
    rows = selection.rotations(df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(X)], F.col("y").cast("double").alias("y"), F.lit(1.0).alias("w"), F.lit(0.0).alias("off")), ["x0", "x1", "x2"], 19, 4)
    dealt = rows.select("x0", F.col("__turned")[4]["v1"].alias("x1"), "x2", "y")
    by_hand = replace(spec, x=["x0", "x1", "x2"], backend="moments").prepare(dealt).backend
    assert np.allclose(by_hand.m["S"], turned["x2"][4].m["S"]) and np.allclose(by_hand.m["b"], turned["x2"][4].m["b"])
    # p-values of a plain version: fits of tables dealt by hand, one by one.
    got = {r["column"]: r["p_value"] for r in selection.drop_test(df, spec, method="permutation", b=19, seed=4)}
    full = spec.fit(df).deviance
    plain = {c: (1 + sum(replace(spec, backend="moments", x=["x0", "x1", "x2"]).fit(rows.select(*[F.col("__turned")[t][f"v{i}"].alias(f"x{i}") if j == i else F.col(f"x{j}") for j in range(3)], "y")).deviance <= full for t in range(3))) for i, c in enumerate(X)}
    assert got["x1"] == got["x2"] == 1 / 20 and got["x3"] > 1 / 20 and plain["x1"] == 1
    jobs = spark.sparkContext.statusTracker()
    counts = []
    for b in (3, 99):
        spark.sparkContext.setJobGroup(f"turn{b}", "turns")
        selection.permuted_moments(df, spec, b, 4)
        counts.append(len(jobs.getJobIdsForGroup(f"turn{b}")))
        spark.sparkContext.setJobGroup("rest", "")
    assert counts[0] == counts[1]
    with pytest.raises(ValueError):
        selection.permuted_moments(df, replace(spec, family="poisson"), 3)
