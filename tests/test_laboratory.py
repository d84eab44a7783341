"""Generalised degrees of freedom over cells, moments and rows, on one bank of probes; exact GCV of the full tensor."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.functions.basis import Knots
from tensorloom.operators import lab
from tensorloom.operators.control import Control
from tensorloom.operators.spline import TensorSpline
from tensorloom.plans.backends import CellBackend, MomentBackend, RowBackend

X, KEY = ["price", "disc"], ["l_orderkey", "l_linenumber"]


@pytest.fixture(scope="module")
def wave(spark):
    """A response over a continuous column; a few rows twice, with keys of their own, so that cells hold more than a row."""
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(1500)
    df = df.select(*KEY, (F.col("l_extendedprice") / 1e4).alias("price"), F.col("l_discount").cast("double").alias("disc"))
    df = df.withColumn("y", F.sin("price") + 8 * F.col("disc") * F.cos(F.col("price") / 2) + 0.5 * F.randn(2))
    return df.union(df.limit(200).withColumn("l_linenumber", F.col("l_linenumber") + 100)).cache()


SPEC = TensorSpline(X, rank=2, k=5, lam=1.0, knots=[Knots(0.0, 11.0, 5), Knots(0.0, 0.1, 4)], control=Control(compute_edf=False, max_sweeps=400))


def test_one_bank_gives_the_same_degrees_of_freedom_on_any_backend(wave):
    got = {}
    for kind, cls in (("cells", CellBackend), ("moments", MomentBackend), ("rows", RowBackend)):
        p = lab.ready(wave, replace(SPEC, backend=kind), KEY)
        assert isinstance(p.backend, cls)
        e = lab.Evaluator(p, 2, probes=1 if kind == "rows" else 6, sweeps=8 if kind == "rows" else 600, df=wave, key=KEY)
        got[kind] = e.at([0.0, -1.0])
        if kind == "rows":
            few = got[kind]
            p.backend.close()
        if kind == "moments":
            one = lab.Evaluator(p, 2, probes=1, sweeps=600, df=wave, key=KEY).at([0.0, -1.0])
    assert got["cells"]["gdf"] == pytest.approx(got["moments"]["gdf"], rel=1e-3)
    assert got["cells"]["rss"] == pytest.approx(got["moments"]["rss"], rel=1e-6)
    # Joint sweeps over rows come further down than alternating ones before these stand still.
    assert few["gdf"] == pytest.approx(one["gdf"], rel=5e-2) and one["rss"] * (1 - 1e-3) < few["rss"] < one["rss"] * (1 + 1e-5)


def test_moments_ask_for_a_key_and_signs_are_even(wave):
    with pytest.raises(ValueError, match="key"):
        lab.Evaluator(replace(SPEC, backend="moments").prepare(wave), 2)
    r = lab.probed_rows(wave, SPEC, KEY, 1, 3).agg(*[F.avg(f"probe{i}") for i in range(3)], F.avg(F.col("probe0") * F.col("probe1"))).first()
    assert max(map(abs, r)) < 4 / 1700**0.5


def test_search_without_cells(wave):
    o = lab.optimise(wave, replace(SPEC, backend="moments"), n_global=3, starts=1, probes=2, local=3, expand=False, key=KEY)
    assert np.isfinite(o["gcv"]) and len(o["lambda"]) == 2


@pytest.mark.parametrize("lam", [(1.0, 1.0), (1e-3, 30.0), (1e4, 1e-4)])
def test_exact_gcv_is_the_dense_trace(wave, lam):
    full = lab.FullTensor.of(wave, SPEC)
    got, a = full.at(lam), full.gram + full.total(lam)
    inv = np.linalg.pinv(a, hermitian=True, rcond=1e-14)
    theta = inv @ full.rhs
    assert got["edf"] == pytest.approx(np.trace(inv @ full.gram), rel=1e-8)
    assert got["rss"] == pytest.approx(full.zz - 2 * full.rhs @ theta + theta @ full.gram @ theta, rel=1e-8)
    # Along a ray, any smoothing without a new solve.
    ray = full.along(lam)
    for t in (1e-3, 0.5, 40.0):
        assert ray.edf(t) == pytest.approx(full.at(np.array(lam) * t)["edf"], rel=1e-8)
    held = full.along([1.0, 0.0], [0.0, lam[1]])
    assert held.edf(lam[0]) == pytest.approx(got["edf"], rel=1e-8) and held.gcv(lam[0]) == pytest.approx(got["gcv"], rel=1e-8)


def test_monte_carlo_is_within_its_error_of_the_exact(wave):
    """A train of full rank is the full tensor."""
    lam = (0.5, 0.2)
    full = lab.FullTensor.of(wave, SPEC).at(lam)
    mc = lab.gdf_mc(wave, replace(SPEC, rank=4, backend="moments"), lam, probes=40, key=KEY, sweeps=3000)
    assert abs(mc["gdf"] - full["edf"]) < 4 * mc["gdf_se"] + 0.05
    assert mc["rss"] == pytest.approx(full["rss"], rel=1e-3)


def test_least_exact_gcv(wave):
    full = lab.FullTensor.of(wave, SPEC)
    best = full.minimise()
    grid = [full.at((10.0**a, 10.0**b))["gcv"] for a in np.linspace(-4, 4, 9) for b in np.linspace(-4, 4, 9)]
    assert best["gcv"] <= min(grid) * (1 + 1e-6)
