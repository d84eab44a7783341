"""Profiled null space against the joint dense solve, on every backend, with linear and smooth terms, and for a tensor of 4,096 entries."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.functions.basis import difference_penalty
from tensorloom.operators.control import Control
from tensorloom.operators.null_space import added, fit_profiled_null, null_basis
from tensorloom.operators.spline import SmoothTerm, TensorSpline
from tensorloom.plans import tensor

X = ["l_quantity", "l_discount"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(*[F.col(c).cast("double").alias(c) for c in [*X, "l_tax"]], (F.col("l_returnflag") == "R").cast("double").alias("flag"))
    return df.withColumn("y", F.sin(F.col("l_quantity") / 7) * (1 + 20 * F.col("l_discount")) + 2 * F.col("flag") + F.cos(40 * F.col("l_tax")) + 0.2 * F.randn(3)).limit(1200).cache()


def joint_dense(df, model, spec, lam) -> np.ndarray:
    """Predictions of one solve for the whole tensor, linear and smooth terms; the null space bears no penalty there either."""
    pdf = df.toPandas()
    bases = [k.evaluate(pdf[c].to_numpy()) for k, c in zip(model.knots, spec.x)]
    x = bases[0]
    for b in bases[1:]:
        x = (x[:, :, None] * b[:, None, :]).reshape(len(x), -1)
    sizes = [k.k for k in model.knots]
    z = [pdf[c].to_numpy()[:, None] for c in spec.linear] + [kn.evaluate(pdf[c].to_numpy()) for c, kn, _ in model.terms]
    both = np.concatenate([x, *z], axis=1)
    pen = np.zeros((both.shape[1],) * 2)
    pen[: x.shape[1], : x.shape[1]] = tensor.dense_penalty(sizes, [difference_penalty(p, spec.penalty_order) for p in sizes], np.full(len(sizes), lam))
    at = x.shape[1] + len(spec.linear)
    for t in spec.smooth:
        pen[at : at + t.k, at : at + t.k] = t.lam * difference_penalty(t.k, t.m)
        at += t.k
    return both @ np.linalg.solve(both.T @ both + pen + 1e-9 * np.eye(len(pen)), both.T @ pdf["y"].to_numpy())


@pytest.mark.parametrize("backend", ["cells", "moments", "rows"])
def test_full_rank_is_the_joint_dense_solve(rows, backend):
    spec = TensorSpline(X, rank=4, k=(6, 4), lam=0.3, linear=["flag"], smooth=[SmoothTerm("l_tax", k=5, lam=2.0)], backend=backend, control=Control(max_sweeps=4000, tol=1e-13))
    f = fit_profiled_null(rows, spec)
    want, got = joint_dense(rows, f.model, spec, 0.3), f.transform(rows).toPandas()
    assert np.abs(got["fit"] - want).max() < 2e-4
    assert f.deviance() == pytest.approx(((got["y"] - got["fit"]) ** 2).sum(), rel=1e-6)
    assert len(f.coef) == 4 and f.null_rank == 4 and 4 < f.edf < 24 + 1 + 5
    assert abs(f.linear["flag"] - 2) < 0.1


def test_4096_entries_and_a_linear_term(rows):
    """Far beyond what the full tensor's Gram matrix was held for: the block's equations hold, and full rank is the dense solve."""
    spec = TensorSpline(X, rank=8, k=(8, 512), lam=1.0, linear=["flag"], backend="cells", control=Control(max_sweeps=5, compute_edf=False))
    f = fit_profiled_null(rows, spec)
    assert np.prod([k.k for k in f.model.knots]) == 4096
    want, got = joint_dense(rows, f.model, spec, 1.0), f.transform(rows).toPandas()
    assert np.abs(got["fit"] - want).max() < 1e-2
    left = got["y"] - got["fit"]
    assert abs(left.sum()) < 1e-6 * len(left) and abs((left * got["flag"]).sum()) < 1e-6 * len(left)


def test_many_null_columns(rows):
    """Eleven margins of order 2 have 2,048 null columns; twelve would pass the limit only if it said so."""
    many = rows.select("y", *[(F.col("l_quantity") * (i + 3) % 17).alias(f"v{i}") for i in range(11)]).limit(150)
    spec = TensorSpline([f"v{i}" for i in range(11)], rank=1, k=4, lam=1.0, backend="cells", control=Control(max_sweeps=2, compute_edf=False))
    f = fit_profiled_null(many, spec)
    assert len(f.coef) == 2048 and np.isfinite(f.deviance())
    with pytest.raises(ValueError, match="null space has 2048"):
        fit_profiled_null(many, replace(spec, control=replace(spec.control, null_space_max_npar=1024)))
    with pytest.raises(ValueError, match="fixed smoothing"):
        fit_profiled_null(rows, TensorSpline(X, smooth=[SmoothTerm("l_tax")]))


def test_sum_of_trains_and_null_basis():
    a, b = (tensor.init_cores([3, 4, 2], r, r, 0.5) for r in (2, 3))
    assert np.allclose(tensor.dense(added(a, b)), tensor.dense(a) + tensor.dense(b))
    assert np.abs(difference_penalty(7, 3) @ null_basis(7, 3)).max() < 1e-10
