"""One pass a sweep over rows: joint normal equations, their safeguard, and how many questions a fit asks."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.functions.basis import difference_penalty
from tensorloom.operators import optimizers as opt
from tensorloom.operators.control import Control
from tensorloom.operators.spline import TensorSpline
from tensorloom.plans import tensor
from tensorloom.plans.backends import Request

X = ["l_quantity", "l_discount", "l_tax"]


@pytest.fixture(scope="module")
def rows(spark):
    y = F.sin(F.col("l_quantity") / 8) * (1 + 10 * F.col("l_discount")) + 5 * F.col("l_tax") + 0.3 * F.randn(3)
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(*[F.col(c).cast("double").alias(c) for c in X], y.alias("y"))
    return df.withColumn("count", F.floor(F.exp(F.col("y") / 2)).cast("double")).withColumn("flag", (F.col("y") > 1).cast("double")).cache()


def test_joint_penalty_is_that_of_the_dense_tensor():
    rng, sizes, lam = np.random.default_rng(0), [4, 5, 3, 4], np.array([0.3, 2.0, 0.7, 1.1])
    cores = [g + rng.normal(0, 0.1, g.shape) for g in tensor.init_cores(sizes, [2, 3, 2], 1, 0.5)]
    pens = [difference_penalty(p, 2) for p in sizes]
    j = tensor.jacobian(tensor.index_bases(sizes), cores)
    assert np.allclose(tensor.joint_penalty(cores, pens, lam), j.T @ tensor.dense_penalty(sizes, pens, lam) @ j, atol=1e-10)


def prepared(rows, **kw):
    return TensorSpline(X, rank=2, k=5, lam=0.5, control=Control(compute_edf=False), **kw).prepare(rows)


def test_a_sweep_is_one_job_and_reaches_the_moments_objective(spark, rows):
    p = prepared(rows, backend="rows")
    m = p.fit()
    sweeps = [h for h in m.history if h["stage"] == "joint"]
    # Sums for the start, the first look, the sweeps, and the fit's own loss and size.
    assert m.converged and p.backend.jobs == len(sweeps) + 4
    assert len(sweeps) < 100 and all(b["objective"] <= a["objective"] for a, b in zip(sweeps, sweeps[1:]))
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("sweep", "one question")
    p.backend.total(Request("sweep", "gaussian", [m.state]))
    spark.sparkContext.setJobGroup("rest", "")
    # Adaptive execution runs the stage that reads the rows as a job, and the stage that adds their sums up as another.
    ids = jobs.getJobIdsForGroup("sweep")
    assert 1 <= len(ids) <= 2
    p.backend.close()
    by_moments = prepared(rows, backend="moments").fit(control=Control(compute_edf=False, max_sweeps=2000))
    assert m.objective <= by_moments.objective * (1 + 1e-6)


@pytest.mark.parametrize(("family", "y"), [("poisson", "count"), ("bernoulli", "flag")])
def test_other_families_by_rows_and_cells(rows, family, y):
    spec = TensorSpline(X, y, family, rank=1, k=4, lam=2.0, backend="cells", control=Control(compute_edf=False, pirls_maxit=300), optimizer="pirls-als")
    by_cells = spec.fit(rows)
    p = replace(spec, backend="rows").prepare(rows)
    by_rows = p.fit()
    p.backend.close()
    assert by_rows.converged and by_rows.objective <= by_cells.objective * (1 + 1e-6)
    # On any backend the same sums: the first look at equal states is equal.
    s = by_cells.state
    a, b = spec.prepare(rows).backend.total(Request("sweep", family, [s])), by_cells
    assert np.allclose(a["nll"] + spec.prepare(rows).problem(2.0)[0].penalty(s), b.objective, rtol=1e-9)


def test_refused_steps_ask_for_no_more_than_one_pass(rows):
    """From a bad start some trials are refused; the objective never rises, and linear terms and an offset ride along."""
    df = rows.withColumn("off", F.col("l_tax") * 3).withColumn("z", (F.col("l_quantity") > 20).cast("double"))
    p = TensorSpline(X, rank=2, k=5, lam=0.01, linear=["z"], offset="off", backend="moments", optimizer="joint", control=Control(compute_edf=False, init_sd=3.0)).prepare(df)
    m = p.fit(seed=5)
    values = [h["objective"] for h in m.history]
    assert any(not h["taken"] for h in m.history) and all(b <= a + 1e-9 * abs(a) for a, b in zip(values, values[1:])) and m.converged
    q, _ = p.problem(0.01)
    g = q.ask("gradient", m.state)["g"].copy()
    g[: -2] += tensor.penalty_gradient(m.cores, q.penalties, q.lam)
    assert np.abs(g).max() < 1e-2 * max(1.0, abs(m.objective)) ** 0.5


def test_proposals_of_all_cores_from_one_question(rows):
    p = prepared(rows, backend="rows")
    s = opt.start(p.problem()[0], 2)
    problem, _ = p.problem()
    before = p.backend.jobs
    lam = opt.propose(problem, s)
    assert p.backend.jobs == before + 1
    one_by_one = [opt.spectral(problem, s, k).gcv(lam[k]) for k in range(3)]
    shared = opt.all_cores(problem, s)
    assert np.allclose(one_by_one, [opt.spectral(problem, s, k, shared).gcv(lam[k]) for k in range(3)])
    p.backend.close()
