import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.functions import surfaces
from tensorloom.functions.basis import Knots, difference_penalty
from tensorloom.operators.control import Control
from tensorloom.operators.spline import SmoothTerm, TensorSpline, TensorSplineModel
from tensorloom.plans import tensor
from tensorloom.plans.backends import Request, State

FAST = Control(max_sweeps=20)


@pytest.fixture(scope="module")
def wave(spark):
    return surfaces.simulate(spark, 300, 2, lambda x: F.sin(2 * np.pi * x[0]) * F.cos(2 * np.pi * x[1]), sigma=0.2, seed=3).cache()


def test_basis_sums_to_one_and_native_equals_numpy(spark):
    k = Knots(0, 1, 8)
    x = np.linspace(0, 1, 21)
    assert np.allclose(k.evaluate(x).sum(axis=1), 1)
    assert (k.evaluate(np.array([-0.1, 1.1])) == 0).all()
    for kn in (k, Knots(0, 24, 7, cyclic=True)):
        pts = np.linspace(kn.lo, kn.hi, 40)
        df = kn.columns(spark.createDataFrame([(float(v),) for v in pts], "x double"), F.col("x"), "b").toPandas().sort_values("x")
        assert np.allclose(df[[f"b{i + 1}" for i in range(kn.k)]].to_numpy(), kn.evaluate(pts), atol=1e-12)
    c = Knots(0, 24, 7, cyclic=True)
    assert np.allclose(c.evaluate(np.array([0.0])), c.evaluate(np.array([24.0])))
    assert np.allclose(c.evaluate(pts).sum(axis=1), 1)
    with pytest.raises(ValueError):
        c.evaluate(np.array([25.0]))
    with pytest.raises(ValueError):
        Knots(0, 1, 3)


def test_penalties_against_dense():
    sizes, lam = [5, 4, 6], np.array([0.5, 1.2, 0.8])
    cores = tensor.init_cores(sizes, 2, sd=1.0)
    pens = [difference_penalty(p) for p in sizes]
    dense = tensor.dense_penalty(sizes, pens, lam)
    theta = tensor.dense(cores).ravel()
    assert tensor.penalty_value(cores, pens, lam) == pytest.approx(0.5 * theta @ dense @ theta, rel=1e-10)
    idx = tensor.index_bases(sizes)
    for k in range(3):
        a = tensor.design_core(idx, cores, k)
        own, other = tensor.core_penalty(cores, pens, lam, k)
        assert np.allclose(a.T @ dense @ a, lam[k] * own + other, atol=1e-8)
        assert np.allclose(a @ tensor.pack(cores[k]), theta)
    g = tensor.penalty_gradient(cores, pens, lam)
    v = tensor.pack_all(cores)
    shapes = [c.shape for c in cores]
    for i in (0, 11, len(v) - 1):
        e = np.eye(len(v))[i] * 1e-6
        num = (tensor.penalty_value(tensor.unpack_all(v + e, shapes), pens, lam) - tensor.penalty_value(tensor.unpack_all(v - e, shapes), pens, lam)) / 2e-6
        assert num == pytest.approx(g[i], rel=1e-5, abs=1e-7)


def test_gauge_and_truncation():
    cores = tensor.init_cores([5, 5, 5], 2, sd=1.0)
    moved = tensor.apply_gauge(tensor.apply_gauge(cores, 0, np.array([[1.2, -0.1], [0.3, 0.9]])), 1, np.array([[0.8, 0.4], [-0.2, 1.1]]))
    pens, lam = [difference_penalty(5)] * 3, np.array([1.3, 0.6, 0.9])
    assert np.allclose(tensor.dense(cores), tensor.dense(moved))
    assert tensor.penalty_value(cores, pens, lam) == pytest.approx(tensor.penalty_value(moved, pens, lam))
    assert np.allclose(tensor.dense(tensor.left_orthogonal(cores)), tensor.dense(cores))
    assert np.allclose(tensor.dense(tensor.truncate(cores, 2)), tensor.dense(cores))
    assert tensor.ranks(tensor.truncate(cores, 1)) == (1, 1, 1, 1)


@pytest.mark.parametrize("family", ["gaussian", "poisson", "bernoulli"])
def test_backends_agree(spark, family):
    df = surfaces.simulate(spark, 150, 2, lambda x: F.sin(3 * x[0]) + x[1], seed=5, family=family).withColumn("w", F.lit(0.5) + F.col("x1"))
    spec = TensorSpline(["x1", "x2"], family=family, rank=2, k=5, lam=1.0, weight="w")
    kinds = ["cells", "rows"] + ["moments"] * (family == "gaussian")
    ready = [(k, TensorSpline(**(spec.__dict__ | {"backend": k})).prepare(df).backend) for k in kinds]
    s = State(tensor.formula_cores([5, 5], 2), np.array([0.1]))
    for kind in ("size", "loss", "gradient", "core", "joint", "newton"):
        answers = [b.total(Request(kind, family, [s], None if family == "gaussian" else s, 1)) for _, b in ready]
        for other in answers[1:]:
            for name in set(answers[0]) & set(other):
                if not (family != "gaussian" and name in ("zz", "nll", "nll0", "yy")):
                    assert np.allclose(answers[0][name], other[name], rtol=1e-8, atol=1e-8), (kind, name)


def test_als_descends_and_equals_dense_solve_at_full_rank(spark, wave):
    m = TensorSpline(["x1", "x2"], rank=5, k=5, lam=0.7, control=Control(max_sweeps=200, tol=1e-13)).fit(wave)
    values = [h["objective"] for h in m.history]
    assert all(b <= a + 1e-8 for a, b in zip(values, values[1:]))
    p = wave.toPandas()
    b = [k.evaluate(p[c].to_numpy()) for k, c in zip(m.knots, ("x1", "x2"))]
    t = np.einsum("ni,nj->nij", *b).reshape(len(p), -1)
    pen = tensor.dense_penalty([5, 5], [difference_penalty(5)] * 2, m.lam)
    x = np.concatenate([t, np.ones((len(p), 1))], axis=1)
    full = np.zeros((26, 26))
    full[:25, :25] = pen
    theta = np.linalg.lstsq(x.T @ x + full, x.T @ p.y.to_numpy(), rcond=None)[0]
    assert np.allclose(x @ theta, m.transform(wave).toPandas()["fit"], atol=1e-3)


def test_prediction_inference_and_json(spark, wave):
    m = TensorSpline(["x1", "x2"], rank=2, k=6, lam="cGCV", control=FAST).fit(wave)
    assert m.margin_edf.sum() == pytest.approx(m.edf) and 2 < m.edf < 30
    out = m.transform(wave, se=True, interval=0.95).toPandas()
    assert np.corrcoef(out["fit"], out["f"])[0, 1] > 0.95
    assert ((out.lower < out["fit"]) & (out["fit"] < out.upper)).all()
    assert 0.8 < ((out.lower < out["f"]) & (out["f"] < out.upper)).mean() <= 1
    again = TensorSplineModel.from_json(m.to_json()).transform(wave).toPandas()
    assert np.allclose(again.sort_values("row_id")["fit"], out.sort_values("row_id")["fit"])
    assert m.deviance == pytest.approx(((out.y - out["fit"]) ** 2).sum(), rel=1e-8)
    assert m.bic() > m.aic() and len(m.parametric_table()) == 1 and m.outside(wave).first()["x1"] == 0
    c = m.transform(wave, contrast={"x1": 0.3, "x2": 0.4}, se=True).toPandas()
    own = m.transform(spark.createDataFrame([(0.3, 0.4)], "x1 double, x2 double"), contrast={"x1": 0.3, "x2": 0.4}, se=True).first()
    assert own["fit"] == pytest.approx(0) and own["se"] == pytest.approx(0, abs=1e-9) and len(c) == 300
    nulls = m.transform(spark.createDataFrame([(None, 0.4)], "x1 double, x2 double")).first()
    assert nulls["fit"] is None
    with pytest.raises(NotImplementedError):
        m.vcov(unconditional=True)


@pytest.mark.parametrize("optimizer", ["lbfgs", "gd", "hybrid"])
def test_gaussian_optimizers_reach_the_als_objective(spark, wave, optimizer):
    als = TensorSpline(["x1", "x2"], rank=2, k=5, lam=1.0, control=Control(max_sweeps=200)).fit(wave)
    other = TensorSpline(["x1", "x2"], rank=2, k=5, lam=1.0, optimizer=optimizer, control=Control(gd_maxit=3000)).fit(wave)
    assert other.objective == pytest.approx(als.objective, rel=0.05)


@pytest.mark.parametrize("family,optimizer", [("poisson", "auto"), ("bernoulli", "auto"), ("bernoulli", "pirls-als"), ("bernoulli", "dn-als"), ("poisson", "lbfgs-als")])
def test_glm_fits(spark, family, optimizer):
    df = surfaces.simulate(spark, 400, 2, lambda x: F.sin(2 * np.pi * x[0]) + x[1], seed=7, family=family)
    m = TensorSpline(["x1", "x2"], family=family, rank=2, k=5, lam=1.0, optimizer=optimizer, control=Control(block_lbfgs_sweeps=8, dn_max_sweeps=15)).fit(df)
    out = m.transform(df).toPandas()
    assert np.corrcoef(out.eta, out.f)[0, 1] > 0.7
    values = [h["objective"] for h in m.history]
    assert all(b <= a + 1e-6 for a, b in zip(values, values[1:]))
    assert len(m.residuals(df, "pearson").filter("residual is null").collect()) == 0


def test_zero_weights_equal_subset(spark, wave):
    df = wave.withColumn("w", (F.col("row_id") % 3 > 0).cast("double"))
    kn = [Knots(0, 1, 5)] * 2
    a = TensorSpline(["x1", "x2"], rank=2, k=5, lam=1.0, weight="w", knots=kn, control=FAST).fit(df)
    b = TensorSpline(["x1", "x2"], rank=2, k=5, lam=1.0, knots=kn, control=FAST).fit(df.filter("w > 0"))
    assert a.deviance == pytest.approx(b.deviance, rel=1e-9)


def test_linear_and_smooth_terms(spark):
    df = surfaces.simulate(spark, 500, 3, lambda x: 0.4 * F.sin(2 * np.pi * x[0]) + F.sin(2 * np.pi * x[2]), sigma=0.15, seed=9).withColumn("g", (F.col("row_id") % 2).cast("double"))
    df = df.withColumn("y", F.col("y") + 0.8 * F.col("g"))
    m = TensorSpline(["x1", "x2"], rank=1, k=5, lam=1.0, linear=["g"], smooth=[SmoothTerm("x3", k=12, target_edf=5.0)], control=FAST).fit(df)
    assert m.parametric_table()[1]["estimate"] == pytest.approx(0.8, abs=0.08)
    assert m.smooth_table()[0]["edf"] == pytest.approx(5, abs=1e-4)
    out = m.transform(df).toPandas()
    assert np.corrcoef(out["fit"], out.y)[0, 1] > 0.9
    auto = TensorSpline(["x1", "x2"], rank=1, k=5, lam=1.0, linear=["g"], smooth=[SmoothTerm("x3", bs="cc", k=10, period=(0, 1))], control=FAST).fit(df)
    assert 2 < auto.smooth_table()[0]["edf"] <= 10


def test_input_errors(spark, wave):
    with pytest.raises(ValueError):
        TensorSpline(["x1"]).fit(wave)
    with pytest.raises(ValueError):
        TensorSpline(["x1", "x2"], family="poisson").fit(wave)
    with pytest.raises(ValueError):
        TensorSpline(["x1", "x2"], lam=-1).fit(wave)
    with pytest.raises(NotImplementedError):
        TensorSpline(["x1", "x2"], lam="cREML").fit(wave)
    with pytest.raises(ValueError):
        TensorSpline(["x1", "x2"]).fit(wave.withColumn("y", F.lit(None).cast("double")))


def test_rows_outside_the_span_and_smoothing_at_the_bounds(spark, wave):
    m = TensorSpline(["x1", "x2"], rank=1, k=5, lam=1.0, control=FAST).fit(wave)
    beyond = spark.createDataFrame([(0.5, 0.5), (-3.0, 0.5), (2.0, 9.0), (None, 0.5)], "x1 double, x2 double")
    assert m.outside(beyond).first().asDict() == {"x1": 2, "x2": 1} and m.outside(beyond.limit(0)).first()["x1"] == 0
    noise = wave.withColumn("y", surfaces.normal(F.col("row_id"), 9, 0))
    with pytest.warns(UserWarning, match="at the bounds"):
        TensorSpline(["x1", "x2"], rank=1, k=5, control=Control(max_sweeps=10, lambda_bounds=(0.9, 1.1))).fit(noise)
