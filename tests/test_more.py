from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.functions import surfaces
from tensorloom.functions.basis import Knots
from tensorloom.operators import grid, lab, lab_adaptive, lag, selection
from tensorloom.operators.control import Control, boundary_status, damped_step, scale_anisotropy
from tensorloom.operators.spline import SmoothTerm, TensorSpline
from tensorloom.plans.backends import Request, State
from tensorloom.plans.linalg import brent, f_tail, operator_norm, sobol, t_two_sided
from tensorloom.plans import tensor
from tensorloom.sources import io
from tensorloom.streaming.moments import StreamMoments

FAST = Control(max_sweeps=15, outer_maxit=5)


@pytest.fixture(scope="module")
def wave(spark):
    return surfaces.simulate(spark, 240, 3, lambda x: F.sin(2 * np.pi * x[0]) * F.cos(2 * np.pi * x[1]) + 0.3 * x[2], sigma=0.25, seed=4).cache()


def test_rules():
    cases = [([(1, 1.0, 0.1), (2, 0.5, 0.1), (3, 0.55, 0.1)], 2, 2), ([(1, 0.55, 0.1), (2, 0.6, 0.1), (3, 0.5, 0.1)], 3, 1), ([(1, 1.0, 0.1), (2, 0.58, 0.1), (4, 0.5, 0.1)], 4, 2), ([(1, 1.0, 0.1), (2, 0.5, 0.1), (3, 0.5, 0.1)], 2, 2)]
    for rows, low, se in cases:
        t = [{"rank": r, "mean_cv": m, "se_cv": s} for r, m, s in rows]
        assert (selection.choose(t, rule="min"), selection.choose(t, rule="1se")) == (low, se)


def test_summaries_agree_with_spark(spark):
    losses = [{"rank": r, "fold": f, "loss": v} for r, fs in ((1, (0.5, 0.7, 0.6)), (2, (0.4, float("inf"), 0.5))) for f, v in enumerate(fs)]
    rows = selection.summary_rows(losses)
    assert rows[1]["mean_cv"] == float("inf") and rows[1]["n_finite"] == 2
    got = {r["rank"]: r for r in selection.summarise_cv(spark.createDataFrame([(x["rank"], x["fold"], x["loss"]) for x in losses], "rank int, fold int, loss double")).collect()}
    for r in rows:
        assert got[r["rank"]]["mean_cv"] == pytest.approx(r["mean_cv"]) and got[r["rank"]]["se_cv"] == pytest.approx(r["se_cv"])
    t = spark.createDataFrame([(1, 0.55, 0.1), (2, 0.6, 0.1), (3, 0.5, 0.1)], "rank int, mean_cv double, se_cv double")
    assert tuple(selection.choose_frame(t).first()) == (3, 1)


def test_folds_are_balanced_and_stable(spark, wave):
    a = selection.balanced_folds(wave, "row_id", 7)
    sizes = [r["count"] for r in a.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 240
    b = selection.balanced_folds(wave.repartition(5), "row_id", 7)
    assert sorted(map(tuple, a.select("row_id", "fold").collect())) == sorted(map(tuple, b.select("row_id", "fold").collect()))
    p = selection.permuted(wave, "x1", 3)
    assert sorted(r["x1"] for r in p.collect()) == sorted(r["x1"] for r in wave.collect())


def test_rank_selection_on_both_backends(spark, wave):
    spec = TensorSpline(["x1", "x2", "x3"], k=5, lam=1.0, control=FAST)
    a = selection.rank_select(wave, __import__("dataclasses").replace(spec, backend="cells"), ranks=(1, 2), folds=3, key="row_id")
    assert a.rank_1se <= a.rank_min and a.refit().rank[1] == a.rank
    from dataclasses import replace

    b = selection.rank_select(wave, replace(spec, backend="moments"), ranks=(1, 2), folds=3, key="row_id")
    for x, y in zip(a.losses, b.losses):
        assert x["loss"] == pytest.approx(y["loss"], rel=1e-5)
    assert [r["rank"] for r in selection.rank_profile(wave, spec, (1, 2))] == [1, 2]


def test_multistart(spark, wave):
    m, table = selection.multistart(wave, TensorSpline(["x1", "x2"], rank=2, k=5, lam=1.0, control=FAST), 3)
    assert len(table) == 3 and m.objective in [t["objective"] for t in table]


def test_activity_path_and_drop_test(spark):
    wave = surfaces.simulate(spark, 240, 3, lambda x: F.sin(2 * np.pi * x[0]) + F.sin(2 * np.pi * x[1]), sigma=0.3, seed=4).cache()
    spec = TensorSpline(["x1", "x2", "x3"], rank=2, k=5, lam=1.0, control=FAST)
    a = selection.activity_path(wave, spec, lambdas=(10.0, 1.0), folds=3)
    assert set(a.order[:2]) == {"x1", "x2"} and 0 <= a.m_1se <= a.m_min <= 3 and len(a.path) == 6
    d = {r["column"]: r["p_value"] for r in selection.drop_test(wave, spec)}
    assert d["x1"] < 0.05 and d["x2"] < 0.05
    q = selection.drop_test(wave, TensorSpline(["x1", "x2"], rank=2, k=5, lam=1.0, control=FAST), "permutation", b=3)
    assert all(0.25 <= r["p_value"] <= 1 for r in q)


def test_lag_family(spark):
    rows = [(t, float(10 + 5 * np.sin(t / 9)), float(20 + 8 * np.cos(t / 5))) for t in range(120)]
    df = spark.createDataFrame(rows, "t int, temp double, pm double")
    assert lag.lag_windows(df.limit(60), ["temp", "pm"], 5, "t").count() == 55
    df = lag.lag_windows(df, ["temp"], 3, "t", complete=False)
    df = df.withColumn("y", 0.1 * F.coalesce("temp__lag1", F.lit(10.0)) + 0.05 * F.coalesce("temp__lag2", F.lit(10.0))).drop(*[f"temp__lag{i}" for i in range(4)])
    m = lag.DistributedLagSpline(["temp", "pm"], "y", "t", lag=3, family="gaussian", k=5, lam=0.01).fit(df)
    out = m.transform(df).toPandas().sort_values("t")
    assert out["fit"].isna().sum() == 3 and np.corrcoef(out["fit"][3:], out.y[3:])[0, 1] > 0.98
    e = m.effect(spark, "temp", at=[m.centre["temp"], 12.0]).collect()
    assert e[0]["rr"] == pytest.approx(1, abs=1e-6) and len(m.effect(spark, "temp", lag=1).collect()) == 50
    counts = df.withColumn("y", F.floor(F.exp(0.1 * F.col("temp")))).withColumn("dow", (F.col("t") % 7).cast("double"))
    p = lag.DistributedLagSpline(["temp"], "y", "t", lag=2, k=5, smooth=[SmoothTerm("t", k=8, target_edf=3.0)], linear=["dow"]).fit(counts)
    assert np.isfinite(p.deviance) and p.effect(spark, "temp", at=[p.centre["temp"]]).first()["rr"] == pytest.approx(1)


def test_lag_interaction_of_two_exposures(spark):
    """y holds a product of two exposures at lag 1, which no sum of separate surfaces can follow."""
    rng = np.random.default_rng(4)
    a, b = rng.uniform(-1, 1, 700), rng.uniform(-1, 1, 700)
    y = 3 * np.concatenate([[0], a[:-1] * b[:-1]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(a, b, y))], "t int, a double, b double, y double")
    m = lag.DistributedLagSpline(["a", "b"], "y", "t", lag=2, family="gaussian", rank=2, k=5, k_lag=3, lam=1e-4).fit(df)
    out = m.transform(df).toPandas().sort_values("t")
    assert len(m.cores) == 3 and ((out.fit - out.y)[2:] ** 2).mean() < 0.02 * (y**2).mean()
    rows = m.effect_rows("a", at=[-0.9, 0.0, 0.9], lag=1, centre={"a": 0.0, "b": 0.9})
    assert abs(rows[1][3]) < 1e-9 and rows[2][3] > 1.8 and rows[0][3] < -1.8
    other = m.effect_rows("a", at=[0.9], lag=1, centre={"a": 0.0, "b": -0.9})
    assert other[0][3] < -1.8
    by_core = lag.MOMENTS
    try:
        lag.MOMENTS = 1
        slow = lag.DistributedLagSpline(["a", "b"], "y", "t", lag=1, family="gaussian", rank=1, k=4, k_lag=2, lam=0.1, control=Control(max_sweeps=3)).fit(df.limit(80))
        lag.MOMENTS = by_core
        fast = lag.DistributedLagSpline(["a", "b"], "y", "t", lag=1, family="gaussian", rank=1, k=4, k_lag=2, lam=0.1, control=Control(max_sweeps=3)).fit(df.limit(80))
    finally:
        lag.MOMENTS = by_core
    assert slow.deviance == pytest.approx(fast.deviance, rel=1e-6)


@pytest.mark.parametrize("size", [3, 7, 50])
def test_lag_ranges_agree_with_one_window(spark, monkeypatch, size):
    df = spark.createDataFrame([(float(i * i % 101), float(i)) for i in range(101)], "t double, v double").dropDuplicates(["t"]).repartition(4)
    whole = sorted(map(tuple, lag.lag_columns(df, "v", 4, "t", prefix="v__lag").collect()))
    monkeypatch.setattr(lag, "RANGE", size)
    got = lag.lag_windows(df, ["v"], 4, "t", complete=False)
    assert sorted(map(tuple, got.collect())) == whole


def test_lag_automatic_smoothing_and_weights(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 1, 200)
    y = np.sin(6 * x) + 0.1 * rng.normal(size=200)
    df = spark.createDataFrame([(i, float(a), float(b), float(i % 2)) for i, (a, b) in enumerate(zip(x, y))], "t int, x double, y double, w double")
    m = lag.DistributedLagSpline(["x"], "y", "t", lag=1, family="gaussian", k=6, k_lag=2, lam="cGCV", control=Control(max_sweeps=20)).fit(df)
    assert len(m.lam) == 2 and m.deviance / m.n < 0.05
    fit = lambda lam, w: lag.DistributedLagSpline(["x"], "y", "t", lag=0, family="gaussian", k=6, k_lag=1, lam=lam, weight=w).fit(df.withColumn("w", F.lit(2.0)))
    assert fit(0.2, "w").deviance == pytest.approx(2 * fit(0.1, None).deviance, rel=1e-5)
    with pytest.raises(ValueError, match="negative weight"):
        lag.DistributedLagSpline(["x"], "y", "t", lag=0, weight="w").fit(df.withColumn("w", F.lit(None).cast("double")))


def test_grid_equals_scattered(spark):
    axes = {"x1": np.linspace(0, 1, 8), "x2": np.linspace(0, 1, 7), "x3": np.linspace(0, 1, 6)}
    df = grid.axes_product(spark, axes).withColumn("y", F.sin(6 * F.col("x1")) + F.col("x2") * F.col("x3"))
    assert grid.grid_scan(df, ["i1", "i2", "i3"], [8, 7, 6], "r2").filter("r2 <> row_id").count() == 0
    kn = [Knots(0, 1, 5)] * 3
    b = [k.evaluate(v) for k, v in zip(kn, axes.values())]
    be = TensorSpline(list(axes), k=5, knots=kn, backend="moments").prepare(df).backend
    assert np.allclose(grid.axis_gram(b), be.m["S"], atol=1e-10)
    y = np.zeros((8, 7, 6))
    for r in df.collect():
        y[r["i1"] - 1, r["i2"] - 1, r["i3"] - 1] = r["y"]
    assert np.allclose(grid.apply_axes([x.T for x in b], y).ravel(), be.m["b"])
    w = np.random.default_rng(0).uniform(0.2, 1.5, (8, 7, 6))
    x = np.einsum("ai,bj,ck->abcijk", *b).reshape(8 * 7 * 6, -1)
    assert np.allclose(grid.weighted_gram(b, w), x.T @ (x * w.ravel()[:, None]))
    dense = grid.fit_dense(df, list(axes), knots=kn, lam=1e-5)
    pen = tensor.dense_penalty([5, 5, 5], [np.diff(np.eye(5), 2, axis=0).T @ np.diff(np.eye(5), 2, axis=0)] * 3, [1e-5] * 3)
    flat = x @ np.linalg.solve(x.T @ x + pen, x.T @ y.ravel())
    fit = {r["row_id"]: r["fit"] for r in dense.transform(df).collect()}
    assert np.allclose([fit[i + 8 * (j + 7 * k)] for i in range(8) for j in range(7) for k in range(6)], flat, atol=1e-3)
    table = grid.compare(df, ["x1", "x2", "x3"], "y", k=5, lam=0.1, ranks=(1, 2), select=False)
    assert [r["method"] for r in table] == ["dense", "tt1", "tt2", "oracle"]


def test_poisson_grid(spark):
    df = surfaces.age_year_counts(spark).withColumn("logex", F.ln("exposure"))
    m = grid.fit_dense(df, ["age", "year"], family="poisson", k=6, lam=1.0, offset="logex")
    assert m.deviance < 41 * 31 * 2


def test_profiled_null_space(spark, wave):
    spec = TensorSpline(["x1", "x2"], rank=2, k=5, lam=1.0, control=FAST)
    f = grid.fit_profiled_null(wave, spec)
    assert len(f.coef) == 4 and f.null_rank == 4 and f.edf == pytest.approx(4 + f.model.edf)
    m = replace(spec, backend="moments", knots=f.model.knots).prepare(wave).backend.m
    assert np.abs(f.null.T @ (m["b"] - m["S"] @ f.theta())).max() < 1e-7
    got = f.transform(wave).selectExpr("sum((y - fit) * (y - fit))").first()[0]
    assert got == pytest.approx(f.deviance(), rel=1e-8)
    # Under heavy smoothing a surface of the null space is left as it is, and nothing else is fitted.
    flat = State(grid.dense_train(f.null @ np.array([1.0, 2.0, -1.0, 3.0]), [5, 5]), np.zeros(1))
    bent = replace(f.model, state=flat, vcov_=None).transform(wave).selectExpr("x1", "x2", "eta as y")
    heavy = grid.fit_profiled_null(bent, replace(spec, lam=1e8, knots=f.model.knots))
    total = bent.selectExpr("sum(y * y)").first()[0]
    assert heavy.deviance() < 1e-8 * total and heavy.coef == pytest.approx([1, 2, -1, 3], abs=1e-4)
    chosen = grid.fit_profiled_null(wave, replace(spec, lam="cGCV"))
    assert chosen.model.trace and (chosen.model.lam != 1).any() and chosen.deviance() < wave.selectExpr("sum(y * y)").first()[0]
    with pytest.raises(ValueError):
        grid.fit_profiled_null(wave, replace(spec, family="poisson"))


def test_comparison_analysis(spark):
    rows = [(2, 10, 6, "dense", 0.2, 1.0), (2, 10, 6, "oracle", 0.1, 0.5), (2, 10, 6, "minCV", 0.11, 2.0), (2, 10, 6, "1-SE", 0.15, 2.0), (4, 5, 6, "oracle", 0.0, 1.0), (4, 5, 6, "1-SE", 0.1, 3.0)]
    a, b = grid.analyse_comparisons(spark.createDataFrame(rows, "d int, n_grid int, k int, method string, rmse double, seconds double")).orderBy("d").collect()
    assert (a["min_over_oracle"], a["one_se_over_oracle"], a["one_se_excess_pct"], a["one_se_over_dense"], a["select_over_fit"]) == pytest.approx((1.1, 1.5, 50.0, 0.75, 4.0)) and a["dense_feasible"]
    assert not b["dense_feasible"] and b["one_se_over_oracle"] is None and b["min_over_oracle"] is None and b["select_over_fit"] == 3.0


def test_data_sets(spark):
    for name in surfaces.DATASETS:
        df = surfaces.dataset(spark, name)
        assert df.count() == (41 * 31 if name == "glam_poisson" else 800)
        assert df.agg(F.sum(F.xxhash64(*df.columns) % 1000)).first() == surfaces.dataset(spark, name).agg(F.sum(F.xxhash64(*df.columns) % 1000)).first()
    with pytest.raises(ValueError):
        surfaces.dataset(spark, "cars")


def test_plot_frames(spark, wave):
    spec = TensorSpline(["x1", "x2"], rank=2, k=5, lam=1.0, control=FAST)
    sel = selection.rank_select(wave, spec, ranks=(1, 2), folds=3)
    rows = sel.plot_frame(spark).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2] and [r["stored"] for r in rows] == [10, 20] and sum(r["is_min"] for r in rows) == 1
    assert all(r["lower"] <= r["mean_cv"] <= r["upper"] for r in rows)
    path = selection.activity_path(wave, spec, lambdas=(1.0, 0.1), folds=3)
    assert path.path_frame(spark).count() == 4 and {r["place"] for r in path.path_frame(spark).collect()} == {1, 2}
    assert [r["added"] for r in path.cv_frame(spark).orderBy("m").collect()] == [None, *path.order]
    table = selection.drop_frame(spark, selection.drop_test(wave, replace(spec, control=Control(max_sweeps=12)))).collect()
    assert [r["statistic"] for r in table] == sorted((r["statistic"] for r in table), reverse=True)
    assert operator_norm(np.array([[0.0, 2.0], [2.0, 0.0]])) == pytest.approx(2) and operator_norm(np.zeros((0, 0))) == 0


def test_laboratory(spark, wave):
    spec = TensorSpline(["x1", "x2"], rank=2, k=5, lam=1.0, control=FAST)
    g = lab.gdf_mc(wave, spec, 1.0, probes=8)
    m = spec.fit(wave)
    assert abs(g["gdf"] - m.edf) < 0.6 * m.edf + 2
    assert lab.global_gcv(10, 1.0, 10) == float("inf") and lab.global_gcv(10, 1.0, 2) == pytest.approx(10 / 64)
    o = lab.optimise(wave, spec, n_global=4, starts=1, probes=2, local=4, expand=False)
    assert len(o["lambda"]) == 2 and np.isfinite(o["gcv"])
    assert sobol(3, 2).tolist() == [[0.5, 0.5], [0.75, 0.25], [0.25, 0.75]]


def test_adaptive_search_parts():
    box, best = np.array([[-5.0, 5.0], [-5.0, 5.0]]), np.array([0.0, -4.8])
    bowl = lambda v: 1 + (v[0] - 0.2) ** 2 + 1e-4 * (v[1] + 5) ** 2
    forced = lab_adaptive.edge_probe(bowl, best, box)
    assert forced.tolist() == [[False, False], [True, True]]
    grown = lab_adaptive.grow_box(box, best, None, forced)
    assert grown.tolist() == [[-5.0, 5.0], [-8.0, 8.0]]
    assert lab_adaptive.grow_box(np.array([[-11.0, 7.0]]), np.array([-10.9]), None, np.array([[False, True]])).tolist() == [[-12.0, 8.0]]
    assert lab_adaptive.grow_box(box, np.array([0.0, -4.2]), np.array([[-1.0, 1.0], [-4.9, -4.0]]), np.zeros((2, 2), bool)).tolist() == [[-5.0, 5.0], [-8.0, 5.0]]
    slab = lab_adaptive.new_slab(12, box, grown, 5)
    assert slab.shape == (12, 2) and (np.abs(slab[:, 1]) > 5).all() and (np.abs(slab) <= 8).all()
    pts = np.array([[0.0, 1.0], [1.0, 2.0], [3.0, 3.0], [4.0, 4.0]])
    assert lab_adaptive.near_optimal(pts, np.array([1.0, 1.005, 1.5, np.inf])).tolist() == [[0.0, 1.0], [1.0, 2.0]]
    assert lab_adaptive.near_optimal(pts, np.full(4, np.inf)) is None
    assert lab_adaptive.tied(1.0, 1.05, 0.03, 0.03) and not lab_adaptive.tied(1.0, 1.1, 0.03, 0.03) and lab_adaptive.tied(1.0, 1.009) and not lab_adaptive.tied(1.0, np.inf)
    curve = lambda f: [(float(x), float(f(x))) for x in np.linspace(-5, 5, 15)]
    faces = box[0]
    assert lab_adaptive.classify(np.array([-0.4, 0.4]), faces, curve(lambda x: 1 + x * x)) == "well_identified"
    assert lab_adaptive.classify(np.array([-4.9, -4.0]), faces, curve(lambda x: 1 + max(x, -3) + 3)) == "effectively_unpenalized"
    assert lab_adaptive.classify(np.array([-3.0, 3.0]), faces, curve(lambda x: 1 + 0.1 * x * x)) == "weakly_identified"
    assert lab_adaptive.classify(np.array([-4.9, -3.0]), faces, curve(lambda x: 6 + x)) == "boundary_unresolved"
    assert [n for n, _ in lab_adaptive.anchors(box, None)][:4] == ["centre", "corner_low", "corner_high", "corner_mixed"]


def test_adaptive_search(spark, wave):
    spec = TensorSpline(["x1", "x2"], rank=2, k=5, lam=1.0, control=FAST)
    o = lab_adaptive.optimise_adaptive(wave, spec, batches=(6, 6), probes=2, probes_final=3, sweeps=(4, 6, 10), starts=2, local=6, expansions=1)
    q = [x for _, _, x in o.explored if np.isfinite(x)]
    assert np.isfinite(o.gcv) and len(o.identifiability) == 2 and len(q) > 20 and o.batches == 2
    assert ((o.log10_lambda >= o.box[:, 0]) & (o.log10_lambda <= o.box[:, 1])).all() and o.model.lam == pytest.approx(10**o.log10_lambda)
    assert any(r["tied"] for r in o.final) and o.frame(spark).count() == len(o.explored)


def test_smoothing_helpers():
    assert boundary_status([1e-4, 1.0, 1e4], (1e-4, 1e4)) == ["lower", "interior", "upper"]
    assert damped_step([1.0], [1e4], 0.25, 1.0, (1e-4, 1e4))[0] == pytest.approx(10.0)
    scale, omega = scale_anisotropy([2.0, 8.0])
    assert scale == pytest.approx(4) and np.prod(omega) == pytest.approx(1)
    assert brent(lambda x: (x - 0.3) ** 2, -2, 2) == pytest.approx(0.3, abs=1e-4)
    assert f_tail(4.0, 1, 10) == pytest.approx(t_two_sided(2.0, 10)) and t_two_sided(2.2281, 10) == pytest.approx(0.05, abs=1e-4)


def test_sources_and_stream(spark, wave, tmp_path):
    io.write(wave, str(tmp_path / "w"))
    back = io.read(spark, str(tmp_path / "w"))
    assert back.count() == 240 and io.formula("y ~ x1 + x2 + 1") == ("y", ["x1", "x2"])
    with pytest.raises(ValueError):
        io.read(spark, "x", "csv")
    d, names = io.dummies(spark.createDataFrame([("a",), ("b",), ("c",)], "g string"), "g")
    assert names == ["g_b", "g_c"]
    spec = TensorSpline(["x1", "x2"], rank=2, k=5, lam=1.0, control=FAST)
    acc = StreamMoments(spec, [Knots(0, 1, 5)] * 2)
    q = spark.readStream.schema(back.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "w")).writeStream.foreachBatch(acc).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    from dataclasses import replace

    whole = replace(spec, knots=[Knots(0, 1, 5)] * 2, backend="moments").fit(wave)
    assert acc.fit().deviance == pytest.approx(whole.deviance, rel=1e-8)
    acc.save(spark, str(tmp_path / "m"))
    assert StreamMoments(spec, acc.knots).load(spark, str(tmp_path / "m")).fit().deviance == pytest.approx(whole.deviance, rel=1e-8)
    io.save_model(spark, whole, str(tmp_path / "j"))
    assert np.allclose(io.load_model(spark, str(tmp_path / "j")).cores[0], whole.cores[0])


def test_simulators(spark):
    for df in (surfaces.simulate_ishigami(spark), surfaces.simulate_sobol_g(spark), surfaces.simulate_friedman(spark), surfaces.simulate_friedman(spark, family="poisson"), surfaces.simulate_friedman(spark, family="binomial")):
        r = df.agg(F.count("y").alias("n"), F.min("y").alias("lo")).first()
        assert r["n"] == 800
    a, b = (surfaces.simulate_friedman(spark.newSession(), n=50).repartition(k).orderBy("row_id").toPandas() for k in (1, 4))
    assert a.equals(b)


def test_gaussian_requests_need_no_data(spark, wave):
    be = TensorSpline(["x1", "x2"], k=5, backend="moments").prepare(wave).backend
    assert be.total(Request("size"))["n"] == 240
    with pytest.raises(ValueError):
        be.total(Request("loss", "poisson", [State([], np.zeros(1))]))


def test_array_mode_equals_scattered_fit(spark):
    axes = {"x1": np.linspace(0, 1, 12).tolist(), "x2": np.linspace(0, 1, 10).tolist()}
    df = grid.axes_product(spark, axes).withColumn("y", F.sin(6 * F.col("x1")) * F.col("x2"))
    spec = TensorSpline(["x1", "x2"], rank=2, k=6, lam=0.5, control=FAST)
    a, b = grid.prepare_array(df, axes, spec).fit(), spec.fit(df)
    assert a.deviance == pytest.approx(b.deviance, rel=1e-8) and np.allclose(a.cores[0], b.cores[0], atol=1e-6)
    with pytest.raises(ValueError):
        grid.prepare_array(df.filter("row_id > 0"), axes, spec)
    assert b.conditional_edf(spec.prepare(df).backend).sum() >= b.edf - 1e-6 and b.edf_weights().sum() == pytest.approx(1)
