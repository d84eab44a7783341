"""Marks of rows outside the span, aliased terms, refits, own fit functions, failed fits as rows."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.operators import lab, selection
from tensorloom.operators import optimizers as opt
from tensorloom.operators.control import Control
from tensorloom.operators.spline import TensorSpline


@pytest.fixture(scope="module")
def wave(spark):
    x = spark.range(400).select("id", F.rand(1).alias("x1"), F.rand(2).alias("x2"))
    return x.withColumn("flag", (F.col("id") % 2).cast("double")).withColumn("y", F.sin(6 * F.col("x1")) * (1 + F.col("x2")) + 2 * F.col("flag") + 0.3 * F.randn(3)).cache()


SPEC = TensorSpline(["x1", "x2"], rank=1, k=5, lam=0.5)


def test_rows_outside_the_span_are_marked(spark, wave):
    m = SPEC.fit(wave)
    new = spark.createDataFrame([(0.5, 0.5), (7.0, 0.5), (0.5, -3.0), (None, 0.5)], "x1 double, x2 double")
    assert [r["outside"] for r in m.transform(new, se=True).collect()] == [False, True, True, False]
    assert "outside" not in m.transform(new, mark=None).columns
    own = m.transform(new.withColumn("Outside", F.lit("mine")))
    assert own.columns.count("Outside") == 1 and "outside" not in own.columns
    assert m.transform(wave).filter("outside").count() == 0


def test_a_doubled_term_leaves_the_others_as_they_are(wave):
    df = wave.withColumn("twin", F.col("flag")).withColumn("both", 1 + F.col("flag")).withColumn("z", F.col("x1") * F.col("x2"))
    alone = replace(SPEC, linear=["flag", "z"]).fit(df).parametric_table()
    rows = {r["term"]: r for r in replace(SPEC, linear=["flag", "twin", "both", "z"]).fit(df).parametric_table()}
    assert rows["twin"]["estimate"] is None and rows["both"]["se"] is None
    for r in alone:
        for k in ("estimate", "se", "p_value"):
            assert rows[r["term"]][k] == pytest.approx(r[k], rel=1e-4, abs=1e-8)


def test_refit_is_a_fresh_fit(wave):
    m = replace(SPEC, control=Control(compute_edf=False)).fit(wave)
    again = m.refit(wave, rank=2, lam=0.1)
    fresh = replace(SPEC, rank=2, lam=0.1, knots=m.knots).fit(wave)
    assert again.objective == fresh.objective and again.edf == fresh.edf and np.isfinite(again.edf)
    assert m.refit(wave, linear=["flag"]).deviance < m.deviance


def test_own_fits_and_failures(wave):
    def mine(prepared, rank, seed):
        if seed == 2:
            raise np.linalg.LinAlgError("no luck")
        return prepared.fit(rank=rank, seed=seed)

    best, table = selection.multistart(wave, SPEC, 3, fit_fun=mine)
    assert [r["ok"] for r in table] == [True, False, True] and table[1]["error"] == "no luck"
    assert best.objective == min(r["objective"] for r in table)
    with pytest.raises(ValueError, match="every start failed"):
        selection.multistart(wave, replace(SPEC, control=Control(seed=2)), 1, fit_fun=mine)

    def fragile(problem, start):
        if problem.lam[0] > 5:
            raise ArithmeticError("too smooth")
        return opt.als(problem, start)[0]

    rows = lab.lambda_grid(wave, replace(SPEC, linear=[]), (-1.0, 1.0), fit_fun=fragile)
    assert sorted(r["ok"] for r in rows) == [False, False, True, True] and all(r["gcv"] == float("inf") for r in rows if not r["ok"])
    assert all(r["ok"] for r in lab.flat_region(rows))
