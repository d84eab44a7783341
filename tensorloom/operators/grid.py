"""Dense grid baselines: penalised fits of the whole coefficient tensor on an array, and their comparison with tensor trains."""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import families as fam_
from ..functions.basis import Knots, difference_penalty
from ..plans import tensor
from ..plans.backends import MomentBackend, Request, State, build
from ..plans.linalg import solve_spd
from .control import parse_lambda
from .spline import TensorSpline, TensorSplineModel


def rotated_product(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """x applied to the first index of a, which then becomes the last."""
    return np.moveaxis(np.tensordot(x, a, axes=(1, 0)), 0, -1)


def apply_axes(xs: list[np.ndarray], a: np.ndarray) -> np.ndarray:
    """Each matrix on its own index: the linear predictor for bases, B'y for their transposes."""
    for x in xs:
        a = rotated_product(x, a)
    return a


def axis_gram(bases: list[np.ndarray]) -> np.ndarray:
    """The unweighted Gram matrix of a full grid: a Kronecker product of the axes'."""
    out = np.eye(1)
    for b in bases:
        out = np.kron(out, b.T @ b)
    return out


def weighted_gram(bases: list[np.ndarray], w: np.ndarray) -> np.ndarray:
    """X'WX of a full grid in any number of dimensions, from row tensors of the axes."""
    sizes = [b.shape[1] for b in bases]
    d = len(sizes)
    a = apply_axes([np.einsum("ni,nj->nij", b, b).reshape(len(b), -1).T for b in bases], w)
    a = a.reshape([n for p in sizes for n in (p, p)])
    return a.transpose([2 * i for i in range(d)] + [2 * i + 1 for i in range(d)]).reshape(int(np.prod(sizes)), -1)


def grid_scan(df: DataFrame, index: list[str], sizes: list[int], into: str = "row_id") -> DataFrame:
    """A grid table with row numbers from 0, the first index fastest (indices from 1)."""
    out, step = F.lit(0).cast("long"), 1
    for c, n in zip(index, sizes, strict=True):
        out, step = out + (F.col(c) - 1) * step, step * n
    return df.withColumn(into, out)


def axes_product(spark: SparkSession, axes: dict[str, list[float]]) -> DataFrame:
    """All points of a grid: row_id, i1.., and the axis values, the first fastest; arithmetic on one range, no join."""
    sizes = [len(v) for v in axes.values()]
    df, step, cols = spark.range(int(np.prod(sizes))).withColumnRenamed("id", "row_id"), 1, []
    for i, (name, v) in enumerate(axes.items()):
        at = (F.floor(F.col("row_id") / step) % sizes[i]).cast("int")
        cols += [(at + 1).alias(f"i{i + 1}"), F.get(F.array(*[F.lit(float(x)) for x in v]), at).alias(name)]
        step *= sizes[i]
    return df.select("row_id", *cols)


@dataclass
class DenseGridModel:
    """A fit of the whole tensor at fixed lambda."""

    x: list[str]
    family: str
    knots: list[Knots]
    theta: np.ndarray
    intercept: float
    lam: np.ndarray
    edf: float
    deviance: float
    n: float

    def transform(self, df: DataFrame) -> DataFrame:
        cores = dense_train(self.theta, [kn.k for kn in self.knots])
        spec = TensorSpline(self.x, family=self.family, knots=self.knots)
        m = TensorSplineModel(spec, self.family, self.knots, State(cores, np.array([self.intercept])), self.lam, "dense", True, self.n, self.n, self.deviance, float("nan"), [], [], [], [])
        return m.transform(df, offset=False)


def fit_dense(df: DataFrame, x: list[str], y: str = "y", family: str = "gaussian", knots: list[Knots] | None = None, k: int = 8, lam=1.0, weight: str | None = None, offset: str | None = None, order: int = 2, maxit: int = 50) -> DenseGridModel:
    """Gaussian or Poisson, fixed lambda, any dimension whose tensor has at most some thousand entries. No separate intercept."""
    spec = TensorSpline(x, y, family, knots=knots, k=k, weight=weight, offset=offset)
    from ..functions.basis import make_knots

    fam = fam_.family(family)
    knots = knots or make_knots(df, x, k)
    sizes = [kn.k for kn in knots]
    if np.prod(sizes, dtype=float) > 5000:
        raise ValueError("the dense tensor has more than 5000 entries")
    be = build(df, knots, x, y, fam, weight, offset)
    lam = np.full(len(x), float(lam)) if np.isscalar(lam) else np.asarray(lam, float)
    pen = tensor.dense_penalty(sizes, [difference_penalty(p, order) for p in sizes], lam)
    del spec
    size = be.total(Request("size"))
    start = 0.0 if fam == "gaussian" else fam_.start_intercept(fam, float(size["w"]), float(size["wy"]), float(size["we"]))
    shapes = [np.zeros((1, p, 1)) for p in sizes]

    def state(theta: np.ndarray) -> State:
        return State(dense_train(theta, sizes), np.zeros(1))

    theta = np.full(int(np.prod(sizes)), start)
    for _ in range(1 if fam == "gaussian" else maxit):
        sums = be.total(Request("tensor", fam, [State(shapes, np.zeros(1))], None if fam == "gaussian" else state(theta)))
        s = sums["S"] + pen
        new = solve_spd(s + 1e-8 * np.eye(len(s)), sums["b"])
        change = np.abs(new - theta).max()
        theta = new
        if change < 1e-8 * (1 + np.abs(theta).max()):
            break
    edf = float(np.trace(np.linalg.solve(s + 1e-8 * np.eye(len(s)), sums["S"])))
    dev = float(be.total(Request("loss", fam, [state(theta)]))["dev0"])
    return DenseGridModel(x, fam, knots, theta, 0.0, lam, edf, dev, be.n)


def compare(df: DataFrame, x: list[str], truth: str, k: int = 8, lam: float = 1.0, ranks=(1, 2, 3), y: str = "y", select: bool = True, knots: list[Knots] | None = None) -> list[dict]:
    """Dense baseline, trains of several ranks and the CV choices, with RMSE against the truth, EDF and seconds."""
    from .selection import rank_select

    def row(method: str, make, rank=None) -> dict:
        t = time.perf_counter()
        m = make()
        s = time.perf_counter() - t
        rmse = m.transform(df).agg(F.sqrt(F.avg((F.col("fit") - F.col(truth)) * (F.col("fit") - F.col(truth)))).alias("r")).first()["r"]
        return {"method": method, "rank": rank, "rmse": float(rmse), "edf": float(m.edf), "seconds": s}

    spec = TensorSpline(x, y, k=k, lam=lam, knots=knots)
    out = [row("dense", lambda: fit_dense(df, x, y, knots=knots, k=k, lam=lam))]
    trains = [row(f"tt{r}", lambda r=r: replace(spec, rank=r).fit(df), r) for r in ranks]
    out += trains + [min(trains, key=lambda r: r["rmse"]) | {"method": "oracle"}]
    if select:
        t = time.perf_counter()
        sel = rank_select(df, spec, ranks=list(ranks))
        s = time.perf_counter() - t
        for name, r in (("minCV", sel.rank_min), ("1-SE", sel.rank_1se)):
            out.append(next(x for x in trains if x["rank"] == r) | {"method": name, "seconds": s})
    return out


def summarise_comparisons(rows: DataFrame) -> DataFrame:
    """(d, n_grid, k, method, rmse) -> one row for each design, a column for each method."""
    return rows.groupBy("d", "n_grid", "k").pivot("method").agg(F.avg("rmse"))


def analyse_comparisons(rows: DataFrame) -> DataFrame:
    """(d, n_grid, k, method, rmse, seconds) with the choices by CV -> one row for each design: how far each choice is from the best
    rank and from the dense fit (ratios, and percent over the best rank), and how often the fit's time the choice takes.

    A ratio is null where either side is null or not finite, or the divisor is nearly 0.
    """
    wide = rows.groupBy("d", "n_grid", "k").pivot("method", ["dense", "oracle", "minCV", "1-SE"]).agg(F.avg("rmse").alias("rmse"), F.avg("seconds").alias("seconds"))
    known = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c)) < F.lit(float("inf"))) & ~F.isnan(c)
    ratio = lambda a, b: F.when(known(a) & known(b) & (F.abs(F.col(b)) > 1e-12), F.col(a) / F.col(b))
    percent = lambda a, b: 100 * (ratio(a, b) - 1)
    return wide.select(
        "d", "n_grid", "k", known("dense_rmse").alias("dense_feasible"), ratio("minCV_rmse", "oracle_rmse").alias("min_over_oracle"), ratio("1-SE_rmse", "oracle_rmse").alias("one_se_over_oracle"),
        percent("minCV_rmse", "oracle_rmse").alias("min_excess_pct"), percent("1-SE_rmse", "oracle_rmse").alias("one_se_excess_pct"), ratio("1-SE_rmse", "dense_rmse").alias("one_se_over_dense"), ratio("1-SE_seconds", "oracle_seconds").alias("select_over_fit"),
    )


def compare_scale(spark: SparkSession, designs=((2, 12, 6), (3, 8, 5)), lam: float = 1.0, ranks=(1, 2), sigma: float = 0.2, seed: int = 1) -> DataFrame:
    """Comparisons over designs (d, points on each axis, k): d, n_grid, k, method, rank, rmse, edf, seconds."""
    from ..functions.surfaces import grid_truth, normal

    out = []
    for d, n, k in designs:
        axes = {f"x{i + 1}": np.linspace(0, 1, n).tolist() for i in range(d)}
        df = axes_product(spark, axes).withColumn("truth", grid_truth([F.col(c) for c in axes])).withColumn("y", F.col("truth") + sigma * normal(F.col("row_id"), seed, 0)).cache()
        out += [(d, n, k, r["method"], r["rank"], r["rmse"], r["edf"], r["seconds"]) for r in compare(df, list(axes), "truth", k, lam, ranks, select=False)]
        df.unpersist()
    return spark.createDataFrame(out, "d int, n_grid int, k int, method string, rank int, rmse double, edf double, seconds double")


def prepare_array(df: DataFrame, axes: dict[str, list[float]], spec: TensorSpline):
    """A full grid table as a prepared Gaussian fit: the Gram matrix is a Kronecker product of the axes', and rows are read for B'y alone.

    Only for a whole grid with even weights; equal to the scattered fit of the same rows.
    """
    from ..functions.basis import make_knots
    from ..plans.backends import collect_sums
    from .spline import Prepared

    knots = spec.knots or make_knots(df, spec.x, spec.k, spec.degree)
    bases = [k.evaluate(np.asarray(axes[c], float)) for c, k in zip(spec.x, knots, strict=True)]
    n = int(np.prod([len(axes[c]) for c in spec.x]))
    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(spec.x)], F.col(spec.y).cast("double").alias("y"), F.lit(1.0).alias("w"), F.lit(0.0).alias("off"))

    def sums(b) -> dict:
        x = b.bases[0]
        for other in b.bases[1:]:
            x = (x[:, :, None] * other[:, None, :]).reshape(len(x), -1)
        return {"b": x.T @ b.y, "zz": (b.y**2).sum(), "m": np.array([b.y.sum()]), "n": float(len(b.y))}

    m = collect_sums(rows, sums, knots, 0)
    if int(m["n"]) != n:
        raise ValueError(f"a whole grid has {n} rows, not {int(m['n'])}")
    cross = np.ones(1)
    for b in bases:
        cross = np.kron(cross, b.sum(axis=0))
    y = np.atleast_1d(m["m"])
    full = {"S": axis_gram(bases), "b": m["b"], "C": cross[:, None], "M": np.array([[float(n)]]), "m": y, "zz": m["zz"], "w": float(n), "n": float(n), "wy": float(y[0]), "we": float(n), "yy": m["zz"]}
    return Prepared(spec, "gaussian", knots, [], 1, MomentBackend([k.k for k in knots], full))


def dense_train(theta: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """An exact train of a flat tensor: the tensor itself in the last core, index selectors before it."""
    cores, a = [], 1
    for p in sizes[:-1]:
        cores.append(np.eye(a * p).reshape(a, p, a * p))
        a *= p
    return [*cores, theta.reshape(a, sizes[-1], 1)]


from .null_space import ProfiledNull, fit_profiled_null, null_basis  # noqa: E402, F401
