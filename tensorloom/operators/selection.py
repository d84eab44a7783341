"""Rank and column selection: cross-validation on fold-additive backends, rules, multi-start, activity path, drop test."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import families as fam_
from ..functions.basis import Knots, difference_penalty
from ..functions.quantiles import exact_quantiles
from ..plans import tensor
from ..plans.backends import MOMENTS, MomentBackend, Request, RowBackend, State, answer, block_of, build, tree_sums
from ..plans.linalg import brent, f_tail
from . import optimizers as opt
from .spline import Prepared, TensorSpline, TensorSplineModel


def fold_id(key: Column, folds: int, seed: int = 1) -> Column:
    """0..folds-1 from a hash of a row key: the same under any partitioning, and without a shuffle."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int")


#: Rows that are numbered in one task, about.
BUCKET = 1 << 20


def number_rows(df: DataFrame, key: str, into: str = "__row", *ties: str) -> DataFrame:
    """Rows numbered from 0 in the order of a 64-bit hash key (and of `ties` within it), by as many ranges of it as the count of rows asks for."""
    n = df.count()
    buckets = max(1, -(-n // BUCKET))
    # The high 32 bits, as a share of their range, give the bucket: equal shares of a hash hold about equally many rows.
    b = F.floor((F.shiftright(key, 32) + F.lit(1 << 31)) * F.lit(buckets) / F.lit(1 << 32)).cast("int")
    work = df.withColumn("__b", b)
    before = work.groupBy("__b").count().withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__b", "__before")
    rank = F.row_number().over(Window.partitionBy("__b").orderBy(key, *ties)) - 1
    return work.join(before, "__b").withColumn(into, F.col("__before") + rank).drop("__b", "__before")


def balanced_folds(df: DataFrame, key: str, folds: int, seed: int = 1, into: str = "fold") -> DataFrame:
    """Folds whose sizes differ by one at most: rows are numbered in hash order."""
    work = number_rows(df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed))), "__h", "__row", key)
    return work.withColumn(into, (F.col("__row") % folds).cast("int")).drop("__h", "__row")


def normalise_folds(df: DataFrame, fold: str, into: str = "fold_id") -> DataFrame:
    """User fold labels as 1..K, by a table of the distinct labels; a row without a label is an error, raised when it is read."""
    labels = df.select(F.col(fold).alias("__label")).distinct().withColumn(into, F.row_number().over(Window.orderBy("__label")))  # a row for each fold
    out = df.join(labels, df[fold].eqNullSafe(F.col("__label"))).drop("__label")  # Spark broadcasts the labels where they are few
    return out.withColumn(into, F.when(F.col(fold).isNull(), F.raise_error(F.lit(f"a row without a fold in {fold}")).cast("int")).otherwise(F.col(into)))


def cv_loss(metric: str, family: str, y: Column, mu: Column, w: Column | None = None) -> Column:
    """An aggregate: mse, rmse, deviance or logloss."""
    w = F.lit(1.0) if w is None else w
    mean = lambda x: F.sum(w * x) / F.sum(w)
    if metric in ("mse", "rmse"):
        out = mean((y - mu) * (y - mu))
        return F.sqrt(out) if metric == "rmse" else out
    if metric == "logloss":
        m = fam_.clip(mu, fam_.LIK_EPS, 1 - fam_.LIK_EPS)
        return mean(-(y * F.ln(m) + (1 - y) * F.ln(1 - m)))
    if metric == "deviance":
        return mean(fam_.unit_deviance(family, y, mu))
    raise ValueError(f"unknown metric {metric!r}")


def summarise_cv(losses: DataFrame, key: str = "rank") -> DataFrame:
    """(key, fold, loss) -> key, mean_cv (infinite if a fold failed), se_cv over finite folds, n_finite."""
    ok = F.col("loss").isNotNull() & (F.col("loss") < F.lit(float("inf"))) & ~F.isnan("loss")
    finite = F.when(ok, F.col("loss"))
    return losses.groupBy(key).agg(
        F.when(F.count(finite) < F.count("*"), F.lit(float("inf"))).otherwise(F.avg(finite)).alias("mean_cv"),
        (F.stddev_samp(finite) / F.sqrt(F.count(finite).cast("double"))).alias("se_cv"),
        F.count(finite).alias("n_finite"),
    )


def choose(table: list[dict], key: str = "rank", rule: str = "1se", tol: float = 1e-12):
    """min: the smallest key within tol of the best mean; 1se: the smallest key within one standard error of it."""
    best = min(r["mean_cv"] for r in table)
    at = min((r for r in table if r["mean_cv"] <= best + tol), key=lambda r: r[key])
    if rule == "min":
        return at[key]
    if rule != "1se":
        raise ValueError(f"unknown rule {rule!r}")
    return min(r[key] for r in table if r["mean_cv"] <= at["mean_cv"] + (at["se_cv"] or 0.0))


def choose_frame(table: DataFrame, key: str = "rank", tol: float = 1e-12) -> DataFrame:
    """The same as one row (min, one_se), without leaving Spark."""
    best = table.agg(F.min("mean_cv").alias("best"))
    near = table.crossJoin(best)  # one row
    at = near.filter(F.col("mean_cv") <= F.col("best") + tol).agg(F.min_by(F.struct(F.col(key).alias("k"), "mean_cv", "se_cv"), key).alias("at"))
    return table.crossJoin(at).agg(F.first("at.k").alias("min"), F.min(F.when(F.col("mean_cv") <= F.col("at.mean_cv") + F.coalesce(F.col("at.se_cv"), F.lit(0.0)), F.col(key))).alias("one_se"))


def held_out_loss(be, s: State, family: str, metric: str) -> float:
    out = be.total(Request("loss", family, [s]))
    w = float(be.total(Request("size"))["w"])
    if metric == "auto":
        metric = "mse" if family == "gaussian" else "deviance"
    value = float(out["dev0"]) / w
    if metric == "rmse":
        return float(np.sqrt(value))
    return value / 2 if metric == "logloss" else value


@dataclass
class RankSelection:
    """Losses by rank, fold and start, their summary, and the prepared data for a refit."""

    losses: list[dict]
    table: list[dict]
    rule: str
    prepared: Prepared

    @property
    def rank(self):
        return choose(self.table, "rank", self.rule)

    @property
    def rank_min(self):
        return choose(self.table, "rank", "min")

    @property
    def rank_1se(self):
        return choose(self.table, "rank", "1se")

    def refit(self, rank=None) -> TensorSplineModel:
        return self.prepared.fit(rank=rank or self.rank)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r["rank"], float(r["mean_cv"]), float(r["se_cv"])) for r in self.table], "rank int, mean_cv double, se_cv double")

    def plot_frame(self, spark: SparkSession) -> DataFrame:
        """For plots of error, compression and their tradeoff: error bars, the train's stored numbers and their share of the dense tensor, and both choices."""
        sizes = [k.k for k in self.prepared.knots]
        stored = lambda r: tensor.complexity(tensor.init_cores(sizes, r, 1, 0.1))
        rows = [(r["rank"], float(r["mean_cv"]), float(r["mean_cv"] - r["se_cv"]), float(r["mean_cv"] + r["se_cv"]), int(stored(r["rank"])["stored"]), float(stored(r["rank"])["compression"]), r["rank"] == self.rank_min, r["rank"] == self.rank_1se) for r in self.table]
        return spark.createDataFrame(rows, "rank int, mean_cv double, lower double, upper double, stored int, compression double, is_min boolean, is_1se boolean")


def rank_select(df: DataFrame, spec: TensorSpline, ranks=(1, 2, 3, 4, 5), folds: int = 5, fold: str | None = None, key: str | None = None, rule: str = "1se", metric: str = "auto", n_starts: int = 1, seed: int = 1, fit_fun=None) -> RankSelection:
    """K-fold CV over ranks. fit_fun(prepared, rank, seed) replaces the fit of a training part. Knots come from all rows and are shared; training data is the total less a fold; smoothing is chosen within."""
    if fold is None:
        cols = [key] if key else [*spec.x, spec.y]
        df, fold = df.withColumn("__fold", fold_id(F.struct(*cols), folds, seed)), "__fold"
    whole = spec.prepare(df, fold=fold)
    fast = replace(spec.control, compute_edf=False)
    losses = []
    for f in whole.backend.folds:
        train, test = whole.part(f, False), whole.part(f, True)
        for r in ranks:
            best = None
            for start in range(n_starts):
                try:
                    m = fit_fun(train, r, seed + start) if fit_fun else train.fit(rank=r, seed=seed + start, control=fast)
                    if np.isfinite(m.objective) and (best is None or m.objective < best.objective):
                        best = m
                except (np.linalg.LinAlgError, FloatingPointError):
                    continue
            losses.append({"rank": int(r), "fold": int(f), "loss": held_out_loss(test.backend, best.state, whole.family, metric) if best else float("inf")})
    return RankSelection(losses, summary_rows(losses), rule, whole)


def summary_rows(losses: list[dict], key: str = "rank") -> list[dict]:
    out = []
    for r in sorted({x[key] for x in losses}):
        v = np.array([x["loss"] for x in losses if x[key] == r], float)
        ok = np.isfinite(v)
        out.append({key: r, "mean_cv": float(v.mean()) if ok.all() else float("inf"), "se_cv": float(v[ok].std(ddof=1) / np.sqrt(ok.sum())) if ok.sum() > 1 else 0.0, "n_finite": int(ok.sum())})
    return out


def rank_profile(df: DataFrame, spec: TensorSpline, ranks=(1, 2, 3, 4, 5)) -> list[dict]:
    """In-sample fits over ranks on shared statistics."""
    p, out = spec.prepare(df), []
    for r in ranks:  # shared statistics
        m = p.fit(rank=r)
        out.append({"rank": int(r), "deviance": m.deviance, "objective": m.objective, "edf": m.edf, "aic": m.aic(), "bic": m.bic(), **{k: v for k, v in m.complexity().items() if k in ("stored", "intrinsic", "compression")}})
    _close(p.backend)
    return out


def multistart(df: DataFrame, spec: TensorSpline, n_starts: int = 10, criterion: str = "objective", prefer_converged: bool = True, fit_fun=None) -> tuple[TensorSplineModel, list[dict]]:
    """The best of several random starts, with the table of all. fit_fun(prepared, rank, seed): a fit of one's own.

    A start that fails is a row of the table (ok false, with its error) and is never the best.
    """
    p, fits, table = spec.prepare(df), [], []
    for i in range(n_starts):
        seed = spec.control.seed + i
        try:
            m = fit_fun(p, spec.rank, seed) if fit_fun else p.fit(seed=seed)
            row = {"objective": m.objective, "deviance": getattr(m, "deviance", float("nan")), "edf": getattr(m, "edf", float("nan")), "converged": getattr(m, "converged", True), "boundary": float(np.mean([b != "interior" for b in m.boundary()])) if hasattr(m, "boundary") else float("nan"), "ok": True, "error": None}
        except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:
            m, row = None, {"objective": float("inf"), "deviance": float("inf"), "edf": float("nan"), "converged": False, "boundary": float("nan"), "ok": False, "error": str(e)}
        fits.append(m)
        table.append({"start": i + 1, **row})
    _close(p.backend)
    able = [i for i in range(n_starts) if table[i]["ok"]]
    if not able:
        raise ValueError(f"every start failed: {table[0]['error'] if table else 'none asked for'}")
    best = min(able, key=lambda i: (prefer_converged and not table[i]["converged"], table[i][criterion]))
    return fits[best], table


# Columns.


def reference_points(df: DataFrame, columns: list[str], how: str = "median") -> dict[str, float]:
    """Exact medians, or means."""
    if how == "median":
        return {c: v[0] for c, v in exact_quantiles(df, columns, [0.5]).items()}
    if how != "mean":
        raise ValueError(f"unknown reference {how!r}")
    r = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return {c: float(r[c]) for c in columns}


def partial_range(model: TensorSplineModel, at: dict[str, float], n_grid: int = 40) -> list[float]:
    """For each column the range of its partial curve, others at their reference."""
    out = []
    for i, _ in enumerate(model.spec.x):
        bases = [k.evaluate(np.linspace(k.lo, k.hi, n_grid) if i == j else np.full(n_grid, np.clip(at[c], k.lo, k.hi))) for j, (c, k) in enumerate(zip(model.spec.x, model.knots, strict=True))]
        out.append(float(np.ptp(tensor.contract(bases, model.cores))))
    return out


@dataclass
class ActivityPath:
    path: list[dict]
    order: list[str]
    table: list[dict]
    losses: list[dict]
    m_min: int
    m_1se: int
    selected: list[str]
    model: object

    def path_frame(self, spark: SparkSession) -> DataFrame:
        """For the plot of activity over the path: a row for each smoothing and column, with the column's place in the ranking from 1."""
        rows = [(float(r["lambda"]), r["column"], float(r["activity"]), self.order.index(r["column"]) + 1) for r in self.path]
        return spark.createDataFrame(rows, "lambda double, column string, activity double, place int")

    def cv_frame(self, spark: SparkSession) -> DataFrame:
        """For the plot of loss by number of columns: error bars, the column that each size adds, and both choices."""
        rows = [(int(r["m"]), self.order[r["m"] - 1] if r["m"] else None, float(r["mean_cv"]), float(r["mean_cv"] - r["se_cv"]), float(r["mean_cv"] + r["se_cv"]), r["m"] == self.m_min, r["m"] == self.m_1se) for r in self.table]
        return spark.createDataFrame(rows, "m int, added string, mean_cv double, lower double, upper double, is_min boolean, is_1se boolean")


@dataclass
class Univariate:
    """A one-column penalised smoother with GCV, for paths that end at one column."""

    column: str
    knots: Knots
    coef: np.ndarray
    lam: float
    edf: float


def _curve(df: DataFrame, spec: TensorSpline, column: str, knots: Knots, fold: str | None = None):
    """A backend of one margin in the spec's family, beside a constant one."""
    return build(df.withColumn("__one", F.lit(0.5)), [knots, Knots(0.0, 1.0, 1, 0)], [column, "__one"], spec.y, fam_.family(spec.family), spec.weight, spec.offset, [], fold, "auto")


def _curve_fit(be, knots: Knots, spec: TensorSpline, most: int = 50) -> tuple[np.ndarray, float, float]:
    """(coefficients, lambda, EDF) of a penalised curve with GCV; for other families by working responses until it stands still."""
    family = fam_.family(spec.family)
    size = be.total(Request("size"))
    g, lam, edf = np.full(knots.k, 0.0 if family == "gaussian" else fam_.start_intercept(family, float(size["w"]), float(size["wy"]), float(size["we"]))), 1.0, 0.0
    for _ in range(1 if family == "gaussian" else most):
        s = State([g.reshape(1, -1, 1), np.ones((1, 1, 1))], np.zeros(1))
        m = be.total(Request("core", family, [s], None if family == "gaussian" else s, 0))
        cache = opt.Spectral.of(be.n, float(m["zz"]), m["S"], m["b"], difference_penalty(knots.k, spec.penalty_order, knots.cyclic), np.zeros_like(m["S"]))
        lam = float(np.exp(brent(lambda x, cache=cache: cache.gcv(np.exp(x)), np.log(1e-4), np.log(1e4))))
        new, edf = cache.u @ (cache.b / (1 + lam * cache.values)), cache.edf(lam)
        still, g = np.abs(new - g).max() <= 1e-6 * (1 + np.abs(new).max()), new
        if still:
            break
    return g, lam, edf


def _curve_state(g: np.ndarray) -> State:
    return State([g.reshape(1, -1, 1), np.ones((1, 1, 1))], np.zeros(1))


def _close(be) -> None:
    if isinstance(be, RowBackend):
        be.close()


def activity_path(df: DataFrame, spec: TensorSpline, lambdas=tuple(10 ** np.linspace(2, -1, 7)), n_grid: int = 40, folds: int = 5, rule: str = "1se", reference: str = "median", seed: int = 1) -> ActivityPath:
    """Columns ranked by the mean range of their partial curves over a path of smoothing; then nested top-m models by CV.

    One loss for all sizes: mean squared error, or the family's mean deviance.
    """
    whole = spec.prepare(df)
    at, path = reference_points(df, spec.x, reference), []
    fast = replace(spec.control, compute_edf=False)
    for lam in lambdas:
        m = whole.fit(lam=float(lam), control=fast)
        path += [{"lambda": float(lam), "column": c, "activity": a} for c, a in zip(spec.x, partial_range(m, at, n_grid), strict=True)]
    mean = {c: float(np.mean([p["activity"] for p in path if p["column"] == c])) for c in spec.x}
    order = sorted(spec.x, key=lambda c: (-mean[c], spec.x.index(c)))
    knots = dict(zip(spec.x, whole.knots, strict=True))
    work, family = df.withColumn("__fold", fold_id(F.struct(*spec.x, spec.y), folds, seed)), fam_.family(spec.family)
    _close(whole.backend)
    losses = []
    for m in range(len(order) + 1):
        cols = [c for c in spec.x if c in order[:m]]
        if m >= 2:
            sub = replace(spec, x=cols, knots=[knots[c] for c in cols], rank=spec.rank if np.isscalar(spec.rank) else 2)
            sel = rank_select(work, sub, ranks=[sub.rank], fold="__fold")
            _close(sel.prepared.backend)
            losses += [{"m": m, "fold": x["fold"], "loss": x["loss"]} for x in sel.losses]
            continue
        kn = knots[cols[0]] if cols else Knots(0.0, 1.0, 1, 0)
        be = _curve(work, spec, cols[0] if cols else "__one", kn, "__fold")
        for f in be.folds:
            train, test = be.part(f, False), be.part(f, True)
            if m == 0:
                z = train.total(Request("size"))
                s = State([np.zeros((1, 1, 1)), np.zeros((1, 1, 1))], np.array([fam_.start_intercept(family, float(z["w"]), float(z["wy"]), float(z["we"]))]))
            else:
                s = _curve_state(_curve_fit(train, kn, spec)[0])
            losses.append({"m": m, "fold": int(f), "loss": held_out_loss(test, s, family, "auto")})
        _close(be)
    table = summary_rows(losses, "m")
    m_min, m_1se = choose(table, "m", "min"), choose(table, "m", "1se")
    m = m_1se if rule == "1se" else m_min
    selected = [c for c in spec.x if c in order[:m]]
    if m >= 2:
        model = replace(spec, x=selected, knots=[knots[c] for c in selected], lam="cGCV").fit(df)
    elif m == 1:
        be = _curve(df, spec, selected[0], knots[selected[0]])
        g, lam, edf = _curve_fit(be, knots[selected[0]], spec)
        _close(be)
        model = Univariate(selected[0], knots[selected[0]], g, lam, edf)
    else:
        model = None
    return ActivityPath(path, order, table, losses, m_min, m_1se, selected, model)


def drop_test(df: DataFrame, spec: TensorSpline, method: str = "F", b: int = 99, alpha: float = 0.05, seed: int = 1) -> list[dict]:
    """For each column the deviance without it, and an F or permutation p-value.

    All permutations of a Gaussian surface are gathered in one pass where its moments can be held (see `permuted_moments`); else each is a fit of its own, over
    the same turned rows.
    """
    full, turned = spec.fit(df), None
    knots = dict(zip(spec.x, full.knots, strict=True))
    out = []
    for c in spec.x:
        rest = [x for x in spec.x if x != c]
        if len(rest) >= 2:
            less = replace(spec, x=rest, knots=[knots[x] for x in rest], rank=spec.rank if np.isscalar(spec.rank) else 2).fit(df)
            dev, edf = less.deviance, less.edf
        else:
            be = _curve(df, spec, rest[0], knots[rest[0]])
            g, _, edf = _curve_fit(be, knots[rest[0]], spec)
            dev = float(be.total(Request("loss", fam_.family(spec.family), [_curve_state(g)]))["dev0"])
            _close(be)
        delta, nu = dev - full.deviance, max(full.edf - edf, 1.0)
        row = {"column": c, "delta_deviance": delta, "nu": nu}
        if method == "F":
            stat = max(delta, 0) / nu / (full.deviance / max(full.n - full.edf, 1))
            p = f_tail(stat, nu, max(full.n - full.edf, 1))
        else:
            # The column's values dealt anew, b times.
            held = spec_with(spec, full.knots)
            if turned is None:
                turned = permuted_moments(df, held, b, seed) if _gathers(held) else rotations(df, spec.x, b, seed)
            if isinstance(turned, dict):
                fits = [Prepared(held, "gaussian", full.knots, [], 1 + len(spec.linear), be).fit() for be in turned[c]]
            else:
                fits = [held.fit(turned.withColumn(c, F.get("__turned", F.lit(t))[f"v{spec.x.index(c)}"])) for t in range(min(b, int(full.n) - 1))]
            stat, hits = delta, sum(m.deviance <= full.deviance for m in fits)
            p = (1 + hits) / (len(fits) + 1)
        out.append(row | {"statistic": float(stat), "p_value": float(p), "keep": bool(p < alpha)})
    return out


def drop_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """The rows of `drop_test` as a table, by falling statistic."""
    cols = ("column", "delta_deviance", "nu", "statistic", "p_value", "keep")
    rows = sorted(rows, key=lambda r: (-r["statistic"], r["column"]))
    return spark.createDataFrame([tuple(r[c] if c in ("column", "keep") else float(r[c]) for c in cols) for r in rows], "column string, delta_deviance double, nu double, statistic double, p_value double, keep boolean")


def rotations(df: DataFrame, columns: list[str], b: int, seed: int = 1, into: str = "__turned") -> DataFrame:
    """df with, for each row, an array of b structs: the columns' values of the rows 1, 2, ..., b places on in the order of a hash, around the end.

    In that order a turn by any number of places is a random dealing of the values. Rows are numbered by ranges of the hash, and blocks of the
    numbers overlap by b rows, so no task holds more than a block; a table of n rows has n - 1 turns at most.
    """
    own = number_rows(df.withColumn("__h", F.xxhash64(F.struct(*df.columns), F.lit(seed))), "__h", "__row", *df.columns)
    own = own.drop("__h")
    n = df.count()
    b, step = min(b, max(n - 1, 0)), max(BUCKET, b)
    last, block = (n - 1) // step if n else 0, F.floor(F.col("__row") / step)
    # A row stands at its own number, and for the block before it, or for the last from the front, at a number beyond that block's end.
    at = lambda k, no, halo: F.struct(k.cast("long").alias("k"), no.cast("long").alias("no"), F.lit(halo).alias("halo"))
    places = F.array_compact(F.array(at(block, F.col("__row"), False), F.when((F.col("__row") % step < b) & (block > 0), at(block - 1, F.col("__row"), True)), F.when(F.col("__row") < b, at(F.lit(last), F.col("__row") + n, True))))
    # The last block may be shorter than b: what follows it there begins again at the front, so the block before it looks around the end too.
    if last and n - last * step < b:
        places = F.array_compact(F.concat(places, F.array(F.when(F.col("__row") < b, at(F.lit(last - 1), F.col("__row") + n, True)))))
    own = own.withColumn("__at", F.explode(places))
    w = Window.partitionBy("__at.k").orderBy("__at.no").rowsBetween(1, b)
    turned = F.collect_list(F.struct(*[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(columns)])).over(w)
    return own.withColumn(into, turned).filter(~F.col("__at.halo")).drop("__at", "__row")


def _gathers(spec: TensorSpline) -> bool:
    return fam_.family(spec.family) == "gaussian" and not spec.smooth and np.prod([k.k for k in spec.knots], dtype=float) <= MOMENTS


#: Numbers that the sums of all permutations may have together in one pass.
GATHERED = 100_000_000


def permuted_moments(df: DataFrame, spec: TensorSpline, b: int, seed: int = 1) -> dict[str, list[MomentBackend]]:
    """{column: moments with that column's values dealt anew, b times}, all gathered by one pass over the rows (or as few as `GATHERED` allows).

    spec: Gaussian with knots, no smooth terms. A permutation turns the hash order of the rows (see `rotations`).
    """
    if not spec.knots or not _gathers(spec):
        raise ValueError(f"permutations in one pass are for Gaussian surfaces with knots, at most {MOMENTS} tensor entries and no smooth terms")
    sizes, d = [k.k for k in spec.knots], len(spec.x)
    entries = int(np.prod(sizes, dtype=float))
    number = lambda c, default: F.col(c).cast("double") if c else F.lit(default)
    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(spec.x)], *[F.col(c).cast("double").alias(f"z{i}") for i, c in enumerate(spec.linear)], F.col(spec.y).cast("double").alias("y"), number(spec.weight, 1.0).alias("w"), number(spec.offset, 0.0).alias("off"))
    turned = rotations(rows.filter("w is null or w <> 0"), [f"x{i}" for i in range(d)], b, seed)
    each = max(1, min(b, GATHERED // (d * entries * entries)))
    out: dict[str, list[MomentBackend]] = {c: [] for c in spec.x}
    dummy, knots, n_z = State([np.zeros((1, p, 1)) for p in sizes], np.zeros(1 + len(spec.linear))), spec.knots, len(spec.linear)
    for first in range(0, b, each):
        # The turns of this pass, flat: turn by turn, column by column.
        part = turned.withColumn("__turned", F.transform(F.slice("__turned", first + 1, each), lambda v: F.array(*[v[f"v{i}"] for i in range(d)])))

        def sums(batch, n_z=n_z) -> dict:
            own, flat = block_of(batch, knots, n_z), batch.column("__turned")
            values = np.asarray(flat.flatten().flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1, d)
            found: dict = {}
            for i in range(d):
                for t in range(values.shape[1]):
                    b_ = replace(own, bases=[knots[j].evaluate(values[:, t, j]) if j == i else x for j, x in enumerate(own.bases)])
                    got = answer(b_, Request("tensor", states=[dummy])) | answer(b_, Request("size"))
                    found |= {(i * 1_000_000 + t, name): v for name, v in got.items()}
            return found

        got: dict[int, dict] = {}
        for (key, name), v in tree_sums(part, sums).items():
            got.setdefault(key, {})[name] = v
        for key in sorted(got):
            out[spec.x[key // 1_000_000]].append(MomentBackend(sizes, got[key]))
    return out


def spec_with(spec: TensorSpline, knots) -> TensorSpline:
    return replace(spec, knots=knots, control=replace(spec.control, compute_edf=False))


def permuted(df: DataFrame, column: str, seed: int) -> DataFrame:
    """df with the values of one column dealt anew: both sides are numbered in the order of a hash and joined on the number."""
    n = lambda x, s: number_rows(x.withColumn("__k", F.xxhash64(F.struct(*x.columns), F.lit(s))), "__k", "__row", *x.columns)
    left = n(df, seed).drop(column, "__k")
    right = n(df, seed + 7919).select("__row", column)
    return left.join(right, "__row").drop("__row").select(*df.columns)
