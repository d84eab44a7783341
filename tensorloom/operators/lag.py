"""Distributed-lag surfaces: the sum over lags of h(x1_{t-l}, ..., xp_{t-l}, l), h one tensor train over all exposures and the lag."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType
from pyspark.sql.window import Window

from ..functions import families as fam_
from ..functions.basis import Knots, difference_penalty, domains
from ..functions.quantiles import exact_quantiles
from ..plans import tensor
from ..plans.backends import MOMENTS, deviance, tree_sums
from ..plans.linalg import brent, ridge_scale, root, solve_spd
from .control import Control
from .optimizers import Spectral
from .spline import SmoothTerm

#: Ordered rows that a task works through at once.
RANGE = 1 << 20
#: What the additive columns' equations may be off by, as a share of their sums.
EQUATIONS = 1e-12


def lag_columns(df: DataFrame, column: str, lag: int, order_by: str, series: str | None = None, prefix: str | None = None) -> DataFrame:
    """df with prefix0..prefixL, null in the burn-in, by one window over each series; without series over the whole table in one task."""
    w = Window.partitionBy(series).orderBy(order_by) if series else Window.orderBy(order_by)
    return df.select("*", *[F.lag(F.col(column).cast("double"), i).over(w).alias(f"{prefix or column + '_lag'}{i}") for i in range(lag + 1)])


def ordered_ranges(df: DataFrame, lag: int, order_by: str, series: str | None = None) -> DataFrame:
    """df cut into blocks of some `RANGE` ordered rows of a series, each with the `lag` rows before it as a halo: columns __block, __row (the row's number in its series) and __halo.

    Series of more than `RANGE` rows are cut at approximate quantiles of their own order (a number, date or time), which come as a table with a row for
    each such series, so the plan is the same for any data. Counts of the cuts number the rows, and blocks of the numbers overlap by the
    halo, so no task holds more than a block of a series. Rows of equal order go by a hash of the row.
    """
    s = F.col(series) if series else F.lit(0)
    work = df.withColumn("__series", s).withColumn("__hash", F.xxhash64(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    sizes = work.groupBy("__series").agg(F.count("*").alias("n")).filter(F.col("n") > RANGE)
    most = sizes.agg(F.max("n")).first()[0]
    if most:
        shares = [i / (-(-most // RANGE)) for i in range(1, -(-most // RANGE))]
        long = work.join(sizes.select(F.col("__series").alias("__s")), F.col("__series").eqNullSafe(F.col("__s")), "left_semi")
        cuts = long.groupBy(F.col("__series").alias("__s")).agg(F.percentile_approx(order_by, shares, 10_000).alias("__cuts"))
        work = work.join(cuts, F.col("__series").eqNullSafe(F.col("__s")), "left").drop("__s")
        at = F.size(F.filter("__cuts", lambda c: c < F.col(order_by)))
        work = work.withColumn("__range", F.when(F.col("__cuts").isNull() | F.col(order_by).isNull(), F.lit(0)).otherwise(at)).drop("__cuts")
    else:
        work = work.withColumn("__range", F.lit(0))
    counts = work.groupBy("__series", "__range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__series").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("__series").alias("__s"), F.col("__range").alias("__r"), before.alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__series", "__range").orderBy(order_by, "__hash")) - 1
    work = work.withColumn("__rank", rank).join(starts, F.col("__series").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")))
    work = work.withColumn("__row", F.col("__before") + F.col("__rank")).drop("__s", "__r", "__before", "__rank", "__range", "__hash")
    step = max(RANGE, lag)
    block, none = F.floor(F.col("__row") / step), F.lit(None).cast("long")
    both = F.array_compact(F.array(block, F.when((F.col("__row") % step >= step - lag) & F.lit(lag > 0), block + 1).otherwise(none)))
    work = work.withColumn("__block", F.explode(both))
    return work.withColumn("__halo", F.col("__block") != F.floor(F.col("__row") / step))


def lag_windows(df: DataFrame, exposures: list[str], lag: int, order_by: str, series: str | None = None, complete: bool = True) -> DataFrame:
    """All lag columns, and with `complete` only rows whose windows have no null.

    Without series the table is one ordered series. Where a series has more than `RANGE` rows and its order is a number, date or time, it is worked through in
    overlapping blocks; shorter ones are a window each. Rows of equal order go by a hash of the row, so that windows don't change from run to run.
    """
    kind, columns = df.schema[order_by].dataType, df.columns
    longest = (df.groupBy(series).count() if series else df.agg(F.count("*").alias("count"))).agg(F.max("count")).first()[0] or 0
    ranged = longest > RANGE and isinstance(kind, (NumericType, DateType, TimestampType, TimestampNTZType))
    if ranged:
        df = ordered_ranges(df, lag, order_by, series)
        w = Window.partitionBy("__series", "__block").orderBy("__row")
    else:
        w = (Window.partitionBy(series) if series else Window.partitionBy(F.lit(0))).orderBy(order_by, F.xxhash64(F.struct(*[F.col(f"`{c}`") for c in columns])))
    lags = [F.lag(F.col(e).cast("double"), i).over(w).alias(f"{e}__lag{i}") for e in exposures for i in range(lag + 1)]
    df = df.select("*", *lags)
    if ranged:
        df = df.filter(~F.col("__halo")).select(*[F.col(f"`{c}`") for c in columns], *[F.col(f"`{e}__lag{i}`") for e in exposures for i in range(lag + 1)])
    if complete:
        for e in exposures:
            for i in range(lag + 1):
                df = df.filter(F.col(f"`{e}__lag{i}`").isNotNull())
    return df


@dataclass
class DistributedLagSpline:
    """Estimator of sum over lags of h(x1_{t-l}, ..., xp_{t-l}, l), h one tensor train over all exposures and the lag.

    exposures: ordered series; order_by: the time column. Poisson by default, as counts in time are the usual response. lam: a number, one for each
    exposure and the lag, or "cGCV" (each core's own, Gaussian or within each PIRLS step).
    """

    exposures: list[str]
    y: str
    order_by: str
    series: str | None = None
    lag: int = 14
    family: str = "poisson"
    rank: int = 1
    k: int = 8
    k_lag: int = 4
    lam: float | list | str = 1.0
    penalty: str = "own"
    linear: list[str] = field(default_factory=list)
    smooth: list[SmoothTerm] = field(default_factory=list)
    offset: str | None = None
    weight: str | None = None
    control: Control = field(default_factory=Control)

    def fit(self, df: DataFrame) -> DistributedLagModel:
        """Where the whole tensor has at most `MOMENTS` entries one Arrow job gives the sums of a Gaussian fit or a PIRLS step; else one for each core."""
        fam = fam_.family(self.family)
        spans = domains(df, self.exposures)  # from the whole series, before lagging
        lag_knots = Knots(0.0, float(max(self.lag, 1)), min(self.k_lag, self.lag + 1), min(3, min(self.k_lag, self.lag + 1) - 1))
        knots = [Knots(*s, self.k) for s in spans] + [lag_knots]
        work = lag_windows(df, self.exposures, self.lag, self.order_by, self.series)
        terms, z = [], list(self.linear)
        for i, (t, s) in enumerate(zip(self.smooth, domains(df, [t.column for t in self.smooth]) if self.smooth else [], strict=True)):
            kn = Knots(*(t.period or s), t.k, t.degree, t.bs == "cc")
            work = kn.columns(work, F.col(t.column), f"__s{i}_")
            terms.append((t, kn, slice(1 + len(z), 1 + len(z) + t.k)))
            z += [f"__s{i}_{j + 1}" for j in range(t.k)]
        cols = [F.col(f"`{c}`") for c in self.lag_names()] + [F.col(c).cast("double").alias(f"z{i}") for i, c in enumerate(z)]
        number = lambda c, default: F.col(c).cast("double") if c else F.lit(default)
        rows = work.select(*cols, F.col(self.y).cast("double").alias("y"), number(self.offset, 0.0).alias("off"), number(self.weight, 1.0).alias("w")).persist()
        try:
            return self._fit(fam, rows, knots, terms, z)
        finally:
            rows.unpersist()

    def lag_names(self) -> list[str]:
        return [f"{e}__lag{i}" for e in self.exposures for i in range(self.lag + 1)]

    def bases(self, b: pa.RecordBatch, knots: list[Knots]) -> Iterator[list[np.ndarray]]:
        """The bases of all margins, for each lag."""
        at = knots[-1].evaluate(np.arange(self.lag + 1.0))
        for i in range(self.lag + 1):
            own = [k.evaluate(np.nan_to_num(_numbers(b, f"{e}__lag{i}"), nan=k.lo)) for e, k in zip(self.exposures, knots, strict=False)]
            yield [*own, np.repeat(at[i : i + 1], b.num_rows, axis=0)]

    def _fit(self, fam, rows, knots, terms, z) -> DistributedLagModel:
        c, sizes = self.control, [k.k for k in knots]
        d, entries = len(sizes), int(np.prod(sizes, dtype=float))
        bad = F.lit(False)
        for name in rows.columns:
            bad = bad | F.col(f"`{name}`").isNull() | F.isnan(f"`{name}`")
        size = rows.agg(F.count("*").alias("n"), F.sum((bad | (F.col("w") < 0)).cast("long")).alias("bad"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("y"), F.sum(F.col("w") * F.exp("off")).alias("e")).first()
        if not size["n"]:
            raise ValueError("no complete window")
        if size["bad"]:
            raise ValueError(f"{size['bad']} rows with a null or NaN, or a negative weight")

        def sums(cores: list[np.ndarray], beta: np.ndarray, k: int | None) -> dict:
            """Working normal equations at the parameters: of the whole tensor (k None) or of core k, beside the additive columns."""

            def part(b: pa.RecordBatch) -> dict:
                x, f = 0.0, 0.0
                for bases in self.bases(b, knots):
                    f = f + tensor.contract(bases, cores)
                    x = x + (_tensor_basis(bases) if k is None else tensor.design_core(bases, cores, k))
                zs = np.stack([np.ones(b.num_rows)] + [_numbers(b, f"z{i}") for i in range(len(z))], axis=1)
                y, off, w0 = (_numbers(b, n) for n in ("y", "off", "w"))
                eta = off + zs @ beta + f
                w, t = fam_.np_working(fam, y, eta, w0)
                both, t = np.concatenate([x, zs], axis=1), t - off
                bw = both * w[:, None]
                out = {"S": both.T @ bw, "b": bw.T @ t, "zz": np.array(w @ (t * t)), "nll": np.array(fam_.np_nll(fam, y, eta, w0)), "dev": np.array(deviance(fam, y, fam_.np_inverse(fam, eta), w0))}
                return {(0, name): v for name, v in out.items()}

            return {name: v for (_, name), v in tree_sums(rows, part).items()}

        def losses(tries: list[tuple[list[np.ndarray], np.ndarray]]) -> list[tuple[float, float]]:
            """(loss, deviance) of all candidates in one pass."""

            def part(b: pa.RecordBatch) -> dict:
                surfaces = [0.0] * len(tries)
                for bases in self.bases(b, knots):
                    surfaces = [f + tensor.contract(bases, cs) for f, (cs, _) in zip(surfaces, tries, strict=True)]
                zs = np.stack([np.ones(b.num_rows)] + [_numbers(b, f"z{i}") for i in range(len(z))], axis=1)
                y, off, w0 = (_numbers(b, n) for n in ("y", "off", "w"))
                etas = [off + zs @ bt + f for f, (_, bt) in zip(surfaces, tries, strict=True)]
                return {(0, "loss"): np.array([[fam_.np_nll(fam, y, e, w0), deviance(fam, y, fam_.np_inverse(fam, e), w0)] for e in etas])}

            return [(float(a), float(b)) for a, b in tree_sums(rows, part)[0, "loss"]]

        def additive(beta: np.ndarray) -> dict:
            """Loss, deviance, score and curvature in the additive columns, the cores as they are; `size` is what the score's sums are made of."""

            def part(b: pa.RecordBatch) -> dict:
                zs = np.stack([np.ones(b.num_rows)] + [_numbers(b, f"z{i}") for i in range(len(z))], axis=1)
                y, off, w0 = (_numbers(b, n) for n in ("y", "off", "w"))
                eta = off + zs @ beta + sum(tensor.contract(bases, cores) for bases in self.bases(b, knots))
                both = np.array([fam_.np_nll(fam, y, eta, w0), deviance(fam, y, fam_.np_inverse(fam, eta), w0)])
                out = {"loss": both, "score": -zs.T @ fam_.np_score(fam, y, eta, w0), "size": np.abs(zs).T @ (w0 * np.abs(y)), "H": zs.T @ (zs * (w0 * fam_.np_curvature(fam, eta, np.ones(len(y))))[:, None])}
                return {(0, name): v for name, v in out.items()}

            return {name: v for (_, name), v in tree_sums(rows, part).items()}

        rng = np.random.default_rng(c.seed)
        r = [1] + [self.rank] * (d - 1) + [1]
        cores = [rng.normal(0, c.init_sd, (r[i], p, r[i + 1])) for i, p in enumerate(sizes)]
        beta = np.zeros(1 + len(z))
        beta[0] = fam_.start_intercept(fam, float(size["w"]), float(size["y"]), float(size["e"]))
        pens = [difference_penalty(p, min(2, p - 1)) if p > 1 else np.zeros((1, 1)) for p in sizes]
        automatic = self.lam == "cGCV"
        lam = np.full(d, float(c.lambda_start)) if automatic else np.full(d, float(self.lam)) if np.isscalar(self.lam) else np.asarray(self.lam, float)
        if lam.shape != (d,) or not (lam > 0).all():
            raise ValueError(f"lam needs 1 or {d} positive numbers, or cGCV")
        index = tensor.index_bases(sizes) if entries <= MOMENTS else None
        smooth_pens = [(at, difference_penalty(t.k, t.m, t.bs == "cc")) for t, _, at in terms]
        smooth_lam = [1.0 if isinstance(t.lam, str) else float(t.lam) for t, _, _ in terms]

        def penalty(cs, bt) -> float:
            own = tensor.penalty_value(cs, pens, lam) if self.penalty == "global" else sum(0.5 * lam[k] * tensor.pack(cs[k]) @ tensor.core_penalty(cs, pens, lam, k, "own")[0] @ tensor.pack(cs[k]) for k in range(d))
            return own + sum(0.5 * x * bt[at] @ p @ bt[at] for (at, p), x in zip(smooth_pens, smooth_lam, strict=True))

        # The ridge of a step is on how far it goes, not on where it ends: at a standstill the equations hold without it.
        def core_step(m: dict, k: int) -> None:
            """Core k given all else: m holds sums of its own design, then of the additive columns."""
            n = cores[k].size
            s, rest = m["S"][:n, :n], m["b"][:n] - m["S"][:n, n:] @ beta
            own, other = tensor.core_penalty(cores, pens, lam, k, self.penalty)
            if automatic:
                zz = float(m["zz"] - 2 * m["b"][n:] @ beta + beta @ m["S"][n:, n:] @ beta)
                cache = Spectral.of(float(size["w"]), zz, s, rest, own, other)
                lam[k] = np.exp(brent(lambda x: cache.gcv(np.exp(x)), *np.log(c.lambda_bounds)))
            a, g = s + lam[k] * own + other, tensor.pack(cores[k])
            cores[k] = tensor.unpack(g + solve_spd(a + ridge_scale(s) * np.eye(n), rest - a @ g), cores[k].shape)

        def additive_step(s: np.ndarray, rest: np.ndarray) -> np.ndarray:
            s = s.copy()
            plain = s.copy()
            for i, ((pos, p), (t, _, _)) in enumerate(zip(smooth_pens, terms, strict=True)):
                if t.target_edf is not None:
                    own = plain[pos, pos]
                    edf = lambda x, own=own, p=p: float(np.trace(np.linalg.solve(own + np.exp(x) * p + ridge_scale(own) * np.eye(len(own)), own)))
                    smooth_lam[i] = float(np.exp(root(lambda x, edf=edf, t=t: edf(x) - t.target_edf, -18, 18)))
                s[pos, pos] += smooth_lam[i] * p
            return beta + solve_spd(s + ridge_scale(s) * np.eye(len(s)), rest - s @ beta)

        def sweep(m: dict | None) -> None:
            nonlocal beta
            for k in range(d):
                if m is None:
                    core_step(last := sums(cores, beta, k), k)
                else:
                    a = np.zeros((len(m["S"]), cores[k].size + len(beta)))
                    a[:entries, : cores[k].size] = tensor.design_core(index, cores, k)
                    a[entries:, cores[k].size :] = np.eye(len(beta))
                    last = {"S": a.T @ m["S"] @ a, "b": a.T @ m["b"], "zz": m["zz"]}
                    core_step(last, k)
            g, n = tensor.pack(cores[-1]), cores[-1].size  # `last` is of the last core, whose design its own update leaves alone
            beta = additive_step(last["S"][n:, n:], last["b"][n:] - last["S"][n:, :n] @ g)

        def settle(bt: np.ndarray) -> tuple[np.ndarray, float, float, list[tuple[float, float]]]:
            """Newton steps in the additive columns until their equations hold, however large the sums; the problem is convex and the cores stay."""
            pen = np.zeros((len(bt), len(bt)))
            for (at, p), x in zip(smooth_pens, smooth_lam, strict=True):
                pen[at, at] = x * p
            here, done = additive(bt), []
            for _ in range(c.pirls_maxit):
                grad, old = here["score"] - pen @ bt, float(here["loss"][0]) + penalty(cores, bt)
                if (np.abs(grad) <= EQUATIONS * here["size"]).all():
                    break
                move = solve_spd(here["H"] + pen, grad)
                for t in lengths:
                    to = additive(bt + t * move)
                    value = float(to["loss"][0]) + penalty(cores, bt + t * move)
                    if np.isfinite(value) and value <= old + c.objective_tol * abs(old):
                        break
                else:
                    break  # no step along this direction goes down
                if value >= old and np.abs(to["score"] - pen @ (bt + t * move)).max() >= np.abs(grad).max():
                    break  # rounding is all that is left
                bt, here = bt + t * move, to
                done.append((value, t))
            return bt, *map(float, here["loss"]), done

        history, converged = [], False
        steps, inner = (1, c.max_sweeps) if fam == "gaussian" else (c.pirls_maxit, c.als_sweeps_per_pirls_max)
        if index is None and fam != "gaussian":
            inner = 1
        lengths = [1.0]
        while lengths[-1] * c.step_factor >= c.step_min:
            lengths.append(lengths[-1] * c.step_factor)
        dense = lambda: (tensor.dense(cores) if index is not None else np.concatenate([tensor.pack(x) for x in cores])).ravel()
        loss, dev = losses([(cores, beta)])[0]
        for it in range(1, steps + 1):
            first = [x.copy() for x in cores], beta.copy()
            m = sums(cores, beta, None) if index is not None else None
            for _ in range(inner):
                before = dense()
                sweep(m)
                now = dense()
                if fam == "gaussian" and np.abs(now - before).max() <= np.sqrt(c.tol) * max(np.abs(now).max(), 1e-12):
                    converged = True
                    break
            # How far to go: the longest step that doesn't raise the penalised objective, all of them tried in one pass.
            tries = [([a + t * (b - a) for a, b in zip(first[0], cores, strict=True)], first[1] + t * (beta - first[1])) for t in (lengths if fam != "gaussian" else [1.0])]
            old, found = loss + penalty(*first), losses(tries)
            values = [x + penalty(*t) for (x, _), t in zip(found, tries, strict=True)]
            best = next((i for i, v in enumerate(values) if np.isfinite(v) and v <= old + c.objective_tol * abs(old)), None) if fam != "gaussian" else 0
            if best is None:
                cores[:], beta = first[0], first[1]
                converged = True  # no step along this direction goes down
                break
            cores[:], beta, (loss, dev) = tries[best][0], tries[best][1], found[best]
            history.append({"stage": "pirls" if fam != "gaussian" else "als", "sweep": it, "objective": values[best], "step": lengths[best]})
            if fam != "gaussian" and best == 0 and abs(old - values[best]) <= c.tol * (abs(old) + c.tol):
                converged = True
                break
        beta, loss, dev, more = settle(beta)
        history += [{"stage": "additive", "sweep": len(history) + i, "objective": x, "step": t} for i, (x, t) in enumerate(more, 1)]
        medians = exact_quantiles(rows, [f"{e}__lag0" for e in self.exposures], [0.5])
        return DistributedLagModel(self, fam, knots, cores, beta, lam, [(t.column, kn, at) for t, kn, at in terms], dev, float(size["n"]), converged, history, {e: medians[f"{e}__lag0"][0] for e in self.exposures})


def _numbers(b: pa.RecordBatch, c: str) -> np.ndarray:
    return b.column(c).to_numpy(zero_copy_only=False).astype(float)


def _tensor_basis(bases: list[np.ndarray]) -> np.ndarray:
    """Row-wise products of all bases, the first index slowest."""
    out = np.ones((len(bases[0]), 1))
    for b in bases:
        out = (out[:, :, None] * b[:, None, :]).reshape(len(b), -1)
    return out


@dataclass
class DistributedLagModel:
    spec: DistributedLagSpline
    family: str
    knots: list[Knots]
    cores: list[np.ndarray]
    beta: np.ndarray
    lam: np.ndarray
    terms: list
    deviance: float
    n: float
    converged: bool
    history: list[dict]
    centre: dict[str, float]

    def surface(self, at: np.ndarray, lag: int | None) -> np.ndarray:
        """h at rows of exposure values: at a lag, or summed over all."""
        lags = self.knots[-1].evaluate(np.arange(self.spec.lag + 1.0) if lag is None else np.array([float(lag)])).sum(axis=0, keepdims=True)
        return tensor.contract([k.evaluate(at[:, i]) for i, k in enumerate(self.knots[:-1])] + [np.repeat(lags, len(at), axis=0)], self.cores)

    def effect_rows(self, exposure: str, at=None, lag: int | None = None, centre: float | dict | None = None, points: int = 50) -> list[tuple]:
        if lag is not None and not 0 <= lag <= self.spec.lag:
            raise ValueError(f"lag must be in 0..{self.spec.lag}")
        i = self.spec.exposures.index(exposure)
        held = {**self.centre, **(centre if isinstance(centre, dict) else {} if centre is None else {exposure: float(centre)})}
        x = np.linspace(self.knots[i].lo, self.knots[i].hi, points) if at is None else np.asarray(at, float)
        base = np.array([[held[e] for e in self.spec.exposures]])
        grid = np.repeat(base, len(x), axis=0)
        grid[:, i] = x
        h, h0 = self.surface(grid, lag), self.surface(base, lag)[0]
        return [(float(v), lag, float(a), float(a - h0), float(np.exp(a - h0))) for v, a in zip(x, h, strict=True)]

    def effect(self, spark, exposure: str, at=None, lag: int | None = None, centre: float | dict | None = None, points: int = 50) -> DataFrame:
        """(value, lag, h, log_rr, rr) against the centre, over all lags or of one, the other exposures held at theirs (medians by default)."""
        return spark.createDataFrame(self.effect_rows(exposure, at, lag, centre, points), "value double, lag int, h double, log_rr double, rr double")

    def transform(self, df: DataFrame) -> DataFrame:
        """All rows of df with eta and fit; null where the window isn't complete."""
        spec = self.spec
        work = lag_windows(df, spec.exposures, spec.lag, spec.order_by, spec.series, complete=False)
        z = list(spec.linear)
        for i, (c, kn, _) in enumerate(self.terms):
            work = kn.columns(work, F.col(c), f"__s{i}_")
            z += [f"__s{i}_{j + 1}" for j in range(kn.k)]
        lags = spec.lag_names()
        inner = work.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__in"), *[F.col(f"`{c}`") for c in lags], *[F.col(c).cast("double").alias(f"z{i}") for i, c in enumerate(z)], (F.coalesce(F.col(spec.offset).cast("double"), F.lit(0.0)) if spec.offset else F.lit(0.0)).alias("off"))
        beta, n_z, knots, cores = self.beta, len(z), self.knots, self.cores

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                known = np.logical_and.reduce([np.isfinite(_numbers(b, c)) for c in lags])
                eta = _numbers(b, "off") + beta[0] + sum((_numbers(b, f"z{i}") * beta[i + 1] for i in range(n_z)), np.zeros(b.num_rows))
                for bases in spec.bases(b, knots):
                    eta = eta + tensor.contract(bases, cores)
                yield pa.RecordBatch.from_arrays([b.column("__in"), pa.array(eta, pa.float64(), mask=~known)], ["__in", "eta"])

        out = inner.mapInArrow(run, inner.select("__in").schema.add("eta", "double"))
        return out.select("__in.*", "eta", F.when(F.col("eta").isNotNull(), fam_.inverse_link(self.family, F.col("eta"))).alias("fit"))


def with_lag(spec: DistributedLagSpline, **kw) -> DistributedLagSpline:
    return replace(spec, **kw)
