"""The public fit: a tensor-train penalised-spline surface with additive terms, its prediction, EDF and uncertainty."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import families as fam_
from ..functions.basis import Knots, difference_penalty, domains, make_knots
from ..plans import tensor
from ..plans.backends import Request, RowBackend, State, build
from ..plans.linalg import ridge_scale, t_two_sided
from . import optimizers as opt
from .control import Control, boundary_status, parse_lambda


@dataclass(frozen=True)
class SmoothTerm:
    """An additive smooth of one column: open ("ps") or cyclic ("cc")."""

    column: str
    bs: str = "ps"
    k: int = 10
    m: int = 2
    degree: int = 3
    period: tuple[float, float] | None = None
    lam: float | str = "cGCV"
    target_edf: float | None = None


@dataclass
class TensorSpline:
    """Estimator. x: ordered covariate columns (their order is the chain's)."""

    x: list[str]
    y: str = "y"
    family: str = "gaussian"
    rank: int | tuple = 3
    k: int | tuple = 10
    degree: int = 3
    penalty_order: int = 2
    lam: float | tuple | str = "cGCV"
    optimizer: str = "auto"
    weight: str | None = None
    offset: str | None = None
    linear: list[str] = field(default_factory=list)
    smooth: list[SmoothTerm] = field(default_factory=list)
    cyclic: bool | tuple = False
    period: dict = field(default_factory=dict)
    knots: list[Knots] | None = None
    backend: str = "auto"
    control: Control = field(default_factory=Control)

    def prepare(self, df: DataFrame, fold: str | None = None) -> Prepared:
        """Knots, bases of additive terms and a backend; two jobs."""
        if len(self.x) < 2:
            raise ValueError("at least two covariates")
        fam = fam_.family(self.family)
        knots = self.knots or make_knots(df, self.x, self.k, self.degree, self.cyclic, self.period)
        terms, z, work = [], list(self.linear), df
        spans = domains(df, [t.column for t in self.smooth]) if self.smooth else []
        for i, (t, span) in enumerate(zip(self.smooth, spans, strict=True)):
            kn = Knots(*(t.period or span), t.k, t.degree, t.bs == "cc")
            work = kn.columns(work, F.col(t.column), f"__s{i}_")
            terms.append((t, kn, slice(1 + len(z), 1 + len(z) + t.k)))
            z += [f"__s{i}_{j + 1}" for j in range(t.k)]
        be = build(work, knots, self.x, self.y, fam, self.weight, self.offset, z, fold, self.backend)
        return Prepared(self, fam, knots, terms, 1 + len(z), be)

    def fit(self, df: DataFrame, seed: int | None = None, monitor=None) -> TensorSplineModel:
        """monitor: a `monitor.FitMonitor`, which records each sweep and lets an interrupted fit go on."""
        ready = self.prepare(df)
        try:
            return ready.fit(seed=seed, monitor=monitor)
        finally:
            if isinstance(ready.backend, RowBackend):
                ready.backend.close()


@dataclass
class Prepared:
    """Data reduced to a backend; fits at other ranks, smoothing or starts need no further preparation."""

    spec: TensorSpline
    family: str
    knots: list[Knots]
    terms: list
    n_beta: int
    backend: object

    def part(self, fold: int, inside: bool) -> Prepared:
        return replace(self, backend=self.backend.part(fold, inside))

    def problem(self, lam=None, control: Control | None = None) -> tuple[opt.Problem, str]:
        c = control or self.spec.control
        method, values = parse_lambda(self.spec.lam if lam is None else lam, len(self.knots), c)
        pens = [difference_penalty(k.k, self.spec.penalty_order, k.cyclic) for k in self.knots]
        smooths = [opt.Smooth(t.column, at, difference_penalty(t.k, t.m, t.bs == "cc"), 1.0 if isinstance(t.lam, str) else float(t.lam), "cGCV" if isinstance(t.lam, str) else "fixed", t.target_edf) for t, _, at in self.terms]
        return opt.Problem(self.backend, self.family, [k.k for k in self.knots], pens, values, c, self.n_beta, smooths), method

    def fit(self, rank=None, lam=None, seed: int | None = None, init: State | None = None, control: Control | None = None, monitor=None) -> TensorSplineModel:
        p, method = self.problem(lam, control)
        p.monitor = monitor
        name = opt.resolve_optimizer(self.spec.optimizer, self.family, bool(self.spec.linear or self.spec.smooth))
        s = init.copy() if init else opt.start(p, self.spec.rank if rank is None else rank, seed, 1.0 if name == "als" else 0.05 / p.control.init_sd if name == "pirls-als" else 1.0)
        trace: list[dict] = []
        if method == "cGCV":
            s, ok, trace = opt.fit_cgcv(p, s, name)
        else:
            s, ok = opt.fit_fixed(p, s, name)
        if monitor is not None:
            monitor.done()
        loss = p.ask("loss", s)
        size = self.backend.total(Request("size"))
        model = TensorSplineModel(
            spec=self.spec, family=self.family, knots=self.knots, state=s, lam=p.lam.copy(), optimizer=name, converged=ok, n=float(size["n"]), sum_w=float(size["w"]),
            deviance=float(loss["dev0"]), objective=float(loss["nll0"]) + p.penalty(s), history=p.history, trace=trace, terms=[(t.column, kn, at) for t, kn, at in self.terms], smooths=p.smooths,
        )
        if p.control.compute_edf:
            model.infer(self.backend)
        edge = [f"{x} ({b})" for x, b in zip(self.spec.x, model.boundary(), strict=True) if b != "interior"]
        if method == "cGCV" and edge:
            warnings.warn(f"smoothing at the bounds: {', '.join(edge)}", stacklevel=2)
        return model


@dataclass
class TensorSplineModel:
    """A fit without rows."""

    spec: TensorSpline
    family: str
    knots: list[Knots]
    state: State
    lam: np.ndarray
    optimizer: str
    converged: bool
    n: float
    sum_w: float
    deviance: float
    objective: float
    history: list[dict]
    trace: list[dict]
    terms: list
    smooths: list
    edf: float = float("nan")
    margin_edf: np.ndarray | None = None
    scale: float = 1.0
    vcov_: dict | None = None

    @property
    def cores(self):
        return self.state.cores

    @property
    def intercept(self) -> float:
        return float(self.state.beta[0])

    @property
    def rank(self) -> tuple:
        return tensor.ranks(self.cores)

    def _penalty(self, cores) -> tuple[np.ndarray, list[int]]:
        pens = [difference_penalty(k.k, self.spec.penalty_order, k.cyclic) for k in self.knots]
        sizes = [c.size for c in cores]
        total, at = np.zeros((sum(sizes),) * 2), 0
        for k, n in enumerate(sizes):
            own, _ = tensor.core_penalty(cores, pens, self.lam, k)
            total[at : at + n, at : at + n] = self.lam[k] * own
            at += n
        return total, sizes

    def infer(self, backend) -> TensorSplineModel:
        """Joint EDF and the coefficient covariance in the left-orthogonal gauge, from one pass."""
        gauge = State(tensor.left_orthogonal(self.cores), self.state.beta)
        sums = backend.total(Request("joint", self.family, [gauge]))
        h, (pen, sizes) = sums["S"], self._penalty(gauge.cores)
        eps = ridge_scale(h) * np.eye(len(h))
        influence = np.linalg.solve(h + pen + eps, h)
        self.edf = float(np.trace(influence))
        cuts = np.cumsum([0, *sizes])
        self.margin_edf = np.array([np.trace(influence[a:b, a:b]) for a, b in zip(cuts, cuts[1:])])
        # With the additive block beside the cores.
        n_b = len(self.state.beta)
        full = np.zeros((len(h) + n_b,) * 2)
        full[: len(h), : len(h)], full[: len(h), len(h) :] = h, sums["C"]
        full[len(h) :, : len(h)], full[len(h) :, len(h) :] = sums["C"].T, sums["M"]
        penalty = np.zeros_like(full)
        penalty[: len(h), : len(h)] = pen
        for t in self.smooths:
            a, b = len(h) + t.at.start, len(h) + t.at.stop
            penalty[a:b, a:b] = t.lam * t.penalty
        ridge, mult = ridge_scale(full), 1.0
        while True:
            try:
                hp = full + penalty + mult * ridge * np.eye(len(full))
                np.linalg.cholesky(hp)
                break
            except np.linalg.LinAlgError:
                mult *= 10
                if mult > 1e6:
                    raise
        inverse = np.linalg.inv(hp)
        total_edf = float(np.trace(inverse @ full))
        self.scale = self.deviance / max(self.sum_w - total_edf, 1.0) if self.family == "gaussian" else 1.0
        self.vcov_ = {"cores": gauge.cores, "bayes": self.scale * inverse, "freq": self.scale * inverse @ full @ inverse, "edf": total_edf, "H": full}
        return self

    def conditional_edf(self, backend) -> np.ndarray:
        """Trace of each core's own smoother with the others held; not additive."""
        pens, out = [difference_penalty(k.k, self.spec.penalty_order, k.cyclic) for k in self.knots], []
        whole = backend.total(Request("blocks", self.family, [self.state], None if self.family == "gaussian" else self.state))["S"]
        cuts = np.cumsum([0, *(c.size for c in self.cores)])
        for k in range(len(self.cores)):
            s = whole[cuts[k] : cuts[k + 1], cuts[k] : cuts[k + 1]]
            own, other = tensor.core_penalty(self.cores, pens, self.lam, k)
            out.append(np.trace(np.linalg.solve(s + self.lam[k] * own + other + ridge_scale(s) * np.eye(len(s)), s)))
        return np.array(out, float)

    def edf_weights(self) -> np.ndarray:
        """Shares of the joint EDF by margin."""
        return self.margin_edf / self.margin_edf.sum()

    def trace_frame(self, spark) -> DataFrame:
        """Smoothing by outer step and margin."""
        rows = [(t["outer"], t["margin"], t["old"], t["proposal"], t["new"]) for t in self.trace]
        return spark.createDataFrame(rows, "outer int, margin int, old double, proposal double, new double")

    def vcov(self, freq: bool = False, unconditional: bool = False) -> np.ndarray:
        if unconditional:
            raise NotImplementedError("covariance is conditional on the smoothing")
        return self.vcov_["freq" if freq else "bayes"]

    def aic(self) -> float:
        return self._criterion(2.0)

    def bic(self) -> float:
        return self._criterion(float(np.log(self.n)))

    def _criterion(self, pen: float) -> float:
        fit = self.n * np.log(self.deviance / self.n) if self.family == "gaussian" else self.deviance
        return float(fit + pen * (self.edf + 1))

    def coef(self, full: bool = False) -> dict:
        out = {"beta": self.state.beta, "cores": self.cores}
        return out | {"theta": tensor.dense(self.cores)} if full else out

    def complexity(self) -> dict:
        return tensor.complexity(self.cores) | {"edf": self.edf}

    def outside(self, df: DataFrame) -> DataFrame:
        """One row: for each covariate how many rows of df lie outside the span that the fit saw, where its basis is zero."""
        return df.agg(*[F.coalesce(F.sum(k.outside(F.col(c).cast("double")).cast("long")), F.lit(0)).alias(c) for c, k in zip(self.spec.x, self.knots, strict=True)])

    def boundary(self) -> list[str]:
        return boundary_status(self.lam, self.spec.control.lambda_bounds)

    def parametric_table(self) -> list[dict]:
        """Intercept and linear terms with the surface as an offset: t for Gaussian, else z; aliased terms without values."""
        n_lin, names = 1 + len(self.spec.linear), ["(Intercept)", *self.spec.linear]
        at = len(self.vcov_["H"]) - len(self.state.beta)
        m = self.vcov_["H"][at : at + n_lin, at : at + n_lin]
        kept: list[int] = []
        for i in range(n_lin):  # a term within the span of those before it is aliased
            left = m[i, i] - m[i, kept] @ np.linalg.solve(m[np.ix_(kept, kept)], m[kept, i]) if kept else m[i, i]
            if left > 1e-10 * max(m[i, i], 1e-300):
                kept.append(i)
        # The fitted linear part, told by the kept terms alone.
        inv = np.linalg.inv(m[np.ix_(kept, kept)])
        estimate = dict(zip(kept, inv @ (m[kept] @ self.state.beta[:n_lin]), strict=True))
        out = []
        for i, name in enumerate(names):
            if i not in estimate:
                out.append({"term": name, "estimate": None, "se": None, "statistic": None, "p_value": None})
                continue
            se = float(np.sqrt(max(inv[kept.index(i), kept.index(i)] * self.scale, 0)))
            stat = float(estimate[i] / se) if se else float("inf")
            p = t_two_sided(stat, max(self.n - self.vcov_["edf"], 1)) if self.family == "gaussian" else 2 * (1 - NormalDist().cdf(abs(stat)))
            out.append({"term": name, "estimate": float(estimate[i]), "se": se, "statistic": stat, "p_value": p})
        return out

    def smooth_table(self) -> list[dict]:
        return [{"term": t.name, "k": t.at.stop - t.at.start, "lambda": t.lam, "edf": t.edf} for t in self.smooths]

    def history_frame(self, spark) -> DataFrame:
        rows = [(h["stage"], int(h["sweep"]), float(h["objective"])) for h in self.history]
        return spark.createDataFrame(rows, "stage string, sweep int, objective double")

    def _design_columns(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        z, work = list(self.spec.linear), df
        for i, (column, kn, _) in enumerate(self.terms):
            work = kn.columns(work, F.col(column), f"__s{i}_")
            z += [f"__s{i}_{j + 1}" for j in range(kn.k)]
        return work, z

    def transform(self, df: DataFrame, kind: str = "response", se: bool = False, interval: float | None = None, offset: bool = True, freq: bool = False, contrast: dict | None = None, mark: str | None = "outside") -> DataFrame:
        """df with eta, fit and, if asked for, se (link scale), lower and upper. Narrow: rows are scored where they lie.

        mark: a column that is true where a covariate lies outside the span that the fit saw, so that its basis is zero there; none if df has one of that name.
        contrast: covariate values of a row whose surface is subtracted. Without the offset column its value is 0.
        """
        work, z = self._design_columns(df)
        x, knots, s, n_z = self.spec.x, self.knots, self.state, len(z)
        cov = gauge = None
        if se or interval is not None:
            if self.vcov_ is None:
                raise ValueError("the fit holds no covariance; call infer")
            cov, gauge = np.linalg.cholesky(self.vcov(freq) + 1e-14 * np.eye(len(self.vcov(freq)))), self.vcov_["cores"]
        base = None if contrast is None else [k.evaluate(np.array([float(contrast[c])])) for k, c in zip(knots, x, strict=True)]
        off = F.coalesce(F.col(self.spec.offset).cast("double"), F.lit(0.0)) if offset and self.spec.offset and self.spec.offset in df.columns else F.lit(0.0)
        key = "__in"
        rows = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        inner = work.select(rows.alias(key), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x)], *[F.col(c).cast("double").alias(f"z{i}") for i, c in enumerate(z)], off.alias("off"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                col = lambda c, b=b: b.column(c).to_numpy(zero_copy_only=False).astype(float)
                raw = [col(f"x{i}") for i in range(len(x))]
                known = np.isfinite(np.array(raw + [col(f"z{i}") for i in range(n_z)])).all(axis=0)
                bases = [k.evaluate(np.where(known, v, k.lo)) for k, v in zip(knots, raw, strict=True)]
                zz = np.stack([np.ones(b.num_rows)] + [col(f"z{i}") for i in range(n_z)], axis=1)
                eta = tensor.contract(bases, s.cores)
                if base is not None:
                    eta = eta - tensor.contract(base, s.cores)
                    zz = np.zeros_like(zz)
                eta = np.where(known, eta + np.where(known[:, None], zz, 0) @ s.beta + col("off"), np.nan)
                cols = [b.column(key), pa.array(eta, pa.float64(), mask=~known)]
                if cov is not None:
                    j = tensor.jacobian(bases, gauge)
                    if base is not None:
                        j = j - tensor.jacobian(base, gauge)
                    j = np.concatenate([j, np.where(known[:, None], zz, 0)], axis=1)
                    cols.append(pa.array(np.sqrt(((j @ cov) ** 2).sum(axis=1)), pa.float64(), mask=~known))
                yield pa.RecordBatch.from_arrays(cols, [key, "eta", "se"][: len(cols)])

        schema = inner.select(key).schema.add("eta", "double")
        if cov is not None:
            schema = schema.add("se", "double")
        out = inner.mapInArrow(run, schema)
        eta = F.col("eta")
        link = (lambda c: c) if kind == "link" or contrast is not None else (lambda c: fam_.inverse_link(self.family, c))
        cols = [F.col(f"{key}.`{c}`") for c in df.columns if c not in ("eta", "fit", "se", "lower", "upper")] + [eta, link(eta).alias("fit")]
        if cov is not None:
            cols.append(F.col("se"))
        if interval is not None:
            q = NormalDist().inv_cdf(0.5 + interval / 2)
            cols += [link(eta - q * F.col("se")).alias("lower"), link(eta + q * F.col("se")).alias("upper")]
        if mark and mark.lower() not in {c.lower() for c in df.columns}:
            beyond = F.lit(False)
            for c, k in zip(x, knots, strict=True):
                beyond = beyond | F.coalesce(k.outside(F.col(f"{key}.`{c}`").cast("double")), F.lit(False))
            cols.append(beyond.alias(mark))
        return out.select(*cols)

    def residuals(self, df: DataFrame, kind: str = "deviance") -> DataFrame:
        w = F.coalesce(F.col(self.spec.weight).cast("double"), F.lit(1.0)) if self.spec.weight else None
        return self.transform(df).withColumn("residual", fam_.residual(self.family, F.col(self.spec.y).cast("double"), F.col("fit"), kind, w))

    def refit(self, df: DataFrame, rank=None, lam=None, control: Control | None = None, **changes) -> TensorSplineModel:
        """A fresh fit with this one's knots, at another rank or smoothing or with other settings of the estimator, degrees of freedom included."""
        spec = replace(self.spec, knots=self.knots, rank=self.spec.rank if rank is None else rank, lam=self.spec.lam if lam is None else lam, **changes)
        return replace(spec, control=replace(control or spec.control, compute_edf=True)).fit(df)

    def slice_frame(self, spark, margin: int, at: dict[str, float], points: int = 50) -> DataFrame:
        """Plot data: one covariate over its span, the others held."""
        k = self.knots[margin]
        grid = spark.range(points).select((F.lit(k.lo) + F.col("id") * F.lit((k.hi - k.lo) / (points - 1))).alias(self.spec.x[margin]), *[F.lit(float(at[c])).alias(c) for i, c in enumerate(self.spec.x) if i != margin], *[F.lit(0.0).alias(c) for c in self.spec.linear], *[F.lit(float(at.get(c, kn.lo))).alias(c) for c, kn, _ in self.terms if c not in self.spec.x])
        return self.transform(grid.select(*dict.fromkeys(grid.columns)), kind="link", se=self.vcov_ is not None)

    def __repr__(self) -> str:
        return f"TensorSplineModel({self.family}, x={self.spec.x}, rank={self.rank}, lambda={np.round(self.lam, 6).tolist()}, deviance={self.deviance:.6g}, edf={self.edf:.4g}, converged={self.converged})"

    def summary(self) -> str:
        lines = [repr(self), f"n {self.n:.0f}, optimizer {self.optimizer}, scale {self.scale:.6g}", f"lambda bounds: {self.boundary()}"]
        if self.vcov_ is not None:
            lines += [f"{r['term']}: {r['estimate']} (se {r['se']}, p {r['p_value']})" for r in self.parametric_table()]
        return "\n".join(lines + [f"s({r['term']}): edf {r['edf']:.3g}, lambda {r['lambda']:.3g}" for r in self.smooth_table()])

    def to_json(self) -> str:
        spec = asdict(self.spec)
        spec["knots"] = None
        return json.dumps({
            "spec": spec, "family": self.family, "knots": [asdict(k) for k in self.knots], "cores": [c.tolist() for c in self.cores], "beta": self.state.beta.tolist(), "lam": self.lam.tolist(), "optimizer": self.optimizer, "converged": bool(self.converged),
            "n": self.n, "sum_w": self.sum_w, "deviance": self.deviance, "objective": self.objective, "edf": self.edf, "scale": self.scale, "terms": [(c, asdict(k), at.start, at.stop) for c, k, at in self.terms],
        })

    @classmethod
    def from_json(cls, text: str) -> TensorSplineModel:
        r = json.loads(text)
        spec = r["spec"] | {"control": Control(**{k: tuple(v) if isinstance(v, list) else v for k, v in r["spec"]["control"].items()}), "smooth": [SmoothTerm(**t) for t in r["spec"]["smooth"]]}
        terms = [(c, Knots(**k), slice(a, b)) for c, k, a, b in r["terms"]]
        return cls(TensorSpline(**spec), r["family"], [Knots(**k) for k in r["knots"]], State([np.array(c) for c in r["cores"]], np.array(r["beta"])), np.array(r["lam"]), r["optimizer"], r["converged"], r["n"], r["sum_w"], r["deviance"], r["objective"], [], [], terms, [], r["edf"], None, r["scale"])
