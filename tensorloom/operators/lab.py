"""Experimental joint smoothing: Monte Carlo degrees of freedom, global GCV, Sobol and simplex search. Gaussian only.

A probe is a sign for each row, from a hash of the row's key. Where a fit rests on moments, probes enter through B'z alone, so all of them ride on one Arrow pass
and refits need none; over rows a refit reads the rows with its probe added to the response. Cells hold the mean sign of their rows. Without a key cells draw their
signs themselves; the two other backends need one, unique for each row, as equal keys would share a sign.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basis import difference_penalty
from ..plans import tensor
from ..plans.backends import Block, CellBackend, MomentBackend, Request, RowBackend, State, collect_sums
from ..plans.linalg import brent, nelder_mead, ridge_scale, sobol
from . import optimizers as opt
from .spline import Prepared, TensorSpline


def probe(key, seed: int, m: int):
    """A Rademacher column from a hash of the row's key."""
    return F.when(F.pmod(F.xxhash64(key, F.lit(seed), F.lit(m)), F.lit(2)) == 0, 1.0).otherwise(-1.0)


def global_gcv(n: float, rss: float, gdf: float) -> float:
    """n RSS / (n - gdf)^2; infinite where the degrees of freedom are out of range."""
    if not np.isfinite(gdf) or not np.isfinite(rss) or gdf < 0 or gdf >= n:
        return float("inf")
    return n * rss / (n - gdf) ** 2


def probed_rows(df: DataFrame, spec: TensorSpline, key: list[str] | str, seed: int, m: int) -> DataFrame:
    """The rows that a fit sees (x0.., y, w, off) with probe0..probe{m-1}."""
    number = lambda c, default: F.col(c).cast("double") if c else F.lit(default)
    key = F.struct(*([key] if isinstance(key, str) else key))
    cols = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(spec.x)] + [F.col(spec.y).cast("double").alias("y"), number(spec.weight, 1.0).alias("w"), number(spec.offset, 0.0).alias("off")]
    return df.select(*cols, *[probe(key, seed, i).alias(f"probe{i}") for i in range(m)]).filter("w <> 0")


class CellProbes:
    """Mean signs of the cells."""

    def __init__(self, be: CellBackend, z: np.ndarray):
        self.be, self.z = be, z

    @classmethod
    def drawn(cls, be: CellBackend, seed: int, m: int) -> CellProbes:
        rng, n = np.random.default_rng(seed), be.counts
        return cls(be, np.stack([(2 * rng.binomial(n.astype(int), 0.5) - n) / n for _ in range(m)]))

    @classmethod
    def hashed(cls, be: CellBackend, rows: DataFrame, m: int) -> CellProbes:
        keys = [c for c in rows.columns if c[0] == "x"] + ["off"]
        t = rows.groupBy(*keys).agg(*[F.avg(f"probe{i}").alias(f"probe{i}") for i in range(m)]).orderBy(*keys).toArrow()  # the cells, in their own order
        return cls(be, np.stack([t.column(f"probe{i}").to_numpy() for i in range(m)]))

    def moved(self, m: int, step: float) -> CellBackend:
        return CellBackend(replace(self.be.block, y=self.be.block.y + step * self.z[m]), self.be.counts, self.be.within)

    def effect(self, m: int, up: State, down: State) -> float:
        return float((self.be.counts * self.z[m] * (self.be.block.eta(up) - self.be.block.eta(down))).sum())


class MomentProbes:
    """All probes projected to the tensor basis by one Arrow pass over the rows."""

    def __init__(self, be: MomentBackend, rows: DataFrame, knots: list, m: int):
        def sums(b: Block) -> dict:
            x = b.bases[0]
            for other in b.bases[1:]:
                x = (x[:, :, None] * other[:, None, :]).reshape(len(x), -1)
            wz, t = b.w[:, None] * b.probes, b.y - b.off
            return {"x": x.T @ b.probes, "z": b.z.T @ b.probes, "wx": x.T @ wz, "wz": b.z.T @ wz, "ty": t @ wz, "zz": (b.probes * wz).sum(axis=0)}

        self.be, self.m = be, collect_sums(rows, sums, knots, 0)
        self.z = range(m)

    def moved(self, m: int, step: float) -> MomentBackend:
        own, p = self.be.m, self.m
        return MomentBackend(self.be.sizes, own | {"b": own["b"] + step * p["wx"][:, m], "m": own["m"] + step * p["wz"][:, m], "zz": own["zz"] + 2 * step * p["ty"][m] + step**2 * p["zz"][m]})

    def effect(self, m: int, up: State, down: State) -> float:
        index = tensor.index_bases(self.be.sizes)
        return float(self.m["x"][:, m] @ (tensor.contract(index, up.cores) - tensor.contract(index, down.cores)) + self.m["z"][:, m] @ (up.beta - down.beta))


class RowProbes:
    """Rows with their probes; a refit adds one to the response."""

    def __init__(self, be: RowBackend, rows: DataFrame, m: int):
        self.be, self.rows, self.z = be, rows, range(m)

    def moved(self, m: int, step: float) -> RowBackend:
        return RowBackend(self.rows.withColumn("y", F.col("y") + F.lit(step) * F.col(f"probe{m}")), self.be.knots, self.be.n_z, self.be.n)

    def effect(self, m: int, up: State, down: State) -> float:
        return float(collect_sums(self.rows, lambda b: {"e": b.probes[:, m] @ (b.eta(up) - b.eta(down))}, self.be.knots, self.be.n_z)["e"])


@dataclass
class Evaluator:
    """Global GCV at log10 lambda, memoised, with common probes and warm starts. df and key: for probes made from the rows."""

    prepared: Prepared
    rank: int
    probes: int = 5
    eps: float = 1e-3
    seed: int = 1
    sweeps: int = 25
    df: DataFrame | None = None
    key: list[str] | str | None = None
    fit_fun: object = None  # fit_fun(problem, start) -> state, in place of alternating sweeps

    def __post_init__(self):
        be, spec = self.prepared.backend, self.prepared.spec
        if self.prepared.family != "gaussian" or spec.linear or spec.smooth:
            raise ValueError("the laboratory works on Gaussian surfaces without further terms")
        if self.key is None and not isinstance(be, CellBackend):
            raise ValueError("probes over moments or rows need the rows' key")
        rows = None if self.key is None else probed_rows(self.df, spec, self.key, self.seed, self.probes)
        if rows is None:
            self.bank = CellProbes.drawn(be, self.seed, self.probes)
        elif isinstance(be, CellBackend):
            self.bank = CellProbes.hashed(be, rows, self.probes)
        else:
            self.bank = MomentProbes(be, rows, self.prepared.knots, self.probes) if isinstance(be, MomentBackend) else RowProbes(be, rows, self.probes)
        size = be.total(Request("size"))
        self.n, self.step = float(size["n"]), self.eps * float(np.sqrt(size["yy"] / size["w"]))
        self.cache: dict[tuple, dict] = {}
        self.base: State | None = None

    def _fit(self, lam: np.ndarray, backend, start: State | None) -> State:
        p, _ = replace(self.prepared, backend=backend).problem(lam)
        p.control = replace(p.control, max_sweeps=self.sweeps)
        start = start or opt.start(p, self.rank, self.seed)
        return self.fit_fun(p, start) if self.fit_fun else opt.fit_fixed(p, start, "als")[0]

    def at(self, log10_lam) -> dict:
        """One evaluation; where a fit fails its row says so (ok false, with the error), its criterion is infinite and a search goes on."""
        key = tuple(np.round(np.asarray(log10_lam, float), 10))
        if key not in self.cache:
            try:
                self.cache[key] = self._evaluated(key, log10_lam) | {"ok": True, "error": None}
            except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:
                self.cache[key] = {"log10_lambda": key, "gdf": float("nan"), "gdf_se": float("nan"), "rss": float("nan"), "gcv": float("inf"), "ok": False, "error": str(e)}
        return self.cache[key]

    def _evaluated(self, key: tuple, log10_lam) -> dict:
        lam, be = 10 ** np.asarray(log10_lam, float), self.prepared.backend
        s = self._fit(lam, be, self.base)
        self.base = self.base or s
        gdf = []
        for m in range(self.probes):
            # Central: what a start that hasn't quite converged still moves cancels.
            up, down = (self._fit(lam, self.bank.moved(m, t), s) for t in (self.step, -self.step))
            gdf.append(self.bank.effect(m, up, down) / (2 * self.step))
        rss = float(be.total(Request("loss", "gaussian", [s]))["dev0"])
        df = float(np.mean(gdf))
        return {"log10_lambda": key, "gdf": df, "gdf_se": float(np.std(gdf) / max(len(gdf), 1) ** 0.5), "rss": rss, "gcv": global_gcv(self.n, rss, df)}

    def gcv(self, log10_lam) -> float:
        return self.at(log10_lam)["gcv"]


def ready(df: DataFrame, spec: TensorSpline, key=None) -> Prepared:
    """Without a key of the rows the laboratory needs cells; with one, whatever backend the spec names or the data call for."""
    return (replace(spec, backend="cells") if key is None else spec).prepare(df)


def gdf_mc(df: DataFrame, spec: TensorSpline, lam, probes: int = 5, seed: int = 1, key: list[str] | str | None = None, sweeps: int = 25) -> dict:
    """Monte Carlo generalised degrees of freedom at fixed lambda."""
    return Evaluator(ready(df, spec, key), spec.rank, probes, seed=seed, sweeps=sweeps, df=df, key=key).at(np.log10(np.full(len(spec.x), float(lam)) if np.isscalar(lam) else np.asarray(lam, float)))


def lambda_grid(df: DataFrame, spec: TensorSpline, points, key: list[str] | str | None = None, fit_fun=None) -> list[dict]:
    """Global GCV over a grid of log10 lambda for every margin."""
    e = Evaluator(ready(df, spec, key), spec.rank, df=df, key=key, fit_fun=fit_fun)
    mesh = np.stack([m.ravel() for m in np.meshgrid(*[np.asarray(points, float)] * len(spec.x), indexing="ij")], axis=1)
    return [e.at(v) for v in mesh]


def flat_region(rows: list[dict], share: float = 0.01) -> list[dict]:
    best = min(r["gcv"] for r in rows)
    return [r for r in rows if r["gcv"] <= best * (1 + share)]


def diverse_top(points: np.ndarray, values: np.ndarray, k: int, least: float) -> list[int]:
    """Greedy: the best point, then the best that keeps its distance."""
    out: list[int] = []
    for i in np.argsort(values, kind="stable"):
        if all(np.linalg.norm(points[i] - points[j]) >= least for j in out):
            out.append(int(i))
        if len(out) == k:
            break
    return out


def identifiability(rows: list[dict], box: np.ndarray, share: float = 0.01) -> list[str]:
    """For each margin from the near-optimal region: identified, flat, or at a bound."""
    near = np.array([r["log10_lambda"] for r in flat_region(rows, share)])
    out = []
    for m, (lo, hi) in enumerate(box):
        a, b = near[:, m].min(), near[:, m].max()
        out.append("lower" if b <= lo + 0.02 * (hi - lo) else "upper" if a >= hi - 0.02 * (hi - lo) else "flat" if b - a > 0.5 * (hi - lo) else "identified")
    return out


def optimise(df: DataFrame, spec: TensorSpline, n_global: int = 24, starts: int = 3, box=(-4.0, 4.0), expand: bool = True, probes: int = 5, local: int = 40, seed: int = 1, key: list[str] | str | None = None) -> dict:
    """Conditional-GCV anchor and Sobol points, diverse local refinement, box expansion at the edge, and a second probe bank for the final choice."""
    d = len(spec.x)
    prepared = ready(df, spec, key)
    e = Evaluator(prepared, spec.rank, probes, seed=seed, df=df, key=key)
    anchor = np.log10(prepared.fit(lam="cGCV", control=replace(spec.control, compute_edf=False)).lam)
    bounds = np.array([box] * d, float)
    for _ in range(3 if expand else 1):
        pts = np.concatenate([anchor[None], bounds[:, 0] + sobol(n_global, d) * (bounds[:, 1] - bounds[:, 0])])
        values = np.array([e.gcv(v) for v in pts])
        best = pts[int(np.argmin(values))]
        edge = np.abs(best[:, None] - bounds) < 0.02 * (bounds[:, 1:] - bounds[:, :1])
        if not (expand and edge.any()):
            break
        bounds = bounds + np.where(edge, np.array([-1.0, 1.0]), 0)
    chosen = []
    for i in diverse_top(pts, values, starts, 0.5):
        v, f = nelder_mead(lambda v: e.gcv(np.clip(v, bounds[:, 0], bounds[:, 1])), pts[i], 0.4, local)
        chosen.append((f, np.clip(v, bounds[:, 0], bounds[:, 1])))
    second = Evaluator(prepared, spec.rank, probes, seed=seed + 1, df=df, key=key)
    final = [{"log10_lambda": v.tolist(), "gcv": f, "gcv_second": second.gcv(v), "score": 0.5 * (f + second.gcv(v))} for f, v in chosen]
    win = min(final, key=lambda r: r["score"])
    rows = list(e.cache.values())
    spread = max(np.linalg.norm(np.array(r["log10_lambda"]) - np.array(win["log10_lambda"])) for r in final)
    return {"lambda": [10**x for x in win["log10_lambda"]], "gcv": win["gcv"], "starts": final, "anchor": anchor.tolist(), "evaluations": rows, "box": bounds.tolist(), "identifiability": identifiability(rows, bounds), "inner_basin_stable": bool(spread < 1.0)}


# The full tensor, without a train: what its smoothing does is known exactly.


@dataclass
class Ray:
    """Everything along base + t * direction of a penalty, from one generalised eigenproblem.

    With A = Gram + base penalty and B = A + direction, A u = mu B u; at t the system is mu + t (1 - mu) in these coordinates, however singular
    the Gram matrix is, so long as it and the penalty together see every direction.
    """

    n: float
    zz: float
    mu: np.ndarray
    b: np.ndarray
    s: np.ndarray

    def edf(self, t: float) -> float:
        return float((np.diag(self.s) / (self.mu + t * (1 - self.mu))).sum())

    def rss(self, t: float) -> float:
        g = self.b / (self.mu + t * (1 - self.mu))
        return max(float(self.zz - 2 * self.b @ g + g @ self.s @ g), 0.0)

    def gcv(self, t: float) -> float:
        return global_gcv(self.n, self.rss(t), self.edf(t))


@dataclass
class FullTensor:
    """The Gram matrix of the whole tensor basis beside its penalties, for exact EDF and GCV at any smoothing. The intercept is the tensor's own."""

    n: float
    zz: float
    gram: np.ndarray
    rhs: np.ndarray
    penalties: list[np.ndarray]

    @classmethod
    def of(cls, df: DataFrame, spec: TensorSpline, most: int = 5_000) -> FullTensor:
        """One pass over df, or over its cells."""
        p = spec.prepare(df)
        sizes = [k.k for k in p.knots]
        if np.prod(sizes, dtype=float) > most:
            raise ValueError(f"the full tensor has more than {most} entries")
        if p.family != "gaussian" or spec.linear or spec.smooth:
            raise ValueError("exact GCV of the full tensor is for Gaussian surfaces without further terms")
        sums = p.backend.total(Request("tensor", states=[State([np.zeros((1, k, 1)) for k in sizes], np.zeros(1))]))
        if isinstance(p.backend, RowBackend):
            p.backend.close()
        pens = [difference_penalty(k.k, spec.penalty_order, k.cyclic) for k in p.knots]
        own = [tensor.dense_penalty(sizes, pens, np.arange(len(sizes)) == m) for m in range(len(sizes))]
        return cls(p.backend.n, float(sums["zz"]), sums["S"], sums["b"], own)

    def total(self, lam) -> np.ndarray:
        return sum(x * p for x, p in zip(np.asarray(lam, float), self.penalties, strict=True))

    def along(self, direction, base=None) -> Ray:
        """Any t of base + t * direction (of one lambda for each margin; base: none) costs a few vector operations."""
        a = self.gram if base is None else self.gram + self.total(base)
        both = a + self.total(direction)
        scale = np.sqrt(np.maximum(np.diag(both), 1e-300))
        both, a = both / np.outer(scale, scale), a / np.outer(scale, scale)
        for f in (0, 1e-9, 1e-6, 1e-3):  # what neither sees is held by a trace of ridge
            try:
                c = np.linalg.cholesky(both + f * ridge_scale(both) * np.eye(len(both)))
                break
            except np.linalg.LinAlgError:
                continue
        inv = np.linalg.inv(c)
        mu, q = np.linalg.eigh(inv @ a @ inv.T)
        u = (inv.T @ q) / scale[:, None]
        return Ray(self.n, self.zz, np.clip(mu, 0, 1), u.T @ self.rhs, u.T @ self.gram @ u)

    def at(self, lam) -> dict:
        ray = self.along(lam)
        return {"edf": ray.edf(1.0), "rss": ray.rss(1.0), "gcv": ray.gcv(1.0)}

    def minimise(self, box=(-4.0, 4.0), rounds: int = 20, tol: float = 1e-6) -> dict:
        """log10 lambda of least exact GCV: one margin after another, each by its own ray, until none moves."""
        d, value = len(self.penalties), np.inf
        x = np.zeros(d)
        for _ in range(rounds):
            before = value
            for k in range(d):
                ray = self.along(np.arange(d) == k, np.where(np.arange(d) == k, 0.0, 10**x))
                new = brent(lambda v, ray=ray: ray.gcv(10**v), *box)
                if ray.gcv(10**new) < value:
                    x[k], value = new, ray.gcv(10**new)
            if before - value <= tol * abs(value):
                break
        return {"log10_lambda": x.tolist(), **self.at(10**x)}
