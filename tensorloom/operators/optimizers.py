"""Fitting methods over a backend: alternating least squares, PIRLS, direct and conditional optimisers, conditional GCV."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from ..functions.families import start_intercept
from ..plans import tensor
from ..plans.backends import Request, State
from ..plans.linalg import brent, lbfgs, ridge_scale, root, solve_spd
from .control import Control, anisotropy_step, damped_step, scale_anisotropy


@dataclass
class Smooth:
    """A block of additive coefficients: positions in beta, penalty, and how its smoothing is chosen."""

    name: str
    at: slice
    penalty: np.ndarray
    lam: float = 1.0
    method: str = "cGCV"
    target_edf: float | None = None
    edf: float = float("nan")


@dataclass
class Problem:
    """Everything a fit needs besides its parameters."""

    backend: object
    family: str
    sizes: list[int]
    penalties: list[np.ndarray]
    lam: np.ndarray
    control: Control
    n_beta: int
    smooths: list[Smooth] = field(default_factory=list)
    history: list[dict] = field(default_factory=list)
    monitor: object = None

    def saw(self, stage: str, s: State, sweep: int, **more) -> None:
        """Tells the monitor, if there is one, where a fit stands: enough to go on from."""
        if self.monitor is not None:
            self.monitor.record(self, stage, s, sweep, more)

    def going_on(self, stage: str, s: State) -> tuple[State, int, dict]:
        """Where an interrupted fit stood in this stage, or (s, 0, {})."""
        return self.monitor.take(self, stage, s) if self.monitor is not None else (s, 0, {})

    def ask(self, kind: str, *states: State, anchor: State | None = None, k: int = 0) -> dict:
        return self.backend.total(Request(kind, self.family, list(states), anchor, k))

    def penalty(self, s: State) -> float:
        j = tensor.penalty_value(s.cores, self.penalties, self.lam)
        return j + sum(0.5 * t.lam * s.beta[t.at] @ t.penalty @ s.beta[t.at] for t in self.smooths)

    def objective(self, *states: State) -> list[float]:
        """Penalised, all states in one pass."""
        out = self.ask("loss", *states)
        return [float(out[f"nll{i}"]) + self.penalty(s) for i, s in enumerate(states)]

    def core_penalty(self, cores, k: int) -> tuple[np.ndarray, np.ndarray]:
        return tensor.core_penalty(cores, self.penalties, self.lam, k, self.control.penalty)

    def order(self) -> list[int]:
        o = list(range(len(self.sizes)))
        return o[::-1] if self.control.margin_order == "rtl" else o


def start(p: Problem, rank, seed: int | None = None, scale: float = 1.0) -> State:
    """Random cores and the family's first intercept."""
    c = p.control
    cores = tensor.init_cores(p.sizes, rank, c.seed if seed is None else seed, c.init_sd)
    size = p.backend.total(Request("size"))
    beta = np.zeros(p.n_beta)
    beta[0] = start_intercept(p.family, float(size["w"]), float(size["wy"]), float(size["we"]))
    return State([g * scale for g in cores], beta)


# Alternating least squares.


def update_additive(p: Problem, s: State, sums: dict, surface: np.ndarray) -> None:
    """Refreshes beta in place: (intercept, linear), the smooths, and the first again. surface: Z'W times the tensor part."""
    m, rhs = sums["M"], sums["m"] - surface
    free = [i for i in range(p.n_beta) if not any(t.at.start <= i < t.at.stop for t in p.smooths)]

    def linear() -> None:
        left = m[np.ix_(free, free)]
        s.beta[free] = np.linalg.lstsq(left, rhs[free] - m[free] @ s.beta + left @ s.beta[free], rcond=None)[0]

    linear()
    for t in p.smooths:
        own, at = m[t.at, t.at], t.at
        b = rhs[at] - m[at] @ s.beta + own @ s.beta[at]
        eps = ridge_scale(own) * np.eye(len(own))
        edf = lambda log, own=own, t=t, eps=eps: float(np.trace(np.linalg.solve(own + np.exp(log) * t.penalty + eps, own)))
        lo, hi = np.log(p.control.lambda_bounds[0]), np.log(p.control.lambda_bounds[1])
        if t.target_edf is not None:
            t.lam = float(np.exp(root(lambda x, edf=edf, t=t: edf(x) - t.target_edf, lo - 9, hi + 9)))
        elif t.method == "cGCV":
            zz = float(sums["zz"]) - 2 * float(sums["m"] @ s.beta) + float(s.beta @ m @ s.beta)  # up to the surface, which is constant here
            base = b

            def gcv(log: float, own=own, t=t, base=base, zz=zz, eps=eps, edf=edf, at=at) -> float:
                g = np.linalg.solve(own + np.exp(log) * t.penalty + eps, base)
                old = s.beta[at]
                rss = zz + 2 * base @ old - old @ own @ old - 2 * base @ g + g @ own @ g
                return p.backend.n * max(rss, 0) / max(p.backend.n - edf(log), 1e-6) ** 2

            t.lam = float(np.exp(brent(gcv, lo, hi)))
        s.beta[at] = solve_spd(own + t.lam * t.penalty + eps, b)
        t.edf = edf(np.log(t.lam))
    if p.smooths:
        linear()


def core_update(p: Problem, s: State, k: int, anchor: State | None = None, additive: bool = True) -> dict:
    """One exact conditional solve of core k, in place; returns its sums."""
    sums = p.ask("core", s, anchor=anchor, k=k)
    own, other = p.core_penalty(s.cores, k)
    g = solve_spd(sums["S"] + p.lam[k] * own + other, sums["b"] - sums["C"] @ s.beta)
    s.cores[k] = tensor.unpack(g, s.cores[k].shape)
    if additive and p.control.refit_intercept:
        update_additive(p, s, sums, sums["C"].T @ g)
    return sums


def als(p: Problem, s: State, sweeps: int | None = None, anchor: State | None = None) -> tuple[State, bool]:
    """Sweeps of core solves until the penalised objective stands still; working responses from the anchor, if any."""
    s, old = s.copy(), None
    start_at, more = 0, {}
    if anchor is None:
        s, start_at, more = p.going_on("als", s)
        old = more.get("old")
    for sweep in range(start_at + 1, (sweeps or p.control.max_sweeps) + 1):
        for k in p.order():
            sums = core_update(p, s, k, anchor, additive=k == p.order()[-1])
        g = tensor.pack(s.cores[k])
        rss = float(sums["zz"] - 2 * (sums["b"] @ g + sums["m"] @ s.beta) + g @ sums["S"] @ g + s.beta @ sums["M"] @ s.beta + 2 * g @ sums["C"] @ s.beta)
        value = 0.5 * max(rss, 0) + p.penalty(s)
        if anchor is None:
            p.history.append({"stage": "als", "sweep": sweep, "rss": rss, "objective": value})
            p.saw("als", s, sweep, old=value, objective=value)
        if old is not None and sweep > 2 and abs(old - value) <= p.control.tol * (abs(old) + p.control.tol):
            return s, True
        old = value
    return s, False


def pirls(p: Problem, s: State) -> tuple[State, bool]:
    """Working responses at the current fit, a few ALS sweeps on them, step halving on the true objective."""
    c = p.control
    s, start_at, more = p.going_on("pirls", s)
    value, sweeps = (more["old"], more["sweeps"]) if more else (p.objective(s)[0], c.als_sweeps_per_pirls)
    for it in range(start_at + 1, c.pirls_maxit + 1):
        new, _ = als(p, s, sweeps, anchor=s)
        steps = [1.0]
        while steps[-1] * c.step_factor >= c.step_min:
            steps.append(steps[-1] * c.step_factor)
        # All candidates of the halving in one pass over the data.
        tries = [blend(s, new, a) for a in steps]
        values = p.objective(*tries)
        best = next((i for i, v in enumerate(values) if v <= value + c.objective_tol * abs(value)), None)
        if best is None:
            return s, False
        change = abs(value - values[best]) / (abs(value) + c.tol)
        s, value = tries[best], values[best]
        p.history.append({"stage": "pirls", "sweep": it, "objective": value, "step": steps[best]})
        if it > 2 and change < c.tol and steps[best] == 1:
            return s, True
        sweeps = min(c.als_sweeps_per_pirls_max, sweeps + (change < 1e-2))
        p.saw("pirls", s, it, old=value, sweeps=sweeps, objective=value)
    return s, False


def blend(a: State, b: State, t: float) -> State:
    return State([(1 - t) * x + t * y for x, y in zip(a.cores, b.cores, strict=True)], (1 - t) * a.beta + t * b.beta)


def joint_sweeps(p: Problem, s: State, sweeps: int | None = None) -> tuple[State, bool]:
    """All cores and additive terms in one block solve for each pass over the data.

    A pass gives, at a trial state, the normal equations of everything at once and the true penalised objective. The trial is taken if the
    objective has fallen, and the next is solved for from those sums; else the last state's equations are solved anew with more damping
    (Levenberg-Marquardt), which asks nothing of the data. So a sweep is one question, a refused one included. Before each look all
    cores but the last are made orthonormal, as damping is not indifferent to how the cores share the tensor's size; it then weighs least on the last, which enters linearly.
    """
    c, s = p.control, State(tensor.left_orthogonal(s.cores), s.beta.copy())  # which also takes ranks beyond what bonds can hold off
    n, shapes = sum(g.size for g in s.cores), [g.shape for g in s.cores]
    free = np.r_[np.ones(n, bool), np.full(p.n_beta, c.refit_intercept)]

    def look(state: State) -> tuple[float, np.ndarray, np.ndarray]:
        out = p.ask("sweep", state)
        h, g = np.array(out["S"], float), np.array(out["g"], float)
        h[:n, :n] += tensor.joint_penalty(state.cores, p.penalties, p.lam)
        g[:n] += tensor.penalty_gradient(state.cores, p.penalties, p.lam)
        for t in p.smooths:
            at = slice(n + t.at.start, n + t.at.stop)
            h[at, at] += t.lam * t.penalty
            g[at] += t.lam * t.penalty @ state.beta[t.at]
        return float(out["nll"]) + p.penalty(state), h, g

    s, start_at, more = p.going_on("joint", s)
    damping, grow = more.get("damping", 0.1), more.get("grow", 2.0)
    value, h, g = look(s)
    for sweep in range(start_at + 1, (sweeps or 4 * c.max_sweeps) + 1):
        own, left = h[np.ix_(free, free)], g[free]
        move = solve_spd(own + damping * max(float(np.diag(own).mean()), 1e-300) * np.eye(len(own)), left)
        fall = float(left @ move - 0.5 * move @ own @ move)  # as the sums foretell
        if fall <= 0.1 * c.tol * (abs(value) + c.tol) and damping <= 1:
            return s, True
        v = np.concatenate([tensor.pack_all(s.cores), s.beta])
        v[free] -= move
        trial = State(tensor.left_orthogonal(tensor.unpack_all(v[:n], shapes)), v[n:])
        new, h_new, g_new = look(trial)
        gain = (value - new) / fall if fall > 0 and np.isfinite(new) else -1.0
        p.history.append({"stage": "joint", "sweep": sweep, "objective": min(new, value) if np.isfinite(new) else value, "taken": gain > 0})
        if gain > 0:
            s, value, h, g = trial, new, h_new, g_new
            damping, grow = damping * max(1 / 5, 1 - (2 * gain - 1) ** 3), 2.0
        else:
            damping, grow = max(damping, 1e-8) * grow, 2 * grow
            if damping > 1e12:
                return s, bool(np.abs(g[free]).max() <= np.sqrt(c.tol) * (1 + abs(value)))
        p.saw("joint", s, sweep, damping=float(damping), grow=float(grow), objective=value)
    return s, False


def _one_scan(p: Problem) -> bool:
    """Whether a question costs a pass over rows, the global penalty holds and no smooth term's own smoothing waits for its turn in a sweep."""
    return getattr(p.backend, "by_rows", False) and p.control.penalty == "global" and all(t.target_edf is None and t.method != "cGCV" for t in p.smooths)


# Direct and conditional optimisers.


def _gradient(p: Problem, shapes, beta_free: bool) -> Callable:
    def fg(v: np.ndarray):
        m = sum(int(np.prod(x)) for x in shapes)
        s = State(tensor.unpack_all(v[:m], shapes), v[m:])
        out = p.ask("gradient", s)
        g = np.asarray(out["g"], float).copy()
        g[:m] += tensor.penalty_gradient(s.cores, p.penalties, p.lam)
        for t in p.smooths:
            g[m + t.at.start : m + t.at.stop] += t.lam * t.penalty @ s.beta[t.at]
        if not beta_free:
            g[m:] = 0
        return float(out["nll"]) + p.penalty(s), g

    return fg


def global_lbfgs(p: Problem, s: State, most: int | None = None) -> tuple[State, bool]:
    shapes = [c.shape for c in s.cores]
    m = sum(c.size for c in s.cores)
    v, f, it, ok = lbfgs(_gradient(p, shapes, p.control.refit_intercept), np.concatenate([tensor.pack_all(s.cores), s.beta]), most or p.control.lbfgs_maxit)
    p.history.append({"stage": "lbfgs", "sweep": it, "objective": f})
    return State(tensor.unpack_all(v[:m], shapes), v[m:]), ok


def gradient_descent(p: Problem, s: State) -> tuple[State, bool]:
    """Armijo steps along the gradient."""
    c, shapes = p.control, [g.shape for g in s.cores]
    m = sum(g.size for g in s.cores)
    fg, v, step, ok = _gradient(p, shapes, p.control.refit_intercept), np.concatenate([tensor.pack_all(s.cores), s.beta]), 1e-2, False
    f, g = fg(v)
    for it in range(c.gd_maxit):
        slope = g @ g
        step = min(step * 4, 1.0)
        while True:
            new = v - step * g
            fn, gn = fg(new)
            if np.isfinite(fn) and fn <= f - c.gd_armijo_c * step * slope:
                break
            step *= c.gd_step_factor
            if step < c.gd_step_min:
                break
        if step < c.gd_step_min:
            break
        ok, v, f, g = abs(f - fn) <= c.gd_tol * (abs(f) + c.gd_tol), new, fn, gn
        if ok:
            break
    p.history.append({"stage": "gd", "sweep": it + 1, "objective": f})
    return State(tensor.unpack_all(v[:m], shapes), v[m:]), ok


def damped_newton_als(p: Problem, s: State) -> tuple[State, bool]:
    """Newton steps core by core with the unfloored curvature and Armijo damping."""
    c, s, old = p.control, s.copy(), None
    for sweep in range(1, c.dn_max_sweeps + 1):
        for k in p.order():
            sums = p.ask("newton", s, k=k)
            own, other = tensor.core_penalty(s.cores, p.penalties, p.lam, k)
            g, pen = tensor.pack(s.cores[k]), p.lam[k] * own + other
            grad = sums["g"] + pen @ g
            move = solve_spd(sums["S"] + pen + (c.dn_ridge + ridge_scale(sums["S"])) * np.eye(len(g)), grad)
            here, step = float(sums["nll"]) + p.penalty(s), 1.0
            while step >= c.dn_step_min:
                t = s.copy()
                t.cores[k] = tensor.unpack(g - step * move, s.cores[k].shape)
                value = p.objective(t)[0]
                if value <= here - c.dn_armijo_c * step * float(grad @ move):
                    s = t
                    break
                step *= c.dn_step_factor
            else:
                value = here
        if p.control.refit_intercept:
            sums = p.ask("core", s, anchor=s, k=k)
            t = s.copy()
            update_additive(p, t, sums, sums["C"].T @ tensor.pack(s.cores[k]))
            new = p.objective(t)[0]
            if new < value:
                s, value = t, new
        p.history.append({"stage": "dn-als", "sweep": sweep, "objective": value})
        if old is not None and abs(old - value) <= c.tol * (abs(old) + c.tol):
            return s, True
        old = value
    return s, False


def lbfgs_als(p: Problem, s: State) -> tuple[State, bool]:
    """L-BFGS on one core after another."""
    c, s, old = p.control, s.copy(), None
    for sweep in range(1, c.block_lbfgs_sweeps + 1):
        for k in p.order():
            own, other = tensor.core_penalty(s.cores, p.penalties, p.lam, k)
            pen, shape, base = p.lam[k] * own + other, s.cores[k].shape, p.penalty(s)
            g0 = tensor.pack(s.cores[k])
            base -= 0.5 * g0 @ pen @ g0

            def fg(v: np.ndarray, k=k, pen=pen, shape=shape, base=base):
                t = s.copy()
                t.cores[k] = tensor.unpack(v, shape)
                out = p.ask("newton", t, k=k)
                return float(out["nll"]) + 0.5 * v @ pen @ v + base, out["g"] + pen @ v

            v, value, *_ = lbfgs(fg, g0, c.block_lbfgs_maxit)
            s.cores[k] = tensor.unpack(v, shape)
        p.history.append({"stage": "lbfgs-als", "sweep": sweep, "objective": value})
        if old is not None and abs(old - value) <= c.tol * (abs(old) + c.tol):
            return s, True
        old = value
    return s, False


OPTIMIZERS = ("als", "pirls-als", "joint", "lbfgs", "gd", "dn-als", "lbfgs-als", "hybrid", "adam")


def resolve_optimizer(name: str, family: str, additive: bool) -> str:
    """auto: ALS for Gaussian, PIRLS-ALS for Poisson and wherever there are linear or smooth terms, else L-BFGS."""
    name = name.lower().replace("_", "-").replace("pirls", "pirls-als") if name.lower() == "pirls" else name.lower().replace("_", "-")
    if name == "auto":
        name = "als" if family == "gaussian" else "pirls-als" if family == "poisson" or additive else "lbfgs"
    if name not in OPTIMIZERS:
        raise ValueError(f"unknown optimizer {name!r}")
    if name == "adam":
        raise NotImplementedError("Adam is not offered")
    if family == "gaussian" and name in ("pirls-als", "dn-als", "lbfgs-als"):
        return "als"
    return "pirls-als" if name == "als" and family != "gaussian" else name


def fit_fixed(p: Problem, s: State, optimizer: str) -> tuple[State, bool]:
    """Over rows, alternating sweeps are taken jointly: one scan each in place of one for each core."""
    run = {"als": als, "pirls-als": pirls, "joint": joint_sweeps, "lbfgs": global_lbfgs, "gd": gradient_descent, "dn-als": damped_newton_als, "lbfgs-als": lbfgs_als}
    if optimizer == "joint" and p.control.penalty != "global":
        raise ValueError("joint sweeps take the global penalty")
    if optimizer in ("als", "pirls-als") and _one_scan(p):
        return joint_sweeps(p, s)
    if optimizer == "hybrid":
        first, _ = (als if p.family == "gaussian" else pirls)(p, s)
        return global_lbfgs(p, first, p.control.hybrid_lbfgs_maxit)
    return run[optimizer](p, s)


# Conditional GCV.


@dataclass
class Spectral:
    """One factorisation of a core's system; then every lambda costs a few vector operations."""

    n: float
    zz: float
    values: np.ndarray
    b: np.ndarray
    s: np.ndarray
    u: np.ndarray

    @classmethod
    def of(cls, n: float, zz: float, s: np.ndarray, b: np.ndarray, own: np.ndarray, other: np.ndarray) -> Spectral:
        base, scale = s + other, ridge_scale(s)
        for f in (1, 10, 1e2, 1e3, 1e4, 1e6):
            try:
                c = np.linalg.cholesky(base + f * scale * np.eye(len(s)))
                break
            except np.linalg.LinAlgError:
                continue
        inv = np.linalg.inv(c)
        e, q = np.linalg.eigh(inv @ own @ inv.T)
        u = inv.T @ q
        return cls(n, zz, np.maximum(e, 0), u.T @ b, u.T @ s @ u, u)

    def edf(self, lam: float) -> float:
        return float((np.diag(self.s) / (1 + lam * self.values)).sum())

    def gcv(self, lam: float) -> float:
        g = self.b / (1 + lam * self.values)
        rss = max(self.zz - 2 * self.b @ g + g @ self.s @ g, 0.0)
        return self.n * rss / max(self.n - self.edf(lam), 1e-6) ** 2


def spectral(p: Problem, s: State, k: int, sums: dict | None = None) -> Spectral:
    """The conditional system of core k with everything else frozen. sums: those of all cores, if they are at hand."""
    if sums is None:
        sums, at = p.ask("core", s, anchor=s if p.family != "gaussian" else None, k=k), slice(None)
    else:
        at = slice(sum(c.size for c in s.cores[:k]), sum(c.size for c in s.cores[: k + 1]))
    zz = float(sums["zz"] - 2 * sums["m"] @ s.beta + s.beta @ sums["M"] @ s.beta)
    own, other = p.core_penalty(s.cores, k)
    return Spectral.of(p.backend.n, zz, sums["S"][at, at], sums["b"][at] - sums["C"][at] @ s.beta, own, other)


def all_cores(p: Problem, s: State) -> dict:
    """The sums of every core's conditional system, from one question."""
    return p.ask("blocks", s, anchor=s if p.family != "gaussian" else None)


def propose(p: Problem, s: State) -> np.ndarray:
    lo, hi = np.log(p.control.lambda_bounds)
    out, sums = p.lam.copy(), all_cores(p, s)
    for k in p.control.cgcv_margin_order or range(len(out)):
        cache = spectral(p, s, k, sums)
        out[k] = np.exp(brent(lambda x, cache=cache: cache.gcv(np.exp(x)), lo, hi))
    return out


def frozen_curves(p: Problem, s: State, points: int = 61) -> list[dict]:
    """GCV of each margin over a log grid with all else frozen."""
    out, sums = [], all_cores(p, s)
    for k in range(len(p.sizes)):
        cache = spectral(p, s, k, sums)
        for x in np.linspace(*np.log10(p.control.lambda_bounds), points):
            out.append({"margin": k + 1, "lambda": float(10**x), "log10_lambda": float(x), "gcv": cache.gcv(10**x), "edf": cache.edf(10**x)})
    return out


def fit_cgcv(p: Problem, s: State, optimizer: str) -> tuple[State, bool, list[dict]]:
    """Fit at fixed lambda, propose by conditional GCV, damp and trust, repeat; a last fit at the end."""
    c, trace, done = p.control, [], False
    sequential = c.cgcv_update == "sequential"
    s, start_at, more = p.going_on("outer", s)
    trace = more.get("trace", trace)
    for outer in range(start_at + 1, c.outer_maxit + 1):
        s, _ = fit_fixed(p, s, optimizer)
        old = p.lam.copy()
        if sequential:
            lo, hi = np.log(c.lambda_bounds)
            for k in p.order():
                cache = spectral(p, s, k)
                p.lam[k] = np.exp(brent(lambda x, cache=cache: cache.gcv(np.exp(x)), lo, hi))
                core_update(p, s, k, anchor=s if p.family != "gaussian" else None, additive=False)
            proposal = p.lam.copy()
        else:
            proposal = propose(p, s)
            step = anisotropy_step if c.cgcv_parameterization == "scale_anisotropy" else damped_step
            p.lam = step(old, proposal, c.cgcv_damping, c.cgcv_max_log10_step, c.lambda_bounds)
        change = float(np.abs(np.log(p.lam / old)).max())
        trace += [{"outer": outer, "margin": k + 1, "old": float(old[k]), "proposal": float(proposal[k]), "new": float(p.lam[k]), "change": change} for k in range(len(old))]
        if outer > 1 and change < c.tol_lambda:
            done = True
            break
        p.saw("outer", s, outer, trace=trace)
    s, ok = fit_fixed(p, s, optimizer)
    if c.cgcv_parameterization == "scale_anisotropy" and c.cgcv_lambda0_method == "log_grid":
        omega, tries = scale_anisotropy(p.lam)[1], []  # the scale of least deviance, the anisotropy as it settled
        for x in c.cgcv_lambda0_grid or np.geomspace(*c.lambda_bounds, 11):
            p.lam = float(x) * omega
            t, _ = fit_fixed(p, s, optimizer)
            tries.append((float(p.ask("loss", t)["dev0"]), float(x)))
        p.lam = min(tries)[1] * omega
        s, ok = fit_fixed(p, s, optimizer)
    return s, ok and done, trace
