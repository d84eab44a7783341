"""Small dense algebra and optimisers for the driver: systems of a few hundred unknowns, never rows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def ridge_scale(s: np.ndarray) -> float:
    return 1e-6 * max(float(np.mean(np.diag(s))) if s.size else 1.0, 1e-12)


def solve_spd(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cholesky, with a ridge that grows until it holds, then least squares."""
    scale = ridge_scale(a)
    for f in (0, 1, 10, 1e2, 1e3, 1e4, 1e5):
        try:
            c = np.linalg.cholesky(a + f * scale * np.eye(len(a)))
            x = np.linalg.solve(c.T, np.linalg.solve(c, b))
            if np.isfinite(x).all():
                return x
        except np.linalg.LinAlgError:
            pass
    return np.linalg.lstsq(a, b, rcond=None)[0]


def operator_norm(a: np.ndarray) -> float:
    """The spectral norm of the symmetric part; the Frobenius norm where its eigenvalues can't be had."""
    if not a.size:
        return 0.0
    a = (a + a.T) / 2
    try:
        return float(np.abs(np.linalg.eigvalsh(a)).max())
    except np.linalg.LinAlgError:
        return float(np.linalg.norm(a))


def brent(f: Callable[[float], float], a: float, b: float, tol: float = 1e-6, most: int = 100) -> float:
    """The minimum of f on [a, b] by golden sections and parabolas."""
    gold = 0.5 * (3 - math.sqrt(5))
    x = w = v = a + gold * (b - a)
    fx = fw = fv = f(x)
    d = e = 0.0
    for _ in range(most):
        m, t = 0.5 * (a + b), tol * abs(x) + 1e-10
        if abs(x - m) <= 2 * t - 0.5 * (b - a):
            break
        parabola = False
        if abs(e) > t:
            r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
            p = (x - v) * q - (x - w) * r
            q = 2 * (q - r)
            p, q = (-p, q) if q > 0 else (p, -q)
            if abs(p) < abs(0.5 * q * e) and q * (a - x) < p < q * (b - x):
                e, d, parabola = d, p / q, True
                u = x + d
                if u - a < 2 * t or b - u < 2 * t:
                    d = math.copysign(t, m - x)
        if not parabola:
            e = (b if x < m else a) - x
            d = gold * e
        u = x + (d if abs(d) >= t else math.copysign(t, d))
        fu = f(u)
        if fu <= fx:
            a, b = (x, b) if u >= x else (a, x)
            v, fv, w, fw, x, fx = w, fw, x, fx, u, fu
        else:
            a, b = (u, b) if u < x else (a, u)
            if fu <= fw or w == x:
                v, fv, w, fw = w, fw, u, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return x


def root(f: Callable[[float], float], a: float, b: float, tol: float = 1e-10, most: int = 200) -> float:
    """A sign change of a monotone f by bisection; the nearer end where there is none."""
    fa, fb = f(a), f(b)
    if fa * fb > 0:
        return a if abs(fa) < abs(fb) else b
    for _ in range(most):
        m = 0.5 * (a + b)
        fm = f(m)
        if fa * fm <= 0:
            b = m
        else:
            a, fa = m, fm
        if b - a < tol:
            break
    return 0.5 * (a + b)


def lbfgs(fg: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, most: int = 500, memory: int = 10, pgtol: float = 1e-8, ftol: float = 1e7 * 2.2e-16) -> tuple[np.ndarray, float, int, bool]:
    """Limited-memory BFGS with backtracking on the Armijo rule; (x, f, iterations, converged)."""
    f, g = fg(x)
    ss: list[np.ndarray] = []
    ys: list[np.ndarray] = []
    for it in range(1, most + 1):
        if np.abs(g).max(initial=0) < pgtol:
            return x, f, it - 1, True
        q, alphas = g.copy(), []
        for s, y in zip(reversed(ss), reversed(ys), strict=True):
            alphas.append(s @ q / (y @ s))
            q -= alphas[-1] * y
        q *= (ss[-1] @ ys[-1]) / (ys[-1] @ ys[-1]) if ss else 1 / max(1.0, np.abs(g).sum())
        for s, y, a in zip(ss, ys, reversed(alphas), strict=True):
            q += s * (a - y @ q / (y @ s))
        step, slope = 1.0, -(g @ q)
        if slope >= 0:
            q, slope = g.copy(), -(g @ g)
        while True:
            new = x - step * q
            fn, gn = fg(new)
            if np.isfinite(fn) and fn <= f + 1e-4 * step * slope:
                break
            step *= 0.5
            if step < 1e-14:
                return x, f, it, False
        s, y = new - x, gn - g
        done = f - fn <= ftol * max(abs(f), abs(fn), 1)
        if s @ y > 1e-12 * (y @ y):
            ss, ys = (ss + [s])[-memory:], (ys + [y])[-memory:]
        x, f, g = new, fn, gn
        if done:
            return x, f, it, True
    return x, f, most, False


def nelder_mead(f: Callable[[np.ndarray], float], x0: np.ndarray, step: float = 0.5, most: int = 200, tol: float = 1e-6) -> tuple[np.ndarray, float]:
    n = len(x0)
    pts = [np.array(x0, float)] + [np.array(x0, float) + step * np.eye(n)[i] for i in range(n)]
    vals = [f(p) for p in pts]
    for _ in range(most):
        o = np.argsort(vals)
        pts, vals = [pts[i] for i in o], [vals[i] for i in o]
        if abs(vals[-1] - vals[0]) <= tol * (abs(vals[0]) + tol):
            break
        c = np.mean(pts[:-1], axis=0)
        r = c + (c - pts[-1])
        fr = f(r)
        if fr < vals[0]:
            e = c + 2 * (c - pts[-1])
            fe = f(e)
            pts[-1], vals[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < vals[-2]:
            pts[-1], vals[-1] = r, fr
        else:
            k = c + 0.5 * (pts[-1] - c)
            fk = f(k)
            if fk < vals[-1]:
                pts[-1], vals[-1] = k, fk
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                vals = [vals[0]] + [f(p) for p in pts[1:]]
    i = int(np.argmin(vals))
    return pts[i], vals[i]


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h / a


def f_tail(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if f > 0 else 1.0


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / (df + t * t), df / 2, 0.5)


def sobol(n: int, d: int) -> np.ndarray:
    """n points of a base-2 digital sequence in up to 8 dimensions (Gray-code order, the first point left out)."""
    #: Degree, coefficients and initial numbers of each dimension after the first.
    table = ((1, 0, (1,)), (2, 1, (1, 3)), (3, 1, (1, 3, 1)), (3, 2, (1, 1, 1)), (4, 1, (1, 1, 3, 3)), (4, 4, (1, 3, 5, 13)), (5, 2, (1, 1, 5, 5, 17)))
    if not 1 <= d <= 8:
        raise ValueError("1 to 8 dimensions")
    bits, out = 31, np.zeros((n, d))
    dirs = [[1 << (bits - i - 1) for i in range(bits)]]
    for s, a, m in table[: d - 1]:
        v = [m[i] << (bits - i - 1) for i in range(s)]
        for i in range(s, bits):
            x = v[i - s] ^ (v[i - s] >> s)
            for k in range(1, s):
                if a >> (s - 1 - k) & 1:
                    x ^= v[i - k]
            v.append(x)
        dirs.append(v)
    state = [0] * d
    for i in range(n):
        low = (~i & (i + 1)).bit_length() - 1
        for j in range(d):
            state[j] ^= dirs[j][low]
            out[i, j] = state[j] / (1 << bits)
    return out
