"""Gaussian, Poisson and Bernoulli families: Column expressions for tables, numpy for driver-side cells and Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

FAMILIES = ("gaussian", "poisson", "bernoulli")
#: Fixed values.
ETA_MAX, MU_MIN, MU_EPS, WEIGHT_FLOOR, LIK_EPS, START = 20.0, 1e-8, 1e-5, 1e-4, 1e-12, (0.05, 0.95)


def family(name: str) -> str:
    key = {"binomial": "bernoulli"}.get(str(name).lower(), str(name).lower())
    if key not in FAMILIES:
        raise ValueError(f"unknown family {name!r}")
    return key


# Column expressions.


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def inverse_link(fam: str, eta: Column) -> Column:
    return {"gaussian": lambda: eta, "poisson": lambda: F.exp(clip(eta, -ETA_MAX, ETA_MAX)), "bernoulli": lambda: 1.0 / (1.0 + F.exp(-eta))}[family(fam)]()


def working(fam: str, y: Column, eta: Column, w: Column = None) -> tuple[Column, Column]:
    """Working weight and response."""
    fam, w = family(fam), F.lit(1.0) if w is None else w
    if fam == "gaussian":
        return w, y
    if fam == "poisson":
        mu = F.greatest(inverse_link(fam, eta), F.lit(MU_MIN))
        return w * mu, clip(eta, -ETA_MAX, ETA_MAX) + (y - mu) / mu
    mu = clip(inverse_link(fam, eta), MU_EPS, 1 - MU_EPS)
    v = F.greatest(mu * (1 - mu), F.lit(WEIGHT_FLOOR))
    return w * v, eta + (y - mu) / v


def unit_deviance(fam: str, y: Column, mu: Column) -> Column:
    fam = family(fam)
    if fam == "gaussian":
        return (y - mu) * (y - mu)
    if fam == "poisson":
        m = F.greatest(mu, F.lit(LIK_EPS))
        return 2.0 * (F.when(y > 0, y * F.ln(F.when(y > 0, y) / m)).otherwise(0.0) - (y - m))
    m = clip(mu, LIK_EPS, 1 - LIK_EPS)
    return -2.0 * (y * F.ln(m) + (1 - y) * F.ln(1 - m))


def variance(fam: str, mu: Column) -> Column:
    return {"gaussian": lambda: F.lit(1.0), "poisson": lambda: F.greatest(mu, F.lit(MU_MIN)), "bernoulli": lambda: F.greatest(mu * (1 - mu), F.lit(WEIGHT_FLOOR))}[family(fam)]()


def residual(fam: str, y: Column, mu: Column, kind: str = "deviance", w: Column = None) -> Column:
    w = F.lit(1.0) if w is None else w
    if kind == "response":
        return y - mu
    if kind == "pearson":
        return F.sqrt(w) * (y - mu) / F.sqrt(variance(fam, mu))
    if kind == "deviance":
        return F.signum(y - mu) * F.sqrt(F.greatest(w * unit_deviance(fam, y, mu), F.lit(0.0)))
    raise ValueError(f"unknown residual {kind!r}")


def start_intercept(fam: str, sum_w: float, sum_wy: float, sum_we: float | None = None) -> float:
    """From sums of w, w y and (Poisson) w exp(offset)."""
    fam, mean = family(fam), sum_wy / sum_w
    if fam == "gaussian":
        return mean
    if fam == "poisson":
        return float(np.log(max(sum_wy / (sum_we if sum_we else sum_w), MU_MIN)))
    p = min(max(mean, START[0]), START[1])
    return float(np.log(p / (1 - p)))


# The same on numpy arrays.


def np_inverse(fam: str, eta: np.ndarray) -> np.ndarray:
    if fam == "gaussian":
        return eta
    if fam == "poisson":
        return np.exp(np.clip(eta, -ETA_MAX, ETA_MAX))
    return 1 / (1 + np.exp(-np.clip(eta, -700, 700)))


def np_working(fam: str, y: np.ndarray, eta: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if fam == "gaussian":
        return w, y
    if fam == "poisson":
        mu = np.maximum(np_inverse(fam, eta), MU_MIN)
        return w * mu, np.clip(eta, -ETA_MAX, ETA_MAX) + (y - mu) / mu
    mu = np.clip(np_inverse(fam, eta), MU_EPS, 1 - MU_EPS)
    v = np.maximum(mu * (1 - mu), WEIGHT_FLOOR)
    return w * v, eta + (y - mu) / v


def np_nll(fam: str, y: np.ndarray, eta: np.ndarray, w: np.ndarray) -> float:
    if fam == "gaussian":
        return float(0.5 * (w * (y - eta) ** 2).sum())
    if fam == "poisson":
        e = np.clip(eta, -ETA_MAX, ETA_MAX)
        return float((w * (np.exp(e) - y * e)).sum())
    mu = np.clip(np_inverse(fam, eta), LIK_EPS, 1 - LIK_EPS)
    return float(-(w * (y * np.log(mu) + (1 - y) * np.log(1 - mu))).sum())


def np_score(fam: str, y: np.ndarray, eta: np.ndarray, w: np.ndarray) -> np.ndarray:
    """d nll / d eta for each row."""
    return w * (np_inverse(fam, eta) - y)


def np_curvature(fam: str, eta: np.ndarray, w: np.ndarray) -> np.ndarray:
    mu = np_inverse(fam, eta)
    return w * (1.0 if fam == "gaussian" else mu if fam == "poisson" else mu * (1 - mu))
