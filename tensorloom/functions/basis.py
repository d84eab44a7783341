"""Open and cyclic B-spline bases, evaluated in the JVM (staged projections) or on Arrow batches, and difference penalties."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT_SLACK = 1e-9


@dataclass(frozen=True)
class Knots:
    """Knots of one margin. Open: clamped, k - degree - 1 equally spaced inner knots. Cyclic: uniform, wrapped at the period."""

    lo: float
    hi: float
    k: int
    degree: int = 3
    cyclic: bool = False

    def __post_init__(self):
        if not self.hi > self.lo:
            raise ValueError("the domain has no width")
        if self.k <= self.degree:
            raise ValueError("k must exceed the degree")

    @property
    def sequence(self) -> np.ndarray:
        d, n = self.degree, self.k - self.degree
        if self.cyclic:
            step = (self.hi - self.lo) / self.k
            return self.lo + step * np.arange(-d, self.k + d + 1)
        inner = np.linspace(self.lo, self.hi, n + 1)[1:-1]
        return np.concatenate([np.repeat(self.lo, d + 1), inner, np.repeat(self.hi, d + 1)])

    def evaluate(self, x: np.ndarray) -> np.ndarray:
        """(n, k) values; zero outside an open span, an error outside a period."""
        x = np.asarray(x, float)
        if self.cyclic:
            if ((x < self.lo - 1e-10) | (x > self.hi + 1e-10)).any():
                raise ValueError("values outside the period")
            x = np.clip(x, self.lo, self.hi)
        t, d = self.sequence, self.degree
        n = len(t) - 1
        last = int(np.flatnonzero(np.diff(t) > 0)[-1]) if not self.cyclic else n
        right = x[:, None] <= t[None, 1:]
        right[:, :last] = x[:, None] < t[None, 1 : last + 1]
        b = ((x[:, None] >= t[None, :-1]) & right & (t[1:] > t[:-1])[None]).astype(float)
        for q in range(1, d + 1):
            left, span = t[q : n + 1] - t[: n + 1 - q], None
            left = np.where(left > 0, left, 1)
            m = n - q
            up = (x[:, None] - t[None, :m]) / left[None, :m] * b[:, :m] * (t[q : q + m] > t[:m])
            span = np.where(t[q + 1 : q + 1 + m] > t[1 : 1 + m], t[q + 1 : q + 1 + m] - t[1 : 1 + m], 1)
            down = (t[None, q + 1 : q + 1 + m] - x[:, None]) / span[None] * b[:, 1 : m + 1] * (t[q + 1 : q + 1 + m] > t[1 : 1 + m])
            b = up + down
        if self.cyclic:
            b[:, :d] += b[:, self.k : self.k + d]
            b = b[:, : self.k]
        return b

    def columns(self, df: DataFrame, x: Column, prefix: str) -> DataFrame:
        """df with columns prefix1..prefixk, one projection for each degree, so that code stays small and in whole-stage codegen."""
        t, d, kept = self.sequence.tolist(), self.degree, df.columns
        n = len(t) - 1
        last = max(i for i in range(n) if t[i + 1] > t[i]) if not self.cyclic else n
        raw = x.cast("double")
        if self.cyclic:
            raw = F.when((raw >= self.lo - 1e-10) & (raw <= self.hi + 1e-10), F.greatest(F.least(raw, F.lit(self.hi)), F.lit(self.lo))).when(raw.isNull(), None).otherwise(F.raise_error("values outside the period").cast("double"))
        v = F.col(f"{prefix}_x")

        def level0(i: int) -> Column:
            if t[i + 1] <= t[i]:
                return F.lit(0.0)
            below = v <= F.lit(t[i + 1]) if i >= last else v < F.lit(t[i + 1])
            return F.when((v >= F.lit(t[i])) & below, 1.0).otherwise(0.0)

        df = df.select(*[f"`{c}`" for c in kept], raw.alias(f"{prefix}_x"))
        df = df.select("*", *[level0(i).alias(f"{prefix}_0_{i}") for i in range(n)])
        for q in range(1, d + 1):
            terms = []
            for i in range(n - q):
                b = F.lit(0.0)
                if t[i + q] > t[i]:
                    b = b + (v - F.lit(t[i])) / F.lit(t[i + q] - t[i]) * F.col(f"{prefix}_{q - 1}_{i}")
                if t[i + q + 1] > t[i + 1]:
                    b = b + (F.lit(t[i + q + 1]) - v) / F.lit(t[i + q + 1] - t[i + 1]) * F.col(f"{prefix}_{q - 1}_{i + 1}")
                terms.append(b.alias(f"{prefix}_{q}_{i}"))
            df = df.select(*[f"`{c}`" for c in kept], f"{prefix}_x", *terms)
        if self.cyclic:
            out = [(F.col(f"{prefix}_{d}_{i}") + (F.col(f"{prefix}_{d}_{self.k + i}") if i < d else F.lit(0.0))).alias(f"{prefix}{i + 1}") for i in range(self.k)]
        else:
            out = [F.col(f"{prefix}_{d}_{i}").alias(f"{prefix}{i + 1}") for i in range(self.k)]
        return df.select(*[f"`{c}`" for c in kept], *out)

    def outside(self, x: Column) -> Column:
        """True where x lies outside the span."""
        return (x < F.lit(self.lo)) | (x > F.lit(self.hi))


def default_domain(lo: float, hi: float) -> tuple[float, float]:
    """The unit interval where it holds all values, else their range."""
    if lo is None or hi is None:
        raise ValueError("no finite values")
    return (0.0, 1.0) if lo >= -UNIT_SLACK and hi <= 1 + UNIT_SLACK else (float(lo), float(hi))


def domains(df: DataFrame, columns: list[str]) -> list[tuple[float, float]]:
    """Domains of all columns from one job."""
    finite = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    r = df.agg(*[f(finite(c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return [default_domain(r[f"lo{i}"], r[f"hi{i}"]) for i in range(len(columns))]


def make_knots(df: DataFrame, columns: list[str], k=10, degree: int = 3, cyclic=False, period: dict | None = None) -> list[Knots]:
    """Knots of all margins. k and cyclic: one value or one for each column; period: {column: (lo, hi)}."""
    d = len(columns)
    ks, cs = ([k] * d if np.isscalar(k) else list(k)), ([cyclic] * d if isinstance(cyclic, bool) else list(cyclic))
    if len(ks) != d or len(cs) != d:
        raise ValueError("k and cyclic need one value or one for each column")
    spans = domains(df, columns)
    return [Knots(*((period or {}).get(c, s) if cy else s), int(n), degree, bool(cy)) for c, s, n, cy in zip(columns, spans, ks, cs, strict=True)]


def difference_penalty(k: int, order: int = 2, cyclic: bool = False) -> np.ndarray:
    """D'D of differences; cyclic: of the circular first difference raised to the order."""
    if cyclic:
        d = np.roll(np.eye(k), 1, axis=1) - np.eye(k)
        d = np.linalg.matrix_power(d, order)
    else:
        d = np.diff(np.eye(k), order, axis=0)
    return d.T @ d
