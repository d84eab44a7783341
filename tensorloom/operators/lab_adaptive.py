"""Adaptive joint smoothing, experimental: batched Sobol search, edge probes, directed growth of the box, margin profiles, ties.

Everything is in log10 lambda. The evaluations ride on one prepared set of Gaussian cells or, with the rows' key, moments (see `lab`): a pass for each bank of probes, none for
an evaluation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..plans.linalg import nelder_mead, sobol
from .lab import Evaluator, diverse_top
from .lab import ready as laboratory
from .spline import TensorSpline, TensorSplineModel

#: How near to a face counts as touching it, the widest interval of an identified margin, what counts as flat, and where growth ends.
TOUCH, NARROW, FLAT, HARD = 0.5, 1.0, 0.005, (-12.0, 8.0)


def near_optimal(points: np.ndarray, q: np.ndarray, share: float = 0.01) -> np.ndarray | None:
    """(margins, 2): the range of the points whose criterion is within a share of the least; None where no point is finite."""
    ok = np.isfinite(q)
    if not ok.any():
        return None
    inside = points[ok & (q <= (1 + share) * q[ok].min())]
    return np.stack([inside.min(axis=0), inside.max(axis=0)], axis=1)


def edge_probe(f: Callable, best: np.ndarray, box: np.ndarray, share: float = 0.01) -> np.ndarray:
    """(margins, 2) of booleans: is the criterion on that face, the other margins held at the best point, still within a share of the best?"""
    here = f(best)
    limit = (1 + share) * here if np.isfinite(here) else np.inf
    out = np.zeros(box.shape, bool)
    for (j, side), face in np.ndenumerate(box):
        value = f(np.where(np.arange(len(best)) == j, face, best))
        out[j, side] = np.isfinite(value) and value <= limit
    return out


def grow_box(box: np.ndarray, best: np.ndarray, intervals: np.ndarray | None, forced: np.ndarray, step: float = 3.0, soft: float = 1.0) -> np.ndarray:
    """The box with faces moved out by a step (HARD at most) where a probe says so, the best point touches, or the region does and the best is near."""
    room = np.stack([best - box[:, 0], box[:, 1] - best], axis=1)
    hit = forced | (room <= TOUCH)
    if intervals is not None:
        region = np.stack([intervals[:, 0] - box[:, 0], box[:, 1] - intervals[:, 1]], axis=1)
        hit |= (region <= TOUCH) & (room <= max(soft, TOUCH))
    grown = np.clip(box + np.array([-step, step]), *HARD)
    return np.where(hit, grown, box)


def in_box(n: int, box: np.ndarray, skip: int = 0) -> np.ndarray:
    return box[:, 0] + sobol(n + skip, len(box))[skip:] * (box[:, 1] - box[:, 0])


def new_slab(n: int, old: np.ndarray, new: np.ndarray, skip: int = 0) -> np.ndarray:
    """n points of the new box, first of all those that the old one lacks."""
    pts = in_box(max(4 * n, n + 10), new, skip)
    outside = ((pts < old[:, 0] - 1e-12) | (pts > old[:, 1] + 1e-12)).any(axis=1)
    return np.concatenate([pts[outside], pts[~outside]])[:n]


def tied(a: float, b: float, se_a: float = np.nan, se_b: float = np.nan, share: float = 0.01) -> bool:
    """Closer than twice the standard error of the difference; without errors, within a share of the lesser."""
    if not (np.isfinite(a) and np.isfinite(b)):
        return False
    if np.isfinite(se_a) and np.isfinite(se_b) and se_a + se_b > 0:
        return bool(abs(a - b) < 2 * np.hypot(se_a, se_b))
    return bool(abs(a - b) <= share * max(abs(min(a, b)), 1e-12))


def profile(f: Callable, best: np.ndarray, margin: int, box: np.ndarray, points: int = 15) -> list[tuple[float, float]]:
    """(log10 lambda, criterion) along one margin, the others held at the best point."""
    return [(float(v), float(f(np.where(np.arange(len(best)) == margin, v, best)))) for v in np.linspace(*box[margin], points)]


def classify(interval: np.ndarray, faces: np.ndarray, curve: list[tuple[float, float]]) -> str:
    """effectively_unpenalized, weakly_identified, boundary_unresolved or well_identified."""
    lo, hi = interval
    at, q = np.array([c for c in curve if np.isfinite(c[1])]).reshape(-1, 2).T

    def flat(rows: np.ndarray, least: int = 2) -> bool:
        return bool(rows.sum() >= least and np.ptp(q[rows]) <= FLAT * max(abs(float(np.median(q[rows]))), 1e-8))

    low = flat(at <= max(hi, -4.0) + 1e-9)
    level = low or flat(np.ones(len(q), bool), 3) or flat((at >= lo - 1e-9) & (at <= hi + 1e-9))
    touch_low, touch_high, wide = lo - faces[0] < TOUCH, faces[1] - hi < TOUCH, hi - lo > NARROW
    if low or (level and hi < -3.5):
        return "effectively_unpenalized" if touch_low else "weakly_identified"
    if wide and (touch_low or touch_high) and len(q) > 1 and q[0] < q[1] * (1 - FLAT):
        return "boundary_unresolved"
    return "weakly_identified" if level or wide or touch_low or touch_high else "well_identified"


def anchors(box: np.ndarray, chosen: np.ndarray | None) -> list[tuple[str, np.ndarray]]:
    """Named points that every search asks for: centre, corners, an even line, and the conditional choice."""
    lo, hi, mid = box[:, 0], box[:, 1], box.mean(axis=1)
    mixed = mid.copy()
    mixed[0], mixed[1] = lo[0], hi[1]
    out = [("centre", mid), ("corner_low", lo), ("corner_high", hi), ("corner_mixed", mixed)]
    out += [(f"even_{i + 1}", np.full(len(box), v)) for i, v in enumerate(np.linspace(lo[0], hi[0], 5))]
    return out + ([("conditional", np.clip(chosen, lo, hi))] if chosen is not None and np.isfinite(chosen).all() else [])


@dataclass
class Adaptive:
    """The choice, how sure it is, and every evaluation."""

    log10_lambda: np.ndarray
    gcv: float
    model: TensorSplineModel
    source: str
    identifiability: list[str]
    intervals: np.ndarray
    profiles: list[list[tuple[float, float]]]
    box: np.ndarray
    expanded: list[int]
    batches: int
    final: list[dict]
    stable: bool
    explored: list[tuple[str, np.ndarray, float]] = field(repr=False)

    def frame(self, spark: SparkSession) -> DataFrame:
        """All evaluations: source, log10 lambda of the margins, criterion."""
        return spark.createDataFrame([(s, [float(x) for x in v], float(q)) for s, v, q in self.explored], "source string, log10_lambda array<double>, gcv double")


def optimise_adaptive(
    df: DataFrame, spec: TensorSpline, box=(-5.0, 5.0), batches=(64, 64, 128), probes: int = 15, probes_final: int = 40, sweeps=(10, 25, 50), starts: int = 5, diverse: int = 10, apart: float = 0.75,
    expansions: int = 2, local: int = 60, share: float = 0.01, seed: int = 1, key: list[str] | str | None = None,
) -> Adaptive:
    """Search in batches until the near-optimal region stands still, refine diverse points, grow the box where a face still competes, profile each
    margin, and choose on fully converged fits with two banks of probes. sweeps: of a fit while searching, refining and choosing.

    The tie rule uses the criterion's own standard error, carried over from that of the degrees of freedom.
    """
    ready = laboratory(df, spec, key)
    coarse, fine = (Evaluator(ready, spec.rank, probes, seed=seed + 11, sweeps=s, df=df, key=key) for s in sweeps[:2])
    faces = np.array([box] * len(spec.x), float)
    fast = replace(spec.control, compute_edf=False)
    chosen = np.log10(ready.fit(lam="cGCV", control=fast).lam)
    seen: list[tuple[str, np.ndarray, float]] = []

    def ask(named, e: Evaluator = coarse) -> None:
        seen.extend((name, np.asarray(v, float), e.gcv(v)) for name, v in named)

    def arrays() -> tuple[np.ndarray, np.ndarray]:
        return np.array([v for _, v, _ in seen]), np.array([q for _, _, q in seen])

    def refine() -> None:
        pts, q = arrays()
        for i in diverse_top(pts, np.where(np.isfinite(q), q, np.inf), diverse, apart)[:starts]:
            v, _ = nelder_mead(lambda v: fine.gcv(np.clip(v, faces[:, 0], faces[:, 1])), pts[i], 0.4, local)
            ask([("refined_from_" + seen[i][0].removeprefix("refined_from_"), np.clip(v, faces[:, 0], faces[:, 1]))], fine)

    used, before, asked = 0, None, 0
    for n in batches:
        used += 1
        named = [(f"sobol_batch{used}", v) for v in in_box(n, faces, asked)]
        asked += n
        ask(named + (anchors(faces, chosen) if used == 1 else []))
        region = near_optimal(*arrays(), share)
        if used > 1 and region is not None and before is not None and np.abs(region - before).max() < 0.25:
            break
        before = region
    refine()
    expanded: set[int] = set()
    for turn in range(expansions):
        pts, q = arrays()
        best = pts[int(np.argmin(q))]
        grown = grow_box(faces, best, near_optimal(pts, q, share), edge_probe(coarse.gcv, best, faces, share))
        if np.allclose(grown, faces):
            break
        expanded |= set(np.flatnonzero((grown != faces).any(axis=1)).tolist())
        n = max(16, sum(batches) // 2)
        slab, faces, asked = new_slab(n, faces, grown, asked), grown, asked + n
        ask((f"sobol_expand{turn + 1}", v) for v in slab)
        refine()
    pts, q = arrays()
    best = pts[int(np.argmin(q))]
    curves = [profile(coarse.gcv, best, j, faces) for j in range(len(faces))]
    for j, curve in enumerate(curves):
        seen.extend((f"profile_m{j + 1}", np.where(np.arange(len(best)) == j, v, best), value) for v, value in curve)
    pts, q = arrays()
    intervals = near_optimal(pts, q, share)
    if intervals is None:
        raise ValueError("no smoothing gave finite degrees of freedom")
    banks = [Evaluator(ready, spec.rank, probes_final, seed=seed + s, sweeps=sweeps[2], df=df, key=key) for s in (11, 911)]
    final = []
    for i in diverse_top(pts, np.where(np.isfinite(q), q, np.inf), starts, apart):
        first, second = (b.at(pts[i]) for b in banks)
        spread = 2 * ready.backend.n * first["rss"] / max(ready.backend.n - first["gdf"], 1e-9) ** 3
        final.append({"source": seen[i][0], "log10_lambda": pts[i], "gcv": first["gcv"], "gcv_second": second["gcv"], "gcv_se": spread * first["gdf_se"]})
    win = min(final, key=lambda r: r["gcv"])
    for r in final:
        r["tied"] = tied(win["gcv"], r["gcv"], win["gcv_se"], r["gcv_se"], share)
    stable = bool(min(final, key=lambda r: r["gcv_second"])["tied"])
    labels = [classify(i, f, c) for i, f, c in zip(intervals, faces, curves, strict=True)]
    model = ready.fit(lam=tuple(10 ** win["log10_lambda"]))
    return Adaptive(win["log10_lambda"], win["gcv"], model, win["source"], labels, intervals, curves, faces, sorted(expanded), used, final, stable, seen)
