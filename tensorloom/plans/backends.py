"""What a fit asks of the data, answered by one of three backends.

Every answer is a sum over rows of small arrays. `CellBackend` holds weighted distinct covariate rows on the driver (bounded by
`CELLS`), made by one map-side-combined aggregation; `MomentBackend` holds the tensor Gram matrix of one Arrow pass and answers every
Gaussian question without another; `RowBackend` runs one Arrow job for each question, for tensors or covariates too large for the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import families as fam_
from ..functions.basis import Knots
from . import tensor

#: Distinct covariate rows up to which data is held as cells, and tensor entries up to which moments are.
CELLS, MOMENTS = 100_000, 1_500
#: Partial sums of an array that come to the driver.
FAN = 4


@dataclass
class State:
    """Parameters of a fit: cores and the coefficients of the additive block (intercept, linear, smooth)."""

    cores: list[np.ndarray]
    beta: np.ndarray

    def copy(self) -> State:
        return State([c.copy() for c in self.cores], self.beta.copy())


@dataclass
class Block:
    """Rows of one batch or all cells: bases of the margins, additive design z, response, weight, offset."""

    bases: list[np.ndarray]
    z: np.ndarray
    y: np.ndarray
    w: np.ndarray
    off: np.ndarray
    fold: np.ndarray | None = None
    probes: np.ndarray | None = None

    def take(self, mask: np.ndarray) -> Block:
        own = lambda a: None if a is None else a[mask]
        return Block([b[mask] for b in self.bases], self.z[mask], self.y[mask], self.w[mask], self.off[mask], own(self.fold), own(self.probes))

    def eta(self, s: State) -> np.ndarray:
        return self.off + self.z @ s.beta + tensor.contract(self.bases, s.cores)


@dataclass
class Request:
    kind: str
    family: str = "gaussian"
    states: list[State] = field(default_factory=list)
    anchor: State | None = None  # working weights and responses come from here; None: from the data
    k: int = 0


def answer(b: Block, q: Request) -> dict[str, np.ndarray]:
    """The sums of one block."""
    if q.kind == "size":
        return {"n": np.array(float(len(b.y))), "w": b.w.sum(), "wy": (b.w * b.y).sum(), "we": (b.w * np.exp(np.clip(b.off, -20, 20))).sum(), "yy": (b.w * b.y**2).sum()}
    if q.kind == "loss":
        out = {}
        for i, s in enumerate(q.states):
            eta = b.eta(s)
            mu = fam_.np_inverse(q.family, eta)
            out[f"nll{i}"] = np.array(fam_.np_nll(q.family, b.y, eta, b.w))
            out[f"dev{i}"] = np.array(deviance(q.family, b.y, mu, b.w))
        return out
    s = q.states[0]
    if q.kind == "gradient":
        j = np.concatenate([tensor.jacobian(b.bases, s.cores), b.z], axis=1)
        eta = b.eta(s)
        return {"nll": np.array(fam_.np_nll(q.family, b.y, eta, b.w)), "g": j.T @ fam_.np_score(q.family, b.y, eta, b.w)}
    if q.kind == "sweep":  # curvature and score of all cores and the additive block at once, with the loss there
        x, eta = np.concatenate([tensor.jacobian(b.bases, s.cores), b.z], axis=1), b.eta(s)
        w, score = fam_.np_curvature(q.family, eta, b.w), fam_.np_score(q.family, b.y, eta, b.w)
        return {"S": x.T @ (x * w[:, None]), "g": x.T @ score, "nll": np.array(fam_.np_nll(q.family, b.y, eta, b.w))}
    if q.anchor is None and q.family == "gaussian":
        w, t = b.w, b.y - b.off
    else:
        eta = b.eta(q.anchor or s)
        w, t = fam_.np_working(q.family, b.y, eta, b.w)
        t = t - b.off
    if q.kind == "core":
        x = tensor.design_core(b.bases, s.cores, q.k)
    elif q.kind == "blocks":  # the working equations of every core given the others, side by side
        x = tensor.jacobian(b.bases, s.cores)
    elif q.kind == "joint":
        x = tensor.jacobian(b.bases, s.cores)
        if q.family != "gaussian":
            w = fam_.np_curvature(q.family, b.eta(s), b.w)
    elif q.kind == "tensor":
        x = b.bases[0]
        for other in b.bases[1:]:
            x = (x[:, :, None] * other[:, None, :]).reshape(len(x), -1)
    elif q.kind == "newton":  # unfloored curvature and score of one core
        x, eta = tensor.design_core(b.bases, s.cores, q.k), b.eta(s)
        w = fam_.np_curvature(q.family, eta, b.w)
        return {"S": x.T @ (x * w[:, None]), "g": x.T @ fam_.np_score(q.family, b.y, eta, b.w), "nll": np.array(fam_.np_nll(q.family, b.y, eta, b.w))}
    else:
        raise ValueError(q.kind)
    xw, zw = x * w[:, None], b.z * w[:, None]
    return {"S": x.T @ xw, "b": xw.T @ t, "C": xw.T @ b.z, "M": b.z.T @ zw, "m": zw.T @ t, "zz": np.array((w * t * t).sum()), "w": np.array(w.sum())}


def deviance(family: str, y, mu, w) -> float:
    if family == "gaussian":
        return float((w * (y - mu) ** 2).sum())
    if family == "poisson":
        m = np.maximum(mu, fam_.LIK_EPS)
        return float(2 * (w * (np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / m), 0) - (y - m))).sum())
    m = np.clip(mu, fam_.LIK_EPS, 1 - fam_.LIK_EPS)
    return float(-2 * (w * (y * np.log(m) + (1 - y) * np.log(1 - m))).sum())


class CellBackend:
    """All data as weighted distinct rows on the driver; `within` is what the response varies within cells.

    n counts rows, not cells. For Poisson and Bernoulli sums over a cell depend on its weight and mean response only; `extra`
    holds what a deviance needs besides.
    """

    def __init__(self, block: Block, n: np.ndarray | None = None, within: np.ndarray | None = None, extra: np.ndarray | None = None):
        size = len(block.y)
        self.block = block
        self.counts = np.ones(size) if n is None else n
        self.within = np.zeros(size) if within is None else within
        self.extra = np.zeros(size) if extra is None else extra
        self.n = float(self.counts.sum())

    @property
    def folds(self) -> list[int]:
        return sorted(set(self.block.fold.tolist()))

    def part(self, fold: int, inside: bool) -> CellBackend:
        mask = (self.block.fold == fold) == inside
        return CellBackend(self.block.take(mask), self.counts[mask], self.within[mask], self.extra[mask])

    def total(self, q: Request) -> dict[str, np.ndarray]:
        out = answer(self.block, q)
        if q.kind == "size":
            out["n"], out["yy"] = np.array(self.n), out["yy"] + self.within.sum()
        elif q.family == "gaussian":
            if q.kind == "loss":
                for i in range(len(q.states)):
                    out[f"nll{i}"], out[f"dev{i}"] = out[f"nll{i}"] + self.within.sum() / 2, out[f"dev{i}"] + self.within.sum()
            elif "zz" in out:
                out["zz"] = out["zz"] + self.within.sum()
            elif "nll" in out:
                out["nll"] = out["nll"] + self.within.sum() / 2
        elif q.kind == "loss":
            for i in range(len(q.states)):
                out[f"dev{i}"] = out[f"dev{i}"] + self.extra.sum()
        return out


    def moments(self, sizes: list[int]) -> MomentBackend:
        """The same data as sums of products, for Gaussian fits with many more cells than tensor entries."""
        dummy = State([np.zeros((1, p, 1)) for p in sizes], np.zeros(self.block.z.shape[1]))

        def sums(be: CellBackend) -> dict:
            out: dict = {}
            for at in range(0, len(be.block.y), 4096):  # tiles, so that no wide design is held whole
                mask = np.zeros(len(be.block.y), bool)
                mask[at : at + 4096] = True
                tile = CellBackend(be.block.take(mask), be.counts[mask], be.within[mask])
                for k, v in (tile.total(Request("tensor", states=[dummy])) | tile.total(Request("size"))).items():
                    out[k] = out[k] + v if k in out else v
            return out

        if self.block.fold is None:
            return MomentBackend(sizes, sums(self))
        by = {f: sums(self.part(f, True)) for f in self.folds}
        return MomentBackend(sizes, {k: sum(v[k] for v in by.values()) for k in next(iter(by.values()))}, by)


class MomentBackend:
    """Gaussian sums of products of the whole tensor basis and the additive block; folds are held apart and subtracted."""

    def __init__(self, sizes: list[int], m: dict[str, np.ndarray], folds: dict[int, dict] | None = None):
        self.sizes, self.m, self.by_fold = sizes, m, folds or {}
        self.n = float(m["n"])
        self._index = tensor.index_bases(sizes)

    @property
    def folds(self) -> list[int]:
        return sorted(self.by_fold)

    def part(self, fold: int, inside: bool) -> MomentBackend:
        own = self.by_fold[fold]
        return MomentBackend(self.sizes, own if inside else {k: self.m[k] - own[k] for k in self.m})

    def total(self, q: Request) -> dict[str, np.ndarray]:
        if q.family != "gaussian":
            raise ValueError("moments answer Gaussian questions only")
        m = self.m
        if q.kind == "size":
            return {k: m[k] for k in ("n", "w", "wy", "we", "yy")}
        if q.kind == "tensor":
            return {k: m[k] for k in ("S", "b", "C", "M", "m", "zz", "w")}
        if q.kind == "loss":
            out = {}
            for i, s in enumerate(q.states):
                t, b = tensor.contract(self._index, s.cores), s.beta
                rss = float(m["zz"] - 2 * (m["b"] @ t + m["m"] @ b) + t @ m["S"] @ t + b @ m["M"] @ b + 2 * t @ m["C"] @ b)
                out[f"nll{i}"], out[f"dev{i}"] = np.array(max(rss, 0) / 2), np.array(max(rss, 0))
            return out
        s = q.states[0]
        if q.kind in ("gradient", "sweep"):
            a, t = tensor.jacobian(self._index, s.cores), tensor.contract(self._index, s.cores)
            left = m["S"] @ t + m["C"] @ s.beta - m["b"]
            g = np.concatenate([a.T @ left, m["C"].T @ t + m["M"] @ s.beta - m["m"]])
            out = {"nll": self.total(replace(q, kind="loss"))["nll0"], "g": g}
            return out if q.kind == "gradient" else out | {"S": np.block([[a.T @ m["S"] @ a, a.T @ m["C"]], [m["C"].T @ a, m["M"]]])}
        a = tensor.jacobian(self._index, s.cores) if q.kind in ("joint", "blocks") else tensor.design_core(self._index, s.cores, q.k)
        out = {"S": a.T @ m["S"] @ a, "b": a.T @ m["b"], "C": a.T @ m["C"], "M": m["M"], "m": m["m"], "zz": m["zz"], "w": m["w"]}
        if q.kind == "newton":
            t = tensor.contract(self._index, s.cores)
            out["g"], out["nll"] = a.T @ (m["S"] @ t + m["C"] @ s.beta - m["b"]), self.total(replace(q, kind="loss"))["nll0"]
        return out


class RowBackend:
    """One Arrow job for each question over (x0.., z0.., y, w, off[, fold]); only sums leave the executors. `jobs` counts them."""

    jobs, by_rows = 0, True

    def __init__(self, df: DataFrame, knots: list[Knots], n_z: int, n: float, fold: tuple[int, bool] | None = None, folds: list[int] | None = None):
        self.df, self.knots, self.n_z, self.n, self.fold, self.folds = df, knots, n_z, n, fold, folds or []

    def part(self, fold: int, inside: bool) -> RowBackend:
        df = self.df.filter((F.col("fold") == fold) if inside else (F.col("fold") != fold))
        return RowBackend(df, self.knots, self.n_z, float(df.count()))

    def close(self) -> None:
        self.df.unpersist()

    def total(self, q: Request) -> dict[str, np.ndarray]:
        self.jobs += 1
        return collect_sums(self.df, lambda b: answer(b, q), self.knots, self.n_z)


def block_of(batch: pa.RecordBatch, knots: list[Knots], n_z: int) -> Block:
    col = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)
    z = np.stack([np.ones(batch.num_rows)] + [col(f"z{i}") for i in range(n_z)], axis=1)
    fold = batch.column("fold").to_numpy(zero_copy_only=False) if "fold" in batch.schema.names else None
    named = sorted((c for c in batch.schema.names if c.startswith("probe")), key=lambda c: int(c[5:]))
    return Block([k.evaluate(col(f"x{i}")) for i, k in enumerate(knots)], z, col("y"), col("w"), col("off"), fold, np.stack([col(c) for c in named], axis=1) if named else None)


_SUMS = "fold int, name string, shape array<int>, v binary"


def _packed(sums: dict[tuple, np.ndarray]) -> pa.RecordBatch:
    rows = [(fold, name, list(x.shape), x.tobytes()) for (fold, name), x in sums.items()]
    kinds = (pa.int32(), pa.string(), pa.list_(pa.int32()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["fold", "name", "shape", "v"])


def _unpacked(fold: int, name: str, shape: list[int], v: bytes) -> tuple[tuple, np.ndarray]:
    return (fold, name), np.frombuffer(v).reshape(shape)


def tree_sums(df: DataFrame, f) -> dict[tuple, np.ndarray]:
    """Sums over all batches of the arrays that f gives by (fold, name). Every split of df is read by a task of its own.

    A task sends each of its arrays once, packed. A narrower stage (the root of the shuffle partitions) adds them up one by one, and
    another leaves `FAN` of each at most for the driver.
    """

    def add(sums: dict, more) -> None:
        for key, x in more:
            sums[key] = sums[key] + x if key in sums else x

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                add(sums, ((key, np.asarray(x, float)) for key, x in f(b).items()))
        yield _packed(sums)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            add(sums, (_unpacked(*r) for r in zip(*(b.column(c).to_pylist() for c in ("fold", "name", "shape", "v")), strict=True)))
        yield _packed(sums)

    out, width = df.mapInArrow(first, _SUMS), math.isqrt(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    for parts in sorted({width, min(width, FAN)}, reverse=True):
        out = out.repartitionById(parts, F.spark_partition_id() % parts).mapInArrow(again, _SUMS)
    sums: dict[tuple, np.ndarray] = {}
    for r in sorted(out.collect(), key=lambda r: (r["fold"], r["name"], bytes(r["v"]))):  # the sums themselves, no larger than the model
        add(sums, [_unpacked(*r)])
    return sums


def collect_sums(df: DataFrame, f, knots: list[Knots], n_z: int, by_fold: bool = False):
    """Sums of f(block) over all rows, as {name: array}, or for each fold."""

    def parts(b: pa.RecordBatch) -> dict[tuple, np.ndarray]:
        whole = block_of(b, knots, n_z)
        each = [(0, whole)] if not by_fold else [(int(k), whole.take(whole.fold == k)) for k in np.unique(whole.fold)]
        return {(fold, name): x for fold, part in each for name, x in f(part).items()}

    out: dict = {}
    for (fold, name), x in tree_sums(df, parts).items():
        out.setdefault(fold, {})[name] = x
    return out if by_fold else out.get(0, {})


def build(df: DataFrame, knots: list[Knots], x: list[str], y: str, family: str, weight: str | None = None, offset: str | None = None, z: list[str] = (), fold: str | None = None, kind: str = "auto"):
    """A backend for df. kind: auto, cells, moments or rows. z: columns of the additive block besides the intercept."""
    cols = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x)] + [F.col(c).cast("double").alias(f"z{i}") for i, c in enumerate(z)]
    cols += [F.col(y).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), (F.col(offset).cast("double") if offset else F.lit(0.0)).alias("off")]
    rows = df.select(*cols, *([F.col(fold).cast("int").alias("fold")] if fold else [])).filter("w is null or isnan(w) or w <> 0")
    keys = [f"x{i}" for i in range(len(x))] + [f"z{i}" for i in range(len(z))] + ["off"] + (["fold"] if fold else [])
    nulls = lambda c: F.col(c).isNull() | F.isnan(c)
    bad = F.lit(False)
    for c in [*keys, "y", "w"]:
        bad = bad | (nulls(c) if c != "fold" else F.col(c).isNull())
    bad = bad | (F.col("w") < 0)
    wrong = (F.col("y") < 0) if family == "poisson" else ~F.col("y").isin(0.0, 1.0) if family == "bernoulli" else F.lit(False)
    first = rows.agg(F.count("*").alias("n"), F.sum(bad.cast("long")).alias("bad"), F.sum(wrong.cast("long")).alias("wrong"), F.approx_count_distinct(F.struct(*keys)).alias("cells"), *([F.collect_set("fold").alias("folds")] if fold else [])).first()
    if not first["n"]:
        raise ValueError("no rows with a positive weight")
    if first["bad"]:
        raise ValueError(f"{first['bad']} rows with a null or NaN, or a negative weight")
    if first["wrong"]:
        raise ValueError(f"{first['wrong']} responses outside the {family} family")
    folds, entries = sorted(first["folds"]) if fold else [], int(np.prod([k.k for k in knots], dtype=float))
    auto = kind == "auto"
    if auto:
        kind = "cells" if first["cells"] <= CELLS else "moments" if family == "gaussian" and entries <= MOMENTS else "rows"
    if kind == "cells":
        ylny = F.sum(F.when(F.col("y") > 0, F.col("w") * F.col("y") * F.ln(F.when(F.col("y") > 0, F.col("y"))))) if family == "poisson" else F.lit(0.0)
        cells = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("wyy"), ylny.alias("ylny"))
        t = cells.orderBy(*keys).limit(2 * CELLS + 1).toArrow()
        if t.num_rows > 2 * CELLS:
            raise ValueError("too many distinct covariate rows for cells; use kind='moments' or 'rows'")
        col = lambda c: t.column(c).to_numpy().astype(float)
        w, mean = col("w"), col("wy") / col("w")
        block = Block([k.evaluate(col(f"x{i}")) for i, k in enumerate(knots)], np.stack([np.ones(t.num_rows)] + [col(f"z{i}") for i in range(len(z))], axis=1), mean, w, col("off"), t.column("fold").to_numpy() if fold else None)
        own = np.where(mean > 0, w * mean * np.log(np.where(mean > 0, mean, 1)), 0.0)
        out = CellBackend(block, col("n"), np.maximum(col("wyy") - w * mean**2, 0), 2 * (np.nan_to_num(col("ylny")) - own) if family == "poisson" else None)
        return out.moments([k.k for k in knots]) if auto and family == "gaussian" and 4 * entries < t.num_rows and entries <= MOMENTS else out
    if kind == "moments":
        if family != "gaussian" or entries > MOMENTS:
            raise ValueError(f"moments need a Gaussian response and at most {MOMENTS} tensor entries")
        dummy = State([np.zeros((1, k.k, 1)) for k in knots], np.zeros(1 + len(z)))
        both = lambda b: answer(b, Request("tensor", states=[dummy])) | answer(b, Request("size"))
        by = collect_sums(rows, both, knots, len(z), by_fold=bool(fold))
        sums = by if not fold else {k: sum(v[k] for v in by.values()) for k in next(iter(by.values()))}
        return MomentBackend([k.k for k in knots], sums, by if fold else None)
    # Every question reads the rows again: what is kept are a few doubles for each, on disk where memory ends.
    return RowBackend(rows.persist(StorageLevel.MEMORY_AND_DISK), knots, len(z), float(first["n"]), folds=folds)
