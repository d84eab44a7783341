"""Profiled null space: what no difference penalty sees is fitted without shrinkage, beside a train for the rest. Gaussian.

The tensor product of the margins' null bases, linear terms and smooth terms of fixed smoothing form one block. Whatever the cores are, the block
has a best answer, so it is solved out of every question that a fit asks: sums S, b of a core's design become S - C' M^-1 C and b - C' M^-1 m, C being the sums
of that design with the block and M, m the block's own. The null design is made row by row beside the core's, so nothing of the size of the full
tensor's Gram matrix is held: the block has at most `Control.null_space_max_npar` columns, the tensor any number of entries.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame

from ..functions import families as fam_
from ..functions.basis import difference_penalty
from ..plans import tensor
from ..plans.backends import Block, CellBackend, MomentBackend, Request, RowBackend, State, collect_sums
from .control import parse_lambda
from .spline import Prepared, TensorSpline, TensorSplineModel

#: Numbers of a null design that cells may hold on the driver, and rows of a batch whose design is made at a time.
HELD, TILE = 20_000_000, 2_048


def null_basis(k: int, order: int = 2) -> np.ndarray:
    """Polynomial coefficients of degree below the order, orthonormal."""
    return np.linalg.qr(np.vander(np.arange(k) - (k - 1) / 2, order, increasing=True))[0]


def null_design(bases: list[np.ndarray], nulls: list[np.ndarray]) -> np.ndarray:
    """Row-wise products of the margins' null bases, the first index slowest."""
    out = np.ones((len(bases[0]), 1))
    for b, u in zip(bases, nulls, strict=True):
        out = (out[:, :, None] * (b @ u)[:, None, :]).reshape(len(b), -1)
    return out


def _with_null(b: Block, nulls: list[np.ndarray]) -> Block:
    """The block with the null design in place of the intercept, which it contains."""
    return replace(b, z=np.concatenate([null_design(b.bases, nulls), b.z[:, 1:]], axis=1))


class NullRows:
    """Rows whose additive block begins with the null design. The block's own sums are asked for once."""

    by_rows = True

    def __init__(self, be: RowBackend, nulls: list[np.ndarray]):
        self.be, self.nulls, self.n = be, nulls, be.n
        self.own = self._sums(lambda b: {"M": b.z.T @ (b.z * b.w[:, None]), "m": b.z.T @ (b.w * (b.y - b.off))})

    def _sums(self, f) -> dict:
        nulls = self.nulls

        def tiles(b: Block) -> dict:
            out: dict = {}
            for at in range(0, len(b.y), TILE):
                mask = np.zeros(len(b.y), bool)
                mask[at : at + TILE] = True
                for k, v in f(_with_null(b.take(mask), nulls)).items():
                    out[k] = out[k] + v if k in out else v
            return out

        self.be.jobs += 1
        return collect_sums(self.be.df, tiles, self.be.knots, self.be.n_z)

    def total(self, q: Request) -> dict[str, np.ndarray]:
        if q.kind == "size":
            return self.be.total(q)

        def part(b: Block) -> dict:
            x = tensor.design_core(b.bases, q.states[0].cores, q.k) if q.kind == "core" else tensor.jacobian(b.bases, q.states[0].cores)
            xw, t = x * b.w[:, None], b.y - b.off
            return {"S": x.T @ xw, "b": xw.T @ t, "C": xw.T @ b.z, "zz": np.array((b.w * t * t).sum()), "w": b.w.sum()}

        return self._sums(part) | self.own

    def close(self) -> None:
        self.be.close()


def _beside(be, nulls: list[np.ndarray]):
    if isinstance(be, CellBackend):
        return CellBackend(_with_null(be.block, nulls), be.counts, be.within)
    if isinstance(be, MomentBackend):
        m, whole = be.m, np.eye(1)
        for u in nulls:
            whole = np.kron(whole, u)
        c, cz, s = m["S"] @ whole, m["C"][:, 1:], whole.T @ m["C"][:, 1:]
        both = np.block([[whole.T @ c, s], [s.T, m["M"][1:, 1:]]])
        return MomentBackend(be.sizes, m | {"C": np.concatenate([c, cz], axis=1), "M": both, "m": np.concatenate([whole.T @ m["b"], m["m"][1:]])})
    return NullRows(be, nulls)


class Profiled:
    """A backend whose additive block is solved out; what it answers is about cores alone."""

    def __init__(self, inner, penalty: np.ndarray):
        self.inner, self.penalty, self.n, self.by_rows = inner, penalty, inner.n, isinstance(inner, NullRows)
        self.inverse: np.ndarray | None = None

    def _left(self, m: dict) -> dict:
        if self.inverse is None:  # the block's own sums are the same in every answer
            self.gram = m["M"]
            self.inverse = np.linalg.pinv(self.gram + self.penalty, hermitian=True, rcond=1e-12)
            self.m = m["m"]
        k = self.inverse @ m["C"].T
        out = {"S": m["S"] - m["C"] @ k, "b": m["b"] - k.T @ m["m"], "zz": m["zz"] - m["m"] @ self.inverse @ m["m"]}
        return out | {"w": m["w"], "C": np.zeros((len(m["b"]), 1)), "M": np.zeros((1, 1)), "m": np.zeros(1)}

    def core(self, s: State, k: int = 0) -> dict:
        return self._left(self.inner.total(Request("core", states=[self._filled(s)], k=k)))

    def _filled(self, s: State) -> State:
        return State(s.cores, np.zeros(len(self.penalty)))

    def total(self, q: Request) -> dict[str, np.ndarray]:
        if q.family != "gaussian":
            raise ValueError("a profiled null space answers Gaussian questions only")
        if q.kind == "size":
            return self.inner.total(q)
        if q.kind == "loss":
            out = {}
            for i, s in enumerate(q.states):
                m, g = self.core(s), tensor.pack(s.cores[0])
                rss = max(float(m["zz"] - 2 * m["b"] @ g + g @ m["S"] @ g), 0.0)
                out[f"nll{i}"], out[f"dev{i}"] = np.array(rss / 2), np.array(rss)
            return out
        s = q.states[0]
        if q.kind == "core":
            return self.core(s, q.k)
        m = self._left(self.inner.total(Request("blocks", states=[self._filled(s)])))
        if q.kind in ("joint", "blocks"):
            return m
        # J of core 0 times core 0 is the surface, so the sums of the first core's columns give the score of all.
        g = tensor.pack(s.cores[0])
        n = len(g)
        score = m["S"][:, :n] @ g - m["b"]
        nll = max(float(m["zz"] - 2 * m["b"][:n] @ g + g @ m["S"][:n, :n] @ g), 0.0) / 2
        full = np.zeros((len(score) + 1,) * 2)
        full[:-1, :-1] = m["S"]
        return {"nll": np.array(nll), "g": np.append(score, 0.0), "S": full}

    def block(self, s: State) -> np.ndarray:
        """The block's coefficients that are best for the cores as they stand."""
        m = self.inner.total(Request("core", states=[self._filled(s)], k=0))
        return self.inverse @ (m["m"] - m["C"].T @ tensor.pack(s.cores[0]))


def added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """The train of the sum of two tensors: bonds side by side."""
    out = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if i in (0, len(a) - 1):
            out.append(np.concatenate([x, y], axis=2 if i == 0 else 0))
        else:
            both = np.zeros((x.shape[0] + y.shape[0], x.shape[1], x.shape[2] + y.shape[2]))
            both[: x.shape[0], :, : x.shape[2]], both[x.shape[0] :, :, x.shape[2] :] = x, y
            out.append(both)
    return out


@dataclass
class ProfiledNull:
    """A train beside unshrunk null coefficients and further terms. backend answers for what the block leaves of the rows."""

    nulls: list[np.ndarray]
    model: TensorSplineModel
    backend: Profiled
    beta: np.ndarray

    @property
    def n_null(self) -> int:
        return int(np.prod([u.shape[1] for u in self.nulls]))

    @property
    def coef(self) -> np.ndarray:
        """Null coefficients."""
        return self.beta[: self.n_null]

    @property
    def linear(self) -> dict[str, float]:
        return dict(zip(self.model.spec.linear, self.beta[self.n_null :].tolist(), strict=False))

    @property
    def null(self) -> np.ndarray:
        """The null basis of the whole tensor, for small ones."""
        out = np.eye(1)
        for u in self.nulls:
            out = np.kron(out, u)
        return out

    @property
    def null_rank(self) -> int:
        return int(np.linalg.matrix_rank(self.backend.gram[: self.n_null, : self.n_null], hermitian=True))

    @property
    def edf(self) -> float:
        """The block by its own influence (in full, where it isn't penalised), the train by that of its residualised map."""
        return float(np.trace(self.backend.inverse @ self.backend.gram)) + self.model.edf

    def cores(self) -> list[np.ndarray]:
        """The train of the whole coefficient tensor, null part included."""
        from .grid import dense_train

        own = dense_train(self.coef, [u.shape[1] for u in self.nulls])
        return added(self.model.cores, [np.einsum("jm,amb->ajb", u, g) for u, g in zip(self.nulls, own, strict=True)])

    def theta(self) -> np.ndarray:
        """The whole coefficient tensor, flat; for small ones."""
        return tensor.dense(self.cores()).ravel()

    def deviance(self) -> float:
        """The residual sum of squares, without what smooth terms pay for their roughness."""
        return self.model.deviance - float(self.beta @ self.backend.penalty @ self.beta)

    def transform(self, df: DataFrame) -> DataFrame:
        whole = State(self.cores(), np.concatenate([[0.0], self.beta[self.n_null :]]))
        return replace(self.model, state=whole, vcov_=None).transform(df)


def fit_profiled_null(df: DataFrame, spec: TensorSpline) -> ProfiledNull:
    """Null space, linear terms and smooth terms of fixed smoothing profiled out; the train at fixed or automatic smoothing.

    Over cells where their null design is small, over moments where the tensor is, else over rows, a scan a sweep.
    """
    if fam_.family(spec.family) != "gaussian":
        raise ValueError("a profiled null space is for Gaussian responses")
    if any(isinstance(t.lam, str) or t.target_edf is not None for t in spec.smooth):
        raise ValueError("smooth terms beside a profiled null space need a fixed smoothing")
    ready = spec.prepare(df)
    knots, orders = ready.knots, [1 if k.cyclic else spec.penalty_order for k in ready.knots]  # the penalty of a cyclic column sees all but the constant
    size = int(np.prod(orders, dtype=float))
    if size > spec.control.null_space_max_npar:
        raise ValueError(f"the null space has {size} columns, more than {spec.control.null_space_max_npar}")
    nulls = [null_basis(k.k, q) for k, q in zip(knots, orders, strict=True)]
    be = ready.backend
    if isinstance(be, CellBackend) and len(be.block.y) * size > HELD:
        be = replace(spec, backend="rows").prepare(df).backend
    penalty = np.zeros((size + ready.n_beta - 1,) * 2)
    for t, _, at in ready.terms:
        own = slice(size + at.start - 1, size + at.stop - 1)
        penalty[own, own] = float(t.lam) * difference_penalty(t.k, t.m, t.bs == "cc")
    left = Profiled(_beside(be, nulls), penalty)
    method, lam = parse_lambda(spec.lam, len(knots), spec.control)
    bare = replace(spec, knots=knots, linear=[], smooth=[], control=replace(spec.control, refit_intercept=False))
    flat = State(tensor.init_cores([k.k for k in knots], spec.rank, spec.control.seed, spec.control.init_sd), np.zeros(1))
    try:
        model = Prepared(bare, "gaussian", knots, [], 1, left).fit(lam=spec.lam if method == "cGCV" else tuple(lam), init=flat)
        beta = left.block(model.state)
    finally:
        if isinstance(be, RowBackend):
            be.close()
    return ProfiledNull(nulls, replace(model, spec=replace(spec, knots=knots), terms=[(t.column, kn, at) for t, kn, at in ready.terms]), left, beta)
