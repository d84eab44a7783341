"""Tensor-train algebra on the driver: cores G_k of shape (r_{k-1}, p_k, r_k), their gauge, truncation, and difference penalties.

A core is packed with its left index fastest and its right index slowest.
"""

from __future__ import annotations

import numpy as np

DENSE_MOST = 500_000


def rank_chain(rank, d: int) -> tuple[int, ...]:
    """1, r_1, ..., r_{d-1}, 1 from one number, d - 1 of them, or the whole chain."""
    r = [int(rank)] * (d - 1) if np.isscalar(rank) else [int(x) for x in rank]
    if len(r) == d + 1:
        if r[0] != 1 or r[-1] != 1:
            raise ValueError("a rank chain starts and ends with 1")
        r = r[1:-1]
    if len(r) != d - 1 or min(r, default=1) < 1:
        raise ValueError(f"rank needs 1, {d - 1} or {d + 1} positive numbers")
    return (1, *r, 1)


def init_cores(sizes: list[int], rank, seed: int = 1, sd: float = 0.15) -> list[np.ndarray]:
    r, rng = rank_chain(rank, len(sizes)), np.random.default_rng(seed)
    return [rng.normal(0, sd, (r[k], p, r[k + 1])) for k, p in enumerate(sizes)]


def formula_cores(sizes: list[int], rank) -> list[np.ndarray]:
    """Cores without randomness: sin(a + 2j + 3b + k) / p, all indices from 1."""
    r, out = rank_chain(rank, len(sizes)), []
    for k, p in enumerate(sizes, 1):
        a, j, b = np.meshgrid(np.arange(1, r[k - 1] + 1), np.arange(1, p + 1), np.arange(1, r[k] + 1), indexing="ij")
        out.append(np.sin(a + 2 * j + 3 * b + k) / p)
    return out


def ranks(cores) -> tuple[int, ...]:
    return tuple(g.shape[0] for g in cores) + (cores[-1].shape[2],)


def pack(core: np.ndarray) -> np.ndarray:
    return core.transpose(2, 1, 0).ravel()


def unpack(g: np.ndarray, shape) -> np.ndarray:
    a, p, b = shape
    return g.reshape(b, p, a).transpose(2, 1, 0)


def pack_all(cores) -> np.ndarray:
    return np.concatenate([pack(c) for c in cores])


def unpack_all(g: np.ndarray, shapes) -> list[np.ndarray]:
    out, at = [], 0
    for s in shapes:
        n = int(np.prod(s))
        out.append(unpack(g[at : at + n], s))
        at += n
    return out


def contract_left(left: np.ndarray, basis: np.ndarray, core: np.ndarray) -> np.ndarray:
    a, p, b = core.shape
    return (left[:, :, None] * basis[:, None, :]).reshape(len(left), -1) @ core.reshape(a * p, b)


def contract_right(right: np.ndarray, basis: np.ndarray, core: np.ndarray) -> np.ndarray:
    a, p, b = core.shape
    return (basis[:, :, None] * right[:, None, :]).reshape(len(right), -1) @ core.transpose(1, 2, 0).reshape(p * b, a)


def interfaces(bases, cores) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Left and right partial products at each core."""
    n, d = len(bases[0]), len(cores)
    left, right = [np.ones((n, 1))], [np.ones((n, 1))]
    for k in range(d - 1):
        left.append(contract_left(left[-1], bases[k], cores[k]))
        right.append(contract_right(right[-1], bases[d - 1 - k], cores[d - 1 - k]))
    return left, right[::-1]


def contract(bases, cores) -> np.ndarray:
    """The surface at each row."""
    out = np.ones((len(bases[0]), 1))
    for b, g in zip(bases, cores, strict=True):
        out = contract_left(out, b, g)
    return out[:, 0]


def surface_column(cores, prefixes: list[str]):
    """The surface as one Column over basis columns prefix1..prefixp of each margin."""
    from pyspark.sql import functions as F

    bond = None
    for core, name in zip(cores, prefixes, strict=True):
        step = [[sum((F.col(f"{name}{j + 1}") * F.lit(float(core[a, j, b])) for j in range(core.shape[1])), F.lit(0.0)) for b in range(core.shape[2])] for a in range(core.shape[0])]
        bond = step[0] if bond is None else [sum((bond[a] * step[a][b] for a in range(len(bond))), F.lit(0.0)) for b in range(core.shape[2])]
    return bond[0]


def design(left: np.ndarray, basis: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The conditional design of a core, in packed order."""
    return (right[:, :, None, None] * basis[:, None, :, None] * left[:, None, None, :]).reshape(len(basis), -1)


def design_core(bases, cores, k: int) -> np.ndarray:
    left, right = interfaces(bases, cores)
    return design(left[k], bases[k], right[k])


def jacobian(bases, cores) -> np.ndarray:
    left, right = interfaces(bases, cores)
    return np.concatenate([design(left[k], bases[k], right[k]) for k in range(len(cores))], axis=1)


def index_bases(sizes: list[int]) -> list[np.ndarray]:
    """Bases that pick each entry of the dense tensor, the first index slowest."""
    grid = np.meshgrid(*[np.arange(p) for p in sizes], indexing="ij")
    return [np.eye(p)[g.ravel()] for p, g in zip(sizes, grid, strict=True)]


def dense(cores) -> np.ndarray:
    sizes = [c.shape[1] for c in cores]
    if np.prod(sizes, dtype=float) > DENSE_MOST:
        raise ValueError("the dense tensor would be too large")
    return contract(index_bases(sizes), cores).reshape(sizes)


def complexity(cores) -> dict:
    """Dense and stored sizes, the gauge and what is left, and compression."""
    sizes, r = [c.shape[1] for c in cores], ranks(cores)
    full, stored, gauge = float(np.prod(sizes, dtype=float)), sum(c.size for c in cores), sum(x * x for x in r[1:-1])
    return {"d": len(cores), "full": full, "stored": stored, "gauge": gauge, "intrinsic": stored - gauge, "compression": full / stored}


def apply_gauge(cores, k: int, a: np.ndarray) -> list[np.ndarray]:
    """The same tensor with a and its inverse between cores k and k + 1."""
    out = list(cores)
    out[k] = np.einsum("ajb,bc->ajc", cores[k], a)
    out[k + 1] = np.einsum("ab,bjc->ajc", np.linalg.inv(a), cores[k + 1])
    return out


def left_orthogonal(cores) -> list[np.ndarray]:
    out = [c.copy() for c in cores]
    for k in range(len(out) - 1):
        a, p, b = out[k].shape
        q, r = np.linalg.qr(out[k].reshape(a * p, b))
        sign = np.where(np.diag(r) < 0, -1.0, 1.0)
        q, r = q * sign, r * sign[:, None]
        out[k], out[k + 1] = q.reshape(a, p, -1), np.einsum("ab,bjc->ajc", r, out[k + 1])
    return out


def truncate(cores, rank) -> list[np.ndarray]:
    """Left-orthogonal, then singular values cut from right to left."""
    goal, out = rank_chain(rank, len(cores)), left_orthogonal(cores)
    for k in range(len(out) - 1, 0, -1):
        a, p, b = out[k].shape
        u, s, v = np.linalg.svd(out[k].reshape(a, p * b), full_matrices=False)
        n = min(goal[k], len(s))
        out[k] = v[:n].reshape(n, p, b)
        out[k - 1] = np.einsum("ajb,bc->ajc", out[k - 1], u[:, :n] * s[:n])
    return out


# Penalties: J = 1/2 sum_m lambda_m |Theta x_m D|^2.


def bond_grams(cores, penalties, lam) -> tuple[list, list]:
    """(L0, LP) to the left and (R0, RP) to the right of each core: plain and penalised inner products."""
    d = len(cores)
    left, right = [(np.ones((1, 1)), np.zeros((1, 1)))], [(np.ones((1, 1)), np.zeros((1, 1)))]
    for k in range(d - 1):
        g, (a0, ap) = cores[k], left[-1]
        dg = np.einsum("ij,ajb->aib", penalties[k], g)
        left.append((np.einsum("ac,ajb,cjd->bd", a0, g, g), np.einsum("ac,ajb,cjd->bd", ap, g, g) + lam[k] * np.einsum("ac,ajb,cjd->bd", a0, g, dg)))
        g, (b0, bp) = cores[d - 1 - k], right[-1]
        dg = np.einsum("ij,ajb->aib", penalties[d - 1 - k], g)
        right.append((np.einsum("bd,ajb,cjd->ac", b0, g, g), np.einsum("bd,ajb,cjd->ac", bp, g, g) + lam[d - 1 - k] * np.einsum("bd,ajb,cjd->ac", b0, g, dg)))
    return left, right[::-1]


def core_penalty(cores, penalties, lam, k: int, mode: str = "global") -> tuple[np.ndarray, np.ndarray]:
    """(own, other): the penalty of core k is lam_k * own + other. mode "own": only its own margin, without its neighbours' scale."""
    a, p, b = cores[k].shape
    if mode == "own":
        return np.kron(np.eye(b), np.kron(penalties[k], np.eye(a))), np.zeros((a * p * b,) * 2)
    left, right = bond_grams(cores, penalties, lam)
    (l0, lp), (r0, rp) = left[k], right[k]
    own = np.kron(r0, np.kron(penalties[k], l0))
    return own, np.kron(r0, np.kron(np.eye(p), lp)) + np.kron(rp, np.kron(np.eye(p), l0))


def penalty_value(cores, penalties, lam) -> float:
    own, other = core_penalty(cores, penalties, lam, 0)
    g = pack(cores[0])
    return float(0.5 * g @ (lam[0] * own + other) @ g)


def penalty_gradient(cores, penalties, lam) -> np.ndarray:
    parts = []
    for k in range(len(cores)):
        own, other = core_penalty(cores, penalties, lam, k)
        parts.append((lam[k] * own + other) @ pack(cores[k]))
    return np.concatenate(parts)


def joint_penalty(cores, penalties, lam) -> np.ndarray:
    """J' P J over all cores, J the Jacobian of the tensor and P its penalty: what the penalty adds to the normal equations of all cores at once.

    Blocks between two cores come from environments as well: a chain with core k open on one side and core l on the other. Each link is a pair
    (plain, penalised so far), which multiply by the product rule, as a penalised chain has one margin penalised and the rest plain.
    """
    left, right = bond_grams(cores, penalties, lam)
    at = np.cumsum([0, *(c.size for c in cores)])
    out = np.zeros((at[-1],) * 2)
    for k in range(len(cores)):
        own, other = core_penalty(cores, penalties, lam, k)
        out[at[k] : at[k + 1], at[k] : at[k + 1]] = lam[k] * own + other
        (l0, lp), g, dg = left[k], cores[k], lam[k] * np.einsum("ij,ajb->aib", penalties[k], cores[k])
        # x[a, j, y]: the open slot (a, j) of core k against the other side's bond y; its bond to the right stays open.
        x0, xp = np.einsum("ac,cjy->ajy", l0, g), np.einsum("ac,cjy->ajy", lp, g) + np.einsum("ac,cjy->ajy", l0, dg)
        b = g.shape[2]
        # link[b, y, u, v]: from the bonds after core k to those before core l, through the cores between.
        m0, mp = np.einsum("bu,yv->byuv", np.eye(b), np.eye(b)), np.zeros((b,) * 4)
        for n in range(k + 1, len(cores)):
            g, dg, (r0, rp) = cores[n], lam[n] * np.einsum("ij,ajb->aib", penalties[n], cores[n]), right[n]
            z0, zp = np.einsum("uif,fe->uie", g, r0), np.einsum("uif,fe->uie", dg, r0) + np.einsum("uif,fe->uie", g, rp)
            join = lambda x, m, z: np.einsum("ajy,byuv,uie->bjaeiv", x, m, z, optimize=True)
            block = join(xp, m0, z0) + join(x0, mp, z0) + join(x0, m0, zp)
            # Packed order: the left index fastest, the right one slowest.
            block = block.reshape(cores[k].size, cores[n].size)
            out[at[k] : at[k + 1], at[n] : at[n + 1]], out[at[n] : at[n + 1], at[k] : at[k + 1]] = block, block.T
            step = lambda m, p, q: np.einsum("byuv,uif,vih->byfh", m, p, q, optimize=True)
            m0, mp = step(m0, g, g), step(mp, g, g) + step(m0, dg, g)
    return out


def dense_penalty(sizes, penalties, lam) -> np.ndarray:
    """Of the dense tensor (first index slowest); for small tensors."""
    total = np.zeros((int(np.prod(sizes)),) * 2)
    for m in range(len(sizes)):
        x = np.eye(1)
        for j, p in enumerate(sizes):
            x = np.kron(x, penalties[j] if j == m else np.eye(p))
        total += lam[m] * x
    return total
