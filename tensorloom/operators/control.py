"""Knobs of a fit and the smoothing specification."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Control:
    """Defaults that define behaviour."""

    max_sweeps: int = 50
    pirls_maxit: int = 50
    tol: float = 1e-8
    tol_lambda: float = 1e-4
    lambda_start: float = 1.0
    lambda_bounds: tuple[float, float] = (1e-4, 1e4)
    outer_maxit: int = 20
    lbfgs_maxit: int = 500
    gd_maxit: int = 5000
    gd_tol: float = 1e-7
    gd_step_factor: float = 0.5
    gd_step_min: float = 1e-12
    gd_armijo_c: float = 1e-4
    step_factor: float = 0.5
    step_min: float = 1 / 128
    objective_tol: float = 1e-10
    seed: int = 1
    init_sd: float = 0.15
    als_sweeps_per_pirls: int = 1
    als_sweeps_per_pirls_max: int = 3
    hybrid_lbfgs_maxit: int = 50
    dn_max_sweeps: int = 40
    dn_armijo_c: float = 1e-4
    dn_step_factor: float = 0.5
    dn_step_min: float = 1e-12
    dn_ridge: float = 0.0
    block_lbfgs_maxit: int = 50
    block_lbfgs_sweeps: int = 40
    compute_edf: bool = True
    null_space_max_npar: int = 4096
    cgcv_update: str = "outer_simultaneous"
    cgcv_damping: float = 0.25
    cgcv_max_log10_step: float = 1.0
    cgcv_parameterization: str = "free"
    cgcv_lambda0_method: str = "fixed_start"
    cgcv_lambda0_grid: tuple[float, ...] | None = None
    cgcv_margin_order: tuple[int, ...] | None = None
    margin_order: str = "ltr"
    penalty: str = "global"
    refit_intercept: bool = True

    def __post_init__(self):
        known = {
            "cgcv_update": ("outer_simultaneous", "sequential"),
            "cgcv_parameterization": ("free", "scale_anisotropy"),
            "cgcv_lambda0_method": ("fixed_start", "log_grid"),
            "margin_order": ("ltr", "rtl"),
            "penalty": ("global", "own"),
        }
        for name, values in known.items():
            if getattr(self, name) not in values:
                raise ValueError(f"{name} must be one of {', '.join(values)}")
        lo, hi = self.lambda_bounds
        if not 0 < lo < hi:
            raise ValueError("lambda_bounds must be positive and ascending")


def parse_lambda(spec, d: int, control: Control) -> tuple[str, np.ndarray]:
    """(method, start values): a number or d of them is fixed, "cGCV" is automatic."""
    if isinstance(spec, str):
        if spec.lower() == "cgcv":
            return "cGCV", np.full(d, float(control.lambda_start))
        if spec in ("cFS", "cREML"):
            raise NotImplementedError(f"{spec} is reserved")
        raise ValueError(f"unknown smoothing method {spec!r}")
    v = np.full(d, float(spec)) if np.isscalar(spec) else np.asarray(spec, float)
    if v.shape != (d,) or not np.isfinite(v).all() or (v <= 0).any():
        raise ValueError(f"lambda needs 1 or {d} positive numbers")
    return "fixed", v


def boundary_status(lam, bounds, share: float = 0.02) -> list[str]:
    """lower, upper or interior for each value, within a share of the bounds on the log scale."""
    lo, hi = np.log(bounds[0]), np.log(bounds[1])
    edge = share * (hi - lo)
    return ["lower" if x <= lo + edge else "upper" if x >= hi - edge else "interior" for x in np.log(np.asarray(lam, float))]


def damped_step(old, proposal, damping: float, max_log10_step: float, bounds) -> np.ndarray:
    """The damped and trusted update of log lambda."""
    old, proposal = np.log(np.asarray(old, float)), np.log(np.asarray(proposal, float))
    most = max_log10_step * np.log(10)
    return np.exp(np.clip(old + np.clip(damping * (proposal - old), -most, most), np.log(bounds[0]), np.log(bounds[1])))


def scale_anisotropy(lam) -> tuple[float, np.ndarray]:
    """lambda = scale * omega with the product of omega 1."""
    log = np.log(np.asarray(lam, float))
    return float(np.exp(log.mean())), np.exp(log - log.mean())


def anisotropy_step(old, proposal, damping: float, max_log10_step: float, bounds) -> np.ndarray:
    """The update under scale times anisotropy: the scale is held, log omega is damped, and the step is trusted and bounded as a whole."""
    scale, now = scale_anisotropy(old)
    log = (1 - damping) * np.log(now) + damping * np.log(scale_anisotropy(proposal)[1])
    return damped_step(old, scale * np.exp(log - log.mean()), 1.0, max_log10_step, bounds)
