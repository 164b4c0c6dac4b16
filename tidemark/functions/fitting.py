"""Small fits in NumPy, run inside a task for one series and fold at a time."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np

from .recurrences import garch_variance, hawkes_loglik

NORMAL = NormalDist()


def nelder_mead(f: Callable[[np.ndarray], float], x0: np.ndarray, tol: float = 1e-6, most: int = 4000) -> np.ndarray:
    """Downhill simplex; it starts 5 percent off in each coordinate (0.00025 from 0)."""
    n = len(x0)
    simplex = [np.array(x0, float)]
    for i in range(n):
        x = np.array(x0, float)
        x[i] = x[i] * 1.05 if x[i] else 0.00025
        simplex.append(x)
    values = [f(x) for x in simplex]
    for _ in range(most):
        order = np.argsort(values, kind="stable")
        simplex, values = [simplex[i] for i in order], [values[i] for i in order]
        if max(abs(v - values[0]) for v in values) <= tol and max(np.abs(x - simplex[0]).max() for x in simplex) <= tol:
            break
        centre, worst = np.mean(simplex[:-1], axis=0), simplex[-1]
        across = centre + (centre - worst)
        value = f(across)
        if value < values[0]:
            beyond = centre + 2 * (centre - worst)
            far = f(beyond)
            simplex[-1], values[-1] = (beyond, far) if far < value else (across, value)
        elif value < values[-2]:
            simplex[-1], values[-1] = across, value
        else:
            inner = centre + 0.5 * ((across if value < values[-1] else worst) - centre)
            got = f(inner)
            if got < min(value, values[-1]):
                simplex[-1], values[-1] = inner, got
            else:
                simplex = [simplex[0], *(simplex[0] + 0.5 * (x - simplex[0]) for x in simplex[1:])]
                values = [values[0], *(f(x) for x in simplex[1:])]
    return simplex[int(np.argmin(values))]


def golden(f: Callable[[float], float], a: float, b: float, tol: float = 1e-6) -> float:
    """Least of a function with one valley on [a, b]."""
    ratio = (math.sqrt(5) - 1) / 2
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tol:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = f(d)
    return (a + b) / 2


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def fit_hawkes(event: np.ndarray) -> tuple[float, float, float]:
    """(mu, alpha, beta) by maximum likelihood; with fewer than 10 events the plain rate."""
    times, n = np.flatnonzero(event).astype(float), float(len(event))
    rate = len(times) / n if n else 0.0
    if len(times) < 10:
        return rate, 0.0, 1.0
    unpack = lambda x: (math.exp(x[0]), _logistic(x[1]), math.exp(x[2]))

    def loss(x: np.ndarray) -> float:
        if np.abs(x).max() > 50:
            return 1e12
        return -hawkes_loglik(times, n, *unpack(x))

    return unpack(nelder_mead(loss, np.array([math.log(0.5 * rate), 0.0, math.log(0.1)])))


def fit_garch(r: np.ndarray) -> tuple[float, float, float, float]:
    """(omega, alpha, beta, variance): the long-run variance is the sample's, so two parameters are left.
    NaN with fewer than two returns."""
    if len(r) < 2:
        return (math.nan,) * 4
    var = float(np.var(r))

    def loss(x: np.ndarray) -> float:
        if np.abs(x).max() > 50:
            return 1e12
        a, b = _logistic(x[0]), _logistic(x[1])
        if a + b >= 0.9999:
            return 1e12
        return -garch_variance(r, var * (1 - a - b), a, b, var)[1]

    a, b = (_logistic(v) for v in nelder_mead(loss, np.array([-2.5, 2.0]), tol=1e-5))
    return var * (1 - a - b), a, b, var


def garch_horizon(next_variance: np.ndarray, fit: tuple[float, float, float, float], h: int) -> np.ndarray:
    """Mean variance of the next h bars."""
    _, a, b, var = fit
    p = a + b
    return var + (next_variance - var) * (1 - p**h) / (1 - p) / h


def logistic_fit(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Intercept and slope by Newton's method, without a penalty."""
    w = np.zeros(2)
    z = np.column_stack([np.ones(len(x)), x])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-9 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (y - p))
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def student_logpdf(x: np.ndarray, nu: float) -> np.ndarray:
    return math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - (nu + 1) / 2 * np.log1p(x * x / nu)


def fit_nu(z: np.ndarray) -> float:
    """Degrees of freedom in (2.1, 60) of a t distribution scaled to unit variance."""
    z = z[np.isfinite(z)]

    def loss(nu: float) -> float:
        s = math.sqrt(nu / (nu - 2))
        return -float(np.sum(student_logpdf(z * s, nu) + math.log(s)))

    return golden(loss, 2.1, 60.0, 1e-4)


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_cdf(x: float, nu: float) -> float:
    half = 0.5 * incomplete_beta(nu / 2, 0.5, nu / (nu + x * x))
    return half if x < 0 else 1 - half


def student_ppf(p: float, nu: float) -> float:
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if student_cdf(mid, nu) < p else (lo, mid)
    return (lo + hi) / 2


def chi2_sf1(x: float) -> float:
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def chi2_sf2(x: float) -> float:
    return math.exp(-max(x, 0.0) / 2)
