"""Driver-side p x p algebra and distribution functions (no scipy needed)."""

from __future__ import annotations

import math

import numpy as np

Z975 = 1.959963984540054  # fixed: standard normal 97.5% quantile


def sym_pinv(g: np.ndarray, rcond: float = 1e-11) -> tuple[np.ndarray, int]:
    """Symmetric pseudo-inverse of a Gram matrix and its numerical rank.

    The rank is decided on the matrix scaled to a unit diagonal, so regressors of very
    different size do not hide each other: eigenvalues below ``rcond`` times the largest are
    zero.  The inverse found there is mapped back, and its part along the null directions is
    projected out, which gives the Moore-Penrose inverse (minimum-norm estimates).
    """
    g = (g + g.T) / 2.0
    diagonal = np.diag(g)
    d = np.where(diagonal > 0, 1.0 / np.sqrt(np.where(diagonal > 0, diagonal, 1.0)), 0.0)
    scaled = g * d[:, None] * d[None, :]
    w, v = np.linalg.eigh(scaled)
    keep = w > rcond * max(abs(w).max(), 1e-300)
    inner = (v[:, keep] / w[keep]) @ v[:, keep].T
    # one refinement of the scaled inverse against rounding
    inner = 2 * inner - inner @ scaled @ inner
    inv = inner * d[:, None] * d[None, :]
    rank = int(keep.sum())
    if rank < len(g):
        # null directions of g: those of the scaled matrix, and empty columns
        live = diagonal > 0
        null = [d * v[:, k] for k in np.flatnonzero(~keep) if np.any(np.abs(v[live, k]) > 1e-8)]
        null += [np.eye(len(g))[k] for k in np.flatnonzero(~live)]
        q, r = np.linalg.qr(np.array([x / np.linalg.norm(x) for x in null]).T)
        q = q[:, np.abs(np.diag(r)) > 1e-10]
        off = np.eye(len(g)) - q @ q.T
        inv = off @ inv @ off
    return inv, rank


def condition_number(g: np.ndarray) -> float:
    """Condition number of X (sqrt of the eigenvalue ratio of XᵀX)."""
    w = np.linalg.eigvalsh((g + g.T) / 2.0)  # of X as it is, as usually reported
    w = np.clip(w, 0, None)
    return float(math.sqrt(w.max() / w.min())) if w.min() > 0 else float("inf")


def norm_sf2(z: float) -> float:
    """Two-sided normal p-value."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def _betacf(a: float, b: float, x: float) -> float:
    tiny, eps = 1e-300, 3e-16
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) by continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_sf2(t: float, df: float) -> float:
    """Two-sided Student-t p-value."""
    if not math.isfinite(t):
        return 0.0
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t for p > 0.5, by bisection on the two-sided tail."""
    lo, hi = 0.0, 1.0
    while t_sf2(hi, df) > 2 * (1 - p):
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_sf2(mid, df) > 2 * (1 - p) else (lo, mid)
    return hi


def f_sf(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def omnibus(n: float, skew: float, kurtosis: float) -> float:
    """D'Agostino-Pearson statistic (chi-square with 2 df) of n residuals; kurtosis 3 is the normal one.
    NaN below 8 rows, as the test is not defined there."""
    if n < 8 or not (math.isfinite(skew) and math.isfinite(kurtosis)):
        return float("nan")
    y = skew * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (beta2 - 1)) - 1
    z_skew = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    spread = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (kurtosis - 3.0 * (n - 1) / (n + 1)) / math.sqrt(spread)
    b1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b1 * (2 / b1 + math.sqrt(1 + 4 / b1 ** 2))
    low = 1 + x * math.sqrt(2 / (a - 4))
    root = math.copysign(((1 - 2 / a) / abs(low)) ** (1 / 3), low) if low else float("nan")
    z_kurtosis = (1 - 2 / (9 * a) - root) / math.sqrt(2 / (9 * a))
    return z_skew ** 2 + z_kurtosis ** 2
