"""Singular values and right singular vectors of a small dense matrix.

Householder reflections bring the matrix to upper bidiagonal form; the dqds
transform (differential quotient-difference with shifts) finds the squared
singular values of the bidiagonal to high relative accuracy; each vector comes
from a twisted factorisation of the shifted tridiagonal product. Values that
lie close together share a search space: their vectors are found one after
the other by inverse iteration with the twisted factors, each orthogonal to
those before.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
CLOSE = 1e-4


def bidiagonalise(r: np.ndarray):
    """(a, b, w): diagonal and upper diagonal of U'RW, and W."""
    m = np.array(r, np.float64)
    d = m.shape[1]
    w = np.eye(d)
    for k in range(d):
        v, beta = _reflector(m[k:, k])
        m[k:, k:] -= beta * np.outer(v, v @ m[k:, k:])
        if k < d - 2:
            v, beta = _reflector(m[k, k + 1:])
            m[k:, k + 1:] -= beta * np.outer(m[k:, k + 1:] @ v, v)
            w[:, k + 1:] -= beta * np.outer(w[:, k + 1:] @ v, v)
    return np.diag(m).copy(), np.diag(m, 1).copy(), w


def _reflector(x: np.ndarray):
    """(v, beta) so that (I - beta vv')x lies along the first axis."""
    v = np.array(x, np.float64)
    size = np.linalg.norm(v)
    if size == 0:
        return v, 0.0
    v[0] += size if v[0] >= 0 else -size
    return v, 2.0 / (v @ v)


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of the upper bidiagonal (a, b), falling, by dqds."""
    q, e = [float(x) * float(x) for x in a], [float(x) * float(x) for x in b]
    found = []
    todo = [(0, len(q), 0.0)]
    while todo:
        lo, hi, sigma = todo.pop()
        tau = 0.0
        while hi - lo > 0:
            if hi - lo == 1:
                found.append(q[lo] + sigma)
                hi -= 1
                continue
            # what is negligible beside its neighbours splits the array
            cut = next((k for k in range(hi - 2, lo - 1, -1) if e[k] <= EPS * EPS * (min(q[k], q[k + 1]) + sigma)
                        or e[k] == 0.0), None)
            if cut is not None:
                todo.append((lo, cut + 1, sigma))
                lo, tau = cut + 1, 0.0
                continue
            got = _dqds_step(q, e, lo, hi, tau)
            if got is None:  # the shift passed the smallest value: a smaller one, at last none
                tau = tau / 4 if tau > EPS * q[hi - 1] else 0.0
                continue
            least, last = got
            sigma += tau
            # the last entry less what couples it to the others stays below the smallest value
            tau = max(0.0, min(least, last) - np.sqrt(max(last, 0.0) * e[hi - 2])) * (1 - 4 * EPS) if hi - lo > 1 else 0.0
            tau = tau if tau > 0 else least / 4
    return np.sort(np.maximum(np.array(found), 0.0))[::-1]


def _dqds_step(q: list, e: list, lo: int, hi: int, tau: float):
    """One transform in place; (smallest d, last d), or None, array untouched, where a d is negative."""
    d, least = q[lo] - tau, np.inf
    new_q, new_e = [0.0] * (hi - lo), [0.0] * (hi - lo - 1)
    for k in range(lo, hi - 1):
        if d < 0 or np.isnan(d):
            return None
        least = min(least, d)
        s = d + e[k]
        new_q[k - lo] = s
        if s == 0.0:
            new_e[k - lo], d = 0.0, q[k + 1] - tau
        else:
            new_e[k - lo] = e[k] * (q[k + 1] / s)
            d = d * (q[k + 1] / s) - tau
    if d < 0 or np.isnan(d):
        return None
    new_q[-1] = d
    q[lo:hi], e[lo:hi - 1] = new_q, new_e
    return min(least, d), d


def _twisted(a: np.ndarray, b: np.ndarray, lam: float):
    """Factors of B'B - lam: lower multipliers, upper multipliers, twist place, pivots."""
    d = len(a)
    big, ell = a * a, np.zeros(max(d - 1, 0))
    ell[:] = b / a[:-1]
    tiny = EPS * EPS * max(big.max(), lam) + np.finfo(np.float64).tiny
    down, up, s, p = np.zeros(max(d - 1, 0)), np.zeros(max(d - 1, 0)), np.zeros(d), np.zeros(d)
    plus, minus = np.zeros(d), np.zeros(d)
    s[0] = -lam
    for i in range(d - 1):
        plus[i] = big[i] + s[i]
        plus[i] = plus[i] if abs(plus[i]) > tiny else tiny
        down[i] = big[i] * ell[i] / plus[i]
        s[i + 1] = down[i] * ell[i] * s[i] - lam
    plus[d - 1] = big[d - 1] + s[d - 1]
    p[d - 1] = big[d - 1] - lam
    for i in range(d - 2, -1, -1):
        minus[i + 1] = big[i] * ell[i] * ell[i] + p[i + 1]
        minus[i + 1] = minus[i + 1] if abs(minus[i + 1]) > tiny else tiny
        t = big[i] / minus[i + 1]
        up[i] = ell[i] * t
        p[i] = p[i + 1] * t - lam
    gamma = s + p + lam
    k = int(np.argmin(np.abs(gamma)))
    pivots = np.concatenate([plus[:k], [gamma[k] if abs(gamma[k]) > tiny else tiny], minus[k + 1:]])
    return down, up, k, pivots


def _back(down, up, k: int, z: np.ndarray) -> np.ndarray:
    """Solve N'x = z, N the twisted unit factor with its twist at k."""
    x = z.copy()
    for i in range(k - 1, -1, -1):
        x[i] -= down[i] * x[i + 1]
    for i in range(k, len(x) - 1):
        x[i + 1] -= up[i] * x[i]
    return x


def _forward(down, up, k: int, z: np.ndarray) -> np.ndarray:
    """Solve Nx = z."""
    x = z.copy()
    for i in range(k):
        x[i + 1] -= down[i] * x[i]
    for i in range(len(x) - 2, k - 1, -1):
        x[i] -= up[i] * x[i + 1]
    return x


def _apart(z: np.ndarray, others: np.ndarray, noise) -> np.ndarray:
    """``z`` made orthogonal to ``others``; where nothing is left of it, another start."""
    for _ in range(8):
        size, rest = np.linalg.norm(z), z
        for _ in range(3):
            rest = rest - others @ (others.T @ rest)
        if np.linalg.norm(rest) > 1e-6 * size:
            return rest / np.linalg.norm(rest)
        z = noise.standard_normal(len(z))
    return rest / np.linalg.norm(rest)


def vectors(a: np.ndarray, b: np.ndarray, lams: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of B'B for its eigenvalues ``lams`` (falling)."""
    d, scale = len(a), np.sqrt(max(float(lams[0]), 0.0)) if len(lams) else 0.0
    if scale == 0.0:
        return np.eye(d)[:, :len(lams)]
    floor = EPS * EPS * scale
    a = np.where(np.abs(a) > floor, a, floor)
    out = np.zeros((d, len(lams)))
    first = 0
    noise = np.random.default_rng(0)
    for j, lam in enumerate(lams):
        if j and lams[j - 1] - lam > CLOSE * max(lams[j - 1], EPS * lams[0]):
            first = j
        down, up, k, pivots = _twisted(a, b, float(lam))
        unit = np.zeros(d)
        unit[k] = 1.0
        z = _back(down, up, k, unit)
        z /= np.linalg.norm(z)
        before = out[:, first:j]
        if j > first:
            even = np.where(np.abs(pivots) > EPS * lams[0], pivots, EPS * lams[0])  # no direction outgrows the others
            for turn in range(4):
                z = _apart(z, before, noise)
                if turn < 3:
                    z = _back(down, up, k, _forward(down, up, k, z) / even)
                    z /= np.linalg.norm(z)
        out[:, j] = z
    return out


def right_singular(r: np.ndarray, keep: int):
    """(squares, vectors): all squared singular values of ``r``, falling, and the right
    singular vectors (columns) of the first ``keep`` of them that are not zero to rounding."""
    a, b, w = bidiagonalise(r)
    top = max(np.abs(a).max(), np.abs(b).max() if len(b) else 0.0)
    b = np.where(np.abs(b) > 4 * EPS * top, b, 0.0)  # no more than the rounding of r
    lams = squared_singular_values(a, b)
    rank = int(np.sum(lams > (len(a) * EPS) ** 2 * lams[0])) if len(lams) and lams[0] > 0 else 0
    n = min(keep, rank)
    return lams, w @ _by_block(a, b, lams, n)


def _by_block(a, b, lams, n: int) -> np.ndarray:
    """Vectors of the first ``n`` values; an array that splits gives them block by block."""
    cuts = [0, *(np.flatnonzero(b == 0.0) + 1), len(a)]
    if len(cuts) == 2:
        return vectors(a, b, lams[:n])
    own = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        part = squared_singular_values(a[lo:hi], b[lo:hi - 1])
        own += [(-v, lo, hi, i) for i, v in enumerate(part)]
    out, made = np.zeros((len(a), n)), {}
    for j, (_, lo, hi, i) in enumerate(sorted(own)[:n]):
        if lo not in made:
            made[lo] = vectors(a[lo:hi], b[lo:hi - 1], squared_singular_values(a[lo:hi], b[lo:hi - 1]))
        out[lo:hi, j] = made[lo][:, i]
    return out
