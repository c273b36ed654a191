"""Chinese-restaurant seatings drawn a dish at a time: the number of tables that a dish's customers sit at.

Of a restaurant with strength s and discount d, the tables t_w of its dishes have the joint weight

    product over j < sum(t) of (s + d j)  *  product over w of p_w^t_w S_d(c_w, t_w)

with p_w the parent's probability of dish w, c_w its customers and S_d(c, t) the summed weight of all ways to seat c customers at
t tables (generalised Stirling numbers). Given an auxiliary g ~ Gamma(s / d + sum(t)) the dishes are independent, each with
weight (d g p_w)^t S_d(c, t), so one Gibbs step seats all customers of all dishes anew at once, whatever their number.

With lam = g p_w that weight is lam^t / t! * q(c, t) up to a factor of c, where q(c, t) is the probability that t independent
Sibuya(d) numbers sum to c. q comes from a recurrence up to SMALL customers, and beyond that from its series in t c^-d where
that is at most 1, else from its saddle point. Tests hold all three against the recurrence.
"""

from __future__ import annotations

from math import gamma, lgamma, pi, sin

import numpy as np

SMALL = 512
_TERMS = 44
_LOGS: dict[float, np.ndarray] = {}


def log_stirling(d: float, most: int = SMALL) -> np.ndarray:
    """log of d^t S_d(c, t) at [c, t], from S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t)."""
    if d in _LOGS and len(_LOGS[d]) > most:
        return _LOGS[d]
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, most + 1)
    for c in range(1, most):
        with np.errstate(divide="ignore"):
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], np.log(np.maximum(c - d * t, 0)) + out[c, 1:])
    out[:, 1:] += t * np.log(d)
    _LOGS[d] = out
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, for x of 400 or more."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * pi) + 1 / (12 * x) - 1 / (360 * x**3)


_FACTORIALS = np.array([lgamma(k + 1.0) for k in range(400)])


def _log_factorial(t: np.ndarray) -> np.ndarray:
    return np.where(t < 399, _FACTORIALS[np.minimum(t, 399).astype(np.int64)], _log_gamma(np.maximum(t + 1.0, 400.0)))


def _series(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log q by the sum over j of (-1)^j C(t, j) G(c - d j) / (G(-d j) G(c + 1)), over G(c - d) / G(c + 1)."""
    base, total, choose = _log_gamma(c - d), np.zeros(t.shape), np.ones(t.shape)
    for j in range(1, _TERMS):
        choose = choose * np.maximum(t - j + 1, 0) / j * np.exp(_log_gamma(c - d * j) - (_log_gamma(c - d * (j - 1)) if j > 1 else base))
        # 1 / G(-z) = -sin(pi z) G(1 + z) / pi; choose carries the power of c, so terms stay small.
        total = total + (-1) ** (j + 1) * choose * (sin(pi * d * j) * gamma(1 + d * j) / pi)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.log(total) + base - _log_gamma(c + 1.0)


def _saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log q by the saddle point of t log(1 - (1 - x)^d) - c log x. Close to t = c, where the c - t customers that open no
    table are nearly Poisson, its implied approximation of their factorial gives way to the factorial itself."""
    low, high = np.full(t.shape, -60.0), np.full(t.shape, -1e-15)  # log(1 - x)
    for _ in range(60):
        mid = (low + high) / 2
        v = np.exp(mid)
        above = t * (1 - v) * d * np.exp((d - 1) * mid) > c * (1 - np.exp(d * mid))
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    v = np.exp((low + high) / 2)
    x, f = 1 - v, 1 - v**d
    first = d * x * v ** (d - 1) / f
    second = first * (1 + (1 - d) * x / v - first)
    over = np.maximum(c - t, 1.0)
    shape = over * np.log(over) - over + 0.5 * np.log(2 * pi * over) - _log_factorial(over)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = t * np.log(f) - c * np.log(x) - 0.5 * np.log(2 * pi * t * second) + shape
    return np.where(c == t, t * np.log(d), out)


def log_weight(c: np.ndarray, t: np.ndarray, log_lam: np.ndarray, d: float) -> np.ndarray:
    """log of lam^t / t! q(c, t) for c over SMALL, up to a term of c. All of one shape."""
    few = t <= c**d
    q = np.empty(t.shape)
    q[few] = _series(c[few], t[few], d)
    q[~few] = _saddle(c[~few], t[~few], d)
    return t * log_lam - _log_factorial(t) + q


def _pick(logits: np.ndarray, rng) -> np.ndarray:
    """A column of each row, by its weight."""
    w = np.exp(logits - logits.max(axis=1, keepdims=True))
    w = np.cumsum(w, axis=1)
    return (w < rng.random(len(w))[:, None] * w[:, -1:]).sum(axis=1)


def _mode(c: np.ndarray, log_lam: np.ndarray, d: float) -> np.ndarray:
    """The likeliest t; weights rise up to it and then fall, so halving finds it."""
    low, high = np.ones(len(c)), c.copy()
    while (low < high).any():
        mid = np.floor((low + high) / 2)
        nxt = np.minimum(mid + 1, c)
        up = (log_weight(c, nxt, log_lam, d) > log_weight(c, mid, log_lam, d)) & (mid < c)
        low, high = np.where(up, nxt, low), np.where(up, high, mid)
    return low


def _log(lam: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(lam, 1e-300))


def draw_tables(c: np.ndarray, lam: np.ndarray, d: float, rng) -> np.ndarray:
    """Tables of dishes with c customers (0: none), each drawn with weight (d lam)^t S_d(c, t)."""
    out = np.minimum(c, 1).astype(np.int64)
    # Most dishes have one customer, and so one table.
    order = np.flatnonzero(c > 1)
    order = order[np.argsort(c[order], kind="stable")]
    ordered = c[order]
    table = log_stirling(d)
    at, end = 0, int(np.searchsorted(ordered, SMALL, "right"))
    while at < end:
        n = int(ordered[at])
        stop = min(int(np.searchsorted(ordered, n, "right")), at + max(1, 1_000_000 // n))
        k = order[at:stop]
        # d^t goes with lam: the weight of t is lam^t (d^t S).
        out[k] = 1 + _pick(_log(lam[k])[:, None] * np.arange(1, n + 1) + table[n, 1 : n + 1], rng)
        at = stop
    k = order[end:]
    if len(k):
        cust, mode = c[k].astype(np.float64), _mode(c[k].astype(np.float64), _log(lam[k]), d)
        reach = np.ceil(12 * np.sqrt(mode) + 24)
        k, cust, mode, reach = (x[np.argsort(reach, kind="stable")] for x in (k, cust, mode, reach))
        at = 0
        while at < len(k):
            stop = at + 1
            while stop < len(k) and (stop + 1 - at) * (2 * reach[stop] + 1) <= 400_000:
                stop += 1
            part, width = slice(at, stop), reach[stop - 1]
            t = mode[part, None] + np.arange(-width, width + 1)
            inside = (t >= 1) & (t <= cust[part, None])
            both = [np.broadcast_to(x[part, None], t.shape) for x in (cust, _log(lam[k]))]
            logits = np.where(inside, log_weight(both[0].copy(), np.clip(t, 1, both[0]), both[1], d), -np.inf)
            out[k[part]] = (mode[part] - width + _pick(logits, rng)).astype(np.int64)
            at = stop
    return out
