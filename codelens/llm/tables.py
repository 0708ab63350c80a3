"""How many tables the customers of a dish sit at, drawn from its exact distribution given the rest.

While all other dishes hold still and a new table has weight a, customers of a dish who leave and join one by one
(an old table of n weighs n - d) come to tables t with probability in proportion to a^t S(c, t).  S are the
generalised Stirling numbers of discount d: S(1, 1) = 1, S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t).  Drawing t
from that moves all customers of a dish at once, however many: what a sweep over them would reach only in the long run.
"""

from __future__ import annotations

import math

import numpy as np

#: Customers up to which the numbers come from their recursion; beyond, from an integral.
SMALL = 512
#: Points of the integral on one side; Metropolis steps, each with a proposal of its own.
NODES, STEPS = 32, 8
#: Weights that are summed at once.
_CELLS = 1 << 20
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def recursion(n: int, discount: float) -> np.ndarray:
    """Logs of S(c, t) for c and t up to n."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[1, 1] = 0
    at = np.arange(1, n + 1)
    for c in range(1, n):
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], out[c, 1:] + np.log(np.maximum(c - discount * at, 1e-300)))
    return out


def _solve(f, goal: np.ndarray) -> np.ndarray:
    """Where the falling ``f`` of a logarithm below zero reaches ``goal``."""
    low, high = np.full(len(goal), -700.0), np.zeros(len(goal))
    for _ in range(60):
        mid = (low + high) / 2
        above = f(mid) > goal
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return (low + high) / 2


def log_stirling(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """Logs of S(c, t) for large c, to about 1e-5, at t of nearly c to 2e-3.

    S(c, t) t! / c! is the coefficient of z^c in ((1 - (1 - z)^d) / d)^t.  With z = exp(-p), it is an integral along
    a parabola of p around the cut, through the saddle or, nearer to the cut than that, at a distance of some 1 / c.
    """
    d = discount
    y = _solve(lambda y: np.log(-np.expm1(y)) + (d - 1) * y + np.log(d) - np.log(-np.expm1(d * y)), np.log(c / t))
    p0 = np.maximum(-np.log(-np.expm1(y)), np.pi * NODES / 12 / c)
    z, y = np.exp(-p0), np.log(-np.expm1(-p0))
    f = -np.expm1(d * y) / d
    mean = z * np.exp((d - 1) * y) / f
    square = mean + z * z * (1 - d) * np.exp((d - 2) * y) / f
    step = np.minimum(3 / NODES, 1 / (6 * p0 * np.sqrt(t * (square - mean * mean))))
    u = 1 + 1j * step[:, None] * np.arange(NODES + 1)
    p = p0[:, None] * u * u
    # 1 - exp(-p), also for small p.
    g = 2 * np.sin(p.imag / 2) ** 2 - np.expm1(-p.real) * np.cos(p.imag) + 1j * np.exp(-p.real) * np.sin(p.imag)
    e = c[:, None] * p + t[:, None] * np.log((1 - g**d) / d)
    top = e[:, :1].real
    w = np.where(np.abs(p.imag) < np.pi, np.exp(e - top) * u, 0).real
    integral = (w[:, 0] / 2 + w[:, 1:].sum(axis=1)) * 2 * step * p0 / np.pi
    return top[:, 0] + np.log(np.maximum(integral, 1e-300)) + _lgamma(c + 1) - _lgamma(t + 1)


def _of_few(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    out = np.ones(len(customers), np.int64)
    logs = recursion(int(customers.max(initial=1)), discount)
    order = np.argsort(customers, kind="stable")
    sizes, first = np.unique(customers[order], return_index=True)
    for c, a, b in zip(sizes.tolist(), first, np.r_[first[1:], len(order)], strict=True):
        for k in range(a, b, max(1, _CELLS // c)):
            some = order[k : min(b, k + max(1, _CELLS // c))]
            x = logs[c, 1 : c + 1] + np.log(weight[some])[:, None] * np.arange(1, c + 1)
            upto = np.cumsum(np.exp(x - x.max(axis=1, keepdims=True)), axis=1)
            out[some] = 1 + (upto < (rng.random(len(some)) * upto[:, -1])[:, None]).sum(axis=1)
    return out


def _of_many(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Metropolis steps whose proposals come from near the mode, whatever the number at hand."""
    c, a, d = customers.astype(float), weight, discount
    y = _solve(lambda y: np.log(-np.expm1(y)) + (d - 1) * y, np.log(c / a))
    mean = -a * np.expm1(d * y) / d
    with np.errstate(over="ignore"):
        spread = mean - c * c / (c + a * np.expm1(y) ** 2 * (1 - d) * np.exp((d - 2) * y))
    mean, scale = np.clip(mean, 1, c), 0.65 * np.sqrt(np.maximum(spread, 0.5))

    def merit(t: np.ndarray) -> np.ndarray:
        low, high = (t - 0.5 - mean) / scale, (t + 0.5 - mean) / scale
        proposed = np.log1p(-np.exp(low - high)) - low - np.logaddexp(0, -low) - np.logaddexp(0, -high)
        return t * np.log(a) + log_stirling(c, t, d) - proposed

    t = np.clip(np.rint(mean), 1, c)
    own = merit(t)
    for _ in range(STEPS):
        new = np.rint(mean + scale * rng.logistic(size=len(c)))
        valid = (new >= 1) & (new <= c)
        new = np.where(valid, new, t)
        its = merit(new)
        moved = valid & (np.log1p(-rng.random(len(c))) < its - own)
        t, own = np.where(moved, new, t), np.where(moved, its, own)
    return t.astype(np.int64)


def drawn(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes that have so many customers, where a new table has that weight."""
    out = np.ones(len(customers), np.int64)
    many = customers > SMALL
    for which, draw in ((~many, _of_few), (many, _of_many)):
        at = np.flatnonzero(which)
        for k in range(0, len(at), 1 << 13):
            some = at[k : k + (1 << 13)]
            out[some] = draw(customers[some], weight[some], discount, rng)
    return out
