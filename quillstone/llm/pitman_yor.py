"""Seating in Chinese restaurants with discount: how many tables the customers of a dish sit at.

A restaurant is a context, a dish a word, a customer an occurrence.  With the sizes of tables summed out, t tables of a
dish with c customers have the weight

    S(c, t) * (s + d T) (s + d (T + 1)) ... (s + d (T + t - 1)) * p_0 p_1 ... p_(t - 1)

where T counts the restaurant's other tables, d is the discount, s the strength and S a generalised Stirling number:
S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t).  Every table is a customer of the parent, so with i of them there the
parent's probability of the dish is p_i = (m + i) / (M + i), where m and M leave these tables out; in a restaurant whose
parent is a fixed distribution it is m / M.  A Gibbs step draws t from these weights.
"""

from __future__ import annotations

import numpy as np

EXACT = 64  # customers up to which a draw is exact; beyond, more tables are drawn for those that follow
STEPS = 16


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0, by Stirling's series at x + 8."""
    x = np.asarray(x, float)
    below = sum(np.log(x + k) for k in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - below


def stirling_table(d: float, most: int = EXACT) -> np.ndarray:
    """log S(c, t) for 1 <= t <= c <= most; -inf elsewhere."""
    out = np.full((most + 1, most + 2), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, most + 1)
    with np.errstate(divide="ignore"):
        for c in range(1, most):
            stay = np.where(t <= c, np.log(np.maximum(c - d * t, 1e-300)), -np.inf)
            out[c + 1, 1 : most + 1] = np.logaddexp(out[c, :most], stay + out[c, 1 : most + 1])
    return out


def _more_tables(c, t, others, mass, whole, grows, d, strength, rng) -> np.ndarray:
    """t tables of the first EXACT customers -> tables of all c.

    Seated one after another, customer i of a dish opens a table with weight x = (s + d (T + t)) p beside i - d t for the
    tables there are; that those who follow ask for this dish too makes a new table ((i - d t) / (c - d t))^d times as
    likely.  On the scale of that factor new tables come at the even rate x / d, which is taken in STEPS parts.
    That they raise the parent's p for those that follow is left out: where the tables of one dish of one restaurant are a
    large part of the parent, too few are drawn (by a sixth for 32 tables beside 1,000 customers)."""
    x0 = ((EXACT - d * t) / (c - d * t)) ** d
    for _ in range(STEPS):
        x = (strength + d * (others + t)) * (mass + grows * t) / (whole + grows * t)
        t = t + rng.poisson(x / d * (1 - x0) / STEPS)
    return np.minimum(t, c)


def draw_tables(c: np.ndarray, others: np.ndarray, mass: np.ndarray, whole: np.ndarray, grows: bool, d: float, strength: float, rng: np.random.Generator, table: np.ndarray) -> np.ndarray:
    """A Gibbs step: for each dish with c >= 1 customers its number of tables given all other tables."""
    out = np.ones(len(c), np.int64)
    order = np.argsort(c, kind="stable")
    bounds = np.append(np.searchsorted(c[order], np.arange(1, EXACT + 1)), len(c))  # of rows with 1, 2, ... customers
    for k in range(2, EXACT + 1):
        for first in range(bounds[k - 1], bounds[k], 50_000):
            own = order[first : min(first + 50_000, bounds[k])]
            step = np.arange(k)
            p = (mass[own][:, None] + grows * step) / (whole[own][:, None] + grows * step)
            w = table[k, 1 : k + 1] + np.cumsum(np.log((strength + d * (others[own][:, None] + step)) * p), axis=1)
            if k == EXACT:  # what tables leave to the customers beyond
                left = d * np.arange(1, k + 1)
                w = w + log_gamma(c[own][:, None] - left) - log_gamma(k - left)
            w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            out[own] = 1 + (w < rng.random((len(own), 1)) * w[:, -1:]).sum(axis=1).clip(0, k - 1)
    many = order[bounds[EXACT - 1] :]
    if len(many):
        out[many] = _more_tables(c[many], out[many], others[many], mass[many], whole[many], grows, d, strength, rng)
    return out


def discount(ones: int, twos: int) -> float:
    """The usual estimate from how many dishes have one customer and two."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
