"""Dependent steps as array scans: every function takes a number of array operations that grows with the logarithm of the length."""

from __future__ import annotations

import numpy as np


def affine_scan(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The compositions of the maps ``x -> a[i] * x + b[i]`` up to and with each i, as ``(a, b)``."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    s = 1
    while s < len(a):
        b = np.concatenate([b[:s], a[s:] * b[:-s] + b[s:]])
        a = np.concatenate([a[:s], a[s:] * a[:-s]])
        s *= 2
    return a, b


def last_of(nxt: np.ndarray) -> np.ndarray:
    """For each i the last member of the chain ``i, nxt[i], nxt[nxt[i]], ...``; the length stands for the end."""
    n = len(nxt)
    last, hop = np.arange(n), np.append(nxt, n)
    while (hop[:n] < n).any():
        some = hop[:n] < n
        last[some] = last[hop[:n][some]]
        hop = hop[hop]
    return last


def chain(nxt: np.ndarray, start: int) -> np.ndarray:
    """The members of the chain from ``start``, in order; the length stands for the end."""
    n = len(nxt)
    path, hop = np.array([start], np.int64), np.append(nxt, n)
    while path[-1] < n:
        path = np.concatenate([path, hop[path]])
        hop = hop[hop]
    return path[path < n]


def kalman_steps(p0: float, q: float, r: float, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gain and variance after ``n`` steps (1, 2, ...) of the scalar filter from variance ``p0``.

    The variance is moved by one fractional linear map, whose powers are known from its fixed points.
    """
    n = np.asarray(n, np.float64)
    if q == 0:
        p = r * p0 / (r + n * p0)
        before = r * p0 / (r + (n - 1) * p0)
    else:
        root = np.sqrt(q * q + 4 * q * r)
        high, low = 2 * q * r / (q + root), (-q - root) / 2
        u0 = (p0 - high) / (p0 - low)
        log = np.log1p(-(high - low) / (r - low))
        at = lambda k: (high - u0 * np.exp(k * log) * low) / (1 - u0 * np.exp(k * log))
        p, before = at(n), at(n - 1)
    return (before + q) / (before + q + r), p
