"""Roots of many polynomials at once, by the iteration of Aberth and Ehrlich."""

from __future__ import annotations

import numpy as np

#: Steps at most; a simple root takes a dozen, roots that meet take more and are then known to fewer digits.
STEPS = 500


def _values(c: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values and derivatives at z by Horner's rule, and bounds of the values' rounding errors."""
    p, d = np.broadcast_to(c[:, :1], z.shape).astype(complex), np.zeros(z.shape, complex)
    bound, size = np.abs(p), np.abs(z)
    for k in range(1, c.shape[1]):
        d = d * z + p
        p = p * z + c[:, k : k + 1]
        bound = bound * size + np.abs(p)
    return p, d, bound * np.finfo(float).eps * 2


def _starts(c: np.ndarray) -> np.ndarray:
    """Points on circles whose radii the upper hull of the coefficients' logarithms gives (Bini)."""
    n = c.shape[1] - 1
    with np.errstate(divide="ignore"):
        heights = np.log(np.abs(c[:, ::-1]))  # of ascending degrees
    out = np.empty((len(c), n), complex)
    for row, h in enumerate(heights):
        hull: list[int] = []
        for k in np.flatnonzero(np.isfinite(h)).tolist():
            while len(hull) > 1 and (h[hull[-1]] - h[hull[-2]]) * (k - hull[-1]) <= (h[k] - h[hull[-1]]) * (hull[-1] - hull[-2]):
                hull.pop()
            hull.append(k)
        for a, b in zip(hull, hull[1:], strict=False):
            radius = np.exp((h[a] - h[b]) / (b - a))
            turns = np.arange(b - a) / (b - a) + a / n + 0.11
            out[row, a:b] = radius * np.exp(2j * np.pi * turns)
    return out


def aberth(c: np.ndarray) -> np.ndarray:
    """Roots of polynomials in rows, the highest degree first, whose first and last coefficients aren't 0.

    Each root moves by Newton's step, corrected for where the others are, until its value is within
    rounding of 0 or it stays.
    """
    n = c.shape[1] - 1
    z = _starts(c)
    moving = np.ones(z.shape, bool)
    for _ in range(STEPS):
        rows = np.flatnonzero(moving.any(axis=1))
        if not len(rows):
            break
        x = z[rows]
        p, d, bound = _values(c[rows], x)
        gaps = x[:, :, None] - x[:, None, :]
        gaps[:, np.arange(n), np.arange(n)] = np.inf
        gaps[gaps == 0] = np.finfo(float).tiny
        with np.errstate(all="ignore"):
            newton = p / d
            step = newton / (1 - newton * (1 / gaps).sum(axis=2))
        stuck = ~np.isfinite(step)
        step[stuck] = 0.01 * (1 + np.abs(x[stuck])) * np.exp(1j * np.arange(stuck.sum()))
        done = (np.abs(p) <= bound) | (np.abs(step) <= 4 * np.finfo(float).eps * np.abs(x)) & ~stuck
        z[rows] = np.where(moving[rows] & (np.abs(p) > 0), x - step, x)
        moving[rows] &= ~done
    return z


def all_roots(c: np.ndarray) -> np.ndarray:
    """Roots of polynomials in rows, all those of 0 among them."""
    if c.shape[1] < 2:
        raise ValueError("a constant has no roots")
    if (c[:, 0] == 0).any():
        raise ValueError("the leading coefficient is 0")
    n = c.shape[1] - 1
    out = np.zeros((len(c), n), complex)
    last = n - (c[:, ::-1] != 0).argmax(axis=1)  # the degree of what is left when roots of 0 are taken out
    for degree in np.unique(last).tolist():
        rows = last == degree
        if degree:
            out[rows, :degree] = aberth(c[rows, : degree + 1].astype(complex))
    return out
