"""One-dimensional cutting stock by column generation over a histogram of lengths.

Everything here works on counts per length class, so its size depends on the
capacity and the granularity alone, never on the number of documents.
"""

from __future__ import annotations

import numpy as np


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the best total value of pieces within ``capacity``, and the pieces' counts."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    use = np.flatnonzero(values > 1e-12)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fit = use[: np.searchsorted(sizes[use], c, side="right")]
        if len(fit):
            total = best[c - sizes[fit]] + values[fit]
            k = int(total.argmax())
            if total[k] > best[c] + 1e-15:
                best[c], pick[c] = total[k], fit[k]
    counts = np.zeros(len(sizes), np.int64)
    c = capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[capacity]), counts


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3, steps: int | None = None) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole multiplicities that cover ``demand`` pieces of each of the ascending ``sizes``.

    The linear program over patterns is solved by a revised simplex whose columns the
    knapsack prices, until the Farley bound proves it within ``gap`` of its optimum (or
    after ``steps`` columns, which costs padding only). Multiplicities are rounded
    down; what remains, fewer pieces than the patterns hold, is packed best fit
    decreasing. Returned counts sum to ``demand`` exactly for each size.
    """
    m = len(sizes)
    if not m:
        return []
    steps = steps or 40 * m
    patterns = [np.bincount([i], minlength=m) * max(1, capacity // int(sizes[i])) for i in range(m)]
    scale = np.array([patterns[i][i] for i in range(m)], float)
    inverse = np.diag(1 / scale)
    level = demand / scale
    for _ in range(steps):
        duals = inverse.sum(axis=0)
        value, column = price(duals, sizes, capacity)
        if value <= 1 + 1e-9 or level.sum() * (1 - 1 / value) <= gap * level.sum():
            break
        way = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(way > 1e-10, level / way, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        level = np.maximum(level - step * way, 0)
        level[out] = step
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
        patterns[out] = column
    found: list[tuple[np.ndarray, int]] = []
    left = demand.astype(np.int64).copy()
    for k in np.argsort(-level, kind="stable"):
        p = patterns[k]
        used = p > 0
        times = min(int(level[k] + 1e-9), int((left[used] // p[used]).min()))
        if times > 0:
            found.append((p, times))
            left -= times * p
    return found + best_fit(sizes, left, capacity)


def best_fit(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Best fit decreasing over counts: a bin takes the largest piece that fits, again and again; equal bins go at once."""
    left = counts.copy()
    found = []
    while left.any():
        room, p = capacity, np.zeros(len(sizes), np.int64)
        while True:
            fit = np.flatnonzero((left - p > 0) & (sizes <= room))
            if not len(fit):
                break
            i = int(fit[-1])
            k = min(int(left[i] - p[i]), room // int(sizes[i]))
            p[i] += k
            room -= k * int(sizes[i])
        used = p > 0
        times = int((left[used] // p[used]).min())
        found.append((p, times))
        left -= times * p
    return found
