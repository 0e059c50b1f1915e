"""Cutting stock by column generation, on a histogram of lengths."""

from collections import Counter

import numpy as np


def patterns(
    counts: dict[int, int], capacity: int, gap: float = 0.0005
) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Patterns, each a number of pieces by length, how often to use them, and the
    pieces of each length that are left.

    ``counts``: pieces by length, 1 to ``capacity``. The linear program minimises the
    sequences used; a knapsack by dynamic programming prices the next column from the
    duals, until the program is within ``gap`` of its optimum. Its solution is rounded
    down, so less than one use of each of its patterns, one for a length, is left.
    """
    lengths = np.array(sorted(k for k, n in counts.items() if n > 0), int)
    if not len(lengths):
        return [], {}
    columns, uses = _solve(lengths, np.array([counts[k] for k in lengths], float), capacity, gap)
    left, found = Counter({int(k): counts[k] for k in lengths}), []
    for column, x in zip(columns.T, uses, strict=True):
        pattern = {int(k): int(a) for k, a in zip(lengths, column, strict=True) if a > 0}
        times = min(int(x + 1e-6), *(left[k] // a for k, a in pattern.items()))
        if times > 0:
            found.append((pattern, times))
            left.subtract({k: a * times for k, a in pattern.items()})
    return found, {k: n for k, n in left.items() if n > 0}


def _solve(lengths: np.ndarray, need: np.ndarray, capacity: int, gap: float):
    """Columns of the last basis, and how often each is used."""
    m = len(lengths)
    each = capacity // lengths
    columns = np.diag(each).astype(float)
    inverse = np.diag(1.0 / each)
    uses = need / each
    for _ in range(10 * m + 100):
        duals = inverse.sum(axis=0)
        worth, column = _knapsack(lengths, duals, capacity)
        if worth <= 1 + gap:  # the duals over it bound the optimum from below
            break
        step = inverse @ column
        able = step > 1e-9
        ratios = np.full(m, np.inf)
        ratios[able] = np.maximum(uses[able], 0) / step[able]
        out = int(np.argmin(ratios))
        if not np.isfinite(ratios[out]):
            break
        uses -= ratios[out] * step
        uses[out] = ratios[out]
        columns[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    return columns, uses


def _knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(lengths[0]), capacity + 1):
        fit = int(np.searchsorted(lengths, room, side="right"))
        gain = best[room - lengths[:fit]] + values[:fit]
        k = int(np.argmax(gain))
        if gain[k] > best[room - 1]:
            best[room], last[room] = gain[k], k
        else:
            best[room] = best[room - 1]
    column, room = np.zeros(len(lengths)), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            column[last[room]] += 1
            room -= int(lengths[last[room]])
    return float(best[capacity]), column
