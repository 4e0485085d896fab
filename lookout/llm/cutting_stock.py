"""Cutting stock by column generation, on a histogram of sizes.

Minimise the number of bins of ``capacity`` units that hold ``demand[c]`` items of every size
class c.  The linear program over patterns starts from the patterns of first-fit decreasing; an
unbounded knapsack by dynamic programming prices the best new pattern with the program's dual
values, and a revised simplex step brings it into the basis until none pays.  The solution is
rounded down, and the few items left over are packed first-fit decreasing.

Everything here depends on the number of classes (at most ``capacity``), never on the items.
"""

from __future__ import annotations

import numpy as np

_EPS = 1e-9
#: The relaxation stops within this share of its optimum: the objective divided by the value
#: of the best new pattern is a lower bound.
_GAP = 1e-3
#: It also stops when so many rounds gain less than a tenth of that.
_STALL = 50


def _price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: an unbounded knapsack over the capacity."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fit = np.searchsorted(sizes, room, "right")
        best[room] = best[room - 1]
        if fit:
            gains = best[room - sizes[:fit]] + values[:fit]
            k = int(gains.argmax())
            if gains[k] > best[room] + _EPS:
                best[room], taken[room] = gains[k], k
    pattern = np.zeros(len(sizes))
    room = capacity
    while room > 0:
        k = taken[room]
        if k < 0:
            room -= 1
        else:
            pattern[k] += 1
            room -= sizes[k]
    return best[capacity], pattern


def _inverted(matrix: np.ndarray) -> np.ndarray:
    """Inverse by Gauss-Jordan elimination with row exchanges, in element-wise steps alone.

    The driver may have started its JVM by a fork after numpy was loaded, and numpy's threaded
    linear algebra can stand still after a fork; nothing in this module calls it.
    """
    m = len(matrix)
    work = np.concatenate([matrix, np.eye(m)], axis=1)
    for k in range(m):
        p = k + int(np.abs(work[k:, k]).argmax())
        work[[k, p]] = work[[p, k]]
        work[k] /= work[k, k]
        factors = work[:, k].copy()
        factors[k] = 0
        work -= factors[:, None] * work[k]
    return work[:, m:]


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (matrix * vector).sum(axis=1)


def _relaxation(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Basis patterns (a column each) and their fractional counts."""
    m = len(sizes)
    basis = _start(sizes, demand, capacity)
    inverse = _inverted(basis)
    before = np.inf
    for step in range(rounds):
        value, pattern = _price(inverse.sum(axis=0), sizes, capacity)
        if value <= 1 + _GAP:
            break
        count, direction = _times(inverse, demand), _times(inverse, pattern)
        if step % _STALL == 0:
            if before - count.sum() < _GAP / 10 * count.sum():
                break
            before = count.sum()
        ratio = np.full(m, np.inf)
        up = direction > _EPS
        ratio[up] = np.maximum(count[up], 0) / direction[up]
        out = int(ratio.argmin())
        basis[:, out] = pattern
        if step % 100 == 99:
            inverse = _inverted(basis)
        else:
            pivot = inverse[out] / direction[out]
            inverse -= direction[:, None] * pivot
            inverse[out] = pivot
    return basis, _times(_inverted(basis), demand)


def _greedy(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """First-fit decreasing by classes: fill a bin from the largest class down, repeat it while it fits."""
    out, left = [], left.copy()
    while left.any():
        pattern, room = np.zeros(len(sizes), np.int64), capacity
        for k in range(len(sizes) - 1, -1, -1):
            pattern[k] = min(left[k], room // sizes[k])
            room -= pattern[k] * sizes[k]
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        left -= pattern * times
        out.append((pattern, times))
    return out


def _start(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """A feasible basis: first-fit decreasing with fractional counts.

    Every pattern is repeated until it uses up a class, which no later pattern holds, so they are
    independent; a class that is used up beside another one gets a pattern of its own.
    """
    basis, left = np.diag((capacity // sizes).astype(float)), demand.copy()
    while (left > 0).any():
        pattern, room = np.zeros(len(sizes)), capacity
        for k in np.flatnonzero(left > 0)[::-1]:
            pattern[k] = room // sizes[k]
            room -= pattern[k] * sizes[k]
        used = np.flatnonzero(pattern)
        repeats = left[used] / pattern[used]
        out = used[repeats.argmin()]
        left[used] -= pattern[used] * repeats.min()
        left[left < _EPS * demand] = 0
        left[out] = 0
        basis[:, out] = pattern
    return basis


def solve(histogram: dict[int, int], capacity: int, rounds: int = 3000) -> list[tuple[dict[int, int], int]]:
    """Patterns {class: items} with the number of bins each fills; together they hold every item once."""
    sizes = np.array(sorted(c for c, n in histogram.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    if sizes[0] < 1 or sizes[-1] > capacity:
        raise ValueError(f"sizes must lie between 1 and the capacity {capacity}")
    demand = np.array([histogram[int(c)] for c in sizes], np.int64)
    basis, count = _relaxation(sizes, demand.astype(float), capacity, rounds)
    whole = np.floor(np.maximum(count, 0) + 1e-6).astype(np.int64)
    patterns = np.rint(basis).astype(np.int64)
    for p in range(len(whole)):  # rounding of the solver must never ask for more than there is
        used = patterns[:, p] > 0
        whole[p] = min(whole[p], int((demand[used] // patterns[used, p]).min()))
        demand = demand - patterns[:, p] * whole[p]
    chosen = [(patterns[:, p], int(whole[p])) for p in range(len(whole)) if whole[p] > 0]
    chosen += _greedy(sizes, demand, capacity)
    return [({int(sizes[k]): int(a[k]) for k in np.flatnonzero(a)}, n) for a, n in chosen]
