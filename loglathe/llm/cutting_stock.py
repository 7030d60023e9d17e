"""Cutting stock by column generation: which lengths share a roll, for a histogram of lengths."""

from __future__ import annotations

import numpy as np

#: Patterns that are generated at most.  What a stop there leaves is only a little more waste.
ROUNDS = 1500
_EPS = 1e-9


def _best_pattern(values: np.ndarray, size: int) -> np.ndarray:
    """Unbounded knapsack: how often each length 1..n goes into a roll of ``size`` for the highest sum of values."""
    n = len(values)
    best, last = np.zeros(size + 1), [0] * (size + 1)
    for room in range(1, size + 1):
        gains = values[:room] + best[max(0, room - n) : room][::-1]
        k = gains.argmax()
        if gains[k] > best[room - 1] + _EPS:
            best[room], last[room] = gains[k], int(k) + 1
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(n, np.int64), size
    while room > 0:
        if last[room]:
            pattern[last[room] - 1] += 1
        room -= last[room] or 1
    return pattern


def _relaxed(demand: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Basic solution of the linear program: patterns (one a column) and how often each is cut, not rounded."""
    n = len(demand)
    fit = size // np.arange(1, n + 1)
    columns = np.diag(fit).astype(float)
    inverse = np.diag(1.0 / fit)
    amounts = demand / fit
    for _ in range(ROUNDS):
        prices = inverse.sum(axis=0)
        pattern = _best_pattern(np.where(demand > 0, prices, 0.0), size)
        if prices @ pattern <= 1 + 1e-7:
            break
        change = inverse @ pattern
        able = change > _EPS
        ratio = np.full(n, np.inf)
        ratio[able] = amounts[able] / change[able]
        out = int(np.argmin(ratio))
        step = ratio[out]
        amounts = amounts - step * change
        amounts[out] = step
        row = inverse[out] / change[out]
        inverse -= np.outer(change, row)
        inverse[out] = row
        columns[:, out] = pattern
    return columns.astype(np.int64), np.maximum(amounts, 0)


def patterns(demand: list[int], size: int) -> list[tuple[int, dict[int, int]]]:
    """``(times, {length: copies})`` that together hold exactly ``demand[i]`` pieces of length ``i + 1``.

    A roll is ``size`` long, at least as long as any piece.  The linear program's amounts are rounded down; the few
    pieces that this leaves, at most a roll for each pattern, go longest first into the roll where they leave least room.
    """
    wanted = np.array(demand, np.int64)
    out, rest = [], wanted.copy()
    if len(wanted) == size:  # pieces as long as a roll
        if wanted[-1]:
            out.append((int(wanted[-1]), {size: 1}))
        wanted, rest = wanted[:-1], rest[:-1]
    if not wanted.any():
        return out
    last = int(np.flatnonzero(wanted)[-1]) + 1
    columns, amounts = _relaxed(wanted[:last].astype(float), size)
    for j in np.argsort(-amounts, kind="stable"):
        column = columns[:, j]
        used = np.flatnonzero(column)
        times = int(min(np.floor(amounts[j] + 1e-6), (rest[used] // column[used]).min()))
        if times > 0:
            rest[used] -= times * column[used]
            out.append((times, {int(i) + 1: int(column[i]) for i in used}))
    by_room: dict[int, list[dict[int, int]]] = {}
    for length in range(last, 0, -1):
        for _ in range(int(rest[length - 1])):
            room = next((r for r in range(length, size + 1) if by_room.get(r)), None)
            roll = by_room[room].pop() if room is not None else {}
            roll[length] = roll.get(length, 0) + 1
            by_room.setdefault((size if room is None else room) - length, []).append(roll)
    return out + [(1, roll) for rolls in by_room.values() for roll in rolls]
