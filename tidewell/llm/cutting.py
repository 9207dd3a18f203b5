"""The cutting-stock problem by column generation, for pieces of whole widths and stock of one width.

The linear program chooses how often each pattern (a multiset of widths that fits into the stock) is used so that every
width is supplied as often as it is demanded with the fewest stocks. Patterns are generated as needed: a knapsack over
the prices of the current basis finds the pattern that saves most, until none saves more than ``gap``. The size of the
program depends on the number of widths only, not on the demand.
"""

from __future__ import annotations

import numpy as np

Pattern = tuple[tuple[int, int], ...]  # (width, how many), widest first


def knapsack(widths: np.ndarray, prices: np.ndarray, stock: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern by dynamic programming over used width."""
    best, last = np.zeros(stock + 1), np.full(stock + 1, -1)
    narrow = np.searchsorted(widths, np.arange(stock + 1), side="right")  # widths are in ascending order
    for c in range(1, stock + 1):
        k = narrow[c]
        best[c] = best[c - 1]
        if k:
            value = best[c - widths[:k]] + prices[:k]
            i = int(value.argmax())
            if value[i] > best[c]:
                best[c], last[c] = value[i], i
    count, c = np.zeros(len(widths)), stock
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            count[last[c]] += 1
            c -= widths[last[c]]
    return float(best[stock]), count


def fullest(widths: list[int], left: list[int], room: int) -> list[int]:
    """How many of each width fill ``room`` as far as possible; reachable sums are bits of whole numbers."""
    every, layers = (1 << (room + 1)) - 1, []
    reach = 1
    for w, n in zip(widths, left, strict=True):
        layers.append(reach)
        n, step = min(n, room // w), 1
        while n > 0 and reach >> room & 1 == 0:
            k = min(step, n)
            reach |= reach << (w * k) & every
            n, step = n - k, step * 2
    c, take = reach.bit_length() - 1, [0] * len(widths)
    for i in range(len(widths) - 1, -1, -1):
        while c and not layers[i] >> c & 1:
            c -= widths[i]
            take[i] += 1
    return take


def first_basis(widths: np.ndarray, demand: np.ndarray, stock: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns filled widest first, each used until one of its widths is supplied.

    A pattern holds no width supplied before it, so the patterns, each in the place of the width that it ends, are a
    triangular basis; widths that end together with another one keep a pattern of their own that isn't used.
    """
    columns = np.diag((stock // widths).astype(float))
    used, left = np.zeros(len(widths)), demand.astype(float)
    while (left > 1e-9).any():
        open_ = np.flatnonzero(left > 1e-9)
        widest = open_[-1]
        take = np.zeros(len(widths))
        take[widest] = 1
        room = int(stock - widths[widest])
        few = [int(k) for k in open_ if widths[k] <= room]
        most = [int(max(1, left[k] - (k == widest))) for k in few]
        for k, n in zip(few, fullest([int(widths[k]) for k in few], most, room), strict=True):
            take[k] += n
        inside = np.flatnonzero(take)
        share = left[inside] / take[inside]
        r = inside[share.argmin()]
        columns[:, r], used[r] = take, share.min()
        left = np.maximum(left - share.min() * take, 0)
        left[r] = 0
    return columns, used


def fractional(widths: np.ndarray, demand: np.ndarray, stock: int, gap: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, how often each is used), within ``gap`` of the least sum; revised simplex."""
    columns, used = first_basis(widths, demand, stock)
    inverse = np.linalg.inv(columns)
    bound = float(widths @ demand) / stock
    for i in range(rounds):
        if used.sum() <= bound * (1 + gap):
            break
        prices = np.maximum(inverse.sum(0), 0)
        value, column = knapsack(widths, prices, stock)
        bound = max(bound, float(prices @ demand) / max(value, 1.0))
        if value <= 1 + 1e-6:
            break
        move = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            room = np.where(move > 1e-6, used / move, np.inf)
        r = int(np.where(room <= room.min() + 1e-9, move, 0).argmax())  # among ties the safest pivot
        columns[:, r] = column
        used -= room[r] * move
        used[r] = room[r]
        pivot = inverse[r] / move[r]
        inverse -= np.outer(move, pivot)
        inverse[r] = pivot
        if i % 100 == 99:  # rounding errors don't add up
            inverse = np.linalg.inv(columns)
            used = np.maximum(inverse @ demand, 0)
    return columns, np.maximum(used, 0)


def patterns(demand: dict[int, int], stock: int, *, gap: float = 2e-3, rounds: int = 600) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used; together they supply the demand exactly.

    The program's solution is rounded down. What is left is packed pattern by pattern: the widest piece left, then what
    fills the rest of the stock best.
    """
    widths = np.array(sorted(w for w, n in demand.items() if n > 0), np.int64)
    if not len(widths):
        return []
    left = np.array([demand[int(w)] for w in widths], np.int64)
    columns, used = fractional(widths, left.astype(float), stock, gap, rounds)
    out: dict[Pattern, int] = {}
    for j in np.argsort(-used, kind="stable"):
        own = np.round(columns[:, j]).astype(np.int64)
        n = int(used[j] + 1e-9)
        if n and own.any():
            n = min(n, int((left[own > 0] // own[own > 0]).min()))
        if n > 0 and own.any():
            left -= n * own
            key = tuple((int(widths[i]), int(own[i])) for i in np.flatnonzero(own)[::-1])
            out[key] = out.get(key, 0) + n
    while left.any():
        i = int(np.flatnonzero(left)[-1])
        take = np.zeros(len(widths), np.int64)
        take[i] = 1
        rest = left - take
        few = [k for k in range(len(widths)) if rest[k] and widths[k] <= stock - widths[i]]
        for k, n in zip(few, fullest([int(widths[k]) for k in few], [int(rest[k]) for k in few], int(stock - widths[i])), strict=True):
            take[k] += n
        times = int((left[take > 0] // take[take > 0]).min())
        left -= times * take
        key = tuple((int(widths[k]), int(take[k])) for k in np.flatnonzero(take)[::-1])
        out[key] = out.get(key, 0) + times
    return sorted(out.items(), reverse=True)
