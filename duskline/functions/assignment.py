"""Exact one-to-one assignment on the small matrices left after edges are gated.

Most pairs first, then the largest total weight, both exactly: float weights are compared as whole numbers.
"""

from __future__ import annotations

import heapq

import numpy as np


Edge = tuple[int, int, float]


def _costs(edges: list[Edge]) -> list[int]:
    """The weights' negatives as whole numbers on one common scale, so sums compare exactly."""
    ratios = [float(w).as_integer_ratio() for *_, w in edges]
    scale = max(den for _, den in ratios)
    return [-num * (scale // den) for num, den in ratios]


def _fill(edges: list[Edge], cost: list[int] | None = None) -> list[int]:
    """Numbers of the edges chosen in one connected group, by successive cheapest paths over the edges themselves.

    Each round looks for the cheapest way from any free row to a free column, going back over chosen edges, and turns it
    over: one pair more, at the least total cost that this many pairs allow. It ends when no free column can be reached.
    Node potentials keep the remaining costs from being negative, so a heap finds the way.
    """
    cost = _costs(edges) if cost is None else cost
    out: dict[int, list[int]] = {}
    for n, (r, _, _) in enumerate(edges):
        out.setdefault(r, []).append(n)
    lift = {("r", r): max(-cost[n] for n in at) for r, at in out.items()}
    ceiling = max(lift.values())
    lift.update({("c", c): 0 for _, c, _ in edges})
    row_pair: dict[int, int] = {}
    col_pair: dict[int, int] = {}
    while True:
        far = {("r", r): ceiling - lift["r", r] for r in out if r not in row_pair}
        came: dict[tuple, int] = {}
        heap = [(d, v) for v, d in far.items()]
        heapq.heapify(heap)
        while heap:
            d, v = heapq.heappop(heap)
            if d > far[v]:
                continue
            if v[0] == "r":
                ways = [(("c", edges[n][1]), cost[n], n) for n in out[v[1]] if row_pair.get(v[1]) != n]
            else:
                n = col_pair.get(v[1])
                ways = [] if n is None else [(("r", edges[n][0]), -cost[n], n)]
            for to, price, n in ways:
                there = d + price + lift[v] - lift[to]
                if to not in far or there < far[to]:
                    far[to], came[to] = there, n
                    heapq.heappush(heap, (there, to))
        goals = [(d + lift[v], v) for v, d in far.items() if v[0] == "c" and v[1] not in col_pair]
        if not goals:
            return list(row_pair.values())
        at = min(goals)[1]
        for v, d in far.items():
            lift[v] += d
        ceiling = max(lift["r", r] for r in out)
        # Turn the way over, from its column back to the free row.
        while True:
            n = came[at]
            row, col = edges[n][:2]
            before = row_pair.get(row)
            row_pair[row], col_pair[col] = n, n
            if before is None:
                break
            at = ("c", edges[before][1])


def best_of(edges: list[Edge]) -> list[int]:
    """Numbers of the edges chosen in one connected group. Around one row or column it is the heaviest, ties to the first."""
    if len(edges) == 1:
        return [0]
    r, c, w = edges[0]
    if len(edges) == 2 and (r == edges[1][0] or c == edges[1][1]):
        return [0 if w >= edges[1][2] else 1]
    if all(e[0] == r for e in edges) or all(e[1] == c for e in edges):
        return [max(range(len(edges)), key=lambda n: edges[n][2])]
    if len(edges) == 4 and len({e[0] for e in edges}) == 2 == len({e[1] for e in edges}):
        # Two rows and two columns, all joined: two ways; where rounding could tell wrong the weights decide as whole numbers.
        here = [n for n, e in enumerate(edges) if (e[0] == r) == (e[1] == c)]
        there = [n for n in range(4) if n not in here]
        more, less = (edges[i][2] + edges[j][2] for i, j in (here, there))
        if abs(more - less) > 1e-9 * (abs(more) + abs(less)):
            return here if more > less else there
    return _fill(edges)


def is_only_best(edges: list[Edge], chosen: list[int]) -> bool:
    """Whether no other choice in the group has as many pairs and the same total: chosen edges are made dearer by less
    than any difference between totals, so another choice as good would now win."""
    if len(edges) == 1:
        return True
    r, c, _ = edges[0]
    if all(e[0] == r for e in edges) or all(e[1] == c for e in edges):
        top = edges[chosen[0]][2]
        return sum(w == top for *_, w in edges) == 1
    mine = set(chosen)
    dearer = [cost * (len(edges) + 1) + (n in mine) for n, cost in enumerate(_costs(edges))]
    return set(_fill(edges, dearer)) == mine


def assign_edges(edges: list[Edge]) -> list[tuple[int, int]]:
    """Pairs (row, column) out of weighted edges: as many as possible, then the largest total weight, both exactly."""
    if apart(edges):
        return sorted([e[:2] for e in edges])
    return sorted(group[n][:2] for group in connected(edges) for n in best_of(group))


def apart(edges: list[Edge]) -> bool:
    """Whether no two edges share a row or a column."""
    return len(edges) < 2 or len({e[0] for e in edges}) == len(edges) == len({e[1] for e in edges})


def connected(edges: list[Edge]) -> list[list[Edge]]:
    """Edges that share no row or column, directly or through others, are solved apart."""
    if len(edges) < 2:
        return [edges] if edges else []
    edges = sorted(edges)
    if apart(edges):
        return [[e] for e in edges]
    of_row: dict[int, list[Edge]] = {}
    of_col: dict[int, list[Edge]] = {}
    for e in edges:
        r, c, _ = e
        one, other = of_row.get(r), of_col.get(c)
        if one is None:
            one = [] if other is None else other
        elif other is not None and other is not one:
            if len(one) < len(other):
                one, other = other, one
            for x in other:
                of_row[x[0]] = of_col[x[1]] = one
            one += other
        one.append(e)
        of_row[r] = of_col[c] = one
    groups = list({id(g): g for g in of_row.values()}.values())
    for g in groups:
        g.sort()
    return groups


def assign(weights: np.ndarray, valid: np.ndarray) -> list[tuple[int, int]]:
    r, c = np.nonzero(valid)
    return assign_edges(list(zip(r.tolist(), c.tolist(), weights[r, c].tolist())))


def match_most(choices: list[list[int]], order: list[int]) -> dict[int, int]:
    """Maximum pairing without weights: ``choices[i]`` lists i's options best first; returns option -> i.

    Rows are placed in ``order``; a placed row moves to another of its options when that frees one.
    """
    taken: dict[int, int] = {}
    for first in order:
        came: dict[int, tuple[int, int | None]] = {}
        stack = [(first, None, iter(choices[first]))]
        while stack:
            row, _, options = stack[-1]
            option = next((o for o in options if o not in came), None)
            if option is None:
                stack.pop()
                continue
            came[option] = (row, stack[-1][1])
            holder = taken.get(option)
            if holder is not None:
                stack.append((holder, option, iter(choices[holder])))
                continue
            while option is not None:
                row, freed = came[option]
                taken[option] = row
                option = freed
            break
    return taken


def iou_pair(a, b) -> float:
    w = (a[2] if a[2] < b[2] else b[2]) - (a[0] if a[0] > b[0] else b[0])
    if w <= 0:
        return 0.0
    h = (a[3] if a[3] < b[3] else b[3]) - (a[1] if a[1] > b[1] else b[1])
    if h <= 0:
        return 0.0
    inter = w * h
    return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)


SMALL = 400


def iou_edges(a: list, b: list, least: float) -> list[Edge]:
    """(i, j, IoU) of the pairs reaching ``least``; arrays only pay off on crowded frames."""
    if len(a) * len(b) <= SMALL:
        return [(i, j, v) for i, p in enumerate(a) for j, q in enumerate(b) if (v := iou_pair(p, q)) >= least]
    w = iou_matrix(np.array(a, dtype=float), np.array(b, dtype=float))
    r, c = np.nonzero(w >= least)
    return list(zip(r.tolist(), c.tolist(), w[r, c].tolist()))


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of every box in ``a`` (n, 4) with every box in ``b`` (m, 4)."""
    left, top = np.maximum(a[:, None, 0], b[None, :, 0]), np.maximum(a[:, None, 1], b[None, :, 1])
    right, bottom = np.minimum(a[:, None, 2], b[None, :, 2]), np.minimum(a[:, None, 3], b[None, :, 3])
    inter = (right - left) * (bottom - top)
    size_a = (a[:, 2] - a[:, 0]) * (a[:, 3] - a[:, 1])
    size_b = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        out = inter / (size_a[:, None] + size_b[None, :] - inter)
    return np.where((right <= left) | (bottom <= top), 0.0, out)
