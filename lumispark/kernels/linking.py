"""Linking of points over frames with one-to-one assignment."""

from __future__ import annotations

import heapq

import numpy as np


def least_cost(edges: list[list[tuple[int, float]]], columns: int) -> list[int]:
    """Column of each row with the least total cost: shortest augmenting paths over sparse edges.

    edges: (column, cost >= 0) of each row, enough to give each row a column. A path is looked for only
    as far as the nearest free column, so the work follows the connected group that a row lies in.
    """
    u, v = [0.0] * len(edges), [0.0] * columns
    row_of, column_of = [-1] * columns, [-1] * len(edges)
    for first in range(len(edges)):
        far: dict[int, float] = {}
        came: dict[int, int] = {}
        done: set[int] = set()
        heap: list[tuple[float, int]] = []
        row, base, scanned = first, 0.0, []
        while True:
            scanned.append((row, base))
            for j, cost in edges[row]:
                if j not in done and (d := base + cost - u[row] - v[j]) < far.get(j, np.inf):
                    far[j], came[j] = d, row
                    heapq.heappush(heap, (d, j))
            base, j = heapq.heappop(heap)
            while j in done:
                base, j = heapq.heappop(heap)
            if row_of[j] < 0:
                break
            done.add(j)
            row = row_of[j]
        for r, d in scanned:
            u[r] += base - d
        for k in done:
            v[k] -= base - far[k]
        row = -1
        while row != first:
            row = came[j]
            row_of[j], column_of[row], j = row, j, column_of[row]
    return column_of


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row with the least total cost (rows <= columns)."""
    return np.array(least_cost([list(enumerate(row)) for row in cost.tolist()], cost.shape[1]), int)


def _near(old: np.ndarray, new: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index in old, index in new, squared distance) of the pairs within reach, by a sort on the widest axis."""
    axis = int(np.ptp(np.nan_to_num(new), axis=0).argmax())
    order = np.argsort(new[:, axis], kind="stable")
    lane, at = new[order, axis], old[:, axis]
    slack = reach + 1e-9 * (reach + np.abs(np.nan_to_num(at)))  # the distances below decide
    begins, ends = np.searchsorted(lane, at - slack, "left"), np.searchsorted(lane, at + slack, "right")
    many = ends - begins
    a = np.repeat(np.arange(len(old)), many)
    b = order[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - begins, many)]
    far = ((old[a] - new[b]) ** 2).sum(axis=1)
    close = far <= reach * reach
    return a[close], b[close], far[close]


def chosen(a: list[int], b: list[int], cost: list[float], missing: float) -> list[tuple[int, int]]:
    """Of candidate pairs (a, b >= 0) the one-to-one choice with the least total cost, an a without a pair costing `missing`."""
    edges: dict[int, list[tuple[int, float]]] = {}
    for i, j, c in zip(a, b, cost):
        edges.setdefault(i, []).append((j, c))
    wide = max(b, default=-1) + 1
    rows = list(edges)
    # a column of its own beyond those of b is a row's missing link
    columns = least_cost([[*edges[i], (wide + k, missing)] for k, i in enumerate(rows)], wide + len(rows))
    return [(i, j) for i, j in zip(rows, columns) if j < wide]


def match(old: np.ndarray, new: np.ndarray, reach: float) -> list[tuple[int, int]]:
    """One-to-one pairs within reach with the least sum of squares, a missing link costing reach squared."""
    if not len(old) or not len(new):
        return []
    return chosen(*(x.tolist() for x in _near(old, new, reach)), reach * reach * 1.0)


def link(frames: np.ndarray, points: np.ndarray, reach: float = 20.0, memory: int = 2) -> np.ndarray:
    """Particle number of each point: points of a frame are matched with the last points of particles
    seen within memory + 1 frames before it; the unmatched begin particles."""
    out = np.full(len(frames), -1)
    live: list[tuple[int, int, np.ndarray]] = []  # (particle, frame, point)
    count = 0
    for frame in np.unique(frames).tolist():
        here = np.flatnonzero(frames == frame)
        live = [x for x in live if frame - x[1] <= memory + 1]
        pairs = match(np.array([x[2] for x in live]).reshape(-1, points.shape[1]), points[here], reach)
        for a, b in pairs:
            out[here[b]] = live[a][0]
        for k in here[out[here] < 0]:
            out[k] = count
            count += 1
        seen = {live[a][0] for a, _ in pairs}
        live = [x for x in live if x[0] not in seen] + [(int(out[k]), frame, points[k]) for k in here]
    return out
