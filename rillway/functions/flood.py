"""Filling of one grid, in rounds of whole-array steps rather than cell by cell.

Every cell points to the lowest of its neighbours, which splits the grid into basins; then
each closed group of basins joins the one over its lowest pass, until water can leave all of
them. A basin's level is the highest pass that its groups had to rise over. Grids have NaN
outside.
"""

from __future__ import annotations

import numpy as np

from rillway.functions.kernels import STEPS


def shifted(grid: np.ndarray, dr: int, dc: int, beyond: float = np.nan) -> np.ndarray:
    """For each cell what the neighbour ``dr`` rows and ``dc`` columns away holds."""
    rows, cols = grid.shape
    return np.pad(grid, 1, constant_values=beyond)[1 + dr : 1 + dr + rows, 1 + dc : 1 + dc + cols]


def jump(pointer: np.ndarray) -> np.ndarray:
    """Where chains of pointers end; an end points to itself."""
    while True:
        far = pointer[pointer]
        if (far == pointer).all():
            return pointer
        pointer = far


def basins(grid: np.ndarray) -> np.ndarray:
    """For each cell the flat place of the cell where its water comes to rest, -1 outside. Of equal heights the first place is lower."""
    place = np.arange(grid.size).reshape(grid.shape)
    low, to = np.where(np.isnan(grid), np.inf, grid), place.copy()
    for dr, dc in STEPS:
        z, at = shifted(grid, dr, dc, np.inf), shifted(place, dr, dc, -1)
        z = np.where(np.isnan(z), np.inf, z)
        better = (z < low) | ((z == low) & (at < to) & (at >= 0))
        low, to = np.where(better, z, low), np.where(better, at, to)
    return np.where(np.isnan(grid), -1, jump(np.where(np.isnan(grid), place, to).ravel()).reshape(grid.shape))


def passes(grid: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lowest pass between each two basins that touch: both labels, and its height."""
    found = []
    for dr, dc in STEPS[:4]:
        z, other = shifted(grid, dr, dc), shifted(label, dr, dc, -1)
        meet = (label >= 0) & (other >= 0) & (label != other)
        a, b = label[meet], other[meet]
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b), np.maximum(grid[meet], z[meet])]))
    return lowest(*np.concatenate(found, axis=1))


def lowest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the passes between the same two only the lowest."""
    order = np.lexsort((w, b, a))
    a, b, w = a[order].astype(np.int64), b[order].astype(np.int64), w[order]
    first = np.ones(len(a), dtype=bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[first], b[first], w[first]


def settle(n: int, is_open: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` nodes the level that it rises to, and the group that it ends in; groups with an open node rise no further.

    In each round every closed group joins its neighbour over its lowest pass; of equal passes
    the first by ends is lower, so two groups at most choose one another.
    """
    order = np.lexsort((b, a, w))
    a, b, w = a[order], b[order], w[order]
    group, level, open_ = np.arange(n), np.full(n, -np.inf), is_open.copy()
    while True:
        ga, gb = group[a], group[b]
        apart = ga != gb
        a, b, w, ga, gb = a[apart], b[apart], w[apart], ga[apart], gb[apart]
        best, rank = np.full(n, -1), np.arange(len(w))[::-1]
        # The passes are in order, so what is put last is the lowest.
        both, ranks = np.stack([ga[::-1], gb[::-1]], axis=1).ravel(), np.repeat(rank, 2)
        best[both] = ranks
        joins = np.flatnonzero((best >= 0) & ~open_)
        if not len(joins):
            return level, group
        to, rise = np.arange(n), np.full(n, -np.inf)
        to[joins] = np.where(ga[best[joins]] == joins, gb[best[joins]], ga[best[joins]])
        rise[joins] = w[best[joins]]
        level = np.maximum(level, rise[group])
        mutual = joins[(to[to[joins]] == joins) & (joins < to[joins])]
        to[mutual] = mutual
        to = jump(to)
        group = to[group]
        reached = np.zeros(n, dtype=bool)
        reached[to[open_]] = True
        open_ = reached


def at_edge(grid: np.ndarray) -> np.ndarray:
    """Cells that lack one of their eight neighbours."""
    there = ~np.isnan(grid)
    inner = np.logical_and.reduce([shifted(there, dr, dc, False) for dr, dc in STEPS])
    return there & ~inner


def fill(grid: np.ndarray) -> np.ndarray:
    """Every cell raised to the lowest level over which its water can leave the grid."""
    label, edge = basins(grid), at_edge(grid)
    names, node = np.unique(label[label >= 0], return_inverse=True)
    if not len(names):
        return grid.copy()
    a, b, w = passes(grid, label)
    index = np.full(grid.size, -1)
    index[names] = np.arange(len(names))
    out = np.full(len(names), len(names))
    ea, ez = index[label[edge]], grid[edge]
    a, b, w = lowest(np.concatenate([index[a], ea]), np.concatenate([index[b], out[ea]]), np.concatenate([w, ez]))
    is_open = np.zeros(len(names) + 1, dtype=bool)
    is_open[-1] = True
    level, _ = settle(len(names) + 1, is_open, a, b, w)
    filled = grid.copy()
    filled[label >= 0] = np.maximum(grid[label >= 0], level[node])
    return filled


def fill_open(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A tile among others: heights raised as far as it alone decides, each cell's group, and the passes between groups.

    A group is named by the flat place of one of its cells. Every group reaches the tile's edge;
    how far it rises beyond the heights that are returned, the other tiles decide.
    """
    label, edge = basins(grid), at_edge(grid)
    names, node = np.unique(label[label >= 0], return_inverse=True)
    index = np.full(grid.size, -1)
    index[names] = np.arange(len(names))
    a, b, w = passes(grid, label)
    a, b = index[a], index[b]
    is_open = np.zeros(len(names), dtype=bool)
    is_open[index[label[edge]]] = True
    level, group = settle(len(names), is_open, a, b, w)
    filled, groups = grid.copy(), np.full(grid.shape, -1)
    filled[label >= 0] = np.maximum(grid[label >= 0], level[node])
    groups[label >= 0] = names[group[node]]
    ga, gb = group[a], group[b]
    apart = ga != gb
    x, y = np.minimum(ga, gb)[apart], np.maximum(ga, gb)[apart]
    x, y, w = lowest(x, y, w[apart])
    return filled, groups, (names[x], names[y], w)


def flat_steps(filled: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Steps over cells of equal height to where the nearest of them drains; ``start`` has what is known, -1 elsewhere.

    All cells of a front step at once; a front may begin with unequal steps, as those that come from other tiles do.
    """
    rows, cols = filled.shape
    flat, steps = filled.ravel(), np.where(start < 0, np.iinfo(np.int64).max, start.astype(np.int64)).ravel()
    front = np.flatnonzero(start.ravel() >= 0)
    while front.size:
        r, c = front // cols, front % cols
        reached = []
        for dr, dc in STEPS:
            ok = (r + dr >= 0) & (r + dr < rows) & (c + dc >= 0) & (c + dc < cols)
            src = front[ok]
            to = src + dr * cols + dc
            better = (flat[to] == flat[src]) & (steps[src] + 1 < steps[to])
            src, to = src[better], to[better]
            np.minimum.at(steps, to, steps[src] + 1)
            reached.append(to)
        front = np.unique(np.concatenate(reached))
    return np.where(steps == np.iinfo(np.int64).max, -1, steps).reshape(filled.shape)


def drains(filled: np.ndarray) -> np.ndarray:
    """Cells that lack a neighbour, or have a lower one."""
    lower = np.logical_or.reduce([shifted(filled, dr, dc) < filled for dr, dc in STEPS])
    return ~np.isnan(filled) & (lower | at_edge(filled))
