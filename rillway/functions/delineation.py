"""Numpy kernels of delineation: catchment masks, their outlines, and the search over pour points."""

from __future__ import annotations

import numpy as np

from rillway.functions import flood, geo, kernels

#: Fewest channel cells that a trace takes, and the share of raised cells that deserves a warning.
LEAST_CHANNEL, MUCH_RAISED, RAISED_M = 5, 0.05, 0.5
#: The share of a river's course that ends the search, and the least that is accepted.
EARLY, ACCEPT = 0.99, 0.9
#: So many crossings of edges and rows are held at once.
EDGES_AT_ONCE = 4_000_000


def lambert93(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sin(np.radians(lat))
    r = geo.C * np.exp(-geo.N * (np.arctanh(s) - geo.E * np.arctanh(geo.E * s)))
    turn = geo.N * np.radians(lon - geo.LON0)
    return geo.XS + r * np.sin(turn), geo.YS - r * np.cos(turn)


def area_km2(ring: np.ndarray) -> float:
    x, y = lambert93(ring[:, 0], ring[:, 1])
    return float(abs((x[:-1] * y[1:] - x[1:] * y[:-1]).sum()) / 2e6)


def condition(grid: np.ndarray) -> dict:
    """Filled heights, directions, accumulation, and the share of cells that filling raised by more than ``RAISED_M``."""
    filled = flood.fill(grid)
    directions = kernels.d8(kernels.resolve_flats(filled))
    directions = np.where(np.isnan(grid), -1, directions)
    raised = float((np.nan_to_num(filled - grid) > RAISED_M).sum() / grid.size)
    return {"filled": filled, "directions": directions, "acc": kernels.accumulate(directions), "raised": raised, "much_raised": raised > MUCH_RAISED}


def catchment(directions: np.ndarray, r: int, c: int) -> np.ndarray:
    """Cells that drain through one cell, itself included: a frontier against the flow."""
    rows, cols = directions.shape
    mask = np.zeros(directions.shape, dtype=bool)
    mask[r, c] = True
    at = np.array([(r, c)])
    while len(at):
        found = []
        for k, (dr, dc) in enumerate(kernels.STEPS):
            i, j = at[:, 0] - dr, at[:, 1] - dc
            ok = (i >= 0) & (i < rows) & (j >= 0) & (j < cols)
            i, j = i[ok], j[ok]
            new = (directions[i, j] == k) & ~mask[i, j]
            found.append(np.stack([i[new], j[new]], axis=1))
        at = np.unique(np.concatenate(found), axis=0)
        mask[at[:, 0], at[:, 1]] = True
    return mask


def largest_part(mask: np.ndarray) -> np.ndarray:
    """The largest 4-connected part of a mask; of equally large ones the first by row and column."""
    label = np.where(mask, np.arange(mask.size).reshape(mask.shape), mask.size)
    while True:
        p = np.pad(label, 1, constant_values=mask.size)
        near = np.minimum.reduce([label, p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])
        near = np.where(mask, near, mask.size)
        # Each cell then takes the label of its label.
        jump = np.append(near.ravel(), mask.size)
        near = jump[near]
        if (near == label).all():
            break
        label = near
    if not mask.any():
        return mask
    count = np.bincount(label[mask])
    return label == int(count.argmax())


def mask_edges(mask: np.ndarray) -> np.ndarray:
    """Sides of cells (in columns and rows: x1, y1, x2, y2) where a mask ends."""
    p = np.pad(mask, 1)
    out = []
    for dr, dc, (a, b) in ((-1, 0, ((0, 0), (1, 0))), (1, 0, ((0, 1), (1, 1))), (0, -1, ((0, 0), (0, 1))), (0, 1, ((1, 0), (1, 1)))):
        r, c = np.nonzero(mask & ~p[1 + dr : 1 + dr + mask.shape[0], 1 + dc : 1 + dc + mask.shape[1]])
        out.append(np.stack([c + a[0], r + a[1], c + b[0], r + b[1]], axis=1))
    return np.concatenate(out).astype(float)


def stitch(edges: np.ndarray) -> list[np.ndarray]:
    """Closed rings of edges that each corner has an even number of; straight corners go."""
    at: dict[tuple, list[int]] = {}
    for k, (x1, y1, x2, y2) in enumerate(edges.tolist()):
        at.setdefault((x1, y1), []).append(k)
        at.setdefault((x2, y2), []).append(k)
    used, rings = np.zeros(len(edges), dtype=bool), []
    for first in range(len(edges)):
        if used[first]:
            continue
        used[first] = True
        ring = [tuple(edges[first, :2]), tuple(edges[first, 2:])]
        while ring[-1] != ring[0]:
            here, before = ring[-1], ring[-2]
            free = [k for k in at[here] if not used[k]]
            if not free:
                break
            far = lambda k, here=here: tuple(edges[k, 2:]) if tuple(edges[k, :2]) == here else tuple(edges[k, :2])
            # Where four sides meet, the sharpest turn to one hand keeps parts that touch at a corner apart.
            turn = lambda k, here=here, before=before, far=far: -((here[0] - before[0]) * (far(k)[1] - here[1]) - (here[1] - before[1]) * (far(k)[0] - here[0]))
            k = min(free, key=turn) if len(free) > 1 else free[0]
            used[k] = True
            ring.append(far(k))
        if ring[-1] == ring[0] and len(ring) > 3:
            rings.append(_without_straight(np.array(ring)))
    return rings


def _without_straight(ring: np.ndarray) -> np.ndarray:
    p = ring[:-1]
    before, after = np.roll(p, 1, axis=0), np.roll(p, -1, axis=0)
    bend = (p[:, 0] - before[:, 0]) * (after[:, 1] - p[:, 1]) - (p[:, 1] - before[:, 1]) * (after[:, 0] - p[:, 0])
    kept = p[bend != 0]
    return np.concatenate([kept, kept[:1]]) if len(kept) >= 3 else ring


def _twice(ring: np.ndarray) -> float:
    return float(abs((ring[:-1, 0] * ring[1:, 1] - ring[1:, 0] * ring[:-1, 1]).sum()))


def _crossed_east(points: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """How many edges of all rings each point's ray to the east crosses: edges are dealt to the points' rows, sorted there, and counted by bisection."""
    a, b = np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])
    rows, row_of = np.unique(points[:, 1], return_inverse=True)
    # An edge crosses the rows y with min <= y < max of its ends.
    lo, hi = np.searchsorted(rows, np.minimum(a[:, 1], b[:, 1])), np.searchsorted(rows, np.maximum(a[:, 1], b[:, 1]))
    count = np.zeros(len(points), dtype=np.int64)
    by_row, upto = np.argsort(row_of, kind="stable"), np.cumsum(np.bincount(row_of, minlength=len(rows)))
    load = np.cumsum(np.bincount(lo, minlength=len(rows) + 1)[:-1] - np.bincount(hi, minlength=len(rows) + 1)[:-1])
    # Rows in runs of so many crossings, so that memory stays bounded.
    run = np.cumsum(load) // EDGES_AT_ONCE
    for first, last in zip(starts := np.flatnonzero(np.diff(run, prepend=-1)), [*starts[1:], len(rows)], strict=True):
        on = np.flatnonzero((lo < last) & (hi > first))
        begin, n = np.maximum(lo[on], first), np.minimum(hi[on], last) - np.maximum(lo[on], first)
        edge = np.repeat(on, n)
        row = np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
        at = a[edge, 0] + (rows[row] - a[edge, 1]) / (b[edge, 1] - a[edge, 1]) * (b[edge, 0] - a[edge, 0])
        order = np.lexsort([at, row])
        row, at = row[order], at[order]
        bounds = np.searchsorted(row, np.arange(first, last + 1))
        for k in range(first, last):
            here = by_row[upto[k - 1] if k else 0 : upto[k]]
            east = at[bounds[k - first] : bounds[k - first + 1]]
            count[here] = len(east) - np.searchsorted(east, points[here, 0], side="right")
    return count


def outer_rings(rings: list[np.ndarray]) -> list[np.ndarray]:
    """Rings that an even number of others hold, largest first; holes go.

    The rings that hold a point are odd in number if all their crossings are, so all rings are counted at once.
    """
    if not rings:
        return []
    middle = np.array([(r[0] + r[1]) / 2 for r in rings])
    own = [kernels.in_ring(x, y, r) for (x, y), r in zip(middle, rings, strict=True)]
    out = [r for r, n, me in zip(rings, _crossed_east(middle, rings), own, strict=True) if (n - me) % 2 == 0]
    return sorted(out, key=lambda r: -_twice(r))


def dilated(mask: np.ndarray, cells: int) -> np.ndarray:
    """A mask widened by so many cells, all round."""
    rows, cols = mask.shape
    out, p = mask.copy(), np.pad(mask, cells)
    for dr in range(-cells, cells + 1):
        for dc in range(-cells, cells + 1):
            if dr * dr + dc * dc <= cells * cells:
                out |= p[cells + dr : cells + dr + rows, cells + dc : cells + dc + cols]
    return out


def ring_mask(ring: np.ndarray, shape: tuple[int, int], west: float, north: float, cell: float) -> np.ndarray:
    """Cells whose middles lie in a ring."""
    rows, cols = shape
    x, y = west + (np.arange(cols) + 0.5) * cell, north - (np.arange(rows) + 0.5) * cell
    mask = np.zeros(shape, dtype=bool)
    a, b = ring[:-1], ring[1:]
    for k in range(rows):
        cross = (a[:, 1] > y[k]) != (b[:, 1] > y[k])
        at = a[cross, 0] + (y[k] - a[cross, 1]) / (b[cross, 1] - a[cross, 1]) * (b[cross, 0] - a[cross, 0])
        mask[k] = (at[:, None] > x[None, :]).sum(axis=0) % 2 == 1
    return mask


def trace(tile: dict, lon: float, lat: float, threshold: int, west: float, north: float, cell: float) -> dict:
    """The catchment of one pour point: snapped to the nearest channel cell, traced, outlined, measured."""
    channel = tile["acc"] > threshold
    n = int(channel.sum())
    if n < LEAST_CHANNEL:
        raise ValueError(f"only {n} channel cells above {threshold}")
    r, c = np.nonzero(channel)
    row, col = (north - lat) / cell - 0.5, (lon - west) / cell - 0.5
    k = int(((r - row) ** 2 + (c - col) ** 2).argmin())
    mask = catchment(tile["directions"], int(r[k]), int(c[k]))
    part = largest_part(mask)
    ring = outer_rings(stitch(mask_edges(part)))[0]
    ring = kernels.simplify(ring, 0.5)
    ring = np.stack([west + ring[:, 0] * cell, north - ring[:, 1] * cell], axis=1)
    return {"ring": ring, "area_km2": area_km2(ring), "n_cells": int(mask.sum()), "snap_lon": west + (c[k] + 0.5) * cell, "snap_lat": north - (r[k] + 0.5) * cell, "moved_cells": float(np.hypot(r[k] - row, c[k] - col)), "raised": tile["raised"]}


def inside_share(lines: list[np.ndarray], ring: np.ndarray) -> float:
    long_ = sum(float(np.hypot(*np.diff(line, axis=0).T).sum()) for line in lines)
    return sum(kernels.length_inside(line, ring) for line in lines) / long_ if long_ > 0 else 0.0


def search(tile: dict, tries: list[tuple], lines: list[np.ndarray], west: float, north: float, cell: float, accept: float = ACCEPT) -> dict | None:
    """Of pour points (offset, threshold, lon, lat) in order the one whose catchment holds most of the
    river's course, up to the first that holds ``EARLY``; None under ``accept``."""
    best, tried = None, 0
    for offset, threshold, lon, lat in tries:
        tried += 1
        try:
            made = trace(tile, lon, lat, threshold, west, north, cell)
        except ValueError:
            continue
        made |= {"frac": inside_share(lines, made["ring"]), "offset_m": offset, "threshold": threshold}
        if best is None or made["frac"] > best["frac"]:
            best = made
        if best["frac"] >= EARLY:
            break
    return None if best is None or best["frac"] < accept else best | {"n_tried": tried}
