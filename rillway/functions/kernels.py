"""Numpy kernels for what has no relational form; grids have NaN outside."""

from __future__ import annotations

import numpy as np

#: Steps to the eight neighbours, from east clockwise.
STEPS = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
#: Metres by which a flat falls with each step.
TINY = 1e-7


def to_grid(r: np.ndarray, c: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, int, int]:
    grid = np.full((r.max() - r.min() + 1, c.max() - c.min() + 1), np.nan)
    grid[r - r.min(), c - c.min()] = z
    return grid, int(r.min()), int(c.min())


def resolve_flats(filled: np.ndarray, tiny: float = TINY) -> np.ndarray:
    """Flats slope by ``tiny`` a step towards where they drain."""
    from rillway.functions import flood

    steps = flood.flat_steps(filled, np.where(flood.drains(filled), 0, -1))
    return filled + np.where(steps > 0, steps * tiny, 0)


def d8(grid: np.ndarray) -> np.ndarray:
    """Number of the neighbour of steepest descent, -1 without one."""
    rows, cols = grid.shape
    padded = np.pad(grid, 1, constant_values=np.nan)
    falls = np.stack([(grid - padded[1 + dr : 1 + dr + rows, 1 + dc : 1 + dc + cols]) / (2**0.5 if dr and dc else 1) for dr, dc in STEPS])
    falls = np.where(np.isnan(falls), -np.inf, falls)
    return np.where(falls.max(axis=0) > 0, falls.argmax(axis=0), -1)


def targets(directions: np.ndarray) -> np.ndarray:
    """For each cell the flat place of the cell that it drains to, -1 where its water leaves the grid or rests."""
    rows, cols = directions.shape
    flat, at, steps = directions.ravel(), np.arange(directions.size), np.array(STEPS)
    known = flat >= 0
    r, c = at // cols + np.where(known, steps[flat, 0], 0), at % cols + np.where(known, steps[flat, 1], 0)
    return np.where(known & (r >= 0) & (r < rows) & (c >= 0) & (c < cols), r * cols + c, -1)


def accumulate(directions: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """Cells that drain through each cell, itself included, in waves from the ridges down; ``own``: how many each cell counts for."""
    to = targets(directions)
    waits = np.bincount(to[to >= 0], minlength=to.size)
    acc, front = (np.ones(to.size, dtype=np.int64) if own is None else own.ravel().copy()), np.flatnonzero(waits == 0)
    while front.size:
        out = front[to[front] >= 0]
        np.add.at(acc, to[out], acc[out])
        np.subtract.at(waits, to[out], 1)
        cand = np.unique(to[out])
        front = cand[waits[cand] == 0]
    return acc.reshape(directions.shape)


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker: keeps the ends and what is off a chord by more than ``tolerance``."""
    keep, stack = np.zeros(len(points), dtype=bool), [(0, len(points) - 1)]
    keep[[0, -1]] = True
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        p, q, mid = points[a], points[b], points[a + 1 : b]
        along = q - p
        size = (along**2).sum()
        t = np.clip(((mid - p) @ along) / size, 0, 1)[:, None] if size else np.zeros((len(mid), 1))
        off = np.sqrt(((mid - (p + t * along)) ** 2).sum(axis=1))
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def simplify_to(points: np.ndarray, most: int, tolerance: float = 1e-4, grow: float = 1.8, tries: int = 12) -> np.ndarray:
    """The original simplified with a growing tolerance until it has at most ``most`` points."""
    out = points
    for k in range(tries):
        if len(out) <= most:
            break
        out = simplify(points, tolerance * grow**k)
    return out


def parts(points: object) -> list[np.ndarray]:
    """The lines of ``geo.numbered_points`` as arrays of (lon, lat)."""
    if points is None or not len(points):
        return []
    rows = np.array([(p["k"], p["lon"], p["lat"]) for p in points], dtype=float)
    return [line[:, 1:] for line in np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1)]


def merge_lines(lines: list[np.ndarray]) -> list[np.ndarray]:
    """Lines joined wherever exactly two ends meet."""
    rest = {k: [tuple(p) for p in line] for k, line in enumerate(lines)}
    while True:
        ends: dict[tuple, list[int]] = {}
        for k, line in rest.items():
            for p in (line[0], line[-1]):
                ends.setdefault(p, []).append(k)
        pair = next(((p, ks) for p, ks in sorted(ends.items()) if len(ks) == 2 and ks[0] != ks[1]), None)
        if pair is None:
            return [np.array(line) for _, line in sorted(rest.items())]
        p, (a, b) = pair
        x, y = rest[a], rest.pop(b)
        x = x if x[-1] == p else x[::-1]
        y = y if y[0] == p else y[::-1]
        rest[a] = x + y[1:]


def in_ring(x: float, y: float, ring: np.ndarray) -> bool:
    """Whether a point is inside a closed ring, by ray parity."""
    a, b = ring[:-1], ring[1:]
    cross = (a[:, 1] > y) != (b[:, 1] > y)
    at = a[cross, 0] + (y - a[cross, 1]) / (b[cross, 1] - a[cross, 1]) * (b[cross, 0] - a[cross, 0])
    return bool((at > x).sum() % 2)


def length_inside(line: np.ndarray, ring: np.ndarray) -> float:
    """Length of the parts of a line inside a ring: cut at crossings, middles tested."""
    total, a, e = 0.0, ring[:-1], ring[1:] - ring[:-1]
    for p, q in zip(line[:-1], line[1:], strict=True):
        d = q - p
        den = d[0] * e[:, 1] - d[1] * e[:, 0]
        ok = den != 0
        w = a[ok] - p
        t = (w[:, 0] * e[ok, 1] - w[:, 1] * e[ok, 0]) / den[ok]
        u = (w[:, 0] * d[1] - w[:, 1] * d[0]) / den[ok]
        cuts = np.unique(np.concatenate([[0.0, 1.0], t[(t > 0) & (t < 1) & (u >= 0) & (u <= 1)]]))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            m = p + d * (lo + hi) / 2
            if in_ring(m[0], m[1], ring):
                total += float(np.hypot(*d)) * (hi - lo)
    return total


def fill_nan(grid: np.ndarray, passes: int = 8) -> np.ndarray:
    """NaN cells get the mean of their four neighbours, pass by pass; what is left gets the least height."""
    out = grid.astype(float).copy()
    for _ in range(passes):
        gap = np.isnan(out)
        if not gap.any():
            return out
        p = np.pad(out, 1, constant_values=np.nan)
        near = np.stack([p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])
        n = (~np.isnan(near)).sum(axis=0)
        out = np.where(gap & (n > 0), np.nansum(near, axis=0) / np.maximum(n, 1), out)
    return np.where(np.isnan(out), np.nanmin(grid) if not np.isnan(grid).all() else 0.0, out)


def bilinear(grid: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Heights between cells; places beyond the edge take the edge."""
    r, c = np.clip(r, 0, grid.shape[0] - 1), np.clip(c, 0, grid.shape[1] - 1)
    i, j = np.minimum(r.astype(int), max(grid.shape[0] - 2, 0)), np.minimum(c.astype(int), max(grid.shape[1] - 2, 0))
    i2, j2 = np.minimum(i + 1, grid.shape[0] - 1), np.minimum(j + 1, grid.shape[1] - 1)
    u, v = r - i, c - j
    return (grid[i, j] * (1 - v) + grid[i, j2] * v) * (1 - u) + (grid[i2, j] * (1 - v) + grid[i2, j2] * v) * u


def cast_shadow(grid: np.ndarray, azimuth: float, altitude: float, dx: float, dy: float | None = None) -> np.ndarray:
    """Cells that ground towards the sun hides: rays that advance one cell along the larger axis, until above the highest ground."""
    east, north = np.sin(np.radians(azimuth)), np.cos(np.radians(azimuth))
    east, north = (v / max(abs(east), abs(north)) for v in (east, north))
    rise, top = np.hypot(east * dx, north * (dx if dy is None else dy)) * np.tan(np.radians(altitude)), np.nanmax(grid)
    live_r, live_c = np.nonzero(~np.isnan(grid))
    base, hidden = grid[live_r, live_c], np.zeros(grid.shape, dtype=bool)
    filled = fill_nan(grid)
    for k in range(1, int(np.hypot(*grid.shape)) + 3):
        level = base + k * rise
        r, c = live_r - k * north, live_c + k * east
        go = (level <= top) & (r >= 0) & (c >= 0) & (r <= grid.shape[0] - 1) & (c <= grid.shape[1] - 1)
        live_r, live_c, base, level, r, c = live_r[go], live_c[go], base[go], level[go], r[go], c[go]
        if not len(base):
            break
        hit = bilinear(filled, r, c) > level + 1e-9
        hidden[live_r[hit], live_c[hit]] = True
        live_r, live_c, base = live_r[~hit], live_c[~hit], base[~hit]
    return hidden


def contours(grid: np.ndarray, level: float) -> np.ndarray:
    """Segments of a contour level by marching squares: n x 2 ends x (row, column).

    Cells that a contour crosses twice (saddles) give both of their segments, in the order of their edges.
    """
    corner = [grid[:-1, :-1], grid[:-1, 1:], grid[1:, 1:], grid[1:, :-1]]
    offset = np.array([(0, 0), (0, 1), (1, 1), (1, 0)], dtype=float)
    r, c = np.nonzero(~np.isnan(sum(corner)))
    z = np.stack([k[r, c] for k in corner], axis=1)
    high, after = z > level, np.roll(z, -1, axis=1)
    cut = high != np.roll(high, -1, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(cut, (level - z) / (after - z), 0)
    place = np.stack([r, c], axis=1)[:, None, :] + offset + t[..., None] * (np.roll(offset, -1, axis=0) - offset)
    # Crossed edges come first in each cell: two, or four of a saddle.
    order = np.argsort(~cut, axis=1, kind="stable")
    place, n = np.take_along_axis(place, order[..., None], axis=1), cut.sum(axis=1)
    return np.concatenate([place[n >= 2][:, :2], place[n == 4][:, 2:]])


def chains(segments: np.ndarray) -> list[np.ndarray]:
    """Contour segments joined end to end into lines; ends are the same if equal to 1e-9."""
    key = lambda p: (round(p[0] * 1e9), round(p[1] * 1e9))
    at: dict[tuple, list[int]] = {}
    for k, s in enumerate(segments):
        for p in s:
            at.setdefault(key(p), []).append(k)
    used, out = np.zeros(len(segments), dtype=bool), []
    # Open lines begin where one segment ends; what is left are rings.
    starts = [k for ks in at.values() if len(ks) == 1 for k in ks]
    for first in [*starts, *range(len(segments))]:
        if used[first]:
            continue
        a, b = segments[first]
        line, k = ([a, b] if len(at[key(a)]) == 1 or len(at[key(b)]) != 1 else [b, a]), first
        used[k] = True
        while nxt := [j for j in at[key(line[-1])] if not used[j]]:
            used[k := nxt[0]] = True
            p, q = segments[k]
            line.append(q if key(p) == key(line[-1]) else p)
        out.append(np.array(line))
    return out
