"""The operators' meaning on arrays of one small scene, by whole-array formulas."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np

from streetlens.config import DEFAULT

FX, CX, CY = DEFAULT.crop_width / 2 / math.tan(math.radians(90) / 2), 128.0, 128.0
SIDE = DEFAULT.canvas
STEP = 0.35


def distances(v: np.ndarray) -> np.ndarray:
    """Metres to the ground at image rows; NaN where there is none."""
    slope = (np.asarray(v, float) - CY) / FX
    with np.errstate(divide="ignore", invalid="ignore"):
        z = DEFAULT.cam_height / slope
    return np.where((slope > 1e-3) & (z > 0) & (z <= DEFAULT.max_range), z, np.nan)


def cells(u: np.ndarray, z: np.ndarray, yaw: float) -> np.ndarray:
    """Rows of (col, row, whether on the grid) for image columns and distances."""
    turn = np.array([[math.cos(math.radians(yaw)), math.sin(math.radians(yaw))], [math.sin(math.radians(yaw)), -math.cos(math.radians(yaw))]])
    at = np.rint(120.0 + (turn @ np.stack([(u - CX) / FX * z, z])) / 0.5).T
    inside = (at >= 0).all(axis=1) & (at < SIDE).all(axis=1) & ~np.isnan(z)
    return np.column_stack([np.where(inside[:, None], at, -1), inside]).astype(int)


def line(a, b):
    """Every step along the longer side, with the nearest step of the shorter one; of two
    that are as near, the one nearer to the left end."""
    (x, y), (p, q) = sorted((tuple(a), tuple(b)), key=lambda e: e[0])
    dx, dy = p - x, q - y
    long = max(dx, abs(dy), 1)
    near = lambda k, side: math.copysign(math.ceil(Fraction(abs(side) * k, long) - Fraction(1, 2)), side)
    return [(x + (k if dx >= abs(dy) else int(near(k, dx))), y + int(near(k, dy) if dx >= abs(dy) else math.copysign(k, dy))) for k in range(max(dx, abs(dy)) + 1)]


def _grid(points, side: int) -> np.ndarray:
    grid = np.zeros((side + 2, side + 2), bool)
    for c, r in points:
        grid[c + 1, r + 1] = True
    return grid


def _points(inner: np.ndarray) -> set:
    return {(int(c), int(r)) for c, r in np.argwhere(inner)}


def _nine(grid: np.ndarray) -> np.ndarray:
    side = len(grid) - 2
    return np.stack([grid[x : x + side, y : y + side] for x in range(3) for y in range(3)])


def grow(points, side=SIDE):
    return _points(_nine(_grid(points, side)).any(axis=0))


def closed(points, side=SIDE):
    """What the complement, grown from inside the grid, leaves of the grown points."""
    hole = np.zeros((side + 2, side + 2), bool)
    hole[1:-1, 1:-1] = ~_nine(_grid(points, side)).any(axis=0)
    return _points(~_nine(hole).any(axis=0))


def _drawn(at: np.ndarray, joins: np.ndarray) -> set:
    """The cells on the grid, and lines between those and their successors where joined."""
    on = {(int(c), int(r)) for c, r, inside in at if inside}
    pairs = np.flatnonzero(joins & (at[:-1, 2] == 1) & (at[1:, 2] == 1))
    return on.union(*(line(at[i, :2].tolist(), at[i + 1, :2].tolist()) for i in pairs))


def _lowest(mask) -> np.ndarray:
    """Distance at the lowest pixel of each second image column."""
    low = np.full(256, -np.inf)
    for u, v in mask:
        low[u] = max(low[u], v)
    return distances(low[::2])


def footprint(mask, yaw, cap=None, connect=True, dilate=True):
    """mask: set of (u, v)."""
    z = _lowest(mask)
    if cap:
        z = np.where(np.isnan(z), z, np.fmin(z, _lowest(cap)))
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(z.astype(np.float32), 2, constant_values=np.nan), 5)
    smooth = np.array([np.float32(np.median(w[~np.isnan(w)])) if not np.isnan(m) else np.float32(np.nan) for w, m in zip(windows, z, strict=True)])
    at = cells(np.arange(0, 256, 2), smooth.astype(float), yaw)
    near = np.abs(np.diff(smooth)) < np.float32(4.0)
    out = _drawn(at, near & connect)
    return grow(out) if dilate else out


def surface(mask, yaw):
    out = set()
    for u in {u for u, _ in mask if u % 2 == 0}:
        v = np.array(sorted(y for x, y in mask if x == u)[::2])
        out |= _drawn(cells(np.full(len(v), u), distances(v), yaw), np.diff(v) <= 4)
    return closed(out)


def rays(occupied):
    """Distances of all rays, and shadow cells, from one table of samples by ray."""
    angle = np.radians(np.arange(720) * 0.5)[:, None]
    far = np.arange(int(60 / STEP)) * STEP
    col, row = np.rint(120 + np.sin(angle) * far / 0.5).astype(int), np.rint(120 - np.cos(angle) * far / 0.5).astype(int)
    there = np.logical_and.accumulate((col >= 0) & (col < SIDE) & (row >= 0) & (row < SIDE), axis=1)
    number = col * 1000 + row
    met = there & np.isin(number, [c * 1000 + r for c, r in occupied])
    first = np.where(met.any(axis=1), met.argmax(axis=1), len(far))
    behind = there & (np.arange(len(far)) >= first[:, None])
    return np.append(far, 60.0)[first].tolist(), {(int(n) // 1000, int(n) % 1000) for n in np.unique(number[behind])}


def edges(hits, wrap=True):
    """Jumps of a ring as differences to the ring turned by one."""
    own = np.asarray(hits, float)
    following = np.roll(own, -1)
    near = np.minimum(own, following)
    weight = 1 - near / 40
    jump = (np.abs(own - following) >= 3) & (near < 60) & (weight > 0)
    jump[-1] &= wrap
    ray = np.where(own <= following, np.arange(len(own)), np.roll(np.arange(len(own)), -1))
    return [(float(r) * 0.5, float(d), float(w)) for r, d, w in zip(ray[jump], near[jump], weight[jump], strict=True)]


def flood(mask):
    """Components of (u, v) with diagonals, as frozen sets: every pixel takes the largest
    number around it until none changes."""
    names = np.zeros((258, 258), int)
    for k, (u, v) in enumerate(sorted(mask)):
        names[u + 1, v + 1] = k + 1
    own = names[1:-1, 1:-1] > 0
    while True:
        spread = np.where(own, _nine(names).max(axis=0), 0)
        if (spread == names[1:-1, 1:-1]).all():
            break
        names[1:-1, 1:-1] = spread
    found: dict[int, set] = {}
    for u, v in mask:
        found.setdefault(int(names[u + 1, v + 1]), set()).add((u, v))
    return {frozenset(c) for c in found.values()}
