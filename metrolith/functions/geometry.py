"""Geometry kernels in NumPy over WKB: areas, lengths, overlaps, shapes.

Polygons are lists of closed rings (x, y); outer rings run counter-clockwise
and holes clockwise once read, so that every area is a sum over edges.
"""

from __future__ import annotations

import struct

import numpy as np

EPS = 1e-9


def _signed(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float(x[:-1] @ y[1:] - x[1:] @ y[:-1]) / 2


def box(x0: float, y0: float, x1: float, y1: float) -> bytes:
    return polygon_wkb([np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]], float)])


def polygon_wkb(rings: list[np.ndarray]) -> bytes:
    out = struct.pack("<BII", 1, 3, len(rings))
    return out + b"".join(struct.pack("<I", len(r)) + np.asarray(r, "<f8").tobytes() for r in rings)


def line_wkb(points: np.ndarray) -> bytes:
    return struct.pack("<BII", 1, 2, len(points)) + np.asarray(points, "<f8").tobytes()


def _read(b: bytes, at: int) -> tuple[str, list[np.ndarray], int]:
    order = "<" if b[at] == 1 else ">"
    kind = struct.unpack_from(order + "I", b, at + 1)[0] % 1000
    at += 5

    def ring(at: int) -> tuple[np.ndarray, int]:
        n = struct.unpack_from(order + "I", b, at)[0]
        return np.frombuffer(b, order + "f8", 2 * n, at + 4).reshape(-1, 2).astype(float), at + 4 + 16 * n

    if kind == 1:
        return "point", [np.frombuffer(b, order + "f8", 2, at).reshape(1, 2).astype(float)], at + 16
    if kind == 2:
        r, at = ring(at)
        return "line", [r], at
    if kind == 3:
        n = struct.unpack_from(order + "I", b, at)[0]
        at, rings = at + 4, []
        for k in range(n):
            r, at = ring(at)
            if (_signed(r) < 0) != (k > 0):
                r = r[::-1]
            rings.append(r)
        return "polygon", rings, at
    if kind in (4, 5, 6, 7):
        n = struct.unpack_from(order + "I", b, at)[0]
        at, parts, name = at + 4, [], "polygon"
        for _ in range(n):
            name, more, at = _read(b, at)
            parts += more
        return name, parts, at
    raise ValueError(f"WKB of kind {kind} is not known")


def parts(wkb: bytes) -> list[np.ndarray]:
    """Rings or lines of a geometry."""
    return _read(bytes(wkb), 0)[1]


def bounds(wkb: bytes) -> tuple[float, float, float, float]:
    p = np.concatenate(parts(wkb))
    return (*p.min(axis=0).tolist(), *p.max(axis=0).tolist())


def area(rings: list[np.ndarray]) -> float:
    return sum(_signed(r) for r in rings)


def length(lines: list[np.ndarray]) -> float:
    return float(sum(np.hypot(*np.diff(p, axis=0).T).sum() for p in lines))


def edges(rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not rings:
        return np.zeros((0, 2)), np.zeros((0, 2))
    return np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])


def locate(p: np.ndarray, rings: list[np.ndarray], eps: float = EPS) -> np.ndarray:
    """1 inside, 0 on the boundary, -1 outside, for each point."""
    a, b = edges(rings)
    out = np.empty(len(p), int)
    for s in range(0, len(p), 2048):
        q = p[s : s + 2048, None, :]
        ax, ay, bx, by = a[:, 0], a[:, 1], b[:, 0], b[:, 1]
        cross = (bx - ax) * (q[..., 1] - ay) - (by - ay) * (q[..., 0] - ax)
        span = np.hypot(bx - ax, by - ay)
        dot = (q[..., 0] - ax) * (bx - ax) + (q[..., 1] - ay) * (by - ay)
        on = (np.abs(cross) <= eps * np.maximum(span, 1)) & (dot >= -eps * span) & (dot <= span * (span + eps))
        up = (ay <= q[..., 1]) & (by > q[..., 1]) & (cross > 0)
        down = (ay > q[..., 1]) & (by <= q[..., 1]) & (cross < 0)
        inside = (up.sum(axis=1) - down.sum(axis=1)) != 0
        out[s : s + 2048] = np.where(on.any(axis=1), 0, np.where(inside, 1, -1))
    return out


def split(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) cut at every crossing with, and every end on, edges (c, d)."""
    starts, ends = [], []
    r, s = b - a, d - c
    for i in range(len(a)):
        den = r[i, 0] * s[:, 1] - r[i, 1] * s[:, 0]
        w = c - a[i]
        num_t, num_u = w[:, 0] * s[:, 1] - w[:, 1] * s[:, 0], w[:, 0] * r[i, 1] - w[:, 1] * r[i, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = num_t / den, num_u / den
        size = r[i] @ r[i]
        cuts = t[(den != 0) & (u >= -EPS) & (u <= 1 + EPS)]
        for q in (c, d):  # ends that lie along the edge
            v = q - a[i]
            along = np.abs(v[:, 0] * r[i, 1] - v[:, 1] * r[i, 0]) <= EPS * max(size, 1)
            cuts = np.append(cuts, (v[along] @ r[i]) / size if size else [])
        cuts = np.unique(np.concatenate(([0.0], cuts[(cuts > EPS) & (cuts < 1 - EPS)], [1.0])))
        p = a[i] + cuts[:, None] * r[i]
        starts.append(p[:-1])
        ends.append(p[1:])
    return (np.concatenate(starts), np.concatenate(ends)) if starts else (a, b)


def overlap_area(p: list[np.ndarray], q: list[np.ndarray]) -> float:
    """Area that two polygons share: by Green's theorem over the pieces of each
    boundary that lie inside the other; a shared boundary counts once, where
    both interiors are on one side of it."""
    a, b = edges(p)
    c, d = edges(q)
    if not len(a) or not len(c) or (np.maximum(a.min(0), c.min(0)) > np.minimum(a.max(0), c.max(0))).any():
        return 0.0
    total = 0.0
    for k, (s, e, rings, (oc, od)) in enumerate(((*split(a, b, c, d), q, (c, d)), (*split(c, d, a, b), p, (a, b)))):
        mid = (s + e) / 2
        where = locate(mid, rings)
        keep = where == 1
        if k == 0:
            for i in np.flatnonzero(where == 0):
                v, m = od - oc, mid[i] - oc
                along = np.abs(v[:, 0] * m[:, 1] - v[:, 1] * m[:, 0]) <= EPS * np.maximum(np.hypot(*v.T), 1)
                t = np.einsum("ij,ij->i", v, m)
                along &= (t >= -EPS) & (t <= np.einsum("ij,ij->i", v, v) + EPS)
                keep[i] = bool(((v[along] @ (e[i] - s[i])) > 0).any())
        total += float((s[keep, 0] * e[keep, 1] - e[keep, 0] * s[keep, 1]).sum()) / 2
    return max(total, 0.0)


def rectangles(wkbs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which geometries are rectangles along the axes, and their x0, y0, x1, y1 (else NaN)."""
    out = np.full((len(wkbs), 4), np.nan)
    head = struct.pack("<BIII", 1, 3, 1, 5)
    at = np.array([i for i, b in enumerate(wkbs) if b is not None and len(b) == 93 and b[:13] == head], int)
    if len(at):
        p = np.frombuffer(b"".join(bytes(wkbs[i][13:]) for i in at), "<f8").reshape(-1, 5, 2)
        d = np.diff(p, axis=1) == 0
        turns = (d[:, 0::2, 0].all(1) & d[:, 1::2, 1].all(1)) | (d[:, 0::2, 1].all(1) & d[:, 1::2, 0].all(1))
        ok = turns & (p[:, 0] == p[:, 4]).all(1)
        out[at[ok]] = np.concatenate([p[ok].min(axis=1), p[ok].max(axis=1)], axis=1)
    return ~np.isnan(out[:, 0]), out


def _turns(group: np.ndarray, y: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where, going up, each group's sum of steps leaves (1) or comes back to (-1) zero."""
    order = np.lexsort((y, group))
    on = (np.cumsum(step[order]) != 0).astype(int)
    turn = np.diff(on, prepend=0)
    at = np.flatnonzero(turn)
    return group[order][at], y[order][at], turn[at]


def edge_table(wkbs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the edges of polygons, and the place of each edge's polygon."""
    known, box = rectangles(wkbs)
    at = np.flatnonzero(known)
    x0, y0, x1, y1 = box[at].T
    corners = np.stack([np.stack(c, axis=1) for c in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]) if len(at) else np.zeros((4, 0, 2))
    rest = np.flatnonzero(~known)
    rings = [[r for r in parts(wkbs[i]) if len(r) > 1] for i in rest]
    a, b = edges([r for p in rings for r in p])
    of = np.repeat(rest, np.array([sum(len(r) - 1 for r in p) for p in rings], int))
    return np.concatenate([corners.reshape(-1, 2), a]), np.concatenate([np.roll(corners, -1, axis=0).reshape(-1, 2), b]), np.concatenate([np.tile(at, 4), of])


#: A box with more edges is cut in two, unless so many cuts did not halve them; a batch of
#: slabs and edges has so many pairs at most.
LEAF, CUTS, PAIRS = 256, 6, 1 << 20


def cover(polygons: list[list[np.ndarray]], owners: np.ndarray, box: tuple[float, float, float, float] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """area, n, ids of the pieces that the polygons' edges cut the plane (or the box) into:
    how many owners cover a piece, and the sum of their numbers."""
    polygon = np.repeat(np.arange(len(polygons)), np.array([sum(max(len(r) - 1, 0) for r in p) for p in polygons], int))
    return cover_edges(*edges([r for p in polygons for r in p if len(r) > 1]), polygon, owners, box)


def cover_edges(a: np.ndarray, b: np.ndarray, polygon: np.ndarray, owners: np.ndarray, box: tuple[float, float, float, float] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``cover`` of an edge table.

    A box of many edges is cut in two at the median of the corners inside. A polygon without
    an edge inside a part holds all of it or nothing; where it holds all, the other polygons
    of its owner don't matter. So crowds end early, and the sweeps stay small."""
    owners = np.asarray(owners, np.int64)
    if not len(a):
        return np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if box is None:
        box = (*np.minimum(a, b).min(axis=0).tolist(), *np.maximum(a, b).max(axis=0).tolist())
    step = np.sign(b[:, 0] - a[:, 0]).astype(int)
    back = (step < 0)[:, None]
    a, b = np.where(back, b, a), np.where(back, a, b)
    out, todo = [], [(_part(a, b, step, owners[polygon], polygon, box), np.inf, 0)]
    while todo:
        node, aim, cuts = todo.pop()
        n = len(node[0])
        if n <= aim:
            aim, cuts = n / 2, 0
        halves = _halves(node) if n > LEAF and cuts < CUTS else []
        todo += [(h, aim, cuts + 1) for h in halves]
        if n and not halves:
            out.append(_sweep(*node))
    if not out:
        return np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out))


def _part(a: np.ndarray, b: np.ndarray, step: np.ndarray, owner: np.ndarray, polygon: np.ndarray, box: tuple[float, float, float, float]) -> tuple:
    """The edges (from left to right) that matter in a box: of the polygons with an edge inside,
    and the box itself for each owner that holds all of it."""
    x0, y0, x1, y1 = box
    low, high = np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 1], b[:, 1])
    names, at = np.unique(polygon, return_inverse=True)
    along = (b[:, 0] > x0) & (a[:, 0] < x1)
    x, y = (x0 + x1) / 2, (y0 + y1) / 2
    dx, dy = (b - a).T
    inside = along & (high > y0) & (low < y1) & (np.abs(dx * (y - a[:, 1]) - dy * (x - a[:, 0])) < dx * (y1 - y0) / 2 + np.abs(dy) * (x1 - x0) / 2)
    crossing = np.bincount(at[inside], minlength=len(names)) > 0
    below = np.flatnonzero((step != 0) & (a[:, 0] <= x) & (b[:, 0] > x) & ~crossing[at])
    below = below[a[below, 1] + (b[below, 1] - a[below, 1]) / (b[below, 0] - a[below, 0]) * (x - a[below, 0]) < y]
    turns = np.bincount(at[below], step[below], minlength=len(names))
    whole = np.unique(owner[(turns != 0)[at]])
    keep = crossing[at] & along & ((step != 0) | (low < y1) & (high > y0)) & ~np.isin(owner, whole)
    n, new = len(whole), (polygon.max(initial=-1) + 1 + np.arange(len(whole)))
    corner = lambda x, y: np.tile([x, y], (n, 1)).astype(float)
    return (
        np.concatenate([a[keep], corner(x0, y0), corner(x0, y1)]),
        np.concatenate([b[keep], corner(x1, y0), corner(x1, y1)]),
        np.concatenate([step[keep], np.ones(n, int), -np.ones(n, int)]),
        np.concatenate([owner[keep], whole, whole]),
        np.concatenate([polygon[keep], new, new]),
        box,
    )


def _halves(node: tuple) -> list[tuple]:
    """Two parts of a box; none where no corner is inside."""
    a, b, *rest, box = node
    for axis in (0, 1) if box[2] - box[0] >= box[3] - box[1] else (1, 0):
        at = np.concatenate([a[:, axis], b[:, axis]])
        at = at[(at > box[axis]) & (at < box[axis + 2])]
        if len(at):
            cut = np.partition(at, len(at) // 2)[len(at) // 2]
            return [_part(a, b, *rest, part) for part in ((*box[: axis + 2], cut, *box[axis + 3 :]), (*box[:axis], cut, *box[axis + 1 :]))]
    return []


def _sweep(a: np.ndarray, b: np.ndarray, step: np.ndarray, owner: np.ndarray, polygon: np.ndarray, box: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of a box by slabs, cut at all vertices and crossings: inside a slab edges keep
    their order, so the pieces are trapezoids, whose area is their height in the
    slab's middle times its width."""
    x0, y0, x1, y1 = box
    keep = step != 0
    a, b, step, owner, polygon = a[keep], b[keep], step[keep], owner[keep], polygon[keep]
    slope = (b[:, 1] - a[:, 1]) / (b[:, 0] - a[:, 0])
    height = lambda i, x: a[i, 1] + slope[i] * (x - a[i, 0])
    xs = [a[:, 0], b[:, 0], np.array([x0, x1])]
    sloped = np.flatnonzero(slope)
    some = max(1, PAIRS // max(len(a), 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        for y in (y0, y1):
            xs.append(a[sloped, 0] + (y - a[sloped, 1]) / slope[sloped])
        for s in range(0, len(sloped), some):
            i = sloped[s : s + some, None]
            lo, hi = np.maximum(a[i, 0], a[:, 0]), np.minimum(b[i, 0], b[:, 0])
            u, v = height(i, lo) - height(slice(None), lo), height(i, hi) - height(slice(None), hi)
            cross = (lo < hi) & (u * v < 0)
            xs.append((lo + (hi - lo) * u / (u - v))[cross])
    xs = np.unique(np.concatenate(xs))
    xs = xs[(xs >= x0) & (xs <= x1)]
    names, group = np.unique(owner, return_inverse=True)
    polygons, polygon = np.unique(polygon, return_inverse=True)
    owner_of = np.zeros(len(polygons), int)
    owner_of[polygon] = group
    areas, ns, ids = [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in range(0, len(xs) - 1, some):
        u, v = xs[s : s + some + 1][:-1], xs[s : s + some + 1][1:]
        slab, i = np.nonzero((a[:, 0] <= u[:, None]) & (b[:, 0] >= v[:, None]))
        k, y, turn = _turns(slab * len(polygons) + polygon[i], height(i, ((u + v) / 2)[slab]), step[i])
        slab, k = np.divmod(k, len(polygons))
        k, y, turn = _turns(slab * len(names) + owner_of[k], y, turn)
        slab, k = np.divmod(k, len(names))
        up = np.lexsort((y, slab))
        #: at the end of a slab nobody is left, so sums run on
        n, total, y = np.cumsum(turn[up]), np.cumsum((turn * names[k])[up]), np.clip(y[up], y0, y1)
        areas.append(np.diff(y, append=y[-1:]) * (v - u)[slab[up]])
        ns.append(n)
        ids.append(total)
    area, n, total = np.concatenate(areas), np.concatenate(ns), np.concatenate(ids)
    held = (n > 0) & (area > 0)
    return area[held], n[held], total[held]


def union_area(polygons: list[list[np.ndarray]]) -> float:
    """Area that polygons cover together."""
    return float(cover(polygons, np.zeros(len(polygons)))[0].sum())


def clip_to_box(ring: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """A ring cut to a rectangle (Sutherland-Hodgman)."""
    for axis, limit, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        if not len(ring):
            break
        p, q = ring[:-1], ring[1:]
        inside_p, inside_q = sign * (p[:, axis] - limit) >= 0, sign * (q[:, axis] - limit) >= 0
        out = []
        for a, b, ia, ib in zip(p, q, inside_p, inside_q):
            if ia != ib:
                out.append(a + (limit - a[axis]) / (b[axis] - a[axis]) * (b - a))
            if ib:
                out.append(b)
        ring = np.array([*out, out[0]]) if out else np.zeros((0, 2))
    return ring


def clipped_length(lines: list[np.ndarray], rings: list[np.ndarray], with_boundary: bool = True) -> float:
    """Length of lines inside a polygon; stretches on its boundary count too, unless
    they are left to another owner."""
    total = 0.0
    for line in lines:
        s, e = split(line[:-1], line[1:], *edges(rings))
        where = locate((s + e) / 2, rings)
        keep = where >= (0 if with_boundary else 1)
        total += float(np.hypot(*(e - s)[keep].T).sum())
    return total


def hull(points: np.ndarray) -> np.ndarray:
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(q):
        out = []
        for x in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (x[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(x)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def smallest_rectangle(points: np.ndarray) -> tuple[float, float]:
    """Width and length of the rotated rectangle of least area around the points."""
    h = hull(points)
    if len(h) < 3:
        return 0.0, float(np.hypot(*(points.max(0) - points.min(0))))
    d = np.roll(h, -1, axis=0) - h
    d = d / np.hypot(*d.T)[:, None]
    u, v = h @ d.T, h @ np.stack([-d[:, 1], d[:, 0]])
    w, l = np.ptp(u, axis=0), np.ptp(v, axis=0)
    k = int(np.argmin(w * l))
    return float(min(w[k], l[k])), float(max(w[k], l[k]))


def shape(rings: list[np.ndarray]) -> dict[str, float | None]:
    """area, ln_area, compactness (4 pi A / P^2, holes in P), elongation, min_width."""
    a, p = area(rings), length(rings)
    narrow, long = smallest_rectangle(np.concatenate(rings))
    return {
        "area": a,
        "ln_area": float(np.log(a)) if a > 0 else None,
        "compactness": 4 * np.pi * a / p**2 if p else None,
        "elongation": long / narrow if narrow > EPS else None,
        "min_width": narrow,
    }


def sample_line(line: np.ndarray, spacing: float) -> tuple[np.ndarray, np.ndarray]:
    """Midpoints of equal stretches of at most ``spacing``, and their lengths."""
    step = np.hypot(*np.diff(line, axis=0).T)
    at = np.concatenate(([0.0], np.cumsum(step)))
    n = max(1, int(np.ceil(at[-1] / spacing)))
    s = (np.arange(n) + 0.5) * at[-1] / n
    return np.stack([np.interp(s, at, line[:, k]) for k in (0, 1)], axis=1), np.full(n, at[-1] / n)


def utm(lon: np.ndarray, lat: np.ndarray, zone: int, south: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Easting and northing on the GRS80 ellipsoid, by the Krueger series."""
    a, f = 6378137.0, 1 / 298.257222101
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    lam, phi = np.radians(np.asarray(lon) - (zone * 6 - 183)), np.radians(lat)
    c = 2 * np.sqrt(n) / (1 + n)
    t = np.sinh(np.arctanh(np.sin(phi)) - c * np.arctanh(c * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t**2))
    x = eta + sum(k * np.cos(2 * (j + 1) * xi) * np.sinh(2 * (j + 1) * eta) for j, k in enumerate(alpha))
    y = xi + sum(k * np.sin(2 * (j + 1) * xi) * np.cosh(2 * (j + 1) * eta) for j, k in enumerate(alpha))
    return 500000 + 0.9996 * big * x, 0.9996 * big * y + (1e7 if south else 0)
