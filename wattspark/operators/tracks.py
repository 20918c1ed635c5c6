"""Kernels over GPS tracks, in numpy. A track is an array of (lat, lng) in degrees."""

from __future__ import annotations

import math

import numpy as np

from wattspark.functions.geo import EARTH_METRES

ENDPOINT_METRES = 50.0


def metres(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = np.radians(np.asarray(a, float)), np.radians(np.asarray(b, float))
    h = np.sin((b[..., 0] - a[..., 0]) / 2) ** 2 + np.cos(a[..., 0]) * np.cos(b[..., 0]) * np.sin((b[..., 1] - a[..., 1]) / 2) ** 2
    return 2 * EARTH_METRES * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def lengths(track: np.ndarray) -> np.ndarray:
    """Metres from the start at each point."""
    t = np.asarray(track, float)
    return np.concatenate(([0.0], np.cumsum(metres(t[:-1], t[1:])))) if len(t) else np.zeros(0)


def at_distance(track: np.ndarray, where: np.ndarray) -> np.ndarray:
    along = lengths(track)
    return np.stack([np.interp(where, along, track[:, i]) for i in (0, 1)], axis=1)


def to_line(point: np.ndarray, track: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each stretch of a track: metres from the point to its nearest place there, and that place's share of the stretch.
    Points of shape (n, 1, 2) give n rows."""
    a, d = track[:-1], np.diff(track, axis=0)
    size = (d**2).sum(axis=1)
    share = np.clip(((point - a) * d).sum(axis=-1) / np.where(size > 0, size, 1), 0, 1)
    share = np.where(size > 0, share, 0.0)
    return metres(point, a + share[..., None] * d), share


def passes(point: np.ndarray, track: np.ndarray, within: float = ENDPOINT_METRES, most: int = 100) -> list[float]:
    """Where a track comes near a point, as point number and share of the stretch; of one pass, its nearest place."""
    away, share = to_line(point, track)
    near = np.flatnonzero(np.diff(np.concatenate(([0], (away < within).astype(np.int8), [0]))))
    out = []
    for start, end in zip(near[::2], near[1::2]):
        i = start + int(np.argmin(away[start:end]))
        out.append(float(i + share[i]))
        if len(out) == most:
            break
    return out


def follows(route: np.ndarray, track: np.ndarray, within: float = ENDPOINT_METRES, samples: int = 6, needed: int = 4) -> bool:
    """Whether a track passes enough of a route's inner points; routes without inner points are followed."""
    picks = [int(math.floor((len(route) - 1) * k / (samples + 1) + 0.5)) for k in range(1, samples + 1)]
    inner = sorted({i for i in picks if 0 < i < len(route) - 1})
    if not inner or len(track) < 2:
        return not inner
    hits = sum(bool((to_line(route[i], track)[0] < within).any()) for i in inner)
    return hits >= min(needed, len(inner))


def segment_matches(track: np.ndarray, slots: np.ndarray, route: np.ndarray, rate: float = 1.0) -> list[tuple[int, int]]:
    """(start, end) seconds of each time that a track rides a route from end to end, one after the other.

    `slots` number the track's samples, `rate` is the seconds of one.
    """
    out, after = [], -1.0
    if len(track) < 2 or len(route) < 2:
        return out
    ends = passes(route[-1], track)
    slot = lambda x: float(np.interp(x, np.arange(len(slots)), slots))
    for start in passes(route[0], track):
        end = next((e for e in ends if e >= start), None)
        if start <= after or end is None or not follows(route, track[int(start) : int(end) + 2]):
            continue
        a, b = math.floor(slot(start) * rate), math.ceil(slot(end) * rate)
        if b > a:
            out.append((a, b))
            after = end
    return out


def near(points: np.ndarray, track: np.ndarray, within: float, cells: int = 1 << 16) -> np.ndarray:
    """Whether a track comes near each point, by `to_line` for so many points at once as make `cells` distances."""
    some = max(1, cells // max(1, len(track)))
    return np.concatenate([(to_line(points[i : i + some, None], track)[0] <= within).any(axis=1) for i in range(0, len(points), some)])


def coverage(a: np.ndarray, b: np.ndarray, within: float = 20.0, every: int = 10) -> float:
    """The share of every tenth point of a (and its last) that is near b."""
    picks = np.unique(np.append(np.arange(0, len(a), every), len(a) - 1))
    return float(np.mean(near(a[picks], b, within))) if len(a) and len(b) > 1 else 0.0


def common(a: np.ndarray, b: np.ndarray) -> float | None:
    """What each of two routes covers of the other, the lesser share; none for strangers, which five points tell mostly."""
    for x, y in ((a, b), (b, a)):
        checks = x[np.linspace(0, len(x) - 1, 5).round().astype(int)]
        if np.mean(near(checks, y, 40.0)) < 0.6:
            return None
    return min(coverage(a, b), coverage(b, a))


def similarity(a: np.ndarray, b: np.ndarray, distance: tuple[float, float], ascent: tuple[float, float]) -> float:
    """Of two routes, 0 to 1: mostly what each covers of the other, the rest closeness in length and climbing."""
    if (shared := common(a, b)) is None:
        return 0.0
    off = lambda p: abs(p[0] - p[1]) / max(1.0, max(p))
    return 0.7 * shared + 0.2 * (1 - off(distance)) + 0.1 * (1 - off(ascent))


def elevation_totals(track: np.ndarray, elevation: np.ndarray, step: float = 25.0, radius: float = 300.0) -> tuple[float, float]:
    """Metres up and down after resampling by distance and a box mean that keeps the net change."""
    ok = np.isfinite(track).all(axis=1) & np.isfinite(elevation)
    along, ele = lengths(track[ok]), np.asarray(elevation, float)[ok]
    if len(ele) < 2:
        return 0.0, 0.0
    last = np.append(np.diff(along) > 0, True)  # of points at one distance the last counts
    along, ele = along[last], ele[last]
    if len(along) < 2:
        return 0.0, 0.0
    even = np.interp(np.append(np.arange(0, along[-1], step), along[-1]), along, ele)
    from wattspark.operators.kernels import half_up, window_mean

    r = max(1, int(half_up(radius / step)))
    smooth = window_mean(even, r, r, np.float64)
    smooth += np.linspace(even[0] - smooth[0], even[-1] - smooth[-1], len(smooth))
    change = np.diff(smooth)
    return float(half_up(change[change > 0].sum())), float(half_up(-change[change < 0].sum()))


def simplified(track: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices that keep a track within `tolerance` metres, ends included (by splitting at the farthest point)."""
    n = len(track)
    keep = np.zeros(n, bool)
    keep[[0, -1]] = n > 0
    open_ = [(0, n - 1)]
    while open_:
        a, b = open_.pop()
        if b - a < 2:
            continue
        line = np.stack([track[a], track[b]])
        away = np.array([to_line(p, line)[0][0] for p in track[a + 1 : b]])
        far = int(np.argmax(away))
        if away[far] > tolerance:
            keep[a + 1 + far] = True
            open_ += [(a, a + 1 + far), (a + 1 + far, b)]
    return np.flatnonzero(keep)


def to_anchors(track: np.ndarray, most: int, tolerance: float = 5.0) -> np.ndarray:
    """Indices of at most `most` points, doubling the tolerance until they suffice."""
    picks = simplified(track, tolerance)
    while len(picks) > max(2, most):
        tolerance *= 2
        picks = simplified(track, tolerance)
    return picks


def polyline6(text: str) -> np.ndarray:
    """Points of an encoded polyline with six digits."""
    values, value, shift = [], 0, 0
    for c in text:
        byte = ord(c) - 63
        value |= (byte & 31) << shift
        shift += 5
        if byte < 32:
            values.append(~(value >> 1) if value & 1 else value >> 1)
            value = shift = 0
    return np.cumsum(np.array(values[: len(values) // 2 * 2], float).reshape(-1, 2), axis=0) / 1e6


def islands(slots: np.ndarray) -> list[tuple[int, int]]:
    """Half-open stretches of consecutive slot numbers."""
    cut = np.flatnonzero(np.diff(slots) != 1) + 1
    edges = [0, *cut.tolist(), len(slots)]
    return [(a, b) for a, b in zip(edges[:-1], edges[1:]) if b > a]


def spacing(track: np.ndarray) -> dict[str, float]:
    """Least, greatest and mean step of a track, and the steps at 50 and 90 % of their order."""
    steps = np.sort(metres(track[:-1], track[1:]))
    pick = lambda p: float(steps[math.floor((len(steps) - 1) * p)])
    return {"min": float(steps[0]), "max": float(steps[-1]), "avg": float(steps.mean()), "p50": pick(0.5), "p90": pick(0.9)} if len(steps) else {}
