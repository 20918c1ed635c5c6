import math

import numpy as np
import pytest

from wattspark.operators import kernels as k
from wattspark.operators import tracks as t


def curve(d):
    return 510 - 35 * math.log(d)


def test_robust_ftp():
    clean = {d: curve(d) for d in (360, 480, 720, 900, 960)}
    ftp, points = k.robust_ftp(clean)
    assert points == 5 and abs(ftp - 0.95 * curve(1200)) < 0.01
    assert abs(k.robust_ftp(clean | {360: curve(360) + 80})[0] - ftp) < 8
    assert k.robust_ftp({480: 280, 900: 260})[1] == 2
    assert k.robust_ftp({480: 280}) is None


def test_normalized_power():
    assert k.normalized_power(np.full(60, 200.0)) == 200
    assert k.normalized_power(np.array([np.nan] + [200.0] * 29)) == 193
    assert k.normalized_power(np.array([0.0] * 30 + [400.0] * 30)) > 200
    assert k.normalized_power(np.zeros(0)) == 0


def test_best_windows():
    p = np.full(240, 100.0)
    p[80:150] = 320
    assert k.best_window(p, 60) == (80, 320.0)
    assert k.best_window(p, 241) is None
    assert [s for s, _ in k.best_apart(p, 60, 2)][0] == 80


def test_histogram_round_trip():
    data = k.encode_histogram({19: 1, 20: 1, 99: 1, 199: 1, 200: 1}, 1, 1)
    assert len(data) < 30
    back = k.decode_histogram(data)
    assert back["bins"] == {19: 1, 20: 1, 99: 1, 199: 1, 200: 1} and back["zero"] == back["missing"] == 1
    assert k.decode_histogram(b"nothing at all") is None
    with pytest.raises(ValueError):
        k.decode_histogram(data[:-1])


def test_spikes():
    p = np.array([300, 305, 310, 312, 1260, 1260, 128, 128, 130, 125.0])
    flat = np.full(len(p), 80.0)
    out, where = k.spikes_removed(p, flat, flat, flat)
    assert where == [(4, 6)] and out[4:6].tolist() == [251, 189]
    assert k.spikes_removed(p, np.where(p > 800, 120, 80.0), np.where(p > 800, 120, 80.0), flat)[1] == []


def test_intervals():
    p = np.concatenate([np.full(300, 100.0), np.full(60, 300.0), np.full(300, 100.0), np.full(60, 300.0)])
    found = k.intervals(p)
    assert len(found) == 1 and 50 <= found[0]["duration"] <= 70


def test_terrain():
    s = np.arange(3600)
    assert k.terrain(np.full(3600, np.nan), s * 8.0) == "altitude_missing"
    assert k.terrain(np.where(s > 1800, 130.0, 100.0), s * 8.0) == "altitude_invalid"
    assert k.terrain(100 + 0.015 * np.minimum(s, 100) * 8, s * 8.0) == "flat"
    assert k.terrain(100 + 0.05 * np.minimum(s, 1200) * 5.0, s * 5.0) == "mountainous"
    assert k.terrain(100 + 15 * (1 - np.cos(s / 60 * math.pi * 0.6)), s * 8.0) == "rolling"


def test_gaps():
    at, out, made = k.fill_gaps(np.array([0, 1, 4, 20]), {"power": np.array([100, 100, 400, np.nan]), "balance": np.array([50, 51, 52, 53.0])}, ("balance",))
    assert at.tolist() == [0, 1, 2, 3, 4, 20]
    assert out["power"][:5].tolist() == [100, 100, 200, 300, 400] and out["balance"].tolist() == [50, 51, 51, 51, 52, 53]
    assert made.tolist() == [False, False, True, True, False, False]


def test_elevation_totals():
    n = 801
    track = np.stack([np.full(n, 48.0), 8 + np.linspace(0, 20_000, n) / (111_195 * math.cos(math.radians(48)))], axis=1)
    ele = 500 + 1000 * (1 - np.abs(np.linspace(-1, 1, n))) + 12 * np.where(np.arange(n) % 2, 1, -1)
    up, down = t.elevation_totals(track, ele)
    assert 950 <= up <= 1050 and 950 <= down <= 1050


def test_segment_match():
    track = np.array([[48.0, 8.0], [48.0, 8.001], [48.0, 8.002], [48.0, 8.003]])
    route = np.array([[48.0, 8.0002], [48.0, 8.0015], [48.0, 8.0028]])
    found = t.segment_matches(track, np.arange(100, 104), route, 5)
    assert len(found) == 1 and found[0][0] >= 500 and found[0][1] > found[0][0]


def test_tracks():
    line = np.stack([np.full(50, 48.0), np.linspace(8, 8.05, 50)], axis=1)
    assert t.simplified(line, 1).tolist() == [0, 49]
    assert t.similarity(line, line, (1000, 1000), (10, 10)) == pytest.approx(1)
    assert t.islands(np.array([1, 2, 3, 7, 8])) == [(0, 3), (3, 5)]
    assert np.allclose(t.polyline6("_izlhA~rlgdF_{geC~ywl@_kwzCn`{nI"), [[38.5, -120.2], [40.7, -120.95], [43.252, -126.453]])
