import numpy as np
import pytest

from wattspark.operators.intensity import TAGS, classify, features

FTP, CURVE = 250, {30: 520, 60: 430, 120: 360, 240: 315, 480: 285, 900: 265, 1200: 260}


def judge(*parts):
    f = features(np.concatenate([np.full(n, w, float) for w, n in parts]))
    return classify(f, FTP, CURVE, 100)


def test_steady_rides():
    easy = judge((120, 3600))
    assert (easy["profile"], easy["structure"], easy["dose"]) == ("recovery", "steady", "low")
    aerobic = judge((175, 5400))
    assert (aerobic["profile"], aerobic["structure"], aerobic["dose"]) == ("endurance", "steady", "moderate")
    assert judge((210, 3600))["profile"] == "tempo"


def test_long_intervals():
    c = judge((150, 900), (310, 240), (120, 360), (305, 240), (150, 900))
    assert (c["profile"], c["structure"], c["dose"], c["vo2_blocks"]) == ("vo2max", "intervals", "moderate", 2)
    assert judge((150, 900), (240, 1200), (150, 900))["profile"] == "threshold"


def test_micro_intervals():
    c = judge((150, 600), *[(340, 30), (110, 30)] * 10, (150, 600))
    assert (c["profile"], c["structure"], c["micro_series"], c["micro_repetitions"], c["anaerobic_blocks"]) == ("vo2max", "intervals", 1, 10, 0)
    assert c["tags"] >> TAGS.index("vo2max") & 1


def test_little_power_and_no_model():
    assert judge((0, 600))["profile"] == "unknown"
    assert classify(features(np.full(600, 200.0)), None, {}, 0)["profile"] == "unknown"


def test_features():
    f = features(np.array([120.0] * 300 + [310] * 240 + [100] * 240 + [300] * 240 + [120] * 300))
    assert [round(w) for _, w in f["efforts"][240][:2]] == [310, 300] and len(f["efforts"][240]) == 3
    assert f["normalized_power"] > f["average_power"] and f["histogram"].sum() == 1320
    assert features(np.zeros(0))["seconds"] == 0
