import struct

import pytest

from wattspark.sources import fit


def sample():
    records = [{"timestamp": 1000 + i, "lat": 48.0 + i / 1e4, "lng": 8.0, "altitude": 500.2, "heart_rate": 120 + i, "cadence": None if i == 1 else 90, "distance": 8.0 * i, "speed": 8.0, "power": 200 + i} for i in range(3)]
    session = {"timestamp": 1003, "start_time": 1000, "sport": 2, "total_elapsed_time": 3.0, "total_timer_time": 3.0, "total_distance": 16.0, "avg_power": 201}
    return fit.encode([session], [{"timestamp": 1003, "start_time": 1000, "total_timer_time": 3.0, "lap_trigger": 0}], records, 999)


def test_round_trip():
    got = fit.decode(sample())
    assert [r["power"] for r in got["record"]] == [200, 201, 202]
    assert got["record"][1]["cadence"] is None and got["record"][0]["altitude"] == pytest.approx(500.2)
    assert got["record"][2]["lat"] == pytest.approx(48.0002, abs=1e-6)
    assert got["session"][0]["total_distance"] == 16 and got["lap"][0]["start_time"] == 1000


def test_big_endian_developer_fields_and_short_times():
    body = bytes((0x60, 0, 1)) + struct.pack(">HB", 20, 2) + bytes((253, 4, 0x86, 7, 2, 0x84)) + bytes((1, 0, 3, 0))
    body += b"\x00" + struct.pack(">IH", 1000, 250) + b"xyz"
    body += bytes((0x41, 0, 0)) + struct.pack("<HB", 20, 1) + bytes((7, 2, 0x84))
    body += bytes((0x80 | 1 << 5 | (1005 & 31),)) + struct.pack("<H", 260)
    head = struct.pack("<BBHI4s", 12, 0x20, 1, len(body), b".FIT")
    data = head + body
    got = fit.decode(data + struct.pack("<H", fit.crc(data)))["record"]
    assert [(r["timestamp"], r["power"]) for r in got] == [(1000, 250), (1005, 260)]


def test_broken_files(spark):
    good = sample()
    for bad in (b"", b"x" * 40, good[:-3], good[:40] + bytes((good[40] ^ 255,)) + good[41:]):
        with pytest.raises(ValueError):
            fit.decode(bad)
    files = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(good[:-3]))], "path string, content binary")
    assert fit.records(files).count() == 3
    rows = {r.path: r for r in fit.sessions(files).collect()}
    assert rows["a"].avg_power == 201 and rows["a"].error is None and rows["b"].error
