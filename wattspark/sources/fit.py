"""FIT files: a decoder for the messages that training data needs, and a writer.

The format is public: a header, records that define or carry messages, and a CRC. Fields are decoded by
their base type; the type's invalid value becomes null.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

EPOCH = datetime(1989, 12, 31, tzinfo=timezone.utc)

#: Fixed values of the format. Base type number: struct code and invalid value.
BASE_TYPES = {0x00: ("B", 0xFF), 0x01: ("b", 0x7F), 0x02: ("B", 0xFF), 0x83: ("h", 0x7FFF), 0x84: ("H", 0xFFFF), 0x85: ("i", 0x7FFFFFFF), 0x86: ("I", 0xFFFFFFFF), 0x88: ("f", None), 0x89: ("d", None), 0x0A: ("B", 0), 0x8B: ("H", 0), 0x8C: ("I", 0), 0x8E: ("q", 2**63 - 1), 0x8F: ("Q", 2**64 - 1), 0x90: ("Q", 0)}
#: Message number, then field number: name, scale, offset.
FIELDS = {
    0: {0: ("type", 1, 0), 1: ("manufacturer", 1, 0), 2: ("product", 1, 0), 3: ("serial_number", 1, 0), 4: ("time_created", 1, 0)},
    18: {253: ("timestamp", 1, 0), 2: ("start_time", 1, 0), 5: ("sport", 1, 0), 6: ("sub_sport", 1, 0), 7: ("total_elapsed_time", 1000, 0), 8: ("total_timer_time", 1000, 0), 9: ("total_distance", 100, 0), 11: ("total_calories", 1, 0), 20: ("avg_power", 1, 0), 21: ("max_power", 1, 0), 22: ("total_ascent", 1, 0), 23: ("total_descent", 1, 0), 34: ("normalized_power", 1, 0)},
    19: {253: ("timestamp", 1, 0), 2: ("start_time", 1, 0), 7: ("total_elapsed_time", 1000, 0), 8: ("total_timer_time", 1000, 0), 9: ("total_distance", 100, 0), 19: ("avg_power", 1, 0), 24: ("lap_trigger", 1, 0)},
    20: {253: ("timestamp", 1, 0), 0: ("lat", 2**31 / 180, 0), 1: ("lng", 2**31 / 180, 0), 2: ("altitude", 5, 500), 3: ("heart_rate", 1, 0), 4: ("cadence", 1, 0), 5: ("distance", 100, 0), 6: ("speed", 1000, 0), 7: ("power", 1, 0), 13: ("temperature", 1, 0), 30: ("left_right_balance", 1, 0)},
    23: {253: ("timestamp", 1, 0), 0: ("device_index", 1, 0), 1: ("device_type", 1, 0), 2: ("manufacturer", 1, 0), 3: ("serial_number", 1, 0), 4: ("product", 1, 0)},
}
NAMES = {0: "file_id", 18: "session", 19: "lap", 20: "record", 23: "device"}
_CRC = (0x0000, 0xCC01, 0xD801, 0x1400, 0xF001, 0x3C00, 0x2800, 0xE401, 0xA001, 0x6C00, 0x7800, 0xB401, 0x5000, 0x9C01, 0x8801, 0x4400)


def crc(data: bytes) -> int:
    out = 0
    for byte in data:
        for nibble in (byte & 15, byte >> 4):
            out = out >> 4 & 0x0FFF ^ _CRC[out & 15] ^ _CRC[nibble]
    return out


def when(seconds: float) -> datetime:
    return (EPOCH + timedelta(seconds=seconds)).replace(tzinfo=None)


def decode(data: bytes, check: bool = True) -> dict[str, list[dict]]:
    """Messages by kind, in order. Unknown messages and fields, and developer fields, are passed over by their
    size. ValueError for bytes that are no FIT file, end early or fail their CRC."""
    if len(data) < 12 or data[8:12] != b".FIT":
        raise ValueError("not a FIT file")
    head, size = data[0], struct.unpack_from("<I", data, 4)[0]
    end = head + size
    if head < 12 or len(data) < end + 2:
        raise ValueError("the file ends early")
    if check and crc(data[: end]) != struct.unpack_from("<H", data, end)[0]:
        raise ValueError("CRC mismatch")
    out: dict[str, list[dict]] = {n: [] for n in NAMES.values()}
    defined: dict[int, tuple] = {}
    at, clock = head, 0
    while at < end:
        mark = data[at]
        at += 1
        if mark & 0x80:  # a data message with its time in five bits
            local, offset = mark >> 5 & 3, mark & 31
            clock += (offset - clock) & 31
            short = True
        else:
            local, short = mark & 15, False
        if mark & 0xC0 == 0x40:
            order = ">" if data[at + 1] else "<"
            number, n = struct.unpack_from(order + "HB", data, at + 2)
            at += 5
            fields = [tuple(data[at + 3 * i : at + 3 * i + 3]) for i in range(n)]
            at += 3 * n
            extra = 0
            if mark & 0x20:
                extra = sum(data[at + 2 + 3 * i] for i in range(data[at]))
                at += 1 + 3 * data[at]
            defined[local] = (order, number, fields, extra)
            continue
        if local not in defined:
            raise ValueError("a message without its definition")
        order, number, fields, extra = defined[local]
        known, row = FIELDS.get(number, {}), {}
        for field, width, base in fields:
            code, invalid = BASE_TYPES.get(base, (None, None))
            if field == 253 and base == 0x86 and width == 4:
                clock = struct.unpack_from(order + "I", data, at)[0]
            if field in known and code and width == struct.calcsize("=" + code):
                value = struct.unpack_from(order + code, data, at)[0]
                name, scale, offset = known[field]
                row[name] = None if value == invalid or value != value else value / scale - offset if scale != 1 or offset else value
            at += width
        at += extra
        if at > end:
            raise ValueError("the file ends within a message")
        if short:
            row["timestamp"] = clock
        if number in NAMES:
            out[NAMES[number]].append(row)
    return out


def encode(sessions: list[dict], laps: list[dict], records: list[dict], created: int) -> bytes:
    """A FIT activity file of decoded messages; times are seconds of the format's epoch. Nulls become invalid values."""
    codes = {"timestamp": 0x86, "start_time": 0x86, "time_created": 0x86, "lat": 0x85, "lng": 0x85, "distance": 0x86, "total_distance": 0x86, "total_elapsed_time": 0x86, "total_timer_time": 0x86, "heart_rate": 0x02, "cadence": 0x02, "temperature": 0x01, "type": 0x00, "sport": 0x00, "sub_sport": 0x00, "lap_trigger": 0x00, "left_right_balance": 0x02, "serial_number": 0x8C}
    body = bytearray()
    for local, (number, rows) in enumerate(((0, [{"type": 4, "manufacturer": 255, "product": 0, "time_created": created}]), (20, records), (19, laps), (18, sessions))):
        used = [(f, *FIELDS[number][f]) for f in sorted(FIELDS[number], reverse=True) if any(r.get(FIELDS[number][f][0]) is not None for r in rows)]
        if not rows or not used:
            continue
        kinds = [codes.get(name, 0x84) for _, name, _, _ in used]
        body += struct.pack("<BBBHB", 0x40 | local, 0, 0, number, len(used))
        for (field, *_), base in zip(used, kinds):
            body += bytes((field, struct.calcsize("=" + BASE_TYPES[base][0]), base))
        shape = "<B" + "".join(BASE_TYPES[b][0] for b in kinds)
        for r in rows:
            values = [BASE_TYPES[b][1] if r.get(n) is None else round((r[n] + o) * s) for (_, n, s, o), b in zip(used, kinds)]
            body += struct.pack(shape, local, *values)
    head = struct.pack("<BBHI4s", 14, 0x20, 2132, len(body), b".FIT")
    data = head + struct.pack("<H", crc(head)) + bytes(body)
    return data + struct.pack("<H", crc(data))


RECORD_SCHEMA = "path string, idx long, t timestamp, lat double, lng double, altitude double, heart_rate int, cadence int, distance double, speed double, power int, temperature int"
SESSION_SCHEMA = "path string, position int, start_time timestamp, sport int, total_elapsed_time double, total_timer_time double, total_distance double, total_calories int, avg_power int, max_power int, total_ascent int, total_descent int, error string"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("pathGlobFilter", "*.fit").option("recursiveFileLookup", "true").format("binaryFile").load(path).select("path", "content")


def records(files: DataFrame) -> DataFrame:
    """The records of FIT files (path, content); broken files give none (see `sessions` for their errors)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    found = decode(bytes(content))["record"]
                except (ValueError, struct.error, IndexError):
                    continue
                rows = [(path, i, when(r["timestamp"]) if r.get("timestamp") else None, *[r.get(c) for c in names[3:]]) for i, r in enumerate(found)]
                yield pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in ("heart_rate", "cadence", "power", "temperature")})

    return files.mapInPandas(run, RECORD_SCHEMA)


def sessions(files: DataFrame) -> DataFrame:
    """The sessions of FIT files; a broken file gives a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SESSION_SCHEMA.split(", ")]
        whole = ("sport", "total_calories", "avg_power", "max_power", "total_ascent", "total_descent")
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    for i, s in enumerate(decode(bytes(content))["session"]):
                        rows.append((path, i, when(s["start_time"]) if s.get("start_time") else None, *[s.get(c) for c in names[3:-1]], None))
                except (ValueError, struct.error, IndexError) as e:
                    rows.append((path, None, None, *[None] * (len(names) - 4), str(e)))
            yield pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in (*whole, "position")})

    return files.mapInPandas(run, SESSION_SCHEMA)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return records(_files(spark, path))
