"""Recordings, backups and sweeps on small tables, against values worked out by hand or plain Python."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from wattspark.operators import recordings
from wattspark.sources import backup, documents
from wattspark.streaming import upkeep

LAPS = "workout_id long, lap_index int, lap_trigger int, start_time double, timestamp double, total_timer_time double, total_elapsed_time double"


def samples(spark, values, column="power"):
    return spark.createDataFrame([(1, i, None if v is None else float(v)) for i, v in enumerate(values)], f"workout_id long, idx long, {column} double")


def series(frame, column):
    return [r[column] for r in frame.orderBy("idx").collect()]


def test_stabilised_leaves_ends_gaps_and_jumps(spark):
    values = [100, 104, 100, 104, 100, None, 100, 104, 100, 400, 100, 104, 100]
    got = series(recordings.stabilised(samples(spark, values), "power", (1, 2, 1), 20, 10), "power")
    want = list(values)
    for i in range(1, len(values) - 1):
        near = values[i - 1 : i + 2]
        if None not in near and max(near) - min(near) <= 20:
            want[i] = (near[0] + 2 * near[1] + near[2]) / 4
    assert got == want
    assert got[1] == 102 and got[9] == 400 and got[0] == 100


def test_stabilised_wants_odd_weights(spark):
    with pytest.raises(ValueError):
        recordings.stabilised(samples(spark, [1, 2]), "power", (1, 1), 1, 1)


def test_dequantised_speed_needs_a_moving_window(spark):
    rows = [(1, i, 36.0, i * 0.0101) for i in range(9)] + [(2, i, 36.0, 0.0) for i in range(9)] + [(3, i, 35.0, i * 0.0101) for i in range(9)]
    s = spark.createDataFrame(rows, "workout_id long, idx long, speed double, distance double")
    got = {(r.workout_id, r.idx): r.speed for r in recordings.dequantised_speed(s).collect()}
    assert got[1, 4] == pytest.approx(36.36) and got[1, 2] == got[1, 7] == 36.0
    assert got[2, 4] == 36.0 and got[3, 4] == 35.0


def test_laps_by_their_own_times_or_in_proportion(spark):
    laps = [
        (1, 0, 0, 1000.0, 1040.0, 40.0, None),  # own times, manual
        (1, 1, 1, 1040.0, None, 60.0, None),  # its end from its duration
        (1, 2, 7, 1000.0, 1100.0, 100.0, None),  # the session's envelope
        (2, 0, 0, 1000.0, 1100.0, 100.0, None),  # a sole lap
        (3, 0, 1, None, None, None, 30.0),
        (3, 1, None, None, None, 10.0, 90.0),
        (3, 2, 1, None, None, None, None),  # nothing known
        (4, 0, 1, 1000.0, 1001.0, 1.0, None),  # a recording of one sample
        (4, 1, 1, 1001.0, 1002.0, 1.0, None),
    ]
    held = spark.createDataFrame([(1, 100, 1000.0), (2, 100, 1000.0), (3, 101, 1000.0), (4, 1, 1000.0)], "workout_id long, record_count long, base_time double")
    got = sorted(map(tuple, recordings.lap_segments(spark.createDataFrame(laps, LAPS), held).collect()))
    assert got == [(1, 0, 3, 0, 40, 40), (1, 1, 1, 40, 99, 59), (3, 0, 1, 0, 75, 75), (3, 1, 1, 75, 100, 25)]


def test_no_laps(spark):
    held = spark.createDataFrame([(1, 100, 1000.0)], "workout_id long, record_count long, base_time double")
    assert recordings.lap_segments(spark.createDataFrame([], LAPS), held).count() == 0


def test_range_means_and_manual_segments(spark):
    s = samples(spark, [10, 20, None, 40, 50]).withColumn("altitude", F.col("idx") * 2.0)
    ranges = spark.createDataFrame([(1, 4, 0), (1, 1, 3), (1, 2, 3), (1, 0, 9)], "workout_id long, a int, b int")
    got = sorted(map(tuple, recordings.manual_segments(ranges, s, ["power"], "altitude").collect()))
    assert got == [(1, 0, 4, 4, 18.0, 8.0), (1, 1, 3, 2, 10.0, 4.0)]


def test_pedal_metrics_without_turning(spark):
    s = samples(spark, [100, None, 201]).withColumn("cadence", F.lit(0))
    row = recordings.pedal_metrics(s).collect()[0]
    assert (row.avg_power, row.max_power, row.avg_cadence, row.max_cadence) == (151.0, 201.0, 0.0, 0.0)


def test_projection_begins_at_the_first_point(spark):
    track = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 0.0, 10.001), (2, 0, 5.0, 5.0)], "workout_id long, idx long, lat double, lng double")
    got = [(r.workout_id, r.idx, round(r.x, 6), r.y) for r in recordings.local_projection(track).orderBy("workout_id", "idx").collect()]
    assert got == [(1, 0, 0.0, 0.0), (1, 1, 111.32, 0.0)]


def test_pages_do_not_depend_on_the_spans(spark):
    rows = spark.createDataFrame([(i * 7,) for i in range(50)], "id long")
    pages = lambda width: {r.id: r.page for r in backup.paged(rows, 8, width=width).collect()}
    assert pages(13) == pages(65_536) == {i * 7: i // 8 for i in range(50)}


def test_backup_round_trip_and_problems(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else f"line\n{i}", dt.date(2024, 1, 1)) for i in range(1, 252)], "id long, name string, day date")
    chunks = backup.backup_chunks(rows)
    assert [(r.chunk, r.first_id, r.last_id, r.n_rows) for r in chunks.orderBy("chunk").collect()] == [(0, 1, 100, 100), (1, 101, 200, 100), (2, 201, 251, 51)]
    assert backup.chunk_problems(chunks).count() == 0
    assert sorted(map(str, backup.restored(chunks, rows.schema).collect())) == sorted(map(str, rows.collect()))
    broken = chunks.filter("chunk <> 1").withColumn("content", F.when(F.col("chunk") == 0, "{}").otherwise(F.col("content")))
    assert sorted(map(tuple, backup.chunk_problems(broken).collect())) == [(0, "digest"), (2, "gap")]
    with pytest.raises(Exception, match="wrong digest"):
        backup.restored(broken, rows.schema).collect()
    assert backup.backup_chunks(rows.limit(0)).count() == 0


def test_segment_archives_round_trip(spark):
    rows = spark.createDataFrame([("a/1", 5, 10.5), ("b", 5, None), ("c", 6, 1.0)], "id string, uid long, distance double")
    archives = backup.segment_archives(rows, "segments", "2024-01-01T00:00:00Z")
    found = documents.unzipped(archives.select(F.col("uid").cast("string").alias("path"), "content")).collect()
    held = {(r.path, r.entry): json.loads(bytes(r.content)) for r in found}
    assert held["5", "segments/segment-a_1.json"] == {"id": "a/1", "uid": 5, "distance": 10.5}
    assert held["5", "manifest.json"]["segmentCount"] == 2 and held["6", "manifest.json"]["segmentCount"] == 1
    assert len(held) == 5


def test_batches_sweeps_and_progress(spark):
    rows = spark.createDataFrame([(i, i % 2, 1) for i in range(10)], "id long, uid long, import_job_id long")
    assert {r.id: r.batch for r in upkeep.micro_batches(rows, size=2).collect()} == {i: i // 2 // 2 for i in range(10)}
    day = lambda n: dt.datetime(2024, 1, n)
    jobs = spark.createDataFrame([(3, "failed", day(1)), (2, "completed", day(1)), (4, "running", day(1)), (5, "failed", day(20))], "id long, status string, updated_at timestamp_ntz")
    now = F.lit("2024-01-21 00:00:00").cast("timestamp_ntz")
    doomed = upkeep.doomed_jobs(jobs, now, limit=1)
    assert [r.id for r in doomed.collect()] == [2]
    assert sorted(r.id for r in upkeep.swept(jobs, doomed).collect()) == [3, 4, 5]
    users = spark.createDataFrame([(1, "pending_deletion", day(2)), (2, "active", day(1)), (3, "pending_deletion", day(30))], "id long, account_status string, deletion_scheduled_for timestamp_ntz")
    assert [r.id for r in upkeep.due_accounts(users, now).collect()] == [1]
    counted, seen = upkeep.observed(rows, "import", most=F.max("id"))
    counted.collect()
    assert seen.get == {"rows": 10, "most": 9}
