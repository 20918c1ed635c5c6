import io
import zipfile

from pyspark.sql import functions as F

from wattspark.operators.kernels import encode_histogram
from wattspark.sources import documents, gpx
from wattspark.streaming import incremental


def test_gpx_round_trip(spark):
    track = [(48.0, 8.0, 500.0), (48.001, 8.0, None), (48.002, 8.001, 502.5)]
    rows = spark.createDataFrame([("a", "Hill & <Dale>", track)], "path string, name string, track array<struct<lat:double,lng:double,ele:double>>")
    built = gpx.build(rows)
    back = gpx.parse(built).orderBy("idx").collect()
    assert [(r.lat, r.lng, r.ele) for r in back] == track
    assert "Hill &amp; &lt;Dale&gt;" in built.first().gpx


def test_gpx_filters(spark):
    text = '<gpx><rte><rtept lat="48" lon="8"><ele>99999</ele></rtept><rtept lat="48.000001" lon="8"/><rtept lat="95" lon="8"/><rtept lat="48.1" lon="8"/></rte></gpx>'
    got = gpx.parse(spark.createDataFrame([("a", text), ("b", "<gpx/>")], "path string, gpx string")).orderBy("idx").collect()
    assert [(r.path, r.lat, r.ele) for r in got] == [("a", 48.0, None), ("a", 48.1, None)]


def test_activity_documents(spark):
    good = '{"version":1,"activities":[{"start_time":"2026-01-01T10:00:00Z","duration_seconds":3600,"activity_type":"cycling","intervals":[{"repetitions":3,"work_seconds":120}]}]}'
    texts = spark.createDataFrame([("a", good), ("b", '{"version":2,"activities":[]}'), ("c", "oops")], "path string, document string")
    got = documents.parse_activities(texts)
    assert got.count() == 1 and got.first().intervals[0].repetitions == 3
    again = documents.activity_document(got.withColumn("uid", F.lit(1)))
    assert documents.parse_activities(again.select(F.lit("x").alias("path"), "document")).count() == 1


def test_archives_and_histograms(spark):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a/one.json", "{}")
        z.writestr("two.txt", "x")
    rows = spark.createDataFrame([("p", held.getvalue()), ("q", b"no zip")], "path string, content binary")
    got = {(r.path, r.entry): r.error for r in documents.unzipped(rows, ".json").collect()}
    assert got[("p", "a/one.json")] is None and got[("q", None)] and len(got) == 2
    h = spark.createDataFrame([(1, encode_histogram({3: 7}, 1, 2)), (2, None), (3, encode_histogram({3: 7})[:-1] + b"\x00")], "id long, power_histogram binary")
    out = {r.id: r for r in documents.histograms(h).collect()}
    assert out[1].bins == {3: 7} and out[1].missing_seconds == 2 and out[2].bins is None and out[3].histogram_error


def test_stream_batches_run_once(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(10).withColumnRenamed("id", "n").write.parquet(source)
    out, calls = str(tmp_path / "out"), []

    def step(df, number):
        calls.append(number)
        df.write.mode("append").parquet(out)

    for _ in range(2):
        stream = spark.readStream.schema("n long").parquet(source)
        incremental.run_batches(stream, str(tmp_path / "state"), str(tmp_path / "ledger"), step).awaitTermination(60)
    spark.range(10, 15).withColumnRenamed("id", "n").write.mode("append").parquet(source)
    incremental.run_batches(spark.readStream.schema("n long").parquet(source), str(tmp_path / "state"), str(tmp_path / "ledger"), step).awaitTermination(60)
    assert len(calls) == 2 and spark.read.parquet(out).count() == 15
    # a batch that is in the ledger is not run again, even if the stream's own state is lost
    incremental.run_batches(spark.readStream.schema("n long").parquet(source), str(tmp_path / "other"), str(tmp_path / "ledger"), step).awaitTermination(60)
    assert len(calls) == 2


def test_affected_windows(spark):
    rows = spark.createDataFrame([(1, "2020-01-01"), (1, "2020-06-01"), (1, "2023-01-01")], "uid long, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = incremental.affected_windows(rows, ["uid"], "t").orderBy("start").collect()
    assert [(str(r.start)[:10], str(r.end)[:10]) for r in got] == [("2020-01-01", "2021-06-01"), ("2023-01-01", "2024-01-01")]
