"""JSON documents and archives of them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The version of manual-activity documents that is understood.
ACTIVITY_VERSION = 1
_ACTIVITIES = (
    "struct<version:int,activities:array<struct<start_time:timestamp,duration_seconds:double,activity_type:string,average_power:double,"
    "intervals:array<struct<repetitions:int,work_seconds:int,rest_seconds:int,work_power:double,rest_power:double>>>>>"
)
MOST_ENTRY_BYTES = 256 << 20


def parse_activities(texts: DataFrame, text: str = "document", key: str = "path") -> DataFrame:
    """A row for each activity of the documents; those of another version, or no JSON, give none."""
    d = texts.select(key, F.from_json(text, _ACTIVITIES).alias("d")).filter(F.col("d.version") == ACTIVITY_VERSION)
    return d.select(key, F.posexplode("d.activities").alias("position", "a")).select(key, "position", "a.*")


def activity_document(activities: DataFrame, by: str = "uid") -> DataFrame:
    """(by, document): the JSON document of each user's activities, ordered by start."""
    one = F.struct("start_time", "duration_seconds", "activity_type", "average_power", "intervals")
    many = activities.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("start_time", one.alias("a")))).alias("rows"))
    return many.select(by, F.to_json(F.struct(F.lit(ACTIVITY_VERSION).alias("version"), F.transform("rows", lambda r: r["a"]).alias("activities"))).alias("document"))


def unzipped(archives: DataFrame, suffix: str = "") -> DataFrame:
    """(path, entry, content) of the entries of zip files (path, content); broken archives give a row with an error.

    An archive is read in the task that holds it, an entry at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for info in z.infolist():
                            if info.is_dir() or not info.filename.endswith(suffix):
                                continue
                            if info.file_size > MOST_ENTRY_BYTES:
                                yield pd.DataFrame([(path, info.filename, None, "entry too large")], columns=["path", "entry", "content", "error"])
                                continue
                            yield pd.DataFrame([(path, info.filename, z.read(info), None)], columns=["path", "entry", "content", "error"])
                except zipfile.BadZipFile as e:
                    yield pd.DataFrame([(path, None, None, str(e))], columns=["path", "entry", "content", "error"])

    return archives.select("path", "content").mapInPandas(run, "path string, entry string, content binary, error string")


def histograms(rows: DataFrame, column: str = "power_histogram") -> DataFrame:
    """`rows` with encoded histograms decoded: bins map, zero_seconds, missing_seconds, histogram_error."""
    from wattspark.operators.kernels import decode_histogram

    @F.pandas_udf("struct<bins:map<int,bigint>,zero_seconds:bigint,missing_seconds:bigint,error:string>")
    def decode(data: pd.Series) -> pd.DataFrame:
        out = []
        for x in data:
            try:
                h = decode_histogram(bytes(x)) if x is not None else None
                out.append((h["bins"], h["zero"], h["missing"], None) if h else (None, None, None, None))
            except ValueError as e:
                out.append((None, None, None, str(e)))
        return pd.DataFrame(out, columns=["bins", "zero_seconds", "missing_seconds", "error"])

    return rows.withColumn("_h", decode(column)).select("*", "_h.bins", "_h.zero_seconds", "_h.missing_seconds", F.col("_h.error").alias("histogram_error")).drop("_h")
