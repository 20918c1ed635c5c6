"""Logical backups in numbered chunks with digests, and archives of segments."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNK_ROWS = 100
ARCHIVE_VERSION = 1


def paged(rows: DataFrame, size: int, key: str = "id", name: str = "page", width: int = 65_536) -> DataFrame:
    """Rows with the number of their page in a scan by `key` (whole numbers, told apart), `size` rows a page.

    Ranks are counted within spans of `width` keys and moved by the number of rows in earlier spans, so only the
    counts of spans meet in one task.
    """
    spans = rows.withColumn("__span", F.floor(F.col(key) / width))
    earlier = Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    before = spans.groupBy("__span").agg(F.count(F.lit(1)).alias("__n")).select("__span", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__span").orderBy(key)) - 1 + F.col("__before")
    return spans.join(before, "__span").select(*rows.columns, F.floor(place / size).alias(name))


def backup_chunks(rows: DataFrame, key: str = "id", size: int = CHUNK_ROWS) -> DataFrame:
    """(chunk, first_id, last_id, n_rows, content, sha256): the rows as lines of JSON, `size` to a chunk in the order of `key`."""
    line = F.struct(F.col(key).alias("k"), F.to_json(F.struct(*rows.columns)).alias("line"))
    chunks = paged(rows, size, key, "chunk").groupBy("chunk").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    content = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    found = chunks.select("chunk", F.element_at("lines", 1)["k"].alias("first_id"), F.element_at("lines", -1)["k"].alias("last_id"), F.size("lines").cast("long").alias("n_rows"), content.alias("content"))
    return found.withColumn("sha256", F.sha2("content", 256))


def chunk_problems(chunks: DataFrame) -> DataFrame:
    """(chunk, problem): chunks whose digest or number of rows is wrong, that overlap the one before or come after a gap."""
    own = chunks.select("chunk", F.when(F.sha2("content", 256) != F.col("sha256"), "digest").when(F.size(F.split("content", "\n")) != F.col("n_rows"), "rows").alias("problem"))
    before = chunks.select((F.col("chunk") + 1).alias("chunk"), F.col("last_id").alias("__last"))
    order = chunks.select("chunk", "first_id").join(before, "chunk", "left")
    gap = F.when(F.col("__last").isNull() & (F.col("chunk") > 0), "gap").when(F.col("first_id") <= F.col("__last"), "overlap")
    return own.unionByName(order.select("chunk", gap.alias("problem"))).filter("problem IS NOT NULL")


def restored(chunks: DataFrame, schema: StructType) -> DataFrame:
    """The rows of chunks; a chunk whose digest is wrong fails the read."""
    checked = F.when(F.sha2("content", 256) == F.col("sha256"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("wrong digest in chunk "), F.col("chunk"))))
    lines = chunks.select(F.explode(F.split(checked, "\n")).alias("line"))
    return lines.select(F.from_json("line", schema).alias("row")).select("row.*")


def segment_archives(segments: DataFrame, format_name: str, exported_at: str, by: str = "uid", key: str = "id") -> DataFrame:
    """(by, content): a zip file of each owner's segments, one JSON document each, and a manifest.

    The JSON is made by Spark; a task packs one owner's archive at a time.
    """
    entry = F.concat(F.lit("segments/segment-"), F.regexp_replace(F.col(key).cast("string"), "[^a-zA-Z0-9_-]", "_"), F.lit(".json"))
    lines = segments.select(by, entry.alias("entry"), F.to_json(F.struct(*segments.columns)).alias("line"))
    head = segments.groupBy(by).agg(F.count(F.lit(1)).alias("segmentCount"))
    manifest = F.to_json(F.struct(F.lit(format_name).alias("format"), F.lit(ARCHIVE_VERSION).alias("version"), F.lit(exported_at).alias("exportedAt"), "segmentCount"))
    lines = lines.unionByName(head.select(by, F.lit("manifest.json").alias("entry"), manifest.alias("line")))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for name, line in sorted(zip(pdf["entry"], pdf["line"])):
                z.writestr(zipfile.ZipInfo(name), line, zipfile.ZIP_DEFLATED)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "content": [held.getvalue()]})

    return lines.groupBy(by).applyInPandas(pack, f"{by} {segments.schema[by].dataType.simpleString()}, content binary")
