"""Shared-folder tables and small helpers of the text operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and the controls tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a folder of this machine where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local:")) and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="wattspark-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes `df` as a table in the shared folder and reads it again, so that lost executors lose none of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._table_path = path
    return again


def forget(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_table_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def settle(spark: SparkSession) -> None:
    """Has the driver collect its garbage: Spark deletes a finished plan's shuffle files only after that."""
    gc.collect()
    spark._jvm.System.gc()


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names like `names` that no column of `docs` has."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def chosen_rows(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, mark: Column) -> DataFrame:
    """The rows of `docs` whose id and `mark` are in `chosen`, a written table (id, mark, single), with all their columns.

    Where `single` is true, one of the rows that share id and mark: that of the longest text. Null ids match
    null ids. Clashing column names don't matter.
    """
    own, k_id, k_mark, k_single = fresh(docs, "own_mark", "kept_id", "kept_mark", "kept_single")
    keyed = docs.withColumn(own, mark)
    keys = chosen.select(F.col("id").alias(k_id), F.col("mark").alias(k_mark), F.col("single").alias(k_single))
    hit = keyed.join(keys, F.col(f"`{id_col}`").eqNullSafe(F.col(k_id)) & (F.col(own) == F.col(k_mark)))
    out = hit.filter(~F.col(k_single)).select(*columns_of(docs))
    if chosen.filter("single").isEmpty():
        return out
    row = F.max_by(F.struct(*columns_of(docs)), F.struct(F.length(f"`{text_col}`"), F.col(f"`{text_col}`")))
    return out.unionByName(hit.filter(k_single).groupBy(k_id, k_mark).agg(row.alias("row")).select("row.*"))


_kept: dict[tuple, object] = {}


def kept_by_worker(key: tuple, build):
    """What `build` gives, kept by this Python worker for its next tasks; it keeps one such thing at a time."""
    if key not in _kept:
        released_by_worker()
        _kept[key] = build()
    return _kept[key]


def give_back() -> None:
    """Returns the memory that this process has freed to the system; an idle worker else keeps what its largest task took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library alone
        trim(0)


def released_by_worker() -> None:
    """Drops what an earlier operator has this worker keep, and gives the memory back."""
    if _kept:
        _kept.clear()
        give_back()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, for mapInArrow, whose task gives its memory back when it ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a batch that goes to a Python worker: whole texts, so far fewer than Spark's 10,000.
BATCH_ROWS = 2048


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session's later tasks, which the JVM and the worker both hold, to BATCH_ROWS rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fold_bucket(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo `modulus`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def most_frequent(counts: DataFrame, most: int, column: str = "n") -> DataFrame:
    """The rows of greatest count, `most` at the most: all from a count on, so that no task or driver sorts them.

    Counts fall in steps of a sixty-fourth of a power of two; whole steps are taken from the top as long as they fit.
    """
    step = F.floor(F.log2(F.col(column)) * 64).cast("int")
    sizes = counts.filter(F.col(column) > 0).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect()  # some thousands at most
    least, left = None, most
    for r in sorted(sizes, reverse=True):
        if r["rows"] > left:
            break
        least, left = r["step"], left - r["rows"]
    return counts.filter(F.lit(False)) if least is None else counts.filter((F.col(column) > 0) & (step >= least))
