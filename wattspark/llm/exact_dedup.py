"""Exact deduplication by skew-safe combining.

Three combining stages, all keyed by the digest and the full content, so that equal digests of
different contents never meet:

1. locally, in the task that reads the rows (the map side of the first aggregation);
2. per digest, content and salt: the copies of one content spread over `salts` groups;
3. per digest and content: the winners of the salts.

Each row then gets the class of its digest by a join that carries digests and ids only. A digest
with more than one content (a collision) takes a second join that compares contents as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspark.llm.common import SPACES, chosen_rows, written

SALTS = 32
_SHIFT = "18446744073709551616"  # 2**64
_TOP = 9223372036854775807  # the id that stands for a null id


def normalised(text: Column) -> Column:
    """The text without the characters [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _order_key(length: Column, row_id: Column) -> Column:
    """Greater for longer texts, then for smaller ids; a number, so that hash aggregation can keep it."""
    big = length.cast("decimal(38,0)") * F.lit(_SHIFT).cast("decimal(20,0)")
    return (big + (F.lit(_TOP).cast("decimal(20,0)") - F.coalesce(row_id, F.lit(_TOP)).cast("decimal(20,0)"))).cast("decimal(38,0)")


def _id_of(key: Column) -> Column:
    found = (F.lit(_TOP).cast("decimal(20,0)") - key % F.lit(_SHIFT).cast("decimal(20,0)")).cast("long")
    return F.when(found != F.lit(_TOP), found)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row with the most code points in its original text stays, then the
    smallest id. Null texts count as empty and so equal each other and all-blank texts. A row whose id
    is null comes after all others in ties and is kept only in a group without any id; of repeated rows
    with the winner's id all are marked kept. Other columns of `docs` are ignored, whatever their names.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"),
        normalised(F.col(text_col)).alias("content"),
    ).withColumn("digest", F.sha2("content", 256))
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("id", "n"), F.lit(salts)).cast("int"))
        .groupBy("digest", "content", "salt")
        .agg(F.max(_order_key(F.col("n"), F.col("id"))).alias("best"), F.count(F.lit(1)).alias("copies"))
    )
    # dealt by digest alone: the winners of all salts and all contents of a digest meet in one task
    winners = salted.repartition("digest").groupBy("digest", "content").agg(F.max("best").alias("best"), F.sum("copies").alias("group_size"))
    classes = written(winners.groupBy("digest").agg(F.count(F.lit(1)).alias("contents"), F.max("best").alias("best"), F.max("group_size").alias("group_size")), "exact-dedup")
    plain = rows.select("id", "digest").join(classes.filter("contents = 1"), "digest").select("id", "digest", "best", "group_size")
    clashing = classes.filter("contents > 1").select("digest")
    if clashing.isEmpty():
        out = plain
    else:
        each = winners.join(clashing, "digest", "left_semi")
        out = plain.unionByName(rows.select("id", "digest", "content").join(each, ["digest", "content"]).select("id", "digest", "best", "group_size"))
    keep = _id_of(F.col("best"))
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` for each normalised text, the one that exact_dedup keeps, with all its columns.

    Rows that share an id are told apart by their texts; of repeated rows one stays. All null and blank texts
    are one text. An empty table gives an empty one, and columns may have any names.
    """
    kept = exact_dedup(docs, id_col, text_col).filter("kept").groupBy(F.col(id_col).alias("id"), F.col("text_sha256").alias("mark"))
    chosen = written(kept.agg((F.count(F.lit(1)) > 1).alias("single")), "exact-kept")
    return chosen_rows(docs, chosen, id_col, text_col, F.sha2(normalised(F.col(f"`{text_col}`")), 256))
