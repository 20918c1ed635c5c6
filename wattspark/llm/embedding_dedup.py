"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are turned by a fixed random rotation and cut into blocks of few dimensions. Two vectors
with cosine >= t lie within squared distance 2 (1 - t); so in at least one block they lie within that
budget's share of the block (pigeonhole). Each block is range-joined by a grid of cells: a vector is at
home in one cell and visits those cells below its own that its ball reaches. The union of the candidates
of all blocks is verified exactly, in double precision, on the original vectors.

Equal vectors are folded to one representative first, so large groups of copies cost one vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspark.llm.common import written
from wattspark.llm.components import components

BLOCK_DIMS = 8
SEED = 11
#: Cells are so many radii wide: wide cells mean fewer copies of a vector, narrow ones fewer comparisons.
CELL_RADII = 4.0
CELL_RADII_MANY = 2.01
MANY = 500_000
#: Homes of a cell that one task compares; fuller cells are dealt over salts, with their visitors in each.
MOST_HOMES = 2048
_SLACK = 1e-5


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same on every call."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dims]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def block_bounds(dims: int, block_dims: int = BLOCK_DIMS) -> list[tuple[int, int]]:
    return [(i, min(dims, i + block_dims)) for i in range(0, dims, block_dims)]


def radius(width: int, dims: int, threshold: float) -> float:
    """Of a block's ball: the root of its share of the squared-distance budget."""
    return math.sqrt(2 * (1 - threshold) * width / dims)


def _cells(y: np.ndarray, r: float, side: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For block coordinates: row numbers, cell keys and whether home, of all home cells and the visited cells below them."""
    n, k = y.shape
    home = np.floor(y / side).astype(np.int64)
    low = y - home * side
    near, toward = np.minimum(low, side - low), np.where(low <= side - low, -1, 1)
    subsets = (np.arange(1 << k)[:, None] >> np.arange(k) & 1).astype(np.float64)
    row, sub = np.nonzero((near**2) @ subsets.T <= r * r)
    shift = toward[row] * subsets[sub].astype(np.int64)
    moved = shift != 0
    at_home = ~moved.any(axis=1)
    first = shift[np.arange(len(row)), moved.argmax(axis=1)]
    take = at_home | (first < 0)
    cells = home[row[take]] + shift[take]
    key = np.zeros(len(cells), dtype=np.uint64)
    for i in range(k):
        key = key * np.uint64(0x9E3779B97F4A7C15) + cells[:, i].astype(np.uint64)
        key ^= key >> np.uint64(29)
    return row[take], key.view(np.int64), at_home[take], None


def _placed(reps: DataFrame, threshold: float, cell_radii: float) -> DataFrame:
    """(dims, block, cell, id, home, at): a row for each representative, block and cell it is in."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            for dims in np.unique(lengths):
                if not dims:
                    continue
                which = np.nonzero(lengths == dims)[0]
                flat = lists.take(pa.array(which)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
                unit = flat / np.linalg.norm(flat / np.abs(flat).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(flat).max(axis=1, keepdims=True)
                turned = unit @ rotation(int(dims)).T
                for b, (lo, hi) in enumerate(block_bounds(int(dims))):
                    r = radius(hi - lo, int(dims), threshold) + 1e-6
                    y = turned[:, lo:hi]
                    for i in range(0, len(y), 4096):
                        row, key, home, _ = _cells(y[i : i + 4096], r, cell_radii * r)
                        at = np.ascontiguousarray(y[i : i + 4096][row].astype(np.float32))
                        offsets = pa.array(np.arange(0, at.size + 1, hi - lo), pa.int32())
                        m = len(row)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(m, dims, np.int32)), pa.array(np.full(m, b, np.int32)), pa.array(key), pa.array(ids[which[i + row]]), pa.array(home), pa.ListArray.from_arrays(offsets, pa.array(at.ravel()))],
                            ["dims", "block", "cell", "id", "home", "at"],
                        )

    return reps.select("id", "v").mapInArrow(place, "dims int, block int, cell long, id long, home boolean, at array<float>")


def _near(threshold: float):
    """Pairs of a cell within the block's budget: home with home, and home with visitor."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.stack(pdf["at"].to_numpy()).astype(np.float64)
        ids, home = pdf["id"].to_numpy(), pdf["home"].to_numpy()
        own = pdf["salt"].to_numpy() == pdf["deal"].to_numpy()  # homes dealt to this salt; the others are here as partners
        dims = int(pdf["dims"].iloc[0])
        budget = radius(at.shape[1], dims, threshold) ** 2 + _SLACK
        homes = np.nonzero(home & own)[0]
        out = []
        norm = (at**2).sum(axis=1)
        for i in range(0, len(homes), 256):
            h = homes[i : i + 256]
            d = norm[h][:, None] + norm[None, :] - 2 * at[h] @ at.T
            a, b = np.nonzero(d <= budget)
            x, y = ids[h[a]], ids[b]
            take = np.where(home[b], x < y, x != y)  # a pair of homes once
            out.append(np.stack([np.minimum(x, y)[take], np.maximum(x, y)[take]], axis=1))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return join


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def usable(v: Column) -> Column:
    """Whether a vector can link: not null, no null or non-finite component, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def links(vectors: DataFrame, threshold: float = 0.95, cell_radii: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(representatives id, v, copies; links a < b between them) of a table (id, v) of usable vectors."""
    reps = written(vectors.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "v", "copies"), "vectors")
    wide = cell_radii or (CELL_RADII if reps.count() < MANY else CELL_RADII_MANY)
    placed = _placed(reps, threshold, wide)
    if wide < 2.005:
        raise ValueError("cells must be over two radii wide")
    placed = written(placed, "vector-cells")
    full = placed.filter("home").groupBy("dims", "block", "cell").agg(F.count(F.lit(1)).alias("homes")).filter(F.col("homes") > MOST_HOMES).withColumn("salts", F.ceil(F.col("homes") / MOST_HOMES).cast("int"))
    full = written(full, "vector-full-cells")
    keys = ["dims", "block", "cell"]
    if full.isEmpty():
        dealt = placed.withColumn("deal", F.lit(0)).withColumn("salt", F.lit(0))
    else:
        dealt = placed.join(full.select(*keys, "salts"), keys, "left").withColumn("deal", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int"))
        dealt = dealt.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)))
    near = dealt.select(*keys, "salt", "deal", "id", "home", "at").groupBy(*keys, "salt").applyInPandas(_near(threshold), "a long, b long").distinct()
    norm = F.sqrt(_dot(F.col("v"), F.col("v")))
    left = reps.select(F.col("id").alias("a"), F.col("v").alias("va"), norm.alias("na"))
    right = reps.select(F.col("id").alias("b"), F.col("v").alias("vb"), norm.alias("nb"))
    cosine = _dot(F.col("va"), F.col("vb")) / (F.col("na") * F.col("nb"))
    found = near.join(left, "a").join(right, "b").filter(cosine >= threshold).select("a", "b")
    return reps, written(found, "vector-links")


def embedding_dedup(table: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", cell_radii: float | None = None) -> DataFrame:
    """One row per row of `table`: id, n_links, component_id, kept.

    Vectors link when their cosine is at least `threshold`, whatever their other columns say. Vectors that
    are null, empty, zero or hold a null or non-finite component link with nothing, nor do rows with a null
    id (whose component is null), nor vectors of different lengths with each other. Repeated rows are
    vectors of their own: they link, and share their id. Scaling a vector does not change its links.
    """
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("usable", usable(F.col("v")) & F.col("id").isNotNull())
    good = rows.filter("usable").select("id", "v")
    reps, edges = links(good, threshold, cell_radii)
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = reps.select(F.col("id").alias("b"), F.col("copies").alias("more"))
    partners = both.join(copies, "b").groupBy(F.col("a").alias("id")).agg(F.sum("more").alias("others"))
    groups = components(edges, "vector-groups")
    classes = reps.join(partners, "id", "left").join(groups, reps["id"] == groups["node"], "left")
    # reps are the least ids of their copies, so the least representative of a component is its least id
    classes = written(classes.select(F.col("v").alias("rv"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", reps["id"]).alias("component_id")), "vector-classes")
    linked = good.join(classes, good["v"] == classes["rv"]).select("id", "n_links", "component_id")
    alone = rows.filter(~F.col("usable")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
