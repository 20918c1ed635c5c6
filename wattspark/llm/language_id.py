"""Language identification by compression.

Each language has a dictionary of raw content: whole labelled documents. A text is compressed by
zstandard (in lower case) with each dictionary in turn and with none; the language of the smallest result is
chosen. What a dictionary saves doesn't grow with the text, so the margin to the second best is held against what
the best saves, not against the text's length; a choice with a narrow margin is rejected, but for texts too short to tell.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattspark.llm.common import released_by_worker, tidy

#: The bounded sample that a language's dictionary is fitted on: so many whole documents, so many bytes in all.
SAMPLE_DOCS = 64
SAMPLE_BYTES = 1 << 17
LEVEL = 6
#: A choice is rejected when the second-best result is larger by less than this share of what the best saves, or by less than so many bytes.
NARROW = 0.05
NARROW_BYTES = 2
#: Shorter texts are never rejected for their margin.
TELLING_BYTES = 256
SEED = 77
UNDETERMINED = "und"


def fit_dictionaries(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> tuple[dict[str, bytes], dict[str, int]]:
    """Dictionaries, and counts of labelled rows, by language; rows without letters or language don't count.

    The counts are over all rows. The sample is by a seeded hash of the text, so copies of one text are
    in or out together and count once in the dictionary. Texts of more than `sample_bytes` aren't drawn; a language
    that has no others is not learned. What reaches the driver is bounded by languages x sample_bytes. No labelled rows give no dictionaries.
    """
    text = F.col(text_col)
    rows = labelled.filter(text.rlike(r"\p{L}") & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), text.alias("text"), (F.octet_length(text) <= sample_bytes).alias("fits"))
    each = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if("fits").alias("fit")).collect()
    counts = {r["lang"]: r["n"] for r in each}
    if not counts:
        return {}, {}
    share = F.create_map(*[F.lit(x) for r in each for x in (r["lang"], min(1 << 20, 1 + (4 * sample_docs << 20) // max(1, r["fit"])))])
    drawn = rows.filter("fits").withColumn("draw", F.xxhash64(F.lit(SEED), "text")).filter(F.pmod("draw", F.lit(1 << 20)) < F.element_at(share, F.col("lang")))
    pieces = drawn.select("lang", "draw", "text").dropDuplicates(["lang", "draw"])
    order = Window.partitionBy("lang").orderBy("draw")  # about four times sample_docs rows a language
    some = pieces.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= sample_docs)
    kept = some.withColumn("upto", F.sum(F.octet_length("text")).over(order)).filter((F.col("upto") <= sample_bytes) | (F.col("rank") == 1)).select("lang", "draw", "text").collect()
    found: dict[str, list[tuple[int, str]]] = {}
    for r in kept:
        found.setdefault(r["lang"], []).append((r["draw"], r["text"]))
    return {lang: "\n".join(p for _, p in sorted(ps)).lower().encode() for lang, ps in found.items()}, counts


class Compressors:
    """Sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.langs = list(dictionaries)
        params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.plain, self.each = zstandard.ZstdCompressor(compression_params=params), []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.each.append(zstandard.ZstdCompressor(compression_params=params, dict_data=d))

    def sizes(self, text: bytes) -> list[int]:
        return [len(c.compress(text)) for c in self.each]


def narrow_margin(size: int, plain: int, best: int, second: int, narrow: float = NARROW) -> bool:
    """Whether the best of the compressed sizes of a text of `size` bytes, `plain` without a dictionary, tells too little."""
    return size >= TELLING_BYTES and second - best < max(NARROW_BYTES, narrow * (plain - best))


def identify(docs: DataFrame, dictionaries: dict[str, bytes], counts: dict[str, int], id_col: str = "doc_id", text_col: str = "text", narrow: float = NARROW) -> DataFrame:
    """`docs` with lang_pred, score (0 to 1) and rejected.

    Null texts and those without a letter get `und`, score 0, and are rejected. Equal sizes go to the
    language with more labelled rows, then to the first by code point. With no dictionaries at all,
    every text is `und`, and those with a letter are not rejected; with one alone, nothing is narrow. Repeated rows are rows of their own, and
    an empty table gives an empty one. Clashing columns of `docs` named lang_pred, score or rejected are replaced.
    """
    order = sorted(dictionaries, key=lambda x: (-counts.get(x, 0), x))
    ordered = {x: dictionaries[x] for x in order}

    def predict(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released_by_worker()
        by = Compressors(ordered)
        for batch in texts:
            langs, scores, rejected = [], [], []
            for text, letter in zip(batch.column(0).field(at).to_pylist(), batch.column(1).to_pylist()):
                if not letter or not order:
                    langs.append(UNDETERMINED), scores.append(0.0), rejected.append(not letter)
                    continue
                raw = text.lower().encode()
                sizes = by.sizes(raw)
                best = min(range(len(sizes)), key=sizes.__getitem__)
                second = min((s for i, s in enumerate(sizes) if i != best), default=sizes[best] * 2)
                langs.append(order[best])
                scores.append(second / (second + sizes[best]))
                rejected.append(len(order) > 1 and narrow_margin(len(raw), len(by.plain.compress(raw)), sizes[best], second, narrow))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["row", "lang_pred", "score", "rejected"])

    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    at = rest.index(text_col)
    row = docs.select(F.struct(*rest).alias("row"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    schema = row.select("row").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return row.mapInArrow(tidy(predict), schema).select("row.*", "lang_pred", "score", "rejected")
