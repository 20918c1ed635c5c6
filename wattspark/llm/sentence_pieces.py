"""SentencePiece encoding and decoding over a relational lattice.

For models whose pieces merge by score. The words of the corpus are counted; for the commonest ones all
substrings up to the longest piece are exploded and equi-joined to the piece table, which gives the
edges of each word's lattice; the edges are grouped by word and folded, best score first, by an
`aggregate` over the word's cuts: an edge takes effect where both its ends are cuts with one cut
between, which then goes. That fold gives what the merges give, because every piece of a trained model
scores below the pieces it is merged from; a fold that adds scores along paths would not.

Words that begin with a run of spaces are merged pair by pair, as pieces of spaces alone don't score so.

The texts are then put together from the encoded words, a list of fixed size. Rarer words are merged in
the task that meets them: to bring them back by a join would move the corpus once more. Decoding is an array lookup and a join of bytes.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspark.llm.common import kept_by_worker, most_frequent, released_by_worker, tidy, written

MARK = "▁"
#: Words encoded by the relational lattice and sent to all tasks: a list of fixed size.
HEAD_WORDS = 1 << 18
#: Longer words don't fit a lattice of 62 cuts in one number; they are merged in the task that meets them.
LONGEST_WORD = 61
#: Rare words that a task keeps.
MOST_KEPT = 1 << 17
_FLUSH = 1 << 20


class Pieces:
    """The piece table of a model: rank by score (ties share one), id, and the byte pieces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        scores = sorted({model.get_score(i) for i in plain}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        self.table = {names[i]: (rank[model.get_score(i)], i) for i in plain}
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.longest = max(map(len, self.table))
        self.content = [bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else names[i].encode() for i in range(n)]
        if any(MARK in p.lstrip(MARK) for p in self.table):
            raise ValueError("a piece spans words")
        #: whether a line feed is in no piece, so that it parts words as well
        self.lines_part = not any("\n" in p for p in self.table)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(piece, rank, id): as many rows as the model has pieces."""
        return spark.createDataFrame([(p, r, i) for p, (r, i) in self.table.items()], "piece string, rank long, id long")

    def agenda(self, word: str) -> list[int]:
        """The ids of a word with a run of marks. Pieces that are only marks don't score in the order of
        their merges, so these words are merged pair by pair, the best pair of neighbours first."""
        n, table = len(word), self.table
        after, before, alive = list(range(1, n + 1)), list(range(-1, n)), [True] * n
        pairs: list[tuple[int, int, int]] = []

        def propose(i: int, k: int) -> None:
            if i >= 0 and k < n and (hit := table.get(word[i : after[k]])):
                heapq.heappush(pairs, (hit[0], i, after[k]))

        for i in range(n - 1):
            propose(i, i + 1)
        while pairs:
            _, i, end = heapq.heappop(pairs)
            k = after[i]
            if not alive[i] or k >= n or after[k] != end:
                continue
            alive[k], after[i] = False, end
            before[end] = i
            propose(before[i], i)
            propose(i, end)
        return self._named(word, after)

    def merged(self, word: str) -> list[int]:
        """The ids of a short word, by the same merges as `agenda` without its bookkeeping."""
        if len(word) > 40:
            return self.agenda(word)
        get, parts = self.table.get, list(word)
        ranks = [get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best = at = None
            for i, hit in enumerate(ranks):
                if hit and (best is None or hit[0] < best):
                    best, at = hit[0], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1])
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at])
        out = []
        for part in parts:
            out.extend([hit[1]] if (hit := get(part)) else [self.bytes[b] for b in part.encode()])
        return out

    def _named(self, word: str, after: list[int]) -> list[int]:
        """Ids of the stretches from each cut to the next; characters without a piece as bytes."""
        out, i = [], 0
        while i < len(word):
            hit = self.table.get(word[i : after[i]])
            out.extend([hit[1]] if hit else [self.bytes[b] for b in word[i].encode()])
            i = after[i]
        return out

    def fold(self, word: str) -> list[int]:
        """The ids of one word by the lattice and fold of `encoded_words`, to test that fold without Spark."""
        n, table = len(word), self.table
        edges = sorted((hit[0], i, k, hit[1]) for i in range(n) for k in range(i + 2, min(n, i + self.longest) + 1) if (hit := table.get(word[i:k])))
        after, cut = list(range(1, n + 1)), [True] * (n + 1)  # the next cut after each cut
        for _, i, k, _ in edges:
            if cut[i] and cut[k] and after[i] < k and after[after[i]] == k:
                cut[after[i]], after[i] = False, k
        return self._named(word, after)

    def words(self, text: str) -> list[str]:
        """Words, marks included, whose encodings follow one another in that of the text; a line feed is one of them."""
        if not text:
            return []
        lines = text.split("\n") if self.lines_part else [text]
        out: list[str] = []
        for i, line in enumerate(lines):
            if i:
                out.append("\n")
            line = line.replace(MARK, " ")  # a mark in the text reads as a space, as in the library
            if not i:
                line = " " + line
            if "  " in line or line[-1:] == " ":
                out.extend(re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", line.replace(" ", MARK)))
                continue
            words = line.replace(" ", " " + MARK).split(" ")
            out.extend(words if words[0] else words[1:])
        return out


def word_counts(texts: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, n) over a one-column table of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released_by_worker()
        held: dict[str, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for w in pieces.words(text or ""):
                    held[w] = held.get(w, 0) + 1
                if len(held) > _FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                    held = {}
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    return texts.mapInArrow(tidy(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encoded_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) of a one-column table of distinct words of at most LONGEST_WORD characters.

    Edges are numbers: rank, start, end and id of a piece, which sort best score first, then leftmost.
    The cuts of a word are bits of a number.
    """
    spark = words.sparkSession
    spans = (
        words.withColumn("chars", F.length("word"))
        .withColumn("start", F.explode(F.sequence(F.lit(0), F.col("chars") - 1)))
        .withColumn("len", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), F.col("chars") - F.col("start")))))
        .withColumn("piece", F.substring(F.col("word"), F.col("start") + 1, F.col("len")))
    )
    table = F.broadcast(pieces.frame(spark))  # the model's pieces: of fixed size
    edges = spans.join(table, "piece", "left").filter("id IS NOT NULL OR len = 1")  # a character without a piece: id null
    packed = edges.select("word", "chars", F.expr("shiftleft(coalesce(rank, 0), 32) | shiftleft(cast(start as bigint), 26) | shiftleft(cast(start + len as bigint), 20) | coalesce(id, 0)").alias("edge"))
    lattice = packed.groupBy("word", "chars").agg(F.array_sort(F.collect_list("edge")).alias("edges"))
    begin, end = "cast(shiftright(e, 26) & 63 as int)", "cast(shiftright(e, 20) & 63 as int)"
    between = f"(shiftleft(1L, {end}) - shiftleft(2L, {begin}))"
    ends_cut = f"getbit(m, {begin}) = 1 AND getbit(m, {end}) = 1"
    cuts = F.expr(f"aggregate(edges, shiftleft(1L, chars + 1) - 1, (m, e) -> if({ends_cut} AND bit_count(m & {between}) = 1, m & ~{between}, m))")
    whole = F.expr(f"filter(edges, e -> getbit(cuts, {begin}) = 1 AND getbit(cuts, {end}) = 1 AND bit_count(cuts & {between}) = 0)")
    ordered = F.expr(f"array_sort(transform(tokens, e -> shiftleft(cast({begin} as bigint), 20) | (e & 1048575)))")
    byte_ids = F.array(*[F.lit(pieces.bytes.get(b, 0)) for b in range(256)])
    done = lattice.withColumn("cuts", cuts).withColumn("tokens", whole).withColumn("tokens", ordered)

    def ids_of(x: Column) -> Column:
        at, known = F.shiftright(x, 20).cast("int"), x.bitwiseAND(F.lit((1 << 20) - 1)).cast("int")
        raw = F.encode(F.substring(F.col("word"), at + 1, F.lit(1)), "UTF-8")
        each = F.transform(F.sequence(F.lit(1), F.octet_length(raw)), lambda j: F.get(byte_ids, F.conv(F.hex(F.substring(raw, j, F.lit(1))), 16, 10).cast("int")))
        return F.when(known == 0, each).otherwise(F.array(known))

    return done.select("word", F.flatten(F.transform("tokens", ids_of)).alias("ids"))


class _Encoder(dict):
    """Words of the list with their ids as bytes; another word is merged here and kept for a while, apart from them."""

    def __init__(self, pieces: Pieces, head: Iterable[tuple[str, bytes]]):
        super().__init__(head)
        self.pieces, self.rare = pieces, {}

    def __missing__(self, word: str) -> bytes:
        found = self.rare.get(word)
        if found is None:
            if len(self.rare) >= MOST_KEPT:
                self.rare.clear()
            found = self.rare[word] = np.array(self.pieces.merged(word), np.int32).tobytes()
        return found


def _encoder(model: str, pieces: Pieces, head: pa.Table) -> _Encoder:
    """The encoder of a worker; any words it has kept are right for the model."""
    ids = head.column("ids").combine_chunks()
    flat = ids.values.to_numpy(zero_copy_only=False).astype(np.int32).tobytes()
    at = (ids.offsets.to_numpy().astype(np.int64) * 4).tolist()
    return _Encoder(pieces, ((w, flat[a:b]) for w, a, b in zip(head.column("word").to_pylist(), at[:-1], at[1:])))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS) -> DataFrame:
    """One row per row of `docs`: id and ids, the piece ids of the whole text, as the library gives them.

    Null and empty texts have no ids. Repeated rows are encoded again; other columns are ignored. `model`
    is the path of a model file with byte fallback, a prefix mark and no normalisation.
    """
    spark, pieces = docs.sparkSession, Pieces(model)
    counted = word_counts(docs.select(F.col(text_col).alias("text")), pieces)
    counted = written(counted.filter((F.length("word") <= LONGEST_WORD) & ~F.col("word").startswith(MARK + MARK)), "pieces-words")
    head = most_frequent(counted, head_words)
    spread = head.select("word").repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), "word")
    # at most head_words short words, as one Arrow table: some 25 bytes a word, unpacked in the workers alone
    shared = spark.sparkContext.broadcast((model, pieces, encoded_words(spread, pieces).toArrow().combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = kept_by_worker(("pieces", model), lambda: _encoder(*shared.value))
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                raw = [b"".join(map(by.__getitem__, by.pieces.words(t))) if t else b"" for t in some.column(1).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in raw]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), np.int32)))
                yield pa.RecordBatch.from_arrays([some.column(0), ids], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"id {kind}, ids array<int>").select(F.col("id").alias(id_col), "ids")


def decoded(ids: Column, model: str) -> Column:
    """The text of an array of piece ids."""
    content = F.split(F.lit(",".join(c.hex() for c in Pieces(model).content)), ",")  # folded to a literal
    raw = F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(content, i)), "")), "UTF-8")
    return F.regexp_replace(F.translate(raw, MARK, " "), r"^ ", "")
