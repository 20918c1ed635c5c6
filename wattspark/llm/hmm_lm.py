"""A hidden Markov language model.

Symbols of the model are the most frequent words, classes of all other words by hash, and the end of a text.
Baum-Welch trains the latent states: each task runs the scaled forward and backward recursions over its
whole texts and sends expected counts, which are summed across partitions. A text's score is
its exact likelihood by the scaled forward recursion over the whole sequence; a word outside the
symbols also pays for itself among the words of its class, by its count.

The recursions over a long text run in segments side by side: each segment's transfer matrix, the product of
its steps, carries the forward vector from its first symbol to its last, and the backward vector back,
so that every segment starts from what the whole text before and after it gives.

Word counts cover the whole corpus and are kept as a table. The commonest words, a list of fixed size,
are looked up in the tasks; all others meet their counts in a join, where no word can be frequent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspark.llm.common import most_frequent, written
from wattspark.llm.shingles import word_hashes

STATES = 6
#: Words that are symbols of their own, and classes of all others.
SYMBOL_WORDS = 4096
CLASSES = 1024
#: Words whose counts the tasks hold: a list of fixed size.
HEAD_WORDS = 1 << 17
ITERATIONS = 5
SEGMENT = 64
SEED = 5
END = SYMBOL_WORDS + CLASSES
SYMBOLS = END + 1
_GATHER = 1 << 22


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a batch of texts and the number of each text's first word; null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    hashes, firsts, at, words = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0, 0
    while at < len(texts):
        to = min(len(texts), max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 20), side="right")) - 1))
        piece = data[offsets[at] : offsets[to]]
        h, first = word_hashes(piece, offsets[at : to + 1] - offsets[at]) if len(piece) else (np.zeros(0, np.uint64), np.zeros(to - at + 1, np.int64))
        hashes.append(h)
        firsts.append(first[1:] + words)
        words, at = words + len(h), to
    return np.concatenate(hashes).view(np.int64), np.concatenate(firsts)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): 64-bit hashes of the words of a one-column table of texts, and their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(_flat(batch.column(0))[0])
            size += len(held[-1])
            if size > _GATHER:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(np.concatenate(held), return_counts=True)], ["word", "n"])
                held, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(np.concatenate(held), return_counts=True)], ["word", "n"])

    return texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def class_of(words: np.ndarray) -> np.ndarray:
    """The symbols of words outside the list, by their hashes."""
    return (SYMBOL_WORDS + (words & (CLASSES - 1))).astype(np.uint16)


@dataclass
class Model:
    """Start of a text, transitions and emissions (states x symbols)."""

    first: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    @staticmethod
    def initial(unigram: np.ndarray, states: int = STATES, seed: int = SEED) -> Model:
        rng = np.random.default_rng(seed)
        # states that last, so that they can stand for languages and manners of writing
        step = 0.1 * (rng.random((states, states)) + 1) / states + 0.9 * np.eye(states)
        emit = unigram * (0.1 + rng.random((states, len(unigram))))
        return Model(np.full(states, 1 / states), step / step.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def expected(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch counts (first, step, emit) of the texts symbols[ends[i]:ends[i + 1]], none of them empty."""
        k, wide = len(self.first), self.emit.T.copy()
        text, starts, lengths = _segments(ends)
        order = np.argsort(-lengths, kind="stable")
        place = np.empty(len(order), np.int64)  # of each segment in that order
        place[order] = np.arange(len(order))
        fresh = np.concatenate(([True], text[1:] != text[:-1]))
        starts, lengths, begins = starts[order], lengths[order], fresh[order]
        active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
        # transfer matrices: row x is the forward vector of a segment entered with all weight on state x before its first symbol
        carry = np.ascontiguousarray(np.broadcast_to(self.step, (len(order), k, k)) * wide[symbols[starts]][:, None, :])
        carry[begins] = np.diag(self.first)[None] * wide[symbols[starts[begins]]][:, None, :] * k
        for t, n in enumerate(active[1:], 1):
            now = (carry[:n].reshape(-1, k) @ self.step).reshape(n, k, k) * wide[symbols[starts[:n] + t]][:, None, :]
            carry[:n] = now / now.sum(axis=(1, 2), keepdims=True)
        # what enters each segment: forward from the first one of a text, backward from the last
        number = np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        enter, leave = np.full((len(order), k), 1 / k), np.ones((len(order), k))
        by_number = np.split(np.argsort(number, kind="stable"), np.cumsum(np.bincount(number))[:-1])
        for some in by_number[1:]:
            alpha = np.einsum("ns,nst->nt", enter[place[some - 1]], carry[place[some - 1]])
            enter[place[some]] = alpha / alpha.sum(axis=1, keepdims=True)
        for some in reversed(by_number[1:]):
            beta = np.einsum("nst,nt->ns", carry[place[some]], leave[place[some]])
            leave[place[some - 1]] = beta / beta.sum(axis=1, keepdims=True)
        # within the segments; scales cancel, as each step's pairs are made to sum to one
        alphas = []
        for t, n in enumerate(active):
            b = wide[symbols[starts[:n] + t]]
            alpha = np.where(begins[:n, None], self.first, enter[:n] @ self.step) * b if t == 0 else (alphas[-1][:n] @ self.step) * b
            alphas.append(alpha / alpha.sum(axis=1, keepdims=True))
        step, emit = np.zeros((k, k)), np.zeros((SYMBOLS, k))
        beta = leave.copy()
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            gamma = alphas[t] * beta[:n]
            gamma /= gamma.sum(axis=1, keepdims=True)
            sym = symbols[starts[:n] + t]
            for s in range(k):
                emit[:, s] += np.bincount(sym, gamma[:, s], SYMBOLS)
            if t == 0:
                break
            onward = wide[sym] * beta[:n]
            before = onward @ self.step.T
            whole = (alphas[t - 1][:n] * before).sum(axis=1, keepdims=True)
            step += alphas[t - 1][:n].T @ (onward / whole)
            beta[:n] = before / before.sum(axis=1, keepdims=True)
        later = ~begins  # the steps from one segment to the next
        if later.any():
            onward = wide[symbols[starts[later]]] * beta[: len(order)][later]
            whole = (enter[later] * (onward @ self.step.T)).sum(axis=1, keepdims=True)
            step += enter[later].T @ (onward / whole)
        return gamma[begins].sum(axis=0), step * self.step, emit.T

    def log10_likelihood(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of whole sequences, by the scaled forward recursion; a step runs over all sequences that are long enough."""
        order = np.argsort(-lengths, kind="stable")
        out, starts, wide = np.zeros(len(lengths)), starts[order], self.emit.T.copy()
        sorted_lengths = lengths[order]
        total, alpha = np.zeros(len(lengths)), None
        for t in range(int(sorted_lengths[0]) if len(lengths) else 0):
            n = int(np.searchsorted(-sorted_lengths, -(t + 1), side="right"))
            alpha = (self.first if t == 0 else alpha[:n] @ self.step) * wide[symbols[starts[:n] + t]]
            scale = alpha.sum(1)
            alpha /= scale[:, None]
            total[:n] += np.log10(scale)
        out[order] = total
        return out


def _segments(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and length of the segments of the texts between `ends`."""
    size = np.diff(ends)
    each = -(-size // SEGMENT)
    text = np.repeat(np.arange(len(size)), each)
    within = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    return text, ends[text] + within * SEGMENT, np.minimum(SEGMENT, size[text] - within * SEGMENT)


def train(sequences: DataFrame, unigram: np.ndarray, states: int = STATES, iterations: int = ITERATIONS, seed: int = SEED) -> Model:
    """Baum-Welch over all rows of a one-column table of symbol sequences (binary, two bytes a symbol).

    What an iteration sends to the driver is the model's own size: a row of `states` numbers for each symbol.
    Null and empty sequences count nothing; without any, the model is the smoothed `unigram`.
    """
    model = Model.initial(unigram, states, seed)
    spark = sequences.sparkSession
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(model)

        def counts(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now = shared.value
            total = np.zeros((SYMBOLS + states + 1, states))
            for batch in batches:
                raw = [x for x in batch.column(0).to_pylist() if x]
                ends = np.concatenate(([0], np.cumsum([len(x) // 2 for x in raw])))
                at = 0
                while at < len(raw):  # some texts at a time; a longer one alone
                    to = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 18), side="right")) - 1)
                    first, step, emit = now.expected(np.frombuffer(b"".join(raw[at:to]), np.uint16), ends[at : to + 1] - ends[at])
                    total[:SYMBOLS] += emit.T
                    total[SYMBOLS : SYMBOLS + states] += step
                    total[-1] += first
                    at = to
            rows = np.nonzero(total.any(axis=1))[0]
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), *[pa.array(total[rows, s]) for s in range(states)]], ["row", *[f"s{s}" for s in range(states)]])

        schema = "row int, " + ", ".join(f"s{s} double" for s in range(states))
        sums = sequences.mapInArrow(counts, schema).groupBy("row").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(states)]).collect()
        table = np.zeros((SYMBOLS + states + 1, states))
        for r in sums:
            table[r["row"]] = r[1:]
        shared.unpersist()
        emit = table[:SYMBOLS].T + 10 * unigram  # smoothed by the words' own frequencies
        step, first = table[SYMBOLS : SYMBOLS + states] + 1, table[-1] + 1
        model = Model(first / first.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
    return model


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, iterations: int = ITERATIONS) -> DataFrame:
    """One row per row of `docs`: id, training, n_tokens, n_known, train_tokens, base_score, score.

    A text's tokens are its words, A-Z lower-cased, and one end, so null and empty texts have one token.
    `training` says which rows the model and the counts learn from; with none, every token counts 0
    and the model's words are equally likely. base_score is by the token counts plus one; score is the
    model's log10 probability. Repeated rows are rows of their own and count again; other columns are
    ignored. Words are told apart by 64 bits of hash.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(training, F.lit(False)).alias("training"), F.col(text_col).alias("text"))
    counts = written(word_counts(rows.filter("training").select("text")), "lm-counts")
    ends = rows.filter("training").count()
    words = counts.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    head = sorted(most_frequent(counts, HEAD_WORDS).collect(), key=lambda r: (-r["n"], r["word"]))
    n_all, v_all = words["n"] + ends, words["v"] + (ends > 0)
    base_room = n_all + v_all + 1
    by_hash = sorted((r["word"], r["n"], i) for i, r in enumerate(head))
    table = np.array([x[0] for x in by_hash], np.int64), np.array([x[1] for x in by_hash], np.int64), np.array([x[2] if x[2] < SYMBOL_WORDS else class_of(np.array([x[0]]))[0] for x in by_hash], np.uint16)
    # a class has room for its words' counts, one more for each, and one for a word never seen
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    at = F.col("word").bitwiseAND(F.lit(CLASSES - 1)).alias("at")
    for r in counts.groupBy(at).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # CLASSES rows
        class_n[r["at"]], class_v[r["at"]] = r["n"], r["v"]
    for r in head[:SYMBOL_WORDS]:
        class_n[r["word"] & (CLASSES - 1)] -= r["n"]
        class_v[r["word"] & (CLASSES - 1)] -= 1
    room = np.log10(class_n + class_v + 1)
    shared = spark.sparkContext.broadcast((*table, room))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, symbol, log_room = shared.value
        serial = TaskContext.get().partitionId() << 40
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                hashes, first = _flat(batch.column(2))
                m = batch.num_rows
                keys = serial + np.arange(m)
                serial += m
                at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
                found = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                sym = np.where(found, symbol[at], class_of(hashes)) if len(known) else class_of(hashes)
                log_c = np.where(found, np.log10((n[at] if len(known) else np.zeros(len(hashes))) + 1.0), 0.0)
                owner = np.repeat(np.arange(m), np.diff(first))
                classed = sym >= SYMBOL_WORDS  # all rare words are; their counts come by the join
                apart = np.where(classed, log_c, 0.0) - np.where(classed, log_room[np.maximum(sym, SYMBOL_WORDS) - SYMBOL_WORDS], 0.0)
                sums = [np.bincount(owner, w, m).astype(np.float64) for w in (found, np.where(found, log_c - np.log10(base_room), 0.0), apart)]
                ended = [sym[first[j] : first[j + 1]].tobytes() + END.to_bytes(2, "little") for j in range(m)]
                rare, rare_owner = hashes[~found], owner[~found]
                if len(rare):
                    order = np.lexsort((rare, rare_owner))
                    rare, rare_owner = rare[order], rare_owner[order]
                    new = np.concatenate(([True], (rare[1:] != rare[:-1]) | (rare_owner[1:] != rare_owner[:-1])))
                    times = np.diff(np.concatenate((np.nonzero(new)[0], [len(rare)])))
                    rare, rare_owner = rare[new], rare_owner[new]
                else:
                    times = np.zeros(0, np.int64)
                none = lambda kind: pa.nulls(len(rare), kind)
                parts = [
                    (pa.array(keys), pa.array(keys[rare_owner])),
                    (batch.column(0), none(batch.column(0).type)),
                    (batch.column(1), none(pa.bool_())),
                    (pa.array(np.diff(first) + 1), none(pa.int64())),
                    (pa.array(sums[0].astype(np.int64)), none(pa.int64())),
                    (pa.array(sums[1]), none(pa.float64())),
                    (pa.array(sums[2]), none(pa.float64())),
                    (pa.array(ended, pa.binary()), none(pa.binary())),
                    (pa.nulls(m, pa.int64()), pa.array(rare)),
                    (pa.nulls(m, pa.int64()), pa.array(times.astype(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in parts], ["key", "id", "training", "n_tokens", "known", "base", "apart", "symbols", "word", "times"])

    id_type = rows.schema["id"].dataType.simpleString()
    seen = written(rows.mapInArrow(read, f"key long, id {id_type}, training boolean, n_tokens long, known long, base double, apart double, symbols binary, word long, times long"), "lm-read")
    texts = seen.filter("symbols IS NOT NULL")

    unigram = np.ones(SYMBOLS)
    unigram[: min(len(head), SYMBOL_WORDS)] += [r["n"] for r in head[:SYMBOL_WORDS]]
    unigram[SYMBOL_WORDS:END] += class_n
    unigram[END] += ends
    unigram /= unigram.sum()
    model = spark.sparkContext.broadcast(train(texts.filter("training").select("symbols"), unigram, states, iterations))

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            ends_at = np.concatenate(([0], np.cumsum([len(x) // 2 for x in raw])))
            found = model.value.log10_likelihood(np.frombuffer(b"".join(raw), np.uint16), ends_at[:-1], np.diff(ends_at))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["row", "likelihood"])

    row = texts.select(F.struct("key", "id", "training", "n_tokens", "known", "base", "apart").alias("row"), "symbols")
    schema = row.select("row").schema.add("likelihood", "double")
    scored = row.mapInArrow(likelihood, schema).select("row.*", "likelihood")

    # words outside the list: none of them is frequent, so their join is even
    rare = seen.filter("word IS NOT NULL").select("key", "word", "times").join(counts, "word", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    per_text = rare.groupBy("key").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10((F.col("c") + 1) / F.lit(float(base_room)))).alias("rare_base"),
        F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_apart"),
    )
    nil = lambda c: F.coalesce(F.col(c), F.lit(0))
    end_base = float(np.log10((ends + 1) / base_room))
    return scored.join(per_text, "key", "left").select(
        F.col("id").alias(id_col),
        "training",
        "n_tokens",
        (F.col("known") + nil("rare_known") + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + nil("rare_base") + F.lit(end_base)).alias("base_score"),
        (F.col("likelihood") + F.col("apart") + nil("rare_apart")).alias("score"),
    )
