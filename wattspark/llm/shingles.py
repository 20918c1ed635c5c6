"""Sets of hashed word shingles, computed for whole batches of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that are worked on at once; a longer text is worked on alone.
_AT_ONCE = 1 << 20
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, _AT_ONCE)
        steps = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        for s in steps:
            s[0] = 1
        _powers = tuple(np.multiply.accumulate(s) for s in steps)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = h.copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(31)
    return h


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the texts data[offsets[i]:offsets[i + 1]]: the 64-bit hashes of their words, A-Z lower-cased, and
    the number of each text's first word (one more entry than texts)."""
    lower = _LOWER[data]
    blank = _SPACE[lower]
    edge = np.zeros(len(lower) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(lower), bool)
    before[:1] = True
    before[1:] = blank[:-1]
    start = np.nonzero(~blank & (before | edge[:-1]))[0]
    after = np.empty(len(lower), bool)
    after[-1:] = True
    after[:-1] = blank[1:]
    end = np.nonzero(~blank & (after | edge[1:]))[0] + 1
    power, inverse = _power_tables(len(lower) + 1)
    total = np.zeros(len(lower) + 1, np.uint64)
    np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * power[: len(lower)], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    return mixed(h ^ ((end - start).astype(np.uint64) << np.uint64(40))), np.searchsorted(start, offsets)


def shingle_set(words: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct hashes of the runs of k words; of fewer words the whole sequence; of none nothing."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    h = np.full(n, min(len(words), k), np.uint64)
    for i in range(min(k, len(words))):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words[i : i + n]
    h = mixed(h)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def signature(shingles: np.ndarray) -> int:
    """63 bits that stand for a set."""
    return int(mixed(np.array([np.bitwise_xor.reduce(mixed(shingles)) ^ np.add.reduce(shingles)], np.uint64))[0] >> np.uint64(1))


def sets_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of each text, in order; null counts as empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _AT_ONCE, side="right")) - 1)
        to = min(to, len(texts))
        piece = data[offsets[at] : offsets[to]]
        hashes, first = word_hashes(piece, offsets[at : to + 1] - offsets[at]) if len(piece) else (np.zeros(0, np.uint64), np.zeros(to - at + 1, np.int64))
        for i in range(to - at):
            yield shingle_set(hashes[first[i] : first[i + 1]])
        at = to
