"""Token counts by a finite-state transducer compiled from a tokenizer file.

The file's pre-tokenizer cuts a normalised word into pieces, and byte-pair merges turn a piece into
tokens. The merges are compiled to a deterministic transducer over bytes. It rests on what is known of
such merges: a sequence of tokens is the encoding of its text exactly if every two neighbours, merged on their own, stay those
two; so of the tokens that end at a byte exactly one goes with the encoding of what stands before it,
and the encoding of a prefix is known byte by byte. A state holds all that later bytes can ask for: for
every place where a token may have begun, the node of the tokens' trie reached since, the token that
ends before it, and the count of tokens up to it, relative to now. A transition is annotated with the
change of that count; the annotations along a piece sum to its number of tokens. States and
transitions are determinised when first reached, and kept in tables of bounded size.

White space leaves the transducer in its start state. So a chunk of text that starts and ends anywhere
is a state map: (bytes before the first space, tokens between, bytes after the last space), or its
bytes alone if it holds no space. State maps compose associatively: every text is cut to chunks, which are mapped on
their own and composed by a tree-shaped scan.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspark.llm.common import kept_by_worker

#: Transitions, states' entries and words that a worker keeps of each; beyond them it starts anew. Bounds on memory, not on what is counted.
MOST_ARCS = 1 << 20
#: Bytes of a chunk of a text.
CHUNK = 1 << 16

#: (text before the first space, tokens between, text after the last space); no space: (text, None, b"").
StateMap = tuple[bytes, "int | None", bytes]


def byte_letters() -> dict[str, int]:
    """The byte of each letter by which byte-level vocabularies write it: printable bytes as themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def letters_of(category: str) -> str:
    """The code points of a Unicode category as ranges of a pattern's class."""
    out = []
    for own, points in groupby(range(sys.maxunicode + 1), lambda c: unicodedata.category(chr(c))[0] == category):
        if own:
            points = list(points)
            out.append(f"\\U{points[0]:08x}-\\U{points[-1]:08x}")
    return "".join(out)


#: Unicode's White_Space beyond ASCII's, and that.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Grammar:
    """What a tokenizer file says: normalisation, pattern of the pieces, special strings, symbols and merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        normal = [n["type"] for n in (said["normalizer"] or {}).get("normalizers", [])]
        steps = (said["pre_tokenizer"] or {}).get("pretokenizers", [])
        if len(steps) != 2 or model["type"] != "BPE" or not model["end_of_word_suffix"] or model["dropout"] or model["continuing_subword_prefix"] or model["byte_fallback"] or model["ignore_merges"]:
            raise ValueError("not byte-pair merges with word ends")
        if normal != ["NFC", "Replace", "Lowercase"] or said["normalizer"]["normalizers"][1]["pattern"] != {"Regex": r"\s+"}:
            raise ValueError("another normalisation")
        split, letters = steps
        if split["type"] != "Split" or not split["invert"] or split["behavior"] != "Removed" or letters["type"] != "ByteLevel" or letters["use_regex"] or letters["add_prefix_space"]:
            raise ValueError("another pre-tokenizer")
        # all classes of the pattern stand in brackets
        self.pattern = split["pattern"]["Regex"].replace(r"\p{L}", letters_of("L")).replace(r"\p{N}", letters_of("N")).replace(r"\s", _WHITE)
        self.special = sorted((a["content"] for a in said["added_tokens"]), key=len, reverse=True)
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in said["added_tokens"]):
            raise ValueError("special strings with conditions")
        end, byte = model["end_of_word_suffix"], byte_letters()

        def symbols(token: str) -> tuple[int, ...]:
            """Bytes of a token; the last one of a word counts from 256 on."""
            last = token.endswith(end) and len(token) > len(end)
            raw = [byte[c] for c in (token[: -len(end)] if last else token)]
            return (*raw[:-1], raw[-1] + 256) if last else tuple(raw)

        self.rank: dict[tuple[tuple[int, ...], tuple[int, ...]], int] = {}
        for i, (a, b) in enumerate(model["merges"]):
            self.rank.setdefault((symbols(a), symbols(b)), i)
        self.tokens = {(b,) for b in range(512)} | {a + b for a, b in self.rank}


class Transducer:
    """Lazily determinised transitions, annotated with the change of the number of tokens."""

    def __init__(self, grammar: Grammar, most: int = MOST_ARCS):
        self.grammar, self.most = grammar, most
        self.piece = re.compile(grammar.pattern)
        self.special = re.compile("|".join(map(re.escape, grammar.special))) if grammar.special else None
        # the trie: child by (node, symbol); the token of a node, if its way is one
        self.child: dict[tuple[int, int], int] = {}
        self.token: dict[int, tuple[int, ...]] = {}
        nodes = 1
        for t in grammar.tokens:
            at = 0
            for s in t:
                if (at, s) not in self.child:
                    self.child[at, s] = nodes
                    nodes += 1
                at = self.child[at, s]
            self.token[at] = t
        self.beside: dict[tuple, bool] = {}
        self._anew()

    def _anew(self) -> None:
        # a state: (node, token before or None, tokens up to there less those up to now) of each open place
        self.states: list[tuple] = [((0, None, 0),)]
        self.number = {self.states[0]: 0}
        self.arcs: dict[int, tuple[int, int]] = {}  # state << 9 | symbol -> (state, change)
        self.words: dict[bytes, int] = {}

    def stay(self, a: tuple[int, ...], b: tuple[int, ...]) -> bool:
        """Whether the merges of two tokens side by side (the first may be empty) end with these two."""
        found = self.beside.get((a, b))
        if found is None:
            if len(self.beside) > self.most:
                self.beside.clear()
            parts, rank, border = [(s,) for s in a + b], self.grammar.rank, len(a)
            while found is None:
                best = min(((r, i) for i, pair in enumerate(zip(parts, parts[1:])) if (r := rank.get(pair)) is not None), default=None)
                if best is None:
                    found = parts == [t for t in (a, b) if t]
                    break
                i = best[1]
                begin = sum(map(len, parts[:i]))
                if begin < border < begin + len(parts[i]) + len(parts[i + 1]):
                    found = False
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.beside[a, b] = found
        return found

    def _alone(self, t: tuple[int, ...]) -> bool:
        """Whether the merges of a token's symbols give the token."""
        return self.stay((), t) if len(t) > 1 else True

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """The state after a symbol and the change of the number of tokens; computed once, then an arc."""
        opened, count, last = [], None, None
        for node, before, at in self.states[state]:
            node = self.child.get((node, symbol))
            if node is None:
                continue
            opened.append((node, before, at))
            t = self.token.get(node)
            if t is not None and count is None and (self._alone(t) if before is None else self.stay(before, t)):
                count, last = at + 1, t
        if symbol < 256:
            key = (*((n, b, at - count) for n, b, at in opened), (0, last, 0))
            if key not in self.number:
                self.number[key] = len(self.states)
                self.states.append(key)
            found = self.number[key], count
        else:
            found = 0, count  # the word's end
        self.arcs[state << 9 | symbol] = found
        return found

    def piece_count(self, piece: bytes) -> int:
        """Tokens of one piece: the sum along its transitions."""
        if len(self.arcs) > self.most or len(self.states) > self.most:
            self._anew()
        state, total, arcs = 0, 0, self.arcs
        for symbol in piece[:-1]:
            hit = arcs.get(state << 9 | symbol) or self.step(state, symbol)
            state = hit[0]
            total += hit[1]
        symbol = piece[-1] + 256
        return total + (arcs.get(state << 9 | symbol) or self.step(state, symbol))[1]

    def word_count(self, word: bytes) -> int:
        """Tokens of a word without ASCII white space."""
        found = self.words.get(word)
        if found is None:
            if len(self.words) > self.most:
                self.words = {}
            low = word.lower()  # of ASCII letters alone
            if low.isalpha():
                found = self.piece_count(low)
            else:
                found = self._mixed_count(word.decode("utf-8", "surrogatepass"))
            self.words[word] = found
        return found

    def _mixed_count(self, word: str) -> int:
        if self.special is not None and "<" in word:
            found = at = 0
            for m in self.special.finditer(word):
                found, at = found + 1 + self._plain_count(word[at : m.start()]), m.end()
            return found + self._plain_count(word[at:])
        return self._plain_count(word)

    def _plain_count(self, word: str) -> int:
        normal = "".join(map(str.lower, unicodedata.normalize("NFC", word)))  # letter by letter: no rule looks at neighbours
        return sum(self.piece_count(p.encode("utf-8", "surrogatepass")) for p in self.piece.findall(normal))

    def state_map(self, chunk: bytes) -> StateMap:
        words = chunk.split()
        if not words:
            return (b"", 0, b"") if chunk else (b"", None, b"")
        first = b"" if chunk[:1].isspace() else words.pop(0)
        if not words and first and not chunk[-1:].isspace():
            return (first, None, b"")
        last = b"" if chunk[-1:].isspace() else words.pop()
        return (first, self._sum(words), last)

    def _sum(self, words: list[bytes]) -> int:
        known = self.words
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            return sum(map(self.word_count, words))

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        if a[1] is None and b[1] is None:
            return (a[0] + b[0], None, b"")
        if a[1] is None:
            return (a[0] + b[0], b[1], b[2])
        if b[1] is None:
            return (a[0], a[1], a[2] + b[0])
        joint = a[2] + b[0]
        return (a[0], a[1] + (self.word_count(joint) if joint else 0) + b[1], b[2])

    def count(self, text: bytes, chunk: int = CHUNK) -> int:
        maps = [self.state_map(text[i : i + chunk]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        if not maps:
            return 0
        first, between, last = maps[0]
        return (self.word_count(first) if first else 0) + (between or 0) + (self.word_count(last) if last else 0)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_bytes, n_tokens, over_limit.

    `tokenizer` is the path of a file of byte-pair merges with word ends and white space dropped, on every
    executor; another kind of file raises ValueError. Special strings in a text count as one token. Null and empty texts have 0 bytes and
    0 tokens. Letters newer than Python's own Unicode tables count as signs. Rows stay rows: repeated ones are counted again; other columns are ignored, and an empty table gives an empty one.
    A long text's chunks are mapped and composed in the task that reads it.
    """
    schema = "id long, n_bytes long, n_tokens long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = kept_by_worker(("tokens", tokenizer), lambda: Transducer(Grammar(tokenizer)))
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(by.count, texts), pa.int64())], ["id", "n_bytes", "n_tokens"])

    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(count, schema)
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
