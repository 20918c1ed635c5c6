import random

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from wattspark.llm.sentence_pieces import Pieces, decoded, encode
from wattspark.llm.token_counts import Grammar, Transducer, token_counts

MODEL, WORDS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "  a  b ", "a\n\nb\n", "日本語 😀 é", "a" * 3000, "<|endoftext|> x <|endoftext|>y", "don't  WE'LL 12.5%", "x\u00a0y\u2028z", "\tTab\r\n", "word " * 20_000, " " * 300 + "z", "<s> <0x0A>"]


def test_token_counts_equal_the_library(spark):
    t = Tokenizer.from_file(WORDS)
    docs = spark.createDataFrame([(i, x, 0) for i, x in enumerate(TEXTS)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in token_counts(docs, WORDS).collect()}
    for i, x in enumerate(TEXTS):
        want = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (want, len((x or "").encode()), want > 2048)
    assert token_counts(docs.limit(0), WORDS).count() == 0


@pytest.fixture(scope="module")
def words():
    return Transducer(Grammar(WORDS)), Tokenizer.from_file(WORDS)


def test_state_maps_compose_like_whole_texts(words):
    by, _ = words
    r = random.Random(2)
    for _ in range(200):
        text = "".join(r.choice("ab \n'x") for _ in range(r.randint(0, 60))).encode()
        assert by.count(text, 4) == by.count(text, 10**6)
    small = Transducer(by.grammar, most=2)
    assert small.count(b"one two three one") == by.count(b"one two three one")


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("theaionrsTHEß'’.,!?<|>0129 -_ΣİÉ日가\u0301\x1c\x85\u3000"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=40), st.integers(1, 50))
def test_transducer_equals_the_library(words, text, chunk):
    by, library = words
    assert by.count(text.encode(), chunk) == len(library.encode(text, add_special_tokens=False).ids)


def test_transducer_on_all_documents_and_other_files(words):
    by, library = words
    import duckdb

    texts = [x or "" for (x,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    assert [by.count(x.encode()) for x in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(by.states) < len(by.arcs)
    with pytest.raises(ValueError):
        Grammar(P.path("byte_bpe_50k.json"))


def test_pieces_equal_the_library(spark):
    m = SentencePieceProcessor(model_file=MODEL)
    docs = spark.createDataFrame([(i, x, 0) for i, x in enumerate(TEXTS)] + [(99, "again", 1), (99, "again", 1)], "doc_id long, text string, ids int")
    for head in (3, 1000):
        got = encode(docs, MODEL, head_words=head).withColumn("back", decoded(F.col("ids"), MODEL)).collect()
        assert len(got) == len(TEXTS) + 2
        for r in got:
            text = ("again" if r.doc_id == 99 else TEXTS[r.doc_id]) or ""
            assert list(r.ids) == m.encode(text)
            assert r.back == text
    assert encode(docs.limit(0), MODEL).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return Pieces(MODEL), SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("theaionrs ,.éß\nT0"), max_size=60))
def test_fold_equals_the_library(pieces, text):
    p, m = pieces
    found = [i for w in p.words(text) for i in (p.agenda(w) if w.startswith("▁▁") else p.fold(w))]
    assert found == m.encode(text)
    assert [i for w in p.words(text) for i in p.merged(w)] == [i for w in p.words(text) for i in p.agenda(w)] == found
