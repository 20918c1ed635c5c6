import hashlib
import random

import pytest
from pyspark.sql import functions as F

from wattspark.llm.exact_dedup import exact_dedup, keep_unique
from wattspark.llm.mixing import KNAPSACK_WORDS, fit, mix, mixed_documents, water_fill

DOCS = "doc_id long, text string, lang string, source string, content string, digest string"


def rows(spark, data):
    return spark.createDataFrame([(i, t, "en", s, "x", "y") for i, t, s in data], DOCS)


def norm(t):
    return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")


def test_exact_dedup_against_brute_force(spark):
    data = [(i, t, "a") for i, t in enumerate(["a b", "ab", "a  b", None, "", " \n", "x" * 5000, "x " * 5000, "é", "ab"] + ["copy"] * 40)] + [(None, "ab", "a"), (7, "x " * 5000, "a")]
    got = {}
    for r in exact_dedup(rows(spark, data)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t, _ in data:
        group = [x for x in data if norm(x[1]) == norm(t)]
        best = min(group, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))[0]
        for r in got[i]:
            assert (r.keep_id, r.group_size, r.kept) == (best, len(group), i == best)
            assert r.text_sha256 == hashlib.sha256(norm(t).encode()).hexdigest()
    assert sum(map(len, got.values())) == len(data)


def test_exact_dedup_keeps_contents_of_one_digest_apart(spark, monkeypatch):
    real = F.sha2
    monkeypatch.setattr(F, "sha2", lambda c, n: F.substring(real(c, n), 1, 1))  # sixteen digests, many collisions
    data = [(i, f"text {i % 60}", "a") for i in range(200)]
    got = exact_dedup(rows(spark, data)).collect()
    assert len(got) == 200
    assert all(r.keep_id == r.doc_id % 60 and r.group_size == len(range(r.doc_id % 60, 200, 60)) for r in got)


def test_exact_dedup_of_nothing_and_columns_kept(spark):
    assert exact_dedup(rows(spark, [])).count() == 0
    kept = keep_unique(rows(spark, [(1, "a", "s"), (2, "a ", "s"), (3, "b", "s")]))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")] and sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_water_fill():
    assert water_fill([("a", 100), ("b", 100), (None, 100)]) == pytest.approx({"a": 187.5, "b": 75.0, None: 37.5})
    capped = water_fill([("a", 10), ("b", 100), ("c", 100)])
    assert capped["a"] == 30 and capped["b"] == pytest.approx(120) and capped["c"] == pytest.approx(60)
    assert water_fill([]) == {}


def test_fit_reaches_the_budget():
    r = random.Random(3)
    for _ in range(30):
        lengths = {r.randint(1, 300): r.randint(1, 4) for _ in range(r.randint(1, 40))}
        total = sum(n * c for n, c in lengths.items())
        budget = r.randint(0, total)
        take = fit(lengths, budget)
        assert all(0 <= take[n] <= lengths[n] for n in take)
        reach = 1
        for n, c in lengths.items():
            for _ in range(c):
                reach |= reach << n
        best = max(s for s in range(budget + 1) if reach >> s & 1)
        got = sum(n * c for n, c in take.items())
        assert got <= budget
        if total < KNAPSACK_WORDS:
            assert best - got <= min(lengths)
    assert fit({5: 2}, 0) == {} and fit({}, 9) == {}


def test_mix_meets_targets_and_reruns_agree(spark):
    r = random.Random(1)
    data = [(i, "w " * r.randint(0, 30), r.choice(["a", "a", "b", None])) for i in range(300)] + [(1000, None, "a"), (1001, "one", "zero-ish"), (1002, "same same", "a"), (1002, "same same", "a")]
    docs = rows(spark, data)
    got = mix(docs).collect()
    assert len(got) == len(data)
    again = {(x.doc_id, x.source, x.taken) for x in mix(docs).collect()}
    assert {(x.doc_id, x.source, x.taken) for x in got} == again
    for source in {x.source for x in got}:
        own = [x for x in got if x.source == source]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 2
        assert sum(x.size for x in own) == own[0].source_size
    assert all(x.taken <= 3 * x["size"] for x in got)
    assert mix(rows(spark, [])).count() == 0
    out = mixed_documents(docs.filter("doc_id < 1000"))
    assert out.columns == docs.columns and out.count() == sum(x.copies for x in mix(docs.filter("doc_id < 1000")).collect())


def test_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (1, "a  b", "s"), (1, "a  b", "s"), (1, "c", "s"), (0, "c ", "s"), (None, "d", "s"), (None, "d", "s")], "doc_id long, text string, kept_id string").repartition(2)
    got = sorted(map(str, ((r.doc_id, r.text) for r in keep_unique(docs).collect())))
    assert got == sorted(map(str, [(1, "a  b"), (0, "c "), (None, "d")]))
    assert keep_unique(docs).columns == docs.columns and keep_unique(docs.limit(0)).count() == 0


def test_mixed_documents_of_repeated_rows_and_clashing_names(spark):
    data = [(1, "a b c", "s", 1)] * 3 + [(1, "d e f", "s", 1), (2, "x y", "t", 2), (None, "x y z w", "t", 2), (3, None, "t", 3), (4, "q " * 40, None, 3)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, mix_id int")
    taken = mix(docs).groupBy("doc_id", "source", "size").agg({"copies": "sum"}).collect()
    out = mixed_documents(docs)
    rows = out.collect()
    assert out.columns == docs.columns and len(rows) == sum(t[3] for t in taken)
    for doc_id, source, size, copies in taken:
        assert sum((r.doc_id, r.source, len((r.text or "").split())) == (doc_id, source, size) for r in rows) == copies
    same = [sum(r.text == x for r in rows) for x in ("a b c", "d e f")]
    assert abs(same[0] - 3 * same[1]) <= 3
    assert mixed_documents(docs.limit(0)).count() == 0
