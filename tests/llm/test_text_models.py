import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattspark.llm import hmm_lm
from wattspark.llm.common import fold_bucket
from wattspark.llm.language_id import fit_dictionaries, identify
from wattspark.llm.pii import KINDS, Booster, digest, find_pii, redacted, train
from wattspark.llm.url_filter import Rule, judge_urls

SF = "/root/testdata/sf0.01"


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    held = fold_bucket(F.col("doc_id"), 5) == 0
    dictionaries, counts = fit_dictionaries(docs.filter(~held))
    found = identify(docs.filter(held), dictionaries, counts).collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.95 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_id_of_little(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "12 !?", 1), (4, "the cat", 1), (4, "the cat", 1)], "doc_id long, text string, score int")
    d, c = {"en": b"the cat sat on the mat", "fr": b"le chat est sur la table"}, {"en": 2, "fr": 1}
    got = identify(docs, d, c).collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and all(r.rejected for r in got[:3])
    assert {r.lang_pred for r in got[3:]} == {"en"} and len(got) == 5
    none = identify(docs, {}, {}).collect()
    assert {r.lang_pred for r in none} == {"und"} and [r.rejected for r in none] == [True] * 3 + [False] * 2
    assert identify(docs.limit(0), d, c).count() == 0 and fit_dictionaries(docs.limit(0).withColumn("lang", F.lit("x"))) == ({}, {})
    long = spark.createDataFrame([(1, "the cat sat on the mat " * 40_000), (2, "zq 81 " * 100), (3, "zq")], "doc_id long, text string")
    assert [(r.lang_pred, r.rejected) for r in identify(long, d, c).collect()] == [("en", False), ("en", True), ("en", False)]  # ties: the commoner language
    assert fit_dictionaries(docs.withColumn("lang", F.lit(None).cast("string"))) == ({}, {})


def luhn(s):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(s))) % 10 == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            n = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (kind == "card" and not (12 <= len(n) <= 19 and luhn(n))) or (kind == "phone" and not 9 <= len(n) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_against_brute_force(spark):
    data = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(300).collect()]
    data += [None, "", "9" * 50_000, "1 " * 20_000, "a@b.c_x@d.e a.b@c..d x@y", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.4", "é +49 (30) 123-4567 é", "4111 1111 1111 1111 4111-1111-1111-1112", "+1" + " 2" * 20, "9" * 100_000 + " 1.2", "1." * 50_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(data)], "doc_id long, text string, base string")
    got = digest(find_pii(docs, Booster())).collect()
    assert len(got) == len(data)
    for r in got:
        want = [] if (data[r.doc_id] or "").startswith("9999") else spans(data[r.doc_id])  # the brute force takes squares of time
        listed = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.spans == listed and r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[1] == i for x in want) for i in range(4)]


def test_boosted_candidates_add_but_never_remove(spark):
    name = lambda i: f"{'abcdefgh'[i % 8]}{'klmnop'[i % 6]}"
    texts = [f"word {i} call +1 (21{i % 9}) 555-01{i % 90 + 10} now" for i in range(300)] + [f"write to {name(i)}.{i}@mail{i % 7}.example.com or to {i}.{i % 200}.7.{i % 99} today" for i in range(256)]
    texts += [f"level {i} of 12, on 20{i % 10}{i % 9}-0{i % 9 + 1}-1{i % 9}, part 12/{100 + i}/{2000 + i}" for i in range(300)]
    plain = len(texts)
    texts += ["please call (212) 555-0187 now", "write to jo.smith [at] mail2.example [dot] com today", "nothing here", "on 2019-03-11 we met"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, own_spans string")
    model = train(docs)
    for kind in (0, 3):
        assert model.thresholds[kind] is not None and model.measured[kind][0] >= 0.95 and model.measured[kind][1] >= 0.5
    got = {r.doc_id: r for r in find_pii(docs, model).collect()}
    assert all(set(r.base_spans) <= set(r.spans) for r in got.values())
    assert [s.kind for s in got[plain].spans] == [3] and [s.kind for s in got[plain + 1].spans] == [0]
    assert not got[plain + 2].spans and not got[plain + 3].spans
    assert sum(len(got[i].spans) > len(got[i].base_spans) for i in range(plain)) <= 0.05 * plain
    again = docs.filter(f"doc_id >= {plain}").unionByName(spark.createDataFrame([(plain, "or +1 (212) 555-0187", "y"), (None, None, "z")], docs.schema))
    clean = redacted(again, model)
    assert clean.columns == docs.columns
    assert sorted(map(str, (r.text for r in clean.collect()))) == sorted(["please call [phone] now", "write to [email] today", "nothing here", "on 2019-03-11 we met", "or [phone]", "None"])
    assert train(docs.limit(0)) == Booster() and find_pii(docs.limit(0), model).count() == 0


RULES = [Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"), Rule("block", "bare.org", "")]


def judged(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.key), r.verdict == "block"), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


@pytest.mark.parametrize("bits", [10, 1])  # with one bit a key the cascade has many levels
def test_url_filter_against_brute_force(spark, bits):
    urls = [None, "", "nothing", "http://", "http://net", "http://NET/", "http://a.net/x?y=/en/", "https://m.Example.net/en/1#t", "http://example.net/en", "http://xexample.com/de/", "http://www.example.com/de/?q", "x://org/fr/", "a://b://c.net/", "http://.net/", "http://bare.org", "http://a.bare.org?x/fr/"]
    urls += [f"http://h{i}.d{i % 7}.{t}/{p}/{i}" for i in range(60) for t in ("net", "org", "com") for p in ("en", "fr", "de")]
    pages = spark.createDataFrame([(i, u, "r", "k") for i, u in enumerate(urls)], "page_id long, url string, rule string, keys string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, RULES, bits_per_key=bits).collect()}
    assert got == {i: judged(u) for i, u in enumerate(urls)}
    assert judge_urls(pages.limit(0), RULES).count() == 0 and {r.verdict for r in judge_urls(pages, []).collect()} == {"allow"}


def random_model(seed, k):
    r = np.random.default_rng(seed)
    return r, hmm_lm.Model(r.dirichlet(np.ones(k)), r.dirichlet(np.ones(k), k), r.dirichlet(np.ones(hmm_lm.SYMBOLS), k))


def test_forward_recursion_is_exact():
    r, m = random_model(1, 3)
    seqs = [r.integers(0, hmm_lm.SYMBOLS, n).astype(np.uint16) for n in (1, 2, 5, 70, 300)]
    at = np.concatenate(([0], np.cumsum([len(q) for q in seqs])))
    got = m.log10_likelihood(np.concatenate(seqs), at[:-1], np.diff(at))
    for q, x in zip(seqs, got):
        assert x == pytest.approx(plain_recursions(m, q)[0])


def plain_recursions(m, q):
    """log10 likelihood and Baum-Welch counts of one whole sequence, step by step."""
    k = len(m.first)
    alphas, scales = [], []
    for t, y in enumerate(q):
        a = (m.first if t == 0 else alphas[-1] @ m.step) * m.emit[:, y]
        scales.append(a.sum())
        alphas.append(a / a.sum())
    beta, step, emit = np.ones(k), np.zeros((k, k)), np.zeros((k, hmm_lm.SYMBOLS))
    for t in range(len(q) - 1, -1, -1):
        gamma = alphas[t] * beta
        emit[:, q[t]] += gamma
        if t:
            onward = m.emit[:, q[t]] * beta / scales[t]
            step += np.outer(alphas[t - 1], onward) * m.step
            beta = m.step @ onward
    return np.log10(scales).sum(), gamma, step, emit


@pytest.mark.parametrize("segment", [1, 4, 64, 10_000])
def test_baum_welch_counts_over_whole_sequences(segment, monkeypatch):
    monkeypatch.setattr(hmm_lm, "SEGMENT", segment)
    r, m = random_model(2, 3)
    seqs = [r.integers(0, 50, n).astype(np.uint16) for n in (1, 5, 64, 65, 200, 4, 129)]
    ends = np.concatenate(([0], np.cumsum([len(q) for q in seqs])))
    first, step, emit = m.expected(np.concatenate(seqs), ends)
    want = [sum(x) for x in zip(*[plain_recursions(m, q)[1:] for q in seqs])]
    assert np.allclose(first, want[0]) and np.allclose(step, want[1]) and np.allclose(emit, want[2])


def test_baum_welch_counts_against_enumeration():
    r, m = random_model(3, 2)
    k, q = 2, r.integers(0, 5, 6).astype(np.uint16)
    first, step, emit = m.expected(q, np.array([0, 6]))
    weight, want = 0.0, np.zeros((k, k))
    for path in np.ndindex(*[k] * 6):
        p = m.first[path[0]] * m.emit[path[0], q[0]]
        for t in range(1, 6):
            p *= m.step[path[t - 1], path[t]] * m.emit[path[t], q[t]]
        weight += p
        for t in range(1, 6):
            want[path[t - 1], path[t]] += p
    assert np.allclose(step, want / weight) and first.sum() == pytest.approx(1) and emit.sum() == pytest.approx(6)


def test_scores_and_counts(spark, monkeypatch):
    monkeypatch.setattr(hmm_lm, "HEAD_WORDS", 40)  # most words take the join
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(200)
    docs = docs.union(spark.createDataFrame([(10**6, None), (10**6 + 1, "zzqx ZZQX yy"), (10**6 + 1, "zzqx ZZQX yy")], "doc_id long, text string"))
    training = fold_bucket(F.col("doc_id"), 7) != 2
    got = hmm_lm.score(docs, training, iterations=2).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    data = [(r.doc_id, (r.text or "").translate(low).encode().split() + [b" "]) for r in docs.collect()]
    c = collections.Counter(w for i, ws in data if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(data)
    words = dict(data)
    for r in got:
        ws = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score < 0
    assert hmm_lm.score(docs.limit(0), training, iterations=1).count() == 0
