"""Personal data by rules and candidate gradient boosting, with DataFrame functions only.

Base spans come from fixed patterns. Looser generators propose further, possibly overlapping spans;
boosted trees over format and context features score them, and those above their kind's calibrated threshold are
added, the best of those that overlap. The trees learn from the corpus itself. Positives are base spans rewritten in their own
contexts as people disguise them (spelled-out signs, national numbers, other separators), so that the base patterns
no longer find them; negatives are what the generators propose where no base span is. So the added spans are personal data
in disguise, as far as it stands in contexts and forms like those of the plain kind; the estimate of precision counts every
natural candidate as wrong, and so errs on the careful side. All features are yes-or-no, so the training set folds to a table of feature patterns
(at most 4 kinds x 2**12 patterns x 2 folds rows, whatever the corpus), and boosting runs over that table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspark.llm.common import fold_bucket, fresh

KINDS = ("email", "ip", "card", "phone")

#: The base patterns. Possessive forms of the contract's: what follows never needs a shorter match, and
#: Java then loops where it would recurse. A card's pattern asks for 12 digits at once, as shorter runs never pass.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_GATE = {"email": "@", "ip": ".", "card": None, "phone": "+"}

#: The generators: looser forms of each kind.
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\[dot\]|\(dot\)| dot ) ?[A-Za-z0-9-]{2,63}){1,4}",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:(?:\.|\[\.\]| \. )[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ ./-]{0,2}[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9+.])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[ ./-]{1,2}(?:\([0-9]{1,5}\)|[0-9]{2,5})){1,6}(?![0-9])",
}
_LOOSE_GATE = {"email": r"@|\[at\]|\(at\)| at [^ ]+ ?(?:\[dot\]|\(dot\)| dot )", "ip": r"[0-9](?:\.|\[\.\]| \. )[0-9]", "card": r"[0-9](?:[ ./-]{0,2}[0-9]){12}", "phone": r"[0-9]\)?[ ./-]{1,2}\(?[0-9]"}

#: Words before a span that speak for its kind.
_CUES = {"email": r"mail|contact|write", "ip": r"\bip\b|addr|host|server", "card": r"card|visa|pay|account", "phone": r"phone|tel|call|mobile|fax"}

_SPAN = "struct<start:int,kind:int,end:int>"
_HITS = "array<struct<start:int,end:int,hit:string>>"


#: Matches that are placed together; a text's blocks are then placed one after another, so many matches don't cost their square.
_BLOCK = 64


def located(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches with their places (code points, end exclusive)."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))), lambda x: x["hit"].isNotNull())
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_HITS).alias("found"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(a["found"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit")))).alias("found"))

    def blocks(every: Column) -> Column:
        numbers = F.sequence(F.lit(0), ((F.size(every) - 1) / _BLOCK).cast("int"))
        return F.transform(numbers, lambda i: F.aggregate(F.slice(every, i * _BLOCK + 1, F.lit(_BLOCK)), zero, step))

    def joined(placed: Column) -> Column:
        begins = F.aggregate(placed, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, p: F.struct((a["at"] + p["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        return F.flatten(F.zip_with(placed, begins, lambda p, o: F.transform(p["found"], lambda h: F.struct((h["start"] + o).alias("start"), (h["end"] + o).alias("end"), h["hit"].alias("hit")))))

    # each step in a lambda over a list of one, so that it is worked out once
    return F.get(F.transform(F.transform(F.array(pairs), blocks), joined), F.lit(0))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    each = F.split(F.reverse(digits), "").cast("array<int>")
    # every second digit from the right counts double, less 9 where that has two digits
    worth = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(worth, F.lit(0), lambda a, d: a + d) % 10 == 0


def _passes(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(hit)).between(12, 19) & luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _base_of(k: int, text: Column) -> Column:
    kind = KINDS[k]
    gate = text.contains(_GATE[kind]) if _GATE[kind] else text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")
    good = F.filter(located(text, BASE[kind]), lambda x: _passes(kind, x["hit"]))
    spans = F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))
    return F.when(gate, spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def base_spans(text: Column) -> Column:
    """The base spans, by start and then kind."""
    return F.array_sort(F.concat(*[_base_of(k, text) for k in range(len(KINDS))]))


#: The features of a candidate, in the order of their bits.
FEATURES = ("cue", "glued_before", "glued_after", "separated", "brackets", "many_digits", "few_distinct", "spelled_out", "leading_zero", "date_like", "long_groups", "sentence_end")


def _bits(kind: str, text: Column, x: Column) -> Column:
    before = F.substring(text, F.greatest(F.lit(1), x["start"] - 23), F.least(F.lit(24), x["start"]))
    after = F.substring(text, x["end"] + 1, F.lit(4))
    tests = (
        F.lower(before).rlike(_CUES[kind]),
        before.rlike(r"[A-Za-z0-9_#=/\"'.-]$"),
        after.rlike(r"^[A-Za-z0-9_#=/\"'-]"),
        x["hit"].rlike(r"[ ./-]"),
        x["hit"].rlike(r"[()\[]"),
        F.length(_digits(x["hit"])) >= 13,
        F.size(F.array_distinct(F.split(_digits(x["hit"]), ""))) <= 3,
        x["hit"].rlike(r"at|dot"),
        x["hit"].rlike(r"^\(?0"),
        x["hit"].rlike(r"^(?:19|20)[0-9]{2}[ ./-]|[ ./-](?:19|20)[0-9]{2}$"),
        x["hit"].rlike(r"[0-9]{3}[^0-9]+[0-9]{3}"),
        x["hit"].rlike(r"[^ ]\. "),
    )
    out = F.lit(0)
    for i, test in enumerate(tests):
        out = out + F.when(test, F.lit(1 << i)).otherwise(F.lit(0))
    return out


def _overlaps(spans: Column, x: Column, kind: int | None = None) -> Column:
    return F.exists(spans, lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]) & (F.lit(True) if kind is None else b["kind"] == kind))


def _proposed(k: int, text: Column, base: Column) -> Column:
    kind = KINDS[k]
    hits = located(text, LOOSE[kind])
    if kind == "card":
        hits = F.filter(hits, lambda x: luhn(_digits(x["hit"])))
    if kind == "phone":
        hits = F.filter(hits, lambda x: F.length(_digits(x["hit"])).between(8, 15))
    found = F.transform(
        hits,
        lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), _bits(kind, text, x).alias("bits"), _overlaps(base, x, k).alias("label"), _overlaps(base, x).alias("known")),
    )
    return F.when(text.rlike(_LOOSE_GATE[kind]), found).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,bits:int,label:boolean,known:boolean>>"))


def candidates(text: Column, base: Column) -> Column:
    """What the generators propose: place, kind, feature bits, whether a base span of the kind covers it, whether any does."""
    return F.concat(*[_proposed(k, text, base) for k in range(len(KINDS))])


def _disguised(kind: str, hit: Column, draw: Column) -> Column:
    """A base span as people disguise it; `draw` chooses the form."""
    one_of = lambda *forms: F.get(F.array(*forms), F.pmod(draw, F.lit(len(forms))).cast("int"))
    if kind == "email":
        signs = lambda at, dot: F.replace(F.regexp_replace(hit, r"@([A-Za-z0-9-]+)\.", f"{at}$1{dot}"), F.lit("@"), F.lit(at))
        return one_of(signs(" at ", " dot "), signs(" [at] ", " [dot] "), signs("(at)", "(dot)"), signs("[at]", "."))
    if kind == "ip":
        return one_of(F.replace(hit, F.lit("."), F.lit("[.]")), F.replace(hit, F.lit("."), F.lit(" . ")))
    digits = _digits(hit)
    if kind == "card":
        grouped = lambda sign: F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", f"$1{sign}")
        return one_of(grouped("."), grouped("/"), grouped(" - "))
    parts = lambda head: F.concat(F.lit(head), F.regexp_replace(digits, r"^([0-9]{2})([0-9]{3})([0-9]+?)([0-9]{2,4})$", "$1 $2 $3 $4"))
    national = F.regexp_replace(F.regexp_replace(hit, r"^\+[0-9]{1,3}[ .-]?", ""), r"^[^0-9(]+", "")
    return one_of(parts("00"), national, parts("0"), F.translate(national, "().-", "    "))


def disguises(text: Column, base: Column) -> Column:
    """Positives for training: what the generators propose, of the same kind, over disguised base spans in their contexts."""

    def of_kind(k: int) -> Column:
        def found(s: Column) -> Column:
            begin = F.greatest(F.lit(0), s["start"] - 24)
            before = F.substring(text, begin + 1, s["start"] - begin)
            hit = F.substring(text, s["start"] + 1, s["end"] - s["start"])
            now = _disguised(KINDS[k], hit, F.xxhash64(hit, s["start"]))
            place = F.struct(F.length(before).alias("start"), F.lit(k).alias("kind"), (F.length(before) + F.length(now)).alias("end"))
            return F.filter(_proposed(k, F.concat(before, now, F.substring(text, s["end"] + 1, F.lit(24))), F.array(place)), lambda c: c["label"])

        return F.flatten(F.transform(F.filter(base, lambda s: s["kind"] == k), found))

    return F.concat(*map(of_kind, range(len(KINDS))))


@dataclass(frozen=True)
class Booster:
    """Trees of depth 2 over yes-or-no features: (feature, feature if yes, feature if no, four leaves), and for each
    kind the least score that is added (None: nothing is sure enough) with the precision and recall measured there."""

    trees: tuple[tuple[int, int, int, tuple[float, float, float, float]], ...] = ()
    bias: float = 0.0
    thresholds: tuple[float | None, ...] = (None,) * len(KINDS)
    measured: tuple[tuple[float, float], ...] = ((0.0, 0.0),) * len(KINDS)

    def raw(self, kind: int, bits: int) -> float:
        on = lambda f: kind == f - len(FEATURES) if f >= len(FEATURES) else bool(bits >> f & 1)
        return self.bias + sum((t[3][0] if on(t[1]) else t[3][1]) if on(t[0]) else (t[3][2] if on(t[2]) else t[3][3]) for t in self.trees)

    def score(self, kind: Column, bits: Column) -> Column:
        def on(f: int) -> Column:
            return kind == f - len(FEATURES) if f >= len(FEATURES) else F.getbit(bits, F.lit(f)) == 1

        out = F.lit(self.bias)
        for first, yes, no, leaf in self.trees:
            out = out + F.when(on(first), F.when(on(yes), leaf[0]).otherwise(leaf[1])).otherwise(F.when(on(no), leaf[2]).otherwise(leaf[3]))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-out))


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-z))


def boost(table: list[tuple[int, int, int, int]], rounds: int = 24, rate: float = 0.3, ridge: float = 1.0) -> tuple[tuple, float]:
    """Newton boosting over rows (kind, bits, candidates, positives)."""
    total, good = sum(r[2] for r in table), sum(r[3] for r in table)
    bias = math.log((good + 1) / (total - good + 1))
    wide = len(FEATURES) + len(KINDS)
    on = [[bool(r[1] >> f & 1) if f < len(FEATURES) else r[0] == f - len(FEATURES) for f in range(wide)] for r in table]
    z, trees = [bias] * len(table), []

    def split(rows: list[int], g: list[float], h: list[float]) -> tuple[float, int, float, float]:
        """Gain, feature, leaf if yes, leaf if no."""
        best = (-1.0, 0, 0.0, 0.0)
        gs, hs = sum(g[i] for i in rows), sum(h[i] for i in rows)
        for f in range(wide):
            gy, hy = sum(g[i] for i in rows if on[i][f]), sum(h[i] for i in rows if on[i][f])
            gain = gy * gy / (hy + ridge) + (gs - gy) ** 2 / (hs - hy + ridge)
            if gain > best[0] + 1e-12:
                best = (gain, f, gy / (hy + ridge), (gs - gy) / (hs - hy + ridge))
        return best

    for _ in range(rounds):
        p = [_sigmoid(x) for x in z]
        g = [r[3] - r[2] * q for r, q in zip(table, p)]
        h = [r[2] * q * (1 - q) for r, q in zip(table, p)]
        every = list(range(len(table)))
        options = []
        for f in range(wide):
            yes, no = [i for i in every if on[i][f]], [i for i in every if not on[i][f]]
            a, b = split(yes, g, h), split(no, g, h)
            options.append((a[0] + b[0], -f, (f, a[1], b[1], tuple(rate * v for v in (a[2], a[3], b[2], b[3])))))
        tree = max(options)[2]
        trees.append(tree)
        for i in every:
            z[i] += (tree[3][0] if on[i][tree[1]] else tree[3][1]) if on[i][tree[0]] else (tree[3][2] if on[i][tree[2]] else tree[3][3])
    return tuple(trees), bias


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.98) -> Booster:
    """Fits the trees on three folds of four by id and the thresholds on the fourth: for each kind the least score from which
    candidates are right in `precision` of all cases there.

    Null texts count as empty, null ids as one id; repeated rows count again. Without candidates nothing is ever added.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    each = docs.select((fold_bucket(F.col(id_col), 4) == 3).alias("calibrates"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    natural = F.filter(candidates(F.col("text"), F.col("base")), lambda c: ~c["known"])
    rows = each.select("calibrates", F.explode(F.concat(natural, disguises(F.col("text"), F.col("base")))).alias("c"))
    table = rows.groupBy("calibrates", "c.kind", "c.bits").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c.label").cast("int")).alias("good")).collect()
    learn = sorted((r["kind"], r["bits"], r["n"], r["good"]) for r in table if not r["calibrates"])
    check = sorted((r["kind"], r["bits"], r["n"], r["good"]) for r in table if r["calibrates"])
    if not learn or not check:
        return Booster()
    trees, bias = boost(learn)
    model = Booster(trees, bias)
    thresholds, measured = [], []
    for kind in range(len(KINDS)):
        scored = sorted(((_sigmoid(model.raw(k, b)), n, g) for k, b, n, g in check if k == kind), reverse=True)
        whole, n, good, best = sum(x[2] for x in scored), 0, 0, (None, (0.0, 0.0))
        for i, (p, m, g) in enumerate(scored):
            n, good = n + m, good + g
            if (i + 1 == len(scored) or scored[i + 1][0] < p) and good and good >= precision * n:
                best = (p - 1e-9, (good / n, good / whole))
        thresholds.append(best[0])
        measured.append(best[1])
    return Booster(trees, bias, tuple(thresholds), tuple(measured))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def added_spans(text: Column, base: Column, model: Booster) -> Column:
    """What the model adds to the base spans: no overlap with them, and of added ones that overlap the best, then the first by kind."""
    if not any(t is not None for t in model.thresholds):
        return F.array().cast(f"array<{_SPAN}>")
    least = F.array(*[F.lit(2.0 if t is None else t) for t in model.thresholds])
    scored = F.transform(F.filter(candidates(text, base), lambda c: ~c["known"]), lambda c: F.struct(model.score(c["kind"], c["bits"]).alias("score"), c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    sure = F.filter(scored, lambda c: c["score"] >= F.get(least, c["kind"]))
    better = lambda o, c: (o["score"] > c["score"]) | ((o["score"] == c["score"]) & (o["kind"] < c["kind"]))
    kept = F.transform(F.array(sure), lambda every: F.filter(every, lambda c: ~F.exists(every, lambda o: (o["start"] < c["end"]) & (o["end"] > c["start"]) & better(o, c))))[0]
    return F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))


def find_pii(docs: DataFrame, model: Booster, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, counts of base spans by kind, base_spans and spans (arrays of start, kind, end).

    Null and empty texts have no spans. Spans of different kinds may overlap; an added span never overlaps a
    base one. Equal starts are in the order of KINDS. Repeated rows are rows of their own; other columns
    are ignored, and an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("base", base_spans(F.col("text")))
    base = F.col("base")
    spans = F.array_sort(F.concat(base, added_spans(F.col("text"), base, model)))

    def count(k: int) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(len(KINDS))]
    return rows.select(F.col("id").alias(id_col), *counts, base.alias("base_spans"), spans.alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Spans as text: base_sha256 of the base spans, and all spans listed; documents without spans have empty lists."""
    return found.select(id_col, *[f"n_{k}" for k in KINDS], F.sha2(_listed(F.col("base_spans")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, model: Booster, text_col: str = "text") -> DataFrame:
    """`docs` with each span of its text replaced by its kind in brackets; overlapping spans become one, named by the first.

    Null texts stay null; repeated rows, and rows that share an id, are redacted each by its own spans.
    """
    own_base, own_spans = fresh(docs, "own_base", "own_spans")
    text, names = F.col(f"`{text_col}`"), F.array(*map(F.lit, KINDS))
    known = F.coalesce(text, F.lit(""))
    found = docs.withColumn(own_base, base_spans(known))
    found = found.withColumn(own_spans, F.array_sort(F.concat(F.col(own_base), added_spans(known, F.col(own_base), model))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        new = s["start"] >= a["at"]
        said = F.concat(a["out"], F.substring(text, a["at"] + 1, F.greatest(F.lit(0), s["start"] - a["at"])), F.when(new, F.concat(F.lit("["), F.get(names, s["kind"]), F.lit("]"))).otherwise(F.lit("")))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), said.alias("out"))

    clean = F.aggregate(F.col(own_spans), zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(text.isNotNull(), clean)).drop(own_base, own_spans)
