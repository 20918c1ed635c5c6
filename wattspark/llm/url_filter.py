"""URL filters by a cascade of Bloom filters, with DataFrame functions only.

A rule is a key `host + path`. The keys that could match a url are built from the url alone: for each
shape of a rule (labels in its host, characters in its path) the host's last labels and the path's
first characters. All such keys of the corpus are the universe. Level 1 of the cascade encodes the
listed keys; level 2 those keys of the universe that level 1 takes for listed but are not; level 3
the listed keys that level 2 takes for such; and so on until a level has no false positive. Walking
the levels gives exact membership for every key of the universe, with no join at query time.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 10
HASHES = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str  # lower case, without a leading dot
    path: str = "/"  # empty or beginning with a slash

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    bits: int
    words: tuple[int, ...]  # the filter in 64-bit words

    def holds(self, key: Column, seed: int) -> Column:
        """Whether the filter takes `key` for one of its own."""
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded to a literal
        found = F.lit(True)
        for at in _positions(key, seed, self.bits):
            found = found & (F.getbit(F.get(words, (at / 64).cast("int")), (at % 64).cast("int")) == 1)
        return found


def _positions(key: Column, seed: int, bits: int) -> list[Column]:
    low = F.xxhash64(F.lit(seed), key).bitwiseAND(F.lit(0x7FFFFFFF))
    step = F.xxhash64(key, F.lit(seed)).bitwiseAND(F.lit(0x7FFFFFFF))
    return [(low + step * F.lit(i)) % F.lit(bits) for i in range(HASHES)]


def _built(keys: DataFrame, seed: int, bits: int) -> Level:
    """The filter of a one-column table of keys. What reaches the driver is the filter: `bits` / 64 numbers at most."""
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), seed, bits))).alias("at"))
    words = at.groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("mask")).collect()
    filled = dict((r["word"], r["mask"]) for r in words)
    return Level(bits, tuple(filled.get(i, 0) for i in range((bits + 63) // 64)))


def _bits(n: int, bits_per_key: int) -> int:
    return max(64, n * bits_per_key)


class Cascade:
    """Exact membership in `listed` for all keys of `universe` (one-column tables `key`)."""

    def __init__(self, listed: DataFrame, universe: DataFrame, bits_per_key: int = BITS_PER_KEY, most_levels: int = 64):
        self.levels: list[Level] = []
        inside, outside = listed.distinct(), universe
        while True:
            # even levels swap roles: what is encoded here, and what must not be taken for it
            own, other = (inside, outside) if len(self.levels) % 2 == 0 else (outside, inside)
            n = own.count()
            if n == 0 or len(self.levels) == most_levels:
                break
            seed = len(self.levels)
            level = _built(own, seed, _bits(n, bits_per_key))
            self.levels.append(level)
            wrong = other.filter(level.holds(F.col("key"), seed))
            if seed == 0:  # the universe holds listed keys too; here alone they are told apart by a join, over the few that pass level 1
                outside = wrong.distinct().join(listed, "key", "left_anti")
            elif seed % 2 == 0:
                outside = wrong
            else:
                inside = wrong
        if self.levels and n:
            raise RuntimeError("the cascade does not end")

    def member(self, key: Column) -> Column:
        """Whether the key is listed; exact for keys of the universe."""
        out = F.lit(len(self.levels) % 2 == 1)
        for seed in reversed(range(len(self.levels))):
            out = F.when(self.levels[seed].holds(key, seed), out).otherwise(F.lit(seed % 2 == 1))
        return out


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)([^?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)([^?#]*)", 2)


def candidate_keys(host: Column, path: Column, rules: Iterable[Rule]) -> Column:
    """The keys that a url could match by, one for each shape of a rule that fits it."""
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})
    labels = F.split(host, r"\.")
    keys = []
    for n, chars in shapes:
        fits = (F.size(labels) >= n) & (F.length(path) >= chars)
        keys.append(F.when(fits, F.concat(F.array_join(F.slice(labels, -n, n), "."), F.substring(path, 1, chars))))
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url", bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """One row per row of `pages`: id, host, path, rule, verdict.

    The longest rule that fits wins; of two rules with the same key, block. Urls that no rule fits get
    `default`, as do null urls and those without ://, whose host and path are empty. Repeated rows and
    null ids are rows like others; other columns are ignored. No rules: the default everywhere.
    """
    parts = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    keyed = parts.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), rules))
    universe = keyed.select(F.explode("keys").alias("key"))
    spark = pages.sparkSession
    blocked = {r.key for r in rules if r.verdict == "block"}
    lists = {"block": sorted(blocked), "allow": sorted({r.key for r in rules} - blocked)}
    cascades = {v: Cascade(spark.createDataFrame([(k,) for k in keys], "key string"), universe, bits_per_key) for v, keys in lists.items() if keys}

    def hits(verdict: str) -> Column:
        if verdict not in cascades:
            return F.array().cast("array<string>")
        return F.filter("keys", lambda k: cascades[verdict].member(k))

    def longest(keys: Column) -> Column:
        return F.aggregate(keys, F.lit(None).cast("string"), lambda a, k: F.when(a.isNull() | (F.length(k) > F.length(a)) | ((F.length(k) == F.length(a)) & (k < a)), k).otherwise(a))

    block, allow = F.col("block_rule"), F.col("allow_rule")
    found = keyed.withColumn("block_rule", longest(hits("block"))).withColumn("allow_rule", longest(hits("allow")))
    by_block = block.isNotNull() & (allow.isNull() | (F.length(block) >= F.length(allow)))
    return found.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.when(by_block, block).otherwise(allow).alias("rule"),
        F.when(by_block, F.lit("block")).when(allow.isNotNull(), F.lit("allow")).otherwise(F.lit(default)).alias("verdict"),
    )
