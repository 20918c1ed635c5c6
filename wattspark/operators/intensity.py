"""Intensity of a workout: features of its power, and what training they make, in numpy and for tables.

All judgements are on 15 s means. Blocks are stretches of them above a share of FTP.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspark.operators.kernels import best_apart, expected_power, half_up, normalized_power, runs

BUCKET = 15
EFFORTS = (30, 60, 120, 240, 480, 900, 1200)
#: Tags, one bit each, in this order.
TAGS = ("recovery", "endurance", "tempo", "threshold", "vo2max", "anaerobic")


@dataclass(frozen=True)
class Block:
    start: int  # seconds
    duration: int
    power: float

    @property
    def end(self) -> int:
        return self.start + self.duration


def features(power: np.ndarray) -> dict:
    """Means, spread, 15 s buckets, a histogram of 25 W steps and the best efforts of a 1 Hz power series."""
    p = np.clip(half_up(np.maximum(np.nan_to_num(np.asarray(power, float)), 0)), 0, 65534)
    mean = float(p.mean()) if len(p) else 0.0
    np_ = normalized_power(p)
    starts = np.arange(0, len(p), BUCKET)
    return {
        "seconds": len(p),
        "positive_seconds": int((p > 0).sum()),
        "coverage": float((p > 0).mean()) if len(p) else 0.0,
        "average_power": float(half_up(mean)),
        "normalized_power": np_,
        "variability": np_ / mean if mean > 0 else 0.0,
        "variation": float(p.std()) / mean if mean > 0 else 0.0,
        "buckets": half_up(np.add.reduceat(p, starts) / np.diff(np.append(starts, len(p)))) if len(p) else p,
        "histogram": np.bincount(np.minimum(40, p // 25).astype(int), minlength=41),
        "efforts": {d: best_apart(p, d) for d in EFFORTS},
    }


def blocks(buckets: np.ndarray, watts: float, least: int, most: int, bridged: bool = True) -> list[Block]:
    """Stretches at `watts` or more that last `least` to `most` seconds; a single bucket below doesn't break one, if `bridged`."""
    high = buckets >= watts
    if bridged and len(high) > 2:
        high = np.concatenate((high[:1], high[1:-1] | (high[:-2] & high[2:]), high[-1:]))
    found = [Block(a * BUCKET, (b - a) * BUCKET, float(half_up(buckets[a:b].mean()))) for a, b in runs(high)]
    return [x for x in found if least <= x.duration <= most]


def _alike(a: float, b: float) -> float:
    return min(a, b) / max(a, b) if max(a, b) > 0 else 1.0


def repeated(found: list[Block]) -> bool:
    """Whether two of the blocks are alike in length and power with a rest of 30 s or more between them."""
    return any(_alike(a.duration, b.duration) >= 0.7 and _alike(a.power, b.power) >= 0.85 and b.start - a.end + 1 >= 30 for a, b in combinations(found, 2))


def micro_series(buckets: np.ndarray, ftp: float, curve: dict[int, float]) -> list[list[Block]]:
    """Series of four or more short efforts with rests of like length, hard for their length and even."""
    series: list[list[Block]] = []
    for b in blocks(buckets, ftp * 1.12, 15, 90, bridged=False):
        a = series[-1][-1] if series else None
        rest = b.start - a.end if a else 0
        if a and 15 <= rest <= 60 and _alike(a.duration, b.duration) >= 0.5 and 0.5 <= rest / ((a.duration + b.duration) / 2) <= 2:
            series[-1].append(b)
        else:
            series.append([b])

    def counts(s: list[Block]) -> bool:
        if len(s) < 4:
            return False
        work, rests = [b.duration for b in s], [b.start - a.end for a, b in pairwise(s)]
        watts = [b.power for b in s]
        hard = expected_power(curve, sum(work) / len(s))
        return sum(work) >= 120 and _alike(min(work), max(work)) >= 0.5 and _alike(min(watts), max(watts)) >= 0.65 and _alike(min(rests), max(rests)) >= 0.5 and hard > 0 and sum(watts) / len(s) / hard >= 0.62

    return [s for s in series if counts(s)]


def classify(f: dict, ftp: float | None, curve: dict[int, float], model_confidence: float) -> dict:
    """Profile, tag mask, structure, dose and confidence; `unknown` without a model or with hardly any power."""
    if not f or f["positive_seconds"] < 30 or not ftp or not ftp > 0:
        return {"profile": "unknown", "tags": 0, "structure": "unknown", "dose": "unknown", "confidence": 0}
    b = f["buckets"]

    def hard(found: list[Block], share: float) -> list[Block]:
        return [x for x in found if (e := expected_power(curve, x.duration)) > 0 and x.power / e >= share]

    micro = micro_series(b, ftp, curve)
    long_hard = blocks(b, ftp * 1.08, 120, 600)
    vo2 = hard(long_hard, 0.92)
    if not repeated(vo2):
        vo2 = [x for x in hard(long_hard, 0.97) if x.duration >= 240]
    anaerobic = [x for x in hard(blocks(b, ftp * 1.3, 15, 119), 0.9) if not any(x.start < s[-1].end and s[0].start < x.end for s in micro)]
    threshold = hard(blocks(b, ftp * 0.91, 480, 1800), 0.78)
    total = lambda found: sum(x.duration for x in found)
    within = lambda lo, hi: int(((b >= lo * ftp) & (b < hi * ftp)).sum()) * BUCKET
    tempo, endurance, high = within(0.76, 0.91), within(0.6, 0.76), within(1.08, np.inf)
    factor = f["normalized_power"] / ftp
    many = (sum(map(len, micro)) >= 8 and sum(map(total, micro)) >= 180) or any(len(s) >= 6 and total(s) >= 180 for s in micro)
    is_vo2, is_anaerobic, is_threshold = many or total(vo2) >= 240, total(anaerobic) >= 60 and high >= 90, total(threshold) >= 480
    if is_vo2:
        profile, main = "vo2max", [x for s in micro for x in s] if many else vo2
    elif is_anaerobic:
        profile, main = "anaerobic", anaerobic
    elif is_threshold:
        profile, main = "threshold", threshold
    else:
        profile, main = "tempo" if tempo >= 900 or factor >= 0.8 else "recovery" if factor < 0.6 and high < 60 else "endurance", []
    found = {profile} | {n for n, yes in (("vo2max", is_vo2), ("anaerobic", is_anaerobic), ("threshold", is_threshold), ("tempo", tempo >= 600), ("endurance", endurance >= 1800)) if yes}
    load = f["seconds"] / 3600 * factor * factor * 100
    dose = "high" if load >= 110 else "moderate" if load >= 50 or (profile == "vo2max" and total(vo2) >= 360) or (profile == "anaerobic" and total(anaerobic) >= 120) else "low"
    return {
        "profile": profile,
        "tags": sum(1 << TAGS.index(n) for n in found),
        "structure": "intervals" if repeated(main) else "variable" if f["variability"] >= 1.1 or f["variation"] >= 0.55 else "steady",
        "dose": dose,
        "confidence": int(half_up(min(100.0, model_confidence) * 0.65 + min(100.0, float(half_up(f["coverage"] * 100))) * 0.35)),
        "vo2_blocks": len(vo2),
        "micro_series": len(micro),
        "micro_repetitions": sum(map(len, micro)),
        "anaerobic_blocks": len(anaerobic),
    }


def feature_table(samples: DataFrame, by: str = "workout_id") -> DataFrame:
    """A row a series: figures, buckets and the best power of each effort length."""
    kind = samples.schema[by].dataType.simpleString()
    names = [f"best_{d}" for d in EFFORTS]
    schema = f"{by} {kind}, seconds long, positive_seconds long, coverage double, average_power double, normalized_power double, variability double, variation double, buckets array<double>, " + ", ".join(f"{n} double" for n in names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = features(pdf.sort_values("idx", kind="stable")["power"].to_numpy(float))
        best = [f["efforts"][d][0][1] if f["efforts"][d] else None for d in EFFORTS]
        row = [pdf[by].iloc[0], *[f[k] for k in ("seconds", "positive_seconds", "coverage", "average_power", "normalized_power", "variability", "variation")], f["buckets"].tolist(), *best]
        return pd.DataFrame([row], columns=[c.split()[0] for c in schema.split(", ")])

    return samples.select(by, "idx", "power").groupBy(by).applyInPandas(run, schema)


def classified(rows: DataFrame) -> DataFrame:
    """`rows` of feature_table with the athlete's model (ftp, model_confidence, curve map<int,double>) and their classes."""

    @F.pandas_udf("struct<profile:string,tags:int,structure:string,dose:string,confidence:int>")
    def judge(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in f.to_dict("records"):
            r["buckets"] = np.asarray(r["buckets"], float)
            ftp = r["ftp"] if r["ftp"] == r["ftp"] else None
            c = classify(r, ftp, dict(r["curve"] or {}), r["model_confidence"] or 0)
            out.append([c[k] for k in ("profile", "tags", "structure", "dose", "confidence")])
        return pd.DataFrame(out, columns=["profile", "tags", "structure", "dose", "confidence"])

    used = F.struct("seconds", "positive_seconds", "coverage", "normalized_power", "variability", "variation", "buckets", "ftp", "model_confidence", "curve")
    return rows.withColumn("_c", judge(used)).select("*", "_c.*").drop("_c")
