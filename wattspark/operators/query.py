"""Filter and sort descriptors compiled to columns, with paging."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {"=": lambda c, v: c == v, ">": lambda c, v: c > v, "<": lambda c, v: c < v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v}
#: Names that a search may use for a column.
# Fixed values.
ALIASES = {
    "id": "id",
    "date": "start_time",
    "start": "start_time",
    "uploaded": "uploaded_at",
    "distance": "total_distance",
    "duration": "total_timer_time",
    "alt": "total_ascent",
    "altitude": "total_ascent",
    "ascent": "total_ascent",
    "power": "avg_power",
    "hr": "avg_heart_rate",
    "heartrate": "avg_heart_rate",
    "np": "avg_normalized_power",
    "cadence": "avg_cadence",
    "cad": "avg_cadence",
    "speed": "avg_speed",
    "type": "workout_type",
    "workout": "workout_type",
}
_SCOPED_NUMBER = re.compile(r"^\s*(\w+)\s*(<=|>=|=|<|>)\s*(-?\d+(?:\.\d+)?)\s*$")
_SCOPED_TEXT = re.compile(r"^\s*(\w+)\s*:\s*(.+?)\s*$")


def _number(value) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def _contains(column: Column, value: str) -> Column:
    """Substring match without case; % and _ in the value keep their meaning."""
    return column.cast("string").ilike(f"%{value}%")


def search(value: str, text: Iterable[str], numeric: Iterable[str], allowed: Iterable[str]) -> Column | None:
    """`key >= 3` compares a numeric column, `key: words` searches one column, anything else all of `text`."""
    numeric, allowed = set(numeric), set(allowed)
    if (m := _SCOPED_NUMBER.match(value)) and (column := ALIASES.get(m[1].lower(), m[1].lower())) in numeric:
        return _COMPARE[m[2]](F.col(column), float(m[3]))
    if (m := _SCOPED_TEXT.match(value)) and (column := ALIASES.get(m[1].lower(), m[1].lower())) in allowed:
        return _contains(F.round(F.col(column)).cast("long") if column in numeric else F.col(column), m[2])
    if not value.strip():
        return None
    return reduce(lambda a, b: a | b, [F.coalesce(_contains(F.col(c), value.strip()), F.lit(False)) for c in text])


def predicate(filters: Iterable[Mapping], allowed: Iterable[str], numeric: Iterable[str], text: Iterable[str] = ()) -> Column:
    """All terms of a filter descriptor. Unknown fields are dropped; an unknown operator means equality;
    numeric fields whose value is no number are dropped; bit_any takes masks from 1 to 63."""
    allowed, numeric, terms = list(allowed), set(numeric), []
    for f in filters:
        field, kind, value = f.get("field"), f.get("type", "="), f.get("value")
        if field == "__search":
            if (term := search(str(value), text, numeric, allowed)) is not None:
                terms.append(term)
            continue
        if field not in allowed:
            continue
        column = F.col(field)
        if kind == "bit_any":
            mask = floor(_number(value) or 0)
            if 1 <= mask <= 63:
                terms.append(column.bitwiseAND(F.lit(mask)) != 0)
        elif kind == "like":
            terms.append(_contains(column, str(value)))
        else:
            if field in numeric:
                value = _number(value)
                if value is None:
                    continue
            terms.append(_COMPARE.get(kind, _COMPARE["="])(column, value))
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def order(sorts: Iterable[Mapping], allowed: Iterable[str], nulls_last: Iterable[str] = ("total_calories", "total_work"), ties: Iterable[Column] = ()) -> list[Column]:
    """Sort keys with every null order stated: ascending nulls last, descending nulls first but for `nulls_last`.
    Any direction but `desc` is ascending; with no usable key, by id."""
    allowed, nulls_last, out = set(allowed), set(nulls_last), []
    for s in sorts:
        if s.get("field") not in allowed:
            continue
        c = F.col(s["field"])
        if str(s.get("dir", "")).lower() != "desc":
            out.append(c.asc_nulls_last())
        else:
            out.append(c.desc_nulls_last() if s["field"] in nulls_last else c.desc_nulls_first())
    return (out or [F.col("id").asc_nulls_last()]) + list(ties)


def page(df: DataFrame, keys: list[Column], number: int, size: int, most: int = 100) -> DataFrame:
    """Page `number` (from 1) of the sorted rows; sizes are held between 1 and `most`."""
    size = max(1, min(most, int(size)))
    return df.orderBy(*keys).offset((max(1, int(number)) - 1) * size).limit(size)


def last_page(rows: int, size: int) -> int:
    return max(1, ceil(rows / max(1, size)))


def access(df: DataFrame, me: int, scope: str, shares: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of `df` (id, uid) that a user may see: mine, shared with me through a group, or all of these."""
    through = shares.join(members.filter(F.col("user_id") == me), "group_id", "left_semi").select(F.col("workout_id").alias("id")).distinct()
    if scope == "mine":
        return df.filter(F.col("uid") == me)
    shared = df.filter(F.col("uid") != me).join(through, "id", "left_semi")
    if scope == "shared":
        return shared
    if scope == "all":
        return df.filter(F.col("uid") == me).unionByName(shared)
    raise ValueError(f"unknown scope {scope}")
