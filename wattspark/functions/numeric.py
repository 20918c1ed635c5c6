"""Rounding, training-load formulas and power models as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the domain.
FTP_DURATIONS = (360, 480, 720, 900, 960)
ZONE_LIMITS = (55, 75, 90, 105, 120, 150)
BEST_EFFORT_DURATIONS = (5, 15, 60, 120, 240, 360, 480, 720, 900, 960, 1800)
LOG_SPAN = (math.log(1200) - math.log(480)) / (math.log(900) - math.log(480))
FTP_SHARE = 0.95


def half_up(x: Column) -> Column:
    """Rounds halves upwards, also below zero: -2.5 becomes -2."""
    return F.floor(x + 0.5).cast("double")


def half_up_to(x: Column, digits: int) -> Column:
    return half_up(x * 10**digits) / 10**digits


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def two_point_ftp(cp8: Column, cp15: Column) -> Column:
    """FTP from the best 8 and 15 minutes, carried on along the logarithm of time to 20 minutes."""
    return (cp8 + F.lit(LOG_SPAN) * (cp15 - cp8)) * F.lit(FTP_SHARE)


def fallback_ftp(cp8: Column, cp15: Column, cp20: Column) -> Column:
    """The two-point estimate, or what single efforts allow."""
    return F.coalesce(F.when((cp8 > 0) & (cp15 > 0), two_point_ftp(cp8, cp15)), F.when(cp20 > 0, cp20 * 0.95), F.when(cp15 > 0, cp15 * 0.9), F.when(cp8 > 0, cp8 * 0.82))


def zone(watts: Column, ftp: Column) -> Column:
    """1 to 7 by percent of FTP, upper limits included."""
    share = watts / ftp * 100
    out = F.lit(7)
    for i in reversed(range(len(ZONE_LIMITS))):
        out = F.when(share <= ZONE_LIMITS[i], i + 1).otherwise(out)
    return out


def intensity_factor(power: Column, ftp: Column) -> Column:
    return F.when((ftp > 0) & (power > 0), power / ftp)


def stress_score(seconds: Column, power: Column, ftp: Column) -> Column:
    """Training stress; 0 where time, power or FTP is missing."""
    return F.coalesce(F.when((ftp > 0) & (power > 0) & (seconds > 0), half_up(seconds * power * (power / ftp) / (ftp * 3600) * 100)), F.lit(0.0))


def calories(recorded: Column, power: Column, seconds: Column) -> Column:
    """The recorded energy if there is any, else the work done in kJ."""
    return F.when(recorded > 0, half_up(recorded)).when((power > 0) & (seconds > 0), half_up(power * seconds / 1000)).otherwise(F.lit(0.0))


def power_load(seconds: Column, power: Column) -> Column:
    """100 an hour at 200 W, with the square of power."""
    return F.when((seconds > 0) & (power > 0), half_up(seconds / 3600 * (power / 200) * (power / 200) * 100)).otherwise(F.lit(0.0))


def segment_speed(metres: Column, seconds: Column) -> Column:
    """km/h to one digit; null without length or time."""
    return F.when((metres > 0) & (seconds > 0), half_up_to(metres * 3.6 / seconds, 1))


def lerp(a: Column, b: Column, share: Column) -> Column:
    """Between a and b; the other one where one is missing."""
    return F.coalesce(a + (b - a) * share, a, b)


def tag_mask(tags: Column, names: tuple[str, ...]) -> Column:
    """Bits for the known tags of an array, in the order of `names`."""
    out = F.lit(0)
    for i, name in enumerate(names):
        out = out + F.when(F.array_contains(tags, name), F.lit(1 << i)).otherwise(F.lit(0))
    return out


def tags_of(mask: Column, names: tuple[str, ...], first: Column | None = None) -> Column:
    """The tags of a mask, the primary one first."""
    each = F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names)]))
    if first is None:
        return each
    return F.when(F.array_contains(each, first), F.concat(F.array(first), F.array_remove(each, first))).otherwise(each)


def decimal_round(x: Column, places: int, scale: int = 6) -> Column:
    """Rounds an exact decimal of `scale` places, halves away from zero."""
    return F.round(x.cast(f"decimal(24,{scale})"), places).cast("double")


def fixed(x: Column, places: int, scale: int = 6) -> Column:
    """The number as text with so many places."""
    return F.round(x.cast(f"decimal(24,{scale})"), places).cast(f"decimal(24,{places})").cast("string")


def rounded(x: Column, digits: int) -> Column:
    """`F.round` of doubles, which goes through their decimal digits, only for values near a tie, below zero, large or no numbers."""
    up = x * 10**digits + 0.5
    plain = x.between(0.0, 1e9 / 10**digits) & (F.abs(up - F.rint(up)) > 1e-5)
    return F.when(plain, F.floor(up) / 10**digits).otherwise(F.round(x, digits))
