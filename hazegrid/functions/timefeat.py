"""Calendar, cyclic, weather and ratio features."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: rush and night hours
RUSH_HOURS = (7, 8, 9, 17, 18, 19)
NIGHT_HOURS = (22, 23, 0, 1, 2, 3, 4, 5)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, for zone-less and zoned timestamps alike (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def weekday(ts: Column) -> Column:
    """Monday = 0."""
    return F.weekday(ts)


def _flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def calendar(ts: Column) -> dict[str, Column]:
    h, d = F.hour(ts), F.weekday(ts)
    return {
        "is_weekend": _flag(d >= 5),
        "is_rush_hour": _flag(h.isin(*RUSH_HOURS)),
        "is_night": _flag(h.isin(*NIGHT_HOURS)),
        "is_morning": _flag(h.between(6, 10)),
        "is_evening": _flag(h.between(17, 21)),
        "is_business_hour": _flag(h.between(8, 17) & (d < 5)),
    }


def wave(name: str, x: Column, period: float) -> dict[str, Column]:
    a = x * (2 * math.pi) / period
    return {f"{name}_sin": F.sin(a), f"{name}_cos": F.cos(a)}


def cyclic(ts: Column) -> dict[str, Column]:
    h = F.hour(ts) + F.minute(ts) / 60.0
    return {**wave("hour", h, 24), **wave("day_of_week", F.weekday(ts), 7), **wave("month", F.month(ts), 12)}


def cyclic_training(ts: Column) -> dict[str, Column]:
    h = F.hour(ts) + F.minute(ts) / 60.0
    return {**wave("hour", h, 24), **wave("day_of_week", F.weekday(ts), 7),
            **wave("day_of_year", F.dayofyear(ts), 365), **wave("week_of_year", F.weekofyear(ts), 52)}


def weather(t: Column, rh: Column, wind_direction: Column) -> dict[str, Column]:
    return {
        "wind_dir_sin": F.sin(F.radians(wind_direction)),
        "wind_dir_cos": F.cos(F.radians(wind_direction)),
        "temp_hum_index": 0.8 * t + rh * t / 500,
        "dew_point": t - (100 - rh) / 5,
    }


def over(n: Column, d: Column) -> Column:
    """``n / d`` where ``d`` is positive, else null."""
    return F.when(d > 0, n / d)


# fixed values: ratio features as (name, numerator, denominator)
RATIOS = (("pm25_pm10_ratio", "pm25", "pm10"), ("pm25_co_ratio", "pm25", "co"), ("no2_co_ratio", "no2", "co"),
          ("pm25_no2_ratio", "pm25", "no2"), ("co_no2_ratio", "co", "no2"), ("pm10_pm25_ratio", "pm10", "pm25"),
          ("pm10_co_ratio", "pm10", "co"), ("no2_o3_ratio", "no2", "o3"))


def ratios(c: dict[str, Column]) -> dict[str, Column]:
    return {name: over(c[a], c[b]) for name, a, b in RATIOS}


def wind_independence(pm: Column, upwind: Column, wind_speed: Column) -> Column:
    return (F.when((pm > 0) & (upwind > 0), F.abs(pm - upwind) / F.greatest(pm, upwind))
            .when(wind_speed < 0.5, 1.0))


def spatial_gradient(pm: Column, neighbour: Column) -> Column:
    return (pm - neighbour) / F.greatest(pm, F.lit(1.0))


def relative_age(ts: Column, now: Column) -> Column:
    s = F.floor(seconds_between(now, ts))
    text = lambda div, u: F.concat(F.lit("il y a "), F.floor(s / div).cast("string"), F.lit(u))
    return (F.when(ts.isNull(), "—").when(s < 60, text(1, "s")).when(s < 3600, text(60, " min"))
            .when(s < 86400, text(3600, " h")).otherwise(text(86400, " j")))


def health(age_min: Column, warn, crit) -> Column:
    return (F.when(age_min.isNull(), "unknown").when(age_min <= warn, "ok").when(age_min <= crit, "warn")
            .otherwise("stale"))


def trend(now: Column, before: Column) -> Column:
    return (F.when(now.isNull() | before.isNull(), F.lit(None).cast("string"))
            .when(now > before * 1.1, "increasing").when(now < before * 0.9, "decreasing").otherwise("stable"))
