"""Scalar expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CANDLE = ("range_pct", "body_pct", "upper_wick_pct", "lower_wick_pct", "close_location")
CALENDAR = ("time_of_day_sin", "time_of_day_cos", "day_of_week_sin", "day_of_week_cos")
SAMPLE_PREFIX = "btc-usdt-index-30m-"


def div(a: Column, b: Column) -> Column:
    """Division that gives null instead of an error or an infinity."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def log_price(c: Column) -> Column:
    return F.ln(c)


def true_range(high: Column, low: Column, previous_close: Column) -> Column:
    """Null without a previous close: greatest() alone would skip the nulls."""
    full = F.greatest(high - low, F.abs(high - previous_close), F.abs(low - previous_close))
    return F.when(previous_close.isNotNull(), full)


def candle(prefix: str = "") -> dict[str, Column]:
    """Shape of one bar, relative to its own prices."""
    o, h, low, c = (F.col(p) for p in ("open", "high", "low", "close"))
    size = h - low
    return {
        f"{prefix}range_pct": div(size, c),
        f"{prefix}body_pct": div(c - o, o),
        f"{prefix}upper_wick_pct": div(h - F.greatest(o, c), c),
        f"{prefix}lower_wick_pct": div(F.least(o, c) - low, c),
        f"{prefix}close_location": F.when(size > 1e-12, div(c - low, size)).otherwise(F.lit(0.5)),
    }


def calendar(t: Column, prefix: str = "") -> dict[str, Column]:
    """Sine and cosine of the minute of the day and of the day of the week (Monday 0)."""
    day = (F.hour(t) * 60 + F.minute(t)) * F.lit(2 * math.pi) / 1440
    week = F.weekday(t) * F.lit(2 * math.pi) / 7
    return {
        f"{prefix}time_of_day_sin": F.sin(day), f"{prefix}time_of_day_cos": F.cos(day),
        f"{prefix}day_of_week_sin": F.sin(week), f"{prefix}day_of_week_cos": F.cos(week),
    }


def sample_id(t: Column) -> Column:
    return F.concat(F.lit(SAMPLE_PREFIX), F.date_format(t, "yyyyMMdd'T'HHmmssSSSSSS'Z'"))


def iso_z(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def clip_probability(p: Column, edge: float = 1e-15) -> Column:
    return F.greatest(F.least(p, F.lit(1 - edge)), F.lit(edge))


def is_bad(c: Column) -> Column:
    """Null, NaN or infinite."""
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def any_bad(names: list[str]) -> Column:
    """Whether any of the columns is null, NaN or infinite, as one SQL text: plans of hundreds of columns are made in less time."""
    return F.expr(" OR ".join(f"`{n}` IS NULL OR isnan(`{n}`) OR abs(`{n}`) = double('Infinity')" for n in names))


def regime_part(value: Column, ideal: float) -> Column:
    """25 points at zero, falling to none at the ideal limit."""
    ratio = F.abs(value) / F.lit(ideal) if ideal > 0 else F.when(value.isNotNull(), F.lit(10.0))
    raw = 25 * (1 - ratio)
    return F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(0.0)), F.lit(25.0)))


def to_tick(value: Column, tick: float) -> Column:
    return F.round(value / F.lit(tick)) * F.lit(tick)


def round_trip_cost(price: Column, commission_bps: float, slippage_ticks: float = 0.0, tick: float = 0.0) -> Column:
    return price * F.lit(2 * commission_bps / 10000) + F.lit(2 * slippage_ticks * tick)


def mode_name(c: Column) -> Column:
    return F.when(c == 2, "Shock").when(c == 1, "Range")


def direction_name(c: Column) -> Column:
    return F.when(c > 0, "Long").when(c < 0, "Short")


def message(prefix: str, **parts: Column) -> Column:
    """A line of the form prefix, then name=value parts, between pipes; null values are left out."""
    return F.concat_ws("|", F.lit(prefix), *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in parts.items()])
