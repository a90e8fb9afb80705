"""Bars: from ticks, to a higher timeframe, deduplicated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BAR_COLUMNS, PRICES


def bucket(t: Column, minutes: int) -> Column:
    """Start of the interval that holds a time, counted from the epoch, as a time of the same kind."""
    seconds = F.unix_timestamp(t.cast("timestamp"))
    start = F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(minutes * 60)))
    return start


def after(t: Column, minutes: int) -> Column:
    return t + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes), F.lit(0))


def close_of(open_time: Column, minutes: int) -> Column:
    return after(open_time, minutes) - F.expr("INTERVAL 1 MILLISECOND")


def from_ticks(ticks: DataFrame, minutes: int, price: Column, time: str = "ts", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """OHLC bars of ticks. Partial minima, maxima and first and last prices are combined before the shuffle."""
    rows = ticks.select(*keys, F.col(time).alias("__t"), price.cast("double").alias("__p"))
    kind = dict(rows.dtypes)["__t"]
    rows = rows.withColumn("open_time", bucket(F.col("__t"), minutes).cast(kind))
    bars = rows.groupBy(*keys, "open_time").agg(
        F.min_by("__p", "__t").alias("open"), F.max("__p").alias("high"), F.min("__p").alias("low"), F.max_by("__p", "__t").alias("close"),
    )
    return bars.withColumn("close_time", close_of(F.col("open_time"), minutes))


def resample(bars: DataFrame, minutes: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars of a higher timeframe; one that misses some of its bars is made of those there are."""
    kind = dict(bars.dtypes)["open_time"]
    rows = bars.withColumn("__o", bucket(F.col("open_time"), minutes).cast(kind))
    out = rows.groupBy(*keys, "__o").agg(
        F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"),
    )
    return out.select(*keys, F.col("__o").alias("open_time"), *PRICES, close_of(F.col("__o"), minutes).alias("close_time"))


def conflicts(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Rows and distinct rows per open time, for times that occur more than once."""
    rest = [c for c in BAR_COLUMNS if c != "open_time"]
    grouped = bars.groupBy(*keys, *BAR_COLUMNS).count().groupBy(*keys, "open_time")
    return grouped.agg(F.sum("count").alias("rows"), F.count("*").alias("versions")).filter("rows > 1") if rest else bars


def merge(*parts: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> tuple[DataFrame, int]:
    """Union without repeated bars, and how many were dropped. Unequal bars of one time are an error."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    found = conflicts(union, keys)
    bad = found.filter("versions > 1").orderBy("open_time").limit(10).collect()
    if bad:
        raise ValueError("conflicting bars at " + ", ".join(str(r.open_time) for r in bad))
    dropped = found.agg(F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("n")).first().n
    return union.dropDuplicates([*keys, "open_time"]), int(dropped)


def date_range(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Bars that open from ``start`` to the end of the day ``end``."""
    kind = dict(bars.dtypes)["open_time"]
    return bars.filter((F.col("open_time") >= F.lit(start).cast(kind)) & (F.col("open_time") < after(F.lit(end).cast(kind), 1440)))
