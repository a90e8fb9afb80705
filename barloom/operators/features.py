"""Rolling price features of one resolution.

A feature set is data: lags, windows and flags. Every expression of one window length uses the
same frame, so Spark evaluates all of a length in one window operator over one sort. A rolling
value exists only when its frame is full; Spark itself would give values for partial frames.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import CALENDAR, CANDLE, any_bad, calendar, candle, div, log_price, true_range
from .ordinal import BLOCK_ROWS, in_blocks

FLAT_STD, FLAT_PATH = 1e-12, 1e-15


@dataclass(frozen=True)
class FeatureSet:
    prefix: str
    returns: tuple[int, ...]
    volatility: tuple[int, ...]
    sma_gaps: tuple[tuple[int, int], ...]
    zscores: tuple[int, ...]
    ranges: tuple[int, ...]
    atr: tuple[int, ...]
    max_lag: int
    path: int = 0

    def names(self) -> list[str]:
        p, n = self.prefix, self.path
        out = [f"{p}ret_{k}" for k in self.returns] + [f"{p}vol_{k}" for k in self.volatility]
        out += [f"{p}sma_gap_{a}_{b}" for a, b in self.sma_gaps] + [f"{p}zscore_{k}" for k in self.zscores]
        out += [f"{p}{name}" for name in CANDLE] + [f"{p}rolling_high_distance_{k}" for k in self.ranges] + [f"{p}rolling_low_distance_{k}" for k in self.ranges]
        out += [f"{p}atr_pct_{k}" for k in self.atr]
        if n:
            out += [f"{p}{name}_{n}" for name in ("up_ratio", "sign_change_rate", "abs_return_sum", "max_return", "min_return", "path_efficiency", "high_recency", "low_recency")]
        return out + [f"{p}{name}" for name in CALENDAR]


def _sets() -> tuple[FeatureSet, FeatureSet]:
    coarse = FeatureSet(
        prefix="", returns=(1, 2, 4, 8, 16, 48), volatility=(4, 8, 16, 48), sma_gaps=((4, 16), (8, 48)),
        zscores=(8, 16, 48), ranges=(8, 16, 48), atr=(4, 8, 16, 48), max_lag=48,
    )
    fine = FeatureSet(
        prefix="f5_", returns=(1, 3, 6, 12, 24, 48, 144, 288), volatility=(6, 12, 24, 48, 288), sma_gaps=((6, 24), (12, 48), (48, 288)),
        zscores=(6, 24, 48, 288), ranges=(6, 24, 48, 288), atr=(6, 24, 48, 288), max_lag=288, path=6,
    )
    return coarse, fine


def coarse_set() -> FeatureSet:
    return _sets()[0]


def fine_set() -> FeatureSet:
    return _sets()[1]


class Rolling:
    """Full-frame aggregates over the last k rows of a series."""

    def __init__(self, by: tuple[str, ...], time: str = "open_time"):
        self.w = Window.partitionBy(*by).orderBy(time)

    def frame(self, k: int):
        return self.w.rowsBetween(-(k - 1), 0)

    def of(self, aggregate: Callable[[Column], Column], value: Column, k: int) -> Column:
        f = self.frame(k)
        return F.when(F.count(value).over(f) == k, aggregate(value).over(f))

    def lag(self, value: Column, k: int = 1) -> Column:
        return F.lag(value, k).over(self.w)


def _basics(bars: DataFrame, by: tuple[str, ...], minutes: int) -> DataFrame:
    roll = Rolling(by)
    lc, epoch = log_price(F.col("close")), F.unix_timestamp(F.col("open_time").cast("timestamp"))
    rows = bars.withColumns({"lc": lc, "prev_close": roll.lag(F.col("close")), "prev_epoch": roll.lag(epoch), "epoch": epoch})
    if "row" not in rows.columns:
        rows = rows.withColumn("row", F.row_number().over(roll.w).cast("long") - 1)
    prev = log_price(F.col("prev_close"))
    return rows.withColumns({
        "r1": F.col("lc") - prev,
        "tr": true_range(F.col("high"), F.col("low"), F.col("prev_close")),
        "step_ok": F.coalesce((F.col("epoch") - F.col("prev_epoch")) == minutes * 60, F.lit(False)).cast("int"),
    })


def _values(spec: FeatureSet, by: tuple[str, ...]) -> dict[str, Column]:
    p, roll, c = spec.prefix, Rolling(by), F.col("close")
    r1 = F.col("r1")
    mean = {k: roll.of(F.avg, c, k) for k in {k for pair in spec.sma_gaps for k in pair} | set(spec.zscores)}
    out: dict[str, Column] = {f"{p}ret_{k}": F.col("lc") - roll.lag(F.col("lc"), k) for k in spec.returns}
    out |= {f"{p}vol_{k}": roll.of(F.stddev_pop, r1, k) for k in spec.volatility}
    out |= {f"{p}sma_gap_{a}_{b}": div(mean[a], mean[b]) - 1 for a, b in spec.sma_gaps}
    for k in spec.zscores:
        sd = roll.of(F.stddev_pop, c, k)
        out[f"{p}zscore_{k}"] = F.when(sd > FLAT_STD, div(c - mean[k], sd)).when(sd.isNotNull(), F.lit(0.0))
    out |= candle(p)
    out |= {f"{p}rolling_high_distance_{k}": div(c, roll.of(F.max, F.col("high"), k)) - 1 for k in spec.ranges}
    out |= {f"{p}rolling_low_distance_{k}": div(c, roll.of(F.min, F.col("low"), k)) - 1 for k in spec.ranges}
    out |= {f"{p}atr_pct_{k}": div(roll.of(F.avg, F.col("tr"), k), c) for k in spec.atr}
    return out | (_path(spec, roll) if spec.path else {}) | calendar(F.col("close_time"), p)


def _path(spec: FeatureSet, roll: Rolling) -> dict[str, Column]:
    """The last few bars' path. Missing returns of the first rows count as the published features count them."""
    p, n, r1 = spec.prefix, spec.path, F.col("r1")
    up = F.coalesce(r1 > 0, F.lit(False)).cast("double")
    size = roll.of(F.sum, F.abs(r1), n)
    total = roll.of(F.sum, r1, n)

    def recency(price: str, extreme: Callable[[Column], Column]) -> Column:
        seen = F.collect_list(price).over(roll.frame(n))
        first = F.array_position(seen, extreme(seen)).cast("double") - 1
        return F.when(F.size(seen) == n, first / (n - 1))

    return {
        f"{p}up_ratio_{n}": roll.of(F.avg, up, n),
        f"{p}sign_change_rate_{n}": roll.of(F.sum, F.col("turn"), n - 1) / (n - 1),
        f"{p}abs_return_sum_{n}": size,
        f"{p}max_return_{n}": roll.of(F.max, r1, n),
        f"{p}min_return_{n}": roll.of(F.min, r1, n),
        f"{p}path_efficiency_{n}": F.coalesce(F.when(size > FLAT_PATH, F.abs(total) / size), F.lit(0.0)),
        f"{p}high_recency_{n}": recency("high", F.array_max),
        f"{p}low_recency_{n}": recency("low", F.array_min),
    }


def build(bars: DataFrame, spec: FeatureSet, minutes: int, keys: tuple[str, ...] = ("symbol",), block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    """``keys, prediction_time``, all features, ``feature_valid``, ``feature_invalid_reason``.

    Values are by row and exist on invalid rows too. A row is valid with ``max_lag`` rows before
    it, all one interval apart, and only finite values. A long series is computed in blocks of
    ``block_rows`` rows by many tasks; without any, one task computes a series, with the same result.
    """
    def compute(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
        basic = _basics(rows, by, minutes)
        if spec.path:
            sign, before = F.signum("r1"), F.signum(F.lag("r1").over(Window.partitionBy(*by).orderBy("open_time")))
            turned = (sign != before) & (sign != 0) & (before != 0)
            basic = basic.withColumn("turn", F.when(F.col("row") <= 1, 1.0).otherwise(F.coalesce(turned.cast("double"), F.lit(1.0))))
        run = F.sum("step_ok").over(Rolling(by).frame(spec.max_lag))
        return basic.select(*by, "row", F.col("close_time").alias("prediction_time"), run.alias("run"), *[v.alias(k) for k, v in _values(spec, by).items()])

    if block_rows:
        # A blocked frame must not look full where the series itself has fewer rows: rows before the
        # block come along, so a frame is cut short only at the start of the series.
        rows = in_blocks(bars, keys, spec.max_lag + 2, block_rows, compute)
    else:
        rows = compute(bars, keys)
    bad = any_bad(spec.names())
    reason = (
        F.when(F.col("row") < spec.max_lag, "insufficient_history").when(F.col("run") != spec.max_lag, "non_contiguous_history").when(bad, "non_finite_feature")
    )
    out = rows.withColumn("feature_invalid_reason", reason).withColumn("feature_valid", F.col("feature_invalid_reason").isNull())
    return out.select(*keys, "prediction_time", *spec.names(), "feature_valid", "feature_invalid_reason")


def align(features: DataFrame, times: DataFrame, names: list[str], keys: tuple[str, ...] = ("symbol",), ordinal: str | None = None) -> DataFrame:
    """The features at exactly the requested times; a miss keeps its row with nulls and its own reason.

    Of repeated times one row counts: the first by ``ordinal``, a column with the order of the input.
    Without one it is a valid row first, then the one with the smallest values in the columns' order,
    so that the choice doesn't depend on how rows are dealt.
    """
    order = [F.col(ordinal)] if ordinal else [F.desc("feature_valid"), *names]
    first = Window.partitionBy(*keys, "prediction_time").orderBy(*order)
    one = features.withColumn("__row", F.row_number().over(first)).filter("__row = 1").drop("__row", *([ordinal] if ordinal else [])).withColumn("__found", F.lit(True))
    joined = times.select(*keys, "prediction_time").join(one, [*keys, "prediction_time"], "left")
    found = F.coalesce("__found", F.lit(False))
    return joined.select(
        *keys, "prediction_time", *names, F.coalesce("feature_valid", F.lit(False)).alias("feature_valid"),
        F.when(found, F.col("feature_invalid_reason")).otherwise("alignment_invalid").alias("feature_invalid_reason"), found.alias("alignment_valid"),
    )
