"""Series that the signal engine decides on.

Built-ins that the published scripts leave to their platform are fixed here: EMA with
alpha 2 / (n + 1) from the first value, ATR by Wilder's average from the first high - low,
population deviations, Pearson correlation. Windows that are not full give null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import div, regime_part
from ..params import SignalParams
from .bars import bucket, resample
from .features import Rolling
from .ordinal import neighbours
from .recursion import ema_alpha, recursive_averages, wilder_alpha


def with_averages(bars: DataFrame, mean_len: int, atr_len: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Adds ``mean`` and ``atr``."""
    before, spread = F.col("__before"), F.col("high") - F.col("low")
    tr = F.greatest(spread, F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    rows = neighbours(bars, {"__before": F.col("close")}, keys, ahead=False).withColumn("tr", F.coalesce(tr, spread)).drop("__before")
    return recursive_averages(rows, {"mean": ("close", ema_alpha(mean_len)), "atr": ("tr", wilder_alpha(atr_len))}, keys)


def efficiency_ratio(roll: Rolling, length: int) -> Column:
    """Net move over the path of the last bars; 0 without any path."""
    close = F.col("close")
    path = roll.of(F.avg, F.col("abs_move"), length) * length
    return F.when(path > 0, div(F.abs(close - roll.lag(close, length)), path)).when(path.isNotNull(), F.lit(0.0))


def _with_move(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    roll = Rolling(by)
    return rows.withColumns({"prev_close": roll.lag(F.col("close")), "abs_move": F.abs(F.col("close") - roll.lag(F.col("close")))})


def slope(roll: Rolling, lookback: int, tick: float) -> Column:
    return div(F.col("mean") - roll.lag(F.col("mean"), lookback), F.greatest(F.col("atr"), F.lit(tick))) / lookback


def higher_timeframe(bars: DataFrame, minutes: int, params: SignalParams, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Slope and efficiency of the last confirmed higher bar, by the open of the bar being formed."""
    rows = _with_move(with_averages(resample(bars, minutes, keys), params.htf_mean_len, params.atr_len, keys), keys)
    roll = Rolling(keys)
    valued = rows.withColumns({"s": slope(roll, params.htf_slope_lookback, params.tick), "e": efficiency_ratio(roll, params.htf_er_len)})
    return valued.select(*keys, F.col("open_time").alias("htf_open"), roll.lag(F.col("s")).alias("htf_slope"), roll.lag(F.col("e")).alias("htf_er"))


def indicators(bars: DataFrame, htf_minutes: int, params: SignalParams = SignalParams(), keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars with everything the signal engine reads, and ``bar_index`` from 0."""
    p, roll = params, Rolling(keys)
    rows = _with_move(with_averages(bars, p.mean_len, p.atr_len, keys), keys)
    kind = dict(bars.dtypes)["open_time"]
    rows = rows.withColumns({
        "bar_index": F.row_number().over(roll.w).cast("long") - 1,
        "safe_atr": F.greatest(F.col("atr"), F.lit(p.tick)), "residual": F.col("close") - F.col("mean"),
        "local_slope": slope(roll, p.local_slope_lookback, p.tick), "local_er": efficiency_ratio(roll, p.local_er_len),
        "htf_open": bucket(F.col("open_time"), htf_minutes).cast(kind),
    })
    rows = rows.join(higher_timeframe(bars, htf_minutes, p, keys), [*keys, "htf_open"], "left")
    lag = roll.lag
    sd = F.greatest(F.coalesce(roll.of(F.stddev_pop, F.col("residual"), p.z_len), F.lit(0.0)), F.lit(p.tick))
    rows = rows.withColumns({"std": sd, "residual_lag": lag(F.col("residual"))})
    rows = rows.withColumns({"z": F.col("residual") / F.col("std"), "residual_delta": F.col("residual") - F.col("residual_lag")})
    score = sum((regime_part(F.col(c), ideal) for c, ideal in (("htf_er", p.ideal_htf_er), ("local_slope", p.ideal_local_slope), ("local_er", p.ideal_local_er))), regime_part(F.col("htf_slope"), p.ideal_htf_slope))
    n = p.half_life_lookback
    frame = roll.frame(n)
    full = F.count("residual_delta").over(frame) == n
    spread = F.stddev_pop("residual_lag").over(frame)
    flat = (F.stddev_pop("residual_delta").over(frame) == 0) | (spread == 0)
    beta = F.when(full & ~flat, F.regr_slope("residual_delta", "residual_lag").over(frame))
    move = (F.col("close") - lag(F.col("close"), p.shock_lookback)) / F.col("safe_atr")
    earlier = (lag(F.col("close"), p.shock_lookback) - lag(F.col("close"), 2 * p.shock_lookback)) / F.col("safe_atr")
    size = F.greatest(F.col("high") - F.col("low"), F.lit(p.tick))
    rows = rows.withColumns({
        "raw_score": score, "half_life": F.when(beta < -1e-6, -math.log(2.0) / beta), "shock_move": move, "previous_shock_move": earlier,
        "prev_z": lag(F.col("z")), "lower_wick": (F.least("open", "close") - F.col("low")) / size, "upper_wick": (F.col("high") - F.greatest("open", "close")) / size,
    })
    rows = rows.withColumn("regime_score", roll.of(F.avg, F.col("raw_score"), p.regime_smooth_len))
    yes = lambda c: F.coalesce(c, F.lit(False))
    veto = (
        yes(F.abs("htf_slope") >= p.veto_htf_slope) | yes(F.abs("local_slope") >= p.veto_local_slope)
        | yes(F.col("htf_er") >= p.veto_htf_er) | yes(F.col("local_er") >= p.veto_local_er)
    )
    slowing = yes(F.abs("shock_move") <= F.abs("previous_shock_move") * p.deceleration_ratio)
    return rows.withColumns({
        "veto": veto, "range_env": ~veto & yes(F.col("regime_score") >= p.range_min_score), "shock_env": ~veto & yes(F.col("regime_score") >= p.shock_min_score),
        "shock_up": yes(F.col("shock_move") >= p.min_shock_atr), "shock_down": yes(F.col("shock_move") <= -p.min_shock_atr),
        "slowing": slowing if p.require_deceleration else F.lit(True),
        "long_rejection": ((F.col("close") > F.col("open")) | (F.col("lower_wick") >= p.min_wick_ratio)) if p.require_rejection else F.lit(True),
        "short_rejection": ((F.col("close") < F.col("open")) | (F.col("upper_wick") >= p.min_wick_ratio)) if p.require_rejection else F.lit(True),
    })


def bands(rows: DataFrame, params: SignalParams = SignalParams()) -> DataFrame:
    out = {}
    for name, z in (("range", params.range_entry_z), ("shock", params.shock_entry_z), ("stop", params.stop_z)):
        out[f"upper_{name}_band"] = F.col("mean") + z * F.col("std")
        out[f"lower_{name}_band"] = F.col("mean") - z * F.col("std")
    return rows.withColumns(out)


def crossings(rows: DataFrame, params: SignalParams = SignalParams()) -> DataFrame:
    """Crossings of z over the negative and under the positive entry levels."""
    over = lambda level: F.coalesce((F.col("z") > level) & (F.col("prev_z") <= level), F.lit(False))
    under = lambda level: F.coalesce((F.col("z") < level) & (F.col("prev_z") >= level), F.lit(False))
    return rows.withColumns({
        "over_range": over(-params.range_entry_z), "under_range": under(params.range_entry_z),
        "over_shock": over(-params.shock_entry_z), "under_shock": under(params.shock_entry_z),
    })


def confirmations(rows: DataFrame, params: SignalParams = SignalParams()) -> DataFrame:
    """Whether a bar confirms an entry, by mode and direction: ``long_range, short_range, long_shock, short_shock``.

    The score has come back over the entry level, the close lies inside the band again, and the bar
    moved in the entry's direction; the last two only where the parameters ask for them. The first bar of a series confirms nothing.
    """
    out = {}
    crossed = crossings(rows, params)
    close, mean, std, before = (F.col(c) for c in ("close", "mean", "std", "prev_close"))
    for mode, level in (("range", params.range_entry_z), ("shock", params.shock_entry_z)):
        for side, hit, inside, turned in (
            ("long", f"over_{mode}", close > mean - level * std, close > before), ("short", f"under_{mode}", close < mean + level * std, close < before),
        ):
            wanted = F.col(hit) & (inside if params.require_band else F.lit(True)) & (turned if params.require_candle else F.lit(True))
            out[f"{side}_{mode}"] = F.coalesce(wanted, F.lit(False))
    return crossed.withColumns(out)


def shock_funnel(rows: DataFrame, params: SignalParams = SignalParams(), keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """How many long and short shock candidates pass each filter in turn."""
    p = params
    long = [F.lit(p.allow_long) & (F.col("z") <= -p.shock_entry_z), F.col("shock_down"), F.col("shock_env"), F.col("slowing"), F.col("long_rejection")]
    short = [F.lit(p.allow_short) & (F.col("z") >= p.shock_entry_z), F.col("shock_up"), F.col("shock_env"), F.col("slowing"), F.col("short_rejection")]
    counts, a, b = [], F.lit(True), F.lit(True)
    for name, x, y in zip(("z", "move", "environment", "deceleration", "rejection"), long, short, strict=True):
        a, b = a & x, b & y
        counts.append((F.count_if(a) + F.count_if(b)).alias(f"{name}_pass"))
    return rows.groupBy(*keys).agg(*counts)
