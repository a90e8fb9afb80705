"""Proofs on whole tables that features look back only, and that they notice a missing bar.

Bars are built twice, once as they are and once with later prices changed or one bar left out, and
both tables of features are compared by key. A proof is one row per series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import is_bad
from ..schemas import PRICES

Build = Callable[[DataFrame], DataFrame]
#: By what prices are multiplied; all differ, so any feature of any price moves.
FACTORS = {"open": 2.0, "high": 2.5, "low": 0.5, "close": 2.2}
TOLERANCE = 1e-10


def mutated(bars: DataFrame, after: Column) -> DataFrame:
    """The same bars with other prices in those that open at a time or later."""
    later = F.col("open_time") >= after
    return bars.withColumns({p: F.when(later, F.col(p) * FACTORS[p]).otherwise(F.col(p)) for p in PRICES})


def close_to(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Equal within an absolute and relative tolerance; values that are no number are equal to each other."""
    both = is_bad(a) & is_bad(b)
    return both | F.coalesce(F.abs(a - b) <= tolerance + tolerance * F.abs(b), F.lit(False))


def differences(before: DataFrame, after: DataFrame, names: Sequence[str], on: Sequence[str], flags: Sequence[str] = ("feature_valid", "feature_invalid_reason"), tolerance: float = TOLERANCE) -> DataFrame:
    """``on, side, changed``: the columns in which both tables differ at a key; ``side`` tells keys of one table only.

    Both sides are aggregated into one row a key under their own names, so columns are compared in one shuffle.
    """
    side = lambda df, p: df.select(*on, F.lit(True).alias(f"{p}there"), *[F.col(c).alias(f"{p}{c}") for c in (*names, *flags)])
    rows = side(before, "a_").join(side(after, "b_"), list(on), "full")
    moved = [F.when(~close_to(F.col(f"a_{c}"), F.col(f"b_{c}"), tolerance), F.lit(c)) for c in names]
    moved += [F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in flags]
    both = F.col("a_there").isNotNull() & F.col("b_there").isNotNull()
    return rows.select(
        *on, F.when(both, "both").when(F.col("a_there").isNotNull(), "before").otherwise("after").alias("side"),
        F.when(both, F.filter(F.array(*moved), lambda c: c.isNotNull())).otherwise(F.array().cast("array<string>")).alias("changed"),
        *[F.col(f"{p}{c}") for p in ("a_", "b_") for c in flags],
    )


def mutation_proof(
    build: Callable[..., DataFrame], sources: Sequence[DataFrame], cut: Column, names: Sequence[str], flags: Sequence[str] = ("feature_valid", "feature_invalid_reason"), keys: tuple[str, ...] = ("symbol",),
) -> DataFrame:
    """Whether bars that open at ``cut`` or later leave features known by then alone, and change later ones.

    ``build`` takes the bars of each source. A row is known by ``cut`` if its prediction time is at most that time.
    ``first_leak`` is the first changed row among them, ``leaking`` its columns.
    """
    found = differences(build(*sources), build(*[mutated(s, cut) for s in sources]), names, [*keys, "prediction_time"], flags)
    earlier, changed = F.col("prediction_time") <= cut, (F.size("changed") > 0) | (F.col("side") != "both")
    row = found.groupBy(*keys).agg(
        F.count_if(earlier).alias("n_before"), F.count_if(earlier & changed).alias("n_changed_before"), F.count_if(~earlier).alias("n_after"), F.count_if(~earlier & changed).alias("n_changed_after"),
        F.min(F.when(earlier & changed, F.col("prediction_time"))).alias("first_leak"), F.min_by("changed", F.when(earlier & changed, F.col("prediction_time"))).alias("leaking"),
        F.min(F.when(~earlier & changed, F.col("prediction_time"))).alias("first_changed"),
    )
    return row.withColumn("passed", (F.col("n_changed_before") == 0) & (F.col("n_before") > 0) & ((F.col("n_after") == 0) | (F.col("n_changed_after") > 0)))


def gap_proof(build: Build, bars: DataFrame, dropped: Column, names: Sequence[str], max_lag: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """What leaving out the bars that ``dropped`` picks does to a feature table whose rows look back ``max_lag`` bars.

    ``n_invalidated`` counts rows that were valid and no longer are, ``n_non_contiguous`` those of them
    that say why, ``first_invalid`` and ``last_invalid`` where they begin and end. One dropped bar with a whole
    history on either side invalidates exactly ``max_lag`` rows. Rows before it may not change.
    """
    found = differences(build(bars), build(bars.filter(~dropped)), names, [*keys, "prediction_time"])
    gap = bars.filter(dropped).groupBy(*keys).agg(F.min("close_time").alias("gap_time"), F.count("*").alias("n_dropped"))
    rows = found.join(gap, list(keys))  # a row for each series
    gone = F.col("a_feature_valid") & ~F.col("b_feature_valid") & (F.col("side") == "both")
    early = F.col("prediction_time") < F.col("gap_time")
    out = rows.groupBy(*keys).agg(
        F.max("gap_time").alias("gap_time"), F.max("n_dropped").alias("n_dropped"), F.count_if(F.col("side") == "before").alias("n_missing"), F.count_if(gone).alias("n_invalidated"),
        F.count_if(gone & (F.col("b_feature_invalid_reason") == "non_contiguous_history")).alias("n_non_contiguous"),
        F.min(F.when(gone, F.col("prediction_time"))).alias("first_invalid"), F.max(F.when(gone, F.col("prediction_time"))).alias("last_invalid"),
        F.count_if(early & (F.size("changed") > 0)).alias("n_changed_before"),
    )
    ok = [F.col("n_changed_before") == 0, F.col("n_missing") == F.col("n_dropped"), F.col("n_invalidated") == F.col("n_non_contiguous"), F.col("n_invalidated") <= F.col("n_dropped") * max_lag]
    return out.withColumn("passed", reduce(and_, ok))
