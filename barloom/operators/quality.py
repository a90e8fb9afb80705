"""Validation of bars, labels, splits and features, as aggregates and small reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.scalar import is_bad
from ..schemas import BAR_COLUMNS
from .ordinal import neighbours


def ohlc_rules() -> dict[str, Column]:
    """What is wrong with a bar, by rule. A null counts as not finite and breaks no other rule."""
    o, h, low, c = (F.col(p) for p in ("open", "high", "low", "close"))
    any_bad = is_bad(o) | is_bad(h) | is_bad(low) | is_bad(c)
    return {
        "non_finite": any_bad,
        "non_positive": F.least(o, h, low, c) <= 0,
        "high_below_body": h < F.greatest(o, c),
        "low_above_body": low > F.least(o, c),
        "high_below_low": h < low,
        "close_not_after_open": F.col("close_time") <= F.col("open_time"),
    }


def ohlc_violations(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    counts = [F.count_if(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in ohlc_rules().items()]
    return bars.groupBy(*keys).agg(F.count("*").alias("n_rows"), *counts)


def steps(bars: DataFrame, minutes: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Each distinct open time with the one before it and the step in seconds."""
    times = bars.select(*keys, "open_time").distinct()
    rows = neighbours(times, {"previous": F.col("open_time")}, keys, ahead=False)
    epoch = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    return rows.withColumn("step_seconds", epoch("open_time") - epoch("previous"))


def gaps(bars: DataFrame, minutes: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Ranges without bars. They are warnings: real markets pause."""
    size = minutes * 60
    late = steps(bars, minutes, keys).filter(F.col("step_seconds") > size)
    return late.select(
        *keys, F.col("previous").alias("gap_from"), (F.col("previous") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes), F.lit(0))).alias("expected_next"),
        F.col("open_time").alias("gap_to"), F.col("step_seconds").alias("duration_seconds"),
        F.greatest(F.floor(F.col("step_seconds") / size) - 1, F.lit(0)).alias("missing_bars"),
    )


def unordered(bars: DataFrame, ordinal: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Rows that do not open after the row before them in the order of ``ordinal``, the order of the input."""
    before = F.lag("open_time").over(Window.partitionBy(*keys).orderBy(ordinal))
    return bars.withColumn("previous", before).filter(F.col("open_time") <= F.col("previous"))


def order_breaks(rows: DataFrame, keys: tuple[str, ...] = ("symbol",), block: int = 1 << 20) -> DataFrame:
    """``keys, n_rows, n_breaks, first_break``: rows that don't open after the row before them of their series, as given.

    ``rows`` have ``file`` and ``row``, their place in the input; ``first_break`` is such a place. A task sorts the rows of
    one block of a file; from block to block one row each goes on.
    """
    place = F.struct("file", "row")
    cut = rows.withColumn("__block", F.floor(F.col("row") / block))
    before = F.lag("open_time").over(Window.partitionBy(*keys, "file", "__block").orderBy("row"))
    marked = cut.withColumn("__wrong", F.coalesce(F.col("open_time") <= before, F.lit(False)))
    blocks = marked.groupBy(*keys, "file", "__block").agg(
        F.count("*").alias("n"), F.count_if("__wrong").alias("wrong"), F.min(F.when(F.col("__wrong"), place)).alias("where"),
        F.min_by("open_time", "row").alias("first"), F.max_by("open_time", "row").alias("last"), F.min("row").alias("row"),
    )
    earlier = F.lag("last").over(Window.partitionBy(*keys).orderBy("file", "__block"))
    blocks = blocks.withColumn("__border", F.coalesce(F.col("first") <= earlier, F.lit(False)))
    border = F.when(F.col("__border"), place)
    return blocks.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), (F.sum("wrong") + F.count_if("__border")).alias("n_breaks"), F.min(F.least(F.col("where"), border)).alias("first_break"))


def month_counts(bars: DataFrame, minutes: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """All that ``preflight`` needs to know of a month of a series, one row each, from one pass over the bars."""
    size, epoch = minutes * 60, lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    dated = bars.withColumn("__month", F.date_trunc("month", "open_time"))
    rows = dated.withColumn("__before", F.lag("open_time").over(Window.partitionBy(*keys, "__month").orderBy("open_time")))
    new = F.col("open_time").isNotNull() & ~F.coalesce(F.col("open_time") == F.col("__before"), F.lit(False))
    step = F.when(new, epoch("open_time") - epoch("__before"))
    return rows.groupBy(*keys, "__month").agg(
        F.count("*").alias("n_rows"), F.count_if(new).alias("n_times"), F.min("open_time").alias("first_open"), F.max("open_time").alias("last_open"),
        *[F.count_if(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in ohlc_rules().items()],
        F.count_if(step > size).alias("n_gaps"), F.count_if(step != size).alias("n_irregular"),
        F.coalesce(F.sum(F.greatest(F.floor(step / size) - 1, F.lit(0))), F.lit(0)).alias("n_missing"),
    )


def preflight(bars: DataFrame, minutes: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row per series: counts, times, rule violations, gaps, and whether it passes. Gaps only warn.

    A task sorts one month of a series; steps from month to month come from the months' own rows.
    """
    size, epoch = minutes * 60, lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    rules = list(ohlc_rules())
    months = month_counts(bars, minutes, keys)
    earlier = F.max("last_open").over(Window.partitionBy(*keys).orderBy("__month").rowsBetween(Window.unboundedPreceding, -1))
    step = epoch("first_open") - F.unix_timestamp(earlier.cast("timestamp"))
    months = months.withColumn("__step", step)
    out = months.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"), (F.sum("n_rows") - F.sum("n_times")).alias("n_duplicates"), F.min("first_open").alias("first_open"), F.max("last_open").alias("last_open"),
        *[F.sum(name).alias(name) for name in rules],
        (F.sum("n_gaps") + F.count_if(F.col("__step") > size)).alias("n_gaps"), (F.sum("n_irregular") + F.count_if(F.col("__step") != size)).alias("n_irregular"),
        (F.sum("n_missing") + F.coalesce(F.sum(F.greatest(F.floor(F.col("__step") / size) - 1, F.lit(0))), F.lit(0))).alias("n_missing"),
    )
    issues = sum((F.col(name) for name in rules), F.col("n_duplicates"))
    return out.withColumn("passed", issues == 0)


def assert_preflight(bars: DataFrame, minutes: int, keys: tuple[str, ...] = ("symbol",)) -> None:
    failed = preflight(bars, minutes, keys).filter(~F.col("passed")).limit(10).collect()
    if failed:
        raise ValueError("; ".join(str(r.asDict()) for r in failed))


def same_rows(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of either frame that the other lacks, counted with repeats."""
    a, b = a.select(*columns), b.select(*columns)
    left = a.exceptAll(b).agg(F.count("*").alias("only_first"))
    right = b.exceptAll(a).agg(F.count("*").alias("only_second"))
    return left.crossJoin(right).withColumn("equal", (F.col("only_first") == 0) & (F.col("only_second") == 0))


def alignment_contract(coarse: DataFrame, fine: DataFrame, ratio: int, fine_minutes: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Per coarse bar: whether a fine bar closes with it, and whether the ``ratio`` fine bars in it are all there.

    A coarse bar that fails because an expected fine bar does not exist is explained by a gap.
    """
    w = Window.partitionBy(*keys).orderBy("open_time")
    epoch = F.unix_timestamp(F.col("open_time").cast("timestamp"))
    ok = F.coalesce((epoch - F.lag(epoch).over(w)) == fine_minutes * 60, F.lit(False)).cast("int")
    stepped = fine.select(*keys, "open_time", "close_time", ok.alias("ok"))
    run = stepped.withColumn("run", F.sum("ok").over(w.rowsBetween(-(ratio - 2), 0))) if ratio > 1 else stepped.withColumn("run", F.lit(0))
    joined = coarse.select(*keys, F.col("open_time").alias("coarse_open"), "close_time").join(run.select(*keys, "close_time", "run"), [*keys, "close_time"], "left")
    inside = fine.select(*keys, F.col("open_time").alias("fine_open"))
    expected = coarse.select(*keys, F.col("open_time").alias("coarse_open"), F.explode(F.sequence(F.lit(0), F.lit(ratio - 1))).alias("k"))
    expected = expected.withColumn("fine_open", F.col("coarse_open") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("k") * fine_minutes, F.lit(0)))
    there = expected.join(inside, [*keys, "fine_open"], "left_semi").groupBy(*keys, "coarse_open").agg(F.count("*").alias("n_there"))
    out = joined.join(there, [*keys, "coarse_open"], "left")
    aligned = F.col("run").isNotNull() & (F.coalesce("run", F.lit(0)) >= ratio - 1)
    missing = F.coalesce("n_there", F.lit(0)) < ratio
    return out.select(
        *keys, "coarse_open", F.col("run").isNotNull().alias("exact_close"), aligned.alias("aligned"), (~aligned & missing).alias("gap_explained"),
    )




def observed(bars: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same bars, and an observation of whatever reads them next: rows, nulls of each column and violations of each rule.

    A write that happens anyway counts them on its way, so no rule costs a pass of its own.
    """
    seen = Observation(name)
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in BAR_COLUMNS]
    rules = [F.count_if(F.coalesce(rule, F.lit(False))).alias(rule_name) for rule_name, rule in ohlc_rules().items()]
    return bars.observe(seen, F.count("*").alias("n_rows"), *nulls, *rules), seen


def observed_errors(seen: Observation) -> list[str]:
    """What an observation of ``observed`` has counted that may not be."""
    return [f"{name}: {n}" for name, n in seen.get.items() if n and name != "n_rows"]
