"""Settlement of fixed-horizon events and their ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import div
from ..params import Payout

HORIZONS = (30, 60)


def horizons(entries: DataFrame, minutes: tuple[int, ...] = HORIZONS, time: str = "entry_time") -> DataFrame:
    """One row per entry and horizon, with the time it is due."""
    rows = entries.withColumn("horizon", F.explode(F.array(*map(F.lit, minutes))))
    return rows.withColumn("target_time", F.col(time) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("horizon"), F.lit(0)))


def first_at_or_after(targets: DataFrame, target: str, observations: DataFrame, time: str, value: list[str], keys: tuple[str, ...] = ("symbol",), bucket: str = "day") -> DataFrame:
    """Each target row with the first observation at or after it (nulls if there is none); of those of one time the one of the lowest values.

    Targets and observations of one bucket of time are sorted together; a target after the last
    observation of its bucket takes the first one of the next bucket that has any. So a task holds
    one bucket of one series, however long the series is.
    """
    seen = F.struct(F.col(time).alias("at"), *value)
    obs = observations.select(*keys, F.col(time).alias("__t"), F.date_trunc(bucket, time).alias("__b"), seen.alias("__o"))
    firsts = obs.groupBy(*keys, "__b").agg(F.min("__o").alias("__first"))
    columns = targets.columns
    rows = targets.withColumns({"__t": F.col(target), "__b": F.date_trunc(bucket, target), "__side": F.lit(0)})
    both = rows.unionByName(obs.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    # Backward in time, so that a frame only grows: one that ends at the last row is read anew for every row.
    within = Window.partitionBy(*keys, "__b").orderBy(F.desc("__t"), F.desc("__side"), F.desc("__o")).rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("__here", F.last("__o", ignorenulls=True).over(within)).filter("__side = 0")
    buckets = rows.select(*keys, "__b").union(firsts.select(*keys, "__b")).distinct().join(firsts, [*keys, "__b"], "left")
    later = Window.partitionBy(*keys).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = buckets.select(*keys, "__b", F.last("__first", ignorenulls=True).over(later).alias("__next"))
    out = here.drop("__o", "__t", "__side").join(ahead, [*keys, "__b"]).withColumn("__hit", F.coalesce("__here", "__next"))
    return out.select(*columns, F.col("__hit.at").alias("observed_time"), *[F.col(f"__hit.{v}").alias(f"observed_{v}") for v in value])


def settle(entries: DataFrame, observations: DataFrame, bars: DataFrame, payout: Payout = Payout(), minutes: tuple[int, ...] = HORIZONS, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Results of ``entries(event_id, direction, mode, entry_time, entry_price)``.

    The first observation (``obs_time``, ``close``) at or after the due time settles: strictly
    better wins, equality loses. An event is unresolved when a bar has opened after the due time
    and no observation came in the bars up to it; it is active as long as none has.
    """
    return settle_with_ends(entries, observations, bars, payout, minutes, keys).drop("done_bar")


def settle_with_ends(entries: DataFrame, observations: DataFrame, bars: DataFrame, payout: Payout = Payout(), minutes: tuple[int, ...] = HORIZONS, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``settle`` and ``done_bar``, the bar in which an event was settled or given up; null while it is active."""
    due = horizons(entries, minutes)
    seen = observations.withColumn("bar", F.col("bar_open"))
    hit = first_at_or_after(due, "target_time", seen, "obs_time", ["close", "bar"], keys)
    hit = hit.withColumnsRenamed({"observed_time": "settled_time", "observed_close": "settle_price", "observed_bar": "settle_bar"})
    # Strictly after the due time: the first open at or after the next microsecond.
    hit = hit.withColumn("due_after", F.col("target_time") + F.expr("INTERVAL 0.000001 SECOND"))
    rows = first_at_or_after(hit, "due_after", bars.select(*keys, "open_time"), "open_time", [], keys).withColumnRenamed("observed_time", "next_open")
    move = F.signum((F.col("settle_price") - F.col("entry_price")) * F.col("direction"))
    resolved = F.col("settle_bar").isNotNull() & (F.col("next_open").isNull() | (F.col("settle_bar") <= F.col("next_open")))
    status = F.when(resolved, F.when(move > 0, "WIN").otherwise("LOSS")).when(F.col("next_open").isNotNull(), "UNRESOLVED").otherwise("ACTIVE")
    done = status.isin("WIN", "LOSS")
    rows = rows.withColumn("result", status)
    return rows.select(
        *due.columns, "result", F.when(done, F.col("settle_price")).alias("settle_price"), F.when(done, F.col("settled_time")).alias("settled_time"),
        F.when(done, F.col("settle_bar")).alias("settle_bar"),
        F.when(F.col("result") == "WIN", F.lit(payout.win)).when(F.col("result") == "LOSS", F.lit(payout.loss)).alias("pnl"),
        F.when(done, seconds_between(F.col("target_time"), F.col("settled_time"))).alias("timing_error_seconds"),
        F.when(done, F.col("settle_bar")).when(F.col("result") == "UNRESOLVED", F.col("next_open")).alias("done_bar"),
    )


def active_counts(settled: DataFrame, keys: tuple[str, ...] = ("symbol",), entry: str = "entry_time") -> DataFrame:
    """``keys, time, n_active`` after each change: an event is active from its entry to the bar in which its last horizon is done.

    ``settled`` is ``settle_with_ends``'s. What ends in a bar is gone before what is entered at its
    time. A sweep over one +1 and one -1 per event: changes of a day are summed within it, and the
    day begins with what the totals of earlier days leave, one row each, so no task sorts a series.
    """
    events = settled.groupBy(*keys, "event_id", entry).agg(F.max("done_bar").alias("end"), F.count_if(F.col("done_bar").isNull()).alias("open"))
    change = F.struct(F.col(entry).alias("time"), F.lit(1).alias("delta"))
    gone = F.struct(F.greatest("end", entry).alias("time"), F.lit(-1).alias("delta"))
    changes = events.select(*keys, F.explode(F.when(F.col("open") == 0, F.array(change, gone)).otherwise(F.array(change))).alias("c")).select(*keys, "c.*")
    changes = changes.groupBy(*keys, "time").agg(F.sum(F.when(F.col("delta") < 0, F.col("delta")).otherwise(0)).alias("less"), F.sum(F.when(F.col("delta") > 0, F.col("delta")).otherwise(0)).alias("more"))
    changes = changes.withColumns({"__day": F.date_trunc("day", "time"), "delta": F.col("less") + F.col("more")})
    within = Window.partitionBy(*keys, "__day").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = changes.groupBy(*keys, "__day").agg(F.sum("delta").alias("total"))
    days = days.select(*keys, "__day", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    swept = changes.withColumn("n", F.sum("delta").over(within)).join(days, [*keys, "__day"])
    return swept.select(*keys, "time", (F.col("base") + F.col("n")).alias("n_active"))


def active_peak(settled: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``keys, max_active, reached``: the largest number of active events and when it was first reached."""
    counts = active_counts(settled, keys)
    return counts.groupBy(*keys).agg(F.max("n_active").alias("max_active"), F.min_by("time", F.struct(-F.col("n_active"), "time")).alias("reached"))


def check_active_limit(settled: DataFrame, limit: int = 100, keys: tuple[str, ...] = ("symbol",)) -> None:
    """Fail if more than ``limit`` events of a series are ever active at once, naming the first few series."""
    over = active_peak(settled, keys).filter(F.col("max_active") > limit).orderBy(*keys).limit(10).collect()
    if over:
        raise ValueError(f"more than {limit} active events: " + ", ".join(f"{'/'.join(str(r[k]) for k in keys)} has {r.max_active} at {r.reached}" for r in over))


def seconds_between(a: Column, b: Column) -> Column:
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return (micros(b) - micros(a)) / 1e6


def ledger(settled: DataFrame, payout: Payout = Payout(), keys: tuple[str, ...] = ("symbol", "horizon")) -> DataFrame:
    """Counts, win rate, expectation and P&L by direction and mode and over each and both of them."""
    done = settled.filter(F.col("result").isin("WIN", "LOSS"))
    cube = done.groupingSets(
        [[*map(F.col, keys), F.col("direction"), F.col("mode")], [*map(F.col, keys), F.col("direction")], [*map(F.col, keys), F.col("mode")], [*map(F.col, keys)]],
        *map(F.col, keys), F.col("direction"), F.col("mode"),
    )
    out = cube.agg(F.count("*").alias("resolved"), F.count_if(F.col("result") == "WIN").alias("wins"), F.count_if(F.col("result") == "LOSS").alias("losses"), F.sum("pnl").alias("net_pnl"))
    rate = div(F.col("wins"), F.col("resolved"))
    return out.withColumn("win_rate", rate * 100).withColumn("expectation", rate * payout.win + (1 - rate) * payout.loss)


def settlement_order():
    """Within a settling bar the newest event comes first."""
    return [F.col("settle_bar"), F.desc("event_id")]


def _by_day(settled: DataFrame) -> DataFrame:
    return settled.filter(F.col("result").isin("WIN", "LOSS")).withColumn("__day", F.date_trunc("day", "settle_bar"))


def streaks(settled: DataFrame, keys: tuple[str, ...] = ("symbol", "horizon")) -> DataFrame:
    """The longest runs of wins and of losses.

    Runs are found within days. Only a day's first and last run can go on in another day, so only
    those are put together over the whole series; a task sorts one day, or two rows a day.
    """
    day = Window.partitionBy(*keys, "__day").orderBy(*settlement_order())
    turned = F.coalesce(F.col("result") != F.lag("result").over(day), F.lit(True)).cast("int")
    rows = _by_day(settled).withColumn("turned", turned)
    runs = rows.withColumn("run", F.sum("turned").over(day.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*keys, "__day", "run", "result").agg(F.count("*").alias("n"))
    runs = runs.withColumn("last", F.max("run").over(Window.partitionBy(*keys, "__day")))
    inner = F.col("run").between(2, F.col("last") - 1)
    edge = F.struct("run", "result", "n")
    days = runs.groupBy(*keys, "__day").agg(
        F.max("last").alias("last"), F.array_sort(F.collect_list(F.when(~inner, edge))).alias("edges"),
        *[F.max(F.when(inner & (F.col("result") == r), F.col("n"))).alias(f"inner_{r}") for r in ("WIN", "LOSS")],
    )
    ends = days.select(*keys, "__day", "last", "inner_WIN", "inner_LOSS", F.explode("edges").alias("e")).select("*", "e.*").drop("e")
    series = Window.partitionBy(*keys).orderBy("__day", "run")
    # The last of three or more runs of a day follows a run that is no edge.
    fresh = F.coalesce(F.col("result") != F.lag("result").over(series), F.lit(True)) | ((F.col("run") == F.col("last")) & (F.col("last") > 2))
    joined = ends.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(series.rowsBetween(Window.unboundedPreceding, 0)))
    whole = joined.groupBy(*keys, "island", "result").agg(F.sum("n").alias("n"), F.max("inner_WIN").alias("inner_WIN"), F.max("inner_LOSS").alias("inner_LOSS"))
    longest = lambda r: F.coalesce(F.greatest(F.max(F.when(F.col("result") == r, F.col("n"))), F.max(f"inner_{r}")), F.lit(0))
    return whole.groupBy(*keys).agg(longest("WIN").alias("max_wins"), longest("LOSS").alias("max_losses"))


def drawdown(settled: DataFrame, keys: tuple[str, ...] = ("symbol", "horizon")) -> DataFrame:
    """Final equity and the deepest fall from its peak, which starts at 0.

    A day is summed up on its own by its total, its highest and lowest equity and its deepest fall
    inside; equity and peak before it come from one row a day.
    """
    day = Window.partitionBy(*keys, "__day").orderBy(*settlement_order()).rowsBetween(Window.unboundedPreceding, 0)
    rows = _by_day(settled).withColumn("equity", F.sum("pnl").over(day))
    rows = rows.withColumn("fall", F.max("equity").over(day) - F.col("equity"))
    days = rows.groupBy(*keys, "__day").agg(
        F.sum("pnl").alias("total"), F.max("equity").alias("top"), F.min("equity").alias("low"), F.max("fall").alias("fall"),
    )
    earlier = Window.partitionBy(*keys).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("base", F.coalesce(F.sum("total").over(earlier), F.lit(0.0)))
    days = days.withColumn("peak", F.greatest(F.lit(0.0), F.coalesce(F.max(F.col("base") + F.col("top")).over(earlier), F.lit(0.0))))
    deepest = F.greatest(F.col("fall"), F.col("peak") - F.col("base") - F.col("low"))
    return days.groupBy(*keys).agg(
        F.sum("total").alias("net_pnl"), F.greatest(F.lit(0.0), F.max(F.col("base") + F.col("top"))).alias("peak_equity"), F.max(deepest).alias("max_drawdown"),
    )


def timing(settled: DataFrame, keys: tuple[str, ...] = ("symbol", "horizon")) -> DataFrame:
    done = settled.filter(F.col("timing_error_seconds").isNotNull())
    return done.groupBy(*keys).agg(
        F.count("*").alias("n_events"), F.sum("timing_error_seconds").alias("sum_seconds"), F.avg("timing_error_seconds").alias("mean_seconds"), F.max("timing_error_seconds").alias("max_seconds"),
    )


def payouts(bets: DataFrame, *keys: str) -> DataFrame:
    """``keys, stake, winning_return, win, loss, break_even, n`` of each kind of bet; ``break_even`` is the share of wins that ends at nothing.

    A stake or return that isn't positive, or a return that isn't more than its stake, fails the job.
    """
    wrong = ~((F.col("stake") > 0) & (F.col("winning_return") > F.col("stake")))
    sound = F.when(F.coalesce(wrong, F.lit(True)), F.raise_error(F.lit("a return must be more than its positive stake")).cast("boolean")).otherwise(True)
    kinds = bets.filter(sound).groupBy(*keys, "stake", "winning_return").agg(F.count("*").alias("n"))
    stake, back = F.col("stake"), F.col("winning_return")
    return kinds.select(*keys, "stake", "winning_return", (back - stake).alias("win"), (-stake).alias("loss"), (stake / back).alias("break_even"), "n")
