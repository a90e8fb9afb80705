"""Streams: bars from ticks, deduplication, and settlement of events as observations come in."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..params import Payout
from ..session import shared_dir

MINUTE = 60_000_000
#: Minutes of due times that a group of a settlement spans at least; a group costs some milliseconds however few its rows.
LEAST_SPAN = 360
#: What a price is; nulls come first and NaN last, as Spark sorts.
MISSING, NULL, PLAIN, NAN = -1, 0, 1, 2


def stream_bars(ticks: DataFrame, minutes: int, price: Column, delay: str = "10 minutes", time: str = "ts", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars of a tick stream, each sent once, when no tick of its time can come any more."""
    rows = ticks.select(*keys, F.col(time).cast("timestamp").alias("ts"), price.cast("double").alias("p")).withWatermark("ts", delay)
    bars = rows.groupBy(*keys, F.window("ts", f"{minutes} minutes").alias("w")).agg(
        F.min_by("p", "ts").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "ts").alias("close"),
    )
    return bars.select(*keys, F.col("w.start").alias("open_time"), "open", "high", "low", "close", (F.col("w.end") - F.expr("INTERVAL 1 MILLISECOND")).alias("close_time"))


def stream_distinct(ticks: DataFrame, ids: list[str], delay: str = "10 minutes", time: str = "ts") -> DataFrame:
    """The first of equal events within the delay; the state forgets what is older."""
    return ticks.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(ids)


def live_settlement(
    feed: DataFrame, payout: Payout = Payout(), horizons: tuple[int, ...] = (30, 60), limit: int = 30, delay: str = "10 minutes", keys: tuple[str, ...] = ("symbol",),
) -> DataFrame:
    """Results of events as they fall due, from one feed of entries and observations, each sent once.

    ``feed``: keys, ts, event_id (null for an observation), direction, price. The first observation
    from the due time to ``limit`` minutes after it settles, by its own time and not by when it came:
    strictly better wins, equality loses. Of observations of one time the lowest price counts. An event
    without any is ``UNRESOLVED``. A result goes out when no observation of its time can come any more,
    so rows that are late by less than ``delay`` count and their order doesn't matter. An entry that
    comes twice is one event.

    A group is one series in a span of due times that is no shorter than the limit, so an observation
    matters to its own span and, as the first of it, to the one before. A group sorts its observations
    and looks up each due time in them; no pairs are formed, and the work grows with the rows however
    dense they are. State holds a price for each time of what is younger than horizon, limit, delay and two spans together.
    """
    rows = feed.select(
        *keys, F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), F.col("direction").cast("double").alias("direction"),
        F.col("price").cast("double").alias("price"),
    ).withWatermark("ts", delay)
    span, entry = 60 * max(limit, LEAST_SPAN), F.col("event_id").isNotNull()
    at = lambda minutes, back=0: F.struct(
        F.lit(minutes).alias("horizon"), (F.unix_micros("ts") + F.lit(minutes * MINUTE)).alias("at"), (F.floor((F.unix_seconds("ts") + 60 * minutes) / span) - back).alias("span"),
    )
    places = F.when(entry, F.array(*[at(h) for h in horizons])).otherwise(F.array(at(0), at(0, 1)))
    # Nothing equals a null key; an entry with one stays without observations.
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    price, direction = F.col("price"), F.col("direction")
    form = F.when(price.isNull() | (entry & direction.isNull()), NULL).when(F.isnan(price), NAN).otherwise(PLAIN)
    placed = rows.filter(F.col("ts").isNotNull() & (entry | known)).select(
        *keys, "ts", entry.alias("entry"), F.coalesce("event_id", F.lit(0)).alias("event_id"), F.coalesce(direction, F.lit(0.0)).alias("direction"), form.alias("form"),
        F.when(form == PLAIN, price).otherwise(0.0).alias("price"), F.explode(places).alias("place"),
    )
    placed = placed.select("*", "place.*").drop("place")
    fields = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys] + [
        "event_id long", "horizon int", "target long", "direction double", "form int", "price double", "seen_at long", "seen_form int", "seen_price double"]
    closed = placed.groupBy(*keys, "span").applyInPandasWithState(
        _settler(keys, span * 1_000_000, limit * MINUTE, min(horizons) * MINUTE), ", ".join(fields), "seen binary, due binary", "append", "EventTimeTimeout",
    )
    value = lambda form, price: F.when(F.col(form) == PLAIN, F.col(price)).when(F.col(form) == NAN, F.lit(float("nan")))
    hit, settle_price = F.col("seen_form") != MISSING, value("seen_form", "seen_price")
    move = F.signum((settle_price - value("form", "price")) * F.col("direction"))
    result = F.when(~hit, "UNRESOLVED").when(move > 0, "WIN").otherwise("LOSS")
    return closed.select(
        *keys, "event_id", "horizon", F.timestamp_micros("target").alias("target_time"), result.alias("result"), settle_price.alias("settle_price"),
        F.when(hit, F.timestamp_micros("seen_at")).alias("settled_time"),
        F.when(result == "WIN", F.lit(payout.win)).when(result == "LOSS", F.lit(payout.loss)).alias("pnl"),
    )


def _settler(keys: tuple[str, ...], span: int, limit: int, lead: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Function of a group of ``live_settlement``; all times in microseconds, ``lead`` is the shortest horizon."""
    seen_type = np.dtype([("at", "i8"), ("form", "i4"), ("price", "f8")])
    due_type = np.dtype([("at", "i8"), ("event_id", "i8"), ("horizon", "i4"), ("direction", "f8"), ("form", "i4"), ("price", "f8")])

    def records(rows: pd.DataFrame, kind: np.dtype) -> np.ndarray:
        out = np.empty(len(rows), kind)
        for name in kind.names:
            out[name] = rows[name].to_numpy()
        return out

    def settle(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, due = [], []
        if state.exists:
            kept = state.get
            seen.append(np.frombuffer(kept[0], seen_type))
            due.append(np.frombuffer(kept[1], due_type))
        for rows in chunks:
            if len(rows):
                entry = rows["entry"].to_numpy(bool)
                seen.append(records(rows[~entry], seen_type))
                due.append(records(rows[entry], due_type))
        seen, due = np.concatenate(seen), np.unique(np.concatenate(due))
        seen = seen[np.lexsort((seen["price"], seen["form"], seen["at"]))]
        seen = seen[np.diff(seen["at"], prepend=np.iinfo("i8").min) != 0]  # the first of each time
        end, now = (int(key[-1]) + 1) * span, state.getCurrentWatermarkMs() * 1000
        seen = seen[: np.searchsorted(seen["at"], end) + 1]  # of the next span only the first
        over = due["at"] + limit < now
        done, due = due[over], due[~over]
        if len(due) or end - lead > now:  # entries to come are due after now + lead
            needed = seen[np.searchsorted(seen["at"], min([now + lead, *due["at"][:1]])) :]
            state.update((needed.tobytes(), due.tobytes()))
            wake = int(due["at"][0]) + limit if len(due) else end - lead
            state.setTimeoutTimestamp(max(wake // 1000, now // 1000, 1))
        elif state.exists:
            state.remove()
        if len(done):
            k = np.searchsorted(seen["at"], done["at"])
            first = np.append(seen, np.zeros(1, seen_type))[k]
            hit = (k < len(seen)) & (first["at"] <= done["at"] + limit)
            yield pd.DataFrame({
                **{k: [v] * len(done) for k, v in zip(keys, key, strict=False)}, "event_id": done["event_id"], "horizon": done["horizon"], "target": done["at"],
                "direction": done["direction"], "form": done["form"], "price": done["price"],
                "seen_at": first["at"], "seen_form": np.where(hit, first["form"], MISSING), "seen_price": first["price"],
            })

    return settle


def run_available(stream: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """All results a stream has for the input there is, as a table written to the shared folder.

    ``at`` is the folder of state and rows; a later run with the same one goes on where the last one stopped.
    """
    spark: SparkSession = stream.sparkSession
    at = at or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/state").option("path", f"{at}/rows").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
