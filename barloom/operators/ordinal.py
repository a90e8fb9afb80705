"""Row numbers and windows over long series without one task per series.

A window that is partitioned by symbol alone puts a symbol's whole history in one task. Here the
history is cut by row number into blocks; each block also gets the rows before it that its windows
look back on, and drops them afterwards. Row numbers come from the counts of calendar buckets, so
no task sees more than one bucket or block. Where only the row before or after matters, calendar
buckets are enough, and one row a bucket tells what lies beyond its border. Keys hold no nulls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block: some 45 days of minutes, 224 days of five minutes.
BLOCK_ROWS = 1 << 16


def bucketed(df: DataFrame, time: str, bucket: str) -> DataFrame:
    """Adds ``__b``, the calendar bucket of ``time``; rows without a time come first, in a bucket of their own."""
    return df.withColumn("__b", F.coalesce(F.date_trunc(bucket, F.col(time)), F.lit("0001-01-01").cast("timestamp")))


def neighbours(df: DataFrame, columns: dict[str, Column], keys: tuple[str, ...], ahead: bool, time: str = "open_time", bucket: str = "month") -> DataFrame:
    """Adds ``columns`` of the row after (``ahead``) or before each row in its series, null where there is none.

    A task sorts one bucket of a series; a bucket's first or last row goes on to the bucket beside it.
    """
    step, edge = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)
    cut = bucketed(df, time, bucket).withColumn("__own", F.struct(*[value.alias(name) for name, value in columns.items()]))
    edges = cut.groupBy(*keys, "__b").agg(edge("__own", F.coalesce(F.col(time), F.col("__b"))).alias("__edge"))
    beyond = edges.select(*keys, "__b", step("__edge").over(Window.partitionBy(*keys).orderBy("__b")).alias("__beyond"))
    within = step("__own").over(Window.partitionBy(*keys, "__b").orderBy(time))
    rows = cut.withColumn("__within", within).join(beyond, [*keys, "__b"], "left").withColumn("__next", F.coalesce("__within", "__beyond"))
    return rows.select(*df.columns, *[F.col("__next")[name].alias(name) for name in columns])


def with_row_number(df: DataFrame, keys: tuple[str, ...], time: str = "open_time", bucket: str = "month", name: str = "row") -> DataFrame:
    """Adds the position (from 0) of each row in its series."""
    cut = bucketed(df, time, bucket)
    sizes = cut.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b")
    starts = sizes.select(*keys, "__b", (F.sum("__n").over(before) - F.col("__n")).alias("__start"))
    within = Window.partitionBy(*keys, "__b").orderBy(time)
    return cut.join(starts, [*keys, "__b"]).withColumn(name, F.col("__start") + F.row_number().over(within) - 1).drop("__b", "__start")


def in_blocks(df: DataFrame, keys: tuple[str, ...], lag: int, block: int, fn: Callable[[DataFrame, tuple[str, ...]], DataFrame], time: str = "open_time") -> DataFrame:
    """``fn(rows, partition keys)`` on blocks of ``block`` rows, each with the ``lag`` rows before it.

    ``fn`` keeps the column ``row``, one output row per input row, and looks back at most ``lag`` rows.
    """
    if lag > block:
        raise ValueError("a block must hold at least as many rows as windows look back")
    numbered = with_row_number(df, keys, time)
    own = F.floor(F.col("row") / block)
    last = (F.floor((F.col("row") + lag) / block))
    copies = numbered.withColumn("__block", F.explode(F.sequence(own, last)))
    out = fn(copies, (*keys, "__block"))
    return out.filter(F.col("__block") == F.floor(F.col("row") / block)).drop("__block")
