"""Bars and ticks of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars


def ticks(spark: SparkSession, sf_dir: str, by_type: bool = False) -> DataFrame:
    """Events as ticks: the price is 100 above the value, the symbol constant or the event's type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    symbol = F.col("event_type") if by_type else F.lit("ALL")
    return events.select(symbol.alias("symbol"), "ts", (F.lit(100.0) + F.col("value")).alias("price"), "event_id")


def tick_bars(spark: SparkSession, sf_dir: str, minutes: int, by_type: bool = False) -> DataFrame:
    return bars.from_ticks(ticks(spark, sf_dir, by_type), minutes, F.col("price"))


def in_file_order(scanned: DataFrame) -> DataFrame:
    """A scan of Parquet files with ``file`` and ``row``, where each row stood; no shuffle changes these.

    Order of input is the order of (file, row): of repeated rows the first is the one with the smallest.
    """
    return scanned.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
