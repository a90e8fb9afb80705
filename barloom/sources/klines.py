"""Kline files: lines of comma-separated text to canonical bars. Nothing is inferred."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bars as bars_ops
from ..operators.quality import gaps, observed, observed_errors, preflight
from ..schemas import BAR_COLUMNS, PRICES
from ..session import shared_dir
from .archive_source import read_archives
from .files import delete, write_text

#: Numbers from here on are milliseconds, smaller ones seconds.
MILLIS_FROM = 1e11
FILE = ("file", "member")


def epoch_times(df: DataFrame, columns: list[str], by: tuple[str, ...] = FILE) -> DataFrame:
    """Text columns to times. The unit is decided per column and file: all numbers, or else ISO texts."""
    out = df
    w = Window.partitionBy(*by)
    for c in columns:
        number = F.expr(f"try_cast(`{c}` AS DOUBLE)")
        out = out.withColumns({f"__n_{c}": number})
        out = out.withColumns({f"__all_{c}": F.min(F.col(f"__n_{c}").isNotNull()).over(w), f"__max_{c}": F.max(F.abs(f"__n_{c}")).over(w)})
        micros = F.when(F.col(f"__max_{c}") >= MILLIS_FROM, F.col(f"__n_{c}") * 1000).otherwise(F.col(f"__n_{c}") * 1000000).cast("long")
        iso = F.try_to_timestamp(F.regexp_replace(F.col(c), "Z$", "+00:00"))
        out = out.withColumn(c, F.when(F.col(f"__all_{c}"), F.timestamp_micros(micros)).otherwise(iso))
        out = out.drop(f"__n_{c}", f"__all_{c}", f"__max_{c}")
    return out


def header_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def parse_lines(lines: DataFrame) -> DataFrame:
    """``file, member`` and the canonical columns of ``zip_lines`` rows.

    Blank lines are dropped. A file whose first line names an open and a close time has a header;
    one without has the close time in its seventh column, or its sixth if there are only six.
    """
    kept = lines.filter(F.length(F.regexp_replace("line", r"[\s,]", "")) > 0)
    w = Window.partitionBy(*FILE)
    rows = kept.withColumns({"cells": F.transform(F.split("line", ","), lambda x: F.trim(x)), "first_no": F.min("line_no").over(w)})
    rows = rows.withColumn("names", F.max(F.when(F.col("line_no") == F.col("first_no"), F.transform("cells", header_name))).over(w))
    has_header = F.array_contains("names", "opentime") & F.array_contains("names", "closetime")
    rows = rows.withColumn("has_header", has_header).filter(~F.col("has_header") | (F.col("line_no") > F.col("first_no")))

    def cell(name: str, position: Column) -> Column:
        named = F.array_position("names", name.replace("_", ""))
        return F.try_element_at("cells", F.when(F.col("has_header"), F.nullif(named, F.lit(0))).otherwise(position).cast("int"))

    last = F.when(F.size("cells") >= 7, 7).otherwise(6)
    positions = {"open_time": F.lit(1), "open": F.lit(2), "high": F.lit(3), "low": F.lit(4), "close": F.lit(5), "close_time": last}
    picked = rows.select(*FILE, *[cell(c, pos).alias(c) for c, pos in positions.items()])
    timed = epoch_times(picked, ["open_time", "close_time"])
    return timed.select(*FILE, "open_time", *[F.expr(f"try_cast(`{p}` AS DOUBLE)").alias(p) for p in PRICES], "close_time")


def assert_parsed(parsed: DataFrame) -> None:
    """No cell may have failed to parse."""
    bad = parsed.filter(" OR ".join(f"{c} IS NULL" for c in BAR_COLUMNS)).limit(5).collect()
    if bad:
        raise ValueError("cells that cannot be read: " + "; ".join(f"{r.file} {r.member}" for r in bad))


def prepare(
    spark: SparkSession, root: str, symbol: str, minutes: int, start: str, end: str, target: str, report: str | None = None, checksum: str = "required", source: dict | None = None,
) -> int:
    """Archives to one checked Parquet table of bars and a JSON report; returns how many repeated bars were dropped.

    Each archive of the dates is read, verified and parsed once; everything after that reads what was parsed.
    """
    staged = f"{shared_dir(spark)}/parsed-{uuid.uuid4().hex}"
    try:
        rows, seen = observed(read_archives(spark, root, start, end, checksum), "parsed")
        rows.write.parquet(staged)
        parsed = spark.read.parquet(staged)
        if any(seen.get[f"null_{c}"] for c in BAR_COLUMNS):
            assert_parsed(parsed)
        bars, dropped = bars_ops.merge(parsed.select(F.lit(symbol).alias("symbol"), *BAR_COLUMNS))
        bars = bars_ops.date_range(bars, start, end)
        bars, seen = observed(bars.repartitionByRange("open_time").sortWithinPartitions("open_time"), "bars")
        bars.write.mode("overwrite").parquet(f"{staged}/bars")
        bars = spark.read.parquet(f"{staged}/bars")
        if not seen.get["n_rows"]:
            raise ValueError(f"no bar of {start} to {end} in the archives under {root}")
        errors = observed_errors(seen)
        if errors:
            raise ValueError("; ".join(errors))
        bars.write.mode("overwrite").parquet(target)
        content = preparation_report(bars, parsed, symbol, minutes, dropped) | {"start_date": start, "end_date": end} | (source or {})
        write_text(spark, report or f"{target.rstrip('/')}.report.json", json.dumps(content, indent=2, default=str, sort_keys=True), overwrite=True)
        return dropped
    finally:
        delete(spark, staged)


#: Gaps that a report lists one by one; it counts all of them.
LISTED_GAPS = 1000


def preparation_report(bars: DataFrame, parsed: DataFrame, symbol: str, minutes: int, dropped: int) -> dict:
    """What was prepared: counts, first and last time, gaps, the preflight's row and the archives read."""
    checked = preflight(bars, minutes).first().asDict()
    found = gaps(bars, minutes)
    listed = [r.asDict() for r in found.orderBy("gap_from").limit(LISTED_GAPS).collect()]
    files = [r.file.rsplit("/", 1)[-1] for r in parsed.select("file").distinct().orderBy("file").collect()]  # a name for each month or day
    last = bars.agg(F.max("close_time").alias("t")).first().t
    return {
        "symbol": symbol, "interval_minutes": minutes, "timezone": "UTC", "rows": checked["n_rows"], "first_open_time": checked["first_open"], "last_close_time": last,
        "duplicate_count": dropped, "gap_count": checked["n_gaps"], "missing_bars": checked["n_missing"], "gap_ranges": listed, "data_preflight": checked, "archives": files,
    }
