"""Canonical bars' schema, and lines of settlements."""

from pyspark.sql import functions as F

from barloom import schemas
from barloom.functions import scalar


def test_schema_errors(spark):
    bars = schemas.empty_bars(spark)
    assert schemas.schema_errors(bars) == [] and bars.count() == 0 and bars.columns == list(schemas.BAR_COLUMNS)
    assert schemas.schema_errors(bars.drop("low", "close")) == ["missing columns: low, close"]
    assert schemas.schema_errors(bars.select("open", "open_time", "high", "low", "close", "close_time")) == ["columns out of order"]
    assert schemas.schema_errors(bars.withColumns({"low": F.col("low").cast("float"), "close_time": F.col("close_time").cast("string")})) == ["close_time is not a timestamp", "low is not a double"]


def test_lines_leave_nulls_out(spark):
    row = spark.range(1).select(
        scalar.message("X", a=F.lit(1), b=F.lit(None).cast("string"), c=scalar.iso_z(F.lit("2024-01-01 00:00:00.25").cast("timestamp_ntz"))).alias("line"),
        scalar.to_tick(F.lit(100.13), 0.05).alias("tick"), scalar.round_trip_cost(F.lit(100.0), 5.0, 1.0, 0.1).alias("cost"), scalar.direction_name(F.lit(0)).alias("none"),
    ).first()
    assert row.line == "X|a=1|c=2024-01-01T00:00:00.250000Z" and abs(row.tick - 100.15) < 1e-9 and abs(row.cost - 0.3) < 1e-9 and row.none is None
