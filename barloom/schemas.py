"""Fixed schemas. Column names and their order are contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PRICES = ("open", "high", "low", "close")
BAR_COLUMNS = ("open_time", *PRICES, "close_time")


def bar_schema(zoned: bool = True) -> T.StructType:
    """Canonical bars; ``zoned`` chooses timestamps with or without a zone."""
    when = T.TimestampType() if zoned else T.TimestampNTZType()
    return T.StructType(
        [T.StructField("open_time", when)] + [T.StructField(p, T.DoubleType()) for p in PRICES] + [T.StructField("close_time", when)]
    )


SAMPLE = T.StructType([
    T.StructField("sample_id", T.StringType()), T.StructField("prediction_time", T.TimestampType()),
    T.StructField("event_entry_time", T.TimestampType()), T.StructField("event_entry_price", T.DoubleType()),
    T.StructField("event_expiry_time", T.TimestampType()), T.StructField("event_expiry_price", T.DoubleType()),
    T.StructField("target_direction", T.ByteType()), T.StructField("target_up", T.ByteType()),
    T.StructField("label_valid", T.BooleanType()), T.StructField("invalid_reason", T.StringType()),
])


def empty_bars(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], bar_schema())


def schema_errors(df: DataFrame) -> list[str]:
    """What keeps a frame from being canonical bars: missing columns, order, types."""
    missing = [c for c in BAR_COLUMNS if c not in df.columns]
    if missing:
        return [f"missing columns: {', '.join(missing)}"]
    errors = []
    if [c for c in df.columns if c in BAR_COLUMNS] != list(BAR_COLUMNS):
        errors.append("columns out of order")
    types = dict(df.dtypes)
    errors += [f"{c} is not a timestamp" for c in ("open_time", "close_time") if not types[c].startswith("timestamp")]
    errors += [f"{c} is not a double" for c in PRICES if types[c] != "double"]
    return errors
