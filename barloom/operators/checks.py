"""Contracts between tables: inputs of labels, feature schemas, one-to-one joins and sealed test parts.

Checks of rows are small reports, one row each with ``passed``; checks of names need no job.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import is_bad

# Columns that tell the outcome and may not be features.
FORBIDDEN = ("target_up", "target_direction", "label_valid", "event_entry_price", "event_expiry_price", "event_entry_time", "event_expiry_time")
SEALED = "SEALED"


def label_inputs(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Nulls in what labels need, and open or close times that repeat within a series."""
    needed = ("open_time", "open", "close", "close_time")
    null = F.greatest(*[F.col(c).isNull().cast("int") for c in needed])
    per = bars.groupBy(*keys, "open_time").agg(F.count("*").alias("c"), F.sum(null).alias("n_nulls"))
    opened = per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("n_nulls"), F.lit(0)).alias("n_nulls"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("repeated_opens"))
    closed = bars.groupBy(*keys, "close_time").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated_closes"))
    row = opened.crossJoin(closed)  # one row each
    return row.withColumn("passed", (F.col("n_nulls") + F.col("repeated_opens") + F.col("repeated_closes")) == 0)


def feature_schema_errors(features: DataFrame, names: Sequence[str], around: Sequence[str] = ("prediction_time",), behind: Sequence[str] = ("feature_valid", "feature_invalid_reason")) -> list[str]:
    """What is wrong with a feature table's columns: their exact order, and outcomes among them."""
    expected, given = [*around, *names, *behind], features.columns
    errors = [f"missing column: {c}" for c in expected if c not in given] + [f"unexpected column: {c}" for c in given if c not in expected]
    if not errors and given != expected:
        errors.append("columns are in another order")
    return distinct_messages(errors + [f"outcome among the features: {c}" for c in given if c in FORBIDDEN])


def view_errors(data: DataFrame, names: Sequence[str], flags: Sequence[str]) -> list[str]:
    """Columns that a view of the dataset needs and lacks."""
    return [f"missing column: {c}" for c in (*names, *flags) if c not in data.columns]


def distinct_messages(messages: Iterable[str]) -> list[str]:
    """Each message once, in the order in which they came first."""
    return list(dict.fromkeys(messages))


def one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str] = ("symbol", "prediction_time")) -> DataFrame:
    """Rows of either side that have no counterpart, and repeats, from one pass over the counts of both."""
    sides = left.select(*on, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*on, F.lit(0).alias("l"), F.lit(1).alias("r")))
    per = sides.groupBy(*on).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    total = lambda value, name: F.coalesce(F.sum(value), F.lit(0)).cast("long").alias(name)
    row = per.agg(
        total("l", "left_rows"), total("r", "right_rows"), F.count_if(F.col("r") == 0).alias("only_left"), F.count_if(F.col("l") == 0).alias("only_right"),
        total(F.greatest(F.col("l") - 1, F.lit(0)), "repeated_left"), total(F.greatest(F.col("r") - 1, F.lit(0)), "repeated_right"),
    )
    wrong = sum((F.col(c) for c in ("only_right", "repeated_left", "repeated_right")), F.col("only_left"))
    return row.withColumn("passed", wrong == 0)


def unique(df: DataFrame, on: Sequence[str], what: str) -> DataFrame:
    """The same rows; the job fails with a message where a key is repeated.

    The count goes over the key that the following join is dealt by, so it adds no exchange.
    """
    n = F.count("*").over(Window.partitionBy(*on))
    kept = df.withColumn("__n", n).filter(F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.lit(f"{what}: repeated key")).cast("boolean")))
    return kept.drop("__n")


def finite(features: DataFrame, names: Sequence[str], keys: tuple[str, ...] = ("symbol",), valid: str = "feature_valid") -> DataFrame:
    """Per series: rows, valid rows, and valid ones that hold a value that isn't finite."""
    bad = F.greatest(*[is_bad(F.col(n)).cast("int") for n in names]) if len(names) > 1 else is_bad(F.col(names[0])).cast("int")
    row = features.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_if(F.col(valid)).alias("n_valid"), F.count_if(F.col(valid) & (bad == 1)).alias("n_non_finite"))
    return row.withColumn("passed", F.col("n_non_finite") == 0)


def same_before(original: DataFrame, changed: DataFrame, names: Sequence[str], until, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Whether later bars leave earlier features alone: rows up to ``until`` that differ between both tables."""
    on = [*keys, "prediction_time"]
    a = original.filter(F.col("prediction_time") <= until).select(*on, F.xxhash64(*names, "feature_valid").alias("a"))
    b = changed.filter(F.col("prediction_time") <= until).select(*on, F.xxhash64(*names, "feature_valid").alias("b"))
    row = a.join(b, on, "full").agg(F.count("*").alias("n_rows"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_changed"))
    return row.withColumn("passed", F.col("n_changed") == 0)


def sealing_errors(run_info: dict, files: Iterable[str]) -> list[str]:
    """A run that never saw its test part says so and left no file of it."""
    errors = [] if run_info.get("test_status") == SEALED else [f"test status is {run_info.get('test_status')!r}"]
    return errors + [f"test file: {name}" for name in sorted(files) if name.rsplit("/", 1)[-1].startswith("test")]


def merged_report(label_report: dict, split_report: dict) -> dict:
    """One report of a dataset: what both name, the labels' report knows better."""
    return split_report | label_report
