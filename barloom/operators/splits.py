"""Chronological splits with purging at their borders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import Ratios
from .ordinal import with_row_number


@dataclass(frozen=True)
class Borders:
    train_rows: int
    before_test: int


def borders(rows: int, ratios: Ratios, least: int) -> Borders:
    """Positions where validation and test start, with at least ``least`` rows before each border.

    The products are truncated in double arithmetic, so they agree with what was published.
    """
    if rows < 2 * least + 1:
        raise ValueError("too few samples for three parts")
    first = min(max(int(rows * ratios.train), least), rows - least - 1)
    second = min(max(int(rows * (ratios.train + ratios.validation)), first + least), rows - 1)
    return Borders(first, second)


def chronological(samples: DataFrame, ratios: Ratios = Ratios(), purge_minutes: int = 30, key: str = "symbol") -> DataFrame:
    """Samples of one series with ``split``; rows too close to the next part's first sample are purged.

    More than one series is an error: each has borders of its own.

    Only the number of rows and the times at two positions come to the driver.
    """
    per = samples.groupBy(key).count().limit(2).collect()
    if len(per) > 1:
        raise ValueError("samples of one series are expected")
    at = borders(per[0]["count"] if per else 0, ratios, 2 if purge_minutes > 0 else 1)
    rows = with_row_number(samples, (key,), "prediction_time")
    starts = {r.row: r.prediction_time for r in rows.filter(F.col("row").isin(at.train_rows, at.before_test)).select("row", "prediction_time").collect()}
    split = F.when(F.col("row") < at.train_rows, "train").when(F.col("row") < at.before_test, "validation").otherwise("test")
    kind = dict(samples.dtypes)["prediction_time"]
    limit = F.when(F.col("split") == "train", F.lit(starts[at.train_rows]).cast(kind)).when(F.col("split") == "validation", F.lit(starts[at.before_test]).cast(kind))
    late = F.col("prediction_time") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(purge_minutes), F.lit(0))
    purged = F.coalesce((late >= limit) | (F.col("event_expiry_time") >= limit), F.lit(False))
    return rows.withColumn("split", split).filter(~purged).drop("row")


def full_report(split: DataFrame, valid_samples: DataFrame, ratios: Ratios = Ratios()) -> DataFrame:
    """The report with three ratios, of the rows kept, of all valid samples and the nominal one, and each part's border.

    ``border`` is the first prediction of the next part, null for the last one.
    """
    nominal = F.create_map(*[F.lit(v) for pair in (("train", ratios.train), ("validation", ratios.validation), ("test", ratios.test)) for v in pair])
    n_valid = valid_samples.agg(F.count("*").alias("n_valid"))
    following = F.lead("first_prediction").over(Window.partitionBy(F.lit(1)).orderBy("first_prediction"))  # three rows
    out = report(split).crossJoin(n_valid)
    return out.select("*", (F.col("n_rows") / F.col("n_valid")).alias("ratio_of_valid"), nominal[F.col("split")].alias("nominal_ratio"), following.alias("border")).drop("n_valid")


def report(split: DataFrame) -> DataFrame:
    per = split.groupBy("split").agg(
        F.count("*").alias("n_rows"), F.min("prediction_time").alias("first_prediction"), F.max("prediction_time").alias("last_prediction"), F.max("event_expiry_time").alias("last_expiry"),
    )
    total = F.sum("n_rows").over(Window.partitionBy(F.lit(1)))
    return per.withColumn("ratio", F.col("n_rows") / total)


def check(split: DataFrame) -> DataFrame:
    """One row: parts that are there, their order, overlaps, nulls, repeats, unknown parts."""
    first = lambda s: F.min(F.when(F.col("split") == s, F.col("prediction_time")))
    last = lambda s, c: F.max(F.when(F.col("split") == s, F.col(c)))
    row = split.agg(
        F.count("*").alias("n_rows"), (F.count("*") - F.count_distinct("prediction_time")).alias("n_duplicates"),
        F.count_if(F.col("prediction_time").isNull() | F.col("event_entry_time").isNull() | F.col("event_expiry_time").isNull()).alias("n_nulls"),
        F.count_if(~F.coalesce(F.col("split").isin("train", "validation", "test"), F.lit(False))).alias("n_unknown"),
        F.count_distinct(F.when(F.col("split").isin("train", "validation", "test"), F.col("split"))).alias("n_parts"),
        (last("train", "prediction_time") < first("validation")).alias("train_first"), (last("validation", "prediction_time") < first("test")).alias("validation_first"),
        (last("train", "event_expiry_time") < first("validation")).alias("train_apart"), (last("validation", "event_expiry_time") < first("test")).alias("validation_apart"),
    )
    good = (F.col("n_duplicates") == 0) & (F.col("n_nulls") == 0) & (F.col("n_unknown") == 0) & (F.col("n_parts") == 3)
    for c in ("train_first", "validation_first", "train_apart", "validation_apart"):
        good = good & F.coalesce(F.col(c), F.lit(False))
    return row.withColumn("passed", good)


def early_stopping(train: DataFrame, fraction: float = 0.1, purge_minutes: int = 30, key: str = "symbol") -> DataFrame:
    """Training rows as ``train_fit`` and, for the last ``fraction``, ``train_es``; rows between are purged."""
    n = train.count()
    start = int(n * (1 - fraction))
    rows = with_row_number(train, (key,), "prediction_time")
    begin = rows.filter(F.col("row") == start).select("prediction_time").first()[0]
    kind = dict(train.dtypes)["prediction_time"]
    late = F.col("prediction_time") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(purge_minutes), F.lit(0))
    part = F.when(F.col("row") >= start, "train_es").when(late < F.lit(begin).cast(kind), "train_fit")
    return rows.withColumn("part", part).filter(F.col("part").isNotNull()).drop("row")
