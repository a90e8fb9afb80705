"""Rows beside each other over months, and features in blocks by default, against one window by series."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import features, fusion, labels, quality
from barloom.operators.ordinal import neighbours
from barloom.session import stored

BARS = "symbol string, open_time timestamp_ntz, open double, high double, low double, close double, close_time timestamp_ntz"


def series(seed, hours=2600):
    """Two series with gaps of a bar and of months, and one of a single bar."""
    rng, rows = random.Random(seed), []
    for symbol, skip in (("a", lambda k: rng.random() < 0.01), ("b", lambda k: 700 < k < 2300)):
        for k in range(hours):
            if not skip(k):
                at, o, c = dt.datetime(2023, 11, 20) + dt.timedelta(hours=k), rng.uniform(90, 110), rng.uniform(90, 110)
                rows.append((symbol, at, o, max(o, c) + rng.random(), min(o, c) - rng.random(), c, at + dt.timedelta(minutes=59, seconds=59, milliseconds=999)))
    return [*rows, ("c", rows[0][1], *rows[0][2:])]


def same(a, b):
    assert a.columns == b.columns and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_neighbours_over_months(spark):
    bars = spark.createDataFrame(series(1), BARS)
    nulls = bars.withColumn("close", F.when(F.hour("open_time") != 23, F.col("close")))
    w = Window.partitionBy("symbol").orderBy("open_time")
    for ahead, step in ((True, F.lead), (False, F.lag)):
        got = neighbours(nulls, {"t": F.col("open_time"), "c": F.col("close") + 1}, ("symbol",), ahead)
        same(got, nulls.withColumns({"t": step("open_time").over(w), "c": step(F.col("close") + 1).over(w)}))
    assert neighbours(bars.limit(0), {"t": F.col("open_time")}, ("symbol",), True).count() == 0


def test_labels_and_gaps_look_over_the_end_of_a_month(spark):
    bars = spark.createDataFrame(series(2), BARS)
    labelled = labels.candidates(bars, 60)
    ends = labelled.filter((F.dayofmonth(F.col("prediction_time") + F.expr("INTERVAL 1 SECOND")) == 1) & (F.hour("prediction_time") == 23) & F.col("event_entry_time").isNotNull())
    assert ends.filter("symbol = 'a'").count() >= 3
    assert labelled.filter("invalid_reason IS NOT NULL").count() == 3 + quality.gaps(bars, 60).count()


def test_blocks_by_default(spark):
    fine = stored(spark.createDataFrame(series(3), BARS), "test-bars")
    whole = features.build(fine, features.fine_set(), 60, block_rows=None)
    for block in (features.BLOCK_ROWS, 300):
        got = features.build(fine, features.fine_set(), 60, block_rows=block)
        rounded = lambda df: df.select([F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
        same(rounded(got), rounded(whole))
    assert "__block" in features.build(fine, features.fine_set(), 60)._jdf.queryExecution().toString()
    coarse = fine.filter(F.hour("open_time") % 6 == 5)
    aligned = fusion.multires(coarse, fine, 360, 60)[1]
    same(aligned.select("symbol", "prediction_time"), coarse.select("symbol", F.col("close_time").alias("prediction_time")))
