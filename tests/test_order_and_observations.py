"""Order of input, counts on the way of a write, one pass of the preflight, entry confirmations and payouts."""

import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from barloom.operators import features, fusion, indicators, quality, settlement
from barloom.params import SignalParams
from barloom.sources.tables import in_file_order

T0 = dt.datetime(2024, 1, 1)
BARS = "symbol string, open_time timestamp_ntz, open double, high double, low double, close double, close_time timestamp_ntz"


def bar(symbol, k, low=99.0):
    return (symbol, T0 + dt.timedelta(minutes=30 * k), 100.0, 101.0, low, 100.5, T0 + dt.timedelta(minutes=30 * (k + 1), milliseconds=-1))


def test_breaks_of_the_given_order(spark, tmp_path):
    pick = random.Random(4)
    ks = [*range(50), 49, *pick.sample(range(50, 200), 150)]
    rows = [bar(pick.choice("ab"), k) for k in ks]
    spark.createDataFrame(rows, BARS).coalesce(1).write.parquet(str(tmp_path / "t"))
    scanned = in_file_order(spark.read.parquet(str(tmp_path / "t")))
    want = {}
    for symbol in "ab":
        own = [(k, r[1]) for k, r in enumerate(rows) if r[0] == symbol]
        wrong = [k for (_, before), (k, now) in zip(own, own[1:]) if now <= before]
        want[symbol] = (len(own), len(wrong), min(wrong))
    for block in (7, 1 << 20):
        found = quality.order_breaks(scanned.repartition(5), block=block).collect()
        assert {r.symbol: (r.n_rows, r.n_breaks, r.first_break.row) for r in found} == want
    sorted_rows = in_file_order(spark.read.parquet(str(tmp_path / "t"))).withColumn("row", F.unix_timestamp(F.col("open_time").cast("timestamp")))
    assert all(r.first_break is None or r.n_breaks for r in quality.order_breaks(sorted_rows.dropDuplicates(["symbol", "open_time"])).collect())


def test_the_first_of_repeated_times_counts(spark):
    rows = spark.createDataFrame([("A", 1, 5.0, False, "x", 3), ("A", 1, 9.0, True, None, 7), ("A", 1, 1.0, True, None, 9)], "symbol string, prediction_time int, v double, feature_valid boolean, feature_invalid_reason string, place int")
    times = spark.createDataFrame([("A", 1), ("A", 2)], "symbol string, prediction_time int")
    got = {r.prediction_time: (r.v, r.feature_valid, r.feature_invalid_reason) for r in features.align(rows, times, ["v"], ordinal="place").collect()}
    assert got == {1: (5.0, False, "x"), 2: (None, False, "alignment_invalid")}


def test_a_write_counts_on_its_way(spark, tmp_path):
    rows = [bar("a", k) for k in range(5)] + [bar("a", 9, low=102.0), bar("b", 1, low=-1.0), ("b", None, 1.0, 1.0, None, 1.0, T0)]
    watched, seen = quality.observed(spark.createDataFrame(rows, BARS), "t")
    watched.write.parquet(str(tmp_path / "t"))
    assert seen.get["n_rows"] == 8 and seen.get["null_open_time"] == seen.get["null_low"] == 1
    assert set(quality.observed_errors(seen)) == {"null_open_time: 1", "null_low: 1", "non_finite: 1", "non_positive: 1", "low_above_body: 1", "high_below_low: 1"}


def test_preflight_over_months_and_repeats(spark):
    rows = [bar("a", k) for k in (0, 1, 1, 2, 5, 48 * 31, 48 * 31 + 1, 48 * 90)] + [bar("b", 3)]
    got = {r.symbol: r for r in quality.preflight(spark.createDataFrame(rows, BARS), 30).collect()}
    gaps = [5 - 2, 48 * 31 - 5, 48 * 90 - 48 * 31 - 1]
    assert (got["a"].n_rows, got["a"].n_duplicates, got["a"].n_gaps, got["a"].n_irregular, got["a"].n_missing) == (8, 1, 3, 3, sum(g - 1 for g in gaps))
    assert not got["a"].passed and (got["b"].n_rows, got["b"].n_gaps, got["b"].n_missing, got["b"].passed) == (1, 0, 0, True)
    assert got["a"].n_missing == quality.gaps(spark.createDataFrame(rows, BARS), 30).filter("symbol = 'a'").agg(F.sum("missing_bars")).first()[0]


def test_confirmations_need_band_and_candle(spark):
    rows = [("S", k, close, before, 100.0, 1.0, z, pz) for k, (close, before, z, pz) in enumerate([
        (98.6, 98.0, -1.4, -2.0), (98.6, 99.0, -1.4, -2.0), (97.0, 96.0, -1.4, -2.0), (101.4, 102.0, 1.4, 2.0), (98.6, 98.0, -1.4, -1.4), (98.6, None, -1.4, None)])]
    df = spark.createDataFrame(rows, "symbol string, open_time int, close double, prev_close double, mean double, std double, z double, prev_z double")
    of = lambda **p: [(r.long_range, r.short_range) for r in indicators.confirmations(df, SignalParams(range_entry_z=1.5, **p)).orderBy("open_time").collect()]
    assert of() == [(True, False), (False, False), (False, False), (False, True), (False, False), (False, False)]
    assert [a for a, _ in of(require_candle=False)] == [True, True, False, False, False, False]
    assert [a for a, _ in of(require_band=False)] == [True, False, True, False, False, False]


def test_lone_rows_and_bad_payouts_fail(spark):
    coarse = features.build(spark.createDataFrame([bar("a", k) for k in range(3)], BARS), features.coarse_set(), 30)
    fine = features.build(spark.createDataFrame([bar("a", k) for k in range(2)], BARS), features.fine_set(), 30)
    aligned = features.align(fine, coarse, fusion.fine_names())
    assert fusion.fuse(coarse, aligned).count() == 3
    with pytest.raises(PySparkException, match="one side only"):
        fusion.fuse(coarse, aligned.limit(2)).collect()
    bets = spark.createDataFrame([(10.0, 18.5), (10.0, 18.5), (5.0, 9.25)], "stake double, winning_return double")
    assert {(r.stake, r.win, r.loss, r.n) for r in settlement.payouts(bets).collect()} == {(10.0, 8.5, -10.0, 2), (5.0, 4.25, -5.0, 1)}
    with pytest.raises(PySparkException, match="positive stake"):
        settlement.payouts(bets.withColumn("winning_return", F.lit(1.0))).collect()
