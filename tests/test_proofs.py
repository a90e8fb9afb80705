"""Proofs that features look back only, fingerprints of tables, and counts for reports."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import features, fingerprints, labels, proofs, reports

T0 = dt.datetime(2024, 1, 1)


def bars_of(spark, n, minutes, seed=7):
    rng = np.random.default_rng(seed)
    close = 100 * np.cumprod(1 + rng.normal(0, 0.003, n))
    opened = np.roll(close, 1)
    opened[0] = 100
    high, low = np.maximum(opened, close) * (1 + rng.uniform(0, 1e-3, n)), np.minimum(opened, close) * (1 - rng.uniform(0, 1e-3, n))
    rows = [("S", T0 + dt.timedelta(minutes=minutes * k), float(opened[k]), float(high[k]), float(low[k]), float(close[k]), T0 + dt.timedelta(minutes=minutes * (k + 1), milliseconds=-1)) for k in range(n)]
    return spark.createDataFrame(rows, "symbol string, open_time timestamp_ntz, open double, high double, low double, close double, close_time timestamp_ntz").cache()


def at(minutes, k):
    return F.lit(T0 + dt.timedelta(minutes=minutes * k)).cast("timestamp_ntz")


def test_later_prices_do_not_reach_earlier_rows(spark):
    bars, names = bars_of(spark, 70, 30), features.coarse_set().names()
    build = lambda b: features.build(b, features.coarse_set(), 30)
    row = proofs.mutation_proof(build, [bars], at(30, 50), names).first()
    assert (row.n_before, row.n_changed_before, row.n_after, row.n_changed_after, row.passed) == (50, 0, 20, 20, True)
    peek = lambda b: build(b).withColumn("ret_1", F.lead("ret_1").over(features.Window.partitionBy("symbol").orderBy("prediction_time")))
    row = proofs.mutation_proof(peek, [bars], at(30, 50), names).first()
    assert not row.passed and row.n_changed_before == 1 and row.leaking == ["ret_1"] and row.first_leak == T0 + dt.timedelta(minutes=1500, milliseconds=-1)


@pytest.mark.parametrize(("spec", "minutes", "n", "gap"), [(features.coarse_set(), 30, 120, 60), (features.fine_set(), 5, 650, 300)])
def test_a_gap_invalidates_exactly_the_rows_that_look_back_on_it(spark, spec, minutes, n, gap):
    bars = bars_of(spark, n, minutes)
    build = lambda b: features.build(b, spec, minutes)
    row = proofs.gap_proof(build, bars, F.col("open_time") == at(minutes, gap), spec.names(), spec.max_lag).first()
    assert (row.n_dropped, row.n_missing, row.n_changed_before, row.passed) == (1, 1, 0, True)
    # The dropped bar's row is missing; of the rows after it max_lag have no whole history, and only those.
    assert row.n_invalidated == row.n_non_contiguous == spec.max_lag
    assert row.first_invalid == T0 + dt.timedelta(minutes=minutes * (gap + 2), milliseconds=-1)
    assert row.last_invalid == row.first_invalid + dt.timedelta(minutes=minutes * (spec.max_lag - 1))
    blind = lambda b: build(b).withColumns({"feature_valid": F.lit(True), "feature_invalid_reason": F.lit(None).cast("string")})
    assert proofs.gap_proof(blind, bars, F.col("open_time") == at(minutes, gap), spec.names(), spec.max_lag).first().n_invalidated == 0


def test_differences_name_columns_and_lone_rows(spark):
    schema = "symbol string, prediction_time int, x double, y double, feature_valid boolean, feature_invalid_reason string"
    a = spark.createDataFrame([("S", 1, 1.0, None, True, None), ("S", 2, 1.0, 2.0, True, None), ("S", 3, 0.0, 0.0, True, None)], schema)
    b = spark.createDataFrame([("S", 1, 1.0 + 1e-12, float("nan"), True, None), ("S", 2, 1.1, None, False, "why"), ("S", 4, 0.0, 0.0, True, None)], schema)
    got = {r.prediction_time: (r.side, r.changed) for r in proofs.differences(a, b, ["x", "y"], ["symbol", "prediction_time"]).collect()}
    assert got == {1: ("both", []), 2: ("both", ["x", "y", "feature_valid", "feature_invalid_reason"]), 3: ("before", []), 4: ("after", [])}


def test_fingerprints_tell_which_part_differs(spark):
    rows = [(p, k % 5, k * 0.5, None if k % 7 == 0 else "t") for p in "ab" for k in range(60)]
    df = spark.createDataFrame(rows, "part string, k long, x double, t string")
    same = df.repartition(7).select("t", F.col("x").cast("float").cast("double").alias("x"), F.col("k").cast("int").alias("k"), "part")
    changes = {
        "same": same, "twice": df.unionByName(df.filter("part = 'a' AND x = 3")), "thrice": df.unionByName(df.filter("part = 'a' AND x = 3")).unionByName(df.filter("part = 'a' AND x = 3")),
        "moved null": df.withColumn("t", F.when((F.col("part") == "a") & (F.col("x") == 3.5), F.lit("t")).otherwise(F.col("t"))), "part": df.filter("part = 'b'"),
        "other part": df.unionByName(df.filter("x = 1 AND part = 'b'").withColumn("part", F.lit("c"))),
    }
    got = {(r.table, r.part): (r.equal, r.n, r.n_first) for r in fingerprints.compare({"first": df, **changes}, ["k", "x", "t"], ["part"]).collect()}
    assert got["same", "a"] == got["same", "b"] == (True, 60, 60)
    assert [got[t, "a"] for t in ("twice", "thrice", "moved null", "part")] == [(False, 61, 60), (False, 62, 60), (False, 60, 60), (False, 0, 60)]
    assert all(got[t, "b"][0] for t in changes) and got["other part", "c"] == (False, 1, 0)
    fingerprints.assert_equal({"first": df, "same": same}, ["k", "x", "t"], ["part"])
    with pytest.raises(ValueError, match="differ"):
        fingerprints.assert_equal({"first": df, "twice": changes["twice"]}, ["k", "x", "t"])
    with pytest.raises(ValueError):
        fingerprints.compare({"first": df}, ["k"])


def test_label_report_lists_a_bounded_number(spark):
    bars = bars_of(spark, 40, 30).filter(F.minute("open_time") == 0)  # every bar lacks the next one
    got = reports.label_report(labels.candidates(bars, 30), listed=3)
    assert (got["total_candidate_events"], got["valid_events"], got["invalid_events"]) == (20, 0, 20)
    assert got["invalid_reason_counts"] == {"missing_next_bar": 20} and len(got["invalid_candidates"]) == 3
    assert reports.label_report(labels.candidates(bars.limit(0), 30))["total_candidate_events"] == 0
