"""Contracts between tables, and the commands that check them."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from barloom import cli
from barloom.operators import checks, features, fusion, splits


def test_feature_schema():
    class Table:
        columns = ["prediction_time", "b", "a", "feature_valid", "feature_invalid_reason"]

    assert checks.feature_schema_errors(Table, ["b", "a"]) == []
    assert checks.feature_schema_errors(Table, ["a", "b"]) == ["columns are in another order"]
    Table.columns = ["prediction_time", "a", "target_up", "feature_valid", "feature_invalid_reason"]
    assert checks.feature_schema_errors(Table, ["a", "b"]) == ["missing column: b", "unexpected column: target_up", "outcome among the features: target_up"]
    assert checks.view_errors(Table, ["a", "b"], ["feature_valid"]) == ["missing column: b"]
    assert checks.distinct_messages(["x", "y", "x"]) == ["x", "y"]


def test_sealing_and_reports():
    assert checks.sealing_errors({"test_status": "SEALED"}, ["predictions", "run_info.json"]) == []
    assert checks.sealing_errors({}, ["a/test_predictions"]) == ["test status is None", "test file: a/test_predictions"]
    assert checks.merged_report({"n": 1}, {"n": 2, "m": 3}) == {"n": 1, "m": 3}


def test_repeated_keys_fail(spark):
    once = spark.createDataFrame([("A", 1), ("A", 2), ("B", 1)], "symbol string, prediction_time int")
    assert checks.unique(once, ["symbol", "prediction_time"], "x").count() == 3
    with pytest.raises(PySparkException, match="x: repeated key"):
        checks.unique(once.unionByName(once.limit(1)), ["symbol", "prediction_time"], "x").collect()
    row = checks.one_to_one(once, once.filter("symbol = 'A'").unionByName(once.filter("symbol = 'A' AND prediction_time = 1"))).first()
    assert (row.left_rows, row.right_rows, row.only_left, row.only_right, row.repeated_left, row.repeated_right, row.passed) == (3, 3, 1, 0, 0, 1, False)
    assert checks.one_to_one(once, once).first().passed and checks.one_to_one(once.limit(0), once.limit(0)).first().passed


def test_finite_and_same_before(spark):
    data = spark.createDataFrame([("A", 1, 0.5, True), ("A", 2, float("nan"), False), ("A", 3, float("inf"), True)], "symbol string, prediction_time int, a double, feature_valid boolean")
    row = checks.finite(data, ["a"]).first()
    assert (row.n_rows, row.n_valid, row.n_non_finite, row.passed) == (3, 2, 1, False)
    later = data.withColumn("a", F.when(F.col("prediction_time") == 3, 9.0).otherwise(F.col("a")))
    assert checks.same_before(data, later, ["a"], 2).first().passed
    assert checks.same_before(data, later, ["a"], 3).first().n_changed == 1


def test_align_takes_a_valid_row_of_repeated_times(spark):
    rows = spark.createDataFrame([("A", 1, 5.0, False, "x"), ("A", 1, 7.0, True, None)], "symbol string, prediction_time int, a double, feature_valid boolean, feature_invalid_reason string")
    got = features.align(rows, rows.select("symbol", "prediction_time").distinct(), ["a"]).collect()
    assert [(r.a, r.feature_valid, r.alignment_valid) for r in got] == [(7.0, True, True)]


def test_more_than_one_series_is_refused(spark):
    rows = spark.createDataFrame([("A", 1), ("B", 1)], "symbol string, prediction_time int")
    with pytest.raises(ValueError, match="one series"):
        splits.chronological(rows)
    assert fusion.view("price_coarse_30m_v1").name == "coarse"


def test_config_command(tmp_path, capsys):
    broken = tmp_path / "config.yaml"
    broken.write_text("data: {}\n")
    assert cli.show_config.__doc__
    with pytest.raises(ValueError):
        cli.show_config(None, type("Args", (), {"config": str(broken)}))


def test_failed_run_says_so(spark, tmp_path):
    args = type("Args", (), {"out": str(tmp_path / "run"), "data": str(tmp_path / "missing"), "trees": 1})
    with pytest.raises(PySparkException):
        cli.compare(spark, args)
    assert json.loads((tmp_path / "run" / "run_info.json").read_text())["status"] == "FAILED"
