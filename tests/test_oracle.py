"""Queries against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from barloom.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
MAIN = [
    "bars_from_ticks", "bars_conflicts", "kline_epoch_parse", "gap_ranges", "ohlc_violations", "preflight_report", "preflight_of_faulty_bars", "label_input_check", "split_full_report", "split_check_of_mixed_parts", "one_to_one_check", "next_bar_labels", "label_causality_check", "chrono_split",
    "train_es_split", "coarse_features_in_blocks", "fine_features", "multires_dataset", "alignment_contract", "prob_metrics", "reliability_table", "confidence_report",
    "monthly_diagnostics", "comparison_pivot", "residual_zscore", "half_life", "shock_funnel", "event_settlement", "event_ledger", "event_streaks", "event_drawdown",
    "stream_bars", "stream_settlement", "live_settlement", "active_event_peak", "common_sample_fingerprints", "mutation_proof_fine", "gap_proof_coarse", "label_reason_report", "feature_report",
    "input_order", "entry_confirmations", "align_exact", "payout_table",
]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or isinstance(value, float) and value != value:
        return None
    if isinstance(value, float) and value == int(value):
        return int(value)
    return str(value) if hasattr(value, "year") else getattr(value, "item", lambda: value)()


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(repr([plain(getattr(v, "item", lambda v=v: v)() if not hasattr(v, "year") else v) for v in r]) for r in df[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", MAIN)
def test_same_rows(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(ORACLE_SQL[name]).df())


def test_most_queries_have_sql():
    assert len(ORACLE_SQL) >= 0.9 * len(QUERIES)
