"""Published small cases and properties."""

import datetime as dt
import io
import os
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import bars, features, fusion, labels, lifecycle, metrics, quality, settlement, splits
from barloom.params import Payout, Ratios, SignalParams, check_timeframes, interval_minutes
from barloom.sources import archives, klines
from barloom.sources.sinks import new_run_folder, write_json

T0 = pd.Timestamp("2024-01-01")


def frame(spark, rows, minutes=30, skip=(), symbol="S"):
    """Bars (open, high, low, close) on a grid, without the positions in ``skip``."""
    data = [
        (symbol, (T0 + pd.Timedelta(minutes=minutes * k)).to_pydatetime(), *map(float, r), (T0 + pd.Timedelta(minutes=minutes * (k + 1)) - pd.Timedelta(milliseconds=1)).to_pydatetime())
        for k, r in enumerate(rows) if k not in skip
    ]
    return spark.createDataFrame(data, "symbol string, open_time timestamp_ntz, open double, high double, low double, close double, close_time timestamp_ntz")


def walk(n, seed=42):
    rng = np.random.default_rng(seed)
    close = 50_000 * np.exp(np.cumsum(rng.normal(0, 0.005, n)))
    opened = np.concatenate([[50_000], close[:-1]])
    wick = rng.uniform(1e-4, 2e-3, n)
    return list(zip(opened, np.maximum(opened, close) * (1 + wick), np.minimum(opened, close) * (1 - wick), close, strict=True))


def test_labels_use_only_the_next_bar(spark):
    rows = [(100, 102, 99, 100.5), (101, 103, 100, 102), (102, 103, 101, 101), (103, 104, 102, 103.5)]
    got = labels.candidates(frame(spark, rows), 30).orderBy("prediction_time").collect()
    assert [(r.event_entry_price, r.event_expiry_price, r.target_up) for r in got] == [(101, 102, 1), (102, 101, 0), (103, 103.5, 1), (None, None, None)]
    assert [r.invalid_reason for r in got] == [None, None, None, "missing_next_bar"]
    gap = labels.candidates(frame(spark, rows, skip=(1,)), 30).orderBy("prediction_time").collect()
    assert [r.invalid_reason for r in gap] == ["missing_next_bar", None, "missing_next_bar"]
    flat = labels.candidates(frame(spark, [rows[0], (101, 103, 100, 101)]), 30).orderBy("prediction_time").first()
    assert (flat.target_direction, flat.target_up, flat.label_valid, flat.invalid_reason) == (0, None, False, None)


def samples(spark, n):
    step = dt.timedelta(minutes=30)
    at = [T0.to_pydatetime() + k * step for k in range(n)]
    rows = [("S", f"id{k}", t, t + step, t + 2 * step - dt.timedelta(milliseconds=1)) for k, t in enumerate(at)]
    return spark.createDataFrame(rows, "symbol string, sample_id string, prediction_time timestamp_ntz, event_entry_time timestamp_ntz, event_expiry_time timestamp_ntz")


def test_split_of_thirty_and_early_stopping(spark):
    split = splits.chronological(samples(spark, 30), Ratios(), 30)
    assert {r.split: r.n for r in split.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 23, "validation": 2, "test": 3}
    assert splits.check(split).first().passed
    parts = splits.early_stopping(samples(spark, 100), 0.1, 30)
    assert {r.part: r.n for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()} == {"train_fit": 89, "train_es": 10}
    with pytest.raises(ValueError):
        splits.chronological(samples(spark, 4), Ratios(), 30)
    with pytest.raises(ValueError):
        Ratios(0.8, 0.1, 0.2)


def test_coarse_warm_up_gap_and_causality(spark):
    rows = walk(120)
    spec = features.coarse_set()
    got = features.build(frame(spark, rows, skip=(60,)), spec, 30).orderBy("prediction_time").toPandas()
    assert got.feature_invalid_reason[:48].eq("insufficient_history").all() and got.feature_valid[48:60].all()
    assert got.feature_invalid_reason[60:108].eq("non_contiguous_history").all() and got.feature_valid[108:].all()
    changed = rows[:51] + [tuple(2 * v for v in r) for r in rows[51:]]
    a = features.build(frame(spark, rows), spec, 30).orderBy("prediction_time").toPandas()
    b = features.build(frame(spark, changed), spec, 30).orderBy("prediction_time").toPandas()
    names = spec.names()
    assert np.allclose(a[names][:51], b[names][:51], atol=1e-10, equal_nan=True) and not np.allclose(a[names][51:], b[names][51:], equal_nan=True)
    assert len(names) == 34


def test_fine_path_features_follow_pandas(spark):
    rows = walk(40, 7)
    got = features.build(frame(spark, rows, 5), features.fine_set(), 5).orderBy("prediction_time").toPandas()
    p = pd.DataFrame(rows, columns=["open", "high", "low", "close"])
    r = np.log(p.close).diff()
    up = r.gt(0).rolling(6).mean()
    sign = np.sign(r)
    turn = (sign.ne(sign.shift()) & sign.ne(0) & sign.shift().ne(0)).astype(float).rolling(5).sum() / 5
    size = r.abs().rolling(6).sum()
    recency = p.high.rolling(6).apply(lambda v: np.argmax(v) / 5, raw=True)
    for name, wanted in (("up_ratio", up), ("sign_change_rate", turn), ("abs_return_sum", size), ("high_recency", recency)):
        assert np.allclose(got[f"f5_{name}_6"].astype(float), wanted, equal_nan=True), name
    assert np.allclose(got.f5_path_efficiency_6, np.where(size > 1e-15, r.rolling(6).sum().abs() / size, 0.0))
    assert len(features.fine_set().names()) == 49 and len(fusion.view("MR").names) == 83


def test_preflight_gaps_dedupe_and_conflicts(spark):
    rows = [(100, 101, 99, 100.5), (101, 102, 100, 101.5), (102, 103, 101, 102.5)]
    report = quality.preflight(frame(spark, rows, skip=(1,)), 30).first()
    assert report.passed and (report.n_gaps, report.n_missing) == (1, 1)
    one = frame(spark, rows)
    merged, dropped = bars.merge(one, one.filter(F.col("open") == 101))
    assert (merged.count(), dropped) == (3, 1)
    with pytest.raises(ValueError, match="conflicting"):
        bars.merge(one, one.withColumn("close", F.col("close") + 0.1))
    with pytest.raises(ValueError):
        quality.assert_preflight(one.withColumn("low", F.lit(-1.0)), 30)
    ordered = one.withColumn("k", F.lit(1) - F.row_number().over(__import__("pyspark").sql.Window.orderBy("open_time")))
    assert quality.unordered(ordered, "k").count() == 2


def test_archives_and_klines(spark, tmp_path):
    assert archives.Archive("BTCUSDT", "30m", dt.date(2024, 1, 1)).url("http://x/data").endswith("/monthly/indexPriceKlines/BTCUSDT/30m/BTCUSDT-30m-2024-01.zip")
    store: dict[str, bytes] = {}

    def archive(lines):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("a.csv", "\n".join(lines))
        return out.getvalue()

    base, day = "http://x", dt.date(2024, 1, 1)
    head = "open_time,open,high,low,close,volume,close_time,quote_volume"
    for name, lines in (("2024-01-01", [head, "1704067200000,100,101,99,100.5,0,1704068999999,0"]), ("2024-01-02", ["1704069000,100.5,102,100,101,0,1704070799.999"])):
        url = archives.Archive("BTCUSDT", "30m", dt.date.fromisoformat(name), True).url(base)
        store[url] = archive(lines)
        store[url + ".CHECKSUM"] = f"{archives.sha256(store[url])}  x.zip".encode()

    def fetch(url):
        if url not in store:
            raise archives.ArchiveNotFound(url)
        return store[url]

    root = str(tmp_path / "raw")
    paths = archives.download_range("BTCUSDT", "30m", day, dt.date(2024, 1, 2), base, root, fetch)
    assert len(paths) == 2 and archives.download(archives.Archive("BTCUSDT", "30m", day, True), base, root, fetch)[1]
    assert archives.verified(spark, root).filter("ok").count() == 2
    parsed = klines.parse_lines(archives.zip_lines(spark, root))
    klines.assert_parsed(parsed)
    got = sorted((r.open_time, r.close, r.close_time) for r in parsed.collect())
    assert got[0] == (dt.datetime(2024, 1, 1), 100.5, dt.datetime(2024, 1, 1, 0, 29, 59, 999000)) and got[1][0] == dt.datetime(2024, 1, 1, 0, 30)
    assert klines.prepare(spark, root, "BTCUSDT", 30, "2024-01-01", "2024-01-01", str(tmp_path / "bars")) == 0
    assert spark.read.parquet(str(tmp_path / "bars")).count() == 2
    bad = archives.Archive("BTCUSDT", "5m", day, True)
    store[bad.url(base)], store[bad.url(base) + ".CHECKSUM"] = b"x", b"0" * 64
    with pytest.raises(archives.ChecksumError):
        archives.download(bad, base, root, fetch)
    with pytest.raises(ValueError):
        klines.assert_parsed(parsed.withColumn("close", F.lit(None).cast("double")))


def scored(spark, pairs):
    return spark.createDataFrame([(int(y), float(p)) for y, p in pairs], "y int, p double")


def test_metrics(spark):
    got = metrics.probability_metrics(scored(spark, [(1, 0.9), (0, 0.1), (1, 0.8), (0, 0.2)])).first()
    assert (got.roc_auc, got.accuracy_at_0_5, round(got.brier_score, 12), got.mean_probability) == (1.0, 1.0, 0.025, 0.5)
    bins = metrics.reliability(scored(spark, [(k % 2, 0.05 + 0.1 * k) for k in range(10)])).orderBy("bin_lower").collect()
    assert [b.n_rows for b in bins] == [1] * 10 and (bins[0].bin_range, bins[-1].bin_range) == ("[0.0, 0.1)", "[0.9, 1.0]")
    q = {r.threshold_q: r for r in metrics.confidence(scored(spark, [(1, 0.75), (0, 0.2), (1, 0.5)])).collect()}[0.70]
    assert (q.long_count, q.long_actual_up_rate, q.short_count, q.short_actual_down_rate, q.combined_count, q.combined_hit_rate) == (1, 1, 1, 1, 2, 1)
    rng = np.random.default_rng(3)
    p, y = np.round(rng.random(300), 2), rng.integers(0, 2, 300)
    wanted = np.mean([(a > b) + (a == b) / 2 for a in p[y == 1] for b in p[y == 0]])
    assert abs(metrics.auc(scored(spark, zip(y, p, strict=True))).first().roc_auc - wanted) < 1e-12
    assert metrics.auc(scored(spark, [(1, 0.3)])).first().roc_auc == 0.5
    assert metrics.probability_metrics(scored(spark, []).limit(0)).count() == 0


def test_payout_and_parameters():
    p = Payout(10, 18.5)
    assert (p.win, p.loss, round(p.break_even, 6)) == (8.5, -10, 0.540541)
    for bad in ((0, 1), (5, 5), (True, 9), (5, float("nan"))):
        with pytest.raises(ValueError):
            Payout(*bad)
    with pytest.raises(ValueError):
        SignalParams(range_entry_z=2.5)
    assert (interval_minutes("5m"), interval_minutes("1h")) == (5, 60)
    for bad in ("0m", "x", "5s"):
        with pytest.raises(ValueError):
            interval_minutes(bad)
    check_timeframes(15, 60)
    with pytest.raises(ValueError):
        check_timeframes(30, 60)


def settled(spark, entry, seen, opens, direction=1, price=100.0):
    entries = spark.createDataFrame([("S", 1, direction, 1, entry, price)], "symbol string, event_id long, direction int, mode int, entry_time timestamp_ntz, entry_price double")
    obs = spark.createDataFrame([("S", t, c, b) for t, c, b in seen] or [], "symbol string, obs_time timestamp_ntz, close double, bar_open timestamp_ntz")
    chart = spark.createDataFrame([("S", t) for t in opens], "symbol string, open_time timestamp_ntz")
    return {r.horizon: r for r in settlement.settle(entries, obs, chart).collect()}


def test_settlement(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    seen = [(at(46), 99.0, at(45)), (at(48), 101.0, at(45)), (at(78), 100.0, at(75))]
    got = settled(spark, at(17), seen, [at(15 * k) for k in range(8)])
    assert (got[30].target_time, got[60].target_time) == (at(47), at(77))
    assert (got[30].result, got[30].settle_price, got[30].timing_error_seconds, got[30].pnl) == ("WIN", 101, 60, 4.25)
    assert (got[60].result, got[60].pnl) == ("LOSS", -5)  # equality loses
    short = settled(spark, at(17), seen, [at(15 * k) for k in range(8)], direction=-1)
    assert (short[30].result, short[60].result) == ("LOSS", "LOSS")
    none = settled(spark, at(17), [], [at(15 * k) for k in range(8)])
    assert {r.result for r in none.values()} == {"UNRESOLVED"} and none[30].pnl is None
    waiting = settled(spark, at(17), seen[:1], [at(15 * k) for k in range(4)])
    assert waiting[60].result == "ACTIVE"


class Bar:
    def __init__(self, index, close, **more):
        base = {
            "symbol": "S", "bar_index": index, "open_time": None, "open": close, "high": close, "low": close, "close": close, "prev_close": close, "mean": 100.0, "std": 1.0,
            "safe_atr": 1.0, "z": close - 100.0, "prev_z": 0.0, "veto": False, "range_env": True, "shock_env": True, "htf_slope": 0.0, "local_slope": 0.0, "shock_up": False,
            "shock_down": False, "slowing": True, "long_rejection": True, "short_rejection": True, "half_life": float("nan"),
        }
        self.__dict__ |= base | more


def steps(machine, *given):
    out = []
    for bar in given:
        machine.step(bar)
        out += [(e[1], e[3], e[6]) for e in machine.events]
        machine.events.clear()
    return out


def entered(**params):
    m = lifecycle.close_machine(SignalParams(**params))
    assert steps(m, Bar(0, 98.0), Bar(1, 98.5, prev_close=98.0, prev_z=-2.0)) == [(0, "SETUP", None), (1, "ENTRY", None)]
    return m


def test_close_engine_decides_in_order():
    t = entered().trade
    assert (t.partial, t.final) == (99.2, 99.75) and t.time_stop == 24
    worst = {"htf_slope": -1.0}
    assert steps(entered(), Bar(30, 90.0, **worst)) == [(30, "EXIT", "STOP")]
    assert steps(entered(), Bar(30, 99.9, **worst)) == [(30, "EXIT", "TREND")]
    assert steps(entered(), Bar(30, 99.9)) == [(30, "EXIT", "TIMEOUT")]
    m = entered()
    assert steps(m, Bar(2, 99.9), Bar(3, 99.9)) == [(2, "TRIM", None), (3, "EXIT", "FINAL")]
    even = entered()
    assert steps(even, Bar(2, 99.3), Bar(3, 98.53), Bar(4, 98.52)) == [(2, "TRIM", None), (3, "EXIT", "BREAKEVEN")]


def test_cooldown_and_setup_rules():
    m = entered()
    steps(m, Bar(10, 90.0))
    assert steps(m, Bar(11, 98.0), Bar(12, 98.0)) == [] and steps(m, Bar(13, 98.0)) == [(13, "SETUP", None)]
    assert steps(m, Bar(14, 98.0, shock_down=True)) == []  # a live setup of the same direction stays
    assert steps(m, Bar(15, 102.0)) == [(15, "SETUP", None)] and m.setup.direction == -1
    steps(m, Bar(32, 100.0))
    assert m.setup is None
    steps(m, Bar(33, 96.0))
    assert m.setup is None  # beyond the stop level at once


def test_stop_limit_and_order_engine():
    bar = lambda o, h, low, c: Bar(1, c, open=o, high=h, low=low)
    assert lifecycle.stop_limit_fill(1, 99, 99, bar(98.5, 99.5, 98, 99)) == 99
    assert lifecycle.stop_limit_fill(1, 99, 99, bar(99.5, 99.6, 99.2, 99.4)) is None  # gapped through
    assert lifecycle.stop_limit_fill(1, 99, 99, bar(99.5, 99.6, 98.9, 99.4)) == 99
    assert lifecycle.stop_limit_fill(-1, 101, 101, bar(101.5, 102, 100.5, 101)) == 101
    quantity = SignalParams(trim_percent=90.0)
    m = lifecycle.order_machine(quantity)
    got = steps(m, Bar(0, 98.0), Bar(1, 98.4, open=98.2, high=98.6, low=98.1), Bar(2, 99.5, high=99.5, low=98.4), Bar(3, 99.8, high=99.8, low=99.3))
    assert [e[1] for e in got] == ["SETUP", "PREPLAN_CREATE", "ENTRY_FILLED", "TP1_FILLED", "EXIT_FILLED"] and got[-1][2] == "FINAL" and m.trade is None
    m = lifecycle.order_machine(quantity)
    got = steps(m, Bar(0, 98.0), Bar(1, 98.0, open=98.0, high=98.2), Bar(2, 98.4, open=98.2, high=98.6), Bar(3, 90.0, open=97.0, high=99.9, low=90.0))
    assert [e[1] for e in got] == ["SETUP", "PREPLAN_CREATE", "ENTRY_EXPIRED", "PREPLAN_UPDATE", "ENTRY_FILLED", "EXIT_FILLED"] and got[-1][2] == "STOP"


def test_sinks(tmp_path):
    folder = new_run_folder(str(tmp_path / "run"))
    write_json({"a": 1}, os.path.join(folder, "x.json"))
    with pytest.raises(FileExistsError):
        new_run_folder(folder)
    with pytest.raises(ValueError):
        write_json({"a": float("nan")}, os.path.join(folder, "y.json"))


def test_empty_tables_stay_empty(spark):
    none = frame(spark, walk(3)).limit(0)
    assert labels.candidates(none, 30).count() == 0 and features.build(none, features.coarse_set(), 30).count() == 0 and quality.gaps(none, 30).count() == 0
