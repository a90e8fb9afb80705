"""Settlement of a feed in parts, and the number of active events."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators import settlement
from barloom.streaming import jobs

T0 = datetime(2024, 1, 1)
FEED = "symbol string, ts timestamp, event_id long, direction int, price double"


def made_feed(seed=3, minutes=900):
    """Entries and observations in the order they come, some late; the last row only moves the clock."""
    pick = random.Random(seed)
    rows = []
    for k in range(400):
        at = T0 + timedelta(minutes=pick.randint(0, minutes), seconds=pick.randint(0, 59))
        symbol = pick.choice("aaab")
        rows.append((at + timedelta(minutes=pick.randint(0, 15)), (symbol, at, None, None, float(pick.randint(90, 110)))))
        if k % 4 == 0:
            rows.append((at + timedelta(minutes=pick.randint(0, 15)), (symbol, at, k, pick.choice([1, -1]), 100.0)))
    rows = [r for _, r in sorted(rows, key=lambda x: x[0])]
    return [*rows, rows[7], ("z", T0 + timedelta(days=9), None, None, 1.0)]


def plain_results(rows, limit, horizons=(30, 60)):
    out = set()
    for symbol, at, event, direction, price in rows:
        for h in horizons if event is not None else ():
            due = at + timedelta(minutes=h)
            seen = [(t, p) for s, t, e, _, p in rows if e is None and s == symbol and due <= t <= due + timedelta(minutes=limit)]
            if seen:
                t, p = min(seen)
                won = (p - price) * direction > 0
                out.add((symbol, event, h, due, "WIN" if won else "LOSS", p, t, 4.25 if won else -5.0))
            else:
                out.add((symbol, event, h, due, "UNRESOLVED", None, None, None))
    return out


def stream_of(spark, folder):
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(folder)


def append(spark, rows, folder, parts):
    size = -(-len(rows) // parts)
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], FEED).coalesce(1).write.mode("append").parquet(folder)


def test_parts_late_rows_and_a_restart_give_the_same_results(spark, tmp_path):
    rows, feed, at = made_feed(), str(tmp_path / "feed"), str(tmp_path / "run")
    half = len(rows) // 2
    run = lambda: jobs.run_available(jobs.live_settlement(stream_of(spark, feed), limit=5, delay="20 minutes"), "live", at)
    append(spark, rows[:half], feed, 3)
    first = run().count()
    append(spark, rows[half:], feed, 3)
    got = [tuple(r) for r in run().collect()]
    want = plain_results(rows, 5)
    assert 0 < first < len(got) == len(set(got))
    assert set(got) == want
    assert {r[4] for r in want} == {"WIN", "LOSS", "UNRESOLVED"}


def test_the_limit_is_inclusive_and_equality_loses(spark, tmp_path):
    m = lambda k: T0 + timedelta(minutes=k)
    rows = [("s", m(0), 1, 1, 10.0), ("s", m(35), None, None, 11.0), ("s", m(60), None, None, 10.0), ("t", m(0), 2, -1, 10.0), ("t", m(36), None, None, 1.0), ("s", m(9000), None, None, 0.0)]
    append(spark, rows, str(tmp_path / "feed"), 1)
    got = jobs.run_available(jobs.live_settlement(stream_of(spark, str(tmp_path / "feed")), limit=5), "live", str(tmp_path / "run")).collect()
    assert {(r.event_id, r.horizon, r.result, r.pnl) for r in got} == {(1, 30, "WIN", 4.25), (1, 60, "LOSS", -5.0), (2, 30, "UNRESOLVED", None), (2, 60, "UNRESOLVED", None)}


def test_active_events_are_swept_by_day(spark):
    pick = random.Random(5)
    rows, events = [], {}
    for k in range(200):
        entry = T0 + timedelta(hours=pick.randint(0, 90))
        ends = [None if pick.random() < 0.03 else entry + timedelta(hours=pick.choice([0, 1, 3, 40])) for _ in range(2)]
        symbol = pick.choice("ab")
        events[k] = (symbol, entry, None if None in ends else max(ends))
        rows += [(symbol, k, entry, h, end) for h, end in zip((30, 60), ends, strict=True)]
    settled = spark.createDataFrame(rows, "symbol string, event_id long, entry_time timestamp, horizon int, done_bar timestamp")
    counts = {}
    for symbol in "ab":
        own = [e[1:] for e in events.values() if e[0] == symbol]
        for t in sorted({t for e in own for t in e if t}):
            counts[symbol, t] = sum(a <= t and (b is None or b > t) for a, b in own)
    assert {(r.symbol, r.time): r.n_active for r in settlement.active_counts(settled).collect()} == counts
    peak = {r.symbol: (r.max_active, r.reached) for r in settlement.active_peak(settled).collect()}
    for symbol in "ab":
        most = max(n for (s, _), n in counts.items() if s == symbol)
        assert peak[symbol] == (most, min(t for (s, t), n in counts.items() if s == symbol and n == most))
    top = max(n for n, _ in peak.values())
    settlement.check_active_limit(settled, top)
    with pytest.raises(ValueError, match="more than"):
        settlement.check_active_limit(settled, top - 1)
    assert settlement.active_peak(settled.filter(F.lit(False))).count() == 0
