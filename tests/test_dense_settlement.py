"""Settlement of dense series: no pairs, no frame that is read anew for every row."""

import random
from datetime import datetime, timedelta

from barloom.operators import settlement
from barloom.streaming import jobs
from tests.test_live_settlement import FEED, T0, append, plain_results, stream_of


def test_a_dense_stream_keeps_a_row_of_state_a_span(spark, tmp_path):
    pick = random.Random(11)
    rows = []
    for k in range(4000):  # two hours of two series, half a second apart, some at one time
        at = T0 + timedelta(seconds=pick.randint(0, 7200))
        entry = k % 50 == 0
        rows.append((pick.choice("ab"), at, k if entry else None, pick.choice([1, -1]) if entry else None, 100.0 if entry else float(pick.randint(90, 110))))
    rows += [rows[0], ("z", T0 + timedelta(days=9), None, None, 1.0)]
    append(spark, rows, str(tmp_path / "feed"), 1)
    made = jobs.live_settlement(stream_of(spark, str(tmp_path / "feed")), limit=40)
    running = made.writeStream.format("memory").queryName("dense_settlement").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    running.awaitTermination()
    got = [tuple(r) for r in spark.table("dense_settlement").collect()]
    assert len(got) == len(set(got)) == 160
    assert set(got) == plain_results(rows, 40)
    assert max(sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in running.recentProgress) <= 10


def test_null_keys_and_prices(spark, tmp_path):
    m = lambda k: T0 + timedelta(minutes=k)
    rows = [
        (None, m(0), 1, 1, 10.0), (None, m(31), None, None, 11.0), ("s", m(0), 2, 1, 10.0), ("s", m(31), None, None, None), ("s", m(61), None, None, float("nan")),
        ("t", m(0), 3, None, 10.0), ("t", m(31), None, None, 12.0), ("s", None, 4, 1, 10.0), ("s", m(9000), None, None, 0.0),
    ]
    append(spark, rows, str(tmp_path / "feed"), 1)
    got = jobs.run_available(jobs.live_settlement(stream_of(spark, str(tmp_path / "feed")), limit=5), "live", str(tmp_path / "run")).collect()
    assert {(r.symbol, r.event_id, r.horizon, r.result, str(r.settle_price)) for r in got} == {
        (None, 1, 30, "UNRESOLVED", "None"), (None, 1, 60, "UNRESOLVED", "None"), ("s", 2, 30, "LOSS", "None"), ("s", 2, 60, "WIN", "nan"),
        ("t", 3, 30, "LOSS", "12.0"), ("t", 3, 60, "UNRESOLVED", "None"),
    }


def test_as_of_frames_only_grow_and_ties_take_the_lowest_value(spark, capsys):
    pick, start = random.Random(2), datetime(2024, 1, 1, 20)
    times = [start + timedelta(minutes=15 * pick.randint(0, 400)) for _ in range(300)]
    seen = [(pick.choice("ab"), t, float(pick.randint(1, 9))) for t in times if t.day != 3]
    due = [(pick.choice("abc"), k, start + timedelta(minutes=5 * pick.randint(0, 1300))) for k in range(200)]
    found = settlement.first_at_or_after(
        spark.createDataFrame(due, "symbol string, id long, due timestamp"), "due", spark.createDataFrame(seen, "symbol string, at timestamp, price double"), "at", ["price"])
    want = {k: min([(t, p) for s2, t, p in seen if s2 == s and t >= d], default=(None, None)) for s, k, d in due}
    assert {r.id: (r.observed_time, r.observed_price) for r in found.collect()} == want
    found.explain()
    assert "unboundedfollowing" not in capsys.readouterr().out.lower()
