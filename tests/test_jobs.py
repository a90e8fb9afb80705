"""Models, the command line, and the entry points."""

import datetime as dt

import numpy as np
import pytest

from barloom import cli
from barloom.operators import model, ordinal


def test_two_stage_training(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    rows = [("S", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=30 * k), float(v), int(v + rng.normal(0, 0.3) > 0)) for k, v in enumerate(x)]
    train = spark.createDataFrame(rows, "symbol string, prediction_time timestamp_ntz, x double, target_up int")
    fitted = model.train_two_stages(train, ["x"], model.BoostedTrees, trees=4, depth=2)
    p = [r.predicted_probability_up for r in fitted.predict(train).collect()]
    assert all(0 <= v <= 1 for v in p) and fitted.importance()[0][0] == "x" and 1 <= fitted.best <= 4
    with pytest.raises(ValueError):
        model.check_targets(train.withColumn("target_up", train.target_up + 2))
    with pytest.raises(ValueError):
        model.register(" boosted_trees ", model.BoostedTrees)
    assert isinstance(model.make_model("boosted_trees", trees=1), model.BoostedTrees)


def test_row_numbers_across_buckets(spark):
    rows = [("S", dt.datetime(2024, 1, 1) + dt.timedelta(days=9 * k), k) for k in range(12)]
    df = spark.createDataFrame(rows, "symbol string, open_time timestamp_ntz, k long")
    assert all(r.row == r.k for r in ordinal.with_row_number(df, ("symbol",)).collect())


def test_command_line(capsys):
    with pytest.raises(SystemExit) as stopped:
        cli.main(["unknown"])
    assert stopped.value.code == 2
    with pytest.raises(SystemExit) as helped:
        cli.main(["--help"])
    assert helped.value.code == 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streaks_and_drawdown_over_days(spark):
    """Runs and falls that go over midnight, against a loop over the whole series."""
    import random

    from barloom.operators import settlement

    dice, rows, wanted = random.Random(5), [], {}
    for horizon, odds in ((30, 0.5), (60, 0.9), (90, 0.0), (120, 1.0)):
        start, equity, peak, fall, run, before, best = dt.datetime(2024, 1, 1), 0.0, 0.0, 0.0, 0, None, {"WIN": 0, "LOSS": 0}
        for k in range(200):
            result = "WIN" if dice.random() < odds else "LOSS"
            start += dt.timedelta(minutes=dice.choice((0, 30, 300, 3000)))
            pnl = 0.8 if result == "WIN" else -1.0
            rows.append(("A", horizon, 1000 - k, result, start, pnl))
            equity += pnl
            peak = max(peak, equity)
            fall = max(fall, peak - equity)
            run = run + 1 if result == before else 1
            before, best[result] = result, max(best[result], run)
        wanted[horizon] = (best["WIN"], best["LOSS"], round(equity, 6), round(peak, 6), round(fall, 6))
    rows.append(("A", 30, 1, "ACTIVE", None, None))
    given = spark.createDataFrame(rows, "symbol string, horizon int, event_id long, result string, settle_bar timestamp, pnl double")
    both = settlement.streaks(given).join(settlement.drawdown(given), ["symbol", "horizon"]).collect()
    assert {r.horizon: (r.max_wins, r.max_losses, round(r.net_pnl, 6), round(r.peak_equity, 6), round(r.max_drawdown, 6)) for r in both} == wanted
    assert settlement.streaks(given.limit(0)).count() == settlement.drawdown(given.limit(0)).count() == 0
