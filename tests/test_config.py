import copy

import pytest
import yaml

from barloom import config


def valid():
    out = {}
    values = {
        "project.seed": 2026, "data.source": "binance_public_data", "data.market": "usd_m_futures", "data.series": "index_price_klines", "data.symbol": "BTCUSDT", "data.interval": "30m",
        "data.timezone": "UTC", "data.start_date": "2020-01-01", "data.end_date": "2026-08-31", "target.type": "binary_direction", "target.horizon_minutes": 30, "target.entry_price": "next_bar_open",
        "target.expiry_price": "next_bar_close", "split.method": "chronological", "split.train_ratio": 0.8, "split.validation_ratio": 0.1, "split.test_ratio": 0.1, "split.purge_minutes": 30,
        "prediction.frequency_minutes": 30, "calibration.method": "none", "signal.long_probability_threshold": None, "signal.short_probability_threshold": 0.4, "signal.cooldown_minutes": None,
        "signal.rearm_probability_threshold": None, "features.set": "price_multires_v1", "features.max_lag_bars": 48, "features.require_contiguous_history": True,
        "training.early_stopping.enabled": True, "training.early_stopping.internal_fraction": 0.1, "training.early_stopping.purge_minutes": 30, "training.early_stopping.stopping_rounds": 100,
        "training.early_stopping.metric": "binary_logloss", "event.horizon_minutes": 30, "event.stake_usdt": 10.0, "event.winning_total_return_usdt": 18.5,
    }
    for path, value in values.items():
        *parents, last = path.split(".")
        at = out
        for key in parents:
            at = at.setdefault(key, {})
        at[last] = value
    return out


def test_valid_configurations(tmp_path):
    given = valid()
    got = config.resolve(given)
    assert got["event"]["win_pnl"] == 8.5 and got["features"]["fine_max_lookback_bars"] == 288 and "intervals" not in given["data"]
    path = tmp_path / "run.yaml"
    path.write_text(yaml.safe_dump(given))
    assert config.load(str(path)) == got


@pytest.mark.parametrize(("path", "value"), [
    ("data.symbol", "ETHUSDT"), ("split.purge_minutes", 5), ("split.train_ratio", 0.9), ("event.horizon_minutes", 60), ("calibration.method", "beta"), ("project.seed", True),
    ("signal.long_probability_threshold", 1.5), ("event.winning_total_return_usdt", 9.0), ("data.start_date", "2027-01-01"), ("data.end_date", "soon"), ("features.max_lag_bars", 47),
    ("training.early_stopping.stopping_rounds", 0), ("training.early_stopping.enabled", "yes"), ("training.early_stopping.internal_fraction", 1.0),
])
def test_invalid_values(path, value):
    given = copy.deepcopy(valid())
    *parents, last = path.split(".")
    at = given
    for key in parents:
        at = at[key]
    at[last] = value
    with pytest.raises(config.ConfigError):
        config.resolve(given)


def test_missing_fields_and_files(tmp_path):
    given = valid()
    del given["split"]["method"]
    with pytest.raises(config.ConfigError, match="split.method"):
        config.resolve(given)
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path / "none.yaml"))
