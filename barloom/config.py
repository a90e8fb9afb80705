"""Run configurations: YAML or mappings, completed by defaults and checked by a table of rules."""

from __future__ import annotations

import copy
import datetime as dt
from collections.abc import Callable, Mapping
from typing import Any

import yaml

from .params import Payout, Ratios, number

Rule = Callable[[str, Any], None]


class ConfigError(ValueError):
    """A configuration that cannot be run."""


def one_of(*allowed: Any) -> Rule:
    def rule(path: str, value: Any) -> None:
        if not any(value == a and type(value) is type(a) for a in allowed):
            raise ConfigError(f"{path} must be {' or '.join(map(repr, allowed))}")

    return rule


def between(low: float, high: float = float("inf"), inner: bool = False, null: bool = False, whole: bool = False) -> Rule:
    """A number from ``low`` to ``high``, without these if ``inner``; null only if allowed."""
    def rule(path: str, value: Any) -> None:
        if value is None and null:
            return
        try:
            v = number(path, value)
        except ValueError as problem:
            raise ConfigError(str(problem)) from None
        outside = not low < v < high if inner else not low <= v <= high
        if outside or whole and not isinstance(value, int):
            raise ConfigError(f"{path} must be {'a whole number ' if whole else ''}between {low} and {high}")

    return rule


def date(path: str, value: Any) -> None:
    try:
        dt.date.fromisoformat(str(value))
    except ValueError:
        raise ConfigError(f"{path} must be a date") from None


def flag(path: str, value: Any) -> None:
    if not isinstance(value, bool):
        raise ConfigError(f"{path} must be true or false")


# The fields of a run, what each may be, and the ones that have a default.
RULES: dict[str, Rule] = {
    "project.seed": between(-(2**63), 2**63, whole=True),
    "data.source": one_of("binance_public_data"), "data.market": one_of("usd_m_futures"), "data.series": one_of("index_price_klines"),
    "data.symbol": one_of("BTCUSDT"), "data.interval": one_of("30m"), "data.timezone": one_of("UTC"),
    "data.intervals.fine": one_of("5m"), "data.intervals.coarse": one_of("30m"), "data.start_date": date, "data.end_date": date,
    "target.type": one_of("binary_direction"), "target.horizon_minutes": one_of(30, 30.0), "target.entry_price": one_of("next_bar_open"), "target.expiry_price": one_of("next_bar_close"),
    "split.method": one_of("chronological"), "split.train_ratio": between(0, inner=True), "split.validation_ratio": between(0, inner=True),
    "split.test_ratio": between(0, inner=True), "split.purge_minutes": between(0),
    "prediction.frequency_minutes": one_of(30, 30.0), "calibration.method": one_of("none", "platt", "isotonic"),
    "signal.long_probability_threshold": between(0, 1, null=True), "signal.short_probability_threshold": between(0, 1, null=True),
    "signal.cooldown_minutes": between(0, null=True), "signal.rearm_probability_threshold": between(0, 1, null=True),
    "features.set": one_of("price_ohlc_v1", "price_multires_v1"), "features.max_lag_bars": one_of(48), "features.require_contiguous_history": flag,
    "features.fine_interval": one_of("5m"), "features.coarse_interval": one_of("30m"), "features.fine_max_lookback_bars": one_of(288), "features.coarse_max_lookback_bars": one_of(48),
    "training.early_stopping.enabled": flag, "training.early_stopping.internal_fraction": between(0, 1, inner=True), "training.early_stopping.purge_minutes": between(0),
    "training.early_stopping.stopping_rounds": between(1, whole=True), "training.early_stopping.metric": one_of("binary_logloss"),
    "event.horizon_minutes": between(0, inner=True), "event.stake_usdt": between(0, inner=True), "event.winning_total_return_usdt": between(0, inner=True),
}
DEFAULTS = {
    "data.intervals.fine": "5m", "data.intervals.coarse": "30m", "features.fine_interval": "5m", "features.coarse_interval": "30m",
    "features.fine_max_lookback_bars": 288, "features.coarse_max_lookback_bars": 48,
}


def lookup(config: Mapping[str, Any], path: str) -> Any:
    at: Any = config
    for key in path.split("."):
        if not isinstance(at, Mapping) or key not in at:
            raise ConfigError(f"missing field: {path}")
        at = at[key]
    return at


def resolve(given: Mapping[str, Any]) -> dict[str, Any]:
    """A checked copy with defaults and the payout's derived values."""
    config = copy.deepcopy(dict(given))
    for path, value in DEFAULTS.items():
        *parents, last = path.split(".")
        at = config
        for key in parents:
            at = at.setdefault(key, {})
            if not isinstance(at, dict):
                raise ConfigError(f"{key} must be a mapping")
        at.setdefault(last, value)
    for path, rule in RULES.items():
        rule(path, lookup(config, path))
    get = lambda path: lookup(config, path)
    if get("event.horizon_minutes") != get("target.horizon_minutes"):
        raise ConfigError("event and target horizons differ")
    if get("split.purge_minutes") < get("target.horizon_minutes"):
        raise ConfigError("the purge is shorter than the horizon")
    if str(get("data.start_date")) >= str(get("data.end_date")):
        raise ConfigError("the start date is not before the end date")
    try:
        Ratios(*(float(get(f"split.{part}_ratio")) for part in ("train", "validation", "test")))
        payout = Payout(get("event.stake_usdt"), get("event.winning_total_return_usdt"))
    except ValueError as problem:
        raise ConfigError(str(problem)) from None
    config["event"] |= {"win_pnl": payout.win, "loss_pnl": payout.loss, "break_even": payout.break_even}
    return config


def load(path: str) -> dict[str, Any]:
    try:
        with open(path, encoding="utf-8") as file:
            given = yaml.safe_load(file)
    except (OSError, yaml.YAMLError) as problem:
        raise ConfigError(f"{path}: {problem}") from None
    if not isinstance(given, Mapping):
        raise ConfigError(f"{path}: a mapping is expected")
    return resolve(given)
