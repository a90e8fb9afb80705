"""The signal and trade lifecycle, one bar after the other per symbol.

The state of a symbol after a bar depends on all bars before it, so a symbol is one sorted run of
rows. Rows stream through a task in batches; only the state of the symbol at hand is kept, so
memory doesn't grow with the history. The same machines serve streams (barloom.streaming).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import SignalParams

RANGE, SHOCK = 1, 2
EVENT_SCHEMA = "symbol string, bar_index long, open_time timestamp_ntz, event string, direction int, mode int, reason string, price double, quantity double, pnl_atr double, pnl_pct double"
EVENT_COLUMNS = [part.split()[0] for part in EVENT_SCHEMA.split(", ")]
BAR_INPUT = [
    "symbol", "bar_index", "open_time", "open", "high", "low", "close", "prev_close", "mean", "std", "safe_atr", "z", "prev_z", "veto", "range_env", "shock_env",
    "htf_slope", "local_slope", "shock_up", "shock_down", "slowing", "long_rejection", "short_rejection", "half_life",
]


@dataclass
class Setup:
    bar: int
    direction: int
    mode: int


@dataclass
class Machine:
    """What both engines share: when a setup comes, ages and fails."""

    params: SignalParams
    setup: Setup | None = None
    last_exit: int | None = None
    uses_cooldown: bool = True
    events: list[tuple] = field(default_factory=list)

    def say(self, bar, event: str, direction: int, mode: int, price: float, reason: str | None = None, quantity: float | None = None, pnl: tuple[float, float] | None = None) -> None:
        self.events.append((bar.symbol, bar.bar_index, bar.open_time, event, direction, mode, reason, price, quantity, *(pnl or (None, None))))

    def cooled(self, bar) -> bool:
        return not self.uses_cooldown or self.last_exit is None or bar.bar_index - self.last_exit >= max(self.params.cooldown, 1)

    def seek(self, bar) -> None:
        """The first setup that applies, shocks before ranges; the opposite direction replaces a live one."""
        p, live = self.params, self.setup.direction if self.setup else 0
        for direction, mode in ((1, SHOCK), (-1, SHOCK), (1, RANGE), (-1, RANGE)):
            allowed = p.allow_long if direction > 0 else p.allow_short
            if not allowed or live == direction:
                continue
            reach = -direction * bar.z >= (p.shock_entry_z if mode == SHOCK else p.range_entry_z)
            if mode == SHOCK:
                moved = bar.shock_down if direction > 0 else bar.shock_up
                rejected = bar.long_rejection if direction > 0 else bar.short_rejection
                fits = bar.shock_env and moved and bar.slowing and rejected
            else:
                fits = bar.range_env
            if reach and fits:
                self.setup = Setup(bar.bar_index, direction, mode)
                self.say(bar, "SETUP", direction, mode, bar.close)
                return

    def age(self, bar) -> None:
        if self.setup:
            limit = self.params.shock_setup_bars if self.setup.mode == SHOCK else self.params.range_setup_bars
            if bar.bar_index - self.setup.bar > limit or self.setup.direction * bar.z <= -self.params.stop_z:
                self.setup = None

    def levels(self, mode: int) -> tuple[float, float, float]:
        p = self.params
        return (p.shock_entry_z, p.shock_partial_z, p.shock_exit_z) if mode == SHOCK else (p.range_entry_z, p.range_partial_z, p.range_exit_z)

    def stop_price(self, direction: int, entry: float, atr: float, mean: float, std: float) -> float:
        p = self.params
        both = (entry - direction * p.hard_stop_atr * atr, mean - direction * p.stop_z * std)
        tight, loose = (max(both), min(both)) if direction > 0 else (min(both), max(both))
        return {"Tight": tight, "Loose": loose}.get(p.stop_mode, loose + (tight - loose) * p.balanced_weight)

    def time_stop(self, half_life: float) -> int:
        p = self.params
        raw = half_life * p.time_stop_multiplier if half_life == half_life else p.fallback_time_stop
        return int(min(p.max_time_stop, max(p.min_time_stop, raw)) + 0.5)

    def trend_failed(self, bar, direction: int) -> bool:
        return direction * bar.htf_slope <= -self.params.veto_htf_slope or direction * bar.local_slope <= -self.params.veto_local_slope


@dataclass
class Trade:
    direction: int
    mode: int
    bar: int
    price: float
    atr: float
    partial: float
    final: float
    stop: float
    even: float
    time_stop: int
    trimmed: bool = False
    quantity: float = 1.0


class CloseMachine(Machine):
    """Decides and fills at confirmed closes."""

    trade: Trade | None = None

    def step(self, bar) -> None:
        if self.trade is None and self.cooled(bar):
            self.seek(bar)
        self.age(bar)
        if self.trade is None and self.setup and not bar.veto and self.confirmed(bar):
            self.enter(bar)
        elif self.trade and bar.bar_index > self.trade.bar:
            self.manage(bar)

    def confirmed(self, bar) -> bool:
        p, d = self.params, self.setup.direction
        level = self.levels(self.setup.mode)[0]
        crossed = d * bar.z > -level and d * bar.prev_z <= -level
        inside = d * (bar.close - (bar.mean - d * level * bar.std)) > 0
        turned = d * (bar.close - bar.prev_close) > 0
        return crossed and (inside or not p.require_band) and (turned or not p.require_candle)

    def enter(self, bar) -> None:
        d, mode, p = self.setup.direction, self.setup.mode, self.params
        _, partial, final = self.levels(mode)
        stop = self.stop_price(d, bar.close, bar.safe_atr, bar.mean, bar.std)
        cost = bar.close * 2 * p.commission_bps / 10000
        better = max if d > 0 else min
        even = better(stop, bar.close + d * cost) if p.break_even else stop
        self.trade = Trade(d, mode, bar.bar_index, bar.close, bar.safe_atr, bar.mean - d * partial * bar.std, bar.mean - d * final * bar.std, stop, even, self.time_stop(bar.half_life))
        self.setup = None
        self.say(bar, "ENTRY", d, mode, bar.close)

    def manage(self, bar) -> None:
        """At most one decision a bar: stop, trend, time, trim, final."""
        t = self.trade
        d = t.direction
        if d * (bar.close - (t.even if t.trimmed else t.stop)) <= 0:
            self.leave(bar, "BREAKEVEN" if t.trimmed and self.params.break_even else "STOP")
        elif self.trend_failed(bar, d):
            self.leave(bar, "TREND")
        elif bar.bar_index - t.bar >= t.time_stop:
            self.leave(bar, "TIMEOUT")
        elif not t.trimmed and d * (bar.close - t.partial) >= 0:
            t.trimmed = True
            self.say(bar, "TRIM", d, t.mode, bar.close)
        elif t.trimmed and d * (bar.close - t.final) >= 0:
            self.leave(bar, "FINAL")

    def leave(self, bar, reason: str) -> None:
        t = self.trade
        net = (bar.close - t.price) * t.direction - t.price * 2 * self.params.commission_bps / 10000
        self.say(bar, "EXIT", t.direction, t.mode, bar.close, reason, pnl=(net / t.atr, net / t.price * 100))
        self.trade, self.setup, self.last_exit = None, None, bar.bar_index


@dataclass
class Plan:
    direction: int
    mode: int
    valid_bar: int
    trigger: float
    limit: float
    mean: float
    std: float
    atr: float
    half_life: float


def stop_limit_fill(direction: int, trigger: float, limit: float, bar) -> float | None:
    """Price at which a stop-limit order fills within a bar, if it does.

    At or beyond the trigger at the open it is a limit order from there on; else it fills at the
    trigger once that trades. Shorts mirror longs.
    """
    reach = bar.high if direction > 0 else bar.low
    back = bar.low if direction > 0 else bar.high
    if direction * (bar.open - trigger) >= 0:
        if direction * (limit - bar.open) >= 0:
            return bar.open
        return limit if direction * (limit - back) >= 0 else None
    return trigger if direction * (reach - trigger) >= 0 else None


class OrderMachine(Machine):
    """Plans a stop-limit entry at a close for the next bar; exits by price orders, trend or time.

    Within a bar the stop is taken before targets; on the entry bar a target counts only if the
    close has reached it. A decided exit fills at the next open.
    """

    trade: Trade | None = None
    plan: Plan | None = None
    leaving: str | None = None

    def tick(self, value: float) -> float:
        return round(value / self.params.tick) * self.params.tick

    def step(self, bar) -> None:
        if self.trade and self.leaving:
            self.fill_exit(bar, bar.open, self.leaving)
        entered = self.fill_entry(bar)
        if self.trade:
            self.fill_orders(bar, entered)
        replaced = False
        if self.plan and self.plan.valid_bar == bar.bar_index and not self.trade:
            self.say(bar, "ENTRY_EXPIRED", self.plan.direction, self.plan.mode, self.plan.limit)
            self.plan, replaced = None, True
        if self.trade is None and self.cooled(bar):
            self.seek(bar)
        self.age(bar)
        t = self.trade
        if t and bar.bar_index > t.bar and not self.leaving:
            if self.trend_failed(bar, t.direction):
                self.leaving = "TREND"
            elif bar.bar_index >= t.bar + t.time_stop:
                self.leaving = "TIMEOUT"
            if self.leaving:
                self.say(bar, "EXIT_DECISION", t.direction, t.mode, bar.close, self.leaving)
        if self.trade is None and self.setup:
            self.make_plan(bar, replaced)
        elif self.plan:
            self.say(bar, "PREPLAN_CANCEL", self.plan.direction, self.plan.mode, self.plan.limit)
            self.plan = None

    def make_plan(self, bar, replaced: bool) -> None:
        d, mode = self.setup.direction, self.setup.mode
        trigger = self.tick(bar.mean - d * self.levels(mode)[0] * bar.std)
        limit = self.tick(trigger + d * self.params.limit_offset_ticks * self.params.tick)
        self.plan = Plan(d, mode, bar.bar_index + 1, trigger, limit, bar.mean, bar.std, bar.safe_atr, bar.half_life)
        self.say(bar, "PREPLAN_UPDATE" if replaced else "PREPLAN_CREATE", d, mode, trigger)

    def fill_entry(self, bar) -> bool:
        plan = self.plan
        if plan is None or self.trade or plan.valid_bar != bar.bar_index:
            return False
        price = stop_limit_fill(plan.direction, plan.trigger, plan.limit, bar)
        if price is None:
            return False
        self.plan, self.setup = None, None
        self.on_entry(bar, plan, price)
        return True

    def on_entry(self, bar, plan: Plan, price: float) -> None:
        p, d = self.params, plan.direction
        _, partial, final = self.levels(plan.mode)
        stop = self.tick(self.stop_price(d, price, plan.atr, plan.mean, plan.std))
        cost = price * 2 * p.commission_bps / 10000 + 2 * p.slippage_ticks * p.tick
        better = max if d > 0 else min
        even = better(stop, self.tick(price + d * cost)) if p.break_even else stop
        self.trade = Trade(
            d, plan.mode, bar.bar_index, price, plan.atr, self.tick(plan.mean - d * partial * plan.std), self.tick(plan.mean - d * final * plan.std), stop, even, self.time_stop(plan.half_life),
        )
        self.say(bar, "ENTRY_FILLED", d, plan.mode, price, quantity=1.0)

    def fill_orders(self, bar, entered: bool) -> None:
        t = self.trade
        d = t.direction
        worst = bar.low if d > 0 else bar.high
        best = bar.close if entered else bar.high if d > 0 else bar.low
        stop = t.even if t.trimmed else t.stop
        if d * (worst - stop) <= 0:
            gapped = not entered and d * (bar.open - stop) < 0
            self.fill_exit(bar, bar.open if gapped else stop, "BREAKEVEN" if t.trimmed and self.params.break_even else "STOP")
            return
        if not t.trimmed and d * (best - t.partial) >= 0:
            sold = t.quantity * self.params.trim_percent / 100
            t.trimmed, t.quantity = True, t.quantity - sold
            self.say(bar, "TP1_FILLED", d, t.mode, t.partial, quantity=sold)
            if t.quantity <= 0:
                self.finish(bar)
                return
        if t.trimmed and d * (best - t.final) >= 0:
            self.fill_exit(bar, t.final, "FINAL")

    def fill_exit(self, bar, price: float, reason: str) -> None:
        t = self.trade
        net = (price - t.price) * t.direction - t.price * 2 * self.params.commission_bps / 10000
        self.say(bar, "EXIT_FILLED", t.direction, t.mode, price, reason, t.quantity, (net / t.atr, net / t.price * 100))
        self.finish(bar)

    def finish(self, bar) -> None:
        self.trade, self.setup, self.leaving, self.last_exit = None, None, None, bar.bar_index


class EventMachine(OrderMachine):
    """Only entries matter: each fill is an event, and its probe position is released at once."""

    def on_entry(self, bar, plan: Plan, price: float) -> None:
        self.say(bar, "EVENT", plan.direction, plan.mode, price)


def close_machine(params: SignalParams) -> Machine:
    return CloseMachine(params)


def order_machine(params: SignalParams) -> Machine:
    return OrderMachine(params)


def event_machine(params: SignalParams) -> Machine:
    return EventMachine(params, uses_cooldown=False)


def run(rows: DataFrame, make: Callable[[SignalParams], Machine], params: SignalParams = SignalParams()) -> DataFrame:
    """Events of every symbol's machine over the rows of ``indicators``."""
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, machine = None, None
        for batch in batches:
            out: list[tuple] = []
            for bar in batch.itertuples(index=False):
                if machine is None or bar.symbol != symbol:
                    symbol, machine = bar.symbol, make(params)
                machine.step(bar)
                out += machine.events
                machine.events.clear()
            if out:
                yield pd.DataFrame(out, columns=EVENT_COLUMNS)

    numbers = ["prev_close", "mean", "std", "safe_atr", "z", "prev_z", "htf_slope", "local_slope", "half_life"]
    given = rows.select(BAR_INPUT).withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in numbers}).withColumn("open_time", F.col("open_time").cast("timestamp_ntz"))
    return given.repartition("symbol").sortWithinPartitions("symbol", "open_time").mapInPandas(walk, EVENT_SCHEMA)
