"""DuckDB SQL that must give the same rows as the queries, built from the same parameters."""

from __future__ import annotations

from ..operators.features import FeatureSet, coarse_set, fine_set
from ..params import SignalParams


def ticks(by_type: bool = False) -> str:
    return f"SELECT {'event_type' if by_type else repr('ALL')} AS symbol, ts, 100.0 + value AS price FROM events"


def bars(minutes: int, by_type: bool = False) -> str:
    return f"""SELECT symbol, time_bucket(INTERVAL '{minutes} minutes', ts, TIMESTAMP '1970-01-01') AS open_time, arg_min(price, ts) AS open,
      max(price) AS high, min(price) AS low, arg_max(price, ts) AS close,
      time_bucket(INTERVAL '{minutes} minutes', ts, TIMESTAMP '1970-01-01') + INTERVAL '{minutes} minutes' - INTERVAL 1 MILLISECOND AS close_time
      FROM ({ticks(by_type)}) GROUP BY symbol, open_time"""


def resampled(source: str, minutes: int) -> str:
    return f"""SELECT symbol, o AS open_time, arg_min(open, open_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time) AS close,
      o + INTERVAL '{minutes} minutes' - INTERVAL 1 MILLISECOND AS close_time
      FROM (SELECT *, time_bucket(INTERVAL '{minutes} minutes', open_time, TIMESTAMP '1970-01-01') AS o FROM {source}) GROUP BY symbol, o"""


def rounded(doubles: list[str], others: list[str]) -> str:
    return ", ".join([*others, *[f"round({c}, 6) + 0.0 AS {c}" for c in doubles]])


def candidates(source: str, minutes: int) -> str:
    return f"""SELECT symbol, 'btc-usdt-index-30m-' || strftime(close_time, '%Y%m%dT%H%M%S%fZ') AS sample_id, close_time AS prediction_time,
      CASE WHEN ok THEN no END AS event_entry_time, CASE WHEN ok THEN np END AS event_entry_price, CASE WHEN ok THEN nct END AS event_expiry_time,
      CASE WHEN ok THEN nc END AS event_expiry_price, CASE WHEN ok THEN CAST(sign(nc - np) AS INTEGER) END AS target_direction,
      CASE WHEN ok AND nc > np THEN 1 WHEN ok AND nc < np THEN 0 END AS target_up, coalesce(ok AND nc <> np, false) AS label_valid,
      CASE WHEN NOT ok THEN 'missing_next_bar' END AS invalid_reason
      FROM (SELECT *, coalesce(no = open_time + INTERVAL '{minutes} minutes', false) AS ok FROM
        (SELECT *, lead(open_time) OVER w AS no, lead(open) OVER w AS np, lead(close) OVER w AS nc, lead(close_time) OVER w AS nct
         FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY open_time)))"""


def feature_values(spec: FeatureSet) -> dict[str, str]:
    p = spec.prefix
    w = "PARTITION BY symbol ORDER BY open_time"

    def roll(fn: str, value: str, k: int) -> str:
        frame = f"OVER ({w} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        return f"(CASE WHEN count({value}) {frame} = {k} THEN {fn}({value}) {frame} END)"

    out = {f"{p}ret_{k}": f"ln(close) - ln(lag(close, {k}) OVER ({w}))" for k in spec.returns}
    out |= {f"{p}vol_{k}": roll("stddev_pop", "r1", k) for k in spec.volatility}
    out |= {f"{p}sma_gap_{a}_{b}": f"{roll('avg', 'close', a)} / {roll('avg', 'close', b)} - 1" for a, b in spec.sma_gaps}
    for k in spec.zscores:
        sd = roll("stddev_pop", "close", k)
        out[f"{p}zscore_{k}"] = f"CASE WHEN {sd} > 1e-12 THEN (close - {roll('avg', 'close', k)}) / {sd} WHEN {sd} IS NOT NULL THEN 0.0 END"
    out |= {
        f"{p}range_pct": "(high - low) / close", f"{p}body_pct": "(close - open) / open", f"{p}upper_wick_pct": "(high - greatest(open, close)) / close",
        f"{p}lower_wick_pct": "(least(open, close) - low) / close", f"{p}close_location": "CASE WHEN high - low > 1e-12 THEN (close - low) / (high - low) ELSE 0.5 END",
    }
    out |= {f"{p}rolling_high_distance_{k}": f"close / {roll('max', 'high', k)} - 1" for k in spec.ranges}
    out |= {f"{p}rolling_low_distance_{k}": f"close / {roll('min', 'low', k)} - 1" for k in spec.ranges}
    out |= {f"{p}atr_pct_{k}": f"{roll('avg', 'tr', k)} / close" for k in spec.atr}
    n = spec.path
    if n:
        size = roll("sum", "abs(r1)", n)
        frame = f"OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        out |= {
            f"{p}up_ratio_{n}": roll("avg", "CASE WHEN r1 > 0 THEN 1.0 ELSE 0.0 END", n), f"{p}sign_change_rate_{n}": f"{roll('sum', 'turn', n - 1)} / {n - 1}",
            f"{p}abs_return_sum_{n}": size, f"{p}max_return_{n}": roll("max", "r1", n), f"{p}min_return_{n}": roll("min", "r1", n),
            f"{p}path_efficiency_{n}": f"coalesce(CASE WHEN {size} > 1e-15 THEN abs({roll('sum', 'r1', n)}) / {size} END, 0.0)",
        }
        for name, price, fn in (("high_recency", "high", "list_max"), ("low_recency", "low", "list_min")):
            seen = f"list({price}) {frame}"
            out[f"{p}{name}_{n}"] = f"CASE WHEN len({seen}) = {n} THEN (list_position({seen}, {fn}({seen})) - 1) / {n - 1}.0 END"
    minute = "2 * pi() * (hour(close_time) * 60 + minute(close_time)) / 1440"
    day = "2 * pi() * (isodow(close_time) - 1) / 7"
    return out | {f"{p}time_of_day_sin": f"sin({minute})", f"{p}time_of_day_cos": f"cos({minute})", f"{p}day_of_week_sin": f"sin({day})", f"{p}day_of_week_cos": f"cos({day})"}


def features(source: str, spec: FeatureSet, minutes: int) -> str:
    """Unrounded features of a table of bars, with validity."""
    w = "PARTITION BY symbol ORDER BY open_time"
    values = ", ".join(f"{v} AS {k}" for k, v in feature_values(spec).items())
    bad = " OR ".join(f"{n} IS NULL OR NOT isfinite({n})" for n in spec.names())
    return f"""SELECT symbol, prediction_time, {', '.join(spec.names())}, reason IS NULL AS feature_valid, reason AS feature_invalid_reason FROM (
      SELECT *, CASE WHEN row < {spec.max_lag} THEN 'insufficient_history' WHEN run <> {spec.max_lag} THEN 'non_contiguous_history' WHEN {bad} THEN 'non_finite_feature' END AS reason FROM (
      SELECT symbol, close_time AS prediction_time, row, sum(step_ok) OVER ({w} ROWS BETWEEN {spec.max_lag - 1} PRECEDING AND CURRENT ROW) AS run, {values} FROM (
      SELECT *, CASE WHEN row <= 1 THEN 1.0 WHEN sign(r1) <> sign(pr1) AND sign(r1) <> 0 AND sign(pr1) <> 0 THEN 1.0 ELSE 0.0 END AS turn FROM (
      SELECT *, lag(r1) OVER ({w}) AS pr1 FROM (
      SELECT *, ln(close) - ln(pc) AS r1, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM (
      SELECT *, lag(close) OVER ({w}) AS pc, row_number() OVER ({w}) - 1 AS row,
        CASE WHEN open_time - lag(open_time) OVER ({w}) = INTERVAL '{minutes} minutes' THEN 1 ELSE 0 END AS step_ok FROM {source}))))))"""


def rounded_features(spec: FeatureSet, source: str, minutes: int) -> str:
    return f"SELECT {rounded(spec.names(), ['symbol', 'prediction_time', 'feature_valid', 'feature_invalid_reason'])} FROM ({features(source, spec, minutes)})"


def fused(coarse: str, fine: str, coarse_minutes: int, fine_minutes: int) -> str:
    c, f = coarse_set(), fine_set()
    bad = " OR ".join(f"{n} IS NULL OR NOT isfinite({n})" for n in [f"c30_{n}" for n in c.names()] + f.names())
    return f"""SELECT *, feature_invalid_reason IS NULL AS multires_feature_valid, feature_invalid_reason IS NULL AS feature_valid FROM (
      SELECT *, CASE WHEN NOT alignment_valid THEN 'alignment_invalid'
        WHEN NOT coarse_feature_valid THEN CASE WHEN cr = 'non_finite_feature' THEN cr ELSE 'coarse_history_invalid' END
        WHEN NOT fine_feature_valid THEN CASE WHEN fr = 'non_finite_feature' THEN fr ELSE 'fine_history_invalid' END
        WHEN {bad} THEN 'non_finite_feature' END AS feature_invalid_reason FROM (
      SELECT c.symbol, c.prediction_time, {', '.join(f'c.{n} AS c30_{n}' for n in c.names())}, {', '.join(f'f.{n}' for n in f.names())},
        c.feature_valid AS coarse_feature_valid, c.feature_invalid_reason AS cr, coalesce(f.feature_valid, false) AS fine_feature_valid,
        f.feature_invalid_reason AS fr, f.symbol IS NOT NULL AS alignment_valid
      FROM ({features(coarse, c, coarse_minutes)}) c LEFT JOIN ({features(fine, f, fine_minutes)}) f USING (symbol, prediction_time)))"""


def split(source: str, train: float, validation: float, purge: int) -> str:
    """Chronological split of one series; the borders are truncated products in doubles."""
    return f"""SELECT * EXCLUDE (row, n, b1, b2, t1, t2) FROM (
      SELECT *, CASE WHEN row < b1 THEN 'train' WHEN row < b2 THEN 'validation' ELSE 'test' END AS split,
        max(CASE WHEN row = b1 THEN prediction_time END) OVER () AS t1, max(CASE WHEN row = b2 THEN prediction_time END) OVER () AS t2 FROM (
      SELECT *, row_number() OVER (ORDER BY prediction_time) - 1 AS row, count(*) OVER () AS n,
        CAST(floor(count(*) OVER () * {train}::DOUBLE) AS BIGINT) AS b1, CAST(floor(count(*) OVER () * ({train}::DOUBLE + {validation}::DOUBLE)) AS BIGINT) AS b2 FROM {source}))
      WHERE NOT coalesce(CASE split WHEN 'train' THEN prediction_time + INTERVAL '{purge} minutes' >= t1 OR event_expiry_time >= t1
        WHEN 'validation' THEN prediction_time + INTERVAL '{purge} minutes' >= t2 OR event_expiry_time >= t2 END, false)"""


def auc(source: str, by: str = "") -> str:
    """Mann-Whitney with average ranks."""
    part = f"PARTITION BY {by}" if by else ""
    prefix = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {prefix}CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) ELSE 0.5 END AS roc_auc
      FROM (SELECT *, rank() OVER ({part} ORDER BY p) + (count(*) OVER (PARTITION BY {prefix}p) - 1) / 2.0 AS r FROM {source}) {group}"""


METRICS = """count(*) AS n_samples, avg(y) AS positive_rate, avg(-(y * ln(greatest(least(p, 1 - 1e-15), 1e-15)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)))) AS binary_logloss,
      avg((p - y) * (p - y)) AS brier_score, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy_at_0_5, avg(p) AS mean_probability, stddev_pop(p) AS std_probability,
      min(p) AS min_probability, max(p) AS max_probability"""
METRIC_NAMES = ["positive_rate", "binary_logloss", "brier_score", "accuracy_at_0_5", "mean_probability", "std_probability", "min_probability", "max_probability"]


def averages(source: str, name: str, mean_len: int, atr_len: int) -> str:
    """CTEs that end in ``name``: bars with EMA and Wilder's ATR by recursion over row numbers."""
    return f"""{name}_n AS (SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS pc FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY open_time)),
    {name}_t AS (SELECT *, coalesce(CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END, high - low) AS tr FROM {name}_n),
    {name} AS (SELECT symbol, open_time, open, high, low, close, close_time, rn, pc, tr, close AS mean, tr AS atr FROM {name}_t WHERE rn = 1
      UNION ALL SELECT t.symbol, t.open_time, t.open, t.high, t.low, t.close, t.close_time, t.rn, t.pc, t.tr,
        e.mean + (t.close - e.mean) * 2.0 / ({mean_len} + 1), e.atr + (t.tr - e.atr) / {atr_len}.0
      FROM {name} e JOIN {name}_t t ON t.symbol = e.symbol AND t.rn = e.rn + 1)"""


def efficiency(k: int) -> str:
    w = "PARTITION BY symbol ORDER BY open_time"
    frame = f"OVER ({w} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    path = f"(avg(abs(close - pc)) {frame} * {k})"
    return f"CASE WHEN count(abs(close - pc)) {frame} = {k} THEN CASE WHEN {path} > 0 THEN abs(close - lag(close, {k}) OVER ({w})) / {path} ELSE 0.0 END END"


def slope(k: int, tick: float) -> str:
    return f"(mean - lag(mean, {k}) OVER (PARTITION BY symbol ORDER BY open_time)) / greatest(atr, {tick}) / {k}"


def part(value: str, ideal: float) -> str:
    return f"CASE WHEN {value} IS NOT NULL THEN least(greatest(25 * (1 - abs({value}) / {ideal}), 0.0), 25.0) END"


def indicators(minutes: int, htf_minutes: int, p: SignalParams) -> str:
    """CTEs that end in ``ind``."""
    w = "PARTITION BY symbol ORDER BY open_time"

    def roll(fn: str, value: str, k: int) -> str:
        frame = f"OVER ({w} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        return f"(CASE WHEN count({value}) {frame} = {k} THEN {fn}({value}) {frame} END)"

    n = p.half_life_lookback
    frame = f"OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    beta = f"CASE WHEN count(dr) {frame} = {n} THEN (avg(dr * lr) {frame} - avg(dr) {frame} * avg(lr) {frame}) / var_pop(lr) {frame} END"
    return f"""RECURSIVE b AS ({bars(minutes)}), h AS ({resampled('b', htf_minutes)}), {averages('b', 'e', p.mean_len, p.atr_len)}, {averages('h', 'g', p.htf_mean_len, p.atr_len)},
    htf AS (SELECT symbol, open_time AS ho, lag(s) OVER ({w}) AS htf_slope, lag(er) OVER ({w}) AS htf_er FROM
      (SELECT symbol, open_time, {slope(p.htf_slope_lookback, p.tick)} AS s, {efficiency(p.htf_er_len)} AS er FROM g)),
    l AS (SELECT e.*, {slope(p.local_slope_lookback, p.tick)} AS local_slope, {efficiency(p.local_er_len)} AS local_er, close - mean AS residual, greatest(atr, {p.tick}) AS safe_atr,
      time_bucket(INTERVAL '{htf_minutes} minutes', open_time, TIMESTAMP '1970-01-01') AS ho FROM e),
    m AS (SELECT l.*, htf_slope, htf_er, lag(residual) OVER ({w}) AS lr FROM l LEFT JOIN htf USING (symbol, ho)),
    s AS (SELECT *, greatest(coalesce({roll('stddev_pop', 'residual', p.z_len)}, 0.0), {p.tick}) AS std, residual - lr AS dr,
      {part('htf_slope', p.ideal_htf_slope)} + {part('htf_er', p.ideal_htf_er)} + {part('local_slope', p.ideal_local_slope)} + {part('local_er', p.ideal_local_er)} AS raw_score,
      (close - lag(close, {p.shock_lookback}) OVER ({w})) / safe_atr AS shock_move,
      (lag(close, {p.shock_lookback}) OVER ({w}) - lag(close, {2 * p.shock_lookback}) OVER ({w})) / safe_atr AS previous_shock_move FROM m),
    z AS (SELECT *, residual / std AS z, {beta} AS beta, {roll('avg', 'raw_score', p.regime_smooth_len)} AS regime_score FROM s),
    ind AS (SELECT *, lag(z) OVER ({w}) AS prev_z, CASE WHEN beta < -1e-6 THEN -ln(2.0) / beta END AS half_life, coalesce(abs(htf_slope) >= {p.veto_htf_slope}, false)
      OR coalesce(abs(local_slope) >= {p.veto_local_slope}, false) OR coalesce(htf_er >= {p.veto_htf_er}, false) OR coalesce(local_er >= {p.veto_local_er}, false) AS veto FROM z)"""
