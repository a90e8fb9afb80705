"""The query catalogue: each entry is a job over the test tables, with SQL for the same rows where there is any."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import bars as bars_ops
from ..operators import features as feat
from ..operators import checks, fingerprints, fusion, indicators, labels, metrics, proofs, quality, reports, settlement, splits
from ..params import Payout, Ratios, SignalParams
from ..session import stored
from ..sources.klines import epoch_times
from ..sources.tables import in_file_order, tick_bars, ticks
from ..streaming import jobs
from . import oracle as sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
PARAMS = SignalParams()


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLE_SQL[fn.__name__] = oracle
        return fn

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, so engines that add in another order agree."""
    return df.select([(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def b30(spark, sf):
    return tick_bars(spark, sf, 30)


def b60(spark, sf):
    return tick_bars(spark, sf, 60)


def b360(spark, sf):
    return bars_ops.resample(b60(spark, sf), 360)


BAR = ["open", "high", "low", "close"]
BAR_REST = ["symbol", "open_time", "close_time"]
B30, B60, BT = sql.bars(30), sql.bars(60), sql.bars(60, by_type=True)
B360 = f"WITH b AS ({B60}) {sql.resampled('b', 360)}"
L30 = sql.candidates(f"({B30})", 30)
LT = sql.candidates(f"({BT})", 60)


@query(f"SELECT {sql.rounded(BAR, BAR_REST)} FROM ({B30})")
def bars_from_ticks(spark, sf):
    return rounded(b30(spark, sf))


@query(f"SELECT {sql.rounded(BAR, BAR_REST)} FROM ({BT})")
def bars_by_symbol(spark, sf):
    return rounded(tick_bars(spark, sf, 60, by_type=True))


@query(f"SELECT {sql.rounded(BAR, BAR_REST)} FROM ({B360})")
def bars_resample(spark, sf):
    return rounded(b360(spark, sf))


@query(f"SELECT {sql.rounded(BAR, BAR_REST)} FROM ({B30})")
def bars_dedupe(spark, sf):
    """Bars and a part of them once more: the union holds each once."""
    once = b30(spark, sf)
    return rounded(bars_ops.merge(once, once.filter(F.dayofmonth("open_time") % 3 == 0))[0])


@query(f"SELECT symbol, open_time, 2::BIGINT AS rows, CASE WHEN day(open_time) % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS versions FROM ({B30}) WHERE day(open_time) % 3 = 0")
def bars_conflicts(spark, sf):
    once = b30(spark, sf)
    again = once.filter(F.dayofmonth("open_time") % 3 == 0).withColumn("close", F.col("close") + F.when(F.dayofmonth("open_time") % 2 == 0, 1.0).otherwise(0.0))
    return bars_ops.conflicts(once.unionByName(again))


@query("SELECT event_id, ts AS from_millis, date_trunc('second', ts) AS from_seconds, date_trunc('millisecond', ts) AS from_iso FROM (SELECT event_id, date_trunc('millisecond', ts) AS ts FROM events)")
def kline_epoch_parse(spark, sf):
    """Epoch texts in milliseconds and seconds, and ISO texts, back to times."""
    t = F.date_trunc("millisecond", F.col("ts")).cast("timestamp")
    texts = spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", F.lit("f").alias("file"), F.pmod("event_id", F.lit(16)).alias("member"), F.unix_millis(t).cast("string").alias("from_millis"),
        F.unix_seconds(t).cast("string").alias("from_seconds"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("from_iso"),
    )
    parsed = epoch_times(texts, ["from_millis", "from_seconds", "from_iso"])
    return parsed.select("event_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("from_millis", "from_seconds", "from_iso")])


@query(f"SELECT {sql.rounded(BAR, BAR_REST)} FROM ({B30}) WHERE open_time >= '2024-01-05' AND open_time < '2024-01-13'")
def date_range_filter(spark, sf):
    return rounded(bars_ops.date_range(b30(spark, sf), "2024-01-05", "2024-01-12"))


_GAPS = """SELECT symbol, p AS gap_from, p + INTERVAL '{m} minutes' AS expected_next, open_time AS gap_to, epoch(open_time - p)::BIGINT AS duration_seconds,
  greatest(epoch(open_time - p)::BIGINT // {s} - 1, 0) AS missing_bars
  FROM (SELECT *, lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS p FROM ({b})) WHERE open_time - p > INTERVAL '{m} minutes'"""
_RULES = """count(*) FILTER (NOT isfinite(open + high + low + close)) AS non_finite, count(*) FILTER (least(open, high, low, close) <= 0) AS non_positive,
  count(*) FILTER (high < greatest(open, close)) AS high_below_body, count(*) FILTER (low > least(open, close)) AS low_above_body, count(*) FILTER (high < low) AS high_below_low,
  count(*) FILTER (close_time <= open_time) AS close_not_after_open"""
_BROKEN = f"SELECT * REPLACE (CASE WHEN day(open_time) % 5 = 0 THEN low - 1 ELSE high END AS high, CASE WHEN day(open_time) % 7 = 0 THEN -1.0 ELSE low END AS low) FROM ({BT})"


@query(_GAPS.format(m=60, s=3600, b=BT))
def gap_ranges(spark, sf):
    return quality.gaps(tick_bars(spark, sf, 60, by_type=True), 60)


@query(f"SELECT symbol, count(*) AS n_rows, {_RULES} FROM ({_BROKEN}) GROUP BY symbol")
def ohlc_violations(spark, sf):
    bars = tick_bars(spark, sf, 60, by_type=True)
    day = F.dayofmonth("open_time")
    broken = bars.withColumns({"high": F.when(day % 5 == 0, F.col("low") - 1).otherwise(F.col("high")), "low": F.when(day % 7 == 0, -1.0).otherwise(F.col("low"))})
    return quality.ohlc_violations(broken)


@query(f"""SELECT a.*, n_gaps, n_irregular, n_missing, true AS passed FROM (SELECT symbol, count(*) AS n_rows, 0::BIGINT AS n_duplicates, min(open_time) AS first_open, max(open_time) AS last_open,
  {_RULES} FROM ({BT}) GROUP BY symbol) a JOIN (SELECT symbol, count(*) FILTER (d > 3600) AS n_gaps, count(*) FILTER (d <> 3600) AS n_irregular, sum(greatest(d // 3600 - 1, 0))::BIGINT AS n_missing
  FROM (SELECT symbol, epoch(open_time - lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time))::BIGINT AS d FROM ({BT})) GROUP BY symbol) b USING (symbol)""")
def preflight_report(spark, sf):
    return quality.preflight(tick_bars(spark, sf, 60, by_type=True), 60)


_FAULTY = f"SELECT * FROM ({_BROKEN}) UNION ALL SELECT * FROM ({BT}) WHERE day(open_time) % 11 = 0"


def faulty_bars(spark, sf):
    """Bars with wrong highs and lows on some days, and those of others twice."""
    bars = tick_bars(spark, sf, 60, by_type=True)
    day = F.dayofmonth("open_time")
    broken = bars.withColumns({"high": F.when(day % 5 == 0, F.col("low") - 1).otherwise(F.col("high")), "low": F.when(day % 7 == 0, -1.0).otherwise(F.col("low"))})
    return broken.unionByName(bars.filter(day % 11 == 0))


@query(f"""SELECT a.*, n_gaps, n_irregular, n_missing, n_duplicates + non_finite + non_positive + high_below_body + low_above_body + high_below_low + close_not_after_open = 0 AS passed
  FROM (SELECT symbol, count(*) AS n_rows, count(*) - count(DISTINCT open_time) AS n_duplicates, min(open_time) AS first_open, max(open_time) AS last_open, {_RULES} FROM ({_FAULTY}) GROUP BY symbol) a
  JOIN (SELECT symbol, count(*) FILTER (d > 3600) AS n_gaps, count(*) FILTER (d <> 3600) AS n_irregular, sum(greatest(d // 3600 - 1, 0))::BIGINT AS n_missing
  FROM (SELECT symbol, epoch(open_time - lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time))::BIGINT AS d FROM (SELECT DISTINCT symbol, open_time FROM ({_FAULTY}))) GROUP BY symbol) b USING (symbol)""")
def preflight_of_faulty_bars(spark, sf):
    return quality.preflight(faulty_bars(spark, sf), 60)


@query(f"""SELECT count(*) AS n_rows, count(*) FILTER (open_time IS NULL OR open IS NULL OR close IS NULL OR close_time IS NULL) AS n_nulls,
  count(*) - count(DISTINCT (symbol, open_time)) AS repeated_opens, count(*) - count(DISTINCT (symbol, close_time)) AS repeated_closes,
  count(*) = count(DISTINCT (symbol, open_time)) AS passed FROM ({_FAULTY})""")
def label_input_check(spark, sf):
    return checks.label_inputs(faulty_bars(spark, sf))


@query("""WITH o AS (SELECT event_type AS symbol, ts AS open_time, row_number() OVER () AS rn FROM (SELECT event_type, ts FROM events)), l AS (SELECT *, lag(open_time) OVER (PARTITION BY symbol ORDER BY rn) AS p FROM o)
  SELECT symbol, count(*) AS n_rows, count(*) FILTER (open_time <= p) AS n_breaks, min(CASE WHEN open_time <= p THEN rn - 1 END) AS first_break FROM l GROUP BY symbol""")
def input_order(spark, sf):
    """Whether each series' times rise strictly in the order in which the file has them."""
    events = in_file_order(spark.read.parquet(f"{sf}/events.parquet"))
    rows = events.select(F.col("event_type").alias("symbol"), F.col("ts").alias("open_time"), "file", "row")
    return quality.order_breaks(rows, block=4096).select("symbol", "n_rows", "n_breaks", F.col("first_break.row").alias("first_break"))


_LABEL_DOUBLES = ["event_entry_price", "event_expiry_price"]
_LABEL_REST = ["symbol", "sample_id", "prediction_time", "event_entry_time", "event_expiry_time", "target_direction::BIGINT AS target_direction", "target_up::BIGINT AS target_up", "label_valid", "invalid_reason"]


@query(f"SELECT {sql.rounded(_LABEL_DOUBLES, _LABEL_REST)} FROM ({LT})")
def next_bar_labels(spark, sf):
    return rounded(labels.candidates(tick_bars(spark, sf, 60, by_type=True), 60))


@query(f"SELECT {sql.rounded(_LABEL_DOUBLES, _LABEL_REST)} FROM ({L30}) WHERE event_entry_time IS NOT NULL")
def label_samples(spark, sf):
    return rounded(labels.samples(labels.candidates(b30(spark, sf), 30)))


@query(f"""SELECT symbol, count(*) AS total_candidates, count(event_entry_time) AS valid_events, count(*) - count(event_entry_time) AS invalid_events,
  count(*) FILTER (target_direction = 0) AS flat_events, count(*) FILTER (invalid_reason = 'missing_next_bar') AS missing_next_bar FROM ({LT}) GROUP BY symbol""")
def label_report(spark, sf):
    return labels.report(labels.candidates(tick_bars(spark, sf, 60, by_type=True), 60))


@query(f"""SELECT count(*) AS n_rows, 0::BIGINT AS unknown_ids, 0::BIGINT AS with_reason, 0::BIGINT AS bad_prediction_time, 0::BIGINT AS bad_event_entry_time, 0::BIGINT AS bad_event_entry_price,
  0::BIGINT AS bad_event_expiry_time, count(*) FILTER (day(prediction_time) = 7) AS bad_event_expiry_price, 0::BIGINT AS bad_target_direction, 0::BIGINT AS bad_target_up, 0::BIGINT AS bad_label_valid,
  0::BIGINT AS duplicate_ids, false AS passed FROM ({L30}) WHERE event_entry_time IS NOT NULL""")
def label_causality_check(spark, sf):
    """Samples whose expiry price was tampered with on one day of the month."""
    bars = b30(spark, sf)
    given = labels.samples(labels.candidates(bars, 30))
    tampered = given.withColumn("event_expiry_price", F.col("event_expiry_price") + F.when(F.dayofmonth("prediction_time") == 7, 1.0).otherwise(0.0))
    return labels.causality_check(tampered, bars, 30)


def split30(spark, sf):
    return splits.chronological(labels.samples(labels.candidates(b30(spark, sf), 30)), Ratios(), 30)


S30 = sql.split(f"({L30}) WHERE event_entry_time IS NOT NULL", 0.8, 0.1, 30)


@query(f"SELECT sample_id, prediction_time, event_expiry_time, split FROM ({S30})")
def chrono_split(spark, sf):
    return split30(spark, sf).select("sample_id", "prediction_time", "event_expiry_time", "split")


@query(f"""SELECT split, count(*) AS n_rows, min(prediction_time) AS first_prediction, max(prediction_time) AS last_prediction, max(event_expiry_time) AS last_expiry,
  round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS ratio FROM ({S30}) GROUP BY split""")
def split_report(spark, sf):
    return rounded(splits.report(split30(spark, sf)))


@query(f"""SELECT *, lead(first_prediction) OVER (ORDER BY first_prediction) AS border FROM (SELECT split, count(*) AS n_rows, min(prediction_time) AS first_prediction, max(prediction_time) AS last_prediction,
  max(event_expiry_time) AS last_expiry, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS ratio,
  round(count(*) / (SELECT count(*) FROM ({L30}) WHERE event_entry_time IS NOT NULL)::DOUBLE, 6) AS ratio_of_valid,
  CASE split WHEN 'train' THEN 0.8 ELSE 0.1 END::DOUBLE AS nominal_ratio FROM ({S30}) GROUP BY split)""")
def split_full_report(spark, sf):
    return rounded(splits.full_report(split30(spark, sf), labels.samples(labels.candidates(b30(spark, sf), 30))))


_MIXED = f"SELECT * REPLACE (CASE WHEN hour(prediction_time) = 5 THEN 'test' WHEN hour(prediction_time) = 6 THEN 'other' ELSE split END AS split) FROM ({S30})"
_ONE = lambda part, c: f"max(CASE WHEN split = '{part}' THEN {c} END)"
_FIRST = lambda part: f"min(CASE WHEN split = '{part}' THEN prediction_time END)"


@query(f"""SELECT count(*) AS n_rows, count(*) - count(DISTINCT prediction_time) AS n_duplicates, count(*) FILTER (prediction_time IS NULL OR event_entry_time IS NULL OR event_expiry_time IS NULL) AS n_nulls,
  count(*) FILTER (split NOT IN ('train', 'validation', 'test')) AS n_unknown, count(DISTINCT split) FILTER (split IN ('train', 'validation', 'test')) AS n_parts,
  {_ONE('train', 'prediction_time')} < {_FIRST('validation')} AS train_first, {_ONE('validation', 'prediction_time')} < {_FIRST('test')} AS validation_first,
  {_ONE('train', 'event_expiry_time')} < {_FIRST('validation')} AS train_apart, {_ONE('validation', 'event_expiry_time')} < {_FIRST('test')} AS validation_apart, false AS passed FROM ({_MIXED})""")
def split_check_of_mixed_parts(spark, sf):
    """A split whose hours were dealt to wrong parts."""
    hour = F.hour("prediction_time")
    mixed = split30(spark, sf).withColumn("split", F.when(hour == 5, "test").when(hour == 6, "other").otherwise(F.col("split")))
    return splits.check(mixed)


@query(f"SELECT count(*) AS n_rows, 0::BIGINT AS n_duplicates, 0::BIGINT AS n_nulls, 0::BIGINT AS n_unknown, 3::BIGINT AS n_parts, true AS train_first, true AS validation_first, true AS train_apart, true AS validation_apart, true AS passed FROM ({S30})")
def split_check(spark, sf):
    return splits.check(split30(spark, sf))


@query(f"""SELECT sample_id, prediction_time, part FROM (SELECT *, CASE WHEN row >= k THEN 'train_es' WHEN prediction_time + INTERVAL 30 MINUTES < t THEN 'train_fit' END AS part FROM
  (SELECT *, max(CASE WHEN row = k THEN prediction_time END) OVER () AS t FROM (SELECT *, row_number() OVER (ORDER BY prediction_time) - 1 AS row, CAST(floor(count(*) OVER () * 0.9::DOUBLE) AS BIGINT) AS k
  FROM ({S30}) WHERE split = 'train'))) WHERE part IS NOT NULL""")
def train_es_split(spark, sf):
    return splits.early_stopping(split30(spark, sf).filter("split = 'train'"), 0.1, 30).select("sample_id", "prediction_time", "part")


@query(sql.rounded_features(feat.coarse_set(), f"({B30})", 30))
def coarse_features(spark, sf):
    return rounded(feat.build(b30(spark, sf), feat.coarse_set(), 30))


@query(sql.rounded_features(feat.coarse_set(), f"({B30})", 30))
def coarse_features_in_blocks(spark, sf):
    """The same values when a series is cut into blocks for many tasks."""
    return rounded(feat.build(b30(spark, sf), feat.coarse_set(), 30, block_rows=500))


@query(sql.rounded_features(feat.coarse_set(), f"({BT})", 60))
def coarse_features_by_symbol(spark, sf):
    return rounded(feat.build(tick_bars(spark, sf, 60, by_type=True), feat.coarse_set(), 60))


@query(sql.rounded_features(feat.fine_set(), f"({B60})", 60))
def fine_features(spark, sf):
    return rounded(feat.build(b60(spark, sf), feat.fine_set(), 60))


def multires60(spark, sf):
    """Bars of both resolutions, and their features: coarse, fine, fused. Ticks are read once."""
    fine = stored(b60(spark, sf), "bars")
    coarse = bars_ops.resample(fine, 360)
    return coarse, fusion.multires(coarse, fine, 360, 60)


def fused60(spark, sf):
    return multires60(spark, sf)[1][2]


_ALL = fusion.coarse_names() + fusion.fine_names()
_FLAGS = ["coarse_feature_valid", "fine_feature_valid", "alignment_valid", "multires_feature_valid", "feature_valid"]
FUSED = sql.fused(f"({B360})", f"({B60})", 360, 60)


@query(f"SELECT {sql.rounded(_ALL, ['symbol', 'prediction_time', *_FLAGS, 'feature_invalid_reason'])} FROM ({FUSED})")
def multires_fused(spark, sf):
    return rounded(fused60(spark, sf))


@query(f"SELECT {sql.rounded(fusion.fine_names(), ['symbol', 'prediction_time', 'fine_feature_valid AS feature_valid', 'alignment_valid', "CASE WHEN alignment_valid THEN fr ELSE 'alignment_invalid' END AS feature_invalid_reason"])} FROM ({FUSED})")
def align_exact(spark, sf):
    return rounded(multires60(spark, sf)[1][1])


@query(f"SELECT symbol, coalesce(feature_invalid_reason, 'valid') AS reason, count(*) AS n_rows FROM ({FUSED}) GROUP BY ALL")
def feature_reason_counts(spark, sf):
    return fusion.reason_counts(fused60(spark, sf))


def dataset60(spark, sf):
    coarse, views = multires60(spark, sf)
    samples = splits.chronological(labels.samples(labels.candidates(coarse, 360)), Ratios(), 360)
    return fusion.dataset(samples, views[2])


DATA = f"""SELECT s.symbol, sample_id, s.prediction_time, split, target_up::BIGINT AS target_up, label_valid, {', '.join(f'coalesce({c}, false) AS {c}' for c in _FLAGS)},
  coalesce(label_valid, false) AND coalesce(coarse_feature_valid AND fine_feature_valid AND alignment_valid AND multires_feature_valid, false) AS common_eligible,
  feature_invalid_reason, {', '.join(_ALL)} FROM ({sql.split(f"({sql.candidates(f'({B360})', 360)}) WHERE event_entry_time IS NOT NULL", 0.8, 0.1, 360)}) s LEFT JOIN ({FUSED}) f USING (symbol, prediction_time)"""
_SAMPLE = ["symbol", "sample_id", "prediction_time", "split", "target_up", "label_valid"]


@query(f"SELECT {sql.rounded(_ALL, [*_SAMPLE, *_FLAGS, 'common_eligible', 'feature_invalid_reason'])} FROM ({DATA})")
def multires_dataset(spark, sf):
    return rounded(dataset60(spark, sf))


def _view(name: str, valid: str) -> None:
    names = fusion.view(name).names
    flags = [c for c in _FLAGS if c != "feature_valid"]
    text = f"SELECT {sql.rounded(names, [*_SAMPLE, *flags, f'{valid} AS feature_valid', 'common_eligible', 'feature_invalid_reason'])} FROM ({DATA})"

    def run(spark, sf):
        return rounded(fusion.project(dataset60(spark, sf), name))

    run.__name__ = f"view_{name}"
    query(text)(run)


for _name, _valid in (("coarse", "coarse_feature_valid"), ("fine", "(fine_feature_valid AND alignment_valid)"), ("multires", "multires_feature_valid")):
    _view(_name, _valid)


@query(f"SELECT count(*) FILTER (common_eligible) AS total, {', '.join(f'''count(*) FILTER (common_eligible AND split = '{s}') AS {s}''' for s in ('train', 'validation', 'test'))} FROM ({DATA})")
def eligible_counts(spark, sf):
    return fusion.eligible_counts(dataset60(spark, sf))


@query(f"""SELECT c.symbol, c.open_time AS coarse_open, x.symbol IS NOT NULL AS exact_close, x.symbol IS NOT NULL AND n = 6 AS aligned, NOT (x.symbol IS NOT NULL AND n = 6) AND n < 6 AS gap_explained
  FROM ({sql.bars(360, True)}) c LEFT JOIN ({BT}) x ON x.symbol = c.symbol AND x.close_time = c.close_time
  JOIN (SELECT c.symbol, c.open_time, count(f.open_time) AS n FROM ({sql.bars(360, True)}) c LEFT JOIN ({BT}) f ON f.symbol = c.symbol AND f.open_time >= c.open_time AND f.open_time < c.open_time + INTERVAL 6 HOURS
  GROUP BY ALL) k ON k.symbol = c.symbol AND k.open_time = c.open_time""")
def alignment_contract(spark, sf):
    fine = tick_bars(spark, sf, 60, by_type=True)
    return quality.alignment_contract(bars_ops.resample(fine, 360), fine, 6, 60)


_SIDES = f"SELECT symbol, close_time, count(*) AS n FROM ({B360}) GROUP BY ALL"
_FINE_SIDE = f"SELECT symbol, close_time, count(*) AS n FROM ({B60}) GROUP BY ALL"


@query(f"""SELECT coalesce(sum(c.n), 0)::BIGINT AS left_rows, coalesce(sum(f.n), 0)::BIGINT AS right_rows, count(*) FILTER (f.n IS NULL) AS only_left, count(*) FILTER (c.n IS NULL) AS only_right,
  coalesce(sum(c.n - 1), 0)::BIGINT AS repeated_left, coalesce(sum(f.n - 1), 0)::BIGINT AS repeated_right,
  count(*) FILTER (f.n IS NULL OR c.n IS NULL OR c.n > 1 OR f.n > 1) = 0 AS passed FROM ({_SIDES}) c FULL JOIN ({_FINE_SIDE}) f USING (symbol, close_time)""")
def one_to_one_check(spark, sf):
    """Close times of coarse and fine bars, of which only some have a counterpart."""
    return checks.one_to_one(b360(spark, sf), b60(spark, sf), ["symbol", "close_time"])


@query("SELECT 0::BIGINT AS only_first, 0::BIGINT AS only_second, true AS equal")
def common_sample_equality(spark, sf):
    data = dataset60(spark, sf)
    return quality.same_rows(fusion.project(data, "c"), fusion.project(data, "mr"), ["sample_id", "prediction_time", "target_up", "split"])


_SAME = ["sample_id", "prediction_time", "target_up"]
_TAMPERED = "SELECT * REPLACE (CASE WHEN hour(prediction_time) = 5 AND day(prediction_time) % 9 = 0 THEN 1 - target_up ELSE target_up END AS target_up) FROM s"


@query(f"""WITH s AS MATERIALIZED (SELECT split, {', '.join(_SAME)} FROM ({DATA})), fine AS ({_TAMPERED}), multires AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE split = 'test' AND day(prediction_time) = 29),
  d AS (SELECT split, 'fine' AS t, count(*) AS n FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM fine UNION ALL (SELECT * FROM fine EXCEPT ALL SELECT * FROM s)) GROUP BY split
    UNION ALL SELECT split, 'multires', count(*) FROM (SELECT * FROM multires EXCEPT ALL SELECT * FROM s) GROUP BY split),
  c AS (SELECT split, 'fine' AS t, count(*) AS n FROM fine GROUP BY split UNION ALL SELECT split, 'multires', count(*) FROM multires GROUP BY split),
  b AS (SELECT split, count(*) AS n FROM s GROUP BY split)
  SELECT c.split, c.t AS "table", c.n, b.n AS n_first, coalesce(d.n, 0) = 0 AS equal FROM c JOIN b USING (split) LEFT JOIN d ON d.split = c.split AND d.t = c.t""")
def common_sample_fingerprints(spark, sf):
    """Samples of three datasets, each built for itself; of one some outcomes are turned, another has some rows twice."""
    coarse, fine, multires = (fusion.project(dataset60(spark, sf), name).select("split", *_SAME) for name in ("coarse", "fine", "multires"))
    turned = (F.hour("prediction_time") == 5) & (F.dayofmonth("prediction_time") % 9 == 0)
    fine = fine.withColumn("target_up", F.when(turned, 1 - F.col("target_up")).otherwise(F.col("target_up")))
    twice = multires.filter((F.col("split") == "test") & (F.dayofmonth("prediction_time") == 29))
    return fingerprints.compare({"coarse": coarse, "fine": fine, "multires": multires.unionByName(twice)}, _SAME, ["split"])


_CUT = "2024-01-21 12:00:00"
_MUTATE = "SELECT * REPLACE ({}) FROM ({})"
_FACTORS = ", ".join(f"CASE WHEN open_time >= TIMESTAMP '{_CUT}' THEN {p} * {k} ELSE {p} END AS {p}" for p, k in proofs.FACTORS.items())


def _changed(names: list[str], flags: list[str]) -> str:
    """SQL that tells whether rows a and b differ."""
    bad = lambda x: f"({x} IS NULL OR NOT isfinite({x}))"
    far = [f"NOT ({bad(f'a.{c}')} AND {bad(f'b.{c}')} OR coalesce(abs(a.{c} - b.{c}) <= 1e-10 + 1e-10 * abs(b.{c}), false))" for c in names]
    return " OR ".join([*far, *[f"a.{c} IS DISTINCT FROM b.{c}" for c in flags]])


def _mutation_sql(before: str, after: str, names: list[str], flags: list[str]) -> str:
    early = f"prediction_time <= TIMESTAMP '{_CUT}'"
    return f"""WITH a AS MATERIALIZED ({before}), b AS MATERIALIZED ({after}), x AS (SELECT symbol, prediction_time, {_changed(names, flags)} AS changed FROM a JOIN b USING (symbol, prediction_time))
      SELECT symbol, count(*) FILTER ({early}) AS n_before, count(*) FILTER ({early} AND changed) AS n_changed_before, count(*) FILTER (NOT {early}) AS n_after, count(*) FILTER (NOT {early} AND changed) AS n_changed_after,
      min(CASE WHEN {early} AND changed THEN prediction_time END) AS first_leak, min(CASE WHEN NOT {early} AND changed THEN prediction_time END) AS first_changed,
      count(*) FILTER ({early} AND changed) = 0 AS passed FROM x GROUP BY symbol"""


def _cut():
    return F.lit(_CUT).cast("timestamp_ntz")


_VALID = ["feature_valid", "feature_invalid_reason"]


@query(_mutation_sql(sql.features(f"({B30})", feat.coarse_set(), 30), sql.features(f"({_MUTATE.format(_FACTORS, B30)})", feat.coarse_set(), 30), feat.coarse_set().names(), _VALID))
def mutation_proof_coarse(spark, sf):
    """Later prices are changed; no coarse feature known before may move."""
    build = lambda bars: feat.build(bars, feat.coarse_set(), 30, block_rows=500)
    return proofs.mutation_proof(build, [b30(spark, sf)], _cut(), feat.coarse_set().names()).drop("leaking")


@query(_mutation_sql(sql.features(f"({B60})", feat.fine_set(), 60), sql.features(f"({_MUTATE.format(_FACTORS, B60)})", feat.fine_set(), 60), feat.fine_set().names(), _VALID))
def mutation_proof_fine(spark, sf):
    build = lambda bars: feat.build(bars, feat.fine_set(), 60)
    return proofs.mutation_proof(build, [b60(spark, sf)], _cut(), feat.fine_set().names()).drop("leaking")


_FUSED_FLAGS = ["multires_feature_valid", "feature_invalid_reason"]


@query(_mutation_sql(FUSED, sql.fused(f"({_MUTATE.format(_FACTORS, B360)})", f"({_MUTATE.format(_FACTORS, B60)})", 360, 60), _ALL, _FUSED_FLAGS))
def mutation_proof_fused(spark, sf):
    """Both resolutions are changed after the cut."""
    build = lambda coarse, fine: fusion.multires(coarse, fine, 360, 60)[2]
    return proofs.mutation_proof(build, [b360(spark, sf), b60(spark, sf)], _cut(), _ALL, tuple(_FUSED_FLAGS)).drop("leaking")


def _gap_sql(source: str, spec: feat.FeatureSet, minutes: int, at: str) -> str:
    hole = f"SELECT * FROM ({source}) WHERE open_time <> TIMESTAMP '{at}'"
    return f"""WITH a AS MATERIALIZED ({sql.features(f"({source})", spec, minutes)}), b AS MATERIALIZED ({sql.features(f"({hole})", spec, minutes)}),
      g AS (SELECT symbol, close_time FROM ({source}) WHERE open_time = TIMESTAMP '{at}'),
      x AS (SELECT a.symbol, a.prediction_time, b.symbol IS NULL AS missing, a.feature_valid AND NOT b.feature_valid AS gone, b.feature_invalid_reason AS why,
        b.symbol IS NOT NULL AND ({_changed(spec.names(), _VALID)}) AS changed FROM a LEFT JOIN b ON a.symbol = b.symbol AND a.prediction_time = b.prediction_time)
      SELECT x.symbol, max(close_time) AS gap_time, 1::BIGINT AS n_dropped, count(*) FILTER (missing) AS n_missing, count(*) FILTER (gone) AS n_invalidated, count(*) FILTER (gone AND why = 'non_contiguous_history') AS n_non_contiguous,
        min(CASE WHEN gone THEN prediction_time END) AS first_invalid, max(CASE WHEN gone THEN prediction_time END) AS last_invalid, count(*) FILTER (prediction_time < close_time AND changed) AS n_changed_before,
        count(*) FILTER (gone) <= {spec.max_lag} AS passed FROM x JOIN g USING (symbol) GROUP BY x.symbol"""


@query(_gap_sql(B30, feat.coarse_set(), 30, _CUT))
def gap_proof_coarse(spark, sf):
    """One bar is left out: the next 48 have no whole history."""
    build = lambda bars: feat.build(bars, feat.coarse_set(), 30, block_rows=500)
    return proofs.gap_proof(build, b30(spark, sf), F.col("open_time") == _cut(), feat.coarse_set().names(), 48)


_FINE_GAP = "2024-01-15 06:00:00"


@query(_gap_sql(B60, feat.fine_set(), 60, _FINE_GAP))
def gap_proof_fine(spark, sf):
    """One bar is left out: the next 288 have no whole history."""
    build = lambda bars: feat.build(bars, feat.fine_set(), 60)
    return proofs.gap_proof(build, b60(spark, sf), F.col("open_time") == F.lit(_FINE_GAP).cast("timestamp_ntz"), feat.fine_set().names(), 288)


@query(f"""SELECT symbol, invalid_reason, false AS all_reasons, count(*) AS n, count(event_entry_time) AS n_entered, count(*) FILTER (target_direction = 0) AS n_flat FROM ({LT}) GROUP BY symbol, invalid_reason
  UNION ALL SELECT symbol, NULL, true, count(*), count(event_entry_time), count(*) FILTER (target_direction = 0) FROM ({LT}) GROUP BY symbol""")
def label_reason_report(spark, sf):
    """What the labels' report is folded from."""
    return reports.label_counts(labels.candidates(tick_bars(spark, sf, 60, by_type=True), 60))


_REPORTED = f"SELECT symbol, coalesce(split, 'none') AS split, coalesce(feature_invalid_reason, 'valid') AS reason, coalesce(label_valid, false) AS labelled, {', '.join(f'coalesce({f}, false) AS {f}' for f in reports.FLAGS)} FROM ({DATA})"
_COUNTED = ", ".join(["count(*) AS n", *[f"count(*) FILTER ({f}) AS n_{f}" for f in reports.FLAGS], *[f"count(*) FILTER ({f} AND labelled) AS n_labelled_{f}" for f in reports.FLAGS]])


@query(f"""WITH r AS MATERIALIZED ({_REPORTED}) SELECT symbol, split, NULL AS reason, 'split' AS level, {_COUNTED} FROM r GROUP BY symbol, split
  UNION ALL SELECT symbol, NULL, reason, 'reason', {_COUNTED} FROM r GROUP BY symbol, reason UNION ALL SELECT symbol, NULL, NULL, 'all', {_COUNTED} FROM r GROUP BY symbol""")
def feature_report(spark, sf):
    """What the reports of a dataset are folded from: parts, reasons and all rows in one pass."""
    return reports.feature_counts(dataset60(spark, sf), reports.FLAGS)


def scored30(spark, sf):
    """Two made-up models of the 30 minute labels: ``variant, prediction_time, y, p``."""
    bars = b30(spark, sf)
    known = labels.candidates(bars, 30).filter("label_valid").select("symbol", "prediction_time", F.col("target_up").alias("y"))
    rows = bars.select("symbol", F.col("close_time").alias("prediction_time"), ((F.col("close") - F.col("open")) / F.col("open")).alias("x")).join(known, ["symbol", "prediction_time"])
    variants = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(w).alias("w")) for n, w in (("down", -2.0), ("up", 0.7))]))
    p = F.round(1 / (1 + F.exp(-F.col("v.w") * F.col("x"))), 4)
    return rows.withColumn("v", variants).select("v.variant", "prediction_time", "y", p.alias("p"))


SCORED = f"""SELECT variant, prediction_time, target_up AS y, round(1 / (1 + exp(-w * x)), 4) AS p FROM (SELECT prediction_time, target_up FROM ({L30}) WHERE label_valid)
  JOIN (SELECT close_time AS prediction_time, (close - open) / open AS x FROM ({B30})) USING (prediction_time) CROSS JOIN (VALUES ('down', -2.0::DOUBLE), ('up', 0.7::DOUBLE)) v(variant, w)"""
DOWN = f"(SELECT * FROM ({SCORED}) WHERE variant = 'down')"


def down30(spark, sf):
    return scored30(spark, sf).filter("variant = 'down'")


@query(f"SELECT {sql.rounded([*sql.METRIC_NAMES, 'roc_auc'], ['n_samples'])} FROM (SELECT {sql.METRICS} FROM {DOWN}) CROSS JOIN ({sql.auc(DOWN)})")
def prob_metrics(spark, sf):
    return rounded(metrics.probability_metrics(down30(spark, sf)))


@query(f"SELECT variant, round(roc_auc, 6) AS roc_auc FROM ({sql.auc(f'({SCORED})', 'variant')})")
def roc_auc(spark, sf):
    return rounded(metrics.auc(scored30(spark, sf), ("variant",)))


@query(f"""SELECT '[' || printf('%.1f', k / 10.0) || ', ' || printf('%.1f', (k + 1) / 10.0) || CASE WHEN k = 9 THEN ']' ELSE ')' END AS bin_range, round(k * 0.1::DOUBLE, 6) AS bin_lower, round((k + 1) * 0.1::DOUBLE, 6) AS bin_upper,
  count(p) AS n_rows, round(avg(p), 6) AS mean_predicted_probability, round(avg(y), 6) AS actual_up_rate
  FROM range(10) r(k) LEFT JOIN {DOWN} ON p >= k * 0.1::DOUBLE AND (p < (k + 1) * 0.1::DOUBLE OR k = 9) GROUP BY k""")
def reliability_table(spark, sf):
    return rounded(metrics.reliability(down30(spark, sf)))


@query(f"""SELECT q::DOUBLE AS threshold_q, count(*) FILTER (p >= q) AS long_count, round(avg(y) FILTER (p >= q), 6) AS long_actual_up_rate, count(*) FILTER (p <= 1 - q) AS short_count,
  round(avg(1 - y) FILTER (p <= 1 - q), 6) AS short_actual_down_rate, count(*) FILTER (p >= q OR p <= 1 - q) AS combined_count,
  round(avg(CASE WHEN p >= q AND y = 1 OR p <= 1 - q AND y = 0 THEN 1.0 ELSE 0.0 END) FILTER (p >= q OR p <= 1 - q), 6) AS combined_hit_rate
  FROM {DOWN} CROSS JOIN (SELECT unnest([0.55, 0.575, 0.6, 0.625, 0.65, 0.675, 0.7]::DOUBLE[]) AS q) GROUP BY q""")
def confidence_report(spark, sf):
    return rounded(metrics.confidence(down30(spark, sf)))


_MONTHS = f"(SELECT *, strftime(prediction_time, '%Y-%m') AS month FROM ({SCORED}) WHERE variant = 'down')"


@query(f"""SELECT month, n_samples AS samples, round(accuracy_at_0_5, 6) AS accuracy, round(roc_auc, 6) AS roc_auc, round(binary_logloss, 6) AS binary_logloss, n AS confidence_event_count, round(h, 6) AS confidence_hit_rate
  FROM (SELECT month, {sql.METRICS}, count(*) FILTER (p >= 0.55 OR p <= 1 - 0.55::DOUBLE) AS n,
  avg(CASE WHEN p >= 0.55 AND y = 1 OR p <= 1 - 0.55::DOUBLE AND y = 0 THEN 1.0 ELSE 0.0 END) FILTER (p >= 0.55 OR p <= 1 - 0.55::DOUBLE) AS h FROM {_MONTHS} GROUP BY month) JOIN ({sql.auc(_MONTHS, 'month')}) USING (month)""")
def monthly_diagnostics(spark, sf):
    return rounded(metrics.monthly(down30(spark, sf)))


_Q = {"q_55": 0.55, "q_575": 0.575, "q_6": 0.6, "q_625": 0.625, "q_65": 0.65, "q_675": 0.675, "q_7": 0.7}
_PIVOT = ", ".join(
    f"count(*) FILTER (p >= {q} OR p <= 1 - {q}::DOUBLE) AS {n}_count, avg(CASE WHEN p >= {q} AND y = 1 OR p <= 1 - {q}::DOUBLE AND y = 0 THEN 1.0 ELSE 0.0 END) FILTER (p >= {q} OR p <= 1 - {q}::DOUBLE) AS {n}_hit_rate"
    for n, q in _Q.items())
_COMPARED = f"SELECT * FROM (SELECT variant, {sql.METRICS}, {_PIVOT} FROM ({SCORED}) GROUP BY variant) JOIN ({sql.auc(f'({SCORED})', 'variant')}) USING (variant)"


@query(f"SELECT {sql.rounded([*sql.METRIC_NAMES, 'roc_auc', *[f'{n}_hit_rate' for n in _Q]], ['variant', 'n_samples', *[f'{n}_count' for n in _Q]])} FROM ({_COMPARED})")
def comparison_pivot(spark, sf):
    return rounded(metrics.comparison(scored30(spark, sf)))


@query(f"""SELECT u.variant, {', '.join(f'round(u.{m} - d.{m}, 6) + 0.0 AS delta_{m}' for m in ('roc_auc', 'binary_logloss', 'brier_score'))} FROM ({_COMPARED}) u, ({_COMPARED}) d WHERE u.variant = 'up' AND d.variant = 'down'""")
def incremental_value(spark, sf):
    return rounded(metrics.incremental(metrics.comparison(scored30(spark, sf)), "down"))


@query(f"SELECT variant AS best_variant, round(roc_auc, 6) AS roc_auc FROM ({_COMPARED}) ORDER BY roc_auc DESC, variant LIMIT 1")
def best_variant(spark, sf):
    return rounded(metrics.best_variant(metrics.comparison(scored30(spark, sf))))


@query("SELECT event_type AS feature_group, round(sum(value), 6) AS gain, round(sum(value) / (SELECT sum(value) FROM events), 6) AS share FROM events GROUP BY event_type")
def group_importance(spark, sf):
    """Events stand for features here: their values are gains, their types are groups."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    name = F.col("event_id").cast("string").alias("feature")
    return rounded(metrics.group_importance(events.select(name, F.col("value").alias("gain")), events.select(name, F.col("event_type").alias("feature_group"))))


def ind60(spark, sf):
    return indicators.indicators(b60(spark, sf), 360, PARAMS)


IND = f"WITH {sql.indicators(60, 360, PARAMS)}"


def _from_ind(name: str, columns: list[str], run: Callable[[DataFrame], DataFrame], select: str, tail: str = "") -> None:
    def job(spark, sf):
        return rounded(run(ind60(spark, sf)))

    job.__name__ = name
    query(f"{IND} SELECT {select} FROM ind {tail}")(job)


def _pick(*names: str) -> tuple[list[str], Callable[[DataFrame], DataFrame], str]:
    keys = ["symbol", "open_time"]
    return list(names), lambda df: df.select(*keys, *names), sql.rounded(list(names), keys)


for _title, _names in {
    "ema": ("mean",), "atr_wilder": ("atr",), "efficiency_ratio": ("local_er", "htf_er"), "slope_atr": ("local_slope", "htf_slope"), "htf_confirmed": ("htf_slope", "htf_er"),
    "regime_score": ("raw_score", "regime_score"), "shock_moves": ("shock_move", "previous_shock_move"), "half_life": ("half_life",), "residual_zscore": ("residual", "std", "z"),
}.items():
    _from_ind(_title, *_pick(*_names))

_BANDS = {f"{side}_{n}_band": f"mean {'+' if side == 'upper' else '-'} {z} * std" for side in ("upper", "lower") for n, z in (("range", PARAMS.range_entry_z), ("shock", PARAMS.shock_entry_z), ("stop", PARAMS.stop_z))}
_from_ind("bands_zscore", [], lambda df: indicators.bands(df, PARAMS).select("symbol", "open_time", *_BANDS), ", ".join(["symbol", "open_time", *[f"round({v}, 6) + 0.0 AS {k}" for k, v in _BANDS.items()]]))
_CROSS = {
    "over_range": f"z > -{PARAMS.range_entry_z} AND prev_z <= -{PARAMS.range_entry_z}", "under_range": f"z < {PARAMS.range_entry_z} AND prev_z >= {PARAMS.range_entry_z}",
    "over_shock": f"z > -{PARAMS.shock_entry_z} AND prev_z <= -{PARAMS.shock_entry_z}", "under_shock": f"z < {PARAMS.shock_entry_z} AND prev_z >= {PARAMS.shock_entry_z}",
}
_from_ind("crossings", [], lambda df: indicators.crossings(df, PARAMS).select("symbol", "open_time", *_CROSS), ", ".join(["symbol", "open_time", *[f"coalesce({v}, false) AS {k}" for k, v in _CROSS.items()]]))
_CONFIRM = {
    f"{side}_{mode}": f"({_CROSS[f'{over}_{mode}']}) AND close {sign} mean {band} {z} * std AND close {sign} pc"
    for mode, z in (("range", PARAMS.range_entry_z), ("shock", PARAMS.shock_entry_z)) for side, over, sign, band in (("long", "over", ">", "-"), ("short", "under", "<", "+"))
}
_from_ind("entry_confirmations", [], lambda df: indicators.confirmations(df, PARAMS).select("symbol", "open_time", *_CONFIRM), ", ".join(["symbol", "open_time", *[f"coalesce({v}, false) AS {k}" for k, v in _CONFIRM.items()]]))
_ENV = f"NOT veto AND coalesce(regime_score >= {PARAMS.shock_min_score}, false)"
_from_ind(
    "environments", [], lambda df: df.select("symbol", "open_time", "veto", "range_env", "shock_env"),
    f"symbol, open_time, veto, NOT veto AND coalesce(regime_score >= {PARAMS.range_min_score}, false) AS range_env, {_ENV} AS shock_env",
)
_SIDES = {
    "long": [f"z <= -{PARAMS.shock_entry_z}", f"shock_move <= -{PARAMS.min_shock_atr}", _ENV, f"abs(shock_move) <= abs(previous_shock_move) * {PARAMS.deceleration_ratio}",
             f"(close > open OR (least(open, close) - low) / greatest(high - low, {PARAMS.tick}) >= {PARAMS.min_wick_ratio})"],
    "short": [f"z >= {PARAMS.shock_entry_z}", f"shock_move >= {PARAMS.min_shock_atr}", _ENV, f"abs(shock_move) <= abs(previous_shock_move) * {PARAMS.deceleration_ratio}",
              f"(close < open OR (high - greatest(open, close)) / greatest(high - low, {PARAMS.tick}) >= {PARAMS.min_wick_ratio})"],
}
_STAGES = ("z", "move", "environment", "deceleration", "rejection")
_from_ind("shock_funnel", [], lambda df: indicators.shock_funnel(df, PARAMS), "symbol, " + ", ".join(
    " + ".join(f"count(*) FILTER ({' AND '.join(side[: k + 1])})" for side in _SIDES.values()) + f" AS {n}_pass" for k, n in enumerate(_STAGES)), "GROUP BY symbol")


def settlement_input30(spark, sf):
    """Made-up entries at the open of every seventh 30 minute bar, 5 minute closes, and the bars."""
    bars = tick_bars(spark, sf, 30, by_type=True)
    minute = F.unix_timestamp(F.col("open_time").cast("timestamp")) / 1800
    k = F.pmod(F.floor(minute), F.lit(7))
    entries = bars.filter(k == 3).select(
        "symbol", F.unix_timestamp(F.col("open_time").cast("timestamp")).alias("event_id"), F.when(F.dayofmonth("open_time") % 2 == 0, 1).otherwise(-1).alias("direction"),
        F.when(F.hour("open_time") < 12, 1).otherwise(2).alias("mode"), (F.col("open_time") + F.expr("INTERVAL 1 MINUTE")).alias("entry_time"), F.col("open").alias("entry_price"),
    )
    fine = tick_bars(spark, sf, 5, by_type=True)
    seen = fine.select("symbol", F.col("close_time").alias("obs_time"), "close", bars_ops.bucket(F.col("open_time"), 30).cast("timestamp_ntz").alias("bar_open"))
    return entries, seen, bars


def settled30(spark, sf):
    return settlement.settle(*settlement_input30(spark, sf), Payout())


SETTLED = f"""WITH bars AS ({sql.bars(30, True)}), obs AS (SELECT symbol, close_time AS obs_time, close, time_bucket(INTERVAL '30 minutes', open_time, TIMESTAMP '1970-01-01') AS bar_open FROM ({sql.bars(5, True)})),
  due AS (SELECT symbol, epoch(open_time)::BIGINT AS event_id, CASE WHEN day(open_time) % 2 = 0 THEN 1 ELSE -1 END AS direction, CASE WHEN hour(open_time) < 12 THEN 1 ELSE 2 END AS mode,
    open_time + INTERVAL 1 MINUTE AS entry_time, open AS entry_price, h AS horizon, open_time + INTERVAL 1 MINUTE + h * INTERVAL 1 MINUTE AS target_time
    FROM bars CROSS JOIN (VALUES (30), (60)) x(h) WHERE (epoch(open_time)::BIGINT // 1800) % 7 = 3),
  hit AS (SELECT due.*, obs_time, close, bar_open FROM due ASOF LEFT JOIN obs ON due.symbol = obs.symbol AND due.target_time <= obs.obs_time),
  nxt AS (SELECT hit.*, bars.open_time AS next_open FROM hit ASOF LEFT JOIN bars ON hit.symbol = bars.symbol AND hit.target_time < bars.open_time),
  res AS (SELECT *, CASE WHEN bar_open IS NOT NULL AND (next_open IS NULL OR bar_open <= next_open) THEN CASE WHEN (close - entry_price) * direction > 0 THEN 'WIN' ELSE 'LOSS' END
    WHEN next_open IS NOT NULL THEN 'UNRESOLVED' ELSE 'ACTIVE' END AS result FROM nxt),
  settled AS (SELECT symbol, event_id, direction, mode, entry_time, entry_price, horizon, target_time, result, CASE WHEN result IN ('WIN', 'LOSS') THEN close END AS settle_price,
    CASE WHEN result IN ('WIN', 'LOSS') THEN obs_time END AS settled_time, CASE WHEN result IN ('WIN', 'LOSS') THEN bar_open END AS settle_bar,
    CASE result WHEN 'WIN' THEN 4.25 WHEN 'LOSS' THEN -5.0 END AS pnl, CASE WHEN result IN ('WIN', 'LOSS') THEN epoch_us(obs_time - target_time) / 1e6 END AS timing_error_seconds FROM res)"""
SETTLED = SETTLED.replace("epoch_us(obs_time - target_time)", "(epoch_us(obs_time) - epoch_us(target_time))")


@query(f"""{SETTLED} SELECT symbol, event_id, direction::BIGINT AS direction, mode::BIGINT AS mode, entry_time, horizon::BIGINT AS horizon, target_time, result, settled_time, settle_bar,
  round(entry_price, 6) AS entry_price, round(settle_price, 6) AS settle_price, round(pnl, 6)::DOUBLE AS pnl, round(timing_error_seconds, 6) AS timing_error_seconds FROM settled""")
def event_settlement(spark, sf):
    return rounded(settled30(spark, sf))


@query(f"""{SETTLED} SELECT symbol, horizon::BIGINT AS horizon, direction::BIGINT AS direction, mode::BIGINT AS mode, count(*) AS resolved, count(*) FILTER (result = 'WIN') AS wins, count(*) FILTER (result = 'LOSS') AS losses,
  round(sum(pnl), 6)::DOUBLE AS net_pnl, round(100.0 * count(*) FILTER (result = 'WIN') / count(*), 6)::DOUBLE AS win_rate,
  round((count(*) FILTER (result = 'WIN')) / count(*)::DOUBLE * 4.25 - (1 - (count(*) FILTER (result = 'WIN')) / count(*)::DOUBLE) * 5, 6) AS expectation
  FROM settled WHERE result IN ('WIN', 'LOSS') GROUP BY GROUPING SETS ((symbol, horizon, direction, mode), (symbol, horizon, direction), (symbol, horizon, mode), (symbol, horizon))""")
def event_ledger(spark, sf):
    return rounded(settlement.ledger(settled30(spark, sf)))


_ISLANDS = """SELECT symbol, horizon, result, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY symbol, horizon ORDER BY settle_bar, event_id DESC)
  - row_number() OVER (PARTITION BY symbol, horizon, result ORDER BY settle_bar, event_id DESC) AS i FROM settled WHERE result IN ('WIN', 'LOSS')) GROUP BY symbol, horizon, result, i"""


@query(f"""{SETTLED} SELECT symbol, horizon::BIGINT AS horizon, coalesce(max(n) FILTER (result = 'WIN'), 0)::BIGINT AS max_wins, coalesce(max(n) FILTER (result = 'LOSS'), 0)::BIGINT AS max_losses FROM ({_ISLANDS}) GROUP BY symbol, horizon""")
def event_streaks(spark, sf):
    return rounded(settlement.streaks(settled30(spark, sf)))


@query(f"""{SETTLED} SELECT symbol, horizon::BIGINT AS horizon, round(sum(pnl), 6)::DOUBLE AS net_pnl, round(max(peak), 6)::DOUBLE AS peak_equity, round(max(peak - equity), 6)::DOUBLE AS max_drawdown FROM (
  SELECT *, greatest(0.0, max(equity) OVER w) AS peak FROM (SELECT *, sum(pnl) OVER w AS equity FROM settled WHERE result IN ('WIN', 'LOSS') WINDOW w AS (PARTITION BY symbol, horizon ORDER BY settle_bar, event_id DESC ROWS UNBOUNDED PRECEDING))
  WINDOW w AS (PARTITION BY symbol, horizon ORDER BY settle_bar, event_id DESC ROWS UNBOUNDED PRECEDING)) GROUP BY symbol, horizon""")
def event_drawdown(spark, sf):
    return rounded(settlement.drawdown(settled30(spark, sf)))


@query(f"""{SETTLED} SELECT symbol, horizon::BIGINT AS horizon, count(*) AS n_events, round(sum(timing_error_seconds), 6) AS sum_seconds, round(avg(timing_error_seconds), 6) AS mean_seconds,
  round(max(timing_error_seconds), 6) AS max_seconds FROM settled WHERE timing_error_seconds IS NOT NULL GROUP BY symbol, horizon""")
def timing_error(spark, sf):
    return rounded(settlement.timing(settled30(spark, sf)))


@query(f"""{SETTLED} SELECT symbol, event_id, horizon::BIGINT AS horizon, round(round(entry_price / 0.05::DOUBLE) * 0.05::DOUBLE, 6) AS tick_price, round(entry_price * (2 * 4.5 / 10000)::DOUBLE + (2 * 1.0 * 0.05)::DOUBLE, 6) AS cost,
  concat_ws('|', 'SETTLED', 'id=' || event_id, 'direction=' || CASE WHEN direction > 0 THEN 'Long' WHEN direction < 0 THEN 'Short' END, 'mode=' || CASE mode WHEN 1 THEN 'Range' WHEN 2 THEN 'Shock' END,
  'result=' || result, 'target_time=' || strftime(target_time, '%Y-%m-%dT%H:%M:%S.%fZ'), 'observed_time=' || strftime(settled_time, '%Y-%m-%dT%H:%M:%S.%fZ')) AS line FROM settled""")
def event_messages(spark, sf):
    """A line for each settlement, the entry price on its tick and what a round trip at it costs."""
    price = F.col("entry_price")
    line = scalar.message(
        "SETTLED", id=F.col("event_id"), direction=scalar.direction_name(F.col("direction")), mode=scalar.mode_name(F.col("mode")), result=F.col("result"),
        target_time=scalar.iso_z(F.col("target_time")), observed_time=scalar.iso_z(F.col("settled_time")),
    )
    rows = settled30(spark, sf).select(
        "symbol", "event_id", "horizon", scalar.to_tick(price, 0.05).alias("tick_price"), scalar.round_trip_cost(price, 4.5, 1.0, 0.05).alias("cost"), line.alias("line"))
    return rounded(rows)


_CHANGES = """SELECT symbol, entry_time AS time, 1 AS delta FROM settled WHERE horizon = 30
  UNION ALL SELECT symbol, max(done_bar), -1 FROM (SELECT *, CASE WHEN result = 'UNRESOLVED' THEN next_open ELSE settle_bar END AS done_bar FROM ended) GROUP BY symbol, event_id HAVING count(done_bar) = 2"""


@query(f"""{SETTLED}, ended AS (SELECT res.symbol, res.event_id, res.result, res.next_open, CASE WHEN res.result IN ('WIN', 'LOSS') THEN res.bar_open END AS settle_bar FROM res),
  n AS (SELECT symbol, time, sum(sum(delta)) OVER (PARTITION BY symbol ORDER BY time) AS n FROM ({_CHANGES}) GROUP BY symbol, time)
  SELECT symbol, max(n)::BIGINT AS max_active, arg_min(time, (-n, time)) AS reached FROM n GROUP BY symbol""")
def active_event_peak(spark, sf):
    """The largest number of events that are active at once, which a limit is held against."""
    return settlement.active_peak(settlement.settle_with_ends(*settlement_input30(spark, sf), Payout()))


@query("""WITH p AS (SELECT event_type, 1 + event_id % 20 AS stake, (1 + event_id % 20) * 1.85::DOUBLE AS winning_return, count(*) AS n FROM events GROUP BY ALL)
  SELECT event_type, stake::DOUBLE AS stake, round(winning_return, 6) AS winning_return, round(winning_return - stake, 6) AS win, -stake::DOUBLE AS loss, round(stake / winning_return, 6) AS break_even, n FROM p""")
def payout_table(spark, sf):
    """What each stake of the events pays and costs, and how often a bet on it must win."""
    stake = (1 + F.col("event_id") % 20).cast("double")
    bets = spark.read.parquet(f"{sf}/events.parquet").select("event_type", stake.alias("stake"), (stake * 1.85).alias("winning_return"))
    return rounded(settlement.payouts(bets, "event_type"))


def _events_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query(f"SELECT {sql.rounded(BAR, ['symbol', 'open_time', 'close_time'])} FROM ({B60}) WHERE open_time + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)")
def stream_bars(spark, sf):
    """Bars of the event stream whose hour is over, the watermark considered."""
    made = jobs.stream_bars(_events_stream(spark, sf).withColumn("symbol", F.lit("ALL")), 60, F.lit(100.0) + F.col("value"))
    rows = jobs.run_available(made, "stream-bars")
    return rounded(rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("open_time", "close_time")}))


@query("SELECT event_type, count(*) AS n_events FROM (SELECT DISTINCT event_id, event_type FROM events) GROUP BY event_type")
def stream_dedupe(spark, sf):
    twice = _events_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    once = jobs.stream_distinct(twice.select("event_id", "event_type", "ts"), ["event_id"])
    return jobs.run_available(once, "stream-dedupe").groupBy("event_type").agg(F.count("*").alias("n_events"))


@query("""WITH e AS (SELECT event_type AS symbol, event_id, ts, 100.0 + value AS price, event_id % 50 = 0 AS entry, CASE WHEN event_id % 100 = 0 THEN 1 ELSE -1 END AS direction FROM events),
  d AS (SELECT symbol, event_id, ts, price, direction, h, ts + h * INTERVAL 1 MINUTE AS target FROM e CROSS JOIN (VALUES (30), (60)) x(h) WHERE entry),
  o AS (SELECT symbol AS s, ts AS t, price AS p FROM e WHERE NOT entry)
  SELECT symbol, event_id, h::BIGINT AS horizon, CASE WHEN (p - price) * direction > 0 THEN 'WIN' ELSE 'LOSS' END AS result, round(p, 6) AS settle_price, t AS settled_time,
  CASE WHEN (p - price) * direction > 0 THEN 4.25 ELSE -5.0 END::DOUBLE AS pnl FROM d ASOF JOIN o ON d.symbol = o.s AND d.target <= o.t""")
def stream_settlement(spark, sf):
    """Every fiftieth event is an entry, the others are observations of its symbol.

    What the stream has closed with an observation stays as it is; entries that are still open when
    the feed ends, or had none in time, are settled from the table.
    """
    closed = jobs.run_available(jobs.live_settlement(_feed(_events_stream(spark, sf)), limit=360), "stream-settlement").filter("result <> 'UNRESOLVED'")
    feed = _feed(spark.read.parquet(f"{sf}/events.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))
    due = settlement.horizons(feed.filter("event_id IS NOT NULL"), time="ts")
    still = due.join(closed.select("symbol", "event_id", "horizon"), ["symbol", "event_id", "horizon"], "left_anti")
    late = settlement.first_at_or_after(still, "target_time", feed.filter("event_id IS NULL").drop("event_id", "direction"), "ts", ["price"]).filter("observed_time IS NOT NULL")
    won = (F.col("observed_price") - F.col("price")) * F.col("direction") > 0
    late = late.select(
        "symbol", "event_id", "horizon", F.when(won, "WIN").otherwise("LOSS").alias("result"), F.col("observed_price").alias("settle_price"), F.col("observed_time").alias("settled_time"),
        F.when(won, Payout().win).otherwise(Payout().loss).alias("pnl"),
    )
    rows = closed.drop("target_time").unionByName(late)
    return rounded(rows.withColumn("settled_time", F.col("settled_time").cast("timestamp_ntz")))


def _feed(events: DataFrame) -> DataFrame:
    entry = F.col("event_id") % 50 == 0
    return events.select(
        F.col("event_type").alias("symbol"), "ts", F.when(entry, F.col("event_id")).alias("event_id"),
        F.when(entry, F.when(F.col("event_id") % 100 == 0, 1).otherwise(-1)).alias("direction"), (F.lit(100.0) + F.col("value")).alias("price"),
    )


@query("""WITH e AS (SELECT event_type AS symbol, event_id, ts, 100.0 + value AS price, event_id % 50 = 0 AS entry, CASE WHEN event_id % 100 = 0 THEN 1 ELSE -1 END AS direction FROM events),
  d AS (SELECT symbol, event_id, ts, price, direction, h, ts + h * INTERVAL 1 MINUTE AS target FROM e CROSS JOIN (VALUES (30), (60)) x(h) WHERE entry),
  o AS (SELECT symbol AS s, ts AS t, price AS p FROM e WHERE NOT entry),
  j AS (SELECT d.*, CASE WHEN t <= target + INTERVAL 30 MINUTES THEN t END AS t, CASE WHEN t <= target + INTERVAL 30 MINUTES THEN p END AS p FROM d ASOF LEFT JOIN o ON d.symbol = o.s AND d.target <= o.t)
  SELECT symbol, event_id, h::BIGINT AS horizon, target AS target_time, CASE WHEN t IS NULL THEN 'UNRESOLVED' WHEN (p - price) * direction > 0 THEN 'WIN' ELSE 'LOSS' END AS result, round(p, 6) AS settle_price,
  t AS settled_time, CASE WHEN t IS NULL THEN NULL WHEN (p - price) * direction > 0 THEN 4.25 ELSE -5.0 END::DOUBLE AS pnl FROM j
  WHERE target + INTERVAL 30 MINUTES < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def live_settlement(spark, sf):
    """The same feed in parts of some days, as it comes: rows are up to 49 minutes late and out of order within a part."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    came = F.col("ts") + F.make_dt_interval(mins=F.pmod("event_id", F.lit(50)).cast("int"))
    rows = events.withColumn("part", F.floor(F.dayofmonth(came) / 8)).select("part", "event_id", "ts", "event_type", "value")
    feed, run = (f"{jobs.shared_dir(spark)}/live-{kind}-{uuid.uuid4().hex}" for kind in ("feed", "run"))
    for part in range(4):  # one after the other, as a feed leaves them; the stream goes on where it stopped
        rows.filter(F.col("part") == part).drop("part").write.mode("append").parquet(feed)
        stream = spark.readStream.schema(rows.drop("part").schema).parquet(feed)
        found = jobs.run_available(jobs.live_settlement(_feed(stream), delay="1 hour"), "live-settlement", run)
    return rounded(found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("target_time", "settled_time")}))


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: labels of the next six-hour bar with the coarse features known by then."""
    bars = b360(spark, sf_dir)
    known = labels.candidates(bars, 360).select("symbol", "prediction_time", "sample_id", "target_up", "label_valid", "invalid_reason")
    return known.join(feat.build(bars, feat.coarse_set(), 360), ["symbol", "prediction_time"])
