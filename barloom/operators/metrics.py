"""Diagnostics of predicted probabilities: ``y`` is 0 or 1, ``p`` the probability of 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip_probability, div

THRESHOLDS = (0.55, 0.575, 0.60, 0.625, 0.65, 0.675, 0.70)

#: Equal ranges of p; narrow, as real models put nearly all p close to 0.5. So many totals fit one task.
RANGES = 1 << 20


def auc(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; 0.5 with one class.

    Equal probabilities are summed first, so the running count is over distinct values, and with
    no grouping it runs within ranges of p whose totals are added before: no task sorts everything.
    """
    tied = df.groupBy(*by, "p").agg(F.sum("y").cast("double").alias("pos"), F.sum(1 - F.col("y")).cast("double").alias("neg"))
    tied = tied.withColumn("__cut", F.floor(F.col("p") * RANGES))
    totals = tied.groupBy(*by, "__cut").agg(F.sum("neg").alias("__n"))
    order = Window.partitionBy(*(by or (F.lit(1),))).orderBy("__cut")
    below = totals.select(*by, "__cut", (F.sum("__n").over(order) - F.col("__n")).alias("__below"))
    rows = tied.join(below, [*by, "__cut"])
    within = Window.partitionBy(*by, "__cut").orderBy("p")
    rows = rows.withColumn("less", F.col("__below") + F.sum("neg").over(within) - F.col("neg"))
    summed = rows.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("less") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p1"), F.sum("neg").alias("p0"))
    area = F.when((F.col("p1") > 0) & (F.col("p0") > 0), div(F.col("u"), F.col("p1") * F.col("p0"))).otherwise(F.lit(0.5))
    return summed.select(*by, area.alias("roc_auc"))


def _aggregates() -> list[Column]:
    y, p = F.col("y"), F.col("p")
    q = clip_probability(p)
    return [
        F.count("*").alias("n_samples"), F.avg("y").alias("positive_rate"), F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("binary_logloss"),
        F.avg((p - y) * (p - y)).alias("brier_score"), F.avg(F.when((p >= 0.5) == (y == 1), 1.0).otherwise(0.0)).alias("accuracy_at_0_5"),
        F.avg("p").alias("mean_probability"), F.stddev_pop("p").alias("std_probability"), F.min("p").alias("min_probability"), F.max("p").alias("max_probability"),
    ]


def probability_metrics(df: DataFrame) -> DataFrame:
    return df.agg(*_aggregates()).crossJoin(auc(df)).filter("n_samples > 0")


def _edges(bins: int) -> list[tuple[int, float, float]]:
    step = 1.0 / bins
    edges = [k * step for k in range(bins)] + [1.0]
    return [(k, edges[k], edges[k + 1]) for k in range(bins)]


def reliability(df: DataFrame, bins: int = 10) -> DataFrame:
    """One row per bin of p, empty ones too; the last bin holds its upper edge."""
    edges = _edges(bins)
    p = F.col("p")
    index = F.lit(bins - 1)
    for k, _, high in reversed(edges[:-1]):
        index = F.when(p < high, k).otherwise(index)
    inside = df.filter((p >= 0) & (p <= 1)).groupBy(index.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mp"), F.avg("y").alias("my"))
    names = [(k, f"[{lo:.1f}, {hi:.1f}{']' if k == bins - 1 else ')'}", lo, hi) for k, lo, hi in edges]
    frame = df.sparkSession.createDataFrame(names, "bin int, bin_range string, bin_lower double, bin_upper double")
    return frame.join(inside, "bin", "left").select(
        "bin_range", "bin_lower", "bin_upper", F.coalesce("n", F.lit(0)).alias("n_rows"), F.col("mp").alias("mean_predicted_probability"), F.col("my").alias("actual_up_rate"),
    )


def confidence(df: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Hits of confident predictions, long and short. All thresholds are counted in one pass."""
    y, p = F.col("y"), F.col("p")
    parts = []
    for q in thresholds:
        long, short = p >= q, p <= 1.0 - q
        parts += [
            F.count_if(long), F.count_if(long & (y == 1)), F.count_if(short), F.count_if(short & (y == 0)),
            F.count_if(long | short), F.count_if((long & (y == 1)) | (short & (y == 0))),
        ]
    counted = df.agg(F.array(*parts).alias("c"))
    rows = counted.select(F.posexplode(F.array(*[F.lit(q) for q in thresholds])).alias("k", "threshold_q"), "c")
    at = lambda j: F.element_at("c", F.col("k") * 6 + j + 1)
    return rows.select(
        "threshold_q", at(0).alias("long_count"), div(at(1), at(0)).alias("long_actual_up_rate"), at(2).alias("short_count"),
        div(at(3), at(2)).alias("short_actual_down_rate"), at(4).alias("combined_count"), div(at(5), at(4)).alias("combined_hit_rate"),
    )


def monthly(df: DataFrame, q: float = 0.55, time: str = "prediction_time") -> DataFrame:
    rows = df.withColumn("month", F.date_format(time, "yyyy-MM"))
    y, p = F.col("y"), F.col("p")
    long, short = p >= q, p <= 1.0 - q
    grouped = rows.groupBy("month").agg(
        *_aggregates(), F.count_if(long | short).alias("confidence_event_count"), F.count_if((long & (y == 1)) | (short & (y == 0))).alias("hits"),
    )
    return grouped.join(auc(rows, ("month",)), "month").select(
        "month", F.col("n_samples").alias("samples"), F.col("accuracy_at_0_5").alias("accuracy"), "roc_auc", "binary_logloss", "confidence_event_count",
        div(F.col("hits"), F.col("confidence_event_count")).alias("confidence_hit_rate"),
    )


def comparison(scored: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, variant: str = "variant") -> DataFrame:
    """One row per variant with its metrics and, per threshold, count and hit rate as columns."""
    y, p = F.col("y"), F.col("p")
    columns = []
    for q in thresholds:
        long, short = p >= q, p <= 1.0 - q
        name = f"q_{round(q * 1000):03d}".rstrip("0") if round(q * 1000) % 10 == 0 else f"q_{round(q * 1000):03d}"
        n, hits = F.count_if(long | short), F.count_if((long & (y == 1)) | (short & (y == 0)))
        columns += [n.alias(f"{name}_count"), div(hits, n).alias(f"{name}_hit_rate")]
    return scored.groupBy(variant).agg(*_aggregates(), *columns).join(auc(scored, (variant,)), variant)


def incremental(compared: DataFrame, base: str, metrics: tuple[str, ...] = ("roc_auc", "binary_logloss", "brier_score"), variant: str = "variant") -> DataFrame:
    """Differences of every other variant to ``base``."""
    b = compared.filter(F.col(variant) == base).select(*[F.col(m).alias(f"base_{m}") for m in metrics])
    rest = compared.filter(F.col(variant) != base).crossJoin(F.broadcast(b))
    return rest.select(variant, *[(F.col(m) - F.col(f"base_{m}")).alias(f"delta_{m}") for m in metrics])


def best_variant(compared: DataFrame, variant: str = "variant") -> DataFrame:
    return compared.orderBy(F.desc("roc_auc"), variant).limit(1).select(F.col(variant).alias("best_variant"), "roc_auc")


def group_importance(importance: DataFrame, groups: DataFrame) -> DataFrame:
    """Gain per feature group and its share of all gain; shares are 0 without any gain."""
    total = importance.agg(F.sum("gain").alias("total"))
    per = groups.join(importance, "feature", "left").groupBy("feature_group").agg(F.coalesce(F.sum("gain"), F.lit(0.0)).alias("gain"))
    return per.crossJoin(F.broadcast(total)).select("feature_group", "gain", F.coalesce(div(F.col("gain"), F.nullif(F.col("total"), F.lit(0.0))), F.lit(0.0)).alias("share"))
