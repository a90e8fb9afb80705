"""Summaries of labels, features and datasets, each folded from one small grouped table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .features import coarse_set, fine_set
from .fusion import coarse_names, fine_names

#: Rows that a report lists one by one; it counts all of them.
LISTED = 1000


def label_counts(labelled: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``keys, invalid_reason, n, n_flat`` by reason, and over all reasons where ``all_reasons``: one pass."""
    cols = [F.col(k) for k in keys]
    sets = labelled.groupingSets([[*cols, F.col("invalid_reason")], cols], *cols, F.col("invalid_reason"))
    return sets.agg(
        F.grouping("invalid_reason").cast("boolean").alias("all_reasons"), F.count("*").alias("n"), F.count("event_entry_time").alias("n_entered"),
        F.count_if(F.col("event_entry_time").isNotNull() & (F.col("target_direction") == 0)).alias("n_flat"),
    )


def label_report(labelled: DataFrame, keys: tuple[str, ...] = ("symbol",), listed: int = LISTED) -> dict:
    """Counts over all series, counts by reason, and the first ``listed`` candidates without an outcome."""
    rows = label_counts(labelled, keys).collect()  # a row for each series and reason
    total = [r for r in rows if r.all_reasons]
    reasons: dict[str, int] = {}
    for r in rows:
        if not r.all_reasons and r.invalid_reason is not None:
            reasons[r.invalid_reason] = reasons.get(r.invalid_reason, 0) + r.n
    invalid = labelled.filter(F.col("invalid_reason").isNotNull()).orderBy("prediction_time", *keys).limit(listed)
    n, entered = sum(r.n for r in total), sum(r.n_entered for r in total)
    return {
        "total_candidate_events": n, "valid_events": entered, "invalid_events": n - entered, "flat_events": sum(r.n_flat for r in total), "invalid_reason_counts": dict(sorted(reasons.items())),
        "invalid_candidates": [r.asDict() for r in invalid.select(*keys, "sample_id", "prediction_time", "invalid_reason").collect()],
    }


def feature_counts(data: DataFrame, flags: tuple[str, ...], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Rows by part, by reason, and in all: ``keys, level, split, reason, n, n_labelled`` and ``n_<flag>`` of every flag.

    ``data`` has ``split``, ``label_valid``, ``feature_invalid_reason`` and the flags; a null flag is false.
    """
    reason = F.coalesce("feature_invalid_reason", F.lit("valid"))
    on = {f: F.coalesce(F.col(f), F.lit(False)) for f in flags}
    labelled = F.coalesce("label_valid", F.lit(False))
    rows = data.select(*keys, F.coalesce("split", F.lit("none")).alias("split"), reason.alias("reason"), labelled.alias("labelled"), *[v.alias(f) for f, v in on.items()])
    cols = [F.col(k) for k in keys]
    sets = rows.groupingSets([[*cols, F.col("split")], [*cols, F.col("reason")], cols], *cols, F.col("split"), F.col("reason"))
    level = F.when(F.grouping("split") == 0, "split").when(F.grouping("reason") == 0, "reason").otherwise("all")
    return sets.agg(
        level.alias("level"), F.count("*").alias("n"), *[F.count_if(F.col(f)).alias(f"n_{f}") for f in flags], *[F.count_if(F.col(f) & F.col("labelled")).alias(f"n_labelled_{f}") for f in flags],
    )


def _sum(rows: list[Row], name: str, **where: str) -> int:
    return sum(r[name] for r in rows if all(r[k] == v for k, v in where.items()))


def coarse_report(data: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> dict:
    """The twelve numbers and names of a coarse build. ``data`` has one row a feature row, with its sample's part if it has any."""
    rows = feature_counts(data, ("feature_valid",), keys).collect()  # a row for each series and part or reason
    n, valid = _sum(rows, "n", level="all"), _sum(rows, "n_feature_valid", level="all")
    return {
        "feature_set": "price_ohlc_v1", "feature_count": len(coarse_set().names()), "feature_names": coarse_set().names(), "total_rows": n, "valid_feature_rows": valid, "invalid_feature_rows": n - valid,
        **{key: _sum(rows, "n", level="reason", reason=why) for key, why in (
            ("insufficient_history_rows", "insufficient_history"), ("non_contiguous_history_rows", "non_contiguous_history"), ("non_finite_rows", "non_finite_feature"))},
        **{f"{part}_model_rows": _sum(rows, "n_labelled_feature_valid", level="split", split=part) for part in ("train", "validation")},
        "test_feature_rows": _sum(rows, "n_feature_valid", level="split", split="test"),
    }


FLAGS = ("coarse_feature_valid", "fine_feature_valid", "alignment_valid", "multires_feature_valid", "common_eligible")


def multires_report(fused: DataFrame, samples: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> dict:
    """The nineteen numbers and names of a fused build. ``fused`` has all prediction times, ``samples`` the eligible ones with their part.

    Both are counted in one pass: a fused row gets its sample's part and eligibility by a join on the key it is dealt by.
    """
    on = [*keys, "prediction_time"]
    rows = fused.join(samples.select(*on, "split", "label_valid", "common_eligible"), on, "left")
    found = feature_counts(rows, FLAGS, keys).collect()  # a row for each series and part or reason
    total = lambda name: _sum(found, name, level="all")
    reasons: dict[str, int] = {}
    for r in found:
        if r.level == "reason" and r.reason != "valid":
            reasons[r.reason] = reasons.get(r.reason, 0) + r.n
    return {
        "feature_set": "price_multires_v1", "coarse_feature_set": "price_ohlc_v1", "fine_feature_set": "price_5m_v1",
        "coarse_feature_count": len(coarse_names()), "fine_feature_count": len(fine_names()), "multires_feature_count": len(coarse_names()) + len(fine_names()),
        "coarse_feature_names": coarse_names(), "fine_feature_names": fine_set().names(), "multires_feature_names": coarse_names() + fine_names(),
        "total_prediction_rows": total("n"), "coarse_feature_valid_rows": total("n_coarse_feature_valid"), "fine_feature_valid_rows": total("n_fine_feature_valid"),
        "fine_alignment_valid_rows": total("n_alignment_valid"), "multires_feature_valid_rows": total("n_multires_feature_valid"), "common_eligible_rows": total("n_common_eligible"),
        **{f"common_eligible_{part}_rows": _sum(found, "n_common_eligible", level="split", split=part) for part in ("train", "validation", "test")},
        "invalid_reason_counts": dict(sorted(reasons.items())),
    }
