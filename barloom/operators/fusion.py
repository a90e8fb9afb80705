"""Coarse and fine features side by side, joined to samples, and the views that models see."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import any_bad
from .checks import unique
from .features import align, build, coarse_set, fine_set
from .ordinal import BLOCK_ROWS

SAMPLE = ("sample_id", "prediction_time", "split", "target_up", "label_valid")
VALIDITY = ("coarse_feature_valid", "fine_feature_valid", "alignment_valid", "multires_feature_valid", "feature_valid", "common_eligible")


def coarse_names() -> list[str]:
    return [f"c30_{n}" for n in coarse_set().names()]


def fine_names() -> list[str]:
    return fine_set().names()


@dataclass(frozen=True)
class View:
    name: str
    groups: dict[str, list[str]]
    valid: tuple[str, ...]

    @property
    def names(self) -> list[str]:
        return [n for group in self.groups.values() for n in group]


def view(name: str) -> View:
    """A view by its name or one of its short names, in any case."""
    short = name.strip().lower().replace("_", "-")
    if short in ("price-ohlc-v1", "price-coarse-30m-v1", "b1-c", "coarse", "c"):
        return View("coarse", {"coarse": coarse_names()}, ("coarse_feature_valid",))
    if short in ("price-5m-v1", "b1-f", "fine", "f"):
        return View("fine", {"fine": fine_names()}, ("fine_feature_valid", "alignment_valid"))
    if short in ("price-multires-v1", "b1-mr", "multires", "mr"):
        return View("multires", {"coarse": coarse_names(), "fine": fine_names()}, ("multires_feature_valid",))
    raise ValueError(f"unknown view: {name!r}")


def fuse(coarse: DataFrame, fine: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Both resolutions at the coarse prediction times; ``fine`` is aligned to them already.

    A row of either side without its counterpart fails the job: it would be lost without a word.
    """
    c = coarse.select(
        *keys, "prediction_time", *[F.col(n).alias(f"c30_{n}") for n in coarse_set().names()],
        F.col("feature_valid").alias("coarse_feature_valid"), F.col("feature_invalid_reason").alias("coarse_reason"),
    )
    f = fine.select(*keys, "prediction_time", *fine_names(), F.col("feature_valid").alias("fine_feature_valid"), F.col("feature_invalid_reason").alias("fine_reason"), "alignment_valid")
    rows = c.withColumn("__c", F.lit(True)).join(f.withColumn("__f", F.lit(True)), [*keys, "prediction_time"], "full")
    lone = F.col("__c").isNull() | F.col("__f").isNull()
    rows = rows.filter(F.when(lone, F.raise_error(F.lit("a prediction time is on one side only")).cast("boolean")).otherwise(True)).drop("__c", "__f")
    bad = any_bad(coarse_names() + fine_names())
    why = lambda side: F.when(F.col(f"{side}_reason") == "non_finite_feature", "non_finite_feature").otherwise(f"{side}_history_invalid")
    reason = (
        F.when(~F.col("alignment_valid"), "alignment_invalid").when(~F.col("coarse_feature_valid"), why("coarse"))
        .when(~F.col("fine_feature_valid"), why("fine")).when(bad, "non_finite_feature")
    )
    rows = rows.withColumn("feature_invalid_reason", reason).withColumn("multires_feature_valid", F.col("feature_invalid_reason").isNull())
    return rows.select(
        *keys, "prediction_time", *coarse_names(), *fine_names(), "coarse_feature_valid", "fine_feature_valid", "alignment_valid",
        "multires_feature_valid", F.col("multires_feature_valid").alias("feature_valid"), "feature_invalid_reason",
    )


def multires(
    coarse_bars: DataFrame, fine_bars: DataFrame, coarse_minutes: int, fine_minutes: int, keys: tuple[str, ...] = ("symbol",), block_rows: int | None = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    coarse = build(coarse_bars, coarse_set(), coarse_minutes, keys, block_rows)
    times = coarse_bars.select(*keys, F.col("close_time").alias("prediction_time"))  # those of the coarse features, without building them again
    fine = align(build(fine_bars, fine_set(), fine_minutes, keys, block_rows), times, fine_names(), keys)
    return coarse, fine, fuse(coarse, fine, keys)


def dataset(samples: DataFrame, fused: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Samples with their features; rows without any are kept and never eligible.

    A prediction time that is repeated within a series on either side fails the job.
    """
    flags, on = VALIDITY[:-1], [*keys, "prediction_time"]
    joined = unique(samples.select(*keys, *SAMPLE), on, "samples").join(unique(fused, on, "features"), on, "left")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags})
    eligible = F.coalesce("label_valid", F.lit(False))
    for c in flags[:4]:
        eligible = eligible & F.col(c)
    return joined.withColumn("common_eligible", eligible).select(*keys, *SAMPLE, *VALIDITY, "feature_invalid_reason", *coarse_names(), *fine_names())


def project(data: DataFrame, name: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """A view of the common dataset, whose ``feature_valid`` is the view's own."""
    v = view(name)
    valid = F.lit(True)
    for c in v.valid:
        valid = valid & F.col(c)
    return data.withColumn("feature_valid", valid).select(*keys, *SAMPLE, *VALIDITY, "feature_invalid_reason", *v.names)


def model_rows(data: DataFrame, split: str) -> DataFrame:
    """Rows of one part that a model may see; what is null is out."""
    keep = (F.col("split") == split) & F.col("feature_valid") & F.col("common_eligible")
    return data.filter(F.coalesce(keep, F.lit(False)))


def reason_counts(features: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return features.groupBy(*keys, F.coalesce("feature_invalid_reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n_rows"))


def eligible_counts(data: DataFrame) -> DataFrame:
    e = F.col("common_eligible")
    return data.agg(F.count_if(e).alias("total"), *[F.count_if(e & (F.col("split") == s)).alias(s) for s in ("train", "validation", "test")])
