"""Labels of the next bar, without looking beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import sample_id
from .bars import after
from .ordinal import neighbours

COLUMNS = (
    "sample_id", "prediction_time", "event_entry_time", "event_entry_price", "event_expiry_time", "event_expiry_price",
    "target_direction", "target_up", "label_valid", "invalid_reason",
)


def candidates(bars: DataFrame, minutes: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One candidate per bar: the next bar's open is entered at, its close settles.

    The next bar counts only if it opens exactly one interval later. A flat outcome keeps its
    entry but has no label. A task looks at one month of a series.
    """
    seen = ("open_time", "open", "close", "close_time")
    rows = neighbours(bars.select(*keys, *seen), {f"next_{c}": F.col(c) for c in seen}, keys, ahead=True)
    there = F.coalesce(F.col("next_open_time") == after(F.col("open_time"), minutes), F.lit(False))
    rows = rows.withColumn("there", there)
    move = F.col("next_close") - F.col("next_open")
    direction = F.when(F.col("there"), F.signum(move)).cast("int")
    return rows.select(
        *keys, sample_id(F.col("close_time")).alias("sample_id"), F.col("close_time").alias("prediction_time"),
        *[F.when(F.col("there"), F.col(f"next_{src}")).alias(name) for name, src in (
            ("event_entry_time", "open_time"), ("event_entry_price", "open"), ("event_expiry_time", "close_time"), ("event_expiry_price", "close"))],
        direction.alias("target_direction"), F.when(direction == 1, 1).when(direction == -1, 0).alias("target_up"),
        F.coalesce(direction != 0, F.lit(False)).alias("label_valid"),
        F.when(~F.col("there"), "missing_next_bar").alias("invalid_reason"),
    )


def samples(labelled: DataFrame) -> DataFrame:
    """Formal samples: candidates with an entry, flat ones included."""
    return labelled.filter(F.col("event_entry_time").isNotNull())


def report(labelled: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    entered = F.col("event_entry_time").isNotNull()
    return labelled.groupBy(*keys).agg(
        F.count("*").alias("total_candidates"), F.count_if(entered).alias("valid_events"), F.count_if(~entered).alias("invalid_events"),
        F.count_if(F.col("target_direction") == 0).alias("flat_events"), F.count_if(F.col("invalid_reason") == "missing_next_bar").alias("missing_next_bar"),
    )


def causality_check(given: DataFrame, bars: DataFrame, minutes: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Differences between given samples and the ones that their bars yield; a subset of them is fine."""
    compared = ["prediction_time", "event_entry_time", "event_entry_price", "event_expiry_time", "event_expiry_price", "target_direction", "target_up", "label_valid"]
    expected = samples(candidates(bars, minutes, keys)).select(*keys, "sample_id", *[F.col(c).alias(f"expected_{c}") for c in compared])
    on = [*keys, "sample_id"]
    joined = given.join(expected.withColumn("known", F.lit(True)), on, "left")
    known = F.coalesce("known", F.lit(False))
    repeated = given.groupBy(*on).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_ids"))
    counts = joined.agg(
        F.count("*").alias("n_rows"), F.count_if(~known).alias("unknown_ids"), F.count_if(F.col("invalid_reason").isNotNull()).alias("with_reason"),
        *[F.count_if(known & ~F.col(c).eqNullSafe(F.col(f"expected_{c}"))).alias(f"bad_{c}") for c in compared],
    )
    out = counts.crossJoin(repeated)
    wrong = sum((F.col(f"bad_{c}") for c in compared), F.col("unknown_ids") + F.col("with_reason") + F.col("duplicate_ids"))
    return out.withColumn("passed", wrong == 0)
