"""Recursive averages (EMA, Wilder) of long series, in chunks.

e[t] = e[t-1] + alpha * (x[t] - e[t-1]) is affine in what a chunk starts with, so chunks run in
parallel as if each were seeded with its own first value. Each chunk then hands on only its first
value, its last result and its decay; those few rows are folded per series, and every row is
corrected by decay * (true start - assumed start).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def recursive_averages(df: DataFrame, averages: dict[str, tuple[str, float]], keys: tuple[str, ...] = ("symbol",), time: str = "open_time", chunk: str = "month") -> DataFrame:
    """Adds ``name: (column, alpha)`` for each average, seeded with the series' first value.

    The averaged columns hold no nulls; a chunk is one calendar unit of ``time``.
    """
    columns = list(df.columns)
    cut = df.withColumn("__c", F.date_trunc(chunk, F.col(time)).cast("timestamp"))
    parts = [T.StructField(f"__{kind}_{n}", T.DoubleType()) for n in averages for kind in ("e", "d", "f")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(time, kind="stable")
        k = np.arange(1, len(group) + 1)
        for name, (column, alpha) in averages.items():
            x = group[column].astype(float)
            group[f"__e_{name}"] = x.ewm(alpha=alpha, adjust=False).mean()
            group[f"__d_{name}"] = (1 - alpha) ** k
            group[f"__f_{name}"] = x.iloc[0]
        return group

    local = cut.groupBy(*keys, "__c").applyInPandas(run, T.StructType([*cut.schema.fields, *parts]))
    ends = local.groupBy(*keys, "__c").agg(*[F.max_by(f"__{kind}_{n}", time).alias(f"__{kind}_{n}") for n in averages for kind in ("e", "d", "f")])
    starts = [T.StructField(f"__s_{n}", T.DoubleType()) for n in averages]

    def carry(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__c", kind="stable")
        for name in averages:
            start, out = None, []
            for e, d, f in zip(group[f"__e_{name}"], group[f"__d_{name}"], group[f"__f_{name}"], strict=True):
                start = f if start is None else start
                out.append(start)
                start = e + d * (start - f)
            group[f"__s_{name}"] = out
        return group[[*keys, "__c", *[f"__s_{n}" for n in averages]]]

    key_fields = [ends.schema[k] for k in (*keys, "__c")]
    seeds = ends.groupBy(*keys).applyInPandas(carry, T.StructType([*key_fields, *starts]))
    joined = local.join(seeds, [*keys, "__c"])
    fixed = [(F.col(f"__e_{n}") + F.col(f"__d_{n}") * (F.col(f"__s_{n}") - F.col(f"__f_{n}"))).alias(n) for n in averages]
    return joined.select(*columns, *fixed)


def ema_alpha(length: int) -> float:
    return 2.0 / (length + 1)


def wilder_alpha(length: int) -> float:
    return 1.0 / length
