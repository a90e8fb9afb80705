"""Whether tables hold the same rows, by fingerprints of their parts instead of a comparison of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by, n, low, high, mixed``: the number of rows of each part and sums and xor of their 64-bit hashes.

    The order of rows doesn't matter and repeats count: three copies of a row are not one, which an
    xor alone can't tell. Tasks send one row a part. Numbers are hashed as doubles and times as
    microseconds, so a table read again as other types of the same values has the same fingerprint; -0.0 is 0.0.
    """
    def plain(name: str, kind: str):
        if kind in ("tinyint", "smallint", "int", "bigint"):
            return F.col(name).cast("bigint")
        if kind in ("float", "double"):
            return F.col(name).cast("double") + F.lit(0.0)
        return F.unix_micros(F.col(name).cast("timestamp")) if kind.startswith("timestamp") else F.col(name)

    kinds = dict(df.dtypes)
    # The place of a null is part of the hash, which skips nulls otherwise.
    parts = [x for c in columns for x in (F.col(c).isNull(), plain(c, kinds[c]))]
    hashed = df.select(*by, F.xxhash64(*parts).alias("h"))
    return hashed.groupBy(*by).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(0)).alias("low"),
        F.coalesce(F.sum(F.call_function("shiftrightunsigned", "h", F.lit(32))), F.lit(0)).alias("high"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("mixed"),
    )


def compare(tables: dict[str, DataFrame], columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by, table, n, n_first, equal`` of every table but the first against the first one, a row for each part of either."""
    (first, base), *others = tables.items()
    if not others:
        raise ValueError("two tables at least are needed")
    of = lambda name, df: fingerprint(df, columns, by).withColumn("table", F.lit(name))
    prints = of(first, base)
    for name, df in others:
        prints = prints.unionByName(of(name, df))
    mark = F.struct("n", "low", "high", "mixed")
    sides = prints.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("table", mark.alias("mark")))).alias("marks"))  # one entry a table
    names = F.explode(F.array(*[F.lit(name) for name, _ in others])).alias("table")
    pairs = sides.select(*by, "marks", names)
    own, want = F.try_element_at("marks", F.col("table")), F.try_element_at("marks", F.lit(first))
    return pairs.select(*by, "table", F.coalesce(own["n"], F.lit(0)).alias("n"), F.coalesce(want["n"], F.lit(0)).alias("n_first"), own.eqNullSafe(want).alias("equal"))


def assert_equal(tables: dict[str, DataFrame], columns: Sequence[str], by: Sequence[str] = ()) -> None:
    """Fail with the first few parts that differ."""
    wrong = compare(tables, columns, by).filter("NOT equal").limit(10).collect()
    if wrong:
        raise ValueError("tables differ: " + "; ".join(str(r.asDict()) for r in wrong))
