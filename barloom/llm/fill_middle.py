"""Fill-in-the-middle transformation of texts, and its inverse.

A text is decoded to its code points as a numpy array. Each code point gets the class of its unit;
where neighbouring classes differ a unit ends. Two ranks among the units, drawn from a hash of the
document's id, choose where the prefix and the middle end; the pieces are slices of the array.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("char", "word", "line")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def spelled(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le")


def unit_classes(points: np.ndarray, unit: str) -> np.ndarray:
    """A class per code point that changes exactly where one unit ends and the next begins."""
    if unit == "char":
        return np.arange(len(points), dtype=np.uint32) & 1
    if unit == "line":  # a line keeps its line feed
        return np.concatenate([[0], np.cumsum(points == 10)[:-1]]) & 1
    if unit == "word":  # runs of spaces, of letters and digits, of anything else
        distinct, at = np.unique(points, return_inverse=True)
        kinds = [0 if (c := chr(p)).isspace() else 1 if c.isalnum() or unicodedata.category(c)[0] == "M" else 2 for p in distinct.tolist()]
        return np.array(kinds)[at]
    raise ValueError(f"unit is one of {', '.join(UNITS)}")


def boundaries(points: np.ndarray, unit: str) -> np.ndarray:
    """Where units begin, and the end of the text; one more than there are units."""
    if not len(points):
        return np.zeros(1, dtype=np.int64)
    classes = unit_classes(points, unit)
    return np.concatenate([[0], np.flatnonzero(classes[1:] != classes[:-1]) + 1, [len(points)]])


def transform(text: str | None, digest: str, unit: str, plain_percent: int, spm_percent: int) -> tuple:
    """``n, form, prefix_chars, middle_chars, output`` of one text."""
    text = text or ""
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or h3 % 100 >= 100 - plain_percent or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return len(text), "plain", None, None, text
    points = code_points(text)
    ends = boundaries(points, unit)
    first, second = (int(ends[rank]) for rank in sorted((h1 % len(ends), h2 % len(ends))))
    prefix, middle, suffix = spelled(points[:first]), spelled(points[first:second]), spelled(points[second:])
    if h4 % 100 < spm_percent:
        return len(text), "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return len(text), "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def rebuild(output: str, form: str) -> str:
    """The text from its transformed form; no sentinel can arise where a piece meets one."""
    if form == "plain":
        return output
    front, _, middle = output.partition(MIDDLE)
    one, _, other = front[3:].partition(SUFFIX if form == "psm" else PREFIX)
    return one + middle + other if form == "psm" else other + middle + one


def fill_in_middle(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", plain_percent: int = 10, spm_percent: int = 20, seed: str = "1",
) -> DataFrame:
    """``id_col, n, form, prefix_chars, middle_chars, output`` of every text.

    ``n`` and the lengths of the prefix and the middle are code points; both lengths are null where
    the form is ``plain``: an empty or null text, one that holds a sentinel, or one of the share
    left as it is. Ranks, share and order come from the sha256 of ``seed:id``, so equal rows are cut
    alike wherever they are, and a null id is hashed as an empty one. Texts of any length are whole;
    other columns are ignored; an empty table gives an empty result.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for digests, texts in batches:
            rows = [transform(t, d, unit, plain_percent, spm_percent) for d, t in zip(digests, texts, strict=True)]
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    parts = df.select(F.col(id_col).alias("__id"), cut(F.sha2(key.cast("binary"), 256), F.col(text_col)).alias("__cut"))
    return parts.select(F.col("__id").alias(id_col), "__cut.*")


def restored(output: Column, form: Column) -> Column:
    """The exact text that a transformed row was made from."""
    @F.pandas_udf("string")
    def whole(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for outputs, forms in batches:
            yield pd.Series([rebuild(o, f) for o, f in zip(outputs, forms, strict=True)], dtype="object")

    return whole(output, form)


ORACLE_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1, n - b) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p
"""
