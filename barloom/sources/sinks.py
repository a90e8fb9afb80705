"""Tables, reports and run folders."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame

from .archives import replace_file


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """A Parquet table, committed as a whole."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    """A small report, such as bins or months, as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_json(report: DataFrame | dict, path: str) -> None:
    """A report of one row, or a mapping, as JSON without NaN."""
    content = report if isinstance(report, dict) else report.first().asDict(recursive=True)
    replace_file(path, json.dumps(content, indent=2, default=str, allow_nan=False, ensure_ascii=False).encode())


def new_run_folder(path: str) -> str:
    """A folder for one run; it must not hold anything yet."""
    if os.path.isdir(path) and os.listdir(path):
        raise FileExistsError(f"{path} holds an earlier run")
    os.makedirs(path, exist_ok=True)
    return path
