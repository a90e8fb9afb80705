"""Kline archives as a Spark data source: ``spark.read.format("kline_archives").load(root)``.

A partition is one archive. Its task reads the file once: it hashes the bytes, holds the hash against
the sidecar's, and parses the members. Archives whose name lies outside the wanted dates, by more than a
day, are left out when partitions are planned, so they are neither read nor unzipped.

Rows keep where they stood: ``file``, ``member`` and ``row``, the number of the row within its
member, which no shuffle changes.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .archives import ChecksumError, checksum_of

SCHEMA = "file string, member string, row long, open_time timestamp, open double, high double, low double, close double, close_time timestamp"
PRICES = ("open", "high", "low", "close")
#: Numbers from here on are milliseconds, smaller ones seconds.
MILLIS_FROM = 1e11
PERIOD = re.compile(r"-(\d{4})-(\d{2})(?:-(\d{2}))?\.zip$")


def period_of(name: str) -> tuple[dt.date, dt.date] | None:
    """First and last day of an archive by its name, or nothing if the name has no date."""
    found = PERIOD.search(name)
    if not found:
        return None
    first = dt.date(int(found[1]), int(found[2]), int(found[3] or 1))
    if found[3]:
        return first, first
    return first, (first + dt.timedelta(days=32)).replace(day=1) - dt.timedelta(days=1)


def header_name(cell: str) -> str:
    return re.sub("[^a-z0-9]", "", cell.lower())


def times(cells: pd.Series) -> pd.Series:
    """Texts to times. All numbers are an epoch, in milliseconds if the largest is large; else ISO texts."""
    numbers = pd.to_numeric(cells, errors="coerce")
    if len(cells) and numbers.notna().all() and np.isfinite(numbers).all():
        unit = 1_000 if numbers.abs().max() >= MILLIS_FROM else 1_000_000
        return pd.to_datetime((numbers * unit).astype("int64"), unit="us", utc=True)
    return pd.to_datetime(cells, utc=True, errors="coerce", format="ISO8601").astype("datetime64[us, UTC]")


def parse_member(content: bytes) -> pd.DataFrame:
    """``row`` and the canonical columns; what can't be read is null.

    Blank lines are dropped. A first line that names an open and a close time is a header; without
    one the close time is in the seventh column, or the sixth if there are only six.
    """
    lines = [line for line in content.decode("utf-8-sig").splitlines() if line.replace(",", "").strip()]
    cells = [[c.strip() for c in line.split(",")] for line in lines]
    names = [header_name(c) for c in cells[0]] if cells else []
    if "opentime" in names and "closetime" in names:
        cells = cells[1:]
        at = {c: names.index(c.replace("_", "")) if c.replace("_", "") in names else None for c in ("open_time", *PRICES, "close_time")}
        pick = lambda row, c: row[at[c]] if at[c] is not None and at[c] < len(row) else None
    else:
        order = {c: k for k, c in enumerate(("open_time", *PRICES))}
        pick = lambda row, c: row[k] if (k := order.get(c, 6 if len(row) >= 7 else 5)) < len(row) else None
    column = lambda c: pd.Series([pick(row, c) for row in cells], dtype="object")
    out = pd.DataFrame({"row": np.arange(len(cells), dtype=np.int64), "open_time": times(column("open_time"))})
    for c in PRICES:
        out[c] = pd.to_numeric(column(c), errors="coerce").astype("float64")
    return out.assign(close_time=times(column("close_time")))


@dataclass
class ArchivePartition(InputPartition):
    path: str
    sidecar: str | None

    def __init__(self, path: str, sidecar: str | None):
        self.path, self.sidecar = path, sidecar


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.checksum = options["path"], options.get("checksum", "required")
        if self.checksum not in ("required", "if_present"):
            raise ValueError("checksum is 'required' or 'if_present'")
        day = lambda k: dt.date.fromisoformat(options[k]) if options.get(k) else None
        self.start, self.end = day("start"), day("end")

    def store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)

    def wanted(self, name: str) -> bool:
        """An archive may hold bars of the day before or after those in its name."""
        period, day = period_of(name), dt.timedelta(days=1)
        return period is None or ((self.end is None or period[0] <= self.end + day) and (self.start is None or period[1] >= self.start - day))

    def partitions(self) -> list[ArchivePartition]:
        store, root = self.store()
        files = {f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file}
        found = sorted(p for p in files if p.lower().endswith(".zip") and self.wanted(p))
        return [ArchivePartition(p, f"{p}.CHECKSUM" if f"{p}.CHECKSUM" in files else None) for p in found]

    def read(self, partition: ArchivePartition) -> Iterator[pa.RecordBatch]:
        store, _ = self.store()
        with store.open_input_stream(partition.path) as source:
            content = source.read()
        if partition.sidecar is None:
            if self.checksum == "required":
                raise ChecksumError(f"{partition.path} has no checksum")
        else:
            with store.open_input_stream(partition.sidecar) as text:
                expected = checksum_of(text.read().decode())
            if hashlib.sha256(content).hexdigest() != expected:
                raise ChecksumError(f"{partition.path} does not match its checksum")
        types = {"file": pa.string(), "member": pa.string(), "row": pa.int64(), "open_time": pa.timestamp("us", "UTC"), **dict.fromkeys(PRICES, pa.float64()), "close_time": pa.timestamp("us", "UTC")}
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            members = sorted(n for n in archive.namelist() if n.lower().endswith(".csv"))
            if not members:
                raise ValueError(f"{partition.path} holds no CSV file")
            for member in members:
                rows = parse_member(archive.read(member)).assign(file=partition.path, member=member)
                yield pa.RecordBatch.from_pandas(rows[list(types)], schema=pa.schema(list(types.items())), preserve_index=False)


class ArchiveSource(DataSource):
    """Options: ``path``, a folder; ``start`` and ``end``, dates; ``checksum``, ``required`` or ``if_present``."""

    @classmethod
    def name(cls) -> str:
        return "kline_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, root: str, start: str | None = None, end: str | None = None, checksum: str = "required") -> DataFrame:
    """Rows of all archives below ``root`` that may hold bars of the dates, each verified and read once an action."""
    spark.dataSource.register(ArchiveSource)
    source = spark.read.format(ArchiveSource.name()).option("checksum", checksum)
    for name, value in (("start", start), ("end", end)):
        source = source.option(name, value) if value else source
    return source.load(root)
