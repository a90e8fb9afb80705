"""Monthly and daily archives: names, checksums, download, and their rows."""

from __future__ import annotations

import datetime as dt
import io
import os
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKET = "indexPriceKlines"
CHECKSUM = r"(?i)(?<![0-9a-f])([0-9a-f]{64})(?![0-9a-f])"


class ArchiveNotFound(Exception):
    """There is no such archive."""


class ChecksumError(Exception):
    """An archive isn't what its checksum says, or has none."""


@dataclass(frozen=True)
class Archive:
    symbol: str
    interval: str
    period: dt.date
    daily: bool = False

    @property
    def name(self) -> str:
        return f"{self.symbol}-{self.interval}-{self.period:%Y-%m-%d}.zip" if self.daily else f"{self.symbol}-{self.interval}-{self.period:%Y-%m}.zip"

    def url(self, base: str) -> str:
        return f"{base.rstrip('/')}/{'daily' if self.daily else 'monthly'}/{MARKET}/{self.symbol}/{self.interval}/{self.name}"

    def folder(self, root: str) -> str:
        return os.path.join(root, MARKET, self.symbol, self.interval, "daily" if self.daily else "monthly")


def months(start: dt.date, end: dt.date) -> list[dt.date]:
    """First days of the months from ``start`` to ``end``."""
    out, at = [], start.replace(day=1)
    while at <= end:
        out.append(at)
        at = (at + dt.timedelta(days=32)).replace(day=1)
    return out


def days_of(month: dt.date, start: dt.date, end: dt.date) -> list[dt.date]:
    last = (month + dt.timedelta(days=32)).replace(day=1) - dt.timedelta(days=1)
    first, last = max(month, start), min(last, end)
    return [first + dt.timedelta(days=k) for k in range((last - first).days + 1)]


def checksum_of(text: str) -> str:
    match = re.search(CHECKSUM, text)
    if not match:
        raise ChecksumError("no checksum in the text")
    return match[1].lower()


def sha256(data: bytes) -> str:
    import hashlib

    return hashlib.sha256(data).hexdigest()


Fetch = Callable[[str], bytes]  # raises ArchiveNotFound where there is nothing


def download(archive: Archive, base: str, root: str, fetch: Fetch, need_checksum: bool = True) -> tuple[str, bool]:
    """Path of a verified archive, and whether it was there already. Nothing unverified is kept."""
    url, folder = archive.url(base), archive.folder(root)
    path, sidecar = os.path.join(folder, archive.name), os.path.join(folder, archive.name + ".CHECKSUM")
    if os.path.exists(path) and os.path.exists(sidecar):
        with open(path, "rb") as data, open(sidecar, encoding="utf-8") as text:
            if sha256(data.read()) == checksum_of(text.read()):
                return path, True
    data = fetch(url)
    try:
        text = fetch(url + ".CHECKSUM").decode()
    except ArchiveNotFound:
        if need_checksum:
            raise ChecksumError(f"{archive.name} has no checksum") from None
        text = ""
    if text and sha256(data) != checksum_of(text):
        raise ChecksumError(f"{archive.name} does not match its checksum")
    os.makedirs(folder, exist_ok=True)
    for content, target in ((data, path), (text.encode(), sidecar)):
        if content:
            replace_file(target, content)
    return path, False


def replace_file(path: str, content: bytes) -> None:
    """Write a file as a whole or not at all."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(content)
            out.flush()
            os.fsync(out.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def download_range(symbol: str, interval: str, start: dt.date, end: dt.date, base: str, root: str, fetch: Fetch, need_checksum: bool = True) -> list[str]:
    """Archives of a range; a month that isn't there is fetched day by day."""
    paths = []
    for month in months(start, end):
        try:
            paths.append(download(Archive(symbol, interval, month), base, root, fetch, need_checksum)[0])
        except ArchiveNotFound:
            paths += [download(Archive(symbol, interval, day, daily=True), base, root, fetch, need_checksum)[0] for day in days_of(month, start, end)]
    return paths


def verified(spark: SparkSession, pattern: str, recursive: bool = True) -> DataFrame:
    """Every archive under a path with its checksum and that of its sidecar, all read by Spark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    zips = files.option("pathGlobFilter", "*.zip").load(pattern).select("path", F.sha2("content", 256).alias("sha256"))
    sums = files.option("pathGlobFilter", "*.CHECKSUM").load(pattern)
    text = F.lower(F.regexp_extract(F.col("content").cast("string"), CHECKSUM, 1))
    sums = sums.select(F.regexp_replace("path", r"\.CHECKSUM$", "").alias("path"), text.alias("expected"))
    return zips.join(sums, "path", "left").withColumn("ok", F.coalesce(F.col("sha256") == F.col("expected"), F.lit(False)))


def zip_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """Lines of all CSV files in all archives: ``file, member, line_no, line``. One archive is one row."""
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in sorted(n for n in archive.namelist() if n.lower().endswith(".csv")):
                        lines = archive.read(member).decode("utf-8-sig").splitlines()
                        if lines:
                            yield pd.DataFrame({"file": path, "member": member, "line_no": range(len(lines)), "line": lines})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(pattern)
    return files.select("path", "content").mapInPandas(unpack, "file string, member string, line_no long, line string")
