"""Small files by Hadoop's file systems, so that a path may be in any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _place(spark, path)
    return bool(fs.exists(at))


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _place(spark, path)
    fs.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Paths of all files below a folder, relative to it, in order."""
    fs, at = _place(spark, path)
    root, found, files = fs.makeQualified(at).toString().rstrip("/") + "/", [], fs.listFiles(at, True)
    while files.hasNext():
        found.append(files.next().getPath().toString()[len(root):])
    return sorted(found)


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """Write a whole file: first next to its place, then renamed, so it is never seen in part."""
    fs, at = _place(spark, path)
    if fs.exists(at) and not overwrite:
        raise FileExistsError(path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.part")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if overwrite:
        fs.delete(at, False)
    if not fs.rename(beside, at):
        raise OSError(f"{path} could not be put in place")


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _place(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(path)
    source = fs.open(at)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()
