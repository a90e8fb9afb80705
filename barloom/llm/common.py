"""Helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch: a few MB of ordinary documents, and bounded for very long ones.
BATCH_ROWS, BATCH_BYTES = 1000, "32m"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole documents or index shards small enough for a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset and the session is local,
    as in tests, a temporary folder is made, set as the checkpoint directory and removed at exit;
    on a cluster that would be a folder of one machine, so it is an error.
    """
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not given:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        given = tempfile.mkdtemp(prefix="barloom-")
        atexit.register(shutil.rmtree, given, ignore_errors=True)
        context.setCheckpointDir(given)
        given = context.getCheckpointDir()
    return given


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it again.

    This cuts the lineage: the rows survive the loss of any executor and are computed once.
    ``discard`` removes them again; what a result still reads goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._barloom_folder = path
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return written


def discard(*written: DataFrame) -> None:
    """Remove what ``materialize`` wrote, once nothing reads it any more."""
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._barloom_folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bitmap_semi_filter(df: DataFrame, key: str, keys: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """Drop most rows of ``df`` whose ``key`` isn't among ``keys[key]``; never one that is.

    The keys are hashed into a bitmap of ``bits`` bits, kept as words of 64 bits. The bitmap has
    at most ``bits / 64`` rows however many keys there are (4 MB here), so it may be broadcast.
    """
    def slot(c):
        return F.pmod(F.xxhash64(F.col(c)), F.lit(bits))

    def mask(c):
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot(c), F.lit(64)).cast("int"))

    words = (
        keys.select(F.floor(slot(key) / 64).alias("__word"), mask(key).alias("__bit"))
        .groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    )
    probe = df.withColumns({"__word": F.floor(slot(key) / 64), "__bit": mask(key)})
    joined = probe.join(F.broadcast(words), "__word").filter(F.col("__bits").bitwiseAND(F.col("__bit")) != 0)
    return joined.select(*[F.col(c) for c in df.columns])


def crc_fold(column, modulus: int):
    """crc32 of an id written as text, modulo ``modulus``: the fold that held-out rows come from."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def sampled(df: DataFrame, ids: DataFrame, id_col: str, rows: int) -> DataFrame:
    """The rows of ``df`` whose id is among ``rows`` of ``ids``, chosen by a hash of the id.

    Only that many ids are broadcast; the choice depends neither on partitioning nor on order.
    """
    chosen = ids.select(F.col(id_col).alias("__id")).filter(F.col("__id").isNotNull()).distinct()
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    return df.join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).drop("__id")


_held: dict[str, Callable[[], None]] = {}


def claim(owner: str, release: Callable[[], None] | None = None) -> None:
    """Begin an operator's work in a Python worker, which other operators may have used before.

    ``release`` empties what the owner keeps there from task to task. Whatever others keep is
    released, and freed memory goes back to the system, so stages of one session don't add up.
    """
    others = [name for name in _held if name != owner]
    for name in others:
        _held.pop(name)()
    if release is not None:
        _held[owner] = release
    if others:
        gc.collect()
        give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if give_back is not None:
            give_back(0)
