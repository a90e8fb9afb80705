"""Sessions and the package's own code on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, for tasks that run its Python code."""
    context = spark.sparkContext
    if getattr(context, "_barloom_shipped", False):
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="barloom-code-"), "barloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("barloom", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._barloom_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset and the session is local,
    as in tests, a temporary folder is made, set as the checkpoint directory and removed at exit;
    on a cluster that would be a folder of one machine, so it is an error.
    """
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not given:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="barloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
        given = context.getCheckpointDir()
    return given


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once into the shared folder, for a small table of a large scan that a plan reads several times.

    Unlike ``checkpoint()`` the rows are read back by column. Plans on top may run at any time, so the files stay until
    the folder is cleared, as checkpoints do.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
