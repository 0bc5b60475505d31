"""Intermediate results that outlive an executor.

Iterative operators must cut their lineage. They do so by writing a Parquet table into the folder
that the cluster shares (``spark.checkpoint.dir``), so losing an executor loses nothing.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset: a fresh local one if the whole session is one process, else an error,
    as executors elsewhere would not see the driver's disk."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: intermediate tables are written there")
    if not getattr(sc, "_histloom_dir", None):
        sc._histloom_dir = tempfile.mkdtemp(prefix="histloom-")
        atexit.register(shutil.rmtree, sc._histloom_dir, ignore_errors=True)
    return "file://" + sc._histloom_dir


class Scratch:
    """Numbered tables of one operator run; ``drop`` frees those that no later step reads, ``keep`` all but those named."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count, self.live = 0, {}

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._histloom_path = path
        self.live[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in tables:
            if self.live.pop(df._histloom_path, None) is not None:
                path = jvm.org.apache.hadoop.fs.Path(df._histloom_path)
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *tables: DataFrame) -> None:
        """Free all tables but these, which a result still reads."""
        left = {t._histloom_path for t in tables}
        self.drop(*[t for p, t in self.live.items() if p not in left])


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_histloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="histloom-package-")  # on the driver, whence Spark serves it for as long as the context lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "histloom_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(root):
            for name in sorted(f for f in files if f.endswith(".py")):
                full = os.path.join(at, name)
                z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._histloom_shipped = True
