"""Reading the tables that queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histloom.functions.files import members


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_changes(commits: DataFrame, *fields: str, also: tuple[str, ...] = ()) -> DataFrame:
    """hash, file_pos and the named members of modified_files; one row per file of each delivery. also: commit columns to keep."""
    rows = commits.filter("hash is not null").select("*", members(*fields).alias("_files")).select("hash", *also, F.posexplode("_files").alias("file_pos", "m"))
    return rows.select("hash", *also, "file_pos", *[F.col(f"m.{f}").alias(f) for f in fields])
