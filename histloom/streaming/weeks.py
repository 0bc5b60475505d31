"""Tumbling weeks over a stream of commits, and reading streams in bounded steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Window starts are counted from Thursday, 1970-01-01; the first Monday is four days on.
MONDAY = "4 days"
#: 3 January 1970 is a Saturday, 4 January the first Sunday.
SUNDAY = "3 days"


def read_stream(spark: SparkSession, path: str, schema: StructType | str, max_files: int = 1000) -> DataFrame:
    """A stream of Parquet files; no step takes more than ``max_files`` of them, however many have arrived."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def weekly_totals(events: DataFrame, key: Column, at: Column, sums: dict[str, Column] | None = None, late: str = "7 days", start: str = MONDAY) -> DataFrame:
    """key, week_start, events and sums of each week. ``at`` is a timestamp; null keys and times are left out. A week is closed ``late`` after its end; what comes later is dropped by the watermark."""
    sums = sums or {}
    rows = events.select(key.alias("key"), at.alias("at"), *[c.alias(f"s_{n}") for n, c in sums.items()]).filter("key is not null and at is not null").withWatermark("at", late)
    g = rows.groupBy("key", F.window("at", "7 days", startTime=start)).agg(F.count(F.lit(1)).alias("events"), *[F.coalesce(F.sum(f"s_{n}"), F.lit(0)).alias(n) for n in sums])
    return g.select("key", F.date_format(F.col("window.start"), "yyyy-MM-dd").alias("week_start"), "events", *sums)
