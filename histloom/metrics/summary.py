"""Developer summaries, trends and rankings, over the weekly results of the timing metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from histloom.functions.numbers import half_even


def weekly_stats(delta: DataFrame, provenance: DataFrame, hours: DataFrame) -> DataFrame:
    """One row per developer and Monday week, 0 where a metric has none. ISO weeks are brought to their Monday. Rows without developer are left out."""
    # ISO week 1 holds 4 January
    year, week = F.substring("week", 1, 4).cast("int"), F.substring("week", 7, 2).cast("int")
    monday = F.date_add(F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))).cast("date"), (week - 1) * 7)
    hours = hours.withColumn("week", F.date_format(monday, "yyyy-MM-dd")).select("dev", "week", "estimated_hours", "sessions", "hours_per_day")
    delta = delta.select("dev", "week", "diff_delta", "lines_added", "lines_updated", "lines_deleted", "lines_moved", "velocity_per_day", "active_days")
    prov = provenance.select("dev", "week", "new_percent", "recent_percent", "old_percent", "legacy_percent")
    joined = reduce(lambda a, b: a.join(b, ["dev", "week"], "full_outer"), [delta, prov, hours])
    return joined.filter("dev is not null").select("dev", "week", *[F.coalesce(c, F.lit(0)).alias(c) for c in joined.columns if c not in ("dev", "week")])


def trends(weekly: DataFrame) -> DataFrame:
    """Velocity trend, consistency, activity rate and means over active weeks of each developer.

    Trend: mean delta of the last four weeks against the four before (or all before, with less than eight weeks). Consistency: 100
    less the coefficient of variation in per cent over the last eight weeks; 100 with one week, 0 where the mean is 0.
    """
    w = Window.partitionBy("dev").orderBy(F.desc("week"))
    all_ = weekly.withColumns({"back": F.row_number().over(w), "n": F.count(F.lit(1)).over(Window.partitionBy("dev"))})
    d, back = F.col("diff_delta"), F.col("back")
    older = (back > 4) & ((F.col("n") < 8) | (back <= 8))
    g = all_.groupBy("dev").agg(
        F.max("n").alias("weeks"), F.avg(F.when(back <= 4, d)).alias("recent"), F.avg(F.when(older, d)).alias("older"), F.avg(F.when(back <= 8, d)).alias("m"), F.stddev_samp(F.when(back <= 8, d)).alias("sd"),
        F.count(F.when(d > 0, 1)).alias("active"), F.avg(F.when(d > 0, d)).alias("avg_weekly_velocity"), F.avg(F.when(d > 0, F.col("estimated_hours"))).alias("avg_weekly_hours"), F.sum("diff_delta").alias("total_diff_delta"),
    )
    change = F.when(F.col("older").isNull() | (F.col("older") == 0), 0.0).otherwise(half_even((F.col("recent") - F.col("older")) / F.col("older") * 100, 2))
    steady = F.when(F.col("weeks") < 2, 100.0).when(F.col("m") == 0, 0.0).otherwise(half_even(F.greatest(F.lit(0.0), 100 - F.col("sd") / F.col("m") * 100), 2))
    return g.select(
        "dev", "weeks", "total_diff_delta", change.alias("velocity_trend"), steady.alias("consistency"), half_even(F.col("active") / F.col("weeks") * 100, 2).alias("activity_rate"),
        F.coalesce("avg_weekly_velocity", F.lit(0.0)).alias("avg_weekly_velocity"), F.coalesce("avg_weekly_hours", F.lit(0.0)).alias("avg_weekly_hours"),
    )


def developer_summary(trend: DataFrame, velocity: DataFrame, hours: DataFrame, time: DataFrame, domains: DataFrame, compat: bool = False) -> DataFrame:
    """One row per developer with what each timing metric says; 0 or 'unknown' where it says nothing. ``compat`` gives no rows.

    trend: ``trends``; velocity: diff_delta rows, one per developer; hours: developer_totals; time: time_analysis; domains: code_domain rows.
    """
    main = domains.filter("dev is not null").groupBy("dev").agg(F.max_by("domain", F.struct("lines", "domain")).alias("main_domain"))
    time = time.select(
        "dev", "total_repos", "total_span_days", "commits_per_day", "total_lines_changed", "total_files_changed", F.col("avg_hours").alias("avg_session_hours"), (F.col("avg_hours") * 60).alias("avg_session_minutes"),
        F.col("avg_commits").alias("avg_commits_per_session"), "session_count", "max_consecutive_days", "total_active_days", "avg_per_active_day", "short_breaks", "long_breaks", (F.col("mean_hours") * 60).alias("mean_interval_minutes"),
        (F.col("median_hours") * 60).alias("median_interval_minutes"), F.col("max_days").alias("max_gap_days"), "peak_day", "peak_day_count", F.col("total_weeks").alias("weeks_active"), F.col("avg_per_week").alias("avg_commits_per_week"),
        "activities_per_day", F.col("consistency_score").alias("session_consistency"),
    )
    parts = [trend, velocity.filter("dev is not null").select("dev", F.col("commits").alias("total_commits")), hours.filter("dev is not null").select("dev", "total_estimated_hours"), time, main]
    out = reduce(lambda a, b: a.join(b, "dev", "full_outer"), parts)
    keep = [c for c in out.columns if c not in ("dev", "main_domain")]
    out = out.select("dev", *[F.coalesce(c, F.lit(0)).alias(c) for c in keep], F.coalesce("main_domain", F.lit("unknown")).alias("main_domain"))
    return out.limit(0) if compat else out


def top(rows: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The n developers with most of ``by``; of equals, the first by name. A top-k report."""
    return rows.orderBy(F.desc(by), "dev").limit(n).select("dev", F.col(by).cast("double").alias("value")).withColumn("ranking", F.lit(by))
