"""spark-submit entry: repositories in, metrics and reports out.

Flags that only steer a single machine's threads, temporary folders or recursion are accepted and have no effect: Spark schedules.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histloom import model
from histloom.functions import rules
from histloom.plans import registry
from histloom.sources import readers, writers


LOG = logging.getLogger("histloom")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="histloom")
    p.add_argument("--commits", required=True, help="commit records (Parquet) or analysis files (JSON)")
    p.add_argument("--csv", help="repository list")
    p.add_argument("--folder", help="user name prefix, any case")
    p.add_argument("--out", required=True)
    p.add_argument("--written", help="folder of analysis files; the repositories they name are left out")
    p.add_argument("--overall", action="store_true", help="one result per repository in place of one per analysis week")
    p.add_argument("--ecosystem", default="")
    p.add_argument("--category", default="")
    p.add_argument("--done", help="checkpoint of completed users (Parquet)")
    for f in ("start-year", "start-month", "end-year", "end-month", "limit", "workers", "recursion-limit"):
        p.add_argument(f"--{f}", type=int)
    for f in ("cleanup-temp", "disable-parallel", "disable-repo-splitting", "force-reprocess"):
        p.add_argument(f"--{f}", action="store_true")
    p.add_argument("--metrics", nargs="*", default=None, help="names; all by default")
    return p


def commits_at(spark: SparkSession, path: str) -> DataFrame:
    """Commit records of a Parquet table, or of analysis files: one JSON file, a folder of them or a pattern."""
    if not (path.endswith(".json") or path.endswith("/json")):
        return spark.read.parquet(path)
    return readers.commits_of(readers.analysis_files(spark, path)).withColumn("extracted_at", F.lit(None).cast("timestamp"))


def run(spark: SparkSession, argv: list[str] | None = None) -> list[str]:
    """Write the weekly rows of each metric and the reports below --out; returns the names written.

    A metric that fails is logged, and left out of the reports; the others go on. Repositories of completed users and those that have an analysis file below --written are left out, unless --force-reprocess.
    """
    a = parser().parse_args(argv)
    raw = commits_at(spark, a.commits)
    local = F.to_timestamp_ntz(F.concat_ws(" ", F.substring("author_date", 1, 10), F.substring("author_date", 12, 8)))
    raw = raw.filter(readers.within_months(local, (a.start_year or 0, a.start_month or 0), (a.end_year or 0, a.end_month or 0)))
    done, repos = [], None
    if a.csv:
        repos = readers.usable_repos(readers.repo_list(spark, a.csv), a.folder, a.limit, rules.kept_source(F.col("url")))
        if a.done and not a.force_reprocess:
            repos = readers.not_done(repos, spark.read.parquet(a.done))
        if a.written and not a.force_reprocess:
            repos = readers.not_written(repos, readers.written_files(spark, a.written))
        raw = raw.join(repos.select(F.col("repo_name").alias("project_name")).distinct(), "project_name", "left_semi")
    weekly = {}
    for name in a.metrics or registry.names():
        try:
            rows = registry.compute(name, raw, ["repo"] if a.overall else ["repo", "week_label"])
            rows.write.mode("overwrite").parquet(f"{a.out}/{name}")
            weekly[name] = spark.read.schema(rows.schema).parquet(f"{a.out}/{name}")
            done.append(name)
        except Exception:
            LOG.exception("metric %s failed", name)
    if repos is not None:
        reports = writers.repo_reports(model.commits_view(raw), repos)
        metrics = writers.process_metrics(weekly) if weekly and not a.overall else None
        writers.write_report_lines(writers.report_lines(reports, model.first_deliveries(raw), metrics, a.ecosystem, a.category), f"{a.out}/reports")
        writers.combined(reports).write.mode("overwrite").json(f"{a.out}/combined")
        done.append("reports")
    return done


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    run(SparkSession.builder.appName("histloom").getOrCreate())
