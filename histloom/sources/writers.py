"""Reports and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom.metrics.merge import CATEGORIES


def repo_reports(commits: DataFrame, repos: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """Header and totals of each repository, zero for those without commits; ``metrics`` (repo, value) becomes process_metrics."""
    totals = commits.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_commits"), F.sum("insertions").alias("total_lines_added"), F.sum("deletions").alias("total_lines_removed"),
        F.min("author_local").cast("string").alias("start_date"), F.max("author_local").cast("string").alias("end_date"),
    )
    out = repos.join(totals, repos["repo_name"] == totals["repo"], "left").drop("repo")
    out = out.select("username", "repo_name", "url", "start_date", "end_date", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_commits", "total_lines_added", "total_lines_removed")])
    if metrics is not None:
        out = out.join(metrics.withColumnRenamed("repo", "repo_name"), "repo_name", "left")
    return out


def process_metrics(weekly: dict[str, DataFrame]) -> DataFrame:
    """(repo, week_label, metrics): for each analysis week the rows of every metric, as a JSON object by category and metric.

    weekly: metric to its rows by repo and week_label. What is gathered in one row is one week of one repository.
    """
    out = None
    for category, names in CATEGORIES.items():
        for name in names:
            if name in weekly:
                rows = weekly[name]
                body = F.struct(*[c for c in rows.columns if c not in ("repo", "week_label")])
                part = rows.groupBy("repo", "week_label").agg(F.sort_array(F.collect_list(F.to_json(body))).alias("rows")).select("repo", "week_label", F.lit(category).alias("category"), F.lit(name).alias("metric"), F.concat(F.lit("["), F.array_join("rows", ","), F.lit("]")).alias("json"))
                out = part if out is None else out.unionAll(part)
    text = lambda c: F.concat(F.lit('"'), c, F.lit('": '))
    by_category = out.groupBy("repo", "week_label", "category").agg(F.sort_array(F.collect_list(F.struct("metric", "json"))).alias("m"))
    by_category = by_category.withColumn("json", F.concat(F.lit("{"), F.array_join(F.transform("m", lambda x: F.concat(text(x["metric"]), x["json"])), ", "), F.lit("}")))
    weeks = by_category.groupBy("repo", "week_label").agg(F.sort_array(F.collect_list(F.struct("category", "json"))).alias("c"))
    return weeks.select("repo", "week_label", F.concat(F.lit("{"), F.array_join(F.transform("c", lambda x: F.concat(text(x["category"]), x["json"])), ", "), F.lit("}")).alias("metrics"))


def report_lines(reports: DataFrame, commits: DataFrame, metrics: DataFrame | None = None, ecosystem: str = "", category: str = "") -> DataFrame:
    """(username, repo_name, part, seq, line): the lines of each repository's analysis file, in order of part and seq.

    reports: ``repo_reports``; commits: commit records, of which every member is written, in order of author date; metrics: ``process_metrics``. One line is a commit or a week,
    so no repository is gathered in one row. A report without commits has an empty list.
    """
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    entry = lambda k, v: F.concat(F.lit(f'  "{k}": '), v, F.lit(",\n"))
    null = lambda c: F.coalesce(quoted(F.substring(F.col(c), 1, 10)), F.lit('"None"'))
    head = F.concat(
        F.lit("{\n"), entry("project_name", quoted(F.col("username"))), entry("repository_url", quoted(F.col("url"))), entry("repository_name", quoted(F.col("repo_name"))), entry("ecosystem", quoted(F.lit(ecosystem))), entry("repo_category", quoted(F.lit(category))),
        F.lit('  "analysis_period": {"start_date": '), null("start_date"), F.lit(', "end_date": '), null("end_date"), F.lit(', "full_history": '), F.col("start_date").isNull().cast("string"), F.lit('},\n  "commits": ['),
    )
    tail = F.concat(
        F.lit('  },\n  "metrics_type": "weekly",\n  "processing": {"total_commits": '), F.col("total_commits").cast("string"), F.lit(', "total_lines_added": '), F.col("total_lines_added").cast("string"),
        F.lit(', "total_lines_removed": '), F.col("total_lines_removed").cast("string"), F.lit("}\n}"),
    )
    key = ["username", "repo_name"]
    line = lambda part, seq, text: [*key, F.lit(part).alias("part"), seq.cast("string").alias("seq"), text.alias("line")]
    first = lambda order: F.struct(F.min(order).alias("x"))["x"]
    named = reports.select(*key)
    body = commits.select(F.col("project_name").alias("repo_name"), F.concat_ws(" ", "author_date", "hash").alias("order"), F.to_json(F.struct(*[c for c in commits.columns if c != "extracted_at"])).alias("json"))

    def listed(rows: DataFrame, part: int, text: Column) -> DataFrame:
        least = rows.groupBy("repo_name").agg(first("order").alias("least"))
        rows = rows.join(least, "repo_name").join(named, "repo_name")
        return rows.select(*line(part, F.col("order"), F.concat(F.when(F.col("order") == F.col("least"), "    ").otherwise("    ,"), text)))

    out = reports.select(*line(0, F.lit(""), head)).unionAll(listed(body, 1, F.col("json"))).unionAll(reports.select(*line(2, F.lit(""), F.lit('  ],\n  "process_metrics": {'))))
    if metrics is not None:
        weeks = metrics.select(F.col("repo").alias("repo_name"), F.lpad(F.regexp_extract("week_label", r"^Week_(\d+)_", 1), 9, "0").alias("order"), F.concat(quoted(F.col("week_label")), F.lit(": "), F.col("metrics")).alias("json"))
        out = out.unionAll(listed(weeks, 3, F.col("json")))
    return out.unionAll(reports.select(*line(4, F.lit(""), tail)))


def write_report_lines(lines: DataFrame, path: str) -> None:
    """Text files below username=/repo_name=; the files of a folder, one after another by name, are the report. A large repository is written by several tasks."""
    order = ["username", "repo_name", "part", "seq"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("username", "repo_name", "line").write.mode("overwrite").partitionBy("username", "repo_name").text(path)


def report_json(reports: DataFrame) -> DataFrame:
    """The header and totals of each report as one JSON text."""
    body = F.struct(
        F.col("username").alias("project_name"), F.col("url").alias("repository_url"), F.col("repo_name").alias("repository_name"), F.struct("start_date", "end_date").alias("analysis_period"),
        F.struct("total_commits", "total_lines_added", "total_lines_removed").alias("processing"),
    )
    return reports.select("username", "repo_name", F.to_json(body).alias("report"))


def combined(reports: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Totals over each user's repositories and its repositories as a map; failed ones are listed."""
    g = reports.groupBy("username").agg(
        F.count(F.lit(1)).alias("repositories"), F.sum("total_commits").alias("total_commits"), F.sum("total_lines_added").alias("total_lines_added"), F.sum("total_lines_removed").alias("total_lines_removed"),
        F.to_json(F.map_from_entries(F.sort_array(F.collect_set(F.struct(F.concat(F.lit("repo_"), "repo_name").alias("k"), F.col("total_commits").alias("v")))))).alias("per_repository"),
    )
    if failed is None:
        return g
    return g.join(failed.groupBy("username").agg(F.sort_array(F.collect_set("repo_name")).alias("failed_repositories")), "username", "left")


def write_reports(reports: DataFrame, path: str) -> None:
    report_json(reports).write.mode("overwrite").partitionBy("username").json(path)


def with_completed(done: DataFrame, users: DataFrame) -> DataFrame:
    """The checkpoint with further users, each once."""
    return done.select("username").unionByName(users.select("username")).filter("username is not null").distinct()
