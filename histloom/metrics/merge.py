"""Merging finished results of parts (chunks, repositories) into one, as stored reports do it.

Such merges lose what a finished result no longer holds; where the raw rows are at hand, compute over them instead. Each rule names, per
column, how values of several parts combine: sum, min, max, mean (unweighted), last (of the greatest part that has one) or zero; percentages and rates are derived again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom.functions.numbers import half_even

_PCT = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b) * 100).otherwise(0.0)

#: metric: (key columns, {column: rule}, {derived column: expression})
RULES: dict[str, tuple[list[str], dict[str, str], dict[str, Callable[[], Column]]]] = {
    "change_set": ([], {"max_files": "max", "avg_files": "mean"}, {}),
    "commits_count": (["path"], {"modifications": "sum"}, {}),
    "contributors_count": (["path"], {"total": "max", "minor": "sum"}, {}),
    "contributors_experience": (["path"], {"experience": "max"}, {}),
    "hunks_count": (["path"], {"median_hunks": "sum"}, {}),
    "lines_count": (["path"], {f"{k}_{s}": {"total": "sum", "max": "max", "avg": "mean"}[s] for k in ("added", "removed", "noop_added", "noop_removed") for s in ("total", "max", "avg")}, {}),
    "code_churn": ([], {"total_count": "sum", "total_max": "max", "total_avg": "round_mean", "net_count": "sum", "net_max": "max", "net_avg": "round_mean", "added": "sum", "removed": "sum"}, {}),
    "true_churn": (["author"], {"contribution": "sum", "churn": "sum"}, {}),
    "bugs": (["path"], {"bug_percent": "mean", "bug_lines": "sum", "lines": "sum"}, {"overall_percent": lambda: _PCT("bug_lines", "lines")}),
    "code_movement": ([], {"moved_lines": "sum", "copied_lines": "sum", "changed_lines": "sum"}, {"moved_percent": lambda: _PCT("moved_lines", "changed_lines"), "copied_percent": lambda: _PCT("copied_lines", "changed_lines")}),
    "test_doc_pct": ([], {k: "sum" for k in ("total_files", "test_files", "doc_files", "total_lines", "test_lines", "doc_lines")}, {"test_percent": lambda: _PCT("test_lines", "total_lines"), "doc_percent": lambda: _PCT("doc_lines", "total_lines"), "quality_score": lambda: (F.col("test_percent") + F.col("doc_percent")) / 2}),
    "meaningful_code": (
        [], {k: "sum" for k in ("total_lines", "meaningful_lines", "files", "long_sequences", "repeated_chars", "repetitive_patterns", "auto_generated_total", "large_commits", "rapid_large_commits", "unrealistic_total", "skipped_lines")},
        {"meaningful_percent": lambda: _PCT("meaningful_lines", "total_lines"), "auto_generated_percent": lambda: _PCT("auto_generated_total", "total_lines"), "quality_score": lambda: F.lit(0.0)},
    ),
    "diff_delta": (["dev", "week"], {k: "sum" for k in ("diff_delta", "commits", "active_days", "files_changed", "lines_added", "lines_deleted", "lines_updated", "lines_moved")}, {"velocity_per_day": lambda: F.col("diff_delta") / F.greatest("active_days", F.lit(1))}),
    "code_provenance": (["dev", "week"], {k: "sum" for k in ("new_lines", "recent_lines", "old_lines", "legacy_lines", "total_lines")}, {f"{k}_percent": (lambda k=k: _PCT(f"{k}_lines", "total_lines")) for k in ("new", "recent", "old", "legacy")}),
    "developer_hours": (["dev", "week"], {"estimated_hours": "sum", "sessions": "sum", "commits": "sum", "hours_per_day": "zero"}, {}),
    "code_domain": (["dev", "domain"], {"lines": "sum"}, {}),
    "time_analysis": (
        ["dev"],
        {k: "sum" for k in ("total_commits", "total_lines_changed", "total_files_changed", "session_count", "total_weeks", "total_active_days", "short_breaks", "long_breaks", *(f"day_{d}" for d in range(7)))}
        | {"first_ts": "min", "last_ts": "max", "max_hours": "max", "max_commits": "max"}
        | {k: "last" for k in ("total_repos", "mean_hours", "median_hours", "min_minutes", "max_days", "avg_hours", "avg_commits", "avg_per_week", "max_per_week", "min_per_week", "avg_break_hours", "max_consecutive_days", "avg_per_active_day")},
        {
            "total_span_days": lambda: half_even((F.col("last_ts") - F.col("first_ts")) / 86400, 2), "commits_per_day": lambda: half_even(F.col("total_commits") / F.greatest("total_span_days", F.lit(1.0)), 3),
            "peak_day_count": lambda: F.greatest(*[f"day_{d}" for d in range(7)]), "peak_day": lambda: F.coalesce(*[F.when(F.col(f"day_{d}") == F.col("peak_day_count"), d) for d in range(7)]),
            "activities_per_day": lambda: F.col("commits_per_day"), "consistency_score": lambda: half_even(F.col("session_count") / F.greatest("total_span_days", F.lit(1.0)), 3),
        },
    ),
}


def merge(metric: str, parts: DataFrame, part: str = "part", scope: list[str] | None = None) -> DataFrame:
    """Merge rows of one metric from several parts, for each value of ``scope`` (the week, say). Columns that the rows lack are left out; null values add nothing."""
    keys, rules, derived = RULES[metric]
    how = {
        "sum": lambda c: F.sum(c), "min": lambda c: F.min(c), "max": lambda c: F.max(c), "mean": lambda c: F.avg(c), "round_mean": lambda c: F.bround(F.avg(c), 0), "zero": lambda c: F.lit(0.0),
        "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(part))),
    }
    out = parts.groupBy(*(scope or []), *keys).agg(*[how[r](c).alias(c) for c, r in rules.items() if c in parts.columns])
    for name, expr in derived.items():
        out = out.withColumn(name, expr())
    return out


#: The categories that weekly reports group the metrics under.
CATEGORIES = {
    "productivity": ["change_set", "commits_count", "contributors_count", "contributors_experience", "hunks_count", "lines_count"],
    "quality": ["bugs", "code_churn", "code_movement", "meaningful_code", "test_doc_pct", "true_churn"],
    "timings": ["code_domain", "code_provenance", "developer_hours", "diff_delta", "time_analysis"],
}


def merge_weekly(results: dict[str, DataFrame], part: str = "part") -> dict[tuple[str, str], DataFrame]:
    """Weekly results of several parts, merged for each week: {(category, metric): rows}.

    results: metric to rows with ``week_label`` and ``part``. A name that no category lists is left out; a metric whose rows lack a key of its rule gives no rows.
    """
    out = {}
    for category, names in CATEGORIES.items():
        for name in names:
            rows = results.get(name)
            if rows is not None:
                usable = set(RULES[name][0]) <= set(rows.columns)
                out[category, name] = merge(name, rows if usable else rows.limit(0).withColumns({k: F.lit(None).cast("string") for k in RULES[name][0] if k not in rows.columns}), part, ["week_label"])
    return out


def folded_developers(weekly: DataFrame) -> DataFrame:
    """One row per developer of merged weekly rows, as stored reports fold them: of each column, the last week's value stands."""
    cols = [c for c in weekly.columns if c not in ("dev", "week_label")]
    return weekly.groupBy("dev").agg(*[F.max_by(c, "week_label").alias(c) for c in cols])


def merge_any(parts: DataFrame, kind: str, value: str, how: Callable[[Column], Column] = F.sum) -> DataFrame:
    """Values of each kind, combined by a given aggregate."""
    return parts.groupBy(kind).agg(how(F.col(value)).alias(value))


def combined_weeks(reports: DataFrame, compat: bool = False) -> DataFrame:
    """Weekly figures over repositories: counts and totals add, maxima (names ending in max) are kept. With ``compat`` the first repository's values stand."""
    if compat:
        return reports.groupBy("week_label", "metric").agg(F.min_by("value", "repo").alias("value"))
    total = F.when(F.max("metric").endswith("max"), F.max("value")).otherwise(F.sum("value"))
    return reports.groupBy("week_label", "metric").agg(total.alias("value"))
