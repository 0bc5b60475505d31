"""The metrics by name, so that a caller can run them over any scope and add its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histloom import model
from histloom.metrics import productivity, quality, timing

Metric = Callable[[DataFrame, list[str]], DataFrame]
_METRICS: dict[str, Metric] = {}


def metric(name: str):
    """Register ``f(raw_commits, scope) -> DataFrame`` under a name. The rows carry every column of the scope."""

    def add(f: Metric) -> Metric:
        _METRICS[name] = f
        return f

    return add


def names() -> list[str]:
    return sorted(_METRICS)


def compute(name: str, raw: DataFrame, scope: list[str] | None = None) -> DataFrame:
    return _METRICS[name](raw, ["repo"] if scope is None else scope)


def _scoped(raw: DataFrame, rows: DataFrame, scope: list[str]) -> DataFrame:
    return model.with_week(rows, model.commits_view(raw)) if "week_label" in scope else rows


def _of_commits(f):
    return lambda raw, scope: f(_scoped(raw, model.commits_view(raw), scope), scope)


def _of_changes(f, fields=None, paths=False):
    def run(raw: DataFrame, scope: list[str]) -> DataFrame:
        rows = _scoped(raw, model.changes_view(raw, fields), scope)
        return f(model.resolved_paths(rows, scope) if paths else rows, scope)

    return run


metric("change_set")(_of_commits(productivity.change_set))
metric("commits_count")(_of_changes(productivity.commits_count, paths=True))
metric("contributors")(_of_changes(productivity.contributors, paths=True))
metric("hunks_count")(_of_changes(productivity.hunks_count, {"hunks": productivity.hunks}, paths=True))
metric("lines_count")(_of_changes(productivity.lines_count, productivity.LINE_FIELDS, paths=True))
metric("code_churn")(_of_changes(quality.code_churn))
metric("true_churn")(_of_changes(lambda c, s: quality.true_churn(c, s, []), {"events": quality.line_events}))
metric("bugs")(_of_changes(quality.bugs, paths=True))
metric("code_movement")(_of_changes(quality.code_movement, quality.MOVE_FIELDS, paths=True))
metric("test_doc_pct")(_of_changes(quality.test_doc_pct, quality.DOC_FIELDS))
metric("code_provenance")(_of_changes(lambda c, s: timing.code_provenance(timing.line_ages(c, s), s), timing.AGE_FIELDS))
metric("code_domain")(_of_changes(lambda c, s: timing.code_domain(c, s, True)))


def verdicts(raw: DataFrame, scope: list[str]) -> DataFrame:
    """Which commits count as work, with their changed lines."""
    changes = model.changes_view(raw)
    lines = changes.groupBy("hash").agg(F.sum(F.col("added") + F.col("deleted")).alias("changed"))
    commits = _scoped(raw, model.commits_view(raw), scope).join(lines, "hash", "left").withColumn("changed", F.coalesce("changed", F.lit(0)))
    return quality.unrealistic(commits, scope)


@metric("meaningful_code")
def _meaningful(raw: DataFrame, scope: list[str]) -> DataFrame:
    return quality.meaningful_code(_scoped(raw, model.changes_view(raw, quality.MEANING_FIELDS), scope), verdicts(raw, scope), scope)


@metric("diff_delta")
def _delta(raw: DataFrame, scope: list[str]) -> DataFrame:
    changes = _scoped(raw, model.changes_view(raw, {"dd": timing.delta_counts}), scope)
    return timing.diff_delta(_scoped(raw, model.commits_view(raw), scope), changes, scope, True)


def _developers(raw: DataFrame, scope: list[str]) -> DataFrame:
    return timing.scoped(_scoped(raw, model.commits_view(raw), scope), scope)


@metric("developer_hours")
def _hours(raw: DataFrame, scope: list[str]) -> DataFrame:
    worth = model.changes_view(raw, {"w": timing.hours_changes}).groupBy("hash").agg(F.sum("w").alias("worth"))
    return timing.unscoped(timing.developer_hours(timing.work_hours(_developers(raw, scope).join(worth, "hash", "left"))), scope)


@metric("time_analysis")
def _time(raw: DataFrame, scope: list[str]) -> DataFrame:
    return timing.unscoped(timing.time_analysis(_developers(raw, scope)), scope)
