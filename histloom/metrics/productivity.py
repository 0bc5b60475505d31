"""Change sets, commits, contributors, hunks and line counts. ``scope`` are the columns that a result is given for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom.functions.rules import noop_line
from histloom.model import line_texts

DIFF_KINDS = ["ADD", "DELETE", "MODIFY", "RENAME"]


def change_set(commits: DataFrame, scope: list[str]) -> DataFrame:
    """Most and mean files in a commit; commits without files count as 0."""
    return commits.groupBy(*scope).agg(F.max("n_files").alias("max_files"), F.avg("n_files").alias("avg_files"))


def file_change_counts(changes: DataFrame, scope: list[str]) -> DataFrame:
    return changes.groupBy(*scope, "filename").agg(F.count(F.lit(1)).alias("changes"))


def commits_count(changes: DataFrame, scope: list[str]) -> DataFrame:
    """Modifications per resolved path; deletes share the null path."""
    return changes.groupBy(*scope, "path").agg(F.count(F.lit(1)).alias("modifications"))


def contributors(changes: DataFrame, scope: list[str], minor_below: float = 0.05) -> DataFrame:
    """Contributors of each path, those with less than ``minor_below`` of its lines, and distinct e-mails (experience).

    total is null where the path has no changed line; null e-mails are no contributor.
    """
    per = changes.groupBy(*scope, "path", "email").agg(F.sum(F.col("added") + F.col("deleted")).alias("n"))
    # totals from the states per contributor, which a join brings back: no path's rows meet in a window
    all_ = per.groupBy(*scope, "path").agg(F.sum("n").alias("t"), F.count("email").alias("experience"))
    cond = None
    b = all_.select(*[F.col(c).alias(f"_{c}") for c in (*scope, "path")], F.col("t"))
    for c in (*scope, "path"):
        e = per[c].eqNullSafe(b[f"_{c}"])
        cond = e if cond is None else cond & e
    share = per.join(b, cond).filter("t > 0 and n > 0 and email is not null")
    minor = share.groupBy(*scope, "path").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n") / F.col("t") < minor_below).alias("minor"))
    m = minor.select(*[F.col(c).alias(f"_{c}") for c in (*scope, "path")], "total", "minor")
    cond = None
    for c in (*scope, "path"):
        e = all_[c].eqNullSafe(m[f"_{c}"])
        cond = e if cond is None else cond & e
    return all_.join(m, cond, "left").select(*scope, "path", "total", "minor", "experience")


def hunks(m: Column) -> Column:
    """Runs of added or deleted lines in a raw diff; null for an empty diff."""
    marks = F.transform(F.split(m["diff"], "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: x.rlike("^[+-]"))
    # a run starts where a mark follows no mark
    flat = F.array_join(F.transform(marks, lambda b: F.when(b, "+").otherwise(" ")), "")
    return F.when(F.coalesce(m["diff"], F.lit("")) != "", F.regexp_count(flat, F.lit(r"\++")))


def hunks_count(changes: DataFrame, scope: list[str]) -> DataFrame:
    return changes.filter("hunks is not null").groupBy(*scope, "path").agg(F.median("hunks").alias("median_hunks"))


def noops(side: str):
    def count(m: Column) -> Column:
        lines = line_texts(m["diff_parsed"][side])
        return F.when(m["change_type_name"].isin(DIFF_KINDS), F.size(F.filter(lines, noop_line))).otherwise(0)

    return count


LINE_FIELDS = {"noop_added": noops("added"), "noop_removed": noops("deleted")}


def lines_count(changes: DataFrame, scope: list[str]) -> DataFrame:
    out = []
    for name, col in (("added", "added"), ("removed", "deleted"), ("noop_added", "noop_added"), ("noop_removed", "noop_removed")):
        out += [F.sum(col).alias(f"{name}_total"), F.max(col).alias(f"{name}_max"), F.bround(F.avg(col), 0).alias(f"{name}_avg")]
    return changes.groupBy(*scope, "path").agg(*out)


def accumulated(changes: DataFrame, scope: list[str]) -> DataFrame:
    """One pass per file: changes, churn, contributors, diff lines and changed lines."""
    return changes.groupBy(*scope, "filename").agg(
        F.count(F.lit(1)).alias("changes"), F.sum(F.col("added") + F.col("deleted")).alias("churn"), F.countDistinct("author").alias("contributors"), F.sum("diff_lines").alias("diff_lines"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted")
    )
