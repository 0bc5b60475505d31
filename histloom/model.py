"""The data model: commits, their file changes, and the time keys that metrics group by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from histloom.functions.files import exploded
from histloom.functions.text import instant, strip



def _commit_columns() -> dict[str, Column]:
    local = lambda c: F.to_timestamp_ntz(F.concat_ws(" ", F.substring(strip(c), 1, 10), F.substring(strip(c), 12, 8)))
    date = F.col("committer_date")
    return {
        "repo": F.col("project_name"), "msg": F.col("msg"), "author": F.col("author.name"), "email": strip(F.col("author.email")), "dev": F.lower(strip(F.col("author.email"))),
        "ts": instant(date, F.col("committer_timezone")), "local": local(date), "author_ts": instant(F.col("author_date"), F.col("author_timezone")), "author_local": local(F.col("author_date")),
        "lines": F.coalesce("lines", F.lit(0)), "insertions": F.coalesce("insertions", F.lit(0)), "deletions": F.coalesce("deletions", F.lit(0)),
        "n_files": F.coalesce(F.size(F.col("modified_files.change_type")), F.lit(0)), "is_merge": F.coalesce("merge", F.lit(False)),
    }


def _first(v: str) -> Column:
    """The value in the earliest delivery; a delivery without time comes after those that have one."""
    return F.min_by(v, F.struct(F.col("extracted_at").isNull(), "extracted_at"))


def first_deliveries(raw: DataFrame) -> DataFrame:
    """Whole commit records, one per hash: the first delivery; failed extractions are kept."""
    v = F.struct(*[F.col(c) for c in raw.columns])
    return raw.filter("hash is not null").select("hash", "extracted_at", v.alias("v")).groupBy("hash").agg(_first("v").alias("v")).select("v.*")


def commits_view(raw: DataFrame, *extra: tuple[str, Column]) -> DataFrame:
    """One narrow row per commit: the first delivery of each hash, failed extractions left out."""
    cols = _commit_columns() | dict(extra)
    rows = raw.filter("hash is not null and error is null").select("hash", "extracted_at", F.struct(*[c.alias(n) for n, c in cols.items()]).alias("v"))
    return rows.groupBy("hash").agg(_first("v").alias("v")).select("hash", "v.*")


def changes_view(raw: DataFrame, fields: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """One row per file change of each commit (first delivery), with file_idx and any ``fields`` computed from the file.

    What is computed here is computed before the deliveries are merged, so wide texts are not shuffled unless asked for.
    """
    cc = {k: v for k, v in _commit_columns().items() if k in ("repo", "msg", "author", "email", "dev", "ts", "local", "author_local")}
    plain = lambda n: lambda m: m[n]
    count = lambda n: lambda m: F.coalesce(m[n], F.lit(0))
    wanted = {
        "filename": plain("filename"), "new_path": plain("new_path"), "old_path": plain("old_path"), "kind": plain("change_type_name"), "added": count("added_lines"), "deleted": count("deleted_lines"),
    }
    array, own = exploded(wanted | (fields or {}))
    rows = raw.filter("hash is not null and error is null").select("hash", "extracted_at", *[c.alias(f"c_{n}") for n, c in cc.items()], array.alias("files"))
    rows = rows.select("*", F.posexplode("files").alias("file_idx", "m"))
    rows = rows.select("hash", "file_idx", "extracted_at", F.struct(*[F.col(f"c_{n}").alias(n) for n in cc], *[c.alias(n) for n, c in own.items()]).alias("v"))
    return rows.groupBy("hash", "file_idx").agg(_first("v").alias("v")).select("hash", "file_idx", "v.*")


def line_texts(lines: Column) -> Column:
    """Texts of [number, text] pairs; an absent list is empty."""
    return F.coalesce(F.transform(lines, lambda x: F.coalesce(F.try_element_at(x, F.lit(2)), F.lit(""))), F.array().cast("array<string>"))


def line_pairs(lines: Column) -> Column:
    pair = lambda x: F.struct(F.try_element_at(x, F.lit(1)).cast("int").alias("no"), F.coalesce(F.try_element_at(x, F.lit(2)), F.lit("")).alias("text"))
    return F.coalesce(F.transform(lines, pair), F.array().cast("array<struct<no:int,text:string>>"))


# ---- week keys ----


def monday(local: Column) -> Column:
    return F.date_format(F.date_trunc("week", local), "yyyy-MM-dd")


def iso_week(local: Column) -> Column:
    year = F.extract(F.lit("YEAROFWEEK"), local)
    return F.format_string("%d-W%02d", year.cast("int"), F.weekofyear(local))


def sunday_week(local: Column) -> Column:
    """Year and Sunday-first week, days before the first Sunday in week 0."""
    week = F.floor((F.dayofyear(local) + 7 - F.dayofweek(local)) / 7).cast("int")
    return F.format_string("%d-W%02d", F.year(local), week)


def window_label(local: Column, start: Column, end: Column, contiguous: bool = False) -> Column:
    """Label of the analysis week that holds ``local``; null outside.

    Weeks start every seven days from ``start`` and last six days to the instant, so a day lies between two of them;
    ``contiguous`` closes that hole. A week must start before ``end``.
    """
    secs = F.timestamp_diff("SECOND", start, local)
    k = F.floor(secs / (7 * 86400))
    label = F.concat(F.lit("Week_"), (k + 1).cast("string"), F.lit("_"), F.date_format(start + F.make_dt_interval(k.cast("int") * 7), "yyyy-MM-dd"))
    inside = (secs >= 0) & (local <= end) & (secs - k * 7 * 86400 <= (7 if contiguous else 6) * 86400) & (start + F.make_dt_interval(k.cast("int") * 7) < end)
    return F.when(inside, label)


def with_week(rows: DataFrame, commits: DataFrame, contiguous: bool = False) -> DataFrame:
    """Rows of each repository with week_label, the range being that of its commits; rows in no week are dropped."""
    span = commits.groupBy("repo").agg(F.min("author_local").alias("_from"), F.max("author_local").alias("_to"))
    same = rows["repo"].eqNullSafe(span["repo"])
    return rows.join(span, same).drop(span["repo"]).withColumn("week_label", window_label(F.col("author_local"), F.col("_from"), F.col("_to"), contiguous)).drop("_from", "_to").filter("week_label is not null")


def week_ranges(start: str, end: str) -> list[tuple[str, str, str]]:
    """The analysis weeks of a range as (start, end, label)."""
    from datetime import datetime, timedelta

    at, stop, out = datetime.fromisoformat(start), datetime.fromisoformat(end), []
    while at < stop:
        out.append((str(at), str(min(at + timedelta(days=6), stop)), f"Week_{len(out) + 1}_{at:%Y-%m-%d}"))
        at += timedelta(days=7)
    return out


# ---- renames ----


def resolved_paths(changes: DataFrame, scope: list[str]) -> DataFrame:
    """``path`` for every change: new_path as redirected by earlier renames within the scope.

    A rename redirects later uses of its old path to what its new path stood for at that time. Each use looks up the last rename
    of its path before it (an as-of join, done as a window over uses and renames of one path); chains among renames are
    followed by doubling, over renames only.
    """
    spark = changes.sparkSession
    from histloom.tables import Scratch

    scratch = Scratch(spark, "renames")
    order = F.struct("ts", "hash", "file_idx")
    rid = F.struct("hash", "file_idx")
    # a change without new path (a delete) is redirected by nothing: all of a repository's deletes would meet in one window
    plain = changes.filter("new_path is null").withColumn("path", F.lit(None).cast("string"))
    uses = changes.filter("new_path is not null").withColumn("_at", order).withColumn("_key", F.col("new_path")).withColumn("_def", F.lit(None).cast("struct<hash:string,file_idx:int>"))
    defs = changes.filter("kind = 'RENAME' and old_path is not null").select(*scope, order.alias("_at"), F.col("old_path").alias("_key"), rid.alias("_def"))
    both = uses.unionByName(defs, allowMissingColumns=True).withColumn("_is_use", F.col("_def").isNull())
    w = Window.partitionBy(*scope, "_key").orderBy("_at", F.col("_is_use").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # a rename of a path to itself must not see its own definition: uses come first at one instant
    seen = both.withColumn("_ref", F.last("_def", ignorenulls=True).over(w)).filter("_is_use").drop("_def", "_is_use", "_key", "_at")
    seen = scratch.save(seen)
    link = scratch.save(seen.filter("kind = 'RENAME'").select(rid.alias("id"), "new_path", F.col("_ref").alias("ref")))
    while True:
        step = link.select(F.col("id").alias("ref"), F.col("new_path").alias("np2"), F.col("ref").alias("ref2"))
        longer = scratch.save(link.join(step, "ref", "left").select("id", F.coalesce("np2", "new_path").alias("new_path"), F.col("ref2").alias("ref")))
        scratch.drop(link)
        link = longer
        if link.filter("ref is not null").isEmpty():
            break
    target = link.select(F.col("id").alias("_ref"), F.col("new_path").alias("_target"))
    return seen.join(target, "_ref", "left").withColumn("path", F.coalesce("_target", "new_path")).drop("_ref", "_target").unionByName(plain)
