"""Weighted diff effort, code age, estimated hours, domains, work sessions and rhythm of developers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from histloom.functions import rules
from histloom.functions.numbers import half_even
from histloom.model import iso_week, line_pairs, line_texts, monday, sunday_week
from histloom.operators.sessions import sessions

WEIGHTS = {"added": 1.0, "deleted": 0.25, "updated": 0.75, "moved": 0.1}


def delta_counts(m: Column) -> Column:
    """added, deleted, updated and moved lines of a change, and its weighted delta; all 0 for files that are skipped.

    A line is moved if it was added as one text and deleted as one that differs in outer blanks at most. The lines of both sides are sorted so that
    equal ones lie together, and read once.
    """
    texts = F.struct(line_texts(m["diff_parsed"]["added"]).alias("a"), line_texts(m["diff_parsed"]["deleted"]).alias("d"))
    entry = lambda side: lambda x: F.struct(rules.stripped(x).alias("s"), x.alias("r"), F.lit(side).alias("side"), rules.delta_line(x).cast("int").alias("w"))
    counts = ["seen_a", "seen_d", "kinds", "here", "added", "deleted", "moved"]  # of the text less outer blanks: additions that count, whether deleted, kinds of raw text added; whether this raw text is added; results

    def counted(t: Column) -> Column:
        rows = F.array_sort(F.filter(F.concat(F.transform(t["a"], entry(0)), F.transform(t["d"], entry(1))), lambda x: x["s"] != ""))
        start = F.struct(F.lit("").alias("s"), F.lit("").alias("r"), *[F.lit(0).alias(c) for c in counts])
        closed = lambda st: {"added": st["added"] + F.when(st["seen_d"] > 0, 0).otherwise(st["seen_a"]), "moved": st["moved"] + F.when(st["seen_d"] > 0, st["kinds"]).otherwise(0)}

        def step(st: Column, x: Column) -> Column:
            other, add = st["s"] != x["s"], x["side"] == 0
            other_raw = other | (st["r"] != x["r"])
            kept = lambda c: F.when(other, 0).otherwise(st[c])
            here = F.when(other_raw, 0).otherwise(st["here"])
            c = closed(st)
            value = {
                "seen_a": kept("seen_a") + F.when(add, x["w"]).otherwise(0), "seen_d": F.when(add, kept("seen_d")).otherwise(1), "kinds": kept("kinds") + F.when(add & (here == 0), 1).otherwise(0),
                "here": F.when(add, 1).otherwise(here), "added": F.when(other, c["added"]).otherwise(st["added"]), "deleted": st["deleted"] + F.when(add | (here > 0), 0).otherwise(x["w"]), "moved": F.when(other, c["moved"]).otherwise(st["moved"]),
            }
            return F.struct(x["s"].alias("s"), x["r"].alias("r"), *[value[k].cast("int").alias(k) for k in counts])

        def done(st: Column) -> Column:
            c = closed(st)
            return F.struct(c["added"].alias("added"), st["deleted"].alias("deleted"), c["moved"].alias("moved"))

        sums = F.aggregate(rows, start, step, done)
        return F.struct(sums.alias("n"), F.size(t["a"]).alias("la"), F.size(t["d"]).alias("ld"))

    def paired(v: Column) -> Column:
        # a fifth of the pairs of raw additions and deletions is not an update
        pairs = F.greatest(F.least(v["la"], v["ld"]) - v["n"]["moved"], F.lit(0))
        return F.struct(v["n"]["added"].alias("added"), v["n"]["deleted"].alias("deleted"), F.floor(pairs * 8 / 10).cast("int").alias("updated"), v["n"]["moved"].alias("moved"))

    def weighed(v: Column) -> Column:
        delta = sum((v[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
        return F.struct(*[v[k].alias(f"d_{k}") for k in WEIGHTS], delta.alias("delta"))

    skip = rules.skipped_file(m["filename"]) | m["diff_parsed"].isNull()
    zero = F.struct(*[F.lit(0).alias(f"d_{k}") for k in WEIGHTS], F.lit(0.0).alias("delta"))
    # each step's value is bound once; written out in place, the steps would multiply
    return F.when(F.coalesce(skip, F.lit(True)), zero).otherwise(bound(bound(bound(texts, counted), paired), weighed))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with value computed once."""
    return F.transform(F.array(value), f)[0]


def diff_delta(commits: DataFrame, changes: DataFrame, scope: list[str], weekly: bool) -> DataFrame:
    """Delta, commits, files, active days and delta per day of each developer (and Monday week)."""
    by = [*scope, "dev", *(["week"] if weekly else [])]
    c = commits.withColumn("week", monday(F.col("local"))).groupBy(*by).agg(F.count(F.lit(1)).alias("commits"), F.countDistinct(F.to_date("local")).alias("active_days"))
    f = changes.withColumn("week", monday(F.col("local"))).groupBy(*by).agg(
        *[F.sum(f"dd.d_{k}").alias(f"lines_{k}") for k in WEIGHTS], F.countDistinct("filename").alias("files_changed")
    )
    r = f.select(*[F.col(k).alias(f"_{k}") for k in by], *[k for k in f.columns if k not in by])
    cond = F.lit(True)
    for k in by:
        cond = cond & c[k].eqNullSafe(r[f"_{k}"])
    j = c.join(r, cond, "left")
    num = [*[f"lines_{k}" for k in WEIGHTS], "files_changed"]
    out = j.select(*by, "commits", "active_days", *[F.coalesce(n, F.lit(0)).alias(n) for n in num])
    # weighed after the sums of whole numbers, so the result does not depend on their order
    out = out.withColumn("diff_delta", sum((F.col(f"lines_{k}") * w for k, w in WEIGHTS.items()), F.lit(0.0)))
    return out.withColumn("velocity_per_day", F.col("diff_delta") / F.greatest("active_days", F.lit(1)))


_NUMBERS = lambda lines: F.transform(lines, lambda x: x["no"])
AGE_FIELDS = {
    "adds": lambda m: _NUMBERS(F.filter(line_pairs(m["diff_parsed"]["added"]), lambda x: rules.provenance_line(x["text"]) & x["no"].isNotNull())), "dels": lambda m: _NUMBERS(F.filter(line_pairs(m["diff_parsed"]["deleted"]), lambda x: x["no"].isNotNull())),
    "prior": lambda m: _NUMBERS(F.filter(F.transform(F.split(F.coalesce(m["source_code_before"], F.lit("")), "\n", -1), lambda x, i: F.struct((i + 1).alias("no"), x.alias("text"))), lambda x: rules.provenance_line(x["text"]))),
}


def line_ages(changes: DataFrame, scope: list[str], recent: int = 30, old: int = 365, seed: int = 60) -> DataFrame:
    """Age class of each meaningful added line: by the last write at its line number, new if there is none or it was deleted.

    Per file and line number the history is one window. At the first change that touches a file's history, its meaningful
    prior lines are taken as written ``seed`` days before. In a change, deletions precede additions.
    """
    code = changes.filter(rules.code_file(F.col("filename")))
    code = code.select(*scope, "filename", "dev", "ts", "local", "hash", "file_idx", F.col("adds").alias("a"), F.col("dels").alias("d"), F.col("prior").alias("p"))
    touch = code.filter((F.size("a") > 0) | (F.size("d") > 0) | (F.size("p") > 0))
    first = touch.groupBy(*scope, "filename").agg(F.min(F.struct("ts", "hash", "file_idx")).alias("at"), F.min_by("p", F.struct("ts", "hash", "file_idx")).alias("p"))
    cols = [*scope, "filename", "dev", "ts", "local", "hash", "file_idx"]
    ev = lambda c, phase, op: code.select(*cols, F.lit(phase).alias("phase"), F.posexplode(c).alias("i", "no")).withColumn("op", F.lit(op))
    seeds = first.select(
        *scope, "filename", F.lit(None).cast("string").alias("dev"), (F.col("at.ts") - seed * 86400).alias("wrote"), F.col("at.ts").alias("ts"), F.lit(None).cast("timestamp_ntz").alias("local"),
        F.col("at.hash").alias("hash"), F.col("at.file_idx").alias("file_idx"), F.lit(0).alias("phase"), F.posexplode("p").alias("i", "no"),
    ).withColumn("op", F.lit("+"))
    events = ev("d", 1, "-").unionByName(ev("a", 2, "+")).withColumn("wrote", F.col("ts")).unionByName(seeds)
    w = Window.partitionBy(*scope, "filename", "no").orderBy("ts", "hash", "file_idx", "phase", "i")
    age = F.col("ts") - F.when(F.lag("op").over(w) == "+", F.lag("wrote").over(w))
    events = events.withColumn("age", F.when(age.isNull(), "new").when(age <= recent * 86400, "recent").when(age <= old * 86400, "old").otherwise("legacy"))
    return events.filter("phase = 2")


def code_provenance(ages: DataFrame, scope: list[str]) -> DataFrame:
    """Added lines by age class of each developer and Monday week, with shares."""
    kinds = ["new", "recent", "old", "legacy"]
    g = ages.groupBy(*scope, "dev", monday(F.col("local")).alias("week")).agg(F.count(F.lit(1)).alias("total_lines"), *[F.count_if(F.col("age") == k).alias(f"{k}_lines") for k in kinds])
    return g.select("*", *[(F.col(f"{k}_lines") / F.col("total_lines") * 100).alias(f"{k}_percent") for k in kinds])


def hours_changes(m: Column) -> Column:
    """Changed lines that count for hours: meaningful ones, or 70 % of the raw count where no lines are given."""
    texts = F.concat(line_texts(m["diff_parsed"]["added"]), line_texts(m["diff_parsed"]["deleted"]))
    raw = F.floor((F.coalesce(m["added_lines"], F.lit(0)) + F.coalesce(m["deleted_lines"], F.lit(0))) * 7 / 10)
    n = F.when(m["diff_parsed"].isNull(), raw).otherwise(F.size(F.filter(texts, rules.hours_line)))
    return F.when(F.coalesce(rules.trivial_file(m["filename"]), F.lit(True)), 0).otherwise(n).cast("long")


def work_hours(commits: DataFrame, gap: int = 7200, before: int = 1800, after: int = 900, cap: float = 8.0) -> DataFrame:
    """Sessions of each developer with estimated hours. commits needs ``worth``, the changes that count."""
    s = sessions(commits, F.col("dev"), F.col("ts"), gap, F.col("hash"), sums={"changes": F.col("worth")}, first={"first_local": F.col("local")})
    s = s.withColumns({"start": F.col("session_start") - before, "end": F.col("session_end") + after, "local_start": F.col("first_local") - F.make_dt_interval(secs=F.lit(before))})
    raw = (F.col("end") - F.col("start")) / 3600.0
    h = F.when(F.col("events") == 1, raw * 0.75).when(F.col("events") > 10, raw * 0.9).otherwise(raw)
    s = s.withColumn("h", h)
    rate = F.col("changes") / F.greatest(F.lit(0.1), F.col("h"))
    hours = F.least(F.when(rate > 1000, F.col("h") * 0.8).when(rate < 50, F.col("h") * 1.1).otherwise(F.col("h")), F.lit(cap))
    return s.select(F.col("key").alias("dev"), "start", "end", "local_start", F.col("events").alias("commits"), "changes", hours.alias("hours"))


def scoped(commits: DataFrame, scope: list[str]) -> DataFrame:
    """Commits whose ``dev`` is the developer within the scope, so that what is computed for each developer is computed for each in each scope."""
    return commits.withColumn("dev", F.when(F.col("dev").isNotNull(), F.struct(*scope, "dev"))) if scope else commits


def unscoped(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Rows of ``scoped`` developers with the scope and the developer as columns again."""
    return rows.select(*[F.col("dev")[k].alias(k) for k in (*scope, "dev")], *[F.col(c) for c in rows.columns if c != "dev"]) if scope else rows


def developer_totals(work: DataFrame) -> DataFrame:
    """Hours (not rounded), sessions and commits of each developer."""
    return work.groupBy("dev").agg(F.sum("hours").alias("total_estimated_hours"), F.count(F.lit(1)).alias("total_sessions"), F.sum("commits").alias("total_commits"))


def developer_hours(work: DataFrame) -> DataFrame:
    """Hours, sessions, commits and hours per day of each developer and ISO week of the session's start."""
    g = work.groupBy("dev", iso_week(F.col("local_start")).alias("week")).agg(F.sum("hours").alias("h"), F.count(F.lit(1)).alias("sessions"), F.sum("commits").alias("commits"), F.countDistinct(F.to_date("local_start")).alias("days"))
    return g.select("dev", "week", half_even(F.col("h"), 2).alias("estimated_hours"), "sessions", "commits", half_even(F.col("h") / F.greatest("days", F.lit(1)), 2).alias("hours_per_day"))


def code_domain(changes: DataFrame, scope: list[str], weekly: bool) -> DataFrame:
    by = [*scope, "dev", *(["week"] if weekly else [])]
    n = F.col("added") + F.col("deleted")
    g = changes.withColumns({"n": n, "week": monday(F.col("local")), "domain": rules.domain(F.col("filename"))}).filter("n > 0").groupBy(*by, "domain").agg(F.sum("n").alias("lines"))
    # at most a dozen rows of one group meet here
    return g.withColumn("percent", F.col("lines") / F.sum("lines").over(Window.partitionBy(*by)) * 100)


DAY = 86400


def _gaps(commits: DataFrame) -> DataFrame:
    """dev, gap and n: how often each interval between successive commits of a developer occurs.

    Commits of one day and developer are ordered in a window of their own; across days only the first and last of each day are, so no window
    holds all commits of a developer.
    """
    c = commits.filter("dev is not null and ts is not null").select("dev", "ts", F.floor(F.col("ts") / DAY).alias("day"))
    inner = c.withColumn("gap", F.col("ts") - F.lag("ts").over(Window.partitionBy("dev", "day").orderBy("ts"))).filter("gap is not null").select("dev", "gap")
    days = c.groupBy("dev", "day").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    outer = days.withColumn("gap", F.col("lo") - F.lag("hi").over(Window.partitionBy("dev").orderBy("day"))).filter("gap is not null").select("dev", "gap")
    return inner.unionAll(outer).groupBy("dev", "gap").agg(F.count(F.lit(1)).alias("n"))


def basic_stats(commits: DataFrame) -> DataFrame:
    span = (F.max("ts") - F.min("ts")) / 86400.0
    g = commits.filter("dev is not null").groupBy("dev").agg(F.count(F.lit(1)).alias("total_commits"), F.countDistinct("repo").alias("total_repos"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), span.alias("s"), F.sum("lines").alias("total_lines_changed"), F.sum("n_files").alias("total_files_changed"))
    return g.filter("total_commits >= 2").select(
        "dev", "total_commits", "total_repos", "first_ts", "last_ts", half_even(F.col("s"), 2).alias("total_span_days"), half_even(F.col("total_commits") / F.greatest("s", F.lit(1.0)), 3).alias("commits_per_day"), "total_lines_changed", "total_files_changed"
    )


def interval_stats(commits: DataFrame) -> DataFrame:
    """Intervals between commits, and the breaks among them, from the counts of equal intervals."""
    mean = F.sum(F.col("gap") * F.col("n")) / F.sum("n")
    return _gaps(commits).groupBy("dev").agg(
        half_even(mean / 3600, 2).alias("mean_hours"), half_even(F.percentile("gap", 0.5, F.col("n")) / 3600, 2).alias("median_hours"), half_even(F.min("gap") / 60, 2).alias("min_minutes"), half_even(F.max("gap") / 86400.0, 2).alias("max_days"),
        F.sum(F.when(F.col("gap") <= 4 * 3600, F.col("n")).otherwise(0)).alias("short_breaks"), F.sum(F.when(F.col("gap") > 24 * 3600, F.col("n")).otherwise(0)).alias("long_breaks"), (mean / 3600).alias("avg_break_hours"),
    )


def work_sessions(commits: DataFrame, gap: int = 4 * 3600) -> DataFrame:
    """Sessions of developers with two commits or more, as measured (no padding)."""
    some = commits.groupBy("dev").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2 and dev is not null").select("dev")
    s = sessions(commits.join(some, "dev", "left_semi"), F.col("dev"), F.col("ts"), gap, F.col("hash"))
    return s.withColumn("hours", F.col("duration") / 3600.0).withColumnsRenamed({"key": "dev", "events": "commits"})


def session_stats(work: DataFrame) -> DataFrame:
    return work.groupBy("dev").agg(
        F.count(F.lit(1)).alias("session_count"), half_even(F.avg("hours"), 2).alias("avg_hours"), half_even(F.max("hours"), 2).alias("max_hours"), half_even(F.avg("commits"), 2).alias("avg_commits"), F.max("commits").alias("max_commits")
    )


def last_sessions(work: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("dev").orderBy(F.desc("session_start"))
    return work.withColumn("back", F.row_number().over(w)).filter(f"back <= {n}").select("dev", "back", "session_start", "session_end", half_even(F.col("hours"), 2).alias("hours"), "commits")


def daily_patterns(commits: DataFrame) -> DataFrame:
    """Commits by weekday (0 is Monday) and the peak day; of equal days the one seen first is the peak."""
    g = commits.filter("dev is not null").groupBy("dev", F.weekday("local").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "hash")).alias("seen"))
    # negated order: of equal counts the earliest wins
    peak = g.groupBy("dev").agg(F.sum("n").alias("t"), F.max("n").alias("peak_day_count"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "seen", "day")))[0]["day"].alias("peak_day"), *[F.sum(F.when(F.col("day") == d, F.col("n")).otherwise(0)).alias(f"day_{d}") for d in range(7)])
    return peak.filter("t >= 2").drop("t")


def weekly_patterns(commits: DataFrame) -> DataFrame:
    g = commits.filter("dev is not null").groupBy("dev", sunday_week(F.col("local")).alias("week")).agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("dev").agg(F.count(F.lit(1)).alias("total_weeks"), F.avg("n").alias("avg_per_week"), F.max("n").alias("max_per_week"), F.min("n").alias("min_per_week"), F.sum("n").alias("t")).filter("t >= 2").drop("t")


def rhythm(commits: DataFrame, work: DataFrame, compat: bool = False) -> DataFrame:
    """Commits per day of the span, and sessions per day (0 with ``compat``)."""
    g = commits.filter("dev is not null").groupBy("dev").agg(F.count(F.lit(1)).alias("n"), (F.floor((F.max("ts") - F.min("ts")) / 86400) + 1).alias("days")).filter("n >= 2")
    s = work.groupBy("dev").agg(F.count(F.lit(1)).alias("k"))
    score = F.lit(0.0) if compat else F.coalesce("k", F.lit(0)) / F.col("days")
    return g.join(s, "dev", "left").select("dev", (F.col("n") / F.col("days")).alias("activities_per_day"), score.alias("consistency_score"))


def sustained(commits: DataFrame) -> DataFrame:
    """Active days, longest streak of consecutive days, commits per active day."""
    days = commits.filter("dev is not null").groupBy("dev", F.to_date("local").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("dev").orderBy("day")
    isles = days.withColumn("isle", F.date_sub("day", F.row_number().over(w))).groupBy("dev", "isle").agg(F.count(F.lit(1)).alias("len"), F.sum("n").alias("n"))
    g = isles.groupBy("dev").agg(F.sum("len").alias("total_active_days"), F.max("len").alias("max_consecutive_days"), F.sum("n").alias("t")).filter("t >= 2")
    return g.select("dev", "total_active_days", "max_consecutive_days", (F.col("t") / F.col("total_active_days")).alias("avg_per_active_day"))


def repo_activity(commits: DataFrame) -> DataFrame:
    return commits.groupBy("repo").agg(F.count(F.lit(1)).alias("commits"), F.countDistinct("dev").alias("developers"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def time_analysis(commits: DataFrame) -> DataFrame:
    """One row per developer with two commits or more: what the functions above give, side by side."""
    c = commits
    work = work_sessions(c)
    out = basic_stats(c)
    for part in (interval_stats(c), session_stats(work), daily_patterns(c), weekly_patterns(c), rhythm(c, work), sustained(c)):
        out = out.join(part, "dev", "left")
    return out
