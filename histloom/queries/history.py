"""Queries of the history metrics over the whole commit table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histloom import model
from histloom.functions import rules
from histloom.metrics import merge, productivity, quality, summary, timing
from histloom.plans import registry
from histloom.queries.common import table
from histloom.sources import readers, writers
from histloom.tables import Scratch

REPO = ["repo"]
WEEK = ["repo", "week_label"]


def _commits(s: SparkSession, d: str) -> DataFrame:
    return model.commits_view(table(s, d, "commits"))


def _changes(s: SparkSession, d: str, fields=None) -> DataFrame:
    return model.changes_view(table(s, d, "commits"), fields)


def _paths(s: SparkSession, d: str, fields=None) -> DataFrame:
    return model.resolved_paths(_changes(s, d, fields), REPO)


def _weekly(s: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    return model.with_week(rows, _commits(s, d))


# ---- productivity ----


def a1_change_set(s, d):
    return productivity.change_set(_commits(s, d), REPO)


def a1_file_changes(s, d):
    return productivity.file_change_counts(_changes(s, d), REPO)


def a2_commits_count(s, d):
    return productivity.commits_count(_paths(s, d), REPO)


def a3_a4_contributors(s, d):
    return productivity.contributors(_paths(s, d), REPO)


def a5_hunks_count(s, d):
    return productivity.hunks_count(_paths(s, d, {"hunks": productivity.hunks}), REPO)


def a6_lines_count(s, d):
    return productivity.lines_count(_paths(s, d, productivity.LINE_FIELDS), REPO)


def j3_renamed_paths(s, d):
    return _paths(s, d).select("hash", "file_idx", "path")


def a46_accumulator(s, d):
    n = lambda m: F.size(model.line_texts(m["diff_parsed"]["added"])) + F.size(model.line_texts(m["diff_parsed"]["deleted"]))
    return productivity.accumulated(_changes(s, d, {"diff_lines": n}), REPO)


# ---- quality ----


def a7_code_churn(s, d):
    return quality.code_churn(_changes(s, d), REPO)


def _events(s, d):
    return _changes(s, d, {"events": quality.line_events})


def a8_true_churn(s, d):
    return quality.true_churn(_events(s, d), REPO, [])


def a8_true_churn_by_author(s, d):
    return quality.true_churn(_events(s, d), REPO, ["author"])


def a8_true_churn_by_file(s, d):
    return quality.true_churn(_events(s, d), REPO, ["file"])


def a9_file_churn(s, d):
    c = _events(s, d)
    return quality.with_true_churn(quality.file_report(c, REPO), c, REPO, ["file"])


def a10_commit_churn(s, d):
    return quality.commit_report(_changes(s, d))


def a11_weekly_churn(s, d):
    return quality.weekly_report(_changes(s, d).withColumn("week", model.monday(F.col("local"))), REPO)


def a11_weekly_true_churn(s, d):
    return quality.true_churn(_events(s, d).withColumn("week", model.monday(F.col("local"))), REPO, ["week"])


def a12_author_churn(s, d):
    c = _events(s, d)
    return quality.with_true_churn(quality.author_report(c, REPO), c, REPO, ["author"])


def a13_extracted_churn(s, d):
    return quality.file_churn(_changes(s, d), REPO).select("repo", "file", "total", "net")


def a14_bugs(s, d):
    return quality.bugs(_paths(s, d), REPO)


def a14_bugs_overall(s, d):
    return quality.bugs_overall(a14_bugs(s, d), REPO)


def a15_code_movement(s, d):
    return quality.code_movement(_paths(s, d, quality.MOVE_FIELDS), REPO)


def a16_test_doc_pct(s, d):
    return quality.test_doc_pct(_changes(s, d, quality.DOC_FIELDS), REPO)


def a18_meaningful_code(s, d):
    return registry.compute("meaningful_code", table(s, d, "commits"), REPO)


def a19_unrealistic_commits(s, d):
    return quality.unrealistic_totals(registry.verdicts(table(s, d, "commits"), REPO), REPO)


# ---- timing ----

DELTA = {"dd": timing.delta_counts}


def a20_diff_delta(s, d):
    return _changes(s, d, DELTA).select("hash", "file_idx", "dd.d_added", "dd.d_deleted", "dd.d_updated", "dd.d_moved", F.round("dd.delta", 6).alias("delta"))


def a21_velocity(s, d):
    return timing.diff_delta(_commits(s, d), _changes(s, d, DELTA), [], False)


def a21_velocity_weekly(s, d):
    return timing.diff_delta(_commits(s, d), _changes(s, d, DELTA), [], True)


def _provenance(s, d):
    return timing.code_provenance(timing.line_ages(_changes(s, d, timing.AGE_FIELDS), REPO), [])


def a22_code_provenance(s, d):
    return _provenance(s, d)


def _work(s, d):
    worth = _changes(s, d, {"w": timing.hours_changes}).groupBy("hash").agg(F.sum("w").alias("worth"))
    return timing.work_hours(_commits(s, d).join(worth, "hash", "left"))


def a24_sessions_2h(s, d):
    return _work(s, d).select("dev", "start", "end", "commits", "changes", F.round("hours", 6).alias("hours"))


def a27_developer_hours(s, d):
    return timing.developer_hours(_work(s, d))


def a27_developer_totals(s, d):
    t = timing.developer_totals(_work(s, d))
    return t.withColumn("total_estimated_hours", F.round("total_estimated_hours", 6))


def a28_code_domain(s, d):
    return timing.code_domain(_changes(s, d), [], False)


def a28_code_domain_weekly(s, d):
    return timing.code_domain(_changes(s, d), [], True)


def a29_basic_stats(s, d):
    return timing.basic_stats(_commits(s, d))


def a30_a34_intervals(s, d):
    return timing.interval_stats(_commits(s, d))


def a31_work_sessions(s, d):
    return timing.session_stats(timing.work_sessions(_commits(s, d)))


def a31_last_sessions(s, d):
    return timing.last_sessions(timing.work_sessions(_commits(s, d)))


def a32_daily_patterns(s, d):
    return timing.daily_patterns(_commits(s, d))


def a33_weekly_patterns(s, d):
    return timing.weekly_patterns(_commits(s, d))


def a35_rhythm(s, d):
    c = _commits(s, d)
    return timing.rhythm(c, timing.work_sessions(c))


def a36_sustained(s, d):
    return timing.sustained(_commits(s, d))


def a37_repo_activity(s, d):
    return timing.repo_activity(_commits(s, d))


def _weekly_stats(s, d):
    """Of the commit table two narrow views are made and kept, which the three metrics share."""
    scratch = Scratch(s, "weekly_stats")
    c, f = scratch.save(_commits(s, d)), scratch.save(_changes(s, d, DELTA | timing.AGE_FIELDS | {"w": timing.hours_changes}))
    worth = f.groupBy("hash").agg(F.sum("w").alias("worth"))
    provenance = timing.code_provenance(timing.line_ages(f, REPO), [])
    return summary.weekly_stats(timing.diff_delta(c, f, [], True), provenance, timing.developer_hours(timing.work_hours(c.join(worth, "hash", "left"))))


def a38_weekly_stats(s, d):
    return _weekly_stats(s, d)


def a39_a41_trends(s, d):
    return summary.trends(_weekly_stats(s, d))


def a38_developer_summary(s, d):
    return summary.developer_summary(summary.trends(_weekly_stats(s, d)), a21_velocity(s, d), a27_developer_totals(s, d), timing.time_analysis(_commits(s, d)), a28_code_domain(s, d))


def a42_top_developers(s, d):
    t = Scratch(s, "trends").save(summary.trends(_weekly_stats(s, d)))
    return summary.top(t, "total_diff_delta").unionByName(summary.top(t, "consistency")).unionByName(summary.top(t, "activity_rate"))


# ---- merges of the results of two parts of the repositories ----


def _parts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("part", F.pmod(F.length("repo"), F.lit(2)))


def _merged(name: str, rule: str | None = None):
    """The results of each part, computed apart, then merged; a row for each key."""

    def run(s: SparkSession, d: str) -> DataFrame:
        c = table(s, d, "commits")
        # what a metric takes for the repository is the part, which keeps its own renames and histories
        halves = c.withColumn("project_name", F.pmod(F.length("project_name"), F.lit(2)).cast("string"))
        rows = registry.compute(name, halves, REPO).withColumnRenamed("repo", "part")
        return merge.merge(rule or name, rows)

    return run


MERGED = {f"m_{rule}": _merged(name, rule) for rule, name in {
    "change_set": "change_set", "commits_count": "commits_count", "contributors_count": "contributors", "contributors_experience": "contributors", "hunks_count": "hunks_count", "lines_count": "lines_count", "code_churn": "code_churn",
    "bugs": "bugs", "code_movement": "code_movement", "test_doc_pct": "test_doc_pct", "meaningful_code": "meaningful_code", "diff_delta": "diff_delta", "code_provenance": "code_provenance", "developer_hours": "developer_hours", "code_domain": "code_domain",
    "time_analysis": "time_analysis",
}.items()}


def m_true_churn(s: SparkSession, d: str) -> DataFrame:
    c = _parts(_events(s, d))
    return merge.merge("true_churn", quality.true_churn(c.drop("repo").withColumnRenamed("part", "repo"), REPO, ["author"]).withColumnRenamed("repo", "part"))


def m17_weekly_merge(s: SparkSession, d: str) -> DataFrame:
    """The weekly results of two parts merged by week, category and metric; a row per figure."""
    c = table(s, d, "commits")
    results = {n: _parts(registry.compute(n, c, WEEK)) for n in ("change_set", "code_churn", "code_movement", "test_doc_pct")}
    out = None
    for (category, name), rows in merge.merge_weekly(results).items():
        nums = [x for x in rows.columns if x != "week_label"]
        long = rows.select("week_label", F.lit(category).alias("category"), F.lit(name).alias("metric"), F.explode(F.create_map(*[y for x in nums for y in (F.lit(x), F.col(x).cast("double"))])).alias("figure", "value"))
        out = long if out is None else out.unionAll(long)
    return out


# ---- rules ----


def f_path_rules(s, d):
    n = F.col("filename")
    rows = _changes(s, d).select("filename").filter("filename is not null").distinct()
    return rows.select(
        n, rules.kept_source(n).alias("kept"), rules.test_file(n).alias("test"), rules.doc_file(n).alias("doc"), rules.language(n).alias("language"), rules.skipped_file(n).alias("skipped"),
        rules.code_file(n).alias("code"), rules.trivial_file(n).alias("trivial"), rules.domain(n).alias("domain"), rules.path_hash(n).alias("md5_8"),
    )


def f_line_rules(s, d):
    """The line predicates over every distinct added line, with its file's language, as counts."""
    t = lambda m: F.transform(model.line_texts(m["diff_parsed"]["added"]), lambda x: F.struct(rules.language(m["filename"]).alias("language"), x.alias("line")))
    rows = _changes(s, d, {"l": t}).filter("filename is not null").select(F.explode("l").alias("l")).select("l.*").distinct()
    line, lang = F.col("line"), F.col("language")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.groupBy("language").agg(
        F.count(F.lit(1)).alias("lines"), n(rules.noop_line(line)).alias("noop"), n(rules.delta_line(line)).alias("delta"), n(rules.provenance_line(line)).alias("provenance"), n(rules.hours_line(line)).alias("hours"),
        n(rules.auto_generated(line) == "long_sequences").alias("long_sequences"), n(rules.auto_generated(line) == "repeated_chars").alias("repeated_chars"), n(rules.auto_generated(line) == "repetitive_patterns").alias("repetitive"),
        n(rules.only_syntax(line, lang)).alias("only_syntax"), n(rules.meaningful_line(line, lang)).alias("meaningful"),
    )


def f6_bug_messages(s, d):
    return _commits(s, d).select("hash", rules.bug_fix(F.coalesce("msg", F.lit(""))).alias("bug_fix"))


def f4_month_range(s, d):
    c = _commits(s, d)
    return c.filter(readers.within_months(F.col("author_local"), (2016, 3), (2018, 2))).select("hash")


def w_week_keys(s, d):
    c = _commits(s, d)
    n = F.col("local")
    return c.select("hash", model.monday(n).alias("monday"), model.iso_week(n).alias("iso"), model.sunday_week(n).alias("sunday"))


def w1_analysis_weeks(s, d):
    return _weekly(s, d, _commits(s, d)).select("hash", "week_label")


# ---- sources and sinks ----


def s1_repositories(s, d):
    return readers.by_user(readers.usable_repos(table(s, d, "repos"))).select("username", "n", F.transform("repositories", lambda r: r["repo_name"]).alias("names"))


def s6_date_range(s, d):
    return readers.date_range(_commits(s, d))


def s10_accessible(s, d):
    return readers.accessible(readers.usable_repos(table(s, d, "repos")), lambda url: url.startswith("https://"))


def f2_f3_users(s, d):
    return readers.usable_repos(table(s, d, "repos"), prefix="B", limit=3)


def f21_addresses(s, d):
    u = F.col("url")
    return readers.usable_repos(table(s, d, "repos")).select("url", rules.address_owner(u).alias("owner"), rules.address_name(u).alias("name"), rules.kept_source(u).alias("kept"))


def j8_not_done(s, d):
    return readers.not_done(readers.usable_repos(table(s, d, "repos")), table(s, d, "completed_users"))


def k1_k2_reports(s, d):
    return writers.repo_reports(_commits(s, d), readers.usable_repos(table(s, d, "repos")))


def k4_combined(s, d):
    return writers.combined(k1_k2_reports(s, d)).drop("per_repository")


def k6_completed(s, d):
    return writers.with_completed(table(s, d, "completed_users"), table(s, d, "repos"))


def a44_summary(s, d):
    a = table(s, d, "analysis_files")
    t = lambda k: F.sum(F.coalesce(f"processing.{k}", F.lit(0))).alias(k)
    return a.groupBy("project_name").agg(F.count(F.lit(1)).alias("files"), t("total_commits"), t("total_lines_added"), t("total_lines_removed"))


def a45_combined_weeks(s, d):
    c = table(s, d, "commits")
    sets, lines = registry.compute("change_set", c, WEEK), _weekly(s, d, _changes(s, d)).groupBy(*WEEK).agg(F.count(F.lit(1)).alias("changes"), F.sum("added").alias("added"), F.sum("deleted").alias("removed"), F.max("added").alias("added_max"))
    long = sets.select(*WEEK, F.lit("files_max").alias("metric"), F.col("max_files").cast("double").alias("value"))
    for name, col in (("files_count", "changes"), ("added_total", "added"), ("removed_total", "removed"), ("added_max", "added_max")):
        long = long.unionAll(lines.select(*WEEK, F.lit(name), F.col(col).cast("double")))
    return merge.combined_weeks(long)


def c9_groups(s, d):
    """Repositories by category and organisation (here the user)."""
    a = table(s, d, "analysis_files")
    return a.groupBy("repo_category", F.col("project_name").alias("organization")).agg(F.countDistinct("repository_name").alias("repositories"))


def j9_not_written(s, d):
    """Repositories without a full analysis file; the files' names are made from the headers at hand."""
    names = table(s, d, "analysis_files").filter("analysis_period.full_history").select(F.concat(F.lit("out/"), F.concat_ws("_", "project_name", "repository_name", F.lit("full_history_analysis.json"))).alias("name"))
    return readers.not_written(readers.usable_repos(table(s, d, "repos")), names)


def u1_chunks(s, d):
    """Commits cut into chunks by year of author date and put together again, by repository."""
    c = table(s, d, "commits").filter("error is null").select("hash", "project_name", F.substring("author_date", 1, 4).alias("year"))
    cut = readers.union_of([c.filter("year < '2017'"), c.filter("year >= '2017'").drop("year"), c.filter("year is null")])
    return cut.groupBy(F.col("project_name").alias("repo")).agg(F.count(F.lit(1)).alias("deliveries"), F.countDistinct("hash").alias("commits"))


def u5_date_chunks(s, d):
    out = readers.date_chunks(s, "2014-01-01", "2024-01-01", 7)
    return out.select("chunk", F.date_format("from_day", "yyyy-MM-dd").alias("from_day"), F.date_format("to_day", "yyyy-MM-dd").alias("to_day"))


QUERIES = {
    f.__name__: f
    for f in (
        a1_change_set, a1_file_changes, a2_commits_count, a3_a4_contributors, a5_hunks_count, a6_lines_count, a46_accumulator, j3_renamed_paths, a7_code_churn, a8_true_churn,
        a8_true_churn_by_author, a8_true_churn_by_file, a9_file_churn, a10_commit_churn, a11_weekly_churn, a11_weekly_true_churn, a12_author_churn, a13_extracted_churn, a14_bugs, a14_bugs_overall, a15_code_movement, a16_test_doc_pct, a18_meaningful_code,
        a19_unrealistic_commits, a20_diff_delta, a21_velocity, a21_velocity_weekly, a22_code_provenance, a24_sessions_2h, a27_developer_hours, a27_developer_totals, a28_code_domain, a28_code_domain_weekly, a29_basic_stats, a30_a34_intervals,
        a31_work_sessions, a31_last_sessions, a32_daily_patterns, a33_weekly_patterns, a35_rhythm, a36_sustained, a37_repo_activity, a38_weekly_stats, a38_developer_summary, a39_a41_trends, a42_top_developers, m_true_churn, m17_weekly_merge,
        f_path_rules, f_line_rules, f6_bug_messages, f4_month_range, w_week_keys, w1_analysis_weeks, s1_repositories, s6_date_range, s10_accessible, f2_f3_users, f21_addresses, j8_not_done, k1_k2_reports, k4_combined,
        k6_completed, a44_summary, a45_combined_weeks, c9_groups, j9_not_written, u1_chunks, u5_date_chunks,
    )
}



def _weekly_metric(name: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        return registry.compute(name, table(s, d, "commits"), WEEK)

    return run


# every metric as the weekly reports give it: computed afresh in each analysis week of each repository
QUERIES |= {f"weekly_{n}": _weekly_metric(n) for n in registry.names()}

QUERIES |= MERGED

from histloom.queries.history_sql import SQL  # noqa: E402, F401
