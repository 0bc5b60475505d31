import json
import random
from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from histloom import cli, model
from histloom.functions import rules
from histloom.metrics import merge, productivity, quality, summary, timing
from histloom.plans import registry
from histloom.sources import readers, writers


def schema():
    return T.StructType.fromDDL(readers.COMMIT_TYPE)


def change(path, diff="", added=(), deleted=(), kind="MODIFY", old="same", n=None, src=None, before=None):
    new = None if kind == "DELETE" else path
    return {
        "filename": path.rsplit("/", 1)[-1], "new_path": new, "old_path": (None if kind == "ADD" else path) if old == "same" else old, "change_type_name": kind, "diff": diff,
        "diff_parsed": {"added": [[str(i), t] for i, t in added], "deleted": [[str(i), t] for i, t in deleted]}, "added_lines": len(added) if n is None else n[0], "deleted_lines": len(deleted) if n is None else n[1],
        "source_code": src, "source_code_before": before,
    }


def commit(h, date, files, author="Ann", email="ann@x.example", repo="r", msg="m"):
    return {"hash": h, "msg": msg, "author": {"name": author, "email": email}, "author_date": date, "committer_date": date, "author_timezone": 0, "committer_timezone": 0, "project_name": repo, "modified_files": files,
            "lines": sum(f["added_lines"] + f["deleted_lines"] for f in files), "files": len(files)}


def frame(spark, commits, at=datetime(2024, 1, 1)):
    return spark.createDataFrame(commits, schema()).withColumn("extracted_at", F.lit(at))


def test_two_commit_sample(spark):
    """A text file written with 13 lines, then changed by one line each way in two hunks, ten seconds apart."""
    first = [(i, f"line {i}" if i not in (3,) else "x") for i in range(1, 14)]
    d1 = "@@ -0,0 +1,13 @@\n" + "".join(f"+{t}\n" for _, t in first)
    d2 = "@@ -2,1 +2,0 @@\n-line 2\n@@ -8,1 +7,1 @@\n-line 8\n+line eight\n"
    raw = frame(spark, [commit("a", "2019-06-01 22:48:48+02:00", [change("test.txt", d1, first, kind="ADD")]), commit("b", "2019-06-01 22:48:58+02:00", [change("test.txt", d2, [(7, "line eight")], [(2, "line 2"), (8, "line 8")])])])
    c, f = model.commits_view(raw), model.changes_view(raw)
    assert productivity.change_set(c, ["repo"]).first()[1:] == (1, 1.0)
    paths = model.resolved_paths(model.changes_view(raw, {"hunks": productivity.hunks}), ["repo"])
    assert productivity.hunks_count(paths, ["repo"]).first()["median_hunks"] == 1.5
    assert productivity.contributors(paths, ["repo"]).first()[1:] == ("test.txt", 1, 0, 1)
    churn = quality.code_churn(f, ["repo"]).first().asDict()
    assert (churn["total_count"], churn["net_count"], churn["added"], churn["removed"]) == (16, 12, 14, 2)
    e = model.changes_view(raw, {"events": quality.line_events})
    assert quality.true_churn(e, ["repo"], []).first()[1:] == (14, 2)
    dd = model.changes_view(raw, {"dd": timing.delta_counts})
    v = timing.diff_delta(c, dd, [], True).first()
    assert (v["week"], v["diff_delta"], v["commits"], v["active_days"]) == ("2019-05-27", 12 + 1 + 2 * 0.25, 2, 1)
    worth = model.changes_view(raw, {"w": timing.hours_changes}).groupBy("hash").agg(F.sum("w").alias("worth"))
    h = timing.developer_hours(timing.work_hours(c.join(worth, "hash", "left"))).first()
    assert (h["week"], h["estimated_hours"], h["sessions"], h["commits"]) == ("2019-W22", 0.83, 1, 2)
    assert timing.code_domain(f, [], False).first()[1:3] == ("docs", 16)
    assert timing.daily_patterns(c).first()["peak_day"] == 5
    assert timing.sustained(c).first()["max_consecutive_days"] == 1
    b = timing.basic_stats(c).first()
    assert (b["total_span_days"], b["commits_per_day"]) == (0.0, 2.0)
    assert timing.interval_stats(c).first()["min_minutes"] == 0.17


def test_renames_redirect_later_uses(spark):
    day = lambda k: f"2020-01-{k:02d} 00:00:00+00:00"
    raw = frame(spark, [
        commit("1", day(1), [change("a", kind="ADD")]), commit("2", day(2), [change("b", kind="RENAME", old="a")]), commit("3", day(3), [change("a", kind="ADD")]), commit("4", day(4), [change("c", kind="RENAME", old="b")]),
        commit("5", day(5), [change("b", kind="ADD")]), commit("6", day(6), [change("z", kind="DELETE")]), commit("7", day(7), [change("a", kind="RENAME", old="q")]), commit("8", day(8), [change("q", kind="ADD")]),
    ])
    got = {r["hash"]: r["path"] for r in model.resolved_paths(model.changes_view(raw), ["repo"]).collect()}
    assert got == {"1": "a", "2": "b", "3": "b", "4": "c", "5": "c", "6": None, "7": "b", "8": "b"}


def test_duplicate_and_failed_deliveries(spark):
    c = commit("1", "2020-01-01 00:00:00+00:00", [change("a", n=(3, 1))])
    raw = frame(spark, [c]).unionByName(frame(spark, [c], datetime(2025, 1, 1))).unionByName(frame(spark, [{"hash": "2", "error": "broken"}]))
    assert model.commits_view(raw).count() == 1 and model.changes_view(raw).count() == 1
    empty = raw.limit(0)
    for name in registry.names():
        assert registry.compute(name, empty).count() == 0, name


def greedy(removed, added):
    used, n = set(), 0
    for r in removed:
        for i, a in enumerate(added):
            if i not in used and a != r:
                used.add(i)
                n += 1
                break
    return n


def test_greedy_moves(spark):
    """Places stand in the files' order on both sides."""
    rng = random.Random(2)
    rows = [[(f, rng.choice([0, 0, 1, 2, 5]), rng.choice([0, 0, 1, 2, 5])) for f in range(rng.randint(1, 6))] for _ in range(400)]
    df = spark.createDataFrame([(r,) for r in rows], "runs array<struct<file:int,cr:long,ca:long>>")
    total = F.aggregate("runs", F.lit(0).cast("long"), lambda s, x: s + x["ca"])
    got = [r["n"] for r in df.select(quality.greedy_moves(F.col("runs"), total).alias("n")).collect()]
    want = [greedy([f for f, r, _ in x for _ in range(r)], [f for f, _, a in x for _ in range(a)]) for x in rows]
    assert [(x, g, w) for x, g, w in zip(rows, got, want) if g != w] == []


def test_code_movement(spark):
    files = [change("a", added=[(1, "moved line"), (2, "copy me ok"), (3, "copy me ok"), (4, "tiny")]), change("b", deleted=[(1, "  moved line"), (2, "gone line")])]
    raw = frame(spark, [commit("1", "2020-01-01 00:00:00+00:00", files)])
    r = quality.code_movement(model.resolved_paths(model.changes_view(raw, quality.MOVE_FIELDS), ["repo"]), ["repo"]).first()
    assert (r["moved_lines"], r["copied_lines"], r["changed_lines"], r["moved_percent"]) == (1, 1, 5, 20.0)


def test_unrealistic_is_a_recurrence(spark):
    rows = [("r", "A", 0, "1", 10), ("r", "A", 60, "2", 2000), ("r", "A", 550, "3", 2000), ("r", "A", 650, "4", 2000), ("r", "A", 700, "5", 9000), ("r", "B", 0, "6", 2000), ("r", None, 5, "7", 1)]
    df = spark.createDataFrame(rows, "repo string, author string, ts long, hash string, changed long").withColumn("verdict", F.lit("clash"))
    got = {r["hash"]: r["verdict"][:5] for r in quality.unrealistic(df, ["repo"]).collect()}
    assert got == {"1": "accep", "2": "rapid", "3": "rapid", "4": "accep", "5": "large", "6": "accep", "7": "accep"}


def fold_verdicts(rows):
    out, last = {}, {}
    for repo, author, ts, h, n in sorted(rows, key=lambda r: (r[2], r[3])):
        was = last.get((repo, author))
        out[h] = "large_commit" if n > 5000 else "rapid_large_commit" if n > 1000 and was is not None and ts - was < 600 else "accepted"
        if out[h] == "accepted":
            last[repo, author] = ts
    return out


def test_unrealistic_against_a_fold(spark):
    rng = random.Random(4)
    for span in (900, 4000, 40000):
        rows = [(rng.choice("rs"), rng.choice(["A", "A", None]), rng.randrange(span), f"{k:03d}", rng.choice([10, 1500, 1500, 2000, 2000, 3000, 9000])) for k in range(150)]
        df = spark.createDataFrame(rows, "repo string, author string, ts long, hash string, changed long")
        assert {r["hash"]: r["verdict"] for r in quality.unrealistic(df, ["repo"]).collect()} == fold_verdicts(rows)


def test_hot_keys_grow_in_proportion(spark):
    """100,000 commits of one author, and one diff of 100,000 lines, in about the time that rows of that number take."""
    import time

    c = spark.range(100_000).select(F.lit("r").alias("repo"), F.lit("A").alias("author"), F.lit("a@x").alias("dev"), (F.col("id") * 700).alias("ts"), F.col("id").cast("string").alias("hash"), F.when(F.col("id") % 3 == 0, 2000).otherwise(10).alias("changed"))
    began = time.time()
    assert quality.unrealistic(c, ["repo"]).filter("verdict = 'accepted'").count() == 100_000
    assert timing.interval_stats(c).first()["max_days"] == 0.01
    n = 100_000
    diff = f"@@ -1,{n} +1,{n} @@\n" + "\n".join(f"{'+-'[k % 2]}line {k // 2 % 5000}" for k in range(n))
    lines = [(k + 1, f"line {k % 5000}") for k in range(n // 2)]
    raw = frame(spark, [commit("1", "2020-01-01 00:00:00+00:00", [change("a.py", diff, lines, lines)])])
    assert quality.true_churn(model.changes_view(raw, {"events": quality.line_events}), ["repo"], []).first()["contribution"] == n // 2
    assert model.changes_view(raw, {"dd": timing.delta_counts}).select("dd.*").first()["d_moved"] == 5000
    moved = quality.code_movement(model.resolved_paths(model.changes_view(raw, quality.MOVE_FIELDS), ["repo"]), ["repo"]).first()
    assert moved["moved_lines"] == 0 and moved["changed_lines"] == n
    assert time.time() - began < 120


def test_registry_honours_the_scope(spark):
    day = lambda k: f"2020-01-{k:02d} 00:00:00+00:00"
    files = lambda k: [change(f"a{k}.py", "@@ -0,0 +1,1 @@\n+x = 1\n", [(1, "x = 1")], src="x = 1")]
    raw = frame(spark, [commit(f"{r}{k}", day(k), files(k), repo=r) for r in "xy" for k in (1, 2, 9, 10)])
    for name in registry.names():
        rows = registry.compute(name, raw, ["repo", "week_label"])
        got = {(r["repo"], r["week_label"]) for r in rows.collect()}
        assert len(got) == 4, (name, got)


def test_deliveries_without_time(spark):
    raw = frame(spark, [commit("1", "2020-01-01 00:00:00+00:00", [change("a.py")], repo="late")], None).withColumn("extracted_at", F.lit(None).cast("timestamp"))
    assert model.commits_view(raw).first()["repo"] == "late" and model.changes_view(raw).first()["repo"] == "late"
    timed = frame(spark, [commit("1", "2020-01-01 00:00:00+00:00", [change("a.py")], repo="first")])
    assert model.commits_view(raw.unionByName(timed.withColumn("extracted_at", F.col("extracted_at").cast("timestamp")))).first()["repo"] == "first"


def test_comment_lines(spark):
    cases = [
        ("a.py", 'x\n# c\n"""doc\ntext\nend"""\ny', 4), ("a.go", "x\n// c\ny\nz", 3), ("a.java", "/* a */ x\n/* b\nc */\n// d\nint x;", 4), ("a.java", "/** d */\nx\n*/\ny", 3), ("a.c", "int x;", 0), ("a.html", "<!-- a\nb -->\nc", 2),
        ("noext", "# c", 0), ("a.sql", "-- c\nselect", 1), ("a.py", None, 0), ("a.py", "", 0), ("a.jl", "#= a\nb =#\n# c\nd", 3), ("a.rs", "/// d\nfn x\ny", 3),
    ]
    got = spark.createDataFrame(cases, "f string, s string, want int").select("*", rules.comment_lines(F.col("f"), F.col("s")).alias("got")).collect()
    assert [r for r in got if r["want"] != r["got"]] == []


def test_line_and_file_rules(spark):
    lines = [("}", 0, 0, 0), ("  } else {", 0, 1, 1), ("import os", 0, 0, 1), ("from a import b", 0, 0, 1), ("// c", 0, 0, 0), ("return x", 1, 1, 1), ("* item", 0, 0, 0), ("-- sql", 0, 0, 1), ("ab", 0, 1, 1), ("", 0, 0, 0), ("\t", 0, 0, 0)]
    df = spark.createDataFrame(lines, "l string, a int, d int, p int")
    got = df.select("l", rules.delta_line(F.col("l")).cast("int").alias("delta"), rules.provenance_line(F.col("l")).cast("int").alias("prov")).collect()
    assert {r["l"]: (r["delta"], r["prov"]) for r in got} == {
        "}": (0, 0), "  } else {": (1, 1), "import os": (0, 1), "from a import b": (0, 1), "// c": (0, 0), "return x": (1, 1), "* item": (0, 0), "-- sql": (0, 1), "ab": (1, 1), "": (0, 0), "\t": (0, 0),
    }
    files = [("x.test.js", "frontend"), ("y_test.go", "backend"), ("README.md", "docs"), ("Dockerfile", "config"), ("a.feature", "test"), ("run.sh", "devops"), ("n.ipynb", "data_science"), ("m.onnx", "machine_learning"), ("p.gd", "game_dev"), ("A.swift", "mobile"), (".env", "config"), ("what", "other"), ("q.sql", "database")]
    got = spark.createDataFrame(files, "f string, d string").select("f", "d", rules.domain(F.col("f")).alias("got")).collect()
    assert [r for r in got if r["d"] != r["got"]] == []
    syntax = [("}", "java", 1), ("else:", "java", 1), ("pass", "python", 1), ("else:", "python", 0), ("</div>", "xml", 1), ("end", "ruby", 1), ("x = 1", "ruby", 0), ("-", "yaml", 1)]
    got = spark.createDataFrame(syntax, "l string, g string, w int").select("*", rules.only_syntax(F.col("l"), F.col("g")).cast("int").alias("got")).collect()
    assert [r for r in got if r["w"] != r["got"]] == []


def test_analysis_weeks_leave_a_day_out(spark):
    start, end = "timestamp_ntz'2020-01-01 00:00:00'", "timestamp_ntz'2020-01-20 00:00:00'"
    rows = [("2020-01-01 00:00:00", "Week_1_2020-01-01"), ("2020-01-07 00:00:00", "Week_1_2020-01-01"), ("2020-01-07 00:00:01", None), ("2020-01-08 00:00:00", "Week_2_2020-01-08"), ("2020-01-20 00:00:00", "Week_3_2020-01-15"), ("2020-01-20 00:00:01", None), ("2019-12-31 00:00:00", None)]
    df = spark.createDataFrame(rows, "t string, w string").withColumn("t", F.to_timestamp_ntz("t"))
    got = df.select("w", model.window_label(F.col("t"), F.expr(start), F.expr(end)).alias("got")).collect()
    assert [r for r in got if r["w"] != r["got"]] == []
    assert [w[2] for w in model.week_ranges("2020-01-01", "2020-01-20")] == ["Week_1_2020-01-01", "Week_2_2020-01-08", "Week_3_2020-01-15"]


def test_provenance_ages(spark):
    day = 86400
    c = [
        commit("1", "2020-01-01 00:00:00+00:00", [change("a.py", added=[(1, "one line"), (2, "two line")], kind="ADD")]), commit("2", "2020-01-11 00:00:00+00:00", [change("a.py", added=[(1, "again 1")])]),
        commit("3", "2020-06-01 00:00:00+00:00", [change("a.py", added=[(2, "again 2"), (9, "ninth")])]), commit("4", "2022-01-01 00:00:00+00:00", [change("a.py", added=[(1, "late 1"), (2, "edit")], deleted=[(2, "again 2")])]),
        commit("5", "2022-01-01 00:00:00+00:00", [change("b.py", added=[(1, "seeded")], before="old text")]), commit("6", "2022-01-01 00:00:00+00:00", [change("c.txt", added=[(1, "no code")])]),
    ]
    del day
    ages = timing.line_ages(model.changes_view(frame(spark, c), timing.AGE_FIELDS), ["repo"])
    got = sorted((r["hash"], r["no"], r["age"]) for r in ages.collect())
    assert got == [("1", 1, "new"), ("1", 2, "new"), ("2", 1, "recent"), ("3", 2, "old"), ("3", 9, "new"), ("4", 1, "legacy"), ("4", 2, "new"), ("5", 1, "old")]


def test_merge_rules(spark):
    df = spark.createDataFrame([(1, "p", 4.0, 2, 10, 20.0), (2, "p", 6.0, 3, 0, 0.0)], "part int, path string, median_hunks double, modifications long, lines long, bug_percent double")
    assert merge.merge("hunks_count", df).first()["median_hunks"] == 10.0
    assert merge.merge("commits_count", df).first()["modifications"] == 5
    assert merge.merge("bugs", df.withColumn("bug_lines", F.lit(2))).first().asDict() == {"path": "p", "bug_percent": 10.0, "bug_lines": 4, "lines": 10, "overall_percent": 40.0}
    cs = spark.createDataFrame([(1, 5, 2.0), (2, 9, 4.0)], "part int, max_files int, avg_files double")
    assert merge.merge("change_set", cs).first()[:] == (9, 3.0)
    assert merge.merge("change_set", cs.limit(0)).first()[:] == (None, None)
    assert merge.merge_any(df, "path", "lines").first()["lines"] == 10
    w = spark.createDataFrame([("a", "W1", "x_max", 3.0), ("b", "W1", "x_max", 5.0), ("a", "W1", "n", 3.0), ("b", "W1", "n", 5.0)], "repo string, week_label string, metric string, value double")
    assert {(r["metric"], r["value"]) for r in merge.combined_weeks(w).collect()} == {("x_max", 5.0), ("n", 8.0)}
    assert {r["value"] for r in merge.combined_weeks(w, compat=True).collect()} == {3.0}


def test_trends(spark):
    rows = [("d", f"2020-0{1 + i // 4}-{1 + 7 * (i % 4):02d}", float(v), 1.0) for i, v in enumerate([1, 1, 1, 1, 2, 2, 2, 2])] + [("e", "2020-01-01", 0.0, 0.0)]
    got = {r["dev"]: r for r in summary.trends(spark.createDataFrame(rows, "dev string, week string, diff_delta double, estimated_hours double")).collect()}
    assert got["d"]["velocity_trend"] == 100.0 and got["e"]["consistency"] == 100.0 and got["e"]["activity_rate"] == 0.0


def test_sources_and_sinks(spark, tmp_path):
    csv = tmp_path / "r.csv"
    csv.write_bytes("﻿username,repo_name,url\nbob,x,https://github.com/bob/x\nbob,,u\nAl,y,https://h.example/y\nBo,z,u/vendor/z\n".encode())
    repos = readers.usable_repos(readers.repo_list(spark, str(csv)))
    assert repos.count() == 3
    assert [r["username"] for r in readers.usable_repos(repos, prefix="B", limit=1).collect()] == ["Bo"]
    assert readers.usable_repos(repos, allow=rules.kept_source(F.col("url"))).count() == 2
    assert readers.not_done(repos, spark.createDataFrame([("bob",), (None,)], "username string")).count() == 2
    (tmp_path / "p_categorized.json").write_text('{"ecosystem": "e", "core_repos": ["c"], "organization_repos": {"o": ["a", "b"]}, "other_repos": []}')
    assert readers.categorized_projects(spark, str(tmp_path / "p_categorized.json")).count() == 3
    tree = tmp_path / "tree" / "ann"
    tree.mkdir(parents=True)
    (tree / "lib_data.json").write_text("{}")
    (tree / "z_forked.json").write_text("{}")
    assert [r[:] for r in readers.repo_tree(spark, str(tmp_path / "tree")).collect()] == [("ann", "lib", "https://github.com/ann/lib")]
    raw = frame(spark, [commit("1", "2020-01-01 00:00:00+00:00", [change("a.py", n=(3, 1))], repo="x")])
    rep = writers.repo_reports(model.commits_view(raw), repos)
    assert sorted(r["total_commits"] for r in rep.collect()) == [0, 0, 1]
    assert writers.combined(rep, repos.filter("repo_name = 'y'")).count() == 3
    raw.write.parquet(str(tmp_path / "commits"))
    done = cli.run(spark, ["--commits", str(tmp_path / "commits"), "--csv", str(csv), "--out", str(tmp_path / "out"), "--metrics", "change_set", "code_churn", "no_such_metric"])
    assert done == ["change_set", "code_churn", "reports"]
    assert spark.read.parquet(str(tmp_path / "out" / "change_set")).count() == 0  # one commit makes no week: its range is empty
    for f in ("bob_x_full_history_analysis.json", "Bo_z_2019_2020_analysis.7z", "other.json"):
        (tmp_path / "tree" / f).write_text("{}")
    left = readers.not_written(repos, readers.written_files(spark, str(tmp_path / "tree")))
    assert sorted(r["username"] for r in left.collect()) == ["Al"]


LOG = """commit 2222222bbb 1111111aaa 0000000fff
Merge: 1111111aaa 0000000fff
Author:     A B <a@b.example>
AuthorDate: 2020-01-02 10:00:00 +0100
Commit:     C D <c@d.example>
CommitDate: 2020-01-03 00:00:00 -0230

    second

diff --git a/old.py b/dir/new.py
similarity index 90%
rename from old.py
rename to dir/new.py
--- a/old.py
+++ b/dir/new.py
@@ -1,3 +1,3 @@ def f():
 a
-b
+c
 d
diff --git a/gone.txt b/gone.txt
deleted file mode 100644
--- a/gone.txt
+++ /dev/null
@@ -1,1 +0,0 @@
-x

commit 1111111aaa
Author:     A B <a@b.example>
AuthorDate: 2020-01-01 00:00:00 +0000
Commit:     A B <a@b.example>
CommitDate: 2020-01-01 00:00:00 +0000

    first
    two lines

diff --git a/old.py b/old.py
new file mode 100644
--- /dev/null
+++ b/old.py
@@ -0,0 +1,2 @@
+a
+b
"""


def test_git_logs(spark):
    logs = spark.createDataFrame([("r", LOG), ("e", ""), ("n", None)], "r string, t string")
    rows = {r["hash"]: r for r in readers.git_logs(logs, F.col("r"), F.col("t")).collect()}
    one, two = rows["1111111aaa"], rows["2222222bbb"]
    assert (one["seq"], two["seq"], one["msg"], two["merge"], two["parents"]) == (0, 1, "first\ntwo lines", True, ["1111111aaa", "0000000fff"])
    assert two["committer"][:] == ("C D", "c@d.example") and (two["author_timezone"], two["committer_timezone"]) == (-3600, 9000) and two["project_name"] == "r"
    assert (two["insertions"], two["deletions"], two["files"]) == (1, 2, 2)
    a, b = two["modified_files"]
    assert (a["old_path"], a["new_path"], a["filename"], a["change_type_name"], a["diff_parsed"][:]) == ("old.py", "dir/new.py", "new.py", "RENAME", ([["2", "c"]], [["2", "b"]]))
    assert (b["old_path"], b["new_path"], b["filename"], b["change_type"], b["deleted_lines"]) == ("gone.txt", None, "gone.txt", "ModificationType.DELETE", 1)
    assert one["modified_files"][0]["old_path"] is None and one["modified_files"][0]["diff"] == "@@ -0,0 +1,2 @@\n+a\n+b\n"
    pick = lambda **k: sorted(r["hash"][:1] for r in readers.git_logs(logs, F.col("r"), F.col("t"), **k).collect())
    assert (pick(since="2020-01-02"), pick(until="2020-01-01"), pick(since="2020-01-01", until="2020-01-02")) == (["2"], ["1"], ["1", "2"])
    assert model.commits_view(readers.git_logs(logs, F.col("r"), F.col("t")).withColumn("extracted_at", F.lit(None).cast("timestamp"))).count() == 2


def test_a_commit_that_cannot_be_read_is_a_row_with_its_error(monkeypatch):
    monkeypatch.setattr(readers, "_file_record", lambda text: 1 / 0)
    got = list(readers.git_commit_records(LOG, "r"))
    assert [(g["hash"], g["error"]) for g in got] == [("1111111aaa", "division by zero"), ("2222222bbb", "division by zero")]


def test_probes_have_a_time_limit(spark, tmp_path):
    import subprocess
    import time

    subprocess.run(["git", "init", "-q", "--bare", str(tmp_path / "here")], check=True)
    assert readers.remote_answers(str(tmp_path / "here")) and not readers.remote_answers(str(tmp_path / "nowhere"))
    repos = spark.createDataFrame([("u", f"r{i}", x) for i, x in enumerate(["yes", "no", "slow", "bad"] + ["yes"] * 40)], "username string, repo_name string, url string").coalesce(1)

    def probe(url):
        if url == "slow":
            time.sleep(20)
        return {"yes": True, "no": False}[url]

    began = time.time()
    got = readers.accessible(repos, probe, seconds=0.5, threads=8).groupBy("url").agg(F.max("accessible").alias("a")).collect()
    assert {r["url"]: r["a"] for r in got} == {"yes": True, "no": False, "slow": False, "bad": False} and time.time() - began < 15


def test_reports_from_json(spark, tmp_path):
    """Analysis files in, the same commits and the weekly metrics out."""
    day = lambda k: f"2020-01-{k:02d} 00:00:00+00:00"
    commits = [commit(f"h{k}", day(k), [change(f"a{k}.py", "@@ -0,0 +1,1 @@\n+x = \"é\"\n", [(1, 'x = "é"')])], repo="x") for k in (1, 2, 9, 10)]
    doc = {"project_name": "bob", "repository_name": "x", "commits": commits, "process_metrics": {}, "processing": {"total_commits": 4}}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "bob_x_analysis.json").write_text(json.dumps(doc))
    (tmp_path / "r.csv").write_text("username,repo_name,url\nbob,x,https://github.com/bob/x\nal,empty,https://h.example/y\n")
    done = cli.run(spark, ["--commits", str(tmp_path / "in" / "*.json"), "--csv", str(tmp_path / "r.csv"), "--out", str(tmp_path / "out"), "--metrics", "change_set", "commits_count", "--ecosystem", "e"])
    assert done == ["change_set", "commits_count", "reports"]
    assert {(r["repo"], r["week_label"], r["max_files"]) for r in spark.read.parquet(str(tmp_path / "out" / "change_set")).collect()} == {("x", "Week_1_2020-01-01", 1), ("x", "Week_2_2020-01-08", 1)}
    read = lambda folder: json.loads("\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / "out" / "reports" / folder).glob("part-*"))))
    got = read("username=bob/repo_name=x")
    assert [c["hash"] for c in got["commits"]] == ["h1", "h2", "h9", "h10"] and got["commits"][0]["modified_files"][0]["diff"] == commits[0]["modified_files"][0]["diff"]
    assert (got["ecosystem"], got["metrics_type"], got["processing"]["total_commits"], got["analysis_period"]) == ("e", "weekly", 4, {"start_date": "2020-01-01", "end_date": "2020-01-10", "full_history": False})
    week = got["process_metrics"]["Week_2_2020-01-08"]["productivity"]
    assert week["change_set"] == [{"max_files": 1, "avg_files": 1.0}] and [r["path"] for r in week["commits_count"]] == ["a10.py", "a9.py"]
    assert read("username=al/repo_name=empty")["commits"] == []
    again = readers.commits_of(readers.analysis_files(spark, str(tmp_path / "in" / "*.json")))
    assert again.count() == 4


def test_size_caps(spark):
    raw = frame(spark, [commit("1", "2020-01-01 00:00:00+00:00", [change("a.py", src="x"), change("b.py", src=""), change("soljson-v0.4.js", src="x")])])
    files = raw.select(readers.capped_files(F.col("modified_files")).alias("m")).first()["m"]
    assert [(f["filename"], f["source_code"]) for f in files] == [("a.py", "x"), ("b.py", None)]


def test_streaming_weeks(spark, tmp_path):
    from histloom.streaming.weeks import SUNDAY, read_stream, weekly_totals

    rows = [("a", "2020-01-05 23:59:59", 1), ("a", "2020-01-06 00:00:00", 2), ("a", "2020-01-12 12:00:00", None), (None, "2020-01-06 00:00:00", 9), ("b", "2020-01-06 05:00:00", 4), ("z", "2020-03-01 00:00:00", 1)]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "k string, t string, n long").withColumn("t", F.to_timestamp("t")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for start, want in (("4 days", {("a", "2019-12-30", 1, 1), ("a", "2020-01-06", 2, 2), ("b", "2020-01-06", 1, 4)}), (SUNDAY, {("a", "2020-01-05", 2, 3), ("a", "2020-01-12", 1, 0), ("b", "2020-01-05", 1, 4)})):
        stream = read_stream(spark, str(tmp_path / "in"), "k string, t timestamp, n long", max_files=2)
        out, at = str(tmp_path / f"out{start}"), str(tmp_path / f"ck{start}")
        q = weekly_totals(stream, F.col("k"), F.col("t"), {"n": F.col("n")}, late="60 days", start=start).writeStream.outputMode("complete").format("memory").queryName("weeks").trigger(availableNow=True).option("checkpointLocation", at).start()
        q.awaitTermination()
        assert want <= {tuple(r) for r in spark.table("weeks").collect()} and len([p for p in q.recentProgress if p["numInputRows"]]) >= 3 and out
        spark.sql("drop view weeks")


def test_streaming_sessions(spark, tmp_path):
    from histloom.streaming.sessions import streaming_sessions, write_sessions

    src = str(tmp_path / "in")
    rows = [("a", "2020-01-01 00:00:00"), ("a", "2020-01-01 01:59:00"), ("a", "2020-01-01 05:00:00"), (None, "2020-01-01 05:00:00"), ("z", "2020-02-01 00:00:00")]
    spark.createDataFrame(rows, "k string, t string").withColumn("t", F.to_timestamp("t")).write.parquet(src)
    stream = spark.readStream.schema("k string, t timestamp").parquet(src)
    write_sessions(streaming_sessions(stream, F.col("k"), F.col("t")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = sorted((r["key"], r["events"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 1), ("a", 2)]
