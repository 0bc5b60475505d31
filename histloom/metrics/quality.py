"""Churn, line-level rewrite churn, bug-fix share, moved and copied lines, tests and documentation, meaningful lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from histloom.functions import rules
from histloom.model import line_texts
from histloom.tables import Scratch

HEADER = r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def code_churn(changes: DataFrame, scope: list[str]) -> DataFrame:
    """Churn per file (added + removed, added - removed), then count, maximum and rounded mean over files."""
    per = file_churn(changes, scope)
    out = []
    for k in ("total", "net"):
        out += [F.sum(k).alias(f"{k}_count"), F.max(k).alias(f"{k}_max"), F.bround(F.avg(k), 0).alias(f"{k}_avg")]
    return per.groupBy(*scope).agg(*out, F.sum("a").alias("added"), F.sum("d").alias("removed"))


def file_churn(changes: DataFrame, scope: list[str]) -> DataFrame:
    named = changes.withColumn("file", F.coalesce(F.nullif("new_path", F.lit("")), F.col("filename")))
    return named.groupBy(*scope, "file").agg(F.sum("added").alias("a"), F.sum("deleted").alias("d")).withColumns({"total": F.col("a") + F.col("d"), "net": F.col("a") - F.col("d")})


def file_report(changes: DataFrame, scope: list[str]) -> DataFrame:
    """Count, maximum and mean churn over the changes of each file."""
    n = F.col("added") + F.col("deleted")
    named = changes.withColumn("file", F.coalesce(F.nullif("new_path", F.lit("")), F.col("filename")))
    return named.groupBy(*scope, "file").agg(F.sum(n).alias("churn"), F.max(n).alias("churn_max"), F.bround(F.avg(n), 0).alias("churn_avg"), F.count(F.lit(1)).alias("changes"))


def weekly_report(changes: DataFrame, scope: list[str]) -> DataFrame:
    """Churn of each Monday week, and of each file in it: rows without file are the week's (level 'week'), the others the file's."""
    n = F.col("added") + F.col("deleted")
    named = changes.withColumns({"file": F.coalesce(F.nullif("new_path", F.lit("")), F.col("filename")), "n": n})
    sets = [[*[F.col(c) for c in scope], F.col("week")], [*[F.col(c) for c in scope], F.col("week"), F.col("file")]]
    g = named.groupingSets(sets, *[F.col(c) for c in (*scope, "week", "file")])
    out = g.agg(F.grouping("file").alias("g"), F.sum("n").alias("churn"), F.max("n").alias("churn_max"), F.bround(F.avg("n"), 0).alias("churn_avg"), F.sum("added").alias("added"), F.sum("deleted").alias("removed"), F.count(F.lit(1)).alias("changes"))
    return out.select(*scope, "week", F.when(F.col("g") == 1, "week").otherwise("file").alias("level"), "file", "churn", "churn_max", "churn_avg", "added", "removed", "changes")


def commit_report(changes: DataFrame) -> DataFrame:
    """Churn per commit; of a file named twice in one commit the last change counts."""
    named = changes.withColumn("file", F.coalesce(F.nullif("new_path", F.lit("")), F.col("filename")))
    last = named.groupBy("hash", "file").agg(F.max_by(F.struct("added", "deleted"), "file_idx").alias("v"))
    return last.groupBy("hash").agg(F.count(F.lit(1)).alias("files"), F.sum("v.added").alias("added"), F.sum("v.deleted").alias("removed"), F.sum(F.col("v.added") + F.col("v.deleted")).alias("churn"))


def author_report(changes: DataFrame, scope: list[str]) -> DataFrame:
    """Churn and (commit, file) pairs of each author."""
    named = changes.withColumn("file", F.coalesce(F.nullif("new_path", F.lit("")), F.col("filename")))
    pairs = named.groupBy(*scope, "author", "hash", "file").agg(F.max_by(F.struct("added", "deleted"), "file_idx").alias("v"))
    return pairs.groupBy(*scope, "author").agg(F.sum(F.col("v.added") + F.col("v.deleted")).alias("churn"), F.sum("v.added").alias("added"), F.sum("v.deleted").alias("removed"), F.count(F.lit(1)).alias("file_count"))


def line_events(m: Column) -> Column:
    """The hunks of a raw diff: where their sides begin (o, n), and the first character of each line (``ops``: + or - or a blank for any other).

    A hunk's text starts right after its header, so function context after it counts as a line, and it ends at the next
    ``@@``. Empty lines are left out.
    """
    nums = lambda g: F.regexp_extract_all(m["diff"], F.lit(HEADER), F.lit(g))
    texts = F.slice(F.split(m["diff"], HEADER), 2, 1 << 30)
    hunks = F.arrays_zip(nums(1).alias("old"), nums(3).alias("new"), texts.alias("text"))

    def read(h: Column, i: Column) -> Column:
        lines = F.filter(F.split(F.substring_index(h["text"], "@@", 1), "\n"), lambda x: x != "")
        ops = F.array_join(F.transform(lines, lambda x: F.when(x.startswith("+"), "+").when(x.startswith("-"), "-").otherwise(" ")), "")
        return F.struct(i.cast("int").alias("hunk"), h["old"].cast("int").alias("o"), h["new"].cast("int").alias("n"), ops.alias("ops"))

    return F.when(m["diff"].contains("@@ -"), F.transform(hunks, read))


def numbered_lines(changes: DataFrame, cols: list[str]) -> DataFrame:
    """cols, hunk, idx, op and no of the added and deleted lines of ``events``; no is the line's number on its own side.

    Any line but an addition advances the old side, any but a deletion the new one: running sums over the lines of a hunk. Rows of one change
    lie together already, so the window needs no shuffle.
    """
    h = changes.select(*cols, "hash", "file_idx", F.explode("events").alias("h")).select(*cols, "hash", "file_idx", "h.hunk", "h.o", "h.n", F.posexplode(F.split("h.ops", "")).alias("idx", "op")).filter("op <> ''")
    w = Window.partitionBy("hash", "file_idx", "hunk").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda other: F.coalesce(F.sum(F.when(F.col("op") == other, 0).otherwise(1)).over(w), F.lit(0))
    no = F.when(F.col("op") == "+", F.col("n") + before("-")).otherwise(F.col("o") + before("+")).cast("int")
    return h.withColumn("no", no).filter("op in ('+', '-')").drop("o", "n")


def true_churn(changes: DataFrame, scope: list[str], by: list[str]) -> DataFrame:
    """Contribution (added lines) and churn (deleted lines whose last writer at that line number is the same author).

    changes needs ``events``. The history of one line number of one file is a window, in which a deletion rewrites what
    the addition just before it wrote.
    """
    named = changes.withColumn("file", F.coalesce(F.nullif("new_path", F.lit("")), F.col("filename")))
    # ``by`` may name further columns of a change, such as its week
    e = numbered_lines(named, list(dict.fromkeys([*scope, *by, "file", "author", "ts"])))
    w = Window.partitionBy(*scope, "file", "no").orderBy("ts", "hash", "file_idx", "hunk", "idx")
    same = (F.lag("op").over(w) == "+") & F.lag("author").over(w).eqNullSafe(F.col("author"))
    e = e.withColumn("rewrite", (F.col("op") == "-") & F.coalesce(same, F.lit(False)))
    return e.groupBy(*dict.fromkeys([*scope, *by])).agg(F.count_if(F.col("op") == "+").alias("contribution"), F.count_if("rewrite").alias("churn"))


def with_true_churn(report: DataFrame, changes: DataFrame, scope: list[str], by: list[str]) -> DataFrame:
    """A churn report (rows per scope and ``by``) with true_contribution and true_churn, 0 where a row has no line of a diff. changes needs ``events``."""
    keys = list(dict.fromkeys([*scope, *by]))
    t = true_churn(changes, scope, by).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("contribution").alias("true_contribution"), F.col("churn").alias("true_churn"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & report[k].eqNullSafe(t[f"_{k}"])
    return report.join(t, cond, "left").select(*report.columns, F.coalesce("true_contribution", F.lit(0)).alias("true_contribution"), F.coalesce("true_churn", F.lit(0)).alias("true_churn"))


def bugs(changes: DataFrame, scope: list[str], patterns: list[str] | None = None) -> DataFrame:
    """Share of each path's changed lines that came with bug-fix commits."""
    n = F.col("added") + F.col("deleted")
    fix = rules.bug_fix(F.coalesce("msg", F.lit("")), patterns)
    g = changes.groupBy(*scope, "path").agg(F.sum(F.when(fix, n).otherwise(0)).alias("bug_lines"), F.sum(n).alias("lines"))
    return g.withColumn("bug_percent", F.when(F.col("lines") > 0, F.col("bug_lines") / F.col("lines") * 100).otherwise(0.0))


def bugs_overall(by_path: DataFrame, scope: list[str]) -> DataFrame:
    """Totals over the paths that ``bugs`` gives, and their share."""
    g = by_path.groupBy(*scope).agg(F.sum("bug_lines").alias("total_bug_lines"), F.sum("lines").alias("total_lines"))
    return g.withColumn("overall_bug_percent", F.when(F.col("total_lines") > 0, F.col("total_bug_lines") / F.col("total_lines") * 100).otherwise(0.0))


MOVE_FIELDS = {"r": lambda m: line_texts(m["diff_parsed"]["deleted"]), "a": lambda m: line_texts(m["diff_parsed"]["added"]), "parsed": lambda m: m["diff_parsed"].isNotNull()}


def greedy_moves(runs: Column, total: Column) -> Column:
    """Pairs made when each removed place in turn takes the first free added place of another file.

    runs: for each file in order, its number of removed (cr) and of added places (ca); total: the sum of ca. The added places stand in the files'
    order, so those taken are a prefix, but for one file's places that its own removals had to pass over and left free: the state is the end
    of the prefix and those places, and each file is one step, whatever its counts.
    """
    zero = lambda n: F.lit(0).cast("long").alias(n)
    start = F.struct(zero("n"), F.lit(-1).cast("int").alias("held_by"), zero("held"), zero("at"), zero("seen"))

    def first(s: Column, x: Column) -> Column:  # from the places held back
        t = F.when(s["held_by"] != x["file"], F.least(x["cr"], s["held"])).otherwise(0)
        return F.struct(t.cast("long").alias("t"), s.alias("s"), x.alias("x"))

    def second(v: Column) -> Column:  # then from the rest, passing over the file's own
        s, x = v["s"], v["x"]
        end = s["seen"] + x["ca"]
        own = F.when(end > s["at"], end - F.greatest(s["at"], s["seen"])).otherwise(0)
        take = F.greatest(F.least(x["cr"] - v["t"], total - s["at"] - own), F.lit(0))
        return F.struct(v["t"].alias("t"), s.alias("s"), x.alias("x"), end.alias("end"), own.alias("own"), take.alias("take"))

    def third(v: Column) -> Column:
        s = v["s"]
        passes = (v["take"] > 0) & (v["own"] > 0) & (s["at"] + v["take"] > s["seen"])
        return F.struct(
            (s["n"] + v["t"] + v["take"]).cast("long").alias("n"), F.when(passes, v["x"]["file"]).otherwise(s["held_by"]).cast("int").alias("held_by"),
            F.when(passes, v["own"]).otherwise(s["held"] - v["t"]).cast("long").alias("held"), (s["at"] + v["take"] + F.when(passes, v["own"]).otherwise(0)).cast("long").alias("at"), v["end"].cast("long").alias("seen"),
        )

    step = lambda s, x: F.transform(F.transform(F.array(first(s, x)), second), third)[0]
    return F.aggregate(runs, start, step, lambda s: s["n"])


def code_movement(changes: DataFrame, scope: list[str]) -> DataFrame:
    """Moved and copied lines among lines of over five characters; renames are left out.

    Lines meet by their text within a commit; of a path named twice in a commit the last change's lines are matched, while all lines count.
    Equal lines of one file are counted before they meet, so what is gathered for a text is one entry per file of the commit.
    """
    long_ = lambda c: F.filter(F.transform(c, rules.stripped), lambda x: F.length(x) > 5)
    rows = changes.filter("kind <> 'RENAME' and parsed").select(*scope, "hash", "path", "file_idx", long_(F.col("r")).alias("r"), long_(F.col("a")).alias("a"))
    total = rows.groupBy(*scope).agg(F.sum(F.size("r") + F.size("a")).alias("changed_lines"))
    last = rows.groupBy(*scope, "hash", "path").agg(F.max_by(F.struct("r", "a"), "file_idx").alias("v"), F.min("file_idx").alias("file"))
    side = lambda c: last.select(*scope, "hash", "file", F.explode(f"v.{c}").alias("text")).withColumn("side", F.lit(c))
    per = side("r").unionAll(side("a")).groupBy(*scope, "hash", "text", "file").agg(F.count_if(F.col("side") == "r").alias("cr"), F.count_if(F.col("side") == "a").alias("ca"))
    met = per.groupBy(*scope, "hash", "text").agg(F.sort_array(F.collect_list(F.struct("file", "cr", "ca"))).alias("runs"), F.sum("cr").alias("r"), F.sum("ca").alias("a"))
    met = met.withColumn("moved", F.when((F.col("r") > 0) & (F.col("a") > 0), greedy_moves(F.col("runs"), F.col("a"))).otherwise(0))
    met = met.withColumn("copied", F.when((F.col("r") == 0) & (F.col("a") > 1), F.col("a") - 1).otherwise(0))
    sums = met.groupBy(*scope).agg(F.sum("moved").alias("moved_lines"), F.sum("copied").alias("copied_lines"))
    t = sums.select(*[F.col(c).alias(f"_{c}") for c in scope], *[F.col(k).alias(f"_{k}") for k in ("moved_lines", "copied_lines")])
    cond = F.lit(True)
    for c in scope:
        cond = cond & total[c].eqNullSafe(t[f"_{c}"])
    n = lambda c: F.coalesce(f"_{c}", F.lit(0)).alias(c)
    out = total.join(t, cond, "left").select(*scope, n("moved_lines"), n("copied_lines"), "changed_lines")
    pct = lambda c: F.when(F.col("changed_lines") > 0, F.col(c) / F.col("changed_lines") * 100).otherwise(0.0)
    return out.withColumns({"moved_percent": pct("moved_lines"), "copied_percent": pct("copied_lines")})


DOC_FIELDS = {"source_lines": lambda m: rules.line_count(m["source_code"]), "comment_lines": lambda m: rules.comment_lines(m["filename"], m["source_code"])}
AUTO = ["long_sequences", "repeated_chars", "repetitive_patterns"]


def good_lines(name: Column, source: Column) -> Column:
    """Meaningful lines, and lines that each rule finds machine-made, as a struct."""
    lang = rules.language(name)
    bare = F.filter(F.transform(F.split(source, "\n", -1), rules.stripped), lambda x: x != "")
    kinds = F.transform(bare, lambda x: F.coalesce(rules.auto_generated(x), F.when(rules.only_syntax(x, lang), "syntax").otherwise("good")))
    n = lambda v, k: F.size(F.filter(v, lambda x: x == k))
    counts = F.transform(F.array(kinds), lambda v: F.struct(n(v, "good").alias("good"), *[n(v, k).alias(k) for k in AUTO]))[0]
    none = F.struct(F.lit(0).alias("good"), *[F.lit(0).alias(k) for k in AUTO])
    return F.when(F.coalesce(source, F.lit("")) == "", none).otherwise(counts)


MEANING_FIELDS = DOC_FIELDS | {"lines": lambda m: good_lines(m["filename"], m["source_code"])}


def test_doc_pct(changes: DataFrame, scope: list[str]) -> DataFrame:
    """Test and documentation files, and their lines summed over every modification."""
    test, doc, n = rules.test_file(F.col("filename")), rules.doc_file(F.col("filename")), F.col("source_lines")
    pct = lambda a, b: F.when(b > 0, a / b * 100).otherwise(0.0)
    g = changes.groupBy(*scope).agg(
        F.countDistinct("filename").alias("total_files"), F.countDistinct(F.when(test, F.col("filename"))).alias("test_files"), F.countDistinct(F.when(doc, F.col("filename"))).alias("doc_files"),
        F.sum(n).alias("total_lines"), F.sum(F.when(test, n).otherwise(0)).alias("test_lines"), F.sum(F.when(doc, n).otherwise(F.col("comment_lines"))).alias("doc_lines"),
    )
    g = g.withColumns({"test_percent": pct(F.col("test_lines"), F.col("total_lines")), "doc_percent": pct(F.col("doc_lines"), F.col("total_lines"))})
    return g.withColumn("quality_score", (F.col("test_percent") + F.col("doc_percent")) / 2)


def unrealistic(commits: DataFrame, scope: list[str], large: int = 5000, rapid: int = 1000, within: int = 600) -> DataFrame:
    """scope, hash, changed and verdict: large_commit, rapid_large_commit or accepted.

    A rapid commit follows its author's last accepted one by less than ``within`` seconds, so acceptance is a recurrence. Only commits between
    ``rapid`` and ``large`` lines need it. Those that a small commit (always accepted) precedes that closely are rapid: small commits are folded to
    their first and last in time cells of that length, where any two of a cell are close. Of the rest, the first in a while is accepted, and so is
    the next one ``within`` or more after an accepted one: these pointers are followed by doubling. No author's commits meet in one task.
    Null authors are one author; commits without time are accepted unless large, and precede nothing.
    """
    scratch = Scratch(commits.sparkSession, "unrealistic")
    cell = F.floor(F.col("ts") / within)
    c = scratch.save(commits.select(*scope, F.struct(*[F.col(x) for x in (*scope, "author")]).alias("k"), "ts", "hash", "changed"))
    timed = c.filter("ts is not null").withColumn("cell", cell)
    mid = timed.filter((F.col("changed") > rapid) & (F.col("changed") <= large))
    small = timed.filter(F.col("changed") <= rapid).groupBy("k", "cell").agg(F.min(F.struct("ts", "hash")).alias("lo"), F.max("ts").alias("hi"))
    here, before = small.select("k", "cell", "lo"), small.select("k", (F.col("cell") + 1).alias("cell"), "hi")
    near = mid.join(here, ["k", "cell"], "left").join(before, ["k", "cell"], "left")
    close = F.coalesce(F.col("lo") < F.struct("ts", "hash"), F.lit(False)) | F.coalesce(F.col("hi") > F.col("ts") - within, F.lit(False))
    free = scratch.save(near.filter(~close).groupBy("k", "cell", "ts").agg(F.min("hash").alias("hash")))
    # at most ``within`` instants in a cell
    cells = free.groupBy("k", "cell").agg(F.sort_array(F.collect_list("ts")).alias("all"), F.max("ts").alias("last"), F.min("ts").alias("lo"))
    ahead = lambda n, *cols: cells.select("k", (F.col("cell") - n).alias("cell"), *cols)
    n = free.join(cells.select("k", "cell", F.col("lo").alias("lo0")), ["k", "cell"]).join(ahead(-1, F.col("last").alias("prev")), ["k", "cell"], "left").join(ahead(1, F.col("all").alias("one")), ["k", "cell"], "left").join(ahead(2, F.col("lo").alias("two")), ["k", "cell"], "left")
    alone = (F.col("lo0") == F.col("ts")) & F.coalesce(F.col("prev") <= F.col("ts") - within, F.lit(True))
    after = F.coalesce(F.array_min(F.filter("one", lambda x: x >= F.col("ts") + within)), F.col("two"))
    nodes = scratch.save(n.select("k", "ts", "hash", after.alias("to"), alone.alias("on")))
    while not nodes.filter("to is not null").isEmpty():
        marked = nodes.filter("on and to is not null").select("k", F.col("to").alias("ts"), F.lit(True).alias("hit")).distinct()
        hop = nodes.select("k", F.col("ts").alias("to"), F.col("to").alias("far"))
        step = nodes.join(marked, ["k", "ts"], "left").join(hop, ["k", "to"], "left").select("k", "ts", "hash", F.col("far").alias("to"), (F.col("on") | F.coalesce("hit", F.lit(False))).alias("on"))
        step = scratch.save(step)
        scratch.drop(nodes)
        nodes = step
    settled = F.when(F.col("changed") > large, "large_commit").otherwise("accepted")
    rest = c.filter((F.col("changed") <= rapid) | (F.col("changed") > large) | F.col("ts").isNull()).select(*scope, "hash", "changed", settled.alias("verdict"))
    judged = mid.join(nodes.filter("on").select("hash", F.lit(True).alias("on")), "hash", "left").select(*scope, "hash", "changed", F.when(F.col("on"), "accepted").otherwise("rapid_large_commit").alias("verdict"))
    scratch.keep(c, nodes)
    return rest.unionAll(judged)


def unrealistic_totals(verdicts: DataFrame, scope: list[str]) -> DataFrame:
    """Commits of each verdict; skipped_lines are the lines of all commits, accepted ones too."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    g = verdicts.groupBy(*scope).agg(n("large_commit").alias("large_commits"), n("rapid_large_commit").alias("rapid_large_commits"), F.sum("changed").alias("skipped_lines"))
    return g.select(*scope, "large_commits", "rapid_large_commits", (F.col("large_commits") + F.col("rapid_large_commits")).alias("unrealistic_total"), "skipped_lines")


def meaningful_code(changes: DataFrame, verdicts: DataFrame, scope: list[str]) -> DataFrame:
    """Lines and meaningful lines of accepted commits, machine-made lines by rule, and unrealistic commits.

    Tests and documentation have no meaningful and no machine-made lines. A scope without an accepted change has zeros. changes needs ``MEANING_FIELDS``.
    """
    test, doc = rules.test_file(F.col("filename")), rules.doc_file(F.col("filename"))
    code = lambda c: F.sum(F.when(test | doc, 0).otherwise(F.col(c)))
    ok = changes.join(verdicts.filter("verdict = 'accepted'").select("hash"), "hash", "left_semi")
    g = test_doc_pct(ok, scope).select(*scope, F.col("total_files").alias("files"), "total_lines", "quality_score")
    m = ok.groupBy(*scope).agg(code("lines.good").alias("meaningful_lines"), *[code(f"lines.{k}").alias(k) for k in AUTO])
    u = unrealistic_totals(verdicts, scope)
    for other in (g, m):
        o = other.select(*[F.col(k).alias(f"_{k}") for k in scope], *[x for x in other.columns if x not in scope])
        cond = F.lit(True)
        for k in scope:
            cond = cond & u[k].eqNullSafe(o[f"_{k}"])
        u = u.join(o, cond, "left").drop(*[f"_{k}" for k in scope])
    u = u.fillna(0)
    pct = lambda c: F.when(F.col("total_lines") > 0, F.col(c) / F.col("total_lines") * 100).otherwise(0.0)
    u = u.withColumn("auto_generated_total", sum((F.col(k) for k in AUTO), F.lit(0)))
    return u.select(
        *scope, "files", "total_lines", "meaningful_lines", pct("meaningful_lines").alias("meaningful_percent"), "quality_score", *AUTO, "auto_generated_total", pct("auto_generated_total").alias("auto_generated_percent"),
        "large_commits", "rapid_large_commits", "unrealistic_total", "skipped_lines",
    )
