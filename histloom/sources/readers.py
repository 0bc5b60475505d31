"""Where repositories, commits and earlier results come from."""

from __future__ import annotations

import json
import os
import re
import subprocess
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histloom.functions.text import strip

REPO_FIELDS = ["username", "repo_name", "url"]
MAX_SOURCE = 1 << 20
MAX_FILE = 5 << 20

_PERSON = "struct<name:string,email:string>"
_METHODS = "array<struct<name:string,start_line:int,end_line:int>>"
FILE_TYPE = (
    f"struct<old_path:string,new_path:string,filename:string,change_type:string,change_type_name:string,diff:string,diff_parsed:struct<added:array<array<string>>,deleted:array<array<string>>>,"
    f"added_lines:bigint,deleted_lines:bigint,source_code:string,source_code_before:string,methods:{_METHODS},methods_before:{_METHODS},changed_methods:{_METHODS},nloc:int,complexity:int,token_count:int>"
)
COMMIT_TYPE = (
    f"struct<hash:string,msg:string,author:{_PERSON},committer:{_PERSON},author_date:string,author_timezone:int,committer_date:string,committer_timezone:int,branches:string,in_main_branch:boolean,merge:boolean,"
    f"parents:array<string>,project_name:string,project_path:string,deletions:bigint,insertions:bigint,lines:bigint,files:bigint,modified_files:array<{FILE_TYPE}>,dmm_unit_size:double,dmm_unit_complexity:double,dmm_unit_interfacing:double,error:string>"
)
ANALYSIS_SCHEMA = (
    f"project_name string, repository_url string, repository_name string, ecosystem string, repo_category string, analysis_period struct<start_date:string,end_date:string,full_history:boolean>,"
    f"commits array<{COMMIT_TYPE}>, process_metrics string, metrics_type string, processing struct<total_commits:bigint,total_lines_added:bigint,total_lines_removed:bigint>"
)


def repo_list(spark: SparkSession, path: str) -> DataFrame:
    """Repository rows of a CSV file with a header, a byte order mark before it or not."""
    raw = spark.read.csv(path, header=True)
    return without_bom(raw).select(*REPO_FIELDS)


def without_bom(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lstrip("﻿").removeprefix("ï»¿").strip() for c in df.columns])


def usable_repos(repos: DataFrame, prefix: str | None = None, limit: int | None = None, allow: Column | None = None) -> DataFrame:
    """Rows with all fields, once each; of users with ``prefix`` (any case), the first ``limit`` by name."""
    rows = repos.select(*[strip(F.col(c)).alias(c) for c in REPO_FIELDS]).filter(" and ".join(f"{c} <> ''" for c in REPO_FIELDS)).distinct()
    if prefix:
        rows = rows.filter(F.startswith(F.lower("username"), F.lit(prefix.lower())))
    if allow is not None:
        rows = rows.filter(allow)
    if limit is not None:
        rows = rows.join(rows.select("username").distinct().orderBy("username").limit(limit), "username", "left_semi")
    return rows


def by_user(repos: DataFrame) -> DataFrame:
    """One row per user with the list of its repositories."""
    return repos.groupBy("username").agg(F.sort_array(F.collect_list(F.struct("repo_name", "url"))).alias("repositories"), F.count(F.lit(1)).alias("n"))


def not_done(repos: DataFrame, done: DataFrame) -> DataFrame:
    return repos.join(done.select("username").filter("username is not null").distinct(), "username", "left_anti")


def categorized_projects(spark: SparkSession, path: str) -> DataFrame:
    """Core, organisation and other repositories of project files, with their category and organisation."""
    schema = "ecosystem string, core_repos array<string>, organization_repos map<string,array<string>>, other_repos array<string>"
    raw = spark.read.json(path, schema=schema, multiLine=True).withColumn("project", F.regexp_extract(F.input_file_name(), r"([^/]+)_categorized\.json", 1))
    base = ["project", "ecosystem"]
    none = F.lit(None).cast("string")
    core = raw.select(*base, F.lit("core").alias("category"), none.alias("organization"), F.explode("core_repos").alias("url"))
    org = raw.select(*base, F.explode("organization_repos").alias("organization", "urls")).select(*base, F.lit("organization").alias("category"), "organization", F.explode("urls").alias("url"))
    other = raw.select(*base, F.lit("other").alias("category"), none.alias("organization"), F.explode("other_repos").alias("url"))
    return core.unionByName(org).unionByName(other)


def grouped_projects(projects: DataFrame) -> DataFrame:
    return projects.groupBy("project", "category", "organization").agg(F.sort_array(F.collect_set("url")).alias("urls"))


def repo_tree(spark: SparkSession, path: str, host: str = "https://github.com") -> DataFrame:
    """One repository per JSON file of a directory tree user/repo_data.json; files of forks are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(path).select("path")
    user, name = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.regexp_replace(F.regexp_extract("path", r"([^/]+)\.json$", 1), "_data$", "")
    rows = files.filter(~F.col("path").endswith("_forked.json")).select(user.alias("username"), name.alias("repo_name"))
    return rows.withColumn("url", F.concat_ws("/", F.lit(host), "username", "repo_name"))


def analysis_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=ANALYSIS_SCHEMA, multiLine=True)


def commits_of(analyses: DataFrame) -> DataFrame:
    """Commit rows of analysis files; the sizes of source texts are capped as at extraction."""
    return analyses.select(F.explode("commits").alias("c")).select("c.*").withColumn("modified_files", capped_files(F.col("modified_files")))


def capped_files(files: Column) -> Column:
    """Source texts that are empty or reach 1 MiB become null; files beyond 5 MiB and compiler dumps are dropped."""
    cap = lambda c: F.when((F.length(c) > 0) & (F.length(c) < MAX_SOURCE), c)
    kept = F.filter(files, lambda m: (F.coalesce(F.length(m["source_code"]), F.lit(0)) <= MAX_FILE) & ~F.coalesce(m["filename"].rlike(r"^soljson-v.*\.js$"), F.lit(False)))
    return F.transform(kept, lambda m: m.withField("source_code", cap(m["source_code"])).withField("source_code_before", cap(m["source_code_before"])))


def date_range(commits: DataFrame) -> DataFrame:
    """First and last author instant of each repository."""
    return commits.groupBy("repo").agg(F.min("author_ts").alias("first_ts"), F.max("author_ts").alias("last_ts"))


def within_months(local: Column, start: tuple[int, int] | None = None, end: tuple[int, int] | None = None) -> Column:
    """Local time from the first day of the start month to midnight of the end month's last day."""
    out = F.lit(True)
    if start and all(start):
        out = out & (local >= F.make_date(F.lit(start[0]), F.lit(start[1]), F.lit(1)).cast("timestamp_ntz"))
    if end and all(end):
        out = out & (local <= F.last_day(F.make_date(F.lit(end[0]), F.lit(end[1]), F.lit(1))).cast("timestamp_ntz"))
    return out


def date_chunks(spark: SparkSession, start: str, end: str, n: int) -> DataFrame:
    """n parts of a date range, the last with the remainder."""
    days = F.floor(F.datediff(F.lit(end), F.lit(start)) / n)
    i = F.col("chunk")
    return spark.range(n).select(F.col("id").cast("int").alias("chunk")).select(
        "chunk", F.date_add(F.lit(start).cast("date"), (i * days).cast("int")).alias("from_day"), F.when(i == n - 1, F.lit(end).cast("date")).otherwise(F.date_add(F.lit(start).cast("date"), ((i + 1) * days).cast("int"))).alias("to_day")
    )


def union_of(chunks: list[DataFrame]) -> DataFrame:
    """Commits of several chunks in one table; members that a chunk lacks are null. A commit that lies in two chunks comes twice, as two deliveries."""
    out = chunks[0]
    for c in chunks[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def not_written(repos: DataFrame, files: DataFrame, name: str = "name") -> DataFrame:
    """Repositories that no file names: user_repository_<anything>_analysis.json (or .7z), in any folder.

    Every part of a file's name that ends before an underscore may be a user and repository, so the files are looked up by equality.
    """
    stem = F.regexp_extract(F.regexp_extract(name, r"([^/]+)$", 1), r"^(.+_.*_analysis)\.(?:json|7z)$", 1)
    words = F.split(stem, "_")
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1))), lambda n: F.array_join(F.slice(words, F.lit(1), n), "_"))
    done = files.filter(stem != "").select(F.explode(heads).alias("_done")).distinct()
    return repos.join(done, F.concat_ws("_", "username", "repo_name") == F.col("_done"), "left_anti")


def written_files(spark: SparkSession, path: str) -> DataFrame:
    """Names of the analysis files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*_analysis.{json,7z}").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("name"))


_COMMIT = re.compile(r"^commit ([0-9a-f]{7,64})((?: [0-9a-f]{7,64})*)", re.M)
_HUNK = re.compile(r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@")
_ZONE = re.compile(r"([+-])(\d{2}):?(\d{2})$")


def _who(head: str, label: str) -> tuple[str | None, str | None]:
    m = re.search(rf"^{label}:\s*(.*?)\s*<([^>]*)>", head, re.M)
    return (m[1], m[2]) if m else (None, None)


def _when(head: str, label: str) -> tuple[str | None, int | None]:
    """A date as written, and its offset in seconds, sign inverted."""
    m = re.search(rf"^{label}:\s*(.+?)\s*$", head, re.M)
    z = _ZONE.search(m[1]) if m else None
    return (m and m[1]), (None if z is None else -(1 if z[1] == "+" else -1) * (int(z[2]) * 3600 + int(z[3]) * 60))


def parsed_diff(diff: str) -> dict[str, list[list[str]]]:
    """[number, text] of the added and the deleted lines."""
    out: dict[str, list[list[str]]] = {"added": [], "deleted": []}
    old = new = 0
    for line in diff.split("\n"):
        h = _HUNK.match(line)
        if h:
            old, new = int(h[1]), int(h[2])
        elif line[:1] == "+":
            out["added"].append([str(new), line[1:]])
            new += 1
        elif line[:1] == "-":
            out["deleted"].append([str(old), line[1:]])
            old += 1
        elif line[:1] == " ":
            old, new = old + 1, new + 1
    return out


def _file_record(text: str) -> dict:
    """One file of a commit, from what follows ``diff --git``."""
    head, at = text, text.find("\n@@")
    head, diff = (text, "") if at < 0 else (text[:at], text[at + 1 :].rstrip("\n") + "\n")
    get = lambda rx: (m := re.search(rx, head, re.M)) and m[1].rstrip("\t")
    names = re.match(r"a/(.*?) b/(.*)", head)
    old, new = get(r"^rename from (.*)$") or get(r"^--- a/(.*)$") or (names and names[1]), get(r"^rename to (.*)$") or get(r"^\+\+\+ b/(.*)$") or (names and names[2])
    kind = "ADD" if "\nnew file mode" in head else "DELETE" if "\ndeleted file mode" in head else "RENAME" if "\nrename from" in head else "COPY" if "\ncopy from" in head else "MODIFY"
    old, new = (None if kind == "ADD" else old), (None if kind == "DELETE" else new)
    lines = parsed_diff(diff)
    return {
        "old_path": old, "new_path": new, "filename": (new or old or "").rsplit("/", 1)[-1], "change_type": f"ModificationType.{kind}", "change_type_name": kind, "diff": diff, "diff_parsed": lines,
        "added_lines": len(lines["added"]), "deleted_lines": len(lines["deleted"]),
    }


def git_commit_records(text: str, repo: str | None = None) -> Iterator[dict]:
    """Commit records of ``git log -p --format=fuller --date=iso --parents`` output, oldest first. A commit that cannot be read has hash, date, message and error only."""
    at = [m.start() for m in _COMMIT.finditer(text)] + [len(text)]
    for a, b in reversed(list(zip(at, at[1:]))):
        head, _, body = text[a:b].partition("\n\n")
        m = _COMMIT.match(head)
        message, *diffs = re.split(r"^diff --git ", body, flags=re.M)
        msg = "\n".join(x[4:] if x.startswith("    ") else x for x in message.strip("\n").split("\n"))
        written, zone = _when(head, "AuthorDate") if "\nAuthorDate:" in head else _when(head, "Date")
        try:
            author, committer = _who(head, "Author"), _who(head, "Commit")
            done, done_zone = _when(head, "CommitDate")
            parents = m[2].split() or ((x := re.search(r"^Merge:\s*(.*)$", head, re.M)) and x[1].split()) or []
            files = [_file_record(d) for d in diffs]
            added, deleted = sum(f["added_lines"] for f in files), sum(f["deleted_lines"] for f in files)
            yield {
                "hash": m[1], "msg": msg, "author": {"name": author[0], "email": author[1]}, "committer": {"name": committer[0] or author[0], "email": committer[1] or author[1]}, "author_date": written, "author_timezone": zone,
                "committer_date": done or written, "committer_timezone": zone if done is None else done_zone, "merge": len(parents) > 1, "parents": parents, "project_name": repo, "insertions": added, "deletions": deleted, "lines": added + deleted,
                "files": len(files), "modified_files": files,
            }
        except Exception as e:  # one commit's fault is that commit's
            yield {"hash": m[1], "msg": msg[:100] + ("..." if len(msg) > 100 else ""), "author_date": written, "error": str(e), "project_name": repo}


def git_logs(logs: DataFrame, repo: Column, text: Column, since: str | None = None, until: str | None = None) -> DataFrame:
    """Commit records parsed from the text of git logs, with the size caps of extraction; one repository's text at a time.

    since, until: first and last author date to keep, as texts that begin like the dates do (YYYY-MM-DD, with a time or not); commits without date are kept. seq: the commit's place in its repository, oldest first.
    """
    schema = COMMIT_TYPE[len("struct<") : -1]

    def read(batches):
        for b in batches:
            for r, t in zip(b["repo"], b["text"]):
                rows = list(git_commit_records(t or "", r))
                for lo in range(0, len(rows), 1000):
                    yield pd.DataFrame({"seq": range(lo, min(len(rows), lo + 1000)), "record": [json.dumps(x) for x in rows[lo : lo + 1000]]})

    parsed = logs.select(repo.alias("repo"), text.alias("text")).mapInPandas(read, "seq long, record string").select("seq", F.from_json("record", f"struct<{schema}>").alias("c")).select("c.*", "seq")
    if since:
        parsed = parsed.filter(F.col("author_date").isNull() | (F.substring("author_date", 1, len(since)) >= since))
    if until:
        parsed = parsed.filter(F.col("author_date").isNull() | (F.substring("author_date", 1, len(until)) <= until))
    return parsed.withColumn("modified_files", capped_files(F.col("modified_files")))


def remote_answers(url: str, seconds: float = 5.0) -> bool:
    """Whether a repository's address answers a listing of its references in time."""
    done = subprocess.run(["git", "ls-remote", url], stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, timeout=seconds, env={**os.environ, "GIT_TERMINAL_PROMPT": "0"})
    return done.returncode == 0


def accessible(repos: DataFrame, probe: Callable[[str], bool] = remote_answers, seconds: float = 5.0, threads: int = 32) -> DataFrame:
    """Repositories with a flag from ``probe(url) -> bool``; a probe that fails or takes longer than ``seconds`` means no. ``threads`` probes run at once in each task."""

    def run(batches):
        for b in batches:
            pool = ThreadPoolExecutor(threads)
            asked, flags = [], []
            for u in b["url"]:
                asked.append(pool.submit(probe, u))
            for k, f in enumerate(asked):
                try:  # those ahead in the queue have had their time already
                    flags.append(bool(f.result(timeout=seconds * (1 + k // threads) + 1)))
                except Exception:
                    flags.append(False)
            pool.shutdown(wait=False, cancel_futures=True)
            yield b.assign(accessible=flags)

    return repos.select(*REPO_FIELDS).mapInPandas(run, "username string, repo_name string, url string, accessible boolean")
