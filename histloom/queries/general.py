"""Queries of the general training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histloom.functions.files import members
from histloom.functions.text import clean_email, instant
from histloom.operators.hotkeys import key_statistics
from histloom.operators.nested import history_tables
from histloom.operators.sessions import sessions
from histloom.queries.common import table

SESSION_GAP = 7200
HOT_SHARE = 0.04


def _commit_sessions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "commits")
    return sessions(c, clean_email(F.col("author.email")), instant(F.col("committer_date"), F.col("committer_timezone")), SESSION_GAP, F.col("hash"))


def p1_found(spark, d):
    return _commit_sessions(spark, d).select(F.col("key").alias("author_email"), F.col("session_start").alias("start_epoch"), F.col("session_end").alias("end_epoch"))


def p1_sessions(spark, d):
    return _commit_sessions(spark, d).withColumnsRenamed({"key": "author_email", "session_start": "start_epoch", "session_end": "end_epoch", "duration": "duration_s", "events": "commits"})


def _statistics(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "commits")
    keys = {"author.email": clean_email(F.col("author.email")), "project_name": F.nullif(F.col("project_name"), F.lit(""))}
    # the identity of a file: its path within its project
    files = F.transform(members("new_path", "old_path"), lambda m: F.concat_ws("\x1f", "project_name", F.coalesce(m["new_path"], m["old_path"])))
    return key_statistics(c, keys, F.col("hash"), F.col("lines"), files)


def p3_found(spark, d):
    return _statistics(spark, d).filter(F.col("share") >= HOT_SHARE).select("key_field", "key_value")


def p3_key_statistics(spark, d):
    return _statistics(spark, d).select("key_field", "key_value", "commits", "changed_lines", "distinct_files", F.round("share", 9).alias("share"))


def _history(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return history_tables(table(spark, d, "raw_records"), F.col("record_id"), F.col("payload"))


def p7_found(spark, d):
    f = _history(spark, d)["files"]
    return f.select(F.col("record").cast("long").alias("record_id"), "hash", "file_pos", "filename", "change_type_name").distinct()


def p7_records(spark, d):
    return _history(spark, d)["records"].withColumn("record", F.col("record").cast("long")).withColumnRenamed("record", "record_id")


def p7_commits(spark, d):
    t = _history(spark, d)["commits"]
    return t.select(F.col("record").cast("long").alias("record_id"), F.coalesce(F.try_element_at("commit_at", F.lit(1)), F.lit(0)).alias("commit_pos"), "hash", "msg", "author_name", "author_email")


def p7_methods(spark, d):
    t = _history(spark, d)["methods"]
    return t.select(F.col("record").cast("long").alias("record_id"), "hash", "file_pos", "method_pos", "name", "start_line", "end_line").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_sessions, p3_found, p3_key_statistics, p7_found, p7_records, p7_commits, p7_methods)}

_EMAIL = r"nullif(lower(regexp_replace(author.email, '^\s+|\s+$', '', 'g')), '')"
_EPOCH = r"""
  (epoch(strptime(replace(left(trim(committer_date), 19), 'T', ' '), '%Y-%m-%d %H:%M:%S'))::bigint
   - case when regexp_matches(trim(committer_date), '[+-]\d\d:?\d\d$') and length(trim(committer_date)) > 19
          then (case when regexp_extract(trim(committer_date), '([+-])\d\d:?\d\d$', 1) = '-' then -1 else 1 end)
               * (regexp_extract(trim(committer_date), '[+-](\d\d):?\d\d$', 1)::int * 3600 + regexp_extract(trim(committer_date), '[+-]\d\d:?(\d\d)$', 1)::int * 60)
          when trim(committer_date) like '%Z' then 0 else -coalesce(committer_timezone, 0) end)"""
_SESSIONS = f"""
with e as (select distinct hash, {_EMAIL} k, {_EPOCH} t from commits where committer_date is not null),
     g as (select *, case when t - lag(t) over (partition by k order by t) <= {SESSION_GAP} then 0 else 1 end f from e where k is not null),
     s as (select *, sum(f) over (partition by k order by t rows unbounded preceding) n from g)
select k, n, min(t) a, max(t) b, count(*) c from s group by k, n"""
_STATS = f"""
with k as (select distinct hash, 'author.email' key_field, {_EMAIL} key_value from commits union
           select distinct hash, 'project_name', nullif(project_name, '') from commits),
     m as (select hash, max(coalesce(lines, 0)) l from commits group by hash),
     f as (select distinct hash, project_name || chr(31) || coalesce(x.new_path, x.old_path) p from (select hash, project_name, unnest(modified_files) x from commits)),
     n as (select count(distinct hash) t from commits),
     a as (select key_field, key_value, count(*) commits, sum(l)::bigint changed_lines from k join m using (hash) where key_value is not null group by 1, 2),
     b as (select key_field, key_value, count(distinct p) distinct_files from k join f using (hash) group by 1, 2)
select a.key_field, a.key_value, commits, changed_lines, coalesce(distinct_files, 0) distinct_files, commits / t share
from a left join b using (key_field, key_value), n"""

# a list may be JSON text, and one entry may stand for the list of it
_NORM = lambda x: f"case when json_type({x}) = 'VARCHAR' and regexp_matches({x} ->> '$', '^\\s*[\\[{{]') and json_valid({x} ->> '$') then ({x} ->> '$')::json else {x} end"
_LIST = lambda x: f"case json_type({x}) when 'ARRAY' then from_json({x}, '[\"JSON\"]') when 'OBJECT' then [{x}] else [] end"
_GIVEN = lambda x: f"nullif(case when json_type({x}) not in ('OBJECT', 'ARRAY') then {x} ->> '$' end, '')"
_FILE_OWN = " and ".join(f"((m -> '$.{c}') is null or json_type(m -> '$.{c}') in ('NULL', 'OBJECT', 'ARRAY'))" for c in ("filename", "new_path", "old_path", "change_type", "change_type_name", "added_lines", "deleted_lines"))
_NESTED = f"""
with v as (select record_id, ltrim(payload, chr(65279)) p from raw_records where payload is not null), j as (select record_id, p::json j from v where json_valid(p)),
 r as (select record_id, j, case when json_type(j) = 'OBJECT' then coalesce(case when json_type(j -> '$.run.result') = 'OBJECT' then j -> '$.run.result' end, j) else j end o from j),
 c0 as (select record_id, {_NORM("(case when json_type(o) = 'ARRAY' then o else o -> '$.commits' end)")} l from r),
 c1 as (select record_id, json_type(l) = 'ARRAY' listed, {_LIST('l')} l from c0), c2 as (select record_id, generate_subscripts(l, 1) - 1 commit_pos, unnest(l) c from c1),
 c as (select *, {_GIVEN("c -> '$.hash'")} h from c2 where json_type(c) = 'OBJECT'),
 m0 as (select record_id, commit_pos, h, c, {_NORM("c -> '$.modified_files'")} m from c),
 m1 as (select record_id, commit_pos, h, {_LIST(f"(case when json_type(m) = 'OBJECT' and {_FILE_OWN} then {_NORM("m -> '$.items'")} else m end)")} l from m0),
 f2 as (select record_id, commit_pos, h, generate_subscripts(l, 1) - 1 file_pos, unnest(l) f from m1), f as (select * from f2 where json_type(f) = 'OBJECT'),
 k0 as (select record_id, h, file_pos, {_LIST(_NORM("f -> '$.methods'"))} l from f), k2 as (select record_id, h, file_pos, generate_subscripts(l, 1) - 1 method_pos, unnest(l) k from k0), k as (select * from k2 where json_type(k) = 'OBJECT')"""
_HEADS = ", ".join(f"{_GIVEN(f'o -> {chr(39)}$.{p}{chr(39)}')} {n}" for n, p in (("project_name", "project_name"), ("ecosystem", "ecosystem"), ("metrics_type", "metrics_type"), ("start_date", "analysis_period.start_date"), ("end_date", "analysis_period.end_date"), ("full_history", "analysis_period.full_history")))

SQL = {
    "p7_found": f"""{_NESTED} select distinct record_id, h hash, file_pos, coalesce({_GIVEN("f -> '$.filename'")}, string_split(coalesce({_GIVEN("f -> '$.new_path'")}, {_GIVEN("f -> '$.old_path'")}), '/')[-1]) filename,
 coalesce({_GIVEN("f -> '$.change_type_name'")}, case when {_GIVEN("f -> '$.change_type'")} is not null then regexp_extract({_GIVEN("f -> '$.change_type'")}, '\\.(.*)$', 1) end) change_type_name from f""",
    "p7_records": f"{_NESTED} select record_id, {_HEADS} from r",
    "p7_commits": f"""{_NESTED} select record_id, commit_pos, h hash, {_GIVEN("c -> '$.msg'")} msg, {_GIVEN("c -> '$.author.name'")} author_name, {_GIVEN("c -> '$.author.email'")} author_email from c""",
    "p7_methods": f"""{_NESTED} select distinct record_id, h hash, file_pos, method_pos, {_GIVEN("k -> '$.name'")} as name, ({_GIVEN("k -> '$.start_line'")})::int start_line, ({_GIVEN("k -> '$.end_line'")})::int end_line from k""",
    "p1_found": f"select k author_email, a start_epoch, b end_epoch from ({_SESSIONS})",
    "p1_sessions": f"select k author_email, a start_epoch, b end_epoch, b - a duration_s, c commits from ({_SESSIONS})",
    "p3_found": f"select key_field, key_value from ({_STATS}) where share >= {HOT_SHARE}",
    "p3_key_statistics": f"select key_field, key_value, commits, changed_lines, distinct_files, round(share, 9) share from ({_STATS})",
}
