"""SQL of the history queries.

The plans are written anew here, while word lists and patterns are those of ``functions/rules.py``: a wrong entry of a list would be wrong on both
sides. What the rules give for known inputs is pinned in ``tests/test_rules.py``.
"""

from __future__ import annotations

import re

from histloom.functions import rules


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_DATE = "trim(committer_date)"
_EPOCH = rf"""(epoch(strptime(replace(left({_DATE}, 19), 'T', ' '), '%Y-%m-%d %H:%M:%S'))::bigint - case when length({_DATE}) > 19 and regexp_matches({_DATE}, '[+-]\d\d:?\d\d$')
 then (case when regexp_extract({_DATE}, '([+-])\d\d:?\d\d$', 1) = '-' then -1 else 1 end) * (regexp_extract({_DATE}, '[+-](\d\d):?\d\d$', 1)::int * 3600 + regexp_extract({_DATE}, '[+-]\d\d:?(\d\d)$', 1)::int * 60)
 when {_DATE} like '%Z' then 0 else -coalesce(committer_timezone, 0) end)"""
_AEPOCH = _EPOCH.replace("committer_", "author_")
_LOCAL = "strptime(replace(left(trim({0}), 19), 'T', ' '), '%Y-%m-%d %H:%M:%S')"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_PATH = "coalesce(nullif(new_path, ''), filename)"

BASE = f"""
with recursive b as (select *, row_number() over (partition by hash order by extracted_at) rn from commits where hash is not null and error is null),
c as (select hash, project_name repo, msg, author.name author, {_STRIP.format('author.email')} email, lower({_STRIP.format('author.email')}) dev, {_EPOCH} ts, {_AEPOCH} author_ts, {_LOCAL.format('committer_date')} as local_, {_LOCAL.format('author_date')} author_local,
      coalesce(lines, 0) lines, coalesce(insertions, 0) insertions, coalesce(deletions, 0) deletions, coalesce(len(modified_files), 0) n_files, modified_files from b where rn = 1),
f as (select * exclude (modified_files, m), m.filename filename, m.new_path new_path, m.old_path old_path, m.change_type_name kind, coalesce(m.added_lines, 0) added, coalesce(m.deleted_lines, 0) deleted, m.diff diff, m.diff_parsed dp, m.source_code_before prior, m.source_code src
      from (select *, generate_subscripts(modified_files, 1) - 1 file_idx, unnest(modified_files) m from c))"""
_RENAMES = """,
o as (select *, row_number() over (order by ts, hash, file_idx) ord from f),
rn as (select repo r_repo, old_path r_old, ord r_ord from o where kind = 'RENAME' and old_path is not null),
rf as (select o.*, r_ord from o asof left join rn on o.repo = r_repo and o.new_path = r_old and o.ord > r_ord),
ch as (select ord start_, new_path np, r_ord nx from rf where kind = 'RENAME' union all select ch.start_, rf.new_path, rf.r_ord from ch join rf on rf.ord = ch.nx),
p as (select rf.*, coalesce(ch.np, rf.new_path) path from rf left join (select * from ch where nx is null) ch on ch.start_ = rf.r_ord)"""
_WEEKS = """,
sp as (select repo, min(author_local) a, max(author_local) z from c group by repo),
wk as (select c.hash, 'Week_' || (floor(epoch(author_local - a) / 604800)::int + 1) || '_' || strftime(a + to_days(floor(epoch(author_local - a) / 604800)::int * 7), '%Y-%m-%d') week_label
       from c join sp using (repo) where epoch(author_local - a) - floor(epoch(author_local - a) / 604800) * 604800 <= 518400 and a + to_days(floor(epoch(author_local - a) / 604800)::int * 7) < z)"""
_MON = "strftime(date_trunc('week', local_), '%Y-%m-%d')"
_TXT = r"[coalesce(x[2], '') for x in coalesce(dp.{0}, [])]"


def _strip(x: str) -> str:
    return _STRIP.format(x)


_CHURN = """select {0}, sum(t) total_count, max(t) total_max, round_even(avg(t), 0) total_avg, sum(n) net_count, max(n) net_max, round_even(avg(n), 0) + 0 net_avg, sum(a) added, sum(d) removed
 from (select {0}, {1} file, sum(added) a, sum(deleted) d, sum(added) + sum(deleted) t, sum(added) - sum(deleted) n from {2} group by all) group by {0}"""
_EVENTS = r""",
hk as (select repo, hash, file_idx, author, ts, coalesce(nullif(new_path, ''), filename) file, regexp_extract_all(diff, '@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@', 1) os, regexp_extract_all(diff, '@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@', 3) ns,
        regexp_split_to_array(diff, '@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@')[2:] ts_ from f where diff like '%@@ -%'),
h2 as (select repo, hash, file_idx, author, ts, file, generate_subscripts(os, 1) hunk, unnest(os)::int o, unnest(ns)::int n, unnest(ts_) body from hk),
l1 as (select *, list_filter(string_split(string_split(body, '@@')[1], chr(10)), lambda x: x <> '') ls from h2),
l2 as (select * exclude (ls, body), generate_subscripts(ls, 1) idx, left(unnest(ls), 1) op from l1),
ev as (select *, case when op = '+' then n + coalesce(sum((op <> '-')::int) over w, 0) else o + coalesce(sum((op <> '+')::int) over w, 0) end no from l2 window w as (partition by hash, file_idx, hunk order by idx rows between unbounded preceding and 1 preceding)),
e2 as (select *, lag(op) over w2 lo, lag(author) over w2 la from ev where op in ('+', '-') window w2 as (partition by repo, file, no order by ts, hash, file_idx, hunk, idx))"""
_TRUE = "select {0}, count(*) filter (op = '+') contribution, count(*) filter (op = '-' and lo = '+' and la is not distinct from author) churn from e2 group by {0}"
_DELTA = rf""",
g0 as (select hash, file_idx, repo, dev, local_, filename, {_TXT.format('added')} a, {_TXT.format('deleted')} d, dp is null or filename is null or regexp_matches(filename, {_q(rules.skip_pattern)}) skip from f),
g1 as (select *, list_distinct([x for x in a if {_strip('x')} <> '' and list_contains([{_strip('y')} for y in d], {_strip('x')})]) mv from g0),
g2 as (select *, len([x for x in a if length({_strip('x')}) > 1 and not regexp_matches(x, {_q(rules.delta_drop_pattern)}) and not list_contains(mv, x)]) na,
        len([x for x in d if length({_strip('x')}) > 1 and not regexp_matches(x, {_q(rules.delta_drop_pattern)}) and not list_contains(mv, x)]) nd, (greatest(0, least(len(a), len(d)) - len(mv)) * 8 // 10)::int nu, len(mv) nm from g1),
dd as (select hash, file_idx, repo, dev, local_, filename, case when skip then 0 else na end d_added, case when skip then 0 else nd end d_deleted, case when skip then 0 else nu end d_updated, case when skip then 0 else nm end d_moved from g2),
d3 as (select *, d_added * 1.0::double + d_deleted * 0.25::double + d_updated * 0.75::double + d_moved * 0.1::double delta from dd)"""


def _velocity(week: str) -> str:
    k = "dev" + (", week" if week else "")
    on = "x.dev is not distinct from y.dev" + (" and x.week = y.week" if week else "")
    w = f", {_MON} as week" if week else ""
    return f"""{BASE}{_DELTA} select x.*, coalesce(y.diff_delta, 0) diff_delta, coalesce(y.lines_added, 0) lines_added, coalesce(y.lines_deleted, 0) lines_deleted, coalesce(y.lines_updated, 0) lines_updated, coalesce(y.lines_moved, 0) lines_moved,
 coalesce(y.files_changed, 0) files_changed, coalesce(y.diff_delta, 0) / greatest(1, x.active_days) velocity_per_day
 from (select dev{w}, count(*) commits, count(distinct local_::date) active_days from c group by {k}) x left join
 (select dev{w}, sum(d_added) * 1.0::double + sum(d_deleted) * 0.25::double + sum(d_updated) * 0.75::double + sum(d_moved) * 0.1::double diff_delta, sum(d_added) lines_added, sum(d_deleted) lines_deleted, sum(d_updated) lines_updated, sum(d_moved) lines_moved, count(distinct filename) files_changed from d3 group by {k}) y on {on}"""


_AGES = rf""",
k0 as (select repo, filename, dev, ts, local_, hash, file_idx, coalesce(dp.added, []) ad, coalesce(dp.deleted, []) de, string_split(coalesce(prior, ''), chr(10)) pr from f where regexp_matches(filename, {_q(rules.code_pattern)})),
ka as (select repo, filename, dev, ts, local_, hash, file_idx, ts wrote, 2 phase, '+' op, u[1]::int no, i, coalesce(u[2], '') t from (select *, generate_subscripts(ad, 1) i, unnest(ad) u from k0)),
kd as (select repo, filename, dev, ts, local_, hash, file_idx, ts wrote, 1 phase, '-' op, u[1]::int no, i from (select *, generate_subscripts(de, 1) i, unnest(de) u from k0)),
kp as (select repo, filename, dev, ts, local_, hash, file_idx, ts - 60 * 86400 wrote, 0 phase, '+' op, no, no i, t from (select *, generate_subscripts(pr, 1) no, unnest(pr) t from k0)),
good_a as (select * exclude (t) from ka where no is not null and length({_strip('t')}) > 1 and not regexp_matches({_strip('t')}, '^(#|//|/\*|\*|<!--)')),
good_p as (select * exclude (t) from kp where length({_strip('t')}) > 1 and not regexp_matches({_strip('t')}, '^(#|//|/\*|\*|<!--)')),
tch as (select repo, filename, min(struct_pack(ts := ts, h := hash, i := file_idx)) fst from (select repo, filename, ts, hash, file_idx from good_a union all select repo, filename, ts, hash, file_idx from kd where no is not null union all select repo, filename, ts, hash, file_idx from good_p) group by all),
ke as (select * from good_a union all select * from kd where no is not null union all select p.* from good_p p join tch on p.repo = tch.repo and p.filename = tch.filename and p.hash = fst.h and p.file_idx = fst.i),
kl as (select *, case when lag(op) over w = '+' then ts - lag(wrote) over w end age from ke window w as (partition by repo, filename, no order by ts, hash, file_idx, phase, i)),
pv as (select dev, {_MON} as week, count(*) total_lines, count(*) filter (age is null) new_lines, count(*) filter (age <= 30 * 86400) recent_lines, count(*) filter (age > 30 * 86400 and age <= 365 * 86400) old_lines, count(*) filter (age > 365 * 86400) legacy_lines from kl where phase = 2 group by all)"""
_HOURS = rf""",
wh as (select hash, sum(case when filename is null or regexp_matches(filename, {_q(rules.TRIVIAL)}) then 0 when dp is null then (added + deleted) * 7 // 10
   else len([x for x in {_TXT.format('added')} if length({_strip('x')}) >= 3 and not regexp_matches({_strip('x')}, '^(//|#|/\*|\*|import |from |using |require)')]) + len([x for x in {_TXT.format('deleted')} if length({_strip('x')}) >= 3 and not regexp_matches({_strip('x')}, '^(//|#|/\*|\*|import |from |using |require)')]) end) worth from f group by hash),
ww as (select c.dev, c.ts, c.local_, coalesce(worth, 0) worth from c left join wh using (hash) where dev is not null),
w1 as (select *, case when ts - lag(ts) over (partition by dev order by ts) <= 7200 then 0 else 1 end nw from ww), w2 as (select *, sum(nw) over (partition by dev order by ts rows unbounded preceding) k from w1),
w3 as (select dev, min(ts) - 1800 start_, max(ts) + 900 end_, min(struct_pack(t := ts, l := local_)).l - interval 30 minute ls, count(*) n, sum(worth) ch from w2 group by dev, k),
w4 as (select *, (end_ - start_) / 3600.0::double * case when n = 1 then 0.75::double when n > 10 then 0.9::double else 1 end h from w3),
ss as (select *, least(8.0::double, h * case when ch / greatest(0.1::double, h) > 1000 then 0.8::double when ch / greatest(0.1::double, h) < 50 then 1.1::double else 1 end) as hours from w4)"""
_S4 = """,
t1 as (select dev, ts, case when ts - lag(ts) over (partition by dev order by ts) <= 14400 then 0 else 1 end nw from c where dev in (select dev from c group by dev having count(*) >= 2)),
t2 as (select *, sum(nw) over (partition by dev order by ts rows unbounded preceding) k from t1),
s4 as (select dev, min(ts) session_start, max(ts) session_end, (max(ts) - min(ts)) / 3600.0::double as hours, count(*) commits from t2 group by dev, k)"""


def _domain(col: str) -> str:
    name = f"string_split({col}, '/')[-1]"
    ext = rf"regexp_extract({name}, '[^.].*\.([^.]*)$', 1)"
    cases = []
    for dom, exts, names, folders, _ in rules.DOMAINS:
        lists = [f"{ext} in ({', '.join(map(_q, exts.split()))})"]
        if names:
            lists.append(f"{name} in ({', '.join(map(_q, names.split()))})")
        lists += [f"contains({col}, {_q(x)})" for x in folders.split()]
        cases.append(f"when {' or '.join(lists)} then {_q(dom)}")
    return f"case {' '.join(cases)} else 'other' end"


def _language(col: str) -> str:
    e = f"lower(string_split({col}, '.')[-1])"
    return f"case when {col} not like '%.%' then 'unknown' else coalesce(map {{{', '.join(f'{_q(k)}: {_q(v)}' for k, v in rules.LANGUAGE_OF.items())}}}[{e}], 'unknown') end"


_FIX = f"regexp_matches(lower(coalesce(msg, '')), {_q(rules.bug_pattern)})"
_REPOS = f"(select distinct {', '.join(_strip(x) + ' ' + x for x in ('username', 'repo_name', 'url'))} from repos where {' and '.join(_strip(x) + chr(32) + '<> ' + chr(39) * 2 for x in ('username', 'repo_name', 'url'))})"
_REPORTS = f"""{BASE} select username, repo_name, url, start_date, end_date, coalesce(n, 0) total_commits, coalesce(a, 0) total_lines_added, coalesce(r, 0) total_lines_removed from {_REPOS}
 left join (select repo, count(*) n, sum(insertions) a, sum(deletions) r, strftime(min(author_local), '%Y-%m-%d %H:%M:%S') start_date, strftime(max(author_local), '%Y-%m-%d %H:%M:%S') end_date from c group by repo) on repo = repo_name"""
_VW = f"{_velocity('w')}"
_WEEKLY = f"""{BASE}{_DELTA}{_AGES}{_HOURS},
vx as (select dev, {_MON} as week, count(distinct local_::date) active_days from c group by all), vy as (select dev, {_MON} as week, sum(d_added) * 1.0::double + sum(d_deleted) * 0.25::double + sum(d_updated) * 0.75::double + sum(d_moved) * 0.1::double diff_delta, sum(d_added) lines_added, sum(d_updated) lines_updated, sum(d_deleted) lines_deleted, sum(d_moved) lines_moved from d3 group by all),
v as (select vx.dev, vx.week, coalesce(diff_delta, 0) diff_delta, coalesce(lines_added, 0) lines_added, coalesce(lines_updated, 0) lines_updated, coalesce(lines_deleted, 0) lines_deleted, coalesce(lines_moved, 0) lines_moved, coalesce(diff_delta, 0) / greatest(1, active_days) velocity_per_day, active_days from vx left join vy on vx.dev is not distinct from vy.dev and vx.week = vy.week),
hh as (select dev, strftime(date_trunc('week', ls), '%Y-%m-%d') as week, round_even(sum(hours), 2) estimated_hours, count(*) sessions, round_even(sum(hours) / greatest(1, count(distinct ls::date)), 2) hours_per_day from ss group by all),
wks as (select coalesce(v.dev, pv.dev, hh.dev) dev, coalesce(v.week, pv.week, hh.week) as week, coalesce(diff_delta, 0) diff_delta, coalesce(lines_added, 0) lines_added, coalesce(lines_updated, 0) lines_updated, coalesce(lines_deleted, 0) lines_deleted, coalesce(lines_moved, 0) lines_moved,
   coalesce(velocity_per_day, 0) velocity_per_day, coalesce(active_days, 0) active_days, coalesce(new_lines / total_lines * 100, 0) new_percent, coalesce(recent_lines / total_lines * 100, 0) recent_percent, coalesce(old_lines / total_lines * 100, 0) old_percent, coalesce(legacy_lines / total_lines * 100, 0) legacy_percent,
   coalesce(estimated_hours, 0) estimated_hours, coalesce(sessions, 0) sessions, coalesce(hours_per_day, 0) hours_per_day
   from v full join pv on v.dev = pv.dev and v.week = pv.week full join hh on hh.dev = coalesce(v.dev, pv.dev) and hh.week = coalesce(v.week, pv.week))"""
_TREND = f"""{_WEEKLY},
tn as (select *, row_number() over (partition by dev order by week desc) k, count(*) over (partition by dev) n from wks where dev is not null),
tg as (select dev, max(n) as weeks, sum(diff_delta) total_diff_delta, avg(diff_delta) filter (k <= 4) rec, avg(diff_delta) filter (k > 4 and (n < 8 or k <= 8)) old, avg(diff_delta) filter (k <= 8) m, stddev_samp(diff_delta) filter (k <= 8) sd,
  count(*) filter (diff_delta > 0) act, avg(diff_delta) filter (diff_delta > 0) av, avg(estimated_hours) filter (diff_delta > 0) ah from tn group by dev),
tr as (select dev, weeks, total_diff_delta, case when old is null or old = 0 then 0 else round_even((rec - old) / old * 100, 2) end velocity_trend, case when weeks < 2 then 100 when m = 0 then 0 else round_even(greatest(0, 100 - sd / m * 100), 2) end consistency,
  round_even(act / weeks * 100, 2) activity_rate, coalesce(av, 0) avg_weekly_velocity, coalesce(ah, 0) avg_weekly_hours from tg)"""

SQL = {
    "a1_change_set": f"{BASE} select repo, max(n_files) max_files, avg(n_files) avg_files from c group by repo",
    "a1_file_changes": f"{BASE} select repo, filename, count(*) changes from f group by all",
    "j3_renamed_paths": f"{BASE}{_RENAMES} select hash, file_idx, path from p",
    "a2_commits_count": f"{BASE}{_RENAMES} select repo, path, count(*) modifications from p group by all",
    "a3_a4_contributors": f"""{BASE}{_RENAMES}, q as (select repo, path, email, sum(added + deleted) n from p group by all), t as (select repo, path, sum(n) t, count(email) experience from q group by all),
 m as (select q.repo, q.path, count(*) total, count(*) filter (n / t < 0.05) minor from q join t on q.repo = t.repo and q.path is not distinct from t.path where t > 0 and n > 0 and email is not null group by all)
 select t.repo, t.path, total, minor, experience from t left join m on t.repo = m.repo and t.path is not distinct from m.path""",
    "a5_hunks_count": rf"""{BASE}{_RENAMES}, l as (select repo, path, len(regexp_extract_all(array_to_string([case when regexp_matches(x, '^[+-]') then '+' else ' ' end for x in string_split(diff, chr(10))], ''), '\++')) h from p where coalesce(diff, '') <> '')
 select repo, path, median(h) median_hunks from l group by all""",
    "a6_lines_count": f"""{BASE}{_RENAMES}, n as (select *, case when kind in ('ADD', 'DELETE', 'MODIFY', 'RENAME') then len([x for x in {_TXT.format('added')} if {_strip('x')} = '']) else 0 end na, case when kind in ('ADD', 'DELETE', 'MODIFY', 'RENAME') then len([x for x in {_TXT.format('deleted')} if {_strip('x')} = '']) else 0 end nr from p)
 select repo, path, {', '.join(f'sum({c}) {k}_total, max({c}) {k}_max, round_even(avg({c}), 0) {k}_avg' for k, c in (('added', 'added'), ('removed', 'deleted'), ('noop_added', 'na'), ('noop_removed', 'nr')))} from n group by all""",
    "a46_accumulator": f"{BASE} select repo, filename, count(*) changes, sum(added + deleted) churn, count(distinct author) contributors, sum(len({_TXT.format('added')}) + len({_TXT.format('deleted')})) diff_lines, sum(added) added, sum(deleted) deleted from f group by all",
    "a7_code_churn": BASE + _CHURN.format("repo", _PATH, "f"),
    "a8_true_churn": BASE + _EVENTS + _TRUE.format("repo"),
    "a8_true_churn_by_author": BASE + _EVENTS + _TRUE.format("repo, author"),
    "a8_true_churn_by_file": BASE + _EVENTS + _TRUE.format("repo, file"),
    "a9_file_churn": f"""{BASE}{_EVENTS}, t as ({_TRUE.format('repo, file')}), r as (select repo, {_PATH} file, sum(added + deleted) churn, max(added + deleted) churn_max, round_even(avg(added + deleted), 0) churn_avg, count(*) changes from f group by all)
 select r.*, coalesce(contribution, 0) true_contribution, coalesce(t.churn, 0) true_churn from r left join t on r.repo is not distinct from t.repo and r.file is not distinct from t.file""",
    "a10_commit_churn": f"{BASE} select hash, count(*) files, sum(added) added, sum(deleted) removed, sum(added + deleted) churn from (select * from f qualify row_number() over (partition by hash, {_PATH} order by file_idx desc) = 1) group by hash",
    "a11_weekly_churn": f"""{BASE}, g as (select repo, {_MON} as week, {_PATH} file, added, deleted, added + deleted n from f)
 select repo, week, case when grouping(file) = 1 then 'week' else 'file' end as level, file, sum(n) churn, max(n) churn_max, round_even(avg(n), 0) churn_avg, sum(added) added, sum(deleted) removed, count(*) changes from g group by grouping sets ((repo, week), (repo, week, file))""",
    "a11_weekly_true_churn": f"{BASE}{_EVENTS.replace('author, ts, coalesce', 'author, ts, local_, coalesce').replace('author, ts, file,', 'author, ts, local_, file,')} {_TRUE.format(f'repo, {_MON} as week').replace(f'group by repo, {_MON} as week', 'group by all')}",
    "a12_author_churn": f"""{BASE}{_EVENTS}, t as ({_TRUE.format('repo, author')}), r as (select repo, author, sum(added + deleted) churn, sum(added) added, sum(deleted) removed, count(*) file_count from (select * from f qualify row_number() over (partition by hash, {_PATH} order by file_idx desc) = 1) group by all)
 select r.*, coalesce(contribution, 0) true_contribution, coalesce(t.churn, 0) true_churn from r left join t on r.repo is not distinct from t.repo and r.author is not distinct from t.author""",
    "a13_extracted_churn": f"{BASE} select repo, {_PATH} file, sum(added + deleted) total, sum(added - deleted) net from f group by all",
    "a14_bugs": f"{BASE}{_RENAMES} select repo, path, sum(case when {_FIX} then added + deleted else 0 end) bug_lines, sum(added + deleted) lines, case when sum(added + deleted) > 0 then sum(case when {_FIX} then added + deleted else 0 end) / sum(added + deleted) * 100 else 0 end bug_percent from p group by all",
    "a14_bugs_overall": f"{BASE}, g as (select repo, sum(case when {_FIX} then added + deleted else 0 end) b, sum(added + deleted) n from f group by repo) select repo, b total_bug_lines, n total_lines, case when n > 0 then b / n * 100 else 0 end overall_bug_percent from g",
    "a20_diff_delta": f"{BASE}{_DELTA} select hash, file_idx, d_added, d_deleted, d_updated, d_moved, round(delta, 6) delta from d3",
    "a21_velocity": _velocity(""),
    "a21_velocity_weekly": _VW,
    "a22_code_provenance": f"{BASE}{_AGES} select *, new_lines / total_lines * 100 new_percent, recent_lines / total_lines * 100 recent_percent, old_lines / total_lines * 100 old_percent, legacy_lines / total_lines * 100 legacy_percent from pv",
    "a24_sessions_2h": f'{BASE}{_HOURS} select dev, start_ as start, end_ as "end", n commits, ch changes, round(hours, 6) as hours from ss',
    "a27_developer_hours": f"{BASE}{_HOURS} select dev, strftime(ls, '%G-W%V') as week, round_even(sum(hours), 2) estimated_hours, count(*) sessions, sum(n) commits, round_even(sum(hours) / greatest(1, count(distinct ls::date)), 2) hours_per_day from ss group by all",
    "a27_developer_totals": f"{BASE}{_HOURS} select dev, round(sum(hours), 6) total_estimated_hours, count(*) total_sessions, sum(n) total_commits from ss group by dev",
    "a28_code_domain": f"{BASE}, g as (select dev, {_domain('filename')} as domain, sum(added + deleted) lines from f where added + deleted > 0 group by all) select *, lines / sum(lines) over (partition by dev) * 100 percent from g",
    "a28_code_domain_weekly": f"{BASE}, g as (select dev, {_MON} as week, {_domain('filename')} as domain, sum(added + deleted) lines from f where added + deleted > 0 group by all) select *, lines / sum(lines) over (partition by dev, week) * 100 percent from g",
    "a29_basic_stats": f"""{BASE} select dev, count(*) total_commits, count(distinct repo) total_repos, min(ts) first_ts, max(ts) last_ts, round_even((max(ts) - min(ts)) / 86400, 2) total_span_days, round_even(count(*) / greatest(1, (max(ts) - min(ts)) / 86400), 3) commits_per_day,
 sum(lines) total_lines_changed, sum(n_files) total_files_changed from c where dev is not null group by dev having count(*) >= 2""",
    "a30_a34_intervals": f"""{BASE}, g as (select dev, ts - lag(ts) over (partition by dev order by ts, hash) gap from c where dev is not null) select dev, round_even(avg(gap) / 3600, 2) mean_hours, round_even(median(gap) / 3600, 2) median_hours, round_even(min(gap) / 60, 2) min_minutes, round_even(max(gap) / 86400, 2) max_days,
 count(*) filter (gap <= 14400) short_breaks, count(*) filter (gap > 86400) long_breaks, avg(gap) / 3600 avg_break_hours from g where gap is not null group by dev""",
    "a31_work_sessions": f"{BASE}{_S4} select dev, count(*) session_count, round_even(avg(hours), 2) avg_hours, round_even(max(hours), 2) max_hours, round_even(avg(commits), 2) avg_commits, max(commits) max_commits from s4 group by dev",
    "a31_last_sessions": f"{BASE}{_S4} select dev, row_number() over (partition by dev order by session_start desc) back, session_start, session_end, round_even(hours, 2) as hours, commits from s4 qualify back <= 5",
    "a32_daily_patterns": f"""{BASE}, g as (select dev, isodow(local_) - 1 as day, count(*) n, min(struct_pack(t := ts, h := hash)) seen from c where dev is not null group by all), r as (select *, row_number() over (partition by dev order by n desc, seen) k from g)
 select dev, max(n) peak_day_count, max(case when k = 1 then day end) peak_day, {', '.join(f'sum(case when day = {k} then n else 0 end) day_{k}' for k in range(7))} from r group by dev having sum(n) >= 2""",
    "a33_weekly_patterns": f"{BASE}, g as (select dev, strftime(local_, '%Y-W%U') w, count(*) n from c where dev is not null group by all) select dev, count(*) total_weeks, avg(n) avg_per_week, max(n) max_per_week, min(n) min_per_week from g group by dev having sum(n) >= 2",
    "a35_rhythm": f"{BASE}{_S4}, g as (select dev, count(*) n, (max(ts) - min(ts)) // 86400 + 1 as days from c where dev is not null group by dev having count(*) >= 2), k as (select dev, count(*) k from s4 group by dev) select dev, n / days activities_per_day, coalesce(k, 0) / days consistency_score from g left join k using (dev)",
    "a36_sustained": f"""{BASE}, g as (select dev, local_::date as day, count(*) n from c where dev is not null group by all), i as (select *, day - row_number() over (partition by dev order by day)::int isle from g), k as (select dev, isle, count(*) len, sum(n) n from i group by all)
 select dev, sum(len) total_active_days, max(len) max_consecutive_days, sum(n) / sum(len) avg_per_active_day from k group by dev having sum(n) >= 2""",
    "a37_repo_activity": f"{BASE} select repo, count(*) commits, count(distinct dev) developers, min(ts) first_ts, max(ts) last_ts from c group by repo",
    "a38_weekly_stats": f"{_WEEKLY} select * from wks where dev is not null",
    "a39_a41_trends": f"{_TREND} select * from tr",
    "a42_top_developers": f"{_TREND} " + " union all ".join(f"select * from (select dev, {k}::double as value, '{k}' ranking from tr order by {k} desc, dev nulls first limit 5)" for k in ("total_diff_delta", "consistency", "activity_rate")),
    "f_path_rules": f"""{BASE} select distinct filename, not regexp_matches(filename, {_q(rules.ignored_pattern)}) kept, regexp_matches(filename, {_q(rules.test_pattern)}) test, regexp_matches(filename, {_q(rules.doc_pattern)}) doc, {_language('filename')} as language, regexp_matches(filename, {_q(rules.skip_pattern)}) skipped,
 regexp_matches(filename, {_q(rules.code_pattern)}) code, regexp_matches(filename, {_q(rules.TRIVIAL)}) trivial, {_domain('filename')} as domain, left(md5(filename), 8) md5_8 from f where filename is not null""",
    "f6_bug_messages": f"{BASE} select hash, {_FIX} bug_fix from c",
    "f4_month_range": f"{BASE} select hash from c where author_local between timestamp '2016-03-01' and timestamp '2018-02-28'",
    "w_week_keys": f"{BASE} select hash, {_MON} monday, strftime(local_, '%G-W%V') iso, strftime(local_, '%Y-W%U') sunday from c",
    "w1_analysis_weeks": f"{BASE}{_WEEKS} select hash, week_label from wk",
    "s1_repositories": f"select username, count(*) n, list(repo_name order by repo_name, url) names from {_REPOS} group by username",
    "s6_date_range": f"{BASE} select repo, min(author_ts) first_ts, max(author_ts) last_ts from c group by repo",
    "s10_accessible": f"select *, url like 'https://%' accessible from {_REPOS}",
    "f2_f3_users": f"with r as (select * from {_REPOS} where lower(username) like 'b%') select * from r where username in (select distinct username from r order by username limit 3)",
    "f21_addresses": f"select url, case when contains(url, 'github.com') and len(string_split(url, '/')) >= 4 then string_split(url, '/')[4] end as owner, string_split(url, '/')[-1] as name, not regexp_matches(url, {_q(rules.ignored_pattern)}) kept from {_REPOS}",
    "j8_not_done": f"select * from {_REPOS} where username not in (select username from completed_users where username is not null)",
    "k1_k2_reports": _REPORTS,
    "k4_combined": f"with recursive x as ({_REPORTS}) select username, count(*) repositories, sum(total_commits) total_commits, sum(total_lines_added) total_lines_added, sum(total_lines_removed) total_lines_removed from x group by username",
    "k6_completed": "select username from completed_users where username is not null union select username from repos where username is not null",
    "a44_summary": "select project_name, count(*) files, sum(coalesce(processing.total_commits, 0)) total_commits, sum(coalesce(processing.total_lines_added, 0)) total_lines_added, sum(coalesce(processing.total_lines_removed, 0)) total_lines_removed from analysis_files group by project_name",
    "c9_groups": "select repo_category, project_name organization, count(distinct repository_name) repositories from analysis_files group by all",
    "j9_not_written": f"select * from {_REPOS} r where not exists (select 1 from analysis_files a where analysis_period.full_history and concat_ws('_', a.project_name, a.repository_name, 'full_history_analysis.json') like replace(replace(r.username || '_' || r.repo_name, '_', '\\_'), '%', '\\%') || '\\_%' escape '\\')",
    "u1_chunks": "select project_name repo, count(*) deliveries, count(distinct hash) commits from commits where error is null group by all",
    "u5_date_chunks": "select i::int chunk, strftime(date '2014-01-01' + (i * 521)::int, '%Y-%m-%d') from_day, case when i = 6 then '2024-01-01' else strftime(date '2014-01-01' + ((i + 1) * 521)::int, '%Y-%m-%d') end to_day from range(7) t(i)",
}


def _words(lang: str) -> str:
    return f"case {lang} " + " ".join(f"when {_q(k)} then [{', '.join(map(_q, w))}]" for k, w in rules.KEYWORDS.items()) + " else [] end"


def _line(line: str, lang: str) -> dict[str, str]:
    """The line predicates over an expression."""
    bare, q = _strip(line), _q("")
    word = f"lower({_strip(f'regexp_replace({line}, {_q(chr(91) + ':;]+$')}, {q})')})"
    rest = _strip(f"regexp_replace({line}, '[a-zA-Z0-9]{{20,}}', {q}, 'g')")
    long_ = f"(regexp_matches({line}, '[a-zA-Z0-9]{{20,}}') and length({rest}) < length({bare}) * 0.3)"
    repeat = f"regexp_matches({line}, '_{{5,}}|={{5,}}|-{{5,}}')"
    few = f"(length({line}) > 200 and len(list_distinct(string_split(replace({line}, ' ', ''), ''))) < 10)"
    syntax = rf"""(regexp_matches({line}, {_q(rules.BRACE_ONLY)}) or list_contains({_words(lang)}, {word}) or ({lang} = 'ruby' and {bare} = 'end') or ({lang} in ('haskell', 'elm') and {bare} in ('where', 'let', 'in'))
 or ({lang} = 'xml' and regexp_matches({line}, '^\s*<[^>]*>\s*$')) or ({lang} in ('yaml', 'json') and {bare} in ('{{', '}}', '[', ']', '-')))"""
    return {"bare": bare, "long": long_, "repeat": repeat, "few": few, "syntax": syntax}


_L, _S = _line("line", "lang"), _line("bare", "lang")
_BARE, _LONG, _REPEAT, _FEW, _SYNTAX = (_L[k] for k in ("bare", "long", "repeat", "few", "syntax"))
SQL["f_line_rules"] = rf"""{BASE}, l as (select distinct {_language('filename')} as lang, unnest({_TXT.format('added')}) line from f where filename is not null)
 select lang as language, count(*) lines, count(*) filter ({_BARE} = '') noop, count(*) filter (length({_BARE}) > 1 and not regexp_matches(line, {_q(rules.delta_drop_pattern)})) delta,
 count(*) filter (length({_BARE}) > 1 and not regexp_matches({_BARE}, '^(#|//|/\*|\*|<!--)')) provenance, count(*) filter (length({_BARE}) >= 3 and not regexp_matches({_BARE}, '^(//|#|/\*|\*|import |from |using |require)')) as hours,
 count(*) filter ({_LONG}) long_sequences, count(*) filter (not {_LONG} and {_REPEAT}) repeated_chars, count(*) filter (not {_LONG} and not {_REPEAT} and {_FEW}) repetitive, count(*) filter ({_SYNTAX}) only_syntax,
 count(*) filter (bare <> '' and not {_S['long']} and not {_S['repeat']} and not {_S['few']} and not {_S['syntax']}) meaningful from (select *, {_BARE} bare from l) group by lang"""
_VERDICTS = """,
 z0 as (select c.repo, c.author, c.ts, c.hash, coalesce(sum(f.added + f.deleted), 0) n from c left join f using (hash) group by all), z as (select *, row_number() over (partition by repo, author order by ts, hash) k from z0),
 v as (select hash, repo, author, k, n, case when n > 5000 then 'large_commit' else 'accepted' end verdict, case when n > 5000 then null else ts end last_ from z where k = 1
  union all select z.hash, z.repo, z.author, z.k, z.n, case when z.n > 5000 then 'large_commit' when z.n > 1000 and v.last_ is not null and z.ts - v.last_ < 600 then 'rapid_large_commit' else 'accepted' end,
   case when z.n > 5000 or (z.n > 1000 and v.last_ is not null and z.ts - v.last_ < 600) then v.last_ else z.ts end from v join z on z.repo is not distinct from v.repo and z.author is not distinct from v.author and z.k = v.k + 1),
 vt as (select repo, count(*) filter (verdict = 'large_commit') large_commits, count(*) filter (verdict = 'rapid_large_commit') rapid_large_commits, count(*) filter (verdict <> 'accepted') unrealistic_total, sum(n) skipped_lines from v group by repo)"""
SQL["a19_unrealistic_commits"] = f"{BASE}{_VERDICTS} select * from vt"


def _marks(table: dict[str, object], ext: str, part: int | None = None) -> str:
    return f"map {{{', '.join(f'{_q(k)}: {_q(v if part is None else v[part])}' for k, v in table.items())}}}[{ext}]"


# comment lines: a fold over the lines, the state being their number and the end mark awaited
_SRC = ", ".join(f"{_marks(t, 'ext', i)} {n}" for t, names in ((rules.BLOCK_COMMENT, ("ba", "bb")), (rules.OTHER_BLOCK, ("oa", "ob")), (rules.DOC_COMMENT, ("da", "db"))) for i, n in enumerate(names))
_HAS = lambda m: f"coalesce(contains({_strip('x.l')}, {m}), false)"
_OPEN = lambda a, b: f"case when contains(substr({_strip('x.l')}, instr({_strip('x.l')}, {a}) + length({a})), {b}) then null else {b} end"
_LINES = rf""",
 y0 as (select *, case when filename like '%.%' then lower(string_split(filename, '.')[-1]) else '' end ext, {_language('filename')} as lang, regexp_matches(filename, {_q(rules.test_pattern)}) tst, regexp_matches(filename, {_q(rules.doc_pattern)}) doc from f),
 y1 as (select *, {_marks(rules.LINE_COMMENT, 'ext')} lm, {_SRC} from y0),
 y2 as (select * exclude (src), case when coalesce(src, '') = '' then [] else string_split(src, chr(10)) end ls from y1),
 y3 as (select *, len(ls) n_lines, case when ext = '' or len(ls) = 0 then 0 else list_reduce([{{'n': 0, 'e': null::varchar, 'l': l}} for l in ls], lambda st, x: {{
   'n': st.n + (st.e is not null or {_HAS('da')} or {_HAS('ba')} or {_HAS('oa')} or coalesce(starts_with({_strip('x.l')}, lm), false))::int,
   'e': case when st.e is not null then case when st.e <> '' and contains(x.l, st.e) then null else st.e end when {_HAS('da')} then db when {_HAS('ba')} then {_OPEN('ba', 'bb')} when {_HAS('oa')} then {_OPEN('oa', 'ob')} end,
   'l': '' }}, {{'n': 0, 'e': null::varchar, 'l': ''}}).n end n_comment from y2)"""
_TESTDOC = """select repo, count(distinct filename) total_files, count(distinct filename) filter (tst) test_files, count(distinct filename) filter (doc) doc_files, sum(n_lines) total_lines, sum(case when tst then n_lines else 0 end) test_lines, sum(case when doc then n_lines else n_comment end) doc_lines from {0} group by repo"""
_PCTS = """*, case when total_lines > 0 then test_lines / total_lines * 100 else 0 end test_percent, case when total_lines > 0 then doc_lines / total_lines * 100 else 0 end doc_percent"""
SQL["a16_test_doc_pct"] = f"{BASE}{_LINES}, td as (select {_PCTS} from ({_TESTDOC.format('y3')})) select *, (test_percent + doc_percent) / 2 quality_score from td"
_B = _line("l", "lang")
SQL["a18_meaningful_code"] = f"""{BASE}{_LINES}{_VERDICTS},
 ok as (select y3.* from y3 join v using (hash) where verdict = 'accepted'), td as (select {_PCTS} from ({_TESTDOC.format('ok')})),
 ml as (select repo, lang, unnest([{_strip('x')} for x in ls]) l from ok where not (tst or doc)),
 mm as (select repo, count(*) filter (not {_B['long']} and not {_B['repeat']} and not {_B['few']} and not {_B['syntax']}) meaningful_lines, count(*) filter ({_B['long']}) long_sequences, count(*) filter (not {_B['long']} and {_B['repeat']}) repeated_chars,
   count(*) filter (not {_B['long']} and not {_B['repeat']} and {_B['few']}) repetitive_patterns from ml where l <> '' group by repo),
 aa as (select vt.*, coalesce(total_files, 0) files, coalesce(total_lines, 0) total_lines, coalesce(meaningful_lines, 0) meaningful_lines, coalesce(long_sequences, 0) long_sequences, coalesce(repeated_chars, 0) repeated_chars, coalesce(repetitive_patterns, 0) repetitive_patterns,
   coalesce((test_percent + doc_percent) / 2, 0) quality_score from vt left join td using (repo) left join mm using (repo))
 select *, case when total_lines > 0 then meaningful_lines / total_lines * 100 else 0 end meaningful_percent, long_sequences + repeated_chars + repetitive_patterns auto_generated_total,
   case when total_lines > 0 then (long_sequences + repeated_chars + repetitive_patterns) / total_lines * 100 else 0 end auto_generated_percent from aa"""
# moved lines: the removed places of a text in turn, each taking the first free added place of another file
SQL["a15_code_movement"] = f"""{BASE}{_RENAMES},
 m0 as (select repo, hash, path, file_idx, [{_strip('x')} for x in {_TXT.format('deleted')} if length({_strip('x')}) > 5] r, [{_strip('x')} for x in {_TXT.format('added')} if length({_strip('x')}) > 5] a from p where kind <> 'RENAME' and dp is not null),
 mt as (select repo, sum(len(r) + len(a)) changed_lines from m0 group by repo),
 m1 as (select repo, hash, path, min(file_idx) fst, max_by(r, file_idx) r, max_by(a, file_idx) a from m0 group by all),
 m2 as (select repo, hash, fst, 0 side, generate_subscripts(r, 1) i, unnest(r) t from m1 union all select repo, hash, fst, 1, generate_subscripts(a, 1), unnest(a) from m1),
 m3 as (select repo, hash, t, coalesce(list(fst order by fst, i) filter (side = 0), []) r, coalesce(list(fst order by fst, i) filter (side = 1), []) a from m2 group by all),
 m4 as (select repo, case when len(r) = 0 or len(a) = 0 then 0 else list_reduce([{{'n': 0, 'free': a, 'x': q}} for q in r], lambda st, y: case when len(list_filter(st.free, lambda z: z <> y.x)) = 0 then {{'n': st.n, 'free': st.free, 'x': y.x}}
   else {{'n': st.n + 1, 'free': [st.free[k] for k in range(1, len(st.free) + 1) if k <> [j for j in range(1, len(st.free) + 1) if st.free[j] <> y.x][1]], 'x': y.x}} end, {{'n': 0, 'free': a, 'x': -1}}).n end moved, case when len(r) = 0 and len(a) > 1 then len(a) - 1 else 0 end copied from m3),
 m5 as (select repo, sum(moved) moved_lines, sum(copied) copied_lines from m4 group by repo)
 select *, case when changed_lines > 0 then moved_lines / changed_lines * 100 else 0 end moved_percent, case when changed_lines > 0 then copied_lines / changed_lines * 100 else 0 end copied_percent
 from (select repo, coalesce(moved_lines, 0) moved_lines, coalesce(copied_lines, 0) copied_lines, changed_lines from mt left join m5 using (repo))"""
# Weekly metrics: the same queries over commits and changes whose ``repo`` is the repository and the analysis week, so nothing is carried from one week into another.
_SEP = "chr(31)"
_CUT = BASE.index("f as (select")
_WEEK_BASE = f"""{BASE[:_CUT].replace('c as (select hash', 'c_ as (select hash')}sp as (select repo, min(author_local) a, max(author_local) z from c_ group by repo),
 c as (select c_.* replace (repo || {_SEP} || 'Week_' || (floor(epoch(author_local - a) / 604800)::int + 1) || '_' || strftime(a + to_days(floor(epoch(author_local - a) / 604800)::int * 7), '%Y-%m-%d') as repo)
  from c_ join sp using (repo) where epoch(author_local - a) - floor(epoch(author_local - a) / 604800) * 604800 <= 518400 and a + to_days(floor(epoch(author_local - a) / 604800)::int * 7) < z),
 {BASE[_CUT:]}"""
# for what is computed per developer: the developer within the week
_DEV_BASE = _WEEK_BASE.replace(f", lower({_STRIP.format('author.email')}) dev,", f", lower({_STRIP.format('author.email')}) dev_,").replace(
    "c as (select c_.* replace (", "cw as (select c_.* replace ("
).replace(f" {BASE[_CUT:]}", f" c as (select * exclude (dev_), repo || {_SEP} || dev_ as dev from cw),\n {BASE[_CUT:]}")


def _weekly(sql: str, base: str = "") -> str:
    return f"select split_part(repo, {_SEP}, 1) repo, split_part(repo, {_SEP}, 2) week_label, * exclude (repo) from ({sql.replace(BASE, base or _WEEK_BASE)})"


def _weekly_dev(sql: str) -> str:
    return f"select split_part(dev, {_SEP}, 1) repo, split_part(dev, {_SEP}, 2) week_label, split_part(dev, {_SEP}, 3) dev, * exclude (dev) from ({sql.replace(BASE, _DEV_BASE)} )"


_OVERALL = {
    "change_set": "a1_change_set", "commits_count": "a2_commits_count", "contributors": "a3_a4_contributors", "hunks_count": "a5_hunks_count", "lines_count": "a6_lines_count", "code_churn": "a7_code_churn", "true_churn": "a8_true_churn",
    "bugs": "a14_bugs", "code_movement": "a15_code_movement", "test_doc_pct": "a16_test_doc_pct", "meaningful_code": "a18_meaningful_code",
}
SQL |= {f"weekly_{k}": _weekly(SQL[v]) for k, v in _OVERALL.items()}
SQL["weekly_diff_delta"] = _weekly(_velocity("w").replace("select dev,", "select repo, dev,").replace("group by dev, week", "group by repo, dev, week").replace("on x.dev is", "on x.repo = y.repo and x.dev is"))
SQL["weekly_code_provenance"] = _weekly(SQL["a22_code_provenance"].replace("pv as (select dev,", "pv as (select repo, dev,"))
SQL["weekly_code_domain"] = _weekly(SQL["a28_code_domain_weekly"].replace("g as (select dev,", "g as (select repo, dev,").replace("partition by dev, week", "partition by repo, dev, week"))
SQL["weekly_developer_hours"] = _weekly_dev(SQL["a27_developer_hours"])
_PARTS = ["a29_basic_stats", "a30_a34_intervals", "a31_work_sessions", "a32_daily_patterns", "a33_weekly_patterns", "a35_rhythm", "a36_sustained"]
SQL["weekly_time_analysis"] = "select split_part(dev, chr(31), 1) repo, split_part(dev, chr(31), 2) week_label, split_part(dev, chr(31), 3) dev, * exclude (dev) from " + " left join ".join(
    f"({SQL[p].replace(BASE, _DEV_BASE)})" + (" using (dev)" if i else "") for i, p in enumerate(_PARTS)
)
# developer summaries
SQL["a38_developer_summary"] = f"""with tr as ({SQL['a39_a41_trends']}), bs as ({SQL['a29_basic_stats']}), su as ({SQL['a36_sustained']}), se as ({SQL['a31_work_sessions']}), dm as ({SQL['a28_code_domain']}), iv as ({SQL['a30_a34_intervals']}), wp as ({SQL['a33_weekly_patterns']}), rh as ({SQL['a35_rhythm']}), pk as ({SQL['a32_daily_patterns']}), ho as ({SQL['a27_developer_totals']}), vl as ({SQL['a21_velocity']}),
 d as (select dev from tr union select dev from bs union select dev from dm where dev is not null union select dev from ho where dev is not null union select dev from vl where dev is not null),
 mn as (select dev, max_by(domain, struct_pack(l := lines, d := domain)) main_domain, '{{' || string_agg('"' || domain || '":' || round_even(percent, 2)::varchar, ',' order by domain) || '}}' ds from dm where dev is not null group by dev)
 select d.dev, coalesce(tr.weeks, 0) as weeks, coalesce(tr.total_diff_delta, 0) total_diff_delta, coalesce(velocity_trend, 0) velocity_trend, coalesce(consistency, 0) consistency, coalesce(activity_rate, 0) activity_rate, coalesce(avg_weekly_velocity, 0) avg_weekly_velocity, coalesce(avg_weekly_hours, 0) avg_weekly_hours,
  coalesce(vl.commits, 0) total_commits, coalesce(ho.total_estimated_hours, 0) total_estimated_hours, coalesce(total_repos, 0) total_repos, coalesce(total_span_days, 0) total_span_days, coalesce(commits_per_day, 0) commits_per_day, coalesce(total_lines_changed, 0) total_lines_changed, coalesce(total_files_changed, 0) total_files_changed,
  coalesce(avg_hours, 0) avg_session_hours, coalesce(avg_hours, 0) * 60 avg_session_minutes, coalesce(avg_commits, 0) avg_commits_per_session, coalesce(session_count, 0) session_count, coalesce(max_consecutive_days, 0) max_consecutive_days, coalesce(total_active_days, 0) total_active_days, coalesce(avg_per_active_day, 0) avg_per_active_day,
  coalesce(short_breaks, 0) short_breaks, coalesce(long_breaks, 0) long_breaks, coalesce(mean_hours, 0) * 60 mean_interval_minutes, coalesce(median_hours, 0) * 60 median_interval_minutes, coalesce(max_days, 0) max_gap_days, coalesce(peak_day, 0) peak_day, coalesce(peak_day_count, 0) peak_day_count, coalesce(total_weeks, 0) weeks_active,
  coalesce(avg_per_week, 0) avg_commits_per_week, coalesce(activities_per_day, 0) activities_per_day, coalesce(consistency_score, 0) session_consistency, coalesce(main_domain, 'unknown') main_domain
 from d left join tr using (dev) left join bs using (dev) left join su using (dev) left join se using (dev) left join mn using (dev) left join iv using (dev) left join wp using (dev) left join rh using (dev) left join pk using (dev) left join ho using (dev) left join vl using (dev)"""


# Merged parts: the queries over two parts of the repositories, each merged by hand here.
_PART_BASE = BASE.replace("project_name repo,", "(length(project_name) % 2)::varchar repo,")
_PART_DEV = _PART_BASE.replace(f", lower({_STRIP.format('author.email')}) dev,", f", repo || {_SEP} || lower({_STRIP.format('author.email')}) dev,")


def _in_parts(name: str, dev: bool = False) -> str:
    sql = SQL[name]
    if dev:
        return f"select split_part(dev, {_SEP}, 1) repo, split_part(dev, {_SEP}, 2) dev, * exclude (dev) from ({sql.replace(BASE, _PART_DEV)})"
    return sql.replace(BASE, _PART_BASE)


_SUM = lambda *cols: ", ".join(f"sum({c}) {c}" for c in cols)
_SHARE = lambda a, b, n: f"case when sum({b}) > 0 then sum({a}) / sum({b}) * 100 else 0 end {n}"
_LAST = lambda *cols: ", ".join(f"max_by({c}, repo) filter ({c} is not null) {c}" for c in cols)
_LC = ["added", "removed", "noop_added", "noop_removed"]
SQL |= {
    "m_change_set": f"select max(max_files) max_files, avg(avg_files) avg_files from ({_in_parts('a1_change_set')})",
    "m_commits_count": f"select path, {_SUM('modifications')} from ({_in_parts('a2_commits_count')}) group by path",
    "m_contributors_count": f"select path, max(total) total, sum(minor) minor from ({_in_parts('a3_a4_contributors')}) group by path",
    "m_contributors_experience": f"select path, max(experience) experience from ({_in_parts('a3_a4_contributors')}) group by path",
    "m_hunks_count": f"select path, sum(median_hunks) median_hunks from ({_in_parts('a5_hunks_count')}) group by path",
    "m_lines_count": f"select path, {', '.join(f'sum({k}_total) {k}_total, max({k}_max) {k}_max, avg({k}_avg) {k}_avg' for k in _LC)} from ({_in_parts('a6_lines_count')}) group by path",
    "m_code_churn": f"select sum(total_count) total_count, max(total_max) total_max, round_even(avg(total_avg), 0) total_avg, sum(net_count) net_count, max(net_max) net_max, round_even(avg(net_avg), 0) + 0 net_avg, sum(added) added, sum(removed) removed from ({_in_parts('a7_code_churn')})",
    "m_true_churn": f"select author, {_SUM('contribution', 'churn')} from ({_in_parts('a8_true_churn_by_author')}) group by author",
    "m_bugs": f"select path, avg(bug_percent) bug_percent, {_SUM('bug_lines', 'lines')}, {_SHARE('bug_lines', 'lines', 'overall_percent')} from ({_in_parts('a14_bugs')}) group by path",
    "m_code_movement": f"select {_SUM('moved_lines', 'copied_lines', 'changed_lines')}, {_SHARE('moved_lines', 'changed_lines', 'moved_percent')}, {_SHARE('copied_lines', 'changed_lines', 'copied_percent')} from ({_in_parts('a15_code_movement')})",
    "m_test_doc_pct": f"""select *, (test_percent + doc_percent) / 2 quality_score from (select {_SUM('total_files', 'test_files', 'doc_files', 'total_lines', 'test_lines', 'doc_lines')}, {_SHARE('test_lines', 'total_lines', 'test_percent')}, {_SHARE('doc_lines', 'total_lines', 'doc_percent')} from ({_in_parts('a16_test_doc_pct')}))""",
    "m_meaningful_code": f"""select {_SUM('total_lines', 'meaningful_lines', 'files', 'long_sequences', 'repeated_chars', 'repetitive_patterns', 'auto_generated_total', 'large_commits', 'rapid_large_commits', 'unrealistic_total', 'skipped_lines')},
 {_SHARE('meaningful_lines', 'total_lines', 'meaningful_percent')}, {_SHARE('auto_generated_total', 'total_lines', 'auto_generated_percent')}, 0.0::double quality_score from ({_in_parts('a18_meaningful_code')})""",
    "m_diff_delta": f"""select dev, week, {_SUM('diff_delta', 'commits', 'active_days', 'files_changed', 'lines_added', 'lines_deleted', 'lines_updated', 'lines_moved')}, sum(diff_delta) / greatest(1, sum(active_days)) velocity_per_day
 from ({_velocity("w").replace("select dev,", "select repo, dev,").replace("group by dev, week", "group by repo, dev, week").replace("on x.dev is", "on x.repo = y.repo and x.dev is").replace(BASE, _PART_BASE)}) group by dev, week""",
    "m_code_provenance": f"""select dev, week, {_SUM('new_lines', 'recent_lines', 'old_lines', 'legacy_lines', 'total_lines')}, {', '.join(_SHARE(f'{k}_lines', 'total_lines', f'{k}_percent') for k in ('new', 'recent', 'old', 'legacy'))}
 from ({SQL['a22_code_provenance'].replace("pv as (select dev,", "pv as (select repo, dev,").replace(BASE, _PART_BASE)}) group by dev, week""",
    "m_developer_hours": f"select dev, week, {_SUM('estimated_hours', 'sessions', 'commits')}, 0.0::double hours_per_day from ({_in_parts('a27_developer_hours', True)}) group by dev, week",
    "m_code_domain": f"select dev, domain, {_SUM('lines')} from ({SQL['a28_code_domain_weekly'].replace('g as (select dev,', 'g as (select repo, dev,').replace(BASE, _PART_BASE)}) group by dev, domain",
    "m_time_analysis": f"""with t as (select split_part(dev, {_SEP}, 1) repo, split_part(dev, {_SEP}, 2) dev, * exclude (dev) from """ + " left join ".join(f"({SQL[p].replace(BASE, _PART_DEV)})" + (" using (dev)" if i else "") for i, p in enumerate(_PARTS)) + f"""),
 g as (select dev, {_SUM('total_commits', 'total_lines_changed', 'total_files_changed', 'session_count', 'total_weeks', 'total_active_days', 'short_breaks', 'long_breaks', *(f'day_{k}' for k in range(7)))}, min(first_ts) first_ts, max(last_ts) last_ts, max(max_hours) max_hours, max(max_commits) max_commits,
   {_LAST('total_repos', 'mean_hours', 'median_hours', 'min_minutes', 'max_days', 'avg_hours', 'avg_commits', 'avg_per_week', 'max_per_week', 'min_per_week', 'avg_break_hours', 'max_consecutive_days', 'avg_per_active_day')} from t group by dev),
 h as (select *, round_even((last_ts - first_ts) / 86400, 2) total_span_days, greatest({', '.join(f'day_{k}' for k in range(7))}) peak_day_count from g)
 select *, round_even(total_commits / greatest(1, total_span_days), 3) commits_per_day, case {' '.join(f'when day_{k} = peak_day_count then {k}' for k in range(7))} end peak_day, round_even(total_commits / greatest(1, total_span_days), 3) activities_per_day, round_even(session_count / greatest(1, total_span_days), 3) consistency_score from h""",
}
_WM = {
    "change_set": ("productivity", "max(max_files)::double max_files, avg(avg_files) avg_files"), "code_churn": ("quality", "sum(total_count)::double total_count, max(total_max)::double total_max, round_even(avg(total_avg), 0) total_avg, sum(net_count)::double net_count, max(net_max)::double net_max, round_even(avg(net_avg), 0) + 0 net_avg, sum(added)::double added, sum(removed)::double removed"),
    "code_movement": ("quality", f"sum(moved_lines)::double moved_lines, sum(copied_lines)::double copied_lines, sum(changed_lines)::double changed_lines, {_SHARE('moved_lines', 'changed_lines', 'moved_percent')}, {_SHARE('copied_lines', 'changed_lines', 'copied_percent')}"),
    "test_doc_pct": ("quality", ", ".join(f"sum({c})::double {c}" for c in ("total_files", "test_files", "doc_files", "total_lines", "test_lines", "doc_lines")) + f", {_SHARE('test_lines', 'total_lines', 'test_percent')}, {_SHARE('doc_lines', 'total_lines', 'doc_percent')}, ({_SHARE('test_lines', 'total_lines', '')} + {_SHARE('doc_lines', 'total_lines', '')}) / 2 quality_score"),
}
SQL["m17_weekly_merge"] = " union all ".join(f"select week_label, '{cat}' category, '{k}' metric, figure, value from (unpivot (select week_label, {cols} from ({SQL['weekly_' + k]}) group by week_label) on columns(* exclude (week_label)) into name figure value value)" for k, (cat, cols) in _WM.items())
SQL["a45_combined_weeks"] = f"""{BASE}{_WEEKS}, s as (select week_label, max(n_files)::double m from c join wk using (hash) group by all), l as (select week_label, count(*)::double n, sum(added)::double a, sum(deleted)::double r, max(added)::double x from f join wk using (hash) group by all)
 select week_label, 'files_max' metric, m as value from s union all select week_label, 'files_count', n from l union all select week_label, 'added_total', a from l union all select week_label, 'removed_total', r from l union all select week_label, 'added_max', x from l"""


def _exact(sql: str) -> str:
    """round_even with digits, spelt out: the built-in macro misjudges ties of doubles that are not exact."""
    while (m := re.search(r"round_even\((?!.*round_even\().*?$", sql, re.S)) and (end := _close(sql, m.start() + 10)):
        arg, digits = sql[m.start() + 11 : end].rsplit(",", 1)
        v, ten = f"round(({arg}) * {10 ** int(digits)}, 7)", 10 ** int(digits)
        sql = sql[: m.start()] + f"(case when {v} - floor({v}) = 0.5 then 2 * round({v} / 2) else round({v}) end / {ten}.0::double)" + sql[end + 1 :]
    return sql


def _close(text: str, at: int) -> int:
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if depth == 0:
            return i
    return 0


SQL = {name: _exact(sql) for name, sql in SQL.items()}
