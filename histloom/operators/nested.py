"""Deeply nested JSON to related flat tables, by path, ordinal and value triples."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIPLES = "record string, path string, at array<int>, value string, kind string, carried string"
COLUMNS = ["record", "path", "at", "value", "kind", "carried"]
BATCH = 4_000_000  # characters and ordinals of paths sent on at once
DECODER = json.JSONDecoder()
BLANK = re.compile(r"[ \t\n\r]*")
MARK = "﻿"


class Every(dict):
    """Stands for a tree of names in which every name is wanted."""

    def get(self, name, default=None):
        return self


def tree(*paths: str) -> dict:
    """Nested names of dotted paths; arrays do not count in them."""
    out: dict = {}
    for p in paths:
        at = out
        for name in p.split("."):
            at = at.setdefault(name, {})
    return out


class Reader:
    """Reads one JSON text from left to right and keeps triples of the members wanted.

    Containers that are wanted are walked member by member, with a stack of its own, so depth is not bounded. Values that are not wanted are
    passed over by the scanner, one at a time, and dropped: what is held is the triples wanted and one value.
    """

    def __init__(self, embedded: frozenset[str], carry_from: dict | None, carry: str | None):
        self.embedded, self.carry_from, self.carry = embedded, carry_from, carry

    def read(self, text: str, wanted: dict) -> list[list]:
        """[path, at, value, kind, carried] of each node wanted, depth first and in order. ValueError if the text is not complete JSON."""
        out: list[list] = []
        self._value(text, wanted, "$", [], None, out)
        return [t for t in out if t is not None]

    def _value(self, text: str, node: dict | None, path: str, at: list[int], name: str | None, out: list) -> None:
        past = lambda i: BLANK.match(text, i).end()
        # frames: is object, node, path, at, name, next ordinal or members met, where its triples begin, its value to carry
        stack: list[list] = []
        i = past(0)
        while True:
            c = text[i : i + 1]
            whole = False
            if c and c in "{[" and node is not None:
                out.append([path, at, None, "object" if c == "{" else "array", None])
                whole = True
            elif c and c in "{[":  # not wanted
                try:
                    _, i = DECODER.raw_decode(text, i)
                except RecursionError:
                    whole = True
            else:
                value, i = DECODER.raw_decode(text, i)
                if node is not None:
                    self._scalar(value, node, path, at, name, out)
                    if stack and stack[-1][0] and stack[-1][1] is self.carry_from and name == self.carry and value is not None:
                        stack[-1][7] = value if isinstance(value, str) else json.dumps(value)
            if whole:
                i = past(i + 1)
                stack.append([c == "{", node, path, at, name, {} if c == "{" else 0, len(out) - 1 if node is not None else len(out), None])
                if text[i : i + 1] != ("}" if c == "{" else "]"):
                    i, node, path, at, name = self._enter(text, i, stack[-1], out, past)
                    continue
                i = past(i + 1)
                self._close(stack.pop(), out)
            while True:  # a value has ended
                i = past(i)
                if not stack:
                    if i < len(text):
                        raise ValueError("extra text")
                    return
                top = stack[-1]
                c = text[i : i + 1]
                if c == ",":
                    i, node, path, at, name = self._enter(text, past(i + 1), top, out, past)
                    break
                if c != ("}" if top[0] else "]"):
                    raise ValueError("comma or end expected")
                i += 1
                self._close(stack.pop(), out)

    def _enter(self, text: str, i: int, top: list, out: list, past) -> tuple:
        """Where the next value of a container begins, and what it is: node, path, at and name."""
        if not top[0]:
            k = top[5]
            top[5] += 1
            if top[1] is None:
                return i, None, "", [], None
            return i, top[1].get("[]", top[1]), top[2] + "[]", [*top[3], k], top[4]
        if text[i : i + 1] != '"':
            raise ValueError("name expected")
        key, i = DECODER.raw_decode(text, i)
        i = past(i)
        if text[i : i + 1] != ":":
            raise ValueError("colon expected")
        node = None if top[1] is None else top[1].get(key)
        if node is not None:
            if key in top[5]:  # of a repeated name the last counts
                for k in range(top[5][key], len(out)):
                    if out[k] is not None and (out[k][0] == f"{top[2]}.{key}" or out[k][0].startswith((f"{top[2]}.{key}.", f"{top[2]}.{key}["))):
                        out[k] = None
            top[5][key] = len(out)
        return past(i + 1), node, f"{top[2]}.{key}", top[3], key

    def _close(self, frame: list, out: list) -> None:
        if frame[0] and frame[1] is not None and frame[1] is self.carry_from:
            for t in out[frame[6] :]:
                if t is not None:
                    t[4] = frame[7]

    def _scalar(self, value, node: dict, path: str, at: list[int], name: str | None, out: list) -> None:
        if isinstance(value, str) and name in self.embedded and value.lstrip()[:1] in ("[", "{"):
            n = len(out)
            try:
                return self._value(value, node, path, at, name, out)
            except ValueError:
                del out[n:]
        if value is None:
            out.append([path, at, None, "null", None])
        else:
            out.append([path, at, value if isinstance(value, str) else json.dumps(value), type(value).__name__, None])


def triples(records: DataFrame, record: Column, payload: Column, embedded: Sequence[str] = (), wanted: dict | None = None, carry_from: dict | None = None, carry: str | None = None) -> DataFrame:
    """Nodes of every payload as (record, path, at, value, kind, carried).

    path: names joined by dots from ``$``, ``[]`` after an array; at: the ordinals of the arrays passed, outermost
    first, so (record, path, at) identifies a node. Containers have a row with a null value. Members named
    in ``embedded`` that hold JSON as text are read as if nested. wanted: a ``tree`` of the members to keep with all that leads to them, everything by
    default (an entry ``[]`` stands for an array's elements where these differ from it); what is not wanted is passed over and never leaves the parser.
    carried: within each object of the tree's node ``carry_from``, the value of its member ``carry``. Of a repeated name the last counts. A payload that is null, empty, cut off or
    otherwise not complete JSON gives no rows; a leading byte order mark is skipped. A text is read as a stream, and rows leave when it has proved complete.
    """
    names, everything = frozenset(embedded), wanted is None

    def parse(batches):
        keep, reader = Every() if everything else wanted, Reader(names, carry_from, carry)
        for b in batches:
            out, size = [], 0
            for rec, text in zip(b["record"], b["payload"]):
                try:
                    found = reader.read((text or "").lstrip(MARK), keep)
                except ValueError:
                    continue
                for t in found:
                    out.append((rec, *t))
                    size += len(t[0]) + len(t[1])  # with depth, every path is longer
                    if len(out) > 20000 or size > BATCH:
                        yield pd.DataFrame(out, columns=COLUMNS)
                        out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=COLUMNS)

    rows = records.select(record.cast("string").alias("record"), payload.alias("payload")).filter("payload is not null")
    return rows.mapInPandas(parse, TRIPLES)


def table_of(shredded: DataFrame, ancestors: str, fields: dict[str, str], depth: int) -> DataFrame:
    """One flat table: a row for each node that ``ancestors`` (an anchored regex over paths) names.

    Paths are grouped by the ancestor they repeat under: the row key is (record, ancestor path, first ``depth``
    ordinals). fields: column to relative path below the ancestor; each becomes a string column, null where the
    member is missing. The ordinals stay as ``at``, which is the link to the parent table (whose ``at`` is a prefix).
    """
    anc = F.regexp_extract("path", f"^({ancestors})(?:\\.|$)", 1)
    rest = F.expr("substring(path, length(anc) + 2)")
    rows = shredded.withColumn("anc", anc).filter("anc <> ''").withColumn("rest", rest)
    rows = rows.filter(F.col("rest").isin("", *fields.values()))
    return rows.groupBy("record", "anc", F.slice("at", 1, depth).alias("at") if depth else F.array().cast("array<int>").alias("at")).agg(
        F.max(F.when(F.col("rest") == "", F.col("kind"))).alias("kind"), *[F.max(F.when(F.col("rest") == p, F.col("value"))).alias(c) for c, p in fields.items()]
    )


COMMITS = r"\$(?:\[\]|(?:\.run\.result|)\.commits(?:\[\])?)"


_LINES = ("added_lines", "deleted_lines")
_FILE = ("filename", "new_path", "old_path", "change_type", "change_type_name", *_LINES)
_HEAD = {"project_name": "project_name", "ecosystem": "ecosystem", "metrics_type": "metrics_type", "start_date": "analysis_period.start_date", "end_date": "analysis_period.end_date", "full_history": "analysis_period.full_history"}
LISTS = ("commits", "modified_files", "items", "methods", "methods_before", "changed_methods")


def history_tables(records: DataFrame, record: Column, payload: Column) -> dict[str, DataFrame]:
    """records, commits, files and methods of analysis files that were delivered as JSON text.

    Layouts read: the analysis object itself, one wrapped in ``run.result``, or a bare array of commits; a
    list that holds one entry may stand as that entry alone, files may be wrapped in ``items``, and any list
    may be JSON text. Linked by (record, hash, file_pos, method_pos); positions count from 0 in the order given.
    A file entry that is no object gives no row; commits without hash keep a null hash and are linked by ``commit_at``.
    Each table reads the payloads once, for its own members; the commit's hash comes with them, so nothing is joined.
    """

    def read(of_commit: dict) -> DataFrame:
        """Triples of the members of a commit, which may stand in any of the layouts."""
        return triples(records, record, payload, LISTS, {"commits": of_commit, "run": {"result": {"commits": of_commit}}, "[]": of_commit}, of_commit, "hash")

    head = tree(*_HEAD.values())
    tables = {}
    tables["records"] = table_of(triples(records, record, payload, (), head | {"run": {"result": head}}), r"\$(?:\.run\.result)?", _HEAD, 0).groupBy("record").agg(*[F.max(c).alias(c) for c in _HEAD])

    def level(t: DataFrame, suffix: str, fields: dict[str, str]) -> DataFrame:
        path = f"{COMMITS}{suffix}"
        rows = t.withColumn("anc", F.regexp_extract("path", f"^({path})(?:\\.|$)", 1)).filter("anc <> ''")
        rows = rows.withColumn("rest", F.expr("substring(path, length(anc) + 2)")).filter(F.col("rest").isin("", *fields.values()))
        depth = F.size(F.split("anc", r"\[\]")) - 1
        before = F.size(F.split(F.regexp_extract("path", f"^{COMMITS}", 0), r"\[\]")) - 1
        return rows.groupBy("record", "anc", F.slice("at", F.lit(1), depth).alias("at"), before.alias("n_before")).agg(
            F.max("carried").alias("hash_of"), F.max(F.when(F.col("rest") == "", F.col("kind"))).alias("kind"), *[F.max(F.when(F.col("rest") == p, F.col("value"))).alias(c) for c, p in fields.items()]
        ).filter("kind = 'object'")

    at0 = F.slice("at", F.lit(1), F.col("n_before")).alias("commit_at")
    hash_of = F.col("hash_of").alias("hash")
    of_commit = {"msg": "msg", "author_name": "author.name", "author_email": "author.email"}
    tables["commits"] = level(read(tree("hash", *of_commit.values())), "", of_commit).select("record", at0, hash_of, *of_commit)
    pos = lambda k: F.coalesce(F.try_element_at("at", F.col("n_before") + k), F.lit(0))
    wrapped = "(?:\\.items)?"
    of_file = [f"modified_files{w}.{c}" for w in ("", ".items") for c in _FILE]
    files = level(read(tree("hash", *of_file)), rf"\.modified_files{wrapped}(?:\[\])?", {c: c for c in _FILE})
    # a wrapper object stands under the same pattern; it has none of a file's own members
    files = files.filter(~(F.col("anc").endswith("modified_files") & F.coalesce(*_FILE).isNull()))
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    tables["files"] = files.select(
        "record", at0, hash_of, pos(1).alias("file_pos"), F.coalesce(given("filename"), F.element_at(F.split(F.coalesce(given("new_path"), given("old_path")), "/"), -1)).alias("filename"),
        "new_path", "old_path", F.coalesce(given("change_type_name"), F.regexp_extract("change_type", r"\.(.*)$", 1)).alias("change_type_name"), *[F.col(c).cast("long").alias(c) for c in _LINES],
    )
    file_list = F.regexp_extract("anc", r"modified_files(?:\.items)?(\[\])?", 1) != ""
    of_method = ["name", "start_line", "end_line"]
    methods = level(read(tree("hash", *[f"modified_files{w}.methods.{c}" for w in ("", ".items") for c in of_method])), rf"\.modified_files{wrapped}(?:\[\])?\.methods(?:\[\])?", {c: c for c in of_method})
    skip = F.when(file_list, 2).otherwise(1)
    tables["methods"] = methods.select(
        "record", at0, hash_of, F.when(file_list, pos(1)).otherwise(0).alias("file_pos"), F.coalesce(F.try_element_at("at", F.col("n_before") + skip), F.lit(0)).alias("method_pos"), "name",
        F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"),
    )
    return tables
