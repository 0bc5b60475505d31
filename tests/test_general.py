import json
import random

import pytest
from pyspark.sql import functions as F

from histloom.functions.text import clean_email, instant
from histloom.operators import nested
from histloom.operators.hotkeys import eager_join_sum, key_statistics
from histloom.operators.nested import history_tables, triples
from histloom.operators.sessions import sessions


def brute_sessions(rows, gap):
    out, by = set(), {}
    for k, t in rows:
        if k is not None and t is not None:
            by.setdefault(k, []).append(t)
    for k, ts in by.items():
        ts.sort()
        start = last = ts[0]
        n = 1
        for t in ts[1:]:
            if t - last > gap:
                out.add((k, start, last, last - start, n))
                start, n = t, 0
            last, n = t, n + 1
        out.add((k, start, last, last - start, n))
    return out


def test_sessions_against_brute_force(spark):
    rng = random.Random(5)
    for gap in (1, 7, 100):
        rows = [(rng.choice(["a", "a", "a", "b", None, ""]), rng.choice([None, *range(-300, 300)])) for _ in range(300)]
        df = spark.createDataFrame(rows, "cell string, root long").withColumn("key", F.lit("clash"))
        got = {tuple(r) for r in sessions(df, F.col("cell"), F.col("root"), gap).collect()}
        got = {(k, a, b, d, n) for k, a, b, d, n in got}
        assert got == brute_sessions(rows, gap)


def test_sessions_edges(spark):
    df = spark.createDataFrame([("a", 0), ("a", 7200), ("a", 14401), ("a", 14401)], "k string, t long")
    got = sorted(tuple(r)[1:] for r in sessions(df, F.col("k"), F.col("t"), 7200).collect())
    assert got == [(0, 7200, 7200, 2), (14401, 14401, 0, 2)]
    assert sessions(df.limit(0), F.col("k"), F.col("t"), 5).count() == 0
    ids = df.withColumn("id", F.lit(1))
    assert sessions(ids, F.col("k"), F.col("t"), 7200, F.col("id")).agg(F.sum("events")).first()[0] == 3


def test_instant(spark):
    rows = [
        ("2020-01-01 00:00:00+02:00", None, 1577829600), ("2020-01-01T00:00:00Z", 9, 1577836800), ("2020-01-01 00:00:00 -0330", None, 1577849400),
        ("2020-01-01 00:00:00", -7200, 1577829600), ("2020-01-01 00:00:00", None, 1577836800), (" 2020-01-01 00:00 ", 0, 1577836800),
        ("", None, None), (None, 5, None), ("yesterday", None, None), ("2020-13-45 00:00:00", None, None),
    ]
    df = spark.createDataFrame(rows, "s string, z int, want long")
    assert [r for r in df.select("s", "want", instant(F.col("s"), F.col("z")).alias("got")).collect() if r.want != r.got] == []
    assert spark.createDataFrame([("\t A@B.c\n",), ("  ",), (None,)], "e string").select(clean_email(F.col("e"))).collect() == [("a@b.c",), (None,), (None,)]


def test_eager_join_sum(spark):
    rng = random.Random(1)
    a = [(rng.choice([1, 1, 1, 2, None]), rng.choice("xy"), rng.choice([None, 3, 4])) for _ in range(60)]
    b = [(rng.choice([1, 1, 2, 3, None]), rng.choice([None, 10, 20])) for _ in range(50)]
    left, right = spark.createDataFrame(a, "j int, g string, v long"), spark.createDataFrame(b, "j int, v long")
    got = {r["g"]: (r["rows"], r["w"], r["v"]) for r in eager_join_sum(left.withColumnRenamed("v", "w"), right, ["j"], ["g"], ["w"], ["v"]).collect()}
    want = {}
    for j, g, w in a:
        for k, v in b:
            if j is not None and j == k:
                n, x, y = want.get(g, (0, 0, 0))
                want[g] = (n + 1, x + (w or 0), y + (v or 0))
    assert got == want
    assert eager_join_sum(left.limit(0), right.withColumnRenamed("v", "z"), ["j"], ["g"]).count() == 0


def test_key_statistics(spark):
    rows = [("h1", "a", 5, ["f", "g", None]), ("h1", "a", 5, ["f", "g"]), ("h2", "a", None, None), ("h3", None, 1, []), ("h4", "b", 2, ["f"]), (None, "b", 9, ["q"])]
    df = spark.createDataFrame(rows, "hash string, e string, lines long, total array<string>")
    got = {tuple(r) for r in key_statistics(df, {"e": F.col("e")}, F.col("hash"), F.col("lines"), F.col("total")).collect()}
    assert got == {("e", "a", 2, 5, 2, 0.5), ("e", "b", 1, 2, 1, 0.25)}
    assert key_statistics(df.limit(0), {"e": F.col("e")}, F.col("hash"), F.col("lines"), F.col("total")).count() == 0


FILE = {"filename": "a.py", "new_path": "x/a.py", "old_path": None, "change_type": "M.ADD", "methods": [{"name": "f", "start_line": 1, "end_line": 2}, {"name": "g"}]}


def test_history_tables(spark):
    commit = {"hash": "h", "msg": "[1, 2]", "author": {"name": "n", "email": None}, "modified_files": [FILE, {"old_path": "p/q/b.c", "filename": None, "change_type": "M.X", "change_type_name": "DELETE"}]}
    as_text = dict(commit, hash="t", modified_files=json.dumps(commit["modified_files"]))
    wrapped = dict(commit, hash="w", modified_files={"count": 1, "items": [FILE]})
    single = dict(commit, hash="s", modified_files=FILE)
    none = dict(commit, hash="z", modified_files=None)
    docs = [json.dumps({"commits": [commit, as_text], "project_name": "p", "extra": [[1], [[2]]]}), "﻿" + json.dumps([wrapped, single, none]), json.dumps({"run": {"result": {"commits": commit}}}),
            json.dumps([commit])[:-3], "", None, "[]", "3", '"x"']
    df = spark.createDataFrame([(i, d, "x") for i, d in enumerate(docs)], "record int, payload string, path string")
    t = {k: sorted(map(tuple, v.collect()), key=str) for k, v in history_tables(df, F.col("record"), F.col("payload")).items()}
    files = sorted((r[0], r[2], r[3], r[4], r[7]) for r in t["files"])
    two = [(0, "a.py", "ADD"), (1, "b.c", "DELETE")]
    want = [("0", h, *x) for h in ("h", "t") for x in two] + [("1", "s", 0, "a.py", "ADD"), ("1", "w", 0, "a.py", "ADD")] + [("2", "h", *x) for x in two]
    assert files == sorted(want)
    assert len(t["commits"]) == 6 and ("0", [0], "h", "[1, 2]", "n", None) in t["commits"]
    assert sorted(r[3:6] for r in t["methods"] if r[0] == "1") == [(0, 0, "f"), (0, 0, "f"), (0, 1, "g"), (0, 1, "g")]
    assert triples(df.limit(0), F.col("record"), F.col("payload")).count() == 0


def test_sessions_count_one_delivery(spark):
    df = spark.createDataFrame([("a", 5, "e", 2), ("a", 5, "e", 7), ("a", 6, "f", 1)], "k string, t long, id string, n long")
    assert [tuple(r)[1:] for r in sessions(df, F.col("k"), F.col("t"), 10, F.col("id"), sums={"n": F.col("n")}).collect()] == [(5, 6, 1, 2, 8)]


def test_deep_payloads(spark):
    whole = lambda n: '{"commits": [{"hash": "h", "x": ' + '{"a":[' * n + "1" + "]}" * n + "}]}"
    inner = '{"commits": ' + json.dumps('[{"hash": "i", "x": ' + "[" * 12_000 + "]" * 12_000 + "}]") + "}"
    with pytest.raises(RecursionError):
        json.loads(whole(6_000))
    rows = [("deep", whole(6_000)), ("cut", whole(6_000)[:-1]), ("text", inner)]
    df = spark.createDataFrame(rows, "r string, p string")
    got = {(r["record"], r["hash"]) for r in history_tables(df, F.col("r"), F.col("p"))["commits"].collect()}
    assert got == {("deep", "h"), ("text", "i")}


def shredded(node, path="$", at=()):
    kind = "object" if isinstance(node, dict) else "array" if isinstance(node, list) else "null" if node is None else type(node).__name__
    yield path, list(at), None if kind in ("object", "array", "null") else node if isinstance(node, str) else json.dumps(node), kind
    for k, v in node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ():
        yield from shredded(v, f"{path}.{k}" if isinstance(node, dict) else path + "[]", at if isinstance(node, dict) else (*at, k))


def test_the_stream_is_read_as_json_is():
    rng, parts = random.Random(2), list('{}[]:,"') + ['"a"', '"a":', "1", "-2.5e3", "null", "true", "NaN", " ", "\n", '"\\u00e9\\""', "x", "\u00a0"]
    texts = ['{"a": [1, {"b": "c\\n", "b": []}, {}], "d": null}', " [ ] ", "", "1 2", "[1,]", '{"a":1,}', '{"a" 1}', '{"a": {"x": 1}, "ab": 2, "a": {"y": 3}}'] + ["".join(rng.choices(parts, k=rng.randint(1, 7))) for _ in range(20_000)]
    reader, whole, few = nested.Reader(frozenset(), None, None), nested.Every(), nested.tree("a.b", "d")

    def read(f, x):
        try:
            return sorted(map(repr, f(x)))
        except ValueError:
            return None

    want = [read(lambda x: shredded(json.loads(x)), x) for x in texts]
    assert [x for x, y in zip(texts, want) if read(lambda x: [tuple(t[:4]) for t in reader.read(x, whole)], x) != y] == [] and sum(y is not None for y in want) > 500
    # what is not wanted is passed over, but must be well-formed
    assert [x for x, y in zip(texts, want) if (read(lambda x: reader.read(x, few), x) is None) != (y is None)] == []
    assert [t[0] for t in reader.read(texts[0], few)] == ["$", "$.a", "$.a[]", "$.a[]", "$.a[].b", "$.a[]", "$.d"]
