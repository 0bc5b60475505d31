"""What the fixed lists give for known inputs; the SQL of the queries shares those lists and would share their errors."""

import pytest
from pyspark.sql import functions as F

from histloom.functions import rules

LANGUAGES = [
    ("x.cls", "apex"), ("a.h", "c"), ("a.HPP", "cpp"), ("a.c++", "cpp"), ("q.cs", "csharp"), ("v.cshtml", "cshtml"), ("s.sass", "scss"), ("k.cljs", "clojurescript"), ("k.edn", "clojure"), ("v.html.erb", "erb"), ("n.hrl", "erlang"), ("n.lhs", "haskell"),
    ("p.pro", "idl"), ("m.cjs", "javascript"), ("m.jsx", "jsx"), ("c.jsonc", "json"), ("r.mkd", "markdown"), ("o.mli", "ocaml"), ("o.mm", "objc"), ("p.inc", "pascal"), ("p.php4", "php"), ("p.pm", "perl"), ("p.pyi", "python"), ("r.Rmd", "r"), ("r.rbw", "ruby"),
    ("s.sc", "scala"), ("s.tcsh", "shell"), ("s.psql", "sql"), ("t.tsx", "tsx"), ("v.vba", "vb"), ("x.xsd", "xml"), ("y.yml", "yaml"), ("Makefile", "unknown"), ("a.zzz", "unknown"),
]
SYNTAX = [
    ("let", "elm", 1), ("where", "elm", 1), ("in", "elm", 1), ("  let  ", "haskell", 1), ("let", "rust", 0), ("End If", "vb", 1), ("end select", "vb", 1), ("endif", "vb", 0), ("end if", "idl", 0), ("begin", "pascal", 1), ("default:", "java", 0), ("default", "java", 0),
    ("else:", "c", 1), ("finally;", "cpp", 0), ("foreach", "csharp", 1), ("foreach", "java", 0), ("elif", "python", 0), ("continue", "python", 1), ("esac", "shell", 1), ("fi;", "shell", 1), ("recur", "clojure", 1), ("} catch {", "markdown", 1), ("<br>", "unknown", 1),
    ("<a b>", "xml", 1), ("<a b>", "java", 0), ("}", "yaml", 1), ("{", "scss", 1), (");", "perl", 1), ("done", "ocaml", 1), ("do", "scala", 1), ("defer", "go", 1), ("}}", "go", 0),
]
COMMENTS = [
    ("a.lua", "--[[ a\nb\n]]\n-- c\nx", 4), ("a.ps1", "<# a\nb #>\n# c\nx", 3), ("a.nim", "#[ a\nb ]#\nx", 2), ("a.ocaml", "(* a\nb *)\nx", 2), ("a.hs", "{- a\nb -}\n-- c\nx", 3), ("a.coffee", "###\na\n###\nx", 3), ("a.vb", "' c\nx", 1), ("a.bat", "REM c\nx", 1),
    ("a.tex", "% c\nx", 1), ("a.f90", "! c\nx", 1), ("a.tsx", "<!-- a\nb -->\n// c", 3), ("a.kt", "/** d\n*/\nx", 2), ("a.cs", "/// d\nx\ny", 3), ("a.r", "#' d\nx", 2), ("a.jsonx", "// c", 0),
]
MESSAGES = [("fixed bug", 1), ("Fixes for issue", 1), ("resolving problem", 1), ("closes #12", 1), ("Bug 7", 1), ("patched it", 1), ("a defect", 1), ("debug output", 1), ("fixed typo", 0), ("dispatch", 1), ("add feature", 0)]
SKIPPED = [("web/yarn.lock", 1), ("a/build/x.js", 1), ("a.min.js", 1), ("x.generated.go", 1), ("logo.svg", 1), ("about/x.py", 1), ("outside.py", 0), ("layout/x.py", 1), ("src/a.py", 0)]


@pytest.mark.parametrize("rule", ["language", "syntax", "comments", "messages", "skipped"])
def test_fixed_lists(spark, rule):
    cases, f = {
        "language": (LANGUAGES, lambda: rules.language(F.col("_1"))), "syntax": (SYNTAX, lambda: rules.only_syntax(F.col("_1"), F.col("_2")).cast("int")), "comments": (COMMENTS, lambda: rules.comment_lines(F.col("_1"), F.col("_2"))),
        "messages": (MESSAGES, lambda: rules.bug_fix(F.col("_1")).cast("int")), "skipped": (SKIPPED, lambda: rules.skipped_file(F.col("_1")).cast("int")),
    }[rule]
    df = spark.createDataFrame(cases)
    got = df.select("*", f().alias("got")).collect()
    assert [r for r in got if r[-2] != r[-1]] == []


def test_a_meaningful_line_is_judged_without_its_indent(spark):
    long_indent = " " * 200 + "x = 1"
    df = spark.createDataFrame([(long_indent,), ("a1" * 12,), ("=====",), ("x" * 19 + " y",)], "l string")
    assert [r[0] for r in df.select(rules.meaningful_line(F.col("l"), F.lit("python"))).collect()] == [True, False, False, True]
