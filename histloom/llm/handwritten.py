"""Which file changes belong to files that nobody on the project wrote by hand.

Each file's text is lexed by the rules of its language family into comments, strings, numbers, words and punctuation; it is then re-emitted in a
canonical layout (one statement to a line, indented by depth), and the original layout is compared with it:

* minified: canonical layout needs many times the lines, and the original lines are long;
* generated: nearly all lines have one and the same token shape;
* data: literals (numbers, base-64 and hex text, not prose) dominate.

What a layout cannot tell is read from the file itself: tool headers in comments, licence banners of other projects, file
names that tools always write, and folders that hold copies. ``layout`` says what the layout alone shows, ``reason`` what all of it does. Evidence counts
for the file, so a change whose own lines show nothing is named when another change of that file in the project does.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom.tables import Scratch

# Names that package managers, bundlers and generators give, folders of copied code.
LOCK_NAMES = "package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml composer.lock poetry.lock pipfile.lock gemfile.lock cargo.lock go.sum mix.lock podfile.lock flake.lock uv.lock bun.lockb packages.lock.json".split()
COPY_FOLDERS = "node_modules bower_components jspm_packages vendor vendored third_party third-party thirdparty 3rdparty external externals deps godeps site-packages dist-packages carthage pods".split()
MINIFIED_NAME = r"[.-](?:min|bundle|packed|chunk)\.(?:m?js|css)$|\.[0-9a-f]{8,}\.(?:m?js|css)$"
GENERATED_NAME = r"\.(?:js|css|m?js|ts)\.map$|\.lock$|[._](?:pb|pb2|pb2_grpc|grpc\.pb)\.[a-z]+$|\.g\.[a-z]+$|\.g\.i\.[a-z]+$|\.designer\.[a-z]+$|\.generated\.[a-z]+$|(?:^|/)(?:lextab|parsetab|y_tab|y\.tab)\.[a-z]+$|_(?:pb2|pb)\.[a-z]+$|(?:grpc|_stub|_skel|outerclass)\.(?:java|kt|cs|scala)$"
HEADER = re.compile(
    r"(?im)^[ +-]?\s*(?://+|#+|/\*+!?|\*+|--+|<!--|;+|%+|\"\"\")\s*(?:<auto-?generated|@generated\b|(?:this )?(?:file|code|class)?\s*(?:is|was|has been)?\s*(?:automatically |auto-?)?generated (?:by|from|with|file|code)\b|please adjust! commands auto|do not edit this file\b|.*\bgenerated by\b.*\bdo not edit\b|autogenerated\b|machine[- ](?:made|generated|written) by\b|(?:created|produced|emitted|compiled|built|output) by the .*\b(?:compiler|generator|tool|translator|transpiler)\b)"
)
BANNER = re.compile(r"(?im)^[ +-]?\s*(?://+|#+|/?\*+!?)?\s*(?:\(c\)|©|copyright(?: \(c\))?)\s+\d{4}(?:-\d{4})?,? .{0,80}\b(?:licen[sc]ed?|all rights reserved)\b")
IDIOM = re.compile(r"\bthis\.[gs]etField\(\d+\b|\bswitch \(\w+\.label\) \{ case \d+: return \[\d|__awaiter\(this, void 0|__extends\(|\bproto\.jspb\b|\$jscomp\b")
PROGRAM = set("py js jsx mjs cjs ts tsx java go c h cc cpp hpp cs rb rs php swift kt scala lua pl r m".split())
STYLE = {"css", "scss", "less"}
# Lexical rules of language families: what opens a comment to the end of the line, and what encloses one.
FAMILIES = {
    "c": (r"//[^\n]*", r"/\*(?s:.*?)(?:\*/|\Z)"), "hash": (r"\#[^\n]*", r"(?!)"), "style": (r"(?!)", r"/\*(?s:.*?)(?:\*/|\Z)"), "lua": (r"--[^\n]*", r"--\[\[(?s:.*?)(?:\]\]|\Z)"), "percent": (r"%[^\n]*", r"(?!)"), "php": (r"(?://|\#)[^\n]*", r"/\*(?s:.*?)(?:\*/|\Z)"),
    "text": (r"(?!)", r"(?!)"),
}
FAMILY_OF = {
    **dict.fromkeys("js jsx mjs cjs ts tsx java go c h cc cpp hpp cs rs swift kt scala".split(), "c"), **dict.fromkeys("py rb pl r".split(), "hash"), **dict.fromkeys(STYLE, "style"), "lua": "lua", "m": "percent", "php": "php",
}
LEXERS = {
    name: re.compile(
        rf"(?P<comment>{block}|{line})"
        r"""|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')"""
        r"|(?P<number>(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)[fFlLuU]*(?!\w))"
        r"|(?P<word>[A-Za-z_$][\w$]*)|(?P<line>\n)|(?P<blank>[^\S\n]+)|(?P<mark>(?s:.))"
    )
    for name, (line, block) in FAMILIES.items()
}
DENSE = re.compile(r"[A-Za-z0-9+/=\\]{32,}")
DIGEST = re.compile(r"\b(?:sha\d+[-:=]|h1:)?[A-Za-z0-9+/_-]{40,}={0,2}")
LISTED = re.compile(r"(['\"0])(?:,\1)+")
PLAIN = ("", "}", "{", "};", "end", "a")


def new_side(diff: str) -> list[str]:
    """The lines that the diff leaves in the file; of a deletion, the deleted ones. Blank lines are left out."""
    kept, gone = [], []
    for line in diff.split("\n"):
        if line[:1] in ("+", " ") and not line.startswith("+++ "):
            kept.append(line[1:])
        elif line[:1] == "-" and not line.startswith("--- "):
            gone.append(line[1:])
    has = [x for x in kept if x.strip()]
    added = any(x[:1] == "+" for x in diff.split("\n"))
    return has if has and added else [x for x in gone if x.strip()] or has


def lex(text: str, ext: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of each token, by the rules of the ending's language family; together they are the text."""
    for m in LEXERS[FAMILY_OF.get(ext, "text")].finditer(text):
        yield m.lastgroup or "", m.group()


def canonical(tokens: Iterable[tuple[str, str]], depth_of: str = "    ") -> list[str]:
    """The text re-emitted with one statement to a line, indented by its depth, and single blanks where there were any."""
    out, line, depth, within, gap = [], [], 0, 0, False

    def end():
        nonlocal line, gap
        if line:
            out.append(depth_of * max(0, depth - (line[0] == "}")) + "".join(line))
        line, gap = [], False

    for kind, t in tokens:
        if kind == "line":
            end()
        elif kind == "blank":
            gap = bool(line)
        else:
            if t == "function" and line[-1:] == [","] or t == "var" and line[-1:] == [","]:
                end()
            line += [" ", t] if gap else [t]
            gap = False
            if kind == "mark":
                within = max(0, within + (t in "([") - (t in ")]"))
                if t in ";{}" and not (t == ";" and within):
                    end()
                    depth = max(0, depth + (t == "{") - (t == "}"))
    end()
    return out


def layout(lines: list[str], ext: str = "") -> dict[str, float]:
    """expansion, line_length, uniformity, shape_tokens, literal share and characters, and lines with digests, of the text's layout."""
    text = "\n".join(lines)
    if not text:
        return {"expansion": 1.0, "line_length": 0.0, "uniformity": 0.0, "shape_tokens": 0, "literals": 0.0, "literal_chars": 0, "digests": 0.0, "digest_lines": 0}
    tokens = list(lex(text, ext))
    dense = numbers = 0
    shapes, shape = [], []
    for kind, t in tokens:
        if kind == "line":
            shapes.append("".join(shape))
            shape = []
        elif kind == "string":
            shape.append('"')
            if len(t) >= 34 and DENSE.fullmatch(t, 1, len(t) - 1):
                dense += len(t)
        elif kind == "number":
            shape.append("0")
            numbers += len(t)
        elif kind == "word":
            shape.append("a")
        elif kind == "mark":
            shape.append(t)
        elif kind == "comment":  # its lines have the shape of its words
            head, *more = re.sub(r"[A-Za-z_$][\w$]*", "a", re.sub(r"[^\S\n]", "", t)).split("\n")
            for x in (head, *more)[:-1]:
                shapes.append("".join([*shape, x]))
                shape = []
            shape.append((head, *more)[-1])
    shapes = [LISTED.sub(r"\1", x) for x in [*shapes, "".join(shape)]]
    shapes = [x for x in shapes if x not in PLAIN]
    top, count = Counter(shapes).most_common(1)[0] if shapes else ("", 0)
    digests = sum(bool(DIGEST.search(x)) for x in lines)
    solid = len(text) - text.count(" ") - text.count("\n") - text.count("\t")
    return {
        "expansion": len(canonical(tokens)) / len(lines), "line_length": len(text) / len(lines), "uniformity": count / len(shapes) if shapes else 0.0,
        "shape_tokens": len(top) if count > 1 else 0, "literals": (dense + numbers) / max(1, solid), "literal_chars": dense + numbers, "digests": digests / len(lines), "digest_lines": digests,
    }


def by_layout(path: str, diff: str) -> str | None:
    """What the layout of a change's text shows: 'minified', 'generated', 'data' or None."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    lines = new_side(diff)
    if not lines:
        return None
    f = layout(lines, ext)
    if ext not in PROGRAM and ext not in STYLE:
        # lists of checksums, as lock files are
        return "data" if f["digest_lines"] >= 3 and f["digests"] >= 0.2 and "PRIVATE KEY" not in diff and "PUBLIC KEY" not in diff else None
    if f["line_length"] >= 160 and f["expansion"] >= 6:
        return "minified"
    if ext in STYLE:
        return None
    if f["literals"] >= 0.5 and f["literal_chars"] >= 100:
        return "data"
    if f["uniformity"] >= 0.85 and (f["shape_tokens"] >= 24 and len(lines) >= 4 or f["shape_tokens"] >= 16 and len(lines) >= 6):
        return "generated"
    return None


def by_text(path: str, diff: str) -> str | None:
    """What the text says of itself: a tool's header, another project's banner, a generator's idioms in most lines."""
    if HEADER.search(diff):
        return "generated"
    if BANNER.search(diff):
        return "vendored"
    ext = path.rsplit(".", 1)[-1].lower()
    lines = new_side(diff) if ext in PROGRAM and IDIOM.search(diff) else []
    return "generated" if lines and len(IDIOM.findall("\n".join(lines))) >= 0.5 * len(lines) else None


def evidence(path: str, diff: str) -> str | None:
    """Why the text of a change shows that its file is not hand-written, or None."""
    return by_text(path, diff) or by_layout(path, diff)


def named(path: Column) -> Column:
    """What the path alone says: 'generated', 'minified', 'vendored' or null."""
    p = F.lower(path)
    name = F.element_at(F.split(p, "/"), -1)
    folders = "|".join(re.escape(x) for x in COPY_FOLDERS)
    return (
        F.when(name.isin(LOCK_NAMES) | p.rlike(GENERATED_NAME), "generated").when(p.rlike(MINIFIED_NAME), "minified").when(p.rlike(f"(^|/)({folders})/"), "vendored")
    )


def classify(changes: DataFrame, project: Column, new_path: Column, old_path: Column, filename: Column, diff: Column, keys: list[str]) -> DataFrame:
    """``keys``, ``reason`` and ``layout`` of every change whose file is generated, minified, vendored or data.

    reason: by its path, its text or its layout; layout: what the layout of the file's changes shows, null if nothing. changes: a row per file change; rows that
    repeat are merged. A file is a path in a project; a renamed file is both its paths,
    and a change without paths is taken by its name. Null or empty diffs are judged by path and by the file's other changes.
    A null project is a project of its own. Every text is lexed, whole, one diff in memory at a time; the only shuffle carries
    the paths that have evidence of their own.
    """
    base = changes.select(*keys, project.alias("_project"), F.coalesce(new_path, old_path, filename).alias("_path"), old_path.alias("_old"), F.coalesce(diff, F.lit("")).alias("_diff"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.select(*keys, "_project", "_path", "_old").schema) + ", _why string, _layout string"

    def read(batches):
        for b in batches:
            pairs = list(zip(b["_path"], b["_diff"]))
            b["_why"] = pd.Series([by_text(p or "", d) if d else None for p, d in pairs], dtype=object, index=b.index)
            b["_layout"] = pd.Series([by_layout(p or "", d) if d else None for p, d in pairs], dtype=object, index=b.index)
            yield b.drop(columns="_diff")

    judged = base.mapInPandas(read, schema).withColumn("reason", F.coalesce(named(F.col("_path")), "_why", "_layout"))
    # kept, as both sides of the join below read it: the texts are lexed once
    scratch = Scratch(changes.sparkSession, "handwritten")
    judged = scratch.save(judged.withColumn("_files", F.array_distinct(F.array_compact(F.array("_path", "_old")))).drop("_path", "_old", "_why"))
    known = judged.filter("reason is not null").select(F.coalesce("_project", F.lit("")).alias("p"), F.explode("_files").alias("f"), F.col("reason").alias("r"), F.col("_layout").alias("l")).groupBy("p", "f").agg(F.min("r").alias("r"), F.min("l").alias("l"))
    own = judged.select(*keys, F.coalesce("_project", F.lit("")).alias("p"), F.explode_outer("_files").alias("f"), "reason", F.col("_layout").alias("layout"))
    found = own.join(known, ["p", "f"], "left").withColumns({"reason": F.coalesce("reason", "r"), "layout": F.coalesce("layout", "l")})
    return found.filter("reason is not null").groupBy(*keys).agg(F.min("reason").alias("reason"), F.min("layout").alias("layout"))
