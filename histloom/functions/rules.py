"""Classifiers of paths, messages and lines as native column expressions.

Every pattern is simple enough for Java regular expressions and RE2 alike, so a rule can be checked by SQL with the same pattern.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------

IGNORED = [
    r"soljson-v\d+\.\d+\.\d+\+commit\.[a-f0-9]+\.js", r"\.min\.js$", r"bundle\.js$", r"vendor\.js$", r"\.map$", r"\.wasm$", r"\.zip$", r"\.gz$", r"\.tar$", r"\.svg$",
    r"\.ttf$", r"\.woff2?$", r"\.eot$", r"\.png$", r"\.jpe?g$", r"\.gif$", r"\.ico$", r"\.pdf$", r"\.mp[34]$", r"\.wav$", r"\.avi$", r"\.mov$", r"\.flv$", r"\.swf$",
    r"\.doc[x]?$", r"\.xls[x]?$", r"\.ppt[x]?$", r"\.bin$", r"\.dat$", r"\.o$", r"\.so$", r"\.dll$", r"\.exe$", r"\.pyc$", r"__pycache__", r"node_modules", r"vendor/",
    r"dist/", r"build/", r"\.git/", r"\.7z$",
]
BUG_PATTERNS = [
    r"fix(?:e[ds])?(?:\s+for)?\s+(?:bug|issue|problem)", r"bug\s+fix(?:e[ds])?", r"resolv(?:e[ds]?|ing)\s+(?:bug|issue|problem)", r"\#\d+", r"bug\s+\#?\d+",
    r"fix(?:e[ds])?\s+\#\d+", r"patch(?:e[ds])?", r"defect", r"debug",
]
TEST_FILES = [
    r"test_.*\.[a-zA-Z]+$", r".*_test\.[a-zA-Z]+$", r".*Tests?\.[a-zA-Z]+$", r".*Spec\.[a-zA-Z]+$", r".*\.spec\.[a-zA-Z]+$", r".*\.test\.[a-zA-Z]+$", r"tests?/.*", r"spec/.*",
    r"__tests__/.*", r"__test__/.*", r"testing/.*", r".*_spec\.[a-zA-Z]+$", r".*-test\.[a-zA-Z]+$", r".*-spec\.[a-zA-Z]+$", r"test[A-Z].*\.[a-zA-Z]+$", r"Test[A-Z].*\.[a-zA-Z]+$",
]
DOC_ENDINGS = "md rst txt adoc asciidoc wiki rdoc pod dox javadoc jsdoc apidoc man pdf epub tex doc docx".split()
DOC_STARTS = "README CHANGELOG CONTRIBUTING LICENSE INSTALL USAGE FAQ HOWTO MANUAL TUTORIAL GUIDE DOC".split()
DOC_FOLDERS = ["docs?", "documentation", "man", "wikis?", "site", "api-docs?", "api"]
SKIPPED = [
    r"package-lock\.json$", r"yarn\.lock$", r"Gemfile\.lock$", r"poetry\.lock$", r"Pipfile\.lock$", r"\.min\.", r"\.map$", r"\.generated\.", r"\.auto\.", "dist/", "build/", "target/",
    "out/", "vendor/", "node_modules/", r"\.vscode/", r"\.idea/", r"\.iml$", r"\.DS_Store$", r"\.git/", r"\.svg$", r"\.png$", r"\.jpg$", r"\.jpeg$", r"\.gif$", r"\.ico$",
    r"\.woff2?$", r"\.ttf$", r"\.eot$", r"\.pdf$", r"\.zip$", r"\.tar\.gz$",
]
CODE_ENDINGS = "py js java cpp c cs rb go rs kt swift m scala php ts tsx jsx vue dart r jl ex exs".split()
TRIVIAL = r"\.json$|\.xml$|\.yaml$|\.yml$|\.lock$|\.md$|\.txt$|package-lock\.json|yarn\.lock|composer\.lock|Pipfile\.lock|[gG][eE][nN][eE][rR][aA][tT][eE][dD]|dist/|build/"
DELTA_COMMENTS = ["#", "//", r"/\*", r"\*", "<!--", "--", '"""', "'''"]
DELTA_IMPORTS = [r"import\s+", r"from\s+.*\s+import", r'#include\s*[<"]', r"using\s+.*;", r"require\s*\(", r"include\s+", r"use\s+", r"package\s+", r"extern crate\s+"]

# Domains in order of precedence: endings, whole names, folders, patterns. A later domain's entry that an earlier one decides is left out.
DOMAINS: list[tuple[str, str, str, str, list[str]]] = [
    ("frontend", "js jsx ts tsx mjs cjs html htm xhtml css scss sass less styl vue svelte astro hbs handlebars mustache ejs pug jade map",
     "webpack.config.js vite.config.js .babelrc", "frontend/ client/ web/ www/ public/ static/ assets/ src/components/ components/ views/ pages/ layouts/ styles/ css/ scss/ sass/", []),
    ("backend", "py pyw pyx pxd pxi java scala kt kts groovy gradle cs vb fs fsx fsi go rb rake gemspec php php3 php4 php5 phtml rs c cpp cxx cc c++ h hpp hxx hh m mm pl pm perl lua ex exs erl hrl hs lhs clj cljs cljc edn ml mli cr nim nims zig",
     "", "backend/ server/ api/ service/ services/ controllers/ src/models/ models/ handlers/ middleware/ lib/ libs/ pkg/ packages/", []),
    ("database", "sql mysql psql sqlite db cql cypher sparql prisma dbml", "db.sqlite3", "migrations/ db/ database/ schema/ sql/ data/ fixtures/", []),
    ("test", "feature story", "pytest.ini tox.ini", "test/ tests/ __tests__/ spec/ specs/ testing/ e2e/ integration/ unit/ cypress/ playwright/ __mocks__/", []),
    ("docs", "md markdown rst txt adoc asciidoc org tex wiki mediawiki", "LICENSE AUTHORS COPYING", "docs/ doc/ documentation/ wiki/ guides/ manual/ help/", []),
    ("config", "json yaml yml toml ini cfg conf xml plist properties env envrc lock sum mod",
     "Pipfile .gitignore .gitattributes .editorconfig .prettierrc .eslintrc .stylelintrc Dockerfile Makefile .env .env.example", "config/ configs/ configuration/ .github/ .circleci/ .gitlab/ ci/ deploy/ deployment/", []),
    ("mobile", "swift dart xaml", "project.pbxproj", "ios/ android/ mobile/ app/ platforms/", []),
    ("devops", "sh bash zsh fish ps1 bat cmd tf tfvars hcl jenkinsfile", "Jenkinsfile Vagrantfile inventory", "scripts/ bin/ infrastructure/ terraform/ ansible/ k8s/ kubernetes/ helm/ charts/ docker/ .gitlab-ci/", []),
    ("data_science", "ipynb r R rmd Rmd jl", "", "notebooks/ analysis/ experiments/ research/ analytics/", []),
    ("machine_learning", "pkl pickle h5 pb onnx", "", "ml/ ai/ training/ inference/ pipelines/ features/", []),
    ("game_dev", "gd tres tscn", "project.godot Assembly-CSharp.csproj", "Assets/ Scripts/ Scenes/ Prefabs/ Content/ Source/ game/ engine/", []),
]

#: Language of each ending.
LANGUAGE_OF = {
    "apex": "apex", "cls": "apex", "trigger": "apex", "astro": "astro", "c": "c", "h": "c", "cpp": "cpp", "cxx": "cpp", "cc": "cpp", "c++": "cpp",
    "hpp": "cpp", "hxx": "cpp", "hh": "cpp", "h++": "cpp", "cs": "csharp", "csx": "csx", "cshtml": "cshtml", "css": "css", "scss": "scss",
    "sass": "scss", "clj": "clojure", "cljc": "clojure", "edn": "clojure", "cljs": "clojurescript", "dart": "dart", "elm": "elm", "erb": "erb",
    "erl": "erlang", "hrl": "erlang", "haml": "haml", "hs": "haskell", "lhs": "haskell", "go": "go", "idl": "idl", "pro": "idl", "java": "java",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "jelly": "jelly", "json": "json", "jsonc": "json", "md": "markdown",
    "markdown": "markdown", "mdown": "markdown", "mkd": "markdown", "mkdown": "markdown", "ml": "ocaml", "mli": "ocaml", "m": "objc", "mm": "objc",
    "pas": "pascal", "pp": "pascal", "inc": "pascal", "php": "php", "phtml": "php", "php3": "php", "php4": "php", "php5": "php", "pl": "perl",
    "pm": "perl", "perl": "perl", "py": "python", "pyw": "python", "pyi": "python", "r": "r", "rmd": "r", "rb": "ruby", "rbw": "ruby", "rs": "rust",
    "scala": "scala", "sc": "scala", "sh": "shell", "bash": "shell", "zsh": "shell", "fish": "shell", "ksh": "shell", "csh": "shell", "tcsh": "shell",
    "sql": "sql", "psql": "sql", "mysql": "sql", "swift": "swift", "ts": "typescript", "tsx": "tsx", "vb": "vb", "vbs": "vb", "vba": "vb",
    "vbhtml": "vbhtml", "xml": "xml", "xsl": "xml", "xslt": "xml", "xsd": "xml", "yaml": "yaml", "yml": "yaml",
}
#: Words that mean nothing on a line of their own, by language. A closing colon is cut from a line before it is compared.
KEYWORDS = {
    "apex": "else if for while switch return break continue catch finally try do".split(),
    "astro": "else if for while switch return break continue catch finally try".split(),
    "c": "else if for while switch return break continue do".split(),
    "clojure": "if when when-not cond case try catch finally do loop recur".split(),
    "clojurescript": "if when when-not cond case try catch finally do loop recur".split(),
    "cpp": "else if for while switch return break continue catch try do".split(),
    "csharp": "else if for while switch return break continue catch finally try foreach do".split(),
    "csx": "else if for while switch return break continue catch finally try foreach do".split(),
    "dart": "else if for while switch return break continue catch finally try do".split(),
    "elm": "if then else case of".split(),
    "erlang": "if case of try catch after end receive".split(),
    "go": "else if for switch return break continue select go defer".split(),
    "haskell": "if then else case of where let in do".split(),
    "idl": "if then else endif for endfor while endwhile case endcase switch endswitch".split(),
    "java": "else if for while switch return break continue catch finally try do".split(),
    "javascript": "else if for while switch return break continue catch finally try do".split(),
    "jsx": "else if for while switch return break continue catch finally try do".split(),
    "objc": "else if for while switch return break continue do".split(),
    "ocaml": "if then else match with try begin end for while do done".split(),
    "pascal": "if then else case of for to do while repeat until try except finally begin end".split(),
    "perl": "else elsif if unless for foreach while until return last next do".split(),
    "php": "else if for while switch return break continue catch finally try elseif foreach do".split(),
    "python": "pass return break continue".split(),
    "r": "if else for in while repeat next break return".split(),
    "ruby": "else elsif rescue ensure begin end if unless for while until case when return break next".split(),
    "rust": "else if for while loop match return break continue".split(),
    "scala": "else catch finally try if for while match case return do".split(),
    "shell": "if then else elif fi for do done while until case esac return break continue".split(),
    "sql": "if else end case when then begin return".split(),
    "swift": "else if for while switch return break continue catch try do".split(),
    "tsx": "else if for while switch return break continue catch finally try do".split(),
    "typescript": "else if for while switch return break continue catch finally try do".split(),
    "vb": ["end if", "end select", *"if then else elseif select case for next do loop while try catch finally return".split()],
}
#: What opens a comment line, by ending.
LINE_COMMENT = {
    "ada": "--", "adb": "--", "applescript": "--", "as": "//", "asm": ";", "asp": "'", "aspx": "'", "au3": ";", "bas": "'", "bat": "REM", "c": "//",
    "c++": "//", "cc": "//", "cfc": "//", "cfm": "//", "clj": ";", "cls": "%", "cmd": "REM", "coffee": "#", "cpp": "//", "cs": "//", "css": "//",
    "d": "//", "dart": "//", "elm": "--", "erl": "%", "ex": "#", "exs": "#", "f": "!", "f90": "!", "for": "!", "fs": "//", "fsi": "//", "fsx": "//",
    "go": "//", "groovy": "//", "h": "//", "hpp": "//", "hs": "--", "htm": "<!--", "html": "<!--", "hx": "//", "java": "//", "jl": "#", "js": "//",
    "jsx": "//", "kt": "//", "kts": "//", "less": "//", "lisp": ";", "lua": "--", "m": "%", "markdown": "<!--", "md": "<!--", "nim": "#", "nix": "#",
    "ocaml": "(*", "pas": "//", "php": "//", "pl": "#", "pm": "#", "ps1": "#", "psm1": "#", "py": "#", "pyw": "#", "r": "#", "rb": "#", "rs": "//",
    "s": ";", "sass": "//", "scala": "//", "scm": ";", "scss": "//", "sh": "#", "sql": "--", "swift": "//", "tcl": "#", "tex": "%", "ts": "//",
    "tsx": "//", "vb": "'", "vba": "'", "vbs": "'", "vhdl": "--", "xsl": "<!--", "yaml": "#", "yml": "#", "zig": "//",
}
#: What opens and closes a comment block, by ending.
BLOCK_COMMENT = {
    "c": ('/*', '*/'), "c++": ('/*', '*/'), "cc": ('/*', '*/'), "cpp": ('/*', '*/'), "cs": ('/*', '*/'), "css": ('/*', '*/'), "d": ('/*', '*/'),
    "dart": ('/*', '*/'), "go": ('/*', '*/'), "groovy": ('/*', '*/'), "h": ('/*', '*/'), "hpp": ('/*', '*/'), "htm": ('<!--', '-->'),
    "html": ('<!--', '-->'), "hx": ('/*', '*/'), "java": ('/*', '*/'), "js": ('/*', '*/'), "jsx": ('/*', '*/'), "kt": ('/*', '*/'),
    "kts": ('/*', '*/'), "less": ('/*', '*/'), "lua": ('--[[', ']]'), "markdown": ('<!--', '-->'), "md": ('<!--', '-->'), "nim": ('#[', ']#'),
    "ocaml": ('(*', '*)'), "php": ('/*', '*/'), "ps1": ('<#', '#>'), "psm1": ('<#', '#>'), "py": ('"""', '"""'), "rs": ('/*', '*/'),
    "sass": ('/*', '*/'), "scala": ('/*', '*/'), "scss": ('/*', '*/'), "sql": ('/*', '*/'), "swift": ('/*', '*/'), "ts": ('/*', '*/'),
    "tsx": ('<!--', '-->'), "xsl": ('<!--', '-->'),
}
#: Other comment blocks, by ending.
OTHER_BLOCK = {
    "clj": ('(comment', ')'), "coffee": ('###', '###'), "hs": ('{-', '-}'), "jl": ('#=', '=#'), "perl": ('=pod', '=cut'), "py": ("'''", "'''"),
    "r": ("'", "'"), "ruby": ('=begin', '=end'),
}
#: What opens and closes documentation, by ending; an empty end never closes.
DOC_COMMENT = {
    "c": ('/**', '*/'), "cc": ('/**', '*/'), "cpp": ('/**', '*/'), "cs": ('///', ''), "go": ('//', ''), "groovy": ('/**', '*/'), "h": ('/**', '*/'),
    "hpp": ('/**', '*/'), "java": ('/**', '*/'), "js": ('/**', '*/'), "jsx": ('/**', '*/'), "kt": ('/**', '*/'), "kts": ('/**', '*/'),
    "php": ('/**', '*/'), "py": ('"""', '"""'), "pyw": ('"""', '"""'), "r": ("#'", ''), "rs": ('///', ''), "scala": ('/**', '*/'),
    "swift": ('///', ''), "ts": ('/**', '*/'), "tsx": ('/**', '*/'),
}
BRACE_ONLY = r"(?i)^\s*[\{\}\(\)\[\]]\s*[;,]?\s*$|^\s*\}\s*(else|catch|finally)\s*\{\s*$|^\s*<\s*/?\s*[a-zA-Z][a-zA-Z0-9]*\s*>\s*$"


# ---- rules --------------------------------------------------------------------------------------

ANY = "|".join
ignored_pattern = f"({ANY(IGNORED)})"
bug_pattern = f"({ANY(BUG_PATTERNS)})"
test_pattern = f"^({ANY(TEST_FILES)})"
doc_pattern = rf"^(.*\.({ANY(DOC_ENDINGS)})$|.*\.html\..*$|({ANY(DOC_STARTS)}).*|({ANY(DOC_FOLDERS)})/.*)"
skip_pattern = f"({ANY(SKIPPED)})"
code_pattern = rf"\.({ANY(CODE_ENDINGS)})$"
delta_drop_pattern = rf"^\s*({ANY(DELTA_COMMENTS + DELTA_IMPORTS)})"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def kept_source(url: Column, patterns: list[str] | None = None) -> Column:
    """No ignore pattern occurs in the address (or path)."""
    return ~url.rlike(f"({ANY(patterns)})" if patterns else ignored_pattern)


def noop_line(line: Column) -> Column:
    return stripped(line) == ""


def bug_fix(msg: Column, patterns: list[str] | None = None, labels: Column | None = None) -> Column:
    hit = F.lower(msg).rlike(f"({ANY(patterns)})" if patterns else bug_pattern)
    return hit if labels is None else hit | F.coalesce(F.lower(labels).contains("bug"), F.lit(False))


def test_file(name: Column) -> Column:
    return name.rlike(test_pattern)


def doc_file(name: Column) -> Column:
    return name.rlike(doc_pattern)


def ending(name: Column) -> Column:
    """Lower-case text after the last dot; empty without a dot."""
    return F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")


def _of(table: dict, key: Column) -> Column:
    """The table's value of ``key``, or null; a pair becomes a struct of a and b."""
    value = lambda v: F.struct(F.lit(v[0]).alias("a"), F.lit(v[1]).alias("b")) if isinstance(v, tuple) else F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    return F.try_element_at(F.create_map(*[x for w, v in table.items() for x in (F.lit(w), value(v))]), key)


def language(name: Column) -> Column:
    return F.when(~name.contains("."), "unknown").otherwise(F.coalesce(_of(LANGUAGE_OF, ending(name)), F.lit("unknown")))


def auto_generated(line: Column) -> Column:
    """Which rule finds the line machine-made: long_sequences, repeated_chars, repetitive_patterns or null."""
    rest = stripped(F.regexp_replace(line, "[a-zA-Z0-9]{20,}", ""))
    letters = F.array_distinct(F.filter(F.split(F.replace(line, F.lit(" "), F.lit("")), ""), lambda x: x != ""))
    return (
        F.when(line.rlike("[a-zA-Z0-9]{20,}") & (F.length(rest) < F.length(stripped(line)) * 0.3), "long_sequences")
        .when(line.rlike("_{5,}|={5,}|-{5,}"), "repeated_chars")
        .when((F.length(line) > 200) & (F.size(letters) < 10), "repetitive_patterns")
    )


def only_syntax(line: Column, lang: Column) -> Column:
    """Nothing on the line but braces, one tag or one keyword."""
    word = F.lower(stripped(F.regexp_replace(line, "[:;]+$", "")))
    words = _of(KEYWORDS, lang)
    bare = stripped(line)
    return (
        line.rlike(BRACE_ONLY) | F.coalesce(F.array_contains(words, word), F.lit(False))
        | ((lang == "ruby") & (bare == "end")) | (lang.isin("haskell", "elm") & bare.isin("where", "let", "in")) | ((lang == "xml") & line.rlike(r"^\s*<[^>]*>\s*$")) | (lang.isin("yaml", "json") & bare.isin("{", "}", "[", "]", "-"))
    )


def meaningful_line(line: Column, lang: Column) -> Column:
    bare = stripped(line)
    return (bare != "") & auto_generated(bare).isNull() & ~only_syntax(bare, lang)


def delta_line(line: Column) -> Column:
    return (F.length(stripped(line)) > 1) & ~line.rlike(delta_drop_pattern)


def provenance_line(line: Column) -> Column:
    return (F.length(stripped(line)) > 1) & ~stripped(line).rlike(r"^(#|//|/\*|\*|<!--)")


def hours_line(line: Column) -> Column:
    return (F.length(stripped(line)) >= 3) & ~stripped(line).rlike(r"^(//|#|/\*|\*|import |from |using |require)")


def skipped_file(name: Column) -> Column:
    return name.rlike(skip_pattern)


def code_file(name: Column) -> Column:
    return name.rlike(code_pattern)


def trivial_file(name: Column) -> Column:
    return name.rlike(TRIVIAL)


def domain(path: Column) -> Column:
    """The first domain whose endings, names, folders or patterns fit; 'other' if none does."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    name = F.element_at(F.split(p, "/"), -1)
    # a leading dot starts a name, not an ending
    ext = F.regexp_extract(name, r"[^.].*\.([^.]*)$", 1)
    out = None
    for dom, exts, names, folders, patterns in DOMAINS:
        hit = ext.isin(exts.split()) | name.isin(names.split())
        for f in folders.split():
            hit = hit | p.contains(f)
        for rx in patterns:
            hit = hit | p.rlike(rx)
        out = F.when(hit, dom) if out is None else out.when(hit, dom)
    return out.otherwise("other")


def address_owner(url: Column) -> Column:
    """Fourth part of an address of the usual host, else null."""
    parts = F.split(url, "/")
    return F.when(url.contains("github.com") & (F.size(parts) >= 4), F.try_element_at(parts, F.lit(4)))


def address_name(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def safe_basename(path: Column) -> Column:
    return F.coalesce(F.element_at(F.split(path, "/"), -1), F.lit("Unknown file"))


def path_hash(path: Column) -> Column:
    return F.substring(F.md5(path), 1, 8)


def comment_lines(name: Column, source: Column) -> Column:
    """Number of comment lines: one fold over the lines, with the end mark awaited as its state."""
    ext = ending(name)
    line_mark, block, other, doc = (_of(t, ext) for t in (LINE_COMMENT, BLOCK_COMMENT, OTHER_BLOCK, DOC_COMMENT))

    def step(state: Column, line: Column) -> Column:
        s = stripped(line)
        has = lambda m: F.coalesce(s.contains(m["a"]), F.lit(False))
        rest = lambda m: s.substr(F.call_function("locate", m["a"], s) + F.length(m["a"]), F.length(s))
        ends_here = lambda m: rest(m).contains(m["b"])
        open_block = lambda m: F.when(ends_here(m), F.lit(None).cast("string")).otherwise(m["b"])
        inside = state["end"].isNotNull()
        # an empty end mark never closes
        still = F.when((state["end"] != "") & line.contains(state["end"]), F.lit(None).cast("string")).otherwise(state["end"])
        starts = F.when(has(doc), doc["b"]).when(has(block), open_block(block)).when(has(other), open_block(other))
        counts = inside | has(doc) | has(block) | has(other) | F.coalesce(s.startswith(line_mark), F.lit(False))
        return F.struct((state["n"] + counts.cast("int")).alias("n"), F.when(inside, still).otherwise(starts).alias("end"))

    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("end"))
    folded = F.aggregate(F.split(source, "\n", -1), start, step, lambda s: s["n"])
    return F.when((ext == "") | (F.coalesce(source, F.lit("")) == ""), 0).otherwise(folded)


def line_count(source: Column) -> Column:
    """Lines of a text as line feeds + 1; 0 for null or empty text."""
    return F.when(F.coalesce(source, F.lit("")) == "", 0).otherwise(F.regexp_count(source, F.lit("\n")) + 1)

