"""Literal credentials in diffs: located by key path and value shape, redacted in place.

Lines of a diff are parsed in the formats that configuration and source use (JSON, YAML, properties, environment, INI, TOML, XML, HCL,
netrc, npmrc, assignments, headers, command options, addresses) into entries: a key path and the value's offsets. ``KeyPaths`` holds what
encloses each line, so an entry whose own key says nothing (value, default, data) is named by its container, by the ``name`` that stands beside it
or by the container's description. An entry is a credential when the last name of its path is sensitive and its value looks like a secret, or when the value has the shape
of an issued token; key blocks and addresses that carry a password or signature are found as such. A drawn key cut into pieces counts under any name;
beyond 120 characters it does not if it looks like data (``is_data``), so a longer key under a neutral name in three or more pieces of one width from 48
is missed. Redactions are spliced into the original bytes at the offsets.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "REDACTED"

# Prefixes under which services issue tokens.
ISSUED = re.compile(
    r"(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w-]{20,}|(?:sk|rk|pk)_live_[A-Za-z0-9]{16,}|A(?:KIA|SIA)[A-Z0-9]{16}|xox[abprs]-[A-Za-z0-9-]{20,}|AIza[\w-]{35}|npm_[A-Za-z0-9]{36}|SG\.[\w-]{16,}\.[\w-]{16,}|hf_[A-Za-z0-9]{30,}|eyJ[\w-]{10,}\.eyJ[\w-]{10,}\.[\w-]{10,})(?![A-Za-z0-9])"
)
SENSITIVE = re.compile(r"(?i)(?:pass(?:w(?:or)?d|phrase|wd|code)?|pwd|passwd|secret|token|credentials?|api[-_. ]?key|access[-_. ]?key|private[-_. ]?key|secret[-_. ]?key|signing[-_. ]?key|encryption[-_. ]?key|auth[-_. ]?key|account[-_. ]?key|client[-_. ]?secret|auth|pw|psw|pswd|passwrd|mdp|geheim(?:nis)?|kennwort|passwort|contrase(?:n|ñ)a|mot_?de_?passe|clave|senha|wachtwoord|parola|has[lł]o|l(?:o|ö)senord)$")
KEYISH = re.compile(r"(?:[_.-](?:key|KEY)|Key)$")
HARMLESS = re.compile(r"(?i)(?:public|primary|foreign|sort|cache|partition|index|unique|csrf_?field|next_?page|page|token_?type|shortcut|hot)[-_. ]?(?:key|token)$")
PLACEHOLDER = re.compile(
    r"(?i)^(?:change[-_ ]?me.*|replace[-_ ]?me.*|your[-_ ].*|my[-_ ]?(?:password|secret|token|key)|<.*>|\[.*\]|\{\{.*|\$\{.*|\$\(.*|\$[A-Za-z_]\w*|%\w+%|%\(.*|@\w+@|#\{.*|!\w+\s.*|(.)\1{3,}|x+|\*+|\.+|-+|todo.*|tbd|fixme|none|null|nil|true|false|undefined|example.*|sample|dummy|fake|placeholder|insert.*|password|passwd|secret|token|test|redacted|vault[:/].*|env[:.].*|secret[:/].*|arn:.*|file:.*|ssm:.*|\s*)$"
)
FILE_HEAD = re.compile(r"data:|iVBORw0KGgo|/9j/|R0lGOD|UEsDB|JVBERi|H4sI|AAEAAA|d09GR|PD94|PHN2Zy")
BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
BLOCK_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
ADDRESS = re.compile(r"\b[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@'\"<>]*:([^\s/@'\"<>]+)@[\w.-]+")
SIGNED = re.compile(r"https?://[^\s'\"<>]*[?&](?:sig|signature|X-Amz-Signature|X-Goog-Signature|access_token|api_?key|token|auth|key)=([A-Za-z0-9%+/=_-]{12,})", re.I)
HOOK = re.compile(r"https?://[\w.-]*hooks?[\w.-]*/(?:[\w-]+/)*(T[A-Z0-9]{6,}/B[A-Z0-9]{6,}/[A-Za-z0-9]{16,})")
HEADER = re.compile(r"(?i)(?:authorization[\"']?\s*[:=,]\s*[\"']?(?:bearer|token|basic|apikey)\s+|(?:private-token|x-api-key|x-auth-token|x-access-token|api-key|apikey|x-vault-token|deploy-token)\s*:\s*)([^\s\"']+)")
SCHEME = re.compile(r"(?<![\w-])(?:Basic|Bearer|Token|ApiKey|basic|bearer|BASIC|BEARER)\s+([A-Za-z0-9+/_~.-]{16,}={0,2})(?![\w+/])")
OPTION = re.compile(r"(?i)(?:^|\s)--?(?:password|passwd|pass|token|secret|api-?key|auth-token|access-token)(?:=|\s+)([\"']?)([^\s\"']+)\1")
USERPASS = re.compile(r"(?:^|\s)(?:-u|--user)\s+[\"']?[\w.@-]+:([^\s\"':]+)")
NETRC = re.compile(r"\bmachine\s+\S+\s+login\s+\S+\s+(?:account\s+\S+\s+)?password\s+(\S+)")
NPMRC = re.compile(r"^\s*//\S+/:_(?:authToken|password|auth)\s*=\s*(\S+)")
PGPASS = re.compile(r"^[\w.*-]+:(?:\d+|\*):[\w*-]+:[\w*-]+:(\S+)$")
CONNECTION = re.compile(r"(?i)(?:^|[;\"'\s])(?:password|pwd|accountkey|sharedaccesskey)\s*=\s*([^;\"'\s]+)(?=[;\"'])")
LOGIN = re.compile(r"(?i)\b(?:authenticate|log_?in|sign_?in|set_?password|set_?credentials|basic_?auth|connect)\s*\((?:[^()]*,)?\s*[\"']([^\"'\s]+)[\"']\s*\)")
NOTE = re.compile(r"^\s*(?://+|#+|--+|/?\*+|;+|<!--|%+)[^:]*:\s*[\w.@+-]+ (?:/|\||:) (\S{6,})\s*(?:\*/|-->)?\s*$")
PAIR = re.compile(r"[\[({]\s*[\"'][\w.+-]+@[\w.-]+[\"']\s*,\s*[\"']([^\"'\s]+)[\"']")
ARGUMENTS = re.compile(r"[\"']([\w.-]+)[\"']\s*,\s*[\"']([^\"'\s]+)[\"']\s*\)")
AUTH_PAIR = re.compile(r"(?i)\bauth\w*\s*[=:]\s*[\[(]\s*[\"'][^\"']+[\"']\s*,\s*[\"']([^\"'\s]+)[\"']")
SHORT = re.compile(r"(?:^|\s)-[uUD]\s+\S+\s+(?:-w\s+|-p\s*)([^\s-]\S+)")
XML = re.compile(r"<([\w.:-]+)(?:\s[^<>]*)?>([^<>]+)</\1>")
XML_ATTR = re.compile(r"<[^<>]*\b(?:name|key)\s*=\s*\"([^\"]+)\"[^<>]*\bvalue\s*=\s*\"([^\"]+)\"")
QUOTED = re.compile(r"""([\w.$\-\[\]'"]*?[\w$\-]+)["'\]]*\s*(?::=|=>|[=:])\s*[rbuf]?(["'`])((?:\\.|(?!\2).)*)\2""")
LINEKV = re.compile(r"^\s*(?:-\s+)?(?:export\s+|set\s+|ENV\s+|ARG\s+|-e\s+|-D)*([A-Za-z_][\w.\-/]*)\s*(=|:(?=\s)|\s(?=\S+$))\s*(\S.*?)\s*$")
PIECE = re.compile(r"""^\s*(?:\+|\.|<>|&|\|\||\\)?\s*[rbuf]?(["'])((?:\\.|(?!\1).)*)\1""")
# What encloses lines: a key that opens a container (indentation or bracket), a block with labels, a section, an element; and the names given beside values.
OPENS = re.compile(r"(?:-\s+)?[\"']?([\w.\-/ ]+?)[\"']?\s*[:=]\s*(?:[|>&{\[].*)?$")
BLOCK_OPENS = re.compile(r"[\w-]+((?:\s+\"[^\"]+\")+)\s*\{$")
SECTION = re.compile(r"\[+([^\[\]\"'(){}]+)\]+$")
ELEMENT = re.compile(r"<([\w.:-]+)(?:\s[^<>]*[^/<>])?>$")
BESIDE = re.compile(r"(?i)(?:-\s+)?(?:[\"']?(name|key|description)[\"']?\s*[:=]\s*[\"']?([^\"'<>]+?)[\"']?,?|<(name|key|description)>([^<>]+)</\w+>)$")
DESCRIBED = re.compile(r"(?i)password|secret|token|\bkey\b|credential")
UNNAMED = re.compile(r"(?i)default|value|data|content")
CONFIG = set("yml yaml json properties env ini cfg conf toml xml tf tfvars hcl netrc npmrc pypirc pgpass local production development staging test".split())
WORDS = "pass pw psw secret token credential key auth mdp geheim kennwort contrase clave senha wachtwoord parola hasl hasł senord".split()
# Where a literal may go on: a joiner and a literal behind it, or a literal at the start of the next line.
JOIN = re.compile(r"""["'`](?=[^\S\n]*(?:\+|\.|<>|&|\\)[^\S\n]*[rbuf]?["']|[ \t+.&\\]*\n[+-][^\S\n]*(?:\+|\.|<>|&|\|\||\\)?[^\S\n]*[rbuf]?["'])""")
NAMED = ["default", "value", "data", "content"]  # keys that take their name from the lines around
# For each rule what a line must hold for it to match there, one of these being enough: literals in folded case, or patterns.
NEEDS = [
    (ADDRESS, ["://"]), (SIGNED, ["sig=", "signature=", "token", "key", "auth"]), (HOOK, ["hook"]), (NETRC, ["machine"]), (NPMRC, ["/:_"]), (PGPASS, [re.compile(r":(?:\d+|\*):")]), (HEADER, ["auth", "token", "key"]), (SCHEME, ["basic", "bearer", "token", "apikey"]), (USERPASS, ["-u"]), (CONNECTION, ["pass", "pw", "key"]),
    (LOGIN, ["auth", "login", "log_in", "signin", "sign_in", "pass", "credential", "connect"]), (NOTE, [" / ", " | ", " : "]), (PAIR, [re.compile(r"@[\w.-]+[\"']\s*,")]), (SHORT, ["-u", "-d"]), (ARGUMENTS, WORDS), (AUTH_PAIR, ["auth"]), (OPTION, ["pass", "token", "secret", "key"]), (XML, [*WORDS, *NAMED]), (XML_ATTR, WORDS), (BLOCK, ["-----begin"]),
    (ISSUED, ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "_live_", "akia", "asia", "xox", "aiza", "npm_", "sg.", "hf_", "eyj"]), (QUOTED, [*WORDS, *NAMED, JOIN]), (LINEKV, [*WORDS, *NAMED]),
]
BIT = {id(rx): 1 << k for k, (rx, _) in enumerate(NEEDS)}
HINTS = {h: sum({BIT[id(rx)] for rx, needs in NEEDS if h in needs}) for _, all_needs in NEEDS for h in all_needs}


def fold(s: str) -> str:
    """Lower case as patterns without case see it, length kept."""
    return s.lower() if s.isascii() else s.replace("ſ", "s").replace("ı", "i").replace("İ", "i").lower()


def hinted(diff: str, starts: list[int]) -> dict[int, int]:
    """Numbers of the lines on which some rule can match, with the bits of those rules. Other lines cannot hold a credential."""
    out: dict[int, int] = {}
    low, size = fold(diff), len(diff)
    for h, bits in HINTS.items():
        at = low.find(h) if isinstance(h, str) else (m.start() if (m := h.search(diff)) else -1)
        while at >= 0:
            i = bisect_right(starts, at) - 1
            out[i] = out.get(i, 0) | bits
            at = starts[i + 1] if i + 1 < len(starts) else size
            at = low.find(h, at) if isinstance(h, str) else (m.start() if (m := h.search(diff, at)) else -1)
    return out


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def looks_random(v: str, least: int = 16) -> bool:
    """A value that was drawn, not worded: long, of one piece, mixed, and evenly spread."""
    if len(v) < least or re.search(r"\s", v) or re.match(r"^[A-Za-z][\w+.-]*://", v) or not re.search(r"\d", v):
        return False
    if re.fullmatch(r"[\w-]*(?:/[\w.-]+)+", v) and not re.search(r"[A-Z].*[a-z].*\d|\d.*[A-Z]", v):
        return False
    return entropy(v) >= 3.0 and bool(re.search(r"[A-Za-z]", v))


def mixed(v: str) -> bool:
    """Drawn of letters alone: upper and lower case take turns too often for words."""
    turns = sum(a.isupper() != b.isupper() for a, b in zip(v, v[1:]))
    return len(v) >= 8 and turns >= 0.3 * len(v) and entropy(v) >= 2.5


def is_data(whole: str, widths: list[int]) -> bool:
    """A long literal in pieces that is no drawn key: the head of a known file, lines filled to one width, other characters than keys have, or worded runs."""
    if FILE_HEAD.match(whole) or len(widths) > 2 and widths[0] >= 48 and len({*widths[:-1]}) == 1 and widths[-1] <= widths[0] or not re.fullmatch(r"[\w+/=.~-]+", whole):
        return True
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" for c in whole]
    return sum(a != b for a, b in zip(kinds, kinds[1:])) < 0.3 * len(whole)  # drawn: 0.40 in lower case with digits, 0.47 in hex, 0.62 in mixed case


def is_reference(v: str) -> bool:
    return bool(PLACEHOLDER.match(v) or re.search(r"\$\{|\{\{|\$\(|^\$|<[^>]*>|%\(", v) or re.match(r"^[A-Za-z_][\w.]*\(.*\)?;?$", v) or re.match(r"^(?:os\.environ|process\.env|env\.|ENV\[|System\.getenv|config\.|settings\.|self\.|this\.|var\.|local\.|data\.|module\.|secrets?\.)", v))


def last_name(key: str) -> str:
    return re.sub(r"^.*[./:\[\]'\"]", "", key.strip("'\"[]"))


def sensitive(key: str) -> bool:
    name = last_name(key)
    if re.search(r"(?i)(?:_id|_file|_path|_name|_url|_type|_count|_length|_len|_ttl|_expiry|_hash|_field|_help|Id)$", name) or HARMLESS.search(key):
        return False
    return bool(SENSITIVE.search(name) or SENSITIVE.search(key))


def plausible(v: str) -> bool:
    """Can be a password that someone typed or drew: no blanks, no placeholder, not a bare word."""
    if is_reference(v) or len(v) < 6 or re.search(r"\s", v) or len(set(v)) < 4:
        return False
    return bool(re.search(r"\d", v) or re.search(r"[^\w\s.-]", v) and len(v) >= 8 or re.search(r"[a-z][A-Z].*[a-z][A-Z]|[A-Z]{2}.*[a-z].*[A-Z]", v) and entropy(v) >= 3.0 or mixed(v))


class KeyPaths:
    """What encloses each line of a diff: parent lines with their keys, and the names and descriptions that stand beside values.

    One pass over the lines. A container is opened by a key without a value, a bracket, a block, a section or an element, and holds the lines
    that are indented deeper, up to the end of the hunk.
    """

    def __init__(self, lines: list[str]):
        self.parent, self.key, self.beside = [-1] * len(lines), [""] * len(lines), {}
        stack: list[tuple[int, int]] = []
        for i, raw in enumerate(lines):
            text = raw[1:]
            body = text.strip()
            if raw[:1] == "@":
                stack = []
            if raw[:1] == "@" or not body:
                continue
            indent = len(text) - len(text.lstrip())
            while stack and stack[-1][0] >= indent and not (body == "{" and stack[-1][0] == indent):
                stack.pop()
            self.parent[i] = stack[-1][1] if stack else -1
            if body.startswith("- "):  # an item of a list holds what stands beside it
                stack.append((indent, i))
            m = BESIDE.match(body)
            if m:
                what, name = m.group(1) or m.group(3), m.group(2) or m.group(4)
                self.beside.setdefault((stack[-1][1] if stack else -1, what.lower() == "description"), name)
            if section := SECTION.match(body):
                self.key[i], stack = section.group(1), [(-1, i)]
            elif o := OPENS.match(body) or BLOCK_OPENS.match(body) or ELEMENT.match(body):
                self.key[i] = o.group(1).strip().replace('"', "")
                if not body.startswith("- "):
                    stack.append((indent, i))
            elif body in "{[" or body.endswith(("{", "[")):
                stack.append((indent, i))

    def of(self, i: int) -> list[str]:
        """Keys of the containers of line i, outermost first."""
        out, at = [], self.parent[i]
        while at >= 0:
            if self.key[at]:
                out.append(self.key[at])
            at = self.parent[at]
        return out[::-1]

    def name(self, i: int, key: str) -> str:
        """The key, or what names it where it says nothing: the name beside it, its description, its containers."""
        if not UNNAMED.fullmatch(last_name(key)):
            return key
        home = i if (i, False) in self.beside else self.parent[i]
        if home >= 0 and (home, False) in self.beside:
            return self.beside[home, False]
        if home >= 0 and DESCRIBED.search(self.beside.get((home, True), "")):
            return "secret"
        return next((k for k in reversed(self.of(i)) if not UNNAMED.fullmatch(last_name(k))), key)


@dataclass
class Finding:
    line: int  # 0-based, where the statement or block begins
    kind: str
    spans: list[tuple[int, int]] = field(default_factory=list)  # offsets in the diff, exclusive ends
    path: str = ""  # keys of the containers and of the entry, joined by dots; empty where the form has no key


def _line_findings(text: str, bits: int) -> list[tuple[str, int, int]]:
    """(kind, start, end) of credentials within one line, by the rules whose bits are set."""
    out = []
    for rx, kind in ((ADDRESS, "address"), (SIGNED, "address"), (HOOK, "address"), (NETRC, "password"), (NPMRC, "token"), (PGPASS, "password"), (HEADER, "token"), (USERPASS, "password"), (CONNECTION, "password"), (LOGIN, "password"), (NOTE, "password"), (PAIR, "password"), (SHORT, "password"), (AUTH_PAIR, "password")):
        if not bits & BIT[id(rx)]:
            continue
        for m in rx.finditer(text):
            v = m.group(1)
            good = plausible(v) if rx in (NETRC, USERPASS, PGPASS, CONNECTION, LOGIN, NOTE, PAIR, SHORT, AUTH_PAIR) else not is_reference(v) and (rx in (ADDRESS,) and len(v) >= 4 or looks_random(v, 12) or bool(ISSUED.search(v)))
            if good:
                out.append((kind, *m.span(1)))
    for m in ARGUMENTS.finditer(text) if bits & BIT[id(ARGUMENTS)] else ():
        if sensitive(m.group(1)) and plausible(m.group(2)):
            out.append(("secret", *m.span(2)))
    for m in SCHEME.finditer(text) if bits & BIT[id(SCHEME)] else ():
        v = m.group(1)
        if not is_reference(v) and (looks_random(v) or mixed(v.rstrip("=")) or ISSUED.search(v)):
            out.append(("token", *m.span(1)))
    for m in OPTION.finditer(text) if bits & BIT[id(OPTION)] else ():
        if plausible(m.group(2)) or ISSUED.search(m.group(2)):
            out.append(("password", *m.span(2)))
    for m in ISSUED.finditer(text) if bits & BIT[id(ISSUED)] else ():
        out.append(("token", *m.span()))
    return out


def find(diff: str, filename: str = "") -> list[Finding]:
    """Credentials on added and deleted lines of a unified diff, in order of where they begin."""
    starts = [0, *(m.end() for m in re.finditer("\n", diff))]
    marks = hinted(diff, starts)
    if not marks:
        return []
    name = filename.rsplit("/", 1)[-1].lower()
    ext = name.rsplit(".", 1)[-1]
    config = ext in CONFIG or name.startswith((".env", "dockerfile", "docker-compose", "_netrc"))
    if ext in ("pub", "lock", "map", "md", "rst", "txt", "adoc"):
        config = False
    lines, found = diff.split("\n"), []
    taken: set[int] = set()
    paths: KeyPaths | None = None  # read when a key first asks for it

    def around() -> KeyPaths:
        nonlocal paths
        paths = paths or KeyPaths(lines)
        return paths

    for i in sorted(marks):
        raw, bits = lines[i], marks[i]
        sign, text, base = raw[:1], raw[1:], starts[i] + 1
        if not text or sign not in "+-" or raw.startswith(("+++ ", "--- ")) or i in taken:
            continue
        key_here = ""
        m = BLOCK.search(text) if bits & BIT[id(BLOCK)] else None
        if m:
            end, j = BLOCK_END.search(text, m.end()), i
            f = Finding(i, "private key")
            if end:  # the block in one line, its breaks escaped
                f.spans.append((base + m.start(), base + end.end()))
            else:
                f.spans.append((base + m.start(), base + len(text)))
                j = i + 1
                while j < len(lines) and lines[j][:1] == sign:
                    e = BLOCK_END.search(lines[j])
                    f.spans.append((starts[j] + 1, starts[j] + (e.end() if e else len(lines[j]))))
                    taken.add(j)
                    if e:
                        break
                    if not re.fullmatch(r"[\s\"'+]*[A-Za-z0-9+/=:\s,-]*(?:\\n)?[\"'+,;)\s]*", lines[j][1:]):
                        f.spans.pop()
                        taken.discard(j)
                        break
                    j += 1
            found.append(f)
            continue
        hits = _line_findings(text, bits)
        for rx in (XML, XML_ATTR):
            for m in rx.finditer(text) if bits & BIT[id(rx)] else ():
                key = around().name(i, m.group(1)) if UNNAMED.fullmatch(last_name(m.group(1))) else m.group(1)
                if sensitive(key) and plausible(m.group(2).strip()):
                    hits.append(("secret", *m.span(2)))
                    key_here = key
        for m in QUOTED.finditer(text) if bits & BIT[id(QUOTED)] else ():
            key, value, s, e = m.group(1), m.group(3), m.start(3), m.end(3)
            pieces, tail, j = [(base + s, base + e)], text[m.end() :], i
            whole = value
            # a literal cut into pieces: "a" + "b", on this line or the next ones
            cut = re.match(r"\s*(?:\+|\.|<>|&|\\|$)", tail)
            rest, off = tail, base + m.end()
            while cut:
                if not rest.strip(" \t+.&\\"):
                    if j + 1 >= len(lines) or lines[j + 1][:1] != sign or (not rest.strip() and not PIECE.match(lines[j + 1][1:])):
                        break
                    j += 1
                    rest, off = lines[j][1:], starts[j] + 1
                p = PIECE.match(rest)
                if not p:
                    break
                pieces.append((off + p.start(2), off + p.end(2)))
                whole += p.group(2)
                rest, off = rest[p.end() :], off + p.end()
                cut = re.match(r"\s*(?:\+|\.|<>|&|\\|$)", rest)
            drawn = looks_random(whole, 20) and entropy(whole) >= 3.4 and not (len(whole) > 120 and is_data(whole, [b - a for a, b in pieces]))
            if len(pieces) > 1 and (ISSUED.fullmatch(whole) or drawn or (sensitive(key) and (looks_random(whole) or plausible(whole)))):
                found.append(Finding(i, "token", pieces, key))
                taken.update(range(i + 1, j + 1))
                hits = [h for h in hits if not any(base + h[1] < b and a < base + h[2] for a, b in pieces)]
                continue
            if any(a < e and s < b for _, a, b in hits):
                continue
            name_here = around().name(i, key) if UNNAMED.fullmatch(last_name(key)) else key
            if sensitive(name_here) and (plausible(value) or ISSUED.search(value)) or KEYISH.search(name_here) and looks_random(value) and not HARMLESS.search(name_here) and not is_reference(value):
                hits.append(("secret", s, e))
                key_here = name_here
        if not hits:
            m = LINEKV.match(text) if bits & BIT[id(LINEKV)] else None
            if m and not m.group(3).startswith(("'", '"', "`", "{", "[", "|", ">")):
                key, value, s, e = m.group(1), m.group(3), m.start(3), m.end(3)
                bare = re.split(r"\s+#", value)[0].rstrip(",;")
                e = s + len(bare)
                upper = key.isupper() and m.group(2) == "="
                trust = config or upper or m.group(2) == "=" and text.startswith(("export ", "ENV ", "      - "))
                key = around().name(i, key) if UNNAMED.fullmatch(last_name(key)) else key
                keyed = sensitive(key) or KEYISH.search(key) and looks_random(bare) and not HARMLESS.search(key)
                if m.group(2) != " " or sensitive(key):
                    good = plausible(bare) if trust else (looks_random(bare, 12) or re.search(r"[!?#%*$^&@]", bare)) and plausible(bare) and not re.search(r"[()\[\]{};]", bare)
                    if keyed and good and not any(a < e and s < b for _, a, b in hits) and not (m.group(2).strip() == "" and not config):
                        hits.append(("secret", s, e))
                        key_here = key
        if hits:
            kind = hits[0][0]
            spans = sorted({(base + a, base + b) for _, a, b in hits})
            merged = [spans[0]]
            for a, b in spans[1:]:
                if a < merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                else:
                    merged.append((a, b))
            found.append(Finding(i, kind, merged, key_here))
    found.sort(key=lambda f: f.line)
    for f in found:
        f.path = ".".join([*around().of(f.line), f.path.strip("'\"")]).strip(".")
    return found


def byte_spans(diff: str, findings: list[Finding]) -> list[tuple[int, int]]:
    """The findings' spans as byte offsets of the text in UTF-8, in order, overlaps joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted({s for f in findings for s in f.spans}):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif b > a:
            out.append((a, b))
    if diff.isascii():
        return out
    at = size = 0
    edges = []
    for x in (x for s in out for x in s):
        size += len(diff[at:x].encode("utf-8", "surrogatepass"))
        at = x
        edges.append(size)
    return list(zip(edges[::2], edges[1::2]))


def redact(diff: str, findings: list[Finding], mark: str = MARK) -> str:
    """The diff with every span replaced; everything else stays byte for byte."""
    raw, out, at = diff.encode("utf-8", "surrogatepass"), [], 0
    for a, b in byte_spans(diff, findings):
        out += [raw[at:a], mark.encode()]
        at = b
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def scan(changes: DataFrame, filename: Column, diff: Column, keys: list[str]) -> DataFrame:
    """keys, line_no, kind, key_path and redacted for each credential; ``redacted`` is the whole diff, on the first finding's row only.

    Null or empty diffs hold nothing. Repeated rows are merged. All others go to Python, one at a time; a rule is tried on the
    lines that hold what it cannot match without (``NEEDS``).
    """
    base = changes.select(*keys, filename.alias("_name"), diff.alias("_diff")).filter(F.length("_diff") > 0)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.select(*keys).schema) + ", line_no int, kind string, key_path string, redacted string"

    def read(batches):
        for b in batches:
            rows = []
            for row in b.itertuples(index=False):
                found = find(row[-1], row[-2] or "")
                seen = set()
                for f in found:
                    if f.line not in seen:
                        rows.append((*row[:-2], f.line + 1, f.kind, f.path, None if seen else redact(row[-1], found)))
                        seen.add(f.line)
            if rows:
                yield pd.DataFrame(rows, columns=[*keys, "line_no", "kind", "key_path", "redacted"])

    return base.mapInPandas(read, schema).groupBy(*keys, "line_no").agg(F.min("kind").alias("kind"), F.min("key_path").alias("key_path"), F.max("redacted").alias("redacted"))
