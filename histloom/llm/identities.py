"""Linking the spellings of one person or bot: merge-and-rematch resolution.

Each record is read into a profile: surnames, given names in canonical form (nicknames and typing slips resolved), initials, mailbox. Profiles that
share a blocking key are merged; the merged profile holds the union of spellings and initials, which gives it new keys (every surname with
every given name, an initial made whole), and so re-enters blocking, until nothing merges any more.

Blocking keys are built so that agreeing on one is the match itself, hence a block is joined to its least member, never compared in pairs.

Given names in the list below are known as such, with their short forms. Of other given names the mailbox tells which word is the surname, and
a short form beside the long one in a mailbox joins both; without a mailbox, names of two unlisted words agree in either order, and one left-out or
swapped letter inside a given name is forgiven where the whole name occurs with that surname. Words may be of any script.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom.tables import Scratch

# Given names, each with the short forms in use for it.
SHORT_FORMS = """
alexander alex sandro sasha xander lex al | amara mara | anastasia stasia nastya ana tasia stacy | antonio nino toni tony tonio anton | benjamin ben benny benni benji
charlotte lotte charlie lottie carla | christopher kit chris topher kris | dominic dom nick nico dominik | dorothea thea dora dorothy dot doro | edward ed eddie ted ned ward
eleanor nel nell ellie nora lena ella | elisabeth beth lisa liz eliza elise betty lisbeth ellie elizabeth | francesca franca fran cesca frankie chess | frederik fred rik fritz freddy erik rick frederick
gabriela gabi gaby gabriella ela bri | harold hal harry | hiroko hiro | ines | ingrid inga inge | isabella isa bella izzy belle | johannes hannes jo johan hans jan john | jonathan jon nat jonny nathan johnny
josephine fina jo josie josefine posy | katarina kata kat katja kati rina kate katharina | kwame | leonard leo len lenny leon | ludovica vica ludo lulu | magdalena lena magda maggy malena | margaret maggie meg peggy greta marge rita
matthew matt matty mat | maximilian max maxi milian | michael micha mike mick mikey mischa mich | nicholas nick nico niko nic klaus nicolas colin | noor | patrick pat paddy rick patty | penelope penny nel pen poppy | renee
robert rob bob bobby bert robbie | rosalind rosa lindy roz rose linda | samuel sam sammy | sebastian seb bastian basti | soren | sunita sunny nita | susanna sanna susie sue suse anna zanna | theodore theo ted teddy
thomas tom tommy | tomasz tomek tom | valentina vale tina val | veronika nika vera roni nik ronnie veronica | victoria tori vicky vica vic toria viki | william will bill liam billy willy | yusuf yus joseph | zoe
"""
CANON: dict[str, list[str]] = {}
for _entry in SHORT_FORMS.replace("\n", "|").split("|"):
    for _short in _entry.split():
        CANON.setdefault(_short, []).append(_entry.split()[0])
WHOLE = {e.split()[0] for e in SHORT_FORMS.replace("\n", "|").split("|") if e.split()}


def fold(s: str) -> str:
    s = s.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("Ł", "L").replace("æ", "ae").replace("đ", "d")
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def slips(w: str) -> set[str]:
    """The word and the word less one letter: words one slip apart share a member."""
    return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}


def near(a: str, b: str) -> bool:
    """Equal up to one letter put in, left out or replaced, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def inside_slips(w: str) -> set[str]:
    """What the word may have been meant to be written as or have been written for: a letter inside put in or left out is one side's, so only leaving out and swapping are listed."""
    out = {w[:i] + w[i + 1 :] for i in range(1, len(w) - 1)}
    out |= {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(1, len(w) - 2)}
    return out - {w}


_SLIPPED: dict[str, set[str]] = {}
for _w in WHOLE:
    if len(_w) >= 5:
        for _v in slips(_w):
            _SLIPPED.setdefault(_v, set()).add(_w)


def given(token: str) -> list[str]:
    """Canonical given names that the token can stand for; empty if none is known."""
    if token in WHOLE:
        return [token]
    if token in CANON:
        return CANON[token]
    if len(token) >= 4:
        return sorted({w for v in slips(token) for w in _SLIPPED.get(v, ()) if near(w, token)})
    return []


def parse(name: str | None, email: str | None) -> dict:
    """surnames, firsts, initials, bare (only a surname known), mailbox (null unless the name fits it) and squashed name."""
    mail = (email or "").strip().lower()
    local, _, domain = mail.partition("@")
    local = fold(re.sub(r"^\d+\+", "", local)).split("+")[0]
    parts = [re.sub(r"\d+", "", p) for p in re.split(r"[._-]+", local)]
    parts = [p for p in parts if p]
    mail = f"{local}@{domain}" if domain and local else ""
    text = fold(name or "")
    text = re.sub(r"\([^()]*\)|\[[^\[\]]*\]", " ", text)
    text = re.sub(r"\s+[-–|/]\s+.*$", " ", text).strip()
    comma = re.match(r"^([^,]+),\s*(.+)$", text)
    if comma:
        text = f"{comma.group(2)} {comma.group(1)}"
    tokens = re.findall(r"[^\W\d_](?:[^\W\d_]|['’])*", re.sub(r"(?<=[a-z]{2})(?=[A-Z][a-z])", " ", text))
    tokens = [t for t in (re.sub("['’]", "", t).lower() for t in tokens) if t]
    out = {"surnames": set(), "firsts": set(), "initials": set(), "bare": set(), "prefixes": set(), "pairs": set(), "mail": None, "squash": "".join(tokens)}
    squashed_local = "".join(parts)
    bot = bool(re.search(r"\bbot\b|\bautomation\b|\[bot\]", (name or "").lower())) or bool(re.search(r"(^|[-_.])(bot|ci)([-_.]|@)", mail))
    if out["squash"] and (out["squash"] == squashed_local or bot):
        out["mail"] = mail or None
    if bot:
        return out

    # the mailbox: a given name or initial, and a surname
    mail_pairs: list[tuple[str, str]] = []
    settled: tuple[str, str] | None = None
    if len(parts) == 2:
        a, b = parts
        if len(a) == 1 or given(a) and not (given(b) and a not in CANON):
            mail_pairs = [(a, b)]
        elif len(b) == 1 or given(b):
            mail_pairs = [(b, a)]
        elif len(tokens) >= 2:  # names that no list has: the word that is typed too is the surname, the other a given name, be it in another form
            known = {tokens[0], tokens[-1]}
            if (a in known) != (b in known) and (first_of := known - {a, b}) and not any(given(t) for t in known):
                mail_pairs = [(a, b)] if b in known else [(b, a)]
                settled = next(iter(first_of)), mail_pairs[0][1]
            elif {a, b} == known and not any(given(t) for t in known):
                mail_pairs, settled = [(a, b)], (a, b)  # as mailboxes are usually written
    mail_words = [p for p in parts if len(p) >= 4]

    def settle(token: str, starts: set[str]) -> str:
        """The surname as the mailbox has it, where the typed one is that up to two slips."""
        cands = [c for w in mail_words for c in ([w[1:]] if w[0] in starts else []) + ([w[:-1]] if w[-1] in starts else []) + [w] if len(c) >= 4]
        if token in cands:
            return token
        close = [c for c in cands if near(c, token)] + [c for c in cands if min(len(c), len(token)) >= 7 and slips(c) & slips(token)]
        return close[0] if close else token

    first = last = None
    if len(tokens) >= 2:
        a, b = tokens[0], tokens[-1]
        swapped = not comma and not given(a) and (bool(given(b)) and len(b) > 1) and len(a) > 1
        fits = [any(near(t, w) for w in mail_words) for t in (a, b)]
        if not swapped and fits[0] and not fits[1] and not given(a) and len(a) > 1:
            swapped = True
        first, last = settled if settled else (b, a) if swapped else (a, b)
        if not given(a) and not given(b) and a != b and (len(a) > 1 and len(b) > 1 or not (a + b).isascii()):
            out["pairs"].add((min(a, b), max(a, b)))
    elif len(tokens) == 1:
        t = tokens[0]
        if given(t) and not any(near(t, w) for w in mail_words if not given(w)):
            first = t
        elif len(t) >= 5:
            hit = t if any(t in (w[1:], w[:-1]) for w in mail_words) else settle(t, set())
            if hit != t or any(hit in (w, w[1:], w[:-1]) for w in mail_words):
                last = hit
            else:
                # a handle: initial and surname, either way round, or the surname alone
                out["bare"].add(t)
            for s, i in ((t[1:], t[0]), (t[:-1], t[-1])):
                if len(s) >= 5:
                    out["initials"].add((s, i))
    if last and len(last) == 1 and last.isascii():  # "Given X.": the surname is an initial
        last = None
    if last:
        last = settle(last, {first[0], *(c[0] for c in given(first))} if first else set())
    # what the mailbox adds
    owner = False
    surname = last
    if mail_pairs:
        f, s = mail_pairs[0]
        if last is None or near(s, last) or last == s:
            owner, surname = True, s
            if len(f) == 1:
                out["initials"].add((s, f))
            else:
                for c in given(f) or [f]:
                    out["firsts"].add((s, c))
    elif len(parts) == 1 and len(parts[0]) >= 4:
        w = parts[0]
        if last is None or w == last:
            owner = True
            if last is None:
                if first and w[0] in {first[0], *(c[0] for c in given(first))} and len(w) >= 7:
                    out["initials"].add((w[1:], w[0]))
                out["bare"].add(w)
                surname = w if first else None
                for s, i in ((w[1:], w[0]), (w[:-1], w[-1])):
                    if len(s) >= 5 and not first:
                        out["initials"].add((s, i))
        elif w[1:] == last or w[:-1] == last or near(w[1:], last):
            owner = True
            out["initials"].add((last, w[0] if w[1:] == last or near(w[1:], last) else w[-1]))
    if surname:
        if first is None:
            out["bare"].add(surname)
        elif len(first) == 1 and first.isascii():
            out["initials"].add((surname, first))
        else:
            for c in given(first) or [first]:
                out["firsts"].add((surname, c))
            if not given(first):
                out["prefixes"].add((surname, first[:3]))
    if mail and (owner or out["mail"]):
        out["mail"] = mail
    out["surnames"] = {s for s, _ in out["firsts"] | out["initials"]} | out["bare"]
    return out


def _read(batches):
    for b in batches:
        rows = []
        for i, n, e in zip(b["id"], b["name"], b["email"]):
            p = parse(n, e)
            if p["mail"]:
                rows.append((i, "mail", p["mail"], None))
            if p["squash"] and (not p["surnames"] or not p["squash"].isascii()):
                rows.append((i, "squash", p["squash"], None))
            rows += [(i, "pair", a, b) for a, b in p["pairs"]]
            rows += [(i, "near", s, v) for s, f in p["firsts"] if len(f) >= 5 and f not in WHOLE for v in inside_slips(f)]
            rows += [(i, "full", s, f) for s, f in p["firsts"]] + [(i, "initial", s, f) for s, f in p["initials"]] + [(i, "prefix", s, f) for s, f in p["prefixes"]] + [(i, "bare", s, None) for s in p["bare"]]
        yield pd.DataFrame(rows, columns=["id", "kind", "a", "b"])


def _keys(features: DataFrame, scratch: Scratch) -> DataFrame:
    """(label, key) of each profile; agreeing on a key is a match. What several rules read is kept as a table, so that no rule's plan repeats it."""
    f = scratch.save(features.select("label", "kind", "a", "b").distinct())
    key = lambda tag, *cols: F.concat_ws("\x1f", F.lit(tag), *cols)
    exact = f.filter("kind in ('mail', 'squash')").select("label", key("x", "kind", "a").alias("key"))
    either = f.filter("kind = 'pair'").select("label", key("p", "a", "b").alias("key"))
    # union of spellings: every surname of the profile with every given name of it
    full = f.filter("kind = 'full'")
    crossed = scratch.save(full.select("label", "a").distinct().join(full.select("label", "b").distinct(), "label"))
    whole = crossed.select("label", key("f", "a", "b").alias("key"))
    # one slip in the surname: agreement on the word less one letter, for long surnames and the same given name
    less = F.transform(F.sequence(F.lit(1), F.length("a")), lambda i: F.concat(F.expr("a").substr(F.lit(1), i - 1), F.expr("a").substr(i + 1, F.length("a"))))
    slip = crossed.filter("length(a) >= 6").select("label", "b", F.explode(F.array_distinct(F.concat(F.array("a"), less))).alias("v")).select("label", key("s", "v", "b").alias("key"))
    # an initial is made whole where the surname has one given name with it; a bare surname where it has one at all
    names = scratch.save(crossed.select(F.col("a"), F.col("b").alias("first")).distinct())
    by_initial = names.groupBy("a", F.substring("first", 1, 1).alias("i")).agg(F.min("first").alias("lo"), F.max("first").alias("hi")).filter("lo = hi")
    by_surname = names.groupBy("a").agg(F.min("first").alias("lo"), F.max("first").alias("hi")).filter("lo = hi")
    initial = f.filter("kind = 'initial'").withColumnRenamed("b", "i")
    made = initial.join(by_initial, ["a", "i"]).select("label", key("f", "a", "lo").alias("key"))
    # a slip inside a given name counts where the name as it should be stands with the surname
    close = f.filter("kind = 'near'").join(names.select("a", F.col("first").alias("b")), ["a", "b"]).select("label", key("f", "a", "b").alias("key"))
    known = names.filter(F.col("first").isin(sorted(WHOLE)))
    by_prefix = known.groupBy("a", F.substring("first", 1, 3).alias("b")).agg(F.min("first").alias("lo"), F.max("first").alias("hi")).filter("lo = hi")
    short = f.filter("kind = 'prefix'").join(by_prefix, ["a", "b"]).select("label", key("f", "a", "lo").alias("key"))
    bare = f.filter("kind = 'bare'").join(by_surname, "a").select("label", key("f", "a", "lo").alias("key"))
    # initials and bare surnames that no full name backs agree among themselves
    alone = initial.join(names.select("a").distinct(), "a", "left_anti").select("label", key("i", "a", "i").alias("key"))
    keys = scratch.save(exact.unionAll(either).unionAll(close).unionAll(whole).unionAll(slip).unionAll(made).unionAll(bare).unionAll(short).unionAll(alone).distinct())
    scratch.drop(f, crossed, names)
    return keys


def resolve(records: DataFrame, record_id: Column, name: Column, email: Column) -> DataFrame:
    """(id, entity): records of one person or bot have the same entity, the least id among them.

    Names and e-mails may be null, blank, reordered, shortened, misspelt, decorated with brackets or a dash and a place, or be handles. A mailbox links
    records only if the name fits it, so a shared mailbox links nobody. Given names that differ are different people, even in one family and with
    one initial; an initial or bare surname that fits several people links to none of them. A record without any usable name or mailbox stands alone.
    Ids must be unique and not null; other columns are ignored. An empty table gives an empty result.
    """
    rows = records.select(record_id.alias("id"), name.alias("name"), email.alias("email")).filter("id is not null")
    kind = dict(rows.dtypes)["id"]
    scratch = Scratch(records.sparkSession, "identities")
    features = scratch.save(rows.mapInPandas(_read, f"id {kind}, kind string, a string, b string").distinct())
    labels = scratch.save(rows.select("id", F.col("id").alias("label")).distinct())
    while True:
        keys = _keys(features.join(labels, "id"), scratch)
        least = keys.groupBy("key").agg(F.min("label").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        hook = scratch.save(keys.join(least, "key").groupBy("label").agg(F.min("least").alias("to")).filter("to < label"))
        if hook.isEmpty():
            scratch.keep(labels)
            return labels.select("id", F.col("label").alias("entity"))
        # follow the hooks to their ends by doubling; hooks point down, so there is no cycle
        while True:
            nxt = hook.select(F.col("label").alias("to"), F.col("to").alias("far"))
            doubled = scratch.save(hook.join(nxt, "to", "left").select("label", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")))
            scratch.drop(hook)
            hook = doubled
            if hook.filter("moved").isEmpty():
                break
        merged = scratch.save(labels.join(hook.select("label", "to"), "label", "left").select("id", F.coalesce("to", "label").alias("label")))
        for old in (labels, hook, keys):
            scratch.drop(old)
        labels = merged


def with_links(entities: DataFrame) -> DataFrame:
    """(id, entity, links): with how many other ids each id is linked. Sizes are counted before they are joined back."""
    return entities.join(entities.groupBy("entity").agg((F.count(F.lit(1)) - 1).alias("links")), "entity").select("id", "entity", "links")


def linked_pairs(entities: DataFrame) -> DataFrame:
    """(a, b), a < b, of every two ids with one entity."""
    left = entities.select("entity", F.col("id").alias("a"))
    return left.join(entities.select("entity", F.col("id").alias("b")), "entity").filter("a < b").select("a", "b")
