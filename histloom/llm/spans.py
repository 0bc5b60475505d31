"""Long exact spans shared between records, by an FM-index per shard.

Routing. A stretch of L characters is sent to the shard of its minimiser, the smallest hash among its k-grams, so equal stretches always meet,
whichever records they come from. Neighbouring stretches with one minimiser travel as one segment, cut where it grows long. A minimiser that occurs with one
owner only cannot belong to a shared stretch, and its segments are never shipped; on ordinary text that is nearly all of them. Texts around a minimiser
that are too many for one index are cut again by the minimisers of longer grams, up to the stretch itself, so a shard is bounded and no two shards are compared.

Matching. A shard's distinct segment texts form one FM-index: the BWT in a wavelet matrix of packed bits with rank counts, and three more bits for each row, by
which an interval is cut back to the stretch length and its owners are told apart; about two bytes a character, the texts and the suffix array are not part of it. Texts
are streamed through it from right to left in step, by backward search; at each position the interval of the stretch of length L that starts there is
known: it is extended by one character on the left and cut back to length L. A stretch whose interval holds rows of two owners is shared.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from histloom.tables import Scratch

#: Characters in one index; about 60 bytes of memory each while it is built.
SHARD_CHARS = 2_000_000
#: Stretches in one segment at most.
SEGMENT = 16_384
#: Parts in which the places of one minimiser are joined.
SALTS = 16


def codes_of(text: str) -> np.ndarray:
    """Code points; one byte each where the text allows."""
    return np.frombuffer(text.encode("latin-1"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(a: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of every k-gram, by doubling."""
    with np.errstate(over="ignore"):
        h = (a.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        out, done, size, rest = None, 0, 1, k
        while rest:
            if rest & 1:
                if out is None:
                    out = h[: len(a) - size + 1]
                else:
                    n = len(a) - done - size + 1
                    out = out[:n] * np.uint64(0xD6E8FEB86659FD93) + h[done : done + n]
                    out ^= out >> np.uint64(29)
                done += size
            rest >>= 1
            if rest:
                n = len(h) - size
                h = h[:n] * np.uint64(0xBF58476D1CE4E5B9) + h[size : size + n]
                h ^= h >> np.uint64(31)
                size *= 2
        return out * np.uint64(0x94D049BB133111EB)


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by doubling."""
    m, size = h, 1
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return m if size == w else np.minimum(m[: len(h) - w + 1], m[w - size : w - size + len(h) - w + 1])


def segments(text: str, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, start, end) of the segments whose stretches of ``length`` share a minimiser; at most ``SEGMENT`` stretches in each."""
    m = window_min(gram_hashes(codes_of(text), k), length - k + 1)
    cut = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    ends = np.concatenate([cut[1:], [len(m)]])
    if (ends - cut).max() > SEGMENT:
        n = -(-(ends - cut) // SEGMENT)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        cut, ends = np.repeat(cut, n) + nth * SEGMENT, np.repeat(ends, n)
        ends = np.minimum(ends, cut + SEGMENT)
    return m[cut].view(np.int64), cut, ends + length - 1


class RankBits:
    """Packed bits with the count of ones before each word."""

    def __init__(self, bits: np.ndarray):
        pad = np.zeros(-len(bits) % 64 + 64, np.uint8)
        self.words = np.packbits(np.concatenate([bits, pad]), bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)

    def place(self, nth: np.ndarray) -> np.ndarray:
        """Where the nth one (from 0) stands."""
        w = np.searchsorted(self.before, nth, "right") - 1
        left, word = nth - self.before[w], self.words[w].copy()
        out = w.astype(np.int64) << 6
        for size in (32, 16, 8, 4, 2, 1):  # halves of the word: is it in the lower one
            low = np.bitwise_count(word & np.uint64((1 << size) - 1)).astype(np.int64)
            up = left >= low
            left = np.where(up, left - low, left)
            out += np.where(up, size, 0)
            word = np.where(up, word >> np.uint64(size), word)
        return out


class FmIndex:
    """FM-index of texts with owners. low, high: least and greatest owner of each text; where they differ, the whole text is shared.

    Rows are the sorted suffixes. Beside the BWT there are three bits for each row: whether it begins another stretch of ``length`` characters than the row
    before, whether its text has another owner than that of the row before, and whether its text has several owners.
    """

    def __init__(self, texts: list[str], low: np.ndarray, high: np.ndarray, length: int):
        parts = [codes_of(t) for t in texts]
        flat = np.concatenate([x for p in parts for x in (p.astype(np.uint32) + 1, np.zeros(1, np.uint32))])
        starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])[:-1]])
        self.alphabet, text = np.unique(flat, return_inverse=True)
        text, n, sigma = text.astype(np.int64), len(text), len(self.alphabet)
        self.length, self.n = length, n
        # ranks of prefixes of doubling length; beyond the end counts as smallest
        rank, depth = text + 1, 1

        def refine(r, shift):
            nxt = np.zeros(n, np.int64)
            nxt[: n - shift] = r[shift:]
            return np.unique(r * (r.max() + 1) + nxt, return_inverse=True)[1] + 1

        while depth * 2 <= length:
            rank, depth = refine(rank, depth), depth * 2
        stretch = refine(rank, length - depth) if length > depth else rank
        suffix = np.argsort(refine(rank, depth), kind="stable")
        b = stretch[suffix]
        self.begins = RankBits(np.concatenate([[1], b[1:] != b[:-1]]).astype(np.uint8))
        of = np.searchsorted(starts, suffix, "right") - 1
        own = low[of]
        self.changes = RankBits(np.concatenate([[0], own[1:] != own[:-1]]).astype(np.uint8))
        self.several = RankBits((low != high)[of].astype(np.uint8))
        self.blocks = int(self.begins.ones(np.array([n]))[0])
        # wavelet matrix of the BWT
        seq = text[suffix - 1]
        self.levels, self.zeros = [], []
        self.bits = max(1, int(sigma - 1).bit_length())
        for level in range(self.bits - 1, -1, -1):
            on = (seq >> level & 1).astype(np.uint8)
            self.levels.append(RankBits(on))
            self.zeros.append(int(len(on) - on.sum()))
            seq = np.concatenate([seq[on == 0], seq[on == 1]])
        count = np.bincount(text, minlength=sigma)
        self.before = np.concatenate([[0], np.cumsum(count)[:-1]])
        self.origin = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.ones(i)
            i = np.where(c >> (self.bits - 1 - k) & 1, zeros + ones, i - ones)
        return i

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: intervals of c + pattern from those of the patterns."""
        both = self._walk(np.concatenate([c, c]), np.concatenate([lo, hi])) + np.tile(self.before[c] - self.origin[c], 2)
        return both[: len(c)], both[len(c) :]

    def cut_back(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the first ``length`` characters of patterns that are longer."""
        last = self.begins.ones(hi)  # stretches that begin before hi
        first = self.begins.place(self.begins.ones(lo + 1) - 1)
        end = np.where(last < self.blocks, self.begins.place(np.minimum(last, self.blocks - 1)), self.n)
        return first, end

    def shared(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Do the rows have two owners. A text with several owners counts by that; owners beyond its least and greatest need not be known."""
        return (self.changes.ones(hi) > self.changes.ones(lo + 1)) | (self.several.ones(hi) > self.several.ones(lo))

    def stream(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, which of its stretches are shared. The texts must be among those indexed, and no shorter than the stretch length."""
        parts = [np.searchsorted(self.alphabet, codes_of(t).astype(np.uint32) + 1) for t in texts]
        order = np.argsort([-len(p) for p in parts], kind="stable")
        sizes = np.array([len(parts[k]) for k in order])
        flat = np.concatenate([parts[k] for k in order])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        ends = starts + sizes
        lo, hi = np.zeros(len(order), np.int64), np.full(len(order), self.n, np.int64)
        marks = np.zeros(len(flat), bool)
        for step in range(1, int(sizes[0]) + 1):
            live = int(np.searchsorted(-sizes, -step, "right"))
            at = ends[:live] - step
            lo, hi = self.extend(flat[at], lo[:live], hi[:live])
            if step >= self.length:
                lo, hi = self.cut_back(lo, hi)
                marks[at] = self.shared(lo, hi)
        out: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
        for k, a, n in zip(order, starts, sizes):
            out[k] = marks[a : a + n - self.length + 1]
        return out


def runs(flags: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of characters that lie in a marked stretch."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    new = np.concatenate([[True], at[1:] > at[:-1] + length])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])
    return list(zip(at[new].tolist(), (at[last] + length).tolist()))


def _both_owners(places: DataFrame) -> DataFrame:
    """Rows of (anchor, low, high, ...) whose anchor has two owners. A frequent anchor is met in ``SALTS`` parts, by ``salt``."""
    part = places.groupBy("anchor", "salt").agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    common = part.groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("anchor")
    return places.join(part.select("anchor", "salt").join(common, "anchor"), ["anchor", "salt"])


def _resolve(texts: DataFrame, length: int, ks: list[int], scratch: Scratch) -> DataFrame:
    """(anchor, tkey, x, y): shared runs of the texts (anchor, tkey, text, low, high), which are distinct and meet by anchor only.

    ks: gram lengths by which the texts of an anchor that exceed an index are cut again, the last being ``length``, whose segments are single stretches.
    """
    weight = texts.groupBy("anchor").agg(F.sum(F.length("text") + 1).alias("w"), F.min("low").alias("lo"), F.max("high").alias("hi")).filter("lo < hi")
    weight = scratch.save(weight.select("anchor", "w"))
    limit = SHARD_CHARS // 2
    hot = F.lit(False) if not ks else F.col("w") > limit
    total, many = weight.agg(F.sum(F.when(~hot, F.col("w"))), F.count(F.when(hot, 1))).first()
    shards = max(1, math.ceil(2 * (total or 0) / SHARD_CHARS))
    calm = texts.join(weight.filter(~hot).select("anchor"), "anchor").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int"))

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        # one text may stand at several anchors: it is indexed once, with all its owners
        g = frame.groupby("text", sort=False).agg(low=("low", "min"), high=("high", "max"))
        index = FmIndex(list(g.index), g["low"].to_numpy(), g["high"].to_numpy(), length)
        flags = dict(zip(g.index, index.stream(list(g.index))))
        rows = [(a, tk, x, y) for a, tk, t in zip(frame["anchor"], frame["tkey"], frame["text"]) for x, y in runs(flags[t], length)]
        return pd.DataFrame(rows, columns=["anchor", "tkey", "x", "y"])

    found = calm.groupBy("shard").applyInPandas(match, "anchor long, tkey long, x int, y int")
    if not many:
        return scratch.save(found)
    k = ks[0]

    def cut(batches):
        for b in batches:
            for a, tk, t, lo, hi in zip(b["anchor"], b["tkey"], b["text"], b["low"], b["high"]):
                sub, s, e = segments(t, length, k)
                yield pd.DataFrame({"parent": a, "ptkey": tk, "anchor": sub, "s": s.astype("int32"), "text": [t[x:y] for x, y in zip(s, e)], "low": lo, "high": hi})

    heavy = texts.join(weight.filter(hot).select("anchor"), "anchor").select("anchor", "tkey", "text", "low", "high")
    parts = heavy.mapInPandas(cut, "parent long, ptkey long, anchor long, s int, text string, low long, high long")
    # the wider anchor belongs to the key: its texts are the only ones that can be equal
    parts = parts.withColumns({"anchor": F.xxhash64("parent", "anchor"), "tkey": F.xxhash64("text"), "salt": F.pmod(F.xxhash64("ptkey"), F.lit(SALTS)).cast("int")})
    parts = scratch.save(_both_owners(scratch.save(parts)))
    inner = scratch.save(parts.groupBy("anchor", "tkey", "text").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    deeper = _resolve(inner, length, ks[1:], scratch)
    back = parts.select("parent", "ptkey", "anchor", "tkey", "s").join(deeper, ["anchor", "tkey"]).select(F.col("parent").alias("anchor"), F.col("ptkey").alias("tkey"), (F.col("s") + F.col("x")).alias("x"), (F.col("s") + F.col("y")).alias("y"))
    return scratch.save(found.unionAll(back))


def shared_spans(records: DataFrame, owner: Column, keys: list[str], text: Column, length: int = 200, k: int = 64) -> DataFrame:
    """keys, start_pos, end_pos: maximal runs of characters in stretches of at least ``length`` that also occur under another owner.

    Positions are 0-based characters, end exclusive. keys identify a text; repeated rows are merged. Texts that are null or shorter than ``length``
    have no run, nor have rows without owner. Repeats within one owner do not count. Whole texts are indexed, of any characters; long ones are cut with overlap.

    A minimiser that many texts share (boilerplate in a third of all rows) is not sent to one task: its places are joined in parts, and its texts, once
    equal ones are folded, are cut again by the minimisers of longer grams until they fit an index.
    """
    scratch = Scratch(records.sparkSession, "spans")
    base = records.select(*keys, owner.alias("_owner"), text.alias("_text")).filter(f"_owner is not null and length(_text) >= {length}")
    base = base.withColumn("_doc", F.xxhash64(*keys)).withColumn("_by", F.xxhash64("_owner"))

    def cut(batches):
        for b in batches:
            out = [[], [], [], [], []]
            for d, o, t in zip(b["_doc"], b["_by"], b["_text"]):
                a, s, e = segments(t, length, k)
                for col, v in zip(out, (a, np.full(len(a), o), np.full(len(a), d), s, e)):
                    col.append(v)
            if out[0]:
                yield pd.DataFrame(dict(zip(("anchor", "owner", "doc", "s", "e"), map(np.concatenate, out))))

    pieces = scratch.save(base.select("_doc", "_by", "_text").mapInPandas(cut, "anchor long, owner long, doc long, s int, e int"))
    salted = pieces.select("anchor", "doc", "s", "e", F.col("owner").alias("low"), F.col("owner").alias("high"), F.pmod("doc", F.lit(SALTS)).cast("int").alias("salt"))
    kept = _both_owners(salted).groupBy("doc").agg(F.collect_set(F.struct("anchor", "s", "e")).alias("seg"))
    cut_out = F.expr("substring(_text, s + 1, e - s)")
    held = scratch.save(
        base.join(kept, base["_doc"] == kept["doc"]).select(*keys, "_by", "_text", F.explode("seg").alias("g")).select(*keys, "_by", "_text", "g.*")
        .select(*keys, F.col("_by").alias("owner"), "anchor", F.col("s").alias("at"), cut_out.alias("text")).withColumn("tkey", F.xxhash64("text"))
    )
    scratch.drop(pieces)
    distinct = scratch.save(held.groupBy("anchor", "tkey", "text").agg(F.min("owner").alias("low"), F.max("owner").alias("high")))
    finer = sorted({k + (length - k) // 2, length - (length - k) // 6, length} - {k})
    found = _resolve(distinct, length, finer, scratch)
    placed = scratch.save(held.select(*keys, "anchor", "tkey", "at").join(found.distinct(), ["anchor", "tkey"]).select(*keys, (F.col("at") + F.col("x")).alias("s"), (F.col("at") + F.col("y")).alias("e")))
    scratch.keep(placed)
    # touching intervals of one text join: a run begins where none before reaches, and ends before the next begins
    w = Window.partitionBy(*keys).orderBy("s", "e")
    rows = placed.distinct().withColumn("reach", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("new", F.when(F.col("reach").isNull() | (F.col("s") > F.col("reach")), 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(*keys, "run").agg(F.min("s").alias("start_pos"), F.max("e").alias("end_pos")).drop("run")
