"""Evaluation passages in training text: SimHash windows, multi-index Hamming lookup, verification by weighted shingles.

Items are cut into windows of two kinds: of ``words`` words, the shortest passage that counts, and item-sized ones, of the largest of a few sizes that
fits the item with some room, so that a whole item is found although some words were changed. Fingerprints are 64-bit SimHashes of a window's words.
A fingerprint is cut into radius + 1 blocks: two within the radius agree in at least one whole block, so looking up each block finds all of them.
A candidate is a leak if the weighted Jaccard similarity of the five-word shingles of both windows reaches the bound; a shingle weighs the more the
fewer items hold it. How many consecutive words of the item stand in the document is then counted on the words themselves.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
BITS = 64
#: Items are looked up in blocks of at most so many bytes of text, so what is sent to executors is bounded.
ITEM_BLOCK_BYTES = 4 << 20
#: Item-sized windows are looked up at every eighth word of a document; an item has windows at eight neighbouring places at least, so one of them is met.
STRIDE = 8


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits in lower case; an underscore separates."""
    return WORD.findall(text.lower()) if text else []


class Codes(dict):
    """A 64-bit code for each word, the same in every process."""

    def __missing__(self, word: str) -> int:
        b = word.encode("utf-8", "surrogatepass")
        x = zlib.crc32(b) | zlib.adler32(b + b"\x01") << 32
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 31
        if len(self) < 1_000_000:
            self[word] = x
        return x

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def running_signs(codes: np.ndarray) -> np.ndarray:
    """Sums of the words' bits before each word, modulo 2^16: windows are shorter than that, so their sums are exact."""
    signs = np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1)
    total = np.zeros((len(codes) + 1, BITS), np.uint16)
    np.cumsum(signs, axis=0, dtype=np.uint16, out=total[1:])
    return total


def simhash(total: np.ndarray, size: int, stride: int = 1) -> np.ndarray:
    """Fingerprints of the windows of ``size`` words that begin at every ``stride``-th word, from the running sums."""
    if len(total) <= size:
        return np.zeros(0, np.uint64)
    up = total[size::stride] - total[: len(total) - size : stride] > size // 2
    return np.packbits(up, axis=1).view(np.uint64).reshape(-1)


def shingles(words: list[str], k: int = 5) -> Counter:
    return Counter(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def similarity_of(a: Counter, b: Counter, weight) -> float:
    """Weighted Jaccard similarity of two counted sets of shingles."""
    both = sum(weight(g) * n for g, n in (a & b).items())
    return both / max(1e-12, sum(weight(g) * n for g, n in (a | b).items()))


def item_sizes(length: int, least: int) -> list[int]:
    """Window sizes for an item: the least, and the largest of the sizes (each half as long again) that leaves ``STRIDE`` places."""
    out, size = [least] if length >= least else [], least
    while size * 3 // 2 <= length - STRIDE + 1:
        size = size * 3 // 2
    return out + [size] if size > least and out else out


class WindowIndex:
    """Fingerprints of all item windows, found by any block of bits; one table for each window size."""

    def __init__(self, items: list[tuple[object, str]], least: int, radius: int):
        self.least, self.radius, codes = least, radius, Codes()
        self.ids, self.words = [i for i, _ in items], [words_of(t) for _, t in items]
        held = Counter(g for w in self.words for g in shingles(w))
        self.weights = {g: math.log(1 + len(items) / n) for g, n in held.items()}
        self.most = math.log(1 + len(items))
        edges = np.linspace(0, BITS, radius + 2).astype(int)
        self.cuts = [(np.uint64(a), np.uint64((1 << int(b - a)) - 1)) for a, b in zip(edges, edges[1:])]
        parts: dict[int, list] = {}
        for k, w in enumerate(self.words):
            total = running_signs(codes.of(w))
            for size in item_sizes(len(w), least):
                f = simhash(total, size)
                parts.setdefault(size, []).append((f, np.full(len(f), k), np.arange(len(f))))
        self.tables = {}
        for size, p in parts.items():
            prints, owner, start = map(np.concatenate, zip(*p))
            sorts = []
            for shift, mask in self.cuts:
                key = (prints >> shift) & mask
                order = np.argsort(key, kind="stable")
                sorts.append((key[order], order))
            self.tables[size] = prints, owner, start, sorts

    def weight(self, shingle: tuple) -> float:
        return self.weights.get(shingle, self.most)

    def near(self, size: int, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item window) within the radius, each once."""
        prints, _, _, sorts = self.tables[size]
        found = []
        for (shift, mask), (keys, order) in zip(self.cuts, sorts):
            k = (f >> shift) & mask
            lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
            n = hi - lo
            at = np.repeat(np.arange(len(f)), n)
            item = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            ok = np.bitwise_count(f[at] ^ prints[item]) <= self.radius
            found.append(at[ok] * len(prints) + item[ok])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(prints), pairs % len(prints)

    def matches(self, docs: list[list[str]], codes: Codes, least_similarity: float):
        """(document, item, place, item place, size, similarity) of every window pair within the radius that is similar enough."""
        flat = [w for ws in docs for w in ws]
        ends = np.cumsum([len(ws) for ws in docs])
        total = running_signs(codes.of(flat))
        for size, (_, owner, start, _) in self.tables.items():
            step = 1 if size == self.least else STRIDE
            f = simhash(total, size, step)
            if not len(f):
                continue
            at, item = self.near(size, f)
            at = at * step
            doc = np.searchsorted(ends, at, "right")
            inside = at + size <= ends[doc]
            for p, m, d in zip(at[inside].tolist(), item[inside].tolist(), doc[inside].tolist()):
                mine, own = flat[p : p + size], self.words[owner[m]][start[m] : start[m] + size]
                s = 1.0 if mine == own else similarity_of(shingles(mine), shingles(own), self.weight)
                if s >= least_similarity:
                    yield d, int(owner[m]), p, int(start[m]), size, s


def longest_run(pairs: list[tuple[int, int]], least: int) -> int:
    """Words of the longest passage, from the (place, item place) of equal windows of ``least`` words; 0 if there is none."""
    best, runs = 0, {}
    for p, q in sorted(set(pairs)):
        runs[p, q] = runs.pop((p - 1, q - 1), least - 1) + 1
        best = max(best, runs[p, q])
    return best


def leaked(
    documents: DataFrame, doc_id: Column, text: Column, items: DataFrame, item_id: Column, item_text: Column, words: int = 13, radius: int = 3, similarity: float = 0.8
) -> DataFrame:
    """(doc_id, item_id, similarity, passages, longest): documents that hold passages of an item, word for word or nearly.

    similarity: of the most similar window, at least ``similarity``. passages: places of the document where ``words`` consecutive words of the item begin; longest: words of
    the longest passage, both 0 where all that was found is edited. Every passage of ``words`` words or more is found; edited ones are as far as their
    fingerprints stay within ``radius``. Words are runs of letters and digits, compared without case, whatever stands between them. Null or short texts have
    no window and give no row, nor do items shorter than ``words``. Repeated document or item rows are merged. Documents are scanned
    whole; items are taken in blocks of bounded size, each compared with every document by index lookups.
    """
    d = documents.select(doc_id.alias("doc_id"), text.alias("text")).filter("text is not null and doc_id is not null")
    q = items.select(item_id.alias("item_id"), item_text.alias("text")).filter("text is not null and item_id is not null").dropDuplicates()
    kinds = dict(d.dtypes)["doc_id"], dict(q.dtypes)["item_id"]
    total = q.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(2 * total / ITEM_BLOCK_BYTES))
    out = None
    for part in range(parts):
        block = q.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else q
        index = WindowIndex([tuple(r) for r in block.sort("item_id", "text").collect()], words, radius)
        sent = d.sparkSession.sparkContext.broadcast(index)

        def scan(batches, sent=sent):
            ix, codes = sent.value, Codes()
            for b in batches:
                ids, texts = b["doc_id"].tolist(), b["text"].tolist()
                for lo in range(0, len(ids) if ix.tables else 0, 256):
                    kept = [(i, w) for i, w in ((i, words_of(t)) for i, t in zip(ids[lo : lo + 256], texts[lo : lo + 256])) if len(w) >= ix.least]
                    if not kept:
                        continue
                    seen: dict[tuple[int, int], tuple[float, list]] = {}
                    for k, o, p, at, size, s in ix.matches([w for _, w in kept], codes, similarity):
                        best, exact = seen.get((k, o), (0.0, []))
                        if s == 1.0 and size == ix.least:
                            exact.append((p, at))
                        seen[k, o] = max(best, s), exact
                    rows = [(kept[k][0], ix.ids[o], s, len({p for p, _ in exact}), longest_run(exact, ix.least)) for (k, o), (s, exact) in seen.items()]
                    if rows:
                        yield pd.DataFrame(rows, columns=["doc_id", "item_id", "similarity", "passages", "longest"])

        found = d.mapInPandas(scan, f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, passages long, longest int")
        out = found if out is None else out.unionAll(found)
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("similarity", "passages", "longest")])
