"""Filling containers of fixed capacity: minimum bin slack over the histogram of item lengths.

Bins are planned on counts per length, of which there are at most ``capacity``, so the driver's state does not grow
with the data: each planned pattern (a multiset of lengths) is repeated as long as the lengths last. Items then
find their place by their rank among items of equal length, which is counted in parts: a length that most items have is not ranked in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from histloom.tables import Scratch

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the byte-level vocabularies (a fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict[str, object] = {}


def encoder(path: str, content: bytes | None = None):
    """The tokenizer of a rank file, loaded once in each process; ``content``, if given, is the file's."""
    if path not in _ENCODERS:
        import base64

        import tiktoken

        content = content if content is not None else read_file(path)
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines())}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def with_token_counts(documents: DataFrame, doc_id: Column, text: Column, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of whole texts; a null text has 0 tokens. The rank file (of fixed size) is read on the driver and sent to the executors."""
    d = documents.select(doc_id.alias("doc_id"), text.alias("text"))
    sent = d.sparkSession.sparkContext.broadcast(read_file(tokenizer))

    def count(batches):
        enc = encoder(tokenizer, sent.value)
        for b in batches:
            n = [len(x) for x in enc.encode_ordinary_batch([t or "" for t in b["text"]], num_threads=1)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": n})

    return d.mapInPandas(count, f"doc_id {dict(d.dtypes)['doc_id']}, tokens long")


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """The lengths, with repeats within ``counts``, whose sum is the greatest that fits in ``room``.

    Bitset subset-sum: bit s of the set is on where sum s can be reached. Lengths enter from the longest; the sets
    before each step are kept to walk back the choice.
    """
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for size in sorted((s for s in counts if 0 < s <= room), reverse=True):
        left, chunk = min(counts[size], room // size), 1
        while left:
            take = min(chunk, left)
            new = (reach | (reach << (size * take))) & mask
            if new != reach:
                steps.append((reach, size, take))
                reach = new
            left -= take
            chunk *= 2
        if reach >> room:
            break
    best, out = reach.bit_length() - 1, []
    for before, size, take in reversed(steps):
        if not before >> best & 1:
            out += [size] * take
            best -= size * take
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns with how often each is used; together they take every item exactly once.

    Each bin is seeded with the longest length left, and the rest of it filled as full as can be. A pattern is
    repeated while its lengths last, so the number of patterns is bounded by the number of lengths, not of items.
    """
    counts = {s: n for s, n in histogram.items() if n}
    out = []
    while counts:
        seed = max(counts)
        rest = dict(counts)
        rest[seed] -= 1
        pattern = [seed, *fullest({s: n for s, n in rest.items() if n}, capacity - seed)]
        uses = {s: pattern.count(s) for s in set(pattern)}
        times = min(counts[s] // k for s, k in uses.items())
        for s, k in uses.items():
            counts[s] -= k * times
            if not counts[s]:
                del counts[s]
        out.append((pattern, times))
    return out


def pack(items: DataFrame, item_id: Column, size: Column, capacity: int, part_items: int = 500_000) -> DataFrame:
    """(item_id, piece, size, container, place, start): every item's container and place in it.

    No item is cut unless it is longer than the capacity; such an item gives full pieces, each a container of its
    own, and a rest that is packed like an item. Items of size 0 or null need no room and get container -1, place
    0. ``place`` counts the pieces in a container, ``start`` is the piece's offset in it. Rows with equal ids are
    packed each; ids must be orderable. Containers are numbered from 0; those of full pieces lie above the others and may leave numbers out.
    ``part_items``: about so many pieces are ranked in one part. The items are evaluated once, and kept as a table.
    """
    scratch = Scratch(items.sparkSession, "packing")
    it = scratch.save(items.select(item_id.alias("item_id"), F.coalesce(size, F.lit(0)).cast("long").alias("size")))
    empty = it.filter("size <= 0").select("item_id", F.lit(0).alias("piece"), "size", F.lit(-1).cast("long").alias("container"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("start"))
    whole = F.expr(f"cast(size div {capacity} as int)")
    rest = it.filter(f"size > 0 and size % {capacity} > 0").select("item_id", whole.alias("piece"), (F.col("size") % capacity).alias("size"))
    n, full = it.agg(F.count(F.when(F.col("size") % capacity > 0, 1)), F.sum(whole)).first()
    parts = max(1, -(-n // part_items))
    rest = rest.withColumn("part", F.pmod(F.xxhash64("item_id", "piece"), F.lit(parts)))
    per = scratch.save(rest.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["size"]: r["n"] for r in per.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # fewer than ``capacity`` rows
    # for each length, runs of ranks: from, first container, items of this length in each container, their place and start
    runs: dict[int, list[tuple[int, int, int, int, int]]] = {}
    used, container = {}, 0
    for pattern, times in plan(histogram, capacity):
        start = place = 0
        for s in sorted(set(pattern), reverse=True):
            k = pattern.count(s)
            runs.setdefault(s, []).append((used.get(s, 0), container, k, place, start))
            used[s] = used.get(s, 0) + k * times
            start, place = start + k * s, place + k
        container += times
    sent = it.sparkSession.sparkContext.broadcast({s: np.array(r, np.int64) for s, r in runs.items()})
    before = per.select("size", "part", F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    order = Window.partitionBy("size", "part").orderBy("item_id", "piece")
    ranked = rest.withColumn("rank", F.row_number().over(order) - 1).join(before, ["size", "part"]).select("item_id", "piece", "size", (F.col("rank") + F.col("before")).alias("rank"))

    def assign(batches):
        lookup = sent.value
        for b in batches:
            size, rank = b["size"].to_numpy(), b["rank"].to_numpy()
            out = np.zeros((len(b), 3), np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                r = lookup[int(s)]
                run = r[np.searchsorted(r[:, 0], rank[at], "right") - 1]
                off = rank[at] - run[:, 0]
                out[at, 0] = run[:, 1] + off // run[:, 2]
                out[at, 1] = run[:, 3] + off % run[:, 2]
                out[at, 2] = run[:, 4] + off % run[:, 2] * s
            yield pd.DataFrame({"item_id": b["item_id"], "piece": b["piece"], "size": size, "container": out[:, 0], "place": out[:, 1].astype("int32"), "start": out[:, 2]})

    kind = dict(it.dtypes)["item_id"]
    out = ranked.mapInPandas(assign, f"item_id {kind}, piece int, size long, container long, place int, start long").unionByName(empty)
    scratch.keep(it, per)
    if full:  # a full piece needs no rank: its row's number in the table is a container
        cut = it.filter(f"size >= {capacity}").select("item_id", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"), F.lit(capacity).cast("long").alias("size"))
        out = out.unionByName(cut.withColumns({"container": F.monotonically_increasing_id() + container, "place": F.lit(0), "start": F.lit(0).cast("long")}))
    return out
