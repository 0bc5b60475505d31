"""Subject areas of documents: averaged word and subword embeddings with independent logistic outputs.

A text is the weighted mean of the embeddings of its words and of the five-letter pieces of its words, both hashed into a table of fixed size, so
there is no vocabulary that words could be missing from: an unknown word is read by its pieces. The weight is the count times the inverse
document frequency of the place in the table, over all documents (a document counts for a place once for each of its words that has it). Embeddings begin at zero, so a place that no labelled text touches says nothing.
Each subject has its own logistic output. Training is synchronous: in every step each partition computes the gradient over its labelled
documents, the gradients are added, and one Adam step is made.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom.tables import Scratch

WORD = re.compile(r"[^\W\d_]{2,}")
CAMEL = re.compile(r"(?<=[^\W\d_A-Z])(?=[A-Z])")
GARBLED = re.compile("[ÃÂ][\u0080-¿‘-›Š-ž€™]|â€")


def clean(text: str) -> str:
    """Entities resolved and wrongly decoded accents repaired."""
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return text
    if GARBLED.search(text):
        for code in ("cp1252", "latin-1"):
            try:
                return text.encode(code).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
    return text


def words(text: str | None) -> Counter:
    """The words of a text in lower case, with their counts; compounds in camel case and with underscores are taken apart."""
    return Counter(WORD.findall(CAMEL.sub(" ", clean(text or "")).lower()))


class Features:
    """Places in the table and weights of a text's words and pieces."""

    def __init__(self, buckets: int, idf: np.ndarray | None = None):
        self.buckets, self.idf, self.memo = buckets, idf, {}

    def places(self, word: str) -> tuple:
        """The places of a word and of its pieces, each with its share; the pieces weigh as much as the word together."""
        hit = self.memo.get(word)
        if hit is None:
            raw = lambda x: zlib.crc32(x.encode("utf-8", "surrogatepass")) % self.buckets
            at = [(raw(word), 1.0)]
            if len(word) > 4:
                z = f"<{word}>"
                n = len(z) - 4
                at += [(raw("#" + z[i : i + 5]), 1.0 / n) for i in range(n)]
            hit = tuple(at)
            if len(self.memo) < 500_000:
                self.memo[word] = hit
        return hit

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct places and their weights, as parts of the length of the text's word weights."""
        acc: dict[int, float] = {}
        square = 0.0
        for w, n in words(text).items():
            k = 1.0 + math.log(n)
            for p, f in self.places(w):
                x = k * f * self.idf[p]
                acc[p] = acc.get(p, 0.0) + x
                square += x * x
        if square <= 0:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        return np.fromiter(acc, np.int32, len(acc)), (np.fromiter(acc.values(), np.float64, len(acc)) / math.sqrt(square)).astype(np.float32)


class WordVectors:
    """What each word adds to a text's mean: the same sums as over places, made once for each word."""

    def __init__(self, features: Features, table: np.ndarray, most: int = 500_000):
        self.features, self.table, self.most, self.at = features, table, most, {}
        self.vectors, self.squares = np.zeros((1024, table.shape[1]), np.float32), np.zeros(1024)

    def _index(self, word: str) -> int:
        k = self.at.get(word)
        if k is None:
            k = len(self.at)
            if k == len(self.squares):
                self.vectors, self.squares = np.concatenate([self.vectors, np.zeros_like(self.vectors)]), np.concatenate([self.squares, np.zeros_like(self.squares)])
            places = self.features.places(word)
            c, x = np.array([p for p, _ in places]), np.array([f for _, f in places]) * self.features.idf[[p for p, _ in places]]
            self.vectors[k], self.squares[k] = x @ self.table[c], x @ x
            self.at[word] = k
        return k

    def mean(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The mean of each text, and whether it has any feature."""
        if len(self.at) > self.most:
            self.at.clear()
        out, has = np.zeros((len(texts), self.table.shape[1]), np.float32), np.zeros(len(texts), bool)
        for i, t in enumerate(texts):
            n = words(t)
            if n:
                at = [self._index(w) for w in n]
                k = 1.0 + np.log(np.fromiter(n.values(), np.float64, len(n)))
                square = (k * k) @ self.squares[at]
                if square > 0:
                    out[i], has[i] = k @ self.vectors[at] / math.sqrt(square), True
        return out, has


def mean_of(table: np.ndarray, cols: list[np.ndarray], vals: list[np.ndarray]) -> np.ndarray:
    """Weighted sums of table rows, one for each text; zero where a text has no feature."""
    out = np.zeros((len(cols), table.shape[1]), np.float32)
    for i, (c, v) in enumerate(zip(cols, vals)):
        if len(c):
            out[i] = v @ table[c]
    return out


class Model:
    """Embedding table, output weights and biases."""

    def __init__(self, table, weights, bias):
        self.parts = [table, weights, bias]

    @classmethod
    def fresh(cls, buckets: int, dim: int, subjects: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        return cls(np.zeros((buckets, dim), np.float32), rng.normal(0, 0.05, (dim, subjects)).astype(np.float32), np.full(subjects, -2.0, np.float32))

    def scores(self, means: np.ndarray) -> np.ndarray:
        _, weights, bias = self.parts
        return 1 / (1 + np.exp(-(means @ weights + bias)))

    def gradient(self, cols, vals, labels: np.ndarray, drop: float = 0.0, rng: np.random.Generator | None = None) -> list[np.ndarray]:
        """Summed gradient of the logistic losses over the given texts, each with a share ``drop`` of its features left out at random."""
        table, weights, bias = self.parts
        if drop:
            keep = [rng.random(len(c)) >= drop for c in cols]
            cols, vals = [c[k] for c, k in zip(cols, keep)], [v[k] / (1 - drop) for v, k in zip(vals, keep)]
        h = mean_of(table, cols, vals)
        g = (1 / (1 + np.exp(-(h @ weights + bias))) - labels).astype(np.float32)
        back = g @ weights.T
        grad = np.zeros_like(table)
        for c, v, b in zip(cols, vals, back):
            grad[c] += v[:, None] * b  # the positions of one text are distinct
        return [grad, h.T @ g, g.sum(0)]


def document_frequencies(documents: DataFrame, buckets: int) -> np.ndarray:
    """Inverse document frequency of each place of the table, over all documents; what comes to the driver is a number for each place."""

    def count(batches):
        f, n = Features(buckets), 0
        seen, total = Counter(), np.zeros(buckets, np.int64)

        def settle():
            for w, k in seen.items():
                for p, _ in f.places(w):
                    total[p] += k
            seen.clear()

        for b in batches:
            for t in b["text"]:
                seen.update(words(t).keys())
            if len(seen) > 500_000:
                settle()
            n += len(b)
        settle()
        at = np.flatnonzero(total)
        yield pd.DataFrame({"place": np.concatenate([at, [-1]]), "n": np.concatenate([total[at], [n]])})

    got = documents.select("text").mapInPandas(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    df, n = np.ones(buckets), 0
    for p, k in zip(got["place"], got["n"]):
        if p < 0:
            n = k
        else:
            df[p] = k
    return np.maximum(np.log((n + 1) / df), 0).astype(np.float32)


def train(labelled: DataFrame, subjects: list[str], features: Features, dim: int, steps: int, rate: float, part_docs: int, drop: float) -> Model:
    """labelled: text, subjects (array). Synchronous data-parallel training; features are left out at random by step and partition."""
    spark = labelled.sparkSession
    scratch = Scratch(spark, "subjects")
    where = {s: i for i, s in enumerate(subjects)}
    model = Model.fresh(features.buckets, dim, len(subjects))
    parts = -(-labelled.count() // part_docs)
    if not parts:
        return model
    sent = spark.sparkContext.broadcast(features)

    def prepare(batches):
        for b in batches:
            rows = []
            for k, t, ss in zip(b["part"], b["text"], b["subjects"]):
                c, v = sent.value.of(t)
                y = np.zeros(len(where), np.float32)
                for s in ss:
                    if s in where:
                        y[where[s]] = 1
                rows.append((k, c.tobytes(), v.tobytes(), y.tobytes()))
            yield pd.DataFrame(rows, columns=["part", "c", "v", "y"])

    rows = labelled.select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"), "doc_id", "text", "subjects").repartition(parts, "part").sortWithinPartitions("part", "doc_id")
    data = scratch.save(rows.mapInPandas(prepare, "part int, c binary, v binary, y binary"))
    total = data.count()
    m, v = [np.zeros_like(p) for p in model.parts], [np.zeros_like(p) for p in model.parts]
    for step in range(1, steps + 1):
        now = spark.sparkContext.broadcast(model.parts)

        def slope(batches, now=now, step=step):
            model, acc, part, rng = Model(*now.value), None, -1, None
            for b in batches:
                if not len(b):
                    continue
                part = max(part, int(b["part"].iloc[0]))
                rng = rng or np.random.default_rng((step, part))
                take = lambda c, t: [np.frombuffer(x, t) for x in b[c]]
                g = model.gradient(take("c", np.int32), take("v", np.float32), np.stack(take("y", np.float32)), drop, rng)
                acc = g if acc is None else [x + y for x, y in zip(acc, g)]
            if acc is not None:
                # only the rows that some text touches are sent
                live = np.flatnonzero(np.abs(acc[0]).sum(1)).astype(np.int32)
                yield pd.DataFrame({"part": [part], "live": [live.tobytes()], "e": [acc[0][live].tobytes()], "w": [acc[1].tobytes()], "b": [acc[2].tobytes()]})

        grads = sorted(data.mapInPandas(slope, "part int, live binary, e binary, w binary, b binary").collect(), key=lambda r: (r["part"], r["w"]))
        g = [np.zeros_like(p) for p in model.parts]
        for r in grads:
            live = np.frombuffer(r["live"], np.int32)
            g[0][live] += np.frombuffer(r["e"], np.float32).reshape(-1, dim)
            g[1] += np.frombuffer(r["w"], np.float32).reshape(dim, -1)
            g[2] += np.frombuffer(r["b"], np.float32)
        for i, (p, d) in enumerate(zip(model.parts, g)):
            d = d / total * len(subjects)
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.999 * v[i] + 0.001 * d * d
            model.parts[i] = (p - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        now.destroy()
    scratch.drop(data)
    return model


def assign(
    documents: DataFrame, doc_id: Column, text: Column, labels: DataFrame, label_doc: Column, label: Column, subjects: list[str],
    buckets: int = 1 << 16, dim: int = 16, steps: int = 50, rate: float = 0.05, part_docs: int = 1000, drop: float = 0.9, threshold: float = 0.15, max_labelled: int = 20_000,
) -> DataFrame:
    """(doc_id, subject, score): every subject whose score reaches ``threshold``; a document may have several or none.

    labels: hand labels, possibly repeated or partly wrong; a document with labels counts as fully labelled. Labels that are not in ``subjects`` or
    without document are left out. At most ``max_labelled`` labelled documents, chosen by hash, are used for fitting (the bound documented for the classifier),
    ``part_docs`` of them in a task; document frequencies and scores cover all documents and whole texts, and no word is left out. Null and empty texts
    have no feature and get no subject. Without labels the result is empty. Subjects are a short fixed list. drop: share of the features left out at random in each step.
    """
    d = documents.select(doc_id.alias("doc_id"), text.alias("text"))
    known = labels.select(label_doc.alias("doc_id"), label.alias("subject")).filter(F.col("doc_id").isNotNull() & F.col("subject").isin(subjects))
    known = known.groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    features = Features(buckets, document_frequencies(d, buckets))
    # read once: a bounded table
    fit = Scratch(d.sparkSession, "labelled").save(d.filter("text is not null").join(known, "doc_id"))
    model = train(fit, subjects, features, dim, steps, rate, part_docs, drop)
    sent = d.sparkSession.sparkContext.broadcast((features, model.parts, subjects))
    kind = dict(d.dtypes)["doc_id"]
    fitted = known.limit(1).count() > 0

    def score(batches):
        features, parts_, names = sent.value
        m, vectors = Model(*parts_), WordVectors(features, parts_[0])
        for b in batches:
            means, has = vectors.mean(b["text"].tolist())
            p = m.scores(means)
            r, s = np.nonzero((p >= threshold) & has[:, None])
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[r], "subject": np.array(names, object)[s], "score": p[r, s].astype(float)})

    out = d.filter("doc_id is not null and text is not null").mapInPandas(score, f"doc_id {kind}, subject string, score double")
    return out.groupBy("doc_id", "subject").agg(F.max("score").alias("score")) if fitted else out.limit(0)
