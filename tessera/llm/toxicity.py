"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Examples are labelled documents that are not held out, at most `EXAMPLES` of them in the order of a hash of their id (a
documented bound; equal word sequences count once). Terms of a text are its words without outer punctuation, their
prefixes of four to six letters, and, for each of these that occurs twice or more, marks of how dense it is: at least
one in 256, 128, 64 or 32 words. The vectors hold the terms whose document frequency differs between the two labels
(chi-square of at least three times the logarithm of the number of terms tested, all of them: there is no cap). With all
other words in, the cosine finds texts of like language and topic, not of like label: measured in README.

Postings are kept in blocks of examples with the largest weight of each term in each block: blocks are scored exactly in
the order of their upper bounds until no other block can hold one of the `NEIGHBOURS` nearest. Their labels vote with
weights that fall with distance; a logistic curve fitted on the leave-one-out votes of the examples turns votes into
scores. The nearest examples are returned as evidence; ties go to the example that comes first in the index.

The index is of bounded size and is broadcast; every document is scored in place, without a shuffle, from its text
alone. Null and empty texts have no terms and get the score of examples without terms. Without examples every score is
0. Null labels and labels without a document are skipped; rows that share a doc_id are each an example with its label;
repeated rows are scored alike, rows without a doc_id are not held out; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches

EXAMPLES = 8000
RATES = (32, 64, 128, 256)  # a term is dense if it is one in so many words
NEIGHBOURS = 15
BLOCK = 32
THRESHOLD = 0.7
_OUTER = ".,;:!?\"'()[]{}*&%$#|<>"
_CACHE = 200_000


def terms(word: str) -> tuple[str, ...]:
    """The terms of one lower-case word."""
    w = word.strip(_OUTER)
    return (w, *(f"{w[:n]}*" for n in (4, 5, 6) if len(w) > n)) if w else ()


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def text_terms(words: list[str]) -> Counter:
    """How often each term occurs in a text of lower-case words; density marks once."""
    out: Counter = Counter()
    for w, n in Counter(words).items():
        for t in terms(w):
            out[t] += n
    for t, n in list(out.items()):
        if n > 1:
            for r in RATES:
                if n * r >= len(words):
                    out[f"{t}@{r}"] = 1
    return out


@dataclass
class Index:
    """Block-max inverted index of unit vectors."""

    ids: list  # of the examples, by place
    labels: np.ndarray
    term_of: dict[str, int]
    idf: np.ndarray
    start: np.ndarray  # (terms, blocks + 1) into at and weight
    at: np.ndarray
    weight: np.ndarray
    most: np.ndarray  # (terms, blocks): largest weight
    bare: float = 0.0  # the vote of texts without terms
    curve: tuple[float, float] = (1.0, 0.0)
    words: dict = field(default_factory=dict)
    bases: dict = field(default_factory=dict)  # of a term without its mark: its number or -1, and (rate, number) of its marks

    def __post_init__(self):
        for t, i in self.term_of.items():
            base, _, rate = t.rpartition("@")
            if base and rate.isdigit() and int(rate) in RATES:
                self.bases.setdefault(base, [-1]).append((int(rate), i))
            else:
                self.bases.setdefault(t, [-1])[0] = i

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and weights of a text, of unit length."""
        known, seen = self.words, Counter()
        words = text.lower().split()
        for w in words:
            if (ts := known.get(w)) is None:
                if len(known) > _CACHE:
                    known.clear()
                ts = known[w] = tuple(t for t in terms(w) if t in self.bases)
            if ts:
                seen.update(ts)
        counts: dict[int, int] = {}
        for t, n in seen.items():
            own, *marks = self.bases[t]
            if own >= 0:
                counts[own] = n
            for rate, i in marks:
                if n > 1 and n * rate >= len(words):
                    counts[i] = 1
        if not counts:
            return np.array([], dtype=int), np.array([])
        t = np.array(sorted(counts))
        v = (1 + np.log([counts[k] for k in t])) * self.idf[t]
        return t, v / np.sqrt((v * v).sum())

    def nearest(self, t: np.ndarray, v: np.ndarray, k: int = NEIGHBOURS, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a term in common, nearest first, ties by place."""
        bound = v @ self.most[t] if len(t) else np.array([])
        ids, sims = np.array([], dtype=int), np.array([])
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(ids) >= k and bound[b] < sims[k - 1] - 1e-12:
                break
            got = np.zeros(BLOCK)
            for j, x in zip(t, v):
                s, e = self.start[j, b], self.start[j, b + 1]
                got[self.at[s:e] - b * BLOCK] += x * self.weight[s:e]
            new = np.flatnonzero(got > 0)
            new = new[new + b * BLOCK != skip]
            ids, sims = np.r_[ids, new + b * BLOCK], np.r_[sims, got[new]]
            order = np.lexsort((ids, -sims))[:k]
            ids, sims = ids[order], sims[order]
        return ids, sims

    def vote(self, t: np.ndarray, v: np.ndarray, skip: int = -1) -> tuple[float, np.ndarray]:
        """The weighted share of label 1 among the nearest, drawn a little to that of texts without terms."""
        ids, sims = self.nearest(t, v, skip=skip)
        if not len(ids):
            return self.bare, ids
        w = 1 / (0.05 + 1 - np.minimum(sims, 1))
        w /= w.max()
        return float((w @ self.labels[ids] + 0.25 * self.bare) / (w.sum() + 0.25)), ids

    def score(self, vote: float) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-(a * vote + b))))


def build(rows: list[tuple], vectors: list[Counter], labels: list[int], vocabulary: list[str]) -> Index:
    """The index of examples given as term counts; rows are their ids."""
    term_of = {t: i for i, t in enumerate(vocabulary)}
    df = np.zeros(len(vocabulary))
    for c in vectors:
        for t in c:
            df[term_of[t]] += 1
    idf = np.log((1 + len(vectors)) / (1 + df)) + 1
    has = [i for i, c in enumerate(vectors) if c]
    dense = []
    for i in has:
        t = np.array(sorted(term_of[x] for x in vectors[i]))
        v = (1 + np.log([vectors[i][vocabulary[k]] for k in t])) * idf[t]
        dense.append((t, v / np.sqrt((v * v).sum())))
    order = sorted(range(len(has)), key=lambda j: (int(dense[j][0][dense[j][1].argmax()]), has[j]))  # like with like
    blocks = max(1, -(-len(order) // BLOCK))
    by: dict[int, list[tuple[int, float]]] = {}
    for place, j in enumerate(order):
        for k, x in zip(*dense[j]):
            by.setdefault(int(k), []).append((place, x))
    start, at, weight, most, n = np.zeros((len(vocabulary), blocks + 1), dtype=np.int64), [], [], np.zeros((len(vocabulary), blocks)), 0
    for k in range(len(vocabulary)):
        posts = by.get(k, [])
        places = np.array([p for p, _ in posts], dtype=int)
        start[k] = n + np.searchsorted(places, np.arange(blocks + 1) * BLOCK)
        for p, x in posts:
            most[k, p // BLOCK] = max(most[k, p // BLOCK], x)
        at.append(places)
        weight.append(np.array([x for _, x in posts]))
        n += len(posts)
    y = np.array([labels[has[j]] for j in order], dtype=float)
    none = [labels[i] for i, c in enumerate(vectors) if not c]
    bare = (sum(none) + 0.5 * np.mean(labels)) / (len(none) + 0.5) if labels else 0.0
    join = lambda xs: np.concatenate(xs) if xs else np.array([])
    index = Index([rows[has[j]] for j in order], y, term_of, idf, start, join(at).astype(int), join(weight), most, float(bare))
    votes = [index.vote(*dense[j], skip=place)[0] for place, j in enumerate(order)] + [index.bare] * len(none)
    index.curve = _logistic(np.array(votes), np.r_[y, np.array(none, dtype=float)])
    return index


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and intercept of a logistic curve by Newton steps, labels drawn in as Platt does."""
    if not len(x) or not 0 < y.sum() < len(y):
        return 0.0, -30.0 if not len(y) or not y.any() else 30.0
    p, n = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (p + 1) / (p + 2), 1 / (n + 2))
    a = np.array([1.0, -0.5])
    design = np.c_[x, np.ones(len(x))]
    for _ in range(50):
        q = 1 / (1 + np.exp(-design @ a))
        h = design.T @ (design * (q * (1 - q))[:, None]) + 1e-3 * np.eye(2)
        move = np.linalg.solve(h, design.T @ (target - q) - 1e-3 * a)
        a = a + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return max(0.0, float(a[0])), float(a[1])


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Index:
    """The index learned from the labelled documents that are not held out."""
    spark = docs.sparkSession
    open_rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    picked = open_rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    rows = [(r["doc_id"], r["y"]) for r in picked.collect()]  # at most `examples`
    kind = docs.schema["doc_id"].dataType.simpleString()
    few = F.broadcast(spark.createDataFrame(rows, f"doc_id {kind}, y int"))
    own = docs.select("doc_id", "text").join(few, "doc_id")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, names, ns = [], [], []
            for x in batch.column(1):
                w = (x.as_py() or "").lower().split()
                low.append(xxhash.xxh3_64_intdigest(" ".join(w)) >> 1)
                held = sorted(text_terms(w).items())
                names.append([t for t, _ in held])
                ns.append([n for _, n in held])
            columns = [batch.column(0), batch.column(2), pa.array(low, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(ns, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "y", "low", "terms", "ns"])

    seen = own.mapInArrow(words, f"id {kind}, y int, low bigint, terms array<string>, ns array<int>")
    for key, order in (("id", "low"), ("low", "id")):  # one text of each doc_id, then one doc_id of each text
        seen = seen.groupBy(key).agg(F.min_by(F.struct(*(c for c in seen.columns if c != key)), order).alias("x")).select(key, "x.*")
    seen = seen.persist()
    n = seen.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    p, n = float(n["p"] or 0), float(n["n"])
    vocabulary: list[str] = []
    if 0 < p < n:
        by = seen.select("y", F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").cast("double").alias("d"), F.sum("y").cast("double").alias("a")).where("d >= 3")
        c = F.lit(n) * F.pow(F.col("a") * (n - p) - (F.col("d") - F.col("a")) * p, 2) / (F.lit(p * (n - p)) * F.col("d") * (n - F.col("d")) + 1e-9)
        by = by.withColumn("c", c)
        tested = by.count()
        by = by.where((F.col("c") >= 3 * math.log(max(tested, 2))) & (F.abs(F.col("a") / p - (F.col("d") - F.col("a")) / (n - p)) >= 0.5 * F.col("d") / n))
        vocabulary = sorted(r["t"] for r in by.select("t").collect())  # terms of at most `examples` texts
    ids = {r["id"]: r["y"] for r in seen.select("id", "y").collect()}  # at most `examples`
    wanted = {t: i for i, t in enumerate(vocabulary)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [{wanted[t]: n for t, n in zip(*x) if t in wanted} for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            ks, ns = (pa.array([list(f(c)) for c in found], pa.list_(pa.int32())) for f in (dict.keys, dict.values))
            yield pa.RecordBatch.from_arrays([batch.column(0), ks, ns], names=["id", "k", "n"])

    got = {r["id"]: Counter({vocabulary[k]: m for k, m in zip(r["k"], r["n"])}) for r in seen.select("id", "terms", "ns").mapInArrow(count, f"id {kind}, k array<int>, n array<int>").collect()}
    seen.unpersist()
    keys = sorted(ids)
    return build(keys, [got.get(i, Counter()) for i in keys], [ids[i] for i in keys], vocabulary)


def score(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (ids of the nearest examples, nearest first)."""
    bounded_batches(docs.sparkSession)
    index = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, examples))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            scores, near = [], []
            for x in batch.column(2):
                vote, ids = own.vote(*own.vector(x.as_py() or ""))
                scores.append(own.score(vote) if len(own.labels) or own.bare else 0.0)
                near.append([own.ids[i] for i in ids])
            a = pa.array(scores, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), a, pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(near, pa.list_(batch.schema.field(0).type))], names=["k", "h", "s", "p", "e"])

    rows = docs.select("doc_id", held_out().alias("h"), "text").mapInArrow(run, f"k {kind}, h boolean, s double, p int, e array<{kind}>")
    return rows.select(F.col("k").alias("doc_id"), F.col("h").alias("held_out"), F.col("s").alias("score"), F.col("p").alias("predicted"), F.col("e").alias("evidence"))
