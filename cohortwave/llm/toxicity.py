"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Labels are learnt from a bounded sample (`max_rows`: the labelled training rows
with the smallest hashes of their id). All of its terms that depend on the label
(chi-square of at least `least`) span the vectors; their document frequencies
are counted over all documents. The sample is an inverted index in blocks of
examples with the largest weight of every (term, block): a query bounds each
block's cosine, reads blocks from the highest bound on, and stops when the k-th
best is above the next bound, so the neighbours are those of a full scan. Where
several examples are as near as the k-th, all of them share the votes that are
left, so neither ids nor their order decide; an example has no vote on its own
document. Votes are weighted by distance, and a logistic curve fitted to leave-one-out votes
makes them probabilities. Index and terms have fixed largest sizes and are
broadcast; documents are read once for terms and scored from short vectors.

Edge cases: null and empty texts, and texts without any of the terms, get the
smoothed share of label 1 among examples without terms; labels other than 0 and
1 and null ids are left out; a document labelled twice counts with its larger
label; repeated rows are scored alike; ids may be of any type and only name the evidence
(ties: smaller id first); without labelled rows every score is 0. Only the named columns are read.
"""
from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .common import map_batches, read, words

BLOCK = 64
#: Cosines this close are equal: sums of the same weights in another order.
NEAR = 1e-5


class Index:
    """Blocked inverted lists over unit vectors, with block maxima."""

    def __init__(self, ids, labels, vectors, df, total: int, k: int = 25, floor: float = 0.05):
        self.k, self.floor = k, floor
        self.idf = np.log((total + 1) / (np.asarray(df, float) + 1)) if len(df) else np.zeros(0)
        dense = np.zeros((len(ids), len(self.idf)), np.float32)
        for r, (at, tf) in zip(dense, vectors):
            r[at] = (1 + np.log(tf)) * self.idf[at]
        norm = np.sqrt((dense ** 2).sum(1))
        y = np.asarray(labels, float)
        empty = norm < 1e-9
        prior = (y.sum() + 0.0) / max(1, len(y))
        self.blank = float((y[empty].sum() + 5 * prior) / (empty.sum() + 5)) if len(y) else 0.0
        self.prior = prior
        dense, y, own = dense[~empty] / norm[~empty, None], y[~empty], [x for x, e in zip(ids, empty) if not e]
        order = np.argsort(dense.argmax(1), kind="stable") if dense.size else np.arange(len(own))  # like examples share blocks, so bounds are tight
        dense, self.y, self.ids = dense[order], y[order], [own[i] for i in order]
        self.at = {x: i for i, x in enumerate(self.ids)}
        self.rank = order  # of equally near examples the one that came first is named first
        self.blocks = -(-len(order) // BLOCK)
        lists = np.zeros((self.blocks * BLOCK, dense.shape[1]), np.float32)
        lists[:len(dense)] = dense
        self.lists = np.ascontiguousarray(lists.reshape(self.blocks, BLOCK, dense.shape[1]).transpose(0, 2, 1))
        self.most = self.lists.max(2).T if self.blocks else np.zeros((len(self.idf), 0), np.float32)
        self.curve = (1.0, 0.0)
        self.curve = self._calibrate(dense)

    def nearest(self, at: np.ndarray, q: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k best examples and of all as near as the k-th, best first; all of them have a
        term in common with q."""
        bound = q @ self.most[at]
        best_at, best = np.zeros(0, np.int64), np.zeros(0, np.float32)
        order = np.argsort(-bound, kind="stable")
        for s in range(0, len(order), 8):
            if bound[order[s]] <= 0 or len(best) >= self.k and best[self.k - 1] > bound[order[s]] + 2 * NEAR:
                break
            group = order[s:s + 8]
            sims = np.einsum("t,btd->bd", q, self.lists[group][:, at]).ravel()
            pos = (group[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            ok = (sims > 0) & (pos != skip)
            best, best_at = np.r_[best, sims[ok]], np.r_[best_at, pos[ok]]
            top = np.lexsort((self.rank[best_at], -best))
            if len(top) > self.k:
                top = top[best[top] >= best[top[self.k - 1]] - NEAR]
            best, best_at = best[top], best_at[top]
        return best_at, best

    def vote(self, at: np.ndarray, q: np.ndarray, skip: int = -1) -> tuple[float, np.ndarray]:
        near, sims = self.nearest(at, q, skip)
        w = 1 / (1 - np.minimum(sims, 1) + self.floor)
        if len(near) > self.k:
            tied = sims <= sims[self.k - 1] + NEAR
            w[tied] = w[tied].mean() * (self.k - (~tied).sum()) / tied.sum()
        return float((w @ self.y[near] + self.prior) / (w.sum() + 1)), near

    def _calibrate(self, dense) -> tuple[float, float]:
        if not len(self.y) or len(set(self.y)) < 2:
            return 1.0, 0.0
        x = np.array([self.vote(a := np.flatnonzero(r), r[a], i)[0] for i, r in enumerate(dense)])
        x = np.log((x + 1e-3) / (1 - x + 1e-3))
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton with a small ridge
            p = 1 / (1 + np.exp(-(a * x + b)))
            w = p * (1 - p) + 1e-9
            g = np.array([((p - self.y) * x).sum() + 0.01 * (a - 1), (p - self.y).sum()])
            h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum()]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        return float(a), float(b)

    def score(self, at, tf, own=None) -> tuple[float, list]:
        """Score and the ids of the five nearest examples; `own` is the id of the document itself."""
        at = np.asarray(at, np.int64)
        q = (1 + np.log(np.asarray(tf, float))) * self.idf[at]
        norm = np.sqrt((q ** 2).sum())
        if norm < 1e-9 or not self.blocks:
            return self.blank, []
        raw, near = self.vote(at, (q / norm).astype(np.float32), self.at.get(own, -1))
        z = self.curve[0] * np.log((raw + 1e-3) / (1 - raw + 1e-3)) + self.curve[1]
        return float(1 / (1 + np.exp(-z))), [self.ids[i] for i in near[:5]]


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(labels: DataFrame, doc_id: str, label: str, max_rows: int) -> DataFrame:
    one = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    one = one.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    return cut_lineage(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows), "sample")


def label_terms(docs: DataFrame, train: DataFrame, least: float) -> list[bytes]:
    """Terms of the sample's texts whose presence depends on the label, strongest first."""
    texts = docs.join(F.broadcast(train), "doc_id").dropDuplicates(["doc_id"]).select("y", "body")

    def run(b):
        pos, neg = Counter(), Counter()
        for t, y in zip(b.column("body").to_pylist(), b.column("y").to_pylist()):
            (pos if y else neg).update(set(words(t)))
        terms = list(pos | neg)
        return {"term": terms, "p": [pos[t] for t in terms], "n": [neg[t] for t in terms]}

    counts = map_batches(texts, run, "term binary, p long, n long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    y = train.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    pos, neg = y[0], y[1] - y[0]
    if not pos or not neg:
        return []
    e = (F.col("p") + F.col("n")) * pos / (pos + neg)
    f = (F.col("p") + F.col("n")) / (pos + neg)
    chi = (F.col("p") - e) ** 2 / (e * (1 - f) * (neg / (pos + neg)) + 1e-9)
    return [bytes(r.term) for r in counts.where("p + n >= 4").withColumn("chi", chi).where(F.col("chi") >= least).orderBy(F.desc("chi"), "term").collect()]  # of a bounded sample


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          max_rows: int = 6000, least: float = 20.0) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (ids of the nearest examples) of each row."""
    spark = docs.sparkSession
    df = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"))
    train = sample(labels, doc_id, label, max_rows)
    vocab = {t: i for i, t in enumerate(label_terms(df, train, least))}
    shared = spark.sparkContext.broadcast(vocab)

    def vectors(b):
        get, at, tf = shared.value.get, [], []
        for t in b.column("body").to_pylist():
            c = sorted(Counter(x for w in words(t) if (x := get(w)) is not None).items())
            at.append([x for x, _ in c])
            tf.append([n for _, n in c])
        return {"doc_id": b.column("doc_id"), "at": at, "tf": tf}

    kind = dict(df.dtypes)["doc_id"]
    vec = cut_lineage(map_batches(df, vectors, f"doc_id {kind}, at array<int>, tf array<int>"), "vectors")

    def frequencies(b):  # summed per slice, so a task sends a few rows of the bounded vocabulary
        n = np.bincount(b.column("at").flatten().to_numpy(zero_copy_only=False).astype(np.int64), minlength=1)
        return {"term": np.flatnonzero(n), "n": n[n > 0]}

    df_of = {r["term"]: r["n"] for r in map_batches(vec.select("at"), frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    rows = vec.join(F.broadcast(train), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    index = spark.sparkContext.broadcast(Index([r.doc_id for r in rows], [r.y for r in rows], [(r["at"], r.tf) for r in rows],
                                               [df_of.get(i, 0) for i in range(len(vocab))], vec.count()))

    def run(b):
        seen: dict = {}
        out = []
        for own, at, tf in zip(b.column("doc_id").to_pylist(), b.column("at").to_pylist(), b.column("tf").to_pylist()):
            own = own if own in index.value.at else None
            key = (tuple(at), tuple(tf), own)
            if key not in seen:
                seen[key] = index.value.score(at, tf, own)
            out.append(seen[key])
        return {"doc_id": b.column("doc_id"), "score": [s for s, _ in out], "evidence": [e for _, e in out]}

    out = map_batches(vec, run, f"doc_id {kind}, score double, evidence array<{kind}>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
