"""Packing of tokenised documents by minimum bin slack.

A document's ids, closed by one separator, are cut into full sequences and a
tail. Only the histogram of tail lengths (at most `capacity` - 1 counts) goes to
the driver. There a bitset subset-sum table picks, beside the longest tail left,
the multiset of lengths that fills the window closest to its capacity, with
counts found by walking the table back; the pattern is used as often as the
counts allow. If slack is left, a tail is cut to fill it. Patterns are rules on
(length, rank): each tail's rank among the tails of its length comes from counts
per task and length, so all pieces find their sequence by formula.

The vocabulary file is a parameter. Ids are those of the `tokenizers` library
for this file; tiktoken computes them from the same vocabulary's ranks, and texts
that spell out a special token go to `tokenizers` itself.

Edge cases: null and empty texts are the separator alone; repeated rows are
packed one by one; an empty table gives no rows; the number of rules is bounded
by the capacity, not by the data. Only the named columns are read.
"""
from __future__ import annotations

import base64
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import cut_lineage
from .common import join_bounded, map_batches, read

CAPACITY, SEPARATOR = 1024, 0
_ENCODERS: dict = {}


def encoder(name: str = "byte_bpe_50k"):
    """A function from a text to its ids; loaded once per Python worker."""
    if name not in _ENCODERS:
        import public_tokenizers as P
        import tiktoken

        with open(P.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        whole: list = []  # loaded when a text needs it

        def encode(text: str) -> list[int]:
            if "<|" not in text:
                return fast(text)
            if not whole:
                from tokenizers import Tokenizer

                whole.append(Tokenizer.from_file(P.path(f"{name}.json")))
            return whole[0].encode(text, add_special_tokens=False).ids

        _ENCODERS[name] = encode
    return _ENCODERS[name]


def tokenised(docs: DataFrame, doc_id: str, text: str, vocabulary: str, capacity: int) -> DataFrame:
    """part, doc_id, n, crcs of the full sequences, first (number of full ones before, in the task),
    tail (ids as bytes), len and rank (of this length, in the task)."""
    state: dict = {}  # in a task: counters that go on from batch to batch

    def run(b):
        encode, part = encoder(vocabulary), TaskContext.get().partitionId()
        if state.get("part") != part:
            state.clear()
            state.update(part=part, full=0, ranks=Counter())
        out = defaultdict(list)
        for t in b.column("body").to_pylist():
            ids = np.array([*(encode(t) if t else ()), SEPARATOR], "<u4")
            full = len(ids) // capacity
            tail = ids[full * capacity:]
            for c, v in (("n", len(ids)), ("crcs", [zlib.crc32(ids[i * capacity:(i + 1) * capacity].tobytes()) for i in range(full)]), ("first", state["full"]),
                         ("tail", tail.astype("<u2" if tail.size == 0 or tail.max() < 65536 else "<u4").tobytes()), ("len", len(tail)), ("rank", state["ranks"][len(tail)])):
                out[c].append(v)
            state["full"] += full
            state["ranks"][len(tail)] += 1
        return {"part": [part] * b.num_rows, "doc_id": b.column("doc_id"), **out}

    df = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"))
    return map_batches(df, run, f"part int, doc_id {dict(df.dtypes)['doc_id']}, n long, crcs array<long>, first long, tail binary, len int, rank long")


class Stock:
    """Tails of each length, as runs (original length, first rank, end rank, offset in the tail)."""

    def __init__(self, counts: dict[int, int]):
        self.runs = defaultdict(list, {n: [(n, 0, c, 0)] for n, c in counts.items() if c})
        self.count = Counter({n: c for n, c in counts.items() if c})

    def put(self, n: int, run: tuple[int, int, int, int]) -> None:
        self.runs[n].append(run)
        self.count[n] += run[2] - run[1]

    def take(self, n: int, k: int) -> list[tuple[int, int, int, int]]:
        out, self.count[n] = [], self.count[n] - k
        while k:
            length, a, b, o = self.runs[n].pop()
            m = min(k, b - a)
            out.append((length, a, a + m, o))
            if a + m < b:
                self.runs[n].append((length, a + m, b, o))
            k -= m
        if not self.count[n]:
            del self.count[n]
        return out


def best_fill(count: Counter, room: int) -> dict[int, int]:
    """Counts by length of a sub-multiset whose sum is closest to `room` from below."""
    steps, table = [], [1]
    mask = (1 << (room + 1)) - 1
    for n in sorted(count, reverse=True):
        left, size = min(count[n], room // n), 1
        while left:
            k = min(size, left)
            steps.append((n, k))
            table.append((table[-1] | table[-1] << (n * k)) & mask)
            left, size = left - k, size * 2
        if table[-1] >> room & 1:
            break
    at, out = table[-1].bit_length() - 1, Counter()
    for (n, k), before in zip(reversed(steps), reversed(table[:-1])):
        if not before >> at & 1:
            out[n] += k
            at -= n * k
    return out


RULE = ["len", "lo", "hi", "start", "size", "sequence", "per", "j0", "offset"]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """Rules for all tails and the number of sequences they fill. A rule: tails of length `len` and ranks
    lo <= rank < hi give their `size` ids from `start` on to place j = j0 + rank - lo of the pattern's
    pieces of this size: sequence + j // per, at offset + j % per * size."""
    stock, rules, sequences = Stock(counts), [], 0
    while stock.count:
        top = max(stock.count)
        stock.count[top] -= 1
        fill = best_fill(+stock.count, capacity - top)
        stock.count[top] += 1
        fill[top] += 1
        slack = capacity - sum(n * c for n, c in fill.items())
        cut = max((n for n in +(stock.count - fill) if n > slack), default=0) if slack else 0
        times = min(stock.count[n] // (c + (n == cut)) for n, c in (fill | {cut: fill[cut]} if cut else fill).items())
        at = 0
        for n, c in fill.items():
            j = 0
            for length, a, b, o in stock.take(n, c * times):
                rules.append((length, a, b, o, n, sequences, c, j, at))
                j += b - a
            at += n * c
        if cut:
            j = 0
            for length, a, b, o in stock.take(cut, times):
                rules.append((length, a, b, o, slack, sequences, 1, j, at))
                stock.put(cut - slack, (length, a, b, o + slack))
                j += b - a
        sequences += times
    return rules, sequences


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    toks = cut_lineage(tokenised(docs, doc_id, text, vocabulary, capacity), "tokens")
    counts = cut_lineage(toks.groupBy("part", "len").agg(F.count("*").alias("c")), "tails")
    rules, used = plan({r.len: r.c for r in counts.where("len > 0").groupBy("len").agg(F.sum("c").alias("c")).collect()}, capacity)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    full = toks.groupBy("part").agg(F.sum(F.size("crcs")).alias("f")).select("part", (F.coalesce(F.sum("f").over(before), F.lit(0)) + used).alias("full0"))
    ranks = counts.select("part", "len", F.coalesce(F.sum("c").over(W.partitionBy("len").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("rank0"))
    # one array of offsets by length per task; as small as its tasks are many
    base = full.join(ranks.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("len", "rank0"))).alias("rank0")), "part")
    by_len = defaultdict(list)
    for r in sorted(rules):
        by_len[r[0]].append(r)
    tables = {n: np.array(rs, np.int64) for n, rs in by_len.items()}
    reach = {n: np.maximum.accumulate(t[:, 2]) for n, t in tables.items()}
    shared = spark.sparkContext.broadcast((tables, reach))

    def run(b):
        tables, reach = shared.value
        out = defaultdict(list)

        def put(*row):
            for c, v in zip(("doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), row):
                out[c].append(v)

        cols = [b.column(c).to_pylist() for c in ("n", "crcs", "place", "tail", "len", "rank")]
        for i, (n, crcs, place, tail, size, rank) in enumerate(zip(*cols)):
            for k, crc in enumerate(crcs):
                put(i, k * capacity, capacity, crc, n, place + k, 0)
            if size:
                t = tables[size]
                at = int(np.searchsorted(t[:, 1], rank, "right"))
                ids = np.frombuffer(tail, "<u2" if len(tail) == 2 * size else "<u4").astype("<u4")
                while at and reach[size][at - 1] > rank:
                    at -= 1
                    _, lo, hi, start, m, seq, per, j0, off = t[at].tolist()
                    if lo <= rank < hi:
                        j = j0 + rank - lo
                        put(i, len(crcs) * capacity + start, m, zlib.crc32(ids[start:start + m].tobytes()), n, seq + j // per, off + j % per * m)
        doc = out.pop("doc", [])
        return {"doc_id": b.column("doc_id").take(np.array(doc, np.int64)), **out} if doc else None

    placed = join_bounded(toks, cut_lineage(base, "ranks"), "part", "inner", 2_000).select("doc_id", "n", "crcs", (F.col("full0") + F.col("first")).alias("place"), "tail", "len",
                                            (F.col("rank") + F.col("rank0")[F.col("len")]).alias("rank"))
    kind = dict(toks.dtypes)["doc_id"]
    return map_batches(placed, run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their sequences."""
    return pack(docs)
