"""Benchmark decontamination with a broadcast hash set of test n-grams.

Words are compared as ids of the test vocabulary. A document's words that are
not in it break its runs; rolling hashes of the runs' windows are looked up in
the sorted hashes of the test windows, and hits are verified word by word in a
dictionary. Test windows are broadcast in blocks of at most `block_windows`
(counted first); a larger test set takes one scan per block, and hits are merged.

Edge cases: null texts have no words; an item of fewer than `width` words is one
window; items without words never occur; items without id count as hits but are
not listed; repeated items are listed once; repeated rows are judged alike; empty
tables give n_hit 0 or no rows. Only the named columns are read.
"""
from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .common import free_name, join_bounded, map_batches, read, row_key, words

WIDTH = 13
STEP = np.uint64(0x9E3779B97F4A7C15)


class Windows:
    """Windows of some items: vocabulary, sorted hashes by length, exact windows to item ids."""

    def __init__(self, items, width: int = WIDTH):
        self.vocab: dict[bytes, int] = {}
        self.exact: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                found = self.exact[tuple(ids[i:i + width])]
                if item is not None:
                    found.add(str(item))
        self.hashes = {n: np.unique(self.rolled(np.array([w for w in self.exact if len(w) == n], np.uint64).T)) for n in {len(w) for w in self.exact}}

    @staticmethod
    def rolled(columns) -> np.ndarray:
        acc = np.zeros_like(columns[0])
        for c in columns:
            acc = (acc + c) * STEP
            acc ^= acc >> np.uint64(32)
        return acc

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Marks of the words inside windows, and the items of these windows. Id 0 is any other word."""
        mark, items = np.zeros(len(ids) + 1, np.int64), set()
        known = np.r_[0, np.cumsum(ids > 0)]
        for n, hashes in self.hashes.items():
            if len(ids) >= n:
                at = np.flatnonzero(known[n:] - known[:-n] == n)
                if len(at):
                    h = self.rolled([ids[at + j] for j in range(n)])
                    at = at[hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h]
                    for i in at.tolist():
                        if (w := tuple(ids[i:i + n].tolist())) in self.exact:
                            mark[i] += 1
                            mark[i + n] -= 1
                            items |= self.exact[w]
        return np.cumsum(mark[:-1]) > 0, items


def blocks(benchmark: DataFrame, item_id: str, text: str, width: int, block_windows: int):
    """Test items in blocks of bounded size; one block unless the test set is larger."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("body")).where("body is not null").distinct()
    chars = items.agg(F.sum(F.length("body"))).first()[0] or 0
    n = max(1, -(-chars // (6 * block_windows)))
    part = F.pmod(F.xxhash64("item", "body"), F.lit(n))
    return [lambda i=i: Windows([tuple(r) for r in items.where(part == i).collect()], width) for i in range(n)]


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text",
         width: int = WIDTH, block_windows: int = 2_000_000) -> DataFrame:
    """`keep` columns with n_words, n_hit and items (sorted) of each row."""
    spark = docs.sparkSession
    types = dict(docs.select(*keep).dtypes)
    held = ", ".join(f"`{c}` {types[c]}" for c in keep)
    df = docs.select(*keep, F.col(text).alias("body"), F.lit(None).cast("binary").alias("marks"),
                     F.lit(None).cast("array<string>").alias("items"))
    todo = blocks(benchmark, item_id, item_text, width, block_windows)
    for k, block in enumerate(todo):
        shared = spark.sparkContext.broadcast(block())
        carried = ["body"] * (k + 1 < len(todo))  # a further block scans the texts once more

        def run(b, shared=shared, carried=carried):
            win = shared.value
            get, out = win.vocab.get, {c: [] for c in ("n_words", "n_hit", "marks", "items")}
            for t, before, found in zip(b.column("body").to_pylist(), b.column("marks").to_pylist(), b.column("items").to_pylist()):
                ws = words(t)
                ids = np.fromiter((get(x, 0) for x in ws), np.uint64, len(ws))
                mark, items = win.hits(ids) if len(ws) else (np.zeros(0, bool), set())
                if before is not None:
                    mark |= np.unpackbits(np.frombuffer(before, np.uint8), count=len(ws)).astype(bool)
                n = int(mark.sum())
                out["n_words"].append(len(ws))
                out["n_hit"].append(n)
                out["marks"].append(np.packbits(mark).tobytes() if n else None)
                out["items"].append(sorted(items | set(found or ())))
            return {c: b.column(c) for c in [*keep, *carried]} | out

        df = map_batches(df.select(*keep, "body", "marks", "items"), run,
                         held + ", body string" * len(carried) + ", n_words long, n_hit long, marks binary, items array<string>")
        df = cut_lineage(df, "hits") if carried else df
    return df.select(*keep, "n_words", "n_hit", "items").withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), ["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, unchanged."""
    row = free_name(docs, "__row")
    keyed = docs.withColumn(row, row_key(docs))
    bad = cut_lineage(scan(keyed, read(spark, sf_dir, "benchmark"), [row]).where("contaminated").select(row).distinct(), "contaminated")
    return join_bounded(keyed, bad, row, "left_anti").drop(row)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Windows as text, joined with all windows of their length in the documents.
OP9_SQL = f"""
with it as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
  wi as (select distinct item, least(len(w), {WIDTH}) as k, unnest(list_transform(range(1, len(w) - least(len(w), {WIDTH}) + 2), lambda i: array_to_string(w[i:i + least(len(w), {WIDTH}) - 1], ' '))) as s from it where len(w) > 0),
  dw as (select doc_id, {_WORDS} as w from documents),
  dn as (select doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as s, unnest(range(1, len(w) - k + 2)) as i
         from dw join (select distinct k from wi) ks on len(w) >= k),
  hit as (select distinct doc_id, i, wi.k, item from dn join wi on wi.k = dn.k and wi.s = dn.s),
  nh as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + k)) as p from hit) x group by 1),
  its as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hit) x group by 1)
select dw.doc_id, len(w)::bigint as n_words, coalesce(nh.n, 0)::bigint as n_hit, coalesce(its.n, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(nh.n, 0) > 0 and 20 * coalesce(nh.n, 0) >= len(w) as contaminated
from dw left join nh on nh.doc_id = dw.doc_id left join its on its.doc_id = dw.doc_id
"""
