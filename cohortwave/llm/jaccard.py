"""Exact n-gram Jaccard self-join with signature trees.

A document is the set of its distinct `k`-word shingles. Two documents link
when `percent`% of their union is shared; classes are the components of links.

1. Equal texts are merged by digest (aggregated before the shuffle).
2. Shingle hashes are counted over the whole corpus. A chunk of documents sends
   each distinct shingle once to its hash bucket, with its count in the chunk,
   so a passage that a third of all documents share costs one entry per chunk.
   Buckets answer with the corpus frequency of shared shingles. A document whose
   shared shingles are below `percent`% of its set cannot link and leaves here.
3. Copies are linked first: documents with an equal minimum hash are compared
   with the most typical of them (highest mean log frequency of its shingles, as an
   original has among its copies). This only shortens the work of the next step.
4. Exact step: with shingles in the order (frequency, hash), two linked documents
   share one within their first n - ceil(n * percent / 100) + 1. Documents that
   share such a shingle and are not yet in one class meet in a signature tree:
   leaves and inner nodes hold the OR of token bitmaps and ranges of sizes, and a
   dual traversal drops node pairs whose largest possible overlap is too small or
   whose documents are one class already. Large groups are split into blocks and
   meet block by block. The pairs that remain are verified on whole sets.

Edge cases: null, empty and blank texts have an empty set and link with nothing
(repeated ones too); texts of fewer than k words are one shingle; repeated rows
are equal texts and so one class, also under null ids; an empty table gives an
empty result. Only the named columns are read.
"""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .common import blank_words, components, free_name, join_bounded, read, row_key, slices

K, PERCENT = 5, 75
LOW = np.uint64((1 << 48) - 1)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93))
BITS = 1024


class WordHash(dict):
    """64-bit hashes of lower-cased words, kept up to a bound."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        v = self[w] = xxhash.xxh3_64_intdigest(w.lower())
        return v


def mix(x: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * by
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, hashes: WordHash, k: int = K) -> np.ndarray:
    """Sorted distinct shingle hashes; bytes.lower() changes A-Z alone."""
    w = np.array([hashes[x] for x in blank_words(text)], np.uint64)
    if not len(w):
        return w
    n = max(1, len(w) - k + 1)
    acc = np.full(n, min(len(w), k), np.uint64)
    for j in range(min(k, len(w))):
        acc = mix(acc ^ w[j:j + n], MIX[0]) + MIX[1]
    return np.unique(acc)


def token_ids(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of a hash and its name there: 48 low bits, below the bucket's 16."""
    b = (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return b.astype(np.int64), (b << np.uint64(48)) | (h & LOW)


def pack(t: np.ndarray) -> bytes:
    return np.ascontiguousarray(t.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


SENT = "bucket long, chunk string, nodes binary, sizes binary, docs binary, toks binary, mtoks binary, mcounts binary"
SENT_COLS = [c.split()[0] for c in SENT.split(", ")]
SENT_TYPES = [pa.int64(), pa.string()] + [pa.binary()] * 6


def _send(k: int, buckets: int, most_words: int = 400_000):
    """Chunks of documents to (bucket, chunk) rows and one row of facts per chunk."""
    def chunk(nodes: list[bytes], sets: list[np.ndarray], number: int):
        # a task that runs again on rows in another order must not mix with its first run: the name holds all nodes
        name = f"{TaskContext.get().partitionId()}-{number}-{hashlib.md5(b''.join(nodes)).hexdigest()}"
        tok, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(tok, kind="stable")
        ts = tok[order]
        first = np.flatnonzero(np.r_[True, ts[1:] != ts[:-1]]) if len(ts) else np.array([], int)
        count = np.diff(np.r_[first, len(ts)])
        alone = np.zeros(len(tok), bool)
        alone[order[first[count == 1]]] = True
        st, sd = tok[alone], doc[alone]
        sb, st = token_ids(st, buckets)
        by = np.argsort(sb, kind="stable")
        sb, st, sd = sb[by], st[by], sd[by]
        mt, mc = ts[first[count > 1]], count[count > 1]
        mdocs = doc[order[np.repeat(count > 1, count)]]
        mb, mt = token_ids(mt, buckets)
        both = np.union1d(sb, mb)
        (s0, s1), (m0, m1) = ((np.searchsorted(x, both), np.searchsorted(x, both, "right")) for x in (sb, mb))
        for i, b in enumerate(both):
            d = sd[s0[i]:s1[i]]
            yield (int(b), name, None, None, np.diff(d, prepend=0).astype("<u2").tobytes(), pack(st[s0[i]:s1[i]]),
                   pack(mt[m0[i]:m1[i]]), mc[m0[i]:m1[i]].astype("<u4").tobytes())
        sizes = np.array([len(s) for s in sets], "<u4").tobytes()
        yield (-1 - int(nodes[0].hex()[:8], 16) % buckets, name, b"".join(nodes), sizes, mdocs.astype("<u2").tobytes(), None,
               mt.astype("<u8").tobytes(), mc.astype("<u4").tobytes())

    def batch(nodes, sets, number):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chunk(nodes, sets, number)), SENT_TYPES)], SENT_COLS)

    def run(batches):
        hashes, nodes, sets, held, number = WordHash(), [], [], 0, 0
        for b in slices(batches):
            for node, text in zip(b.column("node").to_pylist(), b.column("body").to_pylist()):
                nodes.append(node)
                sets.append(shingle_set(text, hashes, k))
                held += len(sets[-1])
                if held >= most_words or len(nodes) >= 60_000:
                    yield batch(nodes, sets, number)
                    nodes, sets, held, number = [], [], 0, number + 1
        if nodes:
            yield batch(nodes, sets, number)
    return run


def _count(p: pd.DataFrame) -> pd.DataFrame:
    """Answer of one bucket: the shared ones of each chunk's lone tokens, and frequencies."""
    bucket = int(p["bucket"].iloc[0])
    if bucket < 0:
        return p.assign(dfs=None, mdfs=None)[[*SENT_COLS, "dfs", "mdfs"]]
    high = np.uint64(bucket & 0xFFFF) << np.uint64(48)
    lone, many = [unpack(x) | high for x in p["toks"]], [unpack(x) | high for x in p["mtoks"]]
    weight = np.concatenate([np.ones(sum(map(len, lone)), np.int64), *[np.frombuffer(x, "<u4") for x in p["mcounts"]]]).astype(np.int64)
    uniq, at = np.unique(np.concatenate(lone + many), return_inverse=True)
    df = np.bincount(at, weight, len(uniq)).astype("<u4")[at]
    out, i, j = [], 0, sum(map(len, lone))
    for chunk, docs, ts, ms in zip(p["chunk"], p["docs"], lone, many):
        f, g = df[i:i + len(ts)], df[j:j + len(ms)]
        i, j = i + len(ts), j + len(ms)
        keep = f > 1
        out.append((bucket, chunk, None, None, np.cumsum(np.frombuffer(docs, "<u2"), dtype=np.uint32)[keep].astype("<u2").tobytes(), ts[keep].tobytes(),
                    ms.tobytes(), None, f[keep].tobytes(), g.tobytes()))
    return pd.DataFrame(out, columns=[*SENT_COLS, "dfs", "mdfs"])


def _gather(percent: int):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        """One chunk's documents, with their shared tokens in the order (frequency, token) if they can link."""
        fact, rest = p[p["bucket"] < 0], p[p["bucket"] >= 0].sort_values("bucket")
        if len(fact) != 1 or rest["bucket"].duplicated().any():
            raise ValueError(f"chunk {p['chunk'].iloc[0]} was sent {len(fact)} times")
        fact = fact.iloc[0]
        join = lambda c, t: np.frombuffer(b"".join(rest[c]), t)
        nodes, sizes = fact["nodes"], np.frombuffer(fact["sizes"], "<u4").astype(np.int64)
        mt, mc, mdocs = (np.frombuffer(fact[c], t) for c, t in (("mtoks", "<u8"), ("mcounts", "<u4"), ("docs", "<u2")))
        # both sides list the tokens of several documents in the order of their hashes
        doc = np.concatenate([join("docs", "<u2"), mdocs]).astype(np.int64)
        tok = np.concatenate([join("toks", "<u8"), np.repeat(mt, mc)])
        df = np.concatenate([join("dfs", "<u4"), np.repeat(join("mdfs", "<u4"), mc)])
        order = np.lexsort((tok, df, doc))
        doc, tok, df = doc[order], tok[order], df[order]
        lo, hi = np.searchsorted(doc, np.arange(len(sizes))), np.searchsorted(doc, np.arange(len(sizes)), "right")
        out = []
        for i, n in enumerate(sizes.tolist()):
            t, need = tok[lo[i]:hi[i]], -(-n * percent // 100)
            if n and len(t) >= need:
                bits = np.zeros(BITS, np.uint8)
                bits[(mix(t, MIX[2]) >> np.uint64(54)).astype(int)] = 1
                posted = max(0, n - need + 1 - (n - len(t)))
                out.append((nodes[16 * i:16 * i + 16], n, t.astype(np.int64), posted, [int(mix(t, m).min().astype(np.int64)) for m in MIX],
                            np.packbits(bits).tobytes(), round(float(np.log2(df[lo[i]:hi[i]]).sum()) / n, 6)))
            else:
                out.append((nodes[16 * i:16 * i + 16], n, None, 0, None, None, None))
        return pd.DataFrame(out, columns=["node", "n", "toks", "posted", "mins", "bits", "typical"])
    return run


class Tree:
    """Levels of OR-combined bitmaps and ranges over documents sorted by size."""

    def __init__(self, n, held, bits, comp, fan: int = 8):
        self.fan, count = fan, np.bitwise_count(bits).sum(1)
        self.levels = [(n, n, held, count, bits, comp, comp)]
        while len(self.levels[-1][0]) > fan:
            at = np.arange(0, len(self.levels[-1][0]), fan)
            lo, hi, h, c, b, c0, c1 = self.levels[-1]
            self.levels.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(h, at), np.minimum.reduceat(c, at),
                                np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at)))

    def possible(self, level: int, other: "Tree", i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Node pairs that may hold a link between documents of different classes."""
        a, b = [x[i] for x in self.levels[level]], [x[j] for x in other.levels[level]]
        common = np.bitwise_count(a[4] & b[4]).sum(1).astype(np.int64)
        most = np.minimum(*(x[2] - np.maximum(0, x[3].astype(np.int64) - common) for x in (a, b)))
        need = np.maximum(-(-np.maximum(a[0], b[0]) * percent // 100), -(-(a[0] + b[0]) * percent // (100 + percent)))
        one = (a[5] == a[6]) & (b[5] == b[6]) & (a[5] == b[5])
        return ~one & (most >= need) & (100 * a[1] >= percent * b[0]) & (100 * b[1] >= percent * a[0])


def dual(x: Tree, y: Tree | None, percent: int = PERCENT, step: int = 200_000):
    """Dual traversal of two trees (or of one with itself); yields arrays of pairs of leaves' documents."""
    self_join, y = y is None, x if y is None else y
    while len(x.levels) != len(y.levels):  # a root of its own over the lower tree
        low = min((x, y), key=lambda t: len(t.levels))
        lo, hi, h, c, b, c0, c1 = low.levels[-1]
        low.levels.append(tuple(np.array([v]) for v in (lo.min(), hi.max(), h.max(), c.min())) + (np.bitwise_or.reduce(b, axis=0)[None],) + tuple(np.array([v]) for v in (c0.min(), c1.max())))
    top = len(x.levels) - 1
    i, j = (g.ravel() for g in np.meshgrid(np.arange(len(x.levels[top][0])), np.arange(len(y.levels[top][0])), indexing="ij"))
    stack = [(top, i, j)]
    while stack:
        level, i, j = stack.pop()
        if self_join:
            keep = i <= j if level else i < j
            i, j = i[keep], j[keep]
        if len(i) > step:
            stack += [(level, i[s:s + step], j[s:s + step]) for s in range(0, len(i), step)]
            continue
        keep = x.possible(level, y, i, j, percent)
        i, j = i[keep], j[keep]
        if not level:
            yield i, j
        elif len(i):
            nx, ny = (len(t.levels[level - 1][0]) for t in (x, y))
            di, dj = (g.ravel() for g in np.meshgrid(np.arange(x.fan), np.arange(x.fan), indexing="ij"))
            i, j = (i[:, None] * x.fan + di).ravel(), (j[:, None] * x.fan + dj).ravel()
            ok = (i < nx) & (j < ny)
            stack.append((level - 1, i[ok], j[ok]))


def _meet(percent: int):
    """Rows sorted by (tok, left, right, n); one signature tree per group, or one per side."""
    def group(p: pd.DataFrame):
        bits = np.frombuffer(b"".join(p["bits"]), "<u8").reshape(len(p), -1)
        n, held, comp, nid = (p[c].to_numpy() for c in ("n", "held", "comp", "nid"))
        own = p["side"].to_numpy()
        make = lambda m: Tree(n[m], held[m], bits[m], comp[m])
        if p["lo"].iloc[0] == p["hi"].iloc[0]:
            for i, j in dual(make(slice(None)), None, percent):
                yield nid[i], nid[j]
        elif (own == 0).any() and (own == 1).any():
            for i, j in dual(make(own == 0), make(own == 1), percent):
                yield nid[own == 0][i], nid[own == 1][j]

    def groups(p: pd.DataFrame):
        key = p[["tok", "lo", "hi"]].to_numpy()
        cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1), True])
        for s, e in zip(cut[:-1], cut[1:]):
            if e - s > 1:
                for a, b in group(p.iloc[s:e]):
                    if len(a):
                        yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    def run(parts):
        held = None
        for p in parts:
            p = p if held is None else pd.concat([held, p], ignore_index=True)
            last = p[["tok", "lo", "hi"]].iloc[-1]
            open_ = (p[["tok", "lo", "hi"]] == last).all(axis=1).to_numpy()
            held, done = p[open_], p[~open_]
            if len(done):
                yield from groups(done)
        if held is not None and len(held):
            yield from groups(held)
    return run


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) that link, by the whole sets."""
    side = lambda c: sets.select(F.col("nid").alias(c), F.col("n").alias(f"n{c}"), F.col("toks").alias(f"t{c}"))
    both = F.size(F.array_intersect("ta", "tb"))
    small = pairs.join(sets.select(F.col("nid").alias("a"), F.col("n").alias("ma")), "a").join(sets.select(F.col("nid").alias("b"), F.col("n").alias("mb")), "b")
    small = small.where((100 * F.col("ma") >= percent * F.col("mb")) & (100 * F.col("mb") >= percent * F.col("ma"))).select("a", "b")
    return (small.join(side("a"), "a").join(side("b"), "b").withColumn("both", both)
            .where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b"))


def shared_sets(texts: DataFrame, chars: int, k: int = K, percent: int = PERCENT, bucket_tokens: int = 1_000_000) -> DataFrame:
    """Documents (node, body) to node, n and, where a link is possible, shared tokens."""
    spark = texts.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8, math.ceil(chars / 6 / bucket_tokens))
    sent = texts.mapInArrow(_send(k, buckets), SENT)
    counted = sent.groupBy("bucket").applyInPandas(_count, SENT + ", dfs binary, mdfs binary")
    return counted.groupBy("chunk").applyInPandas(_gather(percent), "node binary, n long, toks array<long>, posted int, mins array<long>, bits binary, typical double")


def links(sets: DataFrame, percent: int = PERCENT, block: int = 4096) -> DataFrame:
    """Links (a, b) between nid of `sets` (nid, n, toks, posted, mins, bits, typical) that have the components of all links."""
    keys = sets.select("nid", "typical", F.posexplode("mins"))
    centre = keys.groupBy("pos", "col").agg(F.max_by("nid", F.struct("typical", -F.col("nid"))).alias("b"), F.count("*").alias("c")).where("c > 1").drop("c")
    first = keys.join(centre, ["pos", "col"]).where("nid <> b")
    first = first.select(F.least("nid", "b").alias("a"), F.greatest("nid", "b").alias("b")).distinct()
    first = cut_lineage(verify(first, sets, percent), "near")
    comp = components(first)
    posts = (sets.join(comp, sets.nid == comp.node, "left").select("nid", "n", F.size("toks").cast("long").alias("held"), F.coalesce("root", "nid").alias("comp"), "bits",
             F.explode(F.slice("toks", F.lit(1), F.col("posted"))).alias("tok")))
    thin = sets.join(comp, sets.nid == comp.node, "left").select(F.coalesce("root", "nid").alias("comp"), F.explode(F.slice("toks", F.lit(1), F.col("posted"))).alias("tok"))
    mixed = thin.groupBy("tok").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("c")).where("x <> y")
    mixed = mixed.select("tok", F.ceil(F.col("c") / block).cast("int").alias("m"))
    own = F.pmod(F.xxhash64("nid"), F.col("m")).cast("int")
    parts = (posts.join(mixed, "tok").withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
             .withColumn("lo", F.least("own", "o")).withColumn("hi", F.greatest("own", "o")).withColumn("side", (F.col("own") != F.col("lo")).cast("int")))
    met = (parts.repartition("tok", "lo", "hi").sortWithinPartitions("tok", "lo", "hi", "n", "nid")
           .select("tok", "lo", "hi", "side", "nid", "n", "held", "comp", "bits").mapInPandas(_meet(percent), "a long, b long").distinct())
    return first.union(cut_lineage(verify(cut_lineage(met, "met"), sets, percent), "near"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """members: doc_id and node (the text's digest; null for no text) of every row; info: n, root (equal
    within a class of linked texts) and rep (smallest id that is not null) of every distinct text."""
    node = F.unhex(F.md5(F.col(text)))
    members = cut_lineage(docs.select(F.col(doc_id).alias("doc_id"), node.alias("node"), F.length(text).cast("long").alias("chars")), "members")
    reps = cut_lineage(members.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")), "reps")
    # one row of each text goes on: repeated ids and null ids of a text are settled by the row's order in its task
    extra = members.join(reps.where("c > 1"), "node").where("not (doc_id <=> rep)").select("doc_id", "node").distinct()
    texts = docs.select(F.col(doc_id).alias("doc_id"), node.alias("node"), F.col(text).alias("body")).where("node is not null")
    gone = cut_lineage(extra, "extra").select(F.col("doc_id").alias("x_id"), F.col("node").alias("x_node"))
    texts = join_bounded(texts, gone, (F.col("doc_id").eqNullSafe(F.col("x_id"))) & (F.col("node") == F.col("x_node")), "left_anti").select("node", "body")
    chars = members.agg(F.sum("chars")).first()[0] or 0
    nodes = cut_lineage(shared_sets(texts, chars, k, percent).withColumn("nid", F.monotonically_increasing_id()), "sets")
    near = components(links(nodes.where("toks is not null"), percent))
    info = nodes.select("node", "nid", "n").join(near, nodes.nid == near.node, "left").select(nodes.node, "n", F.coalesce("root", "nid").alias("root")) \
        .groupBy("node").agg(F.first("n").alias("n"), F.min("root").alias("root")).join(reps.select("node", "rep"), "node")
    return members, cut_lineage(info, "info")


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    members, info = classes(docs, doc_id, text, k, percent)
    least = info.groupBy("root").agg(F.min("rep").alias("least"))
    return members.join(info.join(least, "root").select("node", "n", "least"), "node", "left").select(
        "doc_id", F.coalesce("n", F.lit(0)).alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(read(spark, sf_dir, "documents"))


#: Pairs that share a shingle, counted, and the closure of those that link.
OP10_SQL = f"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') as w from documents),
  sh as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - {K} + 1, 1) + 1), lambda i: array_to_string(w[i:i + {K} - 1], ' '))) as s from w where len(w) > 0),
  n as (select doc_id, count(*) as n from sh group by 1),
  both_ as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
  link as (select a, b from both_ join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= {PERCENT} * (x.n + y.n - c)),
  edge as (select a, b from link union all select b, a from link),
  reach(a, b) as (select doc_id, doc_id from n union select reach.a, edge.b from reach join edge on edge.a = reach.b)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(least_, w.doc_id) as component_id
from w left join n on n.doc_id = w.doc_id left join (select a, min(b) as least_ from reach group by 1) r on r.a = w.doc_id
"""


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: of its text with the smallest id (ties: smallest digest; a null id comes last),
    the row with that id, and one row where it is repeated. Decided by id and text together, so other texts
    under an id stay. Texts without words link with nothing and all stay."""
    node, row = free_name(docs, "__node"), free_name(docs, "__row")
    members, info = classes(docs)
    kept = info.where("n > 0").groupBy("root").agg(F.min_by("node", F.struct(F.col("rep").isNull(), "rep", "node")).alias("kept"))
    text = info.where("n > 0").join(kept, "root").select("node", "rep", (F.col("node") == F.col("kept")).alias("stays"))
    seen = cut_lineage(members.join(text, "node").groupBy("node", "doc_id").agg(
        F.first(F.col("stays") & F.col("doc_id").eqNullSafe(F.col("rep"))).alias("stays"), F.count("*").alias("c")), "seen")
    columns = [f"`{c}`" for c in docs.columns]
    keyed = docs.withColumn(node, F.unhex(F.md5("text")))

    def at(df: DataFrame, which: DataFrame, how: str) -> DataFrame:
        which = which.select(F.col("doc_id").alias("x_id"), F.col("node").alias("x_node"))
        return join_bounded(df, which, df["doc_id"].eqNullSafe(F.col("x_id")) & (df[node] == F.col("x_node")), how)

    single = at(keyed, seen.where("not stays"), "left_anti")
    again = seen.where("stays and c > 1")
    if again.isEmpty():
        return single.select(*columns)
    once = at(single, again, "left_semi").withColumn(row, row_key(docs))
    once = once.groupBy(node).agg(F.min_by(F.struct(*columns), row).alias("r")).select("r.*")
    return at(single, again, "left_anti").select(*columns).unionByName(once)
