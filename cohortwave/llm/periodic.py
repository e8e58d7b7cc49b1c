"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of words with smallest period q and at least max(`least`,
`times` * q) words that no neighbouring word extends. For L = 1, 2, 4, ... the
dictionary names every factor of L words, equal factors equally (the name of
2L words is the pair of names of its halves). The next occurrence of a factor
within 2L words proposes its distance as a period: where neighbouring positions
propose the same distance, occurrences stand in arithmetic progressions, and
the positions' extent, extended word by word on both sides, is a run. A run of
period q and over L + q words, q <= L < 2q, shows at L exactly so: inside it a
factor of L >= q words cannot come again sooner than q. Equal stretches of
several levels are merged, the smallest period stays.

Only positions whose factor comes again in its text go to the next level, so
text without repeats leaves after two or three levels. The texts of a slice are
worked on in one array, a separator of its own behind each.

Edge cases: null, empty and blank texts have no words and no runs; rows are
worked on alone, so repeated rows, ties, null ids and extra columns change
nothing; an empty table gives an empty result. Columns of the caller called
like the result's are refused, and so is `times` below 3.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import blank_words, map_batches, read

LEAST, TIMES = 6, 4
RESULT = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def names(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of equal keys, and each key's next place with an equal one (or -1)."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    name, following = np.empty(len(key), np.int64), np.full(len(key), -1)
    name[order] = np.cumsum(np.r_[0, ~same][: len(key)])
    following[order[:-1][same]] = order[1:][same]
    return name, following


def proposals(ids: np.ndarray, text: np.ndarray) -> set[tuple[int, int, int]]:
    """(first, last + 1, distance): stretches over which words `distance` apart are equal, within one text."""
    n, width, out = len(ids), 1, set()
    at, name = np.arange(n), ids
    while len(at):
        name, following = names(name)
        inside = following >= 0
        inside[inside] = text[at[inside]] == text[at[following[inside]]]
        step = np.where(inside, at[following] - at, 0)
        near = np.flatnonzero(inside & (step <= width))
        if len(near):
            # neighbouring positions with one distance are one stretch
            cut = np.flatnonzero(np.r_[True, (np.diff(at[near]) != 1) | (np.diff(step[near]) != 0), True])
            out.update(zip(at[near[cut[:-1]]].tolist(), (at[near[cut[1:] - 1]] + width).tolist(), step[near[cut[:-1]]].tolist()))
        again = inside.copy()
        again[following[inside]] = True
        full = np.full(n, -1)
        full[at[again]] = name[again]
        ok = at[again & (at + 2 * width <= n)]
        ok = ok[full[ok + width] >= 0]
        name, at, width = full[ok] * n + full[ok + width], ok, 2 * width
    return out


def runs(ids: np.ndarray, text: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in the order of start and period. `ids` are numbers of words, `text`
    the number of the text at each; texts do not share a separator."""
    found: dict[tuple[int, int], int] = {}
    n = len(ids)
    for lo, hi, q in proposals(ids, text):
        # a stretch of equal pairs is a part of the longest one around it; `times` - 1 periods of pairs are needed
        while lo and ids[lo - 1] == ids[lo - 1 + q]:
            lo -= 1
        while hi + q < n and ids[hi] == ids[hi + q]:
            hi += 1
        if hi - lo + q >= max(least, times * q):
            found[lo, hi + q] = min(q, found.get((lo, hi + q), q))
    return sorted((lo, hi - lo, q) for (lo, hi), q in found.items())


def collapse(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Words that stay: each run keeps its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, q in found:
        depth[start + q] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:-1]) == 0


def periodic(docs: DataFrame, keep: list[str] = ["doc_id"], text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """`keep` columns with n_words, runs (start, length, period in words, from 0) and collapsed, the words
    outside repetitions joined by one space."""
    if times < 3:
        raise ValueError("a run of fewer than three periods need not show at any level")
    taken = {c.split()[0] for c in RESULT.split(", ") if " " in c}
    if clash := taken & {c.lower() for c in keep}:
        raise ValueError(f"columns of the result: {sorted(clash)}")
    types = dict(docs.select(*keep).dtypes)
    df = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("body"))

    def run(b):
        vocab: dict[bytes, int] = {}
        words = [blank_words(t) for t in b.column("body").to_pylist()]
        sizes = np.array([len(w) for w in words], np.int64)
        ids = np.fromiter((x for i, w in enumerate(words) for x in (*(vocab.setdefault(y, len(vocab)) for y in w), -1 - i)), np.int64, sizes.sum() + len(words))
        text_of = np.repeat(np.arange(len(words)), sizes + 1)
        # non-negative names; each separator is a word of its own
        found, first = [[] for _ in words], np.r_[0, np.cumsum(sizes + 1)]
        for start, length, q in runs(ids + len(words), text_of, least, times):
            t = int(text_of[start])
            found[t].append((start - int(first[t]), length, q))
        out = [b" ".join(w) if not r else b" ".join(w[i] for i in np.flatnonzero(collapse(len(w), r))) for w, r in zip(words, found)]
        return {f"k{i}": b.column(f"k{i}") for i in range(len(keep))} | {
            "n_words": sizes, "collapsed": [x.decode("utf-8", "surrogatepass") for x in out],
            "runs": [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]}

    out = map_batches(df, run, ", ".join([f"k{i} {types[c]}" for i, c in enumerate(keep)] + [RESULT]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", "runs", "collapsed")


def planted(doc_id: Column, text: Column) -> Column:
    """The text whose words the query is asked to look at: of one document in ten by the CRC of its id, the
    words from some place on are a period over and over."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit("[^ \\t-\\r]+"), 0)
    s = F.struct(words.alias("w"), F.floor(h / 10).alias("g"))
    a = lambda s: F.pmod(s["g"], F.size(s["w"]))
    s = F.transform(F.array(s), lambda s: F.struct(s["w"].alias("w"), a(s).alias("a"), (1 + F.floor((F.size(s["w"]) - a(s)) / (3 + F.pmod(s["g"], F.lit(8))))).alias("p")))[0]
    at = lambda s, i: F.when(i < s["a"], i).otherwise(s["a"] + F.pmod(i - s["a"], s["p"]))
    edited = F.transform(F.array(s), lambda s: F.array_join(F.transform(s["w"], lambda _, i: s["w"][at(s, i).cast("int")]), " "))[0]
    return F.when((F.pmod(h, F.lit(10)) == 0) & text.rlike("[^ \\t-\\r]"), edited).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = periodic(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    better = lambda x, y: F.coalesce(x["length"] * y["period"] < y["length"] * x["period"], F.lit(True))
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    # in the order of start and period, only a greater exponent replaces
    best = F.aggregate("runs", none, lambda x, y: F.when(better(x, y), y).otherwise(x))
    line = lambda x: F.concat_ws(",", *[x[c].cast("string") for c in ("start", "length", "period")])
    listed = F.array_join(F.transform("runs", lambda x: F.concat(line(x), F.lit("\n"))), "")
    return out.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


OP13_SQL = r"""
with w0 as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') as w,
              list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint)),
                lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) as c
            from documents),
  w1 as (select doc_id, w, len(w)::bigint as n, xor(c, 4294967295::bigint) as h from w0),
  w2 as (select *, case when n > 0 then (h // 10) % n end as a, h // 10 as g from w1),
  w3 as (select *, 1 + (n - a) // (3 + g % 8) as p from w2),
  w4 as (select doc_id, n, case when h % 10 = 0 and n > 0
           then list_transform(range(n), lambda i: w[case when i < a then i + 1 else a + (i - a) % p + 1 end]) else w end as w from w3),
  t as (select doc_id, n, unnest(range(n)) as i, unnest(w) as w from w4),
  pairs as (select x.doc_id, y.i - x.i as q, x.i from t x join t y on x.doc_id = y.doc_id and x.w = y.w and y.i > x.i and 4 * (y.i - x.i) <= x.n),
  isl as (select doc_id, q, min(i) as s, count(*) as m from (select *, i - row_number() over (partition by doc_id, q order by i) as k from pairs) z group by doc_id, q, k),
  r as (select doc_id, s, m + q as len, min(q) as q from isl where m >= 3 * q and m + q >= 6 group by doc_id, s, m + q),
  best as (select distinct on (doc_id) doc_id, s, len, q from r order by doc_id, cast(len as double) / q desc, s, q),
  per as (select doc_id, count(*) as n_runs, sha256(string_agg(concat(s, ',', len, ',', q, chr(10)), '' order by s, q)) as runs_sha from r group by doc_id),
  gone as (select distinct doc_id, unnest(range(s + q, s + len)) as i from r),
  kept as (select t.doc_id, sha256(string_agg(t.w, ' ' order by t.i)) as col_sha from t anti join gone g on t.doc_id = g.doc_id and t.i = g.i group by t.doc_id)
select d.doc_id, coalesce(n_runs, 0)::bigint as n_runs, s::bigint as start, len::bigint as length, q::bigint as period,
  (1000 * len // q)::bigint as exponent_milli, coalesce(runs_sha, sha256('')) as runs_sha256, coalesce(col_sha, sha256('')) as collapsed_sha256
from documents d left join per on per.doc_id = d.doc_id left join best on best.doc_id = d.doc_id left join kept on kept.doc_id = d.doc_id
"""
