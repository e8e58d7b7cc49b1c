"""Phrase collocations by dynamic itemset counting.

Phrases of 1 .. `longest` words are counted per language while the corpus is
scanned shard by shard, round and round. Single words are counted from the first
step on. A longer phrase becomes active at the first boundary between shards at
which both its subphrases (without the last and without the first word) have
reached `least` occurrences, and is counted from there for exactly one full
cycle: the lengths are interleaved, and a phrase whose words are frequent need
not wait for the words' cycle to end. A phrase of `least` occurrences has
subphrases of as many, so none is missed, and its count is over the whole corpus.

In Spark: texts are cut into words once and written as rows of about a million
word numbers with their list of words, dealt evenly to the shards. A step scans
one shard; a task finds the active phrases of a row in arrays, and sends each once
with its count. One shuffle by
(language, phrase) adds them to the counters still in their cycle; a counter that
has gone round leaves with its total, or for good if that is below `least`.

What is active must be known to all tasks and its size must not grow with the
data: phrases are hashed to `slots` (at most `most_slots`), and a slot holds the
boundary at which the first of its phrases reached `least`. A phrase in a slot
with another may make longer phrases active early, never before its own parts
are (only that; they still go round once), so counts stay exact; crowded slots
cost counters, not results.

Then each candidate is cut after each word, its parts' counts are joined, the
lowest score counts, candidates absorbed by a longer one are dropped, and the
best `top` of each language are ranked, first per part of a language and then
over the parts. Numbers are decimals, exact up to 38 digits.

Edge cases: a null text is empty and gives nothing; a null language is `und`;
repeated rows count as often as they occur; equal scores are ordered by count,
then phrase; texts of any length are read whole; an empty table gives an empty
result. Only the named columns are read.
"""
from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import cut_lineage
from .common import large_rows, read, short_shuffles, slices

#: ASCII characters that end a piece; they become a word of a byte that UTF-8 does not use.
CUTS = b".,;:!?\n\x0b\x0c\r"
END = b"\xff"
_TO_END = bytes(0xFF if b in CUTS else b for b in range(256))
SENT = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("c", pa.int64()), ("since", pa.int32())])
CODED = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("words", pa.list_(pa.binary())), ("ids", pa.binary())])


class Numbers(dict):
    """Numbers of words in the order they are seen; 0 ends a piece."""

    def __init__(self):
        self[END] = 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def pieces(text: str) -> list[bytes]:
    """Lower-cased words (A-Z alone), END where a piece ends."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_TO_END).replace(END, b" \xff ").split()


def slot_of(parts, slots: int):
    """Slot of a phrase by the 64-bit hashes of its words (arrays of int64)."""
    x = parts[0]
    for h in parts[1:]:
        x = (x >> 20) ^ h
    return x & (slots - 1)


def packed(table: np.ndarray):
    """A table as its used slots while that is shorter."""
    at = np.flatnonzero(table)
    return (len(table), at.astype(np.uint32), table[at]) if 5 * len(at) < len(table) else table


def unpacked(table) -> np.ndarray:
    if isinstance(table, np.ndarray):
        return table
    out = np.zeros(table[0], np.uint8)
    out[table[1]] = table[2]
    return out


def active_from(reached: list[np.ndarray], h: np.ndarray, word: np.ndarray, longest: int):
    """(k, starts) for k = 2 ..: for each position, the boundary from which its phrase of k words is active; 0 if it is
    not (yet) or is none."""
    of_word = reached[0][slot_of([h], len(reached[0]))]
    of_word[0] = 0  # word 0 ends a piece
    known = of_word[word]
    for k in range(2, longest + 1):
        start = np.where((known[:-1] > 0) & (known[1:] > 0), np.maximum(known[:-1], known[1:]), 0)
        yield k, start
        if k < longest:
            at = np.flatnonzero(start)
            known = np.zeros(len(start), np.uint8)
            slot = reached[k - 1][slot_of([h[word[at + j]] for j in range(k)], len(reached[k - 1]))]
            # a slot's boundary may be another phrase's and lie before this one was active itself
            known[at] = np.where(slot > 0, np.maximum(slot, start[at]), 0)


def active_since(reached: list[np.ndarray], parts: list[np.ndarray]) -> np.ndarray:
    """As `active_from`, for active phrases by the hashes of their words: the last boundary of any shorter part."""
    k = len(parts)
    return reduce(np.maximum, [reached[m - 1][slot_of(parts[i:i + m], len(reached[m - 1]))] for m in range(1, k) for i in range(k - m + 1)])


def count_positions(words: np.ndarray, at: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The words (k arrays) and count of each distinct phrase of k words that starts at `at`."""
    code, named = words[at], []
    for j in range(1, k):
        if j > 1:
            named.append(np.unique(code))
            code = np.searchsorted(named[-1], code)
        code = (code << 32) | words[at + j]
    code.sort()
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    one, columns = code[first], []
    for j in range(k - 1, 0, -1):
        columns.append(one & 0xFFFFFFFF)
        one = one >> 32
        if j > 1:
            one = named[j - 2][one]
    return [one, *columns[::-1]], np.diff(np.r_[first, len(code)])


def _encode(shards: int, most_words: int):
    """Batches (lang, body) to rows (shard, lang, words, ids): a language's words of some texts, as numbers of a list of
    distinct words of which the first is END. Rows are dealt to the shards in turn."""
    def flush(texts: dict[str, list[np.ndarray]], vocab: Numbers, number: int):
        spelled = np.array(list(vocab), object)
        out = []
        for lang, parts in texts.items():
            word = np.concatenate(parts)
            used = np.flatnonzero(np.bincount(word))
            name = np.zeros(len(vocab), np.int32)
            name[used] = np.arange(len(used))
            ids = name[word]
            out.append(((TaskContext.get().partitionId() + number + len(out)) % shards, lang, spelled[used].tolist(), ids.astype("<i4").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), CODED.types)], schema=CODED)

    def run(batches):
        vocab, texts, held, number = Numbers(), {}, 0, 0
        for b in slices(batches, 64):
            for lang, body in zip(b.column("lang").to_pylist(), b.column("body").to_pylist()):
                ws = pieces(body)
                ids = np.fromiter(map(vocab.__getitem__, ws), np.int64, len(ws))
                texts.setdefault(lang, []).extend((ids, np.zeros(1, np.int64)))
                held += len(ids) + 1
            if held >= most_words:
                yield flush(texts, vocab, number)
                vocab, texts, held, number = Numbers(), {}, 0, number + len(texts)
        if texts:
            yield flush(texts, vocab, number)
    return run


def _scan(step: int, shards: int, longest: int, tables):
    """Rows (lang, words, ids) to (lang, phrase, c, since) of phrases active at this step and since when; '' counts all words."""
    def counted(lang: str, spelled: pa.Array, word: np.ndarray, reached: list[np.ndarray]):
        if step < shards:
            count = np.bincount(word)
            count[0] = 0
            at = np.flatnonzero(count)
            yield pa.array([""]), np.array([count.sum()]), np.zeros(1, np.int32)
            yield spelled.take(pa.array(at)), count[at], np.zeros(len(at), np.int32)
        seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 42)
        h = np.array([xxhash.xxh64_intdigest(x, seed) for x in spelled.to_pylist()], np.uint64).astype(np.int64)
        for k, start in active_from(reached, h, word, longest):
            at = np.flatnonzero((start > 0) & (start > step - shards))
            if len(at):
                words, c = count_positions(word, at, k)
                since = active_since(reached, [h[w] for w in words])
                yield pc.binary_join_element_wise(*[spelled.take(pa.array(w)) for w in words], b" "), c, since.astype(np.int32)

    def run(batches):
        reached = [unpacked(t) for t in tables.value]
        for b in batches:
            for lang, words, ids in zip(b.column("lang").to_pylist(), b.column("words"), b.column("ids")):
                for phrase, c, since in counted(lang, words.values, np.frombuffer(ids.as_buffer(), "<i4").astype(np.int64), reached):
                    for i in range(0, len(c), 100_000):
                        part = phrase.slice(i, 100_000).cast(pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(part), np.int64))), part,
                                                          pa.array(c[i:i + 100_000], pa.int64()), pa.array(since[i:i + 100_000])], schema=SENT)
    return run


def n_words(phrase: Column) -> Column:
    return F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1


def _reached(new: DataFrame, slots: int) -> list[tuple[int, int, bytes]]:
    """(words, numbers of 64-bit cells, cells) of the slots of phrases: slots / 64 cells at most for each length."""
    words = F.split("phrase", " ", -1)
    # as `slot_of`, from the language's and the words' hashes
    h = F.transform(words, lambda w: F.xxhash64("lang", w))
    x = F.aggregate(F.slice(h, F.lit(2), F.size(h)), h[0], lambda acc, y: F.shiftright(acc, 20).bitwiseXOR(y))
    marked = new.select(F.size(words).alias("k"), x.bitwiseAND(F.lit(slots - 1)).alias("slot")).distinct()
    packed = marked.select("k", F.floor(F.col("slot") / 64).alias("at"), F.expr("shiftleft(1L, cast(pmod(slot, 64) as int))").alias("bit"))
    packed = packed.groupBy("k", "at").agg(F.bit_or("bit").alias("bits"))
    packed = packed.groupBy("k", F.floor(F.col("at") / 1024).alias("segment")).agg(F.sort_array(F.collect_list(F.struct("at", "bits"))).alias("cells"))
    return [(r.k, [c.at for c in r.cells], [c.bits for c in r.cells]) for r in packed.collect()]


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, shards: int = 3,
           most_slots: int = 1 << 25, most_words: int = 1_000_000) -> DataFrame:
    """As `_counts`, its shuffles removed step by step."""
    with short_shuffles(docs.sparkSession):
        return _counts(docs, text, lang, longest, least, shards, most_slots, most_words)


def _counts(docs: DataFrame, text: str, lang: str, longest: int, least: int, shards: int, most_slots: int, most_words: int) -> DataFrame:
    """lang, phrase and exact f of all phrases of 1 .. `longest` words with at least `least` occurrences; phrase '' has the number of words."""
    spark = docs.sparkSession
    body = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("body")).where("body <> ''")
    coded = cut_lineage(body.mapInArrow(_encode(shards, most_words), "shard int, lang string, words array<binary>, ids binary"), "words")
    words = coded.agg(F.sum(F.length("ids")).alias("b")).first()["b"] or 0
    slots = min(most_slots, 1 << max(16, math.ceil(math.log2(words / 4 + 1))))
    tables = [np.zeros(slots, np.uint8) for _ in range(longest - 1)]
    state, done = None, []
    for step in itertools.count():
        shared = spark.sparkContext.broadcast([packed(t) for t in tables])
        seen = coded.where(F.col("shard") == step % shards).select("lang", "words", "ids") \
            .mapInArrow(_scan(step, shards, longest, shared), "lang string, phrase string, c long, since int")
        seen = seen.withColumn("reached", F.lit(False))
        if state is not None:  # counters that have not gone round
            seen = seen.unionByName(state.where(F.col("since") + shards > step).drop("fresh"))
        ended = F.col("since") + shards <= step + 1
        keep = F.col("reached") | (F.col("phrase") == "")
        # rows of a task are distinct already, so they are dealt out before any of them is added
        g = seen.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("c").alias("c"), F.min("since").alias("since"), F.max("reached").alias("was"))
        g = g.select("lang", "phrase", "c", "since", (F.col("c") >= least).alias("reached"), (~F.col("was") & (F.col("c") >= least)).alias("fresh"))
        with large_rows(spark):
            state = cut_lineage(g.where(keep | ~ended), "counters")
        shared.destroy()
        new = state.where(F.col("fresh") & (F.col("phrase") != "")).where(n_words(F.col("phrase")) < longest)
        for k, at, bits in _reached(new, slots):
            full = np.zeros((len(at), 64), np.uint8)
            full[:] = np.unpackbits(np.array(bits, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, col = np.nonzero(full)
            where = np.array(at, np.int64)[row] * 64 + col
            table = tables[k - 1]
            table[where] = np.where(table[where] == 0, step + 1, table[where])
        last = max([shards, *(int(t.max()) + shards for t in tables if t.any())])
        done.append(state.where(keep & ended))
        if step + 1 >= last:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return cut_lineage(out.select("lang", "phrase", F.col("c").alias("f")), "phrases")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, absorb: int = 50,
                 top: int | None = 2000, parts: int = 64, **how) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score (`top` of each language; all if None)."""
    f = counts(docs, text, lang, longest, least, **how)
    words = F.split("phrase", " ", -1)
    cand = f.where(n_words(F.col("phrase")) >= 2).select("lang", "phrase", F.col("f").alias("a"), words.alias("w"))
    k = F.size("w")
    subs = cand.where(k > 2).select("lang", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), k - 1), lambda m: F.transform(
        F.sequence(F.lit(1), k - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))).alias("phrase"))
    subs = subs.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = cand.join(subs, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("around") < absorb * F.col("a"), F.lit(True))).drop("around")
    cut = kept.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), k - 1)).alias("k"))
    cut = cut.withColumn("first", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ")).withColumn("rest", F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ")).drop("w")
    side = lambda part, c: f.select("lang", F.col("phrase").alias(part), F.col("f").alias(c))
    cut = cut.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    cut = cut.withColumn("score", F.expr("cast(1000000 * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) as decimal(38,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    best = cut.groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("b")).select("lang", "phrase", "a", "b.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is None:
        return best
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    near = best.withColumn("part", part).withColumn("i", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("i") <= top)
    near = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = f.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return near.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


OP11_SQL = r"""
with p as (select coalesce(lang, 'und') as lang, doc_id, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) as piece from documents),
  w as (select lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') as w from p),
  g as (select lang, 1 as k, unnest(w) as phrase from w
        union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w
        union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from w),
  f as (select lang, k, phrase, count(*) as f from g group by 1, 2, 3),
  n as (select lang, sum(f)::bigint as n from f where k = 1 group by 1),
  c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= 10),
  sub as (select lang, phrase, max(a) as around from (select lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) as phrase from c where k = 3) x group by 1, 2),
  kept as (select c.* from c left join sub using (lang, phrase) where around is null or 100 * around < 50 * a),
  cut as (select lang, phrase, a, 1 as j, w[1] as x, array_to_string(w[2:], ' ') as y from kept
          union all select lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] from kept where k = 3),
  sc as (select cut.*, l.f as l, r.f as r, ((1000000::hugeint * a * a) // (l.f::hugeint * r.f))::bigint as score
         from cut join f l on l.lang = cut.lang and l.phrase = x join f r on r.lang = cut.lang and r.phrase = y),
  b as (select distinct on (lang, phrase) lang, phrase, a, l, r, score from sc order by lang, phrase, score, j),
  rk as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b)
select lang, rank, phrase, a, l, r, n, score from rk join n using (lang) where rank <= 2000
"""
