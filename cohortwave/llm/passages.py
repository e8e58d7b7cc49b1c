"""Repeated passages by paragraph MinHash banding.

Lines are paragraphs, and so are runs of lines under `PIECE` words. They are cut
into pieces at places chosen by content alone (least hash of two words among its
neighbours), so the same passage gives the same pieces inside, wherever it stands. A
piece is the set of its 5-word shingles. `tune` picks the bands that
reach a recall at the similarity; pieces with a band key of their own only
leave at once. Equal pieces are merged before anything is paired; colliding ones
are compared by exact Jaccard, first with the most typical piece of their band's
group, then with every other that still may be similar (`jaccard.links`, so a
group is never paired out). Components of the links are the classes. Stretches that
are compared as they are (`anchors`) join them: two copies of `SURE` words in a
paragraph always share one, and a paragraph under `PIECE` words comes with the piece beside it.
The first piece of a class (by document and place) stays, the others are removed
where at least `least_words` repeated words stand in a row.

Band groups are only aggregated and joined, never collected, so one line that a
third of all documents share is as many small rows; sets are read for pieces
that collide. Work on a piece uses its whole text.

Edge cases: null and empty texts have no pieces; texts under `PIECE`
words are never changed; a passage must occur in two rows; repeated rows count
as copies of each other and give one row per piece; pieces of one class that overlap
in a row are one; null ids sort first; an empty table gives
no rows. Offsets count words `[^\\x20\\x09-\\x0D]+`. Only the named columns are read.
"""
from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import cut_lineage
from .common import blank_words, components, map_batches, read
from .jaccard import BITS, MIX, links, mix

K, PERCENT, PIECE = 5, 75, 8
#: Copies of SURE words share a window of ANCHOR words.
SURE, ANCHOR = 51, 16
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def tune(similarity: float = 0.75, recall: float = 0.98, rows: int = 1) -> int:
    """Fewest bands of `rows` minima each that reach the recall at the similarity."""
    bands = 1
    while 1 - (1 - similarity ** rows) ** bands < recall:
        bands += 1
    return bands


def constants(bands: int) -> list[np.uint64]:
    """An odd hash constant for each band."""
    more = mix(np.arange(1, max(0, bands - len(MIX)) + 1, dtype=np.uint64) * MIX[0], MIX[1]) | np.uint64(1)
    return [*MIX, *more][:bands]


class PieceWord(dict):
    """Word hashes up to a bound."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        v = self[w] = xxhash.xxh3_64_intdigest(w.lower())
        return v


def paragraphs(texts: list[str | None], hashes: PieceWord, joined: bool) -> tuple[np.ndarray, ...]:
    """Text number, first word there, words and place of the lines, or with `joined` of the lines from
    PIECE words on and of the runs of shorter ones between them; and the hashes of all words."""
    flat: list[int] = []
    rows: list[tuple[int, int, int, int]] = []
    for t, x in enumerate(texts):
        at, short = 0, False
        for line in (x or "").split("\n"):
            ws = line.encode("utf-8", "surrogatepass").split()
            n = len(ws)
            if n and short and n < PIECE and joined:
                rows[-1] = (*rows[-1][:2], rows[-1][2] + n, rows[-1][3])
            elif n:
                rows.append((t, at, n, len(flat)))
                short = n < PIECE
            flat.extend([hashes[w] for w in ws])
            at += n
    return *np.array(rows, np.int64).reshape(-1, 4).T, np.array(flat, np.uint64)


def pieces(texts: list[str | None], hashes: PieceWord, longest: int = 64, joined: bool = False) -> tuple[np.ndarray, ...]:
    """Pieces of all texts: text number, first word there, words, place in the last array; and the hashes of all words."""
    return cut(*paragraphs(texts, hashes, joined), longest)


def cut(text: np.ndarray, first: np.ndarray, count: np.ndarray, place: np.ndarray, flat: np.ndarray, longest: int = 64) -> tuple[np.ndarray, ...]:
    """Pieces of the paragraphs of PIECE words and more. A cut is where the hash of the two words around
    it is least among those less than PIECE words away; it does not depend on other cuts."""
    long = count >= PIECE
    text, first, count, place = text[long], first[long], count[long], place[long]
    two = np.zeros(len(flat), np.uint64)
    two[1:] = mix(flat[1:] ^ mix(flat[:-1], MIX[0]), MIX[1])
    least = np.zeros(len(flat) + 1, bool)
    for b, n in zip(place.tolist(), count.tolist()):
        least[b + PIECE:b + n - PIECE + 1] = True  # the places that may be cut, their neighbours are in the paragraph
    least = least[:-1]
    for j in range(1, PIECE):
        least[j:] &= two[j:] < two[:-j]
        least[:-j] &= two[:-j] <= two[j:]
    at = np.sort(np.concatenate([place, np.flatnonzero(least)]))
    own = np.searchsorted(place, at, "right") - 1
    n = np.minimum(np.append(at[1:], len(flat)), (place + count)[own]) - at
    k = np.where(n >= longest + PIECE, (n - PIECE) // longest, 0)  # where no place is least, as in one word over and over
    src = np.repeat(np.arange(len(at)), k + 1)
    nth = np.arange(len(src)) - np.repeat(np.cumsum(k + 1) - (k + 1), k + 1)
    n, at, own = np.where(nth < k[src], longest, n[src] - nth * longest), at[src] + nth * longest, own[src]
    return text[own], first[own] + at - place[own], n, at, flat


def anchors(text: np.ndarray, first: np.ndarray, count: np.ndarray, place: np.ndarray, flat: np.ndarray, piece_at: np.ndarray, piece_words: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text number, first word, words and place of stretches that are compared as they are.

    Of every SURE - ANCHOR + 1 neighbouring ANCHOR-word windows of a paragraph the one with the least hash,
    so two copies of SURE words share one wherever they stand; and paragraphs under PIECE words with the piece before them, or after them at the start of a text."""
    m = len(flat) - ANCHOR + 1
    at = np.zeros(0, np.int64)
    width = SURE - ANCHOR + 1
    if m >= width:
        h, step = mix(flat, MIX[2]), 1
        while step < ANCHOR:
            h = mix(mix(h[:-step], MIX[0]) + h[step:], MIX[1])
            step *= 2
        ok = count >= SURE
        begins = np.repeat(place[ok], count[ok] - SURE + 1)
        many = count[ok] - SURE + 1
        begins = begins + np.arange(len(begins)) - np.repeat(np.cumsum(many) - many, many)
        low, step = h.copy(), 1  # least of the next windows, by doubling; then its last place
        while 2 * step <= width:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        low = np.minimum(low[begins], low[begins + width - step])
        hit = np.zeros(m, bool)
        todo = np.arange(len(begins))
        for j in range(width - 1, -1, -1):
            is_ = h[begins[todo] + j] == low[todo]
            hit[begins[todo[is_]] + j] = True
            todo = todo[~is_]
        at = np.flatnonzero(hit)
    own = np.searchsorted(place, at, "right") - 1
    parts = [(text[own], first[own] + at - place[own], np.full(len(at), ANCHOR), at)]
    small = np.flatnonzero(count < PIECE)
    if len(small) and len(piece_at):
        left = np.searchsorted(piece_at, place[small]) - 1
        begin = place[np.searchsorted(text, text[small])]  # of the text
        before = (left >= 0) & (piece_at[left] >= begin)
        lead = small[~before & (np.searchsorted(text, text[small], "right") > small + 1)]
        small, left = small[before], left[before]
        parts.append((text[small], first[small] - (place[small] - piece_at[left]), place[small] + count[small] - piece_at[left], piece_at[left]))
        right = np.searchsorted(piece_at, place[lead])
        parts.append((text[lead], first[lead], piece_at[right] + piece_words[right] - place[lead], place[lead]))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*parts))


def shingles(count: np.ndarray, place: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all pieces, one after the other, and where each piece's begin."""
    if not len(count):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.full(len(flat) - K + 1, 17, np.uint64)
    for j in range(K):
        acc = mix(acc ^ flat[j:j + len(acc)], MIX[0]) + MIX[1]
    many = count - K + 1
    begin = np.cumsum(many) - many
    return acc[np.arange(many.sum()) - np.repeat(begin - place, many)], begin


def content(count: np.ndarray, place: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """A hash of each piece's words in their order."""
    begin = np.cumsum(count) - count
    nth = np.arange(count.sum()) - np.repeat(begin, count)
    word = flat[nth + np.repeat(place, count)]
    return (mix(np.add.reduceat(mix(word ^ mix(nth.astype(np.uint64) + MIX[3], MIX[2]), MIX[1]), begin), MIX[0]) if len(count) else np.zeros(0, np.uint64)).astype(np.int64)


def sketched(docs: DataFrame, doc_id: str, text: str, bands: int) -> DataFrame:
    """row, start, words, same (hash of the words) and keys of each piece; row is (id, hash of the text)."""
    df = docs.select(F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash")).alias("row"), F.col(text).alias("body"))
    kind = dict(df.dtypes)["row"]

    hashes = PieceWord()

    def run(b):
        lines = paragraphs(b.column("body").to_pylist(), hashes, True)
        text, first, count, place, flat = cut(*lines)
        as_is = anchors(*lines, place, count)
        sh, begin = shingles(count, place, flat)
        mins = np.stack([np.minimum.reduceat(mix(sh, m), begin) if len(begin) else sh for m in constants(bands)], axis=1).astype(np.int64)
        same = content(count, place, flat), content(as_is[2], as_is[3], flat)
        return {"row": b.column("row").take(np.concatenate([text, as_is[0]])), "start": np.concatenate([first, as_is[1]]), "words": np.concatenate([count, as_is[2]]),
                "same": np.concatenate(same), "keys": [*mins, *same[1][:, None]]}

    return map_batches(df, run, f"row {kind}, start int, words int, same long, keys array<long>")


def whole_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """same and set of the wanted pieces (row, start, words), from the texts of their rows."""
    per_row = wanted.groupBy("row").agg(F.collect_set(F.struct("start", "words")).alias("spans"))
    df = docs.select(F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash")).alias("row"), F.col(text).alias("body"))
    both = df.join(per_row, df.row.eqNullSafe(per_row.row)).select("body", "spans")
    hashes = PieceWord()

    def run(b):
        flat, count = [], []
        for t, spans in zip(b.column("body").to_pylist(), b.column("spans").to_pylist()):
            ws = blank_words(t)
            for x in spans:
                flat += [hashes[w] for w in ws[x["start"]:x["start"] + x["words"]]]
                count.append(x["words"])
        count, flat = np.array(count, np.int64), np.array(flat, np.uint64)
        place = np.cumsum(count) - count
        sh, begin = shingles(count, place, flat)
        return {"same": content(count, place, flat), "set": [np.unique(x).astype(np.int64) for x in np.split(sh, begin[1:])] if len(begin) else []}

    return map_batches(both, run, "same long, set array<long>").dropDuplicates(["same"])


def ranked(sets: DataFrame, bands: int) -> DataFrame:
    """The sets as `jaccard.links` takes them: shared shingles in the order (frequency, shingle), band keys, bitmap."""
    toks = sets.select("same", F.size("set").alias("n"), F.explode("set").alias("tok"))
    df = toks.groupBy("tok").agg(F.count("*").alias("df"))
    lists = toks.join(df, "tok").groupBy("same").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("t"))
    lists = lists.select("same", "n", F.col("t.df").alias("df"), F.col("t.tok").alias("tok"))

    def run(b):
        size = np.diff(b.column("tok").offsets.to_numpy())
        begin, own = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
        t, df = (b.column(c).flatten().to_numpy() for c in ("tok", "df"))
        t, shared, n = t.astype(np.uint64), df > 1, b.column("n").to_numpy().astype(np.int64)
        held = np.bincount(own[shared], minlength=len(n))
        bits = np.zeros((len(n), BITS), np.uint8)
        bits[own[shared], (mix(t[shared], MIX[2]) >> np.uint64(54)).astype(int)] = 1
        return {"nid": b.column("same"), "n": n, "toks": np.split(t[shared].astype(np.int64), np.cumsum(held)[:-1]),
                "posted": np.maximum(0, n - -(-n * PERCENT // 100) + 1 - (n - held)),
                "mins": list(np.stack([np.minimum.reduceat(mix(t, m), begin) for m in constants(bands)], axis=1).astype(np.int64)),
                "bits": [x.tobytes() for x in np.packbits(bits, axis=1)], "typical": np.round(np.add.reduceat(np.log2(df), begin) / n, 6)}

    return map_batches(lists, run, "nid long, n long, toks array<long>, posted int, mins array<long>, bits binary, typical double")


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = 16, recall: float = 0.98) -> DataFrame:
    """doc_id, start, n_words, class_id, class_size and removed of each repeated piece."""
    bands = tune(PERCENT / 100, recall)
    all_ = cut_lineage(sketched(docs, doc_id, text, bands), "pieces")
    keys = all_.select("same", F.explode("keys").alias("key"))
    # keys are counted before they are joined; mixed ones have pieces that differ, the others need no comparison
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), (F.min("same") != F.max("same")).alias("mixed")).where("n > 1").select("key", "mixed")
    twice = cut_lineage(keys.join(shared, "key").groupBy("same").agg(F.max("mixed").alias("mixed")), "colliding")
    first = all_.join(twice.where("mixed").select("same"), "same").groupBy("same").agg(F.min(F.struct("row", "start", "words")).alias("at"))
    sets = cut_lineage(whole_sets(docs, first.select("at.row", "at.start", "at.words"), doc_id, text), "sets")
    comp = components(links(cut_lineage(ranked(sets, bands), "ranked"), PERCENT))
    same = twice.select("same").join(comp, F.col("same") == F.col("node"), "left").select("same", F.coalesce("root", "same").alias("root"))
    hits = all_.drop("keys").join(same, "same")
    hits = hits.groupBy("root", "row", "start").agg(F.max("words").alias("words"), F.count("*").alias("times"))
    end = F.col("start") + F.col("words")
    fresh = lambda by, overlap: F.when(F.max(end).over(by.rowsBetween(W.unboundedPreceding, -1)) >= F.col("start") + F.lit(overlap), 0).otherwise(1)
    within = W.partitionBy("root", "row").orderBy("start")  # pieces of one class that overlap are one
    hits = hits.withColumn("fresh", fresh(within, 1)).withColumn("nth", F.sum("fresh").over(within)).groupBy("root", "row", "nth").agg(
        F.min("start").alias("start"), (F.max(end) - F.min("start")).alias("words"), F.max("times").alias("times")).drop("nth")
    hits = cut_lineage(hits, "hits")
    size = hits.groupBy("root").agg(F.sum("times").alias("class_size"), F.min(F.struct("row", "start")).alias("keep"), F.max("row").alias("last"), F.max("times").alias("t"))
    hits = hits.join(size.where("last <> keep.row or t > 1"), "root")
    w = W.partitionBy("row").orderBy("start", "words")  # the pieces of one text
    run = W.partitionBy("row", "run")
    return (hits.withColumn("fresh", fresh(w, 0)).withColumn("run", F.sum("fresh").over(w)).withColumn("run_words", F.max(end).over(run) - F.min("start").over(run)).where(F.col("run_words") >= least_words)
            .select(F.col("row.id").alias("doc_id"), "start", F.col("words").alias("n_words"), F.col("root").alias("class_id"), "class_size",
                    (F.struct("row", "start") != F.col("keep")).alias("removed")))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the (start, n_words) spans."""
    gone = {i for s, n in spans for i in range(s, s + n)}
    out, end = [], 0
    for i, m in enumerate(WORD.finditer(text)):
        if i in gone:
            out.append(text[end:m.start()].rstrip(" "))
            end = m.end()
    return "".join([*out, text[end:]])


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(read(spark, sf_dir, "documents"))
