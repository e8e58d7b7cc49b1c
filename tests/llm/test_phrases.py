"""Dynamic itemset counting against plain counts."""
import random
import re
from collections import Counter
from fractions import Fraction

import pytest

from cohortwave.llm import phrases as ph


def plain_counts(rows, longest):
    f = Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall("[^ \t]+", piece)
            f[lang or "und", ""] += len(w)
            f.update((lang or "und", " ".join(w[i:i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    return f


def plain(rows, longest=3, least=10, absorb=50):
    f = plain_counts(rows, longest)
    cand = {k: v for k, v in f.items() if " " in k[1] and v >= least}
    around = Counter()
    for (lang, p), v in cand.items():
        w = p.split(" ")
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                around[lang, " ".join(w[i:i + m])] = max(v, around[lang, " ".join(w[i:i + m])])
    out = []
    for (lang, p), a in cand.items():
        if around[lang, p] and 100 * around[lang, p] >= absorb * a:
            continue
        w = p.split(" ")
        cuts = [(f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]) for k in range(1, len(w))]
        score, k = min((Fraction(10 ** 6 * a * a, lo * r).__floor__(), k) for k, (lo, r) in enumerate(cuts))
        out.append((lang, p, a, *cuts[k], score))
    return sorted(out)


def corpus(seed):
    """Words, pairs and triples of which some occur in a few documents only, so that they are activated late."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(25)] + ["É", "é", "日本", "X", "x", "\x00", "a\x85b"]
    rows = [(rng.choice(["en", "de", None, "und"]), rng.choice([" ", "  ", "\t", " . ", ", "]).join(rng.choices(vocab, k=rng.randint(0, 40)))) for _ in range(120)]
    rows += [("fr", " ".join(["late"] * 30)), ("fr", "late late word"), ("fr", " ".join(["a b c d"] * 12)), (None, None), ("en", ""), ("en", "?!\n")]
    rows += [("it", "Alpha beta gamma delta\nALPHA beta gamma delta; alpha beta gamma")] * 5
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shards, slots, words, longest", [(3, 1 << 16, 3_000_000, 3), (1, 1 << 16, 100, 3), (5, 4, 300, 4)])
def test_counts_equal_plain_counts(spark, shards, slots, words, longest):
    """Also where a few slots hold all phrases and where chunks are small."""
    rows = corpus(shards)
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("lang", "text", "1 as f", "text as phrase").repartition(4)
    got = ph.counts(df, shards=shards, most_slots=slots, most_words=words, longest=longest).collect()
    want = {k: v for k, v in plain_counts(rows, longest).items() if v >= 10 or not k[1] and v}
    assert len(got) == len(want) and {(r.lang, r.phrase): r.f for r in got} == want


def test_shared_slots_lose_no_phrase(spark):
    """A slot may name a boundary before the phrase in it was active; a longer phrase is still counted in every shard."""
    rows = [("en", f"r{i} f{i % 20} f{i * 7 % 21} .") for i in range(500) for _ in range(10 + i % 5)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(8)
    got = ph.counts(df, most_slots=256, most_words=1000).collect()
    want = {k: v for k, v in plain_counts(rows, 3).items() if v >= 10}
    assert {(r.lang, r.phrase): r.f for r in got} == want


def test_collocations(spark):
    rows = corpus(9)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = ph.collocations(df, top=None).select("lang", "phrase", "a", "l", "r", "score").collect()
    assert sorted(map(tuple, got)) == plain(rows)
    n = Counter()
    for (lang, p), v in plain_counts(rows, 1).items():
        n[lang] += v * (p == "")
    ranked = ph.collocations(df, top=4, parts=3).collect()
    for lang in n:
        best = sorted((x for x in plain(rows) if x[0] == lang), key=lambda x: (-x[5], -x[2], x[1].encode()))[:4]
        mine = sorted((r for r in ranked if r.lang == lang), key=lambda r: r["rank"])
        assert [(r["rank"], r.phrase, r.n) for r in mine] == [(i + 1, x[1], n[lang]) for i, x in enumerate(best)]


def test_edges(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert ph.collocations(empty).count() == 0
    assert ph.collocations(spark.createDataFrame([(None, None), ("en", " ")], "lang string, text string")).count() == 0


def test_large_products_are_exact(spark):
    a, other = 10 ** 15 - 7, 10 ** 15 - 1
    df = spark.createDataFrame([(a, other)], "a long, l long").selectExpr(
        "cast(1000000 * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) as decimal(38,0)) div (cast(l as decimal(19,0)) * cast(l as decimal(19,0))) as s")
    assert df.first().s == 10 ** 6 * a * a // (other * other)
