"""The Jaccard join against brute force."""
import itertools
import random

import numpy as np
import pytest

from cohortwave.llm import jaccard
from cohortwave.llm.jaccard import Tree, dual, similar


def shingles(text, k=5):
    import re
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for (i, (_, a)), (j, (_, b)) in itertools.combinations(enumerate(sets), 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "ß", "日本"]
    rows, passage = [], " ".join(rng.choices(vocab, k=40))
    for i in range(90):
        rows.append(" ".join(rng.choices(vocab, k=rng.choice([1, 3, 4, 5, 6, 20, 60, 200]))))
    for i in range(120):
        w = rng.choice(rows).split()
        for _ in range(rng.randint(0, max(1, len(w) // 30))):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append(" ".join(w) if rng.random() < .7 else " ".join(w).upper() + "\n")
    rows += [passage + " " + " ".join(rng.choices(vocab, k=rng.randint(0, 12))) for _ in range(60)]
    rows += ["", None, " \n", "", None, "one two", "one two", "ONE two", "x " * 3000, "x " * 2999]
    out = list(enumerate(rows))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("block", [4096, 16])
def test_components_equal_brute_force(spark, block, monkeypatch):
    rows = corpus(block)
    monkeypatch.setattr(jaccard.links, "__defaults__", (75, block))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "text as node", "doc_id as rep").repartition(5)
    assert sorted(map(tuple, similar(df).collect())) == brute(rows)


def test_edges_of_the_input(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert similar(empty).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (2, None), (None, "q r s")]
    got = similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 2, 1), (1, 2, 1), (2, 0, 2), (2, 0, 2), (None, 1, None)], key=str)


def test_stage_keeps_one_of_each_class(spark):
    rows = [(3, "a b c d e f", "en"), (1, "a b c d e f", "de"), (1, "a b c d e f", "de"), (4, None, None), (5, "z", None)]
    got = jaccard.jaccard_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert got.columns == ["doc_id", "text", "lang"]
    assert sorted(r.doc_id for r in got.collect()) == [1, 4, 5]


def test_trees_lose_no_pair():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 400, (30, 40))
    sets = [set(np.r_[pool[rng.integers(30)][: rng.integers(5, 40)], rng.integers(0, 400, rng.integers(0, 6))].tolist()) for _ in range(300)]
    sets.sort(key=len)
    bits = np.zeros((300, jaccard.BITS), np.uint8)
    for i, s in enumerate(sets):
        bits[i, [t * 7 % jaccard.BITS for t in s]] = 1
    bits = np.packbits(bits, axis=1).view("<u8")
    n, comp = np.array([len(s) for s in sets]), np.arange(300)
    want = {(i, j) for i, j in itertools.combinations(range(300), 2) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    out = list(dual(Tree(n, n, bits, comp), None))
    seen = sum(len(i) for i, _ in out)
    assert want <= {(a, b) for i, j in out for a, b in zip(i.tolist(), j.tolist())} and seen < 300 * 299 / 8
    left, right = slice(0, 250), slice(250, 300)
    across = {(a, b + 250) for i, j in dual(Tree(n[left], n[left], bits[left], comp[left]), Tree(n[right], n[right], bits[right], comp[right])) for a, b in zip(i.tolist(), j.tolist())}
    assert {(i, j) for i, j in want if i < 250 <= j} <= across


def test_chunks_with_equal_ends(spark):
    """Two partitions that begin and end with the same texts are two chunks."""
    rng = random.Random(4)
    x, y, a, b = (" ".join(f"{c}{rng.randrange(500)}" for _ in range(20)) for c in "xyab")
    near = b.rsplit(" ", 1)[0] + " other"
    parts = [[(1, x), (2, a), (9, y)], [(1, x), (3, b), (9, y)], [(1, x), (4, near), (9, y)]]
    df = spark.createDataFrame(spark.sparkContext.parallelize(parts, 3).flatMap(lambda r: r), "doc_id long, text string")
    assert [len(p) for p in df.rdd.glom().collect()] == [3, 3, 3]
    want = [t for rows in parts for t in rows]
    assert {tuple(r) for r in similar(df).collect()} == set(brute(want))
    assert similar(df).count() == 9


def test_repeated_rows_over_many_files(spark, tmp_path):
    rows = corpus(7)[:80]
    many = rows + rows[::3] + rows[:5] * 4
    random.Random(2).shuffle(many)
    spark.createDataFrame(many, "doc_id long, text string").repartition(9).write.parquet(f"{tmp_path}/d")
    got = similar(spark.read.parquet(f"{tmp_path}/d"))
    assert sorted(map(tuple, got.collect())) == brute(many)


def test_stage_decides_by_id_and_text(spark):
    k, z = "one two three four five six", "a b c d e f g"
    rows = [(1, k, "x"), (5, k, "y"), (5, z, "y"), (7, z, "n"), (None, k, "n"), (None, "q r s t u v", "n"), (None, "q r s t u v", "n"), (8, "", "n"), (8, "", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row string").withColumn("__NODE", spark_lit())
    got = jaccard.jaccard_stage(spark, df.repartition(3), "")
    assert got.columns == df.columns
    want = [(1, k, "x", 3), (5, z, "y", 3), (None, "q r s t u v", "n", 3), (8, "", "n", 3), (8, "", "n", 3)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def spark_lit():
    from pyspark.sql import functions as F
    return F.lit(3)
