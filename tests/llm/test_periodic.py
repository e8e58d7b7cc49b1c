"""Periodic runs against a brute-force search over all starts and periods."""
import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cohortwave.llm import periodic as pr


def brute(w, least=6, times=4):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def texts(seed):
    rng = random.Random(seed)
    out = [None, "", " \n\t", "a", "a " * 5, "a " * 6, "A a A a", "x y " * 4, "é ü " * 9 + "é", "\x1f \x85 " * 4, "word " * 30_000]
    for _ in range(150):
        vocab = ["a", "b", "c"][: rng.randint(1, 3)] if rng.random() < .5 else [f"w{i}" for i in range(40)]
        w = rng.choices(vocab, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            unit, at = rng.choices(vocab, k=rng.randint(1, 12)), rng.randint(0, len(w))
            w[at:at] = (unit * rng.randint(2, 9))[: rng.randint(1, 70)]
        out.append(rng.choice([" ", "\n", "  "]).join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_equal_brute_force(spark, seed):
    rows = [(i, t, "k") for i, t in enumerate(texts(seed))] + [(3, "a " * 6, "k")] * 2 + [(None, "b " * 7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, body string").repartition(3)
    got = pr.periodic(df, ["doc_id", "body", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        w = (r.text or "").encode().split()
        want = brute(w) if len(w) < 5000 else [(0, len(w), 1)]
        assert (r.n_words, [tuple(x) for x in r.runs]) == (len(w), want)
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r.collapsed == b" ".join(x for i, x in enumerate(w) if i not in gone).decode()


def test_lower_thresholds(spark):
    rows = [(i, t) for i, t in enumerate(texts(5)) if len(t or "") < 5000]
    got = pr.periodic(spark.createDataFrame(rows, "doc_id long, text string"), least=2, times=3).collect()
    assert {r.doc_id: [tuple(x) for x in r.runs] for r in got} == {i: brute((t or "").encode().split(), 2, 3) for i, t in rows}


def test_query_on_a_small_table(spark, tmp_path):
    rows = [(1000 + i, t) for i, t in enumerate(texts(3))] + [(None, "z " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pr.op13_periodic_runs(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    edited = 0
    for d, t in rows:
        w, r = (t or "").encode().split(), got[d]
        h = zlib.crc32(str(d).encode())
        if d is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            edited += 1
        runs = brute(w) if len(w) < 5000 or len(set(w)) > 1 else [(0, len(w), 1)]
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode())
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert r.collapsed_sha256 == sha(b" ".join(x for i, x in enumerate(w) if i not in gone))
    assert edited > 5


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pr.periodic(empty).count() == 0
    with pytest.raises(ValueError):
        pr.periodic(empty, times=2)
    with pytest.raises(ValueError):
        pr.periodic(empty.withColumn("Runs", F.lit(1)), ["doc_id", "Runs"])
