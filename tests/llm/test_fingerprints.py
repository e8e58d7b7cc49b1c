"""Fingerprints against sums written out in Python."""
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from cohortwave.llm import fingerprints as fg


def vector(p):
    h = [hashlib.sha256(f"{j}:{p}".encode()).hexdigest() for j in range(4)]
    m = int(h[2][60:], 16) & 127
    level = 7 if m == 0 else 8 - 1 - m.bit_length()
    return [int(h[i // 4][15 * (i % 4):15 * (i % 4) + 15], 16) for i in range(16)], level * 32 + int(h[1][60:], 16) % 32, 1 + int(h[0][60:], 16) % 65535


def plain(text):
    n, dense, cells = 0, [0] * 16, [0] * 256
    for p in text.split("\n") if text else []:
        d, c, v = vector(p)
        n, dense, cells[c] = n + 1, [(a + b) % 2 ** 60 for a, b in zip(dense, d)], (cells[c] + v) % 2 ** 16
    return n, dense, cells


def hexes(f):
    return f"{f[0]:08x}" + "".join(f"{x:015x}" for x in f[1]) + "".join(f"{x:04x}" for x in f[2])


def texts(seed=0, n=120):
    rng = random.Random(seed)
    lines = [" ".join(rng.choices("ab é 日 word other".split(), k=rng.randint(0, 9))) for _ in range(60)]
    return ["", None, "\n", "x", "x\n", "é" * 5] + ["\n".join(rng.choices(lines, k=rng.randint(1, 40))) for _ in range(n)]


def test_fingerprint_and_its_algebra(spark):
    rows = list(zip(texts(1), texts(2)))
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", fg.fingerprint(F.col("a")).alias("x"), fg.fingerprint(F.col("b")).alias("y"))
    joined = F.concat_ws("\n", F.when(F.col("a") != "", F.col("a")), F.when(F.col("b") != "", F.col("b")))
    turned = F.array_join(F.reverse(F.split("a", "\n", -1)), "\n")
    both = fg.combined(F.col("x"), F.col("y"))
    out = df.select("a", "b", fg.digits(F.col("x")).alias("own"), fg.digits(both).alias("both"), fg.digits(fg.fingerprint(joined)).alias("joined"),
                    fg.digits(fg.fingerprint(turned)).alias("turned"), fg.digits(fg.combined(both, F.col("y"), -1)).alias("back"),
                    fg.likeness(F.col("x"), both).alias("like")).collect()
    for r in out:
        assert r.own == hexes(plain(r.a or "")) == r.back
        assert r.both == r.joined and r.turned == (r.own if r.a is not None else hexes(plain("")))
        assert 0 <= r.like <= 1 and (r.like == 1) == (not r.b)


def test_likeness_follows_the_share_of_common_paragraphs(spark):
    rng, rows = random.Random(5), []
    for n in (6, 40, 400, 5000):
        for share in (0, .2, .5, .9, 1):
            common = [str(rng.random()) for _ in range(round(n * share))]
            own = lambda: [str(rng.random()) for _ in range(n - len(common))]
            rows.append((len(common) / (2 * n - len(common)), "\n".join(common + own()), "\n".join(own() + common[::-1])))
    got = spark.createDataFrame(rows, "want double, a string, b string").select("want", fg.likeness(fg.fingerprint(F.col("a")), fg.fingerprint(F.col("b"))).alias("got")).collect()
    assert max(abs(r.got - r.want) for r in got) < .25
    assert sum(abs(r.got - r.want) for r in got) / len(got) < .06


@pytest.mark.parametrize("size, cuts", [(1, 1000), (7, 1000), (3, 4), (1000, 1000)])
def test_each_row_is_followed_by_the_next_id(spark, size, cuts):
    t = texts(3)
    rng = random.Random(size)
    ids = rng.sample(range(-500, 10_000), len(t) - 40) + [77] * 25 + [None] * 15
    rows = [(i, x, 1) for i, x in zip(ids, t)] + [(77, "x\ny", 1)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int").repartition(6)
    h = {r.text: r.h for r in df.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(((i, x or "") for i, x, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), h[r[1]], r[1]))
    want = sorted((str(i), x, y) for (i, x), (_, y) in zip(order, order[1:] + order[:1]))
    out = fg.followed(df, bucket_rows=size, most_cuts=cuts).select("id", "text", "next_text", fg.digits(F.col("next_fp")).alias("f")).collect()
    assert sorted((str(r.id), r.text, r.next_text) for r in out) == want
    assert all(r.f == hexes(plain(r.next_text)) for r in out)


def test_edges(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fg.followed(empty).count() == 0
    one = fg.followed(spark.createDataFrame([(5, "a\nb")], "doc_id long, text string")).first()
    assert one.next_text == "a\nb" and one.fp == one.next_fp
    with pytest.raises(ValueError):
        fg.followed(spark.createDataFrame([("5", "a")], "doc_id string, text string"))
    rows = [(4, "ab\ncd\nef"), (9, "12345"), (2, ""), (3, None), (1, "é" * 7)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fg.op12_document_fingerprints(spark, str(tmp_path)).collect()}
    want = {9: "123ab", 4: "ab\nc", 3: "", 2: "", 1: "éééé123"}
    assert {d: r.edited_sha256 for d, r in got.items()} == {d: hashlib.sha256(x.encode()).hexdigest() for d, x in want.items()}
    assert all(r.edited_fingerprint == hexes(plain(want[d])) for d, r in got.items())
    assert got[3].near_next == got[3].near_edited == 1.0 and got[1].n_chars == 7 and not math.isnan(got[1].near_edited)
