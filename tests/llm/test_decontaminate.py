"""Decontamination against brute force."""
import hashlib
import random
import re

from cohortwave.llm.decontaminate import decontaminate_stage, scan


def toks(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or ""))


def brute(doc, items, width=13):
    w, hit, found = toks(doc), set(), set()
    for item, text in items:
        b = toks(text)
        for i in range(max(1, len(b) - width + 1) if b else 0):
            g = b[i:i + width]
            for j in range(len(w) - len(g) + 1):
                if w[j:j + len(g)] == g:
                    hit.update(range(j, j + len(g)))
                    found.add(item)
    found = sorted(str(x) for x in found if x is not None)
    return len(w), len(hit), found, bool(hit) and 20 * len(hit) >= len(w)


def fixture():
    rng = random.Random(3)
    vocab = ["a", "b", "É", "ñu", "c1"]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, say(n)) for i, n in enumerate([13, 14, 30, 5, 2, 12, 13])] + [(20, None), (21, " ?! "), (None, say(15)), (0, say(13))]
    docs = []
    for _ in range(120):
        t = say(rng.choice([0, 3, 12, 40, 300]))
        if rng.random() < .6:
            b = rng.choice(items)[1] or ""
            t = t + " Z, " + (b.upper().replace(" ", "-") if rng.random() < .5 else b) + ". " + say(rng.choice([0, 2, 200]))
        docs.append(t)
    return items, docs + [None, "", "...", "word " * 5000]


def test_scan_equals_brute_force(spark):
    items, docs = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, n_hit int").repartition(3)
    want = {i: brute(t, items) for i, t in enumerate(docs)}
    for size in (2_000_000, 5):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in scan(df, bench, ["doc_id"], block_windows=size).collect()}
        assert got == want
    assert scan(df.limit(0), bench, ["doc_id"]).count() == 0
    assert {r.n_hit for r in scan(df, bench.limit(0), ["doc_id"]).collect()} == {0}


def test_query_columns_and_stage(spark, tmp_path):
    from cohortwave.llm.decontaminate import op9_benchmark_decontamination
    items, docs = fixture()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: brute(t, items) for i, t in enumerate(docs)}
    for r in op9_benchmark_decontamination(spark, str(tmp_path)).collect():
        n, h, found, bad = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, h, len(found), bad)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
    kept = decontaminate_stage(spark, df, str(tmp_path))
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, x in want.items() if not x[3]}
