"""Toxicity: block-max search against a full scan, held-out accuracy, edge cases."""
import zlib

import numpy as np

from cohortwave.llm.toxicity import Index, op4_toxicity, score


def test_nearest_equal_a_full_scan():
    rng = np.random.default_rng(0)
    vectors = []
    for _ in range(700):
        at = np.sort(rng.choice(40, rng.integers(0, 7), replace=False))
        vectors.append((at, rng.integers(1, 5, len(at))))
    labels = rng.integers(0, 2, 700)
    ix = Index(range(700), labels, vectors, rng.integers(1, 400, 40), 1000)
    dense = np.zeros((700, 40))
    for r, (at, tf) in zip(dense, vectors):
        r[at] = (1 + np.log(tf)) * ix.idf[at]
    dense /= np.maximum(np.sqrt((dense ** 2).sum(1)), 1e-12)[:, None]
    for at, tf in vectors[:200]:
        if len(at):
            q = (1 + np.log(tf)) * ix.idf[at]
            q = q / np.sqrt((q ** 2).sum())
            near, sims = ix.nearest(at, q.astype(np.float32))
            full = np.sort(dense[:, at] @ q)[::-1]
            full = full[full > 1e-6]
            want = full[:ix.k]
            assert np.allclose(sims[:ix.k], want, atol=1e-5)
            assert len(near) == len(want) or abs(len(near) - (full >= want[-1] - 1e-5).sum()) <= (np.abs(full - want[-1] + 1e-5) < 1e-6).sum()
    assert ix.score([], [])[0] == ix.blank and 0 < ix.blank < 1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = op4_toxicity(spark, sf)
    lab = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = out.collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= .5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, lab[r.doc_id]) for r in rows if r.held_out and r.doc_id in lab]
    assert sum(a == b for a, b in held) / len(held) > .93


def test_edges(spark):
    docs = [(i, t, "x") for i, t in enumerate(["you idiot fool", "nice day", None, "", "IDIOT! idiot " * 2000, "nice day"] * 12)] + [(None, "idiot", "x"), (1, "nice day", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int("idiot" in (t or "").lower())) for i, t, _ in docs if i is not None] + [(0, 1), (5, None), (None, 1), (7, 9)], "doc_id long, toxic int")
    rows = score(df, labels).collect()
    assert len(rows) == len(docs)
    by = {r.doc_id: r.score for r in rows}
    assert by[0] > .5 > by[1] and by[4] > .5 and by[2] == by[3] == by[14]
    assert {r.score for r in score(df, labels.limit(0)).collect()} == {0.0}
    assert score(df.limit(0), labels).count() == 0


def test_ids_may_be_text(spark):
    rows = [(f"d{i}", "you idiot fool" if i % 2 else "nice day", i % 2) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id string, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id string, toxic int")
    out = score(docs, labels).collect()
    assert all(r.predicted == int(r.doc_id[1:]) % 2 and r.doc_id not in r.evidence for r in out) and any(r.evidence for r in out)


def test_equal_examples_share_their_votes():
    vectors = [(np.array([0]), np.array([1]))] * 40 + [(np.array([1]), np.array([1]))] * 40
    labels = [i % 3 > 0 for i in range(40)] + [0] * 40
    a = Index(range(80), labels, vectors, [40, 40], 400)
    b = Index(range(80)[::-1], labels, vectors, [40, 40], 400)
    c = Index([str(i) for i in range(80)], labels[:40][::-1] + labels[40:], vectors, [40, 40], 400)
    assert a.score([0], [1])[0] == b.score([0], [1])[0] and abs(a.score([0], [1])[0] - c.score([0], [1])[0]) < 1e-12
    share = a.vote(np.array([0]), np.array([1], np.float32))[0]
    assert abs(share - (26 / 40 * 25 / .05 + a.prior) / (25 / .05 + 1)) < 1e-4


def test_an_example_has_no_vote_on_itself():
    vectors = [(np.array([0, i]), np.array([1, 1])) for i in range(1, 31)]
    labels = [1] + [0] * 29
    ix = Index([f"d{i}" for i in range(30)], labels, vectors, [30] + [1] * 30, 400)
    seen, own = ix.score([0, 1], [1, 1], "other"), ix.score([0, 1], [1, 1], "d0")
    assert seen[1][0] == "d0" and "d0" not in own[1] and own[0] < seen[0]
