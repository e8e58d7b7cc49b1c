"""Quality rules: counts against plain code, the estimate against numpy, clean texts kept."""
import random
import re

import numpy as np

from cohortwave.llm.common import components
from cohortwave.llm.quality import DIM, FLOORS, SCALE, chi2_cdf, chi2_quantile, estimate, features, judge, measure, op7_quality_rules, quality_stage
from cohortwave.session import cut_lineage


def brute(t):
    w = re.findall("[^\x20\x09-\x0d]+", t or "")
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(hit)


def test_counts_equal_plain_code():
    rng = random.Random(1)
    for _ in range(1500):
        t = "".join(rng.choices(["a ", "b ", "É ", "# ", "\n", "\t", "x\x1cy ", "a b a b a ", "|", "日 ", "\x85", "\r\n"], k=rng.randint(0, 40)))
        assert measure(t)[:5] == brute(t), repr(t)
    assert measure(None) == measure("") == (0,) * 7
    assert measure("a " * 50_000)[4] == 50_000


def test_chi_square():
    assert abs(chi2_cdf(11.0705, 5) - .95) < 1e-4 and abs(chi2_quantile(.5, 2) - 2 * np.log(2)) < 1e-9


def test_estimate_is_robust(spark):
    rng = np.random.default_rng(0)
    good = rng.multivariate_normal(np.zeros(DIM), np.diag((np.arange(DIM) + 1.) ** 2) * 400, 3000)
    bad = rng.multivariate_normal(np.full(DIM, 600.), np.eye(DIM) * 100, 600)
    x = np.rint(np.r_[good, bad]).astype(int)
    rows = [("g", 1, *map(int, r)) for r in x]
    df = spark.createDataFrame(rows, "g string, w long, " + ", ".join(f"x{i} long" for i in range(DIM)))
    p = estimate(cut_lineage(df, "c")).first()
    assert np.abs(np.array(p.mu)).max() < 8
    var = np.diag(np.linalg.inv(np.array(p.inv).reshape(DIM, DIM))) - (np.array(FLOORS) * SCALE) ** 2
    assert np.allclose(np.sqrt(var), (np.arange(DIM) + 1) * 20, rtol=.15)


def test_query_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = op7_quality_rules(spark, sf).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lab = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == len(text)
    for r in rows:
        if len(text[r.doc_id]) < 3000:
            n, chars, sym, dup, rep = brute(text[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, sym, dup, rep)
            assert r.base_failed == (n < 10 or 100 * rep > 20 * n)
        assert not (r.base_failed and r.kept)
    known = [(r.kept, lab[r.doc_id]) for r in rows if r.doc_id in lab and not r.base_failed]
    assert all(k for k, q in known if q) and sum(not k for k, q in known if not q) > .8 * sum(not q for _, q in known)


def test_edges(spark):
    t = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, t, "en", "a", 5), (1, t, "en", "a", 5), (2, None, None, None, None), (3, "", None, "a", 1), (None, t.title(), None, None, 2), (4, t + " #" * 300, "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")
    out = judge(cut_lineage(features(df), "f")).collect()
    assert sorted((str(r.doc_id), r.kept) for r in out)[:2] == [("1", True), ("1", True)] and {r.kept for r in out if r.doc_id in (2, 3)} == {False}
    kept = quality_stage(spark, df, "")
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect())[:2] == ["1", "1"]
    assert quality_stage(spark, df.limit(0), "").count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2200)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root if find(i) != i}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
