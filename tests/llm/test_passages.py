"""Repeated passages: planted copies, brute-force classes of pieces, recall of the bands."""
import itertools
import random

import numpy as np

from cohortwave.llm.jaccard import MIX, mix
from cohortwave.llm.passages import PieceWord, anchors, constants, content, cut, paragraphs, pieces, repeated, shingles, tune, without


def say(rng, n):
    return " ".join(rng.choice([f"w{i}" for i in range(4000)]) + ("." if rng.random() < .1 else "") for _ in range(n))


def test_planted_passages_are_found_and_clean_texts_left(spark):
    rng = random.Random(1)
    docs = [say(rng, rng.choice([5, 60, 300])) for _ in range(200)]
    planted = {}
    for k in range(20):
        p = say(rng, rng.randint(70, 120)) + "."
        for d in rng.sample(range(200), 3):
            if d not in planted:
                planted[d] = k
                docs[d] = docs[d] + ("\n" if k % 2 else " ") + p + " " + say(rng, 20)
    rows = list(enumerate(docs)) + [(900, None), (901, ""), (902, "one two three four five six seven eight nine")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, start int").repartition(4)
    out = repeated(df).collect()
    many = {d for d, k in planted.items() if sum(v == k for v in planted.values()) > 1}
    assert {r.doc_id for r in out} <= many and len(many - {r.doc_id for r in out}) <= len(many) // 20
    for _, g in itertools.groupby(sorted(out, key=lambda r: r.class_id), lambda r: r.class_id):
        g = list(g)
        assert sum(not r.removed for r in g) <= 1 and len({r.doc_id for r in g}) > 1
    assert repeated(df.limit(0)).count() == 0


def test_passages_without_punctuation_inside_long_lines(spark):
    rng = random.Random(5)
    plain = lambda n: say(rng, n).replace(".", "")
    p = [plain(60) for _ in range(30)]
    docs = [(2 * k + i, f"{plain(rng.randint(20, 90))} {x} {plain(rng.randint(5, 60))}") for k, x in enumerate(p) for i in (0, 1)]
    out = repeated(spark.createDataFrame(docs, "doc_id long, text string"), least_words=8)
    assert len({r.doc_id for r in out.collect()}) >= 54


def test_classes_equal_brute_force(spark):
    rng = random.Random(2)
    base = [say(rng, 40).replace(".", "") for _ in range(12)]
    docs = []
    for i in range(90):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        docs.append(" ".join(w))
    out = repeated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), least_words=8, recall=0.999).collect()
    docs_pieces = [(i, tuple(t.split()[f:f + n])) for i, t in enumerate(docs) for f, n in zip(*(x.tolist() for x in pieces([t], PieceWord())[1:3]))]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for _, w in docs_pieces]
    size = len(sets)
    root = list(range(size))

    def find(i):
        return i if root[i] == i else find(root[i])
    for i, j in itertools.combinations(range(size), 2):
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(size):
        groups.setdefault(find(i), []).append(docs_pieces[i][0])
    got = {}
    for r in out:
        got.setdefault(r.class_id, []).append(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(set(g)) > 1)
    assert sorted(r.doc_id for r in out if not r.removed) == sorted(min(g) for g in got.values())


def test_pieces_cover_their_lines_and_follow_content():
    rng = random.Random(7)
    texts = [None, "", "a b c", *("\n".join(say(rng, rng.choice([3, 9, 40, 300])) for _ in range(4)) for _ in range(30))]
    text, first, count, place, flat = pieces(texts, PieceWord())
    for t, x in enumerate(texts):
        spans = [(f, n) for k, f, n in zip(text.tolist(), first.tolist(), count.tolist()) if k == t]
        at, want = 0, set()
        for line in (x or "").split("\n"):
            n = len(line.split())
            want |= set(range(at, at + n)) if n >= 8 else set()
            at += n
        got = [i for f, n in spans for i in range(f, f + n)]
        assert len(got) == len(set(got)) and set(got) <= want and len(want - set(got)) < 8 * 5 and all(8 <= n <= 71 for _, n in spans)
    inner = say(rng, 120)
    moved = [pieces([a + inner + b], PieceWord()) for a, b in (("", ""), (say(rng, 30) + " ", " " + say(rng, 30)))]
    a, b = (set(content(m[2], m[3], m[4]).tolist()) for m in moved)
    assert len(a & b) >= len(a) - 2 or len(a) <= 3
    sh, begin = shingles(*moved[0][2:])
    assert len(sh) == (moved[0][2] - 4).sum() and len(begin) == len(moved[0][2])


def test_bands_reach_their_recall():
    assert tune(0.75, 0.98) == 3 and tune(0.5, 0.9, 2) == 9
    rng = np.random.default_rng(0)
    hit = 0
    for _ in range(400):
        a = rng.integers(0, 1 << 62, 70).astype(np.uint64)
        b = np.r_[a[:60], rng.integers(0, 1 << 62, 10).astype(np.uint64)]
        hit += any(mix(a, m).min() == mix(b, m).min() for m in MIX[:3])
    assert hit >= 0.96 * 400


def test_removal_keeps_the_rest():
    assert without("a b  c\nd e f", [(1, 2)]) == "a\nd e f" and without("a b", []) == "a b" and without("a b", [(0, 2)]) == ""


def test_repeated_rows(spark):
    t = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    out = repeated(spark.createDataFrame([(1, t), (1, t), (2, t), (None, t)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.removed, r.class_size) for r in out) == [(False, 1, True, 4), (False, 2, True, 4), (True, 0, False, 4)]


def test_short_lines_are_joined(spark):
    rng = random.Random(11)
    plain = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    verse = "\n".join(plain(7) for _ in range(8))
    mixed = "\n".join(plain(n) for n in (12, 3) * 4)
    docs = [(4 * k + i, f"{plain(30)}\n{a}{p}\n{b}{plain(30)}") for k, p in enumerate((verse, mixed)) for i, (a, b) in
            enumerate([("", ""), (plain(5) + "\n", ""), ("", plain(4) + "\n"), (plain(6) + "\n" + plain(2) + "\n", plain(3) + "\n")])]
    out = repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in out} == set(range(8))
    for d, t in docs:
        said = t.split()
        got = {i for r in out if r.doc_id == d for i in range(r.start, r.start + r.n_words)}
        p = (verse, mixed)[d // 4].split()
        s = next(i for i in range(len(said)) if said[i:i + len(p)] == p)
        assert got <= set(range(s - 8, s + len(p) + 8)) and len(got & set(range(s, s + len(p)))) >= (16 if d < 4 else len(p) - 3)


def test_copies_of_51_words_share_a_window_inside_long_lines():
    rng = random.Random(12)
    plain = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    for k in range(400):
        p = plain(51 + k % 10)
        lines = [paragraphs([plain(20), f"{plain(rng.randint(1, 90))} {p} {plain(rng.randint(1, 90))}"], PieceWord(), True) for _ in (0, 1)]
        found = [anchors(*x, *cut(*x)[3:1:-1]) for x in lines]
        a, b = (set(content(f[2], f[3], x[4]).tolist()) for f, x in zip(found, lines))
        assert a & b


def test_one_word_over_and_over_stays_once(spark):
    t = "x " * 300
    out = repeated(spark.createDataFrame([(1, t), (2, t)], "doc_id long, text string")).collect()
    left = {d: without(t, [(r.start, r.n_words) for r in out if r.doc_id == d and r.removed]).split() for d in (1, 2)}
    assert len(left[1]) >= 64 and not left[2]


def test_every_band_has_a_constant():
    for bands in (1, 3, 4, 5, 12):
        c = constants(bands)
        assert len(set(map(int, c))) == bands and all(int(x) & 1 for x in c) and c[:4] == list(MIX[:bands])[:4]
