"""Licence scan: base phrases against plain code, templates on altered notices."""
import random

from cohortwave.llm.licenses import BASE, TEMPLATES, scan
from tests.llm.test_decontaminate import toks


def brute(text):
    w = toks(text)
    at = sorted((i, label) for p, label in BASE for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


def fixture():
    rng = random.Random(8)
    filler = ["lorem", "ipsum", "the", "of", "license", "cc", "by", "mit", "apache", "gnu", "general", "public", "É"]
    docs = [" ".join(rng.choices(filler, k=rng.choice([0, 3, 30, 400]))) for _ in range(150)]
    docs += [None, "", "MIT License", "mit-license, CC BY", "cc by " * 4000, "gnu general public license gnu general public license"]
    return docs


def test_base_equals_plain_code(spark):
    docs = fixture()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, labels string").repartition(3)
    rows = {r.doc_id: r for r in scan(df, ["doc_id"]).collect()}
    assert len(rows) == len(docs)
    for i, t in enumerate(docs):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r["labels"].split(",")) and 0 <= r.score <= 1
    assert scan(df.limit(0), ["doc_id"]).count() == 0


def test_templates_are_found_in_altered_notices(spark):
    rng = random.Random(9)
    filler = [f"word{i}" for i in range(500)]
    docs, want = [], []
    for label, keys, text in TEMPLATES:
        w = text.split()
        near = " ".join(w[:2] + ["extra"] + w[2:]) if len(w) > 9 and not any(" ".join(w[1:4]) in k for k in keys) else text
        for body in (text, near):
            docs.append(" ".join(rng.choices(filler, k=120)) + " " + body.title() + ". " + " ".join(rng.choices(filler, k=80)))
            want.append(label)
    docs += [" ".join(rng.choices(filler, k=200)) for _ in range(300)] + ["software files granted charge " * 30]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    rows = {r.doc_id: r for r in scan(df, ["doc_id"]).collect()}
    missed = [(i, want[i], rows[i]["labels"]) for i in range(len(want)) if want[i] not in rows[i]["labels"].split(",")]
    assert not missed, missed
    assert all(rows[i]["labels"] == "" and rows[i].score == 0 for i in range(len(want), len(docs)))


def test_many_notices_and_scattered_vocabulary_in_one_text(spark):
    rng = random.Random(10)
    filler = [f"word{i}" for i in range(500)]
    every = ". ".join(" ".join(rng.choices(filler, k=20)) + " " + text for _, _, text in TEMPLATES)
    vocab = sorted({w for _, _, text in TEMPLATES for w in text.split()})
    notices = [(label, text) for label, _, text in TEMPLATES if label in ("bsd", "isc")]
    long = lambda text: " ".join(rng.choices(filler * 2 + vocab, k=20000)) + f" {text} " + " ".join(rng.choices(filler * 2 + vocab, k=20000))
    docs = [every, *(long(text) for _, text in notices), long("")] + [" ".join(rng.choices(filler, k=200)) for _ in range(100)]
    rows = {r.doc_id: r for r in scan(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), ["doc_id"]).collect()}
    assert set(rows[0]["labels"].split(",")) == {label for label, _, _ in TEMPLATES}
    for i, (label, _) in enumerate(notices):
        assert label in rows[1 + i]["labels"].split(",") and rows[1 + i].score == 1
    assert not {"bsd", "isc"} & set(rows[3]["labels"].split(","))
