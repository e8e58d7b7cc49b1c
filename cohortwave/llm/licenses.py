"""Licence scans with a positional index of rare words.

Templates (notices and key phrases) are indexed by word and position. Corpus
document frequencies of the template words decide which are rare. Every template
with a key phrase in a text looks up its own highest-IDF words there, as many as a
match cannot miss, and the places vote for text position - template position; an
alignment is the intersection by relative position. Aligned windows count when enough template words stand in place and a
mandatory key phrase of the licence is inside. Phrases of the base list are
found at all their places whatever the index says.

Templates and frequencies have the size of the template list, are aggregated over
all documents and broadcast. Each text is scanned whole; work per text follows
its licence words, not the number of templates.

Edge cases: null and empty texts have no words and score 0; repeated rows are
scanned alike; an empty table gives no rows. Only the named columns are read.
"""
from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import map_batches, read, words

#: Fixed values of the contract: phrase and label.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Opening lines of public licence notices: label, mandatory key phrases (one is enough), text.
TEMPLATES = (
    ("mit", ("permission is hereby granted free of charge", "mit license"), "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", ("mit license",), "released under the mit license"),
    ("apache", ("apache license",), "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", ("gnu general public license",), "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", ("gnu general public license",), "this file is licensed under the gnu general public license version 3"),
    ("lgpl", ("gnu lesser general public license",), "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", ("gnu affero general public license",), "redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", ("redistribution and use in source and binary forms",), "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", ("permission to use copy modify and or distribute",), "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", ("mozilla public license",), "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl", ("eclipse public license",), "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cc-by-nc", ("cc by nc",), "licensed under cc by nc 4 0"),
    ("cc-by-sa", ("cc by sa",), "licensed under cc by sa 4 0"),
    ("cc-by", ("cc by",), "licensed under cc by 4 0"),
    ("cc-by", ("creative commons attribution",), "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", ("cc0 1 0 universal", "public domain dedication"), "cc0 1 0 universal public domain dedication no rights reserved"),
    ("unlicense", ("released into the public domain",), "this is free and unencumbered software released into the public domain"),
)


class Templates:
    def __init__(self, templates=TEMPLATES, base=BASE):
        self.base = [(words(p), label) for p, label in base]
        self.items = [(label, [words(k) for k in keys], words(text)) for label, keys, text in templates]
        self.vocab = {w for _, keys, text in self.items for w in [*text, *(x for k in keys for x in k)]} | {w for p, _ in self.base for w in p}


def places(ws: list[bytes], at: dict[bytes, list[int]], phrase: list[bytes]) -> list[int]:
    """All starts of the phrase, from the places of its rarest word here."""
    k = min(range(len(phrase)), key=lambda i: len(at.get(phrase[i], ())))
    return [p - k for p in at.get(phrase[k], ()) if p >= k and ws[p - k:p - k + len(phrase)] == phrase]


def rare_words(t: Templates, idf: dict[bytes, float], share: float = 0.7) -> list[set[bytes]]:
    """The rarest words of each template, so many that a window with the share has three of them in place (or all words)."""
    out = []
    for _, _, text in t.items:
        weight = Counter()
        for w in text:
            weight[w] += idf.get(w, 0.0)
        own: list[bytes] = []
        for w in sorted(weight, key=lambda w: (-idf.get(w, 0.0), w)):
            own.append(w)
            mass = sorted((weight[x] for x in own), reverse=True)
            if len(own) > 2 and sum(mass[2:]) > (1 - share) * weight.total():
                break
        out.append(set(own))
    return out


def match(ws: list[bytes], t: Templates, idf: dict[bytes, float], rare: list[set[bytes]], share: float = 0.7, slip: int = 2):
    """Base places with labels, and {label: score} of verified templates."""
    at: dict[bytes, list[int]] = defaultdict(list)
    for i, w in enumerate(ws):
        if w in t.vocab:
            at[w].append(i)
    base = sorted((p, label) for phrase, label in t.base for p in places(ws, at, phrase))
    found: dict[str, float] = {}
    for (label, keys, text), own in zip(t.items, rare):
        inside = [(len(k), p) for k in keys if (p := places(ws, at, k))]
        if not inside:
            continue
        votes = defaultdict(set)
        for q, w in enumerate(text):
            if w in own:
                for p in at.get(w, ()):
                    votes[(p - q) // (slip + 1)].add(w)
        total = max(sum(idf.get(w, 0.0) for w in text), 1e-9)
        for slot in sorted(votes):
            got = set().union(*(votes.get(slot + d, ()) for d in (-2, -1, 0, 1)))  # as far as words count below
            if len(got) < min(3, len(own)):
                continue
            start = slot * (slip + 1)
            lo, hi = max(0, start - slip), start + 2 * slip + len(text) + 2
            if not any((i := bisect_left(p, lo)) < len(p) and p[i] <= hi - n for n, p in inside):
                continue
            window = ws[lo:hi]
            hit = sum(idf.get(w, 0.0) for q, w in enumerate(text) if w in window[max(0, q - slip):q + 3 * slip + 2])
            if hit / total >= share and hit / total > found.get(label, 0.0):
                found[label] = hit / total
    return base, found


def frequencies(docs: DataFrame, t: Templates, text: str = "text") -> dict[bytes, float]:
    """IDF of the template words over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(t)

    def run(b):
        c, vocab = Counter(), shared.value.vocab
        for x in b.column("body").to_pylist():
            c.update(vocab.intersection(words(x)))
        return {"word": [*c, b""], "n": [*c.values(), b.num_rows]}

    rows = map_batches(docs.select(F.col(text).alias("body")), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {bytes(r.word): r.n for r in rows}
    total = df.pop(b"", 0)
    return {w: math.log((total + 1) / (df.get(w, 0) + 0.5)) for w in t.vocab}


def scan(docs: DataFrame, keep: list[str], text: str = "text", templates=TEMPLATES, base=BASE) -> DataFrame:
    """keep, n_words, n_base, first_word, last_word, base_labels, labels and score of each row."""
    t = Templates(templates, base)
    shared = docs.sparkSession.sparkContext.broadcast((t, idf := frequencies(docs, t, text), rare_words(t, idf)))

    def run(b):
        t, idf, rare = shared.value
        out = defaultdict(list)
        for x in b.column("body").to_pylist():
            ws = words(x)
            places_, found = match(ws, t, idf, rare) if not t.vocab.isdisjoint(ws) else ([], {})
            own = sorted({label for _, label in places_})
            for c, v in (("n_words", len(ws)), ("n_base", len(places_)), ("first_word", places_[0][0] if places_ else None), ("last_word", places_[-1][0] if places_ else None),
                         ("base_labels", ",".join(own)), ("labels", ",".join(sorted({*own, *found}))), ("score", min(1.0, max([1.0 if own else 0.0, *found.values()])))):
                out[c].append(v)
        return {c: b.column(c) for c in keep} | out

    types = dict(docs.select(*keep).dtypes)
    return map_batches(docs.select(*keep, F.col(text).alias("body")), run, ", ".join(f"`{c}` {types[c]}" for c in keep) +
                       ", n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"), ["doc_id"])
