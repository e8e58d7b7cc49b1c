"""Personal data: base spans against plain regular expressions, and what patterns find."""
import hashlib
import random
import re

from cohortwave.llm.pii import KINDS, base_spans, bootstrap, occurrences, op1_pii, pii_stage, scan

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def checked(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        x = [int(c) for c in d[::-1]]
        return 14 <= len(d) <= 19 and sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(x)) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def brute(text):
    return sorted((m.start(), KINDS.index(k), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if checked(k, m[0]))


def test_base_spans_equal_plain_patterns():
    rng = random.Random(5)
    bits = ["1.2.3.4", "255.0.0.1", "256.1.1.1", "+1 (988) 555-2485", "4111 1111 1111 1111", "4111-1111-1111-1112", "a.b@c.de", "@x.y", "@", "+", ".", "-", " ", "9",
            "é", "x@y@z.w", "00012.1.1.1.1.1.1.1", "\n", "(", "a", "+12", "5500000000000004", "..", "1 ", "日"]
    for _ in range(20000):
        t = "".join(rng.choices(bits, k=rng.randint(0, 12)))
        assert base_spans(t) == brute(t), t


def test_long_runs_are_linear():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 200_000, "a@" * 150_000, "+1" * 150_000, "x1" * 150_000):
        occurrences(t, base_spans(t))


def test_occurrences_do_not_overlap_base_spans():
    rng = random.Random(6)
    bits = ["1.2.3.4", "+1 (988) 555-2485", "4111 1111 1111 1111", "a.b@c.de", " id-9912 ", " ", "word", "\n", "7", "@q1234", ","]
    for _ in range(5000):
        t = "".join(rng.choices(bits, k=rng.randint(0, 10)))
        base = base_spans(t)
        occ = occurrences(t, base)
        assert all(a[1] <= b[0] for a, b in zip(occ, occ[1:]))
        assert all(e <= a or b <= s for a, b, k, _, _ in occ if k < 0 for s, _, e in base)


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"please mail to user{i}@host{i}.org today or wait {i}") for i in range(20)]
    rows += [(100, "please mail to user77(at)host today or wait 555"), (101, "lot 12345 of wares"), (102, None), (103, ""), (104, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.inst, r.kind) for r in bootstrap(scan(df, ["doc_id"])).collect()}
    assert ("user77(at)host", 0) not in found  # too few digits to be an identifier
    rows.append((105, "please mail to user777(at)host today or wait 3"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.inst, r.kind) for r in bootstrap(scan(df, ["doc_id"])).collect()}
    assert found == {("user777(at)host", 0)}


def test_query_and_stage(spark, tmp_path):
    rows = [(1, "x a.b@c.de y 1.2.3.4", 9, "k"), (1, "x a.b@c.de y 1.2.3.4", 9, "k"), (2, None, None, None), (3, "", 0, "k"), (4, "+1 (988) 555-2485", 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, base string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for r in op1_pii(spark, str(tmp_path)).collect():
        t = dict((a, b) for a, b, *_ in rows)[r.doc_id] or ""
        want = brute(t)
        said = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.spans == said
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[1] == i for x in want) for i in range(4)]
    out = pii_stage(spark, df, str(tmp_path))
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "x <EMAIL> y <IP>", 16, "k")] * 2 + [(2, None, None, None), (3, "", 0, "k"), (4, "<PHONE>", 7, None)], key=str)
    assert op1_pii(spark, str(tmp_path)).count() == 5 and pii_stage(spark, df.limit(0), "").count() == 0


def test_rounds_go_on_until_nothing_new_is_accepted(spark):
    ref = lambda k, i: f"ref-{k}-{i}00{i}"
    rows = []
    for k in range(6):  # the patterns of a link reach their confidence only with what the link before has found
        known = [f"user{i}@host{i}.org" for i in range(16)] + [ref(k, i) if k else f"user9{i}@host.org" for i in range(4)]
        rows += [f"see link{k} {v} next{k} thing" for v in [*known, *(ref(k + 1, i) for i in range(4))]]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {(r.inst, r.kind) for r in bootstrap(scan(df, ["doc_id"])).collect()} == {(ref(k + 1, i), 0) for k in range(6) for i in range(4)}
