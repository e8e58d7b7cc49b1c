"""URL filter: rules against plain code, the model on held-out hosts."""
import re

import numpy as np

from cohortwave.llm.urls import RULES, fit, grams, judge, op2_url_filter


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if c.isascii() else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules_equal_plain_code(spark):
    hosts = ["example.com", "www.example.com", "WWW.Example.COM", "a.www.example.com", "xexample.com", "com", "com.", "net", "b.net", "örg.net", "x.org", "", "u@h.com:80"]
    tails = ["", "/", "/en/", "/en", "/es/1?q=/fr/", "/fr/#x", "?/en/", "#", "/EN/"]
    urls = [f"{s}{h}{t}" for s in ("http://", "x://", "", "a?b://", "\n://") for h in hosts for t in tails] + [None, "", "://", "a://b://c.com/en/"]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in judge(df, ["page_id"]).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (verdict or ("block" if got[i].score >= .5 else "allow"))
    assert judge(df.limit(0), ["page_id"]).count() == 0


def test_model_generalises():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows = [(f"{word()}-{'casino' if y else 'school'}.org", f"/{word()}", y) for y in rng.integers(0, 2, 600).tolist()]
    w, b = fit(rows[:400])
    score = [w[(f := grams(h, p, 16))].sum() / len(f) ** .5 + b for h, p, _ in rows[400:]]
    assert np.mean([(s > 0) == y for s, (*_, y) in zip(score, rows[400:])]) > .97
    assert fit([])[1] < -10 and fit([("a", "b", 1)])[1] > 10 and not len(grams("", "", 16))


def test_whole_table(spark):
    out = op2_url_filter(spark, "/root/testdata/sf0.001")
    assert out.count() == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    assert {r.verdict for r in out.collect()} == {"allow", "block"}
