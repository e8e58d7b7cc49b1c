"""URL filters: explicit rules first, then logistic regression on hashed character n-grams.

Rules are (host suffix, path prefix, verdict); the longest that fits decides.
Other URLs get the verdict of a model over the n-grams of host and path, hashed
to a fixed number of weights. It is trained on the driver from a labelled table
of at most `max_rows` rows (rows with the smallest hashes of their URL are taken,
so the sample does not depend on partitions); the weights have a fixed size and
are broadcast. Scoring is a narrow, vectorised pass without a shuffle.

Edge cases: null URLs and URLs without "://" have empty host and path and no
n-grams; their score is the model's bias alone. Repeated rows are scored alike.
Without labelled rows of both verdicts the score is the share of blocked ones
(0 without any). Only the named columns are read.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import read

#: Fixed values of the contract: host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: A curator's labelled URLs; what the rules decide is added to them.
LABELLED = (
    ("http://cheap-pills.example.org/buy-now", 1), ("http://www.best-casino-bonus.example.net/play", 1), ("https://spam-farm.example.org/links", 1),
    ("http://free-download-crack.example.org/keygen.exe", 1), ("https://win-big-prizes.example.net/click?id=7", 1), ("http://replica-watches.example.org/sale", 1),
    ("http://hot-singles.example.org/adult", 1), ("https://payday-loan-fast.example.net/apply", 1), ("http://seo-link-exchange.example.org/partners", 1),
    ("http://cheap-pills.example.net/de/order", 1), ("https://spam-farm.example.net/de/1", 1), ("http://casino.example.org/en/slots", 1),
    ("https://library.example.org/catalogue/12", 0), ("https://docs.example.org/en/guide.html", 0), ("http://news.example.org/en/2024/05/report", 0),
    ("https://www.university.example.org/research/paper", 0), ("https://blog.garden.example.org/en/roses", 0), ("https://museum.example.net/de/exhibit", 0),
    ("http://m.weather.example.net/en/today", 0), ("https://recipes.example.org/fr/soup", 0), ("https://forum.example.org/es/hilo/3", 0),
    ("https://www.school.example.net/en/timetable", 0), ("https://wiki.example.org/de/artikel", 0), ("http://city.example.net/en/council", 0),
)
A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; empty without "://"."""
    at = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(at(1), A_Z, a_z), at(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null. The rule list is configuration, not data."""
    text = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, h + p) if text is None else text.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (text, verdict) if rules else (F.lit(None).cast("string"),) * 2


def grams(host: str, path: str, bits: int, sizes=(2, 3, 4, 5)) -> np.ndarray:
    """Distinct hashed n-grams of host and path; each side has its own hashes."""
    out = []
    for side, s in enumerate((f"^{host}$", f"^{path}$")):
        raw = np.frombuffer(s.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
        for n in sizes if len(s) > 2 else ():
            acc = np.full(max(0, len(raw) - n + 1), 2 * n + side + 1, np.uint64)
            for j in range(n if len(acc) else 0):
                acc = (acc ^ raw[j:j + len(acc)]) * np.uint64(0x100000001B3)
                acc ^= acc >> np.uint64(29)
            out.append(acc >> np.uint64(7))
    return np.unique(np.concatenate(out) & np.uint64((1 << bits) - 1)).astype(np.int64) if out else np.zeros(0, np.int64)


def fit(rows: list[tuple[str, str, int]], bits: int = 16, l2: float = 1e-3, epochs: int = 60, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient steps with AdaGrad; the order of rows does not matter."""
    w, bias = np.zeros(1 << bits), 0.0
    y = np.array([v for *_, v in rows], float)
    if len(set(y)) < 2:
        share = y.mean() if len(y) else 0.0
        return w, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    feats = [grams(h, p, bits) for h, p, _ in rows]
    at, row = np.concatenate(feats), np.repeat(np.arange(len(rows)), [len(f) for f in feats])
    size = np.array([max(1, len(f)) ** -0.5 for f in feats])
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)  # both verdicts count alike
    past, past_b = np.full_like(w, 1e-8), 1e-8
    for _ in range(epochs):
        z = np.bincount(row, w[at] * size[row], len(rows)) + bias
        err = weight * (1 / (1 + np.exp(-z)) - y) / len(rows)
        g = np.bincount(at, (err * size)[row], len(w)) + l2 * w
        past, past_b = past + g * g, past_b + err.sum() ** 2
        w, bias = w - rate * g / np.sqrt(past), bias - rate * err.sum() / past_b ** 0.5
    return w, float(bias)


def judge(pages: DataFrame, keep: list[str], url: str = "url", rules=RULES, labelled=LABELLED, max_rows: int = 4000, bits: int = 16) -> DataFrame:
    """keep, host, path, rule, verdict and score (of being blocked) of each row."""
    spark = pages.sparkSession
    host, path = parts(F.col("__url"))
    df = pages.select(*keep, F.col(url).alias("__url")).withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    df = df.withColumn("rule", rule).withColumn("said", verdict)
    train = (df.where("said is not null").select("host", "path", (F.col("said") == "block").cast("int").alias("y")).distinct()
             .orderBy(F.xxhash64("host", "path"), "host", "path").limit(max_rows).collect())
    split = spark.createDataFrame(list(labelled), "url string, y int").select(*parts(F.col("url")), "y").collect() if labelled else []
    model = spark.sparkContext.broadcast(fit([tuple(r) for r in [*split, *train]], bits))

    @F.pandas_udf("double")
    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        w, bias = model.value
        out = np.empty(len(hosts))
        for i, (h, p) in enumerate(zip(hosts, paths)):
            f = grams(h, p, bits)
            out[i] = w[f].sum() * max(1, len(f)) ** -0.5 + bias
        return pd.Series(1 / (1 + np.exp(-out)))

    return (df.withColumn("score", score("host", "path"))
            .withColumn("verdict", F.coalesce("said", F.when(F.col("score") >= 0.5, "block").otherwise("allow")))
            .select(*keep, "host", "path", "rule", "verdict", "score"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), ["page_id"])
