"""Quality rules by robust multivariate outliers.

Counts of each text give a vector of shrunken, variance-stabilised ratios. Per
(language, source) a regularised minimum covariance determinant gives a centre
and a scatter, and documents far from it by Mahalanobis distance are rejected.

The concentration steps never gather a group: equal quantised vectors are
counted first, a step sums weights and products per (group, distance bin), and
a window over the few hundred bins of a group picks the closest `share` of its
rows. Only one row per group and start is ever worked on by itself.

Edge cases: null and empty texts have no words and fail the base rules; null
language or source are values of their own; groups with fewer than `min_rows`
documents take their language's estimate, then that of all documents; repeated
rows count as often as they occur and get the same verdict; an empty table
gives an empty result. Only the named columns are read.
"""
from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import cut_lineage
from .common import blank_words, free_name, join_bounded, map_batches, read, row_key

BLANKS, SYMBOLS, UPPER = " \t\n\x0b\x0c\r", "#*$%&|<>", bytes(range(65, 91))
#: Vector: log mean word length, shares of symbols, repeated lines, repeated words and capitals (square roots).
DIM, SCALE, SHRINK = 5, 200, 50
FLOORS = (0.06, 0.06, 0.10, 0.10, 0.06)
XS = [f"x{i}" for i in range(DIM)]
PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]


def repeated_words(ws: list[bytes], k: int = 5) -> int:
    """Words inside k-word windows that the text has at least twice."""
    grams = list(zip(*(ws[i:] for i in range(k))))
    if len(set(grams)) == len(grams):
        return 0
    seen, total, end = Counter(grams), 0, 0
    for i, g in enumerate(grams):
        if seen[g] > 1:
            total += i + k - max(i, end)
            end = i + k
    return total


def measure(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper."""
    if not text:
        return (0,) * 7
    ws = blank_words(text)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    raw = text.encode("utf-8", "surrogatepass")
    return (len(ws), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(ws), len(lines), len(raw) - len(raw.translate(None, UPPER)))


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def features(docs: DataFrame, text: str = "text", keep: list[str] = ["doc_id"], lang: str = "lang", source: str = "source") -> DataFrame:
    df = docs.select(*keep, F.coalesce(F.col(lang), F.lit("\x00")).alias("glang"), F.coalesce(F.col(source), F.lit("\x00")).alias("gsource"),
                     F.col(text).alias("body"))
    types = dict(df.dtypes)
    held = [c for c in df.columns if c != "body"]

    def run(b):
        rows = [measure(t) for t in b.column("body").to_pylist()]
        return {c: b.column(c) for c in held} | dict(zip(FEATURES, zip(*rows)))

    out = map_batches(df, run, ", ".join([f"`{c}` {types[c]}" for c in held] + [f"{c} long" for c in FEATURES]))
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def chi2_cdf(x: float, k: int) -> float:
    """Series of the regularised lower incomplete gamma function."""
    a, h = k / 2, x / 2
    term = total = 1 / a
    for n in range(1, 1000):
        term *= h / (a + n)
        total += term
    return total * math.exp(-h + a * math.log(h) - math.lgamma(a)) if x > 0 else 0.0


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return hi


def _params(sums: DataFrame, factor: float) -> DataFrame:
    """Centre, inverse scatter and log determinant of each group's sums."""
    def run(parts):
        for p in parts:
            out = []
            for r in p.itertuples(index=False):
                mu = np.array([getattr(r, f"s{i}") for i in range(DIM)], float) / r.w
                cov = np.zeros((DIM, DIM))
                for i, j in PAIRS:
                    cov[i, j] = cov[j, i] = getattr(r, f"s{i}_{j}") / r.w - mu[i] * mu[j]
                cov = cov * factor + np.diag([(f * SCALE) ** 2 for f in FLOORS])
                out.append((r.start, r.g, mu.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1]), int(r.total)))
            yield pd.DataFrame(out, columns=["start", "g", "mu", "inv", "logdet", "total"])
    return sums.mapInPandas(run, "start int, g string, mu array<double>, inv array<double>, logdet double, total long")


def _distance() -> "F.Column":
    d = [F.col(x) - F.col("mu")[i] for i, x in enumerate(XS)]
    return sum((d[i] * d[j] * F.col("inv")[i * DIM + j] * (1 if i == j else 2) for i, j in PAIRS), F.lit(0.0))


def _sums():
    return [F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(x)).alias(f"s{i}") for i, x in enumerate(XS)],
            *[F.sum(F.col("w") * F.col(XS[i]) * F.col(XS[j])).alias(f"s{i}_{j}") for i, j in PAIRS]]


MOMENTS = ["w", *[f"s{i}" for i in range(DIM)], *[f"s{i}_{j}" for i, j in PAIRS]]


def estimate(cells: DataFrame, share: float = 0.75, steps: int = 4) -> DataFrame:
    """Regularised MCD of weighted cells (g, w, x0..): two starts (quartiles
    without correlation; all rows), `steps` concentration steps each, the
    smaller determinant wins. Sums are integers, so they do not depend on how
    rows are dealt out."""
    h = chi2_quantile(share, DIM)
    factor = share / chi2_cdf(h, DIM + 2)
    whole = cells.groupBy("g").agg(*_sums()).withColumn("total", F.col("w")).withColumn("start", F.lit(0))
    quart = cells.groupBy("g").agg(*[F.percentile(x, F.array(*map(F.lit, (.25, .5, .75))), F.col("w")).alias(x) for x in XS], F.sum("w").alias("total"))
    sd = [f"greatest((x{i}[2] - x{i}[0]) / 1.349D, {FLOORS[i] * SCALE}D)" for i in range(DIM)]
    diag = quart.selectExpr("1 as start", "g", f"array({', '.join(f'x{i}[1]' for i in range(DIM))}) as mu",
                            "array(" + ", ".join(f"1 / pow({sd[i]}, 2)" if i == j else "0D" for i in range(DIM) for j in range(DIM)) + ") as inv",
                            "0D as logdet", "total")
    params = cut_lineage(_params(whole, 1.0).unionByName(diag), "mcd")
    for _ in range(steps):
        near = join_bounded(cells, params, "g", "inner")
        binned = (near.withColumn("bin", F.least(F.floor(8 * F.log2(1 + F.greatest(_distance(), F.lit(0.0)))), F.lit(500)))
                  .groupBy("start", "g", "bin").agg(*_sums(), F.first("total").alias("total")))
        before = F.coalesce(F.sum("w").over(W.partitionBy("start", "g").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        sums = (binned.withColumn("before", before).where(F.col("before") < share * F.col("total"))
                .groupBy("start", "g").agg(*[F.sum(c).alias(c) for c in MOMENTS], F.first("total").alias("total")))
        params = cut_lineage(_params(sums, factor), "mcd")
    return params.groupBy("g").agg(F.min_by(F.struct("mu", "inv", "total"), F.struct("logdet", "start")).alias("p")).select("g", "p.*")


def judge(feats: DataFrame, alpha: float = 1e-6, min_rows: int = 200) -> DataFrame:
    """Adds distance and kept to `features`. `feats` is read several times: pass a written table."""
    levels = {"a": F.concat(F.lit("a"), "glang", F.lit("\x01"), "gsource"), "b": F.concat(F.lit("b"), "glang"), "c": F.lit("c")}
    mean = feats.groupBy("glang", "gsource").agg((F.sum("word_chars") / F.greatest(F.sum("n_words"), F.lit(1))).alias("m0"))
    mean = cut_lineage(mean, "means")
    ratio = lambda a, b: F.round(SCALE * F.sqrt(F.col(a) / (F.col(b) + SHRINK)))
    x = join_bounded(feats, mean, ["glang", "gsource"], "inner").select(
        *feats.columns,
        F.round(SCALE * F.log(F.greatest((F.col("word_chars") + SHRINK * F.col("m0")) / (F.col("n_words") + SHRINK), F.lit(0.01)))).cast("long").alias("x0"),
        ratio("n_symbols", "n_words").cast("long").alias("x1"), ratio("n_dup_lines", "n_lines").cast("long").alias("x2"),
        ratio("n_repeat_words", "n_words").cast("long").alias("x3"), ratio("n_upper", "word_chars").cast("long").alias("x4"))
    cells = x.where("n_words > 0").groupBy("glang", "gsource", *XS).agg(F.count("*").alias("w"))
    cells = cut_lineage(cells.select(F.explode(F.array(*levels.values())).alias("g"), "w", *XS).groupBy("g", *XS).agg(F.sum("w").alias("w")), "cells")
    params = estimate(cells)
    groups = feats.select("glang", "gsource").distinct()
    for k, g in levels.items():
        groups = groups.join(params.select(F.col("g").alias("k"), F.struct("mu", "inv", "total").alias(k)), g == F.col("k"), "left").drop("k")
    big = lambda k: F.when(F.col(f"{k}.total") >= min_rows, F.col(k))
    groups = cut_lineage(groups.withColumn("p", F.coalesce(big("a"), big("b"), F.col("c"))).select("glang", "gsource", "p.mu", "p.inv"), "groups")
    far = F.round(_distance(), 6)
    return (join_bounded(x, groups, ["glang", "gsource"], "left").withColumn("distance", far)
            .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(1 - alpha, DIM), F.lit(True))))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return judge(cut_lineage(features(docs), "quality")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the distance reject."""
    row = free_name(docs, "__row")
    keyed = docs.withColumn(row, row_key(docs))
    verdict = judge(cut_lineage(features(keyed, keep=[row]), "quality"))
    bad = cut_lineage(verdict.where(~F.col("kept")).select(row).distinct(), "rejected")
    return join_bounded(keyed, bad, row, "left_anti").select(*[f"`{c}`" for c in docs.columns])
