"""Periodised wavelet transform of rows of vectors along a long axis.

A signal is rows (keys, i, v): position and a vector of fixed width. Every level
is one shuffle: a row goes to the blocks of outputs whose taps reach it, and a
block is transformed as one matrix. This is so at every length, so a channel may
have any number of rows and all channels of a table go down together; a channel
that has reached its depth waits. Odd lengths repeat their last row.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import cut_lineage


def mirror(lo: np.ndarray) -> np.ndarray:
    """High-pass taps that belong to orthogonal low-pass taps."""
    return np.asarray(lo)[::-1] * (-1.0) ** np.arange(len(lo))


def _blocks_of(outputs: Column, block: int) -> Column:
    return F.array_distinct(F.transform(outputs, lambda o: F.floor(o / block)))


def length_at(total: Column, level) -> Column:
    """Length of the signal that level `level` (from 1) takes apart."""
    return F.ceil(total / F.pow(F.lit(2.0), F.lit(level) - 1)).cast("long")


def decompose(rows: DataFrame, keys: list[str], i: str, v: str, depth: Column, lo: np.ndarray, block: int = 4096) -> DataFrame:
    """(keys, total, level, band, i, v): the details ('d') of levels 1 .. depth and the approximation ('a') of the last.
    `depth` gives a signal's number of levels (at least 1) from its length `total`; positions `i` run from 0 without gaps."""
    lo, hi = np.asarray(lo), mirror(lo)
    taps, half = len(lo), len(lo) // 2
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    sizes = cut_lineage(sizes.withColumn("depth", F.greatest(depth.cast("int"), F.lit(1))), "sizes")
    cols = [*keys, "total", "depth", "i", "v"]
    cur = rows.select(*keys, F.col(i).cast("long").alias("i"), F.col(v).alias("v")).join(sizes, keys).select(*cols)
    schema = T.StructType([*cur.schema, T.StructField("band", T.StringType())])
    deepest = sizes.agg(F.max("depth")).first()[0] or 0      # one number

    def run(key, pdf):
        q, n = int(pdf["q"].iloc[0]), int(pdf["n"].iloc[0])
        pdf = pdf.drop_duplicates("i").sort_values("i")
        even = n + n % 2
        out = np.arange(q * block, min((q + 1) * block, even // 2))
        take = (2 * out[:, None] + half - np.arange(taps)) % even
        x = np.stack(pdf["v"].to_list())[np.searchsorted(pdf["i"].to_numpy(), np.minimum(take, n - 1))]
        same = {c: pdf[c].iloc[0] for c in (*keys, "total", "depth")}
        return pd.concat([pd.DataFrame({**same, "i": out, "v": list(np.einsum("j,ojw->ow", f, x)), "band": b}) for b, f in (("a", lo), ("d", hi))])[schema.names]

    out = None
    for level in range(1, deepest + 1):
        cur = cur.withColumn("n", length_at(F.col("total"), level))
        even = F.col("n") + F.col("n") % 2
        own = F.when((F.col("n") % 2 == 1) & (F.col("i") == F.col("n") - 1), F.array(F.col("i"), F.col("i") + 1)).otherwise(F.array("i"))
        # outputs o with 2 o + half - j = i for some tap j, around the circle
        first = lambda c: F.ceil((c - half) / 2)
        outs = F.flatten(F.transform(own, lambda c: F.transform(F.sequence(first(c), first(c) + taps // 2 - 1), lambda o: F.pmod(o, F.floor(even / 2)))))
        g = cur.withColumn("q", F.explode(_blocks_of(outs, block))).groupBy(*keys, "q").applyInPandas(run, schema)
        g = cut_lineage(g.withColumn("level", F.lit(level)), "level")
        own_level = g.where((F.col("band") == "d") | (F.col("depth") == level))
        out = own_level if out is None else out.unionByName(own_level)
        cur = g.where((F.col("band") == "a") & (F.col("depth") > level)).select(*cols)
    if out is None:
        out = cur.select("*", F.lit("a").alias("band"), F.lit(1).alias("level"))
    return out.select(*keys, "total", "level", "band", "i", "v")


def reconstruct(bands: DataFrame, keys: list[str], lo: np.ndarray, block: int = 4096) -> DataFrame:
    """(keys, i, v) from subbands of `decompose`; those left out count as zero, but for a channel's deepest level, of
    which one must be there."""
    lo, hi = np.asarray(lo), mirror(lo)
    taps, half = len(lo), len(lo) // 2
    deepest = bands.agg(F.max("level")).first()[0] or 0      # one number
    cols = [*keys, "total", "band", "i", "v"]
    schema = bands.select(*cols).schema

    def run(key, pdf):
        q, n = int(pdf["q"].iloc[0]), int(pdf["n"].iloc[0])
        low = (n + n % 2) // 2
        out = np.arange(q * block, min((q + 1) * block, n))
        # taps j with s = 2 o + half - j, of the parity of each output s
        j = np.arange(0, taps, 2)[None, :] + (out[:, None] + half) % 2
        o = (out[:, None] - half + j) // 2 % low
        y = 0.0
        for band, f in (("a", lo), ("d", hi)):
            part = pdf[pdf["band"] == band].drop_duplicates("i").sort_values("i")
            if len(part):
                y = y + np.einsum("oj,ojw->ow", f[j], np.stack(part["v"].to_list())[np.searchsorted(part["i"].to_numpy(), o)])
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in (*keys, "total")}, "band": "a", "i": out, "v": list(y)})[schema.names]

    up = None
    for level in range(deepest, 0, -1):
        here = bands.where(F.col("level") == level).select(*cols)
        here = (here if up is None else here.unionByName(up)).withColumn("n", length_at(F.col("total"), level))
        low = F.floor((F.col("n") + F.col("n") % 2) / 2)
        reach = F.transform(F.sequence(F.lit(0), F.lit(taps - 1)), lambda j: F.pmod(2 * F.col("i") + half - j, 2 * low))
        q = _blocks_of(F.filter(reach, lambda s: s < F.col("n")), block)
        up = cut_lineage(here.withColumn("q", F.explode(q)).groupBy(*keys, "q").applyInPandas(run, schema), "up")
    return (bands if up is None else up).select(*keys, "i", "v")
