"""Repair of bad channels by splines on the sphere.

The weights of a bad channel depend on where the channels stand and on which
are bad, not on the signal. They are solved once for each different (montage,
bad set), however many recordings share it, and applied as one small matrix
product per block.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .montage import _matrices, side_by_side
from .signal import with_recording

XYZ = ["x", "y", "z"]


def kernel(cosine: np.ndarray, stiffness: int = 4, terms: int = 50) -> np.ndarray:
    """Sum over n of (2n + 1) / (n (n + 1))^stiffness * P_n(cosine) / 4 pi."""
    n = np.arange(1, terms + 1)
    return np.polynomial.legendre.legval(cosine, np.r_[0.0, (2 * n + 1) / (n * (n + 1.0)) ** stiffness / (4 * np.pi)])


def spline_matrix(pos: np.ndarray, bad: np.ndarray, stiffness: int = 4, terms: int = 50, smooth: float = 1e-5) -> np.ndarray:
    """Weights (bad x good) of the spline through the good channels, at the bad ones. Constants are kept exactly."""
    u = pos / np.linalg.norm(pos, axis=1, keepdims=True)
    cosine = np.clip(u @ u.T, -1, 1)
    good = ~bad
    n = int(good.sum())
    lhs = np.zeros((n + 1, n + 1))
    lhs[:n, :n] = kernel(cosine[np.ix_(good, good)], stiffness, terms) + smooth * np.eye(n)
    lhs[:n, n] = lhs[n, :n] = 1.0
    rhs = np.concatenate([kernel(cosine[np.ix_(bad, good)], stiffness, terms), np.ones((int(bad.sum()), 1))], axis=1)
    return (rhs @ np.linalg.pinv(lhs))[:, :n]


def spline_weights(flags: DataFrame, positions: DataFrame, rec: list[str], channel: str, **how) -> DataFrame:
    """Per recording with bad channels: `goods`, `bads` and the weights row by row. `positions` (channel, x, y, z, around
    the middle of the head) may also be keyed by columns of `rec`. Channels without a position take no part."""
    own = [c for c in rec if c in positions.columns]
    m = flags.select(*rec, channel, F.coalesce("bad", F.lit(False)).alias("bad")).join(positions.select(*own, channel, *XYZ), [*own, channel])
    sets = m.groupBy(*rec).agg(F.array_sort(F.collect_list(F.struct(F.col(channel).alias("c"), *XYZ, "bad"))).alias("m"))
    sets = sets.where(F.exists("m", lambda c: c["bad"])).withColumn("key", F.sha2(F.to_json("m"), 256))
    each = lambda field: F.transform("m", lambda c: c[field].cast("double")).alias(field)
    once = sets.groupBy("key").agg(F.first("m").alias("m")).select("key", *map(each, XYZ), F.transform("m", lambda c: c["bad"]).alias("bad"))

    def solve(parts):
        for pdf in parts:
            w = [spline_matrix(np.stack([np.asarray(r[c], float) for c in XYZ], axis=1), np.asarray(r["bad"], bool), **how).ravel() for _, r in pdf.iterrows()]
            yield pd.DataFrame({"key": pdf["key"], "weights": w})

    solved = once.mapInPandas(solve, "key string, weights array<double>")
    side = lambda bad: F.transform(F.filter("m", lambda c: c["bad"] == bad), lambda c: c["c"])
    return sets.select(*rec, "key", side(False).alias("goods"), side(True).alias("bads")).join(solved, "key").drop("key")


def apply_weights(blocks: DataFrame, weights: DataFrame, rec: list[str], channel: str) -> DataFrame:
    """(rec, channel, block_id, samples, repaired): bad channels become the weighted sum of the good ones. A bad channel is
    NULL where its recording has no good channel, or where one of them lacks the block or ends early."""
    rows = with_recording(side_by_side(blocks, [*rec, "block_id"], channel, "samples"), weights, rec, "left")
    schema = T.StructType([*rows.select(*rec).schema, T.StructField(channel, blocks.schema[channel].dataType), rows.schema["block_id"],
                           *T.StructType.fromDDL("samples array<double>, repaired boolean")])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in arrow]
            keys = list(zip(*[b.column(c).to_pylist() for c in rec]))
            goods, bads, w, ids = (b.column(c).to_pylist() for c in ("goods", "bads", "weights", "block_id"))
            for i, x in _matrices(b):
                fixed = dict.fromkeys(bads[i] or [])
                near = [x.get(c) for c in goods[i] or []]
                if fixed and near and all(v is not None and len(v) == len(near[0]) for v in near):
                    fixed = dict(zip(bads[i], np.reshape(w[i], (len(bads[i]), -1)) @ np.stack(near)))
                for c, v in x.items():
                    for col, value in zip(out, (*keys[i], c, ids[i], fixed[c] if c in fixed else v, c in fixed)):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


def spline_repair(blocks: DataFrame, flags: DataFrame, positions: DataFrame, rec: list[str], channel: str, **how) -> DataFrame:
    """Replace bad channels by the spherical spline through the good ones."""
    return apply_weights(blocks, spline_weights(flags, positions, rec, channel, **how), rec, channel)
