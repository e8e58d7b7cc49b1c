"""Resampling by any rational ratio with a polyphase bank."""
from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .signal import reflected, with_halo


def bank(sfreq: float, target: float, factor: float = 0.8) -> tuple[int, int, np.ndarray]:
    """up, down and taps (up x 2 half + 2): row k weights the samples around an output that lies k / up behind a sample,
    from `half` before it to half + 1 after. Low-pass at `factor` x the lower Nyquist frequency, unit gain in each row."""
    ratio = Fraction(target / sfreq).limit_denominator(10_000)
    if abs(float(ratio) * sfreq - target) > 1e-9 * target:
        raise ValueError(f"{sfreq} -> {target} Hz is not a ratio of whole numbers up to 10000")
    up, down = ratio.numerator, ratio.denominator
    cut = factor * min(sfreq, target) / 2
    width = min(max(cut * 0.25, 2.0), max(sfreq / 2 - cut, 1e-6))
    half = max(1, int(np.ceil(3.3 / width * sfreq)) // 2)
    u = np.arange(up)[:, None] / up - np.arange(-half, half + 2)[None, :]
    fc = 2 * (cut + width / 2) / sfreq
    taps = np.where(np.abs(u) <= half, fc * np.sinc(fc * u) * (0.54 + 0.46 * np.cos(np.pi * u / half)), 0.0)
    return up, down, taps / taps.sum(axis=1, keepdims=True)


def polyphase(blocks: DataFrame, keys: list[str], block_len: int, sfreq: float, target: float, factor: float = 0.8) -> DataFrame:
    """(keys, block_id, first, samples) at the target rate: output m stands at time m / target of the recording, whatever
    the blocks; its phase follows the number of the sample in the recording. A block gives the outputs that start in it;
    `first` is the number of its first. Samples of the nearest blocks come with the halo, a recording's own ends are
    continued by odd reflection."""
    up, down, taps = bank(sfreq, target, factor)
    half = taps.shape[1] // 2 - 1
    d = with_halo(blocks, keys, half + 1, -(-(half + 1) // block_len))
    names = [*keys, "block_id"]
    schema = T.StructType([*d.select(*names).schema, T.StructField("first", T.LongType()), T.StructField("samples", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for pdf in batches:
            firsts, out = [], []
            for b, own, before, after in zip(pdf["block_id"], pdf["samples"], pdf["before"], pdf["after"]):
                x = np.asarray(own, float)
                left, right = (np.asarray(v, float) if v is not None else x[:0] for v in (before, after))
                base = int(b) * block_len
                m = np.arange(-(-base * up // down), -(-(base + len(x)) * up // down))
                firsts.append(int(m[0]) if len(m) else -1)
                if not len(m):
                    out.append([])
                    continue
                left, right = left[len(left) - min(half, len(left)):], right[:half + 1]
                z = np.concatenate([left, x, right])
                z = np.concatenate([reflected(z, half - len(left)), z, reflected(z[::-1], half + 1 - len(right))[::-1]])
                at = m * down // up - base
                out.append((np.lib.stride_tricks.sliding_window_view(z, taps.shape[1])[at] * taps[m * down % up]).sum(axis=1))
            yield pdf[names].assign(first=firsts, samples=out)

    return d.where(F.size("samples") > 0).mapInPandas(run, schema).where("first >= 0")


def recut(pieces: DataFrame, keys: list[str], block_len: int) -> DataFrame:
    """Pieces (first, samples) of a recording to blocks of `block_len`: one shuffle on (keys, block)."""
    last = F.col("first") + F.size("samples") - 1
    d = pieces.withColumn("b", F.explode(F.sequence(F.floor(F.col("first") / block_len), F.floor(last / block_len))))
    lo = F.greatest(F.col("b") * block_len - F.col("first"), F.lit(0))
    hi = F.least((F.col("b") + 1) * block_len - F.col("first"), F.size("samples").cast("long"))
    d = d.select(*keys, F.col("b").alias("block_id"), "first", F.slice("samples", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("part"))
    g = d.groupBy(*keys, "block_id").agg(F.array_sort(F.collect_list(F.struct("first", "part"))).alias("s"))
    return g.select(*keys, "block_id", F.flatten(F.transform("s", lambda x: x["part"])).alias("samples"))


def resample_to(blocks: DataFrame, keys: list[str], block_len: int, sfreq: float, target: float, factor: float = 0.8, out_len: int | None = None) -> DataFrame:
    """Blocks of `out_len` samples (default: `block_len`) at the target rate."""
    return recut(polyphase(blocks, keys, block_len, sfreq, target, factor), keys, out_len or block_len)
