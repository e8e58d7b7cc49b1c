"""Statistics between the channels of a montage, from sums that tasks merge.

A row holds one window (or block) of all channels side by side, so a task turns
it into one matrix product. Sums of a recording are kept in the task while its
windows pass and leave as one number per pair, which Spark adds up: nothing is
copied per pair, and a recording may be spread over any number of tasks.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.shape import record_array
from ..session import cut_lineage
from .signal import window_parts
from .spectral import BANDS, _hamming

#: Cross-spectra whose imaginary part is below this share of the powers have no sign.
NO_PHASE = 1e-9


def side_by_side(parts: DataFrame, keys: list[str], channel: str, part: str) -> DataFrame:
    """One row per `keys`: the pieces of all channels in the order (channel, block) as `chs`, `lens` and one flat array."""
    g = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(channel).alias("c"), F.col("block_id").alias("b"), F.col(part).alias("s")))).alias("s"))
    return g.select(*keys, F.transform("s", lambda x: x["c"]).alias("chs"), F.transform("s", lambda x: F.size(x["s"])).alias("lens"),
                    F.flatten(F.transform("s", lambda x: F.transform(x["s"], lambda v: v.cast("double")))).alias("flat"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, dict]]:
    """Row number and samples by channel."""
    flat = batch.column("flat")
    values, ends = flat.values.to_numpy(zero_copy_only=False), flat.offsets.to_numpy()
    for i, (chs, lens) in enumerate(zip(batch.column("chs").to_pylist(), batch.column("lens").to_pylist())):
        at, out = ends[i], {}
        for c, n in zip(chs, lens):
            out.setdefault(c, []).append(values[at:at + n])
            at += n
        yield i, {c: x[0] if len(x) == 1 else np.concatenate(x) for c, x in out.items()}


def _summed(rows: DataFrame, keys: list[str], fields: T.StructType, add: Callable, emit: Callable, held: int = 256) -> DataFrame:
    """Fold rows into per-key sums inside a task: `add(old or None, samples)` gives the new sums (or None), `emit`
    their columns. At most `held` keys are open at a time; what leaves early is added up by the caller's groupBy."""
    schema = T.StructType([rows.schema[k] for k in keys] + list(fields))
    arrow = to_arrow_schema(schema)

    def out(key, sums):
        cols = emit(sums)
        n = len(cols[0])
        return pa.RecordBatch.from_arrays([pa.array([k] * n, arrow.field(i).type) for i, k in enumerate(key)]
                                          + [pa.array(c, arrow.field(len(key) + i).type) for i, c in enumerate(cols)], schema=arrow)

    def run(batches):
        open_: dict[tuple, object] = {}
        for b in batches:
            names = list(zip(*[b.column(k).to_pylist() for k in keys]))
            for i, x in _matrices(b):
                new = add(open_.get(names[i]), x)
                if new is not None:
                    open_[names[i]] = new
                if len(open_) > held:
                    for key in list(open_)[: held // 2]:
                        yield out(key, open_.pop(key))
        for key, sums in open_.items():
            yield out(key, sums)

    return rows.mapInArrow(run, schema)


def pair_sums(blocks: DataFrame, rec: list[str], channel: str) -> DataFrame:
    """(rec, c1 <= c2) with n, sx, sy and sxy over the samples of the blocks that hold both channels."""
    rows = side_by_side(blocks, [*rec, "block_id"], channel, "samples").drop("block_id")

    def add(sums, samples):
        sums = sums or {}
        sizes: dict[int, list] = {}
        for c, x in sorted(samples.items()):
            if len(x):
                sizes.setdefault(len(x), []).append(c)
        for n, names in sizes.items():
            x = np.stack([samples[c] for c in names])
            new, names = (n, x.sum(axis=1), x @ x.T), tuple(names)
            sums[names] = tuple(a + b for a, b in zip(sums[names], new)) if names in sums else new
        return sums or None

    def emit(sums):
        out = [[] for _ in range(6)]
        for names, (n, s, gram) in sums.items():
            i, j = np.triu_indices(len(names))
            for col, v in zip(out, ([names[a] for a in i], [names[b] for b in j], [n] * len(i), s[i].tolist(), s[j].tolist(), gram[i, j].tolist())):
                col += v
        return out

    kind = blocks.schema[channel].dataType
    fields = T.StructType([T.StructField("c1", kind), T.StructField("c2", kind), T.StructField("n", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("sx", "sy", "sxy")])
    return _summed(rows, rec, fields, add, emit).groupBy(*rec, "c1", "c2").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy")])


def cross_spectra(blocks: DataFrame, rec: list[str], channel: str, block_len: int, sfreq: float, seg: int, overlap: float, fmin: float, fmax: float) -> DataFrame:
    """Per (rec, f, c1 < c2): windows n, sums of the cross-spectrum (re, im), of the sign of its imaginary part (sgn)
    and of both powers (p1, p2), over mean-removed, Hamming-weighted windows that both channels fill."""
    parts = window_parts(blocks, [*rec, channel], block_len, seg, int(round(seg * (1 - overlap))))
    rows = side_by_side(parts, [*rec, "win_id"], channel, "part").drop("win_id")
    freq = np.arange(seg // 2 + 1) * sfreq / seg
    bins = np.flatnonzero((freq >= fmin) & (freq <= fmax))
    weight = _hamming(seg)
    scale = np.where((bins == 0) | (2 * bins == seg), 1.0, 2.0) / (sfreq * (weight ** 2).sum())

    def add(sums, samples):
        names = tuple(c for c, x in sorted(samples.items()) if len(x) == seg)
        if len(names) < 2:
            return sums
        x = np.stack([samples[c] for c in names])
        f = np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * weight, axis=1)[:, bins].T           # bins x channels
        cross = f[:, :, None] * f[:, None, :].conj() * scale[:, None, None]
        power = np.einsum("kii->ki", cross).real
        sign = np.where(np.abs(cross.imag) > NO_PHASE * np.sqrt(power[:, :, None] * power[:, None, :]), np.sign(cross.imag), 0)
        new = [1, cross, sign, power]
        sums = sums or {}
        sums[names] = [a + b for a, b in zip(sums[names], new)] if names in sums else new
        return sums

    def emit(sums):
        out = [[] for _ in range(9)]
        for names, (n, cross, sign, power) in sums.items():
            i, j = np.triu_indices(len(names), 1)
            for k, hz in enumerate(freq[bins].tolist()):
                out[0] += [hz] * len(i)
                out[1] += [names[a] for a in i]
                out[2] += [names[b] for b in j]
                out[3] += [n] * len(i)
                for col, v in zip(out[4:], (cross[k, i, j].real, cross[k, i, j].imag, sign[k, i, j], power[k, i], power[k, j])):
                    col += v.tolist()
        return out

    kind = blocks.schema[channel].dataType
    fields = T.StructType([T.StructField("f", T.DoubleType()), T.StructField("c1", kind), T.StructField("c2", kind), T.StructField("n", T.LongType())]
                          + [T.StructField(c, T.DoubleType()) for c in ("re", "im", "sgn", "p1", "p2")])
    long = _summed(rows, rec, fields, add, emit)
    return long.groupBy(*rec, "f", "c1", "c2").agg(*[F.sum(c).alias(c) for c in ("n", "re", "im", "sgn", "p1", "p2")])


def connectivity(blocks: DataFrame, rec: list[str], channel: str, block_len: int, sfreq: float, seg: int, overlap: float = 0.5,
                 bands: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Per (rec, band, c1, c2) two measures that leave out what reaches both channels at once: the mean over the band's
    frequencies of the absolute imaginary part of coherency, and of the phase-lag index. NULL where a channel is silent."""
    bands = bands or {"alpha": BANDS["alpha"]}
    x = cross_spectra(blocks, rec, channel, block_len, sfreq, seg, overlap, min(lo for lo, _ in bands.values()), max(hi for _, hi in bands.values()))
    edges = record_array(["band", "lo", "hi"], *[(b, float(lo), float(hi)) for b, (lo, hi) in bands.items()])
    x = x.withColumn("e", F.explode(F.filter(edges, lambda e: (F.col("f") >= e["lo"]) & (F.col("f") < e["hi"]))))
    both = F.col("p1") * F.col("p2")
    return x.groupBy(*rec, F.col("e.band").alias("band"), "c1", "c2").agg(
        F.max("n").alias("n_windows"), F.avg(F.abs(F.col("im")) / F.when(both > 0, F.sqrt(both))).alias("imag_coherence"),
        F.avg(F.when(both > 0, F.abs(F.col("sgn")) / F.col("n"))).alias("phase_lag_index"))


def shrunk_covariance(blocks: DataFrame, rec: list[str], channel: str, channels: list) -> DataFrame:
    """Per recording the covariance of `channels` (row-major array), shrunk towards the mean variance by the analytic
    weight of Ledoit and Wolf, with n and the weight. Both come from sums over blocks: of products, and of the squared
    norms of the samples with the samples and with themselves (third and fourth moments). Blocks without all of the
    channels in equal length are left out; a recording of fewer than two samples has no row."""
    p = len(channels)
    i, j = np.triu_indices(p)
    rows = side_by_side(blocks.where(F.col(channel).isin(channels)), [*rec, "block_id"], channel, "samples").drop("block_id")

    def add(sums, samples):
        if len(samples) < p or len({len(x) for x in samples.values()}) > 1:
            return sums
        x = np.stack([samples[c] for c in channels])
        r = (x * x).sum(axis=0)
        new = np.concatenate([[x.shape[1], (r * r).sum()], x.sum(axis=1), x @ r, (x @ x.T)[i, j]])
        return new if sums is None else sums + new

    fields = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("v", T.DoubleType())])
    long = _summed(rows, rec, fields, add, lambda sums: (range(len(sums)), sums.tolist()))
    whole = long.groupBy(*rec, "slot").agg(F.sum("v").alias("v")).groupBy(*rec).agg(F.array_sort(F.collect_list(F.struct("slot", "v"))).alias("s"))
    whole = whole.select(*rec, F.transform("s", lambda x: x["v"]).alias("s")).where(F.col("s")[0] >= 2)
    schema = T.StructType([*whole.select(*rec).schema, *T.StructType.fromDDL("n long, shrinkage double, cov array<double>")])

    def finish(parts):
        for pdf in parts:
            s = np.stack(pdf["s"].tolist()) if len(pdf) else np.zeros((0, 2 + 2 * p + len(i)))
            n, m = s[:, 0], s[:, 2:2 + p] / s[:, :1]
            second = np.zeros((len(s), p, p))
            second[:, i, j] = second[:, j, i] = s[:, 2 + 2 * p:]
            cov = second / n[:, None, None] - m[:, :, None] * m[:, None, :]
            m2 = (m * m).sum(axis=1)
            r = np.einsum("kii->k", second)
            # sum over samples of |x - m|^4, written out in the sums
            fourth = (s[:, 1] - 4 * (m * s[:, 2 + p:2 + 2 * p]).sum(axis=1) + 2 * m2 * r + 4 * np.einsum("ki,kij,kj->k", m, second, m) - 3 * n * m2 * m2)
            mu = np.einsum("kii->k", cov) / p
            norm = (cov * cov).sum(axis=(1, 2))
            away = (norm - p * mu * mu) / p
            noise = np.minimum((fourth / n - norm) / (n * p), away)
            w = np.where(away > 0, np.maximum(noise, 0) / np.where(away > 0, away, 1), 0.0)
            cov = (1 - w)[:, None, None] * cov + (w * mu)[:, None, None] * np.eye(p)
            yield pdf[rec].assign(n=n.astype(np.int64), shrinkage=w, cov=list(cov.reshape(len(s), -1)))

    return whole.mapInPandas(finish, schema)


def _power(m: np.ndarray, f: Callable) -> np.ndarray:
    """f of the eigenvalues of symmetric matrices (stacked or one)."""
    ev, vec = np.linalg.eigh(m)
    return (vec * f(ev)[..., None, :]) @ np.swapaxes(vec, -1, -2)


def _stack(cov: pd.Series) -> np.ndarray:
    x = np.stack(cov.tolist())
    p = int(round(np.sqrt(x.shape[1])))
    return x.reshape(-1, p, p)


def _between(covs: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Logarithms of the matrices as seen from the mean."""
    root = _power(mean, lambda v: 1 / np.sqrt(v))
    return _power(root @ covs @ root, np.log)


def geometric_means(covs: DataFrame, fold: str | None = None, models: list[int] = [0], tol: float = 1e-9, max_steps: int = 100) -> dict[int, np.ndarray]:
    """The affine-invariant mean of the covariances (column `cov`). With a `fold` column there is one mean per model k,
    fitted on the rows of the other folds only; all models advance together, one job a step. A step moves along the mean
    of the logarithms seen from the current mean, summed in the tasks; the fixed point is where that is zero. Raises where
    it is not reached, and for a model without rows."""
    covs = cut_lineage(covs.select(*([fold] if fold else []), "cov"), "covariances")

    def step(current: dict[int, np.ndarray] | None) -> dict[int, tuple[float, np.ndarray]]:
        def run(parts):
            sums: dict[int, list] = {}
            for pdf in parts:
                if not len(pdf):
                    continue
                x = _stack(pdf["cov"])
                for k in models if current is None else current:
                    use = x if fold is None else x[(pdf[fold] != k).to_numpy()]
                    if len(use):
                        s = sums.setdefault(k, [0, 0.0])
                        s[0] += len(use)
                        s[1] = s[1] + (use if current is None else _between(use, current[k])).sum(axis=0)
            for k, (n, s) in sums.items():
                v = np.r_[float(n), s.ravel()]
                yield pd.DataFrame({"model": k, "slot": np.arange(len(v)), "v": v})

        out: dict[int, list] = {}
        for r in covs.mapInPandas(run, "model int, slot int, v double").groupBy("model", "slot").agg(F.sum("v").alias("v")).orderBy("model", "slot").collect():
            out.setdefault(r.model, []).append(r.v)  # one matrix of the montage per model
        return {k: (v[0], np.array(v[1:]).reshape([int(round(np.sqrt(len(v) - 1)))] * 2) / v[0]) for k, v in out.items()}

    means = {k: m for k, (_, m) in step(None).items()}
    if missing := set(models) - set(means):
        raise ValueError(f"no rows to fit models {sorted(missing)}")
    todo = dict(means)
    for _ in range(max_steps):
        for k, (_, move) in step(todo).items():
            root = _power(means[k], np.sqrt)
            means[k] = root @ _power(move, np.exp) @ root
            means[k] = (means[k] + means[k].T) / 2
            if np.sqrt((move ** 2).sum()) < tol:
                del todo[k]
            else:
                todo[k] = means[k]
        if not todo:
            return means
    raise ArithmeticError(f"means {sorted(todo)} not found in {max_steps} steps")


def tangent_coordinates(covs: DataFrame, keys: list[str], means: dict[int, np.ndarray], fold: str | None = None) -> DataFrame:
    """Per (keys, model): the upper triangle (row by row, off the diagonal times the root of 2) of each covariance's
    logarithm seen from the model's mean. Lengths are distances from the mean. `held_out`: not among the rows of the mean."""
    cols = [*keys, *([fold] if fold else [])]
    schema = T.StructType([*covs.select(*keys).schema, *T.StructType.fromDDL("model int, held_out boolean, coordinates array<double>")])

    def run(parts):
        for pdf in parts:
            if not len(pdf):
                continue
            x = _stack(pdf["cov"])
            i, j = np.triu_indices(x.shape[1])
            for k, mean in means.items():
                c = _between(x, mean)[:, i, j] * np.where(i == j, 1.0, np.sqrt(2.0))
                out = pdf[keys].copy()
                out["model"], out["held_out"], out["coordinates"] = k, (pdf[fold] == k if fold else False), list(c)
                yield out

    return covs.select(*cols, "cov").mapInPandas(run, schema)


def tangent_space(blocks: DataFrame, rec: list[str], channel: str, channels: list, fold: Column, n_folds: int) -> DataFrame:
    """Shrunk covariances of the recordings and their coordinates seen from each training set's own mean."""
    covs = cut_lineage(shrunk_covariance(blocks, rec, channel, channels).withColumn("fold", fold.cast("int")), "covariances")
    return tangent_coordinates(covs, rec, geometric_means(covs, "fold", list(range(n_folds))), "fold")
