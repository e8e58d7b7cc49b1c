"""Cycle segmentation, cycle resampling, wavelet split and waveform features.

Recordings may be arbitrarily long, so every step works on chunks: crossings
per sample chunk, the boundary scan chunk by chunk with repair, the wavelet
transform on blocks of cycles with a halo.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ..functions import formulas as fm
from ..functions.ordered import dense_index, exact_percentiles, neighbour
from ..functions.shape import record_array
from ..session import cut_lineage
from .aggregates import across_channels, fixed_count_summary, modal_value
from .signal import with_halo
from .wavelets import decompose, reconstruct

# The 16 scaling taps of the Daubechies-8 wavelet.
DB8 = [
    0.05441584224308161, 0.3128715909144659, 0.6756307362980128, 0.5853546836548691,
    -0.015829105256023893, -0.2840155429624281, 0.00047248457399797254, 0.128747426620186,
    -0.01736930100202211, -0.04408825393106472, 0.013981027917015516, 0.008746094047015655,
    -0.00487035299301066, -0.0003917403729959771, 0.0006754494059985568, -0.00011747678400228192,
]


def crossings(blocks: DataFrame, keys: list[str], block_len: int) -> DataFrame:
    """Positive-slope zero crossings (previous < 0, current >= 0) as one
    sorted array per block; the sample before a block comes with its halo."""
    d = with_halo(blocks, keys, 1)
    n = F.size("samples")
    prev = F.concat(F.coalesce(F.col("before"), F.slice("samples", F.lit(1), F.lit(1))), F.slice("samples", F.lit(1), F.greatest(n - 1, F.lit(0))))
    up = F.zip_with(prev, "samples", lambda a, b: (a < 0) & (b >= 0))
    base = F.col("block_id") * block_len
    return d.select(*keys, "block_id", F.array_compact(F.transform(up, lambda u, i: F.when(u, base + i))).alias("cross"))


def _follow(entry_t, entry_gaps, cross, after, more, window):
    """Boundary scan over one chunk. Returns (pairs, exit_t, exit_gaps): the
    steps whose start lies in this chunk and the state handed on; None where
    the crossings ahead do not reach as far as a step."""
    own_last = cross[-1]
    ahead = np.concatenate([cross, after])
    gaps = list(entry_gaps)
    t = cross[0] if entry_t is None else entry_t
    pairs = []
    while t <= own_last:
        lo = int(np.searchsorted(ahead, t, side="right"))
        if lo >= len(ahead):
            break
        period = float(np.median(gaps[-window:])) if gaps else float(ahead[lo] - t)
        target = t + period
        k = int(np.searchsorted(ahead, target, side="left"))
        if k >= len(ahead) and more:
            return None
        options = [c for c in (k - 1, k) if lo <= c < len(ahead)] or [lo]
        best = min(options, key=lambda c: (abs(ahead[c] - target), c))
        nxt = int(ahead[best])
        gaps = (gaps + [nxt - int(t)])[-window:]
        pairs.append((int(t), nxt))
        t = nxt
    return pairs, int(t), [int(g) for g in gaps]


def phase_locked_cycles(cross: DataFrame, keys: list[str], blocks_per_chunk: int, window: int = 5) -> DataFrame:
    """(keys, start_i, end_i) of consecutive phase-locked boundaries.

    The next boundary is the crossing nearest to the last one plus the median
    of the last `window` accepted gaps, so each step depends on earlier output.
    Every chunk is scanned from a guessed state at once; a chunk whose true
    entry state turns out different is scanned again. The loop ends when every
    entry state equals its predecessor's exit state, which is the sequential
    result; the scan forgets its start within a few cycles, so two or three
    rounds are normal, and every round settles at least one chunk more. A chunk
    sees the crossings of the next one; where a step is longer than that, of as
    many as it needs."""
    ahead = 1
    while (out := _locked(cross, keys, blocks_per_chunk, window, ahead)) is None:
        ahead *= 2
    return out


def _locked(cross: DataFrame, keys: list[str], blocks_per_chunk: int, window: int, ahead: int) -> DataFrame | None:
    """The scan with the crossings of `ahead` further chunks; None where they are too few."""
    chunk = F.floor(F.col("block_id") / blocks_per_chunk)
    c = cross.where(F.size("cross") > 0).groupBy(*keys, chunk.alias("chunk")).agg(
        F.array_sort(F.flatten(F.collect_list("cross"))).alias("cross"))
    w = W.partitionBy(*keys).orderBy("chunk")
    # one narrow row per chunk goes through this window, the arrays do not
    seq = c.select(*keys, "chunk").withColumn("seq", F.row_number().over(w)).withColumn(
        "n_seq", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    c = cut_lineage(c.join(seq.hint("merge"), [*keys, "chunk"]).drop("chunk"), "crossings")
    nxt = c.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(ahead))).alias("d"), "seq", "cross")
    nxt = nxt.groupBy(*keys, (F.col("seq") - F.col("d")).alias("seq")).agg(F.flatten(F.array_sort(F.collect_list("cross"))).alias("after"))
    rows = cut_lineage(c.join(nxt.hint("merge"), [*keys, "seq"], "left").select(
        *keys, "seq", "cross", F.coalesce("after", F.array().cast("array<bigint>")).alias("after"),
        (F.col("seq") + ahead < F.col("n_seq")).alias("more")), "chunks")
    longs = T.ArrayType(T.LongType())
    schema = rows.select(*keys, "seq").schema
    for name, ty in (("exit_t", T.LongType()), ("exit_gaps", longs), ("entry_t", T.LongType()), ("entry_gaps", longs), ("starts", longs), ("ends", longs), ("short", T.BooleanType())):
        schema = schema.add(name, ty)

    def scan(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                fresh = bool(r.fresh)
                if not fresh:
                    out.append((r.exit_t, r.exit_gaps, r.entry_t, r.entry_gaps, r.starts, r.ends, False))
                    continue
                t0 = None if r.new_t is None or pd.isna(r.new_t) else int(r.new_t)
                g0 = [] if r.new_gaps is None else [int(g) for g in r.new_gaps]
                found = _follow(t0, g0, np.asarray(r.cross), np.asarray(r.after, dtype=np.int64), bool(r.more), window)
                pairs, t, gaps = found or ([], None, None)
                out.append((t, gaps, t0, g0, [p[0] for p in pairs], [p[1] for p in pairs], found is None))
            res = pd.DataFrame(out, columns=["exit_t", "exit_gaps", "entry_t", "entry_gaps", "starts", "ends", "short"])
            for col in ("exit_t", "entry_t"):
                res[col] = res[col].astype("Int64")
            yield pd.concat([pdf[[*keys, "seq"]].reset_index(drop=True), res], axis=1)

    empty = F.lit(None).cast("array<bigint>")
    first = rows.select("*", F.lit(True).alias("fresh"), F.lit(None).cast("bigint").alias("new_t"), empty.alias("new_gaps"),
                        *[F.lit(None).cast("bigint").alias(n) for n in ("exit_t", "entry_t")],
                        *[empty.alias(n) for n in ("exit_gaps", "entry_gaps", "starts", "ends")])
    state = cut_lineage(first.mapInPandas(scan, schema), "scan")
    while True:
        if not state.where("short").isEmpty():
            return None
        hand = state.select(*keys, (F.col("seq") + 1).alias("seq"), F.col("exit_t").alias("new_t"), F.col("exit_gaps").alias("new_gaps"))
        # merged in every round: as many broadcasts of a whole state would pass the driver
        j = state.join(hand.hint("merge"), [*keys, "seq"], "left")
        fresh = (F.col("seq") > 1) & ~(F.col("new_t").eqNullSafe(F.col("entry_t")) & F.col("new_gaps").eqNullSafe(F.col("entry_gaps")))
        j = j.withColumn("fresh", fresh)
        if j.where("fresh").isEmpty():
            break
        state = cut_lineage(j.join(rows.hint("merge"), [*keys, "seq"]).mapInPandas(scan, schema), "scan")
    z = state.select(*keys, F.explode(F.arrays_zip("starts", "ends")).alias("z"))
    return z.select(*keys, F.col("z.starts").alias("start_i"), F.col("z.ends").alias("end_i"))


def crossing_cycles(cross: DataFrame, keys: list[str], block_len: int) -> DataFrame:
    """Plain form: consecutive crossings bound a cycle."""
    long = cross.select(*keys, F.explode("cross").alias("start_i"))
    d = neighbour(long, keys, ["start_i"], {"start_i": "end_i"}, F.floor(F.col("start_i") / (block_len * 64)), 1, levels=2)
    return d.where("end_i is not null")


def cut_waves(cycles: DataFrame, blocks: DataFrame, keys: list[str], block_len: int) -> DataFrame:
    """Samples [start_i, end_i) of each cycle from the (broadband) blocks."""
    c = cycles.withColumn("block_id", F.explode(F.sequence(
        F.floor(F.col("start_i") / block_len), F.floor((F.col("end_i") - 1) / block_len))))
    j = c.join(blocks.select(*keys, "block_id", "samples"), [*keys, "block_id"])
    base = F.col("block_id") * block_len
    lo, hi = F.greatest(F.col("start_i") - base, F.lit(0)), F.least(F.col("end_i") - base, F.size("samples").cast("bigint"))
    part = F.slice("samples", (lo + 1).cast("int"), (hi - lo).cast("int"))
    g = j.groupBy(*keys, "start_i", "end_i").agg(F.array_sort(F.collect_list(F.struct("block_id", part.alias("p")))).alias("ps"))
    return g.select(*keys, "start_i", (F.col("end_i") - F.col("start_i")).alias("len"),
                    F.transform(F.flatten(F.transform("ps", lambda x: x.p)), lambda v: v.cast("double")).alias("wave"))


def valid_cycles(waves: DataFrame, keys: list[str], sfreq: float, iaf: Column, min_frac: float = 0.6, max_frac: float = 1.4,
                 amp_percentile: float = 0.1) -> DataFrame:
    """Adds `amp` and `valid`: period within the fractions of 1/iaf and
    amplitude at least the channel's own lower percentile over ALL cycles."""
    d = waves.withColumn("amp", F.array_max("wave") - F.array_min("wave")).withColumn("period_s", F.col("len") / F.lit(float(sfreq)))
    floor = exact_percentiles(d, keys, "amp", {"__p": amp_percentile}).select(*keys, "__p")
    ok = (F.col("period_s") >= F.lit(min_frac) / iaf) & (F.col("period_s") <= F.lit(max_frac) / iaf) & (F.col("amp") >= F.col("__p"))
    return d.join(floor, keys).withColumn("valid", ok).drop("__p")


def cycle_stats(valid: DataFrame, keys: list[str]) -> DataFrame:
    a = valid.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_detected"), F.count_if("valid").alias("n_valid"))
    m = exact_percentiles(valid.where("valid"), keys, "period_s", {"median_period_s": 0.5}).select(*keys, "median_period_s")
    return a.withColumn("rejection_rate", 1 - F.col("n_valid") / F.col("n_detected")).join(m, keys, "left")


def dft_resample(wave: Column, length: Column) -> Column:
    """Resample a cycle to `length` through its DFT: the low frequencies at
    both ends are kept, the bin at length//2 is zeroed when either length is
    even, amplitudes are preserved. No length, no cycle."""
    @pandas_udf(T.ArrayType(T.DoubleType()))
    def run(w: pd.Series, p: pd.Series) -> pd.Series:
        out = []
        for x, n in zip(w, p):
            if pd.isna(n):
                out.append(None)
                continue
            q, n = len(x), int(n)
            spec = np.fft.fft(np.asarray(x, float))
            m = min(q, n)
            new = np.zeros(n, dtype=complex)
            new[:m // 2 + 1] = spec[:m // 2 + 1]
            tail = m - m // 2 - 1
            if tail > 0:
                new[n - tail:] = spec[q - tail:]
            if n % 2 == 0 or q % 2 == 0:
                new[n // 2] = 0
            out.append(np.fft.ifft(new).real * (n / q))
        return pd.Series(out)
    return run(wave, length)


def psr(valid: DataFrame, keys: list[str], min_period: int = 40, strict: bool = True) -> DataFrame:
    """Valid cycles resampled to the modal cycle length P of their channel. A
    channel with P under `min_period` is an error; where not `strict`, its
    cycles get their P and no `wave_p`, and the other channels go on."""
    v = valid.where("valid")
    p = modal_value(v, keys, "len").withColumn("__ok", F.col("mode") >= min_period)
    if strict:
        p = p.withColumn("mode", F.when(F.col("__ok"), F.col("mode")).otherwise(F.raise_error(F.lit(f"modal cycle length below {min_period}")).cast("bigint")))
    d = v.join(p.select(*keys, F.col("mode").alias("P"), "__ok"), keys)
    return d.withColumn("wave_p", dft_resample(F.col("wave"), F.when(F.col("__ok"), F.col("P")))).drop("__ok")


def harmonic_profile(wave: Column, n_harmonics: int = 5) -> Column:
    """array of |DFT bin k| / |bin 1| for k = 1..n."""
    @pandas_udf(T.ArrayType(T.DoubleType()))
    def run(w: pd.Series) -> pd.Series:
        out = []
        for x in w:
            a = np.abs(np.fft.fft(np.asarray(x, float)))[1:n_harmonics + 1]
            out.append(list(a / a[0]) if a[0] > 0 else [None] * n_harmonics)
        return pd.Series(out)
    return run(wave)


def max_level(n: Column) -> Column:
    return F.greatest(F.floor(F.log2(n / F.lit(float(len(DB8) - 1)))), F.lit(1)).cast("int")


def cycle_subbands(psr_rows: DataFrame, keys: list[str], idx: str = "cycle_idx", wave: str = "wave_p", block: int = 4096) -> DataFrame:
    """db8 subbands of each channel along the cycle axis, phase by phase, down to the deepest sensible level."""
    return decompose(psr_rows, keys, idx, wave, max_level(F.col("total")), DB8[::-1], block)


def harmonic_estimate(psr_rows: DataFrame, keys: list[str], idx: str = "cycle_idx", wave: str = "wave_p", block: int = 4096) -> DataFrame:
    """Adds `estimate`: per phase, the lowest-band (db8, periodised, deepest
    level) reconstruction along the cycle axis."""
    low = cycle_subbands(psr_rows, keys, idx, wave, block).where("band = 'a'")
    est = reconstruct(low, keys, DB8[::-1], block)
    return psr_rows.join(est.select(*keys, F.col("i").alias(idx), F.col("v").alias("estimate")), [*keys, idx])


def split_energies(d: DataFrame, wave: str = "wave_p", estimate: str = "estimate") -> DataFrame:
    """Residual and the two energies per cycle; ratio NULL on no residual."""
    sq = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)
    d = d.withColumn("residual", F.zip_with(wave, estimate, lambda a, b: a - b))
    d = d.withColumn("detail_energy", sq(F.col("residual"))).withColumn("harmonic_energy", sq(F.col(estimate)))
    return d.withColumn("hi_ratio", F.when(F.col("detail_energy") > 1e-12, F.col("harmonic_energy") / F.col("detail_energy")))


def period_variability(d: DataFrame, keys: list[str], length: str = "len") -> DataFrame:
    m = exact_percentiles(d, keys, length, {"__m": 0.5}).select(*keys, "__m")
    return d.join(m, keys).withColumn("period_variability", F.abs(F.col(length) - F.col("__m")) / F.col("__m")).drop("__m")


def waveform_asymmetry(wave: Column) -> tuple[Column, Column]:
    """(rise/decay time ratio, peak/trough sharpness ratio); the first maximum
    and minimum win, sharpness differences are clipped at the ends."""
    n = F.size(wave)
    pk, tr = F.array_position(wave, F.array_max(wave)), F.array_position(wave, F.array_min(wave))   # 1-based
    rise = F.greatest(pk - 1, F.lit(1)).cast("double")
    decay = (n - (pk - 1)).cast("double")
    at = lambda i: F.element_at(wave, i.cast("int"))
    sharp = lambda i: F.abs(at(F.least(i + 1, n.cast("bigint"))) - at(F.greatest(i - 1, F.lit(1))))
    return rise / decay, F.when(sharp(tr) > 1e-12, sharp(pk) / sharp(tr))


FAMILIES = ["harmonic_to_interharmonic_ratio", "cycle_to_cycle_variability", "period_variability", "rise_decay_ratio", "peak_trough_sharpness_ratio"]


def cycle_features(psr_rows: DataFrame, stats: DataFrame, keys: list[str], n_harmonics: int = 5, block: int = 4096) -> DataFrame:
    """All per-cycle features, one row per cycle; the harmonic nearest mains is
    NULL by design."""
    d = dense_index(psr_rows, keys, F.col("start_i"), "start_i", name="cycle_idx").drop("cycle_idx_n")
    d = cut_lineage(d, "psr")
    d = split_energies(harmonic_estimate(d, keys, block=block))
    d = d.withColumn("profile", harmonic_profile(F.col("wave_p"), n_harmonics))
    rd, pt = waveform_asymmetry(F.col("wave"))
    excl = stats.select(*keys, fm.nearest_harmonic(F.lit(1.0) / F.col("median_period_s"), n_harmonics).alias("excluded_harmonic_index"))
    d = period_variability(d, keys).join(excl, keys)
    return d.select(*keys, "start_i", "excluded_harmonic_index",
                    *[F.when(F.col("excluded_harmonic_index") != h, F.col("profile")[h - 1]).alias(f"harmonic_amplitude_profile_h{h}") for h in range(2, n_harmonics + 1)],
                    F.col("hi_ratio").alias(FAMILIES[0]), F.col("detail_energy").alias(FAMILIES[1]), FAMILIES[2],
                    rd.alias(FAMILIES[3]), pt.alias(FAMILIES[4]))


def subject_features(feat: DataFrame, stats: DataFrame, rec: list[str], channel: str, n_sub: int = 200, seed: int = 20260809,
                     n_harmonics: int = 5) -> tuple[DataFrame, DataFrame]:
    """(wide feature rows, per-subject status). Channels below the cycle floor
    are dropped; a subject with a kept channel of too short cycles (no rows in
    `feat`), losing more than half of its channels, or whose kept channel lacks
    values of a metric, is excluded with a reason and the job goes on."""
    ch = stats.withColumn("dropped", F.col("n_valid") < n_sub)
    names = [*[f"harmonic_amplitude_profile_h{h}" for h in range(2, n_harmonics + 1)], *FAMILIES]
    kept = feat.join(ch.where("not dropped").select(*rec, channel), [*rec, channel], "left_semi")
    long = kept.select(*rec, channel, "start_i", "excluded_harmonic_index", F.explode(record_array(["metric", "value"], *[(n, F.col(n)) for n in names])).alias("m")).select(
        *rec, channel, "start_i", "excluded_harmonic_index", "m.metric", "m.value")
    long = cut_lineage(long, "cycle-features")
    by_design = F.col("metric") == F.concat(F.lit("harmonic_amplitude_profile_h"), F.col("excluded_harmonic_index").cast("string"))
    short = (long.groupBy(*rec, channel, "metric").agg(F.count("value").alias("n"), F.bool_or(by_design).alias("design"))
             .where((F.col("n") < n_sub) & ~F.col("design")).groupBy(*rec).agg(F.count(F.lit(1)).alias("n_short")))
    coarse = ch.where("not dropped").select(*rec, channel).join(feat.select(*rec, channel).distinct(), [*rec, channel], "left_anti").groupBy(*rec).agg(F.count(F.lit(1)).alias("n_coarse"))
    excl = long.select(*rec, channel, "excluded_harmonic_index").distinct()
    st = ch.groupBy(*rec).agg(F.count(F.lit(1)).alias("n_channels"), F.count_if("dropped").alias("n_dropped"),
                              F.array_join(F.array_sort(F.collect_list(F.when(F.col("dropped"), F.col(channel).cast("string")))), ",").alias("dropped_channels"))
    st = st.join(short, rec, "left").join(coarse, rec, "left").join(modal_value(excl, rec, "excluded_harmonic_index").select(*rec, F.col("mode").alias("excluded_harmonic_index")), rec, "left")
    reason = (F.when(F.col("n_coarse") > 0, "modal cycle length of a channel too short")
              .when(F.col("n_dropped") > F.col("n_channels") / 2, "too few channels with enough valid cycles")
              .when(F.col("n_short") > 0, "too few defined values of a metric"))
    st = st.select(*rec, "excluded_harmonic_index", "dropped_channels", (F.col("n_channels") - F.col("n_dropped")).alias("n_roi_channels_used"), reason.alias("excluded_reason"))
    s = fixed_count_summary(long, [*rec, channel, "metric"], "start_i", "value", n_sub, seed, strict=False)
    agg = across_channels(s, [*rec, "metric"])
    wide = agg.groupBy(*rec).agg(*[F.max(F.when(F.col("metric") == n, F.col(k))).alias(f"{n}_{k}") for n in names for k in ("median", "iqr")])
    return wide.join(st.where("excluded_reason is null").select(*rec), rec, "left_semi"), st


def channel_features(feat: DataFrame, stats: DataFrame, keys: list[str], n_sub: int, seed: int = 20260809) -> DataFrame:
    """Per-channel medians of every family; channels under the floor keep their
    statistics with NULL features."""
    names = [c for c in feat.columns if c not in (*keys, "start_i", "excluded_harmonic_index")]
    long = feat.select(*keys, "start_i", F.explode(record_array(["metric", "value"], *[(n, F.col(n)) for n in names])).alias("m")).select(*keys, "start_i", "m.*")
    s = fixed_count_summary(long, [*keys, "metric"], "start_i", "value", n_sub, seed, strict=False)
    wide = s.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == n, F.col("median"))).alias(n) for n in names])
    return stats.join(wide, keys, "left")
