"""Power spectra and what is derived from them."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ..functions import text as tx
from ..functions.shape import record_array
from .aggregates import mean_and_iqr
from .signal import window_parts

# Band edges in Hz, half-open [lo, hi).
BANDS = {"delta": (1.0, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 45.0)}
TOTAL = (1.0, 45.0)


def segments(blocks: DataFrame, keys: list[str], block_len: int, seg: int, step: int) -> DataFrame:
    """Complete windows of `seg` samples every `step` samples. A group holds
    one window, never a recording."""
    p = window_parts(blocks, keys, block_len, seg, step)
    g = p.groupBy(*keys, "win_id").agg(F.array_sort(F.collect_list(F.struct("block_id", "part"))).alias("s"))
    return (g.select(*keys, "win_id", F.flatten(F.transform("s", lambda x: x.part)).alias("samples"))
            .where(F.size("samples") == seg))


def channel_mean_blocks(blocks: DataFrame, rec: list[str]) -> DataFrame:
    """Mean over channels of every sample (one signal per recording)."""
    g = blocks.groupBy(*rec, "block_id").agg(F.collect_list("samples").alias("a"))
    zero = F.transform(F.element_at("a", 1), lambda v: F.lit(0.0))
    total = F.aggregate("a", zero, lambda acc, x: F.zip_with(acc, x, lambda p, q: p + q.cast("double")))
    return g.select(*rec, "block_id", F.transform(total, lambda v: v / F.size("a")).alias("samples"))


def _hamming(n: int) -> np.ndarray:
    return 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / n)


def welch_power(samples: Column, sfreq: float) -> Column:
    """One-sided density of one mean-removed, Hamming-weighted segment."""
    @pandas_udf(T.ArrayType(T.DoubleType()))
    def psd(s: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(v, float) for v in s])
        n = x.shape[1]
        w = _hamming(n)
        p = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2 / (sfreq * (w ** 2).sum())
        p[:, 1:(-1 if n % 2 == 0 else None)] *= 2
        return pd.Series(list(p))
    return psd(samples)


def psd_long(segs: DataFrame, keys: list[str], power: Column, df_hz: float, fmin: float, fmax: float) -> DataFrame:
    """Mean power per (keys, f) over all windows: (keys, f, p). Windows are
    combined before the shuffle, so only one row per frequency and task moves."""
    d = segs.select(*keys, F.posexplode(power).alias("k", "p")).withColumn("f", F.col("k") * F.lit(float(df_hz)))
    d = d.where((F.col("f") >= fmin) & (F.col("f") <= fmax))
    return d.groupBy(*keys, "f").agg(F.avg("p").alias("p"))


def welch(blocks: DataFrame, keys: list[str], block_len: int, sfreq: float, seg: int, overlap: float, fmin: float, fmax: float) -> DataFrame:
    s = segments(blocks, keys, block_len, seg, int(round(seg * (1 - overlap))))
    return psd_long(s, keys, welch_power(F.col("samples"), sfreq), sfreq / seg, fmin, fmax)


def spectrum_arrays(psd: DataFrame, keys: list[str], f: str = "f", p: str = "p") -> DataFrame:
    """One sorted array<struct<f,p>> per key: a spectrum has a fixed length."""
    return psd.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(f).alias("f"), F.col(p).alias("p")))).alias("spectrum"))


def band_area(spectrum: Column, lo: float, hi: float) -> Column:
    """Trapezoid area over the points in [lo, hi); 0 when there are none."""
    inside = F.filter(spectrum, lambda x: (x.f >= lo) & (x.f < hi))
    pairs = F.zip_with(F.slice(inside, 1, F.greatest(F.size(inside) - 1, F.lit(0))),
                       F.slice(inside, 2, F.greatest(F.size(inside) - 1, F.lit(0))),
                       lambda a, b: (a.p + b.p) / 2 * (b.f - a.f))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def relative_bands(df: DataFrame, keep: list[str], prefix: str = "", spectrum: str = "spectrum") -> DataFrame:
    """Band areas as shares of the 1-45 Hz area (0 when that is 0)."""
    s = F.col(spectrum)
    d = df.select(*keep, *[band_area(s, *b).alias(f"__{n}") for n, b in BANDS.items()], band_area(s, *TOTAL).alias("__total"))
    return d.select(*keep, *[F.when(F.col("__total") > 0, F.col(f"__{n}") / F.col("__total")).otherwise(0.0).alias(f"{prefix}{n}") for n in BANDS])


def aperiodic(psd: DataFrame, keys: list[str], f: str = "f", p: str = "p") -> DataFrame:
    """Least-squares line of log10 power on log10 frequency, alpha left out."""
    x = F.col(f)
    d = psd.where(((x >= 1) & (x < 8)) | ((x >= 13) & (x <= 45)))
    lf, lp = F.log10(x), F.log10(F.greatest(F.col(p), F.lit(1e-20)))
    return d.groupBy(*keys).agg(F.regr_intercept(lp, lf).alias("aperiodic_offset"), F.regr_slope(lp, lf).alias("aperiodic_slope"))


def baseline_features(blocks: DataFrame, rec: list[str], channel: str, block_len: int, sfreq: float, seg: int,
                      prefix: str = "", peaks: DataFrame | None = None) -> DataFrame:
    """Seven columns per recording: shares from the channel-mean spectrum,
    aperiodic fit from the spectrum of the channel-mean signal."""
    per_channel = welch(blocks, [*rec, channel], block_len, sfreq, seg, 0.0, *TOTAL)
    mean_psd = per_channel.groupBy(*rec, "f").agg(F.avg("p").alias("p"))
    shares = relative_bands(spectrum_arrays(mean_psd, rec), rec, f"{prefix}band_power_")
    fit = aperiodic(welch(channel_mean_blocks(blocks, rec), rec, block_len, sfreq, seg, 0.0, *TOTAL), rec)
    out = shares.join(fit.select(*rec, *[F.col(c).alias(f"{prefix}{c}") for c in ("aperiodic_offset", "aperiodic_slope")]), rec)
    return out.join(peaks, rec, "left") if peaks is not None else out


def zone_features(blocks: DataFrame, rec: list[str], channel_name: Column, block_len: int, sfreq: float, seg: int) -> DataFrame:
    """The seven columns per anatomical zone."""
    z = blocks.withColumn("zone", tx.channel_zone(channel_name)).where("zone is not null")
    return baseline_features(z, [*rec, "zone"], "channel", block_len, sfreq, seg)


def peak_frequency(psd: DataFrame, keys: list[str], lo: float = 7.0, hi: float = 13.0, min_db: float = 3.0,
                   fit: tuple[float, float] = (2.0, 30.0)) -> DataFrame:
    """Peak of log power in [lo, hi] (lowest frequency on a tie) and its height
    over the 1/f line fitted outside the band."""
    inside = (F.col("f") >= lo) & (F.col("f") <= hi)
    base = ~inside & (F.col("f") >= fit[0]) & (F.col("f") <= fit[1])
    lf, lp = F.log10("f"), F.log10("p")
    only = lambda c, v: F.when(c, v)
    g = psd.groupBy(*keys).agg(
        F.min_by(F.struct("f", lp.alias("lp")), F.when(inside, F.struct(-lp, F.col("f")))).alias("pk"),
        F.regr_slope(only(base, lp), only(base, lf)).alias("slope"),
        F.regr_intercept(only(base, lp), only(base, lf)).alias("icept"), F.count_if(base).alias("nb"))
    f0 = F.col("pk.f")
    height = F.lit(10.0) * (F.col("pk.lp") - (F.col("slope") * F.log10(f0) + F.col("icept")))
    enough = F.col("nb") >= 5
    return g.select(*keys, F.when(enough, F.round(f0, 2)).otherwise(f0).alias("iaf_hz"),
                    F.when(enough, F.round(height, 2)).otherwise(F.lit(0.0)).alias("peak_height_db"),
                    F.coalesce(enough & (height >= min_db), F.lit(False)).alias("present"))


def line_noise_index(psd: DataFrame, keys: list[str], center: float = 50.0, half: float = 0.5,
                     sides: tuple = ((44.0, 46.0), (54.0, 56.0))) -> DataFrame:
    """Mean power around mains over mean power on both sides."""
    f = F.col("f")
    peak = (f >= center - half) & (f <= center + half)
    side = ((f >= sides[0][0]) & (f <= sides[0][1])) | ((f >= sides[1][0]) & (f <= sides[1][1]))
    g = psd.groupBy(*keys).agg(F.avg(F.when(peak, F.col("p"))).alias("a"), F.avg(F.when(side, F.col("p"))).alias("b"))
    return g.select(*keys, (F.col("a") / F.greatest("b", F.lit(1e-30))).alias("line_noise_index"))


def dpss_tapers(n: int, half_bandwidth: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading discrete prolate sequences and their concentration ratios; a
    constant of (n, bandwidth), so it is made once per job."""
    i = np.arange(n)
    w = half_bandwidth / n
    diag = ((n - 1 - 2 * i) / 2.0) ** 2 * np.cos(2 * np.pi * w)
    off = i[1:] * (n - i[1:]) / 2.0
    vec = np.linalg.eigh(np.diag(diag) + np.diag(off, 1) + np.diag(off, -1))[1][:, ::-1][:, :count].T
    for k, v in enumerate(vec):
        ref = v.sum() if k % 2 == 0 else v[np.argmax(np.abs(v) > 1e-7 * np.abs(v).max())]
        if ref < 0:
            vec[k] = -v
    m = 2 * np.sinc(2 * w * i) * w
    m[0] = 2 * w
    acf = np.array([np.correlate(v, v, "full")[n - 1:] for v in vec])
    ratios = acf[:, 0] * m[0] + 2 * (acf[:, 1:] * m[1:]).sum(axis=1)
    return vec, ratios


def multitaper_power(samples: Column, n: int, sfreq: float, bandwidth: float = 4.0) -> Column:
    """Eigenvalue-weighted multitaper power of equal-length segments, not
    divided by the sampling rate."""
    half = bandwidth * n / (2.0 * sfreq)
    count = max(1, int(2 * half))
    tapers, ratios = dpss_tapers(n, half, count)
    keep = ratios > 0.9
    if not keep.any():
        keep = ratios == ratios.max()
    tapers, weights = tapers[keep], np.sqrt(ratios[keep])

    @pandas_udf(T.ArrayType(T.DoubleType()))
    def psd(s: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(v, float) for v in s])
        x = x - x.mean(axis=1, keepdims=True)
        p = np.zeros((len(x), n // 2 + 1))
        for tp, wt in zip(tapers, weights):
            spec = np.fft.rfft(x * tp, axis=1)
            spec[:, 0] /= np.sqrt(2.0)
            if n % 2 == 0:
                spec[:, -1] /= np.sqrt(2.0)
            p += (wt * np.abs(spec)) ** 2
        return pd.Series(list(p * 2.0 / (weights ** 2).sum()))
    return psd(samples)


def tfa_features(segs: DataFrame, keys: list[str], n: int, sfreq: float, prefix: str = "") -> DataFrame:
    """Mean and IQR over windows of the relative band areas, and the aperiodic
    fit of the windows' mean spectrum. The spectra are computed once and both
    results read them."""
    from ..session import cut_lineage
    f = lambda k: k * F.lit(sfreq / n)
    pw = segs.select(*keys, "win_id", F.transform(multitaper_power(F.col("samples"), n, sfreq), lambda p, k: F.struct(f(k).alias("f"), p.alias("p"))).alias("s"))
    pw = cut_lineage(pw.select(*keys, "win_id", F.filter("s", lambda x: (x.f >= 1) & (x.f <= 45)).alias("spectrum")), "spectra")
    areas = relative_bands(pw, [*keys, "win_id"])
    long = areas.select(*keys, F.explode(record_array(["band", "v"], *[(b, F.col(b)) for b in BANDS])).alias("r")).select(*keys, "r.band", "r.v")
    st = mean_and_iqr(long, [*keys, "band"], "v")
    wide = st.groupBy(*keys).agg(*[F.max(F.when(F.col("band") == b, F.col(m))).alias(f"{prefix}tfa_{b}_{m}") for b in BANDS for m in ("mean", "iqr")])
    mean_psd = pw.select(*keys, F.explode("spectrum").alias("x")).groupBy(*keys, F.col("x.f").alias("f")).agg(F.avg("x.p").alias("p"))
    fit = aperiodic(mean_psd, keys).select(*keys, F.col("aperiodic_offset").alias(f"{prefix}tfa_aperiodic_offset"), F.col("aperiodic_slope").alias(f"{prefix}tfa_aperiodic_slope"))
    return wide.join(fit, keys, "left")


def windowed_tfa(blocks: DataFrame, rec: list[str], block_len: int, sfreq: float, window_s: float = 4.0, prefix: str = "") -> DataFrame:
    n = int(window_s * sfreq)
    return tfa_features(segments(channel_mean_blocks(blocks, rec), rec, block_len, n, n), rec, n, sfreq, prefix)


def epoch_tfa(epochs: DataFrame, rec: list[str], n: int, sfreq: float, prefix: str, epoch_id: str = "event_id") -> DataFrame:
    """Event-locked form: channels of an epoch are averaged first."""
    g = epochs.groupBy(*rec, F.col(epoch_id).alias("win_id")).agg(F.collect_list("samples").alias("a"))
    zero = F.transform(F.element_at("a", 1), lambda v: F.lit(0.0))
    total = F.aggregate("a", zero, lambda acc, x: F.zip_with(acc, x, lambda p, q: p + q.cast("double")))
    return tfa_features(g.select(*rec, "win_id", F.transform(total, lambda v: v / F.size("a")).alias("samples")), rec, n, sfreq, prefix)


def component_policy(probs: DataFrame, keys: list[str], artifact_classes: list[str], threshold: float = 0.8) -> DataFrame:
    """Per component: highest artifact-class probability, most probable class
    (first declared on a tie) and whether it is removed."""
    p_art = F.max(F.when(F.col("class").isin(artifact_classes), F.col("p")))
    g = probs.groupBy(*keys).agg(p_art.alias("p_artifact"), F.min_by("class", F.struct(-F.col("p"), F.col("class"))).alias("label"))
    return g.withColumn("excluded", F.coalesce(F.col("p_artifact") > threshold, F.lit(False)))


def component_fallback(corr: DataFrame, psd: DataFrame, keys: list[str], threshold: float = 0.8, muscle: float = 3.0) -> DataFrame:
    """Without class probabilities: strong correlation with a frontal channel,
    or high-frequency power well above low-frequency power."""
    r = corr.groupBy(*keys).agg(F.max(F.abs("r")).alias("eog_r"))
    lo, hi = F.avg(F.when(F.col("f") < 20, F.col("p"))), F.avg(F.when(F.col("f") >= 20, F.col("p")))
    m = psd.groupBy(*keys).agg(F.coalesce(hi / F.when(lo > 0, lo), F.lit(0.0)).alias("muscle_ratio"))
    j = r.join(m, keys)
    label = F.when(F.col("eog_r") > threshold, "eye blink").when(F.col("muscle_ratio") > muscle, "muscle artifact")
    return j.withColumn("label", label).withColumn("excluded", label.isNotNull())


def channel_covariance(blocks: DataFrame, rec: list[str], channel: str) -> DataFrame:
    """Covariance of every channel pair of a recording from the montage's pair sums."""
    from .montage import pair_sums
    n = F.col("n")
    return pair_sums(blocks, rec, channel).select(*rec, "c1", "c2", ((F.col("sxy") - F.col("sx") * F.col("sy") / n) / (n - 1)).alias("cov"))


def component_count(cov: DataFrame, rec: list[str], share: float | int = 0.99) -> DataFrame:
    """Smallest number of principal components reaching the variance share (an
    integer is a fixed count). The group is one channel-by-channel matrix."""
    schema = cov.select(*rec).schema.add("n_components", T.IntegerType()).add("n_channels", T.IntegerType())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["c1"]) | set(pdf["c2"]))
        at = {c: i for i, c in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        for a, b, v in zip(pdf["c1"], pdf["c2"], pdf["cov"]):
            m[at[a], at[b]] = m[at[b], at[a]] = v
        ev = np.clip(np.linalg.eigvalsh(m)[::-1], 0, None)
        if isinstance(share, float):
            k = int(np.searchsorted(np.cumsum(ev) / max(ev.sum(), 1e-300), share - 1e-12) + 1)
        else:
            k = int(share)
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in rec}, "n_components": min(k, len(names)), "n_channels": len(names)}])

    return cov.groupBy(*rec).applyInPandas(run, schema)
