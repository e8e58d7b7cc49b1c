"""Spectra as a line and peaks: batched fits, one call per batch of spectra."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .spectral import spectrum_arrays

PEAK = "array<struct<frequency: double, height: double, bandwidth: double>>"


def line(x: np.ndarray, y: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offset and slope of each row of y on x over the points in `use`."""
    n = use.sum(axis=1)
    mx, my = (x * use).sum(axis=1) / n, (y * use).sum(axis=1) / n
    dx = (x - mx[:, None]) * use
    slope = (dx * (y - my[:, None])).sum(axis=1) / (dx * dx).sum(axis=1)
    return my - slope * mx, slope


def robust_line(x: np.ndarray, y: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """A line through all points, then through those at or below the `share` quantile of what stands out of it: peaks
    only ever add power, so the lowest points are the background."""
    a, b = line(x, y, np.ones_like(y))
    over = np.maximum(y - (a[:, None] + b[:, None] * x), 0)
    return line(x, y, (over <= np.quantile(over, share, axis=1, keepdims=True)).astype(float))


def _bells(f: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Sum of bells (centre, height, sd) per spectrum; a height of 0 is no bell."""
    z = (f - peaks[:, :, 0, None]) / peaks[:, :, 2, None]
    return (peaks[:, :, 1, None] * np.exp(-z * z / 2)).sum(axis=1)


def _widths(f: np.ndarray, flat: np.ndarray, at: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Standard deviation of each row's peak at index `at`, from the nearer point of half its height (interpolated)."""
    m, n = flat.shape
    rows = np.arange(m)
    half = flat[rows, at] / 2
    reach = np.full(m, np.inf)
    for step in (1, -1):
        found = np.zeros(m, bool)
        for d in range(1, n):
            i = at + step * d
            ok = (i >= 0) & (i < n) & ~found
            i = np.clip(i, 0, n - 1)
            hit = ok & (flat[rows, i] <= half)
            before = flat[rows, np.clip(i - step, 0, n - 1)]
            part = (before - half) / np.where(hit, before - flat[rows, i], 1)
            there = np.abs(f[np.clip(i - step, 0, n - 1)] + part * (f[i] - f[np.clip(i - step, 0, n - 1)]) - f[at])
            reach = np.where(hit, np.minimum(reach, there), reach)
            found |= hit
            if found.all():
                break
    return np.clip(np.where(np.isfinite(reach), reach, hi * 1.1774) / 1.1774, lo, hi)


def refine(f: np.ndarray, flat: np.ndarray, peaks: np.ndarray, lo: float, hi: float, rounds: int = 8) -> np.ndarray:
    """Gauss-Newton steps of all bells of a spectrum together, kept where they lower the residual."""
    m, k, _ = peaks.shape
    live = peaks[:, :, 1] > 0
    err = ((flat - _bells(f, peaks)) ** 2).sum(axis=1)
    damp = np.full(m, 1e-3)
    for _ in range(rounds):
        z = (f - peaks[:, :, 0, None]) / peaks[:, :, 2, None]
        e = np.exp(-z * z / 2)
        jac = np.stack([peaks[:, :, 1, None] * e * z / peaks[:, :, 2, None], e, peaks[:, :, 1, None] * e * z * z / peaks[:, :, 2, None]], axis=2)
        jac = (jac * live[:, :, None, None]).reshape(m, 3 * k, -1)
        gram = jac @ jac.transpose(0, 2, 1)
        diag = np.einsum("kii->ki", gram)
        gram = gram + np.eye(3 * k) * (diag * damp[:, None] + (diag == 0))[:, None, :]
        step = np.linalg.solve(gram, (jac @ (flat - _bells(f, peaks))[:, :, None]))[:, :, 0].reshape(m, k, 3)
        new = peaks + step * live[:, :, None]
        new[:, :, 0] = np.clip(new[:, :, 0], f[0], f[-1])
        new[:, :, 1] = np.where(live, np.maximum(new[:, :, 1], 1e-12), 0)
        new[:, :, 2] = np.clip(new[:, :, 2], lo, hi)
        less = ((flat - _bells(f, new)) ** 2).sum(axis=1)
        good = less < err
        peaks = np.where(good[:, None, None], new, peaks)
        err, damp = np.where(good, less, err), np.where(good, damp / 3, damp * 10)
    return peaks


def parametrize(f: np.ndarray, p: np.ndarray, share: float, max_peaks: int, least_height: float, least_sd: float, width: tuple[float, float]) -> dict:
    """Spectra (rows of p) to offset, exponent, peaks (centre, height, sd), r2; heights are in log10 of power."""
    y, x = np.log10(np.maximum(p, 1e-20)), np.log10(f)
    m = len(y)
    a, b = robust_line(x, y, share)
    flat = y - (a[:, None] + b[:, None] * x)
    rest, peaks, active = flat, np.tile([1.0, 0.0, 1.0], (m, max_peaks, 1)), np.ones(m, bool)
    rows = np.arange(m)
    lo, hi = width[0] / 2, width[1] / 2
    for k in range(max_peaks):
        at = rest.argmax(axis=1)
        top = rest[rows, at]
        active &= (top > least_height) & (top > least_sd * rest.std(axis=1))
        if not active.any():
            break
        bell = np.stack([f[at], top, _widths(f, rest, at, lo, hi)], axis=1)
        peaks[active, k] = bell[active]
        # all peaks so far together, so that a wrong first guess of one leaves no bump for the next
        peaks[active] = refine(f, flat[active], peaks[active], lo, hi)
        rest = flat - _bells(f, peaks)
    low = (peaks[:, :, 1] > 0) & (peaks[:, :, 1] < least_height)
    if (again := low.any(axis=1)).any():
        peaks[low] = [1.0, 0.0, 1.0]
        peaks[again] = refine(f, flat[again], peaks[again], lo, hi)
    a, b = line(x, y - _bells(f, peaks), np.ones_like(y))
    model = a[:, None] + b[:, None] * x + _bells(f, peaks)
    total = ((y - y.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)
    r2 = 1 - ((y - model) ** 2).sum(axis=1) / np.where(total > 0, total, 1)
    return {"aperiodic_offset": a, "aperiodic_exponent": -b, "r2": np.where(total > 0, r2, 1.0), "peaks": peaks}


def periodic_fit(psd: DataFrame, keys: list[str], f: str = "f", p: str = "p", fit: tuple[float, float] = (1.0, 45.0), share: float = 0.5,
                 max_peaks: int = 6, least_height: float = 0.1, least_sd: float = 2.0, width: tuple[float, float] = (1.0, 12.0)) -> DataFrame:
    """Per key: aperiodic offset and exponent, the periodic peaks over them (frequency, height in log10 of power,
    bandwidth of two standard deviations; by frequency) and r2 of the whole. A spectrum is one bounded array, and all
    spectra of a batch with equal frequencies are fitted as one stack. Spectra of fewer than five frequencies give NULLs."""
    s = spectrum_arrays(psd.where((F.col(f) >= max(fit[0], 1e-9)) & (F.col(f) <= fit[1])), keys, f, p)
    s = s.select(*keys, F.transform("spectrum", lambda x: x["f"]).alias("fs"), F.transform("spectrum", lambda x: x["p"]).alias("ps"))
    schema = T.StructType([*s.select(*keys).schema, *T.StructType.fromDDL(f"aperiodic_offset double, aperiodic_exponent double, r2 double, peaks {PEAK}")])

    def run(parts):
        for pdf in parts:
            grids: dict[bytes, list[int]] = {}
            for i, fs in enumerate(pdf["fs"]):
                grids.setdefault(np.asarray(fs, float).tobytes(), []).append(i)
            for grid, rows in grids.items():
                freq, out = np.frombuffer(grid), pdf.iloc[rows][keys].copy()
                if len(freq) < 5:
                    yield out.assign(aperiodic_offset=np.nan, aperiodic_exponent=np.nan, r2=np.nan, peaks=None)
                    continue
                r = parametrize(freq, np.stack([np.asarray(x, float) for x in pdf["ps"].iloc[rows]]), share, max_peaks, least_height, least_sd, width)
                found = [[{"frequency": c, "height": h, "bandwidth": 2 * w} for c, h, w in sorted(x.tolist()) if h > 0] for x in r.pop("peaks")]
                yield out.assign(**r, peaks=found)

    out = s.mapInPandas(run, schema)
    num = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select(*keys, *[num(c) for c in ("aperiodic_offset", "aperiodic_exponent", "r2")], "peaks")


def strongest_peak(fits: DataFrame, keys: list[str], lo: float, hi: float) -> DataFrame:
    """The highest peak in [lo, hi) of each fit (lowest frequency on a tie); NULLs where there is none."""
    inside = F.filter("peaks", lambda x: (x["frequency"] >= lo) & (x["frequency"] < hi))
    best = F.try_element_at(F.array_sort(F.transform(inside, lambda x: F.struct((-x["height"]).alias("h"), x["frequency"].alias("frequency"), x["bandwidth"].alias("bandwidth")))), F.lit(1))
    return fits.withColumn("b", best).select(*keys, F.col("b.frequency").alias("peak_frequency"), (-F.col("b.h")).alias("peak_height"), F.col("b.bandwidth").alias("peak_bandwidth"))
