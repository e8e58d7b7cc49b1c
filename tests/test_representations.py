"""Connectivity, shrunk covariance, tangent space and spectral parametrisation."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortwave.operators import montage as mo, parametric as pa

SF, SEG = 128.0, 64


def signals(spark, recs: dict, block=64):
    """recs: {rec: {channel: samples}}"""
    rows = [(r, c, i // block, [float(v) for v in x[i:i + block]]) for r, m in recs.items() for c, x in m.items() for i in range(0, len(x), block)]
    return spark.createDataFrame(rows, "rec int, channel string, block_id long, samples array<double>").repartition(5)


def windows(x, seg=SEG, step=SEG // 2):
    return np.stack([x[i:i + seg] for i in range(0, len(x) - seg + 1, step)])


def test_connectivity_equals_plain_cross_spectra(spark):
    rng = np.random.default_rng(1)
    recs = {r: {f"c{i}": rng.normal(size=64 * n + extra) for i in range(4)} for r, n, extra in ((1, 6, 0), (2, 9, 10))}
    recs[2]["c3"] = recs[2]["c3"][:256]                       # ends early
    recs[3] = {"c0": np.zeros(256), "c1": rng.normal(size=256)}  # silent
    recs[4] = {"c0": rng.normal(size=40), "c1": rng.normal(size=40)}  # no full window
    got = {(r.rec, r.c1, r.c2): r for r in mo.connectivity(signals(spark, recs), ["rec"], "channel", 64, SF, SEG).collect()}
    w = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(SEG) / SEG)
    f = np.fft.rfftfreq(SEG, 1 / SF)
    band = (f >= 8) & (f < 13)
    for r in (1, 2):
        spec = {c: np.fft.rfft((windows(x) - windows(x).mean(axis=1, keepdims=True)) * w)[:, band] for c, x in recs[r].items()}
        for a in spec:
            for b in spec:
                if a < b:
                    n = min(len(spec[a]), len(spec[b]))
                    x, y = spec[a][:n], spec[b][:n]
                    cross = x * y.conj()
                    im = np.abs(cross.sum(0).imag) / np.sqrt((abs(x) ** 2).sum(0) * (abs(y) ** 2).sum(0))
                    row = got[r, a, b]
                    assert row.n_windows == n
                    assert row.imag_coherence == pytest.approx(im.mean(), abs=1e-9)
                    assert row.phase_lag_index == pytest.approx(np.abs(np.sign(cross.imag).mean(0)).mean(), abs=1e-9)
    assert got[3, "c0", "c1"].imag_coherence is None and got[3, "c0", "c1"].phase_lag_index is None
    assert not any(k[0] == 4 for k in got) and len(got) == 13


def test_connectivity_ignores_what_has_no_lag(spark):
    rng = np.random.default_rng(2)
    t = np.arange(128 * 60) / SF
    wave, noise = np.sin(2 * np.pi * 10 * t), lambda: 0.3 * rng.normal(size=len(t))
    copy = wave + noise()
    recs = {1: {"a": copy, "b": 2 * copy, "late": np.sin(2 * np.pi * 10 * t - np.pi / 2) + noise()}}
    got = {(r.c1, r.c2): r for r in mo.connectivity(signals(spark, recs), ["rec"], "channel", 64, SF, SEG).collect()}
    assert got["a", "b"].imag_coherence < 1e-9 and got["a", "b"].phase_lag_index == 0
    assert got["a", "late"].imag_coherence > .4 and got["a", "late"].phase_lag_index > .9


def plain_shrunk(x):
    x = x - x.mean(axis=1, keepdims=True)
    p, n = x.shape
    s = x @ x.T / n
    mu, norm = np.trace(s) / p, (s * s).sum()
    away = (norm - p * mu * mu) / p
    noise = min(sum(((np.outer(v, v) - s) ** 2).sum() for v in x.T) / (n * n * p), away)
    w = noise / away if away > 0 else 0
    return w, (1 - w) * s + w * mu * np.eye(p)


def test_shrunk_covariance(spark):
    rng = np.random.default_rng(3)
    recs = {r: {c: rng.normal(size=n) * (i + 1) + 5 * r for i, c in enumerate("abc")} for r, n in ((1, 40), (2, 300), (3, 64))}
    recs[4] = {"a": rng.normal(size=64), "b": rng.normal(size=64)}          # a channel is missing
    recs[5] = {c: [float(i)] for i, c in enumerate("abc")}                  # one sample
    for c in "abc":
        recs[2][c + "x"] = rng.normal(size=300)                             # not asked for
    got = {r.rec: r for r in mo.shrunk_covariance(signals(spark, recs), ["rec"], "channel", ["c", "a", "b"]).collect()}
    assert set(got) == {1, 2, 3}
    for r in got:
        x = np.stack([recs[r][c] for c in "cab"])
        w, cov = plain_shrunk(x)
        assert got[r].n == x.shape[1] and got[r].shrinkage == pytest.approx(w, abs=1e-9) and 0 < w < 1
        assert np.allclose(np.array(got[r].cov).reshape(3, 3), cov, atol=1e-8)


def spd(rng, p, n):
    a = rng.normal(size=(n, p, 2 * p))
    return a @ a.transpose(0, 2, 1) / (2 * p)


def cov_table(spark, covs, folds=None):
    rows = [(i, int(folds[i]) if folds is not None else 0, c.ravel().tolist()) for i, c in enumerate(covs)]
    return spark.createDataFrame(rows, "rec int, fold int, cov array<double>").repartition(4)


def test_geometric_mean_is_the_fixed_point_and_affine_invariant(spark):
    rng = np.random.default_rng(4)
    covs = spd(rng, 4, 30)
    mean = mo.geometric_means(cov_table(spark, covs))[0]
    assert np.abs(mo._between(covs, mean).mean(axis=0)).max() < 1e-8
    a = rng.normal(size=(4, 4))
    moved = a @ covs @ a.T
    mean2 = mo.geometric_means(cov_table(spark, moved))[0]
    assert np.allclose(mean2, a @ mean @ a.T, rtol=1e-6)
    x, y = (mo.tangent_coordinates(cov_table(spark, c), ["rec"], {0: m}).collect() for c, m in ((covs, mean), (moved, mean2)))
    norms = lambda rows: np.array([np.linalg.norm(r.coordinates) for r in sorted(rows, key=lambda r: r.rec)])
    assert np.allclose(norms(x), norms(y), rtol=1e-6)
    # two matrices: the midpoint of the line between them
    half = mo.geometric_means(cov_table(spark, covs[:2]))[0]
    root = mo._power(covs[0], np.sqrt)
    inv = np.linalg.inv(root)
    assert np.allclose(half, root @ mo._power(inv @ covs[1] @ inv, np.sqrt) @ root, rtol=1e-7)


def test_means_see_their_training_rows_only(spark):
    rng = np.random.default_rng(5)
    covs, folds = spd(rng, 3, 24), np.arange(24) % 3
    means = mo.geometric_means(cov_table(spark, covs, folds), "fold", [0, 1, 2])
    changed = covs.copy()
    changed[folds == 1] *= 50
    again = mo.geometric_means(cov_table(spark, changed, folds), "fold", [0, 1, 2])
    assert np.allclose(means[1], again[1], rtol=1e-9) and not np.allclose(means[0], again[0], rtol=1e-2)
    alone = mo.geometric_means(cov_table(spark, covs[folds != 2]))[0]
    assert np.allclose(means[2], alone, rtol=1e-7)
    rows = mo.tangent_coordinates(cov_table(spark, covs, folds), ["rec"], means, "fold").collect()
    assert len(rows) == 72 and all(r.held_out == (r.rec % 3 == r.model) for r in rows)
    with pytest.raises(ValueError):
        mo.geometric_means(cov_table(spark, covs[folds == 0], folds[folds == 0]), "fold", [0, 1])
    with pytest.raises(ArithmeticError):
        mo.geometric_means(cov_table(spark, covs), max_steps=1)


def test_identity_has_zero_coordinates(spark):
    c = np.diag([1.0, 2.0])
    r = mo.tangent_coordinates(cov_table(spark, c[None]), ["rec"], {0: c}).first()
    assert np.allclose(r.coordinates, 0, atol=1e-12)
    r = mo.tangent_coordinates(cov_table(spark, (np.e ** 2 * c)[None]), ["rec"], {0: c}).first()
    assert np.allclose(r.coordinates, [2, 0, 2], atol=1e-9)


FREQ = np.arange(2, 91) / 2


def planted(offset, exponent, peaks, noise=0.0, seed=0):
    y = offset - exponent * np.log10(FREQ) + noise * np.random.default_rng(seed).normal(size=len(FREQ))
    for c, h, sd in peaks:
        y = y + h * np.exp(-((FREQ - c) / sd) ** 2 / 2)
    return 10 ** y


def test_planted_spectra_are_recovered(spark):
    cases = {0: (1.0, 1.5, []), 1: (0.3, 0.8, [(10.0, 1.0, 1.2)]), 2: (2.0, 2.0, [(10.3, 0.8, 1.0), (22.0, 0.5, 2.0)]), 3: (0.0, 1.0, [(6.0, .6, 1.0), (11.0, .9, 1.1), (30.0, .4, 3.0)])}
    rows = [(k, float(f), float(p)) for k, c in cases.items() for f, p in zip(FREQ, planted(*c, noise=.01, seed=k))]
    rows += [(9, 1.0, 1.0), (9, 2.0, .5)]
    got = {r.key: r for r in pa.periodic_fit(spark.createDataFrame(rows, "key int, f double, p double").repartition(3), ["key"]).collect()}
    for k, (offset, exponent, peaks) in cases.items():
        r = got[k]
        assert r.aperiodic_offset == pytest.approx(offset, abs=.06) and r.aperiodic_exponent == pytest.approx(exponent, abs=.06) and r.r2 > .98
        assert len(r.peaks) == len(peaks)
        for p, (c, h, sd) in zip(r.peaks, peaks):
            assert p.frequency == pytest.approx(c, abs=.3) and p.height == pytest.approx(h, abs=.08) and p.bandwidth == pytest.approx(2 * sd, rel=.3)
    assert got[9].aperiodic_offset is None and got[9].peaks is None


def test_fits_do_not_depend_on_the_batch(spark):
    rng = np.random.default_rng(8)
    ps = np.stack([planted(rng.normal(), 1 + rng.random(), [(8 + 4 * rng.random(), .5 + rng.random(), 1 + rng.random())], .05, i) for i in range(40)])
    how = (0.5, 4, 0.1, 2.0, (1.0, 12.0))
    whole, alone = pa.parametrize(FREQ, ps, *how), [pa.parametrize(FREQ, p[None], *how) for p in ps]
    for c in ("aperiodic_offset", "aperiodic_exponent", "r2", "peaks"):
        assert np.allclose(whole[c], np.concatenate([a[c] for a in alone]), atol=1e-7)
    none = pa.parametrize(FREQ, ps[:3], 0.5, 0, 0.1, 2.0, (1.0, 12.0))
    assert none["peaks"].shape == (3, 0, 3)


def test_strongest_peak(spark):
    df = spark.createDataFrame([(1, [(9.0, .5, 2.0), (12.0, .9, 1.0), (20.0, 2.0, 1.0)]), (2, [(3.0, 1.0, 1.0)]), (3, None)], f"key int, peaks {pa.PEAK}")
    got = {r.key: r for r in pa.strongest_peak(df, ["key"], 7, 14).collect()}
    assert (got[1].peak_frequency, got[1].peak_height, got[1].peak_bandwidth) == (12.0, .9, 1.0)
    assert got[2].peak_frequency is None and got[3].peak_frequency is None
