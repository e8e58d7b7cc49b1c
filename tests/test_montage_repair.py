"""Spherical splines, polyphase resampling and the montage's pair sums."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwave.operators import resampling as rs, signal as sg, splines as sl


def signals(spark, recs: dict, block=64):
    rows = [(r, c, i // block, [float(v) for v in x[i:i + block]]) for r, m in recs.items() for c, x in m.items() for i in range(0, len(x), block)]
    return spark.createDataFrame(rows, "rec int, channel string, block_id long, samples array<double>").repartition(5)


def joined(df, *cols):
    """Samples per (cols) in the order of blocks."""
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.block_id):
        out.setdefault(tuple(r[c] for c in cols), []).append(np.asarray([np.nan if v is None else v for v in r.samples], float) if r.samples is not None else None)
    return {k: None if any(x is None for x in v) else np.concatenate(v) for k, v in out.items()}


def sphere(n, seed):
    x = np.random.default_rng(seed).normal(size=(n, 3))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_kernel_is_the_legendre_series():
    x = np.linspace(-1, 1, 7)
    p = [np.ones_like(x), x]
    for n in range(1, 50):
        p.append(((2 * n + 1) * x * p[n] - n * p[n - 1]) / (n + 1))
    want = sum((2 * n + 1) / (n * (n + 1)) ** 4 * p[n] for n in range(1, 51)) / (4 * np.pi)
    assert np.allclose(sl.kernel(x), want, atol=1e-14)


def test_splines_keep_their_own_fields():
    pos, bad = sphere(20, 1), np.arange(20) % 5 == 0
    w = sl.spline_matrix(pos * 9.5, bad, smooth=0.0)
    assert w.shape == (4, 16) and np.allclose(w.sum(axis=1), 1)
    weights = np.random.default_rng(2).normal(size=16)
    weights -= weights.mean()                                   # a spline has coefficients that add to zero
    field = sl.kernel(np.clip(pos @ pos[~bad].T, -1, 1)) @ weights + 3.0
    assert np.allclose(w @ field[~bad], field[bad], atol=1e-7)
    smooth = pos @ np.array([.5, -.2, .8]) + .3 * pos[:, 0] * pos[:, 1]
    assert np.abs(sl.spline_matrix(pos, bad) @ smooth[~bad] - smooth[bad]).max() < .25 * np.ptp(smooth)


@pytest.mark.parametrize("shared", [True, False])
def test_repair_in_blocks(spark, shared):
    names = [f"c{i}" for i in range(9)]
    rng = np.random.default_rng(3)
    recs = {r: {c: rng.normal(size=150) for c in names} for r in (1, 2, 3, 4, 5)}
    recs[4]["c1"] = recs[4]["c1"][:64]                                   # a good channel ends early
    bads = {1: ["c0", "c5"], 2: ["c0", "c5"], 3: [], 4: ["c2"], 5: names}
    pos = {r: sphere(9, 7 if shared else r) for r in recs}
    flags = spark.createDataFrame([(r, c, c in b) for r, b in bads.items() for c in names], "rec int, channel string, bad boolean")
    place = [(r, c, *map(float, p)) for r in recs for c, p in zip(names, pos[r])]
    place = spark.createDataFrame(place, "rec int, channel string, x double, y double, z double")
    place = place.where("rec = 1").drop("rec") if shared else place
    assert sl.spline_weights(flags, place, ["rec"], "channel").count() == 4
    d = sl.spline_repair(signals(spark, recs), flags, place, ["rec"], "channel")
    got = joined(d, "rec", "channel")
    assert {(r.rec, r.channel) for r in d.where("repaired").collect()} == {(r, c) for r, b in bads.items() for c in b}
    for r, m in recs.items():
        bad = np.array([c in bads[r] for c in names])
        x = np.stack([m[c][:64] for c in names])
        for c in names:
            if c not in bads[r]:
                assert np.allclose(got[r, c], m[c])
            elif r in (4, 5):
                assert got[r, c] is None
            else:
                w = sl.spline_matrix(pos[r], bad)[bads[r].index(c)]
                assert np.allclose(got[r, c], w @ np.stack([m[k] for k in names if k not in bads[r]]))
    early = d.where("rec = 4 and channel = 'c2' and block_id = 0").first()
    w = sl.spline_matrix(pos[4], np.array([c == "c2" for c in names]))[0]
    assert np.allclose(early.samples, w @ np.stack([recs[4][c][:64] for c in names if c != "c2"]))


def test_reference_after_spline_repair(spark):
    names = [f"c{i}" for i in range(6)]
    recs = {1: {c: np.random.default_rng(i).normal(size=128) for i, c in enumerate(names)}}
    flags = spark.createDataFrame([(1, c, c == "c3") for c in names], "rec int, channel string, bad boolean")
    place = spark.createDataFrame([(c, *map(float, p)) for c, p in zip(names, sphere(6, 1))], "channel string, x double, y double, z double")
    got = joined(sg.reference_and_repair(signals(spark, recs), flags, None, ["rec"], "channel", positions=place), "channel")
    assert np.allclose(sum(got.values()), 0, atol=1e-9)


def plain_resample(x, sf, target, factor=0.8):
    up, down, taps = rs.bank(sf, target, factor)
    half = taps.shape[1] // 2 - 1
    z = np.concatenate([sg.reflected(x, half), x, sg.reflected(x[::-1], half + 1)[::-1]])
    m = np.arange(-(-len(x) * up // down))
    return np.array([z[(k * down) // up:][: taps.shape[1]] @ taps[k * down % up] for k in m])


@pytest.mark.parametrize("sf, target, n", [(500, 200, 1203), (1000, 300, 1500), (128, 96, 257), (100, 250, 90), (500, 250, 300)])
def test_any_block_length_gives_the_unblocked_result(spark, sf, target, n):
    x = np.random.default_rng(n).normal(size=n)
    want = plain_resample(x, sf, target)
    for block in (30, 64, 500, 5000):
        d = rs.resample_to(signals(spark, {1: {"a": x}}, block), ["rec", "channel"], block, sf, target, out_len=50)
        got = joined(d, "channel")["a",]
        assert len(got) == len(want) and np.allclose(got, want, atol=1e-9)
        sizes = {r.block_id: len(r.samples) for r in d.collect()}
        assert all(s == 50 for b, s in sizes.items() if b < max(sizes))


def test_tones_keep_their_place(spark):
    t = np.arange(4000) / 500
    x = np.sin(2 * np.pi * 11 * t + .4) + np.sin(2 * np.pi * 130 * t)      # the second is above the new limit
    got = joined(sg.resample(signals(spark, {1: {"a": x}}, 200), ["rec", "channel"], 200, 500.0, 200.0), "channel")["a",]
    want = np.sin(2 * np.pi * 11 * np.arange(1600) / 200 + .4)
    assert len(got) == 1600 and np.abs(got - want)[100:-100].max() < .01
    with pytest.raises(ValueError):
        rs.bank(500.0, 123.4567891)


def test_pair_sums_over_blocks_that_hold_both(spark):
    from cohortwave.operators.montage import pair_sums
    from cohortwave.operators.spectral import channel_covariance, component_count
    rng = np.random.default_rng(5)
    recs = {1: {"a": rng.normal(size=150), "b": rng.normal(size=150), "c": rng.normal(size=64)}}
    got = {(r.c1, r.c2): r for r in pair_sums(signals(spark, recs), ["rec"], "channel").collect()}
    for (a, b), r in got.items():
        n = min(len(recs[1][a]), len(recs[1][b]))
        x, y = recs[1][a][:n], recs[1][b][:n]
        assert (r.n, r.sxy) == (n, pytest.approx(x @ y)) and r.sx == pytest.approx(x.sum()) and r.sy == pytest.approx(y.sum())
    assert len(got) == 6
    base = rng.normal(size=(2, 640))
    mix = rng.normal(size=(7, 2)) @ base
    few = {r: {f"c{i}": v + (1e-9 if r == 1 else 3.0) * rng.normal(size=640) for i, v in enumerate(mix)} for r in (1, 2)}
    cov = channel_covariance(signals(spark, few), ["rec"], "channel")
    count = {r.rec: r.n_components for r in component_count(cov, ["rec"], 0.999).collect()}
    for r in few:
        ev = np.sort(np.linalg.eigvalsh(np.cov(np.stack(list(few[r].values())))))[::-1]
        k = count[r]
        assert ev[:k].sum() >= .999 * ev.sum() > ev[:k - 1].sum()
    assert count[1] == 2 and count[2] > 2
