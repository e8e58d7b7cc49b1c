import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortwave.operators import cycles as cy, events as ev, signal as sg, spectral as sp, wavelets as wv


def blocks(spark, x, block, rec=1, channel="c0"):
    rows = [(rec, channel, i // block, [float(v) for v in x[i:i + block]]) for i in range(0, len(x), block)]
    return spark.createDataFrame(rows, "rec int, channel string, block_id long, samples array<double>")


def joined(df):
    pdf = df.toPandas().sort_values("block_id")
    return np.concatenate([np.asarray(v, float) for v in pdf["samples"]])


KEYS = ["rec", "channel"]


def tone(n=5000, f=10.0, sf=500.0, noise=0.0, seed=0):
    return np.sin(2 * np.pi * f * np.arange(n) / sf) + noise * np.random.default_rng(seed).normal(size=n)


def test_fir_is_block_free_and_selective(spark):
    x = tone(noise=0.5) + tone(f=40.0)
    taps = sg.fir_taps(500.0, 8.0, 12.0)
    a, b = joined(sg.fir_filter(blocks(spark, x, 1000), KEYS, taps)), joined(sg.fir_filter(blocks(spark, x, 2500), KEYS, taps))
    assert np.allclose(a, b, atol=1e-9)
    want = np.convolve(x, taps, "same")
    mid = slice(len(taps), -len(taps))
    assert np.allclose(a[mid], want[mid], atol=1e-9)
    spec = np.abs(np.fft.rfft(a))
    assert abs(np.fft.rfftfreq(len(a), 1 / 500)[spec.argmax()] - 10) < 0.5
    assert spec[int(40 * 10)] < 0.02 * spec.max()


@pytest.mark.parametrize("n,size", [(441, 200), (441, 64), (5000, 64), (1030, 500), (170, 1000), (501, 500), (60, 25)])
def test_fir_equals_the_unblocked_filter_at_any_block_length(spark, n, size):
    taps = sg.fir_taps(500.0, 8.0, 12.0)
    x = tone(n, noise=0.5)
    half = len(taps) // 2
    k = min(half, n - 1)
    left, right = 2 * x[0] - x[1:k + 1][::-1], 2 * x[-1] - x[-k - 1:-1][::-1]
    z = np.concatenate([np.full(half - k, left[0]), left, x, right, np.full(half - k, right[-1])])
    got = joined(sg.fir_filter(blocks(spark, x, size), KEYS, taps))
    assert np.allclose(got, np.convolve(z, taps, "valid"), atol=1e-9)


def test_reblock_and_decimate(spark):
    x = np.arange(640.0)
    assert np.array_equal(joined(sg.reblock(blocks(spark, x, 64), KEYS, 4)), x)
    assert np.array_equal(joined(sg.decimate(blocks(spark, x, 64), KEYS, 64, 5)), x[::5])


def test_crossings(spark):
    c = cy.crossings(blocks(spark, tone(), 250), KEYS, 250)
    got = sorted(v for r in c.collect() for v in r["cross"])
    x = np.sign(tone())
    x[x == 0] = 1
    want = np.nonzero((x[:-1] < 0) & (x[1:] >= 0))[0] + 1
    assert got == list(want) and 95 <= len(got) <= 105


def sequential(cross, window=5):
    b, gaps = [int(cross[0])], []
    while True:
        t = b[-1]
        period = np.median(gaps[-window:]) if gaps else cross[1] - cross[0]
        later = cross[cross > t]
        if not len(later):
            return b
        nxt = int(later[np.argmin(np.abs(later - (t + period)))])
        gaps.append(nxt - t)
        b.append(nxt)


def test_steps_longer_than_the_next_chunks(spark):
    """Chunks of a few crossings: a step reaches over several of them."""
    r = np.random.default_rng(6)
    cross = np.unique(np.concatenate([[0, 900, 1000], np.arange(1010, 1060, 10), 1900 + np.arange(0, 400, 7), np.cumsum(r.integers(300, 900, 12)) + 2400]))
    rows = [(1, "a", int(b), [int(v) for v in cross[cross // 20 == b]]) for b in range(int(cross[-1]) // 20 + 1)]
    c = spark.createDataFrame(rows, "rec int, channel string, block_id long, cross array<long>")
    got = cy.phase_locked_cycles(c, KEYS, 1).toPandas().sort_values("start_i")
    want = sequential(cross)
    assert list(zip(got.start_i, got.end_i)) == list(zip(want[:-1], want[1:]))


@pytest.mark.parametrize("per", [1, 2, 50])
def test_phase_locked_equals_sequential(spark, per):
    r = np.random.default_rng(5)
    x = np.convolve(r.normal(size=30000), np.hanning(40), "same") + 0.4 * r.normal(size=30000)
    c = cy.crossings(blocks(spark, x, 600), KEYS, 600)
    cross = np.array(sorted(v for row in c.collect() for v in row["cross"]))
    got = cy.phase_locked_cycles(c, KEYS, per).toPandas().sort_values("start_i")
    want = sequential(cross)
    assert list(zip(got.start_i, got.end_i)) == list(zip(want[:-1], want[1:]))


def test_db8_is_orthonormal():
    h = np.array(cy.DB8)
    assert abs(h.sum() - np.sqrt(2)) < 1e-9
    for k in range(8):
        assert abs((h[2 * k:] * h[:len(h) - 2 * k]).sum() - (k == 0)) < 1e-9


def split(n):
    """Matrices of one level for n samples: low and high band, periodised, the last sample twice where n is odd."""
    low, even = (n + 1) // 2, n + n % 2
    lo = np.array(cy.DB8[::-1])
    out = []
    for f in (lo, lo[::-1] * (-1.0) ** np.arange(16)):
        m = np.zeros((low, n))
        for o in range(low):
            for j in range(16):
                m[o, min((2 * o + 8 - j) % even, n - 1)] += f[j]
        out.append(m)
    return out


def join(n):
    """Matrices from both bands back to n samples."""
    low, even = (n + 1) // 2, n + n % 2
    lo = np.array(cy.DB8[::-1])
    out = []
    for f in (lo, lo[::-1] * (-1.0) ** np.arange(16)):
        m = np.zeros((even, low))
        for o in range(low):
            for j in range(16):
                m[(2 * o + 8 - j) % even, o] += f[j]
        out.append(m[:n])
    return out


def project(x, levels):
    if not levels:
        return x
    return join(len(x))[0] @ project(split(len(x))[0] @ x, levels - 1)


@pytest.mark.parametrize("block", [4096, 16])
def test_all_subbands_give_the_signal_back(spark, block):
    r = np.random.default_rng(block)
    sizes = {"a": 1, "b": 2, "c": 7, "d": 31, "e": 64, "f": 121, "g": 260}
    x = {k: r.normal(size=(n, 3)) for k, n in sizes.items()}
    rows = [(k, i, v.tolist()) for k, m in x.items() for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "k string, i long, v array<double>").repartition(4)
    bands = wv.decompose(df, ["k"], "i", "v", cy.max_level(F.col("total")), cy.DB8[::-1], block)
    got = {}
    for q in bands.collect():
        got.setdefault((q.k, q.level, q.band), {})[q.i] = q.v
    for k, m in x.items():
        levels = max(1, int(np.floor(np.log2(len(m) / 15)))) if len(m) > 15 else 1
        for level in range(1, levels + 1):
            lo, hi = split(len(m))
            d = got[k, level, "d"]
            assert np.allclose([d[i] for i in range(len(d))], hi @ m, atol=1e-12) and len(d) == len(hi)
            m = lo @ m
        a = got[k, levels, "a"]
        assert np.allclose([a[i] for i in range(len(a))], m, atol=1e-12) and (k, levels + 1, "d") not in got
    back = wv.reconstruct(bands, ["k"], cy.DB8[::-1], block).collect()
    assert len(back) == len(rows) and all(np.abs(np.array(q.v) - x[q.k][q.i]).max() < 1e-10 for q in back)
    assert wv.decompose(df.limit(0), ["k"], "i", "v", F.lit(1), cy.DB8[::-1]).count() == 0


@pytest.mark.parametrize("n", [64, 65, 200, 333])
def test_wavelet_split_in_blocks_equals_whole(spark, n):
    r = np.random.default_rng(n)
    w = r.normal(size=(n, 50)) + np.linspace(0, 3, 50)
    df = spark.createDataFrame([("a", i, [float(v) for v in w[i]]) for i in range(n)], "k string, cycle_idx long, wave_p array<double>")
    levels = max(1, int(np.floor(np.log2(n / 15))))
    want = project(w, levels)
    for block in (4096, 40):
        got = np.stack(cy.harmonic_estimate(df, ["k"], block=block).toPandas().sort_values("cycle_idx")["estimate"].to_list())
        assert got.shape == w.shape and np.allclose(got, want, atol=1e-9)
    if n % 2 ** levels == 0:                     # orthogonal projection
        assert abs((want ** 2).sum() + ((w - want) ** 2).sum() - (w ** 2).sum()) < 1e-6
    const = np.ones((n, 50))
    assert np.allclose(project(const, levels), const, atol=1e-9)


def test_dft_resample(spark):
    r = np.random.default_rng(0)
    q = 51
    x = np.cos(2 * np.pi * 2 * np.arange(q) / q) + 0.3 * np.sin(2 * np.pi * 5 * np.arange(q) / q)
    df = spark.createDataFrame([([float(v) for v in x],)], "w array<double>")
    get = lambda p: np.array(df.select(cy.dft_resample(F.col("w"), F.lit(p))).first()[0])
    assert np.allclose(get(q), x)
    t = np.arange(101) / 101
    assert np.allclose(get(101), np.cos(2 * np.pi * 2 * t) + 0.3 * np.sin(2 * np.pi * 5 * t))
    back = spark.createDataFrame([([float(v) for v in get(101)],)], "w array<double>").select(cy.dft_resample(F.col("w"), F.lit(q))).first()[0]
    assert np.allclose(back, x)
    y = r.normal(size=50)
    even = np.array(spark.createDataFrame([([float(v) for v in y],)], "w array<double>").select(cy.dft_resample(F.col("w"), F.lit(50))).first()[0])
    assert abs(np.fft.fft(even)[25]) < 1e-9     # the middle bin is zeroed for even lengths


def test_boundary_scan_sends_no_state_to_the_driver(spark):
    """No join of a round is a broadcast: here any broadcast is an error."""
    rows = [(rec, "c", b, [b * 100 + 7 * i + rec for i in range(14)]) for rec in range(3) for b in range(6)]
    c = spark.createDataFrame(rows, "rec int, channel string, block_id long, cross array<long>")
    want = sorted(map(tuple, cy.phase_locked_cycles(c, KEYS, 100).collect()))
    before = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")
    try:
        got = sorted(map(tuple, cy.phase_locked_cycles(c, KEYS, 1).collect()))
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", before)
    assert got == want and len(got) > 100


def test_psr_needs_long_cycles(spark):
    df = spark.createDataFrame([(1, "c", i, 30, [0.0] * 30, True) for i in range(5)], "rec int, channel string, start_i long, len long, wave array<double>, valid boolean")
    with pytest.raises(Exception, match="modal cycle length"):
        cy.psr(df, KEYS).collect()


def test_psr_of_other_channels_goes_on(spark):
    """One channel with short cycles takes nothing from the others."""
    rows = [(1, c, i, n, [float(j * i) for j in range(n)], True) for c, n in (("short", 30), ("long", 50)) for i in range(5)]
    df = spark.createDataFrame(rows, "rec int, channel string, start_i long, len long, wave array<double>, valid boolean")
    got = {(r.channel, r.start_i): (r.P, r.wave_p) for r in cy.psr(df, KEYS, strict=False).collect()}
    want = {r.start_i: r.wave_p for r in cy.psr(df.where("channel = 'long'"), KEYS).collect()}
    assert len(got) == 10 and all(got["short", i] == (30, None) and got["long", i] == (50, want[i]) for i in range(5))


def test_welch_and_bands(spark):
    x = tone(15000, noise=0.1, sf=250.0)
    n = 1000
    p = sp.welch(blocks(spark, x, 700), KEYS, 700, 250.0, n, 0.0, 1, 45).toPandas().sort_values("f")
    w = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / n)
    seg = x[:len(x) // n * n].reshape(-1, n)
    ref = (np.abs(np.fft.rfft((seg - seg.mean(1, keepdims=True)) * w)) ** 2 * 2 / (250 * (w ** 2).sum())).mean(0)
    f = np.fft.rfftfreq(n, 1 / 250)
    assert np.allclose(p["p"], ref[(f >= 1) & (f <= 45)])
    b = sp.relative_bands(sp.spectrum_arrays(spark.createDataFrame(p), KEYS), KEYS).first().asDict()
    bands = {k: b[k] for k in sp.BANDS}
    assert max(bands, key=bands.get) == "alpha" and sum(bands.values()) <= 1 + 1e-9
    pk = sp.peak_frequency(sp.welch(blocks(spark, x, 700), KEYS, 700, 250.0, n, 0.5, 2, 30), KEYS).first()
    assert pk["iaf_hz"] == 10.0 and pk["present"]


def test_multitaper_finds_the_tone(spark):
    tapers, ratios = sp.dpss_tapers(256, 4.0, 8)
    assert np.allclose(tapers @ tapers.T, np.eye(8), atol=1e-9)
    assert ratios[0] > 0.9999 and (np.diff(ratios) < 1e-6).all()
    x = tone(1000, f=20.0, sf=250.0)
    s = sp.segments(blocks(spark, x, 1000), KEYS, 1000, 1000, 1000)
    p = sp.psd_long(s, KEYS, sp.multitaper_power(F.col("samples"), 1000, 250.0), 0.25, 1, 45).toPandas()
    assert abs(p.loc[p["p"].idxmax(), "f"] - 20) <= 2
    f = sp.windowed_tfa(blocks(spark, x, 500), ["rec"], 500, 250.0, 2.0).first().asDict()
    assert f["tfa_beta_mean"] > 0.9


def test_artifacts(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=5000) * 1e-6
    clean = blocks(spark, x, 300)
    assert sg.artifact_fraction(clean, ["rec"], "channel", 300, 500, 1.5e-4).first()["artifact_frac"] == 0.0
    x[1234] = 1e-3
    d = blocks(spark, x, 300).unionByName(blocks(spark, x * 0, 300, channel="c1"))
    assert abs(sg.artifact_fraction(d, ["rec"], "channel", 300, 500, 1.5e-4).first()["artifact_frac"] - 0.1) < 1e-12
    s = sg.artifact_segments(d, ["rec"], "channel", 300, 500, 1.5e-4, 500.0).collect()
    assert len(s) == 1 and s[0]["onset_s"] == 2.0
    tail = blocks(spark, np.r_[x[:1000], [1.0, 0.0]], 300)      # a two-sample last window
    assert sg.artifact_segments(tail, ["rec"], "channel", 300, 500, 1.5e-4, 500.0).first()["duration_s"] == 2 / 500


def test_reference_order_matters(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=1250)
    d = None
    for c in range(8):
        y = base + 0.1 * r.normal(size=1250)
        if c == 3:
            y = 50 * r.normal(size=1250)
        b = blocks(spark, y, 250, channel=f"c{c}")
        d = b if d is None else d.unionByName(b)
    pos = spark.createDataFrame([(1, f"c{c}", float(c), 0.0, 0.0) for c in range(8)], "rec int, channel string, x double, y double, z double")
    from cohortwave.operators.cohort import nearest_sensors
    nb = nearest_sensors(pos, ["rec"], 3)
    flags = sg.bad_channels(d, nb, ["rec"], "channel", min_corr=-1.0)
    assert [r["channel"] for r in flags.where("bad").collect()] == ["c3"]
    en = lambda o: sg.reference_and_repair(d, flags, nb, ["rec"], "channel", o).where("channel = 'c0'").select(F.sum(F.aggregate("samples", F.lit(0.0), lambda s, v: s + v * v))).first()[0]
    assert en("pre_interpolation") > 5 * en("post_interpolation")


PATTERNS = [
    ([(5, "S  1"), (246, "S 10"), (260, "S  1"), (620, "S 11")], 700, (260, 620)),
    ([(246, "S 10"), (260, "S  1")], 700, (260, 700)),
    ([(10, "S 10")], 370, (10, 370)),
    ([(5, "S  1"), (620, "S 11")], 700, None),
    ([(246, "S 10"), (400, "S  1"), (620, "S 11")], 700, (246, 620)),
    ([(246, "S 10"), (260, "S  1"), (300, "S 11")], 700, None),
    ([(240, "New Segment/S 10"), (250, "Stimulus/S  1"), (255, "S 11"), (500, "S 11")], 700, None),
    ([(100, "S 11"), (240, "S 10"), (600, "S 11"), (650, "S  1")], 700, (240, 600)),
]


def test_closed_windows(spark):
    rows = [(i, k, float(o), d) for i, (ms, _, _) in enumerate(PATTERNS) for k, (o, d) in enumerate(ms)]
    ann = spark.createDataFrame(rows, "rec int, event_id long, onset_s double, description string")
    tm = spark.createDataFrame([(i, float(t)) for i, (_, t, _) in enumerate(PATTERNS)], "rec int, tmax double")
    got = {r["rec"]: (r["start_s"], r["end_s"]) for r in ev.closed_window(ann, ["rec"], tm).collect()}
    for i, (_, _, want) in enumerate(PATTERNS):
        assert got.get(i) == want, (i, got.get(i), want)
    op = {r["rec"]: r["end_s"] for r in ev.open_window(ann, ["rec"]).collect()}
    assert op[0] == 246 and 2 not in op and 3 not in op


def test_marker_gaps(spark):
    ann = spark.createDataFrame([(1, 0, 1.0, "S  4"), (1, 1, 4.5, "S 11"), (1, 2, 10.0, "Stimulus/S  4"), (1, 3, 11.0, "S 11"), (1, 4, 20.0, "S  4")],
                                "rec int, event_id long, onset_s double, description string")
    m = ev.marker_onsets(ann, ["rec"], 4, 3.0, 2.0)
    assert [r["onset_s"] for r in m.where("kept").collect()] == [1.0]
    assert ev.marker_counts(m, ["rec"]).first().asDict() == {"rec": 1, "n_used": 1, "n_skipped": 2}


def test_epochs_past_the_end(spark):
    x = np.arange(1000.0)
    on = spark.createDataFrame([(1, 0, 0.4), (1, 1, 9.0), (1, 2, 9.95)], "rec int, event_id long, onset_s double")
    e = ev.epochs(on, blocks(spark, x, 70), ["rec"], 100.0, 100, 70).collect()
    assert sorted(r["event_id"] for r in e) == [0, 1]
    assert all(list(r["samples"]) == list(x[r["s0"]:r["s0"] + 100]) for r in e)


def test_asymmetry(spark):
    w = [0.0, 1.0, 4.0, 2.0, 0.0, -3.0, -1.0]
    r = spark.createDataFrame([(w,)], "w array<double>").select(*cy.waveform_asymmetry(F.col("w"))).first()
    assert r[0] == 2 / 5 and abs(r[1] - abs(2.0 - 1.0) / abs(-1.0 - 0.0)) < 1e-12
    flat = spark.createDataFrame([([1.0, 1.0, 1.0],)], "w array<double>").select(*cy.waveform_asymmetry(F.col("w"))).first()
    assert flat[1] is None


def test_subject_features(spark):
    """A long noisy rhythm gives all 18 columns; a subject without enough
    cycles is excluded with a reason."""
    x = tone(30000, noise=0.3)
    d = blocks(spark, x, 3000).unionByName(blocks(spark, x[:1500], 3000, rec=2))
    nb = sg.fir_filter(d, KEYS, sg.fir_taps(500.0, 8.0, 12.0))
    c = cy.phase_locked_cycles(cy.crossings(nb, KEYS, 3000), KEYS, 1)
    v = cy.valid_cycles(cy.cut_waves(c, d, KEYS, 3000), KEYS, 500.0, F.lit(10.0)).cache()
    st = cy.cycle_stats(v, KEYS).cache()
    s = {r["rec"]: r for r in st.collect()}
    assert 550 < s[1]["n_detected"] < 620 and abs(s[1]["median_period_s"] - 0.1) < 0.002
    feats, status = cy.subject_features(cy.cycle_features(cy.psr(v, KEYS), st, KEYS), st, ["rec"], "channel", 200)
    rows = feats.collect()
    assert [r["rec"] for r in rows] == [1] and len(feats.columns) == 19
    assert rows[0]["harmonic_amplitude_profile_h5_median"] is None and rows[0]["rise_decay_ratio_median"] > 0
    why = {r["rec"]: r["excluded_reason"] for r in status.collect()}
    assert why[1] is None and "too few" in why[2]


def test_subjects_with_short_cycles(spark):
    """Recordings of 40 to 60 and of 25 to 35 samples a cycle: the short one is excluded with its reason, its channel keeps
    its statistics, and the other's features are as without it."""
    r = np.random.default_rng(5)
    rows = [(rec, "c", i, n, [float(v) for v in np.cos(2 * np.pi * np.arange(n) / n) + 0.1 * r.normal(size=n)], 2.0, n / 500, True)
            for rec, lo in ((1, 45), (2, 25)) for i in range(60) for n in [lo + i % 3]]
    v = spark.createDataFrame(rows, "rec int, channel string, start_i long, len long, wave array<double>, amp double, period_s double, valid boolean").cache()
    st = cy.cycle_stats(v, KEYS).cache()
    f = cy.cycle_features(cy.psr(v, KEYS, strict=False).where("wave_p is not null"), st, KEYS).cache()
    alone = cy.cycle_features(cy.psr(v.where("rec = 1"), KEYS), st, KEYS).cache()
    wide, status = cy.subject_features(f, st, ["rec"], "channel", 40)
    assert wide.collect() == cy.subject_features(alone, st, ["rec"], "channel", 40)[0].collect() and wide.count() == 1
    assert {x.rec: x.excluded_reason for x in status.collect()} == {1: None, 2: "modal cycle length of a channel too short"}
    per = {x.rec: x for x in cy.channel_features(f, st, KEYS, 40).collect()}
    assert per[2].n_valid == 60 and per[2].rise_decay_ratio is None and per[1].rise_decay_ratio is not None


def test_preprocess_chain(spark):
    """Mains removed, the broken channel repaired, the rate reduced."""
    from cohortwave.operators.workflow import preprocess
    r = np.random.default_rng(2)
    t = np.arange(8000) / 500
    shared = np.convolve(r.normal(size=8000), np.ones(5) / 5, "same")
    d = None
    for c in range(6):
        y = shared * (1 + 0.02 * c) + 0.3 * r.normal(size=8000) + (1 + c) * np.sin(2 * np.pi * 50 * t)
        if c == 4:
            y = np.zeros(8000)
        b = blocks(spark, y, 4000, channel=f"c{c}")
        d = b if d is None else d.unionByName(b)
    pos = spark.createDataFrame([(1, f"c{c}", float(c), 0.0, 0.0) for c in range(6)], "rec int, channel string, x double, y double, z double")
    out = preprocess(d, pos, ["rec"], "channel", 4000, 500.0, 250.0, occipital=["c4"], peak=1e9)
    q = out["qc_facts"].first()
    assert q["n_bad_channels"] >= 1 and q["occipital_bads"] == 1 and q["artifact_frac"] == 0.0
    assert q["line_before"] > 3 and q["line_after"] < 1.5
    assert len(joined(out["blocks"].where("channel = 'c0'"))) == 4000
