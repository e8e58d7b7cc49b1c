"""Spectral queries over the vectors as recordings."""
from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import events as ev, signal as sg, spectral as sp
from .bindings import with_roles
from .events import B, ch_name
from .registry import query

# Welch over 64-sample segments with half overlap, written out as a plain DFT.
SFREQ = 128.0
PSD = """, x as (select rec, channel, block_id * 64 + i - 1 as i, samples[i]::double as v from (select rec, channel, block_id, samples, unnest(range(1, 65)) as i from signal) q),
  sg as (select rec, channel, floor(i / {step}) as w, cast(i % {step} as int) as j, v from x
         {extra}),
  sgm as (select rec, channel, w from sg group by 1, 2, 3 having count(*) = 64),
  z as (select rec, channel, w, j, (v - avg(v) over (partition by rec, channel, w)) * (54e-2 - 46e-2 * cos(2 * pi() * j / 6.4e1)) as u from sg join sgm using (rec, channel, w)),
  wn as (select sum((54e-2 - 46e-2 * cos(2 * pi() * j / 6.4e1)) ** 2) as ss from (select unnest(range(0, 64)) as j)),
  ft as (select rec, channel, w, k, sum(u * cos(2 * pi() * k * j / 6.4e1)) as re, sum(u * sin(2 * pi() * k * j / 6.4e1)) as im from z cross join (select unnest(range(0, 33)) as k) kk group by 1, 2, 3, 4),
  psd as (select rec, channel, k * 2e0 as f, avg((re * re + im * im) / (1.28e2 * ss) * case when k in (0, 32) then 1 else 2 end) as p from ft cross join wn group by 1, 2, 3)"""
SRC = PSD.split(", x as (")[1].split("),\n  sg as")[0]


def psd_of(suffix: str, source: str, step: int, extra: str = "") -> str:
    """The PSD CTEs under suffixed names over another sample source."""
    text = PSD.replace(SRC, source).format(step=step, extra=extra)
    for name in ("psd", "sgm", "sg", "ft", "wn", "x", "z"):
        text = re.sub(rf"\b{name}\b(?! =)", f"{name}_{suffix}", text)
    return text


PSD0 = PSD.format(step=64, extra="")
PSD50 = PSD.format(step=32, extra="union all select rec, channel, floor(i / 32) - 1, cast(i % 32 + 32 as int), v from x where i >= 32")


def psd(t, overlap=0.5, fmin=0.0, fmax=64.0):
    return sp.welch(t.signal, ["rec", "channel"], B, SFREQ, 64, overlap, fmin, fmax)


@query("sig8_welch_psd", with_roles(PSD50 + " select rec, channel, f, round(p, 9) as p from psd", "signal"))
def _(t):
    return psd(t).withColumn("p", F.round("p", 9))


AREA = """, mp as (select rec, f, avg(p) as p from psd where f between 1 and 45 group by 1, 2),
  bd as (select * from (values ('delta', 1e0, 4e0), ('theta', 4e0, 8e0), ('alpha', 8e0, 13e0), ('beta', 13e0, 30e0), ('gamma', 30e0, 45e0), ('total', 1e0, 45e0)) b(band, lo, hi)),
  tz as (select rec, band, f, p, lead(f) over w as f2, lead(p) over w as p2 from mp join bd on f >= lo and f < hi window w as (partition by rec, band order by f)),
  ar as (select rec, band, coalesce(sum((p + p2) / 2 * (f2 - f)), 0e0) as a from tz group by 1, 2)"""


@query("sig9_band_area", with_roles(PSD0 + AREA + " select rec, band, round(a, 9) as area from ar", "signal"))
def _(t):
    mean = psd(t, 0.0, 1, 45).groupBy("rec", "f").agg(F.avg("p").alias("p"))
    s = sp.spectrum_arrays(mean, ["rec"])
    from ..functions.shape import record_array
    bands = {**sp.BANDS, "total": sp.TOTAL}
    return s.select("rec", F.explode(record_array(["band", "area"], *[
        (b, F.round(sp.band_area(F.col("spectrum"), *e), 9)) for b, e in bands.items()])).alias("r")).select("rec", "r.*")


REL = "select rec, " + ", ".join(f"round(coalesce(max(a) filter (band = '{b}'), 0e0) / max(a) filter (band = 'total'), 9) as {b}" for b in sp.BANDS) + " from ar group by rec"


@query("sig10_relative_bands", with_roles(PSD0 + AREA + REL, "signal"))
def _(t):
    mean = psd(t, 0.0, 1, 45).groupBy("rec", "f").agg(F.avg("p").alias("p"))
    d = sp.relative_bands(sp.spectrum_arrays(mean, ["rec"]), ["rec"])
    return d.select("rec", *[F.round(b, 9).alias(b) for b in sp.BANDS])


@query("sig11_aperiodic_fit", with_roles(PSD0 + """ select rec, channel, round(regr_intercept(log10(greatest(p, 1e-20)), log10(f)), 6) as aperiodic_offset, round(regr_slope(log10(greatest(p, 1e-20)), log10(f)), 6) as aperiodic_slope
  from psd where (f >= 1 and f < 8) or (f >= 13 and f <= 45) group by 1, 2""", "signal"))
def _(t):
    d = sp.aperiodic(psd(t, 0.0, 1, 45), ["rec", "channel"])
    return d.select("rec", "channel", *[F.round(c, 6).alias(c) for c in ("aperiodic_offset", "aperiodic_slope")])


MEAN = "select {g}, -1 as channel, i, avg(v) as v from ({src}) y group by {g}, i"
FIT = "select {g}, regr_intercept(log10(greatest(p, 1e-20)), log10(f)) as o, regr_slope(log10(greatest(p, 1e-20)), log10(f)) as s from psd_m where (f >= 1 and f < 8) or (f >= 13 and f <= 45) group by {g}"
IAF_SQL = """ a_ as (select rec, f, avg(p) as p from psd_h where f between 2 and 30 group by 1, 2),
  b_ as (select rec, regr_slope(log10(p), log10(f)) as s, regr_intercept(log10(p), log10(f)) as c from a_ where f < 7 or f > 13 group by 1),
  pk as (select rec, first(f order by p desc, f) as f, max(log10(p)) as lp from a_ where f >= 7 and f <= 13 group by 1)"""
SHARES = ", ".join(f"round(coalesce(max(a) filter (band = '{b}'), 0e0) / max(a) filter (band = 'total'), 9) as band_power_{b}" for b in sp.BANDS)
HALF = "union all select rec, channel, floor(i / 32) - 1, cast(i % 32 + 32 as int), v from x where i >= 32"


@query("sig12_baseline_features", with_roles(
    PSD0 + AREA + psd_of("m", MEAN.format(g="rec", src=SRC), 64) + psd_of("h", SRC, 32, HALF) + ", fm as (" + FIT.format(g="rec") + ")," + IAF_SQL + f"""
  select ar.rec, {SHARES}, round(max(o), 6) as aperiodic_offset, round(max(fm.s), 6) as aperiodic_slope, round(max(pk.f), 2) as iaf_hz,
    round(1e1 * (max(lp) - (max(b_.s) * log10(max(pk.f)) + max(c))), 2) as peak_height_db, 1e1 * (max(lp) - (max(b_.s) * log10(max(pk.f)) + max(c))) >= 3e0 as present
  from ar join fm on fm.rec = ar.rec join pk on pk.rec = ar.rec join b_ on b_.rec = ar.rec group by ar.rec""", "signal"))
def _(t):
    peaks = sp.peak_frequency(psd(t, 0.5, 2, 30).groupBy("rec", "f").agg(F.avg("p").alias("p")), ["rec"])
    d = sp.baseline_features(t.signal, ["rec"], "channel", B, SFREQ, 64, peaks=peaks)
    return d.select("rec", *[F.round(f"band_power_{b}", 9).alias(f"band_power_{b}") for b in sp.BANDS],
                    *[F.round(c, 6).alias(c) for c in ("aperiodic_offset", "aperiodic_slope")], "iaf_hz", "peak_height_db", "present")


@query("sig13_peak_frequency", with_roles(PSD50 + """, a as (select rec, f, avg(p) as p from psd where f between 2 and 30 group by 1, 2),
  b as (select rec, regr_slope(log10(p), log10(f)) as s, regr_intercept(log10(p), log10(f)) as c from a where f < 7 or f > 13 group by 1),
  m as (select rec, first(f order by p desc, f) as f, max(log10(p)) as lp from a where f >= 7 and f <= 13 group by 1)
  select m.rec, round(f, 2) as iaf_hz, round(1e1 * (lp - (s * log10(f) + c)), 2) as peak_height_db, 1e1 * (lp - (s * log10(f) + c)) >= 1e0 as present from m join b on m.rec = b.rec""", "signal"))
def _(t):
    return sp.peak_frequency(psd(t, 0.5, 2, 30).groupBy("rec", "f").agg(F.avg("p").alias("p")), ["rec"], min_db=1.0)


@query("lim4_argmax_in_band", with_roles(PSD50 + " select rec, channel, first(f order by p desc, f) as f_peak from psd where f between 7 and 13 group by 1, 2", "signal"))
def _(t):
    d = psd(t, 0.5, 7, 13)
    return d.groupBy("rec", "channel").agg(F.min_by("f", F.struct(-F.col("p"), F.col("f"))).alias("f_peak"))


@query("sig15_line_noise_index", with_roles(PSD50 + """ select rec, round(avg(p) filter (f between 48 and 52) / greatest(avg(p) filter (f between 42 and 46 or f between 54 and 58), 1e-30), 6) as line_noise_index
  from (select rec, f, avg(p) as p from psd group by 1, 2) group by 1""", "signal"))
def _(t):
    mean = psd(t).groupBy("rec", "f").agg(F.avg("p").alias("p"))
    return sp.line_noise_index(mean, ["rec"], 50.0, 2.0, ((42.0, 46.0), (54.0, 58.0))).withColumn("line_noise_index", F.round("line_noise_index", 6))


def taper_sql(n: int, bandwidth: float = 4.0) -> str:
    """Tapers m, their weights g and values (j, h) of windows of n samples, written out."""
    half = bandwidth * n / (2.0 * SFREQ)
    tapers, ratios = sp.dpss_tapers(n, half, max(1, int(2 * half)))
    kept = [(m, g, v) for m, (g, v) in enumerate(zip(ratios.tolist(), tapers.tolist())) if g > 0.9]
    return " union all ".join(f"select {m} as m, {g!r}::double as g, unnest(range(0, {n})) as j, unnest([{', '.join(f'{x!r}::double' for x in v)}]) as h" for m, g, v in kept)


@query("sig27_multitaper_psd", with_roles(f""", x as (select rec, channel, block_id * 64 + i - 1 as i, samples[i]::double as v from (select rec, channel, block_id, samples, unnest(range(1, 65)) as i from signal) q),
  w as (select rec, channel, floor(i / 128) as w, cast(i % 128 as int) as j, v, count(*) over (partition by rec, channel, floor(i / 128)) as c, avg(v) over (partition by rec, channel, floor(i / 128)) as a from x),
  tp as ({taper_sql(128)}), tot as (select sum(g) as tg from (select distinct m, g from tp)), u as (select rec, channel, w, m, g, w.j, (v - a) * h as u from w join tp on tp.j = w.j where c = 128),
  ft as (select rec, channel, w, m, g, k, sum(u * cos(2 * pi() * k * j / 1.28e2)) as re, sum(u * sin(2 * pi() * k * j / 1.28e2)) as im from u cross join (select unnest(range(0, 65)) as k) kk group by 1, 2, 3, 4, 5, 6),
  p as (select rec, channel, w, k, sum(g * (re * re + im * im)) * case when k in (0, 64) then 1e0 else 2e0 end / max(tg) as p from ft cross join tot group by 1, 2, 3, 4)
  select rec, channel, k * {SFREQ / 128!r}::double as f, round(avg(p), 6) as p from p where k * {SFREQ / 128!r}::double between 1 and 45 group by 1, 2, 3""", "signal"))
def _(t):
    s = sp.segments(t.signal, ["rec", "channel"], B, 128, 128)
    return sp.psd_long(s, ["rec", "channel"], sp.multitaper_power(F.col("samples"), 128, SFREQ), SFREQ / 128, 1, 45).withColumn("p", F.round("p", 6))


@query("sig28_windowed_tfa")
def _(t):
    return sp.windowed_tfa(t.signal, ["rec"], B, SFREQ, 1.0, "msit_")


@query("sig29_event_locked_tfa")
def _(t):
    """Epochs of both codes with their trial counts."""
    gaps = ev.marker_onsets(t.annotations, ["rec"], 4, 3600.0, 86400.0)
    kept = gaps.where("kept").select("rec", "event_id", (F.col("onset_s") / 3600.0).alias("onset_s"))
    ep = ev.epochs(kept, t.long_signal.drop("label"), ["rec"], 8.0, 64, B)
    f = sp.epoch_tfa(ep, ["rec"], 64, SFREQ, "sternberg_encoding_")
    n = ev.marker_counts(gaps, ["rec"]).select("rec", F.col("n_used").alias("sternberg_encoding_n_trials_used"), F.col("n_skipped").alias("sternberg_encoding_n_trials_skipped"))
    return f.join(n, "rec", "left")


ZONE = "case when channel in (0, 1) then 'frontal' when channel in (2, 3) then 'central' when channel in (4, 7) then 'parietal' when channel = 5 then 'occipital' else 'temporal' end"


def by_zone(sql: str) -> str:
    """The same CTEs keyed by (recording, zone)."""
    return re.sub(r"\brec\b", "rz", sql)


ZSRC = SRC.replace("select rec, channel, block_id * 64", f"select rec * 8 + ascii({ZONE}) % 8 as rz, channel, block_id * 64")


@query("sig30_zone_features", with_roles(
    by_zone(psd_of("z0", "@src@", 64)).replace("@src@", ZSRC) + by_zone(AREA).replace("from psd", "from psd_z0") + by_zone(psd_of("m", "@src@", 64)).replace("@src@", MEAN.format(g="rz", src=ZSRC)) + ", fm as (" + FIT.format(g="rz") + f""")
  , nm as (select distinct rec * 8 + ascii({ZONE}) % 8 as rz, rec, {ZONE} as zone from signal)
  select nm.rec, nm.zone, {SHARES}, round(max(o), 6) as aperiodic_offset, round(max(fm.s), 6) as aperiodic_slope from ar join fm on fm.rz = ar.rz join nm on nm.rz = ar.rz group by 1, 2""", "signal"))
def _(t):
    d = sp.zone_features(t.signal, ["rec"], ch_name(F.col("channel")), B, SFREQ, 64)
    return d.select("rec", "zone", *[F.round(f"band_power_{b}", 9).alias(f"band_power_{b}") for b in sp.BANDS],
                    *[F.round(c, 6).alias(c) for c in ("aperiodic_offset", "aperiodic_slope")])


PROBS = """, pr as (select vec_id as comp, i - 1 as c, exp(8e0 * embedding[i]::double) as e from (select vec_id, embedding, unnest(range(1, 8)) as i from embeddings) x),
  pp as (select comp, case c when 0 then 'brain' when 1 then 'muscle artifact' when 2 then 'eye blink' when 3 then 'heart beat' when 4 then 'line noise' when 5 then 'channel noise' else 'other' end as class, e / sum(e) over (partition by comp) as p from pr)"""
CLASSES = ["brain", "muscle artifact", "eye blink", "heart beat", "line noise", "channel noise", "other"]


@query("sig31_component_policy", "with one as (select 1)" + PROBS + """ select comp, round(max(p) filter (class not in ('brain', 'other')), 9) as p_artifact, first(class order by p desc, class) as label,
   max(p) filter (class not in ('brain', 'other')) > 5e-1 as excluded from pp group by comp""")
def _(t):
    from ..functions.shape import record_array
    e = lambda i: F.exp(F.lit(8.0) * F.col("embedding")[i].cast("double"))
    total = sum((e(i) for i in range(1, 7)), e(0))
    d = t.embeddings.select(F.col("vec_id").alias("comp"), F.explode(record_array(["class", "p"], *[(c, e(i) / total) for i, c in enumerate(CLASSES)])).alias("r")).select("comp", "r.*")
    return sp.component_policy(d, ["comp"], CLASSES[1:6], 0.5).withColumn("p_artifact", F.round("p_artifact", 9))


@query("sig32_component_fallback", with_roles(PSD0 + """, c0 as (select rec, i, v from x where channel = 0),
  cr as (select x.rec, x.channel, abs(corr(x.v, c0.v)) as r from x join c0 on x.rec = c0.rec and x.i = c0.i where x.channel <> 0 group by 1, 2),
  ms as (select rec, channel, avg(p) filter (f >= 20) / avg(p) filter (f < 20) as m from psd where f between 1 and 45 group by 1, 2)
  select cr.rec, cr.channel, round(r, 6) as eog_r, round(m, 6) as muscle_ratio, case when r > 1.2e-1 then 'eye blink' when m > 1e0 then 'muscle artifact' end as label, r > 1.2e-1 or m > 1e0 as excluded
  from cr join ms on cr.rec = ms.rec and cr.channel = ms.channel""", "signal"))
def _(t):
    nb = t.signal.where("channel <> 0").select("rec", "channel", F.lit(0).cast("bigint").alias("neighbour")).distinct()
    corr = sg.neighbour_correlation(t.signal, nb, ["rec"], "channel")
    d = sp.component_fallback(corr, psd(t, 0.0, 1, 45), ["rec", "channel"], 0.12, 1.0)
    return d.withColumn("eog_r", F.round("eog_r", 6)).withColumn("muscle_ratio", F.round("muscle_ratio", 6))


@query("sig33_component_count")
def _(t):
    return sp.component_count(sp.channel_covariance(t.signal, ["rec"], "channel"), ["rec"], 0.9)


@query("sig33_channel_covariance", with_roles(""", x as (select rec, channel, block_id * 64 + i as i, samples[i]::double as v from (select rec, channel, block_id, samples, unnest(range(1, 65)) as i from signal) q)
  select a.rec, a.channel as c1, b.channel as c2, round(covar_samp(a.v, b.v), 9) as cov from x a join x b on a.rec = b.rec and a.i = b.i and a.channel <= b.channel group by 1, 2, 3""", "signal"))
def _(t):
    return sp.channel_covariance(t.signal, ["rec"], "channel").withColumn("cov", F.round("cov", 9))
