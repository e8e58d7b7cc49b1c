"""Representations of a recording beyond averaged spectra: connectivity, covariance, tangent space, peaks per channel;
spline repair and rational resampling."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import montage as mo, parametric as pa, resampling as rs, signal as sg, splines as sl
from .bindings import with_roles
from .events import B
from .registry import query
from .spectral import PSD50, SFREQ, SRC, psd

# the DFT of every window joined with itself by channel pair
PAIRS = f""", pr as (select a.rec, a.k * 2e0 as f, a.channel as c1, b.channel as c2, count(*) as n, sum(a.re * b.im - a.im * b.re) as im,
    sum(case when abs(a.re * b.im - a.im * b.re) > {mo.NO_PHASE!r}::double * sqrt((a.re * a.re + a.im * a.im) * (b.re * b.re + b.im * b.im)) then sign(a.re * b.im - a.im * b.re) else 0 end) as sg,
    sum(a.re * a.re + a.im * a.im) as p1, sum(b.re * b.re + b.im * b.im) as p2
  from ft a join ft b on a.rec = b.rec and a.w = b.w and a.k = b.k and a.channel < b.channel group by 1, 2, 3, 4),
  bd as (select * from (values ('alpha', 8e0, 13e0), ('beta', 13e0, 30e0)) b(band, lo, hi))"""


@query("rep_connectivity", with_roles(PSD50 + PAIRS + """ select rec, band, c1, c2, max(n) as n_windows, round(avg(abs(im) / sqrt(p1 * p2)), 9) as imag_coherence, round(avg(abs(sg) / n), 9) as phase_lag_index
  from pr join bd on f >= lo and f < hi group by 1, 2, 3, 4""", "signal"))
def _(t):
    d = mo.connectivity(t.signal, ["rec"], "channel", B, SFREQ, 64, 0.5, {"alpha": (8.0, 13.0), "beta": (13.0, 30.0)})
    return d.withColumn("imag_coherence", F.round("imag_coherence", 9)).withColumn("phase_lag_index", F.round("phase_lag_index", 9))


def shrunk_sql(channels: int) -> str:
    """Samples, their covariance S, the shrinkage weight and the shrunk entries sc of the first channels."""
    return f""", x as ({SRC}), y as (select rec, channel, i, v - avg(v) over (partition by rec, channel) as u from x where channel < {channels}),
  whole as (select rec, i from y group by 1, 2 having count(*) = {channels}),
  s as (select a.rec, a.channel as c1, b.channel as c2, sum(a.u * b.u) as s from y a join y b on a.rec = b.rec and a.i = b.i group by 1, 2, 3),
  nn as (select rec, count(*) as n from whole group by 1), s1 as (select s.rec, c1, c2, s / n as s from s join nn on nn.rec = s.rec),
  q as (select rec, sum(r * r) as q from (select rec, i, sum(u * u) as r from y group by 1, 2) z group by 1),
  m as (select s1.rec, max(n) as n, sum(s) filter (c1 = c2) / {channels} as mu, sum(s * s) as norm, max(q) as q from s1 join nn on nn.rec = s1.rec join q on q.rec = s1.rec group by 1),
  w as (select rec, n, mu, case when norm - {channels} * mu * mu > 0 then least((q / n - norm) / (n * {channels}), (norm - {channels} * mu * mu) / {channels}) / ((norm - {channels} * mu * mu) / {channels}) else 0e0 end as w from m),
  sc as (select s1.rec, c1, c2, n, w, (1 - w) * s + case when c1 = c2 then w * mu else 0e0 end as v from s1 join w on w.rec = s1.rec)"""


CHANNELS = list(range(8))


@query("rep_shrinkage_covariance", with_roles(shrunk_sql(8) + " select rec, n::bigint as n, round(w, 9) as shrinkage, c1::int as c1, c2::int as c2, round(v, 9) as cov from sc where c1 <= c2 and rec in (select rec from y group by rec having count(distinct channel) = 8)", "signal"))
def _(t):
    d = mo.shrunk_covariance(t.signal, ["rec"], "channel", CHANNELS)
    cell = F.posexplode("cov").alias("at", "v")
    d = d.select("rec", "n", F.round("shrinkage", 9).alias("shrinkage"), cell).select("rec", "n", "shrinkage", F.floor(F.col("at") / 8).cast("int").alias("c1"), (F.col("at") % 8).alias("c2"), F.round("v", 9).alias("cov"))
    return d.where("c1 <= c2")


@query("rep_tangent_space")
def _(t):
    """All eight channels; the mean of each of five models is fitted on the other folds."""
    return mo.tangent_space(t.signal, ["rec"], "channel", CHANNELS, F.pmod("rec", F.lit(5)), 5)


# at the mean of a training set the logarithms of determinants average out, and a trace is a difference of such logarithms
@query("rep_tangent_trace", with_roles(shrunk_sql(3) + """,
  g as (select rec, max(v) filter (c1 = 0 and c2 = 0) as a, max(v) filter (c1 = 0 and c2 = 1) as b, max(v) filter (c1 = 0 and c2 = 2) as c, max(v) filter (c1 = 1 and c2 = 1) as d, max(v) filter (c1 = 1 and c2 = 2) as e, max(v) filter (c1 = 2 and c2 = 2) as f
        from sc where rec in (select rec from y group by rec having count(distinct channel) = 3) group by 1),
  ld as (select rec, ln(a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)) as ld from g),
  md as (select range::int as model, avg(ld) as mld from ld join range(3) on rec % 3 <> range group by 1)
  select rec, model, rec % 3 = model as held_out, round(ld - mld, 6) + 0e0 as trace from ld cross join md""", "signal"))
def _(t):
    d = mo.tangent_space(t.signal, ["rec"], "channel", CHANNELS[:3], F.pmod("rec", F.lit(3)), 3)
    c = F.col("coordinates")
    return d.select("rec", "model", "held_out", (F.round(c[0] + c[3] + c[5], 6) + 0.0).alias("trace"))


@query("rep_periodic_fit")
def _(t):
    """Line and peaks of every channel, and the strongest peak of the alpha range beside them."""
    fits = pa.periodic_fit(psd(t, 0.5, 1, 45), ["rec", "channel"])
    alpha = pa.strongest_peak(fits, ["rec", "channel"], 7.0, 14.0)
    return fits.select("rec", "channel", "aperiodic_offset", "aperiodic_exponent", "r2", F.size("peaks").alias("n_peaks")).join(alpha, ["rec", "channel"])


# eight sensors on a half sphere, their bad ones by a rule of five classes of recordings
SENSORS = [(float(np.cos(c) * np.cos(.3 + c / 12)), float(np.sin(c) * np.cos(.3 + c / 12)), float(np.sin(.3 + c / 12))) for c in range(8)]
X_ROWS = "x as (select rec, channel, block_id * 64 + i - 1 as i, samples[i]::double as v from (select rec, channel, block_id, samples, unnest(range(1, 65)) as i from signal) q)"


def spline_sql() -> str:
    rows = []
    for k in range(5):
        bad = np.array([(k + c) % 5 == 0 for c in range(8)])
        w = sl.spline_matrix(np.array(SENSORS), bad)
        rows += [f"({k}, {b}, {g}, {v!r}::double)" for b, r in zip(np.flatnonzero(bad), w.tolist()) for g, v in zip(np.flatnonzero(~bad), r)]
    return f""", {X_ROWS}, w as (select * from (values {', '.join(rows)}) t(k, bad, good, w)),
  full_ as (select rec from signal group by 1 having count(distinct channel) = 8),
  rp as (select x.rec, w.bad as channel, x.i, sum(w.w * x.v) as v from x join w on w.k = x.rec % 5 and w.good = x.channel join full_ on full_.rec = x.rec group by 1, 2, 3),
  fx as (select x.rec, x.channel, x.i, case when (x.rec + x.channel) % 5 = 0 then rp.v else x.v end as v from x join full_ on full_.rec = x.rec left join rp on rp.rec = x.rec and rp.channel = x.channel and rp.i = x.i)
  select rec, channel, round(sum(v * v), 6) as energy, round(max(v), 6) as peak from fx group by 1, 2"""


@query("sig5_spline_repair", with_roles(spline_sql(), "signal"))
def _(t):
    whole = t.signal.groupBy("rec").agg(F.count_distinct("channel").alias("n")).where("n = 8").select("rec")
    blocks = t.signal.join(whole, "rec")
    flags = blocks.select("rec", "channel", ((F.col("rec") + F.col("channel")) % 5 == 0).alias("bad")).distinct()
    place = t.spark.createDataFrame([(c, *p) for c, p in enumerate(SENSORS)], "channel long, x double, y double, z double")
    d = sl.spline_repair(blocks, flags, place, ["rec"], "channel")
    return d.groupBy("rec", "channel").agg(F.round(F.sum(F.aggregate("samples", F.lit(0.0), lambda s, v: s + v * v)), 6).alias("energy"),
                                           F.round(F.max(F.array_max("samples")), 6).alias("peak"))


def resample_sql(target: float) -> str:
    up, down, taps = rs.bank(SFREQ, target)
    half = taps.shape[1] // 2 - 1
    rows = ", ".join(f"({k}, {j - half}, {v!r}::double)" for k, r in enumerate(taps.tolist()) for j, v in enumerate(r))
    return f""", {X_ROWS}, n as (select rec, channel, max(i) as last from x group by 1, 2), h as (select * from (values {rows}) t(k, j, w)),
  e as (select rec, channel, i, v from x union all select a.rec, a.channel, -b.i, 2 * a.v - b.v from x a join x b on a.rec = b.rec and a.channel = b.channel and a.i = 0 and b.i between 1 and {half}
    union all select a.rec, a.channel, 2 * a.i - b.i, 2 * a.v - b.v from n join x a on a.rec = n.rec and a.channel = n.channel and a.i = n.last join x b on b.rec = a.rec and b.channel = a.channel and b.i between a.i - {half + 1} and a.i - 1),
  m as (select rec, channel, unnest(range(0, ((last + 1) * {up} + {down - 1}) // {down})) as m from n)
  select m.rec, m.channel, m.m as i, round(sum(h.w * e.v), 6) as v from m join h on h.k = m.m * {down} % {up} join e on e.rec = m.rec and e.channel = m.channel and e.i = m.m * {down} // {up} + h.j group by 1, 2, 3"""


@query("sig7_rational_resample", with_roles(resample_sql(96.0), "signal"))
def _(t):
    d = sg.resample(t.signal.drop("label"), ["rec", "channel"], B, SFREQ, 96.0)
    return sg.samples_long(d, ["rec", "channel"], B).select("rec", "channel", "i", F.round("v", 6).alias("v"))
