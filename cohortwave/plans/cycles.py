"""Cycle queries: recordings cut from the vectors, sampled at 500 Hz."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cycles as cy, signal as sg
from ..session import cut_lineage
from .bindings import with_roles
from .events import B
from .registry import query

KEYS = ["rec", "channel"]
SFREQ, IAF, FACTOR = 500.0, 10.0, 20     # 20 stored blocks per working block

X = """, x as (select rec, channel, block_id * 64 + i - 1 as i, samples[i]::double as v from (select rec, channel, block_id, samples, unnest(range(1, 65)) as i from signal) q),
  lg as (select *, lag(v) over (partition by rec, channel order by i) as pv from x), cr as (select rec, channel, cast(i as bigint) as i from lg where pv < 0 and v >= 0),
  bo as (select rec, channel, i as start_i, lead(i) over (partition by rec, channel order by i) as end_i from cr),
  cyc as (select rec, channel, start_i, end_i - start_i as len from bo where end_i is not null)"""
WAVE = X + """, wv as (select c.rec, c.channel, c.start_i, c.len, max(x.v) - min(x.v) as amp from cyc c join x on x.rec = c.rec and x.channel = c.channel and x.i >= c.start_i and x.i < c.start_i + c.len group by 1, 2, 3, 4),
  th as (select rec, channel, quantile_cont(amp, 0.1) as p from wv group by 1, 2),
  va as (select wv.*, len / 6.4e1 >= 6e-1 / 1.2e1 and len / 6.4e1 <= 1.4e0 / 1.2e1 and amp >= p as valid from wv join th on wv.rec = th.rec and wv.channel = th.channel)"""


def raw_cycles(t):
    d = t.signal.drop("label")
    c = cy.crossing_cycles(cy.crossings(d, KEYS, B), KEYS, B)
    return cy.cut_waves(c, d, KEYS, B)


@query("lag2_zero_crossings", with_roles(X + " select rec, channel, i from cr", "signal"))
def _(t):
    return cy.crossings(t.signal.drop("label"), KEYS, B).select(*KEYS, F.explode("cross").alias("i"))


@query("lag3_cycle_periods", with_roles(X + " select * from cyc", "signal"))
def _(t):
    c = cy.crossing_cycles(cy.crossings(t.signal.drop("label"), KEYS, B), KEYS, B)
    return c.select(*KEYS, "start_i", (F.col("end_i") - F.col("start_i")).alias("len"))


@query("win9_amplitude_threshold", with_roles(WAVE + " select rec, channel, start_i, len, round(amp, 6) as amp, valid from va", "signal"))
def _(t):
    v = cy.valid_cycles(cut_lineage(raw_cycles(t)), KEYS, 64.0, F.lit(12.0))
    return v.select(*KEYS, "start_i", "len", F.round("amp", 6).alias("amp"), "valid")


@query("sig16_cycle_stats", with_roles(WAVE + """ select rec, channel, count(*) as n_detected, count(*) filter (valid) as n_valid,
  round(1 - count(*) filter (valid) / count(*), 9) as rejection_rate, round(median(len / 6.4e1) filter (valid), 9) as median_period_s from va group by 1, 2""", "signal"))
def _(t):
    v = cut_lineage(cy.valid_cycles(cut_lineage(raw_cycles(t)), KEYS, 64.0, F.lit(12.0)))
    return cy.cycle_stats(v, KEYS).select(*KEYS, "n_detected", "n_valid", F.round("rejection_rate", 9).alias("rejection_rate"), F.round("median_period_s", 9).alias("median_period_s"))


@query("sig23_period_variability", with_roles(X + """, m as (select rec, channel, median(len) as md from cyc group by 1, 2)
  select c.rec, c.channel, start_i, round(abs(len - md) / md, 9) as period_variability from cyc c join m on c.rec = m.rec and c.channel = m.channel""", "signal"))
def _(t):
    c = cy.crossing_cycles(cy.crossings(t.signal.drop("label"), KEYS, B), KEYS, B).withColumn("len", F.col("end_i") - F.col("start_i"))
    return cy.period_variability(cut_lineage(c), KEYS).select(*KEYS, "start_i", F.round("period_variability", 9).alias("period_variability"))


@query("sig24_waveform_asymmetry", """ with w as (select vec_id, embedding as e, list_position(embedding, list_max(embedding)) as pk, list_position(embedding, list_min(embedding)) as tr from embeddings),
  s as (select *, abs(e[least(pk + 1, 64)]::double - e[greatest(pk - 1, 1)]) as sp, abs(e[least(tr + 1, 64)]::double - e[greatest(tr - 1, 1)]) as st from w)
  select vec_id, round(greatest(pk - 1, 1) / cast(64 - (pk - 1) as double), 9) as rise_decay_ratio, round(case when st > 1e-12 then sp / st end, 6) as sharpness_ratio from s""")
def _(t):
    rd, pt = cy.waveform_asymmetry(F.col("w"))
    d = t.embeddings.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("w"))
    return d.select("vec_id", F.round(rd, 9).alias("rise_decay_ratio"), F.round(pt, 6).alias("sharpness_ratio"))


@query("sig19_harmonic_profile", """ with z as (select vec_id, unnest(range(0, 64)) as j, unnest(embedding)::double as v from embeddings),
  f as (select vec_id, k, sqrt(sum(v * cos(2 * pi() * k * j / 6.4e1)) ** 2 + sum(v * sin(2 * pi() * k * j / 6.4e1)) ** 2) as a from z cross join (select unnest([1, 2, 3, 4, 5]) as k) group by 1, 2)
  select vec_id, k - 1 as pos, round(a / max(a) filter (k = 1) over (partition by vec_id), 6) as ratio from f""")
def _(t):
    d = t.embeddings.select("vec_id", F.posexplode(cy.harmonic_profile(F.col("embedding"), 5)).alias("pos", "ratio"))
    return d.select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("ratio", 6).alias("ratio"))


@query("sig21_residual_energy", """ with z as (select vec_id, unnest(range(0, 64)) as j, unnest(embedding)::double as v from embeddings),
  m as (select *, avg(v) over (partition by vec_id) as e from z)
  select vec_id, round(sum((v - e) * (v - e)), 9) as detail_energy, round(sum(e * e), 9) as harmonic_energy, round(sum(e * e) / sum((v - e) * (v - e)), 6) as hi_ratio from m group by 1""")
def _(t):
    """The estimate here is each vector's own mean level."""
    d = t.embeddings.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("wave_p"))
    mean = F.aggregate("wave_p", F.lit(0.0), lambda s, v: s + v) / F.size("wave_p")
    d = d.withColumn("m", mean).withColumn("estimate", F.transform("wave_p", lambda v: F.col("m")))
    return cy.split_energies(d).select("vec_id", F.round("detail_energy", 9).alias("detail_energy"), F.round("harmonic_energy", 9).alias("harmonic_energy"), F.round("hi_ratio", 6).alias("hi_ratio"))


# --- the narrowband chain ----------------------------------------------------


def locked(t):
    """Phase-locked cycles of the 8-12 Hz band; boundaries on the narrowband
    copy, waves cut from the broadband blocks."""
    broad = cut_lineage(sg.reblock(t.long_signal.drop("label"), KEYS, FACTOR), "broad")
    nb = sg.fir_filter(broad, KEYS, sg.fir_taps(SFREQ, IAF - 2, IAF + 2))
    c = cy.phase_locked_cycles(cy.crossings(nb, KEYS, B * FACTOR), KEYS, 50)     # 64 000 samples to a chunk
    return broad, c


def valid_of(t):
    broad, c = locked(t)
    w = cut_lineage(cy.cut_waves(c, broad, KEYS, B * FACTOR), "waves")
    return cut_lineage(cy.valid_cycles(w, KEYS, SFREQ, F.lit(IAF)), "valid")


def features_of(t):
    v = valid_of(t)
    st = cut_lineage(cy.cycle_stats(v, KEYS), "stats")
    return cut_lineage(cy.cycle_features(cy.psr(v, KEYS, strict=False).where("wave_p is not null"), st, KEYS), "features"), st


# one step of all recordings at a time: the crossing nearest to the last boundary plus the median of the last five gaps
LOCKED = """, st(rec, xs, t, gaps, t0) as (select rec, xs, xs[1], []::bigint[], null::bigint from xs
    union all select rec, xs, nxt, list_append(gaps, nxt - t)[-5:], t from (select *, list_reduce(later, lambda a, b: case when abs(b - target) < abs(a - target) then b else a end) as nxt
      from (select *, t + coalesce(list_aggregate(gaps, 'median'), later[1] - t) as target from (select *, list_filter(xs, lambda x: x > t) as later from st) u where len(later) > 0) v) w)"""


@query("win4_locked_crossings", with_roles(""", x as (select rec, block_id * 64 + i - 1 as i, samples[i]::double as v from (select rec, block_id, samples, unnest(range(1, 65)) as i from long_signal) q),
  z as (select *, lag(v) over (partition by rec order by i) as pv from x), xs as (select rec, list(cast(i as bigint) order by i) as xs from z where pv < 0 and v >= 0 group by 1)""" + LOCKED
    + " select rec, 0::bigint as channel, t0 as start_i, t as end_i from st where t0 is not null", "long_signal").replace("with ", "with recursive ", 1))
def _(t):
    """The scan over the crossings of the unfiltered signal, in chunks of two blocks."""
    return cy.phase_locked_cycles(cy.crossings(t.long_signal.drop("label"), KEYS, B), KEYS, 2)


@query("win4_phase_locked_boundaries")
def _(t):
    return locked(t)[1]


@query("sig16_valid_cycles")
def _(t):
    return valid_of(t).drop("wave")


@query("sig17_dft_resample", """with kr as (select n, j, (1 + 2 * sum(cos(2 * pi() * k * (n / 5e1 - j / 6.4e1)))) / 6.4e1 as w from (select unnest(range(0, 50)) as n) a cross join (select unnest(range(0, 64)) as j) b
   cross join (select unnest(range(1, 25)) as k) c group by 1, 2), z as (select vec_id, unnest(range(0, 64)) as j, unnest(embedding)::double as v from embeddings)
  select vec_id, n::int as phase, round(sum(w * v), 6) as v from z join kr on z.j = kr.j group by 1, 2""")
def _(t):
    """Every vector resampled to 50 points."""
    d = t.embeddings.select("vec_id", cy.dft_resample(F.col("embedding"), F.lit(50)).alias("wave"))
    return d.select("vec_id", F.posexplode("wave").alias("phase", "v")).withColumn("v", F.round("v", 6))


@query("sig18_psr_table")
def _(t):
    """Channels whose modal cycle is too short have their P and no wave."""
    return cy.psr(valid_of(t), KEYS, strict=False).select(*KEYS, "start_i", "P", "wave_p")


def wavelet_sql(source: str, levels: int = 10) -> str:
    """Subbands a1, d1, .. of the signals (label, i, ph, v) of `source`, level by level as sums over taps, and the estimate
    e0 that comes back from the deepest approximation. A level holds the signals that are deep enough."""
    taps = cy.DB8[::-1]
    high = [v * (-1) ** j for j, v in enumerate(taps[::-1])]
    out = [f"t as (select * from (values {', '.join(f'({j}, {lo!r}::double, {hi!r}::double)' for j, (lo, hi) in enumerate(zip(taps, high)))}) t(j, lo, hi))",
           f"a0 as ({source})", "sz as (select label, count(distinct i) as n0, greatest(floor(log2(count(distinct i) / 1.5e1)), 1) as depth from a0 group by 1)"]
    for k in range(1, levels + 1):
        n = f"cast(ceil(n0 / {2 ** (k - 1)}e0) as bigint)"
        out.append(f"""b{k} as (select o.label, o.o as i, a.ph, sum(t.lo * a.v) as a, sum(t.hi * a.v) as d from (select label, {n} as n, unnest(range(0, ({n} + 1) // 2)) as o from sz where depth >= {k}) o
          cross join t join a{k - 1} a on a.label = o.label and a.i = least((2 * o.o + 8 - t.j + 16 * (o.n + o.n % 2)) % (o.n + o.n % 2), o.n - 1) group by 1, 2, 3)""")
        out.append(f"a{k} as (select label, i, ph, a as v from b{k})")
    for k in range(levels, 0, -1):
        n = f"cast(ceil(n0 / {2 ** (k - 1)}e0) as bigint)"
        deeper = f" union all select * from e{k}" if k < levels else ""
        out.append(f"u{k} as (select a.* from a{k} a join sz on sz.label = a.label where depth = {k}{deeper})")
        out.append(f"""e{k - 1} as (select label, i, ph, sum(v) as v from (select u.label, (2 * u.i + 8 - t.j + 16 * ({n} + {n} % 2)) % ({n} + {n} % 2) as i, u.ph, t.lo * u.v as v, {n} as n from u{k} u join sz on sz.label = u.label cross join t) x
          where i < n group by 1, 2, 3)""")
    return "with " + ",\n".join(out)


BY_LABEL = """select label, row_number() over (partition by label, ph order by vec_id) - 1 as i, ph, v from (select label, vec_id, unnest(range(0, 64)) as ph, unnest(embedding)::double as v from embeddings) x"""


def label_cycles(t):
    """All vectors of one label value taken as the cycles of one channel."""
    from ..functions.ordered import dense_index
    d = t.embeddings.select("label", "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("wave_p"))
    return cut_lineage(dense_index(d, ["label"], F.col("vec_id"), "vec_id", name="cycle_idx").drop("cycle_idx_n"))


@query("sig20_harmonic_estimate", wavelet_sql(BY_LABEL) + """, id as (select label, vec_id, row_number() over (partition by label order by vec_id) - 1 as i from embeddings)
  select id.label, vec_id, round(sum((a.v - e.v) * (a.v - e.v)), 6) as detail_energy, round(sum(e.v * e.v), 6) as harmonic_energy, round(case when sum((a.v - e.v) * (a.v - e.v)) > 1e-12 then sum(e.v * e.v) / sum((a.v - e.v) * (a.v - e.v)) end, 6) as hi_ratio
  from id join a0 a on a.label = id.label and a.i = id.i join e0 e on e.label = a.label and e.i = a.i and e.ph = a.ph group by 1, 2""")
def _(t):
    e = cy.split_energies(cy.harmonic_estimate(label_cycles(t), ["label"]))
    return e.select("label", "vec_id", F.round("detail_energy", 6).alias("detail_energy"), F.round("harmonic_energy", 6).alias("harmonic_energy"), F.round("hi_ratio", 6).alias("hi_ratio"))


@query("sig22_subband_energy", wavelet_sql(BY_LABEL) + " select * from (" + " union all ".join(
    f"select label, {k} as level, 'd' as band, round(sum(d * d), 6) as energy from b{k} group by 1 union all select b.label, {k}, 'a', round(sum(a * a), 6) from b{k} b join sz on sz.label = b.label where depth = {k} group by 1" for k in range(1, 11)) + ") x")
def _(t):
    """Energy of every subband."""
    d = cy.cycle_subbands(label_cycles(t), ["label"])
    return d.groupBy("label", "level", "band").agg(F.round(F.sum(F.aggregate("v", F.lit(0.0), lambda s, v: s + v * v)), 6).alias("energy"))


@query("sig22_reconstruction_error", "select distinct cast(floor(vec_id / 100) as bigint) as label, true as ok from embeddings")
def _(t):
    """Energy of estimate and residual adds up to the energy of the cycles when
    the cycle count is even (orthogonal split)."""
    from ..functions.ordered import dense_index
    d = t.embeddings.select((F.floor(F.col("vec_id") / 100)).alias("label"), "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("wave_p"))
    d = cut_lineage(dense_index(d, ["label"], F.col("vec_id"), "vec_id", name="cycle_idx").drop("cycle_idx_n"))
    e = cy.split_energies(cy.harmonic_estimate(d, ["label"]))
    total = F.aggregate("wave_p", F.lit(0.0), lambda s, v: s + v * v)
    g = e.groupBy("label").agg(F.sum(total).alias("a"), F.sum(F.col("detail_energy") + F.col("harmonic_energy")).alias("b"))
    return g.select("label", (F.abs(F.col("a") - F.col("b")) < 1e-6).alias("ok"))


@query("sig25_channel_features")
def _(t):
    f, st = features_of(t)
    return cy.channel_features(f, st, KEYS, 40)


@query("sig26_subject_features")
def _(t):
    f, st = features_of(t)
    return cy.subject_features(f, st, ["rec"], "channel", 40)[0]


@query("sig26_subject_status")
def _(t):
    f, st = features_of(t)
    return cy.subject_features(f, st, ["rec"], "channel", 40)[1]
