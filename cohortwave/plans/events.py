"""Annotation, window and sample-domain queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ordered
from ..operators import aggregates as ag, cohort as co, events as ev, signal as sg
from .bindings import with_roles
from .registry import query

B = 64            # samples per stored block

GAP = """, g as (select *, lead(onset_s) over (partition by rec order by onset_s, event_id) as nx from annotations),
  m as (select *, coalesce(nx - onset_s >= 1.2e4, false) as kept from g where regexp_matches(description, 'S\\s*4\\s*$'))"""


@query("lag1_marker_gap", with_roles(GAP + " select rec, event_id, round(nx - onset_s, 6) as gap_s, kept from m", "annotations"))
def _(t):
    return ev.marker_onsets(t.annotations, ["rec"], 4, 12000.0, 86400.0).select("rec", "event_id", F.round("gap_s", 6).alias("gap_s"), "kept")


@query("lag1_trial_counts", with_roles(GAP + " select rec, count(*) filter (kept) as n_used, count(*) filter (not kept) as n_skipped from m group by rec", "annotations"))
def _(t):
    return ev.marker_counts(ev.marker_onsets(t.annotations, ["rec"], 4, 12000.0, 86400.0), ["rec"])


CLOSED = """, tm as (select rec, max(onset_s) as tmax from annotations group by rec),
  lb as (select rec, onset_s, event_id, trim(split_part(description, '/', 2)) as l from annotations),
  f as (select rec, min((onset_s, event_id)) as a10 from lb where l = 'S 10' group by rec),
  s1 as (select f.rec, min((onset_s, event_id)) as a1 from lb join f on lb.rec = f.rec where l = 'S  1' and (onset_s, event_id) > a10 group by f.rec),
  st as (select f.rec, a10, case when a1[1] - a10[1] <= 2e5 then a1[1] else a10[1] end as start_s from f left join s1 on f.rec = s1.rec),
  en as (select st.rec, min(onset_s) as e from lb join st on lb.rec = st.rec where l = 'S 11' and (onset_s, event_id) > a10 and onset_s > start_s group by st.rec),
  cw as (select st.rec, start_s, coalesce(e, tmax) as end_s from st left join en on st.rec = en.rec join tm on tm.rec = st.rec where coalesce(e, tmax) - start_s >= 1e4)"""


def closed(t):
    tmax = t.annotations.groupBy("rec").agg(F.max("onset_s").alias("tmax"))
    return ev.closed_window(t.annotations, ["rec"], tmax, 2e5, 1e4), tmax


@query("win2_closed_window", with_roles(CLOSED + " select rec, round(start_s, 6) as start_s, round(end_s, 6) as end_s from cw", "annotations"))
def _(t):
    w, _tmax = closed(t)
    return w.select("rec", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


@query("win3_open_window", with_roles("""select rec, 0e0 as start_s, round(min(onset_s), 6) as end_s from annotations
  where description like '%/S 10' group by rec having min(onset_s) >= 2e4""", "annotations"))
def _(t):
    return ev.open_window(t.annotations, ["rec"], 2e4).withColumn("end_s", F.round("end_s", 6))


@query("sig14_excerpt_choice", with_roles(CLOSED + """ select tm.rec, case when start_s is not null and tm.rec % 2 = 0 then 'eyes_closed' else 'blind_crop' end as method,
  round(case when start_s is not null and tm.rec % 2 = 0 then start_s else 0e0 end, 2) as tmin_s,
  round(case when start_s is not null and tm.rec % 2 = 0 then least(end_s, tmax) else least(1.2e2, tmax) end, 2) as tmax_s from tm left join cw on tm.rec = cw.rec""", "annotations"))
def _(t):
    w, tmax = closed(t)
    return ev.excerpt_choice(tmax, w, ["rec"], F.col("rec") % 2 == 0)


@query("src6_required_window", with_roles(CLOSED + " select rec, round(start_s, 3) as tmin_s, round(end_s, 3) as tmax_s from cw", "annotations"))
def _(t):
    from ..sources.tables import required_window
    w, _tmax = closed(t)
    side = w.select("rec", F.struct(F.col("start_s").alias("tmin_s"), F.col("end_s").alias("tmax_s")).alias("IAFWindow"))
    return required_window(side).select("rec", F.round("tmin_s", 3).alias("tmin_s"), F.round("tmax_s", 3).alias("tmax_s"))


EPOCHS = """, on_ as (select rec, event_id, cast(round_even(onset_s / 3.6e3 * 8e0, 0) as bigint) as s0 from annotations where description like '%S  4'),
  sm as (select rec, block_id * 64 + i - 1 as i, samples[i] as v from (select rec, block_id, samples, unnest(range(1, 65)) as i from long_signal) x)"""


@query("jn10_event_epochs", with_roles(EPOCHS + """ select o.rec, event_id, s0, count(*) as n, round(sum(v::double), 6) as total, round(sum((sm.i - s0) * v::double), 6) as moment
  from on_ o join sm on sm.rec = o.rec and sm.i between s0 and s0 + 31 group by 1, 2, 3 having count(*) = 32""", "annotations", "long_signal"))
def _(t):
    e = epochs_of(t)
    tot = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return e.select("rec", "event_id", "s0", F.size("samples").cast("bigint").alias("n"),
                    F.round(tot(F.transform("samples", lambda v: v.cast("double"))), 6).alias("total"),
                    F.round(tot(F.transform("samples", lambda v, i: v.cast("double") * i)), 6).alias("moment"))


def epochs_of(t):
    on = t.annotations.where(F.col("description").endswith("S  4")).select("rec", "event_id", (F.col("onset_s") / 3600.0).alias("onset_s"))
    return ev.epochs(on, t.long_signal.drop("label"), ["rec"], 8.0, 32, B)


@query("src5_pick_and_crop", with_roles("""
  , sm as (select rec, channel, block_id * 64 + i - 1 as i, samples[i] as v from (select rec, channel, block_id, samples, unnest(range(1, 65)) as i from signal where channel in (1, 3, 5)) x)
  select rec, channel, count(*) as n, round(sum(v::double), 6) as total from sm where i between 50 and 199 group by 1, 2""", "signal"))
def _(t):
    from ..sources.tables import pick_and_crop
    d = pick_and_crop(t.signal.drop("label"), "channel", [1, 3, 5], B, 50, 199)
    return d.groupBy("rec", "channel").agg(F.sum(F.size("samples")).alias("n"),
        F.round(F.sum(F.aggregate("samples", F.lit(0.0), lambda s, v: s + v.cast("double"))), 6).alias("total"))


WIN_ = """, x as (select rec, channel, floor((block_id * 64 + i - 1) / 48) as w, samples[i]::double as v from (select rec, channel, block_id, samples, unnest(range(1, 65)) as i from signal) x),
  c as (select rec, channel, w, max(v) - min(v) as ptp, count(*) as n from x group by 1, 2, 3), b as (select rec, w, bool_or(ptp > 7e-1) as bad, max(n) as n from c group by 1, 2)"""


@query("sig1_artifact_fraction", with_roles(WIN_ + " select rec, round(avg(case when bad then 1e0 else 0e0 end), 9) as artifact_frac, count(*) as n_windows from b where n = 48 group by rec", "signal"))
def _(t):
    return sg.artifact_fraction(t.signal, ["rec"], "channel", B, 48, 0.7).withColumn("artifact_frac", F.round("artifact_frac", 9))


@query("sig2_artifact_segments", with_roles(WIN_ + " select rec, cast(w as bigint) as win_id, round(w * 48 / 6.4e1, 6) as onset_s, round(n / 6.4e1, 6) as duration_s from b where bad", "signal"))
def _(t):
    return sg.artifact_segments(t.signal, ["rec"], "channel", B, 48, 0.7, 64.0).withColumn("onset_s", F.round("onset_s", 6))


@query("sig2_usable_duration", with_roles(WIN_ + " select rec, round(max(w * 48 + n - 1) / 6.4e1 - sum(case when bad then n else 0 end) / 6.4e1, 6) as usable_s, count(*) filter (bad) as n_bad_segments from b group by rec", "signal"))
def _(t):
    return sg.usable_duration(t.signal, ["rec"], "channel", B, 48, 0.7, 64.0).withColumn("usable_s", F.round("usable_s", 6))


@query("jn11_interval_mask", with_roles(WIN_ + " select x.rec, x.channel, count(*) as n_kept, round(sum(v), 6) as total from x join b on x.rec = b.rec and x.w = b.w where not b.bad group by 1, 2", "signal"))
def _(t):
    seg = sg.artifact_segments(t.signal, ["rec"], "channel", B, 48, 0.7, 64.0)
    d = sg.mask_samples(t.signal, seg, ["rec"], "channel", B, 48)
    return d.groupBy("rec", "channel").agg(F.sum(F.size("part")).alias("n_kept"),
        F.round(F.sum(F.aggregate("part", F.lit(0.0), lambda s, v: s + v.cast("double"))), 6).alias("total"))


# sensor positions: the first three samples of each channel's first block
POS = """, p as (select rec, channel, max(samples[1]::double) as x, max(samples[2]::double) as y, max(samples[3]::double) as z from signal where block_id = 0 group by 1, 2),
  nbp as (select a.rec, a.channel, b.channel as nb, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) as d from p a join p b on a.rec = b.rec and a.channel <> b.channel),
  nb as (select * from (select *, row_number() over (partition by rec, channel order by d, nb) as k from nbp) where k <= 3),
  x as (select rec, channel, block_id * 64 + i as i, samples[i]::double as v from (select rec, channel, block_id, samples, unnest(range(1, 65)) as i from signal) q),
  cv as (select rec, channel, ln(var_pop(v) + 1e-30) as lv, stddev_pop(v) as sd from x group by 1, 2),
  md as (select *, median(lv) over (partition by rec) as med from cv),
  mz as (select *, median(abs(lv - med)) over (partition by rec) * 1.4826e0 + 1e-30 as mad from md),
  nm as (select nb.rec, nb.channel, x.i, avg(x.v) as y from nb join x on x.rec = nb.rec and x.channel = nb.nb group by 1, 2, 3),
  co as (select nm.rec, nm.channel, corr(x.v, nm.y) as r from nm join x on x.rec = nm.rec and x.channel = nm.channel and x.i = nm.i group by 1, 2),
  fl as (select mz.rec, mz.channel, sd < 1e-8 as flat, abs((lv - med) / mad) > 3e0 as outlying, r from mz left join co on co.rec = mz.rec and co.channel = mz.channel),
  fb as (select *, not (flat or outlying) and coalesce(r < -5e-2, false) as low_corr, flat or outlying or coalesce(r < -5e-2, false) as bad from fl)"""


def positions(t):
    at = lambda i: F.max(F.col("samples")[i].cast("double"))
    return t.signal.where("block_id = 0").groupBy("rec", "channel").agg(at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def flagged(t):
    nb = co.nearest_sensors(positions(t), ["rec"], 3)
    return sg.bad_channels(t.signal, nb, ["rec"], "channel", z_limit=3.0, min_corr=-0.05), nb


@query("sig3_bad_channels", with_roles(POS + " select rec, channel, flat, outlying, low_corr, round(r, 6) as r, bad from fb", "signal"))
def _(t):
    return flagged(t)[0].withColumn("r", F.round("r", 6))


@query("sig3_bad_channel_counts", with_roles(POS + " select rec, count(*) filter (bad) as n_bad_channels, count(*) filter (bad and channel in (5, 6, 7)) as occipital_bads from fb group by rec", "signal"))
def _(t):
    return sg.bad_channel_counts(flagged(t)[0], ["rec"], "channel", [5, 6, 7])


@query("sig4_average_reference", with_roles(POS + """, mm as (select rec, i, avg(v) as m from x group by 1, 2)
  select x.rec, x.channel, round(sum((v - m) * (v - m)), 6) as energy, round(max(v - m), 6) as peak from x join mm on x.rec = mm.rec and x.i = mm.i group by 1, 2""", "signal"))
def _(t):
    d = sg.average_reference(t.signal, ["rec"], "channel")
    return d.groupBy("rec", "channel").agg(F.round(F.sum(F.aggregate("samples", F.lit(0.0), lambda s, v: s + v * v)), 6).alias("energy"),
                                           F.round(F.max(F.array_max("samples")), 6).alias("peak"))


FIXED = POS + """, gw as (select nb.rec, nb.channel, nb.nb, 1 / (d * d) as w from nb join fb on fb.rec = nb.rec and fb.channel = nb.channel and fb.bad join fb g on g.rec = nb.rec and g.channel = nb.nb and not g.bad),
  rp as (select gw.rec, gw.channel, x.i, sum(w * v) / sum(w) as v from gw join x on x.rec = gw.rec and x.channel = gw.nb group by 1, 2, 3),
  fx as (select x.rec, x.channel, x.i, case when fb.bad then rp.v else x.v end as v from x join fb on fb.rec = x.rec and fb.channel = x.channel left join rp on rp.rec = x.rec and rp.channel = x.channel and rp.i = x.i)"""


@query("sig5_repair_bad_channels", with_roles(FIXED + " select rec, channel, round(sum(v * v), 6) as energy from fx group by 1, 2", "signal"))
def _(t):
    flags, nb = flagged(t)
    d = sg.interpolate_bad(t.signal, flags, nb, ["rec"], "channel")
    return d.groupBy("rec", "channel").agg(F.round(F.sum(F.aggregate("samples", F.lit(0.0), lambda s, v: s + v * v)), 6).alias("energy"))


@query("sig6_fir_lowpass", with_roles(""", x as (select rec, block_id * 64 + i - 1 as i, samples[i]::double as v from (select rec, block_id, samples, unnest(range(1, 65)) as i from long_signal) q),
  h as (select unnest([-2, -1, 0, 1, 2]) as k, unnest([1e-1, 2e-1, 4e-1, 2e-1, 1e-1]) as w), n as (select rec, max(i) as last from x group by 1),
  e as (select * from x union all select a.rec, -b.i, 2 * a.v - b.v from x a join x b on a.rec = b.rec and a.i = 0 and b.i in (1, 2)
    union all select a.rec, 2 * a.i - b.i, 2 * a.v - b.v from n join x a on a.rec = n.rec and a.i = n.last join x b on a.rec = b.rec and b.i in (a.i - 1, a.i - 2)),
  y as (select e.rec, e.i + h.k as i, sum(h.w * e.v) as v from e cross join h group by 1, 2)
  select y.rec, cast(y.i as bigint) as i, round(y.v, 6) as v from y join n on n.rec = y.rec where y.i between 0 and last""", "long_signal"))
def _(t):
    import numpy as np
    d = sg.fir_filter(t.long_signal.drop("label"), ["rec", "channel"], np.array([0.1, 0.2, 0.4, 0.2, 0.1]))
    return sg.samples_long(d, ["rec"], B).select("rec", "i", F.round("v", 6).alias("v"))


def fir_sql(taps, block: int) -> str:
    """Energy per block of the zero-phase filter with odd reflection, taps written out."""
    half = len(taps) // 2
    return f""", x as (select rec, block_id * 64 + i - 1 as i, samples[i]::double as v from (select rec, block_id, samples, unnest(range(1, 65)) as i from long_signal) q),
  n as (select rec, max(i) as last from x group by 1), h as (select unnest(range(-{half}, {half + 1})) as k, unnest([{", ".join(f"{w!r}::double" for w in taps.tolist())}]) as w),
  e as (select rec, i, v from x union all select a.rec, -b.i, 2 * a.v - b.v from x a join x b on a.rec = b.rec and a.i = 0 and b.i between 1 and {half}
    union all select a.rec, 2 * a.i - b.i, 2 * a.v - b.v from n join x a on a.rec = n.rec and a.i = n.last join x b on b.rec = a.rec and b.i between a.i - {half} and a.i - 1),
  y as (select e.rec, e.i + h.k as i, sum(h.w * e.v) as v from e cross join h group by 1, 2)
  select y.rec, cast(floor(y.i / {block}e0) as bigint) as block_id, round(sum(y.v * y.v), 6) as energy from y join n on n.rec = y.rec where y.i between 0 and last group by 1, 2"""


ALPHA_TAPS, LINE_TAPS = sg.fir_taps(500.0, 8.0, 12.0), sg.fir_taps(250.0, 49.5, 50.5, stop=True, transition=1.0)


@query("sig6_narrowband", with_roles(fir_sql(ALPHA_TAPS, 64 * 20), "long_signal"))
def _(t):
    """Band-pass 8-12 Hz at 500 Hz over re-blocked recordings, then energy."""
    d = sg.reblock(t.long_signal.drop("label"), ["rec", "channel"], 20)
    d = sg.fir_filter(d, ["rec", "channel"], ALPHA_TAPS)
    return d.select("rec", "block_id", F.round(F.aggregate("samples", F.lit(0.0), lambda s, v: s + v * v), 6).alias("energy"))


@query("sig6_notch", with_roles(fir_sql(LINE_TAPS, 64 * 20), "long_signal"))
def _(t):
    d = sg.reblock(t.long_signal.drop("label"), ["rec", "channel"], 20)
    d = sg.notch(d, ["rec", "channel"], 250.0)
    return d.select("rec", "block_id", F.round(F.aggregate("samples", F.lit(0.0), lambda s, v: s + v * v), 6).alias("energy"))


@query("sig7_decimate", with_roles(""", x as (select rec, channel, block_id * 64 + i - 1 as i, samples[i]::double as v from (select rec, channel, block_id, samples, unnest(range(1, 65)) as i from signal) q)
  select rec, channel, count(*) as n, round(sum(v), 6) as total from x where i % 5 = 0 group by 1, 2""", "signal"))
def _(t):
    d = sg.decimate(t.signal.drop("label"), ["rec", "channel"], B, 5)
    return d.groupBy("rec", "channel").agg(F.sum(F.size("samples")).alias("n"),
        F.round(F.sum(F.aggregate("samples", F.lit(0.0), lambda s, v: s + v.cast("double"))), 6).alias("total"))


@query("win7_tied_ranks", "select l_returnflag, l_quantity as v, count(*) as n, avg(r) + (count(*) - 1) / 2e0 as rank from (select l_returnflag, l_quantity, rank() over (partition by l_returnflag order by l_quantity) as r from lineitem) group by 1, 2")
def _(t):
    c = ordered.bucketed_counts(t.lineitem, ["l_returnflag"], "l_quantity")
    return c.select("l_returnflag", F.col("l_quantity").alias("v"), F.col("n_at").alias("n"), ordered.tied_rank_column().alias("rank"))


@query("st14_percentiles", """select l_returnflag, count(*) as n, round(quantile_cont(l_extendedprice, 0.025), 6) as lo, round(quantile_cont(l_extendedprice, 0.5), 6) as mid,
  round(quantile_cont(l_extendedprice, 0.9), 6) as hi from lineitem group by 1""")
def _(t):
    q = ordered.exact_percentiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"lo": 0.025, "mid": 0.5, "hi": 0.9})
    return q.select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in ("lo", "mid", "hi")])


H = "('0x' || substr(md5({}), 1, 12))::bigint"


@query("lim3_seeded_sample", f"select l_returnflag, l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_returnflag order by {H.format(chr(39) + '7|' + chr(39) + ' || l_orderkey || ' + chr(39) + '-' + chr(39) + ' || l_linenumber || ' + chr(39) + '-' + chr(39) + ' || l_partkey')}, l_orderkey || '-' || l_linenumber || '-' || l_partkey) as r from lineitem) where r <= 200")
def _(t):
    d = t.lineitem.withColumn("rid", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    return ag.sample_per_group(d, ["l_returnflag"], "rid", 200, 7).select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey")


@query("agg10_fixed_count_summary", f"""select event_type, round(median(value), 6) as median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) as iqr from
  (select *, row_number() over (partition by event_type order by {H.format("'20260809|' || event_id")}, event_id) as r from events) where r <= 200 group by 1""")
def _(t):
    g = ag.fixed_count_summary(t.events, ["event_type"], "event_id", "value", 200, 20260809, strict=False)
    return g.select("event_type", F.round("median", 6).alias("median"), F.round("iqr", 6).alias("iqr"))


@query("agg11_across_channels", with_roles(""", m as (select rec, channel, median(v) as m from (select rec, channel, unnest(samples)::double as v from signal) q group by 1, 2)
  select rec, count(*) as n_channels, round(median(m), 6) as median, round(quantile_cont(m, 0.75) - quantile_cont(m, 0.25), 6) as iqr from m group by 1""", "signal"))
def _(t):
    v = t.signal.select("rec", "channel", F.explode("samples").alias("f")).select("rec", "channel", F.col("f").cast("double").alias("v"))
    med = ordered.exact_percentiles(v, ["rec", "channel"], "v", {"median": 0.5})
    return ag.across_channels(med, ["rec"]).select("rec", "n_channels", F.round("median", 6).alias("median"), F.round("iqr", 6).alias("iqr"))


@query("agg12_mean_iqr", "select event_type, round(avg(value), 6) as mean, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) as iqr from events group by 1")
def _(t):
    return ag.mean_and_iqr(t.events, ["event_type"], "value").select("event_type", F.round("mean", 6).alias("mean"), F.round("iqr", 6).alias("iqr"))


@query("agg13_descriptives", "select c_mktsegment, count(c_acctbal) as n, round(avg(c_acctbal), 4) as mean, round(stddev_samp(c_acctbal), 4) as std, round(median(c_acctbal), 4) as median from customer group by 1")
def _(t):
    return ag.describe(t.customer, ["c_mktsegment"], "c_acctbal").select("c_mktsegment", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "median")])


@query("agg18_metric_ranges", with_roles(" select 'n_bad_channels' as metric, min(n_bad_channels)::double as lo, max(n_bad_channels)::double as hi from sidecars union all select 'artifact_frac', min(artifact_frac), max(artifact_frac) from sidecars", "sidecars"))
def _(t):
    return ag.metric_ranges(t.sidecars, ["n_bad_channels", "artifact_frac"])


@query("agg20_resample_summary", """select event_type, count(*) as n_resamples, round(quantile_cont(value, 0.05), 6) as p5, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95,
  round(avg(case when value > 4e1 then 1e0 else 0e0 end), 6) as frac_above_reference, round(avg(case when value < 2e1 then 1e0 else 0e0 end), 6) as frac_below_chance from events group by 1""")
def _(t):
    d = ag.resample_summary(t.events, ["event_type"], "value", 40.0, 20.0)
    return d.select("event_type", "n_resamples", *[F.round(c, 6).alias(c) for c in ("p5", "p50", "p95", "frac_above_reference", "frac_below_chance")])


@query("agg21_compare_configs", "select lang, count(*) as n, round(avg(n_chars), 6) as mean, round(median(n_chars), 6) as median, round(stddev_samp(n_chars), 6) as std, min(n_chars) as min, max(n_chars) as max from documents group by 1")
def _(t):
    d = ag.compare_configs(t.documents, "lang", "n_chars")
    return d.select("lang", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round("std", 6).alias("std"), "min", "max")


@query("agg21_paired_delta", with_roles("""select count(*) as n_pairs, round(avg(a - b), 6) as mean_delta from (select subject, max(artifact_frac) filter (task = 'rest') as a, max(artifact_frac) filter (task = 'sternberg') as b
  from sidecars group by 1) where a is not null and b is not null""", "sidecars"))
def _(t):
    return ag.paired_delta(t.sidecars, "subject", "task", "artifact_frac", "rest", "sternberg").withColumn("mean_delta", F.round("mean_delta", 6))


@query("agg23_range_and_median", "select min(c_acctbal) as min, max(c_acctbal) as max, round(median(c_acctbal), 6) as median from customer")
def _(t):
    q = ordered.exact_percentiles(t.customer, [], "c_acctbal", {"median": 0.5})
    return t.customer.agg(F.min("c_acctbal").alias("min"), F.max("c_acctbal").alias("max")).crossJoin(F.broadcast(q.select(F.round("median", 6).alias("median"))))  # 1 x 1 row


# names for the eight channels of a recording
CHANNEL_NAMES = ["Fp1", "Fz", "Cz", "C3", "P7", "Oz", "T8", "POz"]


def ch_name(channel):
    return F.element_at(F.array(*[F.lit(c) for c in CHANNEL_NAMES]), (channel + 1).cast("int"))
