"""Test, multiplicity and resampling queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shape import record_array
from ..functions import text as tx
from ..operators import resample as rs, stattests as st
from ..session import cut_lineage
from .bindings import with_roles
from .registry import query

FLAGS = ["A", "N", "R"]
METRICS = ["l_quantity", "l_extendedprice", "l_discount"]


def hash_sql(*parts: str) -> str:
    """The 48-bit hash in the other engine."""
    return "('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 12))::bigint"


def metrics_long(t):
    return t.lineitem.select("l_returnflag", F.explode(record_array(["metric", "value"], *[(m, F.col(m)) for m in METRICS])).alias("u")).select("l_returnflag", "u.*")


KW = "with l as (" + " union all ".join(f"select l_returnflag as g, '{m}' as metric, {m} as v from lineitem" for m in METRICS) + """),
  r as (select metric, g, v, rank() over (partition by metric order by v) + (count(*) over (partition by metric, v) - 1) / 2e0 as rk, count(*) over (partition by metric, v) as t from l),
  a as (select metric, g, count(*)::double as n, sum(rk) as s from r group by 1, 2), tt as (select metric, count(*)::double as n, sum(t::double * t - 1) as ties from r group by 1),
  h as (select tt.metric, tt.n, (12e0 / (tt.n * (tt.n + 1)) * sum(a.s * a.s / a.n) - 3 * (tt.n + 1)) / (1 - max(ties) / (tt.n * tt.n * tt.n - tt.n)) as h from a join tt on a.metric = tt.metric group by tt.metric, tt.n)"""


@query("st1_kruskal_wallis", KW + " select metric, n::bigint as n, 3 as k, round(h, 6) as statistic, round((h - 2) / (n - 3), 9) as effect_size, round(exp(-h / 2), 6) as p_value from h")
def _(t):
    d = st.kruskal(metrics_long(t), ["metric"], "l_returnflag", "value", FLAGS)
    return d.select("metric", "n", "k", F.round("statistic", 6).alias("statistic"), F.round("effect_size", 9).alias("effect_size"), F.round("p_value", 6).alias("p_value"))


@query("st2_effect_size", KW + " select metric, round((h - 2) / (n - 3), 9) as audit, round(greatest((h - 2) / (n - 3), 0e0), 9) as gate from h")
def _(t):
    d = st.kruskal(metrics_long(t), ["metric"], "l_returnflag", "value", FLAGS)
    return d.select("metric", F.round("effect_size", 9).alias("audit"), F.round(F.greatest("effect_size", F.lit(0.0)), 9).alias("gate"))


BOOT = lambda table, rid, strata, seed, n: f"""
  bi as (select *, row_number() over ({('partition by ' + strata) if strata else ''} order by {hash_sql(f"'{seed}'", rid)}, {rid}) - 1 as idx, count(*) over ({('partition by ' + strata) if strata else ''}) as idx_n from {table}),
  bd as (select {strata + ',' if strata else ''} draw, ({hash_sql(f"'{seed}'", 'draw', strata or "'all'", 'idx')}) % idx_n as idx, count(*) as mult from (select *, unnest(range(0, {n})) as draw from bi) group by all),
  bs as (select bd.draw, bd.mult, bi.* exclude (idx, idx_n) from bd join bi on bd.idx = bi.idx {('and bd.' + strata + ' = bi.' + strata) if strata else ''})"""


@query("rs1_stratified_bootstrap", with_roles("," + BOOT("labelled", "doc_id", "y", 11, 20) + " select draw, y, count(*) as n_distinct, cast(sum(mult) as bigint) as n, cast(sum(mult * n_chars) as bigint) as chars from bs group by 1, 2", "labelled"))
def _(t):
    b = rs.bootstrap(t.labelled, "doc_id", 20, 11, ["y"])
    return b.groupBy("draw", "y").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("mult").alias("n"), F.sum(F.col("mult") * F.col("n_chars")).alias("chars"))


@query("rs2_bootstrap_two_classes", with_roles("," + BOOT("labelled", "doc_id", "", 12, 20) + """, ok as (select draw from bs group by 1 having min(y) <> max(y))
  select bs.draw, cast(sum(mult) as bigint) as n, cast(sum(mult * y) as bigint) as n1 from bs join ok on bs.draw = ok.draw group by 1""", "labelled"))
def _(t):
    b = rs.both_classes(rs.bootstrap(t.labelled, "doc_id", 20, 12), ["draw"], "y")
    return b.groupBy("draw").agg(F.sum("mult").alias("n"), F.sum(F.col("mult") * F.col("y")).alias("n1"))


@query("rs3_bootstrap_original_group", with_roles("," + BOOT("labelled", "doc_id", "", 13, 10) + " select draw, doc_id as grp, mult from bs", "labelled"))
def _(t):
    return rs.bootstrap(t.labelled, "doc_id", 10, 13).select("draw", F.col("doc_id").alias("grp"), "mult")


@query("rs4_leave_k_out", with_roles(f""", e as (select *, unnest(range(0, 5)) as rep from (select *, unnest(range(2, 9)) as k from labelled)),
  r as (select *, row_number() over (partition by k, rep order by {hash_sql("'14'", 'k', 'rep', 'doc_id')}, doc_id) as rn from e)
  select k::int as k, rep::int as rep, count(*) as n_used, cast(sum(doc_id) as bigint) as ids from r where rn > k group by 1, 2""", "labelled"))
def _(t):
    d = rs.leave_k_out(t.labelled.select("doc_id", "y"), "doc_id", list(range(2, 9)), 5, 14)
    return d.groupBy("k", "rep").agg(F.count(F.lit(1)).alias("n_used"), F.sum("doc_id").alias("ids"))


PERM = f""", ix as (select *, row_number() over (order by {hash_sql("'15'", 'doc_id')}, doc_id) - 1 as idx from labelled), e as (select *, unnest(range(0, 10)) as draw from ix),
  sr as (select draw, y as y2, row_number() over (partition by draw order by {hash_sql("'15'", 'draw', 'doc_id')}, doc_id) - 1 as idx from e),
  pm as (select e.draw::int as draw, e.doc_id, sr.y2 as y, e.score from e join sr on e.draw = sr.draw and e.idx = sr.idx)"""


@query("rs5_label_permutation", with_roles(PERM + " select draw, doc_id, y from pm", "labelled"))
def _(t):
    return rs.permute_labels(t.labelled, "doc_id", "y", 10, 15).select("draw", "doc_id", "y")


AUC = """(sum(case when y = 1 then rk else 0 end) - sum(y)::double * (sum(y) + 1) / 2) / (sum(y)::double * (count(*) - sum(y)))"""


@query("st11_roc_auc", with_roles(f""", r as (select lang, y, rank() over (partition by lang order by score) + (count(*) over (partition by lang, score) - 1) / 2e0 as rk from labelled)
  select lang, cast(sum(y) as bigint) as n1, count(*) - cast(sum(y) as bigint) as n0, round({AUC}, 9) as auc from r group by 1""", "labelled"))
def _(t):
    return st.auc(t.labelled, ["lang"], "y", "score").withColumn("auc", F.round("auc", 9))


@query("st12_permutation_p", with_roles(PERM + f""", pr as (select draw, y, rank() over (partition by draw order by score) + (count(*) over (partition by draw, score) - 1) / 2e0 as rk from pm),
  pa as (select draw, {AUC} as auc from pr group by 1), o as (select y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2e0 as rk from labelled), oa as (select {AUC} as auc from o)
  select 'score' as analysis, round((count(*) filter (pa.auc >= oa.auc - 1e-12) + 1) / (count(*) + 1e0), 9) as p_value, count(*) as n_draws, round(avg(pa.auc), 9) as null_mean from pa cross join oa""", "labelled"))
def _(t):
    perm = rs.permute_labels(t.labelled, "doc_id", "y", 10, 15).withColumn("analysis", F.lit("score"))
    nulls = st.auc(perm, ["analysis", "draw"], "y", "score")
    obs = st.auc(t.labelled.withColumn("analysis", F.lit("score")), ["analysis"], "y", "score").withColumn("auc", F.col("auc") - 1e-12)
    d = st.permutation_p(nulls, obs, ["analysis"])
    return d.select("analysis", F.round("p_value", 9).alias("p_value"), "n_draws", F.round("null_mean", 9).alias("null_mean"))


@query("st3_bootstrap_effect_ci", with_roles("," + BOOT("labelled", "doc_id", "y", 16, 60) + """, x as (select draw, y as g, score as v, unnest(range(0, mult)) as c from bs),
  r as (select draw, g, v, rank() over (partition by draw order by v) + (count(*) over (partition by draw, v) - 1) / 2e0 as rk, count(*) over (partition by draw, v) as t from x),
  a as (select draw, g, count(*)::double as n, sum(rk) as s from r group by 1, 2), tt as (select draw, count(*)::double as n, sum(t::double * t - 1) as ties from r group by 1),
  h as (select tt.draw, tt.n, (12e0 / (tt.n * (tt.n + 1)) * sum(a.s * a.s / a.n) - 3 * (tt.n + 1)) / (1 - max(ties) / (tt.n * tt.n * tt.n - tt.n)) as h from a join tt on a.draw = tt.draw group by tt.draw, tt.n)
  select 'score' as metric, count(*) as n_draws, round(quantile_cont((h - 1) / (n - 2), 0.025), 6) as ci_low, round(quantile_cont((h - 1) / (n - 2), 0.975), 6) as ci_high from h""", "labelled"))
def _(t):
    b = cut_lineage(rs.bootstrap(t.labelled, "doc_id", 60, 16, ["y"]).withColumn("metric", F.lit("score")), "draws")
    e = st.kruskal(b, ["metric", "draw"], "y", "score", [0, 1], weight=F.col("mult"))
    d = st.interval(cut_lineage(e.select("metric", "draw", "effect_size"), "effects"), ["metric"], "effect_size", 50)
    return d.select("metric", "n_draws", F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"))


CT = """with c as (select c_mktsegment as g, o_orderstatus as l, count(*)::double as o from orders join customer on o_custkey = c_custkey group by 1, 2),
  m as (select *, sum(o) over (partition by g) as r, sum(o) over (partition by l) as c from c), n as (select sum(o) as n from c),
  x as (select n, n * (sum(o * o / (r * c)) - 1) as chi, count(distinct g) as nr, count(distinct l) as nc, min(r) as rm, min(c) as cm from m cross join n group by n)"""


def table53(t):
    d = t.orders.select("o_custkey", "o_orderstatus").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return st.contingency(d.withColumn("v", F.lit("status")), ["v"], "c_mktsegment", "o_orderstatus")


@query("st4_chi_square", CT + """ select 'status' as v, n::bigint as n, round(chi, 6) as chi2, (nr - 1) * (nc - 1) as df, case when rm * cm / n < 5 or nr * nc < 20 then 'chi-square (low expected counts)' else 'chi-square' end as test,
   round(exp(-chi / 2) * (1 + chi / 2 + (chi / 2) ** 2 / 2 + (chi / 2) ** 3 / 6), 6) as p_value from x""")
def _(t):
    return st.chi_square(table53(t), ["v"]).select("v", "n", F.round("chi2", 6).alias("chi2"), "df", "test", F.round("p_value", 6).alias("p_value"))


@query("st6_cramers_v", CT + " select 'status' as v, round(sqrt(greatest(chi, 0) / (n * (least(nr, nc) - 1))), 9) as cramers_v, round(sqrt(greatest(chi, 0) / n), 9) as legacy_v from x")
def _(t):
    c = table53(t)
    a = st.chi_square(c, ["v"]).select("v", F.round("cramers_v", 9).alias("cramers_v"))
    return a.join(st.chi_square(c, ["v"], legacy=True).select("v", F.round("cramers_v", 9).alias("legacy_v")), "v")


FISHER = """with c as (select count(*) filter (quality = 1 and toxic = 1) as a, count(*) filter (quality = 1 and toxic <> 1) as b, count(*) filter (quality <> 1 and toxic = 1) as c, count(*) filter (quality <> 1 and toxic <> 1) as d from labels),
  k as (select a, b, c, d, unnest(range(greatest(0, a + c - (c + d)), least(a + b, a + c) + 1)) as k from c),
  p as (select *, exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1)) as pk from k),
  o as (select *, max(pk) filter (k = a) over () as po from p)"""


@query("st5_fisher_exact", FISHER + " select a, b, c, d, round(a::double * d / nullif(b::double * c, 0), 6) as odds_ratio, round(least(sum(pk) filter (pk <= po * (1 + 1e-7)), 1e0), 6) as p_value from o group by a, b, c, d")
def _(t):
    d = st.fisher_2x2(t.labels, F.col("quality") == 1, F.col("toxic") == 1)
    return d.withColumn("odds_ratio", F.round("odds_ratio", 6)).withColumn("p_value", F.round("p_value", 6))


@query("st6_phi_2x2", FISHER.split(",\n  k as")[0] + " select round((a::double * d - b::double * c) / sqrt((a + b)::double * (a + c) * (b + d) * (c + d)), 9) as phi, round(abs((a::double * d - b::double * c) / sqrt((a + b)::double * (a + c) * (b + d) * (c + d))), 9) as cramers_v from c")
def _(t):
    c = st.contingency(t.labels.withColumn("v", F.lit("x")), ["v"], "quality", "toxic")
    return st.chi_square(c, ["v"]).select(F.round("phi", 9).alias("phi"), F.round("cramers_v", 9).alias("cramers_v"))


@query("st7_spearman_trend", """with r as (select c_mktsegment as seg, rank() over (partition by c_mktsegment order by c_nationkey) + (count(*) over (partition by c_mktsegment, c_nationkey) - 1) / 2e0 as a,
  rank() over (partition by c_mktsegment order by c_acctbal) + (count(*) over (partition by c_mktsegment, c_acctbal) - 1) / 2e0 as b from customer) select seg, count(*) as n, round(corr(a, b), 6) as rho from r group by 1""")
def _(t):
    d = st.spearman(t.customer.select(F.col("c_mktsegment").alias("seg"), "c_nationkey", "c_acctbal"), ["seg"], "c_nationkey", "c_acctbal")
    return d.select("seg", "n", F.round("rho", 6).alias("rho"))


@query("st10_welch_t", """with l as (select quality as y, 'f' || k as f, embedding[k + 1]::double as v from embeddings join labels on vec_id = doc_id cross join (select unnest(range(0, 64)) as k) z),
  g as (select f, avg(v) filter (y = 1) as m1, avg(v) filter (y = 0) as m0, var_samp(v) filter (y = 1) / count(*) filter (y = 1) as e1, var_samp(v) filter (y = 0) / count(*) filter (y = 0) as e0, count(*) filter (y = 1) as n1, count(*) filter (y = 0) as n0 from l group by 1)
  select f, round((m1 - m0) / sqrt(e1 + e0), 6) as t, round((e1 + e0) ** 2 / (e1 ** 2 / (n1 - 1) + e0 ** 2 / (n0 - 1)), 6) as df from g""")
def _(t):
    d = st.welch_t(vector_features(t), ["f"], "y", "v")
    return d.select("f", F.round("t", 6).alias("t"), F.round("df", 6).alias("df"))


def vector_features(t, n=64):
    j = t.embeddings.join(t.labels.select(F.col("doc_id").alias("vec_id"), F.col("quality").alias("y")), "vec_id")
    return j.select("y", F.explode(record_array(["f", "v"], *[(f"f{i}", F.col("embedding")[i].cast("double")) for i in range(n)])).alias("u")).select("y", "u.*")


@query("st10_selected_features")
def _(t):
    """Welch t -> BH within the family -> q < .05, every feature when none."""
    d = cut_lineage(st.welch_t(vector_features(t).withColumn("fam", F.lit(1)), ["fam", "f"], "y", "v"))
    q = st.bh(d.withColumn("p_value", F.coalesce("p_value", F.lit(1.0))), ["fam"], "p_value")
    any_hit = q.groupBy("fam").agg(F.bool_or(F.col("q_value") < 0.05).alias("any"))
    return q.join(any_hit, "fam").select("f", "t", "p_value", "q_value", ((F.col("q_value") < 0.05) | ~F.col("any")).alias("selected"))


@query("st13_pearson", "select c_mktsegment, round(corr(c_acctbal, c_nationkey), 9) as r from customer group by 1")
def _(t):
    return t.customer.groupBy("c_mktsegment").agg(F.round(F.corr("c_acctbal", F.col("c_nationkey").cast("double")), 9).alias("r"))


PV = "with p as (select l_returnflag as fam, l_partkey % 500 as k, min(l_discount + l_tax + (l_partkey % 7) / 1e1) / 2e0 as p from lineitem group by 1, 2)"


def pvalues(t):
    p = F.min(F.col("l_discount") + F.col("l_tax") + (F.col("l_partkey") % 7) / F.lit(10.0)) / 2.0
    return t.lineitem.groupBy(F.col("l_returnflag").alias("fam"), (F.col("l_partkey") % 500).alias("k")).agg(p.alias("p"))


@query("win5_benjamini_hochberg", PV + """, r as (select *, rank() over (partition by fam order by p) + count(*) over (partition by fam, p) - 1 as hi, count(*) over (partition by fam) as n from p)
  select fam, k, round(p, 9) as p, round(least(min(p * n / hi) over (partition by fam order by p desc range between unbounded preceding and current row), 1e0), 9) as q_value from r""")
def _(t):
    return st.bh(cut_lineage(pvalues(t)), ["fam"], "p").select("fam", "k", F.round("p", 9).alias("p"), F.round("q_value", 9).alias("q_value"))


@query("win6_holm", """with p as (select c_mktsegment as fam, c_nationkey as name, count(*) / 1e3 as p from customer group by 1, 2),
  r as (select *, row_number() over (partition by fam order by p, name) as r, count(*) over (partition by fam) as n from p)
  select fam, name, round(p, 9) as p, round(max(least(p * (n - r + 1), 1e0)) over (partition by fam order by r), 9) as p_value_holm from r""")
def _(t):
    p = t.customer.groupBy(F.col("c_mktsegment").alias("fam"), F.col("c_nationkey").alias("name")).agg((F.count(F.lit(1)) / F.lit(1000.0)).alias("p"))
    return st.holm(p, ["fam"], "p", "name").select("fam", "name", F.round("p", 9).alias("p"), F.round("p_value_holm", 9).alias("p_value_holm"))


@query("st9_verdict", PV + " select fam, k, case when p < 5e-2 and abs(p * 2e1 - 1e0) >= 5e-1 then 'blocking' when p < 1e-1 or abs(p * 2e1 - 1e0) >= 3e-1 then 'watch' else 'clear' end as verdict from p")
def _(t):
    return pvalues(t).select("fam", "k", st.verdict(F.col("p"), F.col("p") * 20.0 - 1.0).alias("verdict"))


@query("st8_confound_screen")
def _(t):
    """Every variable x three framings with q-values within the framing."""
    d = t.participants.join(t.client_list.select(F.col("subject").alias("participant_key"), "grp"),
                            F.col("participant_key") == tx.subject_id(F.col("participant_id")), "inner").drop("participant_key")
    d = d.withColumn("grp_order", F.when(F.col("grp") == "N", 0).when(F.col("grp") == "A_P_minus", 1).otherwise(2)).withColumn("segment_code", F.length("segment"))
    return st.screen(d, "c_custkey", ["age"], ["segment_code"], {"education": "grp_order"}, tx.target_framings(F.col("grp")), [0, 1, 2], n_boot=60)


@query("resample_hook_mean", with_roles("," + BOOT("labelled", "doc_id", "", 17, 15) + " select draw, round(sum(mult * n_chars)::double / sum(mult), 6) as statistic from bs group by 1", "labelled"))
def _(t):
    return rs.resampled(t.labelled, "doc_id", 15, 17, F.round(F.avg("n_chars"), 6))


@query("st6_bootstrap_v_ci", with_roles("," + BOOT("labelled", "doc_id", "y", 18, 60) + """, c as (select draw, y as g, lang as l, sum(mult)::double as o from bs group by 1, 2, 3),
  m as (select *, sum(o) over (partition by draw, g) as r, sum(o) over (partition by draw, l) as c from c), v as (select draw, sqrt(greatest(sum(o * o / (r * c)) - 1, 0)) as v from m group by 1)
  select count(*) as n_draws, round(quantile_cont(v, 0.025), 6) as ci_low, round(quantile_cont(v, 0.975), 6) as ci_high from v""", "labelled"))
def _(t):
    b = rs.bootstrap(t.labelled, "doc_id", 60, 18, ["y"])
    v = st.chi_square(st.contingency(b, ["draw"], "y", "lang", weight=F.col("mult")), ["draw"]).select("draw", F.col("cramers_v").alias("effect"))
    d = st.interval(cut_lineage(v.withColumn("k", F.lit(1)), "v"), ["k"], "effect", 50)
    return d.select("n_draws", F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"))


@query("st1_association_table")
def _(t):
    """QC metrics of every document against its language group."""
    s = t.sidecars.select("doc_id", "grp", F.explode(record_array(["metric", "value"], *[(m, F.col(m).cast("double")) for m in (
        "n_bad_channels", "occipital_bads", "n_ica_removed", "line_before", "line_after", "artifact_frac", "iaf_hz", "alpha_peak_height_db")])).alias("u")).select("doc_id", "grp", "u.*")
    return st.association_table(s, "doc_id", "grp", ["de", "en", "es", "fr"])
