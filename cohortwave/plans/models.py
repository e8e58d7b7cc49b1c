"""Cross-validation, analysis, scoring and streaming queries.

The features are vector components and text sizes of the labelled documents;
the number of repeats and draws is kept small, the rows are all there are."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rng import hash_int
from ..operators import aggregates as ag, crossval as cv, models as md, quality as dq, stattests as st
from ..session import cut_lineage, scratch_path
from ..streaming import stream as sm, timed as tm
from .bindings import with_roles
from .cycles import LOCKED
from .registry import ORACLE, query
from .stats import AUC, hash_sql

N_F = 64
FEATS = [f"f{i}" for i in range(N_F)]
GRID = [0.01, 0.1, 1.0, 10.0]
SMALL = dict(n_repeats=2, n_permutations=12, n_bootstrap=12, c_grid=GRID)


def wide(t):
    """One row per labelled vector with a document: features, target, nuisance."""
    e = t.embeddings.select(F.col("vec_id").alias("doc_id"), *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(N_F)], F.col("label").alias("cell"))
    d = t.documents.select("doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"), F.when(F.col("doc_id") % 5 != 0, F.length("source").cast("double")).alias("src_len"))
    return t.labels.select("doc_id", F.col("quality").alias("y"), "toxic").join(e, "doc_id").join(d, "doc_id")


def rows_of(t, name="features", features=FEATS, **kw):
    return md.matrix(wide(t), name, "doc_id", "y", features, **kw)


FOLDS = lambda reps, seed: f""", r as (select doc_id, y, unnest(range(0, {reps})) as rep from labelled),
  fo as (select rep::int as rep, doc_id, y, cast((row_number() over (partition by rep, y order by {hash_sql(f"'{seed}'", "'outer'", 'rep', 'doc_id')}, doc_id) - 1) % 5 as int) as fold from r)"""


@query("cv1_group_folds", with_roles(FOLDS(2, 99) + " select rep, doc_id, fold from fo", "labelled"))
def _(t):
    return cv.group_folds(t.labelled.select("doc_id", "y"), [], "doc_id", "y", 5, 99, 2)


@query("win8_class_relative_rank", with_roles(f" select y, doc_id, cast(row_number() over (partition by y order by {hash_sql(chr(39) + '5' + chr(39), 'doc_id')}, doc_id) - 1 as bigint) as idx from labelled", "labelled"))
def _(t):
    from ..functions.ordered import dense_index
    return dense_index(t.labelled, ["y"], hash_int(5, F.col("doc_id")), "doc_id", hashed=True).select("y", "doc_id", F.col("idx").cast("bigint").alias("idx"))


@query("cv1_fold_coverage", with_roles("select rep::int as rep, 1::bigint as min_tests, 1::bigint as max_tests, count(*) as n_rows from (select doc_id, unnest([0, 1]) as rep from labelled) group by 1", "labelled"))
def _(t):
    d = t.labelled.select("doc_id", "y", F.col("doc_id").alias("g"))
    return cv.fold_coverage(cv.group_folds(d, [], "g", "y", 5, 99, 2), d, [], "g", "doc_id")


@query("cv2_fold_auc", with_roles(FOLDS(2, 42) + f""", s as (select fo.*, l.score from fo join labelled l on fo.doc_id = l.doc_id),
  rk as (select rep, fold, y, rank() over (partition by rep, fold order by score) + (count(*) over (partition by rep, fold, score) - 1) / 2e0 as rk from s), a as (select rep, fold, {AUC} as auc from rk group by 1, 2)
  select 'score' as analysis, round(avg(auc), 9) as auc, count(auc) as n_folds_used from a""", "labelled"))
def _(t):
    f = cv.group_folds(t.labelled.select("doc_id", "y"), [], "doc_id", "y", 5, 42, 2)
    d = f.join(t.labelled.select("doc_id", "y", "score"), "doc_id").withColumn("analysis", F.lit("score"))
    return cv.fold_auc(d, ["analysis"], "score").withColumn("auc", F.round("auc", 9))


@query("cv5_pooled_auc", with_roles(FOLDS(3, 43) + f""", s as (select fo.*, l.score + fold as score from fo join labelled l on fo.doc_id = l.doc_id),
  rk as (select rep, y, rank() over (partition by rep order by score) + (count(*) over (partition by rep, score) - 1) / 2e0 as rk from s), a as (select rep, {AUC} as auc, count(*) as n from rk group by 1)
  select 'score' as analysis, round(avg(auc), 9) as auc, count(auc) as n_repeats, max(n) as n_used from a""", "labelled"))
def _(t):
    f = cv.group_folds(t.labelled.select("doc_id", "y"), [], "doc_id", "y", 5, 43, 3)
    d = f.join(t.labelled.select("doc_id", "y", "score"), "doc_id").select(F.lit("score").alias("analysis"), "rep", "y", (F.col("score") + F.col("fold")).alias("proba"))
    return cv.pooled_auc(d, ["analysis"]).withColumn("auc", F.round("auc", 9))


@query("cv3_train_statistics", with_roles(FOLDS(1, 44) + """, tf as (select fo.doc_id, fo.rep, k::int as fold from fo cross join (select unnest(range(0, 5)) as k) z where k <> fo.fold),
  v as (select tf.rep, tf.fold, case when l.doc_id % 4 <> 0 then l.score end as v from tf join labelled l on l.doc_id = tf.doc_id),
  m as (select rep, fold, median(v) as med from v group by 1, 2)
  select v.rep, v.fold, 'score' as feature, count(*) as n, round(max(med), 6) as median, round(avg(coalesce(v, med)), 6) as mean, round(stddev_pop(coalesce(v, med)), 6) as std from v join m on v.rep = m.rep and v.fold = m.fold group by 1, 2""", "labelled"))
def _(t):
    d = t.labelled.select("doc_id", "y", F.when(F.col("doc_id") % 4 != 0, F.col("score")).alias("score"))
    f = cv.group_folds(d, [], "doc_id", "y", 5, 44)
    s = cv.train_statistics(d, f, [], "doc_id", ["score"], 5)
    return s.select("rep", "fold", "feature", "n", *[F.round(c, 6).alias(c) for c in ("median", "mean", "std")])


@query("cv4_nested_predictions")
def _(t):
    return cv.nested_cv(rows_of(t), ["analysis"], n_repeats=2, c_grid=GRID)[0]


@query("cv4_fold_fits")
def _(t):
    return cv.nested_cv(rows_of(t), ["analysis"], n_repeats=2, c_grid=GRID)[1]


@query("cv6_linear_svm")
def _(t):
    p = cv.simple_cv(rows_of(t), ["analysis"], n_repeats=2, model="svm")
    return cv.fold_auc(p, ["analysis"])


@query("agg19_feature_stability")
def _(t):
    fits = cv.nested_cv(rows_of(t), ["analysis"], n_repeats=2, c_grid=GRID)[1]
    return ag.feature_stability(fits.withColumn("names", F.array(*[F.lit(f) for f in FEATS])), ["analysis"])


@query("agg19_stability_of_signs", """with e as (select label, unnest(range(0, 64)) as k, unnest(embedding)::double as c from embeddings),
  g as (select label, 'f' || k as feature, count(*) as n, count(*) filter (abs(c) > 5e-2) as s, count(*) filter (c > 5e-2) as p, count(*) filter (c < -5e-2) as m from e group by 1, 2)
  select label, feature, round(s / n::double, 9) as selection_frequency, round(greatest(p, m) / s::double, 9) as sign_consistency, s / n::double > 8e-1 as stable from g""")
def _(t):
    c = t.embeddings.select("label", F.array(*[F.lit(f"f{i}") for i in range(N_F)]).alias("names"), F.transform("embedding", lambda v: v.cast("double")).alias("coef"))
    d = ag.feature_stability(c, ["label"], 5e-2)
    return d.select("label", "feature", F.round("selection_frequency", 9).alias("selection_frequency"), F.round("sign_consistency", 9).alias("sign_consistency"), "stable")


@query("agg22_metric_table", "select lang as analysis, count(*) as n, null::double as extra, 0.5::double as ref_chance from documents group by 1 union all select 'all', count(*), sum(n_chars)::double, 0.5::double from documents")
def _(t):
    a = t.documents.groupBy(F.col("lang").alias("analysis")).agg(F.count(F.lit(1)).alias("n"))
    b = t.documents.agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").cast("double").alias("extra")).withColumn("analysis", F.lit("all"))
    return ag.metric_table([a, b], {"chance": 0.5})


@query("dq7_leakage_checklist")
def _(t):
    d = wide(t).select("doc_id", "y", F.col("cell").alias("g"))
    leak = cv.fold_leakage(cv.group_folds(d, [], "g", "y", 5, 7, 2), d, [], "g").withColumn("analysis", F.lit("features"))
    nulls = md.qc_gate(rows_of(t), n_repeats=1, n_permutations=12, n_bootstrap=4).select("analysis", "null_mean")
    return dq.leakage_checklist(leak, nulls, ["analysis"])


@query("md1_qc_only_gate")
def _(t):
    d = md.qc_gate(rows_of(t, "qc_only", ["n_chars", "src_len"]), n_repeats=3, n_permutations=15, n_bootstrap=15)
    return d.withColumn("verdict", md.contamination_verdict(F.col("auc")))


def primary(t):
    w = cut_lineage(wide(t), "wide")
    m = lambda n, f, **k: md.matrix(w, n, "doc_id", "y", f, **k)
    return m("features_only", FEATS).unionByName(m("features_plus_nuisance", [*FEATS, "n_chars", "src_len"])).unionByName(m("nuisance_only", ["n_chars", "src_len"]))


@query("md2_single_analysis")
def _(t):
    return md.run_analyses(rows_of(t), **SMALL)["metrics"]


@query("md3_primary_set")
def _(t):
    m = md.run_analyses(primary(t))["metrics"]
    n = m.groupBy().agg(F.max(F.when(F.col("analysis") == "nuisance_only", F.col("auc"))).alias("nuisance_auc"))
    return m.crossJoin(F.broadcast(n)).withColumn("verdict", dq.null_verdict(F.col("auc"), F.col("nuisance_auc"), F.col("p_value")))    # one row


@query("md4_secondary_set_holm")
def _(t):
    w = cut_lineage(wide(t), "wide")
    rows = (md.matrix(w, "baseline_rest", "doc_id", "y", ["n_chars", "src_len"], complete=True)
            .unionByName(md.matrix(w, "combined", "doc_id", "y", [*FEATS, "n_chars", "src_len"]))
            .unionByName(md.matrix(w, "baseline_msit", "doc_id", "y", FEATS[:3], complete=True)))
    return md.holm_metrics(md.run_analyses(rows)["metrics"], ["baseline_rest", "combined", "baseline_msit"])


@query("md5_benchmark_verdict")
def _(t):
    m = md.run_analyses(rows_of(t, "benchmark", FEATS[:3], complete=True), **SMALL)["metrics"]
    return m.withColumn("verdict", md.benchmark_verdict(F.col("auc")))


@query("md6_positive_controls")
def _(t):
    w = cut_lineage(wide(t), "wide")
    pair = F.array(F.struct(F.lit(1).alias("y2"), F.col("f0").alias("a"), F.col("f1").alias("b")), F.struct(F.lit(0), F.col("f2") - 0.1, F.col("f3")).cast("struct<y2:int,a:double,b:double>"))
    paired = w.select("doc_id", F.explode(pair).alias("p")).select(F.concat_ws("-", "doc_id", F.col("p.y2")).alias("rid"), F.col("doc_id").alias("grp"), "p.*")
    rows = md.matrix(paired, "within_subject", "rid", "y2", ["a", "b"], group="grp").unionByName(
        md.matrix(w.withColumn("even", (F.col("n_chars") % 2).cast("int")), "cross_subject", "doc_id", "even", FEATS))
    return md.control_gate(md.run_analyses(rows, **SMALL)["metrics"], "within_subject", "cross_subject")


def rungs(t):
    w = cut_lineage(wide(t), "wide").withColumn("sex", (F.col("n_chars") % 2).cast("int"))
    return md.control_rows([md.matrix(w, "rung1_baseline", "doc_id", "sex", FEATS[:2]), md.matrix(w, "rung2_combined", "doc_id", "sex", FEATS[:4]), md.matrix(w, "rung3_zones", "doc_id", "sex", FEATS)], "sex")


@query("md7_control_ladder")
def _(t):
    return md.ladder(md.run_analyses(rungs(t))["metrics"], ["rung1_baseline", "rung2_combined", "rung3_zones"])


@query("lim6_first_significant_rung", with_roles("""select lang as analysis, count(*) / 1e3 as p_value, array_position(['de', 'es', 'fr', 'en'], lang)::bigint as rung,
  (select lang from (select lang, count(*) as n from labelled group by 1) where n / 1e3 < 7e-2 order by array_position(['de', 'es', 'fr', 'en'], lang) limit 1) as stopped_at from labelled group by 1""", "labelled"))
def _(t):
    m = t.labelled.groupBy(F.col("lang").alias("analysis")).agg((F.count(F.lit(1)) / 1000.0).alias("p_value"))
    return md.ladder(m, ["de", "es", "fr", "en"], 0.07)


@query("md8_richness_diagnostic")
def _(t):
    d = md.qc_gate(rows_of(t, "rich", [*FEATS, "n_chars"]), n_repeats=2, n_permutations=12, n_bootstrap=12, select=True)
    svm = cv.fold_auc(cv.simple_cv(rows_of(t, "rich", [*FEATS, "n_chars"]), ["analysis"], n_repeats=2, select=True, model="svm"), ["analysis"])
    return d.join(svm.select("analysis", F.col("auc").alias("auc_svm")), "analysis").withColumn("verdict", md.richness_verdict(F.col("auc"), F.col("p_value")))


@query("md9_control_matrix_resume", """select v.analysis, (select count(*) from labels l join embeddings e on e.vec_id = l.doc_id join documents d on d.doc_id = l.doc_id) as n_subjects_used
  from (values ('rung1_baseline'), ('rung2_combined'), ('rung3_zones')) v(analysis)""")
def _(t):
    """One representation is run and stored, then the whole matrix is asked
    for: the stored one is kept, the others are run."""
    r, root = rungs(t), scratch_path(t.spark, "matrix")
    how = dict(n_repeats=1, n_permutations=4, n_bootstrap=4, c_grid=[0.1, 1.0])
    md.control_matrix(r.where("analysis = 'rung1_baseline'"), root, **how)
    return md.control_matrix(r, root, **how).select("analysis", "n_subjects_used")


@query("md10_isolation_comparison")
def _(t):
    m = md.run_analyses(primary(t), n_repeats=1, n_permutations=6, n_bootstrap=6, c_grid=[0.1, 1.0])["metrics"]
    return m.select("analysis", "auc", md.isolation_verdict(F.col("auc"), 0.474, 0.651).alias("verdict"))


@query("md11_final_model")
def _(t):
    return md.train_final(rows_of(t), FEATS, c_grid=GRID)


SC_METRICS = ["n_chars", "toxic_rate"]
MODEL = """, tr as (select d.doc_id, d.n_chars::double as n_chars, (d.doc_id % 10)::double as toxic_rate from documents d join labels l on d.doc_id = l.doc_id where l.quality = 1),
  rg as (select min(n_chars) as l1, max(n_chars) as h1, min(toxic_rate) as l2, max(toxic_rate) as h2, avg(n_chars) as m, stddev_pop(n_chars) as s from tr)"""
SCORED = MODEL + """ select doc_id, case when n_chars < l1 or n_chars > h1 or (doc_id % 12) > h2 then 'cannot_score' else 'scored' end as status,
   case when n_chars < l1 or n_chars > h1 then 'n_chars=' || n_chars::double || ' outside training range [' || l1 || ', ' || h1 || ']'
        when (doc_id % 12) > h2 then 'toxic_rate=' || (doc_id % 12)::double || ' outside training range [' || l2 || ', ' || h2 || ']' end as reason,
   case when not (n_chars < l1 or n_chars > h1 or (doc_id % 12) > h2) then round(1 / (1 + exp(-(2e0 * (0.1e0 + 5e-1 * (n_chars - m) / s) - 0.3e0))), 9) end as probability from documents cross join rg"""


def scoring_parts(t):
    tr = t.documents.join(t.labels.where("quality = 1").select("doc_id"), "doc_id").select(F.col("n_chars").cast("double").alias("n_chars"), (F.col("doc_id") % 10).cast("double").alias("toxic_rate"))
    part = F.struct(F.lit(0.1).alias("intercept"), F.array(F.lit(0.5)).alias("coef"), F.lit(2.0).alias("slope"), F.lit(-0.3).alias("offset"))
    model = tr.agg(F.avg("n_chars").alias("m"), F.stddev_pop("n_chars").alias("s")).select(
        F.array(F.lit("n_chars")).alias("features"), F.array("m").alias("median"), F.array("m").alias("mean"), F.array("s").alias("std"), F.array(part).alias("parts"))
    return model, ag.metric_ranges(tr, SC_METRICS)


def to_score(docs):
    return docs.select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), (F.col("doc_id") % 12).cast("double").alias("toxic_rate"))


@query("md12_scoring_with_refusal", with_roles(SCORED.lstrip(", ").replace("tr as", ", tr as", 1), "labelled"))
def _(t):
    model, ranges = scoring_parts(t)
    d = md.score(to_score(t.documents), model, ["n_chars"], ranges, SC_METRICS, ["doc_id"])
    return d.select("doc_id", "status", "reason", F.round("probability", 9).alias("probability"))


@query("md12_trained_model_scores")
def _(t):
    """Calibrated model trained on the labelled vectors, applied to all."""
    model = cut_lineage(md.train_final(rows_of(t), FEATS, c_grid=[0.1, 1.0]), "model")
    v = t.embeddings.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(N_F)])
    ranges = ag.metric_ranges(wide(t), ["f0", "f1"])
    return md.score(v, model, FEATS, ranges, ["f0", "f1"], ["vec_id"])


@query("md13_model_card_gate", """select lang as run_id, avg(n_chars) as cv_estimated_auc, '[' || min(n_chars) || ']' as cv_estimated_ci, 'r' as training_qc_ranges, sha256(lang) as inputs_sha256 from documents group by lang""")
def _(t):
    p = t.documents.groupBy("lang").agg(F.avg("n_chars").alias("cv_estimated_auc"), F.concat(F.lit("["), F.min("n_chars").cast("string"), F.lit("]")).alias("cv_estimated_ci"))
    p = p.select(F.col("lang").alias("run_id"), "cv_estimated_auc", "cv_estimated_ci", F.lit("r").alias("training_qc_ranges"), F.sha2("lang", 256).alias("inputs_sha256"))
    return md.card_gate(p)


# --- streaming ---------------------------------------------------------------

from .quality import QC  # noqa: E402


@query("str1_continuous_qc", with_roles(QC + " select doc_id, verdict, flags from q", "sidecars"))
def _(t):
    s = t.stream("sidecars").withColumn("alpha_present", F.col("alpha_peak_height_db") >= 3)
    return sm.drain(sm.continuous_qc(s).select("doc_id", "verdict", "flags"), "str1")


@query("str2_live_artifacts", """with w as (select user_id as rec, cast(floor((epoch_us(ts) - 1704067200000000) / 3.6e9 / 6) as bigint) as six, max(value) - min(value) > 3e1 as bad, count(*) as n from events group by 1, 2),
  mx as (select max(epoch_us(ts)) - 3600000000 as wm from events) select rec, six, n, bad from w cross join mx where (six + 1) * 21600000000 + 1704067200000000 <= wm""")
def _(t):
    ev = t.stream("events").select(F.col("user_id").alias("rec"), F.col("ts").cast("timestamp").alias("ts"), "value")
    d = sm.drain(sm.live_artifacts(ev, ["rec"], "ts", "value", "6 hours", 30.0, "1 hour"), "str2")
    six = F.floor(F.timestamp_diff("SECOND", F.lit("2024-01-01 00:00:00").cast("timestamp"), F.col("start")) / 21600)
    return d.select("rec", six.cast("bigint").alias("six"), "n", "bad")


@query("str3_live_marker_gaps", with_roles(""", g as (select *, lead(onset_s) over (partition by rec order by onset_s, event_id) as nx from annotations)
  select rec, event_id, round(nx - onset_s, 6) as gap_s, nx - onset_s >= 1.2e4 as kept from g where nx is not null and description like '%S  4'""", "annotations"))
def _(t):
    d = sm.drain(sm.live_marker_gaps(t.stream("annotations"), "rec", 4, 12000.0), "str3")
    return d.select("rec", "event_id", F.round("gap_s", 6).alias("gap_s"), "kept")


@query("str4_live_boundaries")
def _(t):
    a = t.stream("annotations").select("rec", F.floor("onset_s").alias("i"))
    return sm.drain(sm.live_boundaries(a, "rec", "i"), "str4")


@query("str3_timed_marker_gaps", with_roles(""", g as (select *, lead(onset_s) over (partition by rec order by onset_s, event_id) as nx from annotations)
  select rec, event_id, round(nx - onset_s, 6) as gap_s, coalesce(nx - onset_s >= 1.2e4, false) as kept from g where description like '%S  4'""", "annotations"))
def _(t):
    """In event time, up to and with each recording's last marker."""
    d = tm.drain_to_end(lambda: t.stream("annotations").withColumn("ts", F.col("ts").cast("timestamp")), lambda s: tm.timed_marker_gaps(s, "rec", "ts", 4, 12000.0, "1 hour", 1e8), "rec", "ts", "str3t")
    return d.select("rec", "event_id", F.round("gap_s", 6).alias("gap_s"), "kept")


@query("str4_timed_boundaries", with_roles(", xs as (select rec, list(distinct cast(floor(onset_s) as bigint) order by cast(floor(onset_s) as bigint)) as xs from annotations group by 1)" + LOCKED
                                         + " select rec, t0 as start_i, t as end_i from st where t0 is not null", "annotations").replace("with ", "with recursive ", 1))
def _(t):
    """In event time, up to each recording's last crossing."""
    rows = lambda: t.stream("annotations").select("rec", F.col("ts").cast("timestamp").alias("ts"), F.floor("onset_s").alias("i"))
    return tm.drain_to_end(rows, lambda s: tm.timed_boundaries(s, "rec", "ts", "i", "1 hour", 1e8), "rec", "ts", "str4t")


@query("str5_quarantine_branch", with_roles("select case when bytes % 7 = 0 then 'quarantine' else 'good' end as side, count(*) as n, cast(sum(bytes) as bigint) as bytes from survey group by 1", "survey"))
def _(t):
    good, bad = sm.quarantine(t.stream("survey"), F.col("bytes") % 7 == 0, scratch_path(t.spark, "str5"), "listing")
    of = lambda n, d: d.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).select(F.lit(n).alias("side"), "n", "bytes")
    return of("good", good).unionByName(of("quarantine", bad))


@query("str5_triplet_quarantine", ORACLE["jn12_triplet_integrity"].rsplit("select dir, stem", 1)[0] + "select status, count(*) as n from s group by 1")
def _(t):
    good, bad = sm.triplet_quarantine(t.stream("headers"), t.files, scratch_path(t.spark, "str5t"), "headers")
    return good.unionByName(bad).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("str6_live_scoring", with_roles(SCORED.lstrip(", ").replace("tr as", ", tr as", 1), "labelled"))
def _(t):
    model, ranges = scoring_parts(t)
    s = sm.live_scoring(to_score(t.stream("documents")), model, ["n_chars"], ranges, SC_METRICS, ["doc_id"])
    return sm.drain(s.select("doc_id", "status", "reason", F.round("probability", 9).alias("probability")), "str6")
