"""Source, sink, rule-table and gate queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort as co, quality as dq
from ..sources import sinks as sk, tables as tb
from ..session import scratch_path
from .bindings import with_roles
from .registry import query

RUN = "20240101T000000Z-a1b2c3d"

# --- QC rules ----------------------------------------------------------------

QC = """, b as (select *, n_ica_removed / cast(greatest(n_ica_components, 1) as double) as fr, alpha_peak_height_db >= 3 as alpha_present, regexp_replace(task, '^task-', '') as tk, expected_s * 6e-1 as need from sidecars),
  f as (select *, [case when n_bad_channels >= 8 then n_bad_channels || ' bad channels (>= 8)' end, case when occipital_bads >= 5 then occipital_bads || ' occipital bads (>= 5)' end,
       case when artifact_frac >= 4e-1 then 'artifact ' || cast(round_even(artifact_frac * 100, 0) as bigint) || '% (>= 40%)' end,
       case when line_before > 1.5e0 and line_after > 1.5e0 then 'line-noise removal failed: 50 Hz index ' || line_after || ' after treatment (before ' || line_before || ')' end,
       case when expected_s <> 0 and duration_s < need then 'truncated: ' || cast(round_even(duration_s, 0) as bigint) || 's < ' || cast(round_even(need, 0) as bigint) || 's expected' end,
       case when tk = 'rest' and not alpha_present then 'no identifiable alpha peak (rest)' end] as ff,
     [case when n_bad_channels between 5 and 7 then n_bad_channels || ' bad channels (> 4)' end, case when occipital_bads = 4 then '4 occipital bads (> 3)' end,
       case when fr > 2.5e-1 then cast(round_even(fr * 100, 0) as bigint) || '% ICA removed (> 25%)' end,
       case when artifact_frac > 2e-1 and artifact_frac < 4e-1 then 'artifact ' || cast(round_even(artifact_frac * 100, 0) as bigint) || '% (> 20%)' end] as ww from b),
  qc as (select *, [x for x in ff if x is not null] as f2, [x for x in ww if x is not null] as w2 from f),
  q as (select *, case when len(f2) > 0 then 'fail' when len(w2) > 0 then 'warn' else 'pass' end as verdict, array_to_string(list_concat(f2, w2), ';') as flags,
     round(fr, 3) as ica_removed_frac, abs(5e0 * iaf_hz - 5e1) < 1e0 as fifth_harmonic_collision from qc)"""


def qc_rows(t):
    return dq.classify(t.sidecars.withColumn("alpha_present", F.col("alpha_peak_height_db") >= 3))


@query("dq1_qc_verdict", with_roles(QC + " select doc_id, subject, task, ica_removed_frac, fifth_harmonic_collision, verdict, flags from q", "sidecars"))
def _(t):
    return qc_rows(t).select("doc_id", "subject", "task", "ica_removed_frac", "fifth_harmonic_collision", "verdict", "flags")


EXC = QC + """, rs as (select subject, task || ': ' || flags as reason from q where verdict = 'fail' union select subject, n_bad_channels || ' bad channels >= 10' from q where n_bad_channels >= 10
   union select subject, occipital_bads || ' occipital bads (alpha sites) >= 5' from q where tk = 'rest' and occipital_bads >= 5),
  ex as (select subject, string_agg(reason, ' | ' order by reason) as reason from rs group by 1)"""


@query("dq2_freeze_exclusions", with_roles(EXC + f" select subject, reason, '{RUN}' as run_id from ex", "sidecars"))
def _(t):
    return dq.freeze_exclusions(qc_rows(t), RUN)


@query("agg9_reason_rollup", with_roles(EXC + " select subject, len(string_split(reason, ' | ')) as n_reasons, length(reason) as n_chars from ex", "sidecars"))
def _(t):
    e = dq.freeze_exclusions(qc_rows(t), RUN)
    return e.select("subject", F.size(F.split("reason", r" \| ")).cast("bigint").alias("n_reasons"), F.length("reason").cast("bigint").alias("n_chars"))


def groups(t):
    return t.sidecars.where("task = 'rest'").select("subject", "grp")


@query("agg8_verdict_counts", with_roles(QC + " select count(*) as n_rows, count(*) filter (verdict = 'pass') as n_pass, count(*) filter (verdict = 'warn') as n_warn, count(*) filter (verdict = 'fail') as n_fail from q", "sidecars"))
def _(t):
    return dq.verdict_counts(qc_rows(t))


GRP = EXC + ", g as (select subject, grp from sidecars where task = 'rest'), eg as (select ex.subject, coalesce(grp, 'not-in-cohort') as grp from ex left join g on ex.subject = g.subject)"


@query("agg8_exclusions_per_group", with_roles(GRP + " select grp, count(*) as n_excluded, min(subject) as first_subject, max(subject) as last_subject from eg group by 1", "sidecars"))
def _(t):
    return dq.exclusions_per_group(dq.freeze_exclusions(qc_rows(t), RUN), groups(t))


@query("agg8_excluded_ids", with_roles(GRP + " select grp, subject from eg", "sidecars"))
def _(t):
    return dq.excluded_ids(dq.freeze_exclusions(qc_rows(t), RUN), groups(t))


@query("dq3_task_inclusion", with_roles(QC + " select subject, task, verdict, verdict <> 'fail' as included, flags as reason from q", "sidecars"))
def _(t):
    return dq.task_inclusion(qc_rows(t))


@query("dq3_included_subjects", with_roles(QC + " select distinct subject from q where tk = 'msit' and verdict <> 'fail'", "sidecars"))
def _(t):
    return dq.included_for(dq.task_inclusion(qc_rows(t)), "msit")


@query("dq4_escalation", with_roles(GRP + """, a as (select count(distinct subject) as n, count(*) filter (tk = 'rest' and not alpha_present) as na,
    count(distinct subject) filter (tk = 'rest' and not alpha_present and alpha_peak_height_db >= 1.5e0 and alpha_peak_height_db < 3e0) as nb from q),
  c as (select count(*) as e, (select max(k) from (select count(*) as k from eg group by grp) z) as top from eg),
  m as (select n, e, na, nb, [x for x in [case when e > 5 then e || ' subjects excluded (> 5 threshold)' end,
     case when top / greatest(e, 1) > 8e-1 and e >= 3 then 'exclusions concentrate in one group (' || cast(round_even(top / greatest(e, 1) * 100, 0) as bigint) || '%)' end,
     case when na / greatest(n, 1) > 3e-1 then na || ' rest subjects lack an alpha peak (' || cast(round_even(na / greatest(n, 1) * 100, 0) as bigint) || '% of subjects)' end,
     case when n - e < 70 then 'only ' || (n - e) || ' subjects survive (< 70) for the primary target framing' end] if x is not null] as ms from a cross join c)
  select n as n_subjects, e as n_excluded, na as n_no_alpha, nb as n_borderline, array_to_string(ms, '; ') as messages, case when len(ms) > 0 then 'ESCALATE' else 'PROCEED' end as verdict from m""", "sidecars"))
def _(t):
    q = qc_rows(t)
    return dq.escalation(q, dq.freeze_exclusions(q, RUN), groups(t))


@query("dq6_budget_gate", with_roles("select task, round(sum(bytes) / 1073741824e0, 4) as gb from survey group by 1", "survey"))
def _(t):
    s = t.survey.groupBy("task").agg(F.round(F.sum("bytes") / 1024 ** 3, 4).alias("gb"))
    return dq.budget_gate(s, "gb", 1e12, "derivatives")


@query("dq8_declared_features", "select vec_id, embedding[1]::double as f0, embedding[2]::double as f1 from embeddings")
def _(t):
    d = t.embeddings.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(64)])
    return dq.check_declared_features(d, ["f0", "f1"], ["vec_id"])


@query("dq9_null_verdict", with_roles("select lang, case when avg(y) > 8e-1 and count(*) / 1e3 < 5e-2 then 'POSITIVE' else 'NULL' end as verdict from labelled group by 1", "labelled"))
def _(t):
    g = t.labelled.groupBy("lang").agg(F.avg("y").alias("a"), (F.count(F.lit(1)) / 1000.0).alias("p"))
    return g.select("lang", dq.null_verdict(F.col("a"), F.lit(0.8), F.col("p")).alias("verdict"))


@query("dq10_row_count_gate", "select (select count(*) from labels l join documents d on d.doc_id = l.doc_id) as n, (select count(*) from labels) as n_expected")
def _(t):
    """The join of labels and documents against the cohort that the labels declare."""
    return dq.row_count_gate(t.labels.join(t.documents.select("doc_id"), "doc_id"), t.labels)


@query("dq11_label_blind_sink", "select lang, count(*) as n, 'r1' as run_id from documents group by 1")
def _(t):
    path = scratch_path(t.spark, "features")
    sk.write_table(t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), path, "r1", features=True)
    return t.spark.read.parquet(path)


@query("dq12_proxy_screen", """with l as (select n_chars, 'f0' as feature, n_chars * 2e0 + doc_id as value from documents union all select n_chars, 'f1', doc_id % 17 from documents)
  select feature, round(corr(value, n_chars), 6) as r, count(*) as n, abs(corr(value, n_chars)) > 8e-1 as flagged from l group by 1""")
def _(t):
    d = t.documents.select("n_chars", (F.col("n_chars") * 2.0 + F.col("doc_id")).alias("f0"), (F.col("doc_id") % 17).alias("f1"))
    return dq.proxy_screen(d, ["f0", "f1"], "n_chars").withColumn("r", F.round("r", 6))


# --- sources -----------------------------------------------------------------


@query("src1_delimited_scan", "select c_custkey, c_name, c_acctbal, c_mktsegment from customer")
def _(t):
    path = scratch_path(t.spark, "tsv")
    t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").write.option("header", True).option("sep", "\t").csv(path)
    return tb.read_delimited(t.spark, path, "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string")


def documents_as_sidecars(t):
    s = F.struct
    d = t.sidecars
    return d.select(
        F.col("subject").alias("ParticipantID"), F.col("task").alias("TaskName"),
        s(F.col("n_bad_channels").cast("int").alias("n"), F.array(F.lit("O1")).alias("names"), F.col("occipital_bads").cast("int").alias("occipital_bads")).alias("BadChannels"),
        s(F.col("n_ica_components").cast("int").alias("n_components"), F.slice(F.sequence(F.lit(0), F.lit(20)), F.lit(1), F.col("n_ica_removed").cast("int")).alias("excluded_components"),
          F.array().cast("array<string>").alias("excluded_labels"), F.lit("x").alias("labeling")).alias("ICA"),
        s(F.col("duration_s").alias("s"), "n_samples_final").alias("Duration"), s(F.col("line_before").alias("before_index"), F.col("line_after").alias("after_index")).alias("LineNoisePower"),
        s(F.lit("notch").alias("method")).alias("LineNoiseRemoval"), s(F.col("artifact_frac").alias("fraction")).alias("ArtifactAnnotation"),
        s("iaf_hz", F.col("alpha_peak_height_db").alias("peak_height_db"), (F.col("alpha_peak_height_db") >= 3).alias("present")).alias("IAF"))


@query("src2_sidecar_tree", with_roles(", z as (select *, null::double as expected from sidecars)" + QC.replace("from sidecars)", "from (select * replace (null::double as expected_s) from sidecars) y)", 1) + " select subject, task, duration_s, n_ica_removed, verdict, flags from q", "sidecars"))
def _(t):
    path = scratch_path(t.spark, "sidecars")
    documents_as_sidecars(t).withColumn("sub", F.col("ParticipantID")).write.partitionBy("TaskName").json(path)
    doc = tb.read_sidecars(t.spark, path, "part-*.json", one_per_file=False)
    # TaskName sits in the folder name after a partitioned write
    doc = doc.withColumn("TaskName", F.regexp_extract(F.input_file_name(), "TaskName=([^/]+)/", 1))
    flat = dq.flatten_sidecar(doc).withColumn("expected_s", F.lit(None).cast("double"))
    return dq.classify(flat).select("subject", "task", "duration_s", F.col("n_ica_removed").cast("bigint").alias("n_ica_removed"), "verdict", "flags")


@query("src3_listing_scan", with_roles("""select rel_path as path, bytes, case when rel_path like 'sub-%/%' then split_part(rel_path, '/', 2) else 'root' end as modality,
   case when rel_path like 'sub-%/%' then split_part(rel_path, '/', 1) end as subject, nullif(regexp_extract(rel_path, 'task-([^_.]+)', 1), '') as task from listing""", "listing"))
def _(t):
    return co.require_tasks(co.parse_listing(t.listing))


@query("src4_config_dimension", """select grp, subject, c_custkey is not null as known from (values ('N', 'sub-01'), ('N', 'sub-05'), ('A_P_minus', 'sub-38'), ('A_P_plus', 'sub-9999999')) v(grp, subject)
  left join (select c_custkey, concat('sub-', lpad(cast(c_custkey as string), cast(greatest(2, length(cast(c_custkey as string))) as int), '0')) as s from customer) c on c.s = v.subject""")
def _(t):
    """The configured groups as rows, matched against the participants."""
    from ..functions import text as tx
    g = co.group_members({"N": ["sub-01", "sub-05"], "A_P_minus": ["sub-38"], "A_P_plus": ["sub-9999999"]}, t.spark)
    known = t.customer.select(tx.subject_id(F.col("c_custkey")).alias("subject"), F.lit(True).alias("k"))
    return g.join(known, "subject", "left").select("grp", "subject", F.coalesce("k", F.lit(False)).alias("known"))


@query("src7_manifest_tasks", with_roles("select subject, string_agg(distinct task, ',' order by task) as tasks, count(*) as n_files from survey group by 1", "survey"))
def _(t):
    return tb.manifest_tasks(t.survey)


@query("src7_manifest_of_subject", with_roles("select path, bytes, task from survey where subject = 'sub-0003'", "survey"))
def _(t):
    return tb.manifest_of(t.survey, "sub-0003").select("path", "bytes", "task")


@query("src8_content_fingerprint", "select doc_id, sha256(text) as sha256 from documents")
def _(t):
    return tb.fingerprint_column(t.documents.select("doc_id", "text"), "text").select("doc_id", "sha256")


# --- sinks -------------------------------------------------------------------


@query("snk1_table_sink", with_roles(QC + f" select subject, task, verdict, '{RUN}' as run_id from q", "sidecars"))
def _(t):
    path = scratch_path(t.spark, "qc")
    sk.write_table(qc_rows(t).select("subject", "task", "verdict"), path, RUN)
    return t.spark.read.parquet(path)


@query("snk2_write_once_versions", "select 'v1' as which, count(*) as n, min('r1') as run_id from customer where c_acctbal > 0 union all select 'current', count(*), 'r2' from customer")
def _(t):
    root = scratch_path(t.spark, "publish")
    sk.publish(t.customer.where("c_acctbal > 0"), root, "customers", "r1")
    try:
        sk.publish(t.customer, root, "customers", "r2")
        raise AssertionError("a second publish must be refused")
    except FileExistsError:
        sk.publish(t.customer, root, "customers", "r2", allow_overwrite=True)
    of = lambda name, d: d.agg(F.count(F.lit(1)).alias("n"), F.max("run_id").alias("run_id")).select(F.lit(name).alias("which"), "n", "run_id")
    return of("v1", sk.read_current(t.spark, root, "customers", 1)).unionByName(of("current", sk.read_current(t.spark, root, "customers")))


@query("snk3_staged_publish", "select o_orderstatus, count(*) as n, 'r9' as run_id from orders group by 1")
def _(t):
    root = scratch_path(t.spark, "staged")
    sk.publish(t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), root, "status", "r9")
    return sk.read_current(t.spark, root, "status")


@query("snk4_mixed_run_refusal", "select 1::bigint as n_runs, 2::bigint as n_tables, 'r1' as run_id")
def _(t):
    a, b = t.customer.withColumn("run_id", F.lit("r1")), t.orders.withColumn("run_id", F.lit("r1"))
    return dq.same_run({"a": a, "b": b})


@query("snk5_overwrite_guard", "select n_name as name, case when n_nationkey % 4 = 0 then 'scratch' when n_nationkey % 4 = 1 then 'live' when n_nationkey % 4 = 2 then 'live' else 'refused' end as target from nation")
def _(t):
    """Decisions for each combination of scratch folder, run and existing
    result, attached to the nations by their key."""
    def decide(scratch, run_id, exists):
        try:
            return sk.resolve_target("live", scratch, run_id, exists)
        except PermissionError:
            return "refused"
    cases = [decide("scratch", None, True), decide(None, "r1", True), decide(None, None, False), decide(None, None, True)]
    pick = F.element_at(F.array(*[F.lit(c) for c in cases]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return t.nation.select(F.col("n_name").alias("name"), pick.alias("target"))


@query("snk6_transfer_log_budget", with_roles("select cast(sum(bytes) as bigint) as total_bytes, true as ok from survey", "survey"))
def _(t):
    path = scratch_path(t.spark, "log")
    e = t.survey.select("path", "bytes", F.lit("ok").alias("outcome"), F.lit("r1").alias("run_id"))
    sk.append_log(e.where("task = 'rest'"), path, 10 ** 18)
    sk.append_log(e.where("task <> 'rest'"), path, 10 ** 18)
    return dq.within_budget(t.spark.read.schema(sk.LOG_DDL).parquet(path), 10 ** 18)


REDERIVE = """select doc_id, case when task = 'rest' then iaf_hz + 1e0 else iaf_hz end as iaf_hz, case when task = 'rest' then 1 else 0 end::bigint as n_history,
   case when task = 'rest' then iaf_hz end as before_hz from sidecars"""


def rederived(t):
    docs = t.sidecars.select("doc_id", F.struct("iaf_hz", (F.col("iaf_hz") > 10).alias("present")).alias("IAF"))
    fresh = t.sidecars.where("task = 'rest'").select("doc_id", F.struct((F.col("iaf_hz") + 1).alias("iaf_hz"), (F.col("iaf_hz") + 1 > 10).alias("present")).alias("IAF"))
    return sk.rederive(docs, fresh, ["doc_id"], "IAF", RUN)


@query("snk7_rederive_with_history", with_roles(REDERIVE, "sidecars"))
def _(t):
    return rederived(t).select("doc_id", "IAF.iaf_hz", F.size("history").cast("bigint").alias("n_history"), F.get("history", F.lit(0))["before"]["iaf_hz"].alias("before_hz"))


@query("snk7_gained_lost", with_roles("select count(*) filter (iaf_hz <= 10 and iaf_hz + 1 > 10) as gained, 0::bigint as lost, count(*) as n_rewritten from sidecars where task = 'rest'", "sidecars"))
def _(t):
    return sk.gained_lost(rederived(t), "IAF", "present")


@query("snk8_resume_pending", with_roles("""select m.subject, bool_and(d.subject is not null) as complete, count(*) filter (d.subject is null) as n_pending from (select distinct subject, task from survey) m
  left join (select distinct subject, task from survey where bytes > 22000000) d on m.subject = d.subject and m.task = d.task group by 1""", "survey"))
def _(t):
    return co.pending_subjects(t.survey, t.survey.where("bytes > 22000000"))


@query("snk9_provenance_document", with_roles("""select doc_id, '{"id":{"subject":"' || subject || '","task":"' || task || '"},"qc":{"n_bad_channels":' || n_bad_channels || ',"occipital_bads":' || occipital_bads || '}}' as document from sidecars""", "sidecars"))
def _(t):
    return sk.provenance_json(t.sidecars, ["doc_id"], {"id": ["subject", "task"], "qc": ["n_bad_channels", "occipital_bads"]})
