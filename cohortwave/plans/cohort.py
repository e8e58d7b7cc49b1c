"""Scalar, join, set, costing and inventory queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formulas as fm, text as tx
from ..operators import aggregates as ag, cohort as co
from .bindings import with_roles
from .registry import query

TASKS = ["F", "O", "P"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

# --- scalar functions -------------------------------------------------------


@query("sca1_entity_parse", with_roles(r"""
  , n as (select rel_path, regexp_extract(rel_path, '([^/]*)$', 1) as name from listing)
  select rel_path, nullif(regexp_extract(name, 'sub-([^_.]+)', 1), '') as sub, nullif(regexp_extract(name, 'task-([^_.]+)', 1), '') as task,
         nullif(regexp_extract(name, 'run-([^_.]+)', 1), '') as run, regexp_extract(name, '([^_.]+)\.', 1) as suffix,
         regexp_extract(name, '(\..*)$', 1) as ext from n""", "listing"))
def _(t):
    p = F.col("rel_path")
    return t.listing.select("rel_path", *[tx.name_entity(p, k).alias(k) for k in ("sub", "task", "run")],
                            tx.name_suffix(p).alias("suffix"), tx.file_extension(p).alias("ext"))


@query("sca2_path_modality_subject", with_roles("""
  select rel_path, case when rel_path like 'sub-%/%' then split_part(rel_path, '/', 1) end as subject,
         case when rel_path like 'sub-%/%' then split_part(rel_path, '/', 2) else 'root' end as modality from listing""", "listing"))
def _(t):
    p = F.col("rel_path")
    return t.listing.select("rel_path", tx.path_subject(p).alias("subject"), tx.path_modality(p).alias("modality"))


@query("sca3_subject_id", with_roles("""
  select participant_id, case when participant_id like 'sub-%' then participant_id
     else concat('sub-', lpad(cast(c_custkey as string), cast(greatest(2, length(cast(c_custkey as string))) as int), '0')) end as subject
  from participants""", "participants"))
def _(t):
    return t.participants.select("participant_id", tx.subject_id(F.col("participant_id")).alias("subject"))


GENO = """, g as (select *, lower(trim(apoe)) as s, trim(picalm) as q from participants),
  k as (select *, case s when 'e3/e3' then 33 when '3/4' then 34 when '33' then 33 when 'e3e4' then 34 when 'e4/e4' then 44 when '44' then 44
        when '2-3' then 23 when '3 4' then 34 when 'e1e4' then 14 when '4_3' then 43 when '3/3' then 33 end as al,
     case when q in ('GG','G/G') or lower(q) = 'gg' then 'GG' when q in ('G/A','A/G') or lower(q) in ('ga','ag') then 'AG' when lower(q) = 'aa' then 'AA' end as pic
     from g),
  geno as (select *, cast(floor(al / 10) as int) as a1, cast(al % 10 as int) as a2,
     case when trim(apoe) in ('', 'NA') then 'no first genotype' when al is null then concat('first genotype not understood: ''', apoe, '''') end as apoe_error,
     case when q = '' then 'no second genotype' when pic is null then concat('second genotype not understood: ''', picalm, '''') end as snp_error,
     case when al = 33 and pic <> 'GG' then 'N' when (al % 10 = 4 or floor(al / 10) = 4) and pic <> 'GG' then 'A_P_minus'
          when (al % 10 = 4 or floor(al / 10) = 4) and pic = 'GG' then 'A_P_plus' else 'UNRESOLVABLE' end as group_derived from k)"""


@query("sca4_allele_pair", with_roles(GENO + " select participant_id, apoe, a1, a2, apoe_error as error from geno", "participants"))
def _(t):
    return t.participants.select("participant_id", "apoe", tx.allele_pair(F.col("apoe")).alias("p")).select(
        "participant_id", "apoe", "p.*")


@query("sca5_snp_pair", with_roles(GENO + " select participant_id, picalm, pic as value, snp_error as error, coalesce(pic = 'GG', false) as risk from geno", "participants"))
def _(t):
    return t.participants.select("participant_id", "picalm", tx.snp_pair(F.col("picalm")).alias("p")).select(
        "participant_id", "picalm", "p.*", F.coalesce(F.col("p.value") == "GG", F.lit(False)).alias("risk"))


@query("sca6_carrier_homozygote", with_roles(GENO + """ select segment, cast(count(*) filter (a1 = 4 or a2 = 4) as bigint) as n_carrier,
  cast(count(*) filter (a1 = 4 and a2 = 4) as bigint) as n_homozygote from geno group by segment""", "participants"))
def _(t):
    d = t.participants.withColumn("p", tx.allele_pair(F.col("apoe")))
    return d.groupBy("segment").agg(F.count_if(tx.carries(F.col("p"), 4)).alias("n_carrier"),
                                    F.count_if(tx.homozygous(F.col("p"), 4)).alias("n_homozygote"))


@query("sca7_derived_group", with_roles(GENO + " select group_derived, count(*) as n from geno group by 1", "participants"))
def _(t):
    d = t.participants.select(tx.derived_group(tx.allele_pair(F.col("apoe")), tx.snp_pair(F.col("picalm"))).alias("group_derived"))
    return d.groupBy("group_derived").agg(F.count(F.lit(1)).alias("n"))


@query("sca8_target_framings", with_roles("""
  select 'binary_risk_vs_none' as framing, case when grp = 'N' then 0 else 1 end as class, count(*) as n from client_list group by 1, 2
  union all select 'binary_high_vs_rest', case when grp = 'A_P_plus' then 1 else 0 end, count(*) from client_list group by 1, 2
  union all select 'multiclass_3', case grp when 'N' then 0 when 'A_P_minus' then 1 else 2 end, count(*) from client_list group by 1, 2""", "client_list"))
def _(t):
    return (t.client_list.select(F.explode(tx.target_framings(F.col("grp"))).alias("f")).select("f.*")
            .groupBy("framing", "class").agg(F.count(F.lit(1)).alias("n")))


@query("sca9_task_key", with_roles("select regexp_replace(task, '^task-', '') as task, count(*) as n from sidecars group by 1", "sidecars"))
def _(t):
    return t.sidecars.groupBy(tx.task_key(F.col("task")).alias("task")).agg(F.count(F.lit(1)).alias("n"))


@query("sca10_tolerant_casts", """
  select event_id, coalesce(try_cast(regexp_replace(props, '[^0-9a-z]', '', 'g') as double), 0e0) as num,
         event_type = 'view' as yes, event_type = 'error' as no from events""")
def _(t):
    raw = F.regexp_replace("props", "[^0-9a-z]", "")
    mark = F.when(F.col("event_type") == "view", " True ").when(F.col("event_type") == "error", "FALSE").otherwise("maybe")
    return t.events.select("event_id", tx.to_float(raw).alias("num"), tx.is_true(mark).alias("yes"), tx.is_false(mark).alias("no"))


@query("sca11_near_names", """
  select p_partkey, levenshtein(p_name, concat(p_type, p_brand)) as distance, levenshtein(p_name, replace(p_name, 'ring', 'rng')) <= 2 as near from part""")
def _(t):
    n = F.col("p_name")
    return t.part.select("p_partkey", F.levenshtein(n, F.concat("p_type", "p_brand")).alias("distance"),
                         tx.near_name(n, F.regexp_replace(n, "ring", "rng")).alias("near"))


@query("sca12_header_fields", with_roles(r"""
  select stem, trim(regexp_extract(vhdr_text, 'DataFile=([^\n]+)', 1)) as datafile, trim(regexp_extract(vhdr_text, 'MarkerFile=([^\n]+)', 1)) as markerfile,
     array_to_string(regexp_extract_all(vhdr_text, 'Ch\d+=([^,\n]*)', 1), '|') as channels from headers""", "headers"))
def _(t):
    h = F.col("vhdr_text")
    return t.headers.select("stem", tx.header_field(h, "DataFile").alias("datafile"), tx.header_field(h, "MarkerFile").alias("markerfile"),
                            F.array_join(tx.header_channels(h), "|").alias("channels"))


@query("sca13_marker_codes", with_roles(r"""
  select event_id, cast(nullif(regexp_extract(description, 'S\s*(\d+)\s*$', 1), '') as int) as code,
     trim(regexp_extract(description, '([^/]*)$', 1)) as label from annotations""", "annotations"))
def _(t):
    d = F.col("description")
    return t.annotations.select("event_id", tx.marker_code(d).alias("code"), tx.marker_label(d).alias("label"))


CHANNELS = ["Fp1", "AFz", "FC3", "Cz", "CPz", "P7", "POz", "O2", "Iz", "FT9", "T8", "TP10", "F", "Fx", "X1"]
ZONES = ["frontal", "frontal", "central", "central", "central", "parietal", "parietal", "occipital", "occipital",
         "temporal", "temporal", "temporal", "frontal", None, None]


@query("sca14_channel_zone", "select vec_id, case vec_id % 15 " + " ".join(
    f"when {i} then '{c}'" for i, c in enumerate(CHANNELS)) + " end as ch, case vec_id % 15 " + " ".join(
    f"when {i} then " + (f"'{z}'" if z else "null") for i, z in enumerate(ZONES)) + " end as zone from embeddings")
def _(t):
    ch = F.element_at(F.array(*[F.lit(c) for c in CHANNELS]), (F.col("vec_id") % 15 + 1).cast("int"))
    return t.embeddings.select("vec_id", ch.alias("ch"), tx.channel_zone(ch).alias("zone"))


@query("sca15_duration_from_bytes", with_roles("""
  select path, round(bytes / 5.08e2 / 1e3, 6) as duration_s, round(bytes / 5.12e2 / 1e3, 6) as duration_128_s
  from survey where modality = 'eeg' and path like '%.eeg'""", "survey"))
def _(t):
    d = t.survey.where((F.col("modality") == "eeg") & F.col("path").endswith(".eeg"))
    return d.select("path", F.round(fm.duration_s(F.col("bytes")), 6).alias("duration_s"),
                    F.round(fm.duration_s(F.col("bytes"), fm.DOCUMENTED_CHANNELS), 6).alias("duration_128_s"))


@query("sca16_footprint_model", with_roles("""
  , b as (select task, count(distinct subject) as n, avg(bytes / 5.12e2 / 1e3) as dur from survey where modality = 'eeg' and path like '%.eeg' group by task)
  select task, round(n * 128e0 * dur * 250e0 * 4e0 / 1073741824e0, 2) as preprocessed_gb, round(n * 128e0 * dur * 250e0 * 6e0 / 1073741824e0, 2) as epoched_gb,
     round(n * 128e0 * dur * 250e0 * 4e0 / 1073741824e0, 2) as ica_gb, round(n * 128e0 * dur * 250e0 * 14e0 / 1073741824e0, 2) as total_gb from b""", "survey"))
def _(t):
    d = t.survey.where((F.col("modality") == "eeg") & F.col("path").endswith(".eeg"))
    b = d.groupBy("task").agg(F.countDistinct("subject").alias("n"), F.avg(fm.duration_s(F.col("bytes"), 128)).alias("dur"))
    return b.select("task", *[c.alias(k) for k, c in fm.footprint(F.col("n"), F.lit(128.0), F.col("dur"), 250).items()])


@query("sca17_harmonic_collision", with_roles("""
  select doc_id, iaf_hz, iaf_hz <> 0 and abs(5e0 * iaf_hz - 5e1) < 1e0 as collision from sidecars""", "sidecars"))
def _(t):
    return t.sidecars.select("doc_id", "iaf_hz", fm.harmonic_collision(F.col("iaf_hz")).alias("collision"))


@query("sca18_nearest_harmonic", with_roles("""
  , k as (select doc_id, iaf_hz, unnest([1, 2, 3, 4, 5]) as k from sidecars)
  select doc_id, cast(arg_min(k, abs(k * iaf_hz - 5e1) + k * 1e-13) as int) as harmonic from k group by doc_id""", "sidecars"))
def _(t):
    return t.sidecars.select("doc_id", fm.nearest_harmonic(F.col("iaf_hz")).alias("harmonic"))


RATES = {"rest": 500, "msit": 250, "sternberg": 250}


@query("sca19_task_rate_lookup", with_roles("""
  select subject, task, case task when 'rest' then 500 else 250 end as rate_hz from
    (select subject, regexp_replace(task, '^task-', '') as task from sidecars) x""", "sidecars"))
def _(t):
    rates = F.create_map(*[c for k, v in RATES.items() for c in (F.lit(k), F.lit(v))])
    task = tx.task_key(F.col("task"))
    rate = F.coalesce(rates[F.col("task")], F.raise_error(F.concat(F.lit("no rate for task "), F.col("task"))).cast("int"))
    return t.sidecars.select("subject", task.alias("task")).select("subject", "task", rate.alias("rate_hz"))


@query("sca20_column_roles", with_roles("select participant_id as subject_id, apoe, picalm from participants", "participants"))
def _(t):
    """Rows projected through a resolved role map; a stale map would raise."""
    roles = co.resolve_roles(t.participants, {"subject_id": "participant_id", "apoe": "apoe", "picalm": "picalm"})
    return t.participants.select(*[F.col(c).alias(r) for r, c in roles.items()])


AUC_SQL = """ with c as (select lang, count(*) filter (quality = 1) as n1, count(*) filter (quality = 0) as n0,
     count(*) filter (quality = 1) / (count(*) + 1e0) as auc from documents d join labels l on d.doc_id = l.doc_id group by lang),
  e as (select *, sqrt((auc * (1 - auc) + (n1 - 1) * (auc / (2e0 - auc) - auc * auc) + (n0 - 1) * (2e0 * auc * auc / (1e0 + auc) - auc * auc)) / (n1 * n0)) as se from c)
  select lang, round(auc, 6) as auc, round(se, 6) as se, round(auc - 1.96e0 * se, 6) as lo, round(auc + 1.96e0 * se, 6) as hi, auc - 1.96e0 * se > 5e-1 as clears from e"""


@query("sca21_auc_standard_error", AUC_SQL)
def _(t):
    c = t.labelled.groupBy("lang").agg(F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0"))
    c = c.withColumn("auc", F.col("n1") / (F.col("n1") + F.col("n0") + 1.0))
    c = c.withColumn("se", fm.auc_standard_error(F.col("auc"), F.col("n1"), F.col("n0")))
    lo, hi = F.col("auc") - F.lit(1.96) * F.col("se"), F.col("auc") + F.lit(1.96) * F.col("se")
    return c.select("lang", F.round("auc", 6).alias("auc"), F.round("se", 6).alias("se"), F.round(lo, 6).alias("lo"),
                    F.round(hi, 6).alias("hi"), (lo > 0.5).alias("clears"))


@query("sca22_resolved_params", with_roles("""
  select doc_id, coalesce(expected_s, case when n_bad_channels > 2 then duration_s end, 6e2) as duration,
     case when expected_s is not null then 'sidecar' when n_bad_channels > 2 then 'listing-derived' else 'documented' end as source from sidecars""", "sidecars"))
def _(t):
    v, s = fm.resolved(("sidecar", F.col("expected_s")), ("listing-derived", F.when(F.col("n_bad_channels") > 2, F.col("duration_s"))),
                       ("documented", F.lit(600.0)), what="duration")
    return t.sidecars.select("doc_id", v.alias("duration"), s.alias("source"))


# --- joins ------------------------------------------------------------------


@query("jn1_features_labels_inner", "select e.vec_id, e.label, l.quality from embeddings e join labels l on e.vec_id = l.doc_id")
def _(t):
    return t.embeddings.select("vec_id", "label").join(t.labels.select(F.col("doc_id").alias("vec_id"), "quality"), "vec_id")


@query("jn2_assemble_feature_sets", """
  select d.doc_id as subject, d.n_chars as f, e.label as f_vectors, l.quality, c.turns
  from documents d join embeddings e on d.doc_id = e.vec_id left join (select conv_id, count(*) as turns from conversations group by 1) c on c.conv_id = d.doc_id
  left join labels l on l.doc_id = d.doc_id""")
def _(t):
    sets = {"text": t.documents.select(F.col("doc_id").alias("subject"), F.col("n_chars").alias("f")),
            "vectors": t.embeddings.select(F.col("vec_id").alias("subject"), F.col("label").alias("f"))}
    nuisance = t.conversations.groupBy(F.col("conv_id").alias("subject")).agg(F.count(F.lit(1)).alias("turns"))
    return co.assemble(sets, t.labels.select(F.col("doc_id").alias("subject"), "quality"), nuisance)


@query("jn3_nuisance_full_outer", """
  select coalesce(a.subject, b.subject) as subject, a.total, b.bal from (select o_custkey as subject, count(*) as total from orders where o_totalprice > 300000 group by 1) a
  full outer join (select c_custkey as subject, c_acctbal as bal from customer where c_acctbal > 0) b on a.subject = b.subject""")
def _(t):
    a = t.orders.where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("subject")).agg(F.count(F.lit(1)).alias("total"))
    b = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("subject"), F.col("c_acctbal").alias("bal"))
    return co.nuisance_table(a, b)


@query("jn4_surviving_rows", with_roles("""
  select doc_id, s.subject, s.task from sidecars s join (select subject, task from sidecars where artifact_frac < 4e-1) k on s.subject = k.subject and s.task = k.task""", "sidecars"))
def _(t):
    keep = t.sidecars.where("artifact_frac < 0.4").select("subject", "task")
    return t.sidecars.select("doc_id", "subject", "task").join(keep, ["subject", "task"], "left_semi")


@query("jn5_group_lookup", """select o_orderkey, c_mktsegment as grp from orders join customer on o_custkey = c_custkey where c_acctbal > 0""")
def _(t):
    groups = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("grp"))
    return co.attach_group(t.orders.select("o_orderkey", F.col("o_custkey").alias("subject")), groups).drop("subject")


@query("jn6_semi_join_cohort", "select o_orderkey, o_totalprice from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def _(t):
    cohort = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(cohort, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("jn7_listed_but_absent", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def _(t):
    return t.customer.select("c_custkey").join(t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


RECON = GENO + """, r as (select case when participant_id like 'sub-%' then participant_id
       else concat('sub-', lpad(cast(c_custkey as string), cast(greatest(2, length(cast(c_custkey as string))) as int), '0')) end as subject, * from geno),
  rec as (select coalesce(r.subject, c.subject) as subject, coalesce(r.apoe, '') as apoe_raw, coalesce(r.picalm, '') as picalm_raw,
     case when r.subject is null then '' else coalesce('ERROR: ' || apoe_error, a1 || '/' || a2) end as apoe_norm,
     case when r.subject is null then '' else coalesce('ERROR: ' || snp_error, pic) end as picalm_norm,
     coalesce(r.group_derived, '') as group_derived, coalesce(c.grp, 'NOT_IN_CLIENT_LIST') as group_client,
     case when r.subject is null then 'MISSING_FROM_TSV' when c.grp is null then 'GENETIC_COHORT_ONLY' when r.group_derived = c.grp then 'RECONCILED' else 'MISMATCH' end as status
     from r full outer join client_list c on r.subject = c.subject)"""


def reconciled(t):
    return co.reconcile(t.participants, t.client_list, "participant_id", "apoe", "picalm")


@query("jn8_reconcile", with_roles(RECON + " select * from rec", "participants", "client_list"))
def _(t):
    return reconciled(t)


@query("dq5_stop_gate", with_roles(RECON + """ select count(*) filter (status in ('MISMATCH','MISSING_FROM_TSV')) as n_blocking, count(*) as n_rows,
  case when count(*) filter (status in ('MISMATCH','MISSING_FROM_TSV')) > 2 then 'STOP' else 'PROCEED' end as verdict from rec""", "participants", "client_list"))
def _(t):
    return co.stop_gate(reconciled(t))


@query("jn9_cohort_flags", """
  with l as (select c_custkey as subject from customer where c_acctbal > 0), tb as (select c_custkey as subject from customer where c_nationkey < 20 ),
  d as (select distinct o_custkey as subject from orders), u as (select subject from l union select subject from tb)
  select subject, subject in (select subject from l) as in_client_list, subject in (select subject from tb) as in_participants_tsv,
     subject in (select subject from d) as has_any_eeg,
     subject in (select subject from l) and subject in (select subject from tb) and subject in (select subject from d) as final_include from u""")
def _(t):
    s = F.col("c_custkey").alias("subject")
    return co.cohort_flags(t.customer.where("c_nationkey < 20").select(s), t.customer.where("c_acctbal > 0").select(s),
                           t.orders.select(F.col("o_custkey").alias("subject")))


@query("jn12_triplet_integrity", with_roles(r"""
  , h as (select dir, stem, trim(regexp_extract(vhdr_text, 'DataFile=([^\n]+)', 1)) as df, trim(regexp_extract(vhdr_text, 'MarkerFile=([^\n]+)', 1)) as mf from headers),
  j as (select h.*, a.bytes as de, b.bytes as dm, b.head as dmh, c.bytes as ce, d.bytes as cm, d.head as cmh,
        stem || '.eeg' as canon, stem || '.vmrk' as canonm from h
     left join files a on a.path = dir || '/' || df left join files b on b.path = dir || '/' || mf
     left join files c on c.path = dir || '/' || stem || '.eeg' left join files d on d.path = dir || '/' || stem || '.vmrk'),
  k as (select *, coalesce((de is null or dm is null) and ce is not null and cm is not null and
        (coalesce(trim(regexp_extract(cmh, 'DataFile=([^\n]+)', 1)) = df, false) or (levenshtein(df, canon) <= 2 and levenshtein(mf, canonm) <= 2)), false) as fb from j),
  m as (select *, case when fb then ce else de end as eb, case when fb then canon else df end as en, case when fb then cm else dm end as mb,
        trim(regexp_extract(case when fb then cmh else dmh end, 'DataFile=([^\n]+)', 1)) as nm from k),
  s as (select *, case when df = '' then 'no_datafile_field' when mf = '' then 'no_markerfile_field' when eb is null then 'orphaned_header'
        when mb is null then 'missing_marker_file' when eb = 0 then 'zero_byte_data'
        when nm <> '' and nm <> df and nm <> en and not (fb and levenshtein(nm, en) <= 2) then 'inconsistent_triplet' else 'ok' end as status from m)
  select dir, stem, df as datafile, mf as markerfile, status, fb as header_discrepancy, case when status = 'ok' then en end as resolved_data from s""", "headers", "files"))
def _(t):
    return co.triplet_status(t.headers, t.files)


@query("jn13_nearest_sensors", with_roles("""
  , p as (select rec, channel, max(samples[1]) as x, max(samples[2]) as y, max(samples[3]) as z from signal where block_id = 0 group by 1, 2),
  d as (select a.rec, a.channel, b.channel as neighbour, sqrt((a.x::double - b.x) * (a.x::double - b.x) + (a.y::double - b.y) * (a.y::double - b.y) + (a.z::double - b.z) * (a.z::double - b.z)) as distance
        from p a join p b on a.rec = b.rec and a.channel <> b.channel)
  select * from (select rec, channel, cast(row_number() over (partition by rec, channel order by distance, neighbour) as int) as rank, neighbour, round(distance, 6) as distance from d) where rank <= 3""", "signal"))
def _(t):
    at = lambda i: F.max(F.col("samples")[i].cast("double"))
    pos = t.signal.where("block_id = 0").groupBy("rec", "channel").agg(at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))
    return co.nearest_sensors(pos, ["rec"], 3).withColumn("distance", F.round("distance", 6))


@query("jn14_paired_conditions", """
  with a as (select conv_id, count(*) as n, sum(length(text)) as chars from conversations where role = 'user' group by 1),
  b as (select conv_id, count(*) as n, sum(length(text)) as chars from conversations where role = 'assistant' group by 1)
  select a.conv_id, 'closed' as condition, 1 as y, a.n, cast(a.chars as bigint) as chars from a join b on a.conv_id = b.conv_id
  union all select b.conv_id, 'open', 0, b.n, cast(b.chars as bigint) from a join b on a.conv_id = b.conv_id""")
def _(t):
    g = lambda r: t.conversations.where(F.col("role") == r).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    return co.stack_conditions(g("user"), g("assistant"), "conv_id", ["n", "chars"])


@query("jn15_optional_enrichment", """
  with a as (select o_custkey as subject, count(*) as n_f from orders where o_orderstatus = 'F' and o_totalprice > 200000 group by 1),
  b as (select o_custkey as subject, sum(o_totalprice) as v_p from orders where o_orderstatus = 'P' and o_totalprice > 200000 group by 1)
  select coalesce(a.subject, b.subject) as subject, n_f, round(v_p, 4) as v_p from a full outer join b on a.subject = b.subject""")
def _(t):
    o = t.orders.where("o_totalprice > 200000").withColumnRenamed("o_custkey", "subject")
    a = o.where("o_orderstatus = 'F'").groupBy("subject").agg(F.count(F.lit(1)).alias("n_f"))
    b = o.where("o_orderstatus = 'P'").groupBy("subject").agg(F.round(F.sum("o_totalprice"), 4).alias("v_p"))
    return co.optional_enrichment([t.customer.select(F.col("c_custkey").alias("subject"))], [a, b])


@query("jn16_transfer_plan", with_roles("""
  select s.path, s.bytes, case when p.have is null then 'fetch' when p.have = s.bytes then 'skip' else 'quarantine' end as action
  from survey s left join (select path, case when modality = 'beh' then bytes + 1 else bytes end as have from survey where task <> 'sternberg') p on s.path = p.path""", "survey"))
def _(t):
    have = t.survey.where("task <> 'sternberg'").select("path", F.when(F.col("modality") == "beh", F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"))
    return co.transfer_plan(t.survey.select("path", "bytes"), have)


# --- aggregations -----------------------------------------------------------


@query("agg1_bytes_by_modality_task", with_roles("""
  select 'modality' as level, modality as name, cast(sum(bytes) as bigint) as bytes from survey group by modality
  union all select 'task', task, cast(sum(bytes) as bigint) from survey group by task
  union all select 'total', null, cast(sum(bytes) as bigint) from survey""", "survey"))
def _(t):
    return ag.bytes_by(t.survey)


@query("agg2_inventory", with_roles("select subject, grp, " + ", ".join(
    f"count(*) filter (task = '{k}') > 0 as has_{k}, cast(coalesce(sum(bytes) filter (task = '{k}'), 0) as bigint) as bytes_{k}" for k in TASKS)
    + ", cast(sum(bytes) as bigint) as total_bytes from task_files group by 1, 2", "task_files"))
def _(t):
    return ag.inventory(t.task_files, TASKS, ["grp"])


@query("agg3_effective_n", with_roles("select task, " + ", ".join(
    f"count(distinct subject) filter (grp = '{g}') as {g}" for g in SEGMENTS) + ", count(distinct subject) as total from task_files group by task", "task_files"))
def _(t):
    return ag.effective_n(ag.inventory(t.task_files, TASKS, ["grp"]), TASKS, SEGMENTS)


MISS = """ with k as (select distinct o_orderstatus as task from orders), s as (select distinct o_custkey as subject, c_mktsegment as grp from orders join customer on o_custkey = c_custkey),
  h as (select distinct o_custkey as subject, o_orderstatus as task from orders),
  inv as (select s.subject, s.grp, k.task, h.subject is not null as has from s cross join k left join h on h.subject = s.subject and h.task = k.task),
  n as (select task, grp, count(*) as n_total, count(*) filter (has) as n_have, count(*) filter (not has) as n_missing from inv group by 1, 2),
  e as (select *, cast(n_total as double) * sum(n_have) over w / sum(n_total) over w as eh, cast(n_total as double) * sum(n_missing) over w / sum(n_total) over w as em from n window w as (partition by task)),
  x as (select *, sum((n_have - eh) ** 2 / nullif(eh, 0) + (n_missing - em) ** 2 / nullif(em, 0)) over (partition by task) as c from e)"""


@query("agg4_missingness_by_group", MISS + """ select task, grp, n_total, n_have, n_missing, round(c, 6) as chi2, 'chi-square (missing x group)' as missingness_test,
   round(exp(-c / 2) * (1 + c / 2), 6) as missingness_p from x""")
def _(t):
    return ag.missingness_by_group(ag.inventory(t.task_files, TASKS, ["grp"]), TASKS)


@query("agg4_missing_subjects", MISS + " select task, grp, subject from inv where not has")
def _(t):
    return ag.missing_subjects(ag.inventory(t.task_files, TASKS, ["grp"]), TASKS)


@query("agg5_missing_concentration", MISS + """ select task, cast(sum(n_missing) as bigint) as n_missing, max(n_missing) as n_largest,
   first(grp order by n_missing desc, grp) as largest_group, count(*) = 1 as single_group from n where n_missing > 0 group by task""")
def _(t):
    return ag.missing_concentration(ag.inventory(t.task_files, TASKS, ["grp"]), TASKS)


@query("agg6_budget", with_roles("""
  , e as (select task, bytes, bytes / 5.08e2 / 1e3 as dur, case task when 'rest' then 5e2 else 2.5e2 end as rate from survey where modality = 'eeg' and path like '%.eeg')
  select task, count(*) as n, round(avg(dur), 1) as mean_duration_s, round(min(dur), 1) as min_duration_s, round(max(dur), 1) as max_duration_s,
     round(sum(bytes) / 1073741824e0, 2) as raw_gb, round(sum(dur * 127e0 * rate * 4e0) / 1073741824e0, 2) as derivative_gb from e group by rollup(task)""", "survey"))
def _(t):
    return ag.budget(t.survey, RATES)


SCOPES = {"A_full_eeg": ["msit", "rest", "sternberg"], "B_rest_msit": ["msit", "rest"], "C_rest_msit_only": ["msit", "rest"]}
SCOPE_SQL = """, f as (select unnest(case when task = 'sternberg' then ['A_full_eeg'] else ['A_full_eeg', 'B_rest_msit', 'C_rest_msit_only'] end) as scope, bytes from survey where modality = 'eeg'),
  sc as (select scope, count(*) as n_files, cast(sum(bytes) as bigint) as raw_bytes, round(sum(bytes) / 1073741824e0, 2) as raw_gb from f group by scope)"""


@query("agg7_scope_costs", with_roles(SCOPE_SQL + " select * from sc", "survey"))
def _(t):
    return ag.scope_costs(t.survey, SCOPES)


@query("lim2_recommend_scope", with_roles(SCOPE_SQL + """ select coalesce((select scope from sc where raw_gb * 2e0 <= 9.5e1 order by scope desc limit 1), 'NONE_FITS') as scope,
   (select count(*) from sc where raw_gb * 2e0 <= 9.5e1) as n_fitting""", "survey"))
def _(t):
    costs = ag.scope_costs(t.survey, SCOPES)
    return ag.recommend_scope(costs, F.col("raw_gb"), ["C_rest_msit_only", "B_rest_msit", "A_full_eeg"], 95)


@query("lim1_peak_coresident", with_roles("""
  , s as (select subject, sum(bytes) as b from survey where modality = 'eeg' and path like '%.eeg' group by 1), tp as (select b from s order by b desc, subject limit 2)
  select round(sum(b) / 1073741824e0, 4) as peak_gb, count(*) as n_subjects from tp""", "survey"))
def _(t):
    return ag.peak_coresident_gb(t.survey)


@query("win1_manifest_running_total", with_roles("""
  select path, bytes, modality, subject, task, 'B_rest_msit' as scope, cast(sum(bytes) over (order by path range between unbounded preceding and current row) as bigint) as running_total_bytes
  from survey where modality = 'eeg' and task in ('rest', 'msit')""", "survey"))
def _(t):
    return ag.manifest(t.survey, ["rest", "msit"], "B_rest_msit")


@query("agg14_modal_value", "select c_mktsegment, first(c_nationkey order by n desc, c_nationkey) as mode, max(n) as n_mode from (select c_mktsegment, c_nationkey, count(*) as n from customer group by 1, 2) group by 1")
def _(t):
    return ag.modal_value(t.customer, ["c_mktsegment"], "c_nationkey")


@query("agg15_contingency_table", "select c_mktsegment, count(*) filter (o_orderstatus = 'F') as o_orderstatus_F, count(*) filter (o_orderstatus = 'O') as o_orderstatus_O, count(*) filter (o_orderstatus = 'P') as o_orderstatus_P from orders join customer on o_custkey = c_custkey group by 1")
def _(t):
    d = t.orders.select("o_custkey", "o_orderstatus").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return ag.crosstab(d, "c_mktsegment", "o_orderstatus", TASKS)


PROFILED = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query("agg16_column_profile", "with l as (" + " union all ".join(
    f"select '{c}' as \"column\", '{ty}' as dtype, cast({c} as string) as v from part" for c, ty in
    zip(PROFILED, ["string", "string", "string", "int", "double"])) + """), d as (select "column", dtype, v, count(*) as n from l where v is not null group by 1, 2, 3),
  r as (select *, row_number() over (partition by "column" order by v) as k from d)
  select "column", dtype, count(*) as n_unique, cast(sum(n) as bigint) as n_values, string_agg(v, ',' order by v) filter (k <= 5) as samples from r group by 1, 2""")
def _(t):
    return ag.value_profile(t.part, PROFILED)


@query("agg17_feature_defects", """
  select 'f1' as feature, min(f1) = max(f1) as constant, avg(case when f1 is null then 1e0 else 0e0 end) as missing_frac, avg(case when f1 is null then 1e0 else 0e0 end) > 5e-1 as over_limit from (select cast(n_chars as double) as f1 from documents)
  union all select 'f2', true, 0e0, false
  union all select 'f3', min(f) = max(f), avg(case when f is null then 1e0 else 0e0 end), avg(case when f is null then 1e0 else 0e0 end) > 5e-1 from (select case when doc_id % 4 = 0 then cast(n_chars as double) end as f from documents)""")
def _(t):
    d = t.documents.select(F.col("n_chars").cast("double").alias("f1"), F.lit(1.0).alias("f2"),
                           F.when(F.col("doc_id") % 4 == 0, F.col("n_chars").cast("double")).otherwise(F.lit(float("nan"))).alias("f3"))
    return ag.feature_defects(d, ["f1", "f2", "f3"])


@query("agg24_keep_first", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts, event_id) as r from events) where r = 1")
def _(t):
    d = t.events.select("user_id", "event_id", "event_type", "ts")
    return co.keep_first(d, "user_id", ["ts", "event_id"]).drop("ts")


@query("agg13_category_shares", "select c_mktsegment, o_orderstatus, count(*) as count, round(1e2 * count(*) / sum(count(*)) over (partition by c_mktsegment), 1) as pct from orders join customer on o_custkey = c_custkey group by 1, 2")
def _(t):
    d = t.orders.join(t.customer.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    return ag.category_shares(d, "c_mktsegment", "o_orderstatus")


@query("lim5_total_order", with_roles("select subject, task, doc_id from sidecars order by subject, task", "sidecars"))
def _(t):
    return t.sidecars.select("subject", "task", "doc_id").orderBy("subject", "task")


# --- set operations ---------------------------------------------------------

@query("set1_union_ids", "select c_custkey as id from customer union select o_custkey from orders")
def _(t):
    return t.customer.select(F.col("c_custkey").alias("id")).union(t.orders.select("o_custkey")).distinct()


@query("set2_difference_ids", "select c_custkey as id from customer except select o_custkey from orders where o_totalprice > 300000")
def _(t):
    return t.customer.select(F.col("c_custkey").alias("id")).subtract(t.orders.where("o_totalprice > 300000").select("o_custkey"))


@query("set3_intersection_ids", "select c_custkey as id from customer intersect select o_custkey from orders")
def _(t):
    return t.customer.select(F.col("c_custkey").alias("id")).intersect(t.orders.select("o_custkey"))


@query("set4_disjoint_split", "select (select count(*) from (select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus <> 'F')) as n_shared, false as ok")
def _(t):
    o = t.orders
    return co.disjoint(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), ["o_custkey"])


@query("set5_concat_missing_columns", "select c_custkey as id, c_acctbal as bal, null::bigint as items from customer union all select p_partkey, null, p_size from part")
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))
    b = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("bigint").alias("items"))
    return a.unionByName(b, allowMissingColumns=True)
