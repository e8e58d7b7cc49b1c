"""Rule tables, gates and checks. A gate is a column that fails the job when
its condition does not hold; rule tables produce rows and never fail."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import formulas as fm, text as tx
from ..functions.shape import unpivot

# QC thresholds.
LIMITS = {"bad_channels_warn": 4, "bad_channels_fail": 8, "occipital_warn": 3, "occipital_fail": 5,
          "ica_removed_frac_warn": 0.25, "ica_removed_frac_fail": None, "artifact_frac_warn": 0.20, "artifact_frac_fail": 0.40,
          "line_noise_before": 1.5, "line_noise_after": 1.5, "min_duration_frac": 0.6, "alpha_tasks": ["rest"],
          "max_bad_channels": 10, "max_occipital_bads": 5, "notch_width_hz": 1.0, "margin_hz": 0.5}
# Texts of flags that readers of the verdict table match.
LINE_TEXT = ("line-noise removal failed: 50 Hz index ", " after treatment (before ", ")")
ALPHA_TEXT = "no identifiable alpha peak (rest)"
LABEL_COLUMNS = {"group", "label", "labels", "risk_vs_none", "high_vs_lownormal", "task1_risk_vs_norisk",
                 "task2_high_vs_lownormal", "task3_multiclass", "multiclass"}


def flatten_sidecar(doc: DataFrame) -> DataFrame:
    """Nested document -> the flat columns the rules read."""
    return doc.select(
        F.coalesce("ParticipantID", F.lit("unknown")).alias("subject"), F.coalesce("TaskName", F.lit("?")).alias("task"),
        F.col("Duration.s").alias("duration_s"), F.col("Duration.n_samples_final").alias("n_samples_final"),
        F.col("BadChannels.n").alias("n_bad_channels"), F.array_join("BadChannels.names", ",").alias("bad_channels"),
        F.col("BadChannels.occipital_bads").alias("occipital_bads"), F.col("ICA.n_components").alias("n_ica_components"),
        F.size("ICA.excluded_components").alias("n_ica_removed"), F.array_join("ICA.excluded_labels", ",").alias("ica_removed_labels"),
        F.col("ICA.labeling").alias("ica_labeling"), F.col("LineNoiseRemoval.method").alias("line_noise_method"),
        F.col("LineNoisePower.before_index").alias("line_before"), F.col("LineNoisePower.after_index").alias("line_after"),
        F.col("IAF.iaf_hz").alias("iaf_hz"), F.col("IAF.peak_height_db").alias("alpha_peak_height_db"),
        F.coalesce("IAF.present", F.lit(False)).alias("alpha_present"), F.col("ArtifactAnnotation.fraction").alias("artifact_frac"))


def _pct(c: Column) -> Column:
    return F.concat(F.rint(c * 100).cast("bigint").cast("string"), F.lit("%"))


def _num(c: Column) -> Column:
    return F.rint(c).cast("bigint").cast("string")


def _over(value: Column, text: Column, warn, fail, warn_text: str, fail_text: str) -> tuple[Column, Column]:
    failed = (value >= fail) if fail is not None else F.lit(False)
    return (F.when(failed, F.concat(text, F.lit(f" (>= {fail_text})"))),
            F.when(~failed & (value > warn), F.concat(text, F.lit(f" (> {warn_text})"))))


def classify(d: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """Ordered fail and warn rules -> verdict and ';'-joined flags, fails
    first. Needs the flat sidecar columns plus expected_s (may be NULL)."""
    q = limits
    s = lambda c: F.col(c).cast("string")
    frac = F.col("n_ica_removed") / F.greatest(F.col("n_ica_components"), F.lit(1))
    pct = lambda v: f"{v:.0%}" if v is not None else ""
    bad = _over(F.col("n_bad_channels"), F.concat(s("n_bad_channels"), F.lit(" bad channels")), q["bad_channels_warn"], q["bad_channels_fail"], str(q["bad_channels_warn"]), str(q["bad_channels_fail"]))
    occ = _over(F.col("occipital_bads"), F.concat(s("occipital_bads"), F.lit(" occipital bads")), q["occipital_warn"], q["occipital_fail"], str(q["occipital_warn"]), str(q["occipital_fail"]))
    ica = _over(frac, F.concat(_pct(frac), F.lit(" ICA removed")), q["ica_removed_frac_warn"], q["ica_removed_frac_fail"], pct(q["ica_removed_frac_warn"]), pct(q["ica_removed_frac_fail"]))
    art = _over(F.col("artifact_frac"), F.concat(F.lit("artifact "), _pct(F.col("artifact_frac"))), q["artifact_frac_warn"], q["artifact_frac_fail"], pct(q["artifact_frac_warn"]), pct(q["artifact_frac_fail"]))
    line = F.when((F.coalesce("line_before", F.lit(0.0)) > q["line_noise_before"]) & (F.coalesce("line_after", F.lit(0.0)) > q["line_noise_after"]),
                  F.concat(F.lit(LINE_TEXT[0]), s("line_after"), F.lit(LINE_TEXT[1]), s("line_before"), F.lit(LINE_TEXT[2])))
    need = F.col("expected_s") * F.lit(q["min_duration_frac"])
    trunc = F.when((F.col("expected_s") != 0) & (F.col("duration_s") < need), F.concat(F.lit("truncated: "), _num(F.col("duration_s")), F.lit("s < "), _num(need), F.lit("s expected")))
    alpha = F.when(tx.task_key(F.col("task")).isin(q["alpha_tasks"]) & ~F.coalesce("alpha_present", F.lit(False)), F.lit(ALPHA_TEXT))
    fails = F.array_compact(F.array(bad[0], occ[0], ica[0], art[0], line, trunc, alpha))
    warns = F.array_compact(F.array(bad[1], occ[1], ica[1], art[1]))
    out = d.withColumn("__f", fails).withColumn("__w", warns)
    return (out.withColumn("ica_removed_frac", F.round(frac, 3))
            .withColumn("fifth_harmonic_collision", fm.harmonic_collision(F.coalesce("iaf_hz", F.lit(0.0)), q["notch_width_hz"], q["margin_hz"]))
            .withColumn("verdict", F.when(F.size("__f") > 0, "fail").when(F.size("__w") > 0, "warn").otherwise("pass"))
            .withColumn("flags", F.array_join(F.concat("__f", "__w"), ";")).drop("__f", "__w"))


def freeze_exclusions(qc: DataFrame, run_id: str, limits: dict = LIMITS) -> DataFrame:
    """One row per excluded subject with its distinct reasons. A subject has a
    few (task, rule) reasons; duplicates are removed before they are joined."""
    q = limits
    fail = F.when(F.col("verdict") == "fail", F.concat("task", F.lit(": "), "flags"))
    many = F.when(F.col("n_bad_channels") >= q["max_bad_channels"], F.concat(F.col("n_bad_channels").cast("string"), F.lit(f" bad channels >= {q['max_bad_channels']}")))
    occ = F.when(tx.task_key(F.col("task")).isin(q["alpha_tasks"]) & (F.col("occipital_bads") >= q["max_occipital_bads"]),
                 F.concat(F.col("occipital_bads").cast("string"), F.lit(f" occipital bads (alpha sites) >= {q['max_occipital_bads']}")))
    r = qc.select("subject", F.explode(F.array_compact(F.array(fail, many, occ))).alias("reason")).distinct()
    return r.groupBy("subject").agg(F.array_join(F.array_sort(F.collect_set("reason")), " | ").alias("reason")).withColumn("run_id", F.lit(run_id))


def verdict_counts(qc: DataFrame) -> DataFrame:
    c = lambda v: F.count_if(F.col("verdict") == v)
    return qc.agg(F.count(F.lit(1)).alias("n_rows"), c("pass").alias("n_pass"), c("warn").alias("n_warn"), c("fail").alias("n_fail"))


def exclusions_per_group(excluded: DataFrame, groups: DataFrame) -> DataFrame:
    """Counts per group after the freeze; the ids stay in `excluded`."""
    j = excluded.join(groups, "subject", "left").withColumn("grp", F.coalesce("grp", F.lit("not-in-cohort")))
    return j.groupBy("grp").agg(F.count(F.lit(1)).alias("n_excluded"), F.min("subject").alias("first_subject"), F.max("subject").alias("last_subject"))


def excluded_ids(excluded: DataFrame, groups: DataFrame) -> DataFrame:
    return excluded.join(groups, "subject", "left").select(F.coalesce("grp", F.lit("not-in-cohort")).alias("grp"), "subject")


def task_inclusion(qc: DataFrame) -> DataFrame:
    return qc.select("subject", "task", "verdict", (F.col("verdict") != "fail").alias("included"), F.col("flags").alias("reason"))


def included_for(inclusion: DataFrame, task: str) -> DataFrame:
    return inclusion.where((tx.task_key(F.col("task")) == task) & F.col("included")).select("subject").distinct()


def escalation(qc: DataFrame, excluded: DataFrame, groups: DataFrame, min_db: float = 3.0) -> DataFrame:
    """One row: the escalation messages, PROCEED or ESCALATE, and the number of
    borderline subjects."""
    rest = tx.task_key(F.col("task")) == "rest"
    weak = rest & ~F.col("alpha_present")
    a = qc.agg(F.countDistinct("subject").alias("n_subjects"), F.count_if(weak).alias("n_no_alpha"),
               F.countDistinct(F.when(weak & (F.col("alpha_peak_height_db") >= 1.5) & (F.col("alpha_peak_height_db") < min_db), F.col("subject"))).alias("n_borderline"))
    g = exclusions_per_group(excluded, groups).agg(F.coalesce(F.sum("n_excluded"), F.lit(0)).alias("n_excluded"), F.coalesce(F.max("n_excluded"), F.lit(0)).alias("top"))
    d = a.crossJoin(g)                                          # 1 x 1 row
    n, ex = F.col("n_subjects"), F.col("n_excluded")
    share = F.col("top") / F.greatest(ex, F.lit(1))
    no_alpha = F.col("n_no_alpha") / F.greatest(n, F.lit(1))
    msgs = F.array_compact(F.array(
        F.when(ex > 5, F.concat(ex.cast("string"), F.lit(" subjects excluded (> 5 threshold)"))),
        F.when((share > 0.8) & (ex >= 3), F.concat(F.lit("exclusions concentrate in one group ("), _pct(share), F.lit(")"))),
        F.when(no_alpha > 0.3, F.concat(F.col("n_no_alpha").cast("string"), F.lit(" rest subjects lack an alpha peak ("), _pct(no_alpha), F.lit(" of subjects)"))),
        F.when((n > 0) & (n - ex < 70), F.concat(F.lit("only "), (n - ex).cast("string"), F.lit(" subjects survive (< 70) for the primary target framing")))))
    return d.select("n_subjects", "n_excluded", "n_no_alpha", "n_borderline", F.array_join(msgs, "; ").alias("messages"),
                    F.when(F.size(msgs) > 0, "ESCALATE").otherwise("PROCEED").alias("verdict"))


def gate(df: DataFrame, ok: Column, message: Column | str) -> DataFrame:
    """The rows unchanged, or a failing job at the first row not ok."""
    msg = message if isinstance(message, Column) else F.lit(message)
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(msg).cast("boolean")))


def budget_gate(sizes: DataFrame, value: str, limit: float, what: str) -> DataFrame:
    return gate(sizes, F.col(value) <= limit, F.concat(F.lit(f"{what}: "), F.col(value).cast("string"), F.lit(f" exceeds {limit}")))


def within_budget(log: DataFrame, limit: int) -> DataFrame:
    return log.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes")).select("total_bytes", (F.col("total_bytes") <= limit).alias("ok"))


def same_run(tables: dict[str, DataFrame]) -> DataFrame:
    """One row when all tables carry one and the same run_id; fails otherwise."""
    u = None
    for name, t in tables.items():
        r = t.select("run_id").distinct().select(F.lit(name).alias("source"), "run_id")
        u = r if u is None else u.unionByName(r)
    a = u.agg(F.countDistinct("run_id").alias("n_runs"), F.count(F.lit(1)).alias("n_tables"), F.min("run_id").alias("run_id"))
    return gate(a, F.col("n_runs") == 1, "inputs come from more than one run")


def row_count_gate(df: DataFrame, expected: DataFrame) -> DataFrame:
    a = df.agg(F.count(F.lit(1)).alias("n")).crossJoin(expected.agg(F.count(F.lit(1)).alias("n_expected")))   # 1 x 1 row
    return gate(a, F.col("n") == F.col("n_expected"), "row count differs from the cohort")


def leakage_checklist(leak: DataFrame, null_mean: DataFrame, by: list[str], tolerance: float = 0.05) -> DataFrame:
    a = leak.groupBy(*by).agg(F.bool_and("ok").alias("no_subject_leakage"))
    b = null_mean.select(*by, "null_mean", (F.abs(F.col("null_mean") - 0.5) <= tolerance).alias("null_centred"))
    return a.join(b, by)


def check_declared_features(df: DataFrame, declared: list[str], keys: list[str], budget: int = 30) -> DataFrame:
    """Schema check before a feature table is used."""
    if len(declared) > budget:
        raise ValueError(f"{len(declared)} declared features exceed the budget of {budget}")
    missing = [c for c in declared if c not in df.columns]
    if missing:
        raise ValueError(f"declared features missing: {missing}")
    return df.select(*keys, *declared)


def require_sections(config: dict, sections: list[str]) -> dict:
    missing = [s for s in sections if s not in config]
    if missing:
        raise ValueError(f"configuration lacks sections: {missing}")
    return config


def check_label_blind(df: DataFrame, forbidden: set[str] = LABEL_COLUMNS) -> DataFrame:
    hit = sorted(c for c in df.columns if c.lower() in forbidden)
    if hit:
        raise ValueError(f"feature table carries label columns: {hit}")
    return df


def null_verdict(auc: Column, nuisance_auc: Column, p: Column) -> Column:
    return F.when((auc > nuisance_auc) & (p < 0.05), "POSITIVE").otherwise("NULL")


def proxy_screen(df: DataFrame, features: list[str], reference: str, limit: float = 0.8) -> DataFrame:
    """Pearson r of every feature with a nuisance quantity."""
    long = unpivot(df, [reference], features)
    g = long.groupBy("feature").agg(F.corr("value", F.col(reference).cast("double")).alias("r"), F.count("value").alias("n"))
    return g.withColumn("flagged", F.coalesce(F.abs("r") > limit, F.lit(False)))
