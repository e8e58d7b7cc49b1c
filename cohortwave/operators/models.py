"""Analyses built on cross-validation: controls, gates, final fit, scoring."""
from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.shape import record_array
from ..session import cut_lineage
from . import crossval as cv, resample as rs, stattests as st

ALLOWED_CONTROL_TARGETS = {"sex"}
# Reference lines and floors.
DISCLAIMER = "Research output of an unvalidated model; not for use in care or screening."
REFERENCE = {"chance": 0.5, "qc_only_auc": 0.545, "published_benchmark_auc": 0.58}
FLOORS = {"cross_subject": 0.65, "within_subject": 0.80}


def matrix(df: DataFrame, name: str, row_id: str, y: str, features: list[str], group: str | None = None, complete: bool = False) -> DataFrame:
    """Rows of one analysis: (analysis, row_id, grp, y, x). Missing features
    become NaN and are imputed inside the folds, unless complete rows are asked
    for."""
    d = df.where(F.col(y).isNotNull())
    if complete:
        d = d.dropna(subset=features)
    nan = F.lit(float("nan"))
    return d.select(F.lit(name).alias("analysis"), F.col(row_id).cast("string").alias("row_id"), F.col(group or row_id).cast("string").alias("grp"),
                    F.col(y).cast("int").alias("y"), F.array(*[F.coalesce(F.col(c).cast("double"), nan) for c in features]).alias("x"))


def run_analyses(rows: DataFrame, n_repeats: int = 10, n_permutations: int = 1000, n_bootstrap: int = 2000, seed: int = 20260810,
                 c_grid: list[float] = cv.C_GRID, permute_within: bool = False) -> dict[str, DataFrame]:
    """All analyses in `rows` at once: metrics, predictions of the last repeat,
    fold fits and null draws. Every permutation and bootstrap draw is one group
    of the same fan-out. `permute_within` permutes inside a group (paired
    rows); the default permutes over all rows."""
    rows = cut_lineage(rows.withColumn("pos", F.monotonically_increasing_id()), "matrix")     # numbers fixed by the write
    pred, fits = cv.nested_cv(rows, ["analysis"], n_repeats=n_repeats, seed=seed, c_grid=c_grid)
    per = st.auc(pred, ["analysis", "rep"], "y", "proba")
    observed = cut_lineage(per.groupBy("analysis").agg(F.avg("auc").alias("auc"), F.max(F.col("n1") + F.col("n0")).alias("n_rows")), "observed")
    n_used = rows.groupBy("analysis").agg(F.countDistinct("grp").alias("n_subjects_used"))
    within = ["analysis", "grp"] if permute_within else ["analysis"]
    by = ["analysis", "kind", "draw"]
    slim = rows.drop("x")                # draws name rows, the features stay in the matrix
    perm = rs.permute_labels(slim, "row_id", "y", n_permutations, seed, within).withColumn("kind", F.lit("permutation")).withColumn("mult", F.lit(1).cast("bigint"))
    boot = rs.bootstrap(slim, "row_id", n_bootstrap, seed + 1, ["analysis", "y"]).withColumn("kind", F.lit("bootstrap"))
    drawn = [d.select(*by, "pos", "y", "mult") for d in (perm, boot)]
    cells, _n = cv._shape(rows, ["analysis"])
    draws = cv.nested_cv_auc(drawn[0].unionByName(drawn[1]), rows, by, cells, n_permutations + n_bootstrap, seed=seed, c_grid=c_grid)
    draws = cut_lineage(draws.select(*by, "auc"), "draws")
    nulls = draws.where("kind = 'permutation'")
    p = st.permutation_p(nulls, observed, ["analysis"])
    ci = st.interval(draws.where("kind = 'bootstrap'"), ["analysis"], "auc").select("analysis", "ci_low", "ci_high")
    metrics = observed.join(n_used, "analysis").join(p, "analysis").join(ci, "analysis").select(
        "analysis", "auc", "ci_low", "ci_high", "p_value", "null_mean", "n_subjects_used")
    last = pred.where(F.col("rep") == n_repeats - 1).select("analysis", F.col("row_id").alias("subject"), F.col("y").alias("y_true"), F.col("proba").alias("oof_proba"), F.col("rep").alias("repeat"))
    return {"metrics": cut_lineage(metrics, "metrics"), "predictions": last, "fits": fits, "nulls": nulls, "per_repeat": per}


def holm_metrics(metrics: DataFrame, members: list[str]) -> DataFrame:
    """Adds p_value_holm for the declared secondary set."""
    sec = st.holm(metrics.where(F.col("analysis").isin(members)).withColumn("__fam", F.lit(1)), ["__fam"], "p_value", "analysis").select("analysis", "p_value_holm")
    return metrics.join(sec, "analysis", "left")


def benchmark_verdict(auc: Column, published: float = 0.58) -> Column:
    return F.when(F.abs(auc - published) <= 0.10, "near_published").when(auc <= 0.55, "near_chance").otherwise("other")


def control_gate(metrics: DataFrame, within: str, across: str, floors: dict = FLOORS) -> DataFrame:
    a = F.max(F.when(F.col("analysis") == within, F.col("auc")))
    b = F.max(F.when(F.col("analysis") == across, F.col("auc")))
    g = metrics.agg(a.alias("within_auc"), b.alias("across_auc"))
    return g.select("within_auc", "across_auc",
                    F.when(F.col("within_auc") >= floors["within_subject"], "pass").otherwise("fail").alias("within_verdict"),
                    F.when(F.col("across_auc") >= floors["cross_subject"], "pass").otherwise("fail").alias("across_verdict"),
                    F.when(F.col("within_auc") < floors["within_subject"], "STOP").when(F.col("across_auc") >= floors["cross_subject"], "PROCEED")
                    .otherwise("PROCEED_WITH_CAVEAT").alias("verdict"))


def control_rows(rungs: list[DataFrame], target: str) -> DataFrame:
    """Union of the rungs of a control ladder; only sanctioned targets."""
    if target not in ALLOWED_CONTROL_TARGETS:
        raise ValueError(f"control ladder refuses target {target!r}; sanctioned: {sorted(ALLOWED_CONTROL_TARGETS)}")
    return reduce(lambda a, b: a.unionByName(b), rungs)


def ladder(metrics: DataFrame, order: list[str], alpha: float = 0.05) -> DataFrame:
    """All rungs with the first significant one in declared order."""
    pos = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("analysis"))
    stop = metrics.agg(F.min_by("analysis", F.when(F.col("p_value") < alpha, pos)).alias("stopped_at"))
    return metrics.withColumn("rung", pos).crossJoin(F.broadcast(stop))      # one row


def qc_gate(rows: DataFrame, n_repeats: int = 3, n_permutations: int = 1000, n_bootstrap: int = 2000, seed: int = 42,
            select: bool = False, model: str = "logreg", legacy_bootstrap: bool = False) -> DataFrame:
    """Fixed-C plain k-fold analysis (mean of fold AUCs) with permutation p and
    bootstrap interval per analysis. A bootstrap copy stays in the fold of its
    original row; `legacy_bootstrap` lets copies spread."""
    rows = cut_lineage(rows, "matrix")
    obs = cv.fold_auc(cv.simple_cv(rows, ["analysis"], n_repeats=n_repeats, seed=seed, select=select, model=model), ["analysis"])
    obs = cut_lineage(obs, "observed")
    perm = rs.permute_labels(rows, "row_id", "y", n_permutations, seed, ["analysis"]).select("analysis", F.lit("permutation").alias("kind"), "draw", "row_id", "grp", "y", "x")
    boot = rs.both_classes(rs.bootstrap(rows, "row_id", n_bootstrap, seed + 1, ["analysis"]), ["analysis", "draw"], "y")
    boot = boot.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("mult").cast("int"))))
    rid = F.concat_ws("#", "row_id", F.col("copy").cast("string"))
    boot = boot.select("analysis", F.lit("bootstrap").alias("kind"), "draw", rid.alias("row_id"), (rid if legacy_bootstrap else F.col("grp")).alias("grp"), "y", "x")
    by = ["analysis", "kind", "draw"]
    cells, n_analyses = cv._shape(rows, ["analysis"])
    pred = cv.simple_cv(perm.unionByName(boot), by, n_repeats=1, seed=seed, select=select, model=model,
                        shape=(cells, n_analyses * (n_permutations + n_bootstrap)))
    draws = cut_lineage(cv.fold_auc(pred, by), "draws")
    p = st.permutation_p(draws.where("kind = 'permutation'"), obs, ["analysis"])
    ci = st.interval(draws.where("kind = 'bootstrap'"), ["analysis"], "auc").select("analysis", "ci_low", "ci_high")
    return obs.select("analysis", "auc").join(p, "analysis").join(ci, "analysis", "left").select("analysis", "auc", "p_value", "null_mean", "ci_low", "ci_high")


def contamination_verdict(auc: Column) -> Column:
    return F.when(auc > 0.65, "escalate").when(auc >= 0.55, "proceed_with_baseline").otherwise("proceed")


def richness_verdict(auc: Column, p: Column, prior: float = 0.459) -> Column:
    return F.when((auc > prior) & (p < 0.05), "improved").when((auc < prior) & (p < 0.05), "worse").otherwise("not_significant")


def isolation_verdict(auc: Column, before: float, after: float, tol: float = 0.03) -> Column:
    """Does one change alone explain the move between two fixed references?"""
    return F.when(F.abs(auc - after) <= tol, "matches_after").when(F.abs(auc - before) <= tol, "matches_before").otherwise("between")


def pending_analyses(wanted: DataFrame, results: DataFrame) -> DataFrame:
    """Resume: only the analyses without a stored result."""
    return wanted.join(results.select("analysis").distinct(), "analysis", "left_anti")


def control_matrix(rows: DataFrame, root: str, **settings) -> DataFrame:
    """Metrics of every representation in `rows`. Results are stored below
    `root`; a second call runs only the representations without one."""
    from ..sources.sinks import stored
    wanted = rows.select("analysis").distinct()
    done = stored(rows.sparkSession, f"{root}/metrics")
    todo = cut_lineage(wanted if done is None else pending_analyses(wanted, done), "pending")
    if not todo.isEmpty():
        metrics = run_analyses(rows.join(F.broadcast(todo), "analysis"), **settings)["metrics"]       # names, a declared handful
        metrics.write.mode("append").parquet(f"{root}/metrics")
    return rows.sparkSession.read.parquet(f"{root}/metrics")


# --- final model and scoring -------------------------------------------------


def train_final(rows: DataFrame, features: list[str], n_splits: int = 5, inner: int = 3, seed: int = 20260810, c_grid: list[float] = cv.C_GRID) -> DataFrame:
    """One-row model table: medians, means, stds, and for each of the folds the
    coefficients fitted without it plus the sigmoid calibration on it. Every
    fit runs over the distributed rows; only coefficients are gathered."""
    spark = rows.sparkSession
    p = len(features)
    d = cut_lineage(rows.select("row_id", "grp", F.col("y").cast("double").alias("y"), *[F.col("x")[i].alias(f) for i, f in enumerate(features)]), "rows")
    from ..functions.ordered import exact_percentiles
    from ..functions.shape import unpivot
    long = cut_lineage(unpivot(d, [], features), "long")
    med = exact_percentiles(long, ["feature"], "value", {"median": 0.5})
    med_map = {r["feature"]: r["median"] for r in med.collect()}                    # one row per feature
    fill = [F.coalesce(F.when(~F.isnan(f), F.col(f)), F.lit(float(med_map.get(f, 0.0)))) for f in features]
    ms = d.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(fill)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(fill)]).first()   # one row
    mean = [float(ms[f"m{i}"]) for i in range(p)]
    std = [float(ms[f"s{i}"] or 1.0) or 1.0 for i in range(p)]
    m = d.select("row_id", "grp", "y", F.array(*[(c - mean[i]) / std[i] for i, c in enumerate(fill)]).alias("x"))
    m = cut_lineage(m, "scaled")
    folds = lambda k, salt, name: cv.group_folds(m, [], "grp", "y", k, seed, 1, salt).select("grp", F.col("fold").alias(name))
    m = m.join(folds(inner, "final", "ifold"), "grp").join(folds(n_splits, "calibrate", "cfold"), "grp")
    skip = lambda n, c, tag: F.transform(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda g: g != F.col(c)), lambda g: F.concat(F.lit(tag), g.cast("string")))
    m = cut_lineage(m.withColumn("member", F.concat(skip(inner, "ifold", "in"), skip(n_splits, "cfold", "cal"))), "member")
    b = cv.fit_distributed(m, [f"in{g}" for g in range(inner)], c_grid, p)
    best = cv._best_c_distributed(m, b, c_grid, inner)
    w = cv.fit_distributed(m, [f"cal{g}" for g in range(n_splits)], [best], p)
    w = {g: w[f"cal{g}"][0] for g in range(n_splits)}
    margin = lambda v: F.lit(float(v[0])) + sum((F.col("x")[i] * float(v[i + 1]) for i in range(p)), F.lit(0.0))
    held = F.coalesce(*[F.when(F.col("cfold") == g, margin(w[g])) for g in range(n_splits)])
    counts = {r["cfold"]: (r["n1"], r["n0"]) for r in m.groupBy("cfold").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0")).collect()}   # one row per fold
    soft = F.coalesce(*[F.when(F.col("cfold") == g, F.when(F.col("y") == 1, F.lit((a + 1) / (a + 2))).otherwise(F.lit(1 / (z + 2)))) for g, (a, z) in counts.items()])
    pl = m.select(soft.alias("y"), F.array(held).alias("x"), F.array(F.concat(F.lit("p"), F.col("cfold").cast("string"))).alias("member"))
    sig = cv.fit_distributed(cut_lineage(pl, "platt"), [f"p{g}" for g in range(n_splits)], [1e12], 1)
    parts = [(float(w[g][0]), [float(v) for v in w[g][1:]], float(sig[f"p{g}"][0][1]), float(sig[f"p{g}"][0][0])) for g in range(n_splits)]
    return spark.createDataFrame([(features, [float(med_map.get(f, 0.0)) for f in features], mean, std, best, parts)],
                                 "features array<string>, median array<double>, mean array<double>, std array<double>, best_c double, "
                                 "parts array<struct<intercept: double, coef: array<double>, slope: double, offset: double>>")


def refusal(ranges: list[tuple[str, float, float]]) -> Column:
    """First metric outside its training range, as text; NULL when inside. A
    metric that is NULL is not judged."""
    out = F.lit(None).cast("string")
    for name, lo, hi in reversed(ranges):
        v = F.col(name).cast("double")
        out = F.when((v < lo) | (v > hi), F.concat(F.lit(f"{name}="), v.cast("string"), F.lit(f" outside training range [{lo}, {hi}]"))).otherwise(out)
    return out


def score(rows: DataFrame, model: DataFrame, features: list[str], ranges: DataFrame, metrics: list[str], keep: list[str]) -> DataFrame:
    """Batch or stream scoring with refusal. Features are taken in the model's
    order; the model and the ranges are one broadcast row each."""
    r = ranges.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("lo", "hi")))).alias("ranges"))   # a declared handful
    s = rows.crossJoin(F.broadcast(model)).crossJoin(F.broadcast(r))
    reason = F.lit(None).cast("string")
    for name in reversed(metrics):
        v, rg = F.col(name).cast("double"), F.col("ranges")[name]
        reason = F.when((v < rg["lo"]) | (v > rg["hi"]), F.concat(F.lit(f"{name}="), v.cast("string"), F.lit(" outside training range ["), rg["lo"].cast("string"), F.lit(", "), rg["hi"].cast("string"), F.lit("]"))).otherwise(reason)
    by_name = F.create_map(*[c for f in features for c in (F.lit(f), F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")))])
    x = F.transform(F.arrays_zip("features", "median", "mean", "std"), lambda z: (F.coalesce(F.element_at(by_name, z["features"]), z["median"]) - z["mean"]) / z["std"])
    s = s.withColumn("reason", reason).withColumn("__x", x)
    dot = lambda c: F.aggregate(F.zip_with(c, F.col("__x"), lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    sig = F.transform("parts", lambda q: 1 / (1 + F.exp(-(q["slope"] * (q["intercept"] + dot(q["coef"])) + q["offset"]))))
    prob = F.aggregate(sig, F.lit(0.0), lambda t, v: t + v) / F.size("parts")
    ok = F.col("reason").isNull()
    return s.select(*keep, F.when(ok, "scored").otherwise("cannot_score").alias("status"), "reason", F.when(ok, prob).alias("probability"),
                    F.when(ok, F.lit(False)).alias("actionable"), F.when(ok, F.lit(True)).alias("not_validated"), F.when(ok, F.lit(DISCLAIMER)).alias("disclaimer"))


REQUIRED_CARD_FIELDS = ["run_id", "cv_estimated_auc", "cv_estimated_ci", "training_qc_ranges", "inputs_sha256"]


def card_gate(provenance: DataFrame, required: list[str] = REQUIRED_CARD_FIELDS) -> DataFrame:
    from .quality import gate
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in required]))
    return gate(provenance, F.size(missing) == 0, F.concat(F.lit("model card lacks: "), F.array_join(missing, ", ")))
