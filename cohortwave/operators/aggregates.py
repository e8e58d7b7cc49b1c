"""Inventory, costing and summary aggregations."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import formulas as fm, tails
from ..functions.ordered import exact_percentiles, running_sum
from ..functions.rng import hash_int
from ..session import cut_lineage


def bytes_by(listing: DataFrame) -> DataFrame:
    """Bytes by modality, by task and in total, in one pass."""
    return (listing.groupingSets([["modality"], ["task"], []], "modality", "task")
            .agg(F.sum("bytes").alias("bytes"), F.grouping_id().alias("gid"))
            .select(F.when(F.col("gid") == 1, "modality").when(F.col("gid") == 2, "task").otherwise("total").alias("level"),
                    F.coalesce(F.when(F.col("gid") == 1, F.col("modality")), F.when(F.col("gid") == 2, F.col("task"))).alias("name"),
                    "bytes"))


def inventory(rows: DataFrame, tasks: list[str], keep: list[str] = ()) -> DataFrame:
    """has_<task>, bytes_<task>, total per subject; tasks are a declared list
    so the pivot needs no extra job."""
    cols = []
    for t in tasks:
        here = F.col("task") == t
        cols += [(F.count_if(here) > 0).alias(f"has_{t}"),
                 F.coalesce(F.sum(F.when(here, F.col("bytes"))), F.lit(0)).cast("bigint").alias(f"bytes_{t}")]
    return rows.groupBy("subject", *keep).agg(*cols, F.sum("bytes").alias("total_bytes"))


def _long_inventory(inv: DataFrame, tasks: list[str], grp: str) -> DataFrame:
    return inv.select("subject", grp, F.explode(F.array(*[
        F.struct(F.lit(t).alias("task"), F.col(f"has_{t}").alias("has")) for t in tasks])).alias("u")).select(
        "subject", grp, "u.task", "u.has")


def effective_n(inv: DataFrame, tasks: list[str], groups: list[str], grp: str = "grp") -> DataFrame:
    """task x group counts of subjects with data, plus the total."""
    long = _long_inventory(inv, tasks, grp).where("has")
    return long.groupBy("task").agg(
        *[F.count_if(F.col(grp) == g).alias(g) for g in groups], F.count(F.lit(1)).alias("total"))


def missingness_by_group(inv: DataFrame, tasks: list[str], grp: str = "grp") -> DataFrame:
    """Counts per (task, group) with the chi-square of missing x group (exact
    test for two groups) on every row of the task."""
    counts = _long_inventory(inv, tasks, grp).groupBy("task", grp).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("has")).alias("n_have"))
    counts = counts.withColumn("n_missing", F.col("n_total") - F.col("n_have"))
    w = W.partitionBy("task")                       # one row per declared group
    tot = F.sum("n_total").over(w).cast("double")
    exp_have = F.col("n_total").cast("double") * F.sum("n_have").over(w) / tot
    exp_miss = F.col("n_total").cast("double") * F.sum("n_missing").over(w) / tot
    term = (F.pow(F.col("n_have") - exp_have, 2) / F.when(exp_have > 0, exp_have)
            + F.pow(F.col("n_missing") - exp_miss, 2) / F.when(exp_miss > 0, exp_miss))
    c = counts.select("*", term.alias("__t"), F.count(F.lit(1)).over(w).alias("__k"),
                      F.array_sort(F.collect_list(F.struct(F.col(grp), "n_missing", "n_have")).over(w)).alias("__rows"),
                      F.min("n_total").over(w).alias("__r"), F.sum("n_have").over(w).alias("__h"),
                      F.sum("n_missing").over(w).alias("__m"))
    c = c.withColumn("chi2", F.sum("__t").over(w))
    degenerate = (F.col("__k") < 2) | (F.col("__r") == 0) | (F.col("__h") == 0) | (F.col("__m") == 0)
    r = F.col("__rows")
    fisher = tails.fisher_two_sided(r[0]["n_missing"], r[0]["n_have"], F.get(r, F.lit(1))["n_missing"], F.get(r, F.lit(1))["n_have"])
    two = F.col("__k") == 2
    c = c.withColumn("__fisher", fisher).withColumn("__chi", tails.chi2_sf(F.col("chi2"), F.col("__k") - 1))
    return c.select(
        "task", grp, "n_total", "n_have", "n_missing", F.round("chi2", 6).alias("chi2"),
        F.when(degenerate, "n/a (degenerate table)").when(two, "Fisher's exact")
        .otherwise("chi-square (missing x group)").alias("missingness_test"),
        F.round(F.when(~degenerate, F.when(two, F.col("__fisher")).otherwise(F.col("__chi"))), 6).alias("missingness_p"))


def missing_subjects(inv: DataFrame, tasks: list[str], grp: str = "grp") -> DataFrame:
    """The missing ids as rows: the list has no bound, so it is a table rather
    than one long string per group."""
    return _long_inventory(inv, tasks, grp).where(~F.col("has")).select("task", grp, "subject")


def missing_concentration(inv: DataFrame, tasks: list[str], grp: str = "grp") -> DataFrame:
    """Per task: group with the most missing subjects and its share."""
    c = _long_inventory(inv, tasks, grp).where(~F.col("has")).groupBy("task", grp).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("task").agg(
        F.sum("n").alias("n_missing"), F.max("n").alias("n_largest"),
        F.min_by(grp, F.struct(-F.col("n"), F.col(grp))).alias("largest_group"),
        (F.count(F.lit(1)) == 1).alias("single_group"))


def budget(listing: DataFrame, rates: dict[str, int]) -> DataFrame:
    """Duration statistics and raw / derivative sizes per task plus a total
    row (task NULL). `rates` is the configured sampling rate per task."""
    eeg = listing.where((F.col("modality") == "eeg") & F.col("path").endswith(".eeg"))
    d = eeg.withColumn("dur", fm.duration_s(F.col("bytes")))
    rate = F.lit(None).cast("double")
    for t, r in rates.items():
        rate = F.when(F.col("task") == t, F.lit(float(r))).otherwise(rate)
    d = d.withColumn("rate", F.coalesce(rate, F.raise_error(F.lit("no sampling rate for a task")).cast("double")))
    return d.rollup("task").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("dur"), 1).alias("mean_duration_s"),
        F.round(F.min("dur"), 1).alias("min_duration_s"), F.round(F.max("dur"), 1).alias("max_duration_s"),
        F.round(F.sum("bytes") / fm.GB, 2).alias("raw_gb"),
        F.round(F.sum(fm.derivative_bytes(F.col("dur"), fm.NATIVE_CHANNELS, F.col("rate"))) / fm.GB, 2).alias("derivative_gb"))


def peak_coresident_gb(listing: DataFrame) -> DataFrame:
    eeg = listing.where((F.col("modality") == "eeg") & F.col("path").endswith(".eeg"))
    top = eeg.groupBy("subject").agg(F.sum("bytes").alias("b")).orderBy(F.desc("b"), "subject").limit(2)
    return top.agg(F.round(F.sum("b") / fm.GB, 4).alias("peak_gb"), F.count(F.lit(1)).alias("n_subjects"))


def scope_costs(listing: DataFrame, scopes: dict[str, list[str]]) -> DataFrame:
    """Files and bytes of each scope; a file is expanded to the scopes its
    task belongs to, a list fixed by configuration."""
    member = F.array_compact(F.array(*[F.when(F.col("task").isin(t), F.lit(s)) for s, t in scopes.items()]))
    return (listing.where("modality = 'eeg'").select("bytes", F.explode(member).alias("scope"))
            .groupBy("scope").agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("raw_bytes"))
            .withColumn("raw_gb", F.round(F.col("raw_bytes") / fm.GB, 2)))


def recommend_scope(costs: DataFrame, derivative_gb: Column, preference: list[str], usable_gb: float) -> DataFrame:
    """First scope of the preference order that fits, else NONE_FITS."""
    rank = F.array_position(F.array(*[F.lit(p) for p in preference]), F.col("scope"))
    fits = (F.col("raw_gb") + derivative_gb) <= F.lit(float(usable_gb))
    return costs.agg(F.coalesce(F.min_by("scope", F.when(fits, rank)), F.lit("NONE_FITS")).alias("scope"),
                     F.count_if(fits).alias("n_fitting"))


def manifest(listing: DataFrame, tasks: list[str], scope: str, cuts: int = 64) -> DataFrame:
    """Files of the scope with the running byte total in path order. The order
    is cut at a sample of the paths themselves, in two levels, so no task sorts
    the whole list whatever the paths have in common. The sample only steers
    the division of work."""
    m = listing.where((F.col("modality") == "eeg") & F.col("task").isin(tasks)).withColumn("scope", F.lit(scope))
    points = sorted(r["path"] for r in m.select("path").where("path is not null").distinct().orderBy(F.xxhash64("path"), "path").limit(cuts).collect())
    fine = F.size(F.filter(F.array(*map(F.lit, points)), lambda c: c <= F.col("path"))) if points else F.lit(0)
    m = cut_lineage(m.withColumn("__cut", F.coalesce(fine, F.lit(0))), "manifest")
    return running_sum(m, ["scope"], ["path"], "bytes", [F.floor(F.col("__cut") / 8), F.col("__cut")], "running_total_bytes").drop("__cut")


def value_profile(df: DataFrame, columns: list[str], n_samples: int = 5) -> DataFrame:
    """Type, distinct count and the smallest few values of each column. The
    columns are unpivoted and pre-aggregated, so no task holds all values."""
    types = dict(df.dtypes)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"), F.col(c).cast("string").alias("v"))
        for c in columns])).alias("u")).select("u.*")
    distinct = long.where("v is not null").groupBy("column", "dtype", "v").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("column", "dtype").orderBy("v")
    first = (distinct.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n_samples)
             .groupBy("column", "dtype").agg(F.array_join(F.array_sort(F.collect_list("v")), ",").alias("samples")))
    counts = distinct.groupBy("column", "dtype").agg(F.count(F.lit(1)).alias("n_unique"), F.sum("n").alias("n_values"))
    return counts.join(first, ["column", "dtype"])


def feature_defects(df: DataFrame, features: list[str], max_missing: float = 0.5) -> DataFrame:
    """Per feature: constant? missing share above the limit? Constancy needs
    only min = max, not a distinct count."""
    nn = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), nn(c).alias("v")) for c in features])).alias("u")).select("u.*")
    g = long.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"),
                                    F.avg(F.col("v").isNull().cast("double")).alias("missing_frac"))
    return g.select("feature", F.coalesce(F.col("lo") == F.col("hi"), F.lit(True)).alias("constant"), "missing_frac",
                    (F.col("missing_frac") > max_missing).alias("over_limit"))


def sample_per_group(df: DataFrame, keys: list[str], row_id: str, n: int, seed: int) -> DataFrame:
    """Exactly n rows per group without replacement (all of them when fewer):
    the n smallest hashes. Spark keeps only n rows per group and task before
    the shuffle, so a large group costs no more than a small one."""
    w = W.partitionBy(*keys).orderBy("__h", row_id)
    return (df.withColumn("__h", hash_int(seed, F.col(row_id)))
            .withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__h", "__r"))


def fixed_count_summary(df: DataFrame, keys: list[str], row_id: str, value: str, n: int, seed: int,
                        strict: bool = True) -> DataFrame:
    """Median and IQR over exactly n sampled values per group. A group with
    fewer fails the job when strict, otherwise it is left out."""
    s = sample_per_group(df.where(F.col(value).isNotNull() & ~F.isnan(value)), keys, row_id, n, seed)
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))   # at most n values
    g = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), q.alias("q"))
    if strict:
        g = g.withColumn("q", F.when(F.col("n") == n, F.col("q")).otherwise(
            F.raise_error(F.lit(f"fewer than {n} values in a group")).cast("array<double>")))
    else:
        g = g.where(F.col("n") == n)
    return g.select(*keys, F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def across_channels(medians: DataFrame, keys: list[str], value: str = "median") -> DataFrame:
    """Median and IQR over the channel medians (a device-bounded count)."""
    v = F.when(~F.isnan(value), F.col(value))
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = medians.groupBy(*keys).agg(q.alias("q"), F.count(v).alias("n_channels"))
    return g.select(*keys, "n_channels", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def mean_and_iqr(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    q = exact_percentiles(df, keys, value, {"q1": 0.25, "q3": 0.75})
    m = df.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return m.join(q, keys, "left").select(*keys, "mean", (F.col("q3") - F.col("q1")).alias("iqr"))


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    q = exact_percentiles(df, keys, value, {"median": 0.5})
    a = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return a.join(q, keys).select(*keys, "n", "mean", "std", "median")


def category_shares(df: DataFrame, grp: str, level: str) -> DataFrame:
    c = df.groupBy(grp, level).agg(F.count(F.lit(1)).alias("count"))
    return c.withColumn("pct", F.round(F.lit(100.0) * F.col("count") / F.sum("count").over(W.partitionBy(grp)), 1))


def modal_value(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value; the smallest wins a tie."""
    c = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("mode"), F.max("n").alias("n_mode"))


def crosstab(df: DataFrame, row: str, col: str, levels: list) -> DataFrame:
    return df.groupBy(row).agg(*[F.count_if(F.col(col) == v).alias(f"{col}_{v}") for v in levels])


def metric_ranges(df: DataFrame, metrics: list[str]) -> DataFrame:
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in metrics for n, f in (("lo", F.min), ("hi", F.max))]).select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"lo_{c}").cast("double").alias("lo"),
                                     F.col(f"hi_{c}").cast("double").alias("hi")) for c in metrics])).alias("r")).select("r.*")


def feature_stability(coefs: DataFrame, keys: list[str], threshold: float = 1e-8) -> DataFrame:
    """Selection frequency and modal sign share from one coefficient array per
    fitted fold, with `names` alongside."""
    long = coefs.select(*keys, F.explode(F.arrays_zip(F.col("names"), F.col("coef"))).alias("z")).select(
        *keys, F.col("z.names").alias("feature"), F.col("z.coef").alias("c"))
    sel = F.abs("c") > threshold
    g = long.groupBy(*keys, "feature").agg(
        F.avg(sel.cast("double")).alias("selection_frequency"), F.count_if(sel).alias("n"),
        F.count_if(sel & (F.col("c") > 0)).alias("p"), F.count_if(sel & (F.col("c") < 0)).alias("m"))
    return g.select(*keys, "feature", "selection_frequency",
                    F.when(F.col("n") > 0, F.greatest("p", "m") / F.col("n")).alias("sign_consistency"),
                    (F.col("selection_frequency") > 0.8).alias("stable"))


def resample_summary(draws: DataFrame, keys: list[str], value: str, reference: float, chance: float = 0.5) -> DataFrame:
    q = exact_percentiles(draws, keys, value, {"p5": 0.05, "p50": 0.5, "p95": 0.95})
    s = draws.groupBy(*keys).agg(F.avg((F.col(value) > reference).cast("double")).alias("frac_above_reference"),
                                 F.avg((F.col(value) < chance).cast("double")).alias("frac_below_chance"))
    return q.join(s, keys).withColumnRenamed("n", "n_resamples")


def compare_configs(df: DataFrame, config: str, value: str) -> DataFrame:
    q = exact_percentiles(df, [config], value, {"median": 0.5})
    a = df.groupBy(config).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                               F.min(value).alias("min"), F.max(value).alias("max"))
    return a.join(q, config).select(config, "n", "mean", "median", "std", "min", "max")


def paired_delta(df: DataFrame, unit: str, config: str, value: str, a: str, b: str) -> DataFrame:
    at = lambda c: F.max(F.when(F.col(config) == c, F.col(value)))
    g = df.where(F.col(config).isin(a, b)).groupBy(unit).agg(at(a).alias("a"), at(b).alias("b")).dropna()
    return g.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(F.col("a") - F.col("b")).alias("mean_delta"))


def metric_table(results: list[DataFrame], reference_lines: dict[str, float]) -> DataFrame:
    """One row per analysis; reference lines as ref_* columns; columns some
    analyses lack stay NULL."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.select("*", *[F.lit(float(v)).alias(f"ref_{k}") for k, v in reference_lines.items()])
