"""Rank, contingency and correlation tests on long tables (keys, group, value).

Test statistics are aggregates over counts per distinct value, so a metric's
rows are never sorted in one task; p-values are added to the few result rows.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import tails
from ..functions.ordered import bucketed_counts, percentiles_from_counts, tied_rank_column
from ..functions.shape import record_array

# Rows of one variable that a task draws from; a longer variable's draws are shuffled row by row.
MAX_TASK_ROWS = 4_000_000


def kruskal(df: DataFrame, by: list[str], group: str, value: str, groups: list, min_per_group: int = 1,
            clip: bool = False, weight: Column | None = None) -> DataFrame:
    """Tie-corrected H, its chi-square p and the eta-squared effect. Groups are
    declared; with min_per_group > 1 a metric with a smaller group is skipped,
    otherwise empty groups are ignored."""
    one = weight if weight is not None else F.lit(1)
    marks = {f"g{i}": F.when(F.col(group) == g, one).otherwise(F.lit(0)) for i, g in enumerate(groups)}
    d = df.where(F.col(group).isin(groups))
    c = bucketed_counts(d, by, value, sums=marks, weight=weight)
    r = tied_rank_column()
    t = F.col("n_at").cast("double")
    agg = c.groupBy(*by).agg(F.max("n_all").alias("n"), F.sum(t * t * t - t).alias("ties"),
                             *[F.sum(f"g{i}").alias(f"n{i}") for i in range(len(groups))],
                             *[F.sum(F.col(f"g{i}") * r).alias(f"r{i}") for i in range(len(groups))])
    n = F.col("n").cast("double")
    ns = [F.col(f"n{i}") for i in range(len(groups))]
    k = sum((F.when(x > 0, 1).otherwise(0) for x in ns), F.lit(0))
    ss = sum((F.when(x > 0, F.col(f"r{i}") * F.col(f"r{i}") / x).otherwise(0.0) for i, x in enumerate(ns)), F.lit(0.0))
    denom = 1 - F.col("ties") / F.when(n > 1, n * n * n - n)
    h = (F.lit(12.0) / (n * (n + 1)) * ss - 3 * (n + 1)) / F.when(denom > 0, denom)
    enough = F.least(*ns) >= min_per_group if min_per_group > 1 else k >= 2
    out = agg.select(*by, F.col("n").cast("bigint").alias("n"), k.alias("k"), h.alias("statistic"), enough.alias("__ok"))
    out = out.where("__ok") if min_per_group > 1 else out.withColumn("statistic", F.when(F.col("__ok"), F.col("statistic")))
    eta = eta_squared(F.col("statistic"), F.col("k"), F.col("n"))
    if clip:
        eta = F.greatest(eta, F.lit(0.0))
    out = out.withColumn("effect_size", F.when(F.col("n") > F.col("k"), eta).otherwise(0.0)).drop("__ok")
    return out.withColumn("p_value", tails.chi2_sf(F.col("statistic"), F.col("k") - 1))


def eta_squared(h: Column, k: Column, n: Column) -> Column:
    return (h - k + 1) / (n - k)


def auc(df: DataFrame, by: list[str], y: str, score: str, weight: Column | None = None) -> DataFrame:
    """Tie-aware area under the ROC curve per key from rank sums of the
    positives (NULL when a class is absent)."""
    one = weight if weight is not None else F.lit(1)
    c = bucketed_counts(df, by, score, sums={"pos": F.when(F.col(y) == 1, one).otherwise(F.lit(0))}, weight=weight)
    g = c.groupBy(*by).agg(F.sum(F.col("pos") * tied_rank_column()).alias("r1"), F.sum("pos").cast("double").alias("n1"), F.max("n_all").alias("n"))
    n0 = F.col("n") - F.col("n1")
    a = (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2) / F.when((F.col("n1") > 0) & (n0 > 0), F.col("n1") * n0)
    return g.select(*by, F.col("n1").cast("bigint").alias("n1"), n0.cast("bigint").alias("n0"), a.alias("auc"))


def contingency(df: DataFrame, by: list[str], group: str, level: str, weight: Column | None = None) -> DataFrame:
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.where(F.col(group).isNotNull() & F.col(level).isNotNull()).groupBy(*by, F.col(group).alias("g"), F.col(level).alias("l")).agg(n.alias("o"))


def chi_square(counts: DataFrame, by: list[str], legacy: bool = False) -> DataFrame:
    """Pearson chi-square without continuity correction from cell counts
    (keys, g, l, o). Only observed cells are stored: the sum over all cells is
    n * (sum o^2/(row*col) - 1). A 2x2 table also gets the exact test and phi.
    `legacy` leaves the degrees out of Cramer's V."""
    rows = counts.groupBy(*by, "g").agg(F.sum("o").alias("r"))
    cols = counts.groupBy(*by, "l").agg(F.sum("o").alias("c"))
    j = counts.join(rows, [*by, "g"]).join(cols, [*by, "l"])
    o = F.col("o").cast("double")
    core = j.groupBy(*by).agg(F.sum("o").alias("n"), F.sum(o * o / (F.col("r").cast("double") * F.col("c"))).alias("q"))
    first_g, first_l = F.min("g"), F.min("l")
    rr = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.min("r").alias("rmin"), first_g.alias("g1"), F.min_by("r", "g").alias("r1"))
    cc = cols.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cols"), F.min("c").alias("cmin"), first_l.alias("l1"), F.min_by("c", "l").alias("c1"))
    j2 = core.join(rr, by).join(cc, by) if by else core.crossJoin(rr).crossJoin(cc)   # one row each
    cell = counts.select(*by, F.col("g").alias("g1"), F.col("l").alias("l1"), F.col("o").alias("a"))
    j2 = j2.join(cell, [*by, "g1", "l1"], "left").withColumn("a", F.coalesce("a", F.lit(0)))
    n = F.col("n").cast("double")
    df_ = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    chi = F.greatest(n * (F.col("q") - 1), F.lit(0.0))
    min_exp = F.col("rmin").cast("double") * F.col("cmin") / n
    two = (F.col("n_rows") == 2) & (F.col("n_cols") == 2)
    low = (min_exp < 5) | (F.col("n_rows") * F.col("n_cols") < 20)
    b, c_ = F.col("r1") - F.col("a"), F.col("c1") - F.col("a")
    d = F.col("n") - F.col("r1") - c_
    phi = (F.col("a") * d.cast("double") - b * c_.cast("double")) / F.sqrt(F.col("r1").cast("double") * F.col("c1") * (n - F.col("r1")) * (n - F.col("c1")))
    dims = F.least("n_rows", "n_cols") - 1
    v = F.sqrt(chi / n) if legacy else F.when(dims > 0, F.sqrt(chi / (n * dims))).otherwise(0.0)
    out = j2.select(*by, "n", "n_rows", "n_cols", chi.alias("chi2"), df_.alias("df"), min_exp.alias("min_expected"),
                    F.when(low & two, "Fisher's exact").when(low, "chi-square (low expected counts)").otherwise("chi-square").alias("test"),
                    v.alias("cramers_v"), F.when(two, phi).alias("phi"), F.col("a"), b.alias("b"), c_.alias("c"), d.alias("d"))
    out = out.withColumn("__f", tails.fisher_two_sided(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).withColumn("__c", tails.chi2_sf(F.col("chi2"), F.col("df")))
    return out.withColumn("p_value", F.when(F.col("test") == "Fisher's exact", F.col("__f")).otherwise(F.col("__c"))).drop("__f", "__c")


def fisher_2x2(df: DataFrame, row: Column, col: Column) -> DataFrame:
    """Exact test of a boolean against a boolean: [[tt, tf], [ft, ff]]."""
    g = df.agg(F.count_if(row & col).alias("a"), F.count_if(row & ~col).alias("b"), F.count_if(~row & col).alias("c"), F.count_if(~row & ~col).alias("d"))
    cells = [F.col(x) for x in "abcd"]
    return g.withColumn("odds_ratio", tails.odds_ratio(*cells)).withColumn("p_value", tails.fisher_two_sided(*cells))


def spearman(df: DataFrame, by: list[str], x: str, y: str, min_pairs: int = 10) -> DataFrame:
    """Rank correlation from the counts of distinct (x, y) pairs."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rx = bucketed_counts(d, by, "x").select(*by, "x", tied_rank_column().alias("rx"))
    ry = bucketed_counts(d, by, "y").select(*by, "y", tied_rank_column().alias("ry"))
    p = d.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")).join(rx, [*by, "x"]).join(ry, [*by, "y"])
    w, a, b = F.col("w"), F.col("rx"), F.col("ry")
    s = p.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"), F.sum(w * a * b).alias("ab"))
    n = F.col("n")
    rho = (n * F.col("ab") - F.col("sa") * F.col("sb")) / F.sqrt((n * F.col("aa") - F.col("sa") * F.col("sa")) * (n * F.col("bb") - F.col("sb") * F.col("sb")))
    s = s.where(n >= min_pairs).select(*by, n.cast("bigint").alias("n"), rho.alias("rho"))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.when(1 - F.col("rho") * F.col("rho") > 0, 1 - F.col("rho") * F.col("rho")))
    p = tails.t_two_sided(t, F.col("n") - 2)
    return s.withColumn("p_value", F.when(F.col("rho") * F.col("rho") >= 1, F.lit(0.0)).otherwise(p))


def welch_t(df: DataFrame, by: list[str], y: str, value: str) -> DataFrame:
    """Unequal-variance t per key between y = 1 and y = 0, NULLs omitted."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    at = lambda f, c: f(F.when(F.col(y) == c, v))
    g = df.groupBy(*by).agg(*[at(f, c).alias(f"{n}{c}") for c in (0, 1) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    e1, e0 = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    t = (F.col("m1") - F.col("m0")) / F.sqrt(F.when(e1 + e0 > 0, e1 + e0))
    d = (e1 + e0) * (e1 + e0) / F.nullif(e1 * e1 / (F.col("n1") - 1) + e0 * e0 / (F.col("n0") - 1), F.lit(0.0))
    return g.select(*by, t.alias("t"), d.alias("df")).withColumn("p_value", tails.t_two_sided(F.col("t"), F.col("df")))


def bh(df: DataFrame, family: list[str], p: str, q: str = "q_value", digits: int | None = None) -> DataFrame:
    """Benjamini-Hochberg q within a family: running minimum from the top of
    p*n/rank. Equal p-values share the highest rank, so the frame runs over
    distinct p with counts and a family may be of any size."""
    c = bucketed_counts(df, family, p)
    raw = F.least(F.col(p) * F.col("n_all") / (F.col("n_below") + F.col("n_at")), F.lit(1.0))
    c = c.select(*family, p, raw.alias("__raw"))
    out = _suffix_min(c, family, p)
    val = F.round("__q", digits) if digits is not None else F.col("__q")
    keyed = out.select(*family, F.col(p).alias("__p"), val.alias(q))
    return df.withColumn("__p", F.col(p).cast("double")).join(keyed, [*family, "__p"], "left").drop("__p")


def _suffix_min(c: DataFrame, family: list[str], p: str, n_cells: int = 256) -> DataFrame:
    """Minimum of __raw over all rows of the family with an equal or larger p."""
    d = c.withColumn("__cell", F.least(F.floor(F.col(p) * n_cells), F.lit(n_cells - 1)))
    cells = d.groupBy(*family, "__cell").agg(F.min("__raw").alias("__m"))
    above = W.partitionBy(*family).orderBy(F.desc("__cell")).rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select(*family, "__cell", F.coalesce(F.min("__m").over(above), F.lit(1.0)).alias("__up"))
    inside = W.partitionBy(*family, "__cell").orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0)
    return d.join(cells, [*family, "__cell"]).withColumn("__q", F.least(F.min("__raw").over(inside), F.col("__up")))


def holm(df: DataFrame, family: list[str], p: str, name: str, out: str = "p_value_holm") -> DataFrame:
    """Step-down correction of the declared analyses of a family (a handful of
    rows): running maximum of p*(n-rank), capped at 1."""
    w = W.partitionBy(*family).orderBy(p, name)
    n = F.count(F.lit(1)).over(W.partitionBy(*family))
    d = df.withColumn("__x", F.least(F.col(p) * (n - F.row_number().over(w) + 1), F.lit(1.0)))
    return d.withColumn(out, F.max("__x").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__x")


def permutation_p(nulls: DataFrame, observed: DataFrame, by: list[str], stat: str = "auc") -> DataFrame:
    """(#{null >= observed} + 1) / (n + 1) per key."""
    j = nulls.select(*by, F.col(stat).alias("__null")).join(observed.select(*by, F.col(stat).alias("__obs")), by)
    return j.groupBy(*by).agg(((F.count_if(F.col("__null") >= F.col("__obs")) + 1) / (F.count("__null") + 1)).alias("p_value"),
                              F.count("__null").alias("n_draws"), F.avg("__null").alias("null_mean"))


def interval(draws: DataFrame, by: list[str], stat: str, min_draws: int = 1) -> DataFrame:
    """2.5-97.5 percentile interval over draws; NULL under min_draws."""
    q = percentiles_from_counts(bucketed_counts(draws, by, stat), by, stat, {"ci_low": 0.025, "ci_high": 0.975})
    ok = F.col("n") >= min_draws
    return q.select(*by, F.col("n").alias("n_draws"), F.when(ok, F.col("ci_low")).alias("ci_low"), F.when(ok, F.col("ci_high")).alias("ci_high"))


def _kruskal_effect(counts: np.ndarray, clip: bool) -> float | None:
    """The effect of `kruskal` from the counts of one draw per group and
    distinct value, smallest first."""
    at = counts.sum(axis=0)
    ns, n = counts.sum(axis=1), at.sum()
    r = counts @ (np.cumsum(at) - at + (at + 1) / 2)
    k, eta = int((ns > 0).sum()), None
    denom = 1 - (at * at * at - at).sum() / (n * n * n - n) if n > 1 else 0.0
    if denom > 0 and k >= 2:
        some = ns > 0
        eta = (12 / (n * (n + 1)) * (r[some] * r[some] / ns[some]).sum() - 3 * (n + 1)) / denom - k + 1
        eta = eta / (n - k) if n > k else None
    if clip:
        eta = max(eta or 0.0, 0.0)
    return eta if n > k else 0.0


def effect_draws(long: DataFrame, by: list[str], row_id: str, cls: str, value: str, classes: list, n_boot: int, seed: int,
                 categorical: bool = False, clip: bool = False) -> DataFrame:
    """(by, draw, effect): the effect size on each stratified bootstrap draw;
    draws on which it is undefined are left out."""
    from .resample import bootstrap, bootstrap_counts
    d = long.select(*by, row_id, cls, value).where(F.col(value).isNotNull())
    d = d.withColumn("__rid", F.concat_ws("|", *by, F.col(row_id).cast("string")))
    if not categorical:
        e = bootstrap_counts(d, "__rid", n_boot, seed, by, cls, value, classes, lambda c: _kruskal_effect(c, clip), MAX_TASK_ROWS)
        if e is not None:
            return e
    b = bootstrap(d, "__rid", n_boot, seed, [*by, cls], folded=False)
    if categorical:
        t = chi_square(contingency(b, [*by, "draw"], cls, value, weight=F.col("mult")), [*by, "draw"])
        e = t.select(*by, "draw", F.when(F.col("test") == "Fisher's exact", F.col("phi")).otherwise(F.col("cramers_v")).alias("effect"))
    else:
        e = kruskal(b, [*by, "draw"], cls, value, classes, clip=clip, weight=F.col("mult")).select(*by, "draw", F.col("effect_size").alias("effect"))
    return e.where(F.col("effect").isNotNull())


def association_table(long: DataFrame, row_id: str, group: str, groups: list, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """metric x group screen: H, p, BH q, clipped effect and its interval; a
    metric with fewer than two groups gets p = 1 and effect 0."""
    from ..session import cut_lineage
    long = cut_lineage(long, "metrics")
    k = kruskal(long, ["metric"], group, "value", groups, clip=True)
    k = k.withColumn("p_value", F.coalesce("p_value", F.lit(1.0))).withColumn("effect_size", F.coalesce("effect_size", F.lit(0.0)))
    k = cut_lineage(bh(cut_lineage(k.withColumn("__fam", F.lit(1)), "tests"), ["__fam"], "p_value", "p_fdr"), "q")
    ci = interval(cut_lineage(effect_draws(long, ["metric"], row_id, group, "value", groups, n_boot, seed, clip=True), "effects"), ["metric"], "effect")
    return k.join(ci, "metric", "left").select("metric", F.lit("kruskal-wallis").alias("test"), "statistic", "p_value", "p_fdr", "effect_size",
                                               F.coalesce("ci_low", F.lit(0.0)).alias("ci_low"), F.coalesce("ci_high", F.lit(0.0)).alias("ci_high"))


def verdict(p: Column, effect: Column) -> Column:
    e = F.abs(effect)
    return F.when((p < 0.05) & (e >= 0.5), "blocking").when((p < 0.10) | (e >= 0.3), "watch").otherwise("clear")


def mitigation(variable: Column, v: Column) -> Column:
    return (F.when(v == "blocking", F.concat(variable, F.lit(": adjust for it in every model, or match the groups on it")))
            .when(v == "watch", F.concat(variable, F.lit(": report results with and without adjusting for it"))).otherwise(""))


def screen(df: DataFrame, row_id: str, continuous: list[str], categorical: list[str], ordinal: dict[str, str],
           framings: Column, classes: list[int], n_boot: int = 0, seed: int = 20260805) -> DataFrame:
    """Every variable under every framing in one job, corrected within the
    framing. `framings` is an array<struct<framing,class>> column; `ordinal`
    maps a variable to its ordered-group column. With n_boot > 0 the effects
    get stratified bootstrap intervals (NULL under 50 usable draws)."""
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    f = df.select(row_id, *[c for c in df.columns if c != row_id], F.explode(framings).alias("__f")).withColumn("framing", F.col("__f.framing")).withColumn("cls", F.col("__f.class"))
    f = f.where("cls is not null")
    long = lambda cols: f.select(row_id, "framing", "cls", F.explode(record_array(["variable", "value"], *[(c, clean(c)) for c in cols])).alias("u")).select(row_id, "framing", "cls", "u.*").where("value is not null")
    by = ["framing", "variable"]
    kw = kruskal(long(continuous), by, "cls", "value", classes, min_per_group=1)
    kw = kw.select(*by, F.lit("continuous").alias("type"), F.lit("Kruskal-Wallis").alias("test"), F.round("statistic", 4).alias("statistic"),
                   F.round("p_value", 6).alias("p_value"), F.round("effect_size", 4).alias("effect_size"), F.lit("eta-squared").alias("effect_measure"))
    parts = [kw]
    if categorical:
        ct = chi_square(contingency(long(categorical), by, "cls", "value"), by)
        exact = F.col("test") == "Fisher's exact"
        parts.append(ct.select(*by, F.lit("categorical").alias("type"), "test", F.lit(None).cast("double").alias("statistic"), F.round("p_value", 6).alias("p_value"),
                               F.round(F.when(exact, F.col("phi")).otherwise(F.col("cramers_v")), 4).alias("effect_size"),
                               F.when(exact, "rank-biserial r").otherwise("Cramers V").alias("effect_measure")))
    for var, order in ordinal.items():
        sp = spearman(f.select("framing", clean(var).alias("a"), clean(order).alias("b")), ["framing"], "b", "a")
        parts.append(sp.select("framing", F.lit(var).alias("variable"), F.lit("ordinal-trend").alias("type"), F.lit("Spearman").alias("test"), F.round("rho", 4).alias("statistic"),
                               F.round("p_value", 6).alias("p_value"), F.round("rho", 4).alias("effect_size"), F.lit("Spearman rho").alias("effect_measure")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    v = verdict(F.col("p_value"), F.col("effect_size"))
    from ..session import cut_lineage
    out = cut_lineage(out.withColumn("verdict", v).withColumn("mitigation", mitigation(F.col("variable"), v)), "screen")
    out = bh(out, ["framing"], "p_value", "fdr_q", 4)
    if not n_boot:
        return out
    draws = effect_draws(long(continuous), by, row_id, "cls", "value", classes, n_boot, seed).withColumn("type", F.lit("continuous"))
    if categorical:
        draws = draws.unionByName(effect_draws(long(categorical), by, row_id, "cls", "value", classes, n_boot, seed, True).withColumn("type", F.lit("categorical")))
    ci = interval(cut_lineage(draws, "effects"), [*by, "type"], "effect", 50)
    return out.join(ci.select(*by, "type", F.round("ci_low", 4).alias("effect_ci_low"), F.round("ci_high", 4).alias("effect_ci_high")), [*by, "type"], "left")
