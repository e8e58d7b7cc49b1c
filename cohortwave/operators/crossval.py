"""Nested, repeated, grouped cross-validation of L2 logistic models.

Two layouts of the same analysis:

* many fits over a small matrix (permutations, bootstraps): Spark spreads the
  draws, and the matrix, of bounded, checked size, goes to each part of them;
* few fits over a matrix too large for that: all models advance together, each
  Newton step being one pass over the distributed rows that returns summed
  gradients and Hessians (`fit_distributed`).

`nested_cv` checks the size and picks; both follow the same fold rule.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.ordered import dense_index, exact_percentiles
from ..functions.rng import HashTails, hash_int
from ..functions.shape import record_array
from ..session import cut_lineage
from .stattests import auc as roc_auc

# The inverse regularisation strengths searched.
C_GRID = [0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0]
# A (draw, repeat) group above this many matrix cells uses the distributed fit.
MAX_GROUP_CELLS = 4_000_000
# Drawn rows (numbers, no features) that a task reads beside the matrix.
PART_ROWS = 2_000_000
# Rows whose weighted products are held at once in a task.
BLOCK_ROWS = 4096


def group_folds(df: DataFrame, by: list[str], group: str, y: str, n_folds: int, seed: int, n_repeats: int = 1, salt: str = "outer") -> DataFrame:
    """(by, rep, group, fold): groups are ranked by hash within their class and
    dealt round-robin, so all rows of a group share a fold and every fold gets
    its share of each class."""
    g = df.groupBy(*by, group).agg(F.max(y).alias("__y"))
    g = g.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))))
    key = hash_int(seed, salt, *[F.col(c) for c in by], F.col("rep"), F.col(group))
    d = dense_index(g, [*by, "rep", "__y"], key, group, hashed=True)
    return d.select(*by, "rep", group, (F.col("idx") % n_folds).cast("int").alias("fold"))


def fold_coverage(folds: DataFrame, rows: DataFrame, by: list[str], group: str, row_id: str) -> DataFrame:
    """Is every row tested exactly once per repeat?"""
    j = rows.join(folds, [*by, group])
    per = j.groupBy(*by, "rep", row_id).agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy(*by, "rep").agg(F.min("k").alias("min_tests"), F.max("k").alias("max_tests"), F.count(F.lit(1)).alias("n_rows"))


def fold_leakage(folds: DataFrame, rows: DataFrame, by: list[str], group: str) -> DataFrame:
    """Per (by, rep, fold): groups that are on the test and the train side."""
    j = rows.select(*by, group).join(folds, [*by, group])
    both = j.groupBy(*by, "rep", group).agg(F.countDistinct("fold").alias("k"))
    return both.groupBy(*by, "rep").agg(F.count_if(F.col("k") > 1).alias("n_shared")).withColumn("ok", F.col("n_shared") == 0)


def train_statistics(rows: DataFrame, folds: DataFrame, by: list[str], group: str, features: list[str], n_folds: int) -> DataFrame:
    """Median, mean and standard deviation of each feature over the TRAINING
    rows of every (rep, fold), the latter two after imputing the median."""
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    j = rows.join(folds.withColumnRenamed("fold", "__test"), [*by, group])
    j = j.withColumn("fold", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda f: f != F.col("__test"))))
    long = j.select(*by, "rep", "fold", F.explode(record_array(["feature", "v"], *[(c, clean(c)) for c in features])).alias("u")).select(*by, "rep", "fold", "u.*")
    long = cut_lineage(long, "train")
    keys = [*by, "rep", "fold", "feature"]
    med = exact_percentiles(long, keys, "v", {"median": 0.5}).select(*keys, "median")
    a = long.groupBy(*keys).agg(F.count("v").alias("k"), F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s2")).join(med, keys, "left")
    miss = F.col("n") - F.col("k")
    mean = (F.col("k") * F.col("m") + miss * F.col("median")) / F.col("n")
    a = a.withColumn("mean", mean)
    var = (F.col("k") * (F.col("s2") + F.pow(F.col("m") - F.col("mean"), 2)) + miss * F.pow(F.col("median") - F.col("mean"), 2)) / F.col("n")
    return a.select(*keys, "n", "median", "mean", F.sqrt(var).alias("std"))


# --- kernels used inside tasks ----------------------------------------------


class _Rows:
    """Rows `at` of a matrix, scaled as they are read: one block of them is held beside the matrix."""

    def __init__(self, x: np.ndarray, at: np.ndarray, mu=0.0, sd=1.0):
        self.x, self.at, self.mu, self.sd, self.width = x, at, mu, sd, x.shape[1]

    def __len__(self) -> int:
        return len(self.at)

    def blocks(self):
        for i in range(0, len(self.at), BLOCK_ROWS):
            yield slice(i, i + BLOCK_ROWS), (self.x[self.at[i:i + BLOCK_ROWS]] - self.mu) / self.sd

    def dense(self) -> np.ndarray:
        return (self.x[self.at] - self.mu) / self.sd

    def margins(self, beta: np.ndarray) -> np.ndarray:
        out = np.empty((len(beta), len(self)))
        for i, a in self.blocks():
            out[:, i] = beta[:, :1] + beta[:, 1:] @ a.T
        return out


class _Slices:
    """Rows of a scaled matrix as contiguous runs of it: nothing is copied."""

    def __init__(self, *parts: np.ndarray):
        self.parts, self.width = parts, parts[0].shape[1]

    def __len__(self) -> int:
        return sum(len(a) for a in self.parts)

    def blocks(self):
        at = 0
        for a in self.parts:
            for i in range(0, len(a), BLOCK_ROWS):
                block = a[i:i + BLOCK_ROWS]
                yield slice(at, at + len(block)), block
                at += len(block)


def _fit(x: np.ndarray | _Rows | _Slices, y: np.ndarray, cs: np.ndarray, steps: int = 200, k: np.ndarray | None = None) -> np.ndarray:
    """Ridge logistic coefficients (intercept first, unpenalised) for every C
    at once: minimum of 0.5|w|^2/C + log-loss, a row counted `k` times. Every C
    keeps its Hessian while the gradients shrink fast under it and has it
    summed again, over blocks of rows, when that saves passes."""
    rows = _Slices(x) if isinstance(x, np.ndarray) else x
    p, n, diag = rows.width + 1, len(rows), np.arange(rows.width + 1)
    ridge = np.zeros((len(cs), p))
    ridge[:, 1:] = (1.0 / cs)[:, None]
    share = y.mean() if k is None else (k * y).sum() / k.sum()
    beta = np.zeros((len(cs), p))
    beta[:, 0] = np.log(share / (1 - share)) if 0 < share < 1 else 0.0
    dear = 2 + p / 4 * n / (n + 1000)          # steps that cost as much as a Hessian and the two steps after it (measured)

    def hessian(w):
        out = np.zeros((len(w), p, p))
        for i, block in rows.blocks():
            for h, v in zip(out, w[:, i]):
                a = block * np.sqrt(v)[:, None]
                h[1:, 1:] += a.T @ a
                h[0, 1:] += v @ block
                h[0, 0] += v.sum()
        out[:, 1:, 0] = out[:, 0, 1:]
        return out

    def gradient(b, at):
        grad, mu = ridge[at] * b, np.empty((len(b), n))
        for i, block in rows.blocks():
            z = b[:, 1:] @ block.T
            z += b[:, :1]
            np.minimum(z, 500, out=z)
            np.exp(np.negative(np.maximum(z, -500, out=z), out=z), out=z)
            z += 1
            m = np.divide(1, z, out=mu[:, i]) - y[i]
            if k is not None:
                m *= k[i]
            grad[:, 1:] += m @ block
            grad[:, 0] += m.sum(axis=1)
        return grad, mu

    def weights(mu):
        return mu * (1 - mu) if k is None else mu * (1 - mu) * k

    def solve(h, g):
        return np.linalg.solve(h, g[:, :, None])[:, :, 0]

    live, now, t = np.arange(len(cs)), beta.copy(), np.ones(len(cs))      # the C still searched and where they are
    grad, mu = gradient(now, live)
    hess = np.repeat(hessian(weights(mu[:1])), len(cs), axis=0)           # all C start from one point
    hess[:, diag, diag] += ridge + 1e-12
    unit = 1 / np.sqrt(hess[:, diag, diag])
    step, size = solve(hess, grad), np.abs(grad * unit).max(axis=1)
    for _ in range(steps):
        move = t[:, None] * step
        new = now - move
        grad, mu = gradient(new, live)
        long = np.abs(grad * unit).max(axis=1)
        good = (long <= 0.7 * size) | ((grad * step).sum(axis=1) >= 0)     # else the step went too far
        rate = long / np.maximum(size, 1e-300)
        small = 1e-10 * np.maximum(1, np.abs(new).max(axis=1))
        with np.errstate(all="ignore"):
            left = np.where(rate < 1, np.log(small / (np.abs(move).max(axis=1) * rate)) / np.log(rate), np.inf)
        stale = np.flatnonzero(good & (left > dear))
        if len(stale):
            h = hessian(weights(mu[stale]))
            h[:, diag, diag] += ridge[live[stale]] + 1e-12
            hess[stale], unit[stale] = h, 1 / np.sqrt(h[:, diag, diag])
            long[stale] = np.abs(grad[stale] * unit[stale]).max(axis=1)
        now[good], size[good] = new[good], long[good]
        if good.all():
            step = solve(hess, grad)
        else:
            step[good] = solve(hess[good], grad[good])
        t = np.where(good, 1.0, 0.5 * t)
        done = good & (np.abs(step).max(axis=1) < small)
        if done.any():
            beta[live[done]] = now[done] - step[done]
            live, now, step, size, t, hess, unit = (v[~done] for v in (live, now, step, size, t, hess, unit))
            if not len(live):
                return beta
    raise ArithmeticError(f"logistic fit did not converge in {steps} steps")


def _auc(y: np.ndarray, s: np.ndarray, k: np.ndarray | None = None) -> float:
    """Tie-aware area; a row counts `k` times."""
    one = y if k is None else y * k
    zero = 1.0 - y if k is None else k - one
    n1, n0 = one.sum(), zero.sum()
    if n1 == 0 or n0 == 0:
        return np.nan
    o = np.argsort(s, kind="stable")
    s = s[o]
    first = np.r_[True, (s[1:] != s[:-1]) & ~np.isnan(s[:-1])]
    at = np.cumsum(first) - 1
    pos, neg = np.bincount(at, one[o]), np.bincount(at, zero[o])
    return float((pos * (np.cumsum(neg) - neg / 2)).sum() / (n1 * n0))


def _codes(grp: np.ndarray) -> np.ndarray:
    """Numbers of the groups in the order of their names; -1 for none."""
    c = pd.Categorical(grp)
    return c.codes.astype(np.int64)


def _deal(h: np.ndarray, grp: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Round-robin folds of groups (numbered) ranked by hash within their
    class; -1 for rows without a group."""
    have = np.flatnonzero(grp >= 0)
    fold = np.full(len(grp), -1)
    if not len(have):
        return fold
    size = int(grp.max()) + 1
    top, key = np.full(size, -np.inf), np.zeros(size, h.dtype)
    np.maximum.at(top, grp[have], y[have])
    key[grp[have]] = h[have]
    g = np.flatnonzero(top > -np.inf)
    g = g[np.lexsort((key[g], top[g]))]            # equal hashes stay in the order of the names
    _, start, count = np.unique(top[g], return_index=True, return_counts=True)
    of = np.empty(size, np.int64)
    of[g] = (np.arange(len(g)) - np.repeat(start, count)) % k
    fold[have] = of[grp[have]]
    return fold


def _scaled(x: np.ndarray, holes: np.ndarray, train: np.ndarray) -> tuple[_Rows, _Rows]:
    """Training and other rows, imputed (in `x`, where `holes` has the cells that were missing) and scaled by the training rows."""
    for j in np.flatnonzero(holes.any(axis=0)) if holes.size else ():
        have = x[train & ~holes[:, j], j]
        x[holes[:, j], j] = np.median(have) if len(have) else 0.0
    tr, te = _Rows(x, np.flatnonzero(train)), _Rows(x, np.flatnonzero(~train))
    mu = sum(a.sum(axis=0) for _, a in tr.blocks()) / len(tr)
    tr.mu = te.mu = mu
    sd = np.sqrt(sum((a * a).sum(axis=0) for _, a in tr.blocks()) / len(tr))
    tr.sd = te.sd = np.where(sd > 0, sd, 1.0)
    return tr, te


def _holes(x: np.ndarray) -> np.ndarray:
    """Cells that are missing; none are kept where there are none."""
    return np.isnan(x) if np.isnan(x.sum()) else np.zeros((0, x.shape[1]), bool)


def _batch(pdf: pd.DataFrame, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pdf[f.name], f.type, from_pandas=True) for f in schema], schema=schema)


def _matrix(batches: Iterator[pa.RecordBatch]) -> tuple[pd.DataFrame, np.ndarray]:
    """The group's rows in the order of hash and id, and their features: batch by batch, not through a Python object a row."""
    parts, rest = [], []
    for b in batches:
        parts.append(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).copy())
        rest.append(b.drop_columns(["x"]))
    pdf = pa.Table.from_batches(rest).to_pandas().sort_values(["h", "row_id"], kind="stable")
    to = np.empty(len(pdf), np.int64)
    to[pdf.index.to_numpy()] = np.arange(len(pdf))
    x, end = np.empty((len(pdf), parts[0].shape[1])), len(pdf)
    while parts:
        part = parts.pop()
        x[to[end - len(part):end]] = part
        end -= len(part)
    return pdf.reset_index(drop=True), x


def _prepared(x: np.ndarray, tr: np.ndarray, te: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Copies of the rows `tr` and `te` of `x`, imputed and scaled by the former, each of which counts `k` times."""
    a, b = x[tr], x[te]
    for j in np.flatnonzero(np.isnan(a.sum(axis=0)) | np.isnan(b.sum(axis=0))):
        hole = np.isnan(a[:, j])
        have = np.repeat(a[~hole, j], k[~hole].astype(np.int64))
        fill = np.median(have) if len(have) else 0.0
        a[hole, j] = fill
        b[np.isnan(b[:, j]), j] = fill
    mu = k @ a / k.sum()
    a -= mu
    sd = np.sqrt(np.einsum("i,ij,ij->j", k, a, a) / k.sum())
    sd = np.where(sd > 0, sd, 1.0)
    a /= sd
    return a, (b - mu) / sd


def _choose_c(a: np.ndarray, y: np.ndarray, k: np.ndarray, inner: np.ndarray, cs: np.ndarray) -> float:
    """The C with the best mean AUC over the inner folds; rows come in the order of `inner`."""
    scores = []
    for f in np.unique(inner[inner >= 0]):
        i, j = np.searchsorted(inner, f), np.searchsorted(inner, f, "right")
        rest = lambda v: np.concatenate([v[:i], v[j:]])
        if len(np.unique(rest(y))) < 2:
            continue
        beta = _fit(_Slices(a[:i], a[j:]), rest(y), cs, k=rest(k))
        scores.append([_auc(y[i:j], s, k[i:j]) for s in beta[:, :1] + beta[:, 1:] @ a[i:j].T])
    if not scores:
        return float(cs[0])
    m = np.array(scores)
    ok = ~np.isnan(m).all(axis=1)
    if not ok.any():
        return float(cs[0])
    return float(cs[int(np.argmax(np.round(np.nanmean(m[ok], axis=0), 12)))])


def _nested(x: np.ndarray, at: np.ndarray, grp: np.ndarray, y: np.ndarray, k: np.ndarray, h: np.ndarray, hi: np.ndarray,
            n_splits: int, inner: int, cs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Folds, out-of-fold probabilities, chosen C and (once per fold) coefficients of the rows `at` of `x`, each counted `k` times."""
    fold = _deal(h, grp, y, n_splits)
    proba, best, coef = np.full(len(y), np.nan), np.full(len(y), np.nan), [None] * len(y)
    for f in range(n_splits):
        te, tr = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
        if not len(te):
            continue
        if len(np.unique(y[tr])) < 2:
            proba[te] = y[tr].mean() if len(tr) else 0.5
            continue
        inn = _deal(hi[tr], grp[tr], y[tr], inner)
        by_fold = np.argsort(inn, kind="stable")
        tr, inn = tr[by_fold], inn[by_fold]
        a, b = _prepared(x, at[tr], at[te], k[tr])
        c = _choose_c(a, y[tr], k[tr], inn, cs)
        w = _fit(a, y[tr], np.array([c]), k=k[tr])[0]
        z = w[0] + np.einsum("ij,j->i", b, w[1:])       # row by row: equal rows tie exactly
        proba[te] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        best[te] = c
        coef[te[0]] = list(w[1:])      # once per fold
    return fold, proba, best, coef


# --- small-matrix layout ----------------------------------------------------


def _shape(rows: DataFrame, by: list[str]) -> tuple[int, int]:
    """(largest number of matrix cells in one group, number of groups)."""
    r = rows.groupBy(*by).agg((F.count(F.lit(1)) * F.max(F.size("x"))).alias("c")).agg(F.max("c").alias("c"), F.count(F.lit(1)).alias("g")).first()   # one row
    return r["c"] or 0, r["g"]


def _spread(df: DataFrame, keys: list[str], n_groups: int) -> DataFrame:
    """Groups of heavy fits spread over the cores. An explicit count keeps
    adaptive execution from merging the (byte-wise tiny) partitions into one
    task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(n_groups, 8 * cores)), *keys)


def nested_cv(rows: DataFrame, by: list[str], n_splits: int = 5, inner: int = 3, n_repeats: int = 1, seed: int = 20260810,
              c_grid: list[float] = C_GRID, max_cells: int = MAX_GROUP_CELLS) -> tuple[DataFrame, DataFrame]:
    """rows(by, row_id, grp, y, x array<double>) -> (predictions, fold fits).

    predictions(by, rep, row_id, y, fold, proba) has every row once per repeat;
    fits(by, rep, fold, best_c, coef) has the refitted coefficients."""
    cells, n_groups = _shape(rows, by)
    if cells > max_cells:
        return nested_cv_distributed(rows, by, n_splits, inner, n_repeats, seed, c_grid)
    res = cut_lineage(_nested_groups(rows, by, n_splits, inner, n_repeats, seed, c_grid, n_groups), "cv")
    pred = res.select(*by, "rep", "row_id", "y", "fold", "proba")
    return pred, res.where("coef is not null").select(*by, "rep", "fold", "best_c", "coef")


def nested_cv_auc(draws: DataFrame, rows: DataFrame, by: list[str], cells: int, n_draws: int, n_splits: int = 5, inner: int = 3, n_repeats: int = 1,
                  seed: int = 20260810, c_grid: list[float] = C_GRID, max_cells: int = MAX_GROUP_CELLS) -> DataFrame:
    """(by, rep, auc): the pooled AUC of every draw and nothing else.

    draws(by, pos, y, mult) names the rows of rows(by[0], pos, row_id, grp, x)
    that a draw holds, `mult` times each; `pos` is a row's own number and the
    last of `by` numbers the draws. Drawn rows carry no features: the matrix of
    `by[0]` (at most `cells`) goes to each part of its `n_draws` draws once."""
    if cells > max_cells:
        wide = draws.join(rows.drop(by[0], "y"), "pos").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("mult").cast("int"))))
        wide = wide.select(*by, F.concat_ws("#", "row_id", F.col("copy").cast("string")).alias("row_id"), "grp", "y", "x")
        pred, _fits = nested_cv_distributed(wide, by, n_splits, inner, n_repeats, seed, c_grid)
        return roc_auc(pred, [*by, "rep"], "y", "proba").select(*by, "rep", "auc")
    key, cs = by[0], np.asarray(c_grid)
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("g")).first()   # one row
    cores = draws.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(n_draws, max(4 * cores, -(-n_draws * (sizes["n"] or 0) // PART_ROWS))))
    left = draws.select(*by, "pos", "y", "mult", F.pmod(F.col(by[-1]), F.lit(parts)).cast("int").alias("part"))
    right = rows.select(F.col(key).alias("of"), F.col("pos").alias("at"), "row_id", "grp", "x", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("to"))
    schema = T.StructType([*left.select(*by).schema, T.StructField("rep", T.IntegerType()), T.StructField("auc", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(drawn: pa.Table, matrix: pa.Table) -> pa.Table:
        if not (drawn.num_rows and matrix.num_rows):
            return arrow.empty_table()
        ids = matrix.select(["at", "row_id", "grp"]).to_pandas()
        order = ids.sort_values(["row_id", "at"], kind="stable").index.to_numpy()      # the same sums under any partitioning
        x = np.empty((len(order), len(matrix.column("x")[0])))
        x[np.argsort(order)] = matrix.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(order), -1)
        grp, pos = _codes(ids["grp"].to_numpy()[order]), ids["at"].to_numpy()[order]
        names = HashTails([str(g) for g in pd.Categorical(ids["grp"]).categories])
        found = np.argsort(pos)
        at = found[np.searchsorted(pos[found], drawn.column("pos").to_numpy())]
        y, mult = drawn.column("y").to_numpy().astype(float), drawn.column("mult").to_numpy().astype(float)
        keys = drawn.select(by).to_pandas()
        unit = keys.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
        o = np.lexsort((at, unit))
        out = []
        for mine in np.split(o, np.flatnonzero(np.diff(unit[o])) + 1):
            draw = [drawn.column(c)[int(mine[0])].as_py() for c in by]
            for rep in range(n_repeats):
                g = grp[at[mine]]
                h, hi = (np.append(names.hashes(seed, salt, *draw, rep), 0)[g] for salt in ("outer", "inner"))     # 0 for rows without a group
                _f, proba, _b, _w = _nested(x, at[mine], g, y[mine], mult[mine], h, hi, n_splits, inner, cs)
                auc = _auc(y[mine], proba, mult[mine])
                out.append([*draw, rep, None if np.isnan(auc) else auc])
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    spread = lambda d, *keys: _spread(d, [*keys], sizes["g"] * parts).groupBy(*keys)
    return spread(left, key, "part").cogroup(spread(right, "of", "to")).applyInArrow(run, schema)


def _nested_groups(rows, by, n_splits, inner, n_repeats, seed, c_grid, n_groups) -> DataFrame:
    u = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))))
    keys = [F.col(c) for c in by]
    u = u.withColumn("h", hash_int(seed, "outer", *keys, F.col("rep"), F.col("grp"))).withColumn("hi", hash_int(seed, "inner", *keys, F.col("rep"), F.col("grp")))
    base = u.select(*by, "rep", "row_id", "y").schema
    schema = base.add("fold", T.IntegerType()).add("proba", T.DoubleType()).add("best_c", T.DoubleType()).add("coef", T.ArrayType(T.DoubleType()))
    cs = np.asarray(c_grid)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pdf, x = _matrix(batches)
        y, n = pdf["y"].to_numpy().astype(float), len(pdf)
        fold, proba, best, coef = _nested(x, np.arange(n), _codes(pdf["grp"].to_numpy()), y, np.ones(n), pdf["h"].to_numpy(), pdf["hi"].to_numpy(), n_splits, inner, cs)
        out = pdf[[*by, "rep", "row_id", "y"]].copy()
        yield _batch(out.assign(fold=fold.astype("int32"), proba=proba, best_c=best, coef=coef), arrow)

    u = _spread(u, [*by, "rep"], n_groups * n_repeats)
    return u.groupBy(*by, "rep").applyInArrow(run, schema)


def pooled_auc(pred: DataFrame, by: list[str]) -> DataFrame:
    """AUC of the pooled out-of-fold scores per repeat, then the mean."""
    per = roc_auc(pred, [*by, "rep"], "y", "proba")
    return per.groupBy(*by).agg(F.avg("auc").alias("auc"), F.count("auc").alias("n_repeats"), F.max(F.col("n1") + F.col("n0")).alias("n_used"))


def fold_auc(pred: DataFrame, by: list[str], score: str = "proba") -> DataFrame:
    """Mean over folds of the fold's own AUC; single-class folds are skipped,
    0.5 when none is left."""
    per = roc_auc(pred, [*by, "rep", "fold"], "y", score)
    return per.groupBy(*by).agg(F.coalesce(F.avg("auc"), F.lit(0.5)).alias("auc"), F.count("auc").alias("n_folds_used"))


def simple_cv(rows: DataFrame, by: list[str], n_splits: int = 5, n_repeats: int = 1, seed: int = 42, c: float = 1.0,
              select: bool = False, model: str = "logreg", alpha: float = 0.05, max_cells: int = MAX_GROUP_CELLS,
              shape: tuple[int, int] | None = None) -> DataFrame:
    """Plain stratified k-fold with one fixed C: (by, rep, row_id, y, fold,
    proba, n_selected). Folds are dealt by `grp` where the rows have one, so
    copies of a row stay together; else by row. `select` keeps the features passing Welch t + BH on the
    training rows (all when none does); model 'svm' gives the margin of a linear
    squared-hinge machine instead of a probability."""
    cells, n_groups = shape or _shape(rows, by)
    if "grp" not in rows.columns:
        rows = rows.withColumn("grp", F.col("row_id").cast("string"))
    if cells > max_cells:
        if select or model != "logreg":
            raise ValueError("matrix above the per-group bound: use LinearSVC / train_statistics with explicit folds")
        p, _f = nested_cv_distributed(rows, by, n_splits, 2, n_repeats, seed, [c], "plain")
        return p.withColumn("n_selected", F.lit(None).cast("int"))
    u = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))))
    u = u.withColumn("h", hash_int(seed, "plain", *[F.col(k) for k in by], F.col("rep"), F.col("grp")))
    schema = u.select(*by, "rep", "row_id", "y").schema.add("fold", T.IntegerType()).add("proba", T.DoubleType()).add("n_selected", T.IntegerType())
    from ..functions.tails import _beta_i

    def keep_columns(x, y):
        with np.errstate(all="ignore"):
            g1, g0 = x[y == 1], x[y == 0]
            k1, k0 = (~np.isnan(g1)).sum(axis=0), (~np.isnan(g0)).sum(axis=0)
            e1, e0 = np.nanvar(g1, axis=0, ddof=1) / k1, np.nanvar(g0, axis=0, ddof=1) / k0
            t = (np.nanmean(g1, axis=0) - np.nanmean(g0, axis=0)) / np.sqrt(e1 + e0)
            d = (e1 + e0) ** 2 / (e1 ** 2 / (k1 - 1) + e0 ** 2 / (k0 - 1))
        ok = np.isfinite(t) & np.isfinite(d) & (d > 0)
        p = np.ones(len(t))
        if ok.any():
            p[ok] = _beta_i(d[ok] / 2, np.full(int(ok.sum()), 0.5), d[ok] / (d[ok] + t[ok] ** 2))
        order = np.argsort(p)
        q = np.empty(len(p))
        q[order] = np.minimum.accumulate((p[order] * len(p) / (np.arange(len(p)) + 1))[::-1])[::-1]
        hit = np.where(q < alpha)[0]
        return hit if len(hit) else np.arange(len(p))

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pdf, x = _matrix(batches)
        y = pdf["y"].to_numpy().astype(float)
        fold = _deal(pdf["h"].to_numpy(), _codes(pdf["grp"].to_numpy()), y, n_splits)
        proba, nsel, holes = np.full(len(y), np.nan), np.zeros(len(y), dtype="int32"), _holes(x)
        for f in range(n_splits):
            te = fold == f
            tr = ~te
            if not te.any() or len(np.unique(y[tr])) < 2:
                continue
            use, gaps = x, holes
            if select:
                cols = keep_columns(x[tr], y[tr])
                use, gaps = x[:, cols], holes[:, cols]
            a, b = _scaled(use, gaps, tr)
            if model == "svm":
                w = _fit_svm(a.dense(), y[tr], c)
                proba[te] = b.margins(w[None])[0]
            else:
                w = _fit(a, y[tr], np.array([c]))[0]
                proba[te] = 1 / (1 + np.exp(-np.clip(b.margins(w[None])[0], -500, 500)))
            nsel[te] = a.width
        yield _batch(pdf[[*by, "rep", "row_id", "y"]].assign(fold=fold.astype("int32"), proba=proba, n_selected=nsel), arrow)

    u = _spread(u, [*by, "rep"], n_groups * n_repeats)
    return cut_lineage(u.groupBy(*by, "rep").applyInArrow(run, schema), "cv").where(~F.isnan("proba"))


def _fit_svm(x: np.ndarray, y: np.ndarray, c: float, steps: int = 500) -> np.ndarray:
    """Linear machine with squared hinge loss by damped Newton on the active set."""
    a = np.column_stack([np.ones(len(x)), x])
    s = 2 * y - 1
    ridge = np.ones(a.shape[1])
    ridge[0] = 1e-8
    b = np.zeros(a.shape[1])
    loss = lambda v: 0.5 * (ridge * v * v).sum() + c * (np.maximum(0, 1 - s * (a @ v)) ** 2).sum()
    for _ in range(steps):
        m = 1 - s * (a @ b)
        act = m > 0
        grad = ridge * b - 2 * c * (a[act] * (s[act] * m[act])[:, None]).sum(axis=0)
        hess = np.diag(ridge) + 2 * c * a[act].T @ a[act]
        step = np.linalg.solve(hess, grad)
        cur = loss(b)
        while np.abs(step).max() >= 1e-10 and loss(b - step) > cur:
            step = step / 2
        b = b - step
        if np.abs(step).max() < 1e-10:
            return b
    raise ArithmeticError(f"linear machine did not converge in {steps} steps")


# --- distributed layout -----------------------------------------------------


def fit_distributed(rows: DataFrame, sets: list[str], c_grid: list[float], n_features: int, steps: int = 200, tol: float = 1e-8) -> dict:
    """Coefficients of every (training set, C) pair over distributed rows.

    rows(y double, x array<double> scaled, member array<string>): `member`
    names the training sets a row belongs to; `sets` lists them (a few per
    fold, declared by configuration). One pass per Newton step serves all
    models; a task returns one partial sum per model, whatever its row count.
    Only coefficients (models x features) reach the driver."""
    spark = rows.sparkSession
    p = n_features + 1
    cs = np.asarray(c_grid)
    pos = {s: i for i, s in enumerate(sets)}
    beta = np.zeros((len(sets), len(cs), p))
    live = np.ones((len(sets), len(cs)), dtype=bool)
    damp = np.ones((len(sets), len(cs)))
    prev, old = np.full((len(sets), len(cs)), np.inf), beta.copy()
    ridge = np.zeros((len(cs), p))
    ridge[:, 1:] = (1.0 / cs)[:, None]
    schema = "s int, c int, v array<double>"
    for _ in range(steps):
        b = spark.sparkContext.broadcast((beta, live))       # models x (features + 1), bounded by configuration

        def part(batches):
            bt, lv = b.value
            acc = {}
            for pdf in batches:
                if not len(pdf):
                    continue
                a = np.column_stack([np.ones(len(pdf)), np.stack([np.asarray(v, float) for v in pdf["x"]])])
                y = pdf["y"].to_numpy(float)
                mem = [set(m) for m in pdf["member"]]
                for name, si in pos.items():
                    if not lv[si].any():
                        continue
                    mask = np.fromiter((name in m for m in mem), bool, len(mem))
                    if not mask.any():
                        continue
                    am, ym = a[mask], y[mask]
                    for ci in np.nonzero(lv[si])[0]:
                        z = am @ bt[si, ci]
                        mu = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                        w = mu * (1 - mu)
                        v = np.concatenate([[(np.logaddexp(0, z) - z * ym).sum()], am.T @ (mu - ym), ((am * w[:, None]).T @ am).ravel()])
                        acc[(si, ci)] = acc.get((si, ci), 0) + v
            if acc:
                yield pd.DataFrame([(s, c, list(v)) for (s, c), v in acc.items()], columns=["s", "c", "v"])

        sums = (rows.select("y", "x", "member").mapInPandas(part, schema).select("s", "c", F.posexplode("v").alias("k", "v"))
                .groupBy("s", "c", "k").agg(F.sum("v").alias("v")).groupBy("s", "c").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("v")))
        done = True
        for r in sums.collect():                              # one row per model
            si, ci = r["s"], r["c"]
            v = np.array([e["v"] for e in r["v"]])
            loss = v[0] + 0.5 * (ridge[ci] * beta[si, ci] ** 2).sum()
            if loss > prev[si, ci] + 1e-9 * abs(prev[si, ci]):
                damp[si, ci] *= 0.5
                beta[si, ci] = old[si, ci] + 0.5 * (beta[si, ci] - old[si, ci])
                done = False
                continue
            prev[si, ci], old[si, ci] = loss, beta[si, ci].copy()
            grad = v[1:1 + p] + ridge[ci] * beta[si, ci]
            hess = v[1 + p:].reshape(p, p) + np.diag(ridge[ci] + 1e-12)
            step = np.linalg.solve(hess, grad)
            beta[si, ci] = beta[si, ci] - step
            if np.abs(step).max() < tol:
                live[si, ci] = False
            else:
                done = False
        b.destroy()
        if done:
            return {s: beta[i] for s, i in pos.items()}
    raise ArithmeticError(f"distributed fit did not converge in {steps} passes")


def nested_cv_distributed(rows: DataFrame, by: list[str], n_splits: int, inner: int, n_repeats: int, seed: int,
                          c_grid: list[float], salt: str = "outer") -> tuple[DataFrame, DataFrame]:
    """`nested_cv` without gathering a draw's rows anywhere: folds by rank,
    statistics as aggregates, fits by summed gradients, AUC by rank sums. The
    draws (`by`) are handled one after the other, as their number is small when
    the matrix is large."""
    spark = rows.sparkSession
    p = int(rows.select(F.max(F.size("x"))).first()[0])
    feats = [f"x{i}" for i in range(p)]
    outs, fits = [], []
    for key in rows.select(*by).distinct().collect():         # one row per analysis
        d = rows
        for c in by:
            d = d.where(F.col(c).eqNullSafe(F.lit(key[c])))
        d = cut_lineage(d.select(*by, "row_id", "grp", "y", *[F.col("x")[i].alias(f) for i, f in enumerate(feats)]), "rows")
        outer = group_folds(d, by, "grp", "y", n_splits, seed, n_repeats, salt)
        outer = cut_lineage(outer, "folds")
        stats = train_statistics(d, outer, by, "grp", feats, n_splits)
        st = {(r["rep"], r["fold"], r["feature"]): (r["median"] or 0.0, r["mean"] or 0.0, r["std"] or 1.0) for r in stats.collect()}   # folds x features
        for rep in range(n_repeats):
            for f in range(n_splits):
                med, mu, sd = (np.array([st[(rep, f, x)][k] for x in feats]) for k in range(3))
                sd = np.where(sd > 0, sd, 1.0)
                scaled = F.array(*[(F.coalesce(F.when(~F.isnan(x), F.col(x).cast("double")), F.lit(float(med[i]))) - float(mu[i])) / float(sd[i]) for i, x in enumerate(feats)])
                m = d.join(outer.where(F.col("rep") == rep), [*by, "grp"]).select(*by, "rep", "row_id", "grp", F.col("y").cast("double").alias("y"), "fold", scaled.alias("x"))
                tr = m.where(F.col("fold") != f)
                inn = _inner_folds(tr, by, inner, seed)
                tr = cut_lineage(tr.join(inn, [*by, "grp"]).withColumn("member", F.concat(F.array(F.lit("all")), F.transform(
                    F.filter(F.sequence(F.lit(0), F.lit(inner - 1)), lambda g: g != F.col("ifold")), lambda g: F.concat(F.lit("in"), g.cast("string"))))), "train")
                one = tr.agg(F.min("y").alias("lo"), F.max("y").alias("hi")).first()          # one row
                if one["lo"] == one["hi"]:       # a single class: its mean, as in the other layout
                    outs.append(m.where(F.col("fold") == f).select(*by, "rep", "row_id", F.col("y").cast(rows.schema["y"].dataType).alias("y"), "fold", F.lit(0.5 if one["lo"] is None else one["lo"]).alias("proba")))
                    continue
                best = float(c_grid[0])
                if len(c_grid) > 1:
                    b = fit_distributed(tr, [f"in{g}" for g in range(inner)], c_grid, p)
                    best = _best_c_distributed(tr, b, c_grid, inner)
                w = fit_distributed(tr, ["all"], [best], p)["all"][0]
                z = F.lit(float(w[0])) + sum((F.col("x")[i] * float(w[i + 1]) for i in range(p)), F.lit(0.0))
                outs.append(m.where(F.col("fold") == f).select(*by, "rep", "row_id", F.col("y").cast(rows.schema["y"].dataType).alias("y"), "fold", (1 / (1 + F.exp(-z))).alias("proba")))
                fits.append(spark.range(1).select(*[F.lit(key[c]).alias(c) for c in by], F.lit(rep).alias("rep"), F.lit(f).alias("fold"), F.lit(best).alias("best_c"), F.array(*[F.lit(float(v)) for v in w[1:]]).alias("coef")))
    return reduce(DataFrame.unionByName, outs), reduce(DataFrame.unionByName, fits) if fits else _no_fits(rows, by)


def _no_fits(rows: DataFrame, by: list[str]) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    return rows.limit(0).select(*by, none("int").alias("rep"), none("int").alias("fold"), none("double").alias("best_c"), none("array<double>").alias("coef"))


def _inner_folds(tr: DataFrame, by: list[str], inner: int, seed: int) -> DataFrame:
    g = tr.groupBy(*by, "rep", "grp").agg(F.max("y").alias("__y"))
    key = hash_int(seed, "inner", *[F.col(c) for c in by], F.col("rep"), F.col("grp"))
    d = dense_index(g, [*by, "rep", "__y"], key, "grp", hashed=True)
    return d.select(*by, "grp", (F.col("idx") % inner).cast("int").alias("ifold"))


def _best_c_distributed(tr: DataFrame, b: dict, c_grid: list[float], inner: int) -> float:
    def score(g, ci):
        w = b[f"in{g}"][ci]
        return F.lit(float(w[0])) + sum((F.col("x")[i] * float(w[i + 1]) for i in range(len(w) - 1)), F.lit(0.0))

    per = F.array(*[F.struct(F.lit(ci).alias("c"), sum((F.when(F.col("ifold") == g, score(g, ci)).otherwise(0.0) for g in range(inner)), F.lit(0.0)).alias("z")) for ci in range(len(c_grid))])
    long = tr.select("ifold", "y", F.explode(per).alias("s")).select("ifold", "y", "s.c", "s.z")
    a = roc_auc(cut_lineage(long, "inner"), ["ifold", "c"], "y", "z").groupBy("c").agg(F.round(F.avg("auc"), 12).alias("a"))
    r = a.orderBy(F.desc("a"), "c").first()                    # one row per C
    return float(c_grid[r["c"]])
