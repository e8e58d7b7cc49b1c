"""Bootstrap, leave-k-out and permutation draws as ordinary Spark rows.

A draw is a function of (seed, draw, position), so it is the same under any
partitioning. Draws are expanded from the rows themselves (never a cross join)
and bootstrap draws are folded to multiplicities before they are joined back.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.ordered import dense_index
from ..functions.rng import BATCH, HashTails, hash_int, pick


def indexed(df: DataFrame, by: list[str], row_id: str, seed: int) -> DataFrame:
    """Zero-based position `idx` of every row within `by` (order of a hash of
    the id) and the group size `idx_n`."""
    return dense_index(df, by, hash_int(seed, F.col(row_id)), row_id, hashed=True)


def bootstrap(df: DataFrame, row_id: str, n_draws: int, seed: int, strata: list[str] = (), folded: bool = True) -> DataFrame:
    """(draw, rows of df, mult): n-of-n draws with replacement, within strata
    when given. The original row id is kept, so duplicates can share a fold.
    Not `folded`, a row comes once for each time it is drawn, with mult 1: for
    readers that add the weights up themselves."""
    strata = list(strata)
    d = indexed(df, strata, row_id, seed)
    label = _label(strata)
    draws = d.select(*strata, "idx", "idx_n", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("draw"))
    picks = draws.select(*strata, "draw", pick(F.col("idx_n"), seed, F.col("draw"), label, F.col("idx")).alias("idx"))
    if not folded:
        return picks.withColumn("mult", F.lit(1).cast("bigint")).join(d.drop("idx_n").hint("shuffle_hash"), [*strata, "idx"]).drop("idx")
    # dealt by the keys of the join below, which the count can use as well: the drawn rows are shuffled once
    mult = picks.repartition(*strata, "idx").groupBy(*strata, "draw", "idx").agg(F.count(F.lit(1)).alias("mult"))
    return mult.join(d.drop("idx_n").hint("shuffle_hash"), [*strata, "idx"]).drop("idx")


def _label(strata: list[str]) -> Column:
    return F.concat_ws("/", *[F.col(c).cast("string") for c in strata]) if strata else F.lit("all")


def bootstrap_counts(df: DataFrame, row_id: str, n_draws: int, seed: int, by: list[str], cls: str, value: str, classes: list,
                     statistic: Callable[[np.ndarray], float | None], max_rows: int) -> DataFrame | None:
    """(by, draw, effect) over the draws of `bootstrap` with strata [by, cls],
    which are picked and counted inside tasks: no drawn row is written. A task
    holds one `by` with its rows once and takes a part of its draws;
    `statistic` sees the counts per class and distinct value, smallest first.
    None where a `by` has more than `max_rows` rows."""
    d = indexed(df.select(*by, row_id, cls, value), [*by, cls], row_id, seed)
    which = F.coalesce(*[F.when(F.col(cls) == c, k) for k, c in enumerate(classes)])
    d = d.where(F.col(cls).isin(classes)).select(*by, which.alias("c"), "idx", F.col(value).cast("double").alias("v"), _label([*by, cls]).alias("label"))
    sizes = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("g")).first()   # one row
    if (sizes["n"] or 0) > max_rows:
        return None
    tasks = 8 * df.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(n_draws, -(-tasks // max(1, sizes["g"]))))
    d = d.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(max(1, min(tasks, sizes["g"] * parts)), *by, "part")
    schema = T.StructType([*d.select(*by).schema, T.StructField("draw", T.IntegerType()), T.StructField("effect", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [*batches]
        key, part = [got[0].column(b)[0].as_py() for b in by], got[0].column("part")[0].as_py()
        whole = lambda name: np.concatenate([b.column(name).to_numpy(zero_copy_only=False) for b in got])
        c, idx, v = whole("c"), whole("idx"), whole("v")
        _, code = np.unique(v, return_inverse=True)                # NaN, if any, comes last
        n_values, missing = int(code.max()) + 1, int(np.isnan(v).any())
        strata = []
        for k in range(len(classes)):
            at = np.flatnonzero(c == k)
            b = next((b for b in got if len(at) and (b.column("c").to_numpy() == k).any()), None)
            label = None if b is None else b.column("label")[int(np.flatnonzero(b.column("c").to_numpy() == k)[0])].as_py()
            strata.append((label, code[at[np.argsort(idx[at])]], HashTails(len(at))))
        del got, c, idx, v, code
        draws, effects, todo = [], [], [*range(part, n_draws, parts)]
        many = max(1, BATCH // max(len(codes) for _, codes, _ in strata))
        for some in (todo[i:i + many] for i in range(0, len(todo), many)):
            counts = np.zeros((len(some), len(strata), n_values))
            for k, (label, codes, tails) in enumerate(strata):
                if len(codes):
                    picks = tails.rows([f"{seed}|{draw}|{label}|" for draw in some]) % len(codes)
                    slots = codes[picks] + n_values * np.arange(len(some))[:, None]
                    counts[:, k] = np.bincount(slots.ravel(), minlength=n_values * len(some)).reshape(len(some), -1)
            for draw, c in zip(some, counts[:, :, :n_values - missing]):
                effect = statistic(c) if c.any() else None
                if effect is not None:
                    draws.append(draw)
                    effects.append(float(effect))
        yield pa.RecordBatch.from_arrays([*(pa.array([k] * len(draws), f.type) for k, f in zip(key, arrow)), pa.array(draws, pa.int32()), pa.array(effects, pa.float64())], schema=arrow)

    return d.groupBy(*by, "part").applyInArrow(run, schema)


def both_classes(draws: DataFrame, by: list[str], y: str) -> DataFrame:
    """Drop the draws in which only one class was picked."""
    ok = draws.groupBy(*by).agg(F.min(y).alias("a"), F.max(y).alias("b")).where("a <> b").select(*by)
    return draws.join(ok, by, "left_semi")


def leave_k_out(df: DataFrame, row_id: str, ks: list[int], reps: int, seed: int) -> DataFrame:
    """(k, rep, rows kept): the k rows with the smallest hashes of a draw are
    left out; only k rows per draw and task reach the ranking."""
    def reps_of(k):
        return F.transform(F.sequence(F.lit(0), F.lit(reps - 1)), lambda r: F.struct(F.lit(k).alias("k"), r.alias("rep")))

    draw = F.explode(F.flatten(F.array(*[reps_of(k) for k in ks]))).alias("d")
    e = df.select("*", draw).select(*df.columns, F.col("d.k").alias("k"), F.col("d.rep").alias("rep"))
    h = e.select("k", "rep", row_id, hash_int(seed, F.col("k"), F.col("rep"), F.col(row_id)).alias("h"))
    rank = F.row_number().over(W.partitionBy("k", "rep").orderBy("h", row_id))
    out = h.withColumn("r", rank).where(F.col("r") <= max(ks)).where(F.col("r") <= F.col("k")).select("k", "rep", row_id)
    return e.join(out, ["k", "rep", row_id], "left_anti")


def permute_labels(df: DataFrame, row_id: str, y: str, n_draws: int, seed: int, within: list[str] = ()) -> DataFrame:
    """(draw, rows with permuted y). The row at position i of the stored order
    takes the label of the row at position i of the draw's hash order."""
    within = list(within)
    d = indexed(df, within, row_id, seed).drop("idx_n")
    e = d.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
    src = dense_index(e.select(*within, "draw", row_id, F.col(y).alias("__y")), [*within, "draw"],
                      hash_int(seed, F.col("draw"), F.col(row_id)), row_id, hashed=True).select(*within, "draw", "idx", "__y")
    return e.join(src, [*within, "draw", "idx"]).withColumn(y, F.col("__y")).drop("__y", "idx")


def resampled(df: DataFrame, row_id: str, n_draws: int, seed: int, statistic: Column, strata: list[str] = (), by: list[str] = ()) -> DataFrame:
    """Any aggregate column, evaluated on every bootstrap draw. The statistic
    sees each picked row `mult` times."""
    b = bootstrap(df, row_id, n_draws, seed, strata)
    b = b.withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("mult").cast("int")))).drop("__c", "mult")
    return b.groupBy("draw", *by).agg(statistic.alias("statistic"))
