"""Ordering primitives that never place one key's rows in a single task.

A plain window over (partition by key order by x) sorts a whole key in one
task. When one key holds a large share of the rows that task never ends, so
the functions here cut each key into ordered buckets, work inside the buckets,
and carry a small per-bucket summary from one bucket to the next.
"""
from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage

INF = float("inf")


def value_splits(df: DataFrame, value: str, n_buckets: int) -> list[float]:
    """Cut points that balance the rows of `value`, from a sample as a range
    partitioner would take it. They only steer how the work is divided; every
    row is used and results do not depend on them."""
    probs = [i / n_buckets for i in range(1, n_buckets)]
    qs = df.select(value).sample(0.05, seed=1).approxQuantile(value, probs, 0.5 / n_buckets)
    return [-INF] + (sorted(set(qs)) or [0.0]) + [INF]


def bucketed_counts(df: DataFrame, by: list[str], value: str,
                    n_buckets: int | None = None, sums: dict[str, Column] | None = None,
                    weight: Column | None = None) -> DataFrame:
    """One row per (by, value) with its count `n_at`, the count of smaller
    values `n_below` and the group size `n_all`. Equal values are combined
    before anything is ordered. `sums` adds further summed columns, each with
    a `<name>_below` running total; `weight` counts a row more than once."""
    sums = sums or {}
    spark = df.sparkSession
    if n_buckets is None:
        n_buckets = max(4, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    d = d.withColumn("__v", F.col(value).cast("double"))
    counts = d.groupBy(*by, "__v").agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n_at"),
        *[F.sum(c).alias(name) for name, c in sums.items()])
    # read three times below: cut points, bucket totals, running counts
    counts = cut_lineage(counts, "counts")
    counts = Bucketizer(splits=value_splits(counts, "__v", n_buckets), inputCol="__v", outputCol="__b").transform(counts)
    measures = ["n_at", *sums]
    totals = counts.groupBy(*by, "__b").agg(*[F.sum(m).alias(f"__t_{m}") for m in measures])
    prior = W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    # at most n_buckets rows per group reach these two windows
    offsets = totals.select(
        *by, "__b",
        *[F.coalesce(F.sum(f"__t_{m}").over(prior), F.lit(0)).alias(f"__o_{m}") for m in measures],
        F.sum("__t_n_at").over(whole).alias("n_all"))
    inside = W.partitionBy(*by, "__b").orderBy("__v").rowsBetween(W.unboundedPreceding, -1)
    # a shuffled join on the window's own keys: the window needs no further shuffle
    out = counts.join(offsets.hint("shuffle_hash"), [*by, "__b"])
    below = {m: F.col(f"__o_{m}") + F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in measures}
    return out.select(
        *by, F.col("__v").alias(value), "n_at", *sums,
        below["n_at"].alias("n_below"),
        *[below[m].alias(f"{m}_below") for m in sums], "n_all")


def tied_rank_column() -> Column:
    """Average rank of a value on the output of `bucketed_counts`."""
    return F.col("n_below") + (F.col("n_at") + 1) / F.lit(2.0)


def exact_percentiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float],
                      n_buckets: int | None = None) -> DataFrame:
    """Linearly interpolated percentiles per group, exact at any group size.

    `percentile()` keeps every distinct value of a group in one task; here the
    two order statistics around each position are picked from running counts."""
    c = bucketed_counts(df, by, value, n_buckets)
    return percentiles_from_counts(c, by, value, probs)


def percentiles_from_counts(c: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    lo_hi = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("n_all") - 1)
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("n_below") <= at) & (at < F.col("n_below") + F.col("n_at"))
            lo_hi.append(F.max(F.when(hit, F.col(value))).alias(f"__{side}_{name}"))
    g = c.groupBy(*by).agg(F.max("n_all").alias("n_all"), *lo_hi)
    out = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("n_all") - 1)
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out.append((lo + (pos - F.floor(pos)) * (hi - lo)).alias(name))
    return g.select(*by, F.col("n_all").alias("n"), *out)


def dense_index(df: DataFrame, by: list[str], key: Column, tie: str, n_buckets: int | None = None,
                name: str = "idx", hashed: bool = False) -> DataFrame:
    """Zero-based position of each row of a group in the order of a numeric
    `key` (ties by column `tie`), kept on every row. A `hashed` key is uniform
    over 48 bits, so its buckets need no look at the data."""
    spark = df.sparkSession
    if n_buckets is None:
        n_buckets = max(4, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = df.withColumn("__k", key.cast("double"))
    if hashed:
        splits = [-INF, *[2.0 ** 48 * i / n_buckets for i in range(1, n_buckets)], INF]
    else:
        splits = value_splits(d, "__k", n_buckets)
    d = Bucketizer(splits=splits, inputCol="__k", outputCol="__b").transform(d)
    totals = d.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__t"))
    prior = W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*by, "__b", F.coalesce(F.sum("__t").over(prior), F.lit(0)).alias("__o"),
                            F.sum("__t").over(W.partitionBy(*by)).alias(f"{name}_n"))
    inside = W.partitionBy(*by, "__b").orderBy("__k", tie)
    return (d.join(offsets.hint("shuffle_hash"), [*by, "__b"])
            .withColumn(name, F.col("__o") + F.row_number().over(inside) - 1)
            .drop("__k", "__b", "__o"))


def _following_first(edge: DataFrame, keys: list[str], direction: int, levels: int) -> DataFrame:
    """Each bucket's neighbouring bucket edge. With levels > 1 the (numeric)
    bucket numbers are themselves cut into coarser buckets, so even the table
    with one row per bucket is never sorted as one key."""
    if levels > 1:
        return neighbour(edge, keys, ["__b"], {"__edge": "__carry"}, F.floor(F.col("__b") / 4096), direction, levels - 1, "__c").select(*keys, "__b", "__carry")
    order = F.col("__b").asc() if direction > 0 else F.col("__b").desc()
    w = W.partitionBy(*keys).orderBy(order)
    return edge.select(*keys, "__b", F.lead("__edge").over(w).alias("__carry"))


def neighbour(df: DataFrame, keys: list[str], order: list[str], cols: dict[str, str],
              bucket: Column, direction: int = 1, levels: int = 1, tag: str = "__b") -> DataFrame:
    """lead (direction=1) or lag (direction=-1) of several columns in the order
    of `order` within `keys`. `bucket` must be a monotone function of the first
    order column (an hour number, a sample-block number): only a bucket is ever
    sorted as a unit, and the edge row of each bucket is handed to its
    neighbour through a table with one row per (keys, bucket)."""
    near, carry_col = f"{tag}_near", f"{tag}_carry"
    d = df.withColumn(tag, bucket)
    payload = F.struct(*[F.col(src) for src in cols])
    key = F.struct(*order)
    pick_edge = F.min_by(payload, key) if direction > 0 else F.max_by(payload, key)
    edges = d.groupBy(*keys, tag).agg(pick_edge.alias("__edge_of")).withColumnRenamed(tag, "__bk")
    edges = edges.select(*keys, F.col("__bk").alias("__b"), F.col("__edge_of").alias("__edge"))
    carry = _following_first(edges, keys, direction, levels).select(*keys, F.col("__b").alias(tag), F.col("__carry").alias(carry_col))
    asc = [F.col(c).asc() for c in order]
    w = W.partitionBy(*keys, tag).orderBy(*asc)
    move = (lambda c: F.lead(c).over(w)) if direction > 0 else (lambda c: F.lag(c).over(w))
    d = d.join(carry.hint("shuffle_hash"), [*keys, tag])
    d = d.withColumn(near, move(F.struct(F.struct(*[F.col(s) for s in cols]).alias("p"))))
    for src, dst in cols.items():
        d = d.withColumn(dst, F.when(F.col(near).isNotNull(), F.col(f"{near}.p.{src}"))
                         .otherwise(F.col(f"{carry_col}.{src}")))
    return d.drop(tag, carry_col, near)


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str,
                buckets: list[Column], name: str) -> DataFrame:
    """Inclusive running total in order. `buckets` are monotone in the first
    order column, coarse to fine; each level adds the total of the earlier
    buckets within the level above, so no level sorts more than one bucket's
    children."""
    tags = [f"__b{i}" for i in range(len(buckets))]
    d = df
    for t, b in zip(tags, buckets):
        d = d.withColumn(t, b)
    offset = F.lit(0)
    totals = d.groupBy(*keys, *tags).agg(F.sum(value).alias("__t"))
    for i, t in enumerate(tags):
        level = totals.groupBy(*keys, *tags[:i + 1]).agg(F.sum("__t").alias("__t")) if i < len(tags) - 1 else totals
        w = W.partitionBy(*keys, *tags[:i]).orderBy(t).rowsBetween(W.unboundedPreceding, -1)
        d = d.join(level.select(*keys, *tags[:i + 1], F.coalesce(F.sum("__t").over(w), F.lit(0)).alias(f"__o{i}")), [*keys, *tags[:i + 1]])
        offset = offset + F.col(f"__o{i}")
    inside = W.partitionBy(*keys, *tags).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return d.withColumn(name, offset + F.sum(value).over(inside)).drop(*tags, *[f"__o{i}" for i in range(len(tags))])
