"""Small reshaping helpers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def record_array(names: list[str], *rows: tuple) -> Column:
    """array<struct<names...>> from tuples of columns or plain values."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.array(*[F.struct(*[as_col(v).alias(n) for n, v in zip(names, r)]) for r in rows])


def unpivot(df: DataFrame, keep: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Long form of numeric columns; NaN becomes NULL."""
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    arr = record_array([name, value], *[(c, clean(c)) for c in columns])
    return df.select(*keep, F.explode(arr).alias("__u")).select(*keep, f"__u.{name}", f"__u.{value}")


def pivot_known(df: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """Wide form for a declared list of names (no job to discover them)."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])
