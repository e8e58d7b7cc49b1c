"""Helpers shared by the corpus operators."""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage

#: ASCII characters that separate words of the scanning operators; A-Z is lower-cased before.
_SEPARATORS = bytes(b if (48 <= b <= 57 or 97 <= b <= 122 or b >= 128) else 32 for b in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_SEPARATORS).split() if text else []


def blank_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8; bytes.split() cuts at exactly these characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or `name` with underscores until no column of df is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(df: DataFrame) -> Column:
    """64 bits over the whole row, with its nulls."""
    return F.xxhash64(*[x for c in df.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])


@contextmanager
def settings(spark: SparkSession, **values):
    """Session settings (dots written as two underscores) while it is open."""
    names = {k.replace("__", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def short_shuffles(spark: SparkSession):
    """Within it, the shuffle files of a query that has ended are removed: for loops whose steps write their result."""
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def large_rows(spark: SparkSession):
    """Within it, a few rows at a time are sent to Python: for tables whose rows hold megabytes."""
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=4)


def join_bounded(df: DataFrame, small: DataFrame, on, how: str, max_rows: int = 500_000) -> DataFrame:
    """Join with a table that is counted first: broadcast while it has at most
    `max_rows` rows, else a shuffled join whose skew Spark splits."""
    return df.join(F.broadcast(small) if small.count() <= max_rows else small, on, how)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with a function from a RecordBatch to a dict of columns (or
    None). Batches are worked on in slices, so Python holds few texts at once."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if (out := fn(b)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of edges (a, b): columns node, root with the
    smallest node that can be reached. Large-star and small-star rounds until
    no edge changes; each round is written to the shared folder, so nothing is
    collected and a lost executor costs one round."""
    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # large star: every larger neighbour of a goes to a's smallest
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour of a, and a, go to the smallest
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        new = cut_lineage(large.join(low2, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                                                                         F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
                          .select("x.*").where("a <> b").distinct(), name)
        if new.count() == e.count() and new.join(e, ["a", "b"], "left_anti").isEmpty():
            return new.select(F.col("a").alias("node"), F.col("b").alias("root"))
        e = new
