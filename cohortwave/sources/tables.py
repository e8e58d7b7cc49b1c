"""Readers: delimited tables, sidecar trees, listings, signal blocks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as tx

# The sidecar document as a nested schema.
SIDECAR_DDL = """
  ParticipantID string, TaskName string, Sources array<struct<path: string, sha256: string>>,
  BadChannels struct<n: int, names: array<string>, occipital_bads: int>,
  ICA struct<n_components: int, excluded_components: array<int>, excluded_labels: array<string>, labeling: string>,
  Duration struct<s: double, n_samples_final: bigint>, LineNoisePower struct<before_index: double, after_index: double>,
  LineNoiseRemoval struct<method: string>, ArtifactAnnotation struct<fraction: double>,
  IAF struct<iaf_hz: double, peak_height_db: double, present: boolean>,
  IAFWindow struct<method: string, tmin_s: double, tmax_s: double>,
  Backfill array<struct<kind: string, run_id: string, before_iaf_hz: double>>"""


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """Header CSV/TSV with a declared schema; NaN becomes NULL in doubles."""
    df = spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "FAILFAST").csv(path)
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if ty in ("double", "float") else F.col(c) for c, ty in df.dtypes])


def read_sidecars(spark: SparkSession, root: str, glob: str = "*_desc-preproc_eeg.json", one_per_file: bool = True) -> DataFrame:
    """Sidecar documents below a folder tree, one row each. `one_per_file` is
    for pretty-printed single documents; otherwise one document per line."""
    return (spark.read.schema(SIDECAR_DDL).option("multiLine", one_per_file).option("recursiveFileLookup", True)
            .option("pathGlobFilter", glob).json(root))


def read_listing(spark: SparkSession, root: str) -> DataFrame:
    """Paths relative to `root` and sizes; file contents are not read."""
    plain = "/" + root.rstrip("/").split(":", 1)[-1].lstrip("/")
    quoted = plain.replace("\\", "\\\\").replace("'", "\\'")
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
            .select(F.expr(f"substring(path, instr(path, '{quoted}/') + {len(plain) + 1})").alias("rel_path"),
                    F.col("length").alias("bytes")))


def fingerprints(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
            .select(tx.file_name(F.col("path")).alias("file"), "length", F.sha2("content", 256).alias("sha256")))


def fingerprint_column(df: DataFrame, content: str) -> DataFrame:
    """The same for contents held in a table."""
    return df.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))


def required_window(sidecars: DataFrame, column: str = "IAFWindow") -> DataFrame:
    """tmin/tmax of the stored window; a document without one fails the job."""
    w = F.col(column)
    have = w.isNotNull() & w["tmin_s"].isNotNull() & w["tmax_s"].isNotNull()
    get = lambda f: F.when(have, w[f]).otherwise(F.raise_error(F.lit(f"sidecar without {column}")).cast("double"))
    return sidecars.select(*[c for c in sidecars.columns if c != column], get("tmin_s").alias("tmin_s"), get("tmax_s").alias("tmax_s"))


def pick_and_crop(blocks: DataFrame, channel: str, picks: list, block_len: int, first: int, last: int) -> DataFrame:
    """Chosen channels, samples first..last. Both filters are plain column
    predicates on the stored columns, so they reach the Parquet scan; only the
    two edge blocks are sliced."""
    d = blocks.where(F.col(channel).isin(picks) & (F.col("block_id") >= first // block_len) & (F.col("block_id") <= last // block_len))
    base = F.col("block_id") * block_len
    lo = F.greatest(F.lit(first) - base, F.lit(0))
    hi = F.least(F.lit(last + 1) - base, F.size("samples").cast("bigint"))
    return d.withColumn("samples", F.slice("samples", (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int")))


def manifest_tasks(manifest: DataFrame) -> DataFrame:
    """Tasks per subject (a subject has a handful of distinct tasks)."""
    return manifest.groupBy("subject").agg(F.array_join(F.array_sort(F.collect_set("task")), ",").alias("tasks"), F.count(F.lit(1)).alias("n_files"))


def manifest_of(manifest: DataFrame, subject: str | Column) -> DataFrame:
    return manifest.where(F.col("subject") == subject)
