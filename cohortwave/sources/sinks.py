"""Guarded writers. Every write goes to its own folder named by run id; what
is "current" is a row in a small append-only table, so a reader never sees half
a run and an earlier version is never overwritten."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.quality import check_label_blind

MANIFEST_DDL = "name string, run_id string, version int, path string, published_at timestamp"
LOG_DDL = "path string, bytes bigint, outcome string, run_id string"


def write_table(df: DataFrame, path: str, run_id: str, fmt: str = "parquet", features: bool = False) -> None:
    """A result table stamped with its run. Feature tables must be label-blind."""
    if features:
        check_label_blind(df)
    w = df.withColumn("run_id", F.lit(run_id)).write.mode("errorifexists").format(fmt)
    (w.option("header", True) if fmt == "csv" else w).save(path)


def _published(spark: SparkSession, root: str) -> DataFrame | None:
    return _table(spark, MANIFEST_DDL, f"{root}/_published")


def _table(spark: SparkSession, ddl: str, path: str) -> DataFrame | None:
    """The table, or None where its folder does not exist; any other failure is raised."""
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A table with its own schema, or None where nothing has been written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _claim(spark: SparkSession, path: str, run_id: str) -> None:
    """One writer per path: creating the folder is the claim, and the second one fails."""
    try:
        spark.range(1).select(F.lit(run_id).alias("run_id")).coalesce(1).write.mode("errorifexists").parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_ALREADY_EXISTS":
            raise FileExistsError(f"{path} is claimed by another run") from e
        raise


def latest(spark: SparkSession, root: str, name: str):
    """Newest manifest row of a name, or None (a handful of rows per name)."""
    m = _published(spark, root)
    return None if m is None else m.where(F.col("name") == name).orderBy(F.desc("version")).first()


def publish(df: DataFrame, root: str, name: str, run_id: str, allow_overwrite: bool = False) -> str:
    """Write once, stage first: the data is complete before its manifest row
    exists. A second publish of the same name needs allow_overwrite and becomes
    the next version; the earlier one stays readable. A version belongs to the
    run that created its claim folder, so two runs cannot both publish it."""
    spark = df.sparkSession
    prev = latest(spark, root, name)
    if prev is not None and not allow_overwrite:
        raise FileExistsError(f"{name} is already published as version {prev['version']}")
    version = 1 if prev is None else prev["version"] + 1
    _claim(spark, f"{root}/_claims/{name}-version={version}", run_id)
    path = f"{root}/{name}/version={version}-run={run_id}"
    write_table(df, path, run_id)
    row = spark.range(1).select(F.lit(name).alias("name"), F.lit(run_id).alias("run_id"), F.lit(version).alias("version"), F.lit(path).alias("path"), F.current_timestamp().alias("published_at"))
    row.write.mode("append").parquet(f"{root}/_published")
    return path


def read_current(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    m = _published(spark, root)
    rows = [] if m is None else m.where(F.col("name") == name).collect()            # versions of one name
    rows = [r for r in rows if version is None or r["version"] == version]
    if not rows:
        raise FileNotFoundError(f"{name} has no published version")
    return spark.read.parquet(max(rows, key=lambda r: r["version"])["path"])


def resolve_target(live_root: str, scratch: str | None, run_id: str | None, exists: bool, overwrite: bool = False) -> str:
    """A scratch folder is always allowed; the live one only inside a run, for
    a new result, or with an explicit overwrite."""
    if scratch and scratch.rstrip("/") != live_root.rstrip("/"):
        return scratch
    if run_id or not exists or overwrite:
        return live_root
    raise PermissionError(f"refusing to overwrite {live_root} outside a run")


def append_log(entries: DataFrame, path: str, limit: int) -> int:
    """Append transfer outcomes and return the total; an append that would
    pass the byte limit is refused before anything is written."""
    spark = entries.sparkSession
    log = _table(spark, LOG_DDL, path)
    n, before = (0, 0) if log is None else tuple(v or 0 for v in log.agg(F.count(F.lit(1)), F.sum("bytes")).first())
    add = entries.agg(F.sum("bytes")).first()[0] or 0
    if before + add > limit:
        raise ValueError(f"byte budget exceeded: {before + add} > {limit}")
    _claim(spark, f"{path.rstrip('/')}_claims/after-{n}", "append")       # of two runs that saw the same log one goes on
    entries.select("path", "bytes", "outcome", "run_id").write.mode("append").parquet(path)
    return before + add


def rederive(docs: DataFrame, fresh: DataFrame, on: list[str], block: str, run_id: str, history: str = "history") -> DataFrame:
    """Replace one struct of each document by its re-derived value and append
    the earlier value to the history array; documents without a new value pass
    unchanged."""
    j = docs.join(fresh.select(*on, F.col(block).alias("__new")), on, "left")
    entry = F.struct(F.lit("rederive").alias("kind"), F.lit(run_id).alias("run_id"), F.col(block).alias("before"))
    past = F.coalesce(F.col(history), F.array().cast(docs.schema[history].dataType)) if history in docs.columns else None
    appended = F.array_append(past, entry) if past is not None else F.array(entry)
    changed = F.col("__new").isNotNull()
    kept = past if past is not None else F.array(entry).cast(f"array<{j.select(entry.alias('e')).schema['e'].dataType.simpleString()}>")
    out = j.withColumn(history, F.when(changed, appended).otherwise(kept if past is not None else F.filter(kept, lambda x: F.lit(False))))
    return out.withColumn(block, F.coalesce("__new", block)).drop("__new")


def gained_lost(docs: DataFrame, block: str, flag: str, history: str = "history") -> DataFrame:
    """How many documents gained or lost a flag in their last re-derivation."""
    last = F.element_at(history, -1)["before"][flag]
    d = docs.where(F.size(history) > 0).select(F.col(f"{block}.{flag}").alias("now"), last.alias("was"))
    return d.agg(F.count_if(F.col("now") & ~F.col("was")).alias("gained"), F.count_if(~F.col("now") & F.col("was")).alias("lost"), F.count(F.lit(1)).alias("n_rewritten"))


def provenance_json(df: DataFrame, keys: list[str], sections: dict[str, list[str]]) -> DataFrame:
    """One JSON document per row from named sections of columns."""
    doc = F.struct(*[F.struct(*cols).alias(name) for name, cols in sections.items()])
    return df.select(*keys, F.to_json(doc).alias("document"))
