"""Cohort relational operators: joins, reconciliation, set membership."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..functions.shape import record_array


def parse_listing(listing: DataFrame, path: str = "rel_path") -> DataFrame:
    p = F.col(path)
    return listing.select(
        p.alias("path"), F.coalesce("bytes", F.lit(0)).alias("bytes"), tx.path_modality(p).alias("modality"),
        tx.path_subject(p).alias("subject"), tx.name_entity(p, "task").alias("task"))


def require_tasks(listing: DataFrame) -> DataFrame:
    """The listing unchanged, or a failing job when no row carries a task."""
    seen = listing.agg(F.count("task").alias("__n")).select(
        F.when(F.col("__n") > 0, F.lit(True)).otherwise(
            F.raise_error(F.lit("no task could be parsed from the listing")).cast("boolean")).alias("__ok"))
    return listing.join(F.broadcast(seen), F.col("__ok"), "left_semi")   # one row


def group_members(groups: dict[str, list[str]], spark) -> DataFrame:
    """Configuration map group -> subjects as rows."""
    one = spark.range(1).select(F.create_map(*[
        c for g, ids in groups.items() for c in (F.lit(g), F.array(*[F.lit(i) for i in ids]))]).alias("m"))
    return one.select(F.explode("m").alias("grp", "ids")).select("grp", F.explode("ids").alias("subject"))


def assemble(feature_sets: dict[str, DataFrame], labels: DataFrame, nuisance: DataFrame | None = None,
             on: str = "subject") -> DataFrame:
    """Inner chain of feature tables, then LEFT joins of nuisance and labels;
    columns of a later set that clash get the suffix _<set>."""
    taken: set[str] = set()
    parts = []
    for name, df in feature_sets.items():
        for c in [c for c in df.columns if c != on and c in taken]:
            df = df.withColumnRenamed(c, f"{c}_{name}")
        taken |= set(df.columns)
        parts.append(df)
    out = reduce(lambda a, b: a.join(b, on, "inner"), parts)
    for extra in (nuisance, labels):
        if extra is not None:
            out = out.join(extra, on, "left")
    return out


def nuisance_table(demographic: DataFrame, qc: DataFrame, on: str = "subject") -> DataFrame:
    return demographic.join(qc, on, "full_outer")


def attach_group(df: DataFrame, groups: DataFrame, on: str = "subject", group: str = "grp",
                 drop_unmatched: bool = True) -> DataFrame:
    out = df.join(groups, on, "left")
    return out.dropna(subset=[group]) if drop_unmatched else out


def reconcile(participants: DataFrame, client: DataFrame, subject_col: str, apoe_col: str, snp_col: str) -> DataFrame:
    """One row per participant (or per listed subject without one) with the
    derived and the client group and a status."""
    p = (participants
         .select(tx.subject_id(F.col(subject_col)).alias("subject"),
                 F.col(apoe_col).alias("apoe_raw"), F.col(snp_col).alias("picalm_raw"))
         .withColumn("pair", tx.allele_pair(F.col("apoe_raw"))).withColumn("snp", tx.snp_pair(F.col("picalm_raw")))
         .select("subject", "apoe_raw", "picalm_raw",
                 F.coalesce(F.concat(F.lit("ERROR: "), F.col("pair.error")),
                            F.concat_ws("/", F.col("pair.a1").cast("string"), F.col("pair.a2").cast("string"))).alias("apoe_norm"),
                 F.coalesce(F.concat(F.lit("ERROR: "), F.col("snp.error")), F.col("snp.value")).alias("picalm_norm"),
                 tx.derived_group(F.col("pair"), F.col("snp")).alias("group_derived"),
                 F.lit(True).alias("in_table")))
    j = p.join(client.select("subject", F.col("grp").alias("group_client")), "subject", "full_outer")
    status = (F.when(F.col("in_table").isNull(), "MISSING_FROM_TSV")
              .when(F.col("group_client").isNull(), "GENETIC_COHORT_ONLY")
              .when(F.col("group_derived") == F.col("group_client"), "RECONCILED")
              .otherwise("MISMATCH"))
    blank = lambda c: F.when(F.col("in_table"), F.col(c)).otherwise("").alias(c)
    return j.select("subject", blank("apoe_raw"), blank("picalm_raw"), blank("apoe_norm"), blank("picalm_norm"),
                    blank("group_derived"),
                    F.coalesce("group_client", F.lit("NOT_IN_CLIENT_LIST")).alias("group_client"),
                    status.alias("status"))


def stop_gate(reconciled: DataFrame, max_blocking: int = 2) -> DataFrame:
    return reconciled.agg(
        F.count_if(F.col("status").isin("MISMATCH", "MISSING_FROM_TSV")).alias("n_blocking"),
        F.count(F.lit(1)).alias("n_rows")).select(
        "n_blocking", "n_rows",
        F.when(F.col("n_blocking") > max_blocking, "STOP").otherwise("PROCEED").alias("verdict"))


def cohort_flags(table_ids: DataFrame, list_ids: DataFrame, data_ids: DataFrame, on: str = "subject") -> DataFrame:
    """Flags over the union of table and list ids. One union and one
    aggregation instead of three joins."""
    tag = lambda df, name: df.select(on, *[F.lit(name == n).alias(n) for n in ("t", "l", "d")])
    u = tag(table_ids, "t").unionByName(tag(list_ids, "l")).unionByName(tag(data_ids, "d"))
    g = u.groupBy(on).agg(*[F.max(n).alias(n) for n in ("t", "l", "d")]).where("t or l")
    return g.select(on, F.col("l").alias("in_client_list"), F.col("t").alias("in_participants_tsv"),
                    F.col("d").alias("has_any_eeg"), (F.col("t") & F.col("l") & F.col("d")).alias("final_include"))


def triplet_status(headers: DataFrame, files: DataFrame) -> DataFrame:
    """Check each header's data and marker files against the listing. The four
    possible names are looked up in one join and folded back per header."""
    h = headers.select(
        "dir", "stem", tx.header_field(F.col("vhdr_text"), "DataFile").alias("datafile"),
        tx.header_field(F.col("vhdr_text"), "MarkerFile").alias("markerfile"))
    look = h.select("*", F.explode(record_array(
        ["kind", "file"], ("de", F.col("datafile")), ("dm", F.col("markerfile")),
        ("ce", F.concat("stem", F.lit(".eeg"))), ("cm", F.concat("stem", F.lit(".vmrk"))))).alias("q"))
    look = look.select("dir", "stem", "datafile", "markerfile", F.col("q.kind").alias("kind"),
                       F.concat_ws("/", "dir", "q.file").alias("path"))
    j = look.join(files.select("path", "bytes", "head"), "path", "left")
    at = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    g = j.groupBy("dir", "stem", "datafile", "markerfile").agg(
        *[at(k, "bytes").alias(f"{k}_bytes") for k in ("de", "dm", "ce", "cm")],
        *[at(k, "head").alias(f"{k}_head") for k in ("dm", "cm")])
    canon_e, canon_m = F.concat("stem", F.lit(".eeg")), F.concat("stem", F.lit(".vmrk"))
    declared_ok = F.col("de_bytes").isNotNull() & F.col("dm_bytes").isNotNull()
    canon_ok = F.col("ce_bytes").isNotNull() & F.col("cm_bytes").isNotNull()
    stale = F.coalesce(tx.header_field(F.col("cm_head"), "DataFile") == F.col("datafile"), F.lit(False))
    typo = tx.near_name(F.col("datafile"), canon_e) & tx.near_name(F.col("markerfile"), canon_m)
    g = g.withColumn("fallback", F.coalesce(~declared_ok & canon_ok & (stale | typo), F.lit(False)))
    eeg_bytes = F.when(F.col("fallback"), F.col("ce_bytes")).otherwise(F.col("de_bytes"))
    eeg_name = F.when(F.col("fallback"), canon_e).otherwise(F.col("datafile"))
    mark_bytes = F.when(F.col("fallback"), F.col("cm_bytes")).otherwise(F.col("dm_bytes"))
    mark_head = F.when(F.col("fallback"), F.col("cm_head")).otherwise(F.col("dm_head"))
    named = tx.header_field(mark_head, "DataFile")
    wrong = (named != "") & (named != F.col("datafile")) & (named != eeg_name) & ~(
        F.col("fallback") & tx.near_name(named, eeg_name))
    status = (F.when(F.col("datafile") == "", "no_datafile_field")
              .when(F.col("markerfile") == "", "no_markerfile_field")
              .when(eeg_bytes.isNull(), "orphaned_header")
              .when(mark_bytes.isNull(), "missing_marker_file")
              .when(eeg_bytes == 0, "zero_byte_data")
              .when(F.coalesce(wrong, F.lit(False)), "inconsistent_triplet")
              .otherwise("ok"))
    return g.select("dir", "stem", "datafile", "markerfile", status.alias("status"),
                    F.col("fallback").alias("header_discrepancy"),
                    F.when(status == "ok", eeg_name).alias("resolved_data"))


def transfer_plan(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """skip when the file is there with the listed size, quarantine when the
    size differs, fetch otherwise."""
    j = manifest.join(present.select("path", F.col("bytes").alias("have")), "path", "left")
    action = (F.when(F.col("have") == F.col("bytes"), "skip").when(F.col("have").isNull(), "fetch")
              .otherwise("quarantine"))
    return j.withColumn("action", action).drop("have")


def pending_subjects(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """Per subject: every manifest task has a derivative?"""
    m = manifest.select("subject", "task").distinct()
    j = m.join(done.select("subject", "task", F.lit(True).alias("ok")).distinct(), ["subject", "task"], "left")
    return j.groupBy("subject").agg(
        F.bool_and(F.coalesce("ok", F.lit(False))).alias("complete"),
        F.count_if(F.col("ok").isNull()).alias("n_pending"))


def nearest_sensors(positions: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """k nearest other channels per channel, by distance then name. The group
    is one montage: its channel count is fixed by the device, so the pairs
    within it are bounded."""
    sensor = F.struct(*[F.col(c) for c in ("channel", "x", "y", "z")])
    g = positions.groupBy(*by).agg(F.array_sort(F.collect_list(sensor)).alias("all"))
    d2 = lambda a, b: (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)
    g = g.select(*by, F.explode("all").alias("me"), "all")
    near = F.slice(F.array_sort(F.transform(
        F.filter("all", lambda o: o.channel != F.col("me.channel")),
        lambda o: F.struct(F.sqrt(d2(o, F.col("me"))).alias("distance"), o.channel.alias("neighbour")))), 1, k)
    return g.select(*by, F.col("me.channel").alias("channel"), F.posexplode(near).alias("pos", "n")).select(
        *by, "channel", (F.col("pos") + 1).alias("rank"), "n.neighbour", "n.distance")


def stack_conditions(a: DataFrame, b: DataFrame, on: str, features: list[str],
                     names: tuple[str, str] = ("closed", "open")) -> DataFrame:
    """Two rows per subject present in both conditions, sharing `on`."""
    j = a.select(on, F.struct(*features).alias("__a")).join(b.select(on, F.struct(*features).alias("__b")), on)
    pair = record_array(["condition", "y", "f"], (names[0], 1, F.col("__a")), (names[1], 0, F.col("__b")))
    return j.select(on, F.explode(pair).alias("r")).select(on, "r.condition", "r.y", "r.f.*")


def optional_enrichment(subjects: list[DataFrame], tables: list[DataFrame], on: str = "subject") -> DataFrame:
    """Union of the subject lists, each feature table LEFT-joined; subjects
    with no row in any table are dropped."""
    base = reduce(lambda a, b: a.union(b), [s.select(on) for s in subjects]).distinct()
    out = base
    for i, t in enumerate(tables):
        out = out.join(t.withColumn(f"__has{i}", F.lit(True)), on, "left")
    any_row = reduce(lambda a, b: a | b, [F.col(f"__has{i}").isNotNull() for i in range(len(tables))])
    return out.where(any_row).drop(*[f"__has{i}" for i in range(len(tables))])


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row per key in a declared order, by map-side combined min_by
    rather than a sort of each key's rows."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(key, "__r.*")


def disjoint(train: DataFrame, test: DataFrame, on: list[str]) -> DataFrame:
    """One row: number of keys on both sides, and whether it is zero."""
    shared = train.select(*on).distinct().join(test.select(*on).distinct(), on, "left_semi")
    return shared.agg(F.count(F.lit(1)).alias("n_shared")).select("n_shared", (F.col("n_shared") == 0).alias("ok"))


def resolve_roles(df: DataFrame, roles: dict[str, str]) -> dict[str, str]:
    """Configured role -> column map, checked against the schema; an absent
    mapping or a stale column is an error, never a guess."""
    empty = [r for r, c in roles.items() if not c]
    if empty:
        raise ValueError(f"no resolved column for: {', '.join(empty)}")
    stale = [c for c in roles.values() if c not in df.columns]
    if stale:
        raise ValueError(f"mapped columns not present: {', '.join(stale)}")
    return dict(roles)


def identify_roles(df: DataFrame, patterns: dict[str, str]) -> dict[str, str | None]:
    """First column whose lower-cased name contains the pattern, per role."""
    return {r: next((c for c in df.columns if p in c.lower()), None) for r, p in patterns.items()}

