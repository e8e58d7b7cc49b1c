"""Operators over annotations: gaps, marker windows, event-locked epochs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.ordered import neighbour


def gap_to_next(ann: DataFrame, keys: list[str], bucket_s: float = 3600.0, onset: str = "onset_s", tie: str = "event_id") -> DataFrame:
    """Seconds to the next annotation of any type (NULL on the last)."""
    d = neighbour(ann, keys, [onset, tie], {onset: "next_onset"}, F.floor(F.col(onset) / bucket_s), 1)
    return d.withColumn("gap_s", F.col("next_onset") - F.col(onset))


def marker_onsets(ann: DataFrame, keys: list[str], code: int, min_gap_s: float, bucket_s: float = 3600.0) -> DataFrame:
    """Rows of marker `code` with `kept`: the gap to the following annotation
    of any type is at least min_gap_s. The gap is taken before the code filter."""
    d = gap_to_next(ann, keys, bucket_s).where(tx.marker_code(F.col("description")) == code)
    return d.withColumn("kept", F.coalesce(F.col("gap_s") >= min_gap_s, F.lit(False)))


def marker_counts(onsets: DataFrame, keys: list[str]) -> DataFrame:
    return onsets.groupBy(*keys).agg(F.count_if("kept").alias("n_used"), F.count_if(~F.col("kept")).alias("n_skipped"))


def closed_window(ann: DataFrame, keys: list[str], tmax: DataFrame, max_gap_s: float = 60.0, min_len_s: float = 120.0,
                  order: tuple[str, str] = ("onset_s", "event_id")) -> DataFrame:
    """Block between the first 'S 10' (or the first 'S  1' soon after it) and
    the first later 'S 11'. Each step is a min over matching events, so nothing
    is sorted; the two look-back joins carry one row per recording."""
    key = F.struct(*order)
    ev = ann.select(*keys, key.alias("at"), tx.marker_label(F.col("description")).alias("label")).where(
        F.col("label").isin("S 10", "S  1", "S 11"))
    first = ev.where("label = 'S 10'").groupBy(*keys).agg(F.min("at").alias("a10"))
    later = ev.join(first, keys).where(F.col("at") > F.col("a10"))
    s1 = later.where("label = 'S  1'").groupBy(*keys).agg(F.min("at").alias("a1"))
    start = first.join(s1, keys, "left").select(*keys, "a10", F.when(
        F.col("a1")[order[0]] - F.col("a10")[order[0]] <= max_gap_s, F.col("a1")[order[0]]).otherwise(F.col("a10")[order[0]]).alias("start_s"))
    end = (ev.where("label = 'S 11'").join(start, keys)
           .where((F.col("at") > F.col("a10")) & (F.col("at")[order[0]] > F.col("start_s")))
           .groupBy(*keys).agg(F.min("at").alias("a11")))
    w = start.join(end, keys, "left").join(tmax, keys).select(
        *keys, "start_s", F.coalesce(F.col("a11")[order[0]], F.col("tmax")).alias("end_s"))
    return w.where(F.col("end_s") - F.col("start_s") >= min_len_s)


def open_window(ann: DataFrame, keys: list[str], min_len_s: float = 60.0) -> DataFrame:
    """Leading block [0, first 'S 10')."""
    return (ann.where(tx.marker_label(F.col("description")) == "S 10").groupBy(*keys).agg(F.min("onset_s").alias("end_s"))
            .where(F.col("end_s") >= min_len_s).select(*keys, F.lit(0.0).alias("start_s"), "end_s"))


def excerpt_choice(recordings: DataFrame, windows: DataFrame, keys: list[str], required: Column, default_s: float = 120.0) -> DataFrame:
    """The marker window when the task requires it and one resolves, else the
    leading default_s seconds; the method is recorded. Needs `tmax`."""
    j = recordings.join(windows, keys, "left")
    use = required & F.col("start_s").isNotNull()
    return j.select(*keys, F.when(use, "eyes_closed").otherwise("blind_crop").alias("method"),
                    F.round(F.when(use, F.col("start_s")).otherwise(F.lit(0.0)), 2).alias("tmin_s"),
                    F.round(F.when(use, F.least("end_s", "tmax")).otherwise(F.least(F.lit(default_s), F.col("tmax"))), 2).alias("tmax_s"))


def epochs(onsets: DataFrame, blocks: DataFrame, keys: list[str], sfreq: float, n_samples: int, block_len: int,
           epoch_id: str = "event_id", channel: str = "channel") -> DataFrame:
    """Samples [round(onset*sfreq), +n_samples) of every channel per event;
    epochs past the end of the signal are dropped. An epoch is expanded to the
    block numbers it touches, so the join is an equi-join on (recording,
    block) and only the touched slices are shuffled afterwards."""
    e = onsets.select(*keys, F.col(epoch_id), F.rint(F.col("onset_s") * sfreq).cast("bigint").alias("s0"))
    e = e.withColumn("block_id", F.explode(F.sequence(
        F.floor(F.col("s0") / block_len), F.floor((F.col("s0") + n_samples - 1) / block_len))))
    j = e.join(blocks, [*keys, "block_id"])
    base = F.col("block_id") * block_len
    lo = F.greatest(F.col("s0") - base, F.lit(0))
    hi = F.least(F.col("s0") + n_samples - base, F.size("samples").cast("bigint"))
    part = F.slice("samples", (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))
    g = j.groupBy(*keys, epoch_id, channel, "s0").agg(F.array_sort(F.collect_list(F.struct("block_id", part.alias("p")))).alias("ps"))
    return (g.select(*keys, epoch_id, channel, "s0", F.flatten(F.transform("ps", lambda x: x.p)).alias("samples"))
            .where(F.size("samples") == n_samples))
