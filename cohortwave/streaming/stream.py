"""Structured Streaming forms. Stateless steps are the batch operators applied
to a stream; keyed state is used only where the next row decides."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as tx
from ..operators import cohort as co, models as md, quality as dq
from ..session import scratch_path


def drain(stream: DataFrame, name: str, path: str | None = None, mode: str = "append") -> DataFrame:
    """Run a stream over everything available into a Parquet folder and return
    it as a table. The checkpoint beside it makes a re-run continue."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)
    q = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/data")
         .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def continuous_qc(sidecars: DataFrame, limits: dict = dq.LIMITS) -> DataFrame:
    """New sidecar rows -> QC verdict rows; stateless, the checkpoint is the
    resume point."""
    return dq.classify(sidecars, limits)


def live_artifacts(samples: DataFrame, rec: list[str], ts: str, value: str, window: str, peak: float, delay: str) -> DataFrame:
    """Tumbling peak-to-peak rule on live samples; a window closes when the
    watermark passes it. min and max combine before the shuffle and the state
    of a window is two numbers."""
    g = samples.withWatermark(ts, delay).groupBy(*rec, F.window(ts, window).alias("w")).agg(F.max(value).alias("hi"), F.min(value).alias("lo"), F.count(F.lit(1)).alias("n"))
    return g.select(*rec, F.col("w.start").alias("start"), "n", (F.col("hi") - F.col("lo") > peak).alias("bad"))


def live_marker_gaps(ann: DataFrame, rec: str, code: int, min_gap_s: float) -> DataFrame:
    """Per recording, each marker `code` once its following annotation has
    arrived: (rec, onset_s, gap_s, kept). The state is one pending marker, so
    annotations of a recording must arrive in order across triggers."""
    d = ann.select(F.col(rec).cast("bigint").alias("rec"), "onset_s", "event_id", tx.marker_code(F.col("description")).alias("code"))
    out = T.StructType().add("rec", T.LongType()).add("event_id", T.LongType()).add("onset_s", T.DoubleType()).add("gap_s", T.DoubleType()).add("kept", T.BooleanType())
    state_t = T.StructType().add("onset", T.DoubleType()).add("event_id", T.LongType()).add("code", T.IntegerType())

    def step(key, pdfs, state: GroupState):
        new = pd.concat(list(pdfs)).sort_values(["onset_s", "event_id"])
        onset, ids = new["onset_s"].to_list(), new["event_id"].to_list()
        codes = [-1 if pd.isna(c) else int(c) for c in new["code"]]
        if state.exists:
            o, e, c = state.get
            onset, ids, codes = [o, *onset], [e, *ids], [c, *codes]
        rows = [(key[0], ids[i], onset[i], onset[i + 1] - onset[i], bool(onset[i + 1] - onset[i] >= min_gap_s)) for i in range(len(onset) - 1) if codes[i] == code]
        state.update((float(onset[-1]), int(ids[-1]), int(codes[-1])))
        yield pd.DataFrame(rows, columns=["rec", "event_id", "onset_s", "gap_s", "kept"])

    return d.groupBy("rec").applyInPandasWithState(step, out, state_t, "append", GroupStateTimeout.NoTimeout)


def live_boundaries(cross: DataFrame, rec: str, position: str, window: int = 5) -> DataFrame:
    """Phase-locked cycles as crossings arrive in order. The state holds the
    last boundary, the last `window` gaps and the crossings after it that do
    not yet decide the next one."""
    d = cross.select(F.col(rec).cast("bigint").alias("rec"), F.col(position).cast("bigint").alias("i"))
    out = T.StructType().add("rec", T.LongType()).add("start_i", T.LongType()).add("end_i", T.LongType())
    longs = T.ArrayType(T.LongType())
    state_t = T.StructType().add("t", T.LongType()).add("gaps", longs).add("ahead", longs)

    def step(key, pdfs, state: GroupState):
        new = np.unique(np.concatenate([p["i"].to_numpy() for p in pdfs]))
        t, gaps, ahead = state.get if state.exists else (None, [], [])
        seq = np.unique(np.concatenate([np.asarray(list(ahead), dtype=np.int64), new]))
        gaps = [int(g) for g in gaps]
        t = int(seq[0]) if t is None else int(t)
        rows = []
        while True:
            later = seq[seq > t]
            if not len(later):
                break
            target = t + (float(np.median(gaps[-window:])) if gaps else float(later[0] - t))
            if later[-1] < target:
                break                       # a later crossing may be nearer
            nxt = int(later[int(np.argmin(np.abs(later - target)))])
            rows.append((key[0], t, nxt))
            gaps = (gaps + [nxt - t])[-window:]
            t = nxt
        state.update((t, gaps, [int(v) for v in seq[seq > t]]))
        yield pd.DataFrame(rows, columns=["rec", "start_i", "end_i"])

    return d.groupBy("rec").applyInPandasWithState(step, out, state_t, "append", GroupStateTimeout.NoTimeout)


def quarantine(stream: DataFrame, bad: Column, root: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Split a stream into a good and a quarantine table. A re-run of a batch
    overwrites its own folder, so each row lands once."""
    spark = stream.sparkSession
    flagged = stream.withColumn("__bad", F.coalesce(bad, F.lit(True)))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for side, keep in (("good", ~F.col("__bad")), ("quarantine", F.col("__bad"))):
            batch.where(keep).drop("__bad").write.mode("overwrite").parquet(f"{root}/{name}/{side}/batch={batch_id}")
        batch.unpersist()

    q = flagged.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/{name}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    read = lambda side: spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{root}/{name}/{side}")
    return read("good"), read("quarantine")


def triplet_quarantine(headers: DataFrame, files: DataFrame, root: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Header stream checked against the static listing inside each batch."""
    spark = headers.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        st = co.triplet_status(batch, files)
        st.persist()
        for side, keep in (("good", F.col("status") == "ok"), ("quarantine", F.col("status") != "ok")):
            st.where(keep).write.mode("overwrite").parquet(f"{root}/{name}/{side}/batch={batch_id}")
        st.unpersist()

    q = headers.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/{name}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    read = lambda side: spark.read.option("recursiveFileLookup", True).parquet(f"{root}/{name}/{side}")
    return read("good"), read("quarantine")


def live_scoring(rows: DataFrame, model: DataFrame, features: list[str], ranges: DataFrame, metrics: list[str], keep: list[str]) -> DataFrame:
    return md.score(rows, model, features, ranges, metrics, keep)

