"""Keyed streams in event time: rows may come late and out of order, and the last
one of a key is handed on as well.

A processor keeps the rows of a key in list state until the watermark has passed
them, so that their order is final, and a timer brings it back then. `open_s`
after its last row a key is closed: what still waits for a successor is emitted
as the batch rule treats the end of a recording, and the state is removed.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as tx
from ..session import scratch_path
from .stream import drain

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Key of the row that ends a finite stream; it has no state.
END_KEY = -(1 << 63)


class _Ordered(StatefulProcessor):
    """Rows (at in microseconds, a double, two longs) of a key, decided once the watermark has passed them."""

    def __init__(self, open_s: float):
        self.open_us = int(open_s * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "at long, x double, a long, b long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] == END_KEY:
            return
        latest = None
        for pdf in rows:                      # a batch at a time goes to the state
            if len(pdf):
                self.rows.appendList(list(zip(pdf["at"].tolist(), pdf["x"].astype(float).tolist(), pdf["a"].tolist(), pdf["b"].tolist())))
                latest = max(int(pdf["at"].max()), latest or 0)
        if latest is not None:
            self.handle.registerTimer(-(-latest // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(r) for r in self.rows.get())
        if not held:
            return
        known = sum(r[0] <= passed for r in held)
        closing = known == len(held) and passed >= held[-1][0] + self.open_us
        out, first = self.decide(key[0], held[:known], closing)
        self.rows.clear()
        if not closing:
            keep = held[first:]
            self.rows.appendList(keep)
            # the next unknown row's time, else the end of the wait
            later = keep[-1][0] if known < len(held) else keep[-1][0] + self.open_us
            self.handle.registerTimer(max(-(-later // 1000), passed // 1000 + 1))
        if len(out):
            yield out

    def close(self) -> None:
        pass


class _Gaps(_Ordered):
    """x onset, a event number, b marker code."""

    def __init__(self, open_s: float, code: int, min_gap_s: float):
        super().__init__(open_s)
        self.code, self.min_gap_s = code, min_gap_s

    def decide(self, key, rows, closing):
        rows = sorted(rows, key=lambda r: (r[1], r[2]))
        nxt = [r[1] for r in rows[1:]] + [None]
        n = len(rows) if closing else len(rows) - 1
        out = [(key, r[2], r[1], None if t is None else t - r[1], t is not None and t - r[1] >= self.min_gap_s) for r, t in zip(rows[:n], nxt) if r[3] == self.code]
        frame = pd.DataFrame(out, columns=["rec", "event_id", "onset_s", "gap_s", "kept"])
        return frame.astype({"gap_s": "float64", "kept": "bool"}), max(0, n)


class _Boundaries(_Ordered):
    """a position of a crossing; the last boundary and the gaps before it are a value beside the rows."""

    def __init__(self, open_s: float, window: int):
        super().__init__(open_s)
        self.window = window

    def init(self, handle):
        super().init(handle)
        self.at = handle.getValueState("last", "t long, gaps array<long>")

    def decide(self, key, rows, closing):
        seq = np.unique([r[2] for r in rows])
        last = self.at.get()
        t, gaps = (int(last[0]), [int(g) for g in last[1]]) if last is not None else (int(seq[0]) if len(seq) else None, [])
        out = []
        while t is not None and len(later := seq[seq > t]):
            target = t + (float(np.median(gaps[-self.window:])) if gaps else float(later[0] - t))
            if later[-1] < target and not closing:
                break                         # a crossing to come may be nearer
            nxt = int(later[int(np.argmin(np.abs(later - target)))])
            out.append((key, t, nxt))
            gaps, t = (gaps + [nxt - t])[-self.window:], nxt
        if closing:
            self.at.clear()
        elif t is not None:
            self.at.update((t, gaps))
        first = next((i for i, r in enumerate(rows) if t is None or r[2] > t), len(rows))
        return pd.DataFrame(out, columns=["rec", "start_i", "end_i"]), min(first, max(0, len(rows) - 1))


def timed_marker_gaps(ann: DataFrame, rec: str, ts: str, code: int, min_gap_s: float, delay: str, open_s: float) -> DataFrame:
    """Every marker `code` of a recording with the gap to the annotation that follows it; NULL and not kept for the last."""
    d = ann.select(F.col(rec).cast("bigint").alias("rec"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("at"), F.col("onset_s").cast("double").alias("x"),
                   F.col("event_id").cast("long").alias("a"), F.coalesce(tx.marker_code(F.col("description")), F.lit(-1)).cast("long").alias("b"))
    return d.withWatermark("ts", delay).groupBy("rec").transformWithStateInPandas(
        _Gaps(open_s, code, min_gap_s), "rec long, event_id long, onset_s double, gap_s double, kept boolean", "Append", "EventTime")


def timed_boundaries(cross: DataFrame, rec: str, ts: str, position: str, delay: str, open_s: float, window: int = 5) -> DataFrame:
    """Phase-locked cycles of crossings that come late or out of order, up to the last one. Positions follow the times."""
    d = cross.select(F.col(rec).cast("bigint").alias("rec"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("at"), F.lit(0.0).alias("x"),
                     F.col(position).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    return d.withWatermark("ts", delay).groupBy("rec").transformWithStateInPandas(
        _Boundaries(open_s, window), "rec long, start_i long, end_i long", "Append", "EventTime")


@contextmanager
def rocks(spark: SparkSession):
    before = spark.conf.get(ROCKS[0], None)
    spark.conf.set(*ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(ROCKS[0]) if before is None else spark.conf.set(ROCKS[0], before)


def drain_to_end(source: Callable[[], DataFrame], build: Callable[[DataFrame], DataFrame], rec: str, ts: str, name: str, end: Column | None = None) -> DataFrame:
    """A finite stream to its end: all there is, then one row at a far time under a key of its own, which moves the
    watermark past every timer. Both runs share one checkpoint, so a stopped one goes on where it was."""
    first = source()
    spark = first.sparkSession
    path, ends = scratch_path(spark, name), scratch_path(spark, f"{name}-end")
    spark.createDataFrame([], first.schema).write.parquet(ends)
    whole = lambda s: build(s.unionByName(spark.readStream.schema(s.schema).parquet(ends)))
    with rocks(spark):
        drain(whole(first), name, path)
        types = dict(first.dtypes)
        row = [F.lit(None).cast(types[c]).alias(c) for c in first.columns if c not in (rec, ts)]
        last = F.lit("2200-01-01").cast("timestamp") if end is None else end
        spark.range(1).select(F.lit(END_KEY).cast(types[rec]).alias(rec), last.cast(types[ts]).alias(ts), *row).write.mode("append").parquet(ends)
        return drain(whole(source()), name, path)
