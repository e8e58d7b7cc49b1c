"""Keyed streams in event time: late and unordered rows, timers, and the last row of a key."""
import json
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwave.streaming import stream as sm, timed as tm

BASE = 1_700_000_000.0


def files(folder, parts, names):
    folder.mkdir()
    for i, rows in enumerate(parts):
        (folder / f"{i:02d}.json").write_text("".join(json.dumps(dict(zip(names, r))) + "\n" for r in rows))
        os.utime(folder / f"{i:02d}.json", (time.time() - 100 + i,) * 2)


def source(spark, folder, schema, second):
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    return s.withColumn("ts", F.timestamp_micros((F.lit(BASE * 1e6) + F.col(second) * 1e6).cast("long")))


def test_gaps_equal_the_batch_rule_over_late_rows(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for rec in range(5):
        t = 0.0
        for k in range(rng.randint(1, 40)):
            t += rng.choice([.25, 1, 2.5, 7])
            rows.append((rec, rec * 1000 + k, t, rng.choice(["S  4", "S 11", "note"])))
    # every row comes within 20 s of its time
    rows.sort(key=lambda r: r[2] + rng.uniform(0, 15))
    parts = [rows[i:i + 17] for i in range(0, len(rows), 17)]
    names = ["rec", "event_id", "onset_s", "description"]
    files(tmp_path / "a", parts, names)
    schema = "rec long, event_id long, onset_s double, description string"
    got = tm.drain_to_end(lambda: source(spark, tmp_path / "a", schema, "onset_s"),
                          lambda s: tm.timed_marker_gaps(s, "rec", "ts", 4, 2.0, "20 seconds", 86400.0), "rec", "ts", "gaps").collect()
    want = []
    for rec in range(5):
        own = sorted((r[2], r[1], r[3]) for r in rows if r[0] == rec)
        for a, b in zip(own, own[1:] + [None]):
            if a[2] == "S  4":
                want.append((rec, a[1], a[0], None if b is None else b[0] - a[0], b is not None and b[0] - a[0] >= 2.0))
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_a_silent_key_is_closed_while_others_go_on(spark, tmp_path):
    """Without an end row: only what the watermark has passed comes out, and a key is closed after `open_s`."""
    parts = [[(1, 0, 0.0, "S  4"), (2, 1, 1.0, "S  4")], [(2, 2, 5.0, "S  4")], [(2, 3, 200.0, "note"), (2, 4, 300.0, "note")], [(2, 5, 301.0, "note")]]
    files(tmp_path / "a", parts, ["rec", "event_id", "onset_s", "description"])
    s = source(spark, tmp_path / "a", "rec long, event_id long, onset_s double, description string", "onset_s")
    with tm.rocks(spark):
        out = sm.drain(tm.timed_marker_gaps(s, "rec", "ts", 4, 3.0, "10 seconds", 60.0), "x", str(tmp_path / "o"))
    got = {r.event_id: r for r in out.collect()}
    assert got[0].gap_s is None and not got[0].kept and got[1].gap_s == 4.0 and got[1].kept
    assert got[2].gap_s in (195.0, None) and set(got) == {0, 1, 2}


@pytest.mark.parametrize("per_file", [60, 1000])
def test_boundaries_equal_the_sequential_scan(spark, tmp_path, per_file):
    from tests.test_signal import sequential
    rng = np.random.default_rng(per_file)
    cross = {rec: np.unique(np.cumsum(rng.integers(20, 80, 150))) for rec in (1, 2)}
    rows = [(rec, int(v), float(v) / 100) for rec, c in cross.items() for v in c]
    rows.sort(key=lambda r: r[2] + rng.uniform(0, 1.5))
    files(tmp_path / "c", [rows[i:i + per_file] for i in range(0, len(rows), per_file)], ["rec", "i", "s"])
    got = tm.drain_to_end(lambda: source(spark, tmp_path / "c", "rec long, i long, s double", "s"),
                          lambda s: tm.timed_boundaries(s, "rec", "ts", "i", "2 seconds", 3600.0), "rec", "ts", "bounds").collect()
    for rec, c in cross.items():
        want = sequential(c)
        assert sorted((r.start_i, r.end_i) for r in got if r.rec == rec) == list(zip(want[:-1], want[1:]))
