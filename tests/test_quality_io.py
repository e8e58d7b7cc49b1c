import json
import os

import pytest
from pyspark.sql import functions as F

from cohortwave.operators import cohort as co, quality as dq
from cohortwave.sources import sinks as sk, tables as tb
from cohortwave.streaming import stream as sm


def sidecar(**over):
    """A recording that passes, with the fields of `over` changed."""
    d = {"TaskName": "rest", "Duration": {"n_samples_final": 135000, "s": 540.0},
         "IAF": {"present": True, "peak_height_db": 6.2, "iaf_hz": 9.4}, "IAFWindow": {"tmin_s": 12.5, "tmax_s": 150.0, "method": "closed"},
         "ArtifactAnnotation": {"fraction": 0.11}, "LineNoiseRemoval": {"method": "comb"}, "LineNoisePower": {"after_index": 0.9, "before_index": 3.2},
         "ICA": {"labeling": "net", "n_components": 24, "excluded_components": [0, 3], "excluded_labels": ["heart beat", "eye blink"]},
         "BadChannels": {"occipital_bads": 1, "names": ["F7", "T8"], "n": 2}}
    for k, v in over.items():
        d[k] = {**d[k], **v} if isinstance(v, dict) else v
    return d


CASES = [
    (sidecar(Duration={"s": 210.0}), "fail", "truncated: 210s < 360s expected"),
    (sidecar(ICA={"excluded_components": list(range(3, 12))}), "warn", "38% ICA removed (> 25%)"),
    (sidecar(), "pass", ""),
    (sidecar(BadChannels={"n": 6}), "warn", "6 bad channels (> 4)"),
    (sidecar(BadChannels={"n": 11}), "fail", "11 bad channels (>= 8)"),
    (sidecar(BadChannels={"occipital_bads": 4}), "warn", "4 occipital bads (> 3)"),
    (sidecar(BadChannels={"occipital_bads": 7}), "fail", "7 occipital bads (>= 5)"),
    (sidecar(BadChannels={"n": 9}, ArtifactAnnotation={"fraction": 0.27}), "fail", "9 bad channels (>= 8);artifact 27% (> 20%)"),
    (sidecar(ArtifactAnnotation={"fraction": 0.55}), "fail", "artifact 55% (>= 40%)"),
    (sidecar(LineNoisePower={"before_index": 1.4, "after_index": 1.9}), "pass", ""),
    (sidecar(LineNoisePower={"after_index": 1.9}), "fail", f"{dq.LINE_TEXT[0]}1.9{dq.LINE_TEXT[1]}3.2{dq.LINE_TEXT[2]}"),
    (sidecar(TaskName="sternberg", IAF={"present": False}), "pass", ""),
    (sidecar(TaskName="task-rest", IAF={"present": False}), "fail", dq.ALPHA_TEXT),
    (sidecar(IAF={"present": False}, LineNoisePower={"after_index": 0.2}), "fail", dq.ALPHA_TEXT),
]


def test_sidecars_from_files(spark, tmp_path):
    for i, (doc, _, _) in enumerate(CASES):
        d = tmp_path / f"sub-{i:02d}" / "eeg"
        d.mkdir(parents=True)
        doc = {**doc, "ParticipantID": f"sub-{i:02d}"}
        (d / f"sub-{i:02d}_task-rest_desc-preproc_eeg.json").write_text(json.dumps(doc, indent=2))
        (d / "other.json").write_text("{}")
    docs = tb.read_sidecars(spark, str(tmp_path))
    qc = dq.classify(dq.flatten_sidecar(docs).withColumn("expected_s", F.lit(600.0)))
    got = {r["subject"]: (r["verdict"], r["flags"]) for r in qc.collect()}
    assert len(got) == len(CASES)
    for i, (_, verdict, flags) in enumerate(CASES):
        assert got[f"sub-{i:02d}"] == (verdict, flags)
    ex = {r["subject"] for r in dq.freeze_exclusions(qc, "r").collect()}
    assert ex == {f"sub-{i:02d}" for i, c in enumerate(CASES) if c[1] == "fail"}
    assert tb.required_window(docs).where("tmin_s = 12.5").count() == len(CASES)
    listing = tb.read_listing(spark, str(tmp_path))
    assert listing.where("rel_path like 'sub-%/eeg/%' and bytes > 0").count() == 2 * len(CASES)
    fp = tb.fingerprints(spark, str(tmp_path), "other.json").collect()
    assert {r["sha256"] for r in fp} == {"44136fa355b3678a1146ad16f7e8649e94fb4fc21fe77e8310c060f61caaff8a"}


def test_missing_window_fails(spark):
    d = spark.createDataFrame([(1, None)], "rec int, IAFWindow struct<tmin_s: double, tmax_s: double>")
    with pytest.raises(Exception, match="without IAFWindow"):
        tb.required_window(d).collect()


def test_reconcile_and_flags(spark):
    p = spark.createDataFrame([("1", "3/3", "AG"), ("2", "3/4", "GG"), ("3", "3/3", "AA"), ("4", "NA", "AA")], "id string, apoe string, snp string")
    c = spark.createDataFrame([("sub-01", "N"), ("sub-02", "N"), ("sub-04", "N"), ("sub-09", "N")], "subject string, grp string")
    r = co.reconcile(p, c, "id", "apoe", "snp")
    got = {x["subject"]: x["status"] for x in r.collect()}
    assert got == {"sub-01": "RECONCILED", "sub-02": "MISMATCH", "sub-03": "GENETIC_COHORT_ONLY", "sub-04": "MISMATCH", "sub-09": "MISSING_FROM_TSV"}
    assert co.stop_gate(r).first()["verdict"] == "STOP"
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "subject string")
    f = {x["subject"]: x["final_include"] for x in co.cohort_flags(ids("sub-01", "sub-99"), ids("sub-01", "sub-150"), ids("sub-01", "sub-77")).collect()}
    assert f == {"sub-01": True, "sub-99": False, "sub-150": False}


def test_triplets(spark):
    """Each stem: what its header names, which files lie beside it, and what comes out."""
    long, short = "sub-{}_task-msit_eeg", "w{}"
    cases = {
        long.format(61): ((long.format(61) + ".eeg", long.format(61) + ".vmrk"), (9, long.format(61) + ".eeg"), ("ok", False)),
        long.format(62): (("before-renaming.eeg", "before-renaming.vmrk"), (9, "before-renaming.eeg"), ("ok", True)),
        long.format(63): (("someone-else.eeg", "someone-else.vmrk"), (9, long.format(63) + ".eeg"), ("orphaned_header", None)),
        long.format(64): (("sub-64_task-mst_eeg.eeg", long.format(64) + "..vmrk"), (9, long.format(64) + ".eeg"), ("ok", True)),
        long.format(65): (("sub-65_task-mst_eeg.eeg", "elsewhere.vmrk"), (9, "?"), ("orphaned_header", None)),
        short.format(1): (("w1.eeg", "w1.vmrk"), (None, ""), ("orphaned_header", None)),
        short.format(2): (("w2.eeg", "w2.vmrk"), (9, None), ("missing_marker_file", None)),
        short.format(3): (("w3.eeg", "w3.vmrk"), (0, ""), ("zero_byte_data", None)),
        short.format(4): ((None, "w4.vmrk"), (None, None), ("no_datafile_field", None)),
    }
    heads, files = [], []
    for stem, ((data, marker), (size, names), _) in cases.items():
        heads.append(("rec", stem, "".join([f"DataFile={data}\n" if data else "", f"MarkerFile={marker}\n"])))
        if size is not None:
            files.append((f"rec/{stem}.eeg", size, None))
        if names is not None:
            files.append((f"rec/{stem}.vmrk", 7, f"DataFile={names}"))
    r = co.triplet_status(spark.createDataFrame(heads, "dir string, stem string, vhdr_text string"), spark.createDataFrame(files, "path string, bytes long, head string"))
    got = {x["stem"]: (x["status"], x["header_discrepancy"]) for x in r.collect()}
    for stem, (_, _, (status, differs)) in cases.items():
        assert got[stem][0] == status and differs in (None, got[stem][1]), stem


def test_assemble(spark):
    a = spark.createDataFrame([("01", 1.0), ("02", 2.0)], "subject string, v double")
    b = spark.createDataFrame([("01", 5.0)], "subject string, v double")
    lab = spark.createDataFrame([("01", 1)], "subject string, y int")
    nui = spark.createDataFrame([("02", 40)], "subject string, age int")
    r = co.assemble({"a": a, "b": b}, lab, nui).collect()
    assert len(r) == 1 and r[0].asDict() == {"subject": "01", "v": 1.0, "v_b": 5.0, "age": None, "y": 1}
    with pytest.raises(Exception, match="no task"):
        co.require_tasks(co.parse_listing(spark.createDataFrame([("participants.tsv", 5)], "rel_path string, bytes long"))).collect()
    with pytest.raises(ValueError, match="not present"):
        co.resolve_roles(a, {"x": "gone"})


def test_sinks(spark, tmp_path):
    root = str(tmp_path / "pub")
    sk.publish(spark.range(3), root, "t", "r1")
    with pytest.raises(FileExistsError):
        sk.publish(spark.range(4), root, "t", "r2")
    assert sk.read_current(spark, root, "t").count() == 3
    sk.publish(spark.range(4), root, "t", "r2", allow_overwrite=True)
    assert sk.read_current(spark, root, "t").count() == 4 and sk.read_current(spark, root, "t", 1).count() == 3
    with pytest.raises(PermissionError):
        sk.resolve_target("/live", None, None, True)
    assert sk.resolve_target("/live", "/tmp/x", None, True) == "/tmp/x" and sk.resolve_target("/live", None, "r", True) == "/live"
    log = str(tmp_path / "log")
    e = spark.createDataFrame([("p", 60, "ok", "r")], sk.LOG_DDL)
    assert sk.append_log(e, log, 100) == 60
    with pytest.raises(ValueError, match="budget"):
        sk.append_log(e, log, 100)
    with pytest.raises(ValueError, match="label"):
        sk.write_table(spark.createDataFrame([(1, 1)], "s int, risk_vs_none int"), str(tmp_path / "f"), "r", features=True)


def test_escalation(spark):
    qc = spark.createDataFrame([(f"s{i}", "rest", i >= 30, 2.0, "pass", 0, 0, "") for i in range(80)], "subject string, task string, alpha_present boolean, alpha_peak_height_db double, verdict string, n_bad_channels int, occipital_bads int, flags string")
    ex = spark.createDataFrame([(f"s{i}",) for i in range(6)], "subject string")
    g = spark.createDataFrame([(f"s{i}", "N") for i in range(80)], "subject string, grp string")
    r = dq.escalation(qc, ex, g).first()
    assert r["verdict"] == "ESCALATE" and r["n_borderline"] == 30
    assert "6 subjects excluded" in r["messages"] and "one group (100%)" in r["messages"] and "30 rest subjects" in r["messages"]


def test_streams_over_several_files(spark, tmp_path):
    """State carries over triggers; a second run continues from the checkpoint."""
    import time
    ann = tmp_path / "ann"
    ann.mkdir()
    schema = "rec long, event_id long, onset_s double, description string"
    parts = [[(1, 0, 1.0, "S  4"), (1, 1, 4.5, "S 11"), (2, 0, 3.0, "S  4")], [(1, 2, 10.0, "S  4"), (2, 1, 9.0, "S 10")], [(1, 3, 11.0, "S 11")]]
    for i, rows in enumerate(parts):
        with open(ann / f"{i}.json", "w") as fh:
            fh.writelines(json.dumps(dict(zip(["rec", "event_id", "onset_s", "description"], r))) + "\n" for r in rows)
        os.utime(ann / f"{i}.json", (time.time() - 100 + i,) * 2)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(ann))
    out = sm.drain(sm.live_marker_gaps(s, "rec", 4, 3.0), "g", str(tmp_path / "out"))
    assert sorted((r["rec"], r["onset_s"], r["kept"]) for r in out.collect()) == [(1, 1.0, True), (1, 10.0, False), (2, 3.0, True)]


def test_live_boundaries_equal_batch(spark, tmp_path):
    import time
    import numpy as np
    from tests.test_signal import sequential
    r = np.random.default_rng(3)
    cross = np.unique(np.cumsum(r.integers(20, 80, 400)))
    d = tmp_path / "c"
    d.mkdir()
    for i, chunk in enumerate(np.array_split(cross, 4)):
        (d / f"{i}.json").write_text("".join(json.dumps({"rec": 1, "i": int(v)}) + "\n" for v in chunk))
        os.utime(d / f"{i}.json", (time.time() - 100 + i,) * 2)
    s = spark.readStream.schema("rec long, i long").option("maxFilesPerTrigger", 1).json(str(d))
    got = sm.drain(sm.live_boundaries(s, "rec", "i"), "b", str(tmp_path / "o")).toPandas().sort_values("start_i")
    want = sequential(cross)
    pairs = list(zip(want[:-1], want[1:]))
    assert list(zip(got.start_i, got.end_i)) == pairs[:len(got)] and len(got) >= len(pairs) - 1


def test_a_version_has_one_writer_and_a_broken_manifest_is_an_error(spark, tmp_path):
    from cohortwave.sources import sinks as sk
    df = spark.range(3)
    root = str(tmp_path / "out")
    sk._claim(spark, f"{root}/_claims/t-version=1", "other")           # another run is at it
    with pytest.raises(FileExistsError):
        sk.publish(df, root, "t", "mine")
    assert sk.latest(spark, root, "t") is None
    (tmp_path / "bad" / "_published").mkdir(parents=True)
    (tmp_path / "bad" / "_published" / "part-0.parquet").write_bytes(b"not a table")
    with pytest.raises(Exception):
        sk.publish(df, str(tmp_path / "bad"), "t", "mine")
    log = spark.createDataFrame([("a", 5, "ok", "r")], sk.LOG_DDL)
    assert sk.append_log(log, f"{root}/log", 10) == 5
    sk._claim(spark, f"{root}/log_claims/after-1", "other")
    with pytest.raises(FileExistsError):
        sk.append_log(log, f"{root}/log", 100)
