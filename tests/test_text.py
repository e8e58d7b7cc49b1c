import pytest
from pyspark.sql import functions as F

from cohortwave.functions import formulas as fm, text as tx


def one(spark, values, fn, ty="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ty}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_entities(spark):
    names = ["x/sub-q9_task-walk_meg.bin", "sub-ab_run-07_dir-LR_task-eat_map.json.gz", "readme.md", "sub-_task-run_-z.txt", "task-one_task-two.dat", ""]
    got = one(spark, names, tx.name_entities)
    assert got == [{"sub": "q9", "task": "walk"}, {"sub": "ab", "run": "07", "dir": "LR", "task": "eat"}, {}, {"task": "run"}, {"task": "two"}, {}]
    assert one(spark, names, lambda c: tx.name_entity(c, "task")) == ["walk", "eat", None, "run", "two", None]
    assert one(spark, names, tx.file_extension)[:3] == [".bin", ".json.gz", ".md"]
    assert one(spark, names, tx.name_suffix)[:2] == ["meg", "map"]


def test_alleles_follow_the_grammar(spark):
    """Every pair of 2..4 in each accepted spelling, generated, not listed."""
    pairs = [(a, b) for a in (2, 3, 4) for b in (2, 3, 4)]
    spell = ["{}/{}", "{}{}", "E{}/e{}", "e{}E{}", " {}-{}", "{}_{} ", "{} {}", "0{}/00{}"]
    got = one(spark, [s.format(a, b) for s in spell for a, b in pairs], tx.allele_pair)
    assert [(r["a1"], r["a2"]) for r in got] == pairs * len(spell) and all(r["error"] is None for r in got)


def test_unreadable_alleles_give_an_error(spark):
    bad = [None, "\t", "7/7", "3//4", "e5e5", "three", "3/4/4", "9", "+3/4"]
    for r in one(spark, bad, tx.allele_pair):
        assert r["a1"] is None and r["a2"] is None and r["error"]


def test_snp(spark):
    got = [r["value"] for r in one(spark, ["GA", "ag", "G/A ", "g/a", "GG", "A/A", "T/?", None], tx.snp_pair)]
    assert got == ["AG", "AG", "AG", None, "GG", "AA", None, None]


def test_groups(spark):
    df = spark.createDataFrame([("3/3", "AG"), ("3/4", "AA"), ("4/4", "GG"), ("3/3", "GG"), ("2/3", "AA"), ("NA", "AA")], "a string, p string")
    got = [r[0] for r in df.select(tx.derived_group(tx.allele_pair(F.col("a")), tx.snp_pair(F.col("p")))).collect()]
    assert got == ["N", "A_P_minus", "A_P_plus", "UNRESOLVABLE", "UNRESOLVABLE", "UNRESOLVABLE"]


def test_ids_zones_markers(spark):
    assert one(spark, ["7", "007", "P12x", "sub-3", "none", " 150"], tx.subject_id) == ["sub-07", "sub-07", "sub-12", "sub-3", "none", "sub-150"]
    long = ["P1234567890123456789x", "12345678901234567890", "0012345678901234567890", "-7", "+5", "-12", "a0b", "000"]
    assert one(spark, long, tx.subject_id) == ["sub-1234567890123456789", "sub-12345678901234567890", "sub-12345678901234567890", "sub--7", "sub-05", "sub--12", "sub-00", "sub-00"]
    zones = one(spark, ["Fp1", "FC1", "Fz", "FT7", "TP9", "Cz", "POz", "Iz", "F", "X3", "Fpx"], tx.channel_zone)
    assert zones == ["frontal", "central", "frontal", "temporal", "temporal", "central", "parietal", "occipital", "frontal", None, None]
    assert one(spark, ["Stimulus/S  4", "S 12", "Comment/x", "S 4 x"], tx.marker_code) == [4, 12, None, None]


def test_formulas(spark):
    assert one(spark, [10.0, 10.3, 12.5, 0.0], lambda c: fm.harmonic_collision(c), "double") == [True, False, False, False]
    assert one(spark, [10.0, 12.5, 9.1, 11.2], lambda c: fm.nearest_harmonic(c), "double") == [5, 4, 5, 4]
    se = one(spark, [0.693], lambda c: fm.auc_standard_error(c, F.lit(34), F.lit(30)), "double")[0]
    assert abs(se - 0.0658) < 1e-3
