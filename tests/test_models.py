import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwave.operators import aggregates as ag, crossval as cv, models as md, quality as dq, stattests as st


def xy(spark, n=64, shift=2.5, seed=0, p=6, name="a"):
    r = np.random.default_rng(seed)
    y = np.arange(n) % 2
    x = r.normal(size=(n, p))
    x[:, 0] += shift * y
    x[3, 2] = np.nan
    return spark.createDataFrame([(name, str(i), str(i), int(y[i]), [float(v) for v in x[i]]) for i in range(n)],
                                 "analysis string, row_id string, grp string, y int, x array<double>")


def test_nested_cv(spark):
    d = xy(spark).unionByName(xy(spark, shift=0.0, name="null"))
    pred, fits = cv.nested_cv(d, ["analysis"], n_repeats=3, c_grid=[0.01, 1.0, 10.0])
    cover = pred.groupBy("analysis", "rep", "row_id").count().agg(F.min("count"), F.max("count")).first()
    assert tuple(cover) == (1, 1)
    a = {r["analysis"]: r["auc"] for r in cv.pooled_auc(pred, ["analysis"]).collect()}
    assert a["a"] > 0.75 and 0.2 < a["null"] < 0.7
    again = cv.nested_cv(d.repartition(11), ["analysis"], n_repeats=3, c_grid=[0.01, 1.0, 10.0])[0]
    assert pred.exceptAll(again).count() == 0
    assert fits.count() == 2 * 3 * 5


def test_folds_in_task_equal_folds_on_spark(spark):
    d = xy(spark).withColumn("grp", F.concat(F.lit("g"), (F.col("row_id").cast("int") / 4).cast("int").cast("string")))
    pred, _ = cv.nested_cv(d, ["analysis"], n_repeats=2, c_grid=[1.0])
    f = cv.group_folds(d, ["analysis"], "grp", "y", 5, 20260810, 2)
    j = pred.join(d.select("row_id", "grp"), "row_id").join(f.withColumnRenamed("fold", "f2"), ["analysis", "rep", "grp"])
    assert j.count() == 128 and j.where("fold <> f2").count() == 0
    leak = cv.fold_leakage(f, d, ["analysis"], "grp")
    assert leak.where("not ok").count() == 0


def test_distributed_layout_gives_the_same_predictions(spark):
    d = xy(spark, n=48, p=3)
    small, f1 = cv.nested_cv(d, ["analysis"], n_splits=3, c_grid=[0.1, 1.0])
    big, f2 = cv.nested_cv(d, ["analysis"], n_splits=3, c_grid=[0.1, 1.0], max_cells=1)
    j = small.join(big.select("row_id", "rep", F.col("proba").alias("p2"), F.col("fold").alias("f2")), ["row_id", "rep"])
    worst = j.agg(F.max(F.abs(F.col("proba") - F.col("p2"))), F.count_if(F.col("fold") != F.col("f2"))).first()
    assert worst[0] < 1e-7 and worst[1] == 0


def test_fit_is_the_ridge_optimum():
    r = np.random.default_rng(0)
    x, y = r.normal(size=(80, 4)), (r.random(80) < 0.4).astype(float)
    for c in (0.01, 1.0, 100.0):
        b = cv._fit(x, y, np.array([c]))[0]
        mu = 1 / (1 + np.exp(-(b[0] + x @ b[1:])))
        assert abs((mu - y).sum()) < 1e-6
        assert np.abs(x.T @ (mu - y) + b[1:] / c).max() < 1e-6


def test_run_analyses(spark):
    out = md.run_analyses(xy(spark), n_repeats=2, n_permutations=19, n_bootstrap=12, c_grid=[0.1, 1.0])
    m = out["metrics"].first()
    assert m["auc"] > 0.75 and m["p_value"] == 0.05 and m["ci_low"] <= m["ci_high"] <= 1
    assert out["predictions"].count() == 64 and out["nulls"].count() == 19
    s = ag.feature_stability(out["fits"].withColumn("names", F.array(*[F.lit(f"f{i}") for i in range(6)])), ["analysis"])
    assert s.where("feature = 'f0' and stable and sign_consistency = 1.0").count() == 1


def test_stability_by_hand(spark):
    d = spark.createDataFrame([("a", ["u", "v"], [1.0, 0.0]), ("a", ["u", "v"], [2.0, -1.0]), ("a", ["u", "v"], [-1.0, 0.0]), ("a", ["u", "v"], [0.0, 0.0])], "k string, names array<string>, coef array<double>")
    r = {x["feature"]: x for x in ag.feature_stability(d, ["k"]).collect()}
    assert r["u"]["selection_frequency"] == 0.75 and abs(r["u"]["sign_consistency"] - 2 / 3) < 1e-12
    assert r["v"]["selection_frequency"] == 0.25 and not r["v"]["stable"]


def test_qc_gate_finds_a_proxy(spark):
    g = md.qc_gate(xy(spark, shift=8.0), n_repeats=1, n_permutations=19, n_bootstrap=10)
    r = g.withColumn("v", md.contamination_verdict(F.col("auc"))).first()
    assert r["v"] == "escalate" and r["p_value"] == 0.05


def test_selection_and_svm(spark):
    p = cv.simple_cv(xy(spark, shift=4.0), ["analysis"], select=True)
    assert p.agg(F.min("n_selected")).first()[0] >= 1 and cv.fold_auc(p, ["analysis"]).first()["auc"] > 0.9
    assert cv.fold_auc(cv.simple_cv(xy(spark, shift=4.0), ["analysis"], model="svm"), ["analysis"]).first()["auc"] > 0.9


def test_final_model_and_refusal(spark):
    feats = [f"f{i}" for i in range(3)]
    d = xy(spark, n=60, p=3)
    model = md.train_final(d, feats, c_grid=[0.1, 1.0])
    m = model.first()
    assert len(m["parts"]) == 5 and m["features"] == feats
    new = spark.createDataFrame([(1, 3.0, 0.0, 0.0, 5), (2, -1.0, 0.0, 0.0, 15), (3, -1.0, 0.0, None, 5)], "id int, f0 double, f1 double, f2 double, n_bad_channels int")
    ranges = spark.createDataFrame([("n_bad_channels", 0.0, 10.0)], "metric string, lo double, hi double")
    got = {r["id"]: r for r in md.score(new.select("id", "f2", "f1", "f0", "n_bad_channels"), model, feats, ranges, ["n_bad_channels"], ["id"]).collect()}
    assert got[2]["status"] == "cannot_score" and got[2]["probability"] is None
    assert got[2]["reason"] == "n_bad_channels=15.0 outside training range [0.0, 10.0]"
    assert got[1]["probability"] > 0.7 > 0.3 > got[3]["probability"] and got[1]["actionable"] is False


def test_control_guards(spark):
    with pytest.raises(ValueError, match="sanctioned"):
        md.control_rows([xy(spark)], "binary_risk_vs_none")
    m = spark.createDataFrame([("w", 0.85), ("x", 0.5)], "analysis string, auc double")
    assert md.control_gate(m, "w", "x").first()["verdict"] == "PROCEED_WITH_CAVEAT"
    v = spark.createDataFrame([(0.58,), (0.40,), (0.75,), (0.50,)], "a double").select(md.benchmark_verdict(F.col("a"))).collect()
    assert [r[0] for r in v] == ["near_published", "near_chance", "other", "near_published"]
    with pytest.raises(Exception, match="lacks"):
        md.card_gate(spark.createDataFrame([("r", None)], "run_id string, cv_estimated_auc double"), ["run_id", "cv_estimated_auc"]).collect()


def test_leakage_and_guards(spark):
    with pytest.raises(ValueError, match="label columns"):
        dq.check_label_blind(spark.createDataFrame([(1, 2)], "subject int, Group int"))
    with pytest.raises(ValueError, match="budget"):
        dq.check_declared_features(spark.range(1), [f"f{i}" for i in range(31)], [])
    with pytest.raises(Exception, match="more than one run"):
        dq.same_run({"a": spark.range(1).withColumn("run_id", F.lit("r1")), "b": spark.range(1).withColumn("run_id", F.lit("r2"))}).collect()


def test_screen(spark):
    r = np.random.default_rng(0)
    rows = [(i, ["N", "A_P_minus", "A_P_plus"][i % 3], float(r.normal() + 20 * (i % 3 == 2)), int(r.integers(0, 2)), float(i % 3)) for i in range(90)]
    from cohortwave.functions.text import target_framings
    d = spark.createDataFrame(rows, "id int, grp string, age double, sex int, education double").withColumn("ord", F.col("education"))
    s = st.screen(d, "id", ["age"], ["sex"], {"education": "ord"}, target_framings(F.col("grp")), [0, 1, 2]).collect()
    assert len(s) == 9
    age = {x["framing"]: x for x in s if x["variable"] == "age"}
    assert age["multiclass_3"]["verdict"] == "blocking" and all(x["fdr_q"] >= x["p_value"] - 1e-4 for x in s)


def test_bootstrap_copies_stay_in_their_originals_fold(spark):
    rows = xy(spark).withColumn("draw", F.lit(0))
    copies = rows.unionByName(rows.withColumn("row_id", F.concat("row_id", F.lit("#2")))).withColumn("grp", F.split("row_id", "#")[0])
    p = cv.simple_cv(copies, ["analysis"])
    spread = p.groupBy(F.split("row_id", "#")[0].alias("o")).agg(F.countDistinct("fold").alias("k"), F.count(F.lit(1)).alias("n"))
    assert {(r["k"], r["n"]) for r in spread.collect()} == {(1, 2)}


def test_both_layouts_of_the_plain_analysis_agree(spark):
    rows = xy(spark)
    a = cv.simple_cv(rows, ["analysis"], n_splits=3)
    b = cv.simple_cv(rows.repartition(7), ["analysis"], n_splits=3, max_cells=1)
    j = a.join(b.select("row_id", F.col("fold").alias("f2"), F.col("proba").alias("p2")), "row_id")
    assert j.count() == rows.count() and j.where((F.col("fold") != F.col("f2")) | (F.abs(F.col("proba") - F.col("p2")) > 1e-6)).isEmpty()


def test_fits_that_do_not_converge_are_reported():
    x = np.random.default_rng(0).normal(size=(30, 3))
    with pytest.raises(ArithmeticError):
        cv._fit(x, (x[:, 0] > 0).astype(float), np.array([1.0]), steps=1)


def test_fit_holds_less_than_its_matrix():
    """Beside the matrix, a fit of several C holds blocks of rows and numbers per row."""
    import tracemalloc
    r = np.random.default_rng(8)
    x = r.normal(size=(60000, 64))
    y = (x[:, 0] + r.normal(size=60000) > 0).astype(float)
    tracemalloc.start()
    try:
        cv._fit(x, y, np.array([0.01, 0.1, 1.0, 10.0]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < x.nbytes


def test_scaled_rows_equal_a_scaled_copy():
    """Fold by fold, with missing cells, a feature without values in training and a constant one."""
    r = np.random.default_rng(9)
    x = r.normal(size=(9000, 5)) * [1, 10, 100, 1, 0] + 3
    x[r.random((9000, 5)) < 0.2] = np.nan
    fold = np.arange(9000) % 3
    x[fold != 2, 3] = np.nan
    x[:, 4] = 7.0
    mine, holes = x.copy(), cv._holes(x)
    for f in range(3):
        tr, te = cv._scaled(mine, holes, fold != f)
        med = [np.median(v) if len(v) else 0.0 for v in (c[~np.isnan(c)] for c in x[fold != f].T)]
        full = np.where(np.isnan(x), med, x)
        sd = full[fold != f].std(axis=0)
        want = (full - full[fold != f].mean(axis=0)) / np.where(sd > 0, sd, 1.0)
        assert np.allclose(tr.dense(), want[fold != f], atol=1e-9) and np.allclose(te.dense(), want[fold == f], atol=1e-9)


def test_unfolded_draws_are_the_folded_ones(spark):
    """Effects read every drawn row once: a row drawn three times is three rows; ids and strata may be null or repeat."""
    from collections import Counter
    from cohortwave.operators import resample as rs
    rows = [(i % 37 if i % 11 else None, "ab"[i % 2] if i % 13 else None) for i in range(60)]
    d = spark.createDataFrame(rows, "id long, s string")
    fold = {(r.draw, r.id, r.s): 0 for r in rs.bootstrap(d, "id", 5, 3, ["s"]).collect()}
    for r in rs.bootstrap(d, "id", 5, 3, ["s"]).collect():
        fold[r.draw, r.id, r.s] += r.mult
    flat = rs.bootstrap(d, "id", 5, 3, ["s"], folded=False).collect()
    assert Counter((r.draw, r.id, r.s) for r in flat) == fold and {r.mult for r in flat} == {1} and len(flat) > 200


def labelled_tables(spark, at, n=24):
    r = np.random.default_rng(5)
    vec = [(i, [float(v) for v in r.normal(size=64)], i % 3) for i in range(n)]
    spark.createDataFrame(vec, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([(i, "t", "en", "s" * (1 + i % 4), 50 + i) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(n)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["md3_primary_set", "md4_secondary_set_holm", "md7_control_ladder"])
def test_analyses_take_every_repeat_draw_and_strength(spark, tmp_path, monkeypatch, name):
    """10 repeats, 1000 permutations, 2000 bootstrap draws and 11 strengths, as the reference declares them; every row goes in."""
    import inspect
    from cohortwave.plans import QUERIES
    seen, how = [], inspect.signature(md.run_analyses)

    def spy(rows, **settings):
        seen.append(how.bind(rows, **settings))
        seen[-1].apply_defaults()
        m = rows.groupBy("analysis").agg(F.count(F.lit(1)).alias("n"))
        return {"metrics": m.select("analysis", F.lit(0.5).alias("auc"), F.lit(0.5).alias("p_value"), "n")}

    monkeypatch.setattr(md, "run_analyses", spy)
    got = QUERIES[name](spark, labelled_tables(spark, tmp_path)).collect()
    assert len(got) == 3 and {r["n"] for r in got} == ({24, 19} if name == "md4_secondary_set_holm" else {24})      # 5 of 24 have no src_len
    a = seen[0].arguments
    assert len(seen) == 1 and (a["n_repeats"], a["n_permutations"], a["n_bootstrap"]) == (10, 1000, 2000)
    assert a["c_grid"] == [0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0]


def test_draws_that_name_rows_give_the_aucs_of_drawn_rows(spark):
    """Draws without features against nested CV over draws written out row by row; ids repeat, groups hold several rows and
    values are missing. Above the size bound the other layout gives the same."""
    from cohortwave.operators import resample as rs
    d = xy(spark, n=40, p=4).unionByName(xy(spark, n=30, p=3, seed=3, shift=0.0, name="b"))
    d = d.withColumn("row_id", F.when((F.col("analysis") == "b") & (F.col("row_id") == "7"), "6").otherwise(F.col("row_id"))).withColumn("grp", (F.col("grp").cast("int") / 2).cast("int").cast("string"))
    how = dict(c_grid=[0.1, 10.0], seed=4)
    nulls = md.run_analyses(d, n_repeats=1, n_permutations=3, n_bootstrap=3, **how)["nulls"]
    by = ["analysis", "kind", "draw"]
    rows = d.withColumn("pos", F.col("row_id").cast("long") * 1000 + F.length("analysis") + F.size("x") * 10 + F.col("y")).localCheckpoint()
    perm = rs.permute_labels(rows, "row_id", "y", 3, 4, ["analysis"]).withColumn("kind", F.lit("permutation")).withColumn("mult", F.lit(1))
    boot = rs.bootstrap(rows, "row_id", 3, 5, ["analysis", "y"]).withColumn("kind", F.lit("bootstrap"))
    cols = [*by, "pos", "row_id", "grp", "y", "mult", "x"]
    drawn = perm.select(*cols).unionByName(boot.select(*cols)).localCheckpoint()
    copies = drawn.withColumn("c", F.explode(F.sequence(F.lit(1), F.col("mult").cast("int")))).withColumn("row_id", F.concat_ws("#", "row_id", "c"))
    pred = cv.nested_cv(copies.select(*by, "row_id", "grp", "y", "x"), by, **how)[0]
    want = {tuple(r[:3]): r["auc"] for r in st.auc(pred, by, "y", "proba").select(*by, "auc").collect()}
    named = drawn.select(*by, "pos", "y", "mult")
    got = {tuple(r[:3]): r["auc"] for r in cv.nested_cv_auc(named, rows, by, 160, 6, **how).drop("rep").collect()}
    assert len(got) == 12 and got == pytest.approx(want, abs=1e-9)
    assert {("a", r["draw"]): r["auc"] for r in nulls.where("analysis = 'a'").collect()} == pytest.approx({("a", k[2]): v for k, v in want.items() if k[:2] == ("a", "permutation")}, abs=1e-9)
    one = named.where("kind = 'bootstrap' and draw = 1 and analysis = 'b'")
    far = cv.nested_cv_auc(one, rows, by, 160, 1, c_grid=[1.0], seed=4, n_splits=2, max_cells=1).first()["auc"]
    near = cv.nested_cv_auc(one, rows, by, 160, 1, c_grid=[1.0], seed=4, n_splits=2).first()["auc"]
    assert far == pytest.approx(near, abs=1e-9)


def test_counted_rows_fit_as_copies():
    """Against plain Newton steps on copied rows, near-separable and over several blocks of rows."""
    r = np.random.default_rng(2)
    for n, p in ((40, 30), (9000, 5)):
        x, k = r.normal(size=(n, p)), r.integers(0, 4, n).astype(float)
        y = (x[:, 0] + 0.3 * r.normal(size=n) > 0.5).astype(float)
        at = np.repeat(np.arange(n), k.astype(int))
        cs = np.array(cv.C_GRID)
        got = cv._fit(x, y, cs, k=k)
        assert np.allclose(got, cv._fit(x[at], y[at], cs), atol=1e-8)
        a = np.column_stack([np.ones(len(at)), x[at]])
        for b, c in zip(got, cs):
            grad = a.T @ (1 / (1 + np.exp(-a @ b)) - y[at]) + np.r_[0, b[1:]] / c
            assert np.abs(grad).max() < 1e-6


def test_hashes_in_a_task_equal_the_column(spark):
    from cohortwave.functions.rng import HashTails, hash_int
    tails = ["", "7", "12", "é", "x" * 20, "y" * 60, "z" * 200]
    d = spark.createDataFrame([(t,) for t in tails], "t string")
    for head in (("outer", "a", 3), ("a" * 70, None, 0), ("b", 12345)):
        cols = [F.lit(v) for v in head]
        want = {r["t"]: r["h"] for r in d.select("t", hash_int(9, *cols, F.col("t")).alias("h")).collect()}
        assert HashTails(tails).hashes(9, *head).tolist() == [want[t] for t in tails]


@pytest.mark.parametrize("clip", [False, True])
def test_effects_counted_in_tasks_are_those_of_drawn_rows(spark, monkeypatch, clip):
    """Ids repeat or are null, values tie, are NaN or null, a class is undeclared or null, and a variable has one class or no number."""
    r = np.random.default_rng(1)
    rows = [("a", i % 31 if i % 9 else None, ["x", "y", "z", "w", None][i % 5], float(r.integers(0, 6)) if i % 7 else float("nan") if i % 2 else None) for i in range(90)]
    rows += [("b", i, "y", float(i)) for i in range(6)] + [("c", i, "xy"[i % 2], float("nan")) for i in range(6)] + [(m, i, "xyz"[i % 3], float(r.normal())) for m in (None, "d") for i in range(40)]
    d = spark.createDataFrame(rows, "m string, id long, g string, v double")
    draws = lambda: {(x["m"], x["draw"]): x["effect"] for x in st.effect_draws(d, ["m"], "id", "g", "v", ["x", "y", "z"], 25, 8, clip=clip).collect()}
    counted = draws()
    monkeypatch.setattr(st, "MAX_TASK_ROWS", 0)
    drawn = draws()
    assert {m for m, _ in drawn} >= {"a", "d"} and counted.keys() == drawn.keys()
    assert counted == pytest.approx(drawn, abs=1e-10)


def test_association_takes_every_draw(spark, tmp_path, monkeypatch):
    from cohortwave.plans import QUERIES
    spark.createDataFrame([(i, "t", ["de", "en", "es", "fr"][i % 4], "s", 100 + 7 * i) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    seen, whole = [], st.effect_draws

    def spy(*a, **k):
        seen.append(whole(*a, **k))
        return seen[-1]

    monkeypatch.setattr(st, "effect_draws", spy)
    got = QUERIES["st1_association_table"](spark, str(tmp_path)).collect()
    assert len(got) == 8 and all(r["ci_low"] <= r["ci_high"] for r in got)
    per = {r["metric"]: r["n"] for r in seen[0].groupBy("metric").agg(F.countDistinct("draw").alias("n")).collect()}
    assert len(per) == 8 and set(per.values()) == {2000}
