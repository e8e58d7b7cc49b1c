import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cohortwave.functions import ordered as od, tails
from cohortwave.operators import resample as rs, stattests as st


def skewed(spark, n=3000, seed=0):
    r = np.random.default_rng(seed)
    k = np.where(r.random(n) < 0.4, 0, r.integers(1, 20, n))          # one key holds 40 % of the rows
    v = np.round(r.lognormal(size=n), 2)
    return pd.DataFrame({"k": k, "i": np.arange(n), "v": v, "y": r.integers(0, 2, n)})


def test_ranks_and_percentiles(spark):
    pdf = skewed(spark)
    df = spark.createDataFrame(pdf).repartition(7)
    got = od.bucketed_counts(df, ["k"], "v").withColumn("r", od.tied_rank_column()).toPandas()
    want = pdf.assign(r=pdf.groupby("k")["v"].rank()).drop_duplicates(["k", "v"])
    m = want.merge(got, on=["k", "v"])
    assert len(m) == len(got) and np.allclose(m["r_x"], m["r_y"])
    q = od.exact_percentiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.975}).toPandas().set_index("k").sort_index()
    for c, p in (("a", 0.1), ("b", 0.5), ("c", 0.975)):
        assert np.allclose(q[c], pdf.groupby("k")["v"].quantile(p).sort_index())


def test_neighbour_and_running_sum(spark):
    pdf = skewed(spark).sort_values(["k", "i"])
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=1))
    b = F.floor(F.col("i") / 50)
    got = od.neighbour(df, ["k"], ["i"], {"v": "nx"}, b, 1)
    got = od.neighbour(got, ["k"], ["i"], {"v": "pv"}, b, -1)
    got = od.neighbour(got, ["k"], ["i"], {"v": "n2"}, F.floor(F.col("i") / 2), 1, levels=2)
    got = od.running_sum(got, ["k"], ["i"], "v", [F.floor(F.col("i") / 400), b], "cs").toPandas().sort_values(["k", "i"])
    g = pdf.groupby("k")["v"]
    assert np.allclose(got["nx"].to_numpy(), g.shift(-1).to_numpy(), equal_nan=True)
    assert np.allclose(got["n2"].to_numpy(), g.shift(-1).to_numpy(), equal_nan=True)
    assert np.allclose(got["pv"].to_numpy(), g.shift(1).to_numpy(), equal_nan=True)
    assert np.allclose(got["cs"].to_numpy(), g.cumsum().to_numpy())


def test_dense_index(spark):
    pdf = skewed(spark)
    got = od.dense_index(spark.createDataFrame(pdf), ["k"], F.col("v"), "i").toPandas()
    want = pdf.sort_values(["k", "v", "i"])
    want["w"] = want.groupby("k").cumcount()
    m = want.merge(got, on="i")
    assert (m["w"] == m["idx"]).all()


def brute_kruskal(groups):
    x = np.concatenate(groups)
    r = pd.Series(x).rank().to_numpy()
    n, at, h = len(x), 0, 0.0
    for g in groups:
        h += r[at:at + len(g)].sum() ** 2 / len(g)
        at += len(g)
    h = 12 / (n * (n + 1)) * h - 3 * (n + 1)
    _, c = np.unique(x, return_counts=True)
    return h / (1 - (c ** 3 - c).sum() / (n ** 3 - n))


def test_kruskal_auc_spearman(spark):
    pdf = skewed(spark, 600)
    df = spark.createDataFrame(pdf).withColumn("m", F.lit("x"))
    h = st.kruskal(df, ["m"], "y", "v", [0, 1]).first()
    assert abs(h["statistic"] - brute_kruskal([pdf.v[pdf.y == 0].to_numpy(), pdf.v[pdf.y == 1].to_numpy()])) < 1e-8
    a = st.auc(df, ["m"], "y", "v").first()["auc"]
    p, q = pdf.v[pdf.y == 1].to_numpy(), pdf.v[pdf.y == 0].to_numpy()
    want = ((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / (len(p) * len(q))
    assert abs(a - want) < 1e-12
    neg = st.auc(df.withColumn("v", -F.col("v")), ["m"], "y", "v").first()["auc"]
    assert abs(a + neg - 1) < 1e-12
    rho = st.spearman(df, ["m"], "k", "v").first()["rho"]
    assert abs(rho - pdf["k"].rank().corr(pdf["v"].rank())) < 1e-9


def test_tails(spark):
    df = spark.createDataFrame([(3.841458820694124, 1), (5.991464547107979, 2), (40.0, 30), (0.5, 7)], "x double, d int")
    got = [r[0] for r in df.select(tails.chi2_sf(F.col("x"), F.col("d"))).collect()]
    assert np.allclose(got, [0.05, 0.05, 0.10486428, 0.99943953], atol=1e-7)
    t = [r[0] for r in spark.createDataFrame([(2.228138851964939, 10.0), (1.0, 3.5)], "t double, d double").select(tails.t_two_sided(F.col("t"), F.col("d"))).collect()]
    assert abs(t[0] - 0.05) < 1e-9 and abs(t[1] - 0.38216) < 1e-3
    f = spark.createDataFrame([(8, 2, 1, 5), (3, 0, 0, 0)], "a int, b int, c int, d int").select(tails.fisher_two_sided(*[F.col(c) for c in "abcd"])).collect()
    assert abs(f[0][0] - 0.034965) < 1e-5 and f[1][0] is None


def test_multiplicity(spark):
    p = spark.createDataFrame([("a", .01), ("b", .04), ("c", .20)], "name string, p double").withColumn("f", F.lit(1))
    h = {r["name"]: r["p_value_holm"] for r in st.holm(p, ["f"], "p", "name").collect()}
    assert np.allclose([h["a"], h["b"], h["c"]], [.03, .08, .20])
    r = np.random.default_rng(1).random(200).round(2)
    q = st.bh(spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(r)], "f int, i int, p double"), ["f"], "p").toPandas().sort_values("i")
    o = np.argsort(r)
    w = np.empty(200)
    w[o] = np.minimum.accumulate((r[o] * 200 / (np.arange(200) + 1))[::-1])[::-1]
    assert np.allclose(q["q_value"], np.minimum(w, 1)) and (q["q_value"] >= q["p"] - 1e-12).all()


def test_chi_square_forms(spark):
    d = spark.createDataFrame([("x", "a", "u")] * 8 + [("x", "a", "v")] * 2 + [("x", "b", "u")] * 1 + [("x", "b", "v")] * 5, "k string, g string, l string")
    r = st.chi_square(st.contingency(d, ["k"], "g", "l"), ["k"]).first()
    assert r["test"] == "Fisher's exact" and abs(r["p_value"] - 0.034965) < 1e-5
    o = np.array([[8, 2], [1, 5]])
    e = np.outer(o.sum(1), o.sum(0)) / 16
    assert abs(r["chi2"] - ((o - e) ** 2 / e).sum()) < 1e-9
    assert abs(r["phi"] - (8 * 5 - 2 * 1) / np.sqrt(10 * 9 * 7 * 6)) < 1e-9


def test_resampling_is_partition_free(spark):
    d = spark.createDataFrame([(i, i % 3 == 0) for i in range(300)], "id long, y boolean").withColumn("y", F.col("y").cast("int"))
    a = rs.bootstrap(d.repartition(2), "id", 5, 3, ["y"]).groupBy("draw", "y").agg(F.sum("mult").alias("n"), F.sum(F.col("mult") * F.col("id")).alias("s")).toPandas()
    b = rs.bootstrap(d.repartition(9), "id", 5, 3, ["y"]).groupBy("draw", "y").agg(F.sum("mult").alias("n"), F.sum(F.col("mult") * F.col("id")).alias("s")).toPandas()
    k = ["draw", "y"]
    assert a.sort_values(k).reset_index(drop=True).equals(b.sort_values(k).reset_index(drop=True))
    assert set(a[a.y == 1].n) == {100} and set(a[a.y == 0].n) == {200}
    p = rs.permute_labels(d, "id", "y", 4, 5).groupBy("draw").agg(F.sum("y").alias("s"), F.count("*").alias("n")).collect()
    assert all(r["s"] == 100 and r["n"] == 300 for r in p)
    lk = rs.leave_k_out(d, "id", [2, 5], 3, 1).groupBy("k", "rep").count().collect()
    assert len(lk) == 6 and all(r["count"] == 300 - r["k"] for r in lk)
