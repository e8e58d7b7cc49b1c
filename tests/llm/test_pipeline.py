"""The stages in a row, each against a plain version of its decision on the rows it was given."""
import corpus_pipeline
from cohortwave.llm.pii import base_spans
from cohortwave.llm.quality import measure
from cohortwave.session import cut_lineage
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_jaccard import shingles
from tests.llm.test_packing import check

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(cut_lineage(stage(spark, seen[-1], SF), name))
    raw, good, single, clean, masked = [{r.doc_id: r for r in d.collect()} for d in seen[:5]]
    assert all(d.columns == columns for d in seen[:5])
    for d, r in raw.items():  # base rules, written out again
        n, _, symbols, dups, repeats, *_ = measure(r.text)
        bad = n < 10 or 100 * repeats > 20 * n
        assert d not in good if bad else d in good or symbols or dups or repeats, d
    sets = {d: shingles(r.text) for d, r in good.items()}
    link = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    assert not any(link(a, b) for a in single for b in single if a < b)
    assert all(any(link(a, b) for b in good if b != a) for a in good.keys() - single.keys())
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert clean.keys() == {d for d, r in single.items() if not hits(r.text, items)[3]}
    assert masked.keys() == clean.keys()
    assert not any(base_spans(r.text) for r in masked.values()) and all(r.n_chars == len(r.text) for r in masked.values())
    assert all(r.text == clean[d].text for d, r in masked.items() if not base_spans(clean[d].text) and "<" not in r.text)
    check(seen[5].collect(), [(d, r.text) for d, r in masked.items()])


def test_run_is_the_stages(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(40).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_stages_keep_columns_of_their_own_names(spark):
    """Extra columns called like a stage's helpers, null ids, two texts under one id and no rows at all."""
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    more = docs.select(F.when(F.col("doc_id") % 3 != 0, F.lit(5)).cast("long").alias("doc_id"), "text", "lang", "source", "n_chars",
                       F.col("doc_id").cast("string").alias("__row"), F.lit("s").alias("__spans"), F.lit(2).alias("__node"))
    more = cut_lineage(more, "clash")
    have = {tuple(r) for r in more.collect()}
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, more, SF)
        assert out.columns == more.columns
        rows = out.collect()
        assert rows and all(r["__spans"] == "s" and r["__node"] == 2 for r in rows)
        if stage.__name__ != "pii_stage":
            assert {tuple(r) for r in rows} <= have
        else:
            assert {r["__row"] for r in rows} == {r[5] for r in have}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, more.limit(0), SF).count() == 0
