"""The stages' contract, and the registration of all queries."""

import corpus_pipeline as P
from lexiloom.llm import queries

KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, row int"


def test_registered_queries():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_copies", "decontamination", "packing"]


def test_stages_on_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, None, None, 0.1, 1), (2, "", "en", "s", 0, 0.1, 1), (3, "a b c\nd e f", "en", "s", 11, 0.1, 1), (3, "a b c\nd e f", "en", "s", 11, 0.1, 1), (None, "x y z", "en", "s", 5, 0.1, 1)], KIND)
    for name, stage in P.STAGES:
        out = stage(spark, df, "/root/testdata/sf0.001")
        if name != "packing":
            assert tuple(out.columns) == P.COLUMNS
        assert out.count() >= 2
        assert stage(spark, df.limit(0), "/root/testdata/sf0.001").count() == 0


def test_pipeline_end_to_end(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = P.run(spark, "/root/testdata/sf0.001")
    kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert kept < {r.doc_id for r in docs.select("doc_id").collect()} and len(kept) > 100
    bad = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1")
    assert len(kept & {r.doc_id for r in bad.collect()}) > 0.5 * bad.count()
