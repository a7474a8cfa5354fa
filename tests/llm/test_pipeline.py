"""The pipeline: stages keep the columns, take effect, and run end to end."""

import corpus_pipeline as P


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    now = docs
    for name, stage in P.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns and dict(now.dtypes) == dict(docs.dtypes), name
        now = spark.createDataFrame(now.toPandas(), docs.schema)
        sizes.append(now.count())
    assert sizes[0] >= sizes[1] > sizes[2] == sizes[3] > sizes[4] > 0
    out = P.run(spark, sf).toPandas()
    assert len(out) == sizes[-1] and (out["taken"] <= 2 * out["size"]).all()


def test_awkward_rows(spark):
    rows = [(1, "a b c", None, "s", None, 1), (1, "a b c", None, "s", None, 1), (None, None, None, None, None, None), (2, "", "en", "s", 0, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, gone int")
    one = P.jaccard_join(spark, docs, "/root/testdata/sf0.001")
    assert one.columns == docs.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in one.collect()) == [(False, 1), (False, 2), (True, 0)]
    for _, stage in P.STAGES:
        assert stage(spark, docs.where("false"), "/root/testdata/sf0.001").count() == 0
