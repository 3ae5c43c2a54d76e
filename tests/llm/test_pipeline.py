import corpus_pipeline


def test_stages_and_empty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, out = out, stage(spark, out, "/root/testdata/sf0.001")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        if i < 3:
            assert out.count() <= before.count() and not out.exceptAll(before).count()
    assert out.columns == [*docs.columns, "shard", "slot"] and out.count()
    assert out.select("shard", "slot").distinct().count() == out.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


def test_one_of_repeated_rows_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(2, text, None, None, 1), (1, text, None, None, 1), (1, text, None, None, 1), (None, text + " x", None, None, 1), (3, None, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]
