import corpus_pipeline


def test_stages_keep_columns_and_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.selectExpr("*", "'x' as size", "1 as contamination")
    counts = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, extra, sf)
        if i < 4:
            assert out.columns == extra.columns
        counts.append(out.count())
        extra = out
        if i < 3:  # the decisions of these stages only remove rows
            assert extra.exceptAll(docs.selectExpr("*", "'x' as size", "1 as contamination")).isEmpty()
        extra = spark.createDataFrame(out.toPandas(), out.schema)
    assert counts == sorted(counts, reverse=True) and counts[-1] > 100
    assert {"size", "size_", "copies", "taken"} <= set(extra.columns)


def test_empty_and_null_rows(spark):
    sf = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    for data in ([], [(None,) * len(schema)] * 2):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[:4]:
            assert stage(spark, docs, sf).columns == docs.columns
            stage(spark, docs, sf).count()
        corpus_pipeline.STAGES[4][1](spark, docs, sf).count()


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and out.where("taken > 2 * size").isEmpty()
