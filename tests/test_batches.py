"""B2/B3 as stored files: order, ranges, and how little of the table a range reads."""

import pytest
from pyspark.sql import functions as F

from tokenloom.sources.batches import read_batches, store_batches


def test_a_range_of_batches_is_read_from_its_own_file(spark, tmp_path):
    path = str(tmp_path / "epoch")
    places = spark.range(96).select((F.col("id") % 40).alias("doc_id"), (F.col("id") % 2).cast("int").alias("rank"),
                                    F.expr("id div 2").alias("pos"), F.expr("id div 2 div 4").alias("batch_id"))
    seqs = spark.range(40).select(F.col("id").alias("doc_id"), F.array(F.col("id"), F.col("id") * 2).alias("ids"))
    with pytest.raises(ValueError):
        read_batches(spark, path)
    store_batches(places, seqs, path, batches_per_file=3)
    got = sorted((r.rank, r.pos, r.batch_id, r.doc_id, r.ids) for r in read_batches(spark, path).collect())
    assert got == sorted((i % 2, i // 2, i // 8, i % 40, [i % 40, i % 40 * 2]) for i in range(96))
    some = read_batches(spark, path, rank=1, first=4, last=4)
    assert [(r.pos, r.doc_id) for r in some.orderBy("pos").collect()] == [(p, (2 * p + 1) % 40) for p in range(16, 20)]
    assert [r[0] for r in some.select(F.input_file_name()).distinct().collect()][0].count("rank=1/part=1/") == 1
    scan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "part" in scan.split("PartitionFilters: [")[1].split("]")[0]
    files = spark.read.parquet(path).select("rank", "part", F.input_file_name().alias("f")).distinct()
    assert files.count() == 2 * 4  # one file for three batches of a rank
