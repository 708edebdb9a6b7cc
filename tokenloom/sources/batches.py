"""An epoch stored as batches (B2/B3): files of consecutive batches per rank, so a batch is one short read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import get_record, put_record

BATCHES_PER_FILE = 64


def store_batches(batches: DataFrame, seqs: DataFrame, path: str, batches_per_file: int = BATCHES_PER_FILE,
                  doc_col: str = "doc_id") -> None:
    """Write the sequences of ``batches`` (doc_id, rank, pos, batch_id) to ``path`` in the order of training.

    One shuffle brings sequences to their places, a second one brings ``batches_per_file``
    consecutive batches of a rank together; they are one file ``rank=/part=``, sorted by batch and
    place.  A document that the sampler takes twice is stored twice; a place without a sequence
    is left out.  The table counts from the moment its record is stored.
    """
    per = int(batches_per_file)
    rows = batches.select(doc_col, "rank", "pos", "batch_id").join(seqs, doc_col)
    rows = rows.withColumn("part", F.expr(f"batch_id div {per}")).repartition("rank", "part")
    rows.sortWithinPartitions("rank", "part", "batch_id", "pos").write.partitionBy("rank", "part").parquet(path)
    put_record(batches.sparkSession, path, 0, {"batches_per_file": per})


def read_batches(spark: SparkSession, path: str, rank: int | None = None, first: int = 0, last: int | None = None) -> DataFrame:
    """The stored rows, or those of batches ``first`` to ``last`` (inclusive) of a rank.

    The bounds reach the folders (rank and part) and, inside a file, the statistics of ``batch_id``.
    """
    record = get_record(spark, path, 0)
    if record is None:
        raise ValueError(f"{path} holds no finished table of batches")
    per = record["batches_per_file"]
    rows = spark.read.parquet(path).where((F.col("batch_id") >= int(first)) & (F.col("part") >= int(first) // per))
    if rank is not None:
        rows = rows.where(F.col("rank") == int(rank))
    if last is not None:
        rows = rows.where((F.col("batch_id") <= int(last)) & (F.col("part") <= int(last) // per))
    return rows.drop("part")
