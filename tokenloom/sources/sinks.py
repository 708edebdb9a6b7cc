"""Sinks (S6-S8): tokenized table, manifest, metrics log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import get_record, last_number, put_record


def write_tokenized(seqs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Persist the tokenized table as Parquet (never overwrite by default)."""
    seqs.write.mode(mode).parquet(path)


def manifest(seqs: DataFrame, max_length: int, tokenizer: str) -> DataFrame:
    """One row {samples, max_length, tokenizer}; samples = row count.

    Pass the table read back from where it was written so the count is
    of what was stored.
    """
    return seqs.agg(F.count(F.lit(1)).alias("samples")).select(
        "samples", F.lit(int(max_length)).alias("max_length"), F.lit(str(tokenizer)).alias("tokenizer"))


def write_manifest(spark: SparkSession, path: str, max_length: int, tokenizer: str, out: str) -> DataFrame:
    """Count the written table at ``path`` and store the manifest as JSON at ``out``."""
    m = manifest(spark.read.parquet(path), max_length, tokenizer)
    m.coalesce(1).write.mode("overwrite").json(out)
    return m


EVAL_LOG_COLUMNS = ("eval_loss", "eval_perplexity")


def eval_records(evaluation: DataFrame, run_id: int, step: int) -> DataFrame:
    """(run_id, step, eval_loss, eval_perplexity) of an evaluation row (loss, perplexity)."""
    return evaluation.select(F.lit(int(run_id)).alias("run_id"), F.lit(int(step)).cast("bigint").alias("step"),
                             *[F.col(c).alias(name) for c, name in zip(("loss", "perplexity"), EVAL_LOG_COLUMNS)])


def append_metrics(df: DataFrame, path: str) -> None:
    """Append metric rows keyed by (run_id, step) to the table at ``path``.

    The rows are written in full to their own ``part=`` folder and count from the moment its
    record is stored, so a job that fails half-way leaves nothing that ``read_metrics`` sees.
    """
    spark, part = df.sparkSession, f"p{uuid.uuid4().hex}"
    df.sortWithinPartitions("run_id", "step").write.parquet(f"{path}/part={part}")
    while not put_record(spark, path, last_number(spark, path) + 1, {"part": part}):
        pass  # another writer took the number


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``append_metrics``, one for each (run_id, step): a repeated append replaces the earlier row."""
    records = [get_record(spark, path, n) for n in range(last_number(spark, path) + 1)]
    order = spark.createDataFrame([(r["part"], n) for n, r in enumerate(records) if r], "part string, _n int")
    rows = spark.read.option("mergeSchema", True).parquet(path).join(order, "part")
    values = [c for c in rows.columns if c not in ("run_id", "step", "part", "_n")]
    last = rows.groupBy("run_id", "step").agg(F.max_by(F.struct(*values), "_n").alias("_v"))
    return last.select("run_id", "step", *[F.col("_v")[c].alias(c) for c in values])
