"""Stored jobs: the preparation job with its manifest, routed reads, and file streams over the given tables.

Every job writes under a fresh folder of the shared checkpoint folder and
what it returns is read back from there.
"""

from __future__ import annotations

import math
import uuid

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import telemetry as tm
from ..operators.sequence import label_mask
from ..operators.vocab import build_vocab
from ..session import ensure_checkpoint_dir, intermediate
from ..sources.corpus import ingest_bounded, input_bytes, read_corpus, read_tokenized, source_kind
from ..sources.sinks import write_manifest, write_tokenized
from ..streaming.ingest import (finish_log_windows, stream_ingest, stream_log_windows, stream_metrics,
                                stream_tokenize)
from .prepare import PrepConfig, prepare, spread, table, tokenized

TOKENS = regex.compile(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x09-\x0D\x20]")  # as functions.text, in Python's notation
BATCHES = 4  # micro-batches of a stream
FILE_BYTES = 64 * 1024 * 1024  # of stored input a file of a stream's source


def fresh_folder(spark: SparkSession, name: str) -> str:
    return intermediate(f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokenloom-jobs/{name}-{uuid.uuid4().hex}")


def preparation_job(spark: SparkSession, src: str, dst: str, cfg: PrepConfig = PrepConfig(),
                    num_shards: int | None = None, drop_blank: bool = True, tokenizer=None,
                    tokenizer_name: str = "tokenloom-regex") -> DataFrame:
    """Read ``src`` (S1/S2), bound it (S5), tokenize and encode, write ``dst``/data (S6) and ``dst``/manifest.

    Returns the manifest, counted from the written files.  ``drop_blank``
    False keeps blank texts as empty sequences; ``tokenizer`` maps a
    pandas Series of texts to one of token lists (U1).
    """
    docs = read_corpus(spark, src, drop_blank=drop_blank, ids="place")
    if num_shards is not None:
        docs = ingest_bounded(docs, num_shards)
    _, _, seqs = prepare(spread(docs, "doc_id"), cfg, tokenizer=tokenizer)
    write_tokenized(seqs.drop("labels"), f"{dst}/data")
    return write_manifest(spark, f"{dst}/data", cfg.max_length, tokenizer_name, f"{dst}/manifest")


def training_sequences(spark: SparkSession, path: str, cfg: PrepConfig = PrepConfig()) -> DataFrame:
    """(doc_id, input_ids, attention_mask, labels) of a source, stored or raw.

    A pre-tokenized table is read as it is (S3); a text source is prepared.
    """
    kind = source_kind(spark, path)
    if kind == "tensor":
        raise ValueError(f"tensor files cannot be read: {path}")
    if kind == "pretokenized":
        return label_mask(read_tokenized(spark, path))
    return prepare(spread(read_corpus(spark, path, ids="place"), "doc_id"), cfg)[2]


def regex_tokenizer(texts: pd.Series) -> pd.Series:
    """The standard tokens, from a user-side tokenizer over an Arrow batch."""
    return texts.map(TOKENS.findall)


# ---------------------------------------------------------------- registered queries
def _joined(c):
    return F.array_join(F.col(c), " ")


def q_read_jsonl(spark, sf):
    """Documents written as text-only JSON lines and read back; an id for each line, from its file and offset."""
    path = fresh_folder(spark, "lines") + "/corpus.jsonl"
    table(spark, sf, "documents").select("text").write.json(path)
    d = read_corpus(spark, path, ids="place")
    return d.groupBy(F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("n_lines"),
                                                          F.count_distinct("doc_id").alias("n_ids"))


def q_read_columnar(spark, sf):
    """The columnar source through the corpus reader."""
    d = read_corpus(spark, f"{sf}/documents.parquet")
    return d.select("doc_id", F.length("text").cast("bigint").alias("n_chars"))


def q_pretokenized_scan(spark, sf):
    """S6 -> S4 -> S3: the preparation job's table, recognised by its schema and read back."""
    dst = fresh_folder(spark, "prepared")
    preparation_job(spark, f"{sf}/documents.parquet", dst)
    s = training_sequences(spark, f"{dst}/data")
    return s.select("doc_id", _joined("input_ids").alias("input_ids"), _joined("labels").alias("labels"))


def q_prepared_manifest(spark, sf):
    """S7 of the preparation job: its manifest as stored."""
    dst = fresh_folder(spark, "prepared")
    preparation_job(spark, f"{sf}/documents.parquet", dst)
    m = spark.read.schema("samples bigint, max_length int, tokenizer string").json(f"{dst}/manifest")
    return m.select("samples", "max_length", "tokenizer")


def q_user_tokenizer(spark, sf):
    """U1 in the preparation: a user's batch tokenizer in place of the built-in one."""
    t = tokenized(read_corpus(spark, f"{sf}/documents.parquet"), tokenizer=regex_tokenizer)
    return t.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
                    F.md5(_joined("tokens")).alias("tokens_md5"))


def _stream_files(spark, df, name):
    """(source folder, output folder, progress folder, files of a micro-batch).

    The source is dealt to BATCHES times as many files as the cluster has cores, or more where
    these would pass FILE_BYTES: every micro-batch has work for all cores, no task more than a file.
    """
    base = fresh_folder(spark, name)
    each = max(spark.sparkContext.defaultParallelism, math.ceil(input_bytes(df) / (BATCHES * FILE_BYTES)))
    df.repartition(BATCHES * each).write.parquet(f"{base}/src")
    return f"{base}/src", f"{base}/out", f"{base}/progress", each


def q_stream_ingest(spark, sf):
    """ST1: every row of a file stream, over several micro-batches."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    src, out, progress, files = _stream_files(spark, docs, "ingest")
    stream_ingest(spark, src, out, progress, limit=None, max_files_per_trigger=files)
    return spark.read.parquet(out).select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def q_stream_ingest_bounded(spark, sf):
    """ST1 with its bound, which the third micro-batch passes: rows kept, their ids, those equal to the source."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    src, out, progress, files = _stream_files(spark, docs, "bounded")
    total = docs.count()
    stream_ingest(spark, src, out, progress, limit=total * 5 // 8, max_files_per_trigger=files)
    source = docs.select("doc_id", F.col("text").alias("_t"))
    kept = spark.read.parquet(out).join(source, "doc_id", "left")
    return kept.agg(F.count(F.lit(1)).alias("n_kept"), F.count_distinct("doc_id").alias("n_ids"),
                    F.count(F.when(F.col("text").eqNullSafe(F.col("_t")), 1)).alias("n_own"))


def q_stream_tokenize(spark, sf):
    """ST2: documents as a stream, encoded with the vocabulary of the whole corpus."""
    docs = read_corpus(spark, f"{sf}/documents.parquet").select("doc_id", "text")
    src, out, progress, files = _stream_files(spark, docs, "tokenize")
    cfg = PrepConfig()
    vocab = build_vocab(tokenized(spread(docs, "doc_id")), cfg.vocab_size)
    stream_tokenize(spark, src, out, progress, vocab, cfg.max_length, max_files_per_trigger=files)
    return spark.read.parquet(out).select("doc_id", _joined("input_ids").alias("input_ids"),
                                          _joined("labels").alias("labels"))


def q_stream_log_windows(spark, sf):
    """ST3: the run log as a stream, rolled up to log windows."""
    src, out, progress, files = _stream_files(spark, tm.micro_batches(table(spark, sf, "events")), "log")
    stream_log_windows(spark, src, out, progress, every=1, accumulation=8, max_files_per_trigger=files)
    w = finish_log_windows(spark, out, 1, 8, 8)
    return w.select("run_id", "step", F.round("loss", 9).alias("loss"),
                    F.round("ms_per_step", 6).alias("ms_per_step"))


def q_stream_metrics(spark, sf):
    """Update metrics of every run appended by a stream; a second start adds nothing."""
    rows = tm.update_log(tm.micro_batches(table(spark, sf, "events")), 8).select("run_id", "step", "loss_sum")
    src, out, progress, files = _stream_files(spark, rows, "metrics")
    for _ in range(2):
        stream_metrics(spark, src, out, progress, max_files_per_trigger=files)
    return spark.read.parquet(out).select("run_id", "step", F.round("loss_sum", 9).alias("loss_sum"))


QUERIES = {
    "read_jsonl": q_read_jsonl,
    "read_columnar": q_read_columnar,
    "pretokenized_scan": q_pretokenized_scan,
    "prepared_manifest": q_prepared_manifest,
    "user_tokenizer": q_user_tokenizer,
    "stream_ingest": q_stream_ingest,
    "stream_ingest_bounded": q_stream_ingest_bounded,
    "stream_tokenize": q_stream_tokenize,
    "stream_log_windows": q_stream_log_windows,
    "stream_metrics": q_stream_metrics,
}
