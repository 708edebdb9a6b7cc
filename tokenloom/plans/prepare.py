"""Corpus preparation: read -> non-blank -> tokenize -> vocabulary -> encode -> fixed-length sequences.

Spark form of the ingest/tokenize/save job: the only shuffle is the token
count of the vocabulary, which is stored once and sent to the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import nonblank_col, tokens_col
from ..operators.sequence import label_mask, to_sequences
from ..operators.vocab import EOS_ID, build_vocab, encode
from ..session import bound_batches


DEFAULT_VOCAB_SIZE = 151_936


@dataclass(frozen=True)
class PrepConfig:
    vocab_size: int = DEFAULT_VOCAB_SIZE
    max_length: int = 2048
    pad_id: int | None = None  # None -> eos (P9)
    eos_id: int = EOS_ID


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` hashed by ``key`` into as many partitions as the session's ``spark.tokenloom.partitions`` names.

    For sources in fewer splits than the cluster has cores; without the
    setting rows stay where they are read.
    """
    parts = df.sparkSession.conf.get("spark.tokenloom.partitions", None)
    return df.repartition(int(parts), key) if parts else df


def documents(spark: SparkSession, sf_dir: str, cols=("doc_id", "text", "lang", "source")) -> DataFrame:
    """Non-blank documents (P2); the text is kept unstripped."""
    return spread(table(spark, sf_dir, "documents").select(*cols).where(nonblank_col("text")), "doc_id")


TOKENIZE_BYTES = 1 << 20  # texts handed to a user's tokenizer at once


def tokenized(docs: DataFrame, keep=("doc_id",), tokenizer=None) -> DataFrame:
    """P4 (+P3): (keep..., tokens); ``tokenizer`` (U1) maps a pandas Series of texts to one of token lists.

    The tokenizer gets about TOKENIZE_BYTES of texts at a time, whose tokens leave Python's
    objects before the next ones are made.
    """
    if tokenizer is None:
        return docs.select(*keep, tokens_col("text").alias("tokens"))

    def run(texts: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(ends // TOKENIZE_BYTES)) + 1).tolist(), len(texts)]
        made = [pa.array([], pa.list_(pa.string()))]
        for start, end in zip(cuts, cuts[1:]):
            if start < end:
                made.append(_token_lists(tokenizer(texts.slice(start, end - start).to_pandas()), end - start))
        return pa.concat_arrays(made)

    bound_batches(docs.sparkSession)
    return docs.select(*keep, F.arrow_udf(run, "array<string>")("text").alias("tokens"))


def _token_lists(lists: pd.Series, rows: int) -> pa.Array:
    if len(lists) != rows:
        raise ValueError(f"the tokenizer returned {len(lists)} rows for {rows}")
    return pa.Array.from_pandas(pd.Series(lists), type=pa.list_(pa.string()))


def prepare(docs: DataFrame, cfg: PrepConfig = PrepConfig(), keep=("doc_id",), tokenizer=None):
    """Full preparation: returns (vocab, ids, seqs).

    ``ids`` = (doc_id, ids) truncated to ``max_length``; ``seqs`` =
    (doc_id, input_ids, attention_mask, labels).
    """
    toks = tokenized(docs, keep, tokenizer)
    vocab = build_vocab(toks, cfg.vocab_size)
    ids = encode(toks, vocab, max_length=cfg.max_length, keep=tuple(k for k in keep if k != "doc_id"))
    seqs = label_mask(to_sequences(ids, cfg.max_length, cfg.pad_id, cfg.eos_id, keep=tuple(keep)))
    return vocab, ids, seqs


def prepared_sequences(spark: SparkSession, sf_dir: str, cfg: PrepConfig = PrepConfig()) -> DataFrame:
    """Flagship query: (doc_id, input_ids, attention_mask, labels) for every non-blank document."""
    _, _, seqs = prepare(documents(spark, sf_dir, ("doc_id", "text")), cfg)
    return seqs
