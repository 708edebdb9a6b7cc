"""Vocabulary, encoding and decoding.

Id layout (D5): 0 = ``<eos>`` (also the pad id), 1 = ``<unk>``, then
corpus tokens by count descending, token ascending.  Case-sensitive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bound_batches, cut_lineage
from .rank import global_rank

EOS_ID = 0
UNK_ID = 1
SPECIAL_TOKENS = (("<eos>", EOS_ID), ("<unk>", UNK_ID))


def token_counts(tokens: DataFrame, col: str = "tokens") -> DataFrame:
    """(tok, count) over every token of every row.

    Partial aggregation runs before the shuffle, so a hot token leaves
    each map task as a single row.
    """
    # explode_outer + explicit filter: a plain explode makes Catalyst infer a
    # size(...) > 0 filter that would evaluate the tokenizer regex again.
    return (tokens.select(F.explode_outer(col).alias("tok")).where(F.col("tok").isNotNull())
            .groupBy("tok").agg(F.count(F.lit(1)).alias("count")))


def _largest(counts: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` rows of (tok, count) that come first by count descending, token ascending.

    Counts fall into classes of 64 an octave, so the histogram of classes has a
    few thousand rows at any corpus size.  Classes above the one where
    ``keep`` is reached are taken whole; inside that class rows are ranked by
    buckets of (count, first two bytes of the token), never in one task.
    """
    counts = counts.withColumn("_class", F.floor(F.log2("count") * 64).cast("int"))
    above, edge = 0, None
    for row in counts.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("_class")).collect():
        if above + row["n"] > keep:
            edge = row["_class"]
            break
        above += row["n"]
    if edge is None:
        return counts.drop("_class")
    order = F.concat(F.lpad(F.hex(F.lit(2 ** 62) - F.col("count")), 16, "0"), F.hex(F.encode("tok", "utf-8")))
    ranked = global_rank(counts.where(F.col("_class") == edge).withColumn("_o", order), "_o", "tok",
                         bucket=F.substring("_o", 1, 20), total_col=None, rank_col="_r")
    return (counts.where(F.col("_class") > edge).select("tok", "count")
            .unionByName(ranked.where(F.col("_r") < keep - above).select("tok", "count")))


def build_vocab(tokens: DataFrame, size: int, col: str = "tokens") -> DataFrame:
    """P5: (tok STRING, id INT, count BIGINT), at most ``size`` rows.

    Token counts are stored once and cut to the vocabulary (``_largest``);
    ids are assigned over those at most ``size`` rows.  The result is a
    stored table, so that no reader counts the corpus again.
    """
    keep = int(size) - len(SPECIAL_TOKENS)
    if keep < 0:
        raise ValueError("vocabulary size must cover the special tokens")
    top = _largest(cut_lineage(token_counts(tokens, col)), keep)
    # Window over <= size rows: one partition is bounded by the parameter.
    ranked = top.select("tok", (F.row_number().over(Window.orderBy(F.desc("count"), F.asc("tok")))
                                + F.lit(len(SPECIAL_TOKENS) - 1)).cast("int").alias("id"),
                        F.col("count").cast("bigint").alias("count"))
    specials = tokens.sparkSession.createDataFrame([(t, i, 0) for t, i in SPECIAL_TOKENS],
                                                   "tok string, id int, count bigint")
    return cut_lineage(specials.unionByName(ranked))


def _send(vocab: DataFrame):
    """(tokens, ids) of a vocabulary, sent to every task; its rows are bounded by the vocabulary size."""
    bound_batches(vocab.sparkSession)
    table = vocab.select("tok", F.col("id").cast("int").alias("id")).toArrow()
    return vocab.sparkSession.sparkContext.broadcast(tuple(c.combine_chunks() for c in table.columns))


def _list_like(lists: pa.Array, values: pa.Array) -> pa.Array:
    """``values`` in lists of the lengths of ``lists``; a null list is empty."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def encode(tokens: DataFrame, vocab: DataFrame, max_length: int | None = None,
           col: str = "tokens", id_col: str = "doc_id", unk_id: int = UNK_ID, keep: tuple = ()) -> DataFrame:
    """P6 (+P7 first): (id_col, keep..., ids ARRAY<INT>) with unknown tokens -> ``unk_id``.

    Tokens never leave their row: a dictionary lookup over each Arrow batch
    maps them, so there is no shuffle and no hot token.  Truncation comes
    before the lookup (word -> id is 1:1).  Null tokens are unknown, a null
    array is empty.
    """
    toks = F.col(col) if max_length is None else F.slice(F.col(col), 1, int(max_length))
    sent = _send(vocab)

    def run(lists: pa.Array) -> pa.Array:
        words, ids = sent.value
        found = pc.take(ids, pc.index_in(lists.flatten(), value_set=words))
        return _list_like(lists, pc.fill_null(found, unk_id))

    return tokens.select(id_col, *keep, F.arrow_udf(run, "array<int>")(toks).alias("ids"))


def detokenize(ids: DataFrame, vocab: DataFrame, col: str = "ids", id_col: str = "doc_id",
               skip_special: bool = True, sep: str = " ") -> DataFrame:
    """Ids -> text (tokens joined by ``sep``); ``<eos>``/pad is skipped, ``<unk>`` stays visible.

    Ids that the vocabulary lacks are skipped too.
    """
    sent = _send(vocab)

    def run(lists: pa.Array) -> pa.Array:
        words, known = sent.value
        return _list_like(lists, pc.take(words, pc.index_in(lists.flatten(), value_set=known)))

    chosen = F.filter(F.col(col), lambda i: i != EOS_ID) if skip_special else F.col(col)
    words = F.arrow_udf(run, "array<string>")(chosen.cast("array<int>"))
    return ids.select(id_col, F.array_join(words, sep).alias("text"))
