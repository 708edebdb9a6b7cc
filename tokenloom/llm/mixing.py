"""Mixing sources to target weights by subset-sum budget fitting (operator 5).

A document's size is its number of words.  Sources in code-point order weigh
3, 1, 2, 3, 1, 2, ...  Each source gets whole copies of itself while its target
allows, and the rest of the target is fitted by counts of document sizes: every
size first gives the same share of its documents, and a bounded-knapsack
dynamic program over the sizes fills the remaining budget.  Which documents of a size are
taken is a seeded hash order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rank import global_rank
from .storage import Scratch, fresh_name
from .textops import as_bytes

WEIGHTS = (3, 1, 2)
BUDGET = 1.5            # words to take, as a multiple of all words
MOST_COPIES = 2         # no source and no document exceeds this multiple of its size
FIT_WORDS = 200_000     # largest remaining budget that the dynamic program fits
SEED = 17
RANK_DIGITS = 2         # hash digits that split the documents of one size of one source
BATCH_TEXTS = 512


def _count_words(column: pa.Array) -> pa.Array:
    out = []
    for at in range(0, len(column), BATCH_TEXTS):
        out += [len(t.split()) for t in as_bytes(column.slice(at, BATCH_TEXTS))]
    return pa.array(out, pa.int64())


def word_count(text) -> F.Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.arrow_udf(_count_words, "bigint")(text)


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: float, fit_words: int = FIT_WORDS) -> np.ndarray:
    """How many documents of each size to take so that their words come nearest to ``budget`` from below.

    Every size gives the same share first; larger documents then fill most of
    the rest, and the last ``fit_words`` at most are fitted exactly.
    """
    total = int((sizes * counts).sum())
    take = np.zeros(len(sizes), dtype=np.int64)
    left = int(min(max(budget, 0), total))
    if not total or not left:
        return take
    take = np.minimum(counts, (counts * (left / total)).astype(np.int64))
    left -= int((take * sizes).sum())
    while left < 0:  # rounding of the share at very large counts
        i = int(np.argmax(take * sizes))
        take[i] -= 1
        left += int(sizes[i])
    for i in np.argsort(-sizes, kind="stable"):
        if left <= fit_words:
            break
        if sizes[i]:
            more = min(int(counts[i] - take[i]), (left - fit_words) // int(sizes[i]) + 1, left // int(sizes[i]))
            take[i] += more
            left -= more * int(sizes[i])
    left_fit = min(left, fit_words)
    # chunks of 1, 2, 4, ... documents of one size make a 0/1 knapsack
    chunks = []
    for i in np.flatnonzero((sizes > 0) & (sizes <= left_fit) & (counts > take)):
        free, step = min(int(counts[i] - take[i]), left_fit // int(sizes[i])), 1
        while free > 0:
            m = min(step, free)
            chunks.append((int(i), m, m * int(sizes[i])))
            free, step = free - m, step * 2
    first = np.full(left_fit + 1, -1, dtype=np.int32)  # the chunk that first reached each sum
    reached = np.zeros(left_fit + 1, dtype=bool)
    reached[0] = True
    for c, (_, _, words) in enumerate(chunks):
        if reached[left_fit]:
            break
        if words <= left_fit:
            new = ~reached[words:] & reached[:left_fit + 1 - words]
            first[words:][new] = c
            reached[words:] |= new
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, m, words = chunks[first[at]]
        take[i] += m
        at -= words
    return take


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    """Quota per size of one source; its rows are its distinct sizes."""
    rows = rows.sort_values("size")
    sizes, counts = rows["size"].to_numpy(np.int64), rows["docs"].to_numpy(np.int64)
    take = fit_counts(sizes, counts, float(rows["rest"].iloc[0]))
    return pd.DataFrame({"grp": rows["grp"].to_numpy(), "size": sizes, "quota": take})


def _source_targets(sources: DataFrame, scratch: Scratch, weights=WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """(grp, source_size, target): shares of the budget by weight; what lies above a source's limit is
    shared again among the others until none is above."""
    # rank in code-point order: ranges of sources, numbered within each range after the ranges before it
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (sources.repartitionByRange(parts, F.col("source").isNull(), F.col("source"))
              .withColumn("part", F.spark_partition_id()))
    ranged, _ = scratch.store(ranged)
    before = (ranged.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
              .select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("before")))
    within = Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(within) - 1 + F.col("before")) % len(weights)
    weight = F.array(*[F.lit(float(w)) for w in weights])[place.cast("int")]
    table, _ = scratch.store(ranged.join(before, "part").withColumn("weight", weight)
                             .withColumn("limit", F.col("source_size") * float(MOST_COPIES)))
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * budget
    level = 0.0
    while True:
        row = table.agg(F.sum(F.when(F.col("limit") <= F.col("weight") * level, F.col("limit")).otherwise(0.0)),
                        F.sum(F.when(F.col("limit") > F.col("weight") * level, F.col("weight")))).first()
        if not row[1]:
            break
        new = (total - row[0]) / row[1]
        if new <= level:
            break
        level = new
    return table.select("grp", "source_size", F.least(F.col("limit"), F.col("weight") * level).alias("target"))


def mix_sources(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", source: str = "source",
                key: str = "doc_id", seed: int = SEED, weights=WEIGHTS, budget: float = BUDGET) -> tuple[DataFrame, str]:
    """(table of the ``keep`` columns and one more, its name): struct of size, source_size, target, copies, taken.

    One row per input row.  ``copies`` (0, 1 or 2) is how often the mix
    repeats the document, ``taken`` its words in the mix.  A null text has size 0;
    null sources are one source, after all others; equal rows are separate
    documents.  The order that decides within a size is a hash of seed, key and
    text, so reruns agree.  An empty table gives an empty mix.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    name = fresh_name(list(keep), "mix")
    text_col = F.col(text).cast("string")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")),
                              F.xxhash64(text_col).cast("string")))
    group = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    sized, _ = scratch.store(docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(source).cast("string").alias("source"),
        group.alias("grp"), order.alias("key"), F.xxhash64(text_col).alias("tie"), word_count(text_col).alias("size")))
    histogram, _ = scratch.store(sized.groupBy("grp", "source", "size").agg(F.count(F.lit(1)).alias("docs")))
    sources = histogram.groupBy("grp", "source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST_COPIES)), F.floor(
        F.col("target") / F.col("source_size")))).otherwise(F.lit(0)).cast("int")
    targets, _ = scratch.store(_source_targets(sources, scratch, weights, budget).withColumn("whole", whole)
                               .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    quota, _ = scratch.store(
        histogram.join(targets.select("grp", "rest"), "grp").select("grp", "size", "docs", "rest")
        .groupBy("grp").applyInPandas(_fit_source, "grp string, size bigint, quota bigint")
        .join(targets.select("grp", "source_size", "target", "whole"), "grp"))
    # numbered within (source, size), split by hash, so that no size of a source is one task
    ranked = global_rank(sized.drop("source"), "key", "tie", partition_cols=("grp", "size"), total_col=None,
                         prefix_len=RANK_DIGITS)
    copies = F.col("whole") + (F.col("rank") < F.col("quota")).cast("int")
    return (ranked.join(quota, ["grp", "size"])
            .select("row.*", F.struct("size", "source_size", "target", copies.alias("copies"),
                                      (copies * F.col("size")).alias("taken")).alias(name)), name)


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    mix, name = mix_sources(docs)
    return mix.select("doc_id", *[F.col(f"{name}.{c}") for c in ("size", "source_size", "target", "taken", "copies")])
