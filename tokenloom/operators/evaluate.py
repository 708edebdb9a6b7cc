"""Batch evaluation.

Per batch: token-weighted mean loss (what a mean-reduced cross-entropy
returns).  Across batches: the unweighted mean of batch losses, summed
over every rank before dividing (D8), capped per rank, then perplexity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mathx import perplexity_col


def doc_loss_sums(nll: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """(doc_id, nll_sum, n_targets) from ``pair_nll(..., by=(doc_id,))``."""
    return nll.groupBy(doc_col).agg(F.sum(F.col("n") * F.col("nll")).alias("nll_sum"),
                                    F.sum("n").cast("bigint").alias("n_targets"))


def batch_losses(assignment: DataFrame, doc_sums: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """A5 (inner part): (rank, batch_id, loss, n_targets) per batch.

    ``assignment`` is (doc_id, rank, batch_id) -- a document padded in
    twice by the sampler counts twice.  A batch without a single target
    has loss NaN, as a mean over zero elements does.
    """
    j = assignment.select(doc_col, "rank", "batch_id").join(doc_sums, doc_col, "left")
    agg = j.groupBy("rank", "batch_id").agg(F.sum(F.coalesce("nll_sum", F.lit(0.0))).alias("_s"),
                                            F.sum(F.coalesce("n_targets", F.lit(0))).cast("bigint").alias("n_targets"))
    loss = F.when(F.col("n_targets") > 0, F.col("_s") / F.col("n_targets")).otherwise(F.lit(float("nan")))
    return agg.select("rank", "batch_id", loss.alias("loss"), "n_targets")


def evaluate(batch_loss: DataFrame, max_batches: int | None = None) -> DataFrame:
    """One row (loss, perplexity, n_batches).

    At most ``max_batches`` batches per rank (eval_batches x accumulation);
    loss = sum of batch losses / number of batches over all ranks, 0.0 when
    there is none; perplexity = exp(loss) below 100, else +inf.
    """
    b = batch_loss if max_batches is None else batch_loss.where(F.col("batch_id") < F.lit(int(max_batches)))
    agg = b.agg(F.sum("loss").alias("_s"), F.count(F.lit(1)).alias("n_batches"))
    loss = F.when(F.col("n_batches") > 0, F.col("_s") / F.col("n_batches")).otherwise(F.lit(0.0))
    return agg.select(loss.alias("loss"), perplexity_col(loss).alias("perplexity"), "n_batches")


def rank_reduce(batch_loss: DataFrame) -> DataFrame:
    """Per-rank partial (sum, count) then one global sum/sum (not a mean of means)."""
    per_rank = batch_loss.groupBy("rank").agg(F.sum("loss").alias("loss_sum"), F.count(F.lit(1)).alias("n_batches"))
    tot = per_rank.agg(F.sum("loss_sum").alias("_s"), F.sum("n_batches").alias("n_batches"))
    return tot.select(F.when(F.col("n_batches") > 0, F.col("_s") / F.col("n_batches")).otherwise(F.lit(0.0)).alias("loss"),
                      F.col("n_batches").cast("bigint").alias("n_batches"))
