"""Exact split, rank sharding, batching, accumulation groups.

Sizes come from the rank table's carried row count, so every step is a
column expression of one plan: no driver round trip, no global window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rank import global_rank, hash_key


def exact_split(df: DataFrame, frac: float = 0.8, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """B1: adds ``split`` ('train'/'val'), ``idx`` (position in its split), ``split_n``.

    Exactly ``int(frac * N)`` train rows, disjoint and exhaustive, fixed
    by ``seed`` and independent of partitioning (not ``randomSplit``).
    Inside each split, ``idx`` follows the seeded permutation, as the
    subset indices of a seeded random split do.
    """
    keyed = df.withColumn("_k", hash_key(seed, F.col(id_col)))
    ranked = global_rank(keyed, "_k", id_col, rank_col="_r", total_col="_N")
    n_train = F.floor(F.lit(float(frac)) * F.col("_N")).cast("long")
    is_train = F.col("_r") < n_train
    return ranked.select(
        *[c for c in df.columns],
        F.when(is_train, F.lit("train")).otherwise(F.lit("val")).alias("split"),
        F.when(is_train, F.col("_r")).otherwise(F.col("_r") - n_train).alias("idx"),
        F.when(is_train, n_train).otherwise(F.col("_N") - n_train).alias("split_n"),
    )


def split_sizes(split_df: DataFrame) -> DataFrame:
    """A3: rows per split."""
    return split_df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


def shard(df: DataFrame, world: int, idx_col: str = "idx", n_col: str = "split_n") -> DataFrame:
    """B2: distributed-sampler sharding with wrap padding.

    The order (``idx`` 0..N-1) is padded to ceil(N/W)*W by repeating it
    from the start; padded position j goes to rank j % W at slot j // W.
    Each row is repeated at most ceil(W/N) times, via a bounded
    ``sequence`` generator (no join, no shuffle).
    """
    W = int(world)
    n = F.col(n_col)
    total = ((n + F.lit(W - 1)) / F.lit(W)).cast("long") * F.lit(W)
    reps = F.greatest(((total + n - F.lit(1)) / n).cast("long"), F.lit(1))
    ex = df.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), reps - F.lit(1))))
    j = F.col(idx_col) + n * F.col("_k")
    return (ex.where(j < total)
            .withColumn("rank", (j % F.lit(W)).cast("int"))
            .withColumn("pos", (j / F.lit(W)).cast("long"))
            .withColumn("rank_n", (total / F.lit(W)).cast("long"))
            .drop("_k"))


def batch(df: DataFrame, batch_size: int, drop_last: bool, pos_col: str = "pos",
          n_col: str = "rank_n") -> DataFrame:
    """``batch_id`` = pos // B; ``drop_last`` removes the short tail batch."""
    B = int(batch_size)
    out = df.withColumn("batch_id", (F.col(pos_col) / F.lit(B)).cast("long"))
    if drop_last:
        full = (F.col(n_col) / F.lit(B)).cast("long") * F.lit(B)
        out = out.where(F.col(pos_col) < full)
    return out


def update_groups(df: DataFrame, accumulation: int, batch_col: str = "batch_id",
                  n_col: str = "rank_n", batch_size: int | None = None) -> DataFrame:
    """``step`` = batch_id // G + 1; a trailing group of < G batches forms no update.

    The number of batches per rank is ``rank_n // batch_size`` (train
    loader drops the short batch); give ``batch_size`` for that.
    """
    G = int(accumulation)
    out = df.withColumn("step", (F.col(batch_col) / F.lit(G)).cast("long") + F.lit(1))
    if batch_size is not None:
        n_batches = (F.col(n_col) / F.lit(int(batch_size))).cast("long")
        out = out.where(F.col(batch_col) < (n_batches / F.lit(G)).cast("long") * F.lit(G))
    return out


def step_plan(split_df: DataFrame, world: int, batch_size: int, accumulation: int,
              epochs: int = 1, max_steps: int | None = None) -> DataFrame:
    """A4: one row of the training plan from the train split size.

    per-rank samples = ceil(N/W) (sampler pads); batches = samples // B
    (drop_last); updates/epoch = batches // G; total = max_steps or
    updates * epochs.
    """
    W, B, G = int(world), int(batch_size), int(accumulation)
    n = split_df.where(F.col("split") == "train").agg(F.count(F.lit(1)).alias("n_train"))
    per_rank = ((F.col("n_train") + F.lit(W - 1)) / F.lit(W)).cast("long") if W > 1 else F.col("n_train")
    batches = (per_rank / F.lit(B)).cast("long")
    updates = (batches / F.lit(G)).cast("long")
    total = F.lit(int(max_steps)).cast("long") if max_steps else updates * F.lit(int(epochs))
    return n.select("n_train", per_rank.alias("samples_per_rank"), batches.alias("batches_per_epoch"),
                    updates.alias("updates_per_epoch"), total.alias("total_steps"))
