"""Training-data plan: split -> epoch shuffle -> rank shards -> batches -> updates,
and the evaluation of a next-token table on the held-out split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import batch_losses, doc_loss_sums, evaluate
from ..operators.ngram import counted_pairs, fit_bigram, id_pairs, pair_nll
from ..operators.rank import epoch_shuffle
from ..operators.split import batch, exact_split, shard, update_groups


@dataclass(frozen=True)
class TrainConfig:
    seed: int = 42
    frac: float = 0.8
    world: int = 2
    batch_size: int = 8
    accumulation: int = 8
    eval_batches: int = 30
    sampler_seed: int = 0  # a distributed sampler's own default seed


def split_table(seqs: DataFrame, cfg: TrainConfig = TrainConfig()) -> DataFrame:
    """B1 on the (doc_id, ...) table."""
    return exact_split(seqs, cfg.frac, cfg.seed)


def train_order(split: DataFrame, epoch: int, cfg: TrainConfig = TrainConfig()) -> DataFrame:
    """O1 inside the train split: (doc_id, idx, split_n) in this epoch's order."""
    train = split.where(F.col("split") == "train").select("doc_id")
    ranked = epoch_shuffle(train, cfg.sampler_seed, epoch, "doc_id", rank_col="idx", total_col="split_n")
    return ranked


def train_batches(split: DataFrame, epoch: int = 0, cfg: TrainConfig = TrainConfig()) -> DataFrame:
    """B2 + B3 (drop_last) + B4: (doc_id, rank, pos, batch_id, step)."""
    order = train_order(split, epoch, cfg)
    sh = shard(order, cfg.world)
    b = batch(sh, cfg.batch_size, drop_last=True)
    return update_groups(b, cfg.accumulation, batch_size=cfg.batch_size)


def val_batches(split: DataFrame, cfg: TrainConfig = TrainConfig()) -> DataFrame:
    """B2 + B3 on the validation split, unshuffled, keeping the short tail."""
    val = split.where(F.col("split") == "val").select("doc_id", "idx", "split_n")
    return batch(shard(val, cfg.world), cfg.batch_size, drop_last=False)


def fit_on_train(ids: DataFrame, split: DataFrame, eos_id: int | None = None) -> DataFrame:
    """L1 on the train split's id sequences (truncated, unpadded)."""
    train_ids = ids.join(split.where(F.col("split") == "train").select("doc_id"), "doc_id", "left_semi")
    return fit_bigram(id_pairs(train_ids, eos_id=eos_id))


def val_pairs(seqs: DataFrame, split: DataFrame) -> DataFrame:
    """P13/P14 pairs of the validation documents, counted in their rows."""
    v = seqs.join(split.where(F.col("split") == "val").select("doc_id"), "doc_id", "left_semi")
    return counted_pairs(v)


def evaluate_split(seqs: DataFrame, split: DataFrame, model: DataFrame, alpha: float, vocab_size: int,
                   cfg: TrainConfig = TrainConfig()) -> DataFrame:
    """L3: capped batch-mean loss and perplexity on the validation split."""
    nll = pair_nll(val_pairs(seqs, split), model, alpha, vocab_size, by=("doc_id",))
    losses = batch_losses(val_batches(split, cfg), doc_loss_sums(nll))
    return evaluate(losses, cfg.eval_batches * cfg.accumulation)
