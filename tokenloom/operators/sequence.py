"""Fixed-length training sequences.

All row-local array expressions: no shuffle, inside whole-stage codegen
where Spark allows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import (IGNORE_INDEX, labels_col, mask_col, pad_col,
                                shifted_pairs_col, truncate_col)
from .vocab import EOS_ID


def resolve_pad(pad_id: int | None, eos_id: int = EOS_ID) -> int:
    """Pad := eos when no pad id is given."""
    return int(eos_id if pad_id is None else pad_id)


def to_sequences(ids: DataFrame, max_length: int, pad_id: int | None = None,
                 eos_id: int = EOS_ID, col: str = "ids", keep: tuple = ("doc_id",)) -> DataFrame:
    """P7 + P8 + P10: (keep..., input_ids, attention_mask), both length ``max_length``.

    The mask comes from the real length, never from ``id == pad``, so a
    real token equal to the pad/eos id keeps mask 1 (D6).
    """
    pad = resolve_pad(pad_id, eos_id)
    t = truncate_col(col, max_length)
    return ids.select(*keep, pad_col(t, max_length, pad).alias("input_ids"),
                      mask_col(t, max_length).alias("attention_mask"))


def whole_sequences(ids: DataFrame, col: str = "ids", keep: tuple = ("doc_id",)) -> DataFrame:
    """(keep..., input_ids, attention_mask) over every id of a row: no cut, no padding, mask 1 throughout."""
    return ids.select(*keep, F.col(col).alias("input_ids"),
                      F.transform(col, lambda _: F.lit(1)).alias("attention_mask"))


def label_mask(seqs: DataFrame, ignore_index: int = IGNORE_INDEX) -> DataFrame:
    """labels = input_ids with ``ignore_index`` where mask = 0; a supplied ``labels`` column wins."""
    if "labels" in seqs.columns:
        return seqs
    return seqs.withColumn("labels", labels_col("input_ids", "attention_mask", ignore_index))


def retruncate(seqs: DataFrame, max_length: int) -> DataFrame:
    """Re-cut stored sequences to ``max_length`` on every array column present."""
    out = seqs
    for c in ("input_ids", "attention_mask", "labels"):
        if c in seqs.columns:
            out = out.withColumn(c, truncate_col(c, max_length))
    return out


def shifted_pairs(seqs: DataFrame, ignore_index: int = IGNORE_INDEX, past_len: int = 0,
                  keep: tuple = ("doc_id",)) -> DataFrame:
    """(keep..., pos, ctx, target) for every position t whose label t+1 is not ignored.

    ``pos`` is the position id of the context token (offset by
    ``past_len``).  Built with array slices and one explode; no window.
    """
    s = label_mask(seqs, ignore_index)
    pairs = s.select(*keep, F.posexplode_outer(shifted_pairs_col("input_ids", "labels")).alias("pos", "p")).where(
        F.col("p").isNotNull())
    return pairs.select(*keep, (F.col("pos") + F.lit(int(past_len))).alias("pos"),
                        F.col("p.ctx").alias("ctx"), F.col("p.target").alias("target")
                        ).where(F.col("target") != F.lit(int(ignore_index)))
