"""Array column expressions for fixed-length sequences.

Each is a built-in higher-order or array function evaluated per row;
nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE_INDEX = -100


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def truncate_col(ids: Column | str, max_length: int) -> Column:
    """First ``max_length`` elements."""
    return F.slice(_c(ids), 1, int(max_length))


def pad_col(ids: Column | str, max_length: int, pad_id: int) -> Column:
    """Right-pad (already truncated) ids with ``pad_id`` to ``max_length``."""
    c = _c(ids)
    fill = F.greatest(F.lit(int(max_length)) - F.size(c), F.lit(0))
    return F.concat(c, F.array_repeat(F.lit(int(pad_id)), fill))


def mask_col(ids: Column | str, max_length: int) -> Column:
    """P10: 1 for each real token, 0 for each pad slot -- from length only."""
    k = F.least(F.size(_c(ids)), F.lit(int(max_length)))
    return F.concat(F.array_repeat(F.lit(1), k),
                    F.array_repeat(F.lit(0), F.lit(int(max_length)) - k))


def labels_col(input_ids: Column | str, attention_mask: Column | str,
               ignore_index: int = IGNORE_INDEX) -> Column:
    """labels = ids, ``ignore_index`` where the mask is 0."""
    return F.zip_with(_c(input_ids), _c(attention_mask),
                      lambda i, m: F.when(m == 0, F.lit(ignore_index)).otherwise(i))


def append_col(ids: Column | str, token: Column | str) -> Column:
    """Sequence ++ [token]."""
    return F.concat(_c(ids), F.array(_c(token)))


def shifted_pairs_col(input_ids: Column | str, labels: Column | str) -> Column:
    """ARRAY<STRUCT<ctx, target>> pairing position t with label t+1.

    Built from two slices of the same row, so the causal shift needs no
    window and no shuffle.
    """
    a, b = _c(input_ids), _c(labels)
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.arrays_zip(F.slice(a, 1, n).alias("ctx"), F.slice(b, 2, n).alias("target"))


def consecutive_pairs_col(ids: Column | str, eos_id: int | None = None) -> Column:
    """Adjacent (ctx, target) pairs of a token-id array; optional end marker."""
    a = _c(ids)
    if eos_id is not None:
        a = F.concat(a, F.array(F.lit(int(eos_id))))
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.arrays_zip(F.slice(a, 1, n).alias("ctx"), F.slice(a, 2, n).alias("target"))
