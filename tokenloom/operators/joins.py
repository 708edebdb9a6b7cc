"""Join helpers: broadcast only behind a size check, salted shuffle otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import DEFAULT_BROADCAST_LIMIT


def estimated_bytes(df: DataFrame, row_overhead: int = 24) -> int:
    """Measured size of a small, already materialised table (one cheap job).

    Sums the byte length of every column's string form; used only on
    tables whose row count is bounded by a parameter (vocabulary,
    context tables, block summaries).
    """
    parts = [F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in df.columns]
    expr = sum(parts[1:], parts[0]) + F.lit(row_overhead) if parts else F.lit(row_overhead)
    row = df.agg(F.coalesce(F.sum(expr), F.lit(0)).alias("b")).first()
    return int(row["b"])


def fits_broadcast(df: DataFrame, limit_bytes: int = DEFAULT_BROADCAST_LIMIT) -> bool:
    return estimated_bytes(df) <= limit_bytes


def sized_join(big: DataFrame, small: DataFrame, on: list[str] | str, how: str = "inner",
               limit_bytes: int = DEFAULT_BROADCAST_LIMIT, small_fits: bool | None = None) -> DataFrame:
    """Join ``big`` to a stored ``small``: broadcast when measured under ``limit_bytes``, salted otherwise."""
    fits = fits_broadcast(small, limit_bytes) if small_fits is None else small_fits
    return big.join(F.broadcast(small), on, how) if fits else salted_join(big, small, on, how)


def salted_join(big: DataFrame, small: DataFrame, on: list[str] | str, how: str = "inner",
                salts: int = 16) -> DataFrame:
    """Join with every ``small`` row in ``salts`` copies, so a hot key of ``big`` is split over as many tasks.

    Each ``big`` row picks a copy by a hash of its own values
    (deterministic, so task retries agree).  The copies are shuffled and never
    broadcast: Spark's estimate is of one of them, the driver would build them all.
    """
    on = [on] if isinstance(on, str) else list(on)
    salted_small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted_big = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    return salted_big.join(salted_small.hint("merge"), on + ["_salt"], how).drop("_salt")
