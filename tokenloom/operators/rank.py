"""Exact global rank without a single-task window (W6) and epoch shuffle (O1).

The order key is split into buckets by a monotone function of the key
(for hashed keys: the leading hex digits of an md5, so buckets are even
by construction).  Per-bucket counts form a table whose size is bounded
by the bucket count; a running sum over that table gives each bucket's
offset, and a ``row_number`` inside each bucket finishes the rank.  The
only shuffle of the data is the one that clusters it by bucket.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(*parts) -> Column:
    """Deterministic order key: md5 of ``part1:part2:...``."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def md5_bucket(key: Column | str, prefix_len: int = 4) -> Column:
    """Monotone bucket of an md5 hex key: its first ``prefix_len`` hex digits."""
    c = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(c, 1, int(prefix_len)), 16, 10).cast("int")


def global_rank(df: DataFrame, key: str, tie: str, bucket: Column | None = None,
                partition_cols: tuple = (), rank_col: str = "rank",
                total_col: str | None = "n_rows", prefix_len: int = 4) -> DataFrame:
    """Add ``rank_col`` = 0-based position of each row in order (key, tie).

    With ``partition_cols`` the rank restarts per group.  ``bucket`` must
    be a non-decreasing function of ``key`` (default: the first
    ``prefix_len`` hex digits of an md5 key, 16**4 = 65,536 even buckets:
    about 150k rows per bucket at 10**10 rows, and an offsets table of at
    most 65,536 rows); ``total_col`` (optional) carries the group's row
    count along.
    """
    parts = list(partition_cols)
    b = bucket if bucket is not None else md5_bucket(key, prefix_len)
    with_b = df.withColumn("_b", b)
    counts = with_b.groupBy(*parts, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    run = Window.partitionBy(*parts).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select(*parts, "_b", (F.sum("_bn").over(run) - F.col("_bn")).alias("_off"),
                            F.sum("_bn").over(Window.partitionBy(*parts)).alias("_total"))
    # The join clusters the data by (parts, bucket); the window below
    # reuses that clustering instead of shuffling again.
    joined = with_b.join(offsets, parts + ["_b"])
    within = Window.partitionBy(*parts, "_b").orderBy(F.col(key), F.col(tie))
    out = joined.withColumn(rank_col, (F.col("_off") + F.row_number().over(within) - F.lit(1)).cast("long"))
    if total_col:
        out = out.withColumnRenamed("_total", total_col)
    else:
        out = out.drop("_total")
    return out.drop("_b", "_off", "_bn")


def epoch_shuffle(df: DataFrame, seed: int, epoch: int, id_col: str = "doc_id",
                  partition_cols: tuple = (), rank_col: str = "rank",
                  total_col: str | None = "n_rows") -> DataFrame:
    """O1: a fresh reproducible permutation per (seed, epoch); ties by id."""
    keyed = df.withColumn("_k", hash_key(seed, epoch, F.col(id_col)))
    return global_rank(keyed, "_k", id_col, partition_cols=partition_cols, rank_col=rank_col,
                       total_col=total_col).drop("_k")


FEISTEL_ROUNDS = 8
WALK_STEPS = 64  # each leaves the domain with a chance under 1/2; a row that never came back would raise


def feistel_keys(seed: int, epoch: int, n: int) -> tuple[int, int, list[int]]:
    """(high bits, low bits, round keys) of the permutation of 0 .. n - 1; a key's bit 31 and up hold its round."""
    bits = max(2, (int(n) - 1).bit_length())
    if bits > 48:
        raise ValueError("a permutation of at most 2**48 rows")
    keys = [int(hashlib.md5(f"{seed}:{epoch}:{r}".encode()).hexdigest()[:7], 16) for r in range(FEISTEL_ROUNDS)]
    return bits - bits // 2, bits // 2, [(r << 31) | k for r, k in enumerate(keys)]


def permuted_index(index: Column | str, n: int, seed: int, epoch: int) -> Column:
    """O1 as arithmetic: the place of row ``index`` (0 .. n - 1) in the order of an epoch.

    A keyed Feistel network permutes the numbers below the next power of
    two, and a place beyond the rows is permuted again until it is one of them
    (cycle walking).  The result is a permutation of 0 .. n - 1 that needs no
    sort, no shuffle and no table; another epoch is another column.
    """
    high, low, keys = feistel_keys(seed, epoch, n)
    rounds = F.array(*[F.lit(k).cast("bigint") for k in keys])

    def mixed(half: Column, key: Column, bits: int) -> Column:
        m = F.lit(2147483647).cast("bigint")
        v = (half * F.lit(1103515245) + key.bitwiseAND(m)) % m * F.lit(48271) % m
        return F.shiftright(v, 7).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))

    def step(x: Column) -> Column:
        return F.aggregate(rounds, x, lambda v, k: F.when(
            F.shiftright(k, 31) % 2 == 0,
            v.bitwiseXOR(mixed(F.shiftright(v, low), k, low))).otherwise(
            v.bitwiseXOR(F.shiftleft(mixed(v.bitwiseAND(F.lit((1 << low) - 1).cast("bigint")), k, high), low))))

    x = (F.col(index) if isinstance(index, str) else index).cast("bigint")
    size = F.lit(int(n)).cast("bigint")
    place = F.aggregate(F.sequence(F.lit(2), F.lit(WALK_STEPS)), step(x),
                        lambda v, _: F.when(v < size, v).otherwise(step(v)))
    return F.when(place < size, place).otherwise(F.raise_error(F.lit("no place found for a row")).cast("bigint"))
