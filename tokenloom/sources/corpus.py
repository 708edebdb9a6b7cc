"""Corpus sources.

``read_corpus`` reads JSONL or a columnar directory with an explicit
schema; ``ingest_bounded`` keeps exactly the first N rows of a source by
a key without a single-task global sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import nonblank_col, text_fallback_col
from ..operators.rank import global_rank, hash_key
from .lines import SPLIT_BYTES, read_lines

JSONL_SCHEMA = "text string, content string"
PRETOKENIZED_COLUMNS = ("input_ids", "attention_mask")
ROWS_PER_SHARD = 10_000


def source_kind(spark: SparkSession, path: str) -> str:
    """S4: 'pretokenized' or 'text', from the path and the schema only (no job).

    A ``.pt`` file or a directory holding ``tokenized_data.pt`` is the
    reference's tensor format, which cannot be read here (see README).
    """
    if path.endswith(".pt") or _exists(spark, f"{path.rstrip('/')}/tokenized_data.pt"):
        return "tensor"
    if path.endswith(".jsonl") or path.endswith(".json"):
        return "text"
    cols = spark.read.parquet(path).columns
    return "pretokenized" if "input_ids" in cols else "text"


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on the file system that it names (shared or object store)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def input_bytes(df: DataFrame) -> int:
    """Stored bytes of the files that ``df`` reads, from their file systems (no job)."""
    spark = df.sparkSession
    conf, paths = spark._jsc.hadoopConfiguration(), [spark._jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def read_corpus(spark: SparkSession, path: str, fmt: str | None = None,
                id_col: str = "doc_id", drop_blank: bool = True, ids: str = "content",
                split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """S1/S2 + P1 + P2: (doc_id, text, ...) from JSONL or Parquet.

    JSONL is read with an explicit schema in FAILFAST mode, so a malformed
    line fails the read instead of becoming an empty row (D1).  ``text``
    falls back to ``content`` and then to ''.  Blank rows (Python
    ``strip()`` semantics) are dropped unless ``drop_blank`` is False;
    the kept text is not stripped.  Rows without an id get one from their
    content (``_with_content_ids``), which shuffles them; with ``ids='place'`` a JSON line
    gets it from its file and offset (``read_lines``), which shuffles nothing, and
    rows of other formats keep theirs.
    """
    fmt = fmt or ("json" if path.endswith((".jsonl", ".json")) else "parquet")
    if fmt == "json" and ids == "place" and id_col is not None:
        row = F.from_json("line", f"{id_col} bigint, {JSONL_SCHEMA}", {"mode": "FAILFAST"})
        raw = read_lines(spark, path, split_bytes).select("number", row.alias("_j"))
        df = raw.select(F.coalesce(F.col("_j")[id_col], F.col("number")).alias(id_col),
                        F.coalesce("_j.text", "_j.content", F.lit("")).alias("text"))
        return df.where(nonblank_col("text")) if drop_blank else df
    if fmt == "json":
        schema = JSONL_SCHEMA if id_col is None else f"{id_col} bigint, {JSONL_SCHEMA}"
        raw = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    else:
        raw = spark.read.parquet(path)
    cols = raw.columns
    keep = [c for c in cols if c not in ("text", "content")]
    df = raw.select(*keep, text_fallback_col(cols).alias("text"))
    if id_col is not None:
        if id_col not in df.columns:
            df = _with_content_ids(df, id_col)
        elif not df.where(F.col(id_col).isNull()).isEmpty():
            df = _with_content_ids(df, id_col)
    if drop_blank:
        df = df.where(nonblank_col("text"))
    return df


def _with_content_ids(df: DataFrame, id_col: str) -> DataFrame:
    """Ids for rows without one: a hash of the row, numbered among equal rows.

    Independent of files' splits and of the cluster; equal rows are
    interchangeable, so their numbers are stable as a set.
    """
    others = [F.col(c) for c in df.columns if c != id_col]
    keyed = df.withColumn("_h1", F.xxhash64(*others)).withColumn("_h2", F.xxhash64(*others, F.lit(1)))
    nth = F.row_number().over(Window.partitionBy("_h1", "_h2").orderBy("_h1"))
    made = F.xxhash64("_h1", "_h2", nth)
    given = F.col(id_col) if id_col in df.columns else F.lit(None).cast("bigint")
    return keyed.withColumn(id_col, F.coalesce(given, made)).drop("_h1", "_h2")


def read_tokenized(spark: SparkSession, path: str, keep=("doc_id",)) -> DataFrame:
    """S3: only the token columns (plus ids we keep), pruned at the scan."""
    df = spark.read.parquet(path)
    cols = [c for c in keep if c in df.columns] + list(PRETOKENIZED_COLUMNS)
    if "labels" in df.columns:
        cols.append("labels")
    return df.select(*cols)


def nth_smallest(df: DataFrame, key: str, n: int, rel_err: float = 1e-4, sort_rows: int = 10_000):
    """Exact value of the n-th smallest numeric ``key`` (1-based); the largest if there are fewer rows.

    Passes over the key column narrow an interval that holds the answer:
    quantiles propose two bounds, exact counts tell which side of them the
    answer is on.  A round leaves about 6 * rel_err of the rows; at most
    ``sort_rows`` are sorted in the end.  None without rows or for n <= 0.
    """
    k = F.col("k")
    keys = df.select(F.col(key).alias("k")).where(k.isNotNull())
    total = keys.count()
    if n <= 0 or total == 0:
        return None
    n = min(n, total)
    while total > sort_rows:
        lo, hi = keys.approxQuantile("k", [max(0.0, n / total - 3 * rel_err), min(1.0, n / total + 3 * rel_err)], rel_err)
        below, to_lo, below_hi, to_hi = keys.agg(*[
            F.count(F.when(c, 1)) for c in (k < lo, k <= lo, k < hi, k <= hi)]).first()
        if below < n <= to_lo:
            return keys.where(k == lo).first()[0]
        if below_hi < n <= to_hi:
            return keys.where(k == hi).first()[0]
        if n <= below:
            keys, total = keys.where(k < lo), below
        elif n <= below_hi:
            keys, total, n = keys.where((k > lo) & (k < hi)), below_hi - to_lo, n - to_lo
        else:
            keys, total, n = keys.where(k > hi), total - to_hi, n - to_hi
    return keys.orderBy("k").limit(n).agg(F.max("k")).first()[0]


RADIX_DIGITS = 4  # hex digits a round: at most 65,537 counts reach the driver


def _digits(df: DataFrame, key: str):
    """An order-preserving hex form of a string, binary, integer, date or timestamp column; None for other types."""
    kind, k = dict(df.dtypes)[key], F.col(key)
    if kind == "string":
        return F.hex(F.encode(k, "utf-8"))
    if kind == "binary":
        return F.hex(k)
    if kind in ("date", "timestamp", "timestamp_ntz"):
        k = F.unix_date(k) if kind == "date" else F.unix_micros(k.cast("timestamp"))
    elif kind not in ("tinyint", "smallint", "int", "bigint"):
        return None
    # hex() prints two's complement; with the sign bit turned, its order is that of the numbers
    return F.lpad(F.hex(k.cast("bigint").bitwiseXOR(F.lit(-2 ** 63).cast("bigint"))), 16, "0")


def nth_key(df: DataFrame, key: str, n: int, sort_rows: int = 10_000):
    """Value of the n-th smallest non-null ``key`` (1-based, n at most their number), by radix selection.

    Each round counts the next digits of the keys that agree with the
    prefix so far and goes on with the one class that holds the n-th; the
    few keys left in the end are sorted.  Floats and decimals, which have no such
    digits here, go to ``nth_smallest``.
    """
    digits = _digits(df, key)
    if digits is None:
        return nth_smallest(df, key, n, sort_rows=sort_rows)
    keys, at = df.select(F.col(key).alias("k"), digits.alias("d")).where(F.col(key).isNotNull()), 0
    while True:
        part = F.substring("d", at + 1, RADIX_DIGITS)
        for row in keys.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c")).orderBy("p").collect():
            if n <= row["c"]:
                break
            n -= row["c"]
        keys, at = keys.where(part == row["p"]), at + RADIX_DIGITS
        if row["c"] <= sort_rows:
            return keys.orderBy("k").limit(n).agg(F.max("k")).first()[0]
        if len(row["p"]) < RADIX_DIGITS:  # the keys end here, so they are equal
            return keys.first()["k"]


def ingest_bounded(df: DataFrame, num_shards: int, rows_per_shard: int = ROWS_PER_SHARD,
                   order_by: str = "doc_id") -> DataFrame:
    """Exactly the first ``num_shards * rows_per_shard`` rows by ``order_by``, nulls last.

    All rows when the source is shorter.  The cut is a pushed-down range
    filter on the key, so Parquet skips row groups past it and no task
    ever holds the whole prefix.  Rows that share the key at the cut (or have
    none) are ranked by a hash of the row, so exactly the bound is kept.
    """
    n, k = int(num_shards) * int(rows_per_shard), F.col(order_by)
    rows, known = df.agg(F.count(F.lit(1)), F.count(k)).first()
    if n <= 0:
        return df.limit(0)
    if n >= rows:
        return df
    if n >= known:
        head, tied, room = df.where(k.isNotNull()), df.where(k.isNull()), n - known
    else:
        cut = F.lit(nth_key(df, order_by, n))
        head, tied = df.where(k < cut), df.where(k == cut)
        room = n - head.count()
        if tied.limit(room + 1).count() <= room:
            return df.where(k <= cut)
    if not room:
        return head
    key = hash_key(0, F.xxhash64(*df.columns))
    some = global_rank(tied.withColumn("_h", key), "_h", "_h", total_col=None, rank_col="_r")
    return head.unionByName(some.where(F.col("_r") < F.lit(room)).select(*df.columns))
