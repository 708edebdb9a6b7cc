"""Vector tables: RMS normalisation, id gather, blocked dot-product top-k.

``dot_scores_topk`` cuts both sides into a grid of cells of bounded size;
numpy scores a cell's blocks, skips those that no query can need, and only
each query's best k leave the task.  No pair row is ever materialised.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mathx import rms_normalize_col
from .decode import softmax, top_k
from .joins import fits_broadcast, salted_join


def rms_normalize(vectors: DataFrame, col: str = "embedding", eps: float = 1e-6,
                  weight: list[float] | None = None) -> DataFrame:
    """V1: x / sqrt(mean(x^2) + eps) (times ``weight``), row-local."""
    return vectors.withColumn(col, rms_normalize_col(col, eps, weight))


GATHER_BYTES = 16 * 1024 * 1024  # as text, which is more than in memory


def gather(ids: DataFrame, vectors: DataFrame, id_col: str = "id", key: str = "vec_id", salts: int = 16) -> DataFrame:
    """Every id with its vector row; ``found`` is false (and the vector null) where there is none.

    Vectors that are measured under GATHER_BYTES are sent to the tasks, and ids are not shuffled.
    """
    v = vectors.withColumnRenamed(key, id_col).withColumn("found", F.lit(True))
    small = fits_broadcast(v, GATHER_BYTES)
    joined = ids.join(F.broadcast(v), id_col, "left") if small else salted_join(ids, v, id_col, "left", salts)
    return joined.withColumn("found", F.coalesce("found", F.lit(False)))


SCORES = "query long, token long, score double"


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """The k highest scores of each row, ties by id."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    first = np.searchsorted(rows, rows)  # where each row's candidates begin
    near = np.arange(len(rows)) - first < k
    return rows[near], ids[near], scores[near]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column as they are stored: no copy but that of joining its chunks."""
    vectors = column.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _score_cell(k: int, block_rows: int):
    """Queries and vectors of one cell of the grid -> the best k of its vectors for each of its queries.

    Vectors are taken by descending norm, a block at a time, and only a block is
    widened to float64: a task holds its cell once, as it is stored.  A query whose
    norm times the block's largest norm stays below its k-th score so far
    needs no further block: no later vector can reach it.
    """
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query": pa.array([], pa.int64()), "token": pa.array([], pa.int64()),
                         "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return none
        ids, table = right.column("token").to_numpy(), _matrix(right.column("vec"))
        norms = np.concatenate([np.sqrt((x * x).sum(axis=1)) for x in (
            table[t:t + block_rows].astype(np.float64) for t in range(0, len(ids), block_rows))])
        order = np.argsort(-norms, kind="stable")
        ids, norms = ids[order], norms[order]
        names, found = left.column("query").to_numpy(), [none]
        for at in range(0, len(names), block_rows):
            q = _matrix(left.column("vec").slice(at, block_rows)).astype(np.float64)
            reach, least = np.sqrt((q * q).sum(axis=1)), np.full(len(q), -np.inf)
            best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            for t in range(0, len(ids), block_rows):
                # a little slack: norms and products are rounded differently
                open_ = np.flatnonzero(reach * norms[t] * (1 + 1e-9) >= least)
                if not len(open_):
                    break
                s = q[open_] @ table[order[t:t + block_rows]].astype(np.float64).T
                # all that reach the k-th score: ties at the cut go on to the comparison by id
                cut = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(open_), -np.inf)
                r, c = np.nonzero(s >= np.maximum(cut, least[open_])[:, None])
                best = _best(*(np.concatenate(x) for x in zip(best, (open_[r], ids[t + c], s[r, c]))), k)
                full = np.bincount(best[0], minlength=len(q)) >= k
                last = np.searchsorted(best[0], np.flatnonzero(full), side="right") - 1
                least[full] = best[2][last]
            found.append(pa.table({"query": names[at:at + block_rows][best[0]], "token": best[1], "score": best[2]},
                                  schema=none.schema))
        return pa.concat_tables(found)
    return run


def dot_scores_topk(queries: DataFrame, vectors: DataFrame, k: int, q_key: str = "vec_id",
                    v_key: str = "vec_id", col: str = "embedding", block_rows: int = 1024,
                    cell_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """J5 + W2: (query, token, score) -- the k highest inner products per query.

    Ties by token id.  Scores are computed in float64.  Both sides are cut
    by id hash into parts of about ``cell_bytes``, and each pair of parts is
    one cell of a grid: a query row goes to a row of cells, a vector row to a
    column, no vector pair is ever a row, and nothing passes through the
    driver.  A cell leaves at most k rows a query, which are merged.
    Null vectors take no part.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = vectors.sparkSession
    q = queries.where(F.col(col).isNotNull()).select(F.col(q_key).cast("long").alias("query"), F.col(col).alias("vec"))
    v = vectors.where(F.col(col).isNotNull()).select(F.col(v_key).cast("long").alias("token"), F.col(col).alias("vec"))

    def parts(df: DataFrame) -> int:
        size = df.agg(F.coalesce(F.sum(F.size("vec") + F.lit(2)), F.lit(0)).alias("n")).first()["n"] * 8
        return max(1, math.ceil(size / cell_bytes))

    down = parts(v)
    across = max(parts(q), math.ceil(spark.sparkContext.defaultParallelism / down))  # a cell for every core
    q = (q.withColumn("_g", F.pmod(F.xxhash64("query"), F.lit(across)))
         .withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))))
    v = (v.withColumn("_h", F.pmod(F.xxhash64("token"), F.lit(down)).cast("int"))
         .withColumn("_g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(across - 1).cast("bigint")))))
    found = (q.groupBy("_g", "_h").cogroup(v.groupBy("_g", "_h"))
             .applyInArrow(_score_cell(int(k), int(block_rows)), SCORES))
    return top_k(found, int(k), ctx="query", score="score", token="token") if down > 1 else found


def dot_softmax_topk(queries: DataFrame, vectors: DataFrame, k: int, **kw) -> DataFrame:
    """J5 + W2 + W1: top-k scores per query and their softmax."""
    return softmax(dot_scores_topk(queries, vectors, k, **kw), ctx="query", score="score", out="prob")
