"""V1, J2, J5, U1, U2."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tokenloom.operators.udf import map_batches, score_batches
from tokenloom.operators.vectors import _score_cell, dot_scores_topk, gather, rms_normalize

from conftest import SF001


def test_rms_normalize(spark):
    df = spark.createDataFrame([(0, [3.0, 4.0])], "vec_id long, embedding array<float>")
    x = rms_normalize(df).first().embedding
    inv = 1 / np.sqrt((9 + 16) / 2 + 1e-6)
    assert np.allclose(x, [3 * inv, 4 * inv])


def test_dot_topk_matches_numpy_across_blocks(spark):
    e = spark.read.parquet(SF001 + "/embeddings.parquet").select("vec_id", "embedding")
    got = dot_scores_topk(e, e, 3, block_rows=16, cell_bytes=50_000).collect()  # many blocks, several cells
    whole = dot_scores_topk(e, e, 3).collect()
    assert {(r.query, r.token) for r in got} == {(r.query, r.token) for r in whole}
    pdf = e.toPandas()
    M = np.stack(pdf.embedding.map(lambda v: np.asarray(v, dtype=np.float64)))
    ids = pdf.vec_id.to_numpy()
    S = M @ M.T
    want = set()
    for i, q in enumerate(ids):
        order = sorted(range(len(ids)), key=lambda j: (-S[i, j], ids[j]))[:3]
        want |= {(int(q), int(ids[j])) for j in order}
    assert {(r.query, r.token) for r in got} == want


def test_dot_topk_ties_nulls_and_empty_tables(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(9, 0, -1)] + [(0, None)], "vec_id long, embedding array<float>")
    got = sorted((r.query, r.token) for r in dot_scores_topk(v.where("vec_id < 3"), v, 2, block_rows=4).collect())
    assert got == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert dot_scores_topk(v, v.limit(0), 2).count() == 0 and dot_scores_topk(v.limit(0), v, 2).count() == 0


def test_dot_topk_skips_blocks_and_not_results(spark):
    """Vectors of very different lengths: most blocks are skipped, the best stay the best."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=(400, 6)) * (10.0 ** -rng.integers(0, 6, 400))[:, None]
    m[5] = 0.0
    e = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "vec_id long, embedding array<double>")
    got = {(r.query, r.token) for r in dot_scores_topk(e, e, 4, block_rows=8, cell_bytes=9_000).collect()}
    s = m @ m.T
    assert got == {(i, j) for i in range(400) for j in sorted(range(400), key=lambda j: (-s[i, j], j))[:4]}


def test_gather_keeps_and_flags_ids_without_a_vector(spark):
    ids = spark.createDataFrame([(0, 1), (0, 10**9)], "doc_id long, id long")
    e = spark.read.parquet(SF001 + "/embeddings.parquet").select("vec_id", "label")
    g = {r.id: (r.found, r.label is None) for r in gather(ids, e).collect()}
    assert g == {1: (True, False), 10**9: (False, True)}


def test_map_batches_keeps_ids(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, "c")], "doc_id long, text string")
    out = map_batches(df, lambda p: pd.DataFrame({"n": p.text.str.len().astype("int64")}), "doc_id long, n long",
                      keep=("doc_id",))
    assert sorted(tuple(r) for r in out.collect()) == [(1, 3), (2, 1)]


def test_score_batches_loads_once_per_task(spark):
    df = spark.range(100).select(F.col("id").alias("doc_id")).repartition(2)

    def load():
        state = {"loads": 1}

        def score(pdf):
            return pd.DataFrame({"doc_id": pdf.doc_id, "loads": state["loads"]})
        return score

    out = score_batches(df, load, "doc_id long, loads long").collect()
    assert len(out) == 100 and {r.loads for r in out} == {1}


def test_gather_of_a_small_table_does_not_shuffle_the_ids(spark):
    ids = spark.range(1000).selectExpr("id AS doc_id", "int(id % 5) AS id")
    e = spark.read.parquet(SF001 + "/embeddings.parquet").select("vec_id", "label")
    small = gather(ids, e)
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "explode" not in plan
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, ids.join(
        e.selectExpr("int(vec_id) AS id", "label", "true AS found"), "id", "left").fillna(False, ["found"]).select(small.columns).collect()))


def test_a_cell_is_not_widened_whole():
    """Scores of a cell in float64, from vectors that stay as they are stored."""
    rng = np.random.default_rng(5)
    m = rng.normal(size=(60_000, 64)).astype(np.float32)
    flat = pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), 64).cast(pa.list_(pa.float32()))
    right = pa.table({"token": np.arange(len(m)), "vec": flat})
    left = pa.table({"query": np.arange(40), "vec": flat.slice(0, 40)})
    tracemalloc.start()
    out = _score_cell(3, 1024)(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < m.nbytes  # widened and sorted copies of it: 4 times that
    s = m[:40].astype(np.float64) @ m.astype(np.float64).T
    want = [(i, int(j)) for i in range(40) for j in np.lexsort((np.arange(len(m)), -s[i]))[:3]]
    assert sorted(zip(out["query"].to_pylist(), out["token"].to_pylist())) == sorted(want)
