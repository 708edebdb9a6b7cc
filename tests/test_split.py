"""Exact rank, split, shuffle, shards, batches."""

import pytest
from pyspark.sql import functions as F

from tokenloom.operators.rank import epoch_shuffle, global_rank, hash_key
from tokenloom.operators.split import batch, exact_split, shard, split_sizes, step_plan, update_groups


def _ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "doc_id")


@pytest.mark.parametrize("n", [1, 5, 999])
def test_split_exact_sizes_disjoint_exhaustive(spark, n):
    s = exact_split(_ids(spark, n), 0.8, 42)
    sizes = {r.split: r.n_rows for r in split_sizes(s).collect()}
    assert sizes.get("train", 0) == int(0.8 * n)
    assert sizes.get("val", 0) == n - int(0.8 * n)
    rows = s.collect()
    assert sorted(r.doc_id for r in rows) == list(range(n))
    for name in ("train", "val"):
        idx = sorted(r.idx for r in rows if r.split == name)
        assert idx == list(range(len(idx)))


def test_rank_matches_plain_window_and_is_partition_independent(spark):
    df = _ids(spark, 3000).repartition(7).withColumn("k", hash_key(42, F.col("doc_id")))
    got = {r.doc_id: r.rank for r in global_rank(df, "k", "doc_id", prefix_len=2).collect()}
    ref = sorted((r.k, r.doc_id) for r in df.collect())
    assert got == {d: i for i, (_, d) in enumerate(ref)}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = {r.doc_id: r.rank for r in global_rank(df.coalesce(2), "k", "doc_id").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert again == got


def test_epoch_shuffle_changes_per_epoch(spark):
    a = {r.doc_id: r.rank for r in epoch_shuffle(_ids(spark, 50), 0, 0).collect()}
    b = {r.doc_id: r.rank for r in epoch_shuffle(_ids(spark, 50), 0, 1).collect()}
    assert sorted(a.values()) == list(range(50)) and a != b


def _order(spark, n):
    return spark.createDataFrame([(i, i, n) for i in range(n)], "doc_id long, idx long, split_n long")


@pytest.mark.parametrize("n", [1, 3, 7])
def test_shards_wrap_padding(spark, n):
    W = 4
    got = sorted((r.rank, r.pos, r.doc_id) for r in shard(_order(spark, n), W).collect())
    total = -(-n // W) * W
    padded = [j % n for j in range(total)]
    expect = sorted((j % W, j // W, padded[j]) for j in range(total))
    assert got == expect
    per_rank = {}
    for rk, _, _ in got:
        per_rank[rk] = per_rank.get(rk, 0) + 1
    assert set(per_rank.values()) == {total // W}


def test_batches_drop_last_and_update_groups(spark):
    sh = shard(_order(spark, 21), 1)
    train = batch(sh, 4, drop_last=True)
    assert train.count() == 20
    val = batch(sh, 4, drop_last=False)
    assert val.agg(F.max("batch_id")).first()[0] == 5
    ug = update_groups(train, 2, batch_size=4)
    assert sorted({r.step for r in ug.collect()}) == [1, 2]  # batches 0-3; batch 4 is a short group
    few = update_groups(batch(shard(_order(spark, 3), 1), 4, drop_last=True), 8, batch_size=4)
    assert few.count() == 0


def test_step_plan(spark):
    s = exact_split(_ids(spark, 1000), 0.8, 42)
    r = step_plan(s, world=2, batch_size=8, accumulation=8).first()
    assert (r.n_train, r.samples_per_rank, r.batches_per_epoch, r.updates_per_epoch, r.total_steps) == (800, 400, 50, 6, 6)
    r2 = step_plan(s, world=1, batch_size=8, accumulation=8, max_steps=50000).first()
    assert r2.total_steps == 50000


from hypothesis import given, settings, strategies as st  # noqa: E402


@settings(max_examples=12, deadline=None)
@given(st.integers(1, 40), st.integers(1, 6), st.integers(1, 5))
def test_shard_batch_properties(spark, n, world, bsize):
    rows = shard(_order(spark, n), world).collect()
    per_rank = {}
    for r in rows:
        per_rank.setdefault(r.rank, []).append(r.pos)
    assert len(per_rank) == min(world, len(rows)) or len(per_rank) == world
    sizes = {len(v) for v in per_rank.values()}
    assert len(sizes) == 1 and sizes.pop() == -(-n // world)  # equal work, ceil(N/W) each
    assert {r.doc_id for r in rows} == set(range(n))  # union covers every row
    assert all(sorted(v) == list(range(len(v))) for v in per_rank.values())
    kept = batch(shard(_order(spark, n), world), bsize, drop_last=True).collect()
    full = (-(-n // world)) // bsize * bsize
    assert len(kept) == full * world
