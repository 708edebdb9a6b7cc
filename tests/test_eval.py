"""N-gram fit, cross-entropy, batch evaluation, perplexity cap."""

import math

from pyspark.sql import functions as F

from tokenloom.functions.mathx import perplexity_col
from tokenloom.operators.evaluate import batch_losses, evaluate, rank_reduce
from tokenloom.operators.ngram import counted_pairs, cross_entropy, fit_bigram, id_pairs, pair_nll
from tokenloom.operators.sequence import shifted_pairs
from tokenloom.session import cut_lineage


def test_fit_and_in_sample_cross_entropy(spark):
    ids = spark.createDataFrame([(0, [1, 2, 1, 3])], "doc_id long, ids array<int>")
    pairs = id_pairs(ids)
    m = {(r.ctx, r.token): (r["count"], r.ctx_total) for r in fit_bigram(pairs).collect()}
    assert m == {(1, 2): (1, 2), (2, 1): (1, 1), (1, 3): (1, 2)}
    ce = cross_entropy(pairs, fit_bigram(pairs)).first()
    expect = (math.log(2) + 0 + math.log(2)) / 3
    assert abs(ce.loss - expect) < 1e-12 and ce.n_tokens == 3


def test_unseen_pairs_are_smoothed_not_dropped(spark):
    train = id_pairs(spark.createDataFrame([(0, [1, 2])], "doc_id long, ids array<int>"))
    val = id_pairs(spark.createDataFrame([(1, [1, 3, 4])], "doc_id long, ids array<int>"))
    m = fit_bigram(train)
    hard = cross_entropy(val, m).first()
    assert math.isinf(hard.loss) and math.isinf(hard.perplexity)
    soft = cross_entropy(val, m, alpha=1.0, vocab_size=10).first()
    # P(3|1) = 1/(1+10), P(4|3) = 1/10 (unseen context -> uniform)
    expect = (math.log(11) + math.log(10)) / 2
    assert abs(soft.loss - expect) < 1e-12 and soft.n_tokens == 2


def test_evaluate_cap_nan_and_empty(spark):
    assign = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 1, 0), (4, 0, 2)], "doc_id long, rank int, batch_id long")
    sums = spark.createDataFrame([(1, 2.0, 2), (2, 3.0, 1), (3, 1.0, 1)], "doc_id long, nll_sum double, n_targets long")
    bl = batch_losses(assign, sums)
    got = {(r.rank, r.batch_id): r.loss for r in bl.collect()}
    assert got[(0, 0)] == 1.0 and got[(0, 1)] == 3.0 and got[(1, 0)] == 1.0 and math.isnan(got[(0, 2)])
    capped = evaluate(bl, max_batches=2).first()  # per rank: batches 0, 1
    assert abs(capped.loss - 5.0 / 3) < 1e-12 and capped.n_batches == 3
    nan = evaluate(bl).first()
    assert math.isnan(nan.loss) and math.isinf(nan.perplexity)
    empty = evaluate(bl.where("false")).first()
    assert empty.loss == 0.0 and empty.perplexity == 1.0 and empty.n_batches == 0
    rr = rank_reduce(bl.where(~F.isnan("loss"))).first()
    assert abs(rr.loss - 5.0 / 3) < 1e-12


def test_perplexity_cap(spark):
    df = spark.createDataFrame([(1.0,), (99.9,), (100.0,), (800.0,), (float("nan"),)], "l double")
    got = [r.p for r in df.select(perplexity_col("l").alias("p")).collect()]
    assert abs(got[0] - math.e) < 1e-12 and math.isfinite(got[1])
    assert all(math.isinf(x) for x in got[2:])


def test_pairs_counted_in_the_row(spark):
    seqs = spark.createDataFrame(
        [(0, [1, 2, 1, 2, 1, 3], [1, 2, 1, 2, 1, 3]), (1, [5], [5]), (2, [], []), (3, [7, 7, 7, 0], [7, 7, 7, -100]),
         (4, [1, 2], [1, 2]), (5, None, None)], "doc_id long, input_ids array<int>, labels array<int>")
    got = sorted(tuple(r) for r in counted_pairs(seqs).collect())
    want = shifted_pairs(seqs).groupBy("doc_id", "ctx", "target").agg(F.count(F.lit(1)).alias("n"))
    assert got == sorted(tuple(r) for r in want.collect())
    assert got == [(0, 1, 2, 2), (0, 1, 3, 1), (0, 2, 1, 2), (3, 7, 7, 2), (4, 1, 2, 1)]
    assert counted_pairs(seqs.where("false")).count() == 0


def test_counted_pairs_score_as_pairs_do(spark):
    rows = [(i, [i % 3, 1, 2, 1, i % 7], [i % 3, 1, 2, 1, i % 7]) for i in range(200)]
    seqs = spark.createDataFrame(rows, "doc_id long, input_ids array<int>, labels array<int>")
    model = fit_bigram(shifted_pairs(seqs.where("doc_id < 50")).select("ctx", "target"))
    for by in ((), ("doc_id",)):
        def scores(pairs):
            return sorted((tuple(r)[:-1] + (round(r.nll, 12),)) for r in pair_nll(pairs, model, 0.5, 10, by).collect())
        assert scores(counted_pairs(seqs)) == scores(shifted_pairs(seqs))


def test_scored_pairs_are_shuffled_once(spark):
    seqs = spark.range(2000).selectExpr("id as doc_id", "transform(sequence(1, 30), x -> cast((x * id) % 97 as int)) as input_ids")
    seqs = seqs.withColumn("labels", F.col("input_ids"))
    model = cut_lineage(fit_bigram(shifted_pairs(seqs).select("ctx", "target")))
    plan = pair_nll(counted_pairs(seqs), model, 0.5, 97, ("doc_id",)).hint("merge")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [doc_id" not in text  # no pass that groups the pairs of a document
