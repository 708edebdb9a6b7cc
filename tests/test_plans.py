"""Library-level plans: preparation and training data compose end to end."""

import math

from pyspark.sql import functions as F

from tokenloom.plans import catalog
from tokenloom.plans.prepare import PrepConfig, documents, prepare
from tokenloom.plans.training import (TrainConfig, evaluate_split, fit_on_train, split_table, train_batches,
                                      val_batches)

from conftest import SF001


def test_prepare_split_batches_evaluate(spark):
    cfg = TrainConfig(world=2, batch_size=4, accumulation=2, eval_batches=3)
    vocab, ids, seqs = prepare(documents(spark, SF001, ("doc_id", "text")), PrepConfig(vocab_size=400, max_length=64))
    split = split_table(seqs.select("doc_id"), cfg)
    n = seqs.count()
    assert split.where("split = 'train'").count() == int(0.8 * n)
    tb = train_batches(split, 0, cfg)
    per_rank = tb.groupBy("rank").count().collect()
    assert len(per_rank) == 2 and len({r["count"] for r in per_rank}) == 1  # equal work per rank
    assert tb.agg(F.max("step")).first()[0] == ((-(-int(0.8 * n) // 2)) // 4) // 2
    vb = val_batches(split, cfg)
    assert vb.select("doc_id").distinct().count() == n - int(0.8 * n)
    model = fit_on_train(ids, split)
    n_val = n - int(0.8 * n)
    per_rank_batches = -(-(-(-n_val // 2)) // 4)
    ev = evaluate_split(seqs, split, model, alpha=0.1, vocab_size=400, cfg=cfg).first()
    cap = cfg.eval_batches * cfg.accumulation  # per rank
    assert ev.n_batches == 2 * min(per_rank_batches, cap)
    assert math.isfinite(ev.loss) and ev.perplexity == math.exp(ev.loss)
    tight = TrainConfig(world=2, batch_size=4, accumulation=1, eval_batches=1)
    assert evaluate_split(seqs, split, model, 0.1, 400, tight).first().n_batches == 2


def test_split_plans_read_no_text(spark):
    for name in ("train_val_split", "epoch_shuffle", "batches_train", "global_rank"):
        df = catalog.QUERIES[name](spark, SF001)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "doc_id" in plan and "text#" not in plan, name


def test_intermediate_tables_are_deleted_at_the_end_of_the_block(spark):
    import os
    from tokenloom.session import cut_lineage, intermediate_tables
    with intermediate_tables(spark):
        df = cut_lineage(spark.range(5))
        path = os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
        assert df.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path)
