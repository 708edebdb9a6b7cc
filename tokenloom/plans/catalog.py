"""Registered queries: one per operator of the inventory, each over the whole given tables.

Every query takes ``(spark, sf_dir)`` and returns a DataFrame whose
column names and types match the DuckDB oracle in ``oracle.py``.  Arrays
are shown as space-joined strings and doubles are rounded, so both
engines print the same values.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mathx import perplexity_col, rms_normalize_col
from ..functions.text import nonblank_col, text_fallback_col, tokens_col
from ..operators import decode, ngram, rank, sequence, split as sp, telemetry as tm
from ..operators.evaluate import batch_losses, doc_loss_sums, evaluate as evaluate_batches, rank_reduce
from ..operators import subword, udf, vectors, vocab as vc
from ..sources.batches import read_batches, store_batches
from ..sources.corpus import ingest_bounded
from ..session import cut_lineage, ensure_checkpoint_dir, intermediate
from ..sources.sinks import EVAL_LOG_COLUMNS, append_metrics, eval_records, manifest, read_metrics
from .prepare import DEFAULT_VOCAB_SIZE, documents, spread, table, tokenized
from .training import TrainConfig, train_batches, train_order, val_batches

# Query parameters (the shipped training configuration where it has one).
V = DEFAULT_VOCAB_SIZE  # vocabulary size incl. <eos>, <unk>
N = 2048            # training sequence length, only of the fixed-length queries (P7-P12)
RETRUNC = 512       # second, load-time cut
SEED = 42
ALPHA = 0.01        # add-alpha smoothing for held-out scoring
TEMP, TOP_K, TOP_P = 0.7, 50, 0.9
DOT_K = 10          # candidates of a query over dot products
NEW_TOKENS = 30
TOKENIZER = f"tokenloom-regex-v{V}"
CFG = TrainConfig()
INGEST_SHARDS, SHARD_ROWS = 5, 100   # S5: bound of the bounded ingest
EVAL_CAP = 4        # O3: batches per rank of the capped evaluation
EPOCH_STEPS = 5     # T1: updates of an epoch of the run log
LOG_EVERY, LOG_ACCUM, LOG_BATCH = 1, 8, 8
WINDOW_EVERY, WINDOW_ACCUM = 2, 4


# ---------------------------------------------------------------- shared stages
def _docs(spark, sf):
    return documents(spark, sf, ("doc_id", "text", "lang", "source"))


def _toks(spark, sf):
    return tokenized(_docs(spark, sf), keep=("doc_id",))


def _vocab(spark, sf):
    return vc.build_vocab(_toks(spark, sf), V)


def _ids(spark, sf, vocab=None, materialize=False, max_length=None):
    """Encoded documents, whole unless ``max_length`` cuts them; ``materialize``
    stores them once (as the tokenized table of the preparation job) when
    several branches read them."""
    toks = _toks(spark, sf)
    ids = vc.encode(toks, vocab if vocab is not None else vc.build_vocab(toks, V), max_length=max_length)
    return cut_lineage(ids) if materialize else ids


def _seqs(spark, sf):
    """Fixed-length sequences: cut, padded and masked at N (the feature of P7-P12)."""
    return sequence.label_mask(sequence.to_sequences(_ids(spark, sf, max_length=N), N))


def _whole(ids):
    """Sequences over every id of a text: no cut, no padding."""
    return sequence.label_mask(sequence.whole_sequences(ids))


def _doc_ids(spark, sf):
    """Ids of the non-blank documents, stored once: ranks read them several times, the texts once."""
    return cut_lineage(_docs(spark, sf).select("doc_id"))


def _split(spark, sf):
    """The split, stored once; orders, shards and batches read it and no text."""
    return cut_lineage(sp.exact_split(_doc_ids(spark, sf), CFG.frac, CFG.seed))


def _model(ids, split, eos_id=None, materialize=False):
    train = ids.join(split.where(F.col("split") == "train").select("doc_id"), "doc_id", "left_semi")
    m = ngram.fit_bigram(ngram.id_pairs(train, eos_id=eos_id))
    return cut_lineage(m) if materialize else m


def _shared(spark, sf, vocab=None):
    """Encoded ids and split, each stored once, for queries that read them in several branches."""
    return _ids(spark, sf, vocab, materialize=True), _split(spark, sf)


def _txt(c):
    return F.array_join(F.col(c), " ")


def _prompts(spark, sf, vocab):
    conv = spread(table(spark, sf, "conversations").where((F.col("role") == "user") & nonblank_col("text")),
                  "conv_id")
    toks = conv.select("conv_id", "turn", tokens_col("text").alias("tokens"))
    return vc.encode(toks, vocab, id_col="conv_id", keep=("turn",))


def _micro(spark, sf):
    return tm.micro_batches(table(spark, sf, "events"))


# ---------------------------------------------------------------- S / P
def q_text_fallback(spark, sf):
    """P1 over rows that have a text, a content alone, or neither."""
    i, t = F.col("doc_id"), F.col("text")
    d = table(spark, sf, "documents").select("doc_id", F.when(i % 3 != 0, t).alias("text"),
                                             F.when(i % 2 == 0, F.concat(F.lit("content "), t)).alias("content"))
    text = text_fallback_col(d.columns)
    return d.select("doc_id", F.length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("text_md5"))


def q_nonblank_documents(spark, sf):
    return _docs(spark, sf).select("doc_id", F.length("text").cast("bigint").alias("n_chars"))


def q_tokenize_documents(spark, sf):
    t = _toks(spark, sf)
    return t.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
                    F.md5(_txt("tokens")).alias("tokens_md5"))


def q_build_vocab(spark, sf):
    return _vocab(spark, sf).select("tok", "id", "count")


def q_encode_documents(spark, sf):
    ids = _ids(spark, sf)
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), _txt("ids").alias("ids"))


def q_truncate_tokens(spark, sf):
    t = _toks(spark, sf).select("doc_id", F.slice("tokens", 1, N).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(_txt("t")).alias("tokens_md5"))


def q_pad_tokens(spark, sf):
    return _seqs(spark, sf).select("doc_id", _txt("input_ids").alias("input_ids"))


def q_attention_mask(spark, sf):
    s = _seqs(spark, sf)
    n_real = F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, m: a + m)
    return s.select("doc_id", n_real.alias("n_real"), _txt("attention_mask").alias("attention_mask"))


def q_label_mask(spark, sf):
    return _seqs(spark, sf).select("doc_id", _txt("labels").alias("labels"))


def q_retruncate(spark, sf):
    s = sequence.retruncate(_seqs(spark, sf), RETRUNC)
    return s.select("doc_id", _txt("input_ids").alias("input_ids"), _txt("attention_mask").alias("attention_mask"),
                    _txt("labels").alias("labels"))


def q_shifted_pairs(spark, sf):
    p = sequence.shifted_pairs(_whole(_ids(spark, sf)))
    return p.select("doc_id", F.col("pos").cast("int").alias("pos"), "ctx", "target")


def q_detokenize(spark, sf):
    v = _vocab(spark, sf)
    return vc.detokenize(_ids(spark, sf, v), v)


def q_ingest_bounded(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return ingest_bounded(d, INGEST_SHARDS, SHARD_ROWS)


def q_dataset_manifest(spark, sf):
    return manifest(_seqs(spark, sf), N, TOKENIZER)


def q_token_counts(spark, sf):
    t = tokenized(_docs(spark, sf), keep=("doc_id", "lang", "source"))
    return t.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.size("tokens")).cast("bigint").alias("n_tokens"))


def q_unk_counts(spark, sf):
    """Tokens outside the vocabulary per language and source."""
    toks = tokenized(_docs(spark, sf), keep=("doc_id", "lang", "source"))
    ids = vc.encode(toks, vc.build_vocab(toks, V), keep=("lang", "source"))
    unk = F.size(F.filter("ids", lambda i: i == F.lit(vc.UNK_ID)))
    return ids.groupBy("lang", "source").agg(F.sum(F.size("ids")).cast("bigint").alias("n_tokens"),
                                             F.sum(unk).cast("bigint").alias("n_unk"))


# ---------------------------------------------------------------- subword vocabulary (P5, P6, P16 with a given file)
def q_subword_round_trip(spark, sf):
    """Every text as subword ids and back."""
    ids = subword.encode_subwords(_docs(spark, sf))
    back = subword.decode_subwords(ids, subword.vocabulary(spark), skip_special=False)
    return back.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


def q_subword_sequences(spark, sf):
    """Fixed-length training sequences of subword ids; the vocabulary's own end-of-text id pads."""
    ids = subword.encode_subwords(_docs(spark, sf), max_length=N)
    end = subword.vocabulary(spark).where("special").agg(F.min("id")).first()[0]
    seqs = sequence.label_mask(sequence.to_sequences(ids, N, pad_id=end))
    n_real = F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, m: a + m)
    return seqs.select("doc_id", n_real.alias("n_real"), _txt("input_ids").alias("input_ids"))


def q_subword_counts(spark, sf):
    """Occurrences of every id of the vocabulary in the documents."""
    counts = subword.subword_counts(subword.encode_subwords(_docs(spark, sf)), subword.vocabulary(spark))
    return counts.select("id", F.hex("piece").alias("piece"), "special", "count")


# ---------------------------------------------------------------- rank / split / shard / batch
def q_global_rank(spark, sf):
    d = _doc_ids(spark, sf).withColumn("_k", rank.hash_key(SEED, F.col("doc_id")))
    return rank.global_rank(d, "_k", "doc_id", total_col=None).select("doc_id", "rank")


def q_epoch_shuffle(spark, sf):
    s = _split(spark, sf)
    e0 = train_order(s, 0, CFG).select("doc_id", F.lit(0).alias("epoch"), "idx")
    e1 = train_order(s, 1, CFG).select("doc_id", F.lit(1).alias("epoch"), "idx")
    return e0.unionByName(e1)


def q_epoch_order(spark, sf):
    """O1 without a sort: the places of the train documents in two epochs, by arithmetic on their stored index."""
    train = _split(spark, sf).where(F.col("split") == "train")
    n = train.count()
    places = [rank.permuted_index("idx", n, CFG.sampler_seed, e) for e in (0, 1)]
    return train.select("doc_id", F.posexplode(F.array(*places)).alias("epoch", "place"))


def q_train_val_split(spark, sf):
    return _split(spark, sf).select("doc_id", "split", "idx")


def q_split_sizes(spark, sf):
    return sp.split_sizes(_split(spark, sf))


def q_rank_shards(spark, sf):
    order = train_order(_split(spark, sf), 0, CFG)
    return sp.shard(order, 7).select("doc_id", "rank", "pos")


def q_batches_train(spark, sf):
    b = sp.batch(sp.shard(train_order(_split(spark, sf), 0, CFG), CFG.world), CFG.batch_size, drop_last=True)
    return b.select("doc_id", "rank", "pos", "batch_id")


def q_batches_val(spark, sf):
    return val_batches(_split(spark, sf), CFG).select("doc_id", "rank", "pos", "batch_id")


def q_stored_batches(spark, sf):
    """B2/B3 laid out: the first epoch's batches with their ids written in training order, read back and listed."""
    ids, s = _shared(spark, sf)
    path = intermediate(f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokenloom-jobs/batches-{uuid.uuid4().hex}")
    order = sp.batch(sp.shard(train_order(s, 0, CFG), CFG.world), CFG.batch_size, drop_last=True)
    store_batches(order, ids, path)
    rows = read_batches(spark, path).select("rank", "batch_id", F.struct("pos", _txt("ids").alias("ids")).alias("_r"))
    docs = F.transform(F.array_sort(F.collect_list("_r")), lambda r: r["ids"])  # a batch's few documents
    return rows.groupBy(F.col("rank").cast("bigint").alias("rank"), F.col("batch_id").cast("bigint").alias("batch_id")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.md5(F.array_join(docs, "|")).alias("ids_md5"))


def q_update_groups(spark, sf):
    return train_batches(_split(spark, sf), 0, CFG).select("doc_id", "rank", "batch_id", "step")


def q_step_plan(spark, sf):
    return sp.step_plan(_split(spark, sf), CFG.world, CFG.batch_size, CFG.accumulation, epochs=1)


def q_val_subset_semi(spark, sf):
    val_ids = _split(spark, sf).where(F.col("split") == "val").select("doc_id")
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return d.join(val_ids, "doc_id", "left_semi")


# ---------------------------------------------------------------- n-gram model and evaluation
def q_bigram_fit(spark, sf):
    m = _model(_ids(spark, sf), _split(spark, sf))
    return m.select("ctx", "token", "count", "ctx_total",
                    F.round(F.col("count") / F.col("ctx_total"), 9).alias("p"))


def q_cross_entropy(spark, sf):
    ce = ngram.in_sample_loss(_model(_ids(spark, sf), _split(spark, sf)))
    return ce.select(F.round("loss", 9).alias("loss"), F.round("perplexity", 6).alias("perplexity"), "n_tokens")


ORDER = 3           # L1: ids of an n-gram of the higher-order model
DISCOUNT = 0.75


def _ngrams(ids, s, part, order=ORDER, keep=()):
    return ngram.ngram_rows(ids.join(s.where(F.col("split") == part).select("doc_id"), "doc_id", "left_semi"),
                            order, V, keep=keep)


def q_trigram_fit(spark, sf):
    """L1, order 3: the highest table of the back-off model; the start mark is id V."""
    ids, s = _shared(spark, sf)
    top = ngram.fit_ngram(_ngrams(ids, s, "train"), ORDER, V)[0]
    bits = ngram.id_bits(V)
    return top.select(F.shiftright("ctx", bits).cast("int").alias("first"),
                      F.col("ctx").bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).cast("int").alias("second"),
                      "token", "count", "ctx_total", "ctx_types")


def q_trigram_perplexity(spark, sf):
    """L4, order 3: held-out loss and perplexity by language under the back-off model."""
    toks = tokenized(_docs(spark, sf), keep=("doc_id", "lang"))
    ids = cut_lineage(vc.encode(toks, vc.build_vocab(toks, V), keep=("lang",)))
    s = _split(spark, sf)
    levels = ngram.fit_ngram(_ngrams(ids, s, "train"), ORDER, V)
    nll = ngram.backoff_nll(_ngrams(ids, s, "val", keep=("lang",)), levels, V, DISCOUNT, by=("lang",))
    per = nll.groupBy("lang").agg((F.sum(F.col("n") * F.col("nll")) / F.sum("n")).alias("loss"),
                                  F.sum("n").cast("bigint").alias("n_tokens"))
    return per.select("lang", F.round("loss", 9).alias("loss"), F.round(perplexity_col("loss"), 5).alias("perplexity"), "n_tokens")


def _val_nll(ids, s, docs=None):
    """Pair losses of the validation documents, or of those named in ``docs``."""
    chosen = s.where(F.col("split") == "val") if docs is None else docs
    val = _whole(ids).join(chosen.select("doc_id"), "doc_id", "left_semi")
    return ngram.pair_nll(ngram.counted_pairs(val), _model(ids, s, materialize=True), ALPHA, V, by=("doc_id",))


def q_doc_perplexity(spark, sf):
    ids, s = _shared(spark, sf)
    nll = _val_nll(ids, s)
    per_doc = nll.groupBy("doc_id").agg((F.sum(F.col("n") * F.col("nll")) / F.sum("n")).alias("loss"),
                                        F.sum("n").cast("bigint").alias("n_tokens"))
    return per_doc.select("doc_id", F.round("loss", 9).alias("loss"),
                          F.round(perplexity_col("loss"), 6).alias("perplexity"), "n_tokens")


def q_group_perplexity(spark, sf):
    """L4 per language and source of the validation documents."""
    ids, s = _shared(spark, sf)
    groups = table(spark, sf, "documents").select("doc_id", "lang", "source")
    sums = doc_loss_sums(_val_nll(ids, s)).join(groups, "doc_id")
    loss = F.sum("nll_sum") / F.sum("n_targets")
    per = sums.groupBy("lang", "source").agg(loss.alias("loss"), F.sum("n_targets").cast("bigint").alias("n_tokens"))
    return per.select("lang", "source", F.round("loss", 9).alias("loss"),
                      F.round(perplexity_col("loss"), 6).alias("perplexity"), "n_tokens")


def q_benchmark_perplexity(spark, sf):
    """L4 on a second corpus: each benchmark item scored by the table fitted on the documents' train split."""
    v = _vocab(spark, sf)
    ids, s = _shared(spark, sf, v)
    items = spread(table(spark, sf, "benchmark").where(nonblank_col("text")), "item_id")
    item_ids = vc.encode(items.select("item_id", tokens_col("text").alias("tokens")), v, id_col="item_id")
    pairs = ngram.counted_pairs(_whole(item_ids.withColumnRenamed("item_id", "doc_id")))
    ce = ngram.cross_entropy(pairs, _model(ids, s, materialize=True), ALPHA, V, by=("doc_id",))
    return ce.select(F.col("doc_id").alias("item_id"), F.round("loss", 9).alias("loss"),
                     F.round("perplexity", 6).alias("perplexity"), "n_tokens")


def _batch_losses(spark, sf):
    ids, s = _shared(spark, sf)
    return batch_losses(val_batches(s, CFG), doc_loss_sums(_val_nll(ids, s)))


def q_eval_batch_mean(spark, sf):
    b = _batch_losses(spark, sf)
    return b.select("rank", "batch_id", F.round("loss", 9).alias("loss"), "n_targets")


def q_eval_rank_reduce(spark, sf):
    r = rank_reduce(_batch_losses(spark, sf))
    return r.select(F.round("loss", 9).alias("loss"), "n_batches")


def _eval_row(e):
    return e.select(F.round("loss", 9).alias("loss"), F.round("perplexity", 6).alias("perplexity"),
                    F.col("n_batches").cast("bigint").alias("n_batches"))


def q_evaluate_split(spark, sf):
    return _eval_row(evaluate_batches(_batch_losses(spark, sf)))


def q_evaluate_capped(spark, sf):
    """O3: the first EVAL_CAP batches of each rank; only their documents are scored."""
    ids, s = _shared(spark, sf)
    first = val_batches(s, CFG).where(F.col("batch_id") < EVAL_CAP)
    return _eval_row(evaluate_batches(batch_losses(first, doc_loss_sums(_val_nll(ids, s, first)))))


def q_eval_records(spark, sf):
    """The evaluation after one epoch as a record of its run and step, appended to a metrics table and read back."""
    ids, s = _shared(spark, sf)
    last = train_batches(s, 0, CFG).agg(F.coalesce(F.max("step"), F.lit(0))).first()[0]
    row = evaluate_batches(batch_losses(val_batches(s, CFG), doc_loss_sums(_val_nll(ids, s))))
    path = intermediate(f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokenloom-jobs/evaluations-{uuid.uuid4().hex}")
    append_metrics(eval_records(row, run_id=0, step=last), path)
    back = read_metrics(spark, path)
    return back.select("run_id", "step", *[F.round(c, d).alias(c) for c, d in zip(EVAL_LOG_COLUMNS, (9, 6))])


def q_perplexity(spark, sf):
    """A7 per event (value = loss): capped flag, and exp(loss) as mantissa x 10^exponent."""
    e = table(spark, sf, "events").select("event_id", perplexity_col("value").alias("ppl"))
    finite = F.col("ppl") < F.lit(float("inf"))
    ex = F.floor(F.log10("ppl"))
    return e.select("event_id", (~finite).alias("capped"),
                    F.when(finite, ex.cast("bigint")).alias("ppl_exp10"),
                    F.when(finite, F.round(F.col("ppl") / F.pow(F.lit(10.0), ex), 9)).alias("ppl_mantissa"))


# ---------------------------------------------------------------- next-token selection and generation
def _gen_model(spark, sf):
    v = _vocab(spark, sf)
    return v, _model(_ids(spark, sf, v), _split(spark, sf), eos_id=vc.EOS_ID, materialize=True)


def q_greedy_next(spark, sf):
    return decode.greedy_next(_model(_ids(spark, sf), _split(spark, sf)))


def q_topk_next(spark, sf):
    m = _model(_ids(spark, sf), _split(spark, sf))
    return decode.top_k(m.select("ctx", "token", "count"), TOP_K, score="count")


def q_nucleus_next(spark, sf):
    m = _model(_ids(spark, sf), _split(spark, sf)).select("ctx", "token", F.col("count").cast("double").alias("w"))
    return decode.top_p(m, TOP_P).select("ctx", "token")


def q_next_token_dist(spark, sf):
    d = decode.next_token_dist(_model(_ids(spark, sf), _split(spark, sf)), TEMP, TOP_K, TOP_P)
    return d.select("ctx", "token", F.round("prob", 9).alias("prob"), F.col("rank").cast("int").alias("rank"))


def q_sample_next(spark, sf):
    v = _vocab(spark, sf)
    ids, s = _shared(spark, sf, v)
    m = _model(ids, s, eos_id=vc.EOS_ID)
    front = ids.select("doc_id", F.element_at("ids", -1).alias("last"))
    dist = decode.next_token_dist(m, TEMP, TOP_K, TOP_P)
    out = decode.sample_next(front, dist, decode.uniform_draw(SEED, "doc_id", F.lit(0)))
    return out.select("doc_id", F.coalesce("next_token", F.lit(vc.EOS_ID)).alias("token"))


def _generate(spark, sf, do_sample):
    v, m = _gen_model(spark, sf)
    g = decode.generate(_prompts(spark, sf, v), m, NEW_TOKENS, do_sample=do_sample, temperature=TEMP,
                        k=TOP_K, p=TOP_P, seed=SEED, keys=("conv_id", "turn"))
    return g.select("conv_id", "turn", F.col("n_new").cast("int").alias("n_new"), _txt("ids").alias("ids"))


def q_generate_greedy(spark, sf):
    return _generate(spark, sf, False)


def q_generate_sampled(spark, sf):
    return _generate(spark, sf, True)


# ---------------------------------------------------------------- telemetry
def q_run_micro_batches(spark, sf):
    return _micro(spark, sf).select("run_id", "n", "loss")


def q_log_window_loss(spark, sf):
    w = tm.log_windows(_micro(spark, sf), WINDOW_EVERY, WINDOW_ACCUM, LOG_BATCH)
    return w.select("run_id", "step", F.round("loss", 9).alias("loss"))


def q_run_log(spark, sf):
    w = tm.log_windows(_micro(spark, sf), LOG_EVERY, LOG_ACCUM, LOG_BATCH, world=1,
                       learning_rate=5e-4, warmup=100, total_steps=50_000, schedule="cosine",
                       steps_per_epoch=EPOCH_STEPS)
    return w.select("run_id", "step", "epoch", F.round("loss", 9).alias("loss"),
                    F.round("learning_rate", 12).alias("learning_rate"),
                    F.round("steps_per_sec", 6).alias("steps_per_sec"),
                    F.round("samples_per_sec", 6).alias("samples_per_sec"),
                    F.round("ms_per_step", 6).alias("ms_per_step"))


def _sched(spark, sf, kind):
    u = tm.update_log(_micro(spark, sf), LOG_ACCUM)
    r = tm.scheduled_rate(u, 5e-4, warmup=2, schedule=kind)
    return r.select("run_id", "step", F.round("learning_rate", 12).alias("learning_rate"))


def q_scheduled_rate(spark, sf):
    return _sched(spark, sf, "cosine")


def q_scheduled_rate_linear(spark, sf):
    return _sched(spark, sf, "linear")


def q_cadence_steps(spark, sf):
    u = tm.update_log(_micro(spark, sf), LOG_ACCUM)
    return tm.on_cadence(u, 2).select("run_id", "step", F.round("loss_sum", 9).alias("loss_sum"))


def q_latest_step(spark, sf):
    return tm.latest_step(tm.update_log(_micro(spark, sf), LOG_ACCUM))


# ---------------------------------------------------------------- vectors
def q_rms_normalize(spark, sf):
    e = table(spark, sf, "embeddings")
    n = e.select("vec_id", rms_normalize_col("embedding").alias("x"))
    return n.select("vec_id", F.posexplode("x").alias("dim", "value")).select(
        "vec_id", "dim", F.round("value", 6).alias("value"))


def q_gather_vectors(spark, sf):
    ids = _ids(spark, sf).select("doc_id", F.posexplode("ids").alias("pos", "id"))
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    g = vectors.gather(ids, e, id_col="id")
    x = F.col("embedding")
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return g.select("doc_id", "pos", F.col("id").alias("vec_id"), "found", "label",
                    F.when(F.col("found"), F.size(x)).cast("bigint").alias("dims"),
                    F.element_at(x, 1).cast("double").alias("first"), F.element_at(x, -1).cast("double").alias("last"),
                    F.round(total, 6).alias("total"))


def q_dot_scores_topk(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    s = vectors.dot_softmax_topk(e, e, 5)
    return s.select("query", "token", F.round("score", 6).alias("score"), F.round("prob", 6).alias("prob"))


def q_dot_next_dist(spark, sf):
    """L5 over real scores: temperature and nucleus filter on each query's dot products."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    s = vectors.dot_scores_topk(e, e, DOT_K).withColumnRenamed("query", "ctx")
    d = decode.next_token_dist(s, TEMP, DOT_K, TOP_P, score="score")
    return d.select("ctx", "token", F.round("prob", 6).alias("prob"), F.col("rank").cast("int").alias("rank"))


# ---------------------------------------------------------------- UDF surface
def _text_stats(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"n_chars": pdf["text"].str.len().astype("int64"),
                         "n_lines": (pdf["text"].str.count("\n") + 1).astype("int64")})


def q_map_batches(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return udf.map_batches(d, _text_stats, "doc_id long, n_chars long, n_lines long", keep=("doc_id",))


def _unigram_scorer(vocab, size):
    """A loader for U2: mean -ln of add-one unigram probabilities of a sequence's targets.

    The table has one number per vocabulary id, so it is bounded by ``size``.
    """
    rows = vocab.select("id", "count").toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1)
    counts[rows["id"].to_numpy()] = rows["count"].to_numpy()
    losses = vocab.sparkSession.sparkContext.broadcast(-np.log((counts + 1.0) / (counts.sum() + size)))

    def load():
        nll = losses.value

        def score(pdf: pd.DataFrame) -> pd.DataFrame:
            lengths = pdf["input_ids"].str.len().to_numpy()
            owner = np.repeat(np.arange(len(pdf)), lengths)
            labels, mask = np.concatenate(pdf["labels"].to_list()), np.concatenate(pdf["attention_mask"].to_list())
            target = (labels >= 0) & (mask == 1)
            target[(np.cumsum(lengths) - lengths)[lengths > 0]] = False  # nothing predicts the first id
            n = np.bincount(owner[target], minlength=len(pdf))
            total = np.bincount(owner[target], weights=nll[labels[target]], minlength=len(pdf))
            with np.errstate(invalid="ignore"):
                loss = np.where(n > 0, total / n, np.nan)
            return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "loss": loss, "n_targets": n.astype("int64")})

        return score

    return load


def q_score_batches(spark, sf):
    """(input_ids, attention_mask, labels) of whole texts -> loss per document."""
    v = _vocab(spark, sf)
    seqs = _whole(_ids(spark, sf, v))
    scored = udf.score_batches(seqs, _unigram_scorer(v, V), "doc_id long, loss double, n_targets long")
    return scored.select("doc_id", F.round("loss", 9).alias("loss"), "n_targets")


QUERIES = {
    "text_fallback": q_text_fallback,
    "nonblank_documents": q_nonblank_documents,
    "tokenize_documents": q_tokenize_documents,
    "build_vocab": q_build_vocab,
    "encode_documents": q_encode_documents,
    "truncate_tokens": q_truncate_tokens,
    "pad_tokens": q_pad_tokens,
    "attention_mask": q_attention_mask,
    "label_mask": q_label_mask,
    "retruncate": q_retruncate,
    "shifted_pairs": q_shifted_pairs,
    "detokenize": q_detokenize,
    "ingest_bounded": q_ingest_bounded,
    "dataset_manifest": q_dataset_manifest,
    "token_counts": q_token_counts,
    "unk_counts": q_unk_counts,
    "subword_round_trip": q_subword_round_trip,
    "subword_sequences": q_subword_sequences,
    "subword_counts": q_subword_counts,
    "global_rank": q_global_rank,
    "epoch_shuffle": q_epoch_shuffle,
    "epoch_order": q_epoch_order,
    "train_val_split": q_train_val_split,
    "split_sizes": q_split_sizes,
    "rank_shards": q_rank_shards,
    "batches_train": q_batches_train,
    "stored_batches": q_stored_batches,
    "batches_val": q_batches_val,
    "update_groups": q_update_groups,
    "step_plan": q_step_plan,
    "val_subset_semi": q_val_subset_semi,
    "bigram_fit": q_bigram_fit,
    "trigram_fit": q_trigram_fit,
    "trigram_perplexity": q_trigram_perplexity,
    "cross_entropy": q_cross_entropy,
    "doc_perplexity": q_doc_perplexity,
    "group_perplexity": q_group_perplexity,
    "benchmark_perplexity": q_benchmark_perplexity,
    "eval_batch_mean": q_eval_batch_mean,
    "eval_rank_reduce": q_eval_rank_reduce,
    "evaluate_split": q_evaluate_split,
    "evaluate_capped": q_evaluate_capped,
    "eval_records": q_eval_records,
    "perplexity": q_perplexity,
    "greedy_next": q_greedy_next,
    "topk_next": q_topk_next,
    "nucleus_next": q_nucleus_next,
    "next_token_dist": q_next_token_dist,
    "sample_next": q_sample_next,
    "generate_greedy": q_generate_greedy,
    "generate_sampled": q_generate_sampled,
    "run_micro_batches": q_run_micro_batches,
    "log_window_loss": q_log_window_loss,
    "run_log": q_run_log,
    "scheduled_rate": q_scheduled_rate,
    "scheduled_rate_linear": q_scheduled_rate_linear,
    "cadence_steps": q_cadence_steps,
    "latest_step": q_latest_step,
    "rms_normalize": q_rms_normalize,
    "gather_vectors": q_gather_vectors,
    "dot_scores_topk": q_dot_scores_topk,
    "dot_next_dist": q_dot_next_dist,
    "map_batches": q_map_batches,
    "score_batches": q_score_batches,
}

#: Queries without SQL.  Byte-pair merges are held against the tokenizers library by tests.  The keys and widths of
#: an epoch order depend on the number of rows, which a fixed SQL text cannot know: tests write its SQL for the table's size.
NO_SQL = {"subword_sequences", "subword_counts", "epoch_order"}
