"""Next-token tables from counted bigrams and their evaluation.

The model is a table ``(ctx, token, count)`` of observed pairs plus
per-context totals; add-alpha smoothing is a formula over it, so the
context x vocabulary matrix is never materialised.  Top-k / top-p act
on observed candidates only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import IGNORE_INDEX, consecutive_pairs_col, shifted_pairs_col
from ..functions.mathx import nll_col, perplexity_col
from ..session import DEFAULT_BROADCAST_LIMIT, cut_lineage


def id_pairs(ids: DataFrame, col: str = "ids", eos_id: int | None = None,
             keep: tuple = ("doc_id",)) -> DataFrame:
    """Adjacent (ctx, target) pairs of each id array (optionally ending in EOS)."""
    return ids.select(*keep, F.posexplode_outer(consecutive_pairs_col(col, eos_id)).alias("pos", "p")).where(
        F.col("p").isNotNull()).select(*keep, "pos", F.col("p.ctx").alias("ctx"), F.col("p.target").alias("target"))


def fit_bigram(pairs: DataFrame) -> DataFrame:
    """L1: (ctx, token, count, ctx_total) from (ctx, target) pairs.

    Counts aggregate map-side before the shuffle; the context total is a
    window over the already-aggregated rows (at most V per context).
    """
    counts = pairs.groupBy("ctx", F.col("target").alias("token")).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("ctx_total", F.sum("count").over(Window.partitionBy("ctx")))


def with_probability(model: DataFrame, alpha: float = 0.0, vocab_size: int | None = None) -> DataFrame:
    """P(token | ctx) = (count + alpha) / (ctx_total + alpha * V)."""
    if alpha and not vocab_size:
        raise ValueError("smoothing needs vocab_size")
    den = F.col("ctx_total") + F.lit(float(alpha) * float(vocab_size or 0))
    return model.withColumn("p", (F.col("count") + F.lit(float(alpha))) / den)


def context_totals(model: DataFrame) -> DataFrame:
    return model.groupBy("ctx").agg(F.max("ctx_total").alias("ctx_total"))


HOT_SHARE = 0.001  # a pair with more of the model's count than this is joined by broadcast: at most 1,000 pairs
SPREAD_KEYS = 4096


def counted_pairs(seqs: DataFrame, keep: tuple = ("doc_id",)) -> DataFrame:
    """(keep..., ctx, target, n), each distinct pair of a sequence with its count, made inside the row.

    The pairs of a row are packed into one number each and sorted; runs of equal
    ones are counted.  Nothing is shuffled.  Ignored targets give no pair.
    """
    pairs = F.filter(shifted_pairs_col("input_ids", "labels"), lambda p: p["target"] != IGNORE_INDEX)
    packed = F.transform(pairs, lambda p: F.shiftleft(p["ctx"].cast("bigint"), 32).bitwiseOR(p["target"].cast("bigint")))
    rows = seqs.select(*keep, F.array_sort(packed).alias("_p")).where(F.size("_p") > 0)
    starts = F.filter(F.sequence(F.lit(0), F.size("_p") - 1),
                      lambda i: (i == 0) | (F.get("_p", i) != F.get("_p", F.greatest(i - 1, F.lit(0)))))
    rows = rows.select(*keep, "_p", starts.alias("_s"))
    ends = F.concat(F.slice("_s", 2, F.size("_s")), F.array(F.size("_p")))
    runs = F.zip_with("_s", ends, lambda i, j: F.struct(F.get("_p", i).alias("p"), (j - i).cast("bigint").alias("n")))
    flat = rows.select(*keep, F.explode_outer(runs).alias("_r")).where(F.col("_r").isNotNull())
    return flat.select(*keep, F.shiftright("_r.p", 32).cast("int").alias("ctx"),
                       F.col("_r.p").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("target"),
                       F.col("_r.n").alias("n"))


def _join_counts(agg: DataFrame, seen: DataFrame, by: tuple) -> DataFrame:
    """``agg`` with the model's count ``_c`` of each pair, in one shuffle of its rows.

    Pairs with over HOT_SHARE of the model's count get theirs from a broadcast
    and are spread over spare keys.  A pair that is frequent in the scored
    texts only is left to Spark's skew join, which may split this side of a left join.
    """
    floor = (seen.agg(F.sum("_c")).first()[0] or 0) * HOT_SHARE
    hot = seen.where(F.col("_c") > F.lit(floor)).select("ctx", "target", F.col("_c").alias("_hot_c"))
    rows = agg.join(F.broadcast(hot), ["ctx", "target"], "left")
    spare = (-1 - F.pmod(F.xxhash64(*by), F.lit(SPREAD_KEYS))).cast("int")
    rows = rows.withColumn("_key", F.when(F.col("_hot_c").isNotNull(), spare).otherwise(F.col("ctx")))
    found = rows.join(seen.withColumnRenamed("ctx", "_key"), ["_key", "target"], "left")
    return found.select(*by, "ctx", "target", "n", F.coalesce("_hot_c", "_c").alias("_c"))


def pair_nll(eval_pairs: DataFrame, model: DataFrame, alpha: float = 0.0,
             vocab_size: int | None = None, by: tuple = ()) -> DataFrame:
    """(by..., ctx, target, n, nll) with unseen pairs/contexts smoothed.

    ``eval_pairs`` are pairs (by..., ctx, target), counted here first, or the
    rows of ``counted_pairs``, which have their count ``n`` already and are shuffled once,
    to the model.  Both joins are left joins: an unseen pair keeps
    alpha / (total + alpha*V); an unseen context gets 1/V (or +inf when
    alpha = 0).
    """
    agg = eval_pairs
    if "n" not in agg.columns:
        agg = agg.groupBy(*by, "ctx", "target").agg(F.count(F.lit(1)).alias("n"))
    elif not by:
        agg = agg.groupBy("ctx", "target").agg(F.sum("n").alias("n"))
    seen = model.select("ctx", F.col("token").alias("target"), F.col("count").alias("_c"))
    tot = context_totals(model).withColumnRenamed("ctx_total", "_t")
    # Contexts are vocabulary ids, so this table has at most V rows of about
    # 16 bytes; broadcast when that proves it small, else Spark chooses.
    if vocab_size and int(vocab_size) * 16 <= DEFAULT_BROADCAST_LIMIT:
        tot = F.broadcast(tot)
    j = (_join_counts(agg, seen, by) if by else agg.join(seen, ["ctx", "target"], "left")).join(tot, ["ctx"], "left")
    a, V = float(alpha), float(vocab_size or 0)
    num = F.coalesce(F.col("_c"), F.lit(0)).cast("double") + F.lit(a)
    den = F.coalesce(F.col("_t"), F.lit(0)).cast("double") + F.lit(a * V)
    p = F.when(den > 0, num / den).otherwise(F.lit(0.0))
    return j.select(*by, "ctx", "target", "n", nll_col(p).alias("nll"))


def in_sample_loss(model: DataFrame) -> DataFrame:
    """L2 on the pairs the table was fitted on: (loss, perplexity, n_tokens) from its counts alone."""
    nll = nll_col(F.col("count") / F.col("ctx_total"))
    out = model.agg((F.sum(F.col("count") * nll) / F.sum("count")).alias("loss"),
                    F.sum("count").cast("bigint").alias("n_tokens"))
    return out.select("loss", perplexity_col("loss").alias("perplexity"), "n_tokens")


def cross_entropy(eval_pairs: DataFrame, model: DataFrame, alpha: float = 0.0,
                  vocab_size: int | None = None, by: tuple = ()) -> DataFrame:
    """L2/L4: token-weighted mean -ln P(target | ctx) per ``by`` group.

    Output (by..., loss, perplexity, n_tokens).  Pairs whose target is the
    ignore index must already be filtered (``shifted_pairs`` does).
    """
    nll = pair_nll(eval_pairs, model, alpha, vocab_size, by)
    out = nll.groupBy(*by).agg((F.sum(F.col("n") * F.col("nll")) / F.sum("n")).alias("loss"),
                               F.sum("n").cast("bigint").alias("n_tokens"))
    return out.select(*by, "loss", perplexity_col("loss").alias("perplexity"), "n_tokens")


# ---------------------------------------------------------------- higher orders with back-off
def id_bits(vocab_size: int) -> int:
    return int(vocab_size).bit_length()  # ids 0 .. V - 1 and the start mark V


def ngram_rows(ids: DataFrame, order: int, vocab_size: int, col: str = "ids", eos_id: int | None = None,
               keep: tuple = ()) -> DataFrame:
    """(keep..., ctx BIGINT, token): every id with the ``order - 1`` ids before it, packed into one number.

    A text starts with ``order - 1`` start marks (id ``vocab_size``); with ``eos_id``
    it ends in that id.  The contexts are built inside the row, without a window.
    """
    bits = id_bits(vocab_size)
    if bits * (order - 1) > 62:
        raise ValueError("contexts of this order do not fit a 64-bit number")
    seq = F.col(col).cast("array<bigint>")
    if eos_id is not None:
        seq = F.concat(seq, F.array(F.lit(eos_id).cast("bigint")))
    before = [F.slice(F.concat(F.array_repeat(F.lit(int(vocab_size)).cast("bigint"), j), seq), 1, F.size(seq))
              for j in range(order - 1, 0, -1)]
    zipped = F.arrays_zip(*[c.alias(f"g{j}") for j, c in enumerate([*before, seq])])
    ctx = F.lit(0).cast("bigint")
    for j in range(order - 1):
        ctx = F.shiftleft(ctx, bits).bitwiseOR(F.col(f"_g.g{j}"))
    return (ids.select(*keep, F.explode_outer(zipped).alias("_g")).where(F.col("_g").isNotNull())
            .select(*keep, ctx.alias("ctx"), F.col(f"_g.g{order - 1}").cast("int").alias("token")))


def fit_ngram(rows: DataFrame, order: int, vocab_size: int) -> list[DataFrame]:
    """L1 of any order: the tables of an interpolated Kneser-Ney model, highest order first, each stored.

    ``rows`` are ``ngram_rows``.  A table has (ctx, token, count, ctx_total, ctx_types).  The highest
    order counts occurrences; each lower one counts the distinct words seen
    before its n-gram, which are the rows of the table above it, so one
    aggregate a level builds the cascade.  Counts aggregate map-side, and
    context totals add up counted rows, never occurrences.
    """
    bits = id_bits(vocab_size)
    levels, counts = [], rows.groupBy("ctx", "token").agg(F.count(F.lit(1)).alias("count"))
    for k in range(order, 0, -1):
        counts = cut_lineage(counts)
        totals = counts.groupBy("ctx").agg(F.sum("count").alias("ctx_total"), F.count(F.lit(1)).alias("ctx_types"))
        levels.append(counts.join(totals if k > 1 else F.broadcast(totals), "ctx"))  # one row at the last level
        if k > 1:  # one id shorter; ctx 0 is the empty context
            shorter = F.col("ctx").bitwiseAND(F.lit((1 << (bits * (k - 2))) - 1).cast("bigint"))
            counts = counts.select(shorter.alias("ctx"), "token").groupBy("ctx", "token").agg(
                F.count(F.lit(1)).alias("count"))
    return [cut_lineage(m) for m in levels]


def backoff_nll(rows: DataFrame, levels: list[DataFrame], vocab_size: int, discount: float = 0.75,
                by: tuple = ()) -> DataFrame:
    """L2 under ``fit_ngram``: (by..., ctx, token, n, nll) of the distinct n-grams of each ``by`` group.

    P_k = max(count - D, 0) / total + D * types / total * P_(k-1), down to
    1 / V; a context that was never seen passes its whole mass down.  Rows
    are counted before the joins; each level is one join on (ctx, token)
    and one on its contexts.
    """
    bits, order, d = id_bits(vocab_size), len(levels), float(discount)
    j = rows.groupBy(*by, "ctx", "token").agg(F.count(F.lit(1)).alias("n"))
    p = F.lit(1.0 / float(vocab_size))
    names = j.columns
    for k, level in zip(range(1, order + 1), reversed(levels)):
        mask = F.lit((1 << (bits * (k - 1))) - 1).cast("bigint")
        j = j.withColumn("_ctx", F.col("ctx").bitwiseAND(mask))
        pairs = level.select(F.col("ctx").alias("_ctx"), "token", F.col("count").alias("_c"))
        sums = level.select(F.col("ctx").alias("_ctx"), F.col("ctx_total").alias("_t"), F.col("ctx_types").alias("_u")).distinct()
        if k <= 2 and int(vocab_size) * 32 <= DEFAULT_BROADCAST_LIMIT:  # a row an id: a hot context meets no shuffle
            sums, pairs = F.broadcast(sums), F.broadcast(pairs) if k == 1 else pairs
        j = j.join(pairs, ["_ctx", "token"], "left").join(sums, "_ctx", "left")
        own = F.greatest(F.coalesce(F.col("_c"), F.lit(0)) - F.lit(d), F.lit(0.0)) / F.col("_t")
        level_p = F.when(F.col("_t").isNull(), p).otherwise(own + F.lit(d) * F.col("_u") / F.col("_t") * p)
        j = j.withColumn(f"_p{k}", level_p).select(*names, f"_p{k}")
        p = F.col(f"_p{k}")
    return j.select(*names, nll_col(p).alias("nll"))
