"""Next-token filtering, sampling and batch generation.

Every filter is a window partitioned by context over observed
candidates (at most V rows per context), so a hot context is bounded.
Greedy generation doubles paths over the successor table; sampled
generation decodes each task's prompts against the sent candidates, or, where these
are too large, joins the prompts with them token by token.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import DEFAULT_BROADCAST_LIMIT, cut_lineage
from .joins import fits_broadcast, salted_join, sized_join
from .rank import hash_key
from .vocab import EOS_ID

TWO_POW_32 = 4294967296.0


def softmax(scores: DataFrame, ctx: str = "ctx", score: str = "score", out: str = "prob") -> DataFrame:
    """exp(x - max) / sum(exp(x - max)) per context."""
    w = Window.partitionBy(ctx)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return scores.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def top_k(scores: DataFrame, k: int, ctx: str = "ctx", score: str = "score", token: str = "token") -> DataFrame:
    """The k highest scores per context (ties by token id); k <= 0 keeps all.

    Catalyst turns ``row_number() <= k`` into a per-task WindowGroupLimit
    before the shuffle.
    """
    if k <= 0:
        return scores
    order = Window.partitionBy(ctx).orderBy(F.desc(score), F.asc(token))
    return scores.withColumn("_rk", F.row_number().over(order)).where(F.col("_rk") <= int(k)).drop("_rk")


def top_p(dist: DataFrame, p: float, ctx: str = "ctx", weight: str = "w", token: str = "token") -> DataFrame:
    """Nucleus filter; a candidate is dropped when the probability mass
    strictly before it exceeds ``p``; the first always stays; p >= 1 keeps all."""
    if p >= 1.0:
        return dist
    order = Window.partitionBy(ctx).orderBy(F.desc(weight), F.asc(token))
    before = F.coalesce(F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum(weight).over(Window.partitionBy(ctx))
    return (dist.withColumn("_before", before).withColumn("_tot", total)
            .where(F.col("_before") <= F.lit(float(p)) * F.col("_tot")).drop("_before", "_tot"))


def next_token_dist(model: DataFrame, temperature: float = 1.0, k: int = 50, p: float = 0.9,
                    alpha: float = 0.0, score: str | None = None) -> DataFrame:
    """Temperature -> top-k -> top-p -> renormalise, per context.

    Input ``(ctx, token, count)``, or with ``score`` the name of a column of
    real scores (log-probabilities, dot products; any sign).  Counts score
    ln(count + alpha).  Weights are exp((s - max s) / T): the largest is 1,
    so none overflows at a small T.  T <= 0 leaves scores unscaled.  A NaN,
    null or minus-infinite score has weight 0; a context without any mass
    becomes uniform over its candidates.  Output
    ``(ctx, token, prob, cum_prob, rank)`` over surviving candidates,
    ``cum_prob`` inclusive and ``rank`` 1-based in score order.
    """
    none = F.lit(float("-inf"))
    if score is None:
        base = F.col("count").cast("double") + F.lit(float(alpha))
        s = F.when(base > 0, F.ln(base)).otherwise(none)
    else:
        s = F.col(score).cast("double")
        s = F.when(F.isnan(s) | s.isNull(), none).otherwise(s)
    d = model.select("ctx", "token", s.alias("_s"))
    gap = F.col("_s") - F.max("_s").over(Window.partitionBy("ctx"))
    scaled = gap / F.lit(float(temperature)) if temperature > 0 else gap
    # inf - inf is NaN: all candidates at -inf (no mass), or those at +inf (all of it).
    d = d.select("ctx", "token", F.when(F.isnan(gap), F.lit(1.0)).otherwise(F.exp(scaled)).alias("w"))
    d = top_k(d, k, score="w")
    d = top_p(d, p)
    order = Window.partitionBy("ctx").orderBy(F.desc("w"), F.asc("token"))
    tot = F.sum("w").over(Window.partitionBy("ctx"))
    cum = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return d.select("ctx", "token", (F.col("w") / tot).alias("prob"), (cum / tot).alias("cum_prob"),
                    F.row_number().over(order).alias("rank"))


def greedy_next(model: DataFrame, score: str = "count") -> DataFrame:
    """(ctx, token) with the highest score per context; ties -> lowest token id."""
    order = Window.partitionBy("ctx").orderBy(F.desc(score), F.asc("token"))
    return model.withColumn("_rk", F.row_number().over(order)).where(F.col("_rk") == 1).select("ctx", "token")


def uniform_draw(seed: int, *keys: Column | str) -> Column:
    """Reproducible u in [0, 1) from md5(seed:key...:step)."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    h = F.conv(F.substring(hash_key(seed, *cols), 1, 8), 16, 10).cast("bigint")
    return h.cast("double") / F.lit(TWO_POW_32)


def sample_next(frontier: DataFrame, dist: DataFrame, u: Column, ctx_col: str = "last",
                broadcast_limit: int = DEFAULT_BROADCAST_LIMIT) -> DataFrame:
    """Inverse-CDF draw -- the first candidate whose cumulative prob exceeds u."""
    table = cut_lineage(candidate_table(dist))  # stored, then measured
    return _pick(frontier.withColumn("_u", u), table, ctx_col, fits_broadcast(table, broadcast_limit))


def candidate_table(dist: DataFrame) -> DataFrame:
    """One row per context: candidates sorted by rank (<= k per context)."""
    return dist.groupBy(F.col("ctx").alias("_ctx")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "token", "cum_prob"))).alias("_cands"))


def _pick(frontier: DataFrame, table: DataFrame, ctx_col: str, small: bool) -> DataFrame:
    j = sized_join(frontier.withColumn("_ctx", F.col(ctx_col)), table, "_ctx", "left", small_fits=small)
    hit = F.filter("_cands", lambda c: c["cum_prob"] > F.col("_u"))
    chosen = F.coalesce(F.element_at(hit, 1)["token"], F.element_at("_cands", -1)["token"])
    return j.withColumn("next_token", chosen).drop("_ctx", "_cands", "_u")


def successor_paths(best: DataFrame, steps: int, eos_id: int = EOS_ID) -> list[DataFrame]:
    """Greedy continuations of 1, 2, 4, ... tokens of every context: stored (ctx, path), up to ``steps``.

    A path of 2n tokens is a path of n tokens and the path of its last one,
    so doubling takes one join a power of two.  A path ends at its EOS; a
    token without a successor is followed by EOS.  Each table has at most a
    row per context of the model.
    """
    eos = F.lit(int(eos_id)).cast("int")
    paths = [cut_lineage(best.select("ctx", F.array(F.col("token").cast("int")).alias("path")))]
    while 2 ** len(paths) <= steps:
        half = paths[-1].withColumn("_last", F.element_at("path", -1))
        rest = paths[-1].select(F.col("ctx").alias("_last"), F.col("path").alias("_rest"))
        on = F.when(F.col("_last") == eos, F.array().cast("array<int>")).otherwise(F.coalesce("_rest", F.array(eos)))
        paths.append(cut_lineage(half.join(rest, "_last", "left").select("ctx", F.concat("path", on).alias("path"))))
    return paths


def _greedy(prompts: DataFrame, model: DataFrame, steps: int, eos_id: int, keys: list) -> DataFrame:
    """Greedy part of ``generate``: as many joins as ``steps`` has binary digits, whatever the number of tokens."""
    eos = F.lit(int(eos_id)).cast("int")
    paths = successor_paths(greedy_next(model), steps, eos_id) if steps > 0 else []
    live = prompts.select(*keys, F.element_at("ids", -1).alias("_last"), F.array().cast("array<int>").alias("_new"))
    for power in range(len(paths) - 1, -1, -1):
        if not steps >> power & 1:
            continue
        jump = paths[power].select(F.col("ctx").alias("_last"), F.col("path").alias("_path"))
        done = (F.size("_new") > 0) & (F.col("_last") == eos)  # a prompt may end in EOS and still goes on
        path = F.when(done, F.array().cast("array<int>")).otherwise(F.coalesce("_path", F.array(eos)))
        new = F.concat("_new", path)
        live = salted_join(live, jump, "_last", "left").select(
            *keys, F.when(F.size(path) > 0, F.element_at(path, -1)).otherwise(F.col("_last")).alias("_last"), new.alias("_new"))
    return live.select(*keys, "_new")


def _send_candidates(table: DataFrame):
    """Candidates (ctx, token, cum_prob by rank) as arrays, sent to the tasks."""
    t = table.select("ctx", "token", "cum_prob", "rank").toArrow()
    ctx, rank = t.column("ctx").to_numpy(), t.column("rank").to_numpy()
    order = np.lexsort((rank, ctx))
    ctx = ctx[order]
    first = np.flatnonzero(np.diff(ctx, prepend=ctx[:1] - 1)) if len(ctx) else np.zeros(0, np.int64)
    return table.sparkSession.sparkContext.broadcast((
        ctx[first], np.append(first, len(ctx)), t.column("token").to_numpy()[order].astype(np.int32),
        t.column("cum_prob").to_numpy()[order]))


def _sampled(prompts: DataFrame, dist: DataFrame, steps: int, eos_id: int, seed: int, keys: list) -> DataFrame:
    """Sampled part of ``generate`` without joins: every task decodes its prompts against the sent candidates.

    The draws are columns of the prompt; a step is one search for all of a batch's prompts.
    """
    sent = _send_candidates(dist)

    def run(last: pa.Array, draws: pa.Array) -> pa.Array:
        contexts, first, tokens, cum = sent.value
        now = last.to_numpy(zero_copy_only=False).astype(np.int64)
        u = draws.flatten().to_numpy(zero_copy_only=False).reshape(len(now), steps)
        made, live = np.full((len(now), steps), -1, dtype=np.int32), np.ones(len(now), dtype=bool)
        for step in range(steps):
            rows = np.flatnonzero(live)
            if not len(rows):
                break
            at = np.searchsorted(contexts, now[rows])
            known = at < len(contexts)
            known[known] = contexts[at[known]] == now[rows][known]
            nxt = np.full(len(rows), eos_id, dtype=np.int64)
            low, high = first[at[known]].copy(), first[at[known] + 1] - 1
            end, draw = high.copy(), u[rows[known], step]
            while (low < high).any():  # first candidate whose cumulative probability exceeds the draw, else the last
                middle = (low + high) // 2
                above = cum[middle] > draw
                high, low = np.where(above, middle, high), np.where(above, low, np.minimum(middle + 1, end))
            nxt[known] = tokens[low]
            made[rows, step] = nxt
            now[rows] = nxt
            live[rows] = nxt != eos_id
        sizes = (made >= 0).sum(axis=1)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(made[made >= 0]))

    draws = F.array(*[uniform_draw(seed, *keys, F.lit(step)) for step in range(steps)])
    return prompts.select(*keys, "ids", F.arrow_udf(run, "array<int>")(F.element_at("ids", -1), draws).alias("_new"))


def generate(prompts: DataFrame, model: DataFrame, max_new_tokens: int = 50, do_sample: bool = True,
             temperature: float = 1.0, k: int = 50, p: float = 0.9, eos_id: int = EOS_ID,
             seed: int = 42, keys: tuple = ("doc_id",), col: str = "ids",
             broadcast_limit: int = DEFAULT_BROADCAST_LIMIT, checkpoint_every: int = 10) -> DataFrame:
    """Continue every prompt up to ``max_new_tokens`` tokens.

    Greedy (``do_sample=False`` or T = 0, D9) takes the arg-max per
    context, by doubled paths (``successor_paths``): joins logarithmic in the length.  Sampled
    draws from ``next_token_dist``: candidates that are measured under ``broadcast_limit``
    go to the tasks, which decode without joins; beyond it the prompts are
    joined with them token by token (``generate_by_joins``).  Each row stops at
    its own EOS (kept in the output); a context never seen in training
    yields EOS.  Output ``(keys..., ids, n_new)`` including the prompt; keys are unique.
    """
    keys, steps = list(keys), int(max_new_tokens)
    texts = prompts.where(F.size(col) > 0).select(*keys, F.col(col).alias("ids"))
    if not do_sample or temperature == 0:
        texts = cut_lineage(texts)
        new = texts.join(_greedy(texts, model, steps, eos_id, keys), keys)
    else:
        dist = cut_lineage(next_token_dist(model, temperature, k, p).select("ctx", "token", "cum_prob", "rank"))
        if steps > 0 and not fits_broadcast(dist, broadcast_limit):
            return generate_by_joins(prompts, model, steps, True, temperature, k, p, eos_id, seed, tuple(keys), col,
                                     broadcast_limit, checkpoint_every)
        new = (_sampled(texts, dist, steps, eos_id, seed, keys) if steps > 0
               else texts.withColumn("_new", F.array().cast("array<int>")))
    return new.select(*keys, F.concat("ids", "_new").alias("ids"), F.size("_new").alias("n_new"))


def generate_by_joins(prompts: DataFrame, model: DataFrame, max_new_tokens: int = 50, do_sample: bool = True,
             temperature: float = 1.0, k: int = 50, p: float = 0.9, eos_id: int = EOS_ID,
             seed: int = 42, keys: tuple = ("doc_id",), col: str = "ids",
             broadcast_limit: int = DEFAULT_BROADCAST_LIMIT, checkpoint_every: int = 10) -> DataFrame:
    """``generate`` by one join a token, for candidate tables of any size.

    Greedy (``do_sample=False`` or T = 0, D9) takes the arg-max per
    context; sampled draws from ``next_token_dist``.  Each row stops at
    its own EOS (kept in the output); a context never seen in training
    yields EOS.  Output ``(keys..., ids, n_new)`` including the prompt.
    The loop carries each live prompt's last token alone.  Every
    ``checkpoint_every`` steps the new tokens are written to the shared
    checkpoint folder, finished prompts leave and the loop stops when none
    is left; the parts are put together once, by prompt (keys are unique).
    """
    greedy = (not do_sample) or temperature == 0
    if greedy:
        best = greedy_next(model)
        table = best.select(F.col("ctx").alias("_ctx"),
                            F.array(F.struct(F.lit(1).alias("rank"), F.col("token"),
                                             F.lit(1.0).alias("cum_prob"))).alias("_cands"))
    else:
        table = candidate_table(next_token_dist(model, temperature, k, p))
    table = cut_lineage(table)
    small = fits_broadcast(table, broadcast_limit)
    keys, eos = list(keys), F.lit(int(eos_id))
    texts = cut_lineage(prompts.where(F.size(col) > 0).select(*keys, F.col(col).alias("ids")))
    live = texts.select(*keys, F.element_at("ids", -1).alias("last"))
    out, steps = texts, int(max_new_tokens)
    for start in range(0, steps, checkpoint_every):
        made = []
        for step in range(start, min(start + checkpoint_every, steps)):
            # The draw is a column below the join, so it is hashed once a row and not once a candidate.
            u = F.lit(0.0) if greedy else uniform_draw(seed, *keys, F.lit(step))
            live = _pick(live.withColumn("_u", u), table, "last", small)
            nxt = F.when(F.col("last").isNotNull() & (F.col("last") != eos), F.coalesce("next_token", eos))
            if not made:  # a prompt may end in EOS and still goes on
                nxt = F.coalesce("next_token", eos)
            made.append(f"_t{step}")
            live = live.select(*keys, *made[:-1], nxt.alias(made[-1]), nxt.alias("last"))
        part = cut_lineage(live.select(*keys, F.array_compact(F.array(*made)).alias(f"_part{start}"), "last"))
        out = out.join(part.drop("last"), keys, "left")
        live = part.where(F.col("last").isNotNull() & (F.col("last") != eos)).select(*keys, "last")
        if start + checkpoint_every < steps and live.isEmpty():
            break
    parts = [F.coalesce(F.col(c), F.array().cast("array<int>")) for c in out.columns if c.startswith("_part")]
    new = F.concat(*parts) if parts else F.array().cast("array<int>")
    return out.select(*keys, F.concat("ids", new).alias("ids"), F.size(new).alias("n_new"))
