"""DuckDB SQL for every registered query (same tables, same column names and types).

Written independently of the Spark code: plain window functions and
list functions over the pre-registered parquet views.
"""

from __future__ import annotations

from ..functions.text import NONBLANK_PATTERN as NB, TOKEN_PATTERN as TP
from ..operators.rank import feistel_keys
from . import catalog as C

V, N, R, SEED = C.V, C.N, C.RETRUNC, C.SEED
W, B, G = C.CFG.world, C.CFG.batch_size, C.CFG.accumulation

DOCS = f"docs AS (SELECT doc_id, text, lang, source FROM documents WHERE regexp_matches(text, '{NB}'))"
TOKS = f"toks AS (SELECT doc_id, lang, source, regexp_extract_all(text, '{TP}') AS tokens FROM docs)"
VOCAB = f"""cnt AS (SELECT tok, count(*) AS c FROM (SELECT unnest(tokens) AS tok FROM toks) GROUP BY tok),
top_tok AS (SELECT tok, CAST(row_number() OVER (ORDER BY c DESC, tok) + 1 AS INTEGER) AS id, CAST(c AS BIGINT) AS count
            FROM cnt QUALIFY row_number() OVER (ORDER BY c DESC, tok) <= {V - 2}),
vocab AS (SELECT * FROM top_tok UNION ALL SELECT '<eos>', 0, CAST(0 AS BIGINT) UNION ALL SELECT '<unk>', 1, CAST(0 AS BIGINT))"""
ENC = """ex AS (SELECT doc_id, unnest(range(1, len(tokens) + 1)) AS pos, unnest(tokens) AS tok FROM toks),
enc AS (SELECT ex.doc_id, list(coalesce(v.id, 1) ORDER BY ex.pos) AS ids
        FROM ex LEFT JOIN vocab v ON v.tok = ex.tok GROUP BY ex.doc_id)"""
SEQS = f"""seqs AS (SELECT doc_id, ids,
   list_concat(ids, list_transform(range({N} - len(ids)), lambda x: 0)) AS input_ids,
   list_transform(range({N}), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END) AS attention_mask,
   list_concat(ids, list_transform(range({N} - len(ids)), lambda x: -100)) AS labels
 FROM (SELECT doc_id, list_slice(ids, 1, {N}) AS ids FROM enc))"""
SPLIT = f"""sp0 AS (SELECT doc_id, row_number() OVER (ORDER BY md5('{SEED}:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r,
                count(*) OVER () AS nn FROM docs),
sp1 AS (SELECT doc_id, r, nn, CAST(floor(0.8::DOUBLE * nn) AS BIGINT) AS nt FROM sp0),
split AS (SELECT doc_id, CASE WHEN r < nt THEN 'train' ELSE 'val' END AS split,
                 CAST(CASE WHEN r < nt THEN r ELSE r - nt END AS BIGINT) AS idx,
                 CAST(CASE WHEN r < nt THEN nt ELSE nn - nt END AS BIGINT) AS split_n FROM sp1)"""


def ORDER(epoch: int, name: str = "ord") -> str:
    return f"""{name} AS (SELECT doc_id,
      row_number() OVER (ORDER BY md5('0:{epoch}:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS idx,
      count(*) OVER () AS n FROM split WHERE split = 'train')"""


def SHARD(src: str, world: int, name: str = "sh") -> str:
    return f"""{name}0 AS (SELECT doc_id, idx, n, (n + {world - 1}) // {world} * {world} AS tot FROM {src}),
{name} AS (SELECT doc_id, CAST(j % {world} AS INTEGER) AS rank, CAST(j // {world} AS BIGINT) AS pos,
                  tot // {world} AS rank_n
           FROM (SELECT doc_id, tot, unnest(range(idx, tot, n)) AS j FROM {name}0))"""


def PAIRS(src: str, name: str, eos: bool = False) -> str:
    seq = "list_append(ids, 0)" if eos else "ids"
    return f"""{name} AS (SELECT doc_id, pos, s[pos + 1] AS ctx, s[pos + 2] AS target
      FROM (SELECT doc_id, s, unnest(range(0, len(s) - 1)) AS pos FROM (SELECT doc_id, {seq} AS s FROM {src})))"""


def MODEL(pairs: str, name: str = "model") -> str:
    return f"""{name} AS (SELECT ctx, target AS token, CAST(count(*) AS BIGINT) AS count,
      CAST(sum(count(*)) OVER (PARTITION BY ctx) AS BIGINT) AS ctx_total FROM {pairs} GROUP BY ctx, target)"""


TRAIN_IDS = "trids AS (SELECT e.doc_id, e.ids FROM enc e JOIN split s USING (doc_id) WHERE s.split = 'train')"
VAL_IDS = "vids AS (SELECT e.doc_id, e.ids FROM enc e JOIN split s USING (doc_id) WHERE s.split = 'val')"


def w(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


BASE = (DOCS, TOKS, VOCAB, ENC)
MODEL_BASE = BASE + (SPLIT, TRAIN_IDS, PAIRS("trids", "trp"), MODEL("trp"))

VAL_NLL = (VAL_IDS, PAIRS("vids", "vp"),
           f"""vagg AS (SELECT doc_id, ctx, target, count(*) AS n FROM vp GROUP BY doc_id, ctx, target),
ctxt AS (SELECT ctx, max(ctx_total) AS t FROM model GROUP BY ctx),
vprob AS (SELECT a.doc_id, a.n,
   (coalesce(m.count, 0) + {C.ALPHA}::DOUBLE) / (coalesce(c.t, 0) + {C.ALPHA}::DOUBLE * {V}) AS p
 FROM vagg a LEFT JOIN model m ON m.ctx = a.ctx AND m.token = a.target LEFT JOIN ctxt c ON c.ctx = a.ctx),
vnll AS (SELECT doc_id, n, CASE WHEN p > 0 THEN -ln(p) ELSE 'inf'::DOUBLE END AS nll FROM vprob),
dsum AS (SELECT doc_id, sum(n * nll) AS nll_sum, sum(n) AS n_targets FROM vnll GROUP BY doc_id)""")

VAL_BATCH = ("vsrc AS (SELECT doc_id, idx, split_n AS n FROM split WHERE split = 'val')", SHARD("vsrc", W, "vsh"),
             f"vb AS (SELECT doc_id, rank, pos // {B} AS batch_id FROM vsh)",
             """bl AS (SELECT b.rank, b.batch_id, sum(coalesce(d.nll_sum, 0)) AS s,
                    CAST(sum(coalesce(d.n_targets, 0)) AS BIGINT) AS n_targets
             FROM vb b LEFT JOIN dsum d USING (doc_id) GROUP BY b.rank, b.batch_id),
blo AS (SELECT rank, batch_id, CASE WHEN n_targets > 0 THEN s / n_targets ELSE 'nan'::DOUBLE END AS loss, n_targets FROM bl)""")

GEN_MODEL = BASE + (SPLIT, TRAIN_IDS, PAIRS("trids", "gp", eos=True), MODEL("gp", "gmodel"))
DIST = f"""w0 AS (SELECT ctx, token, exp((ln(CAST(count AS DOUBLE)) - max(ln(CAST(count AS DOUBLE))) OVER (PARTITION BY ctx))
    / {C.TEMP}::DOUBLE) AS w FROM gmodel),
k1 AS (SELECT * FROM w0 QUALIFY row_number() OVER (PARTITION BY ctx ORDER BY w DESC, token) <= {C.TOP_K}),
p1 AS (SELECT * FROM k1 QUALIFY coalesce(sum(w) OVER (PARTITION BY ctx ORDER BY w DESC, token
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= {C.TOP_P}::DOUBLE * sum(w) OVER (PARTITION BY ctx)),
dist AS (SELECT ctx, token, w / sum(w) OVER (PARTITION BY ctx) AS prob,
   sum(w) OVER (PARTITION BY ctx ORDER BY w DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
     / sum(w) OVER (PARTITION BY ctx) AS cum_prob,
   row_number() OVER (PARTITION BY ctx ORDER BY w DESC, token) AS rank FROM p1),
cands AS (SELECT ctx, list(struct_pack(rank := rank, token := token, cum := cum_prob) ORDER BY rank) AS cs
          FROM dist GROUP BY ctx)"""
PROMPTS = f"""pt AS (SELECT conv_id, turn, regexp_extract_all(text, '{TP}') AS tokens FROM conversations
        WHERE role = 'user' AND regexp_matches(text, '{NB}')),
pex AS (SELECT conv_id, turn, unnest(range(1, len(tokens) + 1)) AS pos, unnest(tokens) AS tok FROM pt),
pids AS (SELECT conv_id, turn, list(coalesce(v.id, 1) ORDER BY pos) AS ids
         FROM pex LEFT JOIN vocab v ON v.tok = pex.tok GROUP BY conv_id, turn)"""


def _u(step: str, *keys: str) -> str:
    parts = " || ':' || ".join([f"CAST({k} AS VARCHAR)" for k in keys] + [f"CAST({step} AS VARCHAR)"])
    return f"(CAST(('0x' || substr(md5('{SEED}:' || {parts}), 1, 8)) AS BIGINT) / 4294967296.0)"


MICRO = ("micro AS (SELECT user_id AS run_id, ts, value AS loss, "
         "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)")
UPDATES = (MICRO, f"""upd AS (SELECT run_id, n // {C.LOG_ACCUM} + 1 AS step, sum(loss) AS loss_sum, max(ts) AS ts
   FROM micro GROUP BY run_id, n // {C.LOG_ACCUM} HAVING count(*) = {C.LOG_ACCUM})""")


def WINDOWS(every: int, accum: int) -> str:
    span = every * accum
    return f"""win AS (SELECT run_id, n // {span} AS m, sum(loss) AS s, max(ts) AS ts FROM micro
      GROUP BY run_id, n // {span} HAVING count(*) = {span}),
win2 AS (SELECT a.*, b.ts AS prev_ts, (epoch_us(a.ts) - epoch_us(b.ts)) / 1e6 AS dt,
         CAST((a.m + 1) * {every} AS BIGINT) AS step
         FROM win a LEFT JOIN win b ON b.run_id = a.run_id AND b.m = a.m - 1)"""


def LAMBDA(step: str, warm: str, total: str, kind: str) -> str:
    s, wd, td = f"CAST({step} AS DOUBLE)", f"CAST({warm} AS DOUBLE)", f"CAST({total} AS DOUBLE)"
    span = f"greatest(1.0, {td} - {wd})"
    if kind == "cosine":
        after = f"greatest(0.0, 0.5 * (1.0 + cos(pi() * (({s} - {wd}) / {span}))))"
    elif kind == "linear":
        after = f"greatest(0.0, ({td} - {s}) / {span})"
    else:
        after = "1.0"
    return f"(CASE WHEN {s} < {wd} THEN {s} / greatest(1.0, {wd}) ELSE {after} END)"


def _rate(expr: str) -> str:
    return f"(CASE WHEN prev_ts IS NULL THEN NULL WHEN dt > 0 THEN {expr} ELSE 0.0 END)"


SQL: dict[str, str] = {}

SQL["text_fallback"] = """WITH t AS (SELECT doc_id, CASE WHEN text IS NULL THEN '' WHEN doc_id % 3 <> 0 THEN text
  WHEN doc_id % 2 = 0 THEN 'content ' || text ELSE '' END AS t FROM documents)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5 FROM t"""
SQL["nonblank_documents"] = w(DOCS) + "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM docs"
SQL["tokenize_documents"] = w(DOCS, TOKS) + (
    "SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM toks")
SQL["build_vocab"] = w(DOCS, TOKS, VOCAB) + "SELECT tok, id, count FROM vocab"
SQL["encode_documents"] = w(*BASE) + (
    "SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_ids, array_to_string(ids, ' ') AS ids FROM enc")
SQL["truncate_tokens"] = w(DOCS, TOKS) + (
    f"SELECT doc_id, CAST(len(list_slice(tokens, 1, {N})) AS BIGINT) AS n_tokens, "
    f"md5(array_to_string(list_slice(tokens, 1, {N}), ' ')) AS tokens_md5 FROM toks")
SQL["pad_tokens"] = w(*BASE, SEQS) + "SELECT doc_id, array_to_string(input_ids, ' ') AS input_ids FROM seqs"
SQL["attention_mask"] = w(*BASE, SEQS) + (
    "SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_real, array_to_string(attention_mask, ' ') AS attention_mask FROM seqs")
SQL["label_mask"] = w(*BASE, SEQS) + "SELECT doc_id, array_to_string(labels, ' ') AS labels FROM seqs"
SQL["retruncate"] = w(*BASE, SEQS) + (
    f"SELECT doc_id, array_to_string(list_slice(input_ids, 1, {R}), ' ') AS input_ids, "
    f"array_to_string(list_slice(attention_mask, 1, {R}), ' ') AS attention_mask, "
    f"array_to_string(list_slice(labels, 1, {R}), ' ') AS labels FROM seqs")
SQL["shifted_pairs"] = w(*BASE, PAIRS("enc", "pr")) + (
    "SELECT doc_id, CAST(pos AS INTEGER) AS pos, ctx, target FROM pr")
SQL["detokenize"] = w(*BASE) + """, dex AS (SELECT doc_id, unnest(range(1, len(ids) + 1)) AS pos, unnest(ids) AS id FROM enc)
SELECT d.doc_id, coalesce(array_to_string(list(v.tok ORDER BY d.pos) FILTER (WHERE d.id > 0), ' '), '') AS text
FROM dex d LEFT JOIN vocab v ON v.id = d.id GROUP BY d.doc_id"""
SQL["ingest_bounded"] = f"SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT {C.INGEST_SHARDS * C.SHARD_ROWS}"
SQL["dataset_manifest"] = w(*BASE) + (
    f"SELECT CAST(count(*) AS BIGINT) AS samples, CAST({N} AS INTEGER) AS max_length, "
    f"'{C.TOKENIZER}' AS tokenizer FROM enc")
SQL["token_counts"] = w(DOCS, TOKS) + (
    f"SELECT lang, source, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(tokens)) AS BIGINT) AS n_tokens "
    "FROM toks GROUP BY lang, source")
SQL["unk_counts"] = w(DOCS, TOKS, VOCAB) + (
    "SELECT lang, source, CAST(count(*) AS BIGINT) AS n_tokens, "
    "CAST(count(*) FILTER (WHERE tok NOT IN (SELECT tok FROM vocab)) AS BIGINT) AS n_unk "
    "FROM (SELECT lang, source, unnest(tokens) AS tok FROM toks) GROUP BY lang, source")

SQL["global_rank"] = w(DOCS) + (
    f"SELECT doc_id, CAST(row_number() OVER (ORDER BY md5('{SEED}:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS BIGINT) AS rank FROM docs")
SQL["epoch_shuffle"] = w(DOCS, SPLIT, ORDER(0, "o0"), ORDER(1, "o1")) + (
    "SELECT doc_id, 0 AS epoch, CAST(idx AS BIGINT) AS idx FROM o0 UNION ALL "
    "SELECT doc_id, 1 AS epoch, CAST(idx AS BIGINT) AS idx FROM o1")
SQL["train_val_split"] = w(DOCS, SPLIT) + "SELECT doc_id, split, idx FROM split"
SQL["split_sizes"] = w(DOCS, SPLIT) + "SELECT split, CAST(count(*) AS BIGINT) AS n_rows FROM split GROUP BY split"
SQL["rank_shards"] = w(DOCS, SPLIT, ORDER(0), SHARD("ord", 7)) + "SELECT doc_id, rank, pos FROM sh"
SQL["batches_train"] = w(DOCS, SPLIT, ORDER(0), SHARD("ord", W)) + (
    f"SELECT doc_id, rank, pos, CAST(pos // {B} AS BIGINT) AS batch_id FROM sh WHERE pos < rank_n // {B} * {B}")
SQL["stored_batches"] = (
    "SELECT CAST(rank AS BIGINT) AS rank, batch_id, count(*) AS n_docs, md5(string_agg(ids, '|' ORDER BY pos)) AS ids_md5 "
    f"FROM ({SQL['batches_train']}) JOIN ({SQL['encode_documents']}) USING (doc_id) GROUP BY ALL")
SQL["batches_val"] = w(DOCS, SPLIT, "vsrc AS (SELECT doc_id, idx, split_n AS n FROM split WHERE split = 'val')",
                       SHARD("vsrc", W)) + f"SELECT doc_id, rank, pos, CAST(pos // {B} AS BIGINT) AS batch_id FROM sh"
SQL["update_groups"] = w(DOCS, SPLIT, ORDER(0), SHARD("ord", W)) + (
    f"SELECT doc_id, rank, CAST(pos // {B} AS BIGINT) AS batch_id, CAST(pos // {B} // {G} + 1 AS BIGINT) AS step "
    f"FROM sh WHERE pos < rank_n // {B} * {B} AND pos // {B} < (rank_n // {B}) // {G} * {G}")
SQL["step_plan"] = w(DOCS, SPLIT) + (
    f"SELECT n_train, spr AS samples_per_rank, spr // {B} AS batches_per_epoch, spr // {B} // {G} AS updates_per_epoch, "
    f"spr // {B} // {G} * 1 AS total_steps FROM (SELECT CAST(count(*) AS BIGINT) AS n_train, "
    f"CAST((count(*) + {W - 1}) // {W} AS BIGINT) AS spr FROM split WHERE split = 'train')")
SQL["val_subset_semi"] = w(DOCS, SPLIT) + (
    "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM split WHERE split = 'val')")

SQL["bigram_fit"] = w(*MODEL_BASE) + (
    "SELECT ctx, token, count, ctx_total, round(count / ctx_total, 9) AS p FROM model")


def _feistel(x: str, high: int, low: int) -> str:
    def f(half: str, bits: int) -> str:
        return f"((((({half}) * 1103515245 + (e & 2147483647)) % 2147483647) * 48271 % 2147483647) >> 7) & {(1 << bits) - 1}"
    return (f"list_reduce(list_prepend({x}, ks), lambda v, e: CASE WHEN (e >> 31) % 2 = 0 THEN xor(v, {f(f'v >> {low}', low)}) "
            f"ELSE xor(v, ({f(f'v & {(1 << low) - 1}', high)}) << {low}) END)")


def epoch_order_sql(n: int) -> str:
    """Places of a train split of ``n`` documents in epochs 0 and 1."""
    high, low, _ = feistel_keys(0, 0, n)
    parts = [f"SELECT {e} AS epoch, {feistel_keys(C.CFG.sampler_seed, e, n)[2]}::BIGINT[] AS ks" for e in (0, 1)]
    walk = (f"list_reduce(list_prepend({_feistel('idx', high, low)}, range(63)), "
            f"lambda y, i: CASE WHEN y < {n} THEN y ELSE {_feistel('y', high, low)} END)")
    return w(DOCS, SPLIT, "k AS (" + " UNION ALL ".join(parts) + ")") + (
        f"SELECT doc_id, epoch, {walk} AS place FROM split, k WHERE split = 'train'")


SQL["subword_round_trip"] = w(DOCS) + (  # lossless: what comes back is the text
    "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM docs")


def _TRIGRAMS(src: str, name: str) -> str:
    return f"""{name} AS (SELECT doc_id, s[p] AS g1, s[p + 1] AS g2, s[p + 2] AS token FROM (
  SELECT doc_id, s, unnest(range(1, len(s) - 1)) AS p FROM (SELECT doc_id, list_concat([{V}, {V}], ids) AS s FROM {src})))"""


KNESER_NEY = (_TRIGRAMS("trids", "tg"),
              "k3 AS (SELECT g1, g2, token, CAST(count(*) AS BIGINT) AS c FROM tg GROUP BY ALL)",
              "k2 AS (SELECT g2, token, CAST(count(*) AS BIGINT) AS c FROM k3 GROUP BY ALL)",
              "k1 AS (SELECT token, CAST(count(*) AS BIGINT) AS c FROM k2 GROUP BY ALL)",
              "t3 AS (SELECT g1, g2, CAST(sum(c) AS BIGINT) AS t, CAST(count(*) AS BIGINT) AS u FROM k3 GROUP BY ALL)",
              "t2 AS (SELECT g2, CAST(sum(c) AS BIGINT) AS t, CAST(count(*) AS BIGINT) AS u FROM k2 GROUP BY ALL)",
              "t1 AS (SELECT sum(c) AS t, count(*) AS u FROM k1)")
SQL["trigram_fit"] = w(*BASE, SPLIT, TRAIN_IDS, *KNESER_NEY) + (
    "SELECT g1 AS first, g2 AS second, token, c AS count, t AS ctx_total, u AS ctx_types FROM k3 JOIN t3 USING (g1, g2)")
SQL["trigram_perplexity"] = w(*BASE, SPLIT, TRAIN_IDS, VAL_IDS, *KNESER_NEY, _TRIGRAMS("vids", "vg"), f"""
va AS (SELECT lang, g1, g2, token, count(*) AS n FROM vg JOIN docs USING (doc_id) GROUP BY ALL),
p1 AS (SELECT va.*, greatest(coalesce(k1.c, 0) - {C.DISCOUNT}, 0) / t1.t + {C.DISCOUNT} * t1.u / t1.t / {V} AS p
       FROM va CROSS JOIN t1 LEFT JOIN k1 USING (token)),
p2 AS (SELECT p1.* EXCLUDE (p), CASE WHEN t2.t IS NULL THEN p
         ELSE greatest(coalesce(k2.c, 0) - {C.DISCOUNT}, 0) / t2.t + {C.DISCOUNT} * t2.u / t2.t * p END AS p
       FROM p1 LEFT JOIN k2 ON k2.g2 = p1.g2 AND k2.token = p1.token LEFT JOIN t2 ON t2.g2 = p1.g2),
p3 AS (SELECT p2.* EXCLUDE (p), CASE WHEN t3.t IS NULL THEN p
         ELSE greatest(coalesce(k3.c, 0) - {C.DISCOUNT}, 0) / t3.t + {C.DISCOUNT} * t3.u / t3.t * p END AS p
       FROM p2 LEFT JOIN k3 ON k3.g1 = p2.g1 AND k3.g2 = p2.g2 AND k3.token = p2.token
       LEFT JOIN t3 ON t3.g1 = p2.g1 AND t3.g2 = p2.g2),
pl AS (SELECT lang, sum(-n * ln(p)) / sum(n) AS loss, CAST(sum(n) AS BIGINT) AS n_tokens FROM p3 GROUP BY lang)""") + (
    "SELECT lang, round(loss, 9) AS loss, round(exp(loss), 5) AS perplexity, n_tokens FROM pl")
SQL["cross_entropy"] = w(*MODEL_BASE) + """, tagg AS (SELECT ctx, target, count(*) AS n FROM trp GROUP BY ctx, target),
tn AS (SELECT a.n, -ln(m.count / m.ctx_total) AS nll FROM tagg a JOIN model m ON m.ctx = a.ctx AND m.token = a.target),
tl AS (SELECT sum(n * nll) / sum(n) AS loss, CAST(sum(n) AS BIGINT) AS n_tokens FROM tn)
SELECT round(loss, 9) AS loss, round(CASE WHEN loss < 100 THEN exp(loss) ELSE 'inf'::DOUBLE END, 6) AS perplexity, n_tokens FROM tl"""
SQL["group_perplexity"] = w(*MODEL_BASE, *VAL_NLL) + (
    "SELECT lang, source, round(loss, 9) AS loss, "
    "round(CASE WHEN loss < 100 THEN exp(loss) ELSE 'inf'::DOUBLE END, 6) AS perplexity, n_tokens FROM ("
    "SELECT lang, source, sum(nll_sum) / sum(n_targets) AS loss, CAST(sum(n_targets) AS BIGINT) AS n_tokens "
    "FROM dsum JOIN documents USING (doc_id) GROUP BY lang, source)")
SQL["doc_perplexity"] = w(*MODEL_BASE, *VAL_NLL) + (
    "SELECT doc_id, round(nll_sum / n_targets, 9) AS loss, "
    "round(CASE WHEN nll_sum / n_targets < 100 THEN exp(nll_sum / n_targets) ELSE 'inf'::DOUBLE END, 6) AS perplexity, "
    "CAST(n_targets AS BIGINT) AS n_tokens FROM dsum")
SQL["benchmark_perplexity"] = w(*MODEL_BASE) + f""",
bt AS (SELECT item_id, regexp_extract_all(text, '{TP}') AS t FROM benchmark
       WHERE regexp_matches(text, '{NB}')),
bex AS (SELECT item_id, unnest(range(1, len(t) + 1)) AS pos, unnest(t) AS tok FROM bt),
bids AS (SELECT item_id AS doc_id, list(coalesce(v.id, 1) ORDER BY pos) AS ids
         FROM bex LEFT JOIN vocab v ON v.tok = bex.tok GROUP BY item_id),
{PAIRS("bids", "bp")},
bagg AS (SELECT doc_id, ctx, target, count(*) AS n FROM bp GROUP BY doc_id, ctx, target),
bctx AS (SELECT ctx, max(ctx_total) AS t FROM model GROUP BY ctx),
bprob AS (SELECT a.doc_id, a.n,
   (coalesce(m.count, 0) + {C.ALPHA}::DOUBLE) / (coalesce(c.t, 0) + {C.ALPHA}::DOUBLE * {V}) AS p
 FROM bagg a LEFT JOIN model m ON m.ctx = a.ctx AND m.token = a.target LEFT JOIN bctx c ON c.ctx = a.ctx),
bl2 AS (SELECT doc_id, sum(n * CASE WHEN p > 0 THEN -ln(p) ELSE 'inf'::DOUBLE END) / sum(n) AS loss,
        CAST(sum(n) AS BIGINT) AS n_tokens FROM bprob GROUP BY doc_id)
SELECT doc_id AS item_id, round(loss, 9) AS loss,
  round(CASE WHEN loss < 100 THEN exp(loss) ELSE 'inf'::DOUBLE END, 6) AS perplexity, n_tokens FROM bl2"""
SQL["eval_batch_mean"] = w(*MODEL_BASE, *VAL_NLL, *VAL_BATCH) + (
    "SELECT rank, batch_id, round(loss, 9) AS loss, n_targets FROM blo")
SQL["eval_rank_reduce"] = w(*MODEL_BASE, *VAL_NLL, *VAL_BATCH) + (
    "SELECT round(CASE WHEN count(*) > 0 THEN sum(loss) / count(*) ELSE 0.0 END, 9) AS loss, "
    "CAST(count(*) AS BIGINT) AS n_batches FROM blo")
EVAL_ROW = """, ev AS (
  SELECT CASE WHEN count(*) > 0 THEN sum(loss) / count(*) ELSE 0.0 END AS loss, CAST(count(*) AS BIGINT) AS n_batches
  FROM blo WHERE {only})
SELECT round(loss, 9) AS loss, round(CASE WHEN loss < 100 THEN exp(loss) ELSE 'inf'::DOUBLE END, 6) AS perplexity, n_batches FROM ev"""
SQL["evaluate_split"] = w(*MODEL_BASE, *VAL_NLL, *VAL_BATCH) + EVAL_ROW.format(only="true")
SQL["evaluate_capped"] = w(*MODEL_BASE, *VAL_NLL, *VAL_BATCH) + EVAL_ROW.format(only=f"batch_id < {C.EVAL_CAP}")
SQL["perplexity"] = """WITH p AS (SELECT event_id, CASE WHEN value < 100 THEN exp(value) ELSE 'inf'::DOUBLE END AS ppl
  FROM events)
SELECT event_id, NOT (ppl < 'inf'::DOUBLE) AS capped,
  CASE WHEN ppl < 'inf'::DOUBLE THEN CAST(floor(log10(ppl)) AS BIGINT) END AS ppl_exp10,
  CASE WHEN ppl < 'inf'::DOUBLE THEN round(ppl / pow(10.0, floor(log10(ppl))), 9) END AS ppl_mantissa FROM p"""

SQL["greedy_next"] = w(*MODEL_BASE) + (
    "SELECT ctx, token FROM model QUALIFY row_number() OVER (PARTITION BY ctx ORDER BY count DESC, token) = 1")
SQL["topk_next"] = w(*MODEL_BASE) + (
    f"SELECT ctx, token, count FROM model QUALIFY row_number() OVER (PARTITION BY ctx ORDER BY count DESC, token) <= {C.TOP_K}")
SQL["nucleus_next"] = w(*MODEL_BASE) + (
    "SELECT ctx, token FROM model QUALIFY coalesce(sum(count) OVER (PARTITION BY ctx ORDER BY count DESC, token "
    f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= {C.TOP_P}::DOUBLE * sum(count) OVER (PARTITION BY ctx)")
SQL["next_token_dist"] = (w(*MODEL_BASE) + ", " + DIST.replace("FROM gmodel", "FROM model") +
                          "\nSELECT ctx, token, round(prob, 9) AS prob, CAST(rank AS INTEGER) AS rank FROM dist")
SQL["sample_next"] = w(*GEN_MODEL, DIST) + f"""SELECT v.doc_id,
  coalesce(list_filter(c.cs, lambda x: x.cum > {_u('0', 'v.doc_id')})[1].token, c.cs[-1].token, 0) AS token
FROM enc v LEFT JOIN cands c ON c.ctx = v.ids[-1]"""

_GEN_HEAD = "WITH RECURSIVE " + ",\n".join(GEN_MODEL + (PROMPTS,))
SQL["generate_greedy"] = _GEN_HEAD + f""",
best AS (SELECT ctx, token FROM gmodel QUALIFY row_number() OVER (PARTITION BY ctx ORDER BY count DESC, token) = 1),
gen AS (SELECT conv_id, turn, ids, ids[-1] AS last, false AS done, 0 AS n_new FROM pids
  UNION ALL
  SELECT g.conv_id, g.turn, list_append(g.ids, coalesce(b.token, 0)), coalesce(b.token, 0), coalesce(b.token, 0) = 0,
         g.n_new + 1
  FROM gen g LEFT JOIN best b ON b.ctx = g.last WHERE NOT g.done AND g.n_new < {C.NEW_TOKENS})
SELECT conv_id, turn, CAST(n_new AS INTEGER) AS n_new, array_to_string(ids, ' ') AS ids FROM gen
QUALIFY n_new = max(n_new) OVER (PARTITION BY conv_id, turn)"""
_PICK = f"coalesce(list_filter(c.cs, lambda x: x.cum > {_u('g.n_new', 'g.conv_id', 'g.turn')})[1].token, c.cs[-1].token, 0)"
SQL["generate_sampled"] = _GEN_HEAD + ",\n" + DIST + f""",
gen AS (SELECT conv_id, turn, ids, ids[-1] AS last, false AS done, 0 AS n_new FROM pids
  UNION ALL
  SELECT g.conv_id, g.turn, list_append(g.ids, {_PICK}), {_PICK}, {_PICK} = 0, g.n_new + 1
  FROM gen g LEFT JOIN cands c ON c.ctx = g.last WHERE NOT g.done AND g.n_new < {C.NEW_TOKENS})
SELECT conv_id, turn, CAST(n_new AS INTEGER) AS n_new, array_to_string(ids, ' ') AS ids FROM gen
QUALIFY n_new = max(n_new) OVER (PARTITION BY conv_id, turn)"""

SQL["run_micro_batches"] = w(MICRO) + "SELECT run_id, CAST(n AS BIGINT) AS n, loss FROM micro"
SQL["log_window_loss"] = w(MICRO, WINDOWS(C.WINDOW_EVERY, C.WINDOW_ACCUM)) + (
    f"SELECT run_id, step, round(s / {C.WINDOW_EVERY * C.WINDOW_ACCUM}.0, 9) AS loss FROM win2")
_L, _SPAN = C.LOG_EVERY, C.LOG_EVERY * C.LOG_ACCUM
SQL["run_log"] = w(MICRO, WINDOWS(_L, C.LOG_ACCUM)) + f"""SELECT run_id, step, CAST((step - 1) // {C.EPOCH_STEPS} AS INTEGER) AS epoch, round(s / {_SPAN}.0, 9) AS loss,
  round(5e-4 * {LAMBDA('step', '100', '50000', 'cosine')}, 12) AS learning_rate,
  round({_rate(f'{_L}.0 / dt')}, 6) AS steps_per_sec,
  round({_rate(f'{float(_SPAN * C.LOG_BATCH)} / dt')}, 6) AS samples_per_sec,
  round({_rate(f'dt * 1000.0 / {_L}.0')}, 6) AS ms_per_step
FROM win2"""
_SCHED = ("tot AS (SELECT run_id, max(step) AS total FROM upd GROUP BY run_id)",)
SQL["scheduled_rate"] = w(*UPDATES, *_SCHED) + (
    f"SELECT u.run_id, u.step, round(5e-4 * {LAMBDA('u.step', '2', 't.total', 'cosine')}, 12) AS learning_rate "
    "FROM upd u JOIN tot t USING (run_id)")
SQL["scheduled_rate_linear"] = w(*UPDATES, *_SCHED) + (
    f"SELECT u.run_id, u.step, round(5e-4 * {LAMBDA('u.step', '2', 't.total', 'linear')}, 12) AS learning_rate "
    "FROM upd u JOIN tot t USING (run_id)")
SQL["cadence_steps"] = w(*UPDATES) + "SELECT run_id, step, round(loss_sum, 9) AS loss_sum FROM upd WHERE step % 2 = 0"
SQL["latest_step"] = w(*UPDATES) + "SELECT run_id, max(step) AS latest_step FROM upd GROUP BY run_id"

SQL["rms_normalize"] = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
r AS (SELECT vec_id, x, 1.0 / sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x) + 1e-6) AS inv FROM e),
ex AS (SELECT vec_id, inv, unnest(range(0, len(x))) AS dim, unnest(x) AS v FROM r)
SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(v * inv, 6) AS value FROM ex"""
SQL["gather_vectors"] = w(*BASE) + """, gex AS (SELECT doc_id, unnest(range(0, len(ids))) AS pos, unnest(ids) AS id FROM enc)
SELECT g.doc_id, CAST(g.pos AS INTEGER) AS pos, g.id AS vec_id, e.vec_id IS NOT NULL AS found, e.label,
  CAST(len(e.embedding) AS BIGINT) AS dims, CAST(e.embedding[1] AS DOUBLE) AS first,
  CAST(e.embedding[-1] AS DOUBLE) AS last, round(list_sum(CAST(e.embedding AS DOUBLE[])), 6) AS total
FROM gex g LEFT JOIN embeddings e ON e.vec_id = g.id"""
SQL["dot_scores_topk"] = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
s AS (SELECT a.vec_id AS query, b.vec_id AS token, list_dot_product(a.x, b.x) AS score FROM e a, e b),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, token) <= 5),
p AS (SELECT query, token, score, exp(score - max(score) OVER (PARTITION BY query)) AS ex FROM t)
SELECT query, token, round(score, 6) AS score, round(ex / sum(ex) OVER (PARTITION BY query), 6) AS prob FROM p"""
SQL["dot_next_dist"] = f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
s AS (SELECT a.vec_id AS ctx, b.vec_id AS token, list_dot_product(a.x, b.x) AS score FROM e a, e b),
k1 AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY ctx ORDER BY score DESC, token) <= {C.DOT_K}),
w1 AS (SELECT ctx, token, exp((score - max(score) OVER (PARTITION BY ctx)) / {C.TEMP}::DOUBLE) AS w FROM k1),
p1 AS (SELECT * FROM w1 QUALIFY coalesce(sum(w) OVER (PARTITION BY ctx ORDER BY w DESC, token
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= {C.TOP_P}::DOUBLE * sum(w) OVER (PARTITION BY ctx))
SELECT ctx, token, round(w / sum(w) OVER (PARTITION BY ctx), 6) AS prob,
  CAST(row_number() OVER (PARTITION BY ctx ORDER BY w DESC, token) AS INTEGER) AS rank FROM p1"""
SQL["map_batches"] = ("SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, "
                      "CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS n_lines FROM documents")
SQL["score_batches"] = w(*BASE) + f""", uni AS (SELECT id, -ln((count + 1.0::DOUBLE) / ((SELECT sum(count) FROM vocab) + {V})) AS nll FROM vocab),
tg AS (SELECT doc_id, unnest(ids[2:]) AS id FROM enc),
ts AS (SELECT doc_id, avg(nll) AS loss, CAST(count(*) AS BIGINT) AS n FROM tg JOIN uni USING (id) GROUP BY doc_id)
SELECT e.doc_id, round(ts.loss, 9) AS loss, coalesce(ts.n, 0) AS n_targets FROM enc e LEFT JOIN ts USING (doc_id)"""

SQL["read_jsonl"] = ("SELECT md5(text) AS text_md5, count(*) AS n_lines, count(*) AS n_ids FROM documents "
                     f"WHERE regexp_matches(text, '{NB}') GROUP BY md5(text)")
SQL["read_columnar"] = SQL["nonblank_documents"]
_STORED = "SELECT doc_id, array_to_string(input_ids, ' ') AS input_ids, array_to_string(labels, ' ') AS labels FROM seqs"
SQL["pretokenized_scan"] = w(*BASE, SEQS) + _STORED
SQL["prepared_manifest"] = w(DOCS) + (
    f"SELECT CAST(count(*) AS BIGINT) AS samples, CAST({N} AS INTEGER) AS max_length, 'tokenloom-regex' AS tokenizer FROM docs")
SQL["user_tokenizer"] = SQL["tokenize_documents"]
SQL["stream_ingest"] = "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents"
SQL["stream_tokenize"] = SQL["pretokenized_scan"]
SQL["eval_records"] = (
    f"SELECT CAST(0 AS INTEGER) AS run_id, (SELECT CAST(max(step) AS BIGINT) FROM ({SQL['update_groups']})) AS step, "
    f"loss AS eval_loss, perplexity AS eval_perplexity FROM ({SQL['evaluate_split']})")
SQL["stream_ingest_bounded"] = ("SELECT count(*) * 5 // 8 AS n_kept, count(*) * 5 // 8 AS n_ids, "
                                "count(*) * 5 // 8 AS n_own FROM documents")
SQL["stream_log_windows"] = w(MICRO, WINDOWS(1, 8)) + (
    f"SELECT run_id, step, round(s / 8.0, 9) AS loss, round({_rate('dt * 1000.0 / 1.0')}, 6) AS ms_per_step FROM win2")
SQL["stream_metrics"] = w(*UPDATES) + (
    "SELECT run_id, CAST(step AS BIGINT) AS step, round(loss_sum, 9) AS loss_sum FROM upd")
