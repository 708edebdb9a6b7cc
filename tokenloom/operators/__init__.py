from .decode import (generate, greedy_next, next_token_dist, sample_next, softmax, top_k, top_p,
                     uniform_draw)
from .evaluate import batch_losses, doc_loss_sums, evaluate, rank_reduce
from .ngram import context_totals, cross_entropy, fit_bigram, id_pairs, pair_nll, with_probability
from .rank import epoch_shuffle, global_rank, hash_key, md5_bucket
from .sequence import label_mask, resolve_pad, retruncate, shifted_pairs, to_sequences
from .split import batch, exact_split, shard, split_sizes, step_plan, update_groups
from .telemetry import (latest_step, log_windows, micro_batches, on_cadence, scheduled_rate,
                        update_log)
from .udf import map_batches, score_batches
from .vectors import dot_scores_topk, dot_softmax_topk, gather, rms_normalize
from .vocab import EOS_ID, UNK_ID, build_vocab, detokenize, encode, token_counts

__all__ = [n for n in dir() if not n.startswith("_")]
