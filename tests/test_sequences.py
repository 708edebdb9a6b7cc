"""Encode, pad, mask, labels, re-cut, pairs, decode."""

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tokenloom.operators.sequence import label_mask, retruncate, shifted_pairs, to_sequences
from tokenloom.operators.vocab import build_vocab, detokenize, encode
from tokenloom.plans.prepare import tokenized


def _ids(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, ids array<int>")


def test_pad_mask_labels_edge_lengths(spark):
    n = 4
    rows = [(0, []), (1, [7]), (2, [7, 8, 9]), (3, [7, 8, 9, 10]), (4, [7, 8, 9, 10, 11])]
    got = {r.doc_id: r for r in label_mask(to_sequences(_ids(spark, rows), n)).collect()}
    assert got[0].input_ids == [0, 0, 0, 0] and got[0].attention_mask == [0, 0, 0, 0]
    assert got[0].labels == [-100] * 4
    assert got[1].input_ids == [7, 0, 0, 0] and got[1].attention_mask == [1, 0, 0, 0]
    assert got[2].labels == [7, 8, 9, -100]
    assert got[3].attention_mask == [1, 1, 1, 1]
    assert got[4].input_ids == [7, 8, 9, 10]  # truncated, no EOS appended


def test_real_token_equal_to_pad_keeps_mask(spark):
    s = label_mask(to_sequences(_ids(spark, [(0, [5, 0, 6])]), 5)).first()
    assert s.attention_mask == [1, 1, 1, 0, 0]
    assert s.labels == [5, 0, 6, -100, -100]


def test_explicit_pad_id(spark):
    s = to_sequences(_ids(spark, [(0, [5])]), 3, pad_id=9).first()
    assert s.input_ids == [5, 9, 9]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50), max_size=12), min_size=1, max_size=6), st.integers(1, 10))
def test_sequence_properties(spark, seqs, n):
    rows = [(i, s) for i, s in enumerate(seqs)]
    out = label_mask(to_sequences(_ids(spark, rows), n)).collect()
    for r in out:
        k = min(len(seqs[r.doc_id]), n)
        assert len(r.input_ids) == n and len(r.attention_mask) == n
        assert sum(r.attention_mask) == k
        assert all((lab == -100) == (m == 0) for lab, m in zip(r.labels, r.attention_mask))


def test_retruncate_cuts_all_arrays(spark):
    s = retruncate(label_mask(to_sequences(_ids(spark, [(0, [1, 2, 3])]), 6)), 2).first()
    assert s.input_ids == [1, 2] and s.attention_mask == [1, 1] and s.labels == [1, 2]


def test_shifted_pairs_skip_ignored_targets(spark):
    s = label_mask(to_sequences(_ids(spark, [(0, [3, 4, 5]), (1, [8])]), 5))
    pairs = sorted((r.doc_id, r.pos, r.ctx, r.target) for r in shifted_pairs(s).collect())
    assert pairs == [(0, 0, 3, 4), (0, 1, 4, 5)]
    off = shifted_pairs(s, past_len=10).collect()
    assert sorted(r.pos for r in off) == [10, 11]


def test_vocab_encode_decode_roundtrip(spark):
    toks = spark.createDataFrame([(0, ["b", "a", "b", "c"]), (1, ["a", "b", "zz"])], "doc_id long, tokens array<string>")
    vocab = build_vocab(toks, 4)  # <eos>, <unk>, b, a
    v = {r.tok: r.id for r in vocab.collect()}
    assert v == {"<eos>": 0, "<unk>": 1, "b": 2, "a": 3}
    ids = {r.doc_id: r.ids for r in encode(toks, vocab).collect()}
    assert ids == {0: [2, 3, 2, 1], 1: [3, 2, 1]}
    ids3 = {r.doc_id: r.ids for r in encode(toks, vocab, max_length=2).collect()}
    assert ids3 == {0: [2, 3], 1: [3, 2]}
    text = {r.doc_id: r.text for r in detokenize(encode(toks, vocab), vocab).collect()}
    assert text == {0: "b a b <unk>", 1: "a b <unk>"}


def test_encode_null_arrays_null_tokens_and_empty_input(spark):
    toks = spark.createDataFrame([(0, ["x", None, "y"]), (1, None), (2, []), (3, ["new"])],
                                 "doc_id long, tokens array<string>")
    vocab = build_vocab(toks.where("doc_id < 3"), 5)
    ids = {r.doc_id: r.ids for r in encode(toks, vocab).collect()}
    assert ids == {0: [2, 1, 3], 1: [], 2: [], 3: [1]}
    back = {r.doc_id: r.text for r in detokenize(encode(toks, vocab), vocab).collect()}
    assert back == {0: "x <unk> y", 1: "", 2: "", 3: "<unk>"}
    assert encode(toks.limit(0), vocab).count() == 0


def test_encode_does_not_shuffle(spark):
    toks = spark.createDataFrame([(0, ["x", "y"])], "doc_id long, tokens array<string>")
    plan = encode(toks, build_vocab(toks, 5))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_vocab_equals_a_full_sort_at_every_size(spark):
    rows = [(i, [f"t{(i * j) % 23}" for j in range(1, 30)] + [f"é{i % 7}", f"once{i}"]) for i in range(60)]
    toks = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    counts = {}
    for _, words in rows:
        for t in words:
            counts[t] = counts.get(t, 0) + 1
    order = sorted(counts, key=lambda t: (-counts[t], t.encode()))
    for size in (2, 3, 12, 26, 40, 1000):
        got = {r.tok: r.id for r in build_vocab(toks, size).collect() if r.id > 1}
        assert got == {t: i + 2 for i, t in enumerate(order[:size - 2])}


def test_batches_of_long_texts_are_cut_by_bytes(spark):
    """A Python worker holds one Arrow batch: its size has a bound in bytes, whatever the texts' length."""
    docs = spark.range(600).coalesce(1).selectExpr("id AS doc_id", "split(repeat('some words ', 4000), ' ') AS tokens")
    vocab = spark.createDataFrame([("some", 5), ("words", 7)], "tok string, id int")
    sizes = F.arrow_udf(lambda ids: pa.array([ids.nbytes] * len(ids), pa.int64()), "bigint")
    row = (encode(docs, vocab).select("ids", sizes("ids").alias("n"))
           .agg(F.max("n").alias("most"), F.sum(F.size("ids")).alias("ids"), F.max(F.size("ids")).alias("each")).first())
    assert (row.ids, row.each) == (600 * 8001, 8001)
    assert row.most < 6 << 20  # 600 rows at once: 19 MB


def test_user_tokenizer_gets_a_bounded_part_of_a_batch(spark):
    def chars(texts):
        return texts.map(lambda t: [str(int(texts.str.len().sum()))] * (len(t) % 3))

    docs = spark.range(3000).coalesce(1).selectExpr("id AS doc_id", "repeat('x', int(1000 + id % 7)) AS text")
    got = {r.doc_id: r.tokens for r in tokenized(docs, tokenizer=chars).collect()}
    assert {i: len(t) for i, t in got.items()} == {i: (1000 + i % 7) % 3 for i in range(3000)}
    assert max(int(t[0]) for t in got.values() if t) <= (1 << 20) + 1006


def test_user_tokenizer_must_return_a_row_a_text(spark):
    docs = spark.createDataFrame([(0, "a b"), (1, "c")], "doc_id long, text string").coalesce(1)
    with pytest.raises(Exception, match="returned 1 rows for 2"):
        tokenized(docs, tokenizer=lambda t: t.str.split(" ")[:1]).collect()
