"""Subword vocabularies against the tokenizers library; higher-order tables against a direct model."""

import math
import random
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

from conftest import SF001
from tokenloom.operators import ngram, subword
from tokenloom.plans import catalog


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(subword.default_vocabulary())


TEXTS = [None, "", " ", "It's  a test", "naïve é 日本 \U0001f600", "\x00\x1c\r\n\t", "a<|endoftext|>b", "x" * 5000]


def test_ids_and_texts_equal_the_library(spark, library):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    ids = subword.encode_subwords(docs)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.ids for r in ids.collect()} == want
    vocab = subword.vocabulary(spark)
    assert {r.doc_id: r.text for r in subword.decode_subwords(ids, vocab, skip_special=False).collect()} == \
        {i: t or "" for i, t in enumerate(TEXTS)}
    plain = {r.doc_id: r.text for r in subword.decode_subwords(ids, vocab).collect()}
    assert plain == {i: library.decode(x, skip_special_tokens=True) for i, x in want.items()}


def test_cut_counts_and_sequences(spark, library):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    cut = {r.doc_id: r.ids for r in subword.encode_subwords(docs, max_length=3).collect()}
    assert cut == {i: library.encode(t or "", add_special_tokens=False).ids[:3] for i, t in enumerate(TEXTS)}
    counts = subword.subword_counts(subword.encode_subwords(docs), subword.vocabulary(spark))
    want = Counter(x for t in TEXTS for x in library.encode(t or "", add_special_tokens=False).ids)
    rows = counts.collect()
    assert len(rows) == library.get_vocab_size() and {r.id: r["count"] for r in rows if r["count"]} == want


def test_subword_queries(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    for r in catalog.q_subword_sequences(spark, SF001).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids[:catalog.N]
        assert r.n_real == len(ids)
        assert r.input_ids == " ".join(map(str, ids + [50256] * (catalog.N - len(ids))))
    total = sum(len(library.encode(t, add_special_tokens=False).ids) for t in texts.values())
    assert catalog.q_subword_counts(spark, SF001).agg({"count": "sum"}).first()[0] == total


def kneser_ney(texts, order, size, d):
    """P(token | context) by direct counting."""
    counts = [None] * (order + 1)
    counts[order] = Counter(tuple(([size] * (order - 1) + t)[i:i + order]) for t in texts for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    total, types = defaultdict(int), defaultdict(int)
    for k in range(1, order + 1):
        for g, c in counts[k].items():
            total[(k, g[:-1])] += c
            types[(k, g[:-1])] += 1

    def p(ctx, token, k):
        if k == 0:
            return 1 / size
        c = ctx[len(ctx) - k + 1:]
        low = p(ctx, token, k - 1)
        t = total.get((k, c))
        return low if not t else max(counts[k][(*c, token)] - d, 0) / t + d * types[(k, c)] / t * low

    return lambda ctx, token: p(ctx, token, order)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_backoff_equals_direct_model(spark, order):
    rng, size = random.Random(order), 30
    texts = [[int(min(rng.expovariate(0.2), size - 1)) for _ in range(rng.randrange(0, 30))] for _ in range(40)]
    train, held = texts[:30], texts[30:]
    frame = lambda rows: spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id int, ids array<int>")
    levels = ngram.fit_ngram(ngram.ngram_rows(frame(train), order, size), order, size)
    got = ngram.backoff_nll(ngram.ngram_rows(frame(held), order, size, keep=("doc_id",)), levels, size, by=("doc_id",))
    sums = {r.doc_id: r.s for r in got.selectExpr("doc_id", "n * nll AS s").groupBy("doc_id").sum("s")
            .withColumnRenamed("sum(s)", "s").collect()}
    p = kneser_ney(train, order, size, 0.75)
    for i, t in enumerate(held):
        padded = [size] * (order - 1) + t
        want = sum(-math.log(p(tuple(padded[j:j + order - 1]), x)) for j, x in enumerate(t))
        assert sums.get(i, 0.0) == pytest.approx(want, rel=1e-9)
    everything = sum(p((2,) * (order - 1), x) for x in range(size))
    assert everything == pytest.approx(1.0)


def test_longer_contexts_lower_the_held_out_loss(spark):
    """On texts whose third word follows from the two before it."""
    rng, size = random.Random(7), 40
    texts = []
    for _ in range(120):
        t = [rng.randrange(20), rng.randrange(20)]
        while len(t) < 40:
            t.append((t[-1] + t[-2]) % 20 if rng.random() < 0.9 else rng.randrange(20))
        texts.append(t)
    frame = lambda rows: spark.createDataFrame([(t,) for t in rows], "ids array<int>")
    loss = {}
    for order in (2, 3):
        levels = ngram.fit_ngram(ngram.ngram_rows(frame(texts[:100]), order, size), order, size)
        nll = ngram.backoff_nll(ngram.ngram_rows(frame(texts[100:]), order, size), levels, size)
        loss[order] = nll.selectExpr("sum(n * nll) / sum(n)").first()[0]
    assert loss[3] < loss[2] - 0.5


def test_contexts_too_long_for_a_number(spark):
    with pytest.raises(ValueError):
        ngram.ngram_rows(spark.createDataFrame([([1],)], "ids array<int>"), 5, 151_936)
