"""Operator 11 against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tokenloom.llm import bpe, wordblocks
from tokenloom.llm.storage import Scratch

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(str(PATH))


def texts():
    rng = random.Random(11)
    bits = ["'", "''", "'s", "'re", "'ll", "'l", "'VE", "ve", "t", "a", "Zß", "é", "é", "7", "½", "٣", " ", "  ", "\n", "\r\n", "\t",
            "\x00", "\x1c", "\x85", "\xa0", " ", "　", "​", "!", "?!", "…", "日本", "\U0001f600", "\U0001d7ce", SPECIAL, "<|", "|>",
            "�", "͸", "\U000323b0"]
    out = [None, "", " ", "\n", "  a", "a  ", "a  b", "a \n b", "it's", " 's", "'s't", "x''s", "we'lll", "don't'", SPECIAL, SPECIAL * 3,
           f" {SPECIAL} a  {SPECIAL}  b", "<|endoftext|", "a" * 3000, " " * 500 + "x", "'" * 9 + "s"]
    out += ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(600)]
    return out


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_encode_and_decode_equal_the_library(spark, library):
    rows = [(i if i % 9 else None, t, "clash", i) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, block string, row int").repartition(4)
    got = bpe.decode(bpe.encode(docs, keep=("doc_id", "block", "row")), bpe.piece_table(spark))
    found = {r["row"]["row"]: (r["row"]["doc_id"], list(r["ids"]), r["decoded"]) for r in got.collect()}
    assert len(found) == len(rows)
    for key, text, _, i in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert found[i] == (key, ids, library.decode(ids, skip_special_tokens=False)), repr(text)


def test_long_texts_repeated_rows_and_empty_tables(spark, library):
    words = "alpha beta's  gamma\n\n delta 12 ".split(" ")
    long = " ".join(words[i % 7] + str(i % 97) for i in range(250_000)) + SPECIAL + "x" * 1_200_000 + " end"
    docs = spark.createDataFrame([(1, long), (1, long), (2, "same"), (2, "same")], "doc_id bigint, text string")
    got = bpe.encode(docs).collect()
    want = library.encode(long, add_special_tokens=False).ids
    assert sorted(len(r["ids"]) for r in got) == sorted(2 * [len(want)] + 2 * [1])
    assert all(list(r["ids"]) == want for r in got if r["row"]["doc_id"] == 1)
    both = bpe.encode(docs, pieces=bpe.piece_table(spark))
    assert sorted(r["decoded"] for r in both.collect()) == sorted(r.text for r in docs.collect())
    none = bpe.decode(bpe.encode(docs.limit(0)), bpe.piece_table(spark))
    assert none.collect() == [] and none.columns == ["row", "ids", "decoded"]


def test_blocks_close_at_their_bounds(spark, library, monkeypatch):
    """The same ids when a block holds a few words only."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(2)
    want = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in docs.collect()}
    monkeypatch.setattr(wordblocks, "BLOCK_WORDS", 500)  # task code takes the driver's values along
    monkeypatch.setattr(wordblocks, "GROUP_BYTES", 1000)
    sequences, words, _ = wordblocks.store_blocks(docs, ("doc_id",), "text", F.lit(""), bpe._lazy_splitter(
        spark.sparkContext.broadcast(bpe.Vocabulary.load(str(PATH)).text), [SPECIAL]), Scratch(spark, "test"))
    assert sequences.select("block").distinct().count() > 10
    assert {r["row"]["doc_id"]: list(r["ids"]) for r in bpe.encode(docs).collect()} == want


def test_decode_of_any_ids(spark, library):
    rows = [(1, [220, 50256, 11]), (2, []), (3, None), (4, [187]), (5, [49152, 300])]
    ids = spark.createDataFrame(rows, "doc_id int, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(ids, bpe.piece_table(spark)).collect()}
    assert got == {i: library.decode(x or [], skip_special_tokens=False) for i, x in rows}
    unknown = spark.createDataFrame([(1, [50257, -1, 11])], "doc_id int, ids array<int>")
    assert bpe.decode(unknown, bpe.piece_table(spark)).first().decoded == library.decode([11])


def test_a_word_is_encoded_once(spark, monkeypatch):
    docs = spark.range(40).selectExpr("id AS doc_id", "'one two one two three' AS text").repartition(8)
    seen, load = spark.sparkContext.accumulator(0), bpe._tokenizer

    class Counting:
        def __init__(self, text):
            self.inner = load(text)

        def encode_batch_fast(self, words, **more):
            seen.add(len(words))
            return self.inner.encode_batch_fast(words, **more)

    monkeypatch.setattr(bpe, "_tokenizer", Counting)
    assert sum(len(r["ids"]) for r in bpe.encode(docs).collect()) == 200
    assert seen.value == 4  # "one", " two", " one", " three", each in 40 documents of 8 tasks


def test_query_digests(spark, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op11_bpe(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id] == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary.load(str(public_tokenizers.path("word_bpe_49k.json")))
