"""Text fields, blank rows, tokens, JSONL reading."""

import json

import pytest
from pyspark.sql import functions as F

from tokenloom.functions.text import nonblank_col, tokens_col
from tokenloom.sources.corpus import read_corpus


def _write_jsonl(path, rows):
    with open(path, "w") as f:
        for r in rows:
            f.write(r if isinstance(r, str) else json.dumps(r))
            f.write("\n")


def test_text_fallback_and_blank_rows(spark, tmp_path):
    p = str(tmp_path / "c.jsonl")
    _write_jsonl(p, [{"doc_id": 1, "text": "a"}, {"doc_id": 2, "content": "b"},
                     {"doc_id": 3, "text": None, "content": "c"}, {"doc_id": 4, "x": 1},
                     {"doc_id": 5, "text": ""}, {"doc_id": 6, "text": "  "}, {"doc_id": 7, "text": "\t\n"},
                     {"doc_id": 8, "text": " "}, {"doc_id": 9, "text": " \u0085\x1c"},
                     {"doc_id": 10, "text": " keep me "}])
    kept = {r.doc_id: r.text for r in read_corpus(spark, p).collect()}
    assert kept == {1: "a", 2: "b", 3: "c", 10: " keep me "}  # text is not stripped
    everything = read_corpus(spark, p, drop_blank=False).collect()
    assert len(everything) == 10
    assert {r.doc_id: r.text for r in everything}[4] == ""


def test_malformed_line_fails(spark, tmp_path):
    p = str(tmp_path / "bad.jsonl")
    _write_jsonl(p, [{"doc_id": 1, "text": "ok"}, "{bad"])
    with pytest.raises(Exception):
        read_corpus(spark, p).collect()


@pytest.mark.parametrize("s,expected", [
    ("", False), (" ", False), (" 　", False), ("\x1f", False), ("a", True), (" .", True),
    ("​", True),  # zero-width space is not white space for Python
])
def test_nonblank_matches_python_strip(spark, s, expected):
    assert bool(s.strip()) == expected
    got = spark.createDataFrame([(s,)], "t string").select(nonblank_col("t").alias("k")).first().k
    assert got == expected


def test_tokens_letters_digits_and_punctuation(spark):
    df = spark.createDataFrame([("Héllo, wörld 42x!\x0bnext",)], "t string")
    toks = df.select(tokens_col("t").alias("k")).first().k
    assert toks == ["Héllo", ",", "wörld", "42x", "!", "next"]


def test_null_text_is_not_blank_error(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.where(nonblank_col("t")).count() == 0
    assert df.select(F.size(tokens_col("t"))).first()[0] in (None, -1)


def test_nonblank_agrees_with_python_on_every_bmp_character(spark):
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(i, f" {ch} ") for i, ch in enumerate(chars)], "i int, t string")
    got = {r.i for r in df.where(nonblank_col("t")).select("i").collect()}
    want = {i for i, ch in enumerate(chars) if f" {ch} ".strip()}
    assert got == want
