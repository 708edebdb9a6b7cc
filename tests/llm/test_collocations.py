"""Operator 13 against direct counting and DuckDB."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tokenloom.llm import collocations, oracle, wordblocks

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, grp string, n int, word string"


def brute(rows, least, top):
    counts, sizes = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            for k in (1, 2, 3):
                counts.setdefault(lang, Counter()).update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        held = Counter()
        for p, a in f.items():
            if len(p) == 3 and a >= least:
                for q in (p[:2], p[1:]):
                    held[q] = max(held[q], a)
        found = []
        for p, a in f.items():
            if len(p) > 1 and a >= least and not (p in held and 100 * held[p] >= 50 * a):
                score, _, left, right = min((10 ** 6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]])
                                            for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    vocab = ["the", "The", "of", "new", "york", "city", "Él", "é", "a-b", "x", "\x00", " "] + [f"w{i}" for i in range(60)]
    out = [(None, "en"), ("", None), ("  \n.,", "en"), ("one", None), ("same text same text", "de"), ("same text same text", "de")]
    for _ in range(300):
        words = [vocab[min(int(rng.expovariate(0.15)), len(vocab) - 1)] for _ in range(rng.randrange(1, 80))]
        text = "".join(w + rng.choice([" "] * 12 + ["  ", "\t", ". ", ",", "\n", " ;", "! ?"]) for w in words)
        out.append((rng.choice(["", "."]) + text, rng.choice(["en"] * 5 + ["de", None, "und"])))
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, lang, "clash", 3, "clash") for i, (t, lang) in enumerate(rows)], DOCS).repartition(parts)


def result(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("least, top", [(10, 2000), (2, 30)])
def test_equals_direct_counting(spark, rows, least, top):
    want = brute(rows, least, top)
    assert len(want) > 40
    assert result(collocations.collocations(frame(spark, rows), least=least, top=top)) == want


def test_many_tiles_blocks_and_rounds(spark, rows, monkeypatch):
    """The same phrases when blocks are many, tiles are split and lists are added up in rounds."""
    monkeypatch.setattr(collocations, "FAN", 3)
    monkeypatch.setattr(collocations, "SPLIT_BLOCKS", 4)
    monkeypatch.setattr(wordblocks, "BLOCK_WORDS", 60)
    assert result(collocations.collocations(frame(spark, rows, 12), least=3)) == brute(rows, 3, 2000)


def test_tiles_cover_all_pairs():
    rng = np.random.default_rng(1)
    a, b = (np.minimum(rng.exponential(30_000, 200_000).astype(np.int64) * 3, (1 << 24) - 1) for _ in range(2))
    seen = Counter()
    for splits in (1, 7):
        total = {}
        for tile, cells, n in collocations.tile_lists(a, b, splits):
            assert (np.diff(cells) > 0).all()
            cells, n = collocations.add_lists(tile, splits, [cells, cells], [n, n])
            row, column, width = collocations._corner(tile, splits)
            for c, k in zip(cells, n):
                total[(row + c // width, column + c % width)] = int(k) // 2
        seen = Counter(zip(a.tolist(), b.tolist()))
        assert {(int(x), int(y)): k for (x, y), k in total.items()} == dict(seen)


def test_score_is_exact_beyond_64_bits(spark):
    a, left, right = 10 ** 12 + 7, 10 ** 12 + 9, 3 * 10 ** 12 + 1
    got = spark.createDataFrame([(a, left, right)], "a bigint, l bigint, r bigint").select(collocations._score("a", "l", "r")).first()
    assert got[0] == 10 ** 6 * a * a // (left * right)


def test_long_text_and_empty_table(spark):
    rows = [("alpha Beta gamma, delta " * 80_000 + "end", "en"), ("beta gamma", "en")]
    assert result(collocations.collocations(frame(spark, rows))) == brute(rows, 10, 2000)
    assert result(collocations.collocations(frame(spark, rows).limit(0))) == []


def test_split_of_long_words_and_breaks():
    text = " .a.b c" + "x" * 2_000_000 + " D\n\n;e"
    offsets, words = wordblocks.separator_split([text, "", "f g"], b" \t", b".\n;")
    found = [[w[:2] for w in words.to_pylist()[a:e]] for a, e in zip(offsets[:-1], offsets[1:])]
    # a break may also stand before the first word of a text
    assert [f[1:] if f[:1] == [""] else f for f in found] == [["a", "", "b", "cx", "d", "", "e"], [], ["f", "g"]]
    assert isinstance(words, pa.Array)


def test_query_equals_duckdb(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got, want = collocations.op13_collocations(spark, SF), con.sql(oracle.OP13)
    assert got.columns == want.columns
    assert result(got) == sorted(want.fetchall())
