"""Operator 12 against a direct build of the trees and against DuckDB."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import merkle, oracle

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, n int, tree string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(nodes):
    """(root, siblings of each node level by level) of one tree."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 8 * 8:i // 8 * 8 + 8]
            proofs[k].append((run[:i % 8], run[i % 8 + 1:]))
        nodes, at = [h(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)], [i // 8 for i in at]
    return nodes[0], proofs


def brute(rows):
    """Sorted result rows of op12 for (doc_id, text, lang, source, n_chars)."""
    langs = {}
    for doc_id, text, lang, source, n_chars in rows:
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        low = text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        own = leaf(doc_id, source, lang, n_chars, text)
        changed = leaf(doc_id, source, lang, n_chars, low) if tampered else own
        langs.setdefault(lang, []).append((doc_id is not None, doc_id or 0, own, doc_id, changed))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        langs[lang].sort(key=lambda r: r[:3])
        trees[lang] = climb([r[2] for r in langs[lang]])
    root, upper = climb([trees[lang][0] for lang in order])
    out = []
    for lang, above in zip(order, upper):
        for (_, _, own, doc_id, folded), below in zip(langs[lang], trees[lang][1]):
            proof = below + above
            for left, right in proof:
                folded = h(*left, folded, *right)
            out.append((doc_id, own, trees[lang][0], root, h(*["".join(a + b) for a, b in proof]), folded, folded == root))
    return sorted(out, key=str)


def result(docs):
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0,
                  F.translate("text", upper, upper.lower())).otherwise(F.col("text"))
    proved = merkle.prove(merkle.build_manifest(docs, keep=("doc_id", "tree"), claimed={"text": text}))
    rows = proved.select("row.doc_id", "leaf", "subroot", "root", F.sha2("proof", 256), "folded_root", "verified").collect()
    return sorted((tuple(r) for r in rows), key=str)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "clash", 7, "clash") for r in rows], DOCS).repartition(parts)


def random_rows(n, langs, seed=5):
    rng = random.Random(seed)
    return [(rng.choice([None, rng.randrange(n)]) if i % 11 == 0 else rng.randrange(2 * n),
             rng.choice([None, "", "Mixed Case", "lower", "É and A", f"Text {i}"]), rng.choice(langs),
             rng.choice([None, "s", ""]), rng.choice([None, 0, -3, i])) for i in range(n)]


@pytest.mark.parametrize("rows", [
    random_rows(700, ["en"] * 9 + ["de", None, "", "é"]),
    random_rows(90, [f"l{i:03}" for i in range(80)] + [None]),  # more groups than a run holds; groups of one
    random_rows(64, ["en"]), random_rows(65, ["en"]), [(3, "A", "en", "s", 1)], [(3, "A", "en", "s", 1)] * 20,
], ids=["skewed", "groups", "full", "over", "one", "repeated"])
def test_proofs_equal_direct_build(spark, rows):
    assert result(frame(spark, rows)) == brute(rows)


def test_copies_of_runs_do_not_change_the_result(spark, monkeypatch):
    rows = random_rows(300, ["en", "de"])
    monkeypatch.setattr(merkle, "SALT_LEAVES", 3)
    manifest = merkle.build_manifest(frame(spark, rows))
    assert manifest.runs.groupBy("tree", "level", "run").count().agg(F.max("count")).first()[0] == 100
    assert result(frame(spark, rows, 5)) == brute(rows)


def test_one_changed_letter_fails_its_leaf_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    victim = docs.agg(F.min("doc_id")).first()[0] + 7
    claimed = F.when(F.col("doc_id") == victim, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    proved = merkle.prove(merkle.build_manifest(docs, claimed={"text": claimed}))
    assert [r.row.doc_id for r in proved.where("NOT verified").collect()] == [victim]


def test_long_text_and_empty_table(spark):
    rows = [(1, "Long " * 400_000, "en", None, None), (2, "x", "en", None, None)]
    assert result(frame(spark, rows)) == brute(rows)
    empty = frame(spark, rows).limit(0)
    assert merkle.build_manifest(empty).root is None
    assert result(empty) == []


def test_query_equals_duckdb(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got = merkle.op12_merkle(spark, SF)
    want = con.sql(oracle.OP12)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
