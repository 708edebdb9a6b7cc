"""Round trips, source kind, bounded ingest, manifest, metrics sink."""

import gzip
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from tokenloom.operators.sequence import label_mask, to_sequences
from tokenloom.plans.prepare import PrepConfig, documents, prepare
from tokenloom.plans.jobs import preparation_job, regex_tokenizer, training_sequences
from tokenloom.sources.corpus import ingest_bounded, nth_key, nth_smallest, read_corpus, read_tokenized, source_kind
from tokenloom.sources.lines import FIRST_NUMBER, lines_from, read_lines
from tokenloom.sources.sinks import append_metrics, read_metrics, write_manifest, write_tokenized

from conftest import SF001


def test_tokenized_round_trip_and_manifest(spark, tmp_path):
    _, _, seqs = prepare(documents(spark, SF001, ("doc_id", "text")), PrepConfig(vocab_size=300, max_length=16))
    out = str(tmp_path / "tok")
    write_tokenized(seqs.drop("labels"), out)
    assert source_kind(spark, out) == "pretokenized"
    back = read_tokenized(spark, out)
    assert back.columns == ["doc_id", "input_ids", "attention_mask"]
    plan = back.select("input_ids")._jdf.queryExecution().executedPlan().toString()
    assert "attention_mask" not in plan.split("ReadSchema")[-1].split("\n")[0]  # pruned at the scan
    relabeled = label_mask(back)
    assert relabeled.where(F.size("labels") != 16).count() == 0
    m = write_manifest(spark, out, 16, "regex", str(tmp_path / "manifest")).first()
    assert m.samples == seqs.count() and m.max_length == 16
    js = [json.loads(line) for f in os.listdir(tmp_path / "manifest") if f.endswith(".json")
          for line in open(tmp_path / "manifest" / f)]
    assert js[0]["samples"] == m.samples


def test_source_kind_text(spark, tmp_path):
    p = str(tmp_path / "a.jsonl")
    with open(p, "w") as f:
        f.write('{"text": "x"}\n')
    assert source_kind(spark, p) == "text"
    assert source_kind(spark, SF001 + "/documents.parquet") == "text"
    assert read_corpus(spark, p).count() == 1


def test_ingest_bounded_exact_first_rows(spark):
    d = spark.read.parquet(SF001 + "/documents.parquet").select("doc_id", "n_chars")
    got = sorted(r.doc_id for r in ingest_bounded(d, 1, rows_per_shard=37).collect())
    assert got == list(range(37))
    assert ingest_bounded(d, 5).count() == d.count()  # shorter source: everything
    big = spark.range(0, 200000, 3).withColumnRenamed("id", "k")
    assert nth_smallest(big, "k", 12345) == 3 * 12344
    odd = spark.range(3000).select((F.col("id") % 3).alias("k"))
    for n in (1, 1000, 1001, 2000, 2001, 3000, 9999):
        assert nth_smallest(odd, "k", n, sort_rows=10) == min((n - 1) // 1000, 2)
    uneven = spark.range(500).select((F.col("id") * F.col("id")).alias("k"))
    assert [nth_smallest(uneven, "k", n, rel_err=0.05, sort_rows=3) for n in (1, 250, 500)] == [0, 249 ** 2, 499 ** 2]


def test_ingest_bounded_with_repeated_keys_keeps_exactly_the_bound(spark):
    rows = [(1, "a"), (2, "b"), (2, "c"), (2, "c"), (2, "d"), (3, "e")]
    d = spark.createDataFrame(rows, "k long, v string")
    for n in range(1, 7):
        got = [tuple(r) for r in ingest_bounded(d, 1, rows_per_shard=n, order_by="k").collect()]
        assert len(got) == n and sorted(k for k, _ in got) == sorted(k for k, _ in rows)[:n]


def test_ingest_bounded_counts_null_keys(spark):
    rows = [(None if i % 3 == 0 else i, f"v{i}") for i in range(30)]
    d = spark.createDataFrame(rows, "k long, v string")
    for n in (0, 5, 20, 21, 29, 30, 100):
        got = [r.k for r in ingest_bounded(d, 1, rows_per_shard=n, order_by="k").collect()]
        want = sorted((k for k, _ in rows), key=lambda k: (k is None, k or 0))[:n]
        assert sorted(got, key=lambda k: (k is None, k or 0)) == want
    nothing = spark.createDataFrame([(None, "a"), (None, "b")], "k long, v string")
    assert [ingest_bounded(nothing, 1, n, "k").count() for n in (1, 2, 3)] == [1, 2, 2]


@pytest.mark.parametrize("kind", ["string", "binary", "int", "bigint", "double", "date", "timestamp_ntz"])
def test_nth_key_of_any_type(spark, kind):
    number = F.col("id") * 7919 % 1000 - 500
    column = {"string": F.concat(F.lit("é" * 3), F.repeat(F.lit("a"), (F.col("id") % 4).cast("int")), number.cast("string")),
              "binary": F.encode(number.cast("string"), "utf-8"), "date": F.date_add(F.lit("2020-01-01").cast("date"), number.cast("int")),
              "timestamp_ntz": F.timestamp_seconds(number * 1000).cast("timestamp_ntz")}.get(kind, number.cast(kind))
    d = spark.range(3000).select(column.alias("k"), "id")
    want = sorted(r.k if kind != "string" else r.k.encode() for r in d.collect())
    for n in (1, 2, 999, 1500, 3000):
        got = nth_key(d, "k", n, sort_rows=5)
        assert (got if kind != "string" else got.encode()) == want[n - 1]
    kept = ingest_bounded(d, 1, 1234, "k")
    assert sorted(r.k if kind != "string" else r.k.encode() for r in kept.collect()) == want[:1234]


def test_append_metrics(spark, tmp_path):
    p = str(tmp_path / "metrics")
    rows = spark.createDataFrame([(1, 10, 2.5), (2, 10, 3.0)], "run_id long, step long, loss double")
    append_metrics(rows, p)
    append_metrics(rows.withColumn("step", F.lit(20).cast("long")), p)
    back = spark.read.parquet(p)
    assert back.count() == 4 and set(r.run_id for r in back.collect()) == {1, 2}


def test_jsonl_without_ids_keeps_one_row_per_line_and_stable_ids(spark, tmp_path):
    lines = ['{"text": "a b"}', '{"text": "a b"}', '{"content": "c d"}', '{"text": "e"}'] + \
        ['{"text": "row %d"}' % i for i in range(500)]
    for name, parts in (("one", 1), ("many", 7)):
        for k in range(parts):
            (tmp_path / name).mkdir(exist_ok=True)
            (tmp_path / name / f"p{k}.jsonl").write_text("\n".join(lines[k::parts]))
    ids = [sorted(r["doc_id"] for r in read_corpus(spark, str(tmp_path / n), fmt="json").collect()) for n in ("one", "many")]
    assert ids[0] == ids[1] and len(set(ids[0])) == len(lines)


def test_preparation_job_routes_and_counts(spark, tmp_path):
    src, dst = str(tmp_path / "in.jsonl"), str(tmp_path / "job")
    lines = spark.createDataFrame([("a b",), ("c a a",), (" ",), (None,)], "text string")
    lines.write.json(src)
    cfg = PrepConfig(vocab_size=10, max_length=4)
    assert preparation_job(spark, src, dst, cfg).first().samples == 2
    stored = sorted((r.input_ids, r.labels) for r in training_sequences(spark, dst + "/data", cfg).collect())
    direct = sorted((r.input_ids, r.labels) for r in training_sequences(spark, src, cfg).collect())
    own = prepare(read_corpus(spark, src), cfg, tokenizer=regex_tokenizer)[2]
    assert stored == direct == sorted((r.input_ids, r.labels) for r in own.collect())
    assert preparation_job(spark, src, dst + "2", cfg, drop_blank=False).first().samples == 4
    with pytest.raises(ValueError):
        training_sequences(spark, str(tmp_path / "x.pt"), cfg)


def _write_lines(folder):
    folder.mkdir()
    lines = [('{"text": "%s"}' % ("é" * (i * 37 % 400))) for i in range(300)]
    (folder / "a.jsonl").write_text("\n".join(lines[:200]))
    (folder / "b.jsonl").write_bytes(("\r\n".join(lines[200:]) + "\r\n\r\n").encode())
    (folder / "c.jsonl").write_text("")
    (folder / "_SUCCESS").write_text("no line")
    return lines


def test_line_ids_do_not_depend_on_splits(spark, tmp_path):
    lines, seen = _write_lines(tmp_path / "in"), []
    for split in (5000, 1 << 30):
        rows = read_lines(spark, str(tmp_path / "in"), split).collect()
        seen.append(sorted((r.number, r.line) for r in rows))
        assert [line for _, line in seen[-1]] == lines and len(set(n for n, _ in seen[-1])) == 300
    assert all(s == seen[0] for s in seen)
    body = (tmp_path / "in" / "a.jsonl").read_bytes()
    for number, line in seen[0][:200]:
        at = (number - FIRST_NUMBER) % (1 << 40)
        assert body[at:at + len(line.encode())].decode() == line
    whole = list(lines_from(io.BytesIO(body), 0, len(body)))
    for split in (1, 13, 64, 1000):
        ranges = [(at, min(at + split, len(body))) for at in range(0, len(body), split)]
        assert [x for a, b in ranges for x in lines_from(io.BytesIO(body), a, b)] == whole
    packed = tmp_path / "packed"
    packed.mkdir()
    (packed / "a.jsonl.gz").write_bytes(gzip.compress(body))
    assert sorted((r.number, r.line) for r in read_lines(spark, "file:" + str(packed), 64).collect()) == seen[0][:200]


def test_corpus_by_place_has_no_exchange_and_fails_fast(spark, tmp_path):
    p = tmp_path / "in.jsonl"
    p.write_text('{"text": "a"}\n{"content": "b"}\n{"doc_id": 7, "text": "c", "extra": 1}\n{"text": " "}\n{"text": null}\n')
    d = read_corpus(spark, str(p), ids="place")
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()
    assert [(r.doc_id, r.text) for r in d.orderBy("text").collect()] == [
        (FIRST_NUMBER, "a"), (FIRST_NUMBER + 14, "b"), (7, "c")]
    assert read_corpus(spark, str(p), ids="place", drop_blank=False).count() == 5
    p.write_text('{"text": "a"}\n{"text": \n')
    with pytest.raises(Exception):
        read_corpus(spark, str(p), ids="place").collect()
    p.write_text("")
    assert read_corpus(spark, str(p), ids="place").count() == 0
    with pytest.raises(Exception):
        read_lines(spark, str(tmp_path / "none")).collect()


def test_repeated_append_replaces_its_rows(spark, tmp_path):
    p = str(tmp_path / "metrics")
    for loss, steps in ((1.0, (10, 20)), (2.0, (20, 30)), (2.0, (20, 30))):
        append_metrics(spark.createDataFrame([(1, s, loss) for s in steps], "run_id long, step long, loss double"), p)
    spark.createDataFrame([(1, 10, 9.0)], "run_id long, step long, loss double").write.parquet(p + "/part=unfinished")
    got = sorted(tuple(r) for r in read_metrics(spark, p).collect())
    assert got == [(1, 10, 1.0), (1, 20, 2.0), (1, 30, 2.0)]
