"""ST1-ST3: streams equal their batch counterparts."""

import os

from pyspark.sql import functions as F

from tokenloom.operators.telemetry import log_windows, micro_batches
from tokenloom.operators.vocab import build_vocab, encode
from tokenloom.operators.sequence import label_mask, to_sequences
from tokenloom.plans.jobs import BATCHES, _stream_files
from tokenloom.plans.prepare import documents, tokenized
from tokenloom.sources.corpus import input_bytes
from tokenloom.streaming import ingest
from tokenloom.streaming.ingest import rows_ingested
from tokenloom.streaming import (finish_log_windows, stream_ingest, stream_log_windows, stream_metrics,
                                 stream_tokenize)

from conftest import SF001


def _split_files(df, path, parts):
    df.repartition(parts).write.parquet(path)
    return len([f for f in os.listdir(path) if f.endswith(".parquet")])


def test_stream_ingest_limit(spark, tmp_path):
    src = str(tmp_path / "src")
    d = spark.read.parquet(SF001 + "/documents.parquet").select("doc_id", "text")
    _split_files(d, src, 4)
    stream_ingest(spark, src, str(tmp_path / "out"), str(tmp_path / "ck"), limit=150, max_files_per_trigger=1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 150
    stream_ingest(spark, src, str(tmp_path / "out2"), str(tmp_path / "ck2"), limit=10_000, max_files_per_trigger=1)
    assert spark.read.parquet(str(tmp_path / "out2")).count() == d.count()


def test_stream_tokenize_equals_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    d = spark.read.parquet(SF001 + "/documents.parquet").select("doc_id", "text")
    _split_files(d, src, 3)
    docs = documents(spark, SF001, ("doc_id", "text"))
    toks = tokenized(docs)
    vocab = build_vocab(toks, 500)
    stream_tokenize(spark, src, str(tmp_path / "out"), str(tmp_path / "ck"), vocab, max_length=32,
                    max_files_per_trigger=1)
    got = {r.doc_id: (r.input_ids, r.labels) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    ref = label_mask(to_sequences(encode(toks, vocab, max_length=32), 32))
    want = {r.doc_id: (r.input_ids, r.labels) for r in ref.collect()}
    assert got == want


def test_stream_log_windows_equals_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    log = micro_batches(spark.read.parquet(SF001 + "/events.parquet"))
    _split_files(log, src, 3)
    stream_log_windows(spark, src, str(tmp_path / "out"), str(tmp_path / "ck"), every=1, accumulation=4,
                       max_files_per_trigger=1)
    got = {(r.run_id, r.step): round(r.loss, 9)
           for r in finish_log_windows(spark, str(tmp_path / "out"), 1, 4, 8).collect()}
    want = {(r.run_id, r.step): round(r.loss, 9) for r in log_windows(log, 1, 4, 8).collect()}
    assert got == want and len(got) > 0


def test_stream_metrics_appends_once(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = spark.createDataFrame([(r % 3, r, float(r)) for r in range(30)], "run_id long, step long, loss double")
    _split_files(rows, src, 3)
    dst, ck = str(tmp_path / "metrics"), str(tmp_path / "ck")
    stream_metrics(spark, src, dst, ck, max_files_per_trigger=1)
    stream_metrics(spark, src, dst, ck, max_files_per_trigger=1)  # restart: nothing new to append
    back = spark.read.parquet(dst)
    assert back.count() == 30 and back.select("run_id").distinct().count() == 3


def test_stream_ingest_stops_at_its_bound_and_stays_there(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    spark.range(400).withColumn("v", F.col("id") % 7).repartition(8).write.parquet(src)
    q = stream_ingest(spark, src, out, ck, limit=120, max_files_per_trigger=1)
    assert spark.read.parquet(out).count() == 120 == rows_ingested(spark, out)
    assert not q.isActive
    folders = [f for f in os.listdir(out) if f.startswith("batch_id=")]
    assert len(folders) == 3  # 50 rows a file: the rest was not copied
    assert stream_ingest(spark, src, out, ck, limit=120, max_files_per_trigger=1) is None
    assert spark.read.parquet(out).count() == 120 == spark.read.parquet(out).select("id").distinct().count()


def test_stream_ingest_keeps_its_room_over_a_restart(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    for start, rows in ((0, 60), (60, 120), (180, 120)):
        spark.range(start, start + rows).repartition(2).write.mode("append").parquet(src)
        stream_ingest(spark, src, out, ck, limit=200, max_files_per_trigger=1)
        assert spark.read.parquet(out).count() == min(200, start + rows) == rows_ingested(spark, out)
    ids = sorted(r.id for r in spark.read.parquet(out).collect())
    assert ids[:180] == list(range(180)) and len(set(ids)) == 200


def test_stream_ingest_of_a_bound_that_is_a_file_border(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    spark.range(40).repartition(4).write.parquet(src)
    stream_ingest(spark, src, out, ck, limit=20, max_files_per_trigger=1)
    assert spark.read.parquet(out).count() == 20


def test_log_windows_are_written_once_and_state_survives_a_restart(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    rows = [(r, n, 1_700_000_000 + 10 * n + r, float(n) if n % 5 else None) for r in (1, 2) for n in range(1100)]
    log = spark.createDataFrame(rows, "run_id long, n long, t long, loss double").selectExpr(
        "run_id", "n", "timestamp_seconds(t) as ts", "loss")
    log.where("n % 3 = 0").coalesce(1).write.parquet(src)
    for part in ("n % 3 = 1", "n % 3 = 2"):  # every window is open until the last start
        stream_log_windows(spark, src, out, ck, every=2, accumulation=4)
        assert spark.read.parquet(out).count() == 0
        log.where(part).coalesce(1).write.mode("append").parquet(src)
    stream_log_windows(spark, src, out, ck, every=2, accumulation=4)
    back = spark.read.parquet(out)
    assert back.count() == 2 * 137 == back.select("run_id", "m").distinct().count()
    got = sorted((r.run_id, r.step, round(r.loss, 9), r.ms_per_step, r.ts) for r in
                 finish_log_windows(spark, out, 2, 4, 8).collect())
    want = sorted((r.run_id, r.step, round(r.loss, 9), r.ms_per_step, r.ts) for r in log_windows(log, 2, 4, 8).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and str(got) == str(want)
    state = spark.read.format("statestore").load(ck)
    assert state.count() == 2 * 1  # 137 windows: two slices of 64 left the state, the third stays open


def test_many_runs_share_the_state_rows(spark, tmp_path, monkeypatch):
    """A state row a run would be 600 of them, and as many calls of Python in every micro-batch."""
    monkeypatch.setattr(ingest, "BUCKETS", 16, raising=False)
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    log = spark.range(600 * 21).selectExpr(
        "nullif(id div 21, 5) * 9007199254740993 AS run_id", "id % 21 AS n", "timestamp_seconds(id * 7) AS ts",
        "CASE WHEN id % 50 > 0 THEN id / 8 END AS loss")
    _split_files(log, src, 3)
    stream_log_windows(spark, src, out, ck, every=1, accumulation=4, max_files_per_trigger=1)
    log.where("n < 8 AND run_id % 2 = 0").coalesce(1).write.mode("append").parquet(src)  # their windows are written already
    stream_log_windows(spark, src, out, ck, every=1, accumulation=4, max_files_per_trigger=1)
    state = spark.read.format("statestore").load(ck)
    assert 0 < state.count() <= 2 * 16
    assert state.selectExpr("sum(size(value.groupState.run)) AS n").first().n == 600  # the sixth window of each run is open

    def rows(w):
        return sorted(str(r) for r in w.select("run_id", "step", F.round("loss", 9), F.round("ms_per_step", 6), "ts").collect())

    got = finish_log_windows(spark, out, 1, 4, 8)
    assert got.count() == 600 * 5
    assert rows(got) == rows(log_windows(log, 1, 4, 8))


def test_idle_slices_leave_the_state(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))

    def add(run, t):
        spark.sql(f"SELECT {run}L AS run_id, 0L AS n, timestamp_seconds({t}) AS ts, 1.0D AS loss").coalesce(1).write.mode("append").parquet(src)
        stream_log_windows(spark, src, out, ck, every=1, accumulation=2, idle_seconds=60)
        return sorted(r.key.run_id for r in spark.read.format("statestore").load(ck).collect())

    assert add(1, 1_700_000_000) == [1]
    add(2, 1_700_001_000)
    assert 1 not in add(3, 1_700_002_000)


def test_a_stream_source_has_files_for_every_core(spark):
    """Four micro-batches, each of as many files as there are cores."""
    src, _, _, files = _stream_files(spark, spark.read.parquet(SF001 + "/documents.parquet").select("doc_id"), "files")
    written = spark.read.parquet(src)
    assert files == spark.sparkContext.defaultParallelism and len(written.inputFiles()) == BATCHES * files
    assert written.count() == written.distinct().count() == 200
    assert input_bytes(written) == sum(os.path.getsize(f.removeprefix("file://")) for f in written.inputFiles())
