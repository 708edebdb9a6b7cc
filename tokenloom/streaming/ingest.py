"""Structured Streaming jobs (ST1-ST3).

All three read a file source with an explicit schema, run with
``trigger(availableNow=True)`` so a bounded backlog is processed in
several micro-batches and the query stops, and keep their progress in a
checkpoint folder so a restarted job resumes where it stopped.
"""

from __future__ import annotations

import threading

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions.text import nonblank_col, text_fallback_col, tokens_col
from ..operators.rank import global_rank, hash_key
from ..operators.sequence import label_mask, to_sequences
from ..operators.telemetry import window_rows
from ..operators.vocab import encode
from ..plans.prepare import spread
from ..sources.commits import get_record, last_number, put_record


def _source(spark: SparkSession, src: str, schema: StructType | str | None, fmt: str,
            max_files_per_trigger: int) -> DataFrame:
    if schema is None:
        schema = spark.read.format(fmt).load(src).schema  # file footers only
    return (spark.readStream.format(fmt).schema(schema)
            .option("maxFilesPerTrigger", int(max_files_per_trigger)).load(src))


def rows_ingested(spark: SparkSession, dst: str) -> int:
    """Rows that ``stream_ingest`` has written to ``dst``, by its last record."""
    record = get_record(spark, dst, last_number(spark, dst))
    return int(record["rows"]) if record else 0


def stream_ingest(spark: SparkSession, src: str, dst: str, checkpoint: str, limit: int | None,
                  schema: StructType | str | None = None, fmt: str = "parquet",
                  max_files_per_trigger: int = 1000):
    """ST1: copy at most ``limit`` rows of a file stream into the Parquet table at ``dst``.

    Each micro-batch writes its own ``batch_id=`` folder, so a replayed one
    replaces its rows, and then a record of the rows written so far, which tells the
    next one its room: earlier folders are not read again.  Only the batch
    that passes the limit is ranked, by a hash of the row in buckets, and keeps
    its first rows.  With the limit reached, the query stops and reads no further
    files; a later start returns None at once.  The limit of a table is not to be changed.
    """
    s = _source(spark, src, schema, fmt, max_files_per_trigger)
    cols = s.columns
    full = threading.Event()

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        done = 0
        if batch_id > 0:
            before = get_record(spark, dst, batch_id - 1)
            if before is None:
                raise RuntimeError(f"{dst} has no record of micro-batch {batch_id - 1}")
            done = int(before["rows"])
        if limit is not None and done >= int(limit):  # started before the query could be stopped
            put_record(spark, dst, batch_id, {"rows": done}, replace=True)
            full.set()
            return
        rows = batch.count()
        if limit is not None and rows > int(limit) - done:
            rows = int(limit) - done
            keyed = batch.withColumn("_h", hash_key(F.xxhash64(*cols)))
            ranked = global_rank(keyed, "_h", cols[0], rank_col="_r", total_col=None)
            batch = ranked.where(F.col("_r") < rows).select(*cols)
        batch.write.mode("overwrite").parquet(f"{dst}/batch_id={int(batch_id)}")
        put_record(spark, dst, batch_id, {"rows": done + rows}, replace=True)
        if limit is not None and done + rows >= int(limit):
            full.set()

    if limit is not None and rows_ingested(spark, dst) >= int(limit):
        return None
    q = (s.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    while not q.awaitTermination(1):
        if full.is_set():
            q.stop()
            break
    return q


def stream_tokenize(spark: SparkSession, src: str, dst: str, checkpoint: str, vocab: DataFrame,
                    max_length: int, schema: StructType | str | None = None, fmt: str = "parquet",
                    max_files_per_trigger: int = 1000, id_col: str = "doc_id"):
    """ST2: text stream -> P1/P2/P4 -> frozen-vocabulary encode -> sequences, per micro-batch.

    Every step is row-local and part of the stream's own plan, so the vocabulary
    is sent once for all micro-batches.  Each micro-batch overwrites its own
    ``batch_id=`` folder, so a replayed batch replaces rather than duplicates.
    """
    s = _source(spark, src, schema, fmt, max_files_per_trigger)
    docs = s.select(id_col, text_fallback_col(s.columns).alias("text")).where(nonblank_col("text"))
    toks = spread(docs, id_col).select(id_col, tokens_col("text").alias("tokens"))
    ids = encode(toks, vocab.select("tok", "id"), max_length=max_length, id_col=id_col)
    seqs = label_mask(to_sequences(ids, max_length, keep=(id_col,)))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{dst}/batch_id={int(batch_id)}")

    q = (seqs.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


SLICE = 64  # log windows of a run that leave the state together: a bit each in their slice's mask
BUCKETS = 4096  # state rows that share the slices of all runs; a checkpoint keeps its number
_WINDOW_SUMS = "run_id bigint, m bigint, loss_sum double, n_micro bigint, ts_micros bigint"
_BUCKET_STATE = ("run array<bigint>, m array<bigint>, sums array<double>, counts array<bigint>, last array<bigint>, "
                 "done_run array<bigint>, done_part array<bigint>, done array<bigint>, newest bigint")


def _window_state(span: int, idle_seconds: int | None):
    """State function of ST3 for windows of ``span`` micro-batches, for any number of slices a call.

    The state has the open windows, and for each unfinished slice with written windows a mask of them.
    """

    def groups(first, second):
        """(order, place of each group's first row in it, group of each row) by two columns."""
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        ids = np.empty(len(order), np.int64)
        ids[order] = np.cumsum(new) - 1
        return order, np.flatnonzero(new), ids

    def summed(run, m, sums, counts, last):
        order, starts, _ = groups(run, m)
        return (run[order][starts], m[order][starts], np.add.reduceat(sums[order], starts),
                np.add.reduceat(counts[order], starts), np.maximum.reduceat(last[order], starts))

    def step(key, frames, state):
        if state.hasTimedOut:  # nothing came for the whole idle time: its open windows never end
            state.remove()
            return
        kinds = (np.int64, np.int64, np.float64, np.int64, np.int64)
        stored = state.get if state.exists else ((),) * 8 + (np.iinfo(np.int64).min,)
        parts = [tuple(np.array(x, t) for x, t in zip(stored[:5], kinds))]
        done_run, done_part, done = (np.array(x, np.int64) for x in stored[5:8])
        for f in frames:
            run, m, loss, ts = (f[c].to_numpy() for c in ("run", "m", "loss", "ts_micros"))
            parts.append(summed(run, m, loss, np.ones(len(f), np.int64), ts))
        newest = max([stored[8], *(int(p[4].max()) for p in parts[1:])])
        run, m, sums, counts, last = summed(*(np.concatenate(x) for x in zip(*parts)))

        slices, bit = m // SLICE, np.left_shift(np.uint64(1), (m % SLICE).astype(np.uint64))
        all_runs, all_parts = np.concatenate([run, done_run]), np.concatenate([slices, done_part])
        order, starts, ids = groups(all_runs, all_parts)
        written = np.zeros(len(starts), np.uint64)
        written[ids[len(run):]] = done.view(np.uint64)
        ids = ids[:len(run)]
        left = (written[ids] & bit) == 0  # rows of a window that is written already count nowhere
        new, still = left & (counts >= span), left & (counts < span)
        np.bitwise_or.at(written, ids[new], bit[new])
        kept = (written != 0) & (written != np.iinfo(np.uint64).max)
        if still.any() or kept.any():
            at = order[starts[kept]]
            state.update(tuple(x.tolist() for x in (run[still], m[still], sums[still], counts[still], last[still],
                                                    all_runs[at], all_parts[at], written[kept].view(np.int64))) + (newest,))
            if idle_seconds is not None:
                state.setTimeoutTimestamp(max(newest // 1000, state.getCurrentWatermarkMs()) + 1000 * idle_seconds)
        elif state.exists:
            state.remove()
        if new.any():
            yield pd.DataFrame({"run_id": None if key[-1] else run[new], "m": m[new], "loss_sum": sums[new],
                                "n_micro": counts[new], "ts_micros": last[new]})

    return step


def stream_log_windows(spark: SparkSession, src: str, dst: str, checkpoint: str, every: int,
                       accumulation: int, schema: StructType | str | None = None, fmt: str = "parquet",
                       max_files_per_trigger: int = 1000, idle_seconds: int | None = None):
    """ST3: streaming roll-up of a micro-batch log (run_id, n, ts, loss) into log windows.

    The stream's state holds the open windows.  Slices of SLICE windows of a run are dealt by
    their hash to BUCKETS state rows, so a long run is spread over many tasks and many
    short ones share a call of the state function.  A window is written once, in
    the micro-batch that completes it, to that batch's ``batch_id=`` folder; a slice
    whose windows are all written leaves the state.  A run's last, unfinished slice
    stays, unless ``idle_seconds`` is set: then a slice has a state row of its own and goes when the
    log's clock has passed its newest row by that much, and rows older than
    that are late and left out.  Each ``n`` of a run is expected once.
    A null loss counts as 0; rows without ``n`` or ``ts`` belong to no window.
    """
    span = int(every) * int(accumulation)
    s = _source(spark, src, schema, fmt, max_files_per_trigger)
    run, ts = F.col("run_id").cast("bigint"), F.col("ts").cast("timestamp")
    rows = s.where(F.col("n").isNotNull() & F.col("ts").isNotNull()).select(
        run.alias("run_id"), F.coalesce(run, F.lit(0)).alias("run"), run.isNull().alias("no_run"),
        F.expr(f"n div {span}").alias("m"), F.expr(f"n div {span * SLICE}").alias("part"),
        ts.alias("ts"), F.unix_micros(ts).alias("ts_micros"),
        F.coalesce(F.col("loss").cast("double"), F.lit(0.0)).alias("loss"))
    if idle_seconds is None:
        bucket = F.pmod(F.xxhash64("run_id", "part"), F.lit(BUCKETS)).alias("bucket")
        rows = rows.select(bucket, "no_run", "run", "m", "ts_micros", "loss")
        keys, timer = ("bucket", "no_run"), GroupStateTimeout.NoTimeout
    else:
        rows = rows.withWatermark("ts", f"{int(idle_seconds)} seconds")
        keys, timer = ("run_id", "part", "no_run"), GroupStateTimeout.EventTimeTimeout
    done = rows.groupBy(*keys).applyInPandasWithState(
        _window_state(span, idle_seconds), _WINDOW_SUMS, _BUCKET_STATE, "append", timer)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("ts", F.timestamp_micros("ts_micros")).drop("ts_micros")
        rows.write.mode("overwrite").parquet(f"{dst}/batch_id={int(batch_id)}")

    q = (done.writeStream.outputMode("append").foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def finish_log_windows(spark: SparkSession, dst: str, every: int, accumulation: int, batch_size: int,
                       world: int = 1) -> DataFrame:
    """The windows that ST3 wrote, as ``window_rows``: rates come from the run's window before, by an equi-join."""
    sums = spark.read.parquet(dst).select("run_id", "m", "loss_sum", "n_micro", "ts")
    return window_rows(sums, every, accumulation, batch_size, world)


def stream_metrics(spark: SparkSession, src: str, dst: str, checkpoint: str,
                   schema: StructType | str | None = None, fmt: str = "parquet", max_files_per_trigger: int = 1000,
                   partition_by: tuple = ()):
    """S8 for a stream: append metric rows (run_id, step, ...) to the Parquet table at ``dst``.

    Rows are sorted by run inside each file, so Parquet statistics prune a
    run; ``partition_by`` columns make folders and suit few values only.

    ``foreachBatch`` with the batch sink.  Each micro-batch overwrites its
    own ``batch_id=`` folder, so a retried batch replaces its rows instead
    of appending them twice; the checkpoint records consumed files, so a
    restart skips them.
    """
    s = _source(spark, src, schema, fmt, max_files_per_trigger)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        rows = batch.sortWithinPartitions("run_id", "step")
        rows.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{dst}/batch_id={int(batch_id)}")

    q = (s.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
