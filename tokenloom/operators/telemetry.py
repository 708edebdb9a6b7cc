"""Run telemetry over a micro-batch log (T1-T4, W5, A8, B4 on logs).

A log row is one micro-batch: (run_id, n, ts, loss) with ``n`` the
0-based micro-batch number in the run.  ``micro_batches`` derives ``n``
from raw rows by an exact per-run rank whose buckets are time slices, so
a run holding a third of all rows is still spread over many tasks.
Throughput uses a self-join on (run, window - 1) rather than ``lag`` over
the run, for the same reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mathx import schedule_factor_col
from .rank import global_rank


def _micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def micro_batches(events: DataFrame, run_col: str = "user_id", ts_col: str = "ts", id_col: str = "event_id",
                  loss_col: str = "value", bucket_seconds: int = 60) -> DataFrame:
    """(run_id, n, ts, loss): rows of each run numbered by (ts, id).

    Exact per-run rank bucketed by ``bucket_seconds`` time slices: a run
    with a third of 10**11 rows over a month still has < 1M rows per
    one-minute slice, and the offsets table has one row per (run, slice).
    """
    base = events.select(F.col(run_col).alias("run_id"), F.col(ts_col).alias("ts"),
                         F.col(id_col).alias("_id"), F.col(loss_col).cast("double").alias("loss"))
    bucket = F.floor(_micros("ts") / F.lit(int(bucket_seconds) * 1_000_000)).cast("long")
    ranked = global_rank(base, "ts", "_id", bucket=bucket, partition_cols=("run_id",), rank_col="n",
                         total_col=None)
    return ranked.select("run_id", "n", "ts", "loss")


def update_log(log: DataFrame, accumulation: int) -> DataFrame:
    """B4 on a log: (run_id, step, loss_sum, ts) per complete group of G micro-batches."""
    G = int(accumulation)
    agg = log.groupBy("run_id", (F.col("n") / F.lit(G)).cast("long").alias("_g")).agg(
        F.sum("loss").alias("loss_sum"), F.count(F.lit(1)).alias("_c"), F.max("ts").alias("ts"))
    return agg.where(F.col("_c") == G).select("run_id", (F.col("_g") + 1).alias("step"), "loss_sum", "ts")


def window_sums(log: DataFrame, span: int) -> DataFrame:
    """(run_id, m, loss_sum, n_micro, ts) of each window of ``span`` micro-batches, whole or not."""
    return log.groupBy("run_id", F.expr(f"n div {int(span)}").alias("m")).agg(
        F.sum("loss").alias("loss_sum"), F.count(F.lit(1)).alias("n_micro"), F.max("ts").alias("ts"))


def window_rows(sums: DataFrame, every: int, accumulation: int, batch_size: int, world: int = 1) -> DataFrame:
    """A8/W5 of complete windows: (run_id, step, loss, steps_per_sec, samples_per_sec, ms_per_step, ts).

    loss = sum of the window's micro-batch losses / (every * G) (fixed
    divisor); steps/s, samples/s, ms/step from the clock difference to
    the previous log row of the run (NULL for the first, D10; 0 when the
    difference is not positive).
    """
    L, span = int(every), int(every) * int(accumulation)
    done = sums.where(F.col("n_micro") == span)
    prev = done.select("run_id", (F.col("m") + 1).alias("m"), F.col("ts").alias("_prev_ts"))
    dt = (_micros("ts") - _micros("_prev_ts")).cast("double") / F.lit(1e6)

    def rate(x):
        return F.when(F.col("_prev_ts").isNull(), F.lit(None).cast("double")).when(dt > 0, x).otherwise(F.lit(0.0))

    return done.join(prev, ["run_id", "m"], "left").select(
        "run_id", ((F.col("m") + 1) * F.lit(L)).cast("long").alias("step"),
        (F.col("loss_sum") / F.lit(float(span))).alias("loss"),
        rate(F.lit(float(L)) / dt).alias("steps_per_sec"),
        rate(F.lit(float(span * int(batch_size) * int(world))) / dt).alias("samples_per_sec"),
        rate(dt * F.lit(1000.0) / F.lit(float(L))).alias("ms_per_step"), "ts")


def log_windows(log: DataFrame, every: int, accumulation: int, batch_size: int, world: int = 1,
                learning_rate: float = 5e-4, warmup: int = 100, total_steps: int = 50_000,
                schedule: str = "cosine", steps_per_epoch: int | None = None) -> DataFrame:
    """One row per ``every`` updates of each run (``window_rows``).

    learning rate = lr * lambda(step); ``epoch`` (0-based) is that of the
    row's step, 0 throughout without ``steps_per_epoch``.
    """
    rows = window_rows(window_sums(log, int(every) * int(accumulation)), every, accumulation, batch_size, world)
    step = F.col("step")
    epoch = F.expr(f"(step - 1) div {int(steps_per_epoch)}").cast("int") if steps_per_epoch else F.lit(0)
    rate = F.lit(float(learning_rate)) * schedule_factor_col(step, int(warmup), int(total_steps), schedule)
    return rows.select("run_id", "step", epoch.alias("epoch"), "loss", rate.alias("learning_rate"),
                       "steps_per_sec", "samples_per_sec", "ms_per_step", "ts")


def scheduled_rate(updates: DataFrame, learning_rate: float, warmup: int, schedule: str = "cosine",
                   total_steps: int | None = None) -> DataFrame:
    """Attach lr * lambda(step) to an update log of many runs.

    ``total_steps`` None: each run's own number of updates (its plan).
    """
    if total_steps is None:
        totals = updates.groupBy("run_id").agg(F.max("step").alias("_total"))
        u = updates.join(totals, "run_id")
        total = F.col("_total")
    else:
        u, total = updates, F.lit(int(total_steps))
    lam = schedule_factor_col("step", int(warmup), total, schedule)
    return u.withColumn("learning_rate", F.lit(float(learning_rate)) * lam).drop("_total")


def on_cadence(log: DataFrame, every: int, step_col: str = "step") -> DataFrame:
    """Rows whose step is a multiple of ``every`` (log / eval / save cadence)."""
    return log.where((F.col(step_col) % F.lit(int(every))) == 0)


def latest_step(log: DataFrame, step_col: str = "step") -> DataFrame:
    """T4: resume point per run."""
    return log.groupBy("run_id").agg(F.max(step_col).alias("latest_step"))
