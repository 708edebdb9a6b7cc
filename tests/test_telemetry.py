"""Log windows, throughput, schedule, cadence, resume point."""

import datetime as dt
import math

from tokenloom.operators.telemetry import (latest_step, log_windows, micro_batches, on_cadence, scheduled_rate,
                                           update_log)


def _events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double")


def _t(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_micro_batch_numbering_ties_by_id(spark):
    ev = _events(spark, [(5, _t(0), 1, 1.0), (3, _t(0), 1, 2.0), (9, _t(7200), 1, 3.0), (1, _t(1), 2, 4.0)])
    got = sorted((r.run_id, r.n, r.loss) for r in micro_batches(ev).collect())
    assert got == [(1, 0, 2.0), (1, 1, 1.0), (1, 2, 3.0), (2, 0, 4.0)]


def test_windows_throughput_and_edges(spark):
    # run 1: 5 micro-batches, G=2, L=1 -> windows at steps 1, 2 (5th is a short group)
    rows = [(i, _t(t), 1, float(i)) for i, t in enumerate([0, 10, 20, 20, 30])]
    rows += [(100, _t(0), 2, 1.0)]  # run 2: fewer than G micro-batches -> nothing
    log = micro_batches(_events(spark, rows))
    w = {(r.run_id, r.step): r for r in log_windows(log, 1, 2, batch_size=4, warmup=0, total_steps=10).collect()}
    assert set(w) == {(1, 1), (1, 2)}
    assert w[(1, 1)].loss == 0.5 and w[(1, 1)].steps_per_sec is None  # first window: no previous clock
    assert w[(1, 2)].loss == 2.5
    assert abs(w[(1, 2)].steps_per_sec - 0.1) < 1e-12 and abs(w[(1, 2)].samples_per_sec - 0.8) < 1e-12
    assert abs(w[(1, 2)].ms_per_step - 10000.0) < 1e-9
    same = [(i, _t(0), 1, 1.0) for i in range(4)]
    w2 = log_windows(micro_batches(_events(spark, same)), 1, 2, 4).collect()
    assert sorted(r.steps_per_sec for r in w2 if r.steps_per_sec is not None) == [0.0]  # same clock -> 0


def test_schedule_cosine_linear_constant(spark):
    u = spark.createDataFrame([(1, s, 0.0, _t(s)) for s in range(0, 13)], "run_id long, step long, loss_sum double, ts timestamp_ntz")
    cos = {r.step: r.learning_rate for r in scheduled_rate(u, 1.0, 2, "cosine", total_steps=12).collect()}
    assert cos[0] == 0.0 and cos[1] == 0.5 and abs(cos[2] - 1.0) < 1e-12
    assert abs(cos[7] - 0.5) < 1e-12 and abs(cos[12]) < 1e-12
    lin = {r.step: r.learning_rate for r in scheduled_rate(u, 1.0, 2, "linear", total_steps=12).collect()}
    assert abs(lin[7] - 0.5) < 1e-12 and lin[12] == 0.0
    const = {r.step: r.learning_rate for r in scheduled_rate(u, 1.0, 2, "anything").collect()}
    assert const[5] == 1.0 and const[1] == 0.5
    per_run = {r.step: r.learning_rate for r in scheduled_rate(u, 1.0, 2, "cosine").collect()}
    assert abs(per_run[12]) < 1e-12  # total = the run's own last step
    assert not math.isnan(per_run[3])


def test_cadence_and_latest(spark):
    log = micro_batches(_events(spark, [(i, _t(i), 1, 1.0) for i in range(12)]))
    upd = update_log(log, 2)
    assert sorted(r.step for r in on_cadence(upd, 3).collect()) == [3, 6]
    assert latest_step(upd).first().latest_step == 6
