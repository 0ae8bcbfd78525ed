"""Streams: a row later than the watermark is dropped by the windowed cost; ingest keeps one row per id."""
from pyspark.sql import functions as F

from augeval.operators.ledger import LOG_SCHEMA, write_log
from augeval.plans import roles
from augeval.session import scratch_path
from augeval.streaming import log_stream as ls

COLS = [f.name for f in LOG_SCHEMA.fields]


def test_late_row_ignored(spark, sf):
    log = roles.log(spark, sf, spread_rows=False).select(*COLS)
    path = scratch_path(spark, "late")
    ls.write_batches(log, path, "seq", 3)
    first_day = log.agg(F.min("date")).first()[0]
    late = log.filter(F.col("date") == first_day).limit(1).withColumn("custom_id", F.lit("late_row")) \
        .withColumn("seq", F.lit(10 ** 9).cast("bigint"))
    write_log(late, path, "append")                      # arrives after the watermark passed its day
    out = ls.run_to_table(ls.cost_windows(ls.read_stream(spark, path, files_per_trigger=1), "1 hour"), spark, "late-out")
    got = out.filter(F.col("day") == first_day).agg(F.sum("requests")).first()[0]
    expected = log.filter(F.col("date") == first_day).count()
    assert got == expected                               # the late copy is not counted


def _shuffled(spark, rows, schema, files):
    """Rows in random order over ``files`` files, then a tick of the clock."""
    d = spark.createDataFrame(rows, schema)
    path = scratch_path(spark, "shuffled")
    d.repartition(files).write.json(path)
    ls.write_tick(d, path, "ts", "60 DAYS")
    return ls.read_stream(spark, path, d.schema, files_per_trigger=8), d


def _day(n):
    from datetime import datetime, timedelta
    return datetime(2024, 1, 1) + timedelta(hours=6 * n)


def test_first_arrival_from_many_files_in_any_order(spark):
    import random
    r = random.Random(3)
    rows = [(f"r{r.randrange(40)}", i, _day(r.randrange(40)), f"text {i}") for i in range(400)]
    schema = "custom_id string, seq long, ts timestamp_ntz, text string"
    s, _ = _shuffled(spark, rows, schema, 20)
    out, q = ls.run_query(ls.ingest(s.drop("ts"), "30 days", horizon_ms=86_400_000), spark, "first")
    want = {}
    for x in rows:
        want[x[0]] = min(want.get(x[0], x), x, key=lambda y: (y[2], y[1]))
    assert sorted((x.custom_id, x.seq, x.text) for x in out.collect()) == sorted((x[0], x[1], x[3]) for x in want.values())
    assert ls.state_rows(q) == 0


def _runs(seed):
    import random
    r = random.Random(seed)
    rows = [(run, e, r.choice([5.0, 4.0, 3.0, 2.0, 1.0, 6.0]), _day(e)) for run in range(20) for e in range(1, r.randrange(2, 15))]
    r.shuffle(rows)
    return rows


RUNS = "run long, epoch long, val_mae double, ts timestamp_ntz"


def test_early_stop_from_many_files_in_any_order(spark):
    """Eight files per batch, rows shuffled over them: the stream gives the batch twin's rows, each run once, and no state is left."""
    from augeval.operators.paired import early_stop
    s, d = _shuffled(spark, _runs(5), RUNS, 20)
    out, q = ls.run_query(ls.early_stop_stream(s, 3, "10 days", 20 * 86_400_000), spark, "t4t")
    want = early_stop(d, ["run"], "epoch", "val_mae", 3).select("run", "best_epoch", "best_val_mae", "steps_run").collect()
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want)) and len(want) == 20
    assert ls.state_rows(q) == 0


def test_settled_epochs_leave_the_state_while_the_stream_goes_on(spark):
    """A file a trigger in event order and no final tick: behind the watermark a run holds its fold, not its epochs; runs that have
    ended by silence hold nothing."""
    d = spark.createDataFrame([(run, e, 100.0 - e, _day(e)) for run in range(4) for e in range(1, 200 if run else 20)], RUNS)
    path = scratch_path(spark, "long")
    for lo in range(0, 200, 25):
        d.where(f"epoch > {lo} and epoch <= {lo + 25}").coalesce(1).write.mode("append").json(path)
    s = ls.read_stream(spark, path, d.schema, files_per_trigger=1)
    out, q = ls.run_query(ls.early_stop_stream(s, 3, "1 day", 5 * 86_400_000), spark, "long-out")
    assert [tuple(x) for x in out.collect()] == [(0, 19, 81.0, 19)]  # silent for five days; the others go on
    # clock, fold and timers (by key and by time) of three runs, and the epochs of the last day (four a day) of each
    assert ls.state_rows(q) <= 3 * (4 + 6)


def test_ingest_one_row_per_id(spark, sf):
    log = roles.log(spark, sf, spread_rows=False).select(*COLS)
    path = scratch_path(spark, "ingest")
    ls.write_batches(log, path, "seq", 3)
    ls.write_tick(log, path, "ts", "500 DAYS")
    s = ls.read_stream(spark, path).select("custom_id", "seq", "event_time")
    out = ls.run_to_table(ls.ingest(s, "400 days"), spark, "ing")
    assert out.count() == out.select("custom_id").distinct().count() == log.select("custom_id").distinct().count()


class _Value:
    def __init__(self):
        self.value, self.calls = None, 0

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None


class _Handle:
    """State of one key, in memory."""

    def __init__(self):
        self.states, self.timers = {}, set()

    def getValueState(self, name, schema):
        return self.states.setdefault(name, _Value())

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def test_early_stop_state_calls_do_not_grow_with_the_rows():
    class Times:
        def __init__(self, watermark):
            self.watermark = watermark

        def getCurrentWatermarkInMs(self):
            return self.watermark

    def calls(n):
        op, handle = ls.EarlyStop(3, 10 ** 9), _Handle()
        op.init(handle)
        row = lambda e, v: {"epoch": e, "val_mae": v, "_at": e * 1000}
        rows = [row(e, 1000.0 - e) for e in range(1, n + 1)]
        assert not list(op.handleInputRows((7,), iter([*reversed(rows), row(n, 5000.0)]), Times(0)))  # of a repeated epoch the last row counts
        assert handle.timers == {2}
        assert not list(op.handleInputRows((7,), iter([row(n + 2, None), row(n + 1, 4000.0)]), Times(n)))
        out = list(op.handleInputRows((7,), iter([row(3, 0.0)]), Times(10 * n)))  # epoch 3 is folded already
        assert [tuple(r) for r in out] == [(7, n - 1, 1001.0 - n, n + 2)] and handle.states["ahead"].value is None
        return sum(s.calls for s in handle.states.values())
    assert calls(10) == calls(500) <= 25
