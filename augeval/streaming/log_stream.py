"""The response log as a file stream: ingest with the first arrival per id, windowed cost, stream-static decontamination, and
early stopping. Every query runs with ``trigger(availableNow=True)`` into a file sink (never the driver-memory sink), with its
checkpoint under the shared checkpoint folder.

The stateful operators (``transformWithState``) hang on event time alone, never on the order or number of files: what is
behind the watermark is settled, what is ahead of it waits in typed state, timers settle keys that receive nothing more and let their state
go. A row whose key is null is a tick of the clock: it moves the watermark and nothing else."""
from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from augeval.operators.ledger import LOG_SCHEMA, TS_FORMAT, TS_NTZ_FORMAT, write_log
from augeval.session import scratch_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # transformWithState needs it


def write_batches(df: DataFrame, path: str, order_col: str, n_batches: int, files: int | None = None) -> None:
    """Write a table as JSON lines in ``n_batches`` successive appends, in ``order_col`` ranges (by NTILE-free
    arithmetic on the column's min / max, so no global window); ``files`` per append, its rows dealt over them."""
    lo, hi = df.agg(F.min(order_col), F.max(order_col)).first()
    width = (hi - lo + 1) / n_batches
    for b in range(n_batches):
        part = df.filter((F.col(order_col) >= lo + b * width) & (F.col(order_col) < lo + (b + 1) * width))
        write_log(part.repartition(files, F.xxhash64(*df.columns)) if files else part, path, "append")


def write_tick(df: DataFrame, path: str, ts_col: str, later: str) -> None:
    """Append one row with the latest ``ts_col`` plus ``later`` and nothing else: it lets the watermark pass every earlier row."""
    tick = df.agg((F.max(ts_col) + F.expr(f"INTERVAL {later}")).alias("_t"))
    write_log(tick.select(*[(F.col("_t") if f.name == ts_col else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema]), path, "append")


def read_stream(spark: SparkSession, path: str, schema: T.StructType = LOG_SCHEMA, files_per_trigger: int = 1000) -> DataFrame:
    """File stream of JSON lines with an event-time column; ``files_per_trigger`` bounds a micro-batch."""
    s = (spark.readStream.schema(schema).option("timestampFormat", TS_FORMAT)
         .option("timestampNTZFormat", TS_NTZ_FORMAT).option("maxFilesPerTrigger", files_per_trigger).json(path))
    return s.withColumn("event_time", F.col("ts").cast("timestamp"))


def run_query(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> tuple[DataFrame, StreamingQuery]:
    """Run a streaming query to completion (availableNow) into parquet files: the result as a table, and the ended query
    with its progress."""
    out, ckpt = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        q = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", ckpt)
             .trigger(availableNow=True).start(out))
    finally:
        spark.conf.set(PROVIDER, before)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), q


def run_to_table(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """``run_query``'s table."""
    return run_query(stream, spark, name, mode)[0]


def state_rows(q: StreamingQuery) -> int:
    """State rows that a query held after its last batch."""
    return sum(op["numRowsTotal"] for op in q.lastProgress["stateOperators"])


class _Keyed(StatefulProcessor):
    """A key's state with one event-time timer, kept in ``clock`` as (latest event, timer), both in milliseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "latest long, timer long")

    def close(self) -> None:
        pass

    def set_timer(self, latest: int, at: int) -> None:
        old = self.clock.get()
        if old is None or old[1] != at:
            if old is not None:
                self.handle.deleteTimer(old[1])
            self.handle.registerTimer(at)
        self.clock.update((latest, at))

    def latest(self, rows: Iterable[Row] = ()) -> int:
        old = self.clock.get()
        return max([*(r["_at"] // 1000 for r in rows), *([old[0]] if old is not None else [])])


class FirstArrival(_Keyed):
    """The row of each key with the smallest (event time, order): sent once the watermark has passed it; further rows of the key
    are dropped until the key has been silent for ``horizon_ms``."""

    def __init__(self, names: list[str], order: str, schema: str, horizon_ms: int):
        self.names, self.order, self.schema, self.horizon = names, order, schema, horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.first = handle.getValueState("first", f"_at long, _sent boolean, {self.schema}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = list(rows)
        if key[0] is None:
            return
        latest = self.latest(rows)
        best = self.first.get() if self.first.exists() else None
        if best is None or not best[1]:
            at = self.names.index(self.order) + 2
            best = min([*([tuple(best)] if best is not None else []), *((r["_at"], False, *(r[n] for n in self.names)) for r in rows)],
                       key=lambda b: (b[0], b[at]))
            self.first.update(best)
        self.set_timer(latest, latest + self.horizon if best[1] else best[0] // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        best, latest = self.first.get(), self.clock.get()[0]
        if not best[1]:
            yield Row(**dict(zip(self.names, best[2:], strict=True)))
        if timerValues.getCurrentWatermarkInMs() >= latest + self.horizon:
            self.first.clear()
            self.clock.clear()
        else:
            self.first.update((best[0], True, *best[2:]))
            self.clock.update((latest, latest + self.horizon))
            self.handle.registerTimer(latest + self.horizon)


def ingest(stream: DataFrame, delay: str, key: str = "custom_id", order: str = "seq", horizon_ms: int = 0) -> DataFrame:
    """The first row per id by (event_time, ``order``), whatever file or batch brings it, as long as no row is later than
    ``delay``; repeated ids are dropped until an id has been silent for ``horizon_ms`` (beyond the watermark)."""
    s = stream.withWatermark("event_time", delay)
    names = [c for c in s.columns if c != "event_time"]
    schema = T.StructType([s.schema[c] for c in names])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return s.withColumn("_at", F.unix_micros("event_time")).groupBy(key).transformWithState(
        FirstArrival(names, order, ddl, horizon_ms), schema, "append", "EventTime")


def cost_windows(stream: DataFrame, delay: str, window: str = "1 day") -> DataFrame:
    """Cost and requests per task in tumbling windows; rows later than the watermark are dropped."""
    w = stream.withWatermark("event_time", delay).groupBy(F.window("event_time", window), "task").agg(
        F.sum("cost_usd").alias("cost_usd"), F.count(F.lit(1)).alias("requests"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "task", "cost_usd", "requests")


def decontaminate_stream(stream: DataFrame, held: DataFrame, id_col: str) -> DataFrame:
    """Stream-static anti join as a left join to the static distinct ids + null test."""
    ids = held.select(F.col(id_col).alias("_held")).distinct()
    return stream.join(ids, F.col(id_col) == F.col("_held"), "left").filter(F.col("_held").isNull()).drop("_held")


STOP_SCHEMA = T.StructType([T.StructField("run", T.LongType()), T.StructField("best_epoch", T.LongType()),
                            T.StructField("best_val_mae", T.DoubleType()), T.StructField("steps_run", T.LongType())])


class EarlyStop(_Keyed):
    """Early stopping of a run. Epochs behind the watermark are folded in order to (best so far, steps since); only those ahead of it
    are held, in one state value that a call reads and writes once. The stop row comes once: when the fold has waited ``patience``
    steps, or when the run has been silent for ``silence_ms``, which also lets go of all its state."""

    def __init__(self, patience: int, silence_ms: int):
        self.patience, self.silence = patience, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.folded = handle.getValueState("folded", "best_epoch long, best_val double, last_epoch long, waited long, ended boolean")
        self.ahead = handle.getValueState("ahead", "epoch array<long>, val array<double>, at array<long>")

    def _held(self) -> dict[int, tuple[float | None, int]]:
        held = self.ahead.get()
        return {} if held is None else {e: (v, at) for e, v, at in zip(*held, strict=True)}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = list(rows)
        if key[0] is None:
            return
        f, ahead = self.folded.get(), self._held()
        for r in rows:  # a repeated epoch counts once; one that is folded already is let go
            if f is None or not f[4] and r["epoch"] > f[2]:
                ahead[r["epoch"]] = (r["val_mae"], r["_at"] // 1000)
        yield from self._settle(key[0], self.latest(rows), timerValues.getCurrentWatermarkInMs(), f, ahead)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        latest = self.clock.get()[0]
        self.clock.clear()  # this timer is gone
        yield from self._settle(key[0], latest, timerValues.getCurrentWatermarkInMs(), self.folded.get(), self._held())

    def _settle(self, run: int, latest: int, watermark: int, folded: tuple | None, ahead: dict) -> Iterator[Row]:
        f = list(folded) if folded is not None else [None, None, None, 0, False]
        epochs = sorted((e, *v) for e, v in ahead.items())
        done = 0
        while done < len(epochs) and epochs[done][2] < watermark and not f[4]:
            epoch, val, _ = epochs[done]
            done += 1
            if f[0] is None or val is not None and (f[1] is None or val < f[1]):  # strict improvement
                f[0], f[1], f[3] = epoch, val, 0
            else:
                f[3] += 1
            f[2], f[4] = epoch, f[3] >= self.patience
            if f[4]:
                yield Row(run=run, best_epoch=f[0], best_val_mae=f[1], steps_run=epoch)
        epochs = [] if f[4] else epochs[done:]
        if not epochs and watermark >= latest + self.silence:
            if not f[4] and f[0] is not None:
                yield Row(run=run, best_epoch=f[0], best_val_mae=f[1], steps_run=f[2])
            clock = self.clock.get()
            if clock is not None:
                self.handle.deleteTimer(clock[1])
            for state in (self.folded, self.ahead, self.clock):
                state.clear()
            return
        if f[2] is not None:
            self.folded.update(tuple(f))
        if epochs:
            self.ahead.update(tuple(list(c) for c in zip(*epochs, strict=True)))
        elif ahead or f[4]:
            self.ahead.clear()
        self.set_timer(latest, epochs[0][2] + 1 if epochs else latest + self.silence)


def early_stop_stream(stream: DataFrame, patience: int, delay: str, silence_ms: int) -> DataFrame:
    """T4: early stopping over (run, epoch, val_mae, event_time) rows in any order of files and batches, none later than ``delay``;
    a run's epochs follow event time. One row a run; a run that is silent for ``silence_ms`` beyond the watermark has ended."""
    s = stream.select("run", "epoch", "val_mae", "event_time").withWatermark("event_time", delay)
    return s.withColumn("_at", F.unix_micros("event_time")).groupBy("run").transformWithState(
        EarlyStop(patience, silence_ms), STOP_SCHEMA, "append", "EventTime")
