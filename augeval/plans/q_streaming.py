"""Registered plans: Structured Streaming over the response log and the epoch log.

Each plan writes the role table as JSON files in several batches, runs the stream to completion with
``trigger(availableNow=True)`` into a file sink, and returns the sink as a table; its batch twin is the oracle."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from augeval.operators.ledger import LOG_SCHEMA
from augeval.plans import roles
from augeval.plans.oracle_roles import with_roles
from augeval.plans.q_eval import _stop_sql
from augeval.plans.registry import query
from augeval.session import cut_lineage, scratch_path
from augeval.streaming import log_stream as ls

BATCHES = 4
FILES = 4           # files of an append; a trigger takes 8, so its files come from several appends
PER_TRIGGER = 8
LOG_COLS = [f.name for f in LOG_SCHEMA.fields]
HIST_SCHEMA = T.StructType([T.StructField("run", T.LongType()), T.StructField("epoch", T.LongType()),
                            T.StructField("val_mae", T.DoubleType()), T.StructField("ts", T.TimestampNTZType())])
DELAY = "15 days"   # rows of an append come in any order, so up to a fourth of the 30 days of the log may be out of order
DAY_MS = 86_400_000


def _log_stream(spark, sf, name):
    path, log = scratch_path(spark, name), roles.log(spark, sf, spread_rows=False).select(*LOG_COLS)
    ls.write_batches(log, path, "seq", BATCHES, FILES)
    ls.write_tick(log, path, "ts", "60 DAYS")
    return ls.read_stream(spark, path, files_per_trigger=PER_TRIGGER)


@query("stream_log_ingest", with_roles("SELECT custom_id, arg_min(seq, (ts, seq)) AS seq FROM log GROUP BY custom_id", "log"))
def q_stream_log_ingest(spark, sf):
    """The first row per id by event time, from eight files a trigger."""
    s = _log_stream(spark, sf, "t1-in").select("custom_id", "seq", "event_time")
    return ls.run_to_table(ls.ingest(s, DELAY, horizon_ms=40 * DAY_MS), spark, "t1").select("custom_id", "seq")


@query("stream_cost", with_roles("""
  SELECT strftime(ts, '%Y-%m-%d') AS day, task, sum(cost_usd) AS cost_usd, count(*) AS requests FROM log GROUP BY 1, 2
""", "log"))
def q_stream_cost(spark, sf):
    """Cost per task in daily tumbling windows, eight files a trigger, emitted when the watermark closes them (append mode)."""
    s = ls.cost_windows(_log_stream(spark, sf, "t2-in"), DELAY)
    return ls.run_to_table(s, spark, "t2")


@query("stream_decontaminate", with_roles("""
  SELECT custom_id, seq FROM log WHERE custom_id NOT IN (
    SELECT printf('req_%04d_%s', user_id, event_type) FROM events
    WHERE CAST(('0x' || substr(md5('7|' || printf('req_%04d_%s', user_id, event_type)), 1, 8)) AS BIGINT) / 4294967296.0 < 0.3)
""", "log"))
def q_stream_decontaminate(spark, sf):
    """Stream rows whose id is not held out (stream-static left join + null test)."""
    from augeval.plans.q_ledger import SAMPLE_SHARE, _planned
    from augeval.functions.keys import seeded_hash
    p = _planned(spark, sf)
    u = F.conv(F.substring(seeded_hash(7, "custom_id"), 1, 8), 16, 10).cast("double") / float(16 ** 8)
    held = p.filter(u < SAMPLE_SHARE).select("custom_id")
    s = _log_stream(spark, sf, "t3-in").where("custom_id is not null")
    s = ls.decontaminate_stream(s, held, "custom_id").select("custom_id", "seq")
    return ls.run_to_table(s, spark, "t3")


@query("stream_early_stop", with_roles("""
  SELECT run, CAST(best_epoch AS BIGINT) AS best_epoch, best_val_mae, CAST(steps_run AS BIGINT) AS steps_run FROM stop
""", "hist", extra=[("hx", "SELECT * FROM hist")] + _stop_sql("3", "run")))
def q_stream_early_stop(spark, sf):
    """T4: stateful early stopping over the epoch stream, eight files a trigger in any order; one row for every run."""
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts")
    h = roles.hist(spark, sf).join(ev, "event_id").select("run", F.col("epoch").cast("bigint").alias("epoch"), "val_mae", F.col("ts").cast("timestamp_ntz").alias("ts"))
    h = cut_lineage(h, "t4-hist")  # read by every append and the tick: numbered once
    path = scratch_path(spark, "t4-in")
    ls.write_batches(h.withColumn("_o", F.unix_micros(F.col("ts").cast("timestamp"))), path, "_o", BATCHES, FILES)
    ls.write_tick(h, path, "ts", "60 DAYS")
    s = ls.read_stream(spark, path, HIST_SCHEMA, files_per_trigger=PER_TRIGGER)
    return ls.run_to_table(ls.early_stop_stream(s, 3, DELAY, 40 * DAY_MS), spark, "t4")
