"""Structured Streaming forms of the event queries.

A stream reads the ``events`` table (or a folder that files arrive in), keeps its state by key and appends to a Parquet
folder by batch. A batch that is run again overwrites its own folder, so that results hold after a restart. Steps are tumbling
windows of an hour of event time. Rows later than the watermark are dropped by Spark; a listener adds up their number from the
query's progress.
"""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_folder
from ..sources.events import event_rows
from . import correlator
from .sink import AlertSink

#: How late a row may come. A table that is read whole is not in order, so its span is allowed for.
LATE = "400 days"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a stream."""
    # a pattern: a stream takes a single file no other way
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/[e]vents.parquet")


class Dropped(StreamingQueryListener):
    """Adds up the rows that a query's stateful operators drop because they are late."""

    def __init__(self):
        self.rows, self.run_id, self.ended = 0, None, threading.Event()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        if self.run_id is None or str(event.progress.runId) == self.run_id:
            self.rows += sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if self.run_id is None or str(event.runId) == self.run_id:
            self.ended.set()


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """The state store that processors with several states and timers need, while a stream starts and runs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def run(stream: DataFrame, folder: str, mode: str = "append", put: Callable[[DataFrame, int], None] | None = None, state: str = "state") -> int:
    """Take all that is there, batch after batch; each writes its own folder, or what put does. Returns the number of late rows that were dropped."""

    def own(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/out/number={number}")

    spark, dropped = stream.sparkSession, Dropped()
    spark.streams.addListener(dropped)
    try:
        query = stream.writeStream.foreachBatch(put or own).outputMode(mode).option("checkpointLocation", f"{folder}/{state}").trigger(availableNow=True).start()
        dropped.run_id = str(query.runId)
        query.awaitTermination()
        # progress arrives behind the query, its end last
        dropped.ended.wait(60)
    finally:
        spark.streams.removeListener(dropped)
    return dropped.rows


def step_counts(events: DataFrame, late: str = LATE) -> DataFrame:
    """Per hour and type of event: count so far."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").count()
    return counts.select(F.floor((F.unix_micros("w.start") - 1704067200000000) / 3600000000).cast("long").alias("step"), "event_type", F.col("count").alias("n"))


def stream_step_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "step-counts")
    run(step_counts(read_events(spark, sf_dir)), folder, "update")
    return spark.read.parquet(f"{folder}/out").groupBy("step", "event_type").agg(F.max_by("n", "batch").alias("n"))


STREAM_STEP_COUNTS_SQL = """select cast(floor((epoch_us(ts) - 1704067200000000) / 3600000000) as bigint) as step, event_type, count(*) as n
    from events where ts is not null group by 1, 2"""


def count_gaps(key, frames, state: GroupState):
    """Of one actor: number of events, sum of values, first and last time, carried over batches."""
    n, total, first, last = state.get if state.exists else (0, 0, 0, 0)
    for pdf in frames:
        cents = (pdf["value"].fillna(0) * 100).round().astype("int64")
        n, total = n + len(pdf), total + int(cents.sum())
        us = pdf["us"].dropna().astype("int64")
        if len(us):
            first, last = (min(first or us.min(), us.min()), max(last, us.max()))
    state.update((int(n), int(total), int(first), int(last)))
    yield pd.DataFrame({"actor_id": [key[0]], "n": [n], "cents": [total], "first_us": [first], "last_us": [last]})


def actor_totals(events: DataFrame) -> DataFrame:
    """Per actor, running totals in keyed state; an actor's row comes again with every batch that has events of theirs."""
    rows = events.select(F.col("user_id").alias("actor_id"), "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.groupBy("actor_id").applyInPandasWithState(
        count_gaps, "actor_id long, n long, cents long, first_us long, last_us long", "n long, cents long, first_us long, last_us long", "update", GroupStateTimeout.NoTimeout)


def stream_actor_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "actor-totals")
    run(actor_totals(read_events(spark, sf_dir)), folder, "update")
    cols = ("n", "cents", "first_us", "last_us")
    return spark.read.parquet(f"{folder}/out").groupBy("actor_id").agg(*(F.max_by(c, "batch").alias(c) for c in cols))


STREAM_ACTOR_TOTALS_SQL = """select user_id as actor_id, count(*) as n, cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents,
    min(epoch_us(ts)) as first_us, max(epoch_us(ts)) as last_us from events group by 1"""


def adapted(stream: DataFrame, late: str = LATE) -> DataFrame:
    """Rows of ``events`` as activity events, each by itself, with a watermark on ``ts``: what the batch adapter makes of them."""
    spark = stream.sparkSession
    view = f"stream_{uuid.uuid4().hex}"
    stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).createOrReplaceTempView(view)
    return spark.sql("with " + event_rows("spark", view) + " select * from security_events")


def hour(ts: str = "ts"):
    """The step of a row: the tumbling window of an hour that it is in."""
    return F.floor((F.unix_micros(F.window(ts, "1 hour").start) - 1704067200000000) / 3600000000).cast("long")


def ingest(events: DataFrame) -> DataFrame:
    """Activity events with their step and monitor. An event that is delivered twice counts once; late ones are dropped."""
    source = F.when(F.col("event_type").isin("db_query", "data_export"), "db").when(F.col("event_type") == "email_send", "email").otherwise("auth")
    return events.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "actor_id", hour().alias("step"), "event_type", source.alias("source"), "label")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its hour and the monitor that it goes through, appended batch by batch; the first file is delivered twice."""
    folder = shared_folder(spark, "ingest")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    for part in (rows, rows.filter("event_id % 7 = 0")):
        part.write.mode("append").parquet(f"{folder}/in")
    run(ingest(adapted(arriving(spark, f"{folder}/in", rows.schema))), folder)
    return spark.read.parquet(f"{folder}/out").select("event_id", "actor_id", "step", "source", "label")


def arriving(spark: SparkSession, folder: str, schema, files: int = 1_000_000) -> DataFrame:
    """The files of a folder as a stream, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


#: One row in so many comes late in the query below, and how late a row may come there.
LATE_ROWS, SHORT = 50, "1 hour"


def stream_late_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts where some rows come in a second batch: those that the watermark has passed are left out, and counted as ``dropped`` (step -1)."""
    folder = shared_folder(spark, "late")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").filter("ts is not null")
    late, lost = F.col("event_id") % LATE_ROWS == 0, 0
    for part in (rows.filter(~late), rows.filter(late)):
        # a run after each part: what is there is taken, and the watermark stays in the checkpoint
        part.write.mode("append").parquet(f"{folder}/in")
        lost += run(ingest(adapted(arriving(spark, f"{folder}/in", rows.schema), SHORT)), folder)
    counts = spark.read.parquet(f"{folder}/out").groupBy("step", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(spark.createDataFrame([(-1, "dropped", lost)], "step long, event_type string, n long"))


STREAM_LATE_DATA_SQL = f"""with r as (select *, event_id % {LATE_ROWS} = 0 as late, case event_type when 'signup' then 'login' when 'purchase' then 'data_export' when 'error' then 'email_send' else 'db_query' end as kind from events where ts is not null),
    mark as (select (epoch_us(max(ts)) // 1000 - 3600000) * 1000 as passed from r where not late)
    select cast(floor((epoch_us(date_trunc('hour', ts)) - 1704067200000000) / 3600000000) as bigint) as step, kind as event_type, count(*) as n from r, mark where not late or epoch_us(ts) > passed group by 1, 2
    union all select -1, 'dropped', count(*) from r, mark where late and epoch_us(ts) <= passed"""

#: Days of events that come together in the streams below, and how late a row may come there.
TOGETHER, BEHIND = 8, "20 days"


def delivered(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The events as a stream of several batches that are out of order, and a last row that moves the watermark past all of them."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").filter("ts is not null")
    part = F.floor(F.datediff(F.col("ts"), F.lit("2024-01-01")) / TOGETHER).cast("int")
    first, last = rows.agg(F.min(part), F.max(part)).first()
    parts = [] if first is None else list(range(first, last + 1))
    # every second part comes before the one that it follows
    for a in range(0, len(parts) - 1, 2):
        parts[a], parts[a + 1] = parts[a + 1], parts[a]
    for p in parts:
        rows.filter(part == p).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    end = rows.agg(F.max("ts").alias("ts")).filter("ts is not null").select(F.lit(-1).cast("long").alias("event_id"), F.expr("ts + interval 100 days").alias("ts"))
    end.coalesce(1).select(*(F.col(c) if c in end.columns else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes)).write.mode("append").parquet(f"{folder}/in")
    return arriving(spark, f"{folder}/in", rows.schema, 1)


def stream_correlate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early and confirmed alerts of the first variant from a stream whose batches are out of order."""
    folder = shared_folder(spark, "correlate")
    with keyed_state(spark):
        run(correlator.alerts(adapted(delivered(spark, sf_dir, folder), BEHIND)), folder)
    return spark.read.schema(f"{correlator.SCHEMA}, batch long").parquet(f"{folder}/out").select("event_id", "actor_id", "step", "tier", "label", "score", "threshold", "trust")


def stream_alert_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts by tier in a keyed sink, after the whole stream has been taken twice, by two queries."""
    folder = shared_folder(spark, "alert-sink")
    source = delivered(spark, sf_dir, folder)
    with keyed_state(spark):
        for name in ("first", "second"):
            run(correlator.alerts(adapted(source, BEHIND)), folder, put=AlertSink(folder, name).put, state=f"state-{name}")
    return AlertSink(folder, "").rows(spark, correlator.SCHEMA).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("actor_id", "step").alias("distinct_alerts"))


QUERIES = {f.__name__: f for f in (stream_step_counts, stream_actor_totals, stream_ingest, stream_late_data, stream_correlate, stream_alert_sink)}
ORACLE_SQL = {"stream_step_counts": STREAM_STEP_COUNTS_SQL, "stream_actor_totals": STREAM_ACTOR_TOTALS_SQL, "stream_late_data": STREAM_LATE_DATA_SQL}
