"""Streams over the events, run to their end: each query reads what has arrived, writes a sink in the shared folder and returns it.

``events.ts`` has no zone, which watermarks refuse, so it is cast; results are
cast back. In append mode the windows that the last watermark hasn't passed
stay open and aren't in the sink.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources.tables import table

TIMEOUT_S = 1800
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; it goes when the session ends."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="tessera-")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{top}/{name}-{uuid.uuid4().hex}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return place.toString()


def arriving(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The table as a stream, ``ts`` as a point in time."""
    schema = table(spark, sf_dir, name).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in schema.names else stream


def run_to_end(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Everything the stream has now, in a parquet sink; ``each`` takes batches instead, and writes them to the sink's folder itself."""
    spark = stream.sparkSession
    folder = scratch(spark, "sink")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True)
    if each is None:
        running = writer.format("parquet").start(folder)
    else:
        running = writer.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{folder}/batch={k}")).start()
    if not running.awaitTermination(TIMEOUT_S):
        running.stop()
        raise TimeoutError("the stream didn't end in time")
    return spark.read.schema(stream.schema).parquet(folder)


def rocksdb(spark: SparkSession) -> None:
    """State on the executors' disks instead of their heaps."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each hour, ten minutes' lateness allowed."""
    rocksdb(spark)
    counts = arriving(spark, sf_dir).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"))
    return run_to_end(counts.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n"))


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each hour, every half hour."""
    rocksdb(spark)
    counts = arriving(spark, sf_dir).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour", "30 minutes")).agg(F.count("*").alias("n"))
    return run_to_end(counts.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after half an hour without an event."""
    rocksdb(spark)
    found = arriving(spark, sf_dir).withWatermark("ts", "10 minutes").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return run_to_end(found.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n"))


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of user and kind of event once."""
    rocksdb(spark)
    return run_to_end(arriving(spark, sf_dir).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]))


def with_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases joined with the customers as they come."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return run_to_end(arriving(spark, sf_dir).filter("event_type = 'purchase'").select("event_id", "user_id").join(customers, "user_id"))


def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a user within ten minutes after a purchase, stream against stream."""
    rocksdb(spark)
    events = arriving(spark, sf_dir)
    bought = events.filter("event_type = 'purchase'").select(F.col("user_id").alias("buyer"), F.col("event_id").alias("purchase"), F.col("ts").alias("bought_at")).withWatermark("bought_at", "10 minutes")
    failed = events.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("error"), F.col("ts").alias("failed_at")).withWatermark("failed_at", "10 minutes")
    met = F.expr("buyer = user_id AND failed_at BETWEEN bought_at AND bought_at + INTERVAL 10 MINUTES")
    return run_to_end(bought.join(failed, met).select("purchase", "error"))


def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and dearest purchase of each user, kept as custom state; the last state that each user had."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, top = state.get if state.exists else (0, 0.0)
        for rows in batches:
            n += len(rows)
            top = max(top, float(rows["spent"].max()))
        state.update((n, top))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "top": [top]})

    rocksdb(spark)
    spent = F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)
    states = arriving(spark, sf_dir).select("user_id", spent.alias("spent")).groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, top double", "n long, top double", "update", GroupStateTimeout.NoTimeout)
    batches = run_to_end(states, "update", each=lambda batch, k: None)
    return batches.groupBy("user_id").agg(F.max("n").alias("n"), F.max("top").alias("top"))


def counted_in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete mode into the memory sink: events of each kind, of which there are few."""
    name = f"kinds_{uuid.uuid4().hex}"
    counts = arriving(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    running = counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start()
    if not running.awaitTermination(TIMEOUT_S):
        running.stop()
        raise TimeoutError("the stream didn't end in time")
    return spark.table(name)


def updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update mode: counts of sliding windows as they change; the last count of each."""
    rocksdb(spark)
    counts = arriving(spark, sf_dir).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour", "30 minutes")).agg(F.count("*").alias("n"))
    changes = run_to_end(counts.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n"), "update", each=lambda batch, k: None)
    return changes.groupBy("start").agg(F.max("n").alias("n"))


def deduplicated_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of user and kind of event once in forty days; the state of older ones goes."""
    rocksdb(spark)
    events = arriving(spark, sf_dir).withWatermark("ts", "40 days").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return run_to_end(events.select("user_id", "event_type"))


class Totals(StatefulProcessor):
    """Events of each user so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.n = handle.getValueState("n", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = (self.n.get()[0] if self.n.exists() else 0) + sum(map(len, rows))
        self.n.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

    def close(self) -> None:
        pass


def processor_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom state by a stateful processor; the last total of each user."""
    rocksdb(spark)
    totals = arriving(spark, sf_dir).select("user_id", "event_id").groupBy("user_id").transformWithStateInPandas(Totals(), "user_id long, n long", "update", "none")
    return run_to_end(totals, "update", each=lambda batch, k: None).groupBy("user_id").agg(F.max("n").alias("n"))


def state_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a finished stream keeps: its state store read as a table."""
    rocksdb(spark)
    counts = arriving(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    place = scratch(spark, "stream")
    running = counts.writeStream.outputMode("update").option("checkpointLocation", place).trigger(availableNow=True).format("noop").start()
    if not running.awaitTermination(TIMEOUT_S):
        running.stop()
        raise TimeoutError("the stream didn't end in time")
    return spark.read.format("statestore").load(place).select("key.user_id", F.col("value.count").alias("n"))


def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts where the first days come last, in the third of three batches: too late for an hour's watermark, so they aren't counted."""
    rocksdb(spark)
    folder = scratch(spark, "late")
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    for part in ("ts >= '2024-01-11' AND ts < '2024-01-21'", "ts >= '2024-01-21'", "ts < '2024-01-11'"):
        events.filter(part).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    counts = stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    return run_to_end(counts.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n"))


#: The watermark after the last event; what ends by then is in the sink.
_passed = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)"
QUERIES = {
    "stream_tumbling": tumbling,
    "stream_sliding": sliding,
    "stream_sessions": sessions,
    "stream_dedup": deduplicated,
    "stream_static_join": with_static,
    "stream_interval_join": interval_join,
    "stream_custom_state": running_totals,
    "stream_complete_memory": counted_in_memory,
    "stream_update": updated,
    "stream_dedup_within": deduplicated_within,
    "stream_processor": processor_totals,
    "stream_state_read": state_read,
    "stream_late_rows": late_rows,
}
ORACLES = {
    "stream_tumbling": f"SELECT start, n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1) WHERE start + INTERVAL 1 HOUR <= {_passed}",
    "stream_sliding": f"SELECT start, n FROM (SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY 1) WHERE start + INTERVAL 1 HOUR <= {_passed}",
    "stream_sessions": f"""
SELECT user_id, start, n FROM (
  SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s
  FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)) GROUP BY user_id, s
) WHERE last + INTERVAL 30 MINUTE <= {_passed}""",
    "stream_complete_memory": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "stream_update": "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY 1",
    "stream_dedup_within": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_processor": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id",
    "stream_state_read": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id",
    "stream_late_rows": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-11' GROUP BY 1 HAVING time_bucket(INTERVAL 1 DAY, max(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_static_join": "SELECT user_id, event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase'",
    "stream_interval_join": "SELECT p.event_id AS purchase, e.event_id AS error FROM events p JOIN events e ON p.user_id = e.user_id AND e.ts BETWEEN p.ts AND p.ts + INTERVAL 10 MINUTE WHERE p.event_type = 'purchase' AND e.event_type = 'error'",
    "stream_custom_state": "SELECT user_id, count(*) AS n, max(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS top FROM events GROUP BY user_id",
}
