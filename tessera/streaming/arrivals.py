"""Streams whose input arrives in parts: each part is run to its end and the stream stopped, and the next run goes on from the state that was saved."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.sources.tables import table
from tessera.streaming import events


def in_parts(spark: SparkSession, sf_dir: str, parts: int = 3) -> list[DataFrame]:
    """The events in the order of their ids, which is that of time, cut into as many equal ranges."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    top = rows.agg(F.max("event_id")).first()[0]
    return [rows.filter(F.floor(F.col("event_id") * parts / F.lit((top or 0) + 1)) == k) for k in range(parts)]


def in_parts_of_time(spark: SparkSession, sf_dir: str, parts: int = 3) -> list[DataFrame]:
    """The events cut into as many equal spans of time, whatever the order of their ids: none is late."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.unix_micros("ts")
    first, last = rows.agg(F.min(at), F.max(at)).first()
    # whole numbers: a cut doesn't depend on rounding
    span = -(-((last or 0) - (first or 0) + 1) // parts)
    return [rows.filter((at >= F.lit((first or 0) + k * span)) & (at < F.lit((first or 0) + (k + 1) * span))) for k in range(parts)]


def run_in_parts(parts: list[DataFrame], build: Callable[[DataFrame], DataFrame], mode: str = "append") -> tuple[DataFrame, str]:
    """What the stream gives over all parts, and its checkpoint. Every run after the first starts from the checkpoint alone."""
    spark = parts[0].sparkSession
    source, sink, place = (events.scratch(spark, name) for name in ("arrivals", "sink", "stream"))
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = build(spark.readStream.schema(parts[0].schema).parquet(source))
        # a batch that is run again after a loss replaces its own folder
        running = stream.writeStream.outputMode(mode).option("checkpointLocation", place).trigger(availableNow=True).foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{sink}/batch={k}")).start()
        if not running.awaitTermination(events.TIMEOUT_S):
            running.stop()
            raise TimeoutError("the stream didn't end in time")
    return spark.read.schema(stream.schema).parquet(sink).select(*stream.columns), place


def larger(x: float | None, y: float | None) -> float | None:
    """The larger value; a missing one doesn't count, and what isn't a number is the largest, as in SQL."""
    if x is None or y is None:
        return y if x is None else x
    return x if x != x or x >= y else y


class Weeks(StatefulProcessor):
    """Of each user and week: count and largest value of each kind of event, told once the watermark has passed the week; then the state goes.

    The kinds are a map in the state store, so an event touches its own kind's
    entry alone. Events of a week that has passed are too late and don't count.
    Rows come as rows: a key has few in an arrival, too few for a frame of its own.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kinds = handle.getMapState("kinds", "event_type string", "n long, top double")

    @staticmethod
    def end_ms(week: datetime.date) -> int:
        after = datetime.datetime.combine(week + datetime.timedelta(days=7), datetime.time(), datetime.timezone.utc)
        return int(after.timestamp() * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        end = self.end_ms(key[1])
        if end <= timerValues.getCurrentWatermarkInMs():
            return
        came: dict[str, tuple[int, float | None]] = {}
        for row in rows:
            n, top = came.get(row.event_type, (0, None))
            came[row.event_type] = (n + 1, larger(top, row.value))
        # each call to the store is a round trip: the kinds that there are come in one
        there = {kind: of for (kind,), of in self.kinds.iterator()}
        if not there:
            self.handle.registerTimer(end)
        for kind, (n, top) in came.items():
            before, most = there.get(kind, (0, None))
            self.kinds.updateValue((kind,), (before + n, larger(most, top)))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        found = [Row(user_id=key[0], week=key[1], event_type=kind, n=n, top=top) for (kind,), (n, top) in self.kinds.iterator()]
        self.kinds.clear()
        yield from found

    def close(self) -> None:
        pass


def weekly(stream: DataFrame) -> DataFrame:
    rows = stream.withWatermark("ts", "10 minutes").select("user_id", F.date_trunc("week", "ts").cast("date").alias("week"), "event_type", "value", "ts")
    return rows.groupBy("user_id", "week").transformWithState(Weeks(), "user_id long, week date, event_type string, n long, top double", "append", "EventTime")


def weeks_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks of each user that have passed, from three arrivals: map state, event-time timers, expiry."""
    events.rocksdb(spark)
    return run_in_parts(in_parts_of_time(spark, sf_dir), weekly)[0]


def hours_across_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours counted over three arrivals, of which two end in the middle of one."""
    events.rocksdb(spark)
    counts = lambda stream: stream.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")
    return run_in_parts(in_parts_of_time(spark, sf_dir), counts)[0]


def totals_across_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of each user as they change, over three arrivals; the last of each."""
    events.rocksdb(spark)
    totals = lambda stream: stream.groupBy("user_id").transformWithStateInPandas(events.Totals(), "user_id long, n long", "update", "none")
    return run_in_parts(in_parts(spark, sf_dir), totals, "update")[0].groupBy("user_id").agg(F.max("n").alias("n"), F.count("*").alias("changes"))


QUERIES = {"stream_weeks_by_user": weeks_by_user, "stream_hours_across_parts": hours_across_parts, "stream_totals_across_parts": totals_across_parts}
ORACLES = {
    "stream_weeks_by_user": f"""
SELECT user_id, week::date AS week, event_type, count(*) AS n, max(value) AS top FROM (SELECT *, date_trunc('week', ts) AS week FROM events)
WHERE week + INTERVAL 7 DAY <= {events._passed} GROUP BY user_id, week, event_type""",
    "stream_hours_across_parts": events.ORACLES["stream_tumbling"],
    "stream_totals_across_parts": "SELECT user_id, count(*) AS n, count(DISTINCT event_id * 3 // (SELECT max(event_id) + 1 FROM events)) AS changes FROM events GROUP BY user_id",
}
