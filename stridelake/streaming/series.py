"""Streaming forms: windowed means with late data dropped by watermark, and per-user velocity with timers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, schema: str = EVENT, files: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def windowed_means(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """start, event_type, n, mean by tumbling windows."""
    g = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """user_id, start, end, n by sessions that end after a gap."""
    g = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VELOCITY = "user_id long, event_id long, velocity double"


def streaming_velocity(events: DataFrame, late: str = "1 day", idle_seconds: int = 30 * 86_400) -> DataFrame:
    """VELOCITY of events (ts, user_id, event_id, value): the batch operator's forward difference, whatever order they come in.

    An event waits in its user's state until the watermark has passed it, so that all before it have come or are too late. It is
    given out when the next one of its user has, with the difference to that one. An event that no other follows within
    `idle_seconds` is given out once the watermark is as much further, with the difference to the one before (0 if it is alone),
    and the state is gone; a later event of its user begins anew. So a user's state holds the events of one delay and one more; events that are later than
    `late` are dropped, as by every watermark. Needs the RocksDB state store (set for the session where none is chosen).
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    spark, idle = events.sparkSession, idle_seconds * 1000
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key, ""):
        spark.conf.set(key, ROCKSDB)

    class Velocity(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.waiting = handle.getListState("waiting", "us long, event_id long, value double")
            #: The last event that the watermark has passed, and the value before it.
            self.last = handle.getValueState("last", "us long, event_id long, value double, before double")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            for part in rows:
                us = part["ts"].astype("int64")
                us = us // 1000 if part["ts"].dt.unit == "ns" else us
                self.waiting.appendList(list(zip(us.tolist(), part["event_id"].tolist(), part["value"].astype(float).tolist())))
                for ms in (us // 1000 + 1).unique().tolist():
                    self.handle.registerTimer(int(ms))
            yield pd.DataFrame({"user_id": pd.Series(dtype="int64"), "event_id": pd.Series(dtype="int64"), "velocity": pd.Series(dtype="float64")})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd

            now, out = timerValues.getCurrentWatermarkInMs(), []
            rows = sorted(tuple(x) for x in self.waiting.get())
            passed = [r for r in rows if r[0] // 1000 < now]
            last = self.last.get() if self.last.exists() else None

            def end():
                out.append((key[0], last[1], 0.0 if last[3] is None else last[2] - last[3]))

            for us, event_id, value in passed:
                before = None
                if last is not None and (us - last[0]) // 1000 > idle:
                    end()
                elif last is not None:
                    out.append((key[0], last[1], value - last[2]))
                    before = last[2]
                last = (us, event_id, value, before)
            if passed:
                self.waiting.put(rows[len(passed) :]) if len(rows) > len(passed) else self.waiting.clear()
            if last is not None and now - last[0] // 1000 > idle + 1:  # all that may come is further away
                end()
                self.last.clear()
            elif passed:
                self.last.update(last)
                self.handle.registerTimer(last[0] // 1000 + idle + 2)
            yield pd.DataFrame(out, columns=["user_id", "event_id", "velocity"]).astype({"user_id": "int64", "event_id": "int64", "velocity": "float64"})

        def close(self):
            pass

    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_id", "value").withWatermark("ts", late)
    return timed.groupBy("user_id").transformWithStateInPandas(Velocity(), VELOCITY, "Append", "EventTime")


def resume_into(stream: DataFrame, path: str, checkpoint: str):
    """Append what is new since the last call and stop: an incremental extraction."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
