"""The velocity stream against the batch operator, on shuffled and late input."""

import random

from pyspark.sql import functions as F

from stridelake.operators import sequence
from stridelake.streaming import series as streams

SCHEMA = "event_id long, ts timestamp, user_id long, value double"


def fed(spark, tmp_path, rows, per_file, name, **more):
    """All rows that the stream gives, of files of `per_file` rows in this order."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    source = tmp_path / name
    out, cp = str(source / "out"), str(source / "cp")
    frame = lambda part: spark.createDataFrame(part, "event_id long, s long, user_id long, value double").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "value")
    for i in range(0, len(rows), per_file):
        frame(rows[i : i + per_file]).coalesce(1).write.mode("append").parquet(str(source / "in"))
        # a run a file, which stops in between: state and watermark go on from the checkpoint
        stream = streams.streaming_velocity(streams.event_stream(spark, str(source / "in"), SCHEMA, 1), **more)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return [tuple(r) for r in spark.read.schema(streams.VELOCITY).parquet(out).collect()], frame


def test_velocity_of_shuffled_events_is_that_of_the_batch(spark, tmp_path):
    rng = random.Random(3)
    base = [(i, 1_700_000_000 + 600 * i + rng.randrange(500), i % 3, float(rng.randrange(100))) for i in range(60)]
    ties = [(100, base[10][1], base[10][2], 7.0), (101, base[10][1], base[10][2], 9.0), (102, base[40][1] + 1, 77, 5.0)]
    rows = sorted(base + ties, key=lambda r: r[1])
    # out of order by less than the delay of two hours
    rows.sort(key=lambda r: r[1] + rng.randrange(5000))
    ends = [(900, 1_800_000_000, 99, 0.0), (901, 1_900_000_000, 99, 1.0), (902, 1_900_000_001, 99, 2.0)]
    got, frame = fed(spark, tmp_path, rows + ends[:1] + ends[1:2] + ends[2:], 22, "shuffled", late="2 hours", idle_seconds=86_400)
    df = frame(rows).withColumn("frame_idx", F.struct("ts", "event_id"))
    want = {(r.user_id, r.event_id, r.velocity) for r in sequence.velocity(df, "user_id", "value").select("user_id", "event_id", "velocity").collect()}
    assert {r for r in got if r[0] != 99} == want and len([r for r in got if r[0] != 99]) == len(rows)


def test_late_events_are_dropped_and_idle_users_begin_anew(spark, tmp_path):
    day = 86_400
    rows = [(1, day, 1, 1.0), (2, 2 * day, 1, 4.0), (3, 20 * day, 2, 0.0)]
    rows += [(4, day + 5, 1, 100.0), (5, 30 * day, 2, 2.0), (6, 31 * day, 1, 50.0)]
    rows += [(7, 32 * day, 1, 51.0), (8, 60 * day, 2, 3.0), (9, 61 * day, 2, 3.0), (10, 90 * day, 3, 3.0), (11, 120 * day, 3, 3.0), (12, 121 * day, 3, 3.0)]
    got, _ = fed(spark, tmp_path, rows, 3, "late", late="1 day", idle_seconds=5 * day)
    user = sorted((e, v) for u, e, v in got if u == 1)
    assert user == [(1, 3.0), (2, 3.0), (6, 1.0), (7, 1.0)]
    assert sorted((e, v) for u, e, v in got if u == 2) == [(3, 0.0), (5, 0.0), (8, 0.0), (9, 0.0)]
