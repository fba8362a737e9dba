"""An extraction that is stopped anywhere, and random numbers fixed by keys."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridelake.functions.draws import gaussian
from stridelake.plans import catalog
from stridelake.sources import extraction


class Stopped(Exception):
    pass


@pytest.mark.parametrize("at", ["work", "rows", "manifest"])
def test_a_stopped_run_neither_loses_nor_doubles_keys(spark, tmp_path, monkeypatch, at):
    path = str(tmp_path / "x")
    found = spark.createDataFrame([(f"k{i}", i) for i in range(130)] + [(None, 1)], "key string, v int")
    calls = []

    def work(own):
        calls.append(1)
        if at == "work" and len(calls) == 2:
            raise Stopped
        return own.select("key", (F.col("v") * 2).alias("w"))

    assert extraction.extracted(spark, path) is None
    real = extraction._store
    if at != "work":
        # the second batch ends after its rows are written (rows), or after its manifest is, before the rename (manifest)
        def store(spark, p):
            if "/pending/" in p and len(calls) == 2 and at == "manifest" or p.endswith("/log") and len(calls) == 2 and at == "rows":
                raise Stopped
            return real(spark, p)

        monkeypatch.setattr(extraction, "_store", store)
    with pytest.raises(Stopped):
        extraction.extract(found, "key", work, path, batch=30)
    monkeypatch.setattr(extraction, "_store", real)
    part = extraction.extracted(spark, path).count()
    assert 0 < part < 130
    at = None
    assert extraction.extract(found, "key", work, path, batch=30) >= 1
    got = sorted((r.key, r.w) for r in extraction.extracted(spark, path).collect())
    assert got == sorted((f"k{i}", 2 * i) for i in range(130))
    assert extraction.extract(found, "key", work, path) == 0
    assert sorted(r.key for r in extraction.committed(spark, path).collect()) == sorted(f"k{i}" for i in range(130))


def test_a_run_of_bounded_batches(spark, tmp_path):
    path, found = str(tmp_path / "y"), spark.range(100).withColumnRenamed("id", "key")
    runs = 0
    while extraction.extract(found, "key", lambda own: own, path, batch=20, most=2):
        runs += 1
    assert runs >= 2 and extraction.extracted(spark, path).count() == 100


def test_no_batch_reads_the_table(spark, tmp_path, monkeypatch):
    """extraction_log: the events are out of the way from the first batch of a run to its last."""
    events, away = tmp_path / "events.parquet", tmp_path / "away"
    spark.range(600).selectExpr("id as event_id", "id % 60 as user_id", "id / 8 as value").write.parquet(str(events))
    calls, real = [], extraction.extract

    def extract(found, key, work, path, **how):
        def alone(own):
            calls.append(1)
            if events.exists():
                events.rename(away)
            return work(own)

        try:
            return real(found, key, alone, path, **how | {"batch": 20 if "batch" in how else 5})
        finally:
            away.rename(events)

    monkeypatch.setattr(extraction, "extract", extract)
    got = {r.user_id: (r.n, r.total) for r in catalog.extraction_log(spark, str(tmp_path)).collect()}
    assert len(calls) >= 3
    assert got == {u: (10, sum(range(u, 600, 60)) / 8) for u in range(60)}


def test_rows_are_dealt_to_their_batches(spark, tmp_path):
    """Keys with no row, with one and with most of all rows; keys of another integer type; rows of keys that are not to be done."""
    path, found = str(tmp_path / "z"), spark.range(40).selectExpr("cast(id as int) as key")
    rows = spark.range(60).selectExpr("id as key", "0 as v").where("key % 4 > 0").unionByName(spark.range(5_000).selectExpr("7L as key", "1 as v"))
    given = []

    def work(own):
        given.append(own.count())
        return own.groupBy("key").agg(F.count("*").alias("n"), F.sum("v").alias("v"))

    assert extraction.extract(found, "key", work, path, batch=8, most=1, rows=rows) == 1
    assert 0 < extraction.committed(spark, path).count() < 40
    extraction.extract(found, "key", work, path, batch=8, rows=rows, at_once=3)
    got = sorted((r.key, r.n, r.v) for r in extraction.extracted(spark, path).collect())
    assert got == [(k, 5_001, 5_000) if k == 7 else (k, 1, 0) for k in range(40) if k % 4]
    assert sum(given) == 30 + 5_000
    assert sorted(r.key for r in extraction.committed(spark, path).collect()) == list(range(40))
    assert extraction.extract(found, "key", work, path, rows=rows) == 0


def test_batches_side_by_side_stop_with_the_one_that_fails(spark, tmp_path):
    path, found = str(tmp_path / "s"), spark.range(200).withColumnRenamed("id", "key")
    calls = []

    def work(own):
        calls.append(1)
        if len(calls) >= 4:
            raise Stopped
        return own

    with pytest.raises(Stopped):
        extraction.extract(found, "key", work, path, batch=10, at_once=3)
    assert len(calls) <= 6
    assert 0 < extraction.extracted(spark, path).count() < 200
    extraction.extract(found, "key", lambda own: own, path, batch=10, at_once=3)
    assert sorted(r.key for r in extraction.extracted(spark, path).collect()) == list(range(200))


def test_gaussian_numbers(spark):
    rows = spark.range(20_000).select("id", gaussian(F.col("id"), "a").alias("g")).collect()
    g = np.array([r.g for r in rows])
    assert abs(g.mean()) < 0.03 and abs(g.std() - 1) < 0.02 and abs((g**3).mean()) < 0.1 and abs((g**4).mean() - 3) < 0.2
    for r in rows[:50]:
        digest = hashlib.md5(f"{r.id}|a".encode()).hexdigest()
        u, v = ((int(digest[8 * k : 8 * k + 8], 16) + 0.5) / 2**32 for k in range(2))
        assert abs(r.g - math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v)) < 1e-12
