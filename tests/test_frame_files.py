"""Frames of files by batch and stream, and checks taken while a table is written."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridelake.sources import frame_files, run_log


@pytest.fixture
def root(spark, tmp_path):
    frame_files.register(spark)
    r = np.random.default_rng(7)
    for k in range(6):
        folder = tmp_path / "in" / f"P{k % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        a = r.normal(size=(4 + k, 5, 3))
        a[1] = np.nan
        np.save(folder / f"v{k}.npy", a)
    (tmp_path / "in" / "P0" / "bad.npy").write_bytes(b"no array")
    np.save(tmp_path / "in" / "P1" / "flat.npy", np.zeros(3))
    (tmp_path / "in" / "P1" / "notes.txt").write_text("not a video")
    return tmp_path / "in"


def frames(spark, root, **options):
    return spark.read.format("frame_files").options(path=str(root), **options)


def test_every_frame_of_every_file(spark, root):
    rows = frames(spark, root, partition_bytes=700).load().collect()
    good = [r for r in rows if r.error is None]
    assert {(r.identity, r.video_id, r.frame_idx) for r in good} == {(f"P{k % 3}", f"v{k}", i) for k in range(6) for i in range(4 + k)}
    for r in good:
        a = np.load(r.path)[r.frame_idx]
        assert r.lm is None if r.frame_idx == 1 else np.array_equal(np.array([list(p) for p in r.lm]), a)
    assert sorted((r.video_id, r.frame_idx, r.lm) for r in rows if r.error) == [("bad", None, None), ("flat", None, None)]


def test_only_files_of_the_wanted_names_are_opened(spark, root):
    for k in (0, 1):  # these would fail if they were opened
        os.remove(root / f"P{k}" / f"v{k}.npy")
        os.symlink(root / "P0" / "bad.npy", root / f"P{k}" / f"v{k}.npy")
    names = lambda **options: {(r.identity, r.video_id) for r in frames(spark, root, **options).load().where("error is null").collect()}
    everything = {("P0", "v3"), ("P1", "v4"), ("P2", "v2"), ("P2", "v5")}
    assert names() == everything
    assert names(identities="P2, P1") == everything - {("P0", "v3")}
    assert names(identities="P2", videos="v[5-9]") == {("P2", "v5")}
    assert frames(spark, root, identities="P2").load().where("error is not null").count() == 0
    assert frames(spark, root, videos="nothing*").load().count() == 0


def test_a_condition_leaves_later_queries_alone(spark, root):
    df = frames(spark, root).load()
    n = df.count()
    assert df.where("identity = 'P2' and frame_idx < 2").count() == 4
    assert df.where("identity = 'nobody'").count() == 0
    assert df.where("video_id <> 'v5'").count() == n - 9
    assert df.count() == n


def test_a_stated_schema_prunes_columns(spark, root):
    df = frames(spark, root).schema("frame_idx int, video_id string").load()
    assert df.columns == ["frame_idx", "video_id"]
    assert df.where("frame_idx is not null").count() == sum(4 + k for k in range(6))


def test_a_missing_root_fails_and_an_empty_one_has_no_rows(spark, root, tmp_path):
    (tmp_path / "none").mkdir()
    assert frames(spark, tmp_path / "none").load().count() == 0
    with pytest.raises(Exception, match="No such file"):
        frames(spark, tmp_path / "missing").load().count()


def test_a_stream_gives_the_batch_rows_once_and_goes_on(spark, root, tmp_path):
    def run():
        df = spark.readStream.format("frame_files").options(path=str(root), settle_seconds="0").load()
        q = df.writeStream.format("parquet").options(path=str(tmp_path / "out"), checkpointLocation=str(tmp_path / "at")).trigger(availableNow=True).start()
        q.awaitTermination()

    key = lambda df: sorted((r.path, -1 if r.frame_idx is None else r.frame_idx, str(r.lm)) for r in df.collect())
    run()
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(frames(spark, root).load())
    np.save(root / "P2" / "late.npy", np.ones((3, 5, 3)))
    run()
    run()
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(frames(spark, root).load())


def sequences(spark, gone=(), twice=(), hole=None):
    rows = [(f"v{v}", i, [float(v), None if (v, i) == hole else 1.0]) for v in range(3) for i in range(4) if (v, i) not in gone]
    return spark.createDataFrame(rows + [(f"v{v}", i, [0.0, 0.0]) for v, i in twice], "video_id string, frame_idx int, feat array<double>")


def test_checks_are_taken_while_a_table_is_written(spark, tmp_path):
    def summary(df, name):
        seen = run_log.write_checked(df, str(tmp_path / name), run_log.frame_checks("video_id", "feat", 4, 2))
        assert spark.read.parquet(str(tmp_path / name)).count() == df.count() == seen["rows"]
        return run_log.frame_summary(seen, 4)

    good = {"rows": 12, "nulls": 0, "other_sizes": 0, "null_numbers": 0, "videos": 3, "last": 3, "complete": 1}
    assert summary(sequences(spark), "whole") == good
    assert summary(sequences(spark, hole=(1, 2)), "hole") == good | {"null_numbers": 1}
    # as many rows at each place, but of other videos
    assert summary(sequences(spark, gone=[(0, 0), (1, 1), (2, 2), (0, 3)]), "apart") == good | {"rows": 8, "videos": 2, "complete": 0}
    assert summary(sequences(spark, gone=[(0, 0)], twice=[(1, 0)]), "twice") == good | {"complete": 0}
    assert summary(sequences(spark).where("false"), "none") == {k: 0 for k in good} | {"last": None, "complete": 1}


def test_scalars_are_kept_by_run_and_epoch(spark, tmp_path):
    log = str(tmp_path / "log")
    run_log.append_scalars(spark, log, "a", 1, {"loss": 0.5, "rate": None})
    run_log.append_scalars(spark, log, "a", 2, {"loss": 0.25})
    assert sorted(map(tuple, spark.read.parquet(log).select("run", "epoch", "name", "value").collect())) == [("a", 1, "loss", 0.5), ("a", 1, "rate", None), ("a", 2, "loss", 0.25)]
    wide = spark.createDataFrame([("b", 3, 1.5, None)], "r string, e int, x double, y double")
    long = run_log.scalars(wide, "r", "e", {"x": "X", "y": "Y"})
    assert long.schema.simpleString() == spark.createDataFrame([], run_log.SCALARS).schema.simpleString()
    assert sorted(map(tuple, long.collect()), key=lambda r: r[2]) == [("b", 3, "X", 1.5), ("b", 3, "Y", None)]
    assert long.where(F.col("value").isNull()).count() == 1
