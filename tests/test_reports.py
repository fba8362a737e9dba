"""Frames for faces, videos by identity, and tables of text, on small cases."""

import pytest
from pyspark.sql import functions as F

from stridelake.operators import metrics, sequence, summary
from stridelake.sources import files


def test_best_frame_is_sampled_and_the_middle_one_stands_in(spark):
    areas = {"far": [9.0 if i == 0 else float(i == 50) for i in range(100)], "tie": [1.0] * 40, "none": [None] * 7 + [0.0] * 8, "short": [1.0] * 9}
    rows = [(v, i, a) for v, own in areas.items() for i, a in enumerate(own)]
    df = spark.createDataFrame(rows, "video_id string, frame_idx int, a double").repartition(5)
    got = {r.video_id: (r.frame_idx, r.area) for r in sequence.best_frames(df, "video_id", F.col("a")).collect()}
    places = sorted({min(99, int(10 + i * 80 / 19)) for i in range(20)})
    best = max(places, key=lambda i: (areas["far"][i], -i))
    expected = (best, areas["far"][best]) if areas["far"][best] else (50, None)
    assert got == {"far": expected, "tie": (4, 1.0), "none": (7, None)}
    assert sequence.best_frames(df.where("false"), "video_id", F.col("a")).count() == 0


def test_videos_of_all_roots_by_identity(spark, tmp_path):
    for p in ("a/P1/x.mp4", "a/P1/deep/y.AVI", "b/P1/z.webm", "b/P2/n.txt", "b/P2/w.mov"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    with pytest.warns(UserWarning, match="missing"):
        got = files.videos_by_identity(spark, [str(tmp_path / r) for r in ("a", "b", "missing", "a")])
    rows = {r.identity: ([p.rsplit("/", 1)[1] for p in r.paths], r.videos) for r in got.collect()}
    assert rows == {"P1": (["x.mp4", "z.webm"], 2), "P2": (["w.mov"], 1), "deep": (["y.AVI"], 1)}
    with pytest.warns(UserWarning):
        assert files.videos_by_identity(spark, [str(tmp_path / "missing")]).count() == 0


FOLDS = "person string, accuracy double, n long"


def lines(df, *order):
    return [r.line for r in df.orderBy(*order).collect()]


def test_tables_of_text(spark):
    folds = spark.createDataFrame([("ann", 0.875, 8), ("bo", 0.625, 12)], FOLDS)
    want = [f"{name:<12} {value:>10} {n:>5}" for name, value, n in (("ann", "87.50%", 8), ("bo", "62.50%", 12), ("MEAN", "75.00%", ""), ("STD", "12.50%", ""))]
    assert lines(summary.fold_table(folds, "person", ["accuracy"], "n"), "part", "name") == want
    table = lines(summary.overall_table(folds, {"accuracy": "Accuracy (%)"}), "place")
    assert [x.split() for x in table] == [["Accuracy", "(%)", "75.00", "±", "12.50"], ["Number", "of", "Folds", "2", "—"]]
    c = spark.createDataFrame([(3, 1, 4, 0)], "tp long, fp long, tn long, fn long")
    assert [x.split()[-2:] for x in lines(summary.outcome_table(c, {"tp": "TP", "fn": "FN"}), "place")] == [["3", "37.5%"], ["0", "0.0%"], ["8", "100.0%"]]
    none = c.select(*[F.lit(0).cast("long").alias(k) for k in c.columns])
    assert [x.split()[-1] for x in lines(summary.outcome_table(none, {"tp": "TP"}), "place")] == ["0.0%", "100.0%"]
    v = spark.createDataFrame([("full", 234, 0.5)], "variant string, inputs int, accuracy double")
    assert lines(summary.variant_table(v, "variant", "inputs", ["accuracy"]), "name") == [f"{'full':<25} {234:>8} {'50.00%':>8}"]
    assert lines(summary.importance_table(v, "variant", "accuracy", True), "name") == [f"{'full':<20} {'50.0%':>12}"]


def test_bars_are_in_order(spark):
    rows = spark.createDataFrame([("a", 0.7), ("b", 0.95), ("c", 0.7), ("d", 0.2)], "name string, value double")
    got = [tuple(r) for r in summary.bars(rows, "name", "value").orderBy("place").select("name", "place", "band").collect()]
    assert got == [("b", 1, "high"), ("a", 2, "middle"), ("c", 3, "middle"), ("d", 4, "low")]


def test_curves_do_not_depend_on_the_number_of_ranges(spark):
    rows = spark.createDataFrame([(i % 3 == 0, (i * 37 % 101) / 100) for i in range(700)], "y boolean, score double").select(F.col("y").cast("int").alias("label"), "score")
    curve = lambda k: sorted(tuple(map(str, r)) for r in metrics.running_totals(rows, ranges=k).collect())
    assert curve(2) == curve(64) == curve(300)
