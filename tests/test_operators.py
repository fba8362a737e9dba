"""Edge cases with known results, and operators that SQL does not express."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stridelake.functions import geometry, names
from stridelake.operators import augment, enroll, head, history, lookup, metrics, preserve, sequence, summary, train
from stridelake.sources import files, run_log
from stridelake.streaming import series as streams

SF = "/root/testdata/sf0.001"


def seq(spark, values, key="k"):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(values)], "k string, frame_idx int, v double")


def column(df, c, order="frame_idx"):
    return [r[c] for r in df.orderBy(order).collect()]


@pytest.mark.parametrize("values,v,a", [([1, 4, 9, 16], [3, 5, 7, 7], [2, 2, 0, 0]), ([5], [0], [0]), ([1, 3], [2, 2], [0, 0])])
def test_derivatives(spark, values, v, a):
    assert column(sequence.velocity(seq(spark, values), "k", "v"), "velocity") == v
    assert column(sequence.acceleration(seq(spark, values), "k", "v"), "acceleration") == a


@pytest.mark.parametrize("n", [1, 2, 3, 10, 59, 60, 61, 150])
def test_resampling_is_linear_interpolation(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    got = column(sequence.resample(seq(spark, x), "k", "v"), "v", "i")
    assert len(got) == 60 and np.allclose(got, np.interp(np.linspace(0, n - 1, 60), np.arange(n), x))
    for k in (1, 5, 20):
        picked = column(sequence.sample_uniform(seq(spark, x), "k", k), "v", "i") if k > 1 else None
        if picked:
            assert picked == [x[i * (n - 1) // (k - 1)] for i in range(k)]
    assert column(sequence.tile(seq(spark, x), "k"), "v", "i") == [x[i % n] for i in range(60)]
    assert column(sequence.edge_pad(seq(spark, x), "k"), "v", "i") == [x[min(i, n - 1)] for i in range(60)]
    assert column(sequence.reverse(seq(spark, x), "k"), "v") == x[::-1].tolist()
    count = max(1, int(n / 0.8))
    places = [round(i * (n - 1) / (count - 1)) if count > 1 else 0 for i in range(count)]
    assert column(sequence.change_speed(seq(spark, x), "k", 0.8), "v", "i") == [x[p] for p in places]


def test_resample_to_five(spark):
    assert column(sequence.resample(seq(spark, [0, 10]), "k", "v", 5), "v", "i") == [0, 2.5, 5, 7.5, 10]


@pytest.mark.parametrize("n,kept", [(9, 0), (10, 10)])
def test_videos_need_ten_poses(spark, n, kept):
    df = seq(spark, range(n + 3)).withColumn("lm", F.when(F.col("frame_idx") < n, F.array(F.lit(1.0))))
    assert sequence.valid_videos(df, "k").count() == kept


def test_angles(spark):
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    r = spark.range(1).select(geometry.joint_angle(p(0, 1), p(0, 0), p(1, 0)).alias("a"), geometry.joint_angle(p(0, 0), p(0, 0), p(1, 0)).alias("b")).first()
    assert r.a == pytest.approx(90, abs=1e-6) and r.b == pytest.approx(90)


def test_constant_step_width_fails_without_error(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(preserve.correlation("a", "b").alias("r")).first().r is None


def test_feature_stats_floor(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, 4.0],)], "v array<double>")
    got = {r.dim: (r["mean"], r["std"]) for r in enroll.feature_stats(df, "v", 2).collect()}
    assert got == {0: (1.0, 1.0), 1: (3.0, pytest.approx(2**0.5))}


#: label, predicted, score: 2 of 3 positives found, 1 of 4 negatives taken for one.
JUDGED = [(1, 1, 0.75), (0, 0, 0.25), (0, 1, 0.625), (1, 0, 0.375), (0, 0, 0.125), (1, 1, 0.875), (0, 0, 0.375)]


def test_known_metrics(spark):
    df = spark.createDataFrame([(y, float(p), s) for y, p, s in JUDGED], "label int, p double, score double")
    c = metrics.counts(df, F.col("p") > 0).first()
    assert (c.tn, c.fp, c.fn, c.tp) == (3, 1, 1, 2)
    # of 12 pairs, 0.75 and 0.875 win all 8; 0.375 wins over 0.125 and 0.25, ties with 0.375 and loses to 0.625
    assert metrics.roc_auc(df).first().auc == pytest.approx(10.5 / 12)


def test_curves_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    y, s = rng.integers(0, 2, 500), np.round(rng.normal(size=500), 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None]))
    assert metrics.roc_auc(df).first().auc == pytest.approx(auc)
    t = {r.score: (r.tp, r.fp) for r in metrics.running_totals(df, ranges=7).collect()}
    assert t == {v: (int((pos >= v).sum()), int((neg >= v).sum())) for v in set(s)}
    best = max((np.mean(pos >= v) - np.mean(neg >= v), v) for v in set(s))
    got = metrics.youden(df).first()
    assert got.j == pytest.approx(best[0]) and got.threshold == best[1]
    e = metrics.eer(df, drop_collinear=False).first()
    assert e.eer == pytest.approx(min((abs(np.mean(neg >= v) - np.mean(pos < v)), (np.mean(neg >= v) + np.mean(pos < v)) / 2) for v in set(s))[1])


def test_one_class(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.6)], "label int, score double")
    assert metrics.roc_auc(df).first().auc == 0.0
    assert tuple(metrics.eer(df).first()) == (0.0, 0.5)
    none = metrics.rates(metrics.counts(df, F.col("score") > 1)).first()
    assert (none.precision, none.f1) == (0.0, 0.0)


def test_verdicts(spark):
    rows = [(0.8, "a", "a", 0.8, "AUTHENTIC"), (0.7737, "a", "a", 0.7737, "SUSPECTED_FAKE"), (0.9, "b", "a", 0.1, "IDENTITY_MISMATCH"), (0.5, "b", "a", 0.1, "SUSPECTED_FAKE")]
    df = spark.createDataFrame(rows, "best double, id string, claim string, own double, want string")
    got = df.select(geometry.verdict(F.col("best"), F.col("id"), F.col("claim"), F.col("own")).alias("v"), "want").collect()
    assert all(r.v == r.want for r in got)


def test_unenrolled_claim_is_an_error(spark):
    claims, people = spark.createDataFrame([("x",)], "claimed_identity string"), spark.createDataFrame([("a",)], "identity string")
    with pytest.raises(KeyError, match="x is not enrolled"):
        enroll.require_enrolled(claims, people)


def test_names(spark):
    rows = {"Ingrid_F1": ("Ingrid", "Ingrid"), "Ingrid_F_hflip": ("Ingrid", "Ingrid_F"), "Ingrid_F1_dark_up": ("Ingrid", "Ingrid_F1_dark"), "X_Y_F1": ("X", "X_Y"), "Lone": ("Lone", "Lone")}
    df = spark.createDataFrame([(k,) for k in rows], "n string")
    got = {r.n: (r.a, r.b) for r in df.select("n", names.identity_a(F.col("n")).alias("a"), names.identity_b(F.col("n")).alias("b")).collect()}
    assert got == rows
    assert spark.range(1).select(names.stem(F.lit("/x/y/Ann_F1.front.mp4")).alias("s")).first().s == "Ann_F1.front"


def test_history(spark):
    h = spark.createDataFrame([("r", e, v) for e, v in enumerate([1.0, 2.0, 2.0, 2.0, 3.0], 1)], "run string, epoch int, v double")
    assert history.early_stop(h, "v", 2).first().stop_epoch == 4
    assert column(history.plateau_rates(h, "v", 1.0, 1), "lr", "epoch") == [1, 1, 1, 0.5, 0.5]
    assert column(history.best_so_far(h, "v"), "is_best", "epoch") == [True, True, False, False, True]


def test_head_by_loops():
    w = head.initial_weights(1, hidden=4, dims=2)
    assert head.trainable(head.initial_weights()) == 133_058
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 1, 6, 2))
    x = np.concatenate([a - b, abs(a - b), a * b], axis=2)[0]
    for i in range(3):
        c = w[f"conv{i}"]
        k = c.shape[2] // 2
        y = np.zeros((len(x), c.shape[0]))
        for t in range(len(x)):
            for d in range(-k, k + 1):
                if 0 <= t + d < len(x):
                    y[t] += c[:, :, d + k] @ x[t + d]
        x = np.maximum(y / np.sqrt(1 + 1e-5), 0)
    z = np.maximum(w["dense0"] @ x.mean(axis=0), 0)
    assert np.allclose(head.forward(w, a, b)[0], w["dense1"] @ z)


def test_training_learns(spark):
    rng = np.random.default_rng(3)
    rows = [(str(i), "p", "q", int(y), [float(y + rng.normal(0, 0.3)), float(rng.normal())]) for i, y in enumerate(rng.integers(0, 2, 80))]
    df = spark.createDataFrame(rows, "key string, true_identity string, claimed_identity string, label int, x array<double>")
    model = train.fit(df)
    assert metrics.roc_auc(train.score(model, df)).first().auc > 0.9
    for r in df.join(train.score(model, df).select("key", "score"), "key").collect():
        assert r.score == pytest.approx(model.predictProbability(Vectors.dense(r.x))[1])


def test_a_fit_can_be_scored_after_a_checked_write(spark, tmp_path):
    rows = [(str(i), "p", "q", i % 2, [float(i % 2), float(i)]) for i in range(20)]
    df = spark.createDataFrame(rows, "key string, true_identity string, claimed_identity string, label int, x array<double>")
    assert run_log.write_checked(df, str(tmp_path / "t"), {"rows": F.count(F.lit(1))}) == {"rows": 20}
    assert train.score(train.fit(df), df).where("score is not null").count() == 20


def test_flip_twice_is_nothing(spark):
    lm = F.array(*[F.struct(F.lit(0.1 * j).alias("x"), F.lit(0.2).alias("y"), F.lit(0.3).alias("z")) for j in range(12)])
    r = spark.range(1).select(lm.alias("a")).select("a", augment.hflip(F.col("a")).alias("b")).select("a", augment.hflip(F.col("b")).alias("c"), augment.rotate(F.col("a"), 0).alias("d")).first()
    assert [round(p.x, 9) for p in r.a] == [round(p.x, 9) for p in r.c] == [round(p.x, 9) for p in r.d]


def test_files(spark, tmp_path):
    for name in ("a/x.MP4", "a/b/y.avi", "z.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"ok" if "x" in name else b"bad")
    found = files.video_files(spark, str(tmp_path), content=True)
    assert {p.path.rsplit("/")[-1] for p in found.collect()} == {"x.MP4", "y.avi"}

    def decoder(path, content):
        if content != b"ok":
            raise ValueError("no video")
        return [{"frame": 0}, {"frame": 1}]

    rows = files.decoded_frames(found, decoder, "path string, frame double, error string").collect()
    assert sorted((r.error or "") for r in rows) == ["", "", "no video"]
    w = {"a": np.arange(6.0).reshape(2, 3)}
    files.save_model(spark, w, spark.range(1), str(tmp_path / "m"))
    assert (files.load_model(spark, str(tmp_path / "m"))[0]["a"] == w["a"]).all()


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(str(source))
    batch = spark.read.parquet(str(source))
    schema = batch.schema.simpleString().removeprefix("struct<").removesuffix(">")
    stream = streams.event_stream(spark, str(source), batch.schema)
    assert schema and stream.isStreaming
    streams.resume_into(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    streams.resume_into(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()
    query = streams.windowed_means(stream, "1 day", "400 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == batch.count()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_verdicts_of_claims(spark):
    from stridelake.operators import verify

    sig = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "identity string, sig array<double>")
    claims = spark.createDataFrame([(1, "a", [1.0, 0.1]), (2, "a", [0.1, 1.0]), (3, "a", [-1.0, -1.0])], "key long, claimed_identity string, e array<double>")
    got = {r.key: (r.best_identity, r.verdict) for r in verify.verdicts(claims, sig, 2).collect()}
    assert {k: v[1] for k, v in got.items()} == {1: "AUTHENTIC", 2: "IDENTITY_MISMATCH", 3: "SUSPECTED_FAKE"} and got[2][0] == "b"


def test_command_line(spark, capsys, tmp_path):
    from stridelake.__main__ import main

    assert main(["queries"]) == 0 and "roc_auc" in capsys.readouterr().out
    assert main(["sql", "roc_auc"]) == 0 and "SELECT" in capsys.readouterr().out
    assert main(["run", "parse_identity_a", "--tables", SF, "--out", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() == entry.queries()["parse_identity_a"](spark, SF).count() > 100


@pytest.mark.parametrize("n,k", [(1, 1), (4, 1), (1, 3), (7, 4), (10, 25), (33, 33)])
def test_resampling_to_a_length_of_each_key(spark, n, k):
    x = np.random.default_rng(n).normal(size=n)
    got = column(sequence.resample_to(seq(spark, x).withColumn("wanted", F.lit(k)), "k", "v", "wanted"), "v", "i")
    assert len(got) == k and np.allclose(got, np.interp(np.linspace(0, n - 1, k), np.arange(n), x))


def test_swapped_videos_find_their_originals(spark):
    clips = spark.createDataFrame([("Ada", "F3", "a3"), ("Ada", "S1", "a1"), ("Bo_X", "Q", "b1"), ("Bo_X", None, "b0")], "identity string, view string, path string")
    names_ = spark.createDataFrame([("Ada_body_Cy_face",), ("Bo_X_body_Ada_face",), ("Cy_body_Ada_face",)], "name string")
    found = lambda **k: {r.body: r.path for r in lookup.with_originals(names_, clips, **k).collect()}
    assert found() == {"Ada": "a1", "Bo_X": None, "Cy": None}
    assert found(any_last=True) == {"Ada": "a1", "Bo_X": "b0", "Cy": None}


def test_reports_are_read_back_and_flattened(spark, tmp_path):
    rows = spark.createDataFrame([("a", [[0.5], [0.25, 1.0]])], "run string, scores array<array<double>>")
    files.write_report(rows, str(tmp_path / "r"))
    assert files.flattened(files.read_report(spark, str(tmp_path / "r")), "scores").first().scores == [0.5, 0.25, 1.0]


def test_shares_of_no_outcomes_are_zero(spark):
    c = spark.createDataFrame([(0, 0, 3, 1)], "tp long, fp long, tn long, fn long")
    got = {(r.label, r.predicted): (r.n, r.row_percent, r.total_percent) for r in summary.confusion_rows(c).collect()}
    assert got == {(1, 1): (0, 0.0, 0.0), (0, 1): (0, 0.0, 0.0), (0, 0): (3, 100.0, 75.0), (1, 0): (1, 100.0, 25.0)}
