"""Named queries over the tables at hand, each with the SQL it is compared with where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import names
from ..operators import attribution, augment, descent, enroll, features, folds, gradients, head, history, lookup, metrics, preserve, search, sequence, summary, train, verify
from ..schema import VerifierConfig
from ..sources import extraction, files, run_log
from ..sources.shared import shared_path, written
from ..sources.surrogate import label_scores, pose_frames, scored_pairs, series, signatures, table, vectors
from . import sql as q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CONFIG = VerifierConfig()
THRESHOLD = CONFIG.threshold


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


# --- frames and features -------------------------------------------------------------------------------------------


@query(f"WITH {q.PF} SELECT identity, video_id, frame_idx, i AS dim, {q.r('e[i + 1]')} AS value FROM pf, range(63) AS t(i)")
def pose_frames_view(spark, sf):
    f = pose_frames(spark, sf).select("identity", "video_id", "frame_idx", F.posexplode(F.flatten(F.transform("lm", lambda p: F.array(p["x"], p["y"], p["z"])))).alias("dim", "value"))
    return f.select("identity", "video_id", "frame_idx", F.col("dim").cast("long").alias("dim"), r6("value").alias("value"))


# a frame counts as one without a pose where its first coordinate is negative
@query(f"""WITH {q.PF}, k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM pf WHERE e[1] >= 0)
    SELECT video_id, i::INT AS frame_idx, frame_idx AS source_idx FROM k WHERE n >= 10""")
def valid_video_filter(spark, sf):
    f = pose_frames(spark, sf).withColumn("lm", F.when(F.col("lm")[0]["x"] >= 0, F.col("lm")))
    return sequence.valid_videos(f).select("video_id", "frame_idx", "source_idx")


@query(f"WITH {q.PF} SELECT video_id, frame_idx, j AS slot, {q.r('e[3 * j + 1]')} AS x, {q.r('e[3 * j + 2]')} AS y, {q.r('e[3 * j + 3]')} AS z FROM pf, range(12) AS t(j)")
def landmark_subset(spark, sf):
    f = pose_frames(spark, sf).select("video_id", "frame_idx", F.posexplode(F.slice("lm", 1, geo.N_SLOTS)).alias("slot", "p"))
    return f.select("video_id", "frame_idx", F.col("slot").cast("long").alias("slot"), *[r6(F.col("p")[k]).alias(k) for k in "xyz"])


@query(f"WITH {q.PF}, h AS (SELECT video_id, frame_idx, {q.centred()} AS c FROM pf) SELECT video_id, frame_idx, i AS dim, {q.r('c[i + 1]')} AS value FROM h, range(36) AS t(i)")
def hip_center_normalize(spark, sf):
    f = pose_frames(spark, sf).select("video_id", "frame_idx", F.posexplode(geo.hip_centred(F.col("lm"))).alias("dim", "value"))
    return f.select("video_id", "frame_idx", F.col("dim").cast("long").alias("dim"), r6("value").alias("value"))


@query(f"WITH {q.PF} SELECT video_id, frame_idx, " + ", ".join(f"{q.r(q.angle('e', *a))} AS {n}" for n, a in geo.ANGLES.items()) + " FROM pf")
def joint_angles(spark, sf):
    lm = F.col("lm")
    return pose_frames(spark, sf).select("video_id", "frame_idx", *[r6(geo.joint_angle(lm[a], lm[b], lm[c])).alias(n) for n, (a, b, c) in geo.ANGLES.items()])


@query(f"WITH {q.PF} SELECT video_id, frame_idx, {q.r(q.step())} AS step_width FROM pf")
def step_width(spark, sf):
    return pose_frames(spark, sf).select("video_id", "frame_idx", r6(geo.step_width(F.col("lm"))).alias("step_width"))


@query(f"WITH {q.PF}, h AS (SELECT video_id, frame_idx, {q.centred()} AS c FROM pf) SELECT video_id, frame_idx, {q.r(q.symmetry('c'))} AS symmetry FROM h")
def body_symmetry(spark, sf):
    f = pose_frames(spark, sf).select("video_id", "frame_idx", geo.hip_centred(F.col("lm")).alias("c"))
    return f.select("video_id", "frame_idx", r6(geo.symmetry(F.col("c"))).alias("symmetry"))


_BONE = " UNION ALL ".join(
    f"SELECT video_id, '{a}-{b}' AS bone, sqrt((e[{3 * a + 1}] - e[{3 * b + 1}]) ** 2 + (e[{3 * a + 2}] - e[{3 * b + 2}]) ** 2 + (e[{3 * a + 3}] - e[{3 * b + 3}]) ** 2) AS l FROM pf" for a, b in geo.BONES
)


@query(f"WITH {q.PF} SELECT video_id, bone, {q.r('avg(l)')} AS mean_length FROM ({_BONE}) GROUP BY video_id, bone")
def bone_lengths(spark, sf):
    lm = F.col("lm")
    bones = F.array(*[F.struct(F.lit(f"{a}-{b}").alias("bone"), geo.distance(lm[a], lm[b], "xyz").alias("l")) for a, b in geo.BONES])
    f = pose_frames(spark, sf).select("video_id", F.explode(bones).alias("b"))
    return f.groupBy("video_id", "b.bone").agg(r6(F.avg("b.l")).alias("mean_length"))


@query(f"WITH {q.FEATURES} SELECT video_id, frame_idx, i AS dim, {q.r('feat[i + 1]')} AS value FROM ff, range(78) AS t(i)")
def feature_vector_78(spark, sf):
    f = features.feature_frames(pose_frames(spark, sf)).select("video_id", "frame_idx", F.posexplode("feat").alias("dim", "value"))
    return f.select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.col("dim").cast("long").alias("dim"), r6("value").alias("value"))


@query(f"WITH {q.FEATURES} SELECT i AS dim, {q.r('avg(feat[i + 1])')} AS mean, {q.r('CASE WHEN stddev_samp(feat[i + 1]) < 1e-6 THEN 1e0 ELSE stddev_samp(feat[i + 1]) END')} AS std FROM ff, range(78) AS t(i) GROUP BY i")
def feature_stats(spark, sf):
    s = enroll.feature_stats(features.feature_frames(pose_frames(spark, sf)), "feat", geo.N_DIMS)
    return s.select(F.col("dim").cast("long").alias("dim"), r6("mean").alias("mean"), r6("std").alias("std"))


@query(f"""WITH {q.FEATURES}, st AS (SELECT i, avg(feat[i + 1]) AS m, CASE WHEN stddev_samp(feat[i + 1]) < 1e-6 THEN 1e0 ELSE stddev_samp(feat[i + 1]) END AS s FROM ff, range(78) AS t(i) GROUP BY i)
    SELECT video_id, i AS dim, {q.r('avg((feat[i + 1] - m) / s)')} AS mean_z, {q.r('max((feat[i + 1] - m) / s)')} AS max_z FROM ff, st GROUP BY video_id, i""")
def zscore(spark, sf):
    f = features.feature_frames(pose_frames(spark, sf))
    z = enroll.zscore(f, enroll.feature_stats(f, "feat", geo.N_DIMS), "feat")
    g = z.select("video_id", F.posexplode("feat").alias("dim", "z")).groupBy("video_id", F.col("dim").cast("long").alias("dim"))
    return g.agg(r6(F.avg("z")).alias("mean_z"), r6(F.max("z")).alias("max_z"))


# --- sequences -------------------------------------------------------------------------------------------------------


@query(f"WITH {q.SERIES} SELECT event_id, {q.r('coalesce((lead(value) OVER w) - value, value - (lag(value) OVER w), 0)')} AS velocity FROM s WINDOW w AS (PARTITION BY user_id ORDER BY frame_idx)")
def velocity(spark, sf):
    return sequence.velocity(series(spark, sf), "user_id", "value").select("event_id", r6("velocity").alias("velocity"))


@query(f"WITH {q.SERIES} SELECT event_id, {q.r('coalesce((lead(value, 2) OVER w) - 2 * (lead(value) OVER w) + value, 0)')} AS acceleration FROM s WINDOW w AS (PARTITION BY user_id ORDER BY frame_idx)")
def acceleration(spark, sf):
    return sequence.acceleration(series(spark, sf), "user_id", "value").select("event_id", r6("acceleration").alias("acceleration"))


_MOVED = " + ".join(f"abs(e[{3 * j + k + 1}] - b[{3 * j + k + 1}])" for j in range(21) for k in (0, 1))


@query(f"""WITH {q.PF}, l AS (SELECT *, lag(e) OVER (PARTITION BY video_id ORDER BY frame_idx) AS b FROM pf), m AS (SELECT video_id, frame_idx, {_MOVED} AS moved FROM l),
    f AS (SELECT video_id, frame_idx, coalesce(moved, lead(moved) OVER (PARTITION BY video_id ORDER BY frame_idx), 0) AS moved FROM m)
    SELECT video_id, frame_idx, {q.r('moved / (max(moved) OVER (PARTITION BY video_id) + 1e-8)')} AS attention FROM f""")
def movement_attention(spark, sf):
    return sequence.movement_attention(pose_frames(spark, sf), "video_id").select("video_id", "frame_idx", r6("attention").alias("attention"))


def _placed(k: int) -> str:
    return f"SELECT DISTINCT user_id, n, i, (i * (n - 1)) // {k - 1} AS p FROM s, range({k}) AS t(i)"


@query(f"""WITH {q.SERIES}, at60 AS ({_placed(60)}) SELECT at60.user_id, i, {q.r('a.value + (coalesce(b.value, a.value) - a.value) * ((i * (at60.n - 1) - p * 59) / 59e0)')} AS value
    FROM at60 JOIN s a ON a.user_id = at60.user_id AND a.frame_idx = p LEFT JOIN s b ON b.user_id = at60.user_id AND b.frame_idx = p + 1""")
def resample_linear_60(spark, sf):
    f = sequence.resample(series(spark, sf), "user_id", "value")
    return f.select("user_id", F.col("i").cast("long").alias("i"), r6("value").alias("value"))


@query(f"WITH {q.SERIES}, at20 AS ({_placed(20)}) SELECT at20.user_id, i, a.event_id FROM at20 JOIN s a ON a.user_id = at20.user_id AND a.frame_idx = p")
def frame_sample_uniform(spark, sf):
    return sequence.sample_uniform(series(spark, sf), "user_id", 20).select("user_id", F.col("i").cast("long").alias("i"), "event_id")


@query(f"""WITH {q.SERIES}, c AS (SELECT DISTINCT user_id, n FROM s),
    p AS (SELECT user_id, i, least(n - 1, floor(CASE WHEN i = 19 THEN n * 0.9e0 ELSE n * 0.1e0 + i * ((n * 0.9e0 - n * 0.1e0) / 19e0) END)::BIGINT) AS frame_idx FROM c, range(20) AS t(i))
    SELECT user_id, i, event_id FROM p JOIN s USING (user_id, frame_idx)""")
def frame_sample_band(spark, sf):
    """Twenty events a user, evenly spaced over the middle four fifths."""
    return sequence.sample_band(series(spark, sf), "user_id", 20).select("user_id", F.col("i").cast("long").alias("i"), "event_id")


@query(f"WITH {q.SERIES} SELECT user_id, i, event_id FROM s JOIN range(60) AS t(i) ON frame_idx = i % n WHERE frame_idx < 60")
def tile_or_truncate(spark, sf):
    return sequence.tile(series(spark, sf), "user_id").select("user_id", F.col("i").cast("long").alias("i"), "event_id")


@query(f"WITH {q.SERIES} SELECT user_id, i, event_id FROM s JOIN range(60) AS t(i) ON frame_idx = least(i, n - 1)")
def edge_pad(spark, sf):
    return sequence.edge_pad(series(spark, sf), "user_id").select("user_id", F.col("i").cast("long").alias("i"), "event_id")


@query(f"WITH {q.SERIES} SELECT user_id, n - 1 - frame_idx AS frame_idx, event_id FROM s")
def reverse(spark, sf):
    return sequence.reverse(series(spark, sf), "user_id").select("user_id", "frame_idx", "event_id")


@query(f"""WITH {q.SERIES}, c AS (SELECT DISTINCT user_id, n, greatest(1, floor(n / 1.2e0)::BIGINT) AS k FROM s), w AS (SELECT user_id, n, k, unnest(range(k)) AS i FROM c),
    p AS (SELECT user_id, i, CASE WHEN k = 1 THEN 0 ELSE round_even(i * (n - 1) / greatest(k - 1, 1)::DOUBLE, 0)::BIGINT END AS frame_idx FROM w)
    SELECT user_id, i, event_id FROM p JOIN s USING (user_id, frame_idx)""")
def speed_change(spark, sf):
    return sequence.change_speed(series(spark, sf), "user_id", 1.2).select("user_id", F.col("i").cast("long").alias("i"), "event_id")


@query(f"""WITH {q.SERIES}, p AS (SELECT user_id, frame_idx AS i, greatest(0, least(n - 1, frame_idx + trunc({q.gaussian('user_id', 'frame_idx')} * 0.1e0 * n)::BIGINT)) AS frame_idx FROM s)
    SELECT user_id, i, event_id FROM p JOIN s USING (user_id, frame_idx)""")
def temporal_jitter(spark, sf):
    """Each user's events in a slightly shuffled order: places moved by a tenth of the length, spread as a normal number."""
    return sequence.jitter(series(spark, sf), "user_id", 0.1).select("user_id", F.col("i").cast("long").alias("i"), "event_id")


# --- augmentation ------------------------------------------------------------------------------------------------------


def _points(f: DataFrame, lm: Column) -> DataFrame:
    f = f.select("video_id", "frame_idx", F.posexplode(lm).alias("slot", "p"))
    return f.select("video_id", "frame_idx", F.col("slot").cast("long").alias("slot"), *[r6(F.col("p")[k]).alias(k) for k in "xyz"])


_SLOTS = f"WITH {q.PF}, p AS (SELECT video_id, frame_idx, j, e[3 * j + 1] AS x, e[3 * j + 2] AS y, e[3 * j + 3] AS z FROM pf, range(12) AS t(j)) SELECT video_id, frame_idx, "


@query(_SLOTS + f"xor(j, 1) AS slot, {q.r('1 - x')} AS x, {q.r('y')} AS y, {q.r('z')} AS z FROM p")
def hflip(spark, sf):
    return _points(pose_frames(spark, sf), augment.hflip(F.col("lm")))


@query(_SLOTS + f"j AS slot, {q.r('(x - 0.5e0) * cos(radians(7)) - (y - 0.5e0) * sin(radians(7)) + 0.5e0')} AS x, {q.r('(x - 0.5e0) * sin(radians(7)) + (y - 0.5e0) * cos(radians(7)) + 0.5e0')} AS y, {q.r('z')} AS z FROM p")
def rotate(spark, sf):
    return _points(pose_frames(spark, sf), augment.rotate(F.col("lm"), 7))


@query(_SLOTS + f"j AS slot, {q.r('(x - 0.5e0) * 1.1e0 + 0.5e0')} AS x, {q.r('(y - 0.5e0) * 1.1e0 + 0.5e0')} AS y, {q.r('z')} AS z FROM p")
def zoom(spark, sf):
    return _points(pose_frames(spark, sf), augment.zoom(F.col("lm"), 1.1))


@query(f"""WITH {q.PF}, g AS (SELECT video_id, frame_idx, e, slot, video_id || '|' || frame_idx AS key FROM pf, range(12) AS t(slot))
    SELECT video_id, frame_idx, slot, {q.r(f"e[3 * slot + 1] + 0.01 * {q.gaussian('key', 'slot', '0')}")} AS x, {q.r(f"e[3 * slot + 2] + 0.01 * {q.gaussian('key', 'slot', '1')}")} AS y, {q.r("e[3 * slot + 3]")} AS z FROM g""")
def landmark_noise(spark, sf):
    f = pose_frames(spark, sf)
    return _points(f, augment.noise(F.col("lm"), F.concat_ws("|", "video_id", F.col("frame_idx").cast("string")), 0.01))


_KINDS = "(VALUES " + ", ".join(f"('{k}')" for k in augment.SPATIAL + augment.TEMPORAL) + ") AS k(augmentation)"


@query(f"WITH {q.PF} SELECT DISTINCT video_id, augmentation FROM pf, {_KINDS} WHERE NOT (augmentation = 'blur' AND video_id LIKE '%_1')")
def augmentation_plan(spark, sf):
    v = pose_frames(spark, sf).select("video_id").distinct()
    return augment.plan(spark, v, v.where("video_id like '%_1'").withColumn("augmentation", F.lit("blur")))


# --- enrolment and pairs -------------------------------------------------------------------------------------------------


def signature_values(signatures: DataFrame) -> DataFrame:
    """identity, frame_idx, dim, value, num_videos of all dimensions."""
    s = signatures.select("identity", "frame_idx", "num_videos", F.posexplode("sig").alias("dim", "value"))
    return s.select("identity", "frame_idx", F.col("dim").cast("long").alias("dim"), r6("value").alias("value"), "num_videos")


@query(f"""WITH {q.PF}, h AS (SELECT identity, video_id, frame_idx, {q.centred()} AS c FROM pf)
    SELECT identity, frame_idx, i AS dim, {q.r('avg(c[i + 1])')} AS value, count(DISTINCT video_id) AS num_videos FROM h, range(36) AS t(i) GROUP BY identity, frame_idx, i""")
def enroll_signature(spark, sf):
    f = pose_frames(spark, sf).select("identity", "video_id", "frame_idx", geo.hip_centred(F.col("lm")).alias("c"))
    return signature_values(enroll.frame_signatures(f, "c", 36))


@query(f"WITH {q.PF} SELECT identity, frame_idx, i AS dim, {q.r('avg(e[i + 1])')} AS value, count(DISTINCT video_id) AS num_videos FROM pf, range(36) AS t(i) GROUP BY identity, frame_idx, i HAVING count(DISTINCT video_id) >= 3")
def enroll_min_videos(spark, sf):
    f = pose_frames(spark, sf).select("identity", "video_id", "frame_idx", features.flat(F.col("lm")).alias("v"))
    return signature_values(enroll.frame_signatures(f, "v", 36, 3))


@query(f"WITH {q.SCORED}, s AS (SELECT identity, d, sum(e[d]) AS t, count(*) AS n FROM v, range(1, 65) AS x(d) GROUP BY ALL) SELECT vec_id, d - 1 AS dim, {q.r('(t - e[d]) / (n - 1)')} AS value FROM v JOIN s USING (identity) WHERE n > 1")
def enroll_leave_self_out(spark, sf):
    o = enroll.leave_self_out(vectors(spark, sf), "e", 64).where("others is not null")
    o = o.select("vec_id", F.posexplode("others").alias("dim", "value"))
    return o.select("vec_id", F.col("dim").cast("long").alias("dim"), r6("value").alias("value"))


@query(f"""WITH {q.SCORED}, p AS (SELECT identity, row_number() OVER (ORDER BY md5(identity), identity) - 1 AS place, count(*) OVER () AS people FROM (SELECT DISTINCT identity FROM v))
    SELECT vec_id AS key, identity AS true_identity, identity AS claimed_identity, 1 AS label FROM v
    UNION ALL SELECT vec_id, v.identity, o.identity, 0 FROM v JOIN p ON p.identity = v.identity JOIN p o ON o.place = (p.place + 1 + ('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::BIGINT % (p.people - 1)) % p.people""")
def verification_pairs(spark, sf):
    v = vectors(spark, sf)
    return enroll.enrolled_pairs(v.select(F.col("vec_id").alias("key"), F.col("identity").alias("true_identity")), v.select("identity").distinct())


@query(f"""WITH {q.PF}, v AS (SELECT DISTINCT identity, video_id FROM pf), x AS (SELECT *, coalesce(lead(video_id) OVER w, first_value(video_id) OVER w) AS next FROM v WINDOW w AS (PARTITION BY identity ORDER BY md5(video_id), video_id)),
    rp AS (SELECT identity, arg_max(video_id, md5(video_id)) AS rep FROM v GROUP BY identity), g AS (SELECT identity, coalesce(lead(rep) OVER w, first_value(rep) OVER w) AS negative FROM rp WINDOW w AS (ORDER BY md5(identity), identity))
    SELECT video_id AS anchor, next AS positive, negative, identity AS anchor_person FROM x JOIN g USING (identity)""")
def triplets(spark, sf):
    return enroll.triplets(pose_frames(spark, sf).select("identity", "video_id").distinct())


@query(f"""WITH {q.SCORED} SELECT vec_id, claimed_identity, {q.r('list_sum(list_transform(range(1, 65), lambda i: abs(e[i] - sig[i])))')} AS l1,
    {q.r('list_sum(list_transform(range(1, 65), lambda i: e[i] - sig[i]))')} AS gap, {q.r('list_dot_product(e, sig)')} AS product FROM v, sig WHERE identity = claimed_identity""")
def comparison_features(spark, sf):
    v = vectors(spark, sf)
    f = v.join(signatures(v).select("identity", "sig"), "identity").select("vec_id", F.col("identity").alias("claimed_identity"), enroll.comparison_features(F.col("e"), F.col("sig")).alias("f"))
    part = lambda a, b: geo.total(F.col("f")[i] for i in range(a, b))
    return f.select("vec_id", "claimed_identity", r6(part(64, 128)).alias("l1"), r6(part(0, 64)).alias("gap"), r6(part(128, 192)).alias("product"))


@query(f"WITH {q.PF}, v AS (SELECT DISTINCT identity FROM pf) SELECT identity, CASE WHEN row_number() OVER (ORDER BY md5('42|' || identity), identity) <= floor((SELECT count(*) FROM v) * 0.8e0) THEN 'train' ELSE 'validation' END AS part FROM v")
def person_split(spark, sf):
    return enroll.split_people(vectors(spark, sf).select("identity").distinct(), 0.8, "42")


# --- identification and verdicts -----------------------------------------------------------------------------------------


@query(f"WITH {q.SCORED} SELECT vec_id, true_identity, arg_max(claimed_identity, (score, claimed_identity)) AS best_identity, max(score) AS best_score FROM sp GROUP BY vec_id, true_identity")
def identify_1_to_n(spark, sf):
    v = vectors(spark, sf)
    best = verify.identify(v.select(F.concat_ws("|", "vec_id", "identity").alias("key"), "e"), signatures(v), 64)
    own = F.split("key", "\\|", 2)
    return best.select(own[0].cast("long").alias("vec_id"), own[1].alias("true_identity"), "best_identity", "best_score")


@query(f"WITH {q.SCORED} SELECT * FROM (SELECT vec_id, claimed_identity, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, claimed_identity)::INT AS rank FROM sp) WHERE rank <= 5")
def top5_scores(spark, sf):
    v = vectors(spark, sf)
    best = search.best_matches(v.select(F.col("vec_id").alias("key"), "e"), signatures(v), 5, 64)
    return enroll.top_scores(best, 5, "key").select(F.col("key").alias("vec_id"), "claimed_identity", "score", "rank")


#: Identities in a ring by the digests of their names.
_RING = "rg AS (SELECT identity, coalesce(lead(identity) OVER w, first_value(identity) OVER w) AS next_identity FROM (SELECT DISTINCT identity FROM v) WINDOW w AS (ORDER BY md5(identity), identity))"
_VERDICT = f"""{_RING}, m AS (SELECT vec_id, true_identity, arg_max(claimed_identity, (score, claimed_identity)) AS best, max(score) AS top FROM sp GROUP BY ALL),
    cl AS (SELECT vec_id, true_identity, CASE WHEN vec_id % 2 = 0 THEN true_identity ELSE next_identity END AS claimed_identity FROM m JOIN rg ON rg.identity = true_identity)"""


@query(f"""WITH {q.SCORED}, {_VERDICT} SELECT cl.claimed_identity, CASE WHEN score > 0.4 THEN 'AUTHENTIC' WHEN top > 0.4 AND best <> cl.claimed_identity THEN 'IDENTITY_MISMATCH' ELSE 'SUSPECTED_FAKE' END AS verdict, count(*) AS n
    FROM cl JOIN m USING (vec_id) JOIN sp ON sp.vec_id = cl.vec_id AND sp.claimed_identity = cl.claimed_identity GROUP BY ALL""")
def three_way_verdict(spark, sf):
    v = vectors(spark, sf)
    s = signatures(v).select("identity", "sig")
    claim = F.when(F.col("vec_id") % 2 == 0, F.col("identity")).otherwise(F.col("next_identity"))  # every other probe claims the next identity
    claims = v.join(enroll.next_in_ring(s.select("identity")), "identity").select(F.col("vec_id").alias("key"), claim.alias("claimed_identity"), "e")
    return verify.verdicts(claims, s, 64, 0.4).groupBy("claimed_identity", "verdict").agg(F.count("*").alias("n"))


@query(f"""WITH {q.SCORED}, {_RING} SELECT a.vec_id, a.score AS own_score, b.score AS other_score, a.score - b.score > 0 AS own_wins FROM sp a JOIN rg ON rg.identity = a.true_identity JOIN sp b ON b.vec_id = a.vec_id AND b.claimed_identity = next_identity WHERE a.label = 1""")
def dual_claim(spark, sf):
    p = scored_pairs(spark, sf)
    own = p.where("label = 1").select("vec_id", "true_identity", F.col("score").alias("own_score"))
    ring = enroll.next_in_ring(p.select(F.col("true_identity").alias("identity")).distinct())
    own = own.join(ring.select(F.col("identity").alias("true_identity"), F.col("next_identity").alias("claimed_identity")), "true_identity")
    return own.join(p.select("vec_id", "claimed_identity", F.col("score").alias("other_score")), ["vec_id", "claimed_identity"]).select("vec_id", "own_score", "other_score", (F.col("own_score") - F.col("other_score") > 0).alias("own_wins"))


# --- preservation ----------------------------------------------------------------------------------------------------------

_STRENGTHS = {"preserved": 0.0005, "weakened": 0.004, "broken": 0.05}
_MOVES = ", ".join(f"('{n}', {s}::DOUBLE)" for n, s in _STRENGTHS.items())
_GAPS = "[" + ", ".join("sqrt(" + " + ".join(f"(ca[{3 * j + k + 1}] - cb[{3 * j + k + 1}]) ** 2" for k in range(3)) + ")" for j in range(12)) + "]"
_TORSO = "greatest(1e-6, sqrt(" + " + ".join(f"((ca[{k + 1}] + ca[{k + 4}]) / 2 - (ca[{k + 19}] + ca[{k + 22}]) / 2) ** 2" for k in range(3)) + "))"
_PRESERVATION = f"""WITH {q.PF}, mv(kind, size) AS (VALUES {_MOVES}),
    nv AS (SELECT video_id, coalesce(lead(video_id) OVER w, first_value(video_id) OVER w) AS other FROM (SELECT DISTINCT identity, video_id FROM pf) WINDOW w AS (PARTITION BY identity ORDER BY video_id)),
    both_ AS (SELECT kind || ':' || video_id AS pair_id, frame_idx, e AS a, list_transform(range(63), lambda i: e[i + 1] + CASE WHEN i % 3 = 0 THEN size * (((frame_idx + i // 3) % 7) - 3) ELSE 0 END) AS b FROM pf, mv
        UNION ALL SELECT 'altered:' || x.video_id, x.frame_idx, x.e, y.e FROM pf x JOIN nv USING (video_id) JOIN pf y ON y.video_id = nv.other AND y.frame_idx = x.frame_idx WHERE nv.other <> x.video_id),
    f AS (SELECT pair_id, {q.centred('a')} AS ca, {q.centred('b')} AS cb, {q.angles('a')} AS ga, {q.angles('b')} AS gb, {q.step('a')} AS sa, {q.step('b')} AS sb FROM both_),
    d AS (SELECT pair_id, sa, sb, {q.symmetry('ca')} AS ya, {q.symmetry('cb')} AS yb, {_GAPS} AS gap, {_TORSO} AS scale,
                 list_dot_product(ca, cb) / (sqrt(list_dot_product(ca, ca)) * sqrt(list_dot_product(cb, cb)) + 1e-8) AS cosine, sqrt(list_sum(list_transform(range(1, 7), lambda i: (ga[i] - gb[i]) ** 2))) AS l2_angles FROM f),
    o AS (SELECT pair_id, avg(list_sum(list_transform(gap, lambda g: CASE WHEN g < 0.05 * scale THEN 1e0 ELSE 0e0 END)) / 12) AS pck_score, avg(cosine) AS mean_cosine, avg(sqrt(list_dot_product(gap, gap))) AS mean_l2_coords,
                 avg(list_sum(gap) / 12) AS mean_per_landmark_l2, avg(l2_angles) AS mean_l2_angles,
                 covar_pop(sa, sb) / nullif(stddev_pop(sa) * stddev_pop(sb), 0) AS step_correlation, covar_pop(ya, yb) / nullif(stddev_pop(ya) * stddev_pop(yb), 0) AS symmetry_correlation FROM d GROUP BY pair_id),
    v AS (SELECT *, coalesce(step_correlation >= 0.85 AND symmetry_correlation >= 0.85, false) AS corr_pass, pck_score >= 0.9 AS pck_pass, mean_cosine >= 0.95 AS cosine_pass FROM o)"""


def preservation_pairs(spark, sf) -> DataFrame:
    """Every video against itself moved a little, more and much, and against its person's next one by name."""
    f = pose_frames(spark, sf)
    strengths = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("size")) for k, s in _STRENGTHS.items()]))
    moved = preserve.jittered(f.withColumn("a", F.col("lm")).withColumn("move", strengths), F.col("move.size"))
    moved = moved.select(F.concat("move.kind", F.lit(":"), "video_id").alias("pair_id"), "frame_idx", "a", F.col("lm").alias("b"))
    ring = Window.partitionBy("identity").orderBy("video_id")
    other = F.coalesce(F.lead("video_id").over(ring), F.first("video_id").over(ring))
    swaps = f.select("identity", "video_id").distinct().withColumn("video_b", other).where("video_b <> video_id")
    swaps = swaps.select(F.concat(F.lit("altered:"), "video_id").alias("pair_id"), F.col("video_id").alias("video_a"), "video_b")
    plain = F.transform("b", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z")))
    return moved.unionByName(preserve.aligned(swaps, f).withColumn("b", plain).select("pair_id", "frame_idx", "a", "b"))


_SCORES = ("pck_score", "mean_cosine", "mean_l2_coords", "mean_per_landmark_l2", "mean_l2_angles", "step_correlation", "symmetry_correlation")


@query(_PRESERVATION + " SELECT pair_id, " + ", ".join(f"{q.r(c)} AS {c}" for c in _SCORES) + ", corr_pass, pck_pass, cosine_pass, corr_pass::INT + pck_pass::INT + cosine_pass::INT AS pass_count, corr_pass::INT + pck_pass::INT + cosine_pass::INT >= 2 AS preserved FROM v")
def gait_preservation(spark, sf):
    p = preserve.preservation(preservation_pairs(spark, sf))
    return p.select("pair_id", *[r6(c).alias(c) for c in _SCORES], "corr_pass", "pck_pass", "cosine_pass", "pass_count", "preserved")


@query(_PRESERVATION + f" SELECT pair_id, {q.r('pck_score')} AS pck_score FROM v")
def pck(spark, sf):
    return preserve.preservation(preservation_pairs(spark, sf)).select("pair_id", r6("pck_score").alias("pck_score"))


@query(_PRESERVATION + f" SELECT pair_id, {q.r('mean_cosine')} AS mean_cosine FROM v")
def pose_cosine(spark, sf):
    return preserve.preservation(preservation_pairs(spark, sf)).select("pair_id", r6("mean_cosine").alias("mean_cosine"))


@query(_PRESERVATION + f" SELECT pair_id, {q.r('step_correlation')} AS step_correlation FROM v")
def step_corr(spark, sf):
    return preserve.preservation(preservation_pairs(spark, sf)).select("pair_id", r6("step_correlation").alias("step_correlation"))


# --- metrics -------------------------------------------------------------------------------------------------------------

_RATES = "accuracy, precision, recall, f1"
_RATE_SQL = f"""{q.r('coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0)::DOUBLE, 0)')} AS accuracy, {q.r('coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)')} AS precision,
    {q.r('coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)')} AS recall, {q.r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)')} AS f1"""


@query(f"WITH {q.LABELS}, {q.CONFUSION.replace('0.7737', '0.5')} SELECT tp, fp, tn, fn, {_RATE_SQL} FROM c")
def confusion_matrix(spark, sf):
    c = metrics.rates(metrics.counts(label_scores(spark, sf), F.col("score") > 0.5))
    return c.select("tp", "fp", "tn", "fn", *[r6(k).alias(k) for k in _RATES.split(", ")])


@query(f"""WITH {q.LABELS}, {q.CONFUSION.replace('0.7737', '0.5')},
    x AS (SELECT '0' AS class, tn AS a, fn AS b, fp AS d FROM c UNION ALL SELECT '1', tp, fp, fn FROM c),
    y AS (SELECT class, coalesce(a / nullif(a + b, 0)::DOUBLE, 0) AS precision, coalesce(a / nullif(a + d, 0)::DOUBLE, 0) AS recall, coalesce(2 * a / nullif(2 * a + b + d, 0)::DOUBLE, 0) AS f1, a + d AS support FROM x),
    z AS (SELECT * FROM y UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM y
          UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM y)
    SELECT class, {q.r('precision')} AS precision, {q.r('recall')} AS recall, {q.r('f1')} AS f1, support::BIGINT AS support FROM z""")
def classification_report(spark, sf):
    c = metrics.report(metrics.counts(label_scores(spark, sf), F.col("score") > 0.5))
    return c.select("class", *[r6(k).alias(k) for k in ("precision", "recall", "f1")], "support")


@query(f"WITH {q.SCORED} SELECT true_identity, {q.r('avg(((score > 0.4) = (label = 1))::INT)')} AS accuracy, count(*) AS n FROM sp GROUP BY true_identity")
def per_identity_accuracy(spark, sf):
    right = ((F.col("score") > 0.4) == (F.col("label") == 1)).cast("int")
    return scored_pairs(spark, sf).groupBy("true_identity").agg(r6(F.avg(right)).alias("accuracy"), F.count("*").alias("n"))


@query(f"""WITH {q.LABELS}, {q.CONFUSION.replace('0.7737', '0.5')}, p AS (SELECT tn / (tn + fn + 1e-8) AS fp0, tn / (tn + fp + 1e-8) AS fr0, tp / (tp + fp + 1e-8) AS ap, tp / (tp + fn + 1e-8) AS ar FROM c)
    SELECT {q.r('100 * fp0')} AS fake_precision, {q.r('100 * fr0')} AS fake_recall, {q.r('100 * 2 * fp0 * fr0 / (fp0 + fr0 + 1e-8)')} AS fake_f1,
           {q.r('100 * ap')} AS authentic_precision, {q.r('100 * ar')} AS authentic_recall, {q.r('100 * 2 * ap * ar / (ap + ar + 1e-8)')} AS authentic_f1 FROM p""")
def eps_metrics(spark, sf):
    c = metrics.eps_rates(metrics.counts(label_scores(spark, sf), F.col("score") > 0.5))
    return c.select(*[r6(f"{a}_{b}").alias(f"{a}_{b}") for a in ("fake", "authentic") for b in ("precision", "recall", "f1")])


@query(f"WITH {q.LABELS}, {q.CURVE}, {q.ROC} SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, {q.r('tpr')} AS tpr, {q.r('fpr')} AS fpr FROM roc")
def roc_curve(spark, sf):
    return metrics.roc_curve(label_scores(spark, sf)).select("threshold", "tp", "fp", r6("tpr").alias("tpr"), r6("fpr").alias("fpr"))


@query(f"WITH {q.SCORED}, {q.CURVE}, {q.ROC} SELECT threshold, {q.r('fpr')} AS fpr, {q.r('1 - tpr')} AS fnr FROM roc")
def det_curve(spark, sf):
    return metrics.roc_curve(scored_pairs(spark, sf)).select("threshold", r6("fpr").alias("fpr"), r6("fnr").alias("fnr"))


@query(f"WITH {q.SCORED}, {q.CURVE} SELECT {q.r('sum(neg * (2 * tp - pos)) / 2e0 / max(n_pos * n_neg)')} AS auc FROM t")
def roc_auc(spark, sf):
    return metrics.roc_auc(scored_pairs(spark, sf)).select(r6("auc").alias("auc"))


@query(f"WITH {q.SCORED}, {q.CURVE} SELECT {q.r('sum(pos / n_pos::DOUBLE * tp / (tp + fp))')} AS average_precision FROM t")
def average_precision(spark, sf):
    return metrics.average_precision(scored_pairs(spark, sf)).select(r6("average_precision").alias("average_precision"))


@query(f"""WITH {q.SCORED}, {q.CURVE} SELECT {q.r('sum(pos / n_pos::DOUBLE * (tp / (tp + fp)::DOUBLE + coalesce((tp - pos) / nullif(tp - pos + fp - neg, 0)::DOUBLE, 1)) / 2)')} AS pr_auc FROM t""")
def pr_auc_trapezoid(spark, sf):
    return metrics.pr_auc(scored_pairs(spark, sf)).select(r6("pr_auc").alias("pr_auc"))


@query(f"WITH {q.SCORED}, {q.CURVE}, {q.ROC} SELECT threshold, {q.r('tpr - fpr')} AS j, {q.r('tpr')} AS tpr, {q.r('fpr')} AS fpr FROM roc ORDER BY round(tpr - fpr, 12) DESC, coalesce(threshold, 'inf'::DOUBLE) DESC LIMIT 1")
def youden(spark, sf):
    y = metrics.youden(scored_pairs(spark, sf))
    return y.select("threshold", r6("j").alias("j"), r6("tpr").alias("tpr"), r6("fpr").alias("fpr"))


_CORNERS = q.ROC.replace("FROM t)", "FROM t WHERE next_pos IS NULL OR pos <> next_pos OR neg <> next_neg)")


@query(f"WITH {q.SCORED}, {q.CURVE}, {_CORNERS} SELECT {q.r('(fpr + 1 - tpr) / 2')} AS eer, threshold FROM roc ORDER BY round(abs(fpr - (1 - tpr)), 12), coalesce(threshold, 'inf'::DOUBLE) DESC LIMIT 1")
def eer(spark, sf):
    return metrics.eer(scored_pairs(spark, sf)).select(r6("eer").alias("eer"), "threshold")


@query(f"""WITH {q.SCORED}, {q.CURVE}, {q.ROC}, b AS (SELECT threshold AS t FROM roc ORDER BY round(tpr - fpr, 12) DESC, coalesce(threshold, 'inf'::DOUBLE) DESC LIMIT 1),
    c AS (SELECT count(*) FILTER (label = 1 AND p) AS tp, count(*) FILTER (label = 0 AND p) AS fp, count(*) FILTER (label = 0 AND NOT p) AS tn, count(*) FILTER (label = 1 AND NOT p) AS fn FROM (SELECT *, score > t AS p FROM sp, b))
    SELECT tp, fp, tn, fn, {_RATE_SQL} FROM c""")
def metrics_at_youden(spark, sf):
    p = scored_pairs(spark, sf)
    t = metrics.youden(p).select(F.col("threshold").alias("t"))  # one row
    c = metrics.rates(metrics.counts(p.crossJoin(F.broadcast(t)), F.col("score") > F.col("t")))
    return c.select("tp", "fp", "tn", "fn", *[r6(k).alias(k) for k in _RATES.split(", ")])


@query(f"WITH {q.SCORED}, {q.CURVE}, m AS (SELECT {q.r('sum(neg * (2 * tp - pos)) / 2e0 / max(n_pos * n_neg)')} AS auc FROM t), {_CORNERS}, x AS (SELECT {q.r('(fpr + 1 - tpr) / 2')} AS eer FROM roc ORDER BY round(abs(fpr - (1 - tpr)), 12), coalesce(threshold, 'inf'::DOUBLE) DESC LIMIT 1) SELECT auc, eer FROM m, x")
def pooled_metrics(spark, sf):
    p = scored_pairs(spark, sf)
    return metrics.roc_auc(p).select(r6("auc").alias("auc")).crossJoin(metrics.eer(p).select(r6("eer").alias("eer")))


# folds: every identity is left out once


@query(f"WITH {q.SCORED}, f AS (SELECT DISTINCT identity AS test_person FROM v) SELECT test_person, CASE WHEN true_identity = test_person THEN 'test' ELSE 'train' END AS role, count(*) AS n, sum(label)::BIGINT AS n_pos FROM sp, f GROUP BY ALL")
def loocv_split(spark, sf):
    """Counts of each fold's roles, by total less own instead of a row for every fold and pair."""
    own = scored_pairs(spark, sf).groupBy(F.col("true_identity").alias("test_person")).agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("n_pos"))
    all_ = Window.partitionBy(F.lit(1))  # a row a fold
    rest = own.select("test_person", F.lit("train").alias("role"), (F.sum("n").over(all_) - F.col("n")).alias("n"), (F.sum("n_pos").over(all_) - F.col("n_pos")).alias("n_pos"))
    return own.select("test_person", F.lit("test").alias("role"), "n", "n_pos").unionByName(rest)


_FOLDS = f"""WITH {q.SCORED}, c AS (SELECT true_identity AS test_person, count(*) FILTER (label = 1 AND p) AS tp, count(*) FILTER (label = 0 AND p) AS fp, count(*) FILTER (label = 0 AND NOT p) AS tn, count(*) FILTER (label = 1 AND NOT p) AS fn
        FROM (SELECT *, score > 0.4 AS p FROM sp) GROUP BY 1),
    g AS (SELECT true_identity AS test_person, score, sum(label) AS pos, sum(1 - label) AS neg FROM sp GROUP BY 1, 2), t AS (SELECT *, sum(pos) OVER (PARTITION BY test_person ORDER BY score DESC) AS tp FROM g),
    a AS (SELECT test_person, sum(neg * (2 * tp - pos)) / 2e0 / (sum(pos) * sum(neg)) AS auc FROM t GROUP BY 1),
    m AS (SELECT test_person, {_RATE_SQL}, {q.r('auc')} AS auc, tp + fp + tn + fn AS n_samples FROM c JOIN a USING (test_person))"""


def fold_metrics(pairs: DataFrame) -> DataFrame:
    c = metrics.rates(metrics.counts(pairs, F.col("score") > 0.4, "true_identity"))
    both = c.join(metrics.roc_auc(pairs, ["true_identity"]), "true_identity")
    return both.select(F.col("true_identity").alias("test_person"), *[r6(k).alias(k) for k in (*_RATES.split(", "), "auc")], (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("n_samples"))


@query(_FOLDS + " SELECT * FROM m")
def loocv_fold_metrics(spark, sf):
    return fold_metrics(scored_pairs(spark, sf))


@query(_FOLDS + " SELECT " + ", ".join(f"{q.r(f'avg({k})')} AS mean_{k}, {q.r(f'stddev_pop({k})')} AS std_{k}" for k in ("accuracy", "f1", "auc")) + " FROM m")
def loocv_summary(spark, sf):
    return fold_metrics(scored_pairs(spark, sf)).agg(*[x for k in ("accuracy", "f1", "auc") for x in (r6(F.avg(k)).alias(f"mean_{k}"), r6(F.stddev_pop(k)).alias(f"std_{k}"))])


@query(f"WITH {q.SCORED}, e AS (SELECT label, min(score) AS lo, max(score) AS hi FROM sp GROUP BY 1) SELECT label, least(49, floor(coalesce((score - lo) * 50 / nullif(hi - lo, 0), 0))::INT) AS bin, count(*) AS n FROM sp JOIN e USING (label) GROUP BY ALL")
def score_histogram(spark, sf):
    return metrics.score_histogram(scored_pairs(spark, sf))


@query(f"WITH {q.SCORED} SELECT label, {q.r('avg(score)')} AS mean, {q.r('stddev_pop(score)')} AS std, count(*) AS n FROM sp GROUP BY label")
def score_moments(spark, sf):
    return scored_pairs(spark, sf).groupBy("label").agg(r6(F.avg("score")).alias("mean"), r6(F.stddev_pop("score")).alias("std"), F.count("*").alias("n"))


@query(f"""WITH {q.SCORED}, c AS (SELECT *, CASE WHEN score >= 0.4 AND label = 1 THEN 'TP' WHEN score >= 0.4 THEN 'FP' WHEN label = 1 THEN 'FN' ELSE 'TN' END AS "case" FROM sp)
    SELECT * FROM (SELECT "case", vec_id, claimed_identity, score, row_number() OVER (PARTITION BY "case" ORDER BY vec_id, claimed_identity)::INT AS nth FROM c) WHERE nth <= 5""")
def four_cases(spark, sf):
    return metrics.first_of_each_case(scored_pairs(spark, sf), "vec_id", 0.4).select("case", "vec_id", "claimed_identity", "score", "nth")


@query(_FOLDS + " SELECT test_person, CASE WHEN accuracy >= 0.9 THEN 'high' WHEN accuracy >= 0.7 THEN 'middle' ELSE 'low' END AS band FROM m")
def accuracy_bands(spark, sf):
    a = F.col("accuracy")
    return fold_metrics(scored_pairs(spark, sf)).select("test_person", F.when(a >= 0.9, "high").when(a >= 0.7, "middle").otherwise("low").alias("band"))


# --- names, files, plans of work ---------------------------------------------------------------------------------------

#: What names of videos end in, each of the event that it is made from.
ENDINGS = ("_F1", "_F_hflip", "_F1_dark_up", "", "_front", "_S_Aug1", "_side", "_S2")
_NAMES = f"n AS (SELECT DISTINCT 'P' || user_id || CASE WHEN event_id % 5 = 0 THEN '_Q' ELSE '' END || {list(ENDINGS)}[event_id % 8 + 1] AS name FROM events)"
_VIEWS = "('" + "', '".join(names.VIEWS) + "')"
_PARTS = f"WITH {_NAMES}, p AS (SELECT name, string_split(name, '_') AS w FROM n)"


def _nth(choices, n: str) -> Column:
    """The choice that column n picks, in turn."""
    return F.element_at(F.array(*map(F.lit, choices)), (F.col(n) % len(choices) + 1).cast("int"))


def _names(spark, sf) -> DataFrame:
    """Names of videos: user, a second part for every fifth event, and an ending."""
    person = F.concat(F.lit("P"), "user_id", F.when(F.col("event_id") % 5 == 0, "_Q").otherwise(""))
    return table(spark, sf, "events").select(F.concat(person, _nth(ENDINGS, "event_id")).alias("name")).distinct()


@query(_PARTS + f" SELECT name, CASE WHEN len(w) >= 2 AND w[-1] IN {_VIEWS} THEN array_to_string(w[1 : len(w) - 1], '_') WHEN len(w) >= 3 AND w[-2] IN {_VIEWS} THEN array_to_string(w[1 : len(w) - 2], '_') ELSE w[1] END AS identity FROM p")
def parse_identity_a(spark, sf):
    return _names(spark, sf).select("name", names.identity_a(F.col("name")).alias("identity"))


@query(_PARTS + " SELECT name, regexp_replace(name, '_[^_]*$', '') AS identity FROM p")
def parse_identity_b(spark, sf):
    return _names(spark, sf).select("name", names.identity_b(F.col("name")).alias("identity"))


@query(_PARTS + " SELECT name, w[1] AS identity, coalesce(w[2], 'unknown') AS view, len(w) > 2 AS is_augmented FROM p")
def parse_identity_c(spark, sf):
    return _names(spark, sf).select("name", names.identity_c(F.col("name")).alias("c")).select("name", "c.*")


@query("""WITH n AS (SELECT DISTINCT 'P' || user_id || '_body_P' || (event_id % 20) || CASE WHEN event_id % 3 = 0 THEN '_R' ELSE '' END || '_face' AS name FROM events)
    SELECT name, string_split(name, '_body_')[1] AS body, replace(string_split(name, '_body_')[2], '_face', '') AS face FROM n""")
def parse_swapped(spark, sf):
    face = F.concat(F.lit("_body_P"), (F.col("event_id") % 20).cast("string"), F.when(F.col("event_id") % 3 == 0, "_R").otherwise(""), F.lit("_face"))
    swapped = table(spark, sf, "events").select(F.concat(F.lit("P"), "user_id", face).alias("name")).distinct()
    return swapped.select("name", names.swapped_names(F.col("name")).alias("c")).select("name", "c.*")


@query(_PARTS + " SELECT name FROM p WHERE len(w) = 2 AND regexp_matches(w[2], '^[FS][1-3]$')")
def originals_only(spark, sf):
    return _names(spark, sf).where(names.is_original(F.col("name"), "view"))


@query(_PARTS + " SELECT name, len(w) <= 2 AS by_parts, len(w) = 2 AND w[2] IN ('F1', 'F2', 'F3', 'S1', 'S2', 'S3') AS by_view, NOT contains(lower(name), '_aug') AS by_mark FROM p")
def originals_by_rule(spark, sf):
    return _names(spark, sf).select("name", *[names.is_original(F.col("name"), rule).alias(f"by_{rule}") for rule in ("parts", "view", "mark")])


#: Views of clips, each of the event that it is made from.
CLIP_VIEWS = ("S1", "F2", "S2", "X", "F1", "F3", "Y")
ORDER = lookup.ORDERS["original"]


@query(f"""WITH n AS (SELECT user_id || '-' || event_id // 40 AS identity, {list(CLIP_VIEWS)}[event_id % 7 + 1] AS view, 'c' || event_id AS path FROM events), k AS (SELECT *, list_position({list(ORDER)}, view) AS rank FROM n)
    SELECT identity, arg_min(path, (rank, path)) AS path FROM k WHERE rank > 0 GROUP BY identity""")
def preferred_view(spark, sf):
    """Each user's clips of forty events: the one that the order of views prefers."""
    group = F.concat_ws("-", "user_id", F.floor(F.col("event_id") / 40).cast("string"))
    clips = table(spark, sf, "events").select(group.alias("identity"), _nth(CLIP_VIEWS, "event_id").alias("view"), F.concat(F.lit("c"), "event_id").alias("path"))
    return lookup.preferred(clips, ORDER)


@query("""WITH n AS (SELECT 'm/checkpoint_epoch_' || event_id || CASE WHEN event_id % 7 = 3 THEN '_best' ELSE '' END || '.pth' AS path FROM events), k AS (SELECT path, regexp_extract(path, 'epoch_([0-9]+)_best', 1) AS e FROM n)
    SELECT arg_max(path, e::INT) AS path, max(e::INT) AS epoch FROM k WHERE e <> ''""")
def latest_checkpoint(spark, sf):
    best = F.when(F.col("event_id") % 7 == 3, "_best").otherwise("")
    return files.latest_best(table(spark, sf, "events").select(F.concat(F.lit("m/checkpoint_epoch_"), "event_id", best, F.lit(".pth")).alias("path")))


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) + 0e0 AS total FROM events GROUP BY user_id")
def extraction_log(spark, sf):
    """Sums of each user's events by an extraction that was stopped after one batch and went on."""
    events, path = table(spark, sf, "events").select("user_id", "value"), shared_path(spark, "extraction")
    users = events.select("user_id").distinct()
    work = lambda own: own.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    extraction.extract(users, "user_id", work, path, most=1, rows=events)
    extraction.extract(users, "user_id", work, path, batch=500, rows=events, at_once=8)
    return extraction.extracted(spark, path).select("user_id", "n", (F.round("total", 4) + F.lit(0.0)).alias("total"))


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90)")
def incremental_antijoin(spark, sf):
    e = table(spark, sf, "events")
    return files.new_rows(e, e.where("event_type = 'purchase' and value > 90"), "user_id").select("event_id", "user_id")


# --- history ---------------------------------------------------------------------------------------------------------------

#: A run is a user; its epochs are the user's events in order of time.
_HISTORY = f"{q.SERIES}, h AS (SELECT user_id::VARCHAR AS run, (frame_idx + 1)::INT AS epoch, value AS v FROM s)"


def _history(spark, sf) -> DataFrame:
    return series(spark, sf).select(F.col("user_id").cast("string").alias("run"), (F.col("frame_idx") + 1).cast("int").alias("epoch"), F.col("value").alias("v"))


@query(f"WITH {_HISTORY} SELECT run, epoch, v > coalesce(max(v) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS is_best FROM h")
def best_so_far(spark, sf):
    return history.best_so_far(_history(spark, sf), "v").select("run", "epoch", "is_best")


@query(f"""WITH RECURSIVE {_HISTORY}, f AS (SELECT run, 0 AS epoch, NULL::DOUBLE AS best, 0 AS bad, NULL::INT AS stop FROM h GROUP BY run
        UNION ALL SELECT f.run, h.epoch, CASE WHEN f.stop IS NULL AND (best IS NULL OR v > best + 0.001) THEN v ELSE best END, CASE WHEN f.stop IS NOT NULL THEN bad WHEN best IS NULL OR v > best + 0.001 THEN 0 ELSE bad + 1 END,
            CASE WHEN f.stop IS NOT NULL THEN f.stop WHEN NOT (best IS NULL OR v > best + 0.001) AND bad + 1 >= 3 THEN h.epoch END FROM f JOIN h ON h.run = f.run AND h.epoch = f.epoch + 1)
    SELECT run, max(stop) AS stop_epoch, arg_max(best, epoch) AS best FROM f GROUP BY run""")
def early_stopping(spark, sf):
    return history.early_stop(_history(spark, sf), "v", 3)


@query(f"""WITH RECURSIVE {_HISTORY}, f AS (SELECT run, 0 AS epoch, '-inf'::DOUBLE AS best, 0 AS bad, 0.001::DOUBLE AS lr FROM h GROUP BY run
        UNION ALL SELECT run, epoch, CASE WHEN better THEN v ELSE best END, CASE WHEN cut THEN 0 ELSE nb END, CASE WHEN cut THEN greatest(lr * 0.5, 0.00001) ELSE lr END
        FROM (SELECT *, nb > 1 AS cut FROM (SELECT h.run, h.epoch, v, best, lr, v > CASE WHEN isinf(best) THEN best ELSE best + 1e-4 * abs(best) END AS better, CASE WHEN v > CASE WHEN isinf(best) THEN best ELSE best + 1e-4 * abs(best) END THEN 0 ELSE bad + 1 END AS nb
              FROM f JOIN h ON h.run = f.run AND h.epoch = f.epoch + 1)))
    SELECT run, epoch, round(lr, 9) AS lr FROM f WHERE epoch > 0""")
def plateau_lr(spark, sf):
    return history.plateau_rates(_history(spark, sf), "v", 0.001, 1).select("run", "epoch", F.round("lr", 9).alias("lr"))


# --- losses, encodings -------------------------------------------------------------------------------------------------


@query(f"""WITH {q.SCORED}, {_RING}, a AS (SELECT x.vec_id, x.e AS a, y.sig AS p, z.sig AS n FROM v x JOIN rg USING (identity) JOIN sig y ON y.claimed_identity = x.identity JOIN sig z ON z.claimed_identity = next_identity),
    u AS (SELECT vec_id, list_transform(a, lambda x: x / sqrt(list_dot_product(a, a))) AS a, list_transform(p, lambda x: x / sqrt(list_dot_product(p, p))) AS p, list_transform(n, lambda x: x / sqrt(list_dot_product(n, n))) AS n FROM a)
    SELECT vec_id, {q.r('greatest(0, list_sum(list_transform(range(1, 65), lambda i: (a[i] - p[i]) ** 2)) - list_sum(list_transform(range(1, 65), lambda i: (a[i] - n[i]) ** 2)) + 1)')} AS loss FROM u""")
def triplet_loss(spark, sf):
    v = vectors(spark, sf)
    s = signatures(v).select("identity", "sig")
    both = v.join(s.withColumnRenamed("sig", "p"), "identity").join(enroll.next_in_ring(s.select("identity")), "identity")
    both = both.join(s.select(F.col("identity").alias("next_identity"), F.col("sig").alias("n")), "next_identity")
    return both.select("vec_id", r6(geo.triplet_loss(F.col("e"), F.col("p"), F.col("n"), 64)).alias("loss"))


@query(f"""WITH {q.SCORED}, d AS (SELECT vec_id, claimed_identity, identity = claimed_identity AS same, list_sum(list_transform(range(1, 65), lambda i: (e[i] - sig[i]) ** 2)) AS d2 FROM v, sig)
    SELECT same, {q.r('avg(CASE WHEN same THEN d2 ELSE greatest(0, 2 - sqrt(d2)) ** 2 END)')} AS loss, {q.r('avg(sqrt(d2))')} AS mean_distance FROM d GROUP BY same""")
def contrastive_loss(spark, sf):
    from ..sources.surrogate import BROADCAST_SIGNATURES, small

    v = vectors(spark, sf)
    p = v.crossJoin(small(signatures(v).select(F.col("identity").alias("other"), "sig"), BROADCAST_SIGNATURES))
    e, s, same = F.col("e"), F.col("sig"), F.col("identity") == F.col("other")
    d = F.sqrt(geo.total((e[i] - s[i]) * (e[i] - s[i]) for i in range(64)))
    return p.select(same.alias("same"), geo.contrastive_loss(e, s, same, 64).alias("l"), d.alias("d")).groupBy("same").agg(r6(F.avg("l")).alias("loss"), r6(F.avg("d")).alias("mean_distance"))


@query(f"""WITH {q.PF}, w AS (SELECT *, exp(e[1] - max(e[1]) OVER p) AS w FROM pf WINDOW p AS (PARTITION BY video_id)) SELECT video_id, i AS dim, {q.r('sum(w * e[i + 1]) / sum(w)')} AS value FROM w, range(63) AS t(i) GROUP BY video_id, i""")
def attention_pool(spark, sf):
    """Frames of a video averaged by softmax weights (of the first coordinate, as an identity projection)."""
    f = pose_frames(spark, sf).select("video_id", features.flat(F.col("lm"), 21).alias("v"))
    f = f.withColumn("w", F.exp(F.col("v")[0] - F.max(F.col("v")[0]).over(Window.partitionBy("video_id"))))
    g = f.groupBy("video_id").agg(*[(F.sum(F.col("w") * F.col("v")[i]) / F.sum("w")).alias(f"d{i}") for i in range(63)])
    g = g.select("video_id", F.posexplode(F.array(*[F.col(f"d{i}") for i in range(63)])).alias("dim", "value"))
    return g.select("video_id", F.col("dim").cast("long").alias("dim"), r6("value").alias("value"))


@query(f"""WITH {q.PF} SELECT video_id, frame_idx, d AS dim, {q.r('e[d + 1] + CASE WHEN d % 2 = 0 THEN sin(frame_idx * exp(-(d // 2 * 2) * ln(10000e0) / 64)) ELSE cos(frame_idx * exp(-(d // 2 * 2) * ln(10000e0) / 64)) END')} AS value FROM pf, range(63) AS b(d)""")
def positional_encoding(spark, sf):
    """Frames with the encoding of their places added: sines in even dimensions, cosines in odd ones."""
    f = pose_frames(spark, sf).select("video_id", "frame_idx", F.posexplode(features.flat(F.col("lm"), 21)).alias("dim", "v"))
    at = F.col("frame_idx") * F.exp(-(F.floor(F.col("dim") / 2) * 2) * F.log(F.lit(10000.0)) / 64)
    return f.select("video_id", "frame_idx", F.col("dim").cast("long").alias("dim"), r6(F.col("v") + F.when(F.col("dim") % 2 == 0, F.sin(at)).otherwise(F.cos(at))).alias("value"))


# --- attribution -----------------------------------------------------------------------------------------------------------

_ATTRIBUTION = f"""WITH {q.FEATURES}, a AS (SELECT video_id AS sample_id, frame_idx, i AS dim, abs(feat[i + 1]) AS value FROM ff, range(78) AS t(i)),
    j AS (SELECT joint, avg(v) AS v FROM (SELECT sample_id, CASE WHEN dim < 36 THEN dim // 3 ELSE (dim - 42) // 3 END AS joint, sum(value) AS v FROM a WHERE dim < 36 OR dim >= 42 GROUP BY ALL) GROUP BY joint)"""


def attributions(spark, sf) -> DataFrame:
    """Sizes of features, in place of gradients."""
    f = features.feature_frames(pose_frames(spark, sf)).select(F.col("video_id").alias("sample_id"), "frame_idx", F.posexplode("feat").alias("dim", "v"))
    return f.select("sample_id", "frame_idx", "dim", F.abs("v").alias("value"))


@query(_ATTRIBUTION + f", g AS (SELECT CASE WHEN dim < 36 THEN 'coords' WHEN dim < 42 THEN 'angles' ELSE 'velocities' END AS feature_group, sum(value) AS t FROM a GROUP BY 1) SELECT feature_group, {q.r('t / sum(t) OVER ()')} AS share FROM g")
def attribution_rollup(spark, sf):
    return attribution.group_shares(attributions(spark, sf)).select("feature_group", r6("share").alias("share"))


@query(_ATTRIBUTION + f" SELECT joint::INT AS joint, {q.r('v / max(v) OVER ()')} AS importance, row_number() OVER (ORDER BY round(v, 6) DESC, joint)::INT AS rank FROM j")
def rank_joints(spark, sf):
    return attribution.joint_importance(attributions(spark, sf)).select("joint", r6("importance").alias("importance"), "rank")


@query(_ATTRIBUTION + f" SELECT joint::INT AS joint, {q.r('coalesce((v - min(v) OVER ()) / nullif(max(v) OVER () - min(v) OVER (), 0), 0.5)')} AS scaled FROM j")
def importance_minmax(spark, sf):
    return attribution.min_max(attribution.joint_importance(attributions(spark, sf)), "importance").select("joint", r6("scaled").alias("scaled"))


@query(_ATTRIBUTION + f", t AS (SELECT sample_id, frame_idx, sum(value) AS v FROM a GROUP BY ALL) SELECT sample_id, frame_idx, {q.r('v / max(v) OVER (PARTITION BY sample_id)')} AS weight FROM t")
def attribution_temporal(spark, sf):
    return attribution.temporal(attributions(spark, sf)).select("sample_id", F.col("frame_idx").cast("long").alias("frame_idx"), r6("weight").alias("weight"))


@query(f"WITH {q.PF}, v AS (SELECT DISTINCT identity, video_id FROM pf), n AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY video_id) AS nth FROM v) SELECT identity, video_id FROM n WHERE nth <= greatest(1, 25 // (SELECT count(DISTINCT identity) FROM v)) ORDER BY nth, identity LIMIT 25")
def n_per_person(spark, sf):
    return attribution.few_per_person(pose_frames(spark, sf).select("identity", "video_id").distinct(), 25).select("identity", "video_id")


@query(f"""WITH {q.PF}, b AS (SELECT video_id, frame_idx, greatest((0.45 * abs(e[1] - e[4]) * 640)::DOUBLE, 30) AS r0, trunc(e[37] * 640)::INT AS cx, trunc(e[38] * 480)::INT AS cy FROM pf), c AS (SELECT *, trunc(r0)::INT AS r FROM b)
    SELECT video_id, frame_idx, greatest(0, least(640, cx - r)) AS "left", greatest(0, least(480, trunc((cy - r * 1.3)::DOUBLE)::INT)) AS top, greatest(0, least(640, cx + r)) AS "right", greatest(0, least(480, trunc((cy + r * 0.5)::DOUBLE)::INT)) AS bottom FROM c""")
def face_box(spark, sf):
    lm = F.col("lm")
    return pose_frames(spark, sf).select("video_id", "frame_idx", geo.face_box(lm, lm[12], 640, 480).alias("b")).select("video_id", "frame_idx", "b.*")


# --- model ---------------------------------------------------------------------------------------------------------------


def _videos(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs, pooled videos, pooled signatures."""
    videos = features.pooled(features.feature_frames(pose_frames(spark, sf)))
    sig = signatures(videos.select("identity", F.col("feat").alias("e")), 78).select("identity", "sig")
    pairs = enroll.enrolled_pairs(videos.select(F.col("video_id").alias("key"), F.col("identity").alias("true_identity")), videos.select("identity").distinct())
    return pairs, videos, sig


@query()
def train_verifier(spark, sf):
    rows = train.pair_features(*_videos(spark, sf))
    return train.score(train.fit(rows), rows).select("key", "claimed_identity", "label", r6("score").alias("score"))


@query()
def loocv_train(spark, sf):
    """Every person's probes by a fit without them, all folds from one pass."""
    rows = written(train.pair_features(*_videos(spark, sf)), "pair-features")
    return folds.leave_one_out(rows, 234).select("test_person", "key", "claimed_identity", "label", r6("score").alias("score"))


@query()
def ablation_grid(spark, sf):
    """Outcomes by parts of the features, all variants from one pass."""
    c = metrics.rates(metrics.counts(_variants(spark, sf), F.col("score") > 0.5, "variant"))
    return c.select("variant", "tp", "fp", "tn", "fn", r6("accuracy").alias("accuracy"), r6("f1").alias("f1"))


def _variants(spark, sf) -> DataFrame:
    columns = {name: [78 * k + i for k in range(3) for i in dims] for name, dims in train.VARIANTS.items()}
    return folds.variants(written(train.pair_features(*_videos(spark, sf)), "pair-features"), 234, columns)


def _head_pairs(spark, sf) -> DataFrame:
    """pair_id, identity, label, video, claimed: each video with its own person's mean sequence and with another's."""
    f = features.feature_frames(pose_frames(spark, sf))
    whole = lambda df, key: df.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "feat"))), lambda x: x["feat"])).alias("seq"))  # noqa: E731  60 frames a key
    videos = whole(f.select("video_id", "frame_idx", "feat"), "video_id").select(F.col("video_id").alias("key"), F.col("seq").alias("video"))
    people = whole(enroll.frame_signatures(f, "feat", 78).select("identity", "frame_idx", F.col("sig").alias("feat")), "identity").select(F.col("identity").alias("claimed_identity"), F.col("seq").alias("claimed"))
    # who claims whom only needs names, not frames
    named = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("true_identity"), F.concat_ws("_", "label", F.col("vec_id") % 3).alias("key")).distinct()
    pairs = enroll.enrolled_pairs(named, named.select(F.col("true_identity").alias("identity")).distinct())
    pairs = pairs.join(videos, "key").join(people, "claimed_identity")
    return pairs.select(F.concat_ws("|", "key", "claimed_identity").alias("pair_id"), F.col("true_identity").alias("identity"), "label", "video", "claimed")


@query()
def head_forward(spark, sf):
    """Scores of genuine and of false claims."""
    return head.score_pairs(_head_pairs(spark, sf), head.initial_weights())


@query()
def head_training(spark, sf):
    """Loss and accuracy by epoch, of a head that is fit on four people of five."""
    pairs = _head_pairs(spark, sf)
    parts = enroll.split_people(pairs.select("identity").distinct(), CONFIG.train_share, CONFIG.seed)
    pairs = written(pairs.join(parts, "identity"), "split-pairs")
    fit = descent.fit_head(pairs.where("part = 'train'"), pairs.where("part = 'validation'"), 6, config=CONFIG)
    return descent.curve(spark, fit).select("run", "epoch", *[r6(c).alias(c) for c in ("train_loss", "train_accuracy", "val_loss", "val_accuracy")], "lr")


def _gradients(spark, sf) -> DataFrame:
    return gradients.attribute(_head_pairs(spark, sf), head.initial_weights())


@query()
def input_attribution(spark, sf):
    """Size of each input times the slope of the predicted class's logit by it."""
    return _gradients(spark, sf).select("sample_id", "frame_idx", "dim", r6("value").alias("value"))


@query()
def gradient_rank_joints(spark, sf):
    return attribution.joint_importance(_gradients(spark, sf)).select("joint", r6("importance").alias("importance"), "rank")


@query()
def gradient_rollup(spark, sf):
    return attribution.group_shares(_gradients(spark, sf)).select("feature_group", r6("share").alias("share"))


@query()
def gradient_temporal(spark, sf):
    return attribution.temporal(_gradients(spark, sf)).select("sample_id", "frame_idx", r6("weight").alias("weight"))


# --- reports and plot data -------------------------------------------------------------------------------------------------


@query(f"WITH {q.SCORED}, {q.CURVE} SELECT score AS threshold, {q.r('tp / (tp + fp)::DOUBLE')} AS precision, {q.r('tp / n_pos::DOUBLE')} AS recall FROM t")
def pr_curve(spark, sf):
    t = metrics.running_totals(scored_pairs(spark, sf))
    return t.select(F.col("score").alias("threshold"), r6(F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), r6(F.col("tp") / F.col("n_pos")).alias("recall"))


@query(f"WITH {q.LABELS} SELECT {q.r('avg(label)')} AS positive_share, count(*) AS n FROM sp")
def pr_baseline(spark, sf):
    return label_scores(spark, sf).agg(r6(F.avg("label")).alias("positive_share"), F.count("*").alias("n"))


@query(f"WITH {q.SCORED} SELECT {q.r('avg(score)')} AS overall, {q.r('avg(score) FILTER (label = 1)')} AS authentic, {q.r('avg(score) FILTER (label = 0)')} AS fake FROM sp")
def mean_similarity(spark, sf):
    s, y = F.col("score"), F.col("label")
    return scored_pairs(spark, sf).agg(r6(F.avg(s)).alias("overall"), r6(F.avg(F.when(y == 1, s))).alias("authentic"), r6(F.avg(F.when(y == 0, s))).alias("fake"))


@query(f"SELECT user_id, event_type, {q.r('sum(value * event_id) / sum(event_id)')} AS weighted_mean FROM events GROUP BY ALL HAVING sum(event_id) <> 0")
def running_weighted_mean(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.sum(F.col("value") * F.col("event_id")).alias("s"), F.sum("event_id").alias("w"))
    return g.where("w <> 0").select("user_id", "event_type", r6(F.col("s") / F.col("w")).alias("weighted_mean"))


@query(f"""WITH {q.SERIES} SELECT event_id, round(sum(value * (event_id % 7)) OVER w / nullif(sum(event_id % 7) OVER w, 0)::DOUBLE, 9) + 0e0 AS mean FROM s
    WINDOW w AS (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_mean(spark, sf):
    """The weighted mean of each user's events up to every one."""
    h = series(spark, sf).withColumn("weight", F.col("event_id") % 7)
    return history.running_mean(h, "user_id", ["frame_idx"], "value", "weight").select("event_id", (F.round("mean", 9) + F.lit(0.0)).alias("mean"))


@query(_FOLDS + f" SELECT arg_max(test_person, (accuracy, test_person)) AS best, {q.r('max(accuracy) - avg(accuracy)')} AS over_mean FROM m")
def best_variant(spark, sf):
    return fold_metrics(scored_pairs(spark, sf)).agg(F.max_by("test_person", F.struct("accuracy", "test_person")).alias("best"), r6(F.max("accuracy") - F.avg("accuracy")).alias("over_mean"))


@query(_FOLDS + " SELECT test_person, unnest(['accuracy', 'f1', 'auc']) AS name, unnest([accuracy, f1, auc]) AS value FROM m")
def metrics_long(spark, sf):
    return fold_metrics(scored_pairs(spark, sf)).select("test_person", F.expr("stack(3, 'accuracy', accuracy, 'f1', f1, 'auc', auc) as (name, value)"))


@query(_FOLDS + " SELECT format('{:<8} {:>8.2f} {:>8.2f} {:>6d}', test_person, 100 * accuracy, 100 * f1, n_samples) AS line FROM m")
def report_table(spark, sf):
    return fold_metrics(scored_pairs(spark, sf)).select(F.format_string("%-8s %8.2f %8.2f %6d", "test_person", 100 * F.col("accuracy"), 100 * F.col("f1"), "n_samples").alias("line"))


@query("SELECT event_type, count(*) AS total, count(*) FILTER (value > 10) AS succeeded, count(*) - count(*) FILTER (value > 10) AS failed, count(DISTINCT user_id) AS videos FROM events GROUP BY event_type")
def extraction_totals(spark, sf):
    ok = F.coalesce(F.sum(F.when(F.col("value") > 10, 1)), F.lit(0)).cast("long")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("total"), ok.alias("succeeded"), (F.count("*") - ok).alias("failed"), F.count_distinct("user_id").alias("videos"))


@query("SELECT label::VARCHAR AS identity, count(DISTINCT len(embedding)) AS shapes, max(len(embedding))::INT AS size FROM embeddings GROUP BY label")
def shape_consistency(spark, sf):
    return vectors(spark, sf).groupBy("identity").agg(F.count_distinct(F.size("e")).alias("shapes"), F.max(F.size("e")).alias("size"))


@query(f"WITH {q.SCORED} SELECT identity, {q.r('sqrt(sum(list_dot_product(e, e)))')} AS norm FROM v GROUP BY identity")
def global_norm(spark, sf):
    return vectors(spark, sf).groupBy("identity").agg(r6(F.sqrt(F.sum(geo.dot(F.col("e"), F.col("e"), 64)))).alias("norm"))


@query("""WITH n AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'v/' ELSE 'w/' END || 'P' || user_id || '_' || event_id % 9 || CASE WHEN event_id % 3 = 1 THEN '_hflip' ELSE '' END || '.mp4' AS path FROM events)
    SELECT regexp_replace(regexp_replace(path, '^.*/', ''), '[.][^.]*$', '') AS stem, min(path) AS path FROM n GROUP BY 1""")
def union_roots(spark, sf):
    """Videos of both roots, one of each stem: originals are copied among the augmented ones."""
    e = table(spark, sf, "events").withColumn("name", F.concat(F.lit("P"), "user_id", F.lit("_"), (F.col("event_id") % 9).cast("string")))
    path = lambda root, kind: F.concat(F.lit(root), "name", F.lit(kind + ".mp4")).alias("path")
    originals = e.where("event_id % 3 = 0").select(path("v/", ""))
    augmented = e.where("event_id % 3 = 1").select(path("w/", "_hflip")).unionByName(e.where("event_id % 3 = 2").select(path("w/", "")))
    return lookup.one_of_each(originals.unionByName(augmented))


@query(f"WITH {q.PF} SELECT video_id, arg_max(frame_idx, (round(abs(e[1] - e[4]) * abs(e[38] - e[2]), 9), -frame_idx)) AS frame_idx FROM pf GROUP BY video_id")
def largest_face(spark, sf):
    lm = F.col("lm")
    area = F.round(F.abs(lm[0]["x"] - lm[1]["x"]) * F.abs(lm[12]["y"] - lm[0]["y"]), 9)
    return pose_frames(spark, sf).groupBy("video_id").agg(F.max_by("frame_idx", F.struct(area.alias("a"), (-F.col("frame_idx")).alias("f"))).alias("frame_idx"))


@query(f"WITH {q.SERIES}, at8 AS ({_placed(8)}) SELECT at8.user_id, i, a.event_id, {q.r('100 * p / at8.n::DOUBLE')} AS cycle_percent, {q.r('p / 30e0')} AS seconds FROM at8 JOIN s a ON a.user_id = at8.user_id AND a.frame_idx = p")
def display_frames(spark, sf):
    f = sequence.sample_uniform(sequence.with_length(series(spark, sf), "user_id").withColumnRenamed("n", "frames"), "user_id", 8)
    return f.select("user_id", F.col("i").cast("long").alias("i"), "event_id", r6(100 * F.col("frame_idx") / F.col("frames")).alias("cycle_percent"), r6(F.col("frame_idx") / 30.0).alias("seconds"))


# videos that end in _2 stand for augmented ones; coordinates and angles
@query(f"""WITH {q.PF}, o AS (SELECT identity, video_id, frame_idx, list_concat(e[1:36], {q.angles()}) AS v FROM pf WHERE video_id NOT LIKE '%_2')
    SELECT identity, frame_idx, i AS dim, {q.r('avg(v[i + 1])')} AS value, count(DISTINCT video_id) AS num_videos FROM o, range(42) AS t(i) GROUP BY identity, frame_idx, i""")
def enroll_originals(spark, sf):
    f = pose_frames(spark, sf).where("video_id not like '%_2'")
    f = f.select("identity", "video_id", "frame_idx", F.concat(features.flat(F.col("lm")), geo.joint_angles(F.col("lm"))).alias("v"))
    return signature_values(enroll.frame_signatures(f, "v", 42))


@query("SELECT vec_id, label::VARCHAR AS identity FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 50)")
def enrolled_only(spark, sf):
    v = vectors(spark, sf).select("vec_id", "identity")
    return v.join(v.groupBy("identity").count().where("count >= 50"), "identity", "left_semi").select("vec_id", "identity")


@query(_PRESERVATION.replace(_TORSO, _TORSO.replace("ca[19]", "ca[7]").replace("ca[20]", "ca[8]").replace("ca[21]", "ca[9]").replace("ca[22]", "ca[10]").replace("ca[23]", "ca[11]").replace("ca[24]", "ca[12]")) + f" SELECT pair_id, {q.r('pck_score')} AS pck_score FROM v")
def pck_by_torso(spark, sf):
    return preserve.preservation(preservation_pairs(spark, sf), "shoulder_hip").select("pair_id", r6("pck_score").alias("pck_score"))


@query(f"WITH {q.SCORED} SELECT vec_id, claimed_identity, {q.r('(list_dot_product(e, sig) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(sig, sig)) + 1e-8) + 1) / 2')} AS similarity FROM v, sig WHERE identity = claimed_identity")
def unit_similarity(spark, sf):
    v = vectors(spark, sf)
    s = signatures(v).select("identity", "sig")
    return v.join(s, "identity").select("vec_id", F.col("identity").alias("claimed_identity"), r6((geo.cosine(F.col("e"), F.col("sig"), 64) + 1) / 2).alias("similarity"))


@query(f"""WITH {q.SCORED}, u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS a, list_transform(sig, lambda x: x / sqrt(list_dot_product(sig, sig))) AS b FROM v JOIN sig ON identity = claimed_identity)
    SELECT vec_id, {q.r('sqrt(list_sum(list_transform(range(1, 65), lambda i: (a[i] - b[i]) ** 2)) + 1e-8)')} AS distance FROM u""")
def unit_distance(spark, sf):
    """Distance of each vector's direction to that of its person's signature."""
    v = vectors(spark, sf)
    return v.join(signatures(v).select("identity", "sig"), "identity").select("vec_id", r6(geo.euclidean(F.col("e"), F.col("sig"), 64)).alias("distance"))


@query(f"""WITH {q.SCORED}, m AS (SELECT vec_id, max(score) FILTER (label = 1) * 5 AS a, max(score) FILTER (label = 0) * 5 AS b FROM sp GROUP BY vec_id)
    SELECT vec_id, {q.r('exp(a - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b)))')} AS p_authentic, {q.r('greatest(exp(a - greatest(a, b)), exp(b - greatest(a, b))) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b)))')} AS confidence FROM m""")
def softmax_confidence(spark, sf):
    g = scored_pairs(spark, sf).groupBy("vec_id").agg(F.array(F.max(F.when(F.col("label") == 0, F.col("score"))) * 5, F.max(F.when(F.col("label") == 1, F.col("score"))) * 5).alias("z"))
    return g.withColumn("p", geo.softmax(F.col("z"), 2)).select("vec_id", r6(F.col("p")[1]).alias("p_authentic"), r6(F.array_max("p")).alias("confidence"))


@query()
def embedding_plane(spark, sf):
    """Two principal components of the pooled features, in place of a neighbour embedding."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = features.pooled(features.feature_frames(pose_frames(spark, sf))).withColumn("x", array_to_vector("feat"))
    out = PCA(k=2, inputCol="x", outputCol="y").fit(v).transform(v).withColumn("y", vector_to_array("y"))
    return out.select("video_id", "identity", r6(F.col("y")[0]).alias("y0"), r6(F.col("y")[1]).alias("y1"))


@query()
def ablation_scores(spark, sf):
    return _variants(spark, sf).select("variant", "key", "claimed_identity", "label", r6("score").alias("score"))


# --- reports, lookups and claims --------------------------------------------------------------------------------------------


# nine decimals: at the sixth a quotient may lie half-way, where engines round differently
@query(f"""WITH {q.SERIES}, c AS (SELECT DISTINCT user_id, n, 5 + n % 50 AS k FROM s), at_ AS (SELECT user_id, n, k, unnest(range(k)) AS i FROM c), p AS (SELECT *, (i * (n - 1)) // (k - 1) AS p FROM at_)
    SELECT p.user_id, i, round(a.value + (coalesce(b.value, a.value) - a.value) * ((i * (p.n - 1) - p * (k - 1)) / (k - 1)::DOUBLE), 9) AS value
    FROM p JOIN s a ON a.user_id = p.user_id AND a.frame_idx = p LEFT JOIN s b ON b.user_id = p.user_id AND b.frame_idx = p + 1""")
def resample_to_length(spark, sf):
    s = sequence.with_length(series(spark, sf), "user_id").withColumn("wanted", 5 + F.col("n") % 50).drop("n")
    return sequence.resample_to(s, "user_id", "value", "wanted").select("user_id", F.col("i").cast("long").alias("i"), F.round("value", 9).alias("value"))


@query(f"""SELECT event_type, count(*) AS total, count(*) FILTER (value > 10) AS succeeded, count(*) - count(*) FILTER (value > 10) AS failed, {q.r('sum(value) / count(*)')} AS seconds_per_video,
    count(DISTINCT user_id) AS sources, {q.r('count(*) / count(DISTINCT user_id)::DOUBLE')} AS expansion FROM events GROUP BY event_type""")
def run_totals(spark, sf):
    t = summary.run_totals(table(spark, sf, "events"), F.col("value") > 10, F.col("value"), F.col("user_id"), "event_type")
    return t.withColumns({c: r6(c) for c in ("seconds_per_video", "expansion")})


@query("SELECT event_id, user_id FROM events WHERE coalesce(value <= 10, true) ORDER BY event_id LIMIT 10")
def first_failures(spark, sf):
    return summary.first_failures(table(spark, sf, "events"), F.col("value") > 10, "event_id").select("event_id", "user_id")


@query(f"""WITH {q.LABELS}, c AS (SELECT label::INT AS label, (score > 0.5)::INT AS predicted, count(*) AS n FROM sp GROUP BY ALL), b AS (SELECT * FROM (VALUES (0), (1)) AS x(label), (VALUES (0), (1)) AS y(predicted)),
    f AS (SELECT label, predicted, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (label, predicted))
    SELECT label, predicted, n, {q.r('coalesce(100e0 * n / nullif(sum(n) OVER (PARTITION BY label), 0), 0)')} AS row_percent, {q.r('coalesce(100e0 * n / nullif(sum(n) OVER (), 0), 0)')} AS total_percent FROM f""")
def confusion_percent(spark, sf):
    c = summary.confusion_rows(metrics.counts(label_scores(spark, sf), F.col("score") > 0.5))
    return c.select("label", "predicted", "n", r6("row_percent").alias("row_percent"), r6("total_percent").alias("total_percent"))


@query(f"""WITH {q.SCORED}, g AS (SELECT true_identity AS person, score, sum(label) AS pos, sum(1 - label) AS neg FROM sp GROUP BY ALL),
    t AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg, sum(pos) OVER p AS n_pos, sum(neg) OVER p AS n_neg FROM g WINDOW w AS (PARTITION BY person ORDER BY score DESC), p AS (PARTITION BY person)),
    roc AS (SELECT person, score AS threshold, tp / n_pos::DOUBLE AS tpr, fp / n_neg::DOUBLE AS fpr FROM t WHERE next_pos IS NULL OR pos <> next_pos OR neg <> next_neg UNION ALL SELECT DISTINCT person, 'inf'::DOUBLE, 0e0, 0e0 FROM t),
    e AS (SELECT person AS test_person, arg_min((fpr + 1 - tpr) / 2, (round(abs(fpr - (1 - tpr)), 12), -threshold)) AS eer FROM roc GROUP BY person)
    SELECT test_person, {q.r('eer')} AS eer, CASE WHEN eer > 0.15 THEN 'high' WHEN eer > 0.1 THEN 'middle' ELSE 'low' END AS band FROM e""")
def eer_bands(spark, sf):
    e = metrics.eer(scored_pairs(spark, sf), ["true_identity"])
    return e.select(F.col("true_identity").alias("test_person"), r6("eer").alias("eer"), summary.error_band(F.col("eer")).alias("band"))


@query(_FOLDS + f" SELECT test_person AS variant, accuracy, {q.r("accuracy - (SELECT max(accuracy) FROM m WHERE test_person = '0')")} AS delta FROM m")
def delta_to_full(spark, sf):
    """Folds stand for variants, the one named 0 for the full one."""
    v = fold_metrics(scored_pairs(spark, sf)).select(F.col("test_person").alias("variant"), "accuracy")
    return summary.against_full(v, "0").select("variant", "accuracy", r6("delta").alias("delta"))


@query(f"""WITH {q.SCORED}, {_RING}, a AS (SELECT x.e AS a, y.sig AS p, z.sig AS n FROM v x JOIN rg USING (identity) JOIN sig y ON y.claimed_identity = x.identity JOIN sig z ON z.claimed_identity = next_identity),
    d AS (SELECT 2 - 2 * list_dot_product(a, p) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(p, p))) AS dp, 2 - 2 * list_dot_product(a, n) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(n, n))) AS dn FROM a)
    SELECT count(*) AS n, {q.r('avg(greatest(0, dp - dn + 1))')} AS loss, {q.r('avg((dp + 1 > dn)::INT)')} AS violations, {q.r('avg(dp)')} AS mean_positive, {q.r('avg(dn)')} AS mean_negative FROM d""")
def triplet_metrics(spark, sf):
    v = vectors(spark, sf)
    s = signatures(v).select("identity", "sig")
    both = v.join(s.withColumnRenamed("sig", "p"), "identity").join(enroll.next_in_ring(s.select("identity")), "identity")
    both = both.join(s.select(F.col("identity").alias("next_identity"), F.col("sig").alias("n")), "next_identity")
    t = summary.triplet_metrics(both, F.col("e"), F.col("p"), F.col("n"), 64)
    return t.select("n", *[r6(c).alias(c) for c in ("loss", "violations", "mean_positive", "mean_negative")])


# each person's body with the next one's face; views are the last parts of the videos' names
@query(f"""WITH {q.PF}, v AS (SELECT DISTINCT identity FROM pf), {_RING}, o AS (SELECT identity, arg_min(video_id, (coalesce(list_position(['9', '1'], split_part(video_id, '_', 2)), 3), video_id)) AS path FROM pf GROUP BY identity)
    SELECT rg.identity || '_body_' || next_identity || '_face' AS name, rg.identity AS body, next_identity AS face, path FROM rg JOIN o USING (identity)""")
def swapped_originals(spark, sf):
    clips = pose_frames(spark, sf).select("identity", F.substring_index("video_id", "_", -1).alias("view"), F.col("video_id").alias("path")).distinct()
    ring = enroll.next_in_ring(clips.select("identity").distinct())
    swapped = ring.select(F.concat("identity", F.lit("_body_"), "next_identity", F.lit("_face")).alias("name"))
    return lookup.with_originals(swapped, clips, ("9", "1"), any_last=True)


@query(f"""WITH {q.SCORED}, {_RING} SELECT v.vec_id AS key, sp.claimed_identity, {q.r('score')} AS score, score > 0.4 AS is_authentic
    FROM v JOIN rg USING (identity) JOIN sp ON sp.vec_id = v.vec_id AND sp.claimed_identity = CASE WHEN v.vec_id % 2 = 0 THEN v.identity ELSE next_identity END""")
def claims_verified(spark, sf):
    v = vectors(spark, sf)
    s = signatures(v).select("identity", "sig")
    claim = F.when(F.col("vec_id") % 2 == 0, F.col("identity")).otherwise(F.col("next_identity"))
    claims = v.join(enroll.next_in_ring(s.select("identity")), "identity").select(F.col("vec_id").alias("key"), claim.alias("claimed_identity"), "e")
    return verify.verify_claims(claims, s, 64, 0.4).select("key", "claimed_identity", r6(F.round("score", 9)).alias("score"), "is_authentic")


# --- tables of text, checks of a write, scalars, plot data ------------------------------------------------------------------

_OVERALL = {"accuracy": "Accuracy (%)", "precision": "Precision (%)", "recall": "Recall (%)", "f1": "F1 Score (%)", "auc": "ROC-AUC (%)"}
_TITLES = {"tp": "True Positive (TP)", "tn": "True Negative (TN)", "fp": "False Positive (FP)", "fn": "False Negative (FN)"}
_FIXED = lambda x, k: f"printf('%.{k}f', round({x}, {k}))"
_CELL = lambda x, width: f"lpad({_FIXED(f'100 * ({x})', 2)} || '%', {width}, ' ')"


@query(_FOLDS + " SELECT place::INT AS place, line FROM (" + " UNION ALL ".join(f"SELECT {i} AS place, printf('%-30s %-20s ', '{t}', {_FIXED(f'100 * avg({c})', 2)}) || rpad('± ' || {_FIXED(f'100 * stddev_pop({c})', 2)}, 15, ' ') AS line FROM m" for i, (c, t) in enumerate(_OVERALL.items()))
    + f" UNION ALL SELECT {len(_OVERALL)}, printf('%-30s %-20s ', 'Number of Folds', count(*)::VARCHAR) || rpad('—', 15, ' ') FROM m)")
def report_overall(spark, sf):
    return summary.overall_table(fold_metrics(scored_pairs(spark, sf)), _OVERALL)


@query(f"WITH {q.LABELS}, {q.CONFUSION.replace('0.7737', '0.5')}, w AS (SELECT *, tp + tn + fp + fn AS total FROM c) SELECT place::INT AS place, line FROM ("
    + " UNION ALL ".join(f"SELECT {i} AS place, printf('%-25s %-10d %s', '{t}', {k}, {_FIXED(f'100e0 * {k} / total', 1)} || '%') AS line FROM w" for i, (k, t) in enumerate(_TITLES.items()))
    + " UNION ALL SELECT 4, printf('%-25s %-10d %s', 'TOTAL', total, '100.0%') FROM w)")
def report_outcomes(spark, sf):
    return summary.outcome_table(metrics.counts(label_scores(spark, sf), F.col("score") > 0.5), _TITLES)


_FOLD_VALUES = ["accuracy", "f1", "precision", "recall", "auc"]


@query(_FOLDS + " SELECT 0 AS part, test_person AS name, concat_ws(' ', rpad(test_person, 12, ' '), " + ", ".join(_CELL(c, 10) for c in _FOLD_VALUES) + ", lpad(n_samples::VARCHAR, 5, ' ')) AS line FROM m"
    + "".join(f" UNION ALL SELECT {p}, '{t}', concat_ws(' ', rpad('{t}', 12, ' '), " + ", ".join(_CELL(f"{f}({c})", 10) for c in _FOLD_VALUES) + ", '     ') FROM m" for p, t, f in ((1, "MEAN", "avg"), (2, "STD", "stddev_pop"))))
def report_folds(spark, sf):
    return summary.fold_table(fold_metrics(scored_pairs(spark, sf)), "test_person", _FOLD_VALUES, "n_samples")


@query()
def report_variants(spark, sf):
    """A line for each variant of the features; SQL cannot fit them."""
    sizes = {name: 3 * len(dims) for name, dims in train.VARIANTS.items()}
    c = metrics.rates(metrics.counts(_variants(spark, sf), F.col("score") > 0.5, "variant"))
    size = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("variant"))
    return summary.variant_table(c.withColumn("inputs", size), "variant", "inputs", ["accuracy", "f1", "precision", "recall"])


@query(_ATTRIBUTION + f", g AS (SELECT CASE WHEN dim < 36 THEN 'coords' WHEN dim < 42 THEN 'angles' ELSE 'velocities' END AS name, sum(value) AS t FROM a GROUP BY 1), sh AS (SELECT name, t / sum(t) OVER () AS share FROM g) SELECT joint::VARCHAR AS name, rpad(joint::VARCHAR, 20, ' ') || ' ' || lpad({_FIXED('v / max(v) OVER ()', 4)}, 12, ' ') AS line FROM j UNION ALL SELECT name, rpad(name, 20, ' ') || ' ' || lpad({_FIXED('100 * share', 1)} || '%', 12, ' ') FROM sh")
def report_importance(spark, sf):
    a = attributions(spark, sf)
    return summary.importance_table(attribution.joint_importance(a), "joint", "importance").unionByName(summary.importance_table(attribution.group_shares(a), "feature_group", "share", True))


# the box of the upper landmarks stands for a face; every fifth person shows none
@query(f"""WITH {q.PF}, n AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM pf), a AS (SELECT identity, video_id, frame_idx, n, CASE WHEN identity::INT % 5 = 4 THEN 0 ELSE round(abs(e[1] - e[4]) * abs(e[38] - e[2]), 9) END AS area FROM n WHERE n >= 10),
    k AS (SELECT DISTINCT video_id, n, i, least(n - 1, floor(CASE WHEN i = 19 THEN n * 0.9e0 ELSE n * 0.1e0 + i * ((n * 0.9e0 - n * 0.1e0) / 19e0) END))::INT AS spot FROM a, range(20) AS t(i)),
    b AS (SELECT a.video_id, max(area) AS area, arg_min(frame_idx, (-area, frame_idx)) AS f FROM a JOIN k ON k.video_id = a.video_id AND spot = frame_idx WHERE area > 0 GROUP BY 1)
    SELECT a.video_id, coalesce(f, a.n // 2)::INT AS frame_idx, {q.r('b.area')} AS area FROM a LEFT JOIN b USING (video_id) WHERE a.frame_idx = 0""")
def best_face_frame(spark, sf):
    lm = F.col("lm")
    area = F.round(F.abs(lm[0]["x"] - lm[1]["x"]) * F.abs(lm[12]["y"] - lm[0]["y"]), 9)
    seen = F.when(F.col("identity").cast("int") % 5 == 4, 0.0).otherwise(area)
    return sequence.best_frames(pose_frames(spark, sf), "video_id", seen).select("video_id", "frame_idx", r6("area").alias("area"))


@query(f"""WITH {q.FEATURES}, c AS (SELECT count(*) AS rows_, count(DISTINCT video_id) AS videos, max(frame_idx) AS last, count(*) FILTER (feat IS NULL) AS nulls, count(*) FILTER (len(feat) <> 78) AS other_sizes, sum(len(list_filter(feat, lambda x: x IS NULL OR isnan(x)))) AS null_numbers FROM ff)
    SELECT 'write' AS run, 0 AS epoch, unnest(['rows', 'videos', 'last', 'nulls', 'other_sizes', 'null_numbers', 'complete']) AS name, unnest([rows_, videos, last, nulls, other_sizes, null_numbers, (rows_ = 60 * videos)::INT])::DOUBLE AS value FROM c""")
def write_checks(spark, sf):
    """What is observed while the feature frames are written, as scalars of the run."""
    frames = features.feature_frames(pose_frames(spark, sf))
    seen = run_log.write_checked(frames, shared_path(spark, "feature-frames"), run_log.frame_checks("video_id", "feat", 60, 78))
    log = shared_path(spark, "run-log")
    run_log.append_scalars(spark, log, "write", 0, run_log.frame_summary(seen, 60))
    return spark.read.schema(run_log.SCALARS).parquet(log)


@query(f"""WITH {q.SERIES} SELECT user_id::VARCHAR AS run, frame_idx::INT AS epoch, unnest(['value', 'best']) AS name, unnest([value, max(value) OVER w]) AS value FROM s
    WINDOW w AS (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def run_scalars(spark, sf):
    so_far = Window.partitionBy("user_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    h = series(spark, sf).withColumn("best", F.max("value").over(so_far))
    return run_log.scalars(h, "user_id", "frame_idx", {"value": "value", "best": "best"})


@query(f"""WITH {q.PF}, g AS (SELECT video_id, frame_idx, {q.angles()} AS g FROM pf) SELECT video_id, frame_idx, {q.r('frame_idx / 30e0')} AS seconds, a AS angle, {q.r('g[a + 1]')} AS degrees FROM g, range(6) AS t(a)""")
def angle_series(spark, sf):
    """Angles over time, long form."""
    g = pose_frames(spark, sf).select("video_id", "frame_idx", F.posexplode(geo.joint_angles(F.col("lm"))).alias("angle", "degrees"))
    return g.select("video_id", "frame_idx", r6(F.col("frame_idx") / 30.0).alias("seconds"), F.col("angle").cast("long").alias("angle"), r6("degrees").alias("degrees"))


@query(_FOLDS + f" SELECT test_person, rank() OVER (ORDER BY accuracy DESC, test_person)::INT AS place, accuracy, {q.r('accuracy - avg(accuracy) OVER ()')} AS over_mean, CASE WHEN accuracy >= 0.9 THEN 'high' WHEN accuracy >= 0.7 THEN 'middle' ELSE 'low' END AS band FROM m")
def fold_bars(spark, sf):
    """Accuracies by fold in order, with what they lie over the mean."""
    m = fold_metrics(scored_pairs(spark, sf)).select("test_person", "accuracy")
    return summary.bars(m, "test_person", "accuracy").withColumn("over_mean", r6("over_mean"))
