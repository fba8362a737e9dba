"""Common parts of the SQL that the queries are compared with."""

from __future__ import annotations

from ..functions.geometry import ANGLES

PF = """pf AS (SELECT label::VARCHAR AS identity, label || '_' || (vec_id % 3) AS video_id,
                      (row_number() OVER (PARTITION BY label, vec_id % 3 ORDER BY vec_id) - 1)::INT AS frame_idx, embedding::DOUBLE[] AS e FROM embeddings)"""
SERIES = "s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, value, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
SCORED = """v AS (SELECT vec_id, label::VARCHAR AS identity, embedding::DOUBLE[] AS e FROM embeddings),
    sig AS (SELECT identity AS claimed_identity, list(m ORDER BY d) AS sig FROM (SELECT identity, d, avg(e[d]) AS m FROM v, range(1, 65) AS t(d) GROUP BY ALL) GROUP BY 1),
    sp AS (SELECT vec_id, identity AS true_identity, claimed_identity, (identity = claimed_identity)::INT AS label,
                  round(list_dot_product(e, sig) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(sig, sig)) + 1e-8), 9) AS score FROM v, sig)"""
LABELS = "sp AS (SELECT doc_id, quality AS label, n_chars % 101 / 100e0 AS score FROM labels JOIN documents USING (doc_id))"
CURVE = """g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM sp GROUP BY score),
    t AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg,
                 sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg FROM g WINDOW w AS (ORDER BY score DESC))"""
ROC = """pts AS (SELECT NULL::DOUBLE AS threshold, 0 AS tp, 0 AS fp, 0e0 AS tpr, 0e0 AS fpr FROM t LIMIT 1),
    roc AS (SELECT * FROM pts UNION ALL SELECT score, tp, fp, coalesce(tp / nullif(n_pos, 0)::DOUBLE, 0), coalesce(fp / nullif(n_neg, 0)::DOUBLE, 0) FROM t)"""
CONFUSION = """c AS (SELECT count(*) FILTER (label = 1 AND p) AS tp, count(*) FILTER (label = 0 AND p) AS fp, count(*) FILTER (label = 0 AND NOT p) AS tn, count(*) FILTER (label = 1 AND NOT p) AS fn
               FROM (SELECT *, score > 0.7737 AS p FROM sp))"""


def r(x: str) -> str:
    return f"round({x}, 6) + 0e0"


def gaussian(*key: str) -> str:
    """A standard normal number for a key, as functions.draws has it."""
    digest = "md5(" + " || '|' || ".join(f"({k})::VARCHAR" for k in key) + ")"
    u = lambda nth: f"((('0x' || substr({digest}, {8 * nth + 1}, 8))::BIGINT + 0.5e0) / 4294967296e0)"
    return f"(sqrt(-2 * ln({u(0)})) * cos(2 * pi() * {u(1)}))"


def xyz(e: str, j: int, k: int) -> str:
    return f"{e}[{3 * j + k + 1}]"


def centred(e: str = "e") -> str:
    return f"list_transform(range(36), lambda i: {e}[i + 1] - ({e}[7 + i % 3] + {e}[10 + i % 3]) / 2)"


def angle(e: str, a: int, b: int, c: int) -> str:
    d = lambda p, k: f"({xyz(e, p, k)} - {xyz(e, b, k)})"
    norm = lambda p: f"sqrt({d(p, 0)} * {d(p, 0)} + {d(p, 1)} * {d(p, 1)})"
    return f"degrees(acos(greatest(-1e0, least(1e0, ({d(a, 0)} * {d(c, 0)} + {d(a, 1)} * {d(c, 1)}) / ({norm(a)} * {norm(c)} + 1e-8)))))"


def angles(e: str = "e") -> str:
    return "[" + ", ".join(angle(e, *ends) for ends in ANGLES.values()) + "]"


def step(e: str = "e") -> str:
    return f"sqrt(({e}[19] - {e}[22]) * ({e}[19] - {e}[22]) + ({e}[20] - {e}[23]) * ({e}[20] - {e}[23]))"


def symmetry(c: str) -> str:
    return "(" + " + ".join(f"abs({c}[{6 * k + 1}] + {c}[{6 * k + 4}])" for k in range(6)) + ") / 6"


#: Resampled landmarks: rs(identity, video_id, frame_idx, e), and their features ff(identity, video_id, frame_idx, feat).
RESAMPLED = (
    PF
    + """, n AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM pf),
    pl AS (SELECT DISTINCT identity, video_id, n, i, (i * (n - 1)) // 59 AS p FROM n, range(60) AS t(i)),
    rs AS (SELECT pl.identity, pl.video_id, pl.i AS frame_idx,
                  list_transform(range(36), lambda k: a.e[k + 1] + (coalesce(b.e, a.e)[k + 1] - a.e[k + 1]) * ((pl.i * (pl.n - 1) - pl.p * 59) / 59e0)) AS e
           FROM pl JOIN pf a ON a.video_id = pl.video_id AND a.frame_idx = pl.p LEFT JOIN pf b ON b.video_id = pl.video_id AND b.frame_idx = pl.p + 1)"""
)
FEATURES = (
    RESAMPLED
    + f""", fc AS (SELECT identity, video_id, frame_idx, {centred()} AS c, {angles()} AS g FROM rs),
    fl AS (SELECT *, lead(c) OVER w AS c1, lag(c) OVER w AS c0 FROM fc WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)),
    ff AS (SELECT identity, video_id, frame_idx,
                  list_concat(list_concat(c, g), list_transform(range(36), lambda k: coalesce(c1[k + 1] - c[k + 1], c[k + 1] - c0[k + 1], 0e0))) AS feat FROM fl)"""
)
