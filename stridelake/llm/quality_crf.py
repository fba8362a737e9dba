"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of kinds of characters, repeated and distinct words and word lengths of
the line, the same of its neighbouring lines, and a bias; a 2 x 2 table scores the labels of adjacent lines. A document's
score is the mean, weighted by line length, of its lines' forward-backward marginals of being good.

The model is fit here, on a bounded sample: the SAMPLE_ROWS labelled documents of each class with the smallest hash of
doc_id, of each a stretch of SAMPLE_LINES lines at a place that its hash picks, which take their document's label. Only
their features and labels reach the driver: at most 2 * SAMPLE_ROWS * SAMPLE_LINES lines (43 MB as numbers of 4 bytes).

Defined cases: a null or empty text is one empty line; null labels are not learned from; an id with several labels counts
as good if one of them is; of several rows with a labelled id the one with the least text hash is learned from; with labels
of one class or none every score is the mean label (0.5 without labels); scores do not depend on ids, so null or repeated
ids and rows are scored alike; very long texts are scored whole, SCORED characters of texts at a time or one text; an empty
table gives no rows; extra columns are ignored by quality and kept unchanged by keep_good, whatever their names.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded

#: Bounds of the training sample: labelled documents of each class, and lines of each.
SAMPLE_ROWS, SAMPLE_LINES = 1500, 256
#: Characters of texts whose lines are held at once.
SCORED = 1 << 20
ROUNDS, RATE, RIDGE = 200, 0.1, 1e-3

_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_MARKS, _SHOUT, _BAR, _POINT = b"*$%&#@^~<>{}[]\\=+_`", b"!?", b"|\t", b".,;:'\"-()"
KINDS = (_UPPER, _LOWER, _DIGIT, _MARKS, _SHOUT, _BAR, _POINT)
N_OWN = len(KINDS) + 7


def line_features(line: str) -> list[float]:
    raw = line.encode("utf-8", "surrogatepass")
    n, words = len(raw) or 1, line.split()
    shares = [1 - len(raw.translate(None, k)) / n if raw else 0.0 for k in KINDS]
    m = len(words) or 1
    repeats = sum(map(operator.eq, words, words[1:])) / m
    distinct = len(set(words)) / m if m > 20 else 1.0
    # shares of rare kinds are stretched, so that a few per cent already count
    stretch = lambda x: min(1.0, 5 * x)
    return [shares[0], shares[1], stretch(shares[2]), stretch(shares[3]), stretch(shares[4]), stretch(shares[5]), shares[6], repeats, max(0.0, repeats - 0.3), 1 - distinct, min(1.0, len(line) / m / 20), min(1.0, len(words) / 50), float(not words), stretch(max(0.0, shares[0] - 0.1))]


def document_lines(text: str) -> tuple[list[list[float]], list[int]]:
    lines = text.split("\n")
    return [line_features(x) for x in lines], [len(x) + 1 for x in lines]


def design(own, sizes):
    """Own, mean neighbouring features and bias of all lines of some documents with `sizes` lines each."""
    import numpy as np

    own = np.asarray(own, np.float64).reshape(-1, N_OWN)
    first = np.zeros(len(own), bool)
    first[np.cumsum(sizes) - sizes] = True
    last = np.r_[first[1:], True] if len(first) else first
    before = np.where(first[:, None], 0, np.roll(own, 1, axis=0))
    after = np.where(last[:, None], 0, np.roll(own, -1, axis=0))
    return np.hstack([own, (before + after) / 2, np.ones((len(own), 1))])


def marginals(emission, sizes, table):
    """alpha and beta (log odds of good against bad) of every line; their sum is the log odds of its marginal."""
    import numpy as np

    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    starts, lengths = starts[order], sizes[order]
    alpha, beta = emission.copy(), np.zeros_like(emission)
    longest = int(lengths[0]) if len(lengths) else 0
    running = np.searchsorted(-lengths, -np.arange(longest + 1), side="right")  # documents with at least t lines
    for t in range(1, longest):
        at = starts[: running[t + 1]] + t
        a = alpha[at - 1]
        alpha[at] += np.logaddexp(table[0, 1], a + table[1, 1]) - np.logaddexp(table[0, 0], a + table[1, 0])
    for t in range(longest - 2, -1, -1):
        at = starts[: running[t + 2]] + t
        b = emission[at + 1] + beta[at + 1]
        beta[at] = np.logaddexp(table[1, 0], table[1, 1] + b) - np.logaddexp(table[0, 0], table[0, 1] + b)
    return alpha, beta


@dataclass
class LineCrf:
    weights: list[float]
    table: list[list[float]]
    constant: float | None = None

    def scores(self, texts: list[str]) -> list[float]:
        import numpy as np

        if self.constant is not None:
            return [self.constant] * len(texts)
        own, lengths, sizes = [], [], []
        for t in texts:
            f, n = document_lines(t)
            own += f
            lengths += n
            sizes.append(len(n))
        sizes, lengths = np.array(sizes, np.int64), np.array(lengths, np.float64)
        alpha, beta = marginals(design(own, sizes) @ np.array(self.weights), sizes, np.array(self.table))
        good = 1 / (1 + np.exp(-np.clip(alpha + beta, -500, 500)))
        starts = np.cumsum(sizes) - sizes
        return (np.add.reduceat(good * lengths, starts) / np.add.reduceat(lengths, starts)).tolist() if len(texts) else []


def gradient(x, y, w, sizes, theta, table):
    """Gradient of the weighted conditional log likelihood by feature weights and by the table of adjacent labels."""
    import numpy as np

    starts = np.cumsum(sizes) - sizes
    last = np.zeros(len(x), bool)
    last[starts + sizes - 1] = True
    pairs = np.flatnonzero(~last)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[pairs], y[pairs + 1]), w[pairs])
    e = x @ theta
    alpha, beta = marginals(e, sizes, table)
    good = 1 / (1 + np.exp(-np.clip(alpha + beta, -500, 500)))
    a, b = alpha[pairs], e[pairs + 1] + beta[pairs + 1]
    joint = np.stack([np.full_like(a, table[0, 0]), table[0, 1] + b, a + table[1, 0], a + table[1, 1] + b])
    joint = np.exp(joint - joint.max(axis=0))
    joint /= joint.sum(axis=0)
    return x.T @ (w * (y - good)), seen - (joint @ w[pairs]).reshape(2, 2)


def fit(samples: list) -> LineCrf:
    """Weights of the largest class-balanced conditional likelihood with a ridge, by adaptive gradient steps.

    samples: (features of the lines, label) of each document.
    """
    import numpy as np

    labels = np.array([y for _, y in samples], np.int64)
    if len(set(labels.tolist())) < 2:
        return LineCrf([], [], float(labels.mean()) if len(labels) else 0.5)
    sizes = np.array([len(x) for x, _ in samples], np.int64)
    x = design(np.concatenate([np.asarray(own, np.float64).reshape(-1, N_OWN) for own, _ in samples]), sizes)
    # a document weighs the same whatever its lines, and a class the same whatever its documents
    share = 1 / (2 * np.bincount(labels)[labels] * sizes)
    y, w = np.repeat(labels, sizes), np.repeat(share, sizes)
    theta, table = np.zeros(x.shape[1]), np.zeros((2, 2))
    moments = [np.zeros(theta.size + 4), np.zeros(theta.size + 4)]
    for k in range(1, ROUNDS + 1):
        by_weight, by_table = gradient(x, y, w, sizes, theta, table)
        g = np.r_[by_weight, by_table.ravel()] - RIDGE * np.r_[theta, table.ravel()]
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.999 * moments[1] + 0.001 * g * g
        step = RATE * moments[0] / (1 - 0.9**k) / (np.sqrt(moments[1] / (1 - 0.999**k)) + 1e-9)
        theta, table = theta + step[:-4], table + step[-4:].reshape(2, 2)
    return LineCrf(theta.tolist(), table.tolist())


def held_out(doc_id: str) -> Column:
    """Whether the row of this id is kept from training: crc32 of its decimal text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_lines: int = SAMPLE_LINES) -> DataFrame:
    """doc_id, label, own (features of at most sample_lines lines, as bytes of 4-byte numbers): one row a sampled document."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    usable = usable.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = usable.where("label = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).union(usable.where("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))

    def features(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            own = []
            for text, place in zip(batch.column("text").to_pylist(), batch.column("place").to_pylist()):
                lines = (text or "").split("\n")
                a = place % (len(lines) - sample_lines + 1) if len(lines) > sample_lines else 0
                own.append(np.array([line_features(x) for x in lines[a : a + sample_lines]], np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(own, pa.binary())], names=["doc_id", "label", "own"])

    # the sample has at most 2 * sample_rows ids, so its broadcast and what comes back are bounded by that parameter
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("row"))
    placed = one.select("doc_id", "label", "row.text", F.pmod("row.hash", F.lit(1 << 31)).alias("place"))
    return placed.mapInArrow(features, "doc_id long, label int, own binary")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_lines: int = SAMPLE_LINES) -> LineCrf:
    """Fit on at most sample_rows labelled documents of each class, none of them held out."""
    import numpy as np

    found = sorted(tuple(r) for r in sample(docs, labels, sample_rows, sample_lines).collect())
    return fit([(np.frombuffer(own, np.float32).reshape(-1, N_OWN), label) for _, label, own in found])


def _portions(texts: list[str]):
    """Ranges of texts of about SCORED characters."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > SCORED:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def score(docs: DataFrame, model: LineCrf) -> DataFrame:
    """doc_id, score of every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            got = [s for a, b in _portions(texts) for s in model.scores(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.float64())], names=["doc_id", "score"])

    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: LineCrf, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score reaches the threshold; all columns kept, no shuffle."""
    at = docs.columns.index("text")
    plain = bounded(docs).toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names of any characters

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            got = [s >= threshold for a, b in _portions(texts) for s in model.scores(texts[a:b])]
            yield batch.filter(pa.array(got, pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
