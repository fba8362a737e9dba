"""Decontamination against a search of every diagonal, without seeds."""

from itertools import combinations

import numpy as np
from pyspark.sql import SparkSession

from stridelake.llm import decontaminate, queries


def best_by_hand(words, item):
    best = 0
    for diagonal in range(-len(item) + 1, len(words)):
        run = 0
        for j, w in enumerate(item):
            if 0 <= diagonal + j < len(words):
                run = max(0, run + (1 if words[diagonal + j] == w else -2))
                best = max(best, run)
    return best


def test_six_of_eight_places_hold_a_mask():
    for equal in combinations(range(8), 6):
        assert any({at + i for i, c in enumerate(m) if c == "1"} <= set(equal) for m in decontaminate.MASKS for at in range(9 - len(m)))


def test_frequent_seeds_miss_no_overlap(spark):
    """Items and documents of few words, so that every seed is shared by many; a small bound makes most of them frequent."""
    rng = np.random.default_rng(12)
    say = lambda n: [f"v{x}" for x in rng.integers(0, 3, n)]
    items, docs = [say(n) for n in (5, 6, 7, 8, 9, 12, 20)], [say(n) for n in (3, 5, 8, 20, 60)] + [["v1"] * 40]
    want = {(d, i): s for d, w in enumerate(docs) for i, item in enumerate(items) if (s := best_by_hand(w, item)) >= min(decontaminate.MIN_SCORE, len(item))}
    frames = (spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(x)], f"{n} long, text string") for x, n in ((docs, "doc_id"), (items, "item_id")))
    docs, items = frames
    for shared in (0, 1, 3):
        got = decontaminate.contaminated(docs, items, spaced_from=decontaminate.MIN_WORDS, shared=shared).collect()
        assert {(r.doc_id, r.item_id): r.score for r in got} == want and want


def test_query_finds_every_overlap(spark: SparkSession, tmp_path):
    rng = np.random.default_rng(11)
    say = lambda n: [f"v{x}" for x in rng.integers(0, 3000, n)]
    items = [say(n) for n in (5, 7, 8, 9, 10, 11, 12, 12, 15, 15, 30, 59, 80)]
    docs = []
    for words in items:
        n = len(words)
        changes = [{0}, {n - 1}, {n - 2}, {n // 2}, set(range(3, n, 4)), set(range(2, n, 3))]
        changes += [set(rng.choice(n, k, replace=False).tolist()) for k in (1, 2, 3, 4) for _ in range(4) if k < n]
        docs += [say(20) + ["z" if j in change else w for j, w in enumerate(words)] + say(20) for change in changes]
        docs += [say(20) + words[:k] + say(20) for k in range(6, min(n, 12))]
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {(d, i): s for d, w in enumerate(docs) for i, item in enumerate(items) if (s := best_by_hand(w, item)) >= min(decontaminate.MIN_SCORE, len(item))}
    got = {(r.doc_id, r.item_id): r.score for r in queries.op3_benchmark_decontamination(spark, str(tmp_path)).collect()}
    assert got == want and len(want) > 100
