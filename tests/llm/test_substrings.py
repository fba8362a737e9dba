"""Substring dedup against brute force over all windows."""

import hashlib
import random
import re

import numpy as np
import pytest
from data import edge_docs, frame
from pyspark.sql import functions as F

from stridelake.llm import recompression, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(docs, window):
    words = [WORD.findall(t or "") for _, t in docs]
    size = lambda i: (1 << 63) - 1 if i is None else i
    least = {}
    for (i, _), w in zip(docs, words):
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            least[k] = min(least.get(k, size(i)), size(i))
    out = []
    for (i, _), w in zip(docs, words):
        gone = set()
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < size(i):
                gone.update(range(p, p + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(repr, out))


def hard_docs(seed):
    """Passages, shifted periods and runs over small alphabets, in documents of all lengths."""
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh" if k % 2 else "ab") for _ in range(rng.randint(5, 120))] for k in range(8)]
    docs = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 5)):
            kind = rng.randrange(4)
            if kind == 0:
                p = rng.choice(passages)
                a = rng.randrange(len(p))
                w += p[a : a + rng.randint(1, 120)]
            elif kind == 1:
                w += [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(1, 40))]
            elif kind == 2:
                w += [rng.choice("ab")] * rng.randint(1, 150)
            else:
                unit = [rng.choice("abc") for _ in range(rng.randint(2, 4))]
                w += unit * rng.randint(1, 40)
        docs.append((rng.randrange(50) if i % 9 else None, " ".join(w)))
    return docs


@pytest.mark.parametrize("window", [2, 7, 24, 50, 120])
def test_against_all_windows(spark, window):
    docs = hard_docs(window) + [(i, t) for i, t, *_ in edge_docs()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(repr(tuple(r)) for r in substring_dedup.substring_digests(df, window).collect())
    assert got == by_hand(docs, window)


def test_edges_and_texts(spark):
    docs = [(i, t) for i, t, *_ in edge_docs()]
    rows = substring_dedup.substring_dedup(frame(spark)).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in rows) == by_hand(docs, 50)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in rows)
    assert next(r.kept_text for r in rows if r.doc_id == 10).startswith("shared0 ") is False or next(r.n_removed for r in rows if r.doc_id == 10) == 0
    assert substring_dedup.substring_digests(frame(spark, [])).count() == 0


def test_equal_windows_have_equal_keys():
    rng = np.random.default_rng(0)
    for alphabet in (2, 5, 10**6):
        block = rng.integers(0, alphabet, 200)
        parts = [np.r_[rng.integers(0, alphabet, rng.integers(0, 30)), block, rng.integers(0, alphabet, rng.integers(0, 30))] for _ in range(6)]
        hashes = recompression.mix(np.concatenate(parts).astype(np.uint64))
        own, p, n, key, _ = recompression.window_runs(hashes, np.array(list(map(len, parts))), 50)
        keys = {}
        for o, a, c, k in zip(own, p, n, key):
            for q in range(a, a + c):
                keys.setdefault(tuple(parts[o][q : q + 50]), set()).add(int(k))
        assert {len(v) for v in keys.values()} == {1}
        assert n.sum() == sum(len(x) - 49 for x in parts)


def test_words_are_cut_alike_in_blocks():
    data = np.frombuffer(b" a  bb\tccc\x0b\n d" * 7, np.uint8)
    whole = recompression.word_spans(data)
    for block in (1, 2, 3, 5, 16):
        assert all((a == b).all() for a, b in zip(whole, recompression.word_spans(data, block)))
    assert all(len(x) == 0 for x in recompression.word_spans(data[:0]))


def test_equal_keys_without_equal_words_remove_nothing(spark, monkeypatch):
    """All windows named alike: the digests of words still tell them apart."""
    docs = hard_docs(3)
    df = spark.createDataFrame(docs, "doc_id long, text string")

    def one_name(texts, window):
        real = runs(texts, window)
        return real.selectExpr("d", "row", "p", "n", "key % 3 as key", "content % 5 as content")

    runs = substring_dedup.runs
    monkeypatch.setattr(substring_dedup, "runs", one_name)
    rows = {r.doc_id: r for r in substring_dedup.substring_digests(df, 7).collect() if r.doc_id is not None}
    want = {}
    for line in by_hand(docs, 7):
        i, _, removed, _ = eval(line)
        want.setdefault(i, []).append(removed)
    assert all(r.n_removed <= max(want[i]) for i, r in rows.items())


def test_rows_without_id_whose_keys_collide(spark, monkeypatch):
    passage = " ".join(f"a{k}" for k in range(60))
    docs = [(1, passage), (None, "x " * 20 + passage + " y" * 21), (None, " ".join(f"b{k}" for k in range(101)))]
    texts = substring_dedup._texts
    monkeypatch.setattr(substring_dedup, "_texts", lambda docs: texts(docs).withColumn("row", F.lit(7).cast("long")))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(repr(tuple(r)) for r in substring_dedup.substring_digests(df).collect())
    assert got == by_hand(docs, 50)


def test_long_texts_and_hot_passages(spark, monkeypatch):
    """A text of many pieces, its copy at another place, and one passage that most documents hold."""
    rng = random.Random(11)
    hot = " ".join(f"h{k}" for k in range(70))
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(40_000))
    docs = [(5, long), (9, "some words before " + long[5000:] + " and after"), (2, hot + " " + " ".join(long.split()[777:900]))]
    docs += [(100 + k, f"u{k} " * 3 + hot + f" v{k}") for k in range(300)] + [(7, hot)] * 50
    monkeypatch.setattr(substring_dedup, "PIECE", 10_000)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(repr(tuple(r)) for r in substring_dedup.substring_digests(df).collect())
    assert got == by_hand(docs, 50)


def test_one_giant_text(spark):
    rng = np.random.default_rng(2)
    words = [f"word{x}" for x in range(50_000)]
    giant = " ".join(words[i] for i in rng.integers(0, 50_000, 3_400_000))
    assert len(giant) > 30_000_000
    docs = [(2, giant), (1, " ".join(giant[10_000_000:10_002_000].split()[1:-1]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.substring_digests(df).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == got[1].n_words and got[2].n_words == 3_400_000
    kept = giant.split()
    at = next(i for i in range(len(kept)) if kept[i : i + 5] == docs[1][1].split()[:5])
    del kept[at : at + got[1].n_words]
    assert hashlib.sha256(" ".join(kept).encode()).hexdigest() == got[2].kept_sha256
