"""SentencePiece encoding by parallel scan against the library, and exact round trips."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from data import edge_docs, frame
from sentencepiece import SentencePieceProcessor

from stridelake.llm import sentencepiece_scan as scan

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))
LIBRARY = SentencePieceProcessor(model_file=MODEL)


def texts(seed):
    rng = random.Random(seed)
    kinds = [
        lambda: " ".join(rng.choice(["the", "thinging", "été", "x", "日本", "1234", "a.b,c"]) for _ in range(rng.randint(1, 60))),
        lambda: "".join(rng.choice("abcdetin") for _ in range(rng.randint(1, 400))),
        lambda: " " * rng.randint(1, 70) + "word" + " " * rng.randint(0, 40),
        lambda: "".join(rng.choice(" a\n\t▁é😀\x00語tion") for _ in range(rng.randint(1, 300))),
        lambda: "a" * rng.randint(1, 300),
    ]
    return ["".join(rng.choice(kinds)() for _ in range(rng.randint(1, 4))) for _ in range(40)]


def test_merges_are_the_librarys():
    model = scan.PieceModel(MODEL)
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice("aeinrst oh,.") for _ in range(rng.randint(1, 30)))
        assert [i for p in model.merged(" " + t) for i in model.token_ids(p)] == LIBRARY.encode(t)
    for t in texts(1):
        assert list(scan.array("i", model.ids(t))) == LIBRARY.encode(t)


@pytest.mark.parametrize("chunk", [64, 100, 16384])
def test_chunks_give_the_librarys_ids(spark, chunk):
    docs = list(enumerate(texts(chunk) + [t or "" for _, t, *_ in edge_docs()]))
    docs += docs[-1:]
    got = scan.encode(spark.createDataFrame(docs, "doc_id long, text string"), MODEL, chunk).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(LIBRARY.encode(t))) for i, t in docs)


def test_product_is_associative():
    import numpy as np

    rng = np.random.default_rng(2)
    a, b, c = (np.where(rng.random((4, 4)) < 0.3, -np.inf, rng.integers(-9, 0, (4, 4))) for _ in range(3))
    assert (scan.product(scan.product(a, b), c) == scan.product(a, scan.product(b, c))).all()


def test_round_trip_and_edges(spark):
    both = scan.encode(frame(spark), MODEL, 1000, back=True).collect()
    assert Counter((r.doc_id, r.text) for r in both) == Counter((i, t or "") for i, t, *_ in edge_docs())
    got = scan.decode(scan.encode(frame(spark), MODEL), MODEL).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t or "") for i, t, *_ in edge_docs())
    assert scan.encode(frame(spark, []), MODEL).count() == 0
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in small.collect()}
    back = scan.decode(scan.encode(small, MODEL, 2000), MODEL).collect()
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in back} == want
