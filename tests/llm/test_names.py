"""Columns of the input whose names helpers might take, and long, hot rows, through every operator and stage."""

import random

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from stridelake.llm import common, decontaminate, exact_dedup, licenses, near_copies, quality_crf, sentencepiece_scan, simhash, substring_dedup, token_counts, token_records, warc

SF = "/root/testdata/sf0.001"
NAMES = ("_key", "_row", "_copies", "_doc_id", "_text_key", "_leaked", "text_key", "spans", "key", "Key_", "row", "own", "own_id", "own_key", "keep", "by_id", "by_key", "leaked", "copies", "nth", "node", "n", "segments", "hash", "label", "place", "words", "pos", "seed", "mask", "lines", "hits", "d", "p", "gone", "uid", "k", "start", "size", "fp", "sha", "sha1", "cp", "at", "file", "offset", "score", "first", "struct<x>", "a.b")
BPE, PIECES = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def documents(spark):
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "words", "of", "prose"]) + str(rng.randrange(50)) for _ in range(25_000))
    texts = ["The first text is plain prose, of one line. " * 4, "A second text\nhas two lines. " * 5, None, "", long, long, long + " end", "hot row"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, "hot row")] * 40 + [(None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.concat(F.lit(f"{c} of "), F.coalesce("doc_id", F.lit(-1))).alias(c) for c in NAMES])


def unchanged(df, got):
    assert got.columns == df.columns
    rows = got.collect()
    for r in rows:
        assert tuple(r)[2:] == tuple(f"{c} of {-1 if r.doc_id is None else r.doc_id}" for c in NAMES)
    return sorted((-1 if r.doc_id is None else r.doc_id) for r in rows)


def test_stages_keep_all_columns(spark):
    df = documents(spark)
    labels = spark.createDataFrame([(0, 1), (1, 1), (5, 0)], "doc_id long, quality int")
    model = quality_crf.train(df, labels)
    assert len(unchanged(df, quality_crf.keep_good(df, quality_crf.LineCrf([], [], 1.0)))) == df.count()
    assert quality_crf.keep_good(df, model).columns == df.columns
    assert unchanged(df, exact_dedup.drop_copies(df)) == [0, 1, 2, 4, 6, 7]
    assert unchanged(df, near_copies.drop_similar(df)) == [0, 1, 2, 4, 7]
    items = spark.createDataFrame([(1, "a second text has two lines a second text has two lines")], "item_id long, text string")
    assert set(unchanged(df, decontaminate.decontaminate(df, items))) == {-1, 0, 2, 3, 4, 5, 6, 7}
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, df, SF).columns == df.columns


def test_operators_take_the_columns(spark):
    df = documents(spark)
    n = df.count()
    per_row = (
        token_records.token_records(df, BPE, 2),
        substring_dedup.substring_dedup(df),
        licenses.license_scan(df),
        sentencepiece_scan.encode(df, PIECES, back=True),
        quality_crf.score(df, quality_crf.LineCrf([], [], 0.5)),
        exact_dedup.exact_dedup(df),
        simhash.near_dedup(df),
        token_counts.section_tokens(df, BPE).where("section = 0"),
    )
    assert [x.count() for x in per_row] == [n] * len(per_row)
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), *[F.col(f"`{c}`") for c in NAMES])
    assert warc.warc_round(pages).count() == n
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in sentencepiece_scan.encode(df, PIECES, back=True).collect():
        assert r.text == (texts[r.doc_id] or "")


@pytest.mark.parametrize("name", ["key", "KEY", "Key_"])
def test_fresh_names(spark, name):
    got = common.fresh(spark.createDataFrame([(1,)], f"`{name}` int"), "key", "key")
    assert len({x.lower() for x in got} | {name.lower()}) == 3
