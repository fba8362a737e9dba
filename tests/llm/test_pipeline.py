"""The pipeline against its stages done by hand, and each stage on hard rows."""

import hashlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from data import edge_docs, frame
from sentencepiece import SentencePieceProcessor
from test_near_copies import kept_by_hand, similar_by_hand
from test_records import exact_by_hand
from test_scans import leaks_by_hand

from stridelake.llm import quality_crf

SF = "/root/testdata/sf0.001"


def test_against_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    model = quality_crf.train(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [r for r, s in zip(rows, model.scores([t for _, t in rows])) if s >= 0.5]
    kept = {k[0] for k in exact_by_hand(rows) if k[3]}
    rows = [r for r in rows if r[0] in kept]
    kept = kept_by_hand(sorted(d for d, _ in rows), similar_by_hand(rows))
    rows = [r for r in rows if r[0] in kept]
    gone = {d for d, _ in leaks_by_hand(rows, bench)}
    library = SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    want = {d: (library.encode(t), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows if d not in gone}
    got = {r.doc_id: (list(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and len(gone) and len(want) < docs.count()


@pytest.mark.parametrize("k", range(4))
def test_stages_take_hard_rows(spark, k):
    stage = corpus_pipeline.STAGES[k][1]
    df = frame(spark)
    got = stage(spark, df, SF)
    assert got.columns == df.columns
    ids = Counter(r.doc_id for r in got.collect())
    assert max(ids.values()) == (2 if k in (0, 3) else 1)
    if k == 1:
        assert ids == Counter(x[0] for x in exact_by_hand([(i, t) for i, t, *_ in edge_docs()]) if x[3])
    if k == 3:
        assert ids == Counter(i for i, *_ in edge_docs())
    assert stage(spark, frame(spark, []), SF).count() == 0


def test_last_stage_takes_hard_rows(spark):
    got = corpus_pipeline.STAGES[4][1](spark, frame(spark), SF).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in edge_docs())
    assert corpus_pipeline.STAGES[4][1](spark, frame(spark, []), SF).count() == 0
