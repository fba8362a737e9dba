"""A corpus pipeline: quality, exact copies, near copies, benchmark leaks, and SentencePiece ids of what stays.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the shared folder and read
again as the next one's docs. All but the last return the columns of docs, unchanged and whatever their names.

Defined cases, for every stage: a null text is empty; rows with null or repeated ids are rows like others, told apart by
their text; of rows that repeat in id and text the stages of copies keep one (the least as JSON text), the others treat all
alike; very long texts are read whole; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.llm.common import shared_dir, table
from stridelake.llm.decontaminate import MIN_WORDS, decontaminate
from stridelake.llm.exact_dedup import drop_copies
from stridelake.llm.near_copies import drop_similar
from stridelake.llm.quality_crf import keep_good, train
from stridelake.llm.queries import tokenizer_path
from stridelake.llm.sentencepiece_scan import encode


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model, fit on labels that are not held out, scores 0.5 or more; empty texts are scored too."""
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal without blanks: the longest, then the smallest doc_id (null last)."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id (null last) of each component of five-word-shingle similarity 0.8 or more.

    Found by SimHash with deletion variants on wide fingerprints; texts without words are equal to each other.
    """
    return drop_similar(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item; those without words stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), spaced_from=MIN_WORDS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces and the digest of the text that the ids decode to: one row per row; empty texts have no ids."""
    model = tokenizer_path("piece_bpe_32k.model")
    back = encode(docs, model, back=True)
    return back.select("doc_id", "ids", F.size("ids").alias("n_pieces"), F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", leaks), ("sentencepiece", pieces)]

#: The quality model is fit, which SQL cannot express; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
