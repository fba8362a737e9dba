"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Words are lower-cased runs of letters, marks and digits. At each word position a fixed mask picks some of the next words
and leaves out the others; their hash is the seed, so a substituted word that falls on a left-out position does no harm.
Seeds of benchmark items and of documents are equality-joined. Each hit names a diagonal (document position minus item
position), and the overlap on it is verified word by word: the best stretch, at +1 for equal words and -2 for others,
has to reach `min_score`.

A stretch that scores 8 has, in some 8 words in a row, 6 or more that are equal (with at most 5 in each, m equal of n words
could not reach 3 m = 2 n + 8), and each choice of 6 of 8 places holds all places of one of the masks; so every overlap
that the verification accepts has a seed.

A seed that more than `shared` places of items have is too frequent to be joined alone: it goes with one more word and that
word's place, out of those next to the mask. An overlap has at least one more equal word there (two in each 8 words of
above; all words where an item is shorter than 8), so none is missed.

Hits are made distinct before they are verified, within tasks first, so each diagonal is walked once. The seeds of the
benchmark are broadcast only where their counted number is at most BROADCAST_SEEDS; those of a larger benchmark are joined
by shuffling document seeds. Documents meet their hits by id and digest again. Items of fewer than `spaced_from` words
are searched whole, as one seed of all their words; those of fewer than MIN_WORDS words are not searched. Null texts and
texts without words have no seeds; null or repeated ids give links under that id, one a document id and item, of equal
scores the first place; very long texts have seeds all over; empty tables give no rows; extra columns are ignored by
contaminated and kept unchanged by decontaminate, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, fresh, saved, small, text_key

#: Word positions that count; 4 of 4 to 6 each.
MASKS = ("1111", "11011", "110101", "110011")
MIN_WORDS, MIN_SCORE = 5, 8
#: Bound of a broadcast: about 100 MB of seeds.
BROADCAST_SEEDS = 2_000_000
#: Places of items that may have one seed, and where the further word of a more frequent one may be (an 8-word stretch that holds the mask).
SHARED, NEXT = 256, range(-4, 8)


def words_of(text) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{M}]+"), "")


def _seeds(rows: DataFrame, masks: list[str]) -> DataFrame:
    """rows' columns (with words), pos, mask (its number) and seed: of every mask that fits at every position."""
    rows = rows.where(F.size("words") > 0).select("*", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("pos"))
    picked = [
        F.when(F.col("pos") + len(m) <= F.size("words"), F.xxhash64(F.lit(k), *[F.get("words", F.col("pos") + i) for i, c in enumerate(m) if c == "1"]))
        for k, m in enumerate(masks)
    ]
    return rows.select("*", F.posexplode(F.array(*picked)).alias("mask", "seed")).where("seed is not null")


def _overlap(hits: DataFrame, min_score: int) -> DataFrame:
    """Hits with words, item_words and diagonal -> one row per document and item that overlap."""
    skip = F.greatest(F.lit(0), -F.col("diagonal"))
    size = F.least(F.size("item_words"), F.size("words") - F.col("diagonal")) - skip
    same = F.zip_with(F.slice("words", F.col("diagonal") + skip + 1, size), F.slice("item_words", skip + 1, size), lambda a, b: a == b)
    hits = hits.select("doc_id", "item_id", (F.col("diagonal") + skip).alias("at"), F.size("item_words").alias("item_size"), same.alias("same"))
    step = lambda acc, x: F.struct(
        F.greatest(F.lit(0), acc["run"] + F.when(x, 1).otherwise(-2)).alias("run"),
        F.greatest(acc["best"], acc["run"] + F.when(x, 1).otherwise(-2)).alias("best"),
        (acc["equal"] + F.when(x, 1).otherwise(0)).alias("equal"),
    )
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(0).alias("equal"))
    hits = hits.select("doc_id", "item_id", "at", "item_size", F.aggregate("same", zero, step).alias("v"))
    enough = F.col("v.best") >= F.least(F.lit(min_score), F.col("item_size"))
    return (
        hits.where(enough)
        .groupBy("doc_id", "item_id")
        .agg(F.max("v.best").alias("score"), F.max("v.equal").alias("equal_words"), F.min("at").alias("first_word"), F.max("item_size").alias("item_words"))
    )


def _frequent(seeds: DataFrame, masks: list[str], words: str, pos: str) -> DataFrame:
    """seeds with further words: their seed is a hash of seed, place and word, for every place in NEXT that is not in the mask."""
    places = F.array(*[F.array(*map(F.lit, (o for o in NEXT if not (0 <= o < len(m) and m[o] == "1")))) for m in masks])
    rows = seeds.withColumn("place", F.explode(F.get(places, F.col("mask"))))
    at = F.col(pos) + F.col("place")
    word = F.when(at >= 0, F.get(words, at))
    return rows.where(word.isNotNull()).withColumn("seed", F.xxhash64("seed", "place", word)).drop("place")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, min_score: int = MIN_SCORE, masks: tuple[str, ...] = MASKS, broadcast_seeds: int = BROADCAST_SEEDS, spaced_from: int = 12, shared: int = SHARED
) -> DataFrame:
    """doc_id, item_id, score, equal_words, first_word, item_words of each document and benchmark item that overlap.

    With spaced_from at MIN_WORDS items of every length have spaced seeds, and no overlap is missed.
    """
    items = benchmark.select(F.col("item_id").cast("long"), words_of(F.col("text")).alias("item_words")).where(F.size("item_words") >= MIN_WORDS)
    short = [r.n for r in items.select(F.size("item_words").alias("n")).where(F.col("n") < spaced_from).distinct().collect()]  # a bounded list
    usual, masks = len(masks), [*masks, *("1" * n for n in sorted(short))]
    seeds = _seeds(items.select("item_id", F.col("item_words").alias("words")), masks).withColumnsRenamed({"pos": "item_pos"}).withColumn("n", F.size("words"))
    # a solid mask is for the items of just its length, so that it adds no weaker seeds to others
    fits = (F.col("mask") < usual) & (F.col("n") >= spaced_from)
    for k, n in enumerate(sorted(short)):
        fits |= (F.col("mask") == usual + k) & (F.col("n") == n)
    seeds = saved(seeds.where(fits).select("item_id", "item_pos", "mask", "seed", F.col("words").alias("item_words")), "item-seeds")
    few = seeds.limit(broadcast_seeds + 1).count() <= broadcast_seeds
    sent = F.broadcast if few else lambda df: df
    often = saved(seeds.where(F.col("mask") < usual).groupBy("seed").agg(F.count("*").alias("held")).where(F.col("held") > shared).select("seed"), "frequent-seeds")

    key = F.xxhash64(text_key(), F.length("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = _seeds(rows.select("doc_id", key.alias("row_key"), words_of(F.col("text")).alias("words")), masks)
    hit = ("doc_id", "row_key", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal"))
    if often.isEmpty():
        found = own.join(sent(seeds.select("item_id", "item_pos", "seed")), "seed").select(*hit)
    else:
        frequent = _frequent(seeds.join(sent(often), "seed", "left_semi"), masks, "item_words", "item_pos")
        rare = seeds.join(sent(often), "seed", "left_anti")
        found = own.join(sent(rare.select("item_id", "item_pos", "seed")), "seed").select(*hit)
        more = _frequent(own.join(sent(often), "seed", "left_semi"), masks, "words", "pos")
        found = found.union(more.join(sent(frequent.select("item_id", "item_pos", "seed")), "seed").select(*hit))
    found = saved(found.distinct(), "hits").withColumnsRenamed({"doc_id": "own_id", "row_key": "own_key"})
    met = rows.withColumn("row_key", key).join(small(found), F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("row_key") == F.col("own_key")))
    hits = met.select("doc_id", words_of(F.col("text")).alias("words"), "item_id", "diagonal")
    return _overlap(hits.join(small(items), "item_id"), min_score)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that overlap no benchmark item, with all columns unchanged; rows are told apart by id and text."""
    row = F.xxhash64(F.col("doc_id").cast("long"), text_key())
    leaks = contaminated(docs.select(row.alias("doc_id"), "text"), benchmark, **options)
    own, leaked = fresh(docs, "own", "leaked")
    leaks = small(saved(leaks.select(F.col("doc_id").alias(leaked)).distinct(), "leaks"))
    return docs.withColumn(own, row).join(leaks, F.col(own) == F.col(leaked), "left_anti").select(columns_of(docs))
