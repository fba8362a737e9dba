"""Spelling variants by an index of variable-length grams: words that differ by one inserted, deleted or replaced code point.

1. Words are counted: maximal runs of LETTERS, A-Z lower-cased, with one code point left out where the checksum of document
   and run says so (see `drop_every`). Counts are summed within tasks first.
2. A gram dictionary: all grams of Q_MIN code points (words are framed by FIRST and LAST), and each longer one, up to Q_MAX,
   whose prefix is frequent. Grams that are frequent are thus extended, rare ones are pruned of extensions. The threshold
   is at least a share of 1 / PARENTS of all grams, which bounds the dictionary whatever the number of words.
3. Each word is decomposed: at every place the longest gram of the dictionary, unless one before covers it.
4. Each word has a bound of affected grams: the most that one edit at any place can change. A gram is affected if it
   overlaps the edit, or if a longer gram that reaches over the edit could take its place: one that begins with the text
   up to the edit, or ends with the text after it. The prefixes and suffixes of the dictionary's grams tell.
5. Lists are merged: of two near words' unaffected grams, which both have, the rarest is among the (bound + 1) rarest grams
   of either, so only those lists hold a word. The text before or after an unaffected gram is the same in both words, so a
   list is kept by that text.
6. Words of a list are verified: their rests are one edit apart, found through rests with one code point left out, so the
   work is in proportion to the list and only true pairs are made. Lists beyond LIST words are dealt out by those rests.
   Words whose bound leaves no gram meet in lists of the words with one code point left out.

Defined cases: a null text has no words; a null doc_id is empty in the checksum; repeated rows count again; of near words
with one count the first in code-point order is the form; a word without near words has n_near 0 and is its own root; very
long texts are counted whole; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, saved, shuffle_partitions

#: Code points of words, beside A-Z and a-z; words' least length and number; the divisor of checksums that leaves one out.
FROM_LETTER, TO_LETTER = 0xC0, 0xFF
MIN_LENGTH, MIN_COUNT, DROP_EVERY = 5, 3, 97
#: A form is as many times as frequent, at least.
TIMES = 2
#: Lengths of grams; number of frequent grams of one length at most; frequency that no gram is extended below.
Q_MIN, Q_MAX, PARENTS, LEAST_FREQUENT = 2, 5, 2000, 100
FIRST, LAST = "\x01", "\x02"
#: Words of a list that one task verifies; words that a task counts before it hands them on.
LIST, COUNTED = 20_000, 1 << 18

_LINK = "word string, near string, near_n long, large boolean, key long, n long, cut int"


def _counts(drop_every: int, min_length: int):
    """doc_id, text -> word, n."""

    def run(batches):
        import zlib
        from collections import Counter

        import pyarrow as pa

        # one byte a code point: those beyond Latin-1 become '?', which is no letter
        ascii_ = {*range(65, 91), *range(97, 123)}
        letters = bytes(b + 32 * (65 <= b <= 90) if b in ascii_ or FROM_LETTER <= b <= TO_LETTER else 32 for b in range(256))
        total: dict = {}

        def out():
            words = pa.array([w.decode("latin-1") for w in total], pa.string())
            rows = pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return rows

        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                if (text := text.as_py()) is None:
                    continue
                doc = doc.as_py()
                begun = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for w, k in Counter(text.encode("latin-1", "replace").translate(letters).split()).items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), begun)
                    if h % drop_every == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                    if len(w) >= min_length:
                        total[w] = total.get(w, 0) + k
                if len(total) > COUNTED:
                    yield out()
        if total:
            yield out()

    return run


def words(docs: DataFrame, drop_every: int = DROP_EVERY, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of all words of at least min_length code points and min_count occurrences."""
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(_counts(drop_every, min_length), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _grams(batches):
    from collections import Counter

    import pyarrow as pa

    for batch in batches:
        found: Counter = Counter()
        for w in batch.column("word").to_pylist():
            w = FIRST + w + LAST
            for q in range(Q_MIN, Q_MAX + 1):
                found.update([w[i : i + q] for i in range(len(w) - q + 1)])
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["gram", "f"])


def gram_dictionary(vocabulary: DataFrame, parents: int = PARENTS, least: int = LEAST_FREQUENT) -> dict[str, int]:
    """Gram -> its frequency in the vocabulary. Of each length at most `parents` grams are extended."""
    counted = saved(vocabulary.select("word").mapInArrow(_grams, "gram string, f long").groupBy("gram").agg(F.sum("f").alias("f")), "grams")
    total = counted.where(F.length("gram") == Q_MIN).agg(F.sum("f")).first()[0] or 0
    limit = max(least, total // parents)
    parent = counted.where(F.col("f") > limit).select(F.col("gram").alias("parent"))
    longer = counted.where(F.length("gram") > Q_MIN).withColumn("parent", F.expr("substring(gram, 1, length(gram) - 1)"))
    # parents are at most Q_MAX - Q_MIN times `parents`
    kept = longer.join(F.broadcast(parent), "parent").select("gram", "f").union(counted.where(F.length("gram") == Q_MIN))
    return {r.gram: r.f for r in kept.toLocalIterator()}


class GramIndex:
    """Decomposition of words by a gram dictionary, and the grams that one edit can change."""

    def __init__(self, grams: dict[str, int]):
        self.order = grams
        self.longer = {g for g in grams if len(g) > Q_MIN}
        self.heads = {g[:k] for g in self.longer for k in range(Q_MIN, len(g))}
        self.tails = {g[-k:] for g in self.longer for k in range(Q_MIN, len(g))}

    def decompose(self, s: str) -> list[tuple[int, int]]:
        """Spans of the grams of a framed word, from left to right; none lies within another."""
        spans, end, longer = [], 0, self.longer
        for p in range(len(s) - Q_MIN + 1):
            e = p + Q_MIN
            for q in range(min(Q_MAX, len(s) - p), Q_MIN, -1):
                if s[p : p + q] in longer:
                    e = p + q
                    break
            if e > end:
                spans.append((p, e))
                end = e
        return spans

    def unaffected(self, s: str, spans: list[tuple[int, int]]) -> int:
        """The least number of grams that stay after one edit of the word, wherever it is."""
        size, heads, tails = len(s), self.heads, self.tails
        before, after = [0] * (size + 1), [0] * (size + 1)
        for i in range(1, size):
            reach = i  # from where a longer gram could reach over an edit at i
            for k in range(min(Q_MAX - 1, i), Q_MIN - 1, -1):
                if s[i - k : i] in heads:
                    reach = i - k
                    break
            before[i] = sum(b <= i and a < reach for a, b in spans)
            reach = i  # up to where one from before i could reach
            for k in range(min(Q_MAX - 1, size - i), Q_MIN - 1, -1):
                if s[i : i + k] in tails:
                    reach = i + k
                    break
            after[i] = sum(a >= i and b > reach for a, b in spans)
        changed = min(before[i] + after[i + 1] for i in range(1, size - 1))
        inserted = min(before[i] + after[i] for i in range(1, size))
        return min(changed, inserted)

    def lists(self, word: str):
        """(texts before or after grams whose lists hold the word: (side, text)), whether the bound leaves no gram."""
        s = FIRST + word + LAST
        spans = self.decompose(s)
        stay = self.unaffected(s, spans)
        order = self.order
        if stay < len(spans) and stay:
            spans = sorted(spans, key=lambda x: (order.get(s[x[0] : x[1]], 0), s[x[0] : x[1]], x[0]))[: len(spans) - stay + 1]
        sides = [(1, s[:b]) for _, b in spans if b < len(s)] + [(-1, s[a:]) for a, _ in spans if a > 0]
        return sides, stay < 1


def _without(rest: str):
    """(place, rest without it) of each place."""
    return [(i, rest[:i] + rest[i + 1 :]) for i in range(len(rest))]


def _postings(grams):
    """word, n -> key of a list, word, n, cut (length of the common text: from the left if > 0, from the right if < 0, none if 0)."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        index, key = GramIndex(grams), lambda x: xxhash.xxh3_64_intdigest(x.encode()) - (1 << 63)
        for batch in batches:
            keys, cuts, rows = [], [], []
            for at, w in enumerate(batch.column("word").to_pylist()):
                sides, rest = index.lists(w)
                for side, text in sides:
                    keys.append(key(f"{side}{text}"))
                    cuts.append(side * (len(text) - 1))
                if rest:
                    variants = {v for _, v in _without(w)} | {w}
                    keys.extend(key(v) for v in variants)
                    cuts.extend([0] * len(variants))
                rows.extend([at] * (len(keys) - len(rows)))
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column("word").take(at), batch.column("n").take(at), pa.array(cuts, pa.int32())], names=["key", "word", "n", "cut"])

    return run


def _near(members):
    """(word, n, cut) of a list -> pairs of places in it whose words are one edit apart."""
    rests = [w[c:] if c > 0 else w[:c] if c < 0 else w for w, _, c in members]
    whole: dict = {}
    for at, r in enumerate(rests):
        whole.setdefault((members[at][2], r), at)
    changed: dict = {}
    for at, r in enumerate(rests):
        cut, seen = members[at][2], None
        for i, v in _without(r):
            if v != seen:  # in a run of equal letters any may be the one
                seen = v
                if (other := whole.get((cut, v))) is not None:
                    yield at, other
            if found := changed.get((cut, i, v)):
                for other in found:
                    if rests[other] != r:
                        yield at, other
                found.append(at)
            else:
                changed[cut, i, v] = [at]


def _rows(links, large):
    import pyarrow as pa

    columns = [[x[0] for x in links] + [x[1] for x in large], [x[1] for x in links] + [None] * len(large), [x[2] for x in links] + [None] * len(large), [False] * len(links) + [True] * len(large)]
    columns += [[None] * len(links) + [x[k] for x in large] for k in (0, 2, 3)]
    kinds = (pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["word", "near", "near_n", "large", "key", "n", "cut"])


def _merged(most: int):
    """Postings in order of key -> links both ways (word, near, near_n), and the postings of lists of more than `most` words (large)."""

    def run(batches):
        import numpy as np

        held, at, over = [], None, False
        links, large = [], []

        def close():
            if len(held) > 1 and not over:
                members = [(w, n, c) for _, w, n, c in held]
                for a, b in _near(members):
                    (x, m, _), (y, k, _) = members[a], members[b]
                    links.append((x, y, k))
                    links.append((y, x, m))
            held.clear()

        for batch in batches:
            keys = batch.column("key").to_numpy()
            if not len(keys):
                continue
            # lists of one word, which most are, end here; the first and the last may go on in another batch
            lone = np.r_[False, keys[1:] != keys[:-1]] & np.r_[keys[1:] != keys[:-1], False]
            few = batch.filter(_mask(~lone))
            for row in zip(*[few.column(c).to_pylist() for c in ("key", "word", "n", "cut")]):
                if row[0] != at:
                    close()
                    at, over = row[0], False
                held.append(row)
                if over or len(held) > most:
                    over = True
                    large.extend(held)
                    held.clear()
            yield _rows(links, large)
            links, large = [], []
        close()
        yield _rows(links, large)

    return run


def _mask(a):
    import pyarrow as pa

    return pa.array(a)


def _dealt(batches):
    """Postings of large lists -> the same, with keys of list and rest without one code point."""
    import pyarrow as pa
    import xxhash

    for batch in batches:
        rows = []
        for key, w, n, c in zip(*[batch.column(x).to_pylist() for x in ("key", "word", "n", "cut")]):
            rest = w[c:] if c > 0 else w[:c] if c < 0 else w
            for v in {v for _, v in _without(rest)} | {rest}:
                rows.append((xxhash.xxh3_64_intdigest(f"{key} {c} {v}".encode()) - (1 << 63), w, n, c))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int32()))], names=["key", "word", "n", "cut"])


_POSTING = "key long, word string, n long, cut int"


def near_words(vocabulary: DataFrame, grams: dict[str, int], most: int = LIST) -> DataFrame:
    """word, near, near_n: each pair of words that are one edit apart, both ways; once or more."""
    spark = vocabulary.sparkSession
    parts = shuffle_partitions(spark)
    in_order = lambda df: df.repartition(parts, "key").sortWithinPartitions("key")
    postings = vocabulary.repartition(parts, "word").mapInArrow(_postings(grams), _POSTING)
    found = saved(in_order(postings).mapInArrow(_merged(most), _LINK), "spelling-lists")
    large = found.where("large").select("key", "word", "n", "cut")
    # a list by a rest without one code point has no more words than places times letters: none is large again
    dealt = in_order(large.mapInArrow(_dealt, _POSTING)).mapInArrow(_merged(1 << 62), _LINK)
    pick = ("word", "near", "near_n")
    return found.where("not large").select(*pick).union(dealt.select(*pick))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's forms. Counts double from form to form, so a few rounds of doubled steps end."""
    up = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        jump = up.select(F.col("word").alias("root"), F.col("root").alias("far"))
        # only ends that have a form of their own go on
        new = saved(up.join(jump, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        if new.where("moved").isEmpty():
            return up
        up = new.select("word", "root")


def spelling_variants(docs: DataFrame, drop_every: int = DROP_EVERY, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, times: float = TIMES, most: int = LIST) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of docs (doc_id, text)."""
    vocabulary = saved(words(docs, drop_every, min_length, min_count), "words")
    links = near_words(vocabulary, gram_dictionary(vocabulary), most)
    once = links.groupBy("word", "near").agg(F.first("near_n").alias("near_n"))
    best = once.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("best"))
    own = vocabulary.join(best, "word", "left")
    enough = -F.col("best.k") >= times * F.col("n")
    own = own.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.k")).alias("form_n"))
    own = saved(own, "forms")
    roots = _roots(own.where("form is not null"))
    return own.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
