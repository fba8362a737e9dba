"""Removal of long repeated word sequences by recompression.

A window is `window` consecutive words of one document. A word is removed if some window over it also starts in a document
with a smaller doc_id. The plan, on the symbols that recompression.py names:

1. Every document yields its runs of windows, each with the key of its anchor and a hash of its content (saved once). Keys
   are grouped (min and max doc_id, summed within tasks first); only the runs of those of two or more documents go on.
2. Runs of equal content form a kind, and the first document that has it represents it. The texts of representatives are
   read again: a kind gets the digest of its words, and where a key has several kinds, each of their windows does too.
3. Windows are grouped by digest: those that are shared only in part of a run are found so, and what is found for a kind
   holds wherever its digest is met.
4. The texts meet their runs again. A run's windows are removed only if the digest of its own words is that of its kind: a
   repeat rests on words (by BLAKE2b of 128 bits), never on the hashes that named it. The texts are shuffled once; both
   joins with them read that exchange.

Groups are only ever summed, and joined with one row per group on one side, so hot passages split; no pairs are made.

Defined cases: null text has no words; documents shorter than a window, and those of an empty table, lose nothing; a null
doc_id counts as larger than all others; rows that repeat, or share a doc_id, are treated alike and never as smaller than
one another; texts are held whole, but worked on in pieces of PIECE bytes that overlap by all but a word of a window; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, saved, shuffle_partitions

LARGEST = (1 << 63) - 1
#: Bytes of text that are taken together in a task, and of which a longer text has several pieces.
PIECE = 512 << 10
RUNS = "d long, row long, p int, n int, key long, content long"


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, d (never null), row (tells rows with one doc_id apart), text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return bounded(rows).select("doc_id", F.coalesce("doc_id", F.lit(LARGEST)).alias("d"), F.xxhash64("text").alias("row"), "text")


def _pieces(raw: list[bytes], window: int):
    """Lists of (text number, number of the piece's first word, bytes): about PIECE bytes, every window in one piece."""
    import numpy as np

    from .recompression import word_spans

    held, size = [], 0
    for i, text in enumerate(raw):
        if size and size + len(text) > PIECE:
            yield held
            held, size = [], 0
        if len(text) <= PIECE:
            held.append((i, 0, text))
            size += len(text)
            continue
        starts, ends = word_spans(np.frombuffer(text, np.uint8))
        first = 0
        while first + window <= len(starts):
            last = max(int(np.searchsorted(ends, starts[first] + PIECE)), first + window)  # exclusive
            last = min(last, len(starts))
            yield [(i, first, text[starts[first] : ends[last - 1]])]
            if last == len(starts):
                break
            first = last - window + 1
    if held:
        yield held


def _hashed(raw: list[bytes]):
    """Word hashes of texts laid end to end, and each text's number of words."""
    import numpy as np

    from .recompression import word_hashes, word_spans

    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    starts, ends = word_spans(data)
    limits = np.cumsum([len(x) + 1 for x in raw])
    return word_hashes(data, starts, ends), np.diff(np.concatenate([[0], np.searchsorted(starts, limits)]))


def runs(texts: DataFrame, window: int) -> DataFrame:
    """RUNS rows: each run of windows (first start p, number n) with its key and content."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .recompression import window_runs

        for batch in batches:
            d, row = batch.column("d").to_numpy(), batch.column("row").to_numpy()
            for pieces in _pieces(batch.column("text").cast(pa.binary()).to_pylist(), window):
                own, p, n, key, content = window_runs(*_hashed([x[2] for x in pieces]), window)
                if len(own):
                    of, word0 = np.array([x[0] for x in pieces])[own], np.array([x[1] for x in pieces])[own]
                    columns = (d[of], row[of], (word0 + p).astype(np.int32), n.astype(np.int32), key.view(np.int64), content.view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["d", "row", "p", "n", "key", "content"])

    return texts.select("d", "row", "text").mapInArrow(run, RUNS)


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _spans(text: bytes):
    import numpy as np

    from .recompression import word_spans

    return word_spans(np.frombuffer(text, np.uint8))


def _digests(window: int):
    """Texts with the kinds that they represent -> each kind's digest (nth null), and with it its windows' where asked for."""

    def run(batches):
        import pyarrow as pa

        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        names = ("key", "content", "d", "nth", "digest", "part")
        for batch in batches:
            rows = []
            for d, text, own in zip(batch.column("d").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("own").to_pylist()):
                text = text.as_py()
                starts, ends = _spans(text)
                for r in own:
                    p, n = r["p"], r["n"]
                    words = text[starts[p] : ends[p + n + window - 2]].split()
                    kind = (r["key"], r["content"], d)
                    rows.append((*kind, None, whole := _digest(words), None))
                    if r["several"]:
                        rows += [(*kind, k, whole, _digest(words[k : k + window])) for k in range(n)]
                    if len(rows) > 4000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def removed_windows(texts: DataFrame, exchanged: DataFrame, window: int) -> DataFrame:
    """d, row, gone (array of first start, number of windows, bits of those removed, digest): per text with removed windows."""

    def apart(groups: DataFrame) -> DataFrame:
        """Groups dealt out evenly, so that a join with their rows has exchanges of its own on both sides and hot keys split."""
        return groups.repartition(shuffle_partitions(texts.sparkSession))

    found = saved(runs(texts, window), "runs")
    shared = apart(found.groupBy("key").agg(F.min("d").alias("low"), F.max("d").alias("high")).where("low < high").select("key"))
    matched = saved(found.join(shared, "key"), "matched-runs")
    kinds = matched.groupBy("key", "content").agg(F.min(F.struct("d", "row", "p")).alias("rep"), F.max("n").alias("n"), F.max("d").alias("high"))
    several = apart(kinds.groupBy("key").agg((F.count("*") > 1).alias("several")))
    # a kind of one document only matters for the windows that it shares with other kinds
    reps = kinds.join(several, "key").where(F.col("several") | (F.col("rep.d") < F.col("high")))
    reps = reps.select("rep.d", "rep.row", F.struct("key", "content", F.col("rep.p").alias("p"), "n", "several").alias("run"))
    reps = reps.groupBy("d", "row").agg(F.collect_list("run").alias("own"))  # no more than the document has runs
    # the same columns as in the last join, so that Spark reads the same exchange
    rows = exchanged.join(reps.hint("shuffle_hash"), ["d", "row"]).select("d", "text", "own").mapInArrow(_digests(window), "key long, content long, d long, nth int, digest binary, part binary")
    rows = saved(rows, "digests")
    windows = rows.where("nth is not null")
    least = apart(windows.groupBy("part").agg(F.min("d").alias("least")))
    partly = windows.join(least, "part").where("least < d").groupBy("key", "content", "digest").agg(F.bit_or(F.expr("shiftleft(1L, nth)")).alias("bits"))
    whole = rows.where("nth is null").groupBy("key", "content", "digest").agg(F.min("d").alias("first"))
    first = whole.join(partly, ["key", "content", "digest"], "left")
    bits = F.when(F.col("d") > F.col("first"), F.lit(-1)).otherwise(F.col("bits"))
    gone = matched.join(apart(first), ["key", "content"]).select("d", "row", "p", "n", bits.alias("bits"), "digest")
    return gone.where("bits is not null").groupBy("d", "row").agg(F.collect_list(F.struct("p", "n", "bits", "digest")).alias("gone"))


def _cover(text: bytes, starts, ends, gone, window: int):
    """Which words the removed windows cover, of runs whose words have the digest of their kind."""
    import numpy as np

    edge = np.zeros(len(starts) + 1, np.int32)
    for r in gone:
        p, bits, n = r["p"], r["bits"], r["n"]
        if p + n + window - 1 > len(starts) or _digest(text[starts[p] : ends[p + n + window - 2]].split()) != r["digest"]:
            continue
        if bits == -1:
            edge[p] += 1
            edge[p + n + window - 1] -= 1
        else:
            for k in range(n):
                if bits >> k & 1:
                    edge[p + k] += 1
                    edge[p + k + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def _kept_parts(text: bytes, gone, window: int):
    """Number of words, number removed, and the kept words in parts (joined by single spaces, to be joined by one again)."""
    import numpy as np

    if not gone and len(text) <= PIECE:
        words = text.split()
        return len(words), 0, [b" ".join(words)] if words else []
    starts, ends = _spans(text)
    cover = _cover(text, starts, ends, gone or (), window)
    turns = np.flatnonzero(np.diff(np.r_[True, cover, True].astype(np.int8)))
    parts = []
    for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()):
        while a < b:
            to = min(b, max(a + 1, int(np.searchsorted(starts, starts[a] + PIECE))))
            parts.append(b" ".join(text[starts[a] : ends[to - 1]].split()))
            a = to
    return len(starts), int(cover.sum()), parts


def substring_dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, kept_sha256: words cut at U+0020 and U+0009 to U+000D, kept ones joined by a space."""
    return _kept(docs, window, True)


def substring_digests(docs: DataFrame, window: int = 50) -> DataFrame:
    """As substring_dedup, without the kept texts."""
    return _kept(docs, window, False)


def _kept(docs: DataFrame, window: int, with_text: bool) -> DataFrame:
    if not 2 <= window <= 120:
        raise ValueError("a window has 2 to 120 words")  # a run's windows have to fit the bits of a long

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())

        def batch_of(rows):
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            return pa.RecordBatch.from_arrays([*arrays[:4], *(a.cast(pa.string()) for a in arrays[4:])], names=names)

        for batch in batches:
            rows, size = [], 0
            for doc_id, text, gone in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("gone")):
                n, removed, parts = _kept_parts(text.as_py(), gone.as_py(), window)
                sha = hashlib.sha256()
                for k, part in enumerate(parts):
                    sha.update(b" " * bool(k) + part)
                rows.append((doc_id, n, removed, sha.hexdigest(), *([b" ".join(parts)] * with_text)))
                size += with_text * sum(map(len, parts))
                if len(rows) == 1000 or size > PIECE:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

    texts = _texts(docs)
    exchanged = texts.repartition(shuffle_partitions(docs.sparkSession), "d", "row")
    gone = removed_windows(texts, exchanged, window)
    joined = exchanged.join(gone.hint("shuffle_hash"), ["d", "row"], "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
