"""Exact dedup by an extendible-hash index on shared files.

Each input task first folds its own equal texts (found by key, told apart by bytes), so a group of any size sends one entry
per task. Entries go to owner tasks by the leading bits of their 64-bit key: an owner holds whole key ranges. It fills
buckets in key order; a bucket with more than `capacity` keys is split by its next bit (which doubles the directory where
its depth is the global one), keys that collide are chained, and the chain is told apart by comparing bytes. Buckets are
written to files in the shared folder, and the directory (prefix, depth, file, offset) is a small table.

The rows of the input then meet their groups in the index: they go to the tasks that read their buckets, in order of file
and offset (a hot bucket's rows are split over several tasks), and find their entry by key and SHA-256 of the text. Later
texts are `probe`d in the same way, with their bytes compared.

Defined cases: null text counts as empty; empty texts are equal to each other; a null doc_id loses every tie; of repeated
rows (same doc_id and text) each is a row of its own and one of them stays; very long texts are hashed and packed whole; an
empty table gives no rows; extra columns are ignored by exact_dedup and kept unchanged by drop_copies, whatever their names
(of rows that repeat it keeps one, see keep_rows).
"""

from __future__ import annotations

import hashlib
import math
import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, each_copy, file_system, keep_rows, saved, shared_dir, shuffle_partitions, task_file, text_key

#: U+0020 and U+0009 to U+000D; UTF-8 uses these bytes for nothing else.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
CAPACITY = 512
#: Bytes of folded texts that an input task holds before it hands them on.
FOLD_BYTES = 48 << 20
#: An entry in a bucket file: key, sha256, has an id that stays, this id and its code points, rows, length of the packed text that follows.
HEAD = "<q32s?qiqI"

ENTRY = "key long, sha binary, body binary, n long, best_cp int, best_id long"
BUCKET = "start long, prefix long, depth int, n_keys int, file string, offset long, length long"


def _normal(batch):
    """doc_id, code points and normalised bytes of each row of an Arrow batch."""
    import pyarrow as pa
    import pyarrow.compute as pc

    text = pc.fill_null(batch.column("text"), "")
    raw = text.cast(pa.binary()).to_pylist()
    return batch.column("doc_id").to_pylist(), pc.utf8_length(text).to_pylist(), [x.translate(None, BLANKS) for x in raw]


def _key(body: bytes) -> int:
    import xxhash

    k = xxhash.xxh64_intdigest(body)
    return k - (1 << 64) if k >> 63 else k


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (code points, doc_id): the longer, then the smaller id; a null id last."""
    rank = lambda x: (-x[0], x[1] is None, x[1] or 0)
    return a if rank(a) <= rank(b) else b


def _fold(batches):
    import pyarrow as pa
    import zstandard

    pack, held, size = zstandard.ZstdCompressor(level=1).compress, {}, 0

    def flush():
        rows = [(k, *e) for k, chain in held.items() for e in chain]
        names = ("key", "sha", "body", "n", "best_cp", "best_id")
        types = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int64())
        for i in range(0, len(rows), 2000):
            part = [(k, hashlib.sha256(body).digest(), packed, n, *best) for k, body, packed, n, best in rows[i : i + 2000]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=names)

    for batch in batches:
        for doc_id, cp, body in zip(*_normal(batch)):
            chain = held.setdefault(_key(body), [])
            for entry in chain:
                if entry[0] == body:
                    entry[2:] = entry[2] + 1, _better(entry[3], (cp, doc_id))
                    break
            else:
                chain.append([body, packed := pack(body), 1, (cp, doc_id)])
                size += len(body) + len(packed) + 200
            if size > FOLD_BYTES:
                yield from flush()
                held, size = {}, 0
    yield from flush()


def _split(entries: list, prefix: int, depth: int, capacity: int):
    """Buckets (prefix, depth, entries) of entries in key order, split while they hold more than `capacity` keys."""
    if len({e[0] for e in entries[: capacity + 1]}) > capacity or (len(entries) > capacity and len({e[0] for e in entries}) > capacity):
        bit = 63 - depth
        low = [e for e in entries if not (e[0] & ((1 << 64) - 1)) >> bit & 1]
        high = [e for e in entries if (e[0] & ((1 << 64) - 1)) >> bit & 1]
        yield from _split(low, prefix << 1, depth + 1, capacity)
        yield from _split(high, prefix << 1 | 1, depth + 1, capacity)
    elif entries:
        yield prefix, depth, entries


def _own(folder: str, depth: int, capacity: int):
    """Owner: entries in key order -> bucket files and one directory row per bucket."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        unpack, out, rows = zstandard.ZstdDecompressor().decompress, None, []
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        name = task_file(base, "bucket")

        def close_range(prefix, entries):
            nonlocal out
            for p, d, bucket in _split(entries, prefix, depth, capacity):
                out = out or fs.open_output_stream(name)
                start = out.tell()
                for key, sha, body, n, (cp, best) in bucket:
                    out.write(struct.pack(HEAD, key, sha, best is not None, best or 0, cp, n, len(body)) + body)
                rows.append((prefix, p, d, len({e[0] for e in bucket}), name, start, out.tell() - start))

        at, held = None, []
        for batch in batches:
            for key, sha, body, n, cp, doc_id in zip(*(batch.column(c).to_pylist() for c in ("key", "sha", "body", "n", "best_cp", "best_id"))):
                prefix = (key & ((1 << 64) - 1)) >> (64 - depth)
                if prefix != at:
                    if held:
                        close_range(at, held)
                    at, held = prefix, []
                i = len(held) - 1
                while i >= 0 and held[i][0] == key:  # the chain of this key
                    if held[i][2] == body or unpack(held[i][2]) == unpack(body):
                        break
                    i -= 1
                if i >= 0 and held[i][0] == key:
                    held[i] = (key, sha, held[i][2], held[i][3] + n, _better(held[i][4], (cp, doc_id)))
                else:
                    held.append((key, sha, body, n, (cp, doc_id)))
        if held:
            close_range(at, held)
        if out:
            out.close()
        if rows:
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in BUCKET.split(", ")])

    return run


def _first_bits(key: str, depth: Column | int) -> Column:
    """The leading bits of a 64-bit key."""
    return F.expr(f"shiftrightunsigned({key}, 64 - {depth})")


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The directory of an index of docs (doc_id, text), saved: one row per bucket. `start` is the prefix of `least_depth` bits."""
    spark = docs.sparkSession
    # the directory starts at the depth that half fills its buckets; splits go on from there
    depth = max(1, math.ceil(math.log2(max(2, 2 * docs.count() / capacity))))
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    owned = rows.mapInArrow(_fold, ENTRY).repartition(shuffle_partitions(spark), _first_bits("key", depth)).sortWithinPartitions("key", "sha")
    buckets = owned.mapInArrow(_own(shared_dir(spark, "exact-index"), depth, capacity), BUCKET)
    return saved(buckets.withColumn("least_depth", F.lit(depth)), "directory")


def _look_up(by_bytes: bool):
    """Rows in order of file and offset, with key and sha or body -> row, found, keep_id, keep_cp, group_size, from their buckets."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        unpack, head = zstandard.ZstdDecompressor().decompress, struct.calcsize(HEAD)
        at, bucket, name, stream = None, {}, None, None
        for batch in batches:
            rows = []
            places = zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "key")))
            for nth, (file, offset, length, key) in enumerate(places):
                if (file, offset) != at:
                    if file != name:
                        if stream:
                            stream.close()
                        fs, path = file_system(file)
                        stream, name = fs.open_input_file(path), file
                    stream.seek(offset)
                    data, i, bucket, at = stream.read(length), 0, {}, (file, offset)
                    while i < length:
                        own, sha, known, keep_id, cp, n, size = struct.unpack_from(HEAD, data, i)
                        i += head
                        chain = bucket.setdefault(own, [])
                        chain.append((data[i : i + size] if by_bytes else sha, (keep_id if known else None, cp, n)))
                        i += size
                chain = bucket.get(key, ())
                if by_bytes:
                    body = unpack(batch.column("body")[nth].as_py()) if chain else None
                    found = next((entry for packed, entry in chain if unpack(packed) == body), None)
                else:
                    digest = batch.column("sha")[nth].as_py()
                    found = next((entry for sha, entry in chain if sha == digest), None)
                rows.append((found is not None, *(found or (None, None, None))))
            found, keep_id, keep_cp, n = zip(*rows) if rows else ((), (), (), ())
            columns = [batch.column(c) for c in ("doc_id", "text_key", "cp", "sha") if c in batch.schema.names]
            names = [c for c in ("doc_id", "text_key", "cp", "sha") if c in batch.schema.names]
            columns += [pa.array(found, pa.bool_()), pa.array(keep_id, pa.int64()), pa.array(keep_cp, pa.int32()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "found", "keep_id", "keep_cp", "group_size"])
        if stream:
            stream.close()

    return run


def _at_buckets(rows: DataFrame, directory: DataFrame, spread: str) -> DataFrame:
    """rows (with key) with file, offset and length of their buckets, in their order; a bucket of many rows is split by `spread`."""
    depths = [r.least_depth for r in directory.select("least_depth").distinct().collect()]  # one number, or none
    rows = rows.withColumn("at", _first_bits("key", depths[0] if depths else 1))
    named = directory.select(F.col("start").alias("at"), "prefix", "depth", "file", "offset", "length")
    placed = rows.join(named, "at").where(_first_bits("key", "depth") == F.col("prefix")).drop("at", "prefix", "depth")
    return placed.repartitionByRange(shuffle_partitions(rows.sparkSession), "file", "offset", spread).sortWithinPartitions("file", "offset")


def _packed(batches):
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        ids, _, bodies = _normal(batch)
        columns = [pa.array(ids, pa.int64()), pa.array([_key(b) for b in bodies], pa.int64()), pa.array([pack(b) for b in bodies], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "body"])


def probe(directory: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, keep_id of the rows of docs whose text is in an index that was built before: its buckets are read."""
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = rows.mapInArrow(_packed, "doc_id long, key long, body binary")
    found = _at_buckets(keyed, directory, "doc_id").mapInArrow(_look_up(True), "doc_id long, found boolean, keep_id long, keep_cp int, group_size long")
    return found.where("found").select("doc_id", "keep_id")


def _digest(batches):
    import pyarrow as pa

    for batch in batches:
        ids, cps, bodies = _normal(batch)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), batch.column("text_key"), pa.array(cps, pa.int32()), pa.array([_key(b) for b in bodies], pa.int64()), pa.array([hashlib.sha256(b).digest() for b in bodies], pa.binary())],
            names=["doc_id", "text_key", "cp", "key", "sha"],
        )


def _members(docs: DataFrame, capacity: int) -> DataFrame:
    """doc_id, text_key, sha, copies (rows that repeat), keep_id, group_size, first (may stay): distinct rows of docs."""
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    directory = build_index(rows, capacity)
    keyed = rows.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(_digest, "doc_id long, text_key long, cp int, key long, sha binary")
    keyed = saved(keyed.groupBy("doc_id", "text_key", "cp", "key", "sha").agg(F.count("*").alias("copies")), "keyed")
    placed = _at_buckets(keyed.drop("copies"), directory, "text_key")
    found = placed.mapInArrow(_look_up(False), "doc_id long, text_key long, cp int, sha binary, found boolean, keep_id long, keep_cp int, group_size long")
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("cp") == F.col("keep_cp"))
    found = found.select("doc_id", "text_key", "sha", "keep_id", "group_size", first.alias("first"))
    many = keyed.where("copies > 1").select(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key"), "copies")
    joined = found.join(many, found.doc_id.eqNullSafe(many.own_id) & (found.text_key == many.own_key), "left")
    return joined.select("doc_id", "text_key", "sha", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "keep_id", "group_size", "first")


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (of the text without blanks): one row per row of docs."""
    rows = _members(docs, capacity)
    # rows that repeat, or differ in blanks only under one id, are numbered, so that one of them stays
    rows = rows.groupBy("doc_id", "sha", "keep_id", "group_size", "first").agg(F.sum("copies").alias("copies"))
    rows = each_copy(rows, "copies", "nth")
    return rows.select("doc_id", "keep_id", "group_size", (F.col("first") & (F.col("nth") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with all columns."""
    # texts of one id that differ in blanks only, and are equally long, tie: the least text key stays
    tied = Window.partitionBy("doc_id", "sha", "first")
    keep = F.col("first") & (F.col("text_key") == F.min("text_key").over(tied))
    return keep_rows(docs, _members(docs, capacity).select("doc_id", "text_key", "copies", keep.alias("keep")))
