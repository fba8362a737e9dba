"""Token ids as length-delimited binary records with masked checksums, and a separate offset index.

A record is: length (8 bytes), masked checksum of those 8 bytes (4), the serialized ids, masked checksum of the ids (4).
Ids are little-endian, two bytes each where the vocabulary fits, else four. The checksum is CRC-32 (zlib), masked by a
rotation and a constant so that a checksum of data that holds checksums stays sound. The index file beside each record
file has one entry per record (offset, payload length, first token's place in the file, doc_id, whether it has one), so
that a shuffled reader can seek to any record.

Documents are range-partitioned and sorted by doc_id (null first, then by text), encoded in the writing task, and one
file pair is written per partition. Null texts are empty: only the end id. Repeated rows each get a record, and however
many they are, they spread over several files. Very long texts are encoded whole, and an empty table gives no files; extra
columns are ignored, whatever their names. Records of a lost task are written anew under another name; only files in the
manifest count.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, file_system, shared_dir, shuffle_partitions, task_file
from .unit_encoder import unit_encoder

MAGIC = b"TIDREC1\n"
INDEX = "<QQQqB7x"
#: Added to the rotated checksum, as record formats with masked checksums do.
MASK = 0xA282EAD8
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload))


def unframe(stream) -> bytes:
    """The payload of the record that begins here; raises where a length or payload is damaged."""
    head = stream.read(12)
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError("damaged record length")
    n = struct.unpack("<Q", head[:8])[0]
    body = stream.read(n + 4)
    if len(body) < n + 4 or masked(body[:n]) != struct.unpack("<I", body[n:])[0]:
        raise ValueError("damaged record payload")
    return body[:n]


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, wide: bool = False) -> list[tuple[int, str, int, int]]:
    """Write doc_id, text as records in ascending doc_id order; (part, file, records, tokens) of each file in that order."""
    code, width = ("I", 4) if wide else ("H", 2)

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, end = unit_encoder(tokenizer, code), struct.pack("<" + code, end_id)
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        name, out, index, docs_n, tokens = task_file(base, "ids"), None, None, 0, 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for at in range(0, batch.num_rows, 200):
                texts = [x or "" for x in batch.column("text").slice(at, 200).to_pylist()]
                for doc_id, payload in zip(ids[at : at + 200], encoder.ids(texts)):
                    if out is None:
                        out, index = fs.open_output_stream(name + ".rec", buffer_size=1 << 20), fs.open_output_stream(name + ".idx", buffer_size=1 << 16)
                        out.write(MAGIC + bytes([width]))
                        offset = len(MAGIC) + 1
                    data = frame(payload + end)
                    out.write(data)
                    index.write(struct.pack(INDEX, offset, len(payload) + width, tokens, doc_id or 0, doc_id is not None))
                    offset, docs_n, tokens = offset + len(data), docs_n + 1, tokens + len(payload) // width + 1
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "file": [name], "records": [docs_n], "tokens": [tokens]})

    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the last number only spreads rows that repeat
    order = (F.col("doc_id"), F.xxhash64("text"), F.col("nth"))
    rows = rows.withColumn("nth", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order).drop("nth")
    # one row per written file, which the number of tasks bounds
    return sorted(tuple(r) for r in rows.mapInArrow(write, "part long, file string, records long, tokens long").collect())


def read_index(fs, path: str):
    """(offset, payload length, first token, doc_id) of each record of a file."""
    with fs.open_input_stream(path + ".idx") as f:
        for offset, length, first, doc_id, has in struct.iter_unpack(INDEX, f.read()):
            yield offset, length, first, doc_id if has else None


def read_records(spark: SparkSession, manifest: list[tuple[int, str, int, int]]) -> DataFrame:
    """ROWS of the record files, read back in whole with every checksum compared."""
    start, files = 0, []
    for _, name, _, tokens in manifest:
        files.append((name, start))
        start += tokens

    def read(batches):
        import numpy as np
        import pyarrow as pa

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                fs, path = file_system(name)
                rows = []
                with fs.open_input_stream(path + ".rec", buffer_size=1 << 20) as f:
                    if f.read(len(MAGIC)) != MAGIC:
                        raise ValueError(f"{name} is no record file")
                    kind = "<u2" if f.read(1)[0] == 2 else "<u4"
                    for _, _, first, doc_id in read_index(fs, path):
                        ids = np.frombuffer(unframe(f), kind)
                        rows.append((doc_id, base + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == 5000:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    return spark.createDataFrame(files, "file string, start long").mapInArrow(read, ROWS)


def read_shuffled(spark: SparkSession, manifest: list[tuple[int, str, int, int]], seed: int = 0) -> DataFrame:
    """doc_id, ids of every record in an order that the seed fixes: index rows are shuffled, records are read by seeking."""
    files = spark.createDataFrame([(m[1],) for m in manifest], "file string")

    def entries(batches):
        import pyarrow as pa

        for batch in batches:
            for name in batch.column("file").to_pylist():
                fs, path = file_system(name)
                rows = list(read_index(fs, path))
                yield pa.RecordBatch.from_pydict({"file": pa.array([name] * len(rows)), "offset": pa.array([r[0] for r in rows], pa.int64()), "doc_id": pa.array([r[3] for r in rows], pa.int64())})

    def seek(batches):
        import numpy as np
        import pyarrow as pa

        open_files: dict = {}
        for batch in batches:
            ids = []
            for name, offset in zip(batch.column("file").to_pylist(), batch.column("offset").to_pylist()):
                if name not in open_files:
                    if len(open_files) > 200:
                        for f, _ in open_files.values():
                            f.close()
                        open_files.clear()
                    fs, path = file_system(name)
                    f = fs.open_input_file(path + ".rec")
                    f.seek(len(MAGIC))
                    open_files[name] = f, "<u2" if f.read(1)[0] == 2 else "<u4"
                f, kind = open_files[name]
                f.seek(offset)
                ids.append(np.frombuffer(unframe(f), kind).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    order = F.xxhash64(F.lit(seed), "file", "offset")
    return files.mapInArrow(entries, "file string, offset long, doc_id long").orderBy(order).mapInArrow(seek, "doc_id long, ids array<int>")


def token_records(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the records of docs to the shared folder and read them back: ROWS."""
    spark = docs.sparkSession
    return read_records(spark, write_records(docs, shared_dir(spark, "token-records"), tokenizer, end_id))
