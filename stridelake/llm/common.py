"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which every executor reaches; set here only if unset and in local mode (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="stridelake-")
        spark.sparkContext.setCheckpointDir(base)
    return posixpath.join(base, f"{name}-{uuid.uuid4().hex}")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that df has not, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df, with names of any characters."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def text_key() -> Column:
    """Tells rows with one doc_id apart; a null text is empty."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


#: Row names of so many rows at most are broadcast (about 100 MB); more are joined by an exchange.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """A saved table, marked for broadcast if it has no more than `most` (BROADCAST_ROWS) rows."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if most is None else most) else df


def keep_rows(docs: DataFrame, members: DataFrame, most: int | None = None) -> DataFrame:
    """The rows of docs that members keeps, one of each; all columns of docs, in their order and unchanged.

    members: doc_id, text_key, copies, keep of every distinct (doc_id, text) of docs. Only the rows that go, and those that
    docs repeats, are joined with docs. Of rows that repeat, the one whose other columns are least as JSON text stays.
    """
    special = saved(members.where("not keep or copies > 1").select("doc_id", "text_key", "keep"), "special-rows")
    key, by_id, by_key, keep, row = fresh(docs, "key", "by_id", "by_key", "keep", "row")
    named = small(special.select(F.col("doc_id").alias(by_id), F.col("text_key").alias(by_key), F.col("keep").alias(keep)), most)
    marked = docs.withColumn(key, text_key())
    marked = marked.join(named, marked.doc_id.cast("long").eqNullSafe(named[by_id]) & (marked[key] == named[by_key]), "left")
    once = marked.where(F.col(keep).isNull()).select(columns_of(docs))
    whole = F.struct(*columns_of(docs))
    repeated = marked.where(keep).groupBy(by_id, by_key).agg(F.min_by(whole, F.to_json(whole)).alias(row))
    return once.unionByName(repeated.select([F.col(row)[c].alias(c) for c in docs.columns]))


#: Rows that one step makes of a row that is repeated.
COPIES = 10_000


def each_copy(rows: DataFrame, copies: str, nth: str) -> DataFrame:
    """Each row as many times as its column `copies` says, numbered from 1 in `nth`; rows of many copies are dealt out in pieces."""
    once = rows.where(F.col(copies) == 1).withColumn(nth, F.lit(1).cast("long"))
    pieces = rows.where(F.col(copies) > 1).withColumn(nth, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / COPIES).cast("long"))))
    pieces = pieces.repartition(shuffle_partitions(rows.sparkSession))
    begin = F.col(nth) * COPIES
    numbers = F.sequence(begin + 1, F.least(begin + COPIES, F.col(copies)))
    return once.unionByName(pieces.withColumn(nth, F.explode(numbers)))


#: Bytes of rows that go to a Python worker at once; rows of long texts are many to the usual number of rows.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """df, after lowering the bound of the session's Arrow batches to BATCH_BYTES, for this and all later queries.

    It bounds what a task holds of long texts outside the heap. A lower bound that the user has set stays.
    """
    conf = df.sparkSession.conf
    now = conf.get(_BATCH, None)
    if now is None or not now.strip().isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Members of a bucket that are compared in one task.
TILE = 2048


def tiled(rows: DataFrame, member: str, tile: int = TILE) -> DataFrame:
    """rows (key, size of its bucket, member, ...) dealt to tiles: key, lo, hi, left, right and the other columns.

    A bucket is cut into blocks of about `tile` members; each pair of blocks, and each block with itself, is one tile. A row
    is in `left` or `right`, or in both in a block's own tile; every pair of a bucket's members meets in just one tile.
    Tiles are dealt to tasks by (key, lo, hi), so no task holds more than two blocks, whatever the size of a bucket.
    """
    g = F.ceil(F.col("size") / tile).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(member), g).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), g - 1)))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    rows = rows.select("*", lo.alias("lo"), hi.alias("hi"), (F.col("block") == lo).alias("left"), (F.col("block") == hi).alias("right"))
    parts = shuffle_partitions(rows.sparkSession)
    return rows.drop("block", "other", "size").repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def by_tile(batches):
    """Record batches of rows in order of (key, lo, hi) -> one batch for each tile."""
    import numpy as np
    import pyarrow as pa

    held, at = [], None

    def whole():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "lo", "hi")], axis=1)
        cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            name = tuple(names[a].tolist())
            if held and name != at:
                yield whole()
                held = []
            at = name
            held.append(batch.slice(a, b - a))
    if held:
        yield whole()


def file_system(uri: str):
    """(file system, path) of a folder of any store that pyarrow knows; plain paths are local ones."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def task_file(folder: str, prefix: str) -> str:
    """A file name of this very task attempt: a retried or doubled task never writes another one's file."""
    from pyspark import TaskContext

    ctx = TaskContext.get()
    return f"{folder}/{prefix}-{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
