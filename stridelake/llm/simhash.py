"""SimHash near-dedup by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments, fewer than the usual k + 1: where two fingerprints differ in at most three
bits, one of the segments differs in at most one. Each segment is indexed under its 32 variants with one bit as wildcard;
two segments within one bit share a variant, so an equality join on variants finds every pair, and each pair is verified
in one bucket only (the one of the differing bit). Equal fingerprints are one node, so copies never meet as pairs. Buckets
of more than TILE fingerprints are cut into tiles, which are dealt to tasks of their own; of a large bucket's links each
task keeps a spanning forest. Components come from label propagation with pointer jumping.

Defined cases: null text is empty; texts without words have fingerprint zero, linked like any other; a null doc_id never
names a component unless all of its component's ids are null; repeated rows get a row each; of equal ids the component is
the same; very long texts are fingerprinted whole, SHINGLES shingles at a time; an empty table gives no rows; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from functools import partial
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TILE, bounded, by_tile, saved, shuffle_partitions, tiled

#: Buckets of up to so many fingerprints are compared shift by shift, larger ones block by block.
SMALL_BUCKET, BLOCK = 64, 512
#: Shingles whose bits are held at once.
SHINGLES = 1 << 15


def _fingerprint(words: list[bytes], size: int) -> int:
    """Majority bits of the XXH64 (seed 42) of the shingles; signed, as Spark's long."""
    import numpy as np
    import xxhash

    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) > size else iter([b" ".join(words)])
    total, ones = 0, np.zeros(64, np.int64)
    while raw := b"".join(map(partial(xxhash.xxh64_digest, seed=42), islice(shingles, SHINGLES))):
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        total, ones = total + len(bits), ones + bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp: A-Z lower-cased, words cut at U+0020 and U+0009 to U+000D, shingles with repeats."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            text = pc.fill_null(batch.column("text"), "").cast(pa.binary())
            # bytes.lower() changes A-Z and bytes.split() cuts at those six characters, and at no others
            fp = [_fingerprint(x.as_py().lower().split(), shingle) for x in text]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def variants(nodes: DataFrame) -> DataFrame:
    """key, fp: 64 one-wildcard variants of each fingerprint; variant v has bit v % 32 of segment v / 32 cleared."""
    v = nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v"))
    half = F.when(F.col("v") < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    cleared = half.bitwiseAND(F.expr("~shiftleft(1L, v % 32)"))
    return v.select(F.expr("shiftleft(cast(v as bigint), 32)").bitwiseOR(cleared).alias("key"), "fp")


def _linked(most: int):
    """Whether two fingerprints in bucket variant v are within `most` bits, and v is the bucket that owns the pair."""
    import numpy as np

    low = np.uint64(0xFFFFFFFF)

    def linked(v, a, b):
        x = a ^ b
        top, bottom = (x >> np.uint64(32)).astype(np.int64), (x & low).astype(np.int64)
        first = v < 32
        here, bit = np.where(first, top, bottom), np.int64(1) << (v % 32)
        owns = (here == bit) | ((here == 0) & (v % 32 == 0))
        return owns & (first | (np.bitwise_count(top) > 1)) & (np.bitwise_count(x) <= most) & (x != 0)

    return linked


def _forest(linked, v, left, right):
    """Links between two blocks of a large bucket (or in one, given twice), as a spanning forest of these blocks."""
    import numpy as np

    fps = np.concatenate([left, right])
    root = np.arange(len(fps))
    for i in range(0, len(left), BLOCK):
        for j in range(0, len(right), BLOCK):
            a, b = np.nonzero(linked(np.int64(v), left[i : i + BLOCK, None], right[None, j : j + BLOCK]))
            a, b = a + i, b + j + len(left)
            while len(a := a[(open_ := root[a] != root[b])]):
                b = b[open_]
                hi, lo = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
                np.minimum.at(root, hi, lo)
                while (root[root] != root).any():
                    root = root[root]
    own = np.flatnonzero(fps[root] != fps)
    return fps[root[own]], fps[own]


def _small_buckets(most: int):
    """Rows in order of key -> verified links a < b (as unsigned) of small buckets, and the rows (a: key, b: fp) of large ones."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        linked = _linked(most)

        def out(a, b, large):
            columns = [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), large))]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "large"])

        def links(keys, fps):
            v, found = keys >> 32, []
            sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)])
            for s in range(1, int(sizes.max(initial=1))):
                i = np.flatnonzero(keys[s:] == keys[:-s])
                i = i[linked(v[i], fps[i], fps[i + s])]
                found.append((fps[i], fps[i + s]))
            a, b = (np.concatenate([o[k] for o in found]) if found else np.empty(0, np.uint64) for k in (0, 1))
            return out(np.minimum(a, b), np.maximum(a, b), False)

        rest_k, rest_f, opened = np.empty(0, np.int64), np.empty(0, np.uint64), None
        for batch in batches:
            keys = np.r_[rest_k, batch.column("key").to_numpy()]
            fps = np.r_[rest_f, batch.column("fp").to_numpy().view(np.uint64)]
            if not len(keys):
                continue
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            large = np.repeat((sizes > SMALL_BUCKET) | (keys[starts] == opened if opened is not None else False), sizes)
            # the last bucket may go on: one that is large already is handed on, a small one is held
            cut = len(keys) if large[-1] else int(starts[-1])
            opened = keys[-1] if large[-1] else None
            yield out(keys[:cut][large[:cut]], fps[:cut][large[:cut]], True)
            yield links(keys[:cut][~large[:cut]], fps[:cut][~large[:cut]])
            rest_k, rest_f = keys[cut:], fps[cut:]
        yield links(rest_k, rest_f)

    return run


def _large_buckets(most: int):
    """Tiles of large buckets -> links of a spanning forest of each."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        linked = _linked(most)
        for tile in by_tile(batches):
            fps = tile.column("fp").to_numpy().view(np.uint64)
            left, right = (fps[tile.column(c).to_numpy(zero_copy_only=False)] for c in ("left", "right"))
            a, b = _forest(linked, tile.column("key")[0].as_py() >> 32, left, right)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b).view(np.int64)), pa.array(np.maximum(a, b).view(np.int64))], names=["a", "b"])

    return run


def fingerprint_links(nodes: DataFrame, most: int = 3, tile: int = TILE) -> DataFrame:
    """a, b: links that join the same fingerprints as all pairs of at most `most` (3 or fewer) differing bits do."""
    if most > 3:
        raise ValueError("two segments with one wildcard find at most three differing bits")
    parts = shuffle_partitions(nodes.sparkSession)
    # each node makes 64 rows, so nodes are dealt out before
    keyed = variants(nodes.repartition(parts, "fp")).repartition(parts, "key").sortWithinPartitions("key")
    found = saved(keyed.mapInArrow(_small_buckets(most), "a long, b long, large boolean"), "buckets")
    large = found.where("large").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    sized = large.join(large.groupBy("key").agg(F.count("*").alias("size")).repartition(parts), "key")
    dense = tiled(sized, "fp", tile).select("key", "lo", "hi", "left", "right", "fp").mapInArrow(_large_buckets(most), "a long, b long")
    return found.where("not large").select("a", "b").union(dense)


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest reachable node (as a signed long) of every node with a link.

    Each node points to its smallest neighbour or itself; pointers double until they end; links are then drawn between the
    ends, and those within one are gone, so that later rounds only see what is not joined yet.
    """
    ends = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges = saved(links.where("a <> b").select(*ends("a", "b")).distinct(), "links")
    rounds = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("root")), "labels")
        ended = False
        while not ended:
            jump = up.select(F.col("node").alias("root"), F.col("root").alias("far"))
            new = saved(up.join(jump, "root").select("node", F.col("root").alias("old"), F.col("far").alias("root")), "labels")
            ended, up = new.where("root <> old").isEmpty(), new.select("node", "root")
        rounds.append(up)
        own = lambda c, r: up.select(F.col("node").alias(c), F.col("root").alias(r))  # noqa: B023, E731
        edges = edges.join(own("a", "x"), "a").join(own("b", "y"), "b").where("x <> y")
        edges = saved(edges.select(*ends("x", "y")).distinct(), "links")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds.pop()
    while rounds:
        later = roots.select(F.col("node").alias("root"), F.col("root").alias("far"))
        roots = saved(rounds.pop().join(later, "root", "left").select("node", F.coalesce("far", "root").alias("root")), "labels")
    return roots


def _rooted(fps: DataFrame, most: int) -> DataFrame:
    """fp, root: the component of every fingerprint, by its smallest member (as a signed long)."""
    nodes = fps.select("fp").distinct()
    roots = components(fingerprint_links(nodes, most))
    # a fingerprint without links is its own root
    return nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_dedup(docs: DataFrame, shingle: int = 3, most: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id reachable)."""
    fps = saved(fingerprints(docs, shingle), "fingerprints")
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    owned = first.join(_rooted(fps, most), "fp")
    named = owned.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = owned.join(named, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
