"""Near copies by deletion-variant signatures: documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

The method is that of simhash.py with fingerprints of a sharper kind, of three-word shingles as there. Each bit is the parity of
the least hash of the set of shingles under a hash function of its own, so that two sets of similarity s differ in a bit
with the probability (1 - s) / 2 whatever the edit is: a block replaced or put in, a tail appended (majority bits differ more
for an appended tail than for replaced words of one similarity); where single words are replaced, sets of three-word
shingles are more alike than those of five. Fingerprints have SEGMENTS segments of BITS bits. At similarity 0.8 a segment differs
in at most one bit with the probability 0.9^30 + 30 * 0.1 * 0.9^29 = 0.184, so a pair meets in a bucket of one-wildcard
variants with 1 - (1 - 0.184)^18 = 0.974, and at 0.85 with 0.9993. Widths are the same for every size of table. Unrelated sets
meet in a segment with 31 / 2^30, so chance meetings are one a segment at 10^9 documents, of which CHECK further bits turn
away all but a twentieth. Every link is verified on the whole sets of 64-bit shingle hashes.

Equal sets are one node. In each bucket a node meets the smallest node within CHECK_FAR check bits. Of those that it meets in a
segment a node takes the smallest, and where their fingerprints differ in a share of FAR or less they are of one family. In
a family all are first compared with its centre, the member nearest to a sample of it. Families that this leaves in
several components are narrowed to members that share one of their rarest shingles (prefix filter: two similar sets always
do), so that pages of one template with contents of their own never meet. What is left is cut into tiles, bounded by the
number of shingles, in which all pairs across components are compared and a spanning forest of the similar ones is kept. So
no pairs are written, and large groups of copies need about one comparison a member. Only sets between FAR and the threshold
that share rare shingles with many others are compared with each of them.

Defined cases: null text is empty; texts without words have equal (empty) sets; a text of fewer than five words is one
shingle; of a component the row with the smallest doc_id stays (null last; then by text key); of rows that repeat one stays
(see keep_rows); long texts are read whole; an empty table stays empty; extra columns are kept unchanged, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, by_tile, keep_rows, saved, shuffle_partitions, text_key
from .simhash import components

SHINGLE, SIGNED, SIMILARITY = 5, 3, 0.8
#: Segments and their bits; bits beside them that go with each posting, and how many of them may differ; share of all bits in a family.
SEGMENTS, BITS, CHECK, CHECK_FAR, FAR = 18, 30, 23, 7, 0.15
#: Bits of a node's number within a task, and of both; with CHECK bits they fill a long.
WITHIN_TASK, NUMBER = 23, 40
#: Members of a family that its centre is chosen by, shingles of a tile's block, what a member counts beside its shingles, and shingles that are counted at once.
SAMPLE, BLOCK_SHINGLES, MEMBER, COLUMNS = 32, 1 << 17, 256, 4096
#: Shingles whose hashes are held at once.
BLOCK = 1024


def shingle_hashes(text: bytes, size: int = SHINGLE):
    """The distinct XXH64 of the shingles in order; A-Z lower-cased, words cut at U+0020 and U+0009 to U+000D."""
    import numpy as np
    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) > size else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64))


class _Bits:
    """Parity bits of the least hashes of a set, in segments, and the check bits."""

    def __init__(self):
        import hashlib

        import numpy as np

        count = SEGMENTS * BITS + CHECK
        drawn = np.frombuffer(hashlib.shake_128(b"near copies").digest(8 * count), "<u4")
        self.factors, self.added = drawn[:count] | 1, drawn[count:]
        self.weights, self.check = (np.int64(1) << np.arange(k, dtype=np.int64) for k in (BITS, CHECK))

    def __call__(self, hashes):
        """(segments, check bits) of distinct 64-bit hashes."""
        import numpy as np

        x, least = hashes.astype(np.uint32), np.full(len(self.factors), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), BLOCK):
            own = x[i : i + BLOCK, None] * self.factors
            own += self.added
            np.minimum(least, own.min(axis=0), out=least)
        bits = (np.bitwise_count(least) & 1).astype(np.int64)
        return bits[:-CHECK].reshape(SEGMENTS, BITS) @ self.weights, int(bits[-CHECK:] @ self.check)


_SIGNED = "doc_id long, text_key long, node long, n int, segments array<long>, check_bits long"


def _signatures(batches):
    """doc_id, text_key, text -> doc_id, text_key, node (hash of the shingle set), n (its size), segments, check_bits."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    fingerprint = _Bits()
    for batch in batches:
        nodes, sizes, segments, checks = [], [], [], []
        for x in pc.fill_null(batch.column("text"), "").cast(pa.binary()):
            h = shingle_hashes(x.as_py())
            nodes.append(xxhash.xxh64_intdigest(h.tobytes()))
            sizes.append(len(h))
            own, check = fingerprint(shingle_hashes(x.as_py(), SIGNED))
            segments.append(own)
            checks.append(check)
        flat = np.concatenate(segments) if segments else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, SEGMENTS), pa.int32()), pa.array(flat, pa.int64()))
        node = pa.array(np.array(nodes, np.uint64).view(np.int64))
        columns = [batch.column("doc_id"), batch.column("text_key"), node, pa.array(sizes, pa.int32()), lists, pa.array(checks, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "node", "n", "segments", "check_bits"])


def signatures(docs: DataFrame) -> DataFrame:
    """The signatures of docs (doc_id, text), saved."""
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return saved(rows.withColumn("text_key", text_key()).mapInArrow(_signatures, _SIGNED), "signatures")


def _sets(batches):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        node = batch.column("node")
        for at, x in enumerate(pc.fill_null(batch.column("text"), "").cast(pa.binary())):
            own = pa.array([shingle_hashes(x.as_py()).view(np.int64)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([node.slice(at, 1), own], names=["node", "shingles"])


def variants(nodes: DataFrame) -> DataFrame:
    """key, node: the one-wildcard variants of each segment; variant v has bit v % BITS of segment v / BITS cleared."""
    rows = nodes.select("node", F.posexplode("segments").alias("segment", "value"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("bit"))
    cleared = F.col("value").bitwiseAND(F.expr("~shiftleft(1L, bit)"))
    return rows.select(F.shiftleft((F.col("segment") * BITS + F.col("bit")).cast("long"), BITS).bitwiseOR(cleared).alias("key"), "node")


def _meetings(batches):
    """Rows in order of (key, node) -> segment, head, node: the smallest node of a bucket within CHECK_FAR check bits of each.

    A node is its number, then its check bits. Those that are near no head before become heads themselves.
    """
    import numpy as np
    import pyarrow as pa

    mask = np.int64((1 << CHECK) - 1)
    last, open_heads = None, np.empty(0, np.int64)  # of the bucket that the batch before left open
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, nodes = batch.column("key").to_numpy(), batch.column("node").to_numpy()
        found = []

        def meet(rows, heads, keys=keys, nodes=nodes, found=found):
            """Those of rows that are not near their heads."""
            near = np.bitwise_count((heads ^ nodes[rows]) & mask) <= CHECK_FAR
            found.append((keys[rows[near]], heads[near], nodes[rows[near]]))
            return rows[~near]

        left, goes_on = np.arange(len(keys)), int(np.searchsorted(keys, last, "right")) if last == keys[0] else 0
        more = open_heads if goes_on else np.empty(0, np.int64)
        for head in more:
            left = np.r_[meet(left[left < goes_on], np.repeat(head, int((left < goes_on).sum()))), left[left >= goes_on]]
        last, open_heads = keys[-1], more if goes_on == len(keys) else np.empty(0, np.int64)
        while len(left):  # the first row that is left of each bucket is a head
            new = np.r_[True, keys[left[1:]] != keys[left[:-1]]]
            heads = nodes[left[new]]
            open_heads = np.r_[open_heads, heads[keys[left[new]] == last]]
            left = meet(left[~new], heads[np.cumsum(new)[~new] - 1])
        found_k, found_h, found_n = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(3))
        columns = [pa.array(((found_k >> BITS) // BITS).astype(np.int32)), pa.array(found_h >> CHECK), pa.array(found_n >> CHECK)]
        yield pa.RecordBatch.from_arrays(columns, names=["segment", "head", "node"])


def _distance(a, b):
    """Number of differing bits of two arrays of segments."""
    each = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _similar(left, right, similarity: float):
    """Which sets of `left` and `right` (lists of sorted arrays) are similar: a matrix, by counts of common shingles."""
    import numpy as np

    names, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    sizes = np.array([len(x) for x in (*left, *right)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(names), COLUMNS):
        lo, hi = np.searchsorted(place, [at, at + COLUMNS])
        holds = np.zeros((len(sizes), min(COLUMNS, len(names) - at)), np.float32)
        holds[owner[lo:hi], place[lo:hi] - at] = 1
        both += holds[: len(left)] @ holds[len(left) :].T
    total = sizes[: len(left), None] + sizes[None, len(left) :] - both
    return both >= similarity * total - 1e-6


def _between(similarity: float):
    """Tiles of families -> a spanning forest of the similar pairs of different components."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for tile in by_tile(batches):
            node, root = tile.column("node").to_numpy(), tile.column("root").to_numpy()
            left, right = (np.flatnonzero(tile.column(c).to_numpy(zero_copy_only=False)) for c in ("left", "right"))
            sets = tile.column("shingles")
            near = _similar(*([sets[i].values.to_numpy() for i in side.tolist()] for side in (left, right)), similarity)
            p, q = np.nonzero(near & (root[left][:, None] != root[right][None]))
            group = {int(r): int(r) for r in root}
            kept = []
            for x, y in zip(left[p].tolist(), right[q].tolist()):
                a, b = int(root[x]), int(root[y])
                while group[a] != a:
                    a = group[a]
                while group[b] != b:
                    b = group[b]
                if a != b:
                    group[max(a, b)] = min(a, b)
                    kept.append((int(node[x]), int(node[y])))
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _sharing(members: DataFrame, similarity: float) -> DataFrame:
    """Members (key, node, root, shingles) of families in several components, with keys of those that may be similar.

    In the order of (documents of the family that have it, hash) two similar sets share one of the first shingles of each:
    the smaller set's up to what it must have in common with one of its own size, the larger's up to a set of `similarity`
    times its size. Rows are as many as shingles; a shingle's holders are linked to one of them.
    """
    parts = shuffle_partitions(members.sparkSession)
    several = members.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
    members = saved(members.join(several, "key"), "open-families")
    rows = members.select("key", "node", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    held = rows.groupBy("key", "s").agg(F.count("*").alias("held")).repartition(parts)
    places = rows.join(held, ["key", "s"]).withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("held", "s")))
    upto = lambda share: F.col("n") - F.ceil(F.lit(share) * F.col("n") - 1e-6) + 1
    first = places.where((F.col("held") > 1) & (F.col("place") <= upto(similarity)))
    first = saved(first.select("key", "s", "node", (F.col("place") <= upto(2 * similarity / (1 + similarity))).alias("smaller")), "rarest")
    heads = first.where("smaller").groupBy("key", "s").agg(F.min("node").alias("head")).repartition(parts)
    groups = components(first.join(heads, ["key", "s"]).select(F.col("head").alias("a"), F.col("node").alias("b")))
    return members.drop("key").join(groups.select("node", F.col("root").alias("key")), "node")


def _tiles(members: DataFrame, block: int) -> DataFrame:
    """Members (key, node, root, shingles) of groups in several components, in tiles by (key, lo, hi).

    The members of a group's largest component are only paired with the others, so its tiles are as many as the others'
    blocks times all blocks. A block has about `block` shingles (a member counts as MEMBER more).
    """
    counts = members.groupBy("key", "root").agg(F.sum(F.size("shingles") + MEMBER).alias("held"))
    largest = counts.groupBy("key").agg(F.max(F.struct("held", "root")).alias("most"), F.sum("held").alias("all"), F.count("*").alias("roots")).where("roots > 1")
    rows = members.join(largest.select("key", F.col("most.root").alias("main"), F.col("most.held").alias("inside"), (F.col("all") - F.col("most.held")).alias("outside")), "key")
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    main = F.col("root") == F.col("main")
    spread = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    rows = rows.withColumn("block", F.when(main, blocks("outside") + spread(blocks("inside"))).otherwise(spread(blocks("outside"))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(main, blocks("outside")).otherwise(blocks("outside") + blocks("inside")) - 1)))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    rows = rows.select("key", lo.alias("lo"), hi.alias("hi"), (F.col("block") == lo).alias("left"), (F.col("block") == hi).alias("right"), "node", "root", "shingles")
    return rows.repartition(shuffle_partitions(rows.sparkSession), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with a short `node` number: of the task, then of the row within it."""
    given = F.monotonically_increasing_id()
    task, within = F.shiftright(given, 33), given.bitwiseAND(F.lit((1 << 33) - 1))
    fits = (within < 1 << WITHIN_TASK) & (task < 1 << (NUMBER - WITHIN_TASK))
    return rows.withColumn("node", F.when(fits, F.shiftleft(task, WITHIN_TASK).bitwiseOR(within)).otherwise(F.raise_error(F.lit("more rows a task than numbers"))))


def similar_links(docs: DataFrame, signed: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK_SHINGLES) -> DataFrame:
    """a, b: verified links that join the same nodes as all similar pairs of a family do. signed: rows of signatures()."""
    parts = shuffle_partitions(docs.sparkSession)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("row")
    whole = signed.groupBy("node").agg(first, F.min(F.struct("n", "segments", "check_bits")).alias("own")).where("own.n > 0")
    # short numbers for the nodes, which go into many buckets
    firsts = saved(_numbered(whole.select(F.col("node").alias("hash"), "row", "own.segments", "own.check_bits")), "nodes")
    keyed = variants(firsts.select(F.shiftleft("node", CHECK).bitwiseOR(F.col("check_bits")).alias("node"), "segments").repartition(parts))
    keyed = keyed.repartition(parts, "key").sortWithinPartitions("key", "node")
    met = keyed.mapInArrow(_meetings, "segment int, head long, node long")
    # the smallest head of each node and segment: at most SEGMENTS a node, however many it meets
    met = met.groupBy("node", "segment").agg(F.min("head").alias("head")).select("head", "node").distinct()
    own = lambda c, s: firsts.select(F.col("node").alias(c), F.col("segments").alias(s))
    near = met.select(F.col("head").alias("a"), F.col("node").alias("b")).join(own("b", "sb"), "b").join(own("a", "sa"), "a")
    families = components(near.where(_distance("sa", "sb") <= int(FAR * SEGMENTS * BITS)).select("a", "b"))

    # the sets of all members of families, from the one text that each node is named by
    named = families.select("node", F.col("root").alias("key")).join(firsts.select("node", "segments", F.col("row.doc_id").alias("own_id"), F.col("row.text_key").alias("own_key")), "node")
    named = saved(named, "families")
    rows = named.select("node", "own_id", "own_key")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", text_key())
    texts = texts.join(rows, texts.doc_id.eqNullSafe(rows.own_id) & (texts.text_key == rows.own_key)).select("node", "text")
    sets = saved(bounded(texts).mapInArrow(_sets, "node long, shingles array<long>").dropDuplicates(["node"]), "shingles")

    # a family's centre: the member with the least distance to the SAMPLE members with the smallest hashes
    order = F.xxhash64("node")
    sampled = Window.partitionBy("key").orderBy(order, "node")
    few = named.groupBy("key", (F.pmod(order, F.lit(64))).alias("part")).agg(F.min(F.struct(order.alias("o"), "node", "segments")).alias("one"))
    few = few.select("key", "one.node", "one.segments").withColumn("nth", F.row_number().over(sampled)).where(F.col("nth") <= SAMPLE)
    few = few.groupBy("key").agg(F.collect_list("segments").alias("sample"))
    far = F.aggregate("sample", F.lit(0), lambda s, x: s + _distance(x, F.col("segments")))
    centres = named.join(few, "key").groupBy("key").agg(F.min(F.struct(far.alias("far"), "node")).alias("one")).select("key", F.col("one.node").alias("centre"))
    centres = centres.join(sets.withColumnsRenamed({"node": "centre", "shingles": "own"}), "centre")
    members = saved(named.select("key", "node").join(sets, "node"), "members")
    both = F.size(F.array_intersect("shingles", "own"))
    enough = both >= F.lit(similarity) * (F.size("shingles") + F.size("own") - both) - 1e-6
    links = saved(members.join(centres, "key").where((F.col("node") != F.col("centre")) & enough).select(F.col("centre").alias("a"), F.col("node").alias("b")), "links")

    roots = components(links)
    held = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = _tiles(_sharing(held.select("key", "node", "root", "shingles"), similarity), block).mapInArrow(_between(similarity), "a long, b long")
    links = links.union(rest)
    names = firsts.select("node", "hash")
    links = links.join(names.withColumnsRenamed({"node": "a", "hash": "x"}), "a").join(names.withColumnsRenamed({"node": "b", "hash": "y"}), "b")
    return links.select(F.col("x").alias("a"), F.col("y").alias("b"))


def drop_similar(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs with the smallest doc_id of each component of similar documents (null last), with all columns."""
    signed = signatures(docs)
    roots = components(similar_links(docs, signed, similarity))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("row")
    owned = signed.groupBy("node").agg(first).join(roots, "node", "left")
    best = owned.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("row").alias("row"))
    best = best.select(F.col("row.doc_id").alias("own_id"), F.col("row.text_key").alias("own_key"))
    copies = signed.groupBy("doc_id", "text_key").agg(F.count("*").alias("copies"))
    members = copies.join(best, copies.doc_id.eqNullSafe(best.own_id) & (copies.text_key == best.own_key), "left")
    return keep_rows(docs, members.select("doc_id", "text_key", "copies", F.col("own_key").isNotNull().alias("keep")))
