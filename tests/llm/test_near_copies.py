"""The near-copy stage against all pairs by exact similarity."""

import random
from itertools import combinations

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stridelake.llm import near_copies

SF = "/root/testdata/sf0.001"


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def similar_by_hand(rows):
    sets = {d: shingles(t) for d, t in rows}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}


def kept_by_hand(ids, links):
    root = {i: i for i in ids}
    while any(root[a] != root[b] for a, b in links):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return {i for i in ids if root[i] == i}


def edited(rng, words, edits):
    out = list(words)
    for at in rng.sample(range(0, len(out), 6), edits):
        out[at] = f"z{rng.random()}"
    return " ".join(out)


def test_stage_finds_all_similar_pairs(spark):
    rng = random.Random(5)
    rows = []
    for group in range(40):
        words = [f"g{group}w{rng.randrange(900)}" for _ in range(300)]
        rows += [(10 * group + k, edited(rng, words, k)) for k in range(10)]
    rng.shuffle(rows)
    links = similar_by_hand(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near(spark, df, SF).collect()}
    assert got == kept_by_hand(sorted(d for d, _ in rows), links) and len(links) > 100


def test_stage_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id for r in corpus_pipeline.near(spark, docs, SF).collect()}
    assert got == kept_by_hand(sorted(d for d, _ in rows), similar_by_hand(rows))


@pytest.mark.parametrize("block", [1000, 1 << 17])
def test_pairs_that_miss_the_smallest_node_are_compared(spark, block):
    """One fingerprint for all, of six groups: most links do not touch a bucket's smallest node."""
    words = [[f"c{c}w{i}" for i in range(120)] for c in range(6)]
    rows = [(10 * c + k, " ".join(["same same same same same", *words[c], f"t{k}"])) for c in range(6) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_key", F.xxhash64("text"))
    one = near_copies.signatures(df).withColumn("segments", F.array_repeat(F.lit(5).cast("long"), near_copies.SEGMENTS)).withColumn("check_bits", F.lit(0).cast("long"))
    assert near_copies.components(near_copies.similar_links(df, one, block=block)).groupBy("root").count().count() == 6


def test_meetings_over_batches():
    keys = [k << near_copies.BITS for k in (1, 1, 1, 2, 3, 3, 40, 40, 40, 40, 50)]
    far = (1 << near_copies.CHECK) - 1
    checks = [0, 3, 1, 0, 0, 1, 0, far, 1, far - 2, 0]
    nodes = [i << near_copies.CHECK | c for i, c in enumerate(checks)]
    want = [(0, 0, 1), (0, 0, 2), (0, 4, 5), (1, 6, 8), (1, 7, 9)]
    for step in range(1, 12):
        batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + step], pa.int64()) for x in (keys, nodes)], names=["key", "node"]) for i in range(0, 11, step)]
        got = [tuple(r.values()) for b in near_copies._meetings(batches) for r in b.to_pylist()]
        assert sorted(got) == want


def test_variants_meet_exactly_within_one_bit(spark):
    rng = random.Random(1)
    bits = near_copies.BITS
    base = [rng.randrange(1 << bits) for _ in range(near_copies.SEGMENTS)]
    far = [x ^ 0b101 for x in base]
    one = list(far)
    one[7] = base[7] ^ 1 << bits - 1
    nodes = spark.createDataFrame([(1, base), (2, far), (3, one)], "node long, segments array<long>")
    keys = {}
    for r in near_copies.variants(nodes).collect():
        keys.setdefault(r.key, set()).add(r.node)
    assert {frozenset(v) for v in keys.values() if len(v) > 1} == {frozenset({1, 3}), frozenset({2, 3})}
    assert [k >> bits for k, v in keys.items() if v == {1, 3}] == [7 * bits + bits - 1]


def test_bits_differ_by_half_of_what_sets_do_not_share():
    rng = np.random.default_rng(2)
    own = near_copies._Bits()
    for share in (0.0, 0.5, 0.8, 0.9):
        far = []
        for _ in range(60):
            n = int(rng.integers(40, 4000))
            both = round(n * 2 * share / (1 + share))
            x = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
            a, b = own(x[:n]), own(x[n - both :])
            far.append(int(np.bitwise_count(a[0] ^ b[0]).sum()) / (near_copies.SEGMENTS * near_copies.BITS))
        assert abs(np.mean(far) - (1 - share) / 2) < 0.02


#: Copies of similarity 0.8 of 304 words: words replaced all over, in one place, a block put in, a tail appended, text cut off.
EDITS = {
    "replaced": lambda w, new: [new[i] if i % 51 == 25 else x for i, x in enumerate(w)],
    "replaced block": lambda w, new: w[:100] + new[:28] + w[128:],
    "inserted": lambda w, new: w[:140] + new[:65] + w[140:],
    "appended": lambda w, new: w + new[:74],
    "cut": lambda w, new: w[:244],
}


@pytest.mark.parametrize("kind", EDITS)
def test_reach_does_not_depend_on_the_kind_of_edit(spark, kind):
    """200 pairs at the threshold itself; widths are those of every size of table."""
    rng, rows = random.Random(kind), []
    for k in range(200):
        words, new = ([f"{c}{rng.randrange(20_000)}" for _ in range(304)] for c in "wn")
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(EDITS[kind](words, new)))]
    sets = {d: shingles(t) for d, t in rows}
    alike = [len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) for k in range(200)]
    assert 0.8 <= min(alike) and max(alike) < 0.82
    kept = near_copies.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert 400 - kept >= 0.94 * 200


@pytest.mark.parametrize("own", [40, 70, 150])
def test_pages_of_one_template_do_not_meet(spark, own):
    """1,500 pages of one template and contents of their own (similarity 0.76, 0.62 and 0.39), and ten copies of one of them."""
    rng = random.Random(own)
    template = [f"t{i}" for i in range(300)]
    rows = [(i, " ".join([*template, *(f"c{rng.randrange(1 << 30)}" for _ in range(own))])) for i in range(1500)]
    rows += [(2000 + k, rows[3][1] + f" tail{k}") for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = []
    real = near_copies._tiles
    near_copies._tiles = lambda members, block: made.append(near_copies.saved(real(members, block), "tiles")) or made[0]
    try:
        got = {r.doc_id for r in near_copies.drop_similar(df).collect()}
    finally:
        near_copies._tiles = real
    assert got == set(range(1500)) and made[0].count() <= 50


def test_similar_sets_are_those_of_the_definition(monkeypatch):
    monkeypatch.setattr(near_copies, "COLUMNS", 7)
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 30, n)) for n in rng.integers(1, 40, 60)] + [np.arange(8), np.arange(10)]
    got = near_copies._similar(sets[:40], sets[30:], 0.8)
    want = [[len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)) - 1e-9 for b in map(np.ndarray.tolist, sets[30:])] for a in map(np.ndarray.tolist, sets[:40])]
    assert got.tolist() == want and near_copies._similar(sets[-1:], sets[-2:-1], 0.8)[0, 0]


def test_reach_against_all_pairs_on_a_larger_table(spark):
    """Share of pairs of similarity 0.8 or more (found by shared shingles) that end in one component."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = {d: shingles(t) for d, t in rows}
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    together = {p for ds in holders.values() for p in combinations(ds, 2)}
    links = {(a, b) for a, b in together if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}
    kept = {r.doc_id for r in near_copies.drop_similar(docs).collect()}
    want = kept_by_hand(sorted(sets), links)
    assert want <= kept and len(kept - want) <= 0.02 * (len(sets) - len(want))


@pytest.mark.parametrize(
    "links",
    [
        [(i, i + 1) for i in range(40)],
        [(-5, i) for i in range(30)] + [(i, 100) for i in range(30)] + [(7, -5), (-5, 7)],
        [(i, 99) for i in range(40)],
        [(i * 37 % 101 - 50, i * 53 % 89 - 40) for i in range(60)],
        [(7, 7)],
        [],
    ],
)
def test_components_are_those_of_a_plain_search(spark, links):
    want = {x: x for a, b in links if a != b for x in (a, b)}
    for _ in want:
        for a, b in links:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    got = near_copies.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == want
