"""Binary token records, WARC archives, exact dedup and SimHash against brute force."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from data import edge_docs, frame
from tokenizers import Tokenizer

from stridelake.llm import common, exact_dedup, simhash, token_records, warc

BPE = str(public_tokenizers.path("byte_bpe_50k.json"))
BLANK, WORD = re.compile(r"[\x20\x09-\x0D]"), re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def small(spark):
    return [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, text string")


def test_token_records_equal_whole_text_encoding(spark, small):
    tok = Tokenizer.from_file(BPE)
    docs = [(i, t) for i, t in small] + [(1000 + (i or 0), t) for i, t, *_ in edge_docs()]
    got = sorted(map(tuple, token_records.token_records(rows(spark, docs), BPE, 2).collect()))
    want, start = [], 0
    for i, t in sorted(docs, key=lambda d: (d[0], d[1] or "")):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((g[0], g[2], g[3]) for g in got) == sorted((w[0], w[2], w[3]) for w in want)
    assert [g[1] for g in sorted(got, key=lambda g: g[1])] == [w[1] for w in want]


def test_token_records_nulls_empty_table_and_clashing_columns(spark):
    got = token_records.token_records(frame(spark), BPE, 2).collect()
    assert len(got) == len(edge_docs()) and {r.doc_id for r in got if r.start == 0} == {None}
    assert token_records.token_records(frame(spark, []), BPE, 2).count() == 0


def test_damage_is_found_and_shuffled_reads_are_whole(spark, small):
    manifest = token_records.write_records(rows(spark, small), common.shared_dir(spark, "t"), BPE, 2, wide=True)
    tok = Tokenizer.from_file(BPE)
    got = {r.doc_id: r.ids for r in token_records.read_shuffled(spark, manifest, 3).collect()}
    assert got == {i: tok.encode(t, add_special_tokens=False).ids + [2] for i, t in small}
    path = manifest[0][1] + ".rec"
    data = bytearray(open(path, "rb").read())
    data[40] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="damaged record"):
        token_records.read_records(spark, manifest).collect()


def test_warc_round_trip(spark):
    pages = [(1, "http://a/", "<p>x</p>", "c"), (2, None, "<p>x</p>", "c"), (3, "u v\n", None, "c"), (4, "u", "", "c"), (5, "u", "ünï\r\n\r\nWARC/1.1", "c"), (None, "u", "<p>x</p>", "c"), (7, "u", "same", "c"), (7, "u", "same", "c"), (None, "u", "alone", "c")]
    got = warc.warc_round(spark.createDataFrame(pages, "page_id long, url string, html string, sha1 string")).collect()
    want = []
    for p, _, html, _ in pages:
        body = (html or "").encode()
        origin = max((q for q, _, h, _ in pages if (h or "").encode() == body and q is not None), default=None)
        want.append((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if p == origin else "revisit", None if p == origin else origin))
    assert Counter(map(tuple, got)) == Counter(want)
    kept = warc.warc_round(spark.createDataFrame(pages, "page_id long, url string, html string, sha1 string"), min_bytes=5).collect()
    assert {r.record_type for r in kept if r.payload_bytes < 5} == {"response"}
    assert warc.warc_round(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def exact_by_hand(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[BLANK.sub("", t or "")].append((i, t or ""))
    out = []
    for body, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        seen = False
        for m in members:
            kept = not seen and m == best
            seen |= kept
            out.append((m[0], best[0], len(members), kept, hashlib.sha256(body.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("capacity", [1, 512])
def test_exact_dedup(spark, small, capacity):
    docs = small + [(i, t) for i, t, *_ in edge_docs()]
    assert Counter(map(tuple, exact_dedup.exact_dedup(rows(spark, docs), capacity).collect())) == exact_by_hand(docs)


def test_exact_dedup_edges_and_chains(spark, monkeypatch):
    docs = [(i, t) for i, t, *_ in edge_docs()]
    assert Counter(map(tuple, exact_dedup.exact_dedup(frame(spark)).collect())) == exact_by_hand(docs)
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    index = exact_dedup.build_index(frame(spark), 2).collect()
    assert max(r.depth for r in index) > min(r.depth for r in index)  # a bucket was split
    saved = exact_dedup.build_index(frame(spark), 2)
    new = rows(spark, [(100, "samerow"), (101, "not there"), (102, " " + "x" * 40000), (103, None)])
    assert {tuple(r) for r in exact_dedup.probe(saved, new).collect()} == {(100, 16), (102, 17), (103, 6)}
    # keys that collide are told apart by their bytes
    import zstandard

    pack = lambda b: bytearray(zstandard.ZstdCompressor().compress(b))
    entries = [(5, bytearray(b"a" * 32), pack(b"a"), 1, 1, 4), (5, bytearray(b"b" * 32), pack(b"b"), 2, 1, 2), (5, bytearray(b"a" * 32), pack(b"a"), 3, 1, 3)]
    df = spark.createDataFrame(entries, exact_dedup.ENTRY).coalesce(1)
    (bucket,) = df.mapInArrow(exact_dedup._own(common.shared_dir(spark, "own"), 1, 512), exact_dedup.BUCKET).collect()
    assert bucket.n_keys == 1
    asked = spark.createDataFrame([(k, 0, 1, bytearray(x * 32), 5, bucket.file, bucket.offset, bucket.length) for k, x in enumerate((b"a", b"b", b"c"))], "doc_id long, text_key long, cp int, sha binary, key long, file string, offset long, length long")
    got = asked.coalesce(1).mapInArrow(exact_dedup._look_up(False), "doc_id long, text_key long, cp int, sha binary, found boolean, keep_id long, keep_cp int, group_size long").collect()
    assert [(g.found, g.keep_id, g.group_size) for g in got] == [(True, 3, 4), (True, 2, 2), (False, None, None)]


def test_exact_dedup_of_hot_groups(spark, monkeypatch):
    """A third of the rows equal, many of them under one id; numbered in pieces."""
    monkeypatch.setattr(common, "COPIES", 7)
    docs = [(None, "")] * 40 + [(5, "a b")] * 30 + [(k, "ab") for k in range(40)] + [(k, f"text {k} {k % 9}") for k in range(100, 160)]
    assert Counter(map(tuple, exact_dedup.exact_dedup(rows(spark, docs), 2).collect())) == exact_by_hand(docs)
    kept = Counter(map(tuple, exact_dedup.drop_copies(rows(spark, docs), 2).collect()))
    assert kept == Counter({(None, ""): 1, (5, "a b"): 1} | {d: 1 for d in docs[110:]})


@pytest.mark.parametrize("most", [0, 10**6])
def test_rows_that_repeat_keep_the_least(spark, most):
    df = spark.createDataFrame([(1, "x", "b"), (1, "x", "a"), (2, "y", None), (3, "z", "q")], "doc_id long, text string, own string")
    members = df.groupBy("doc_id", common.text_key().alias("text_key")).count().withColumnRenamed("count", "copies").selectExpr("*", "doc_id < 3 as keep")
    assert sorted(map(tuple, common.keep_rows(df, members, most).collect())) == [(1, "x", "a"), (2, "y", None)]


def test_equal_rows_spread_over_record_files(spark):
    df = rows(spark, [(1, "same text")] * 4000).repartition(8)
    manifest = token_records.write_records(df, common.shared_dir(spark, "spread"), BPE, 2)
    assert len(manifest) > 1 and sum(m[2] for m in manifest) == 4000


def simhash_by_hand(docs):
    fps = []
    for i, t in docs:
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return fps, components_by_hand([d[0] for d in docs], fps)


def components_by_hand(ids, fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    first = {}
    for k, i in enumerate(ids):
        r = find(k)
        first[r] = i if first.get(r) is None else first[r] if i is None else min(first[r], i)
    return [first[find(k)] for k in range(len(fps))]


def test_simhash(spark, small):
    docs = small + [(i if i is None else 5000 + i, t) for i, t, *_ in edge_docs()]
    fps, comp = simhash_by_hand(docs)
    want = Counter((d[0], f"{f:016x}", c) for d, f, c in zip(docs, fps, comp))
    assert Counter(map(tuple, simhash.near_dedup(rows(spark, docs)).collect())) == want
    assert simhash.near_dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("small_bucket", [2, 64])
def test_links_find_every_component(spark, monkeypatch, small_bucket):
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small_bucket)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    rng = np.random.default_rng(small_bucket)
    fps = []
    for _ in range(12):  # chains and clouds of near fingerprints
        at = int(rng.integers(0, 1 << 63)) * 2 + 1
        for _ in range(25):
            at ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))
            fps.append(at)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash.fingerprint_links(nodes)
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert [got.get(f, f) for f in signed] == components_by_hand(signed, fps)


@pytest.mark.parametrize("tile", [16, 4096])
def test_links_of_one_hot_bucket(spark, tile):
    """All fingerprints share one segment, so they share its 32 buckets."""
    rng = np.random.default_rng(tile)
    fps = sorted({0xABCDEF01 << 32 | int(x) for x in rng.integers(0, 1 << 11, 400)} | {0xABCDEF01 << 32 | int(x) << 13 for x in rng.integers(0, 1 << 19, 300)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), tile=tile)
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert [got.get(f, f) for f in signed] == components_by_hand(signed, fps)


def test_warc_dates(spark):
    import gzip
    from datetime import UTC, datetime

    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    for date in (None, datetime(2021, 5, 6, 7, 8, 9, tzinfo=UTC)):
        ((path, _),) = warc.write_archives(pages, common.shared_dir(spark, "dates"), date=date)
        (head, _, _), = warc.parse_archive(gzip.open(path.removeprefix("file:")))
        found = datetime.strptime(head["warc-date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC)
        assert found == date if date else abs((datetime.now(UTC) - found).total_seconds()) < 600
