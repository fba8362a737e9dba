"""Token counts, decontamination, licence scans and the quality model against brute force and held-out labels."""

import functools
import re
import textwrap
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from data import edge_docs, frame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, processors

from stridelake.llm import decontaminate, license_texts, licenses, quality_crf, queries, token_counts
from stridelake.llm.unit_encoder import UnitEncoder

BPE = str(public_tokenizers.path("byte_bpe_50k.json"))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


#: Runs of blanks between, before and after words.
BLANKS = [a + x + b for x in (" ", "\n", "  ", "\n\n", " \n", "\n ", "\t \t", "\n\n\n", " \t", "\x85 \x85", "\x1c \x1c", "\xa0", " 's ", "<|endoftext|>", "\n\n<|endoftext|>", "don't", " ...x_1!", "\r\n") for a in ("", "foo", "foo,") for b in ("", "bar", "!bar", "7")]


def test_ids_equal_those_of_whole_texts(small):
    tok = Tokenizer.from_file(BPE)
    texts = [t for _, t in small[:80]] + BLANKS
    for text, got in zip(texts, UnitEncoder(BPE).ids(texts)):
        assert np.frombuffer(got, "<u2").tolist() == tok.encode(text, add_special_tokens=False).ids, text


@functools.lru_cache
def spanned():
    tok = Tokenizer.from_file(BPE)
    tok.post_processor = processors.ByteLevel(trim_offsets=False)
    return tok


def whole_spans(text):
    return spanned().encode(text, add_special_tokens=False).offsets


def test_spans_equal_those_of_whole_texts(small):
    texts = [t for _, t in small[:80]] + [t or "" for _, t, *_ in edge_docs()] + BLANKS
    for text, got in zip(texts, UnitEncoder(BPE, spans=True).spans(texts)):
        assert [tuple(x) for x in got.tolist()] == whole_spans(text)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution_by_rule(spark, rule):
    text = "alpha beta  gamma\n\n\ndelta 日本語"
    spans = [{"name": n, "start": a, "end": b} for n, a, b in [("p", 0, 3), ("q", 3, 12), ("r", 12, 19), ("s", 20, len(text))]]
    df = spark.createDataFrame([(1, text, spans)], "doc_id long, text string, spans array<struct<name:string,start:int,end:int>>")
    got = {r.name: r.n_tokens for r in token_counts.section_tokens(df, BPE, rule, "spans").collect()}
    want = Counter()
    for s, e in whole_spans(text):
        e = max(e, s + 1)
        held = {x["name"]: max(0, min(e, x["end"]) - max(s, x["start"])) for x in spans}
        held[None] = e - s - sum(held.values())
        if rule == "split":
            for k, v in held.items():
                want[k] += v / (e - s)
        elif rule == "first":
            want[next((x["name"] for x in spans if x["start"] <= s < x["end"]), None)] += 1
        else:
            want[max([k for k in held if k] + [None], key=lambda k: held[k])] += 1
    assert {k: round(v, 9) for k, v in got.items() if v} == {k: round(v, 9) for k, v in want.items() if v}


def test_line_counts_add_up(spark):
    got = token_counts.section_tokens(frame(spark), BPE).toPandas()
    assert len(edge_docs()) == (got.section == 0).sum()
    assert got.n_tokens.sum() == sum(len(whole_spans(t or "")) for _, t, *_ in edge_docs())
    assert token_counts.section_tokens(frame(spark, []), BPE).count() == 0
    rows = spark.createDataFrame([(1, "user", None), (2, None, "hello there")], "turn long, role string, text string")
    fields = token_counts.section_tokens(token_counts.fields_as_sections(rows, "turn", ["role", "text"]), BPE, spans="spans").collect()
    assert {(r.doc_id, r.name): r.n_tokens for r in fields if r.name} == {(1, "role"): 1, (1, "text"): 0, (2, "role"): 0, (2, "text"): 2}


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_lines_against_a_slow_count(spark, small, rule):
    docs = small[:25] + [(1000 + k, t) for k, (_, t, *_) in enumerate(edge_docs())] + [(2000, "one\n\n  two \n" * 40), (2001, "long word\nnext " * 9000)]
    got = {(r.doc_id, r.section): (round(r.n_tokens, 6), r.n_crossing) for r in token_counts.section_tokens(spark.createDataFrame(docs, "doc_id long, text string"), BPE, rule).collect()}
    want = {}
    for d, text in docs:
        text = text or ""
        line = np.zeros(len(text), np.int64)
        for i, c in enumerate(text[:-1]):
            line[i + 1] = line[i] + (c == "\n")
        count, crossing = Counter(), Counter()
        for s, e in whole_spans(text):
            held = Counter(line[s : max(e, s + 1)].tolist())
            for k in held:
                crossing[k] += len(held) > 1
            if rule == "split":
                for k, v in held.items():
                    count[k] += v / sum(held.values())
            else:
                count[int(line[s]) if rule == "first" else max(held, key=lambda k: (held[k], -k))] += 1
        if rule != "split":
            crossing = None
        for k in range(int(line[-1]) + 1 if len(text) else 1):
            want[d, k] = (round(count[k], 6), None if crossing is None else crossing[k])
    assert got.keys() == want.keys()
    assert {k: (got[k], v, c) for k, (v, c) in want.items() if abs(got[k][0] - v) > 1e-5 or c is not None and got[k][1] != c} == {}


def leaks_by_hand(docs, bench, min_score=decontaminate.MIN_SCORE):
    cut = lambda t: [w for w in re.split(r"[^\w]+|_+", (t or "").lower()) if w]
    items = [(i, cut(t)) for i, t in bench]
    found = set()
    for d, t in docs:
        w = cut(t)
        for i, b in items:
            if len(b) < decontaminate.MIN_WORDS:
                continue
            masks = list(decontaminate.MASKS) if len(b) >= 12 else ["1" * len(b)]
            for diagonal in range(-len(b) + 1, len(w)):
                same = [0 <= diagonal + j < len(w) and w[diagonal + j] == x for j, x in enumerate(b)]
                hit = any(all(same[j + o] for o, c in enumerate(m) if c == "1") and 0 <= diagonal + j and diagonal + j + len(m) <= len(w) for m in masks for j in range(len(b) - len(m) + 1))
                if hit:
                    run = best = 0
                    for j, s in enumerate(same):
                        if 0 <= diagonal + j < len(w):
                            run = max(0, run + (1 if s else -2))
                            best = max(best, run)
                    if best >= min(min_score, len(b)):
                        found.add((d, i))
    return found


@pytest.mark.parametrize("bound,shared", [(0, 256), (10**6, 256), (0, 0), (10**6, 0), (10**6, 2)])
def test_decontamination(spark, bound, shared):
    rng = np.random.default_rng(3)
    say = lambda n: [f"v{x}" for x in rng.integers(0, 5000, n)]
    bench = [(i, say(n)) for i, n in enumerate([4, 6, 11, 12, 16, 30, 50])]
    docs = [(None, None), (0, ""), (1, " ".join(say(200)))]
    for i, words in bench:
        for k, every in enumerate([0, 9, 7, 3]):
            changed = [f"z{j}" if every and j % every == every - 1 else w for j, w in enumerate(words)]
            docs.append((100 * i + k + 2, " ".join(say(30)) + " " + ", ".join(changed).upper() + "! " + " ".join(say(30))))
        docs.append((100 * i + 50, " ".join(words[: len(words) // 2 + 1])))
    docs += docs[-2:]
    bench = [(i, " ".join(w)) for i, w in bench] + [(None, None), (99, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"words": F.lit(1), "pos": F.lit(2), "seed": F.lit(3)})
    items = spark.createDataFrame(bench, "item_id long, text string").withColumn("words", F.lit("x"))
    got = decontaminate.contaminated(df, items, broadcast_seeds=bound, shared=shared).collect()
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    assert {(r.doc_id, r.item_id) for r in got} == leaks_by_hand(docs, bench)
    assert {(100 * i + k + 2, i) for i in (3, 4, 5, 6) for k in range(2)} <= {(r.doc_id, r.item_id) for r in got}
    kept = decontaminate.decontaminate(df, items, broadcast_seeds=bound)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {r.doc_id for r in got}
    assert decontaminate.contaminated(frame(spark, []), items).count() == 0
    assert decontaminate.contaminated(frame(spark), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_every_licence_is_found_in_other_guise(spark):
    docs, want = [], {}
    for name in license_texts.TEXTS:
        for edition in license_texts.editions(license_texts.TEXTS[name]):
            flat = re.sub(r"[ \t]+", " ", edition)
            for text in ("Copyright (c) 1999-2024 Some Body\nAll rights reserved.\n\n" + flat.upper(), flat.replace("license", "licence").replace(",", " ;").replace('"', "``"), edition.replace("\n", "\r\n"), edition + "\nand more"):
                want[len(docs)] = None if text.endswith("more") else name
                docs.append((len(docs), text))
    got = {r.doc_id: r.license_id for r in licenses.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def wrapped(text, width):
    """text with each paragraph wrapped at width; None: one line a paragraph, 0: all on one line."""
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", text.strip())]
    if width == 0:
        return " ".join(paragraphs)
    return "\n\n".join(p if width is None else textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in paragraphs)


def test_every_licence_is_found_at_any_width(spark):
    """Copyright statements are wrapped with the rest; a further one is a paragraph of its own, on one line or two."""
    docs, want = [], {}
    for name, text in license_texts.TEXTS.items():
        for width in (50, 55, 60, 66, 70, 72, 76, 80, 90, 100, None, 0):
            for head in ("", "Copyright (c) 2019-2024 Some Body\n\n", "Copyright 2020 The Authors of a Very Long\nProject Name. All rights reserved.\n\n"):
                want[len(docs)] = None if head and width == 0 else name
                docs.append((len(docs), head + wrapped(text, width) if width != 0 or not head else "some words " + wrapped(text, width)))
    got = {r.doc_id: r.license_id for r in licenses.license_scan(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect()}
    assert got == want


def test_licence_sql_is_the_same_at_any_width(spark, tmp_path):
    docs = [(k, f"Copyright 2021 X Y\n\n{wrapped(license_texts.TEXTS[n], width)}") for k, (n, width) in enumerate((n, w) for n in ("Apache-2.0", "GPL-2", "MIT", "BSD", "LGPL-3") for w in (50, 66, None, 0))]
    spark.createDataFrame([*docs, (99, None), (100, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL["op5_license_scan"])
    names = [d[0] for d in want.description]
    got = queries.op5_license_scan(spark, str(tmp_path)).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    assert sum(r.license_id is not None for r in got) >= 15


def test_license_scan(spark):
    mit = license_texts.TEXTS["MIT"]
    docs = [(1, "Copyright (c) 2020 A. Nother\n\n" + mit.upper()), (2, mit.replace("License", "Licence").replace("\n\n", "\n").replace(",", " -- ")), (3, mit + " more"), (4, "Text.\n  released under the MIT  licence\nEnd"), (5, None), (6, ""), (None, "# LICENSED under CC BY-NC 4.0"), (7, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.\nReleased under the MIT license"), (8, "x\n" * 60_000 + "Released under the MIT License."), (9, mit.split("\n", 1)[1])]
    df = spark.createDataFrame(docs + docs[-3:-2] * 3, "doc_id long, text string").withColumns({"lines": F.lit(1), "digest": F.lit(2), "bits": F.lit(3)})
    got = {r.doc_id: (r.license_id, r.notices, r.notice_lines) for r in licenses.license_scan(df).collect()}
    assert got == {1: ("MIT", "", 0), 2: ("MIT", "", 0), 3: (None, "", 0), 4: (None, "MIT", 1), 5: (None, "", 0), 6: (None, "", 0), None: (None, "CC-BY-NC-4.0", 1), 7: (None, "CC-BY-NC-4.0,MIT", 3), 8: (None, "MIT", 1), 9: ("MIT", "", 0)}
    assert licenses.license_scan(df).count() == len(docs) + 3
    assert licenses.license_scan(frame(spark, [])).count() == 0
    assert {r.license_id for r in licenses.license_scan(df, {"A": "Text"}, {}).collect()} == {None}


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_crf.quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == r.quality for r in got]) > 0.97
    assert np.mean([r.predicted for r in got if r.quality == 1]) > 0.98


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    sizes, table = np.array([1, 4, 3]), rng.normal(size=(2, 2))
    e = rng.normal(size=8)
    alpha, beta = quality_crf.marginals(e, sizes, table)
    at = 0
    for n in sizes:
        total, good = 0.0, np.zeros(n)
        for bits in range(1 << n):
            y = [bits >> k & 1 for k in range(n)]
            p = np.exp(sum(e[at + k] for k in range(n) if y[k]) + sum(table[y[k], y[k + 1]] for k in range(n - 1)))
            total += p
            good += p * np.array(y)
        assert np.allclose(1 / (1 + np.exp(-(alpha + beta)[at : at + n])), good / total)
        at += n


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(4)
    sizes = np.array([1, 3, 2])
    x, y, w = rng.normal(size=(6, 3)), rng.integers(0, 2, 6), np.repeat(rng.random(3), sizes)

    def likelihood(theta, table):
        total, at = 0.0, 0
        for n in sizes:
            e, own = x[at : at + n] @ theta, y[at : at + n]
            score = lambda z: sum(e[k] for k in range(n) if z[k]) + sum(table[z[k], z[k + 1]] for k in range(n - 1))
            all_ = np.log(sum(np.exp(score([b >> k & 1 for k in range(n)])) for b in range(1 << n)))
            total += w[at] * (score(own) - all_)
            at += n
        return total

    theta, table = rng.normal(size=3), rng.normal(size=(2, 2))
    by_weight, by_table = quality_crf.gradient(x, y, w, sizes, theta, table)
    for got, want in ((by_weight, theta), (by_table, table)):
        for k in np.ndindex(want.shape):
            step = np.zeros(want.shape)
            step[k] = 1e-5
            ends = [likelihood(theta + s * step, table) if want is theta else likelihood(theta, table + s * step) for s in (1, -1)]
            assert abs((ends[0] - ends[1]) / 2e-5 - got[k]) < 1e-6


def test_document_score_against_a_slow_one():
    rng = np.random.default_rng(6)
    n_own = quality_crf.N_OWN
    model = quality_crf.LineCrf(rng.normal(size=2 * n_own + 1).tolist(), rng.normal(size=(2, 2)).tolist())
    texts = ["one line", "", "a\nBB 12\n\n!!! ### x", "first\nsecond line here\nthird 3"]
    table = np.array(model.table)
    for text, got in zip(texts, model.scores(texts)):
        lines = text.split("\n")
        own = [np.array(quality_crf.line_features(x)) for x in lines]
        zero, n = np.zeros(n_own), len(lines)
        e = [float(np.r_[own[k], ((own[k - 1] if k else zero) + (own[k + 1] if k + 1 < n else zero)) / 2, 1.0] @ model.weights) for k in range(n)]
        total, good = 0.0, np.zeros(n)
        for bits in range(1 << n):
            z = [bits >> k & 1 for k in range(n)]
            p = np.exp(sum(e[k] for k in range(n) if z[k]) + sum(table[z[k], z[k + 1]] for k in range(n - 1)))
            total, good = total + p, good + p * np.array(z)
        weight = np.array([len(x) + 1 for x in lines])
        assert abs(got - (good / total @ weight) / weight.sum()) < 1e-9


def test_sample_is_bounded_in_ids_and_lines(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([(i, "line\n" * 1000) for i in ids for _ in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    got = quality_crf.sample(docs, labels, sample_rows=5, sample_lines=30).collect()
    assert len(got) == 10 and {len(r.own) // 4 // quality_crf.N_OWN for r in got} == {30}


def test_quality_edges(spark):
    a, b, c, *_ = (i for i, *_ in edge_docs() if i and i < 16 and zlib.crc32(str(i).encode()) % 3 != 1)
    labels = spark.createDataFrame([(a, None), (None, 1), (b, 1), (b, 1)], "doc_id long, quality int")
    got = quality_crf.quality(frame(spark), labels).collect()
    assert len(got) == len(edge_docs()) and {r.score for r in got} == {1.0}
    mixed = labels.union(spark.createDataFrame([(a, 0), (c, 0)], "doc_id long, quality int"))
    got = quality_crf.quality(frame(spark), mixed).collect()
    assert len(got) == len(edge_docs()) and all(0 <= r.score <= 1 for r in got)
    assert quality_crf.quality(frame(spark, []), labels).count() == 0
    assert {r.score for r in quality_crf.quality(frame(spark), labels.limit(0)).collect()} == {0.5}
