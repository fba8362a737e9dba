"""Spelling variants against all pairs by brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from data import frame

from stridelake.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, drop_every=97, min_length=5, min_count=3):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    own = {w: n for w, n in count.items() if len(w) >= min_length and n >= min_count}
    by = defaultdict(list)  # by lengths, so that all pairs are few enough
    for w in own:
        by[len(w)].append(w)
    found, form = {}, {}
    for w, n in own.items():
        found[w] = [y for k in (-1, 0, 1) for y in by[len(w) + k] if near(w, y)]
        if found[w] and own[best := min(found[w], key=lambda y: (-own[y], y))] >= 2 * n:
            form[w] = best
    out = {}
    for w, n in own.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(found[w]), own.get(form.get(w)))
    return out


def got(df, **more):
    rows = spelling.spelling_variants(df, **more).collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op12_spelling_variants(spark, SF).collect()}
    assert out == plain(rows)


@pytest.mark.parametrize("letters,most", [("ab", 20_000), ("ab", 8), ("aé÷z", 8), ("aé÷z", 20_000)])
def test_dense_words_in_small_and_large_lists(spark, letters, most):
    rng = random.Random(len(letters) * 7 + most)
    words = ["".join(rng.choice(letters) for _ in range(rng.choice((5, 6, 7, 8, 11, 12)))) for _ in range(700)]
    words += [w + "aaaaaaaaaa" for w in words[:100]] + ["bbbbbbbbbb" + w for w in words[:100]]
    rows = [(i, " ".join(rng.choices(words, k=400))) for i in range(15)]
    df = frame(spark, [(i, t, "en", None, len(t), "k", "w") for i, t in rows])
    assert got(df, most=most) == plain(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "nullid Nullid NULLID"), (3, "Größe größe GRößE GRÖßE grÖße x÷yzab"), (3, "cafés cafés cafés"), (3, "cafés cafés cafés"), (4, "日本語 word1word wordword word_word wordword wordword"), (5, "chain " * 3 + "chains " * 6 + "chainss " * 12 + "chainsss " * 24), (6, "a\n" * 50_000 + "lengthy-lengthy " * 40_000)]
    df = frame(spark, [(i, t, "en", None, 0, "k", "w") for i, t in rows]).selectExpr("*", "1 AS word", "2 AS n", "3 AS cut", "4 AS near")
    out = got(df)
    assert out == plain(rows)
    assert out["chain"][:2] == ("chains", "chainsss")
    assert got(frame(spark, [])) == {}


def test_unaffected_grams_are_those_of_all_edits(spark):
    """The bound never promises more than what is left after the worst edit, tried one by one."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abc") for _ in range(rng.randrange(5, 10))) for _ in range(300)]
    vocab = spark.createDataFrame([(w,) for w in sorted(set(vocabulary))], "word string")
    index = spelling.GramIndex(spelling.gram_dictionary(vocab, least=20))
    assert index.longer

    def sides(s, cut, left):
        return {(s[a:b], a) if left else (s[a:b], len(s) - b) for a, b in index.decompose(s) if (b <= cut if left else a >= cut)}

    for w in vocabulary[:60]:
        s = spelling.FIRST + w + spelling.LAST
        worst = len(s)
        for i in range(1, len(s)):
            changed = [(s[:i] + c + s[i:], i, i) for c in "abcd"]
            if i < len(s) - 1:
                changed += [(s[:i] + c + s[i + 1 :], i, i + 1) for c in ("", *"abcd") if c != s[i]]
            for t, before, after in changed:
                grown = after + len(t) - len(s)
                same = len(sides(s, before, True) & sides(t, before, True)) + len(sides(s, after, False) & sides(t, grown, False))
                worst = min(worst, same)
        assert index.unaffected(s, index.decompose(s)) <= worst
