"""Recompression of word sequences: runs and pairs of symbols are named anew, level by level.

A level first names each maximal run of one symbol (symbol, length), then pairs: the alphabet is split into left and right
symbols by a bit of their names, and each left symbol before a right one is named together with it. A name is a hash of
what it stands for, so equal interiors get equal names in every document and task without a dictionary being shuffled.

Whether a symbol comes out as it does depends on the words of its `region` only: its own, and those of the neighbours that
were looked at. Regions at the ends of a document reach outside it. The symbols whose regions lie inside a window of words
depend on nothing but its words. Its `anchor` is one of them: on the highest level that has enough of them (level 0 always
has), the one with the least scrambled name. So equal windows, wherever they are, share their anchor's name and place.
"""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the hash of a word, and of the two hashes of a stretch of words.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Rounds of pairs; every RUN_EVERY-th begins by naming runs. An anchor is chosen among at least CHOICES symbols of a level.
LEVELS, RUN_EVERY, CHOICES = 3, 3, 5

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_spans(data: np.ndarray, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes, cut at U+0020 and U+0009 to U+000D; only block by block in full width."""
    starts, ends, before = [], [], True
    for at in range(0, len(data), block):
        blank = _BLANK[data[at : at + block]]
        edge = np.diff(np.concatenate([[before], blank]).view(np.int8))
        starts.append(np.flatnonzero(edge == -1).astype(np.int64) + at)
        ends.append(np.flatnonzero(edge == 1).astype(np.int64) + at)
        before = bool(blank[-1])
    if not before:
        ends.append(np.array([len(data)]))
    empty = [np.empty(0, np.int64)]
    return np.concatenate(starts + empty), np.concatenate(ends + empty)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    sizes = ends - starts
    inside = np.arange(len(data)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
    inside[_BLANK[data]] = 0  # blanks count for nothing
    value = (data.astype(np.uint64) + np.uint64(1)) * powers(BYTE_BASE, int(sizes.max()) + 1)[inside]
    value[_BLANK[data]] = 0
    return mix(np.add.reduceat(value, starts) + sizes.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def _runs(name, left, right, at, size, head):
    """One symbol for each maximal run; it has to see the symbol on either side."""
    n = len(name)
    new = np.ones(n, bool)
    new[1:] = (name[1:] != name[:-1]) | head[1:]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], n] - 1
    count = (last - first + 1).astype(np.uint64)
    named = np.where(count > 1, mix(name[first] ^ (count * np.uint64(0xD1B54A32D192ED03)), 1), name[first])
    end = np.r_[head[1:], True]
    lo = np.where(head[first], at[first] - 1, left[np.maximum(first - 1, 0)])
    hi = np.where(end[last], at[last] + size[last] + 1, right[np.minimum(last + 1, n - 1)])
    total = at[last] + size[last] - at[first]
    return named, np.minimum(lo, left[first]), np.maximum(hi, right[last]), at[first], total, head[first]


def _pairs(name, left, right, at, size, head, level):
    """One symbol for each left symbol before a right one; the others have to see the symbol that they did not pair with."""
    n = len(name)
    is_right = (mix(name, level + 2) & np.uint64(1)).astype(bool)
    end = np.r_[head[1:], True]
    joins = ~is_right & ~end & np.r_[is_right[1:], False]
    gone = np.r_[False, joins[:-1]]
    keep = np.flatnonzero(~gone)
    pair = joins[keep]
    after, before = np.minimum(keep + 1, n - 1), np.maximum(keep - 1, 0)
    named = np.where(pair, mix(name[keep] * np.uint64(3) ^ mix(name[after], 7), 11), name[keep])
    hi_alone = np.where(end[keep], at[keep] + size[keep] + 1, right[after])
    hi = np.where(pair, right[after], np.where(is_right[keep], right[keep], hi_alone))
    lo_alone = np.where(head[keep], at[keep] - 1, left[before])
    lo = np.where(~pair & is_right[keep], lo_alone, left[keep])
    return named, np.minimum(lo, left[keep]), np.maximum(hi, right[keep]), at[keep], size[keep] + np.where(pair, size[after], 0), head[keep]


def _leftmost_least(priority: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the least priority in each range lo..hi-1 (none empty), of equal ones the first."""
    width = int((hi - lo).max())
    tables, span = [np.arange(len(priority))], 1
    while 2 * span <= width:
        a, b = tables[-1][:-span], tables[-1][span:]
        tables.append(np.where(priority[a] <= priority[b], a, b))
        span *= 2
    k = np.frexp((hi - lo).astype(np.float64))[1] - 1
    out = np.empty(len(lo), np.int64)
    for i, table in enumerate(tables):
        of = np.flatnonzero(k == i)
        a, b = table[lo[of]], table[hi[of] - (1 << i)]
        out[of] = np.where(priority[a] <= priority[b], a, b)
    return out


def window_runs(hashes: np.ndarray, sizes: np.ndarray, window: int, levels: int = LEVELS):
    """Runs of windows with one anchor, for documents of `sizes` words laid end to end.

    Returns (document, start of the first window in it, number of windows, key, content). The key names the anchor with
    the half window of words before it (where it lies in the right half of its windows) or from it on; all of these lie
    inside each window, so equal windows have equal keys. The content is a hash of all words that the run's windows cover.
    """
    n_windows = np.maximum(sizes - window + 1, 0)
    if not n_windows.sum():
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    # places leave room between documents, so that a region that reaches outside never fits a window
    word0 = np.cumsum(sizes) - sizes
    begin = word0 + 2 * np.arange(len(sizes)) + 1
    at = np.arange(len(hashes)) + np.repeat(begin - word0, sizes)
    head = np.zeros(len(hashes), bool)
    head[word0[sizes > 0]] = True
    stack = [(hashes, at, at + 1, at, np.ones(len(at), np.int64), head)]
    for level in range(levels):
        symbols = stack[-1]
        stack.append(_pairs(*(_runs(*symbols) if level % RUN_EVERY == 0 else symbols), level))
    owner = np.repeat(np.arange(len(sizes)), n_windows)
    open_ = np.arange(len(owner)) + np.repeat(begin - np.cumsum(n_windows) + n_windows, n_windows)
    top = int(at[-1]) + window + 3
    place, start = np.arange(len(owner)), open_
    anchor, spot = np.zeros(len(owner), np.uint64), np.zeros(len(owner), np.int64)
    for level in range(len(stack) - 1, -1, -1):
        name, left, right, first = stack[level][:4]
        # regions follow one another: those inside a window are from the first that begins in it to the last that ends in it
        lo = np.concatenate([[0], np.cumsum(np.bincount(left, minlength=top))])[open_]
        hi = np.cumsum(np.bincount(right, minlength=top))[open_ + window]
        fits = hi - lo >= (CHOICES if level else 1)
        got = place[fits]
        if len(got):
            j = _leftmost_least(mix(name, 200), lo[fits], hi[fits])
            anchor[got], spot[got] = mix(name[j], 100 + level), first[j]
        open_, place = open_[~fits], place[~fits]
    before = spot - start >= window // 2
    new = np.ones(len(owner), bool)
    new[1:] = (spot[1:] != spot[:-1]) | (anchor[1:] != anchor[:-1]) | (before[1:] != before[:-1]) | (owner[1:] != owner[:-1])
    i = np.flatnonzero(new)
    count, owner, before = np.diff(np.r_[i, len(owner)]), owner[i], before[i]
    offset = start[i] - begin[owner]
    word = spot[i] - begin[owner] + word0[owner]
    half = window // 2
    total, back = _sums(hashes, 1)
    side = np.where(before, word - half, word)
    context = (total[side + half] - total[side]) * back[side]
    key = mix(mix(context, 3) ^ anchor[i] ^ before.astype(np.uint64))
    total, back = _sums(hashes, 0)
    a = offset + word0[owner]
    content = mix((total[a + count + window - 1] - total[a]) * back[a] + count.astype(np.uint64), 5)
    return owner, offset, count, key, content


def _sums(hashes: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums for hashes of stretches of words, and the factors that bring a stretch to its own start."""
    base = WORD_BASES[which]
    p = powers(base, len(hashes) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(hashes * p[:-1])]), powers(pow(base, -1, 1 << 64), len(hashes) + 1)
