"""Similarity of dialogue texts as Arrow-batched functions (the pluggable score of anchor search)."""

from __future__ import annotations

import difflib
import functools
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as t

WORD = re.compile(r"[a-z0-9']{2,}")
_CJK = re.compile("[㐀-鿿぀-ヿ가-힯]")


def _ratio(a, b, autojunk: bool = True) -> float:
    return difflib.SequenceMatcher(None, a, b, autojunk=autojunk).ratio()


#: From this length on difflib begins blocks only at characters that are rare in the second text.
_AUTOJUNK = 200


@functools.lru_cache(16)
def _rare_places(b: str) -> dict[str, list[int]]:
    places: dict = {}
    for j, c in enumerate(b):
        places.setdefault(c, []).append(j)
    return {c: js for c, js in places.items() if len(js) <= len(b) // 100 + 1}


def _matched_from_rare(a: str, b: str) -> int:
    """Characters in the matching blocks of `a` and a long `b`: the longest run of rare characters, and what is equal around it."""
    places = _rare_places(b)
    at = [i for i, c in enumerate(a) if c in places]
    matched, left = 0, [(0, len(a), 0, len(b))]
    while left:
        alo, ahi, blo, bhi = left.pop()
        i, j, size, runs, last = alo, blo, 0, {}, -2
        for x in at[bisect_left(at, alo):bisect_left(at, ahi)]:
            before, runs = runs if x == last + 1 else {}, {}
            last = x
            for y in places[a[x]]:
                if blo <= y < bhi:
                    k = runs[y] = before.get(y - 1, 0) + 1
                    if k > size:
                        i, j, size = x - k + 1, y - k + 1, k
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        if size:
            matched += size
            if alo < i and blo < j:
                left.append((alo, i, blo, j))
            if i + size < ahi and j + size < bhi:
                left.append((i + size, ahi, j + size, bhi))
    return matched


def _matched(a: str, b: str) -> int:
    """Characters in the matching blocks of two texts. The longest block is sought by searching for ever longer pieces of one
    text in the other, so the steps are searches and not characters times characters."""
    matched, left = 0, [(a, b)]
    while left:
        x, y = left.pop()
        n, size, at, i = len(x), 0, 0, 0
        while i + size < n:  # the first of the longest blocks counts
            while i + size < n and x[i:i + size + 1] in y:
                size, at = size + 1, i
            i += 1
        if size:
            j, matched = y.find(x[at:at + size]), matched + size
            if at and j:
                left.append((x[:at], y[:j]))
            if at + size < n and j + size < len(y):
                left.append((x[at + size:], y[j + size:]))
    return matched


def char_ratio(a: str, b: str) -> float:
    """`SequenceMatcher(None, a, b).ratio()` of two texts."""
    found = _matched_from_rare if len(b) >= _AUTOJUNK else _matched
    return 2.0 * found(a, b) / (len(a) + len(b)) if a or b else 1.0


def _f1(common: int, n: int, m: int) -> float:
    return 2 * common / (n + m) if n + m else 0.0


def dialogue_similarity(a: str | None, b: str | None) -> float:
    """Order-sensitive similarity of two cleaned texts: words, characters, bag of words."""
    if not a or not b:
        return 0.0
    u, v = WORD.findall(a), WORD.findall(b)
    chars = char_ratio(a, b)
    if not u or not v:
        return chars * 0.7
    bag = _f1(sum((Counter(u) & Counter(v)).values()), len(u), len(v))
    return 0.50 * _ratio(u, v) + 0.30 * chars + 0.20 * bag


@F.pandas_udf(t.DoubleType())
def dialogue_score(expected: pd.Series, observed: pd.Series) -> pd.Series:
    return pd.Series([dialogue_similarity(a, b) for a, b in zip(expected, observed)], dtype=float)


@F.pandas_udf(t.StructType([t.StructField(n, t.DoubleType()) for n in ("dialogue", "semantic")]))
def text_scores(expected: pd.Series, observed: pd.Series) -> pd.DataFrame:
    """`dialogue_similarity`, and a tolerant similarity of two key texts; character pairs stand for words in CJK.

    The ratio of the characters serves both, and an observed text that stands in several rows in turn is read once.
    """
    ordered, last, v, bag = difflib.SequenceMatcher(), None, [], Counter()

    def one(a, b):
        nonlocal last, v, bag
        if not a or not b:
            return 0.0, 0.0
        if b != last:
            last, v = b, WORD.findall(b)
            bag = Counter(v)
            ordered.set_seq2(v)
        u, ratio = WORD.findall(a), char_ratio(a, b)
        dialogue = ratio * 0.7
        if u and v:
            ordered.set_seq1(u)
            dialogue = 0.50 * ordered.ratio() + 0.30 * ratio + 0.20 * _f1(sum((Counter(u) & bag).values()), len(u), len(v))
        if _CJK.search(a) or _CJK.search(b):
            x, y = ({text[i:i + 2] for i in range(max(0, len(text) - 1))} for text in (a, b))
            weight = 1.0
        else:
            x, y, weight = set(u), set(v), 0.6
        return dialogue, max(ratio * weight, _f1(len(x & y), len(x), len(y)) if x and y else 0.0)

    return pd.DataFrame([one(a, b) for a, b in zip(expected, observed)], columns=["dialogue", "semantic"], dtype=float)


_ENDS = ("matched", "longest", "gaps", "first_a", "first_b", "last_a", "last_b")


def _codes(a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
    numbers: dict = {}
    return tuple(np.fromiter((numbers.setdefault(x, len(numbers)) for x in side), np.int64, len(side)) for side in (a, b))


def _alignment(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index pairs of a longest common subsequence. A row of lengths falls by one or not at all from word to word, so it is
    one number whose set bits mark the falls; a row follows from the one below it by an addition. Two texts of 20,000 words take 50 MB."""
    a, b = a.tolist(), b.tolist()
    n, m = len(a), len(b)
    at: dict = {}
    for j, word in enumerate(b):
        at[word] = at.get(word, 0) | 1 << (m - 1 - j)
    full = (1 << m) - 1
    falls, level = [0] * (n + 1), full
    for i in range(n - 1, -1, -1):
        met = level & at.get(a[i], 0)
        level = ((level + met) | (level - met)) & full
        falls[i] = full ^ level
    pairs, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif (falls[i + 1] & ((1 << (m - j)) - 1)).bit_count() >= (falls[i] & ((1 << (m - j - 1)) - 1)).bit_count():
            i += 1
        else:
            j += 1
    return np.array(pairs, dtype=np.int64).reshape(-1, 2)


@F.pandas_udf(t.StructType([t.StructField(n, t.IntegerType()) for n in _ENDS]))
def common_subsequence(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Longest common subsequence of two token arrays: size, longest contiguous run, gaps, ends."""
    def one(a, b):
        pairs = _alignment(*_codes(list(a), list(b)))
        if not len(pairs):
            return (0, 0, 0, -1, -1, -1, -1)
        breaks = np.flatnonzero((np.diff(pairs, axis=0) != 1).any(axis=1)) + 1
        runs = np.diff(np.concatenate([[0], breaks, [len(pairs)]]))
        return (len(pairs), int(runs.max()), len(breaks), *pairs[0].tolist(), *pairs[-1].tolist())

    return pd.DataFrame([one(a, b) for a, b in zip(left, right)], columns=list(_ENDS)).astype("int32")
