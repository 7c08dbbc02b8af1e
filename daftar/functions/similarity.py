"""Similarity of names and addresses. Only the matching-blocks ratio needs Python; it runs on Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from daftar.functions import text as T


@lru_cache(maxsize=1 << 16)
def _ratio(left: str, right: str) -> float:
    return SequenceMatcher(None, left, right).ratio() if left and right else 0.0


def _ratios(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([_ratio(a or "", b or "") for a, b in zip(left, right)], dtype="float64")


def sequence_score(left: Column, right: Column) -> Column:
    """Share of characters in matching blocks of two normalized texts; 0 if one is empty. Not symmetric."""
    return F.pandas_udf(_ratios, "double")(left, right)


#: Letters up to which texts are compared many at once, the places of a letter as bits of a word.
SHORT = 63


def _matching(e: np.ndarray) -> np.ndarray:
    """Characters in matching blocks of each pair. ``e``: where its letters agree, by letter of the left text (rows) and
    pair (columns), a bit for each letter of the right one. As SequenceMatcher does, the longest run is taken, of equal
    ones the first of the left text and then of the right one, and what is before and what is after it goes on."""
    rows, one = np.arange(e.shape[0])[:, None], np.uint64(1)
    total = np.zeros(e.shape[1], np.int64)
    of = np.flatnonzero(e.any(axis=0))
    e = e[:, of]
    while of.size:
        i, j, k = np.empty(of.size, np.int64), np.empty(of.size, np.uint64), np.empty(of.size, np.int64)
        runs, open_, length = e, np.arange(of.size), 1
        while open_.size:
            longer = runs[:-1] & (runs[1:] >> one)
            on = longer.any(axis=0)
            done = open_[~on]
            if done.size:
                last = runs[:, ~on]
                i[done], k[done] = (last != 0).argmax(axis=0), length
                word = last[i[done], np.arange(done.size)]
                j[done] = np.bitwise_count((word & (~word + one)) - one)
            runs, open_, length = longer[:, on], open_[on], length + 1
        total += np.bincount(of, k, total.size).astype(np.int64)
        before = np.where(rows < i, e & ((one << j) - one), 0)
        after = np.where(rows >= i + k, e & ~((one << (j + k.astype(np.uint64))) - one), 0)
        x, y = before.any(axis=0), after.any(axis=0)
        e, of = np.concatenate([before[:, x], after[:, y]], axis=1), np.concatenate([of[x], of[y]])
    return total


def ratios(texts: list[str], left: np.ndarray, right: np.ndarray, at_once: int = 8192) -> np.ndarray:
    """The score of pairs of texts, given by their numbers in ``texts``: what ``sequence_score`` gives, many at once."""
    length = np.array([len(t) for t in texts], np.int64)
    known = {c: i for i, c in enumerate(sorted({c for t in texts if len(t) <= SHORT for c in t}), 1)}
    letter, places = np.zeros((SHORT, len(texts)), np.int64), np.zeros((len(texts), len(known) + 1), np.uint64)
    for x, text in enumerate(texts):
        if len(text) <= SHORT:
            for j, c in enumerate(text):
                letter[j, x] = known[c]
                places[x, known[c]] |= np.uint64(1 << j)
    out = np.zeros(left.size)
    short = (length[left] <= SHORT) & (length[right] <= SHORT)
    for pair in np.flatnonzero(~short):
        out[pair] = _ratio(texts[left[pair]], texts[right[pair]])
    some = np.flatnonzero(short & (length[left] > 0) & (length[right] > 0))
    for start in range(0, some.size, at_once):
        now = some[start : start + at_once]
        a, b = left[now], right[now]
        common = _matching(places.ravel()[letter[: length[a].max()][:, a] + b * places.shape[1]])
        out[now] = 2.0 * common / (length[a] + length[b])
    return out


def sequence_bound(left: Column, right: Column) -> Column:
    """What the score can be at most, from the lengths; native."""
    a, b = F.length(left), F.length(right)
    return F.when((a > 0) & (b > 0), 2.0 * F.least(a, b) / (a + b)).otherwise(0.0)


_BIT = {c: 1 << i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789 ./-")}


def _letters(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        once, twice, thrice, rest = 0, 0, 0, 0
        for c in text or "":
            # All other characters count as one.
            bit = _BIT.get(c, 1 << 40)
            if not once & bit:
                once |= bit
            elif not twice & bit:
                twice |= bit
            elif not thrice & bit:
                thrice |= bit
            else:
                rest += 1
        rows.append((once, twice, thrice, rest))
    return pd.DataFrame(rows, columns=["once", "twice", "thrice", "rest"], dtype="int64")


def letters(text: Column) -> Column:
    """Which characters a text has once, twice and three times at least, as bits, and how many beyond."""
    return F.pandas_udf(_letters, "once long, twice long, thrice long, rest long")(text)


def letters_bound(a: Column, b: Column, length_a: Column, length_b: Column) -> Column:
    """What the score of two texts can be at most, from their ``letters``; native."""
    common = reduce(Column.__add__, [F.bit_count(a[c].bitwiseAND(b[c])) for c in ("once", "twice", "thrice")]) + F.least(a["rest"], b["rest"])
    return F.when((length_a > 0) & (length_b > 0), 2.0 * common / (length_a + length_b)).otherwise(0.0)


def name_profile(norm_name: Column) -> list[Column]:
    """Columns of a fingerprint that pair scoring needs, computed once per record and not per pair."""
    tokens = T.name_tokens(norm_name)
    return [
        tokens.alias("tokens"),
        T.alias_tokens(tokens).alias("aliases"),
        T.phonetic_codes(tokens).alias("codes"),
        T.counts(T.char_ngrams(norm_name)).alias("grams"),
        T.initials(tokens).alias("inits"),
        T.surname(tokens).alias("surname"),
        T.first_initial(tokens).alias("first"),
        F.array_join(F.array_sort(T.alias_tokens(tokens)), " ").alias("sorted_aliases"),
    ]
