"""Evaluation texts leaking into training text: which documents hold passages of which test items.

Method: spaced-seed hashing. A mask looks at some word positions of a window and ignores the others; test
and training windows with equal hashes under the same mask are joined, and each hit is verified by
extending it over both texts, tolerating so many substituted words. With no substitution allowed, one mask
whose span is at most the passage length misses nothing; with s substitutions, the masks below are chosen
so that each pattern of s substitutions inside the passage leaves one of them whole somewhere.

Test windows have a bounded size only if the test set has; so their number is counted, and up to
``TABLE_LIMIT`` hashes go to the workers, which then let through only windows that can hit. Beyond that the
windows of both sides are joined by shuffle. Either way hits carry positions only, and whole texts meet
each other again by document id. Hot test windows (phrases of a form) are kept: a document's hits with an
item are one row per diagonal before texts are compared.

Words are compared case-folded, by compatibility form, without punctuation and invisible characters.

Defined results: null, empty and blank texts and items hold nothing; repeated rows give the pair once;
an item with fewer words than the passage length is never found.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from daftar.runtime import spread

#: Test hashes (8 bytes each) that may be shipped to every worker.
TABLE_LIMIT = 2_000_000

_DROP = re.compile(r"[^\w\s]|_")
_ASCII_DROP = {c: None for c in range(128) if not chr(c).isalnum() and not chr(c).isspace()}


def words(text: str | None) -> list[str]:
    """The words of a text in comparable form: what is neither letter, digit nor white space is dropped, and
    with it punctuation, marks and invisible characters."""
    if not text:
        return []
    if text.isascii():
        return text.lower().translate(_ASCII_DROP).split()
    return _DROP.sub("", unicodedata.normalize("NFKC", text).casefold()).split()


def masks(passage: int, substitutions: int) -> list[tuple[int, ...]]:
    """Seeds as tuples of looked-at offsets, all of them within ``passage`` words.

    A set is complete if each choice of s substituted positions leaves one seed unharmed at some place inside
    the passage. Seeds with two ignored positions are added while the set isn't, then an unbroken seed of
    passage // (s + 1) words, which is always enough."""
    if substitutions == 0:
        return [tuple(k for k in range(passage) if k % 4 != 2)]
    block = max(1, passage // (substitutions + 1))
    spaced = [tuple(k for k in range(span) if k not in (span // 3, 2 * span // 3)) for span in range(min(passage, block + 6), block + 1, -2)]
    seeds: list[tuple[int, ...]] = []
    for seed in [*spaced, tuple(range(block))]:
        seeds.append(seed)
        if all(any(not any(at + k in bad for k in x) for x in seeds for at in range(passage - x[-1])) for bad in map(set, combinations(range(passage), substitutions))):
            break
    return seeds


def hashes(of: list[str], mask: tuple[int, ...]) -> np.ndarray:
    """The hash of each window under the mask (as signed 64-bit numbers)."""
    n = len(of) - mask[-1]
    if n <= 0:
        return np.empty(0, np.int64)
    numbers = np.fromiter(map(xxh64_intdigest, of), np.uint64, len(of))
    out = np.zeros(n, np.uint64)
    for offset in mask:
        out = out * np.uint64(0x9E3779B97F4A7C15) + numbers[offset : offset + n]
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def windows(table: DataFrame, key: str, text: str, seeds: list[tuple[int, ...]], only=None) -> DataFrame:
    """(key, seed, at, hash) of each window of each text; ``only``: a broadcast sorted array to be hit."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = only.value if only is not None else None
        for part in parts:
            out = []
            for k, t in zip(part[key], part[text]):
                w = words(t)
                for s, mask in enumerate(seeds):
                    h = hashes(w, mask)
                    at = np.arange(len(h))
                    if wanted is not None and len(h):
                        at = at[wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h] if len(wanted) else at[:0]
                    if len(at):
                        out.append((k, s, at, h[at]))
            if out:
                sizes = [len(x[2]) for x in out]
                yield pd.DataFrame({"k": np.repeat([x[0] for x in out], sizes), "seed": np.repeat([x[1] for x in out], sizes), "at": np.concatenate([x[2] for x in out]), "hash": np.concatenate([x[3] for x in out])})

    rows = table.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text)
    return rows.mapInPandas(run, f"k {dict(rows.dtypes)[key]}, seed int, at bigint, hash bigint").withColumnRenamed("k", key)


def longest(a: list[str], b: list[str], shift: int, substitutions: int) -> int:
    """Most consecutive words of b (an item), on the diagonal a[i] ~ b[i - shift], with so many substitutions."""
    start, end = max(0, shift), min(len(a), len(b) + shift)
    best, wrong, left = 0, [], start
    for i in range(start, end):
        if a[i] != b[i - shift]:
            wrong.append(i)
            if len(wrong) > substitutions:
                left = wrong.pop(0) + 1
        best = max(best, i + 1 - left)
    return best


def leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "item_text", passage: int = 15, substitutions: int = 0, table_limit: int = TABLE_LIMIT) -> DataFrame:
    """(doc, item, words): each document and item that share a passage of ``passage`` words or more."""
    spark, seeds = documents.sparkSession, masks(passage, substitutions)
    doc_rows, item_rows = spread(documents.select(doc, text)), items.select(item, item_text)
    tests = windows(item_rows, item, item_text, seeds)
    only = None
    if tests.select(F.count("*")).first()[0] <= table_limit:
        # Bounded by table_limit: 16 MB at most.
        listed = tests.select("hash").distinct().toPandas()["hash"].to_numpy(np.int64)
        only = spark.sparkContext.broadcast(np.sort(listed))
    hits = windows(doc_rows, doc, text, seeds, only).withColumnRenamed("at", "doc_at").join(tests.withColumnRenamed("at", "item_at"), ["seed", "hash"])
    diagonals = hits.select(doc, item, (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct()

    @F.pandas_udf("int")
    def verified(docs: pd.Series, tests: pd.Series, shifts: pd.Series) -> pd.Series:
        known: dict[str, list[str]] = {}
        out = []
        for a, b, s in zip(docs, tests, shifts):
            if b not in known:
                known[b] = words(b)
            out.append(max(longest(words_of(a), known[b], x, substitutions) for x in s))
        return pd.Series(out, dtype="int32")

    by_pair = diagonals.groupBy(doc, item).agg(F.collect_set("shift").alias("shifts"))
    texts = doc_rows.filter(F.col(text).isNotNull())
    joined = by_pair.join(texts.withColumnRenamed(text, "_text"), doc).join(item_rows.filter(F.col(item_text).isNotNull()).withColumnRenamed(item_text, "_item"), item)
    found = joined.select(doc, item, verified("_text", "_item", "shifts").alias("words")).filter(F.col("words") >= passage)
    return found.groupBy(doc, item).agg(F.max("words").alias("words"))


@lru_cache(maxsize=4)
def words_of(text: str) -> list[str]:
    """The same document often follows itself with another item."""
    return words(text)
