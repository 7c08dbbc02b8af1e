"""Splitting oversized texts at natural boundaries.

Method: lexical cohesion. A text falls into sentences and lines; the words of ``block`` units before and
after each gap are compared by cosine, and a gap where the similarity falls below its surroundings is a
valley, a likely change of topic. From each start the deepest valley within the size window is the cut
(paragraphs before lines before sentences where valleys are equally deep). The next piece starts so many
tokens earlier, at a word. A unit longer than the window is cut between words, and a stretch without any
break inside it, never inside a character.

Sizes are tokens of the public byte-level vocabulary, counted for the piece by itself, the overlap
included. Documents are independent: no shuffle, one pass, a document's memory is a task's.

Defined results: a null text has one piece with null text and 0 tokens, an empty one an empty piece; texts
within the limit are one piece; pieces cover the text without holes; repeated rows repeat their pieces.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm.encode import VOCABULARY, Vocabulary, vocabulary, words_of
from daftar.runtime import spread

#: Tokens of a word beyond which the word itself is cut; less where the limit is small.
LONG_WORD = 32
#: Tokens of one character at most, so the smallest limit.
CHARACTER = 4
#: What ends a unit: its mark and what closes it, before the space that follows: words of the vocabulary begin with it.
_END = re.compile(r"(?:[.!?](?=\s|\Z)|[۔؟])[.!?۔؟]*[\"'”’)\]]*(?:[ \t]*\n+)?|\n+")
_WORDS = re.compile(r"[^\W\d_]{3,}")


def atoms(text: str, known: Vocabulary, most: int = LONG_WORD) -> tuple[list[int], list[int], bool]:
    """Ends and token counts of the words of a text (those of more than ``most`` tokens in parts), and whether any
    was cut."""
    words, remembered = words_of(text), known.words
    sizes = [len(remembered.get(w) or known.word(w)) for w in words]
    if max(sizes, default=0) <= most:
        return list(accumulate(map(len, words))), sizes, False
    ends, counts, at = [], [], 0
    for word, size in zip(words, sizes):
        if size <= most:
            at += len(word)
            ends.append(at)
            counts.append(size)
            continue
        ids, held, here = known.word(word), bytearray(), 0
        for token in ids:
            held += known.bytes[token]
            here += 1
            if here >= most - 3:
                try:
                    part = held.decode("utf-8")
                except UnicodeDecodeError:
                    continue
                at += len(part)
                ends.append(at)
                counts.append(len(known.read(known.extend(bytes(held), []))))
                held, here = bytearray(), 0
        if held:
            at += len(held.decode("utf-8", "surrogatepass"))
            ends.append(at)
            counts.append(len(known.read(known.extend(bytes(held), []))))
    return ends, counts, True


def units(text: str) -> list[int]:
    """Ends of the sentences and lines of a text."""
    ends = [m.end() for m in _END.finditer(text)]
    return ends if ends and ends[-1] == len(text) else [*ends, len(text)]


def similarities(words: np.ndarray, unit: np.ndarray, n: int, block: int) -> np.ndarray:
    """Cosine of the words of ``block`` units before and after each of the n - 1 gaps; ``words`` as numbers, each with
    its unit.

    Two occurrences of a word add to a product at the gaps that have one in each block, and to a square at the gaps
    that have both in one; these are ranges of gaps, so all are summed by their ends."""
    order = np.lexsort((unit, words))
    words, unit = words[order], unit[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (unit[1:] != unit[:-1])
    start = np.flatnonzero(new)
    words, unit, times = words[start], unit[start], np.diff(np.append(start, len(new))).astype(float)
    dot, before, after = np.zeros(n + 2 * block + 2), np.zeros(n + 2 * block + 2), np.zeros(n + 2 * block + 2)

    def add(to: np.ndarray, low: np.ndarray, high: np.ndarray, weight: np.ndarray) -> None:
        """``weight`` to the gaps from ``low`` to ``high``; a gap has the number of the unit after it."""
        low, high = np.maximum(low, 1), np.minimum(high, n - 1) + 1
        keep = low < high
        to += np.bincount(low[keep], weight[keep], len(to)) - np.bincount(high[keep], weight[keep], len(to))

    add(before, unit + 1, unit + block, times * times)
    add(after, unit - block + 1, unit, times * times)
    for lag in range(1, 2 * block):
        p, q = unit[:-lag], unit[lag:]
        pairs = (words[:-lag] == words[lag:]) & (q - p < 2 * block)
        if not pairs.any():
            break
        p, q, w = p[pairs], q[pairs], (times[:-lag] * times[lag:])[pairs]
        add(dot, np.maximum(p + 1, q - block + 1), np.minimum(p + block, q), w)
        close = q - p < block
        p, q, w = p[close], q[close], 2 * w[close]
        add(before, q + 1, p + block, w)
        add(after, q - block + 1, p, w)
    product = np.cumsum(before)[1:n] * np.cumsum(after)[1:n]
    return np.where(product > 0.5, np.cumsum(dot)[1:n] / np.sqrt(np.maximum(product, 1)), 0.0)


def gaps(text: str, block: int) -> dict[int, tuple[float, int]]:
    """Depth of the valley and strength (1 sentence, 2 line, 3 paragraph) of each natural boundary, by its place."""
    ends = units(text)
    n = len(ends)
    if n < 2:
        return {}
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(d := c.lower()) != 1 else d for c in text)
    flat, sizes, a = [], [], 0
    for b in ends:
        words = _WORDS.findall(low, a, b)
        flat += words
        sizes.append(len(words))
        a = b
    similar = similarities(np.fromiter(map(hash, flat), np.int64, len(flat)), np.repeat(np.arange(n), sizes), n, block).tolist()
    # The depth of a valley is its distance to the nearest peak on either side.
    left, right = similar[:], similar[:]
    for i in range(1, n - 1):
        left[i] = max(similar[i], left[i - 1] if similar[i - 1] >= similar[i] else similar[i])
    for i in range(n - 3, -1, -1):
        right[i] = max(similar[i], right[i + 1] if similar[i + 1] >= similar[i] else similar[i])
    out = {}
    for i, s in enumerate(similar):
        a, b = ends[i - 1] if i else 0, ends[i]
        tail = text[max(a, b - 4) : b]
        out[b] = (left[i] + right[i] - 2 * s, 3 if tail.count("\n") > 1 else 2 if "\n" in tail else 1)
    return out


def pieces(text: str, known: Vocabulary, limit: int = 512, overlap: int = 64, block: int = 6, least: float = 0.4) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of each piece; a piece is at least ``least`` of the limit where boundaries allow."""
    if len(text) <= 4 * limit and (total := known.count(text)) <= limit:
        return [(0, len(text), total)]
    ends, counts, long_words = atoms(text, known, min(LONG_WORD, limit - overlap))
    sums = [0, *accumulate(counts)]
    if sums[-1] <= limit:
        return [(0, len(text), known.count(text) if long_words else sums[-1])]
    depths = gaps(text, block)
    starts, n, out = [0, *ends[:-1]], len(ends), []
    natural = [k for k, end in enumerate(ends) if end in depths]
    first = fresh = 0

    def size_of(a: int, b: int) -> int:
        if long_words:
            return known.count(text[starts[a] : ends[b - 1]])
        # White space at a piece's end may join into other tokens than inside the text; all before it stands.
        k = b - 1
        while k > a and text[starts[k] : ends[k]].isspace():
            k -= 1
        return sums[k] - sums[a] + known.count(text[starts[k] : ends[b - 1]])

    while True:
        last = bisect_right(sums, sums[first] + limit) - 1
        if long_words:
            # Parts of a cut word may join into other tokens, so what counts is the piece itself.
            while last > first + 1 and known.count(text[starts[first] : ends[last - 1]]) > limit:
                last -= 1
        if last <= fresh and first < fresh:
            # The overlap leaves no room for what is next.
            first = fresh
            continue
        last = max(last, first + 1)
        if last >= n:
            out.append((starts[first], len(text), size_of(first, n)))
            return out
        best = (-1.0, 0, 0)
        for k in natural[bisect_left(natural, max(first, fresh)) : bisect_left(natural, last)]:
            if sums[k + 1] - sums[first] >= least * limit:
                depth, strength = depths[ends[k]]
                best = max(best, (round(depth, 3) + 0.05 * strength, strength, k + 1))
        cut = best[2] or last
        if not best[2]:
            # No natural boundary in the window: the last place after white space, else between words.
            cut = next((k for k in range(last, max(first, fresh), -1) if text[ends[k - 1]].isspace() or text[ends[k - 1] - 1].isspace()), last)
        out.append((starts[first], ends[cut - 1], size_of(first, cut)))
        first, fresh = max(first + 1, bisect_left(sums, sums[cut] - overlap)), cut


def split(documents: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 512, overlap: int = 64, block: int = 6, path: str = VOCABULARY) -> DataFrame:
    """(key, piece_no, start, end, n_tokens, piece): consecutive pieces of each row's text."""
    if limit < CHARACTER:
        raise ValueError("a character can have four tokens, so the limit has to be four at least")
    if not 0 <= overlap <= limit / 4:
        raise ValueError("the overlap must be a quarter of the limit at most")
    rows = spread(documents.select(F.col(key).alias("k"), F.col(text).alias("t")))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = vocabulary(path)
        for part in parts:
            out, held = [], 0
            for k, t in zip(part["k"], part["t"]):
                if t is None:
                    out.append((k, 0, 0, 0, 0, None))
                    continue
                for n, (a, b, size) in enumerate(pieces(t, known, limit, overlap, block)):
                    out.append((k, n, a, b, size, t[a:b]))
                    held += b - a
                if held > 4_000_000:
                    yield pd.DataFrame(out, columns=COLUMNS)
                    out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=COLUMNS)

    return rows.mapInPandas(run, f"k {dict(rows.dtypes)['k']}, piece_no int, start int, end int, n_tokens int, piece string").withColumnRenamed("k", key)


COLUMNS = ["k", "piece_no", "start", "end", "n_tokens", "piece"]
