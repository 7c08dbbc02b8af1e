"""Scores of all candidate pairs, rejects in full, many pairs at once.

The rows of a block (or of two pieces of a large one) come to one place together; there their pairs are made and
scored as arrays, each two different names and addresses once. So no pair is shuffled or joined to its texts, and what
moves is the rows of blocks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.functions import text as T
from daftar.functions.similarity import name_profile, ratios
from daftar.operators import resolve
from daftar.runtime import cut, spread

#: Pairs that are scored at once, and candidates of one task.
AT_ONCE, OF_A_TASK = 1 << 17, 2_000_000
_FLAGS = ("same_phone", "same_city", "same_surname", "same_first", "initials_ok")
_SCHEMA = "left_id string, right_id string, name_score double, address_score double, " + ", ".join(f"{c} boolean" for c in _FLAGS)
_GROUP = ["k", "x", "y", "i", "j"]


def scores(prints: DataFrame) -> DataFrame:
    """left_id, right_id, confidence, decision, name_score, address_score and what agrees, of every candidate pair: as
    ``resolve.compare`` gives them with ``rejects``."""
    texts = prints.withColumns({c: F.coalesce(c, F.lit("")) for c in ("norm_name", "norm_address")})
    names = spread(texts.select("norm_name").distinct()).select("norm_name", *name_profile(F.col("norm_name")))
    names = cut(names.select("norm_name", "inits", "sorted_aliases", F.array_join("codes", " ").alias("codes")))
    described = texts.join(names, "norm_name")
    dealt, carried, parts = resolve.dealt(described, OF_A_TASK, "phone", "norm_name", "norm_address", "inits", "sorted_aliases", "codes")
    other = F.explode(F.sequence(F.lit(0), F.col("pieces"))).alias("other")
    rows = dealt.select("k", "x", "y", "piece", other, *carried)
    rows = rows.select("k", "x", "y", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), (F.col("other") < F.col("piece")).alias("right"), *carried)
    met = rows.repartition(parts, *_GROUP).sortWithinPartitions(*_GROUP, "right", "record_id")
    return resolve.decided(met.mapInArrow(_scored, _SCHEMA))


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their groups to scored pairs; the last group of a batch may go on in the next one."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = (pa.concat_tables([rest, rows]) if rest is not None else rows).combine_chunks()
        starts = _starts(rows)
        if len(starts) > 1:
            yield from _pairs(rows.slice(0, starts[-1]), starts[:-1])
            rows = rows.slice(starts[-1])
        rest = rows
    if rest is not None and rest.num_rows:
        yield from _pairs(rest, np.zeros(1, np.int64))


def _starts(rows: pa.Table) -> np.ndarray:
    """Where the groups of sorted rows begin."""
    new = np.ones(rows.num_rows, bool)
    if rows.num_rows > 1:
        new[1:] = np.logical_or.reduce([_array(rows, c)[1:] != _array(rows, c)[:-1] for c in _GROUP])
    return np.flatnonzero(new)


def _array(rows: pa.Table, column: str) -> np.ndarray:
    """A column, texts and flags as their numbers among its distinct values."""
    values = rows[column].combine_chunks()
    if not pa.types.is_integer(values.type):
        values = values.dictionary_encode()
        values = (values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values).indices
    return values.to_numpy(zero_copy_only=False)


def _pairs(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    n = rows.num_rows
    sizes = np.diff(np.append(starts, n))
    end = np.repeat(starts + sizes, sizes)
    right = rows["right"].combine_chunks().to_numpy(zero_copy_only=False)
    # A row meets those after it in its piece that have another id, or all of the other piece.
    ids = _array(rows, "record_id")
    new = np.append(np.flatnonzero(np.append(True, ids[1:] != ids[:-1])), n)
    later = np.minimum(new[np.searchsorted(new, np.arange(n), "right")], end)
    others = np.repeat(np.add.reduceat((~right).astype(np.int64), starts) + starts, sizes)
    apart = _array(rows, "i") != _array(rows, "j")
    first = np.where(right, end, np.where(apart, others, later))
    met = end - first
    code = {c: _array(rows, c) for c in ("city", "first", "last", "block_key", "phone", "norm_name", "norm_address")}
    there = {c: pc.not_equal(rows[c], "").to_numpy() for c in ("city", "first", "last", "block_key", "phone")}
    texts = _distinct(rows, code["norm_address"], "norm_address")
    named = list(zip(*[_distinct(rows, code["norm_name"], c) for c in ("norm_name", "sorted_aliases", "codes", "inits")]))
    k, id_ = _array(rows, "k"), rows["record_id"].combine_chunks()
    upto = np.cumsum(met)
    at = 0
    while at < n:
        # As many rows as have AT_ONCE pairs, or one.
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, "right")))
        count = met[at:to]
        left = np.repeat(np.arange(at, to), count)
        partner = np.arange(left.size) + np.repeat(first[at:to] - (np.cumsum(count) - count), count)
        at = to
        same = {c: (code[c][left] == code[c][partner]) & there[c][left] for c in there}
        before = np.zeros(left.size, bool)
        for number, key in enumerate(resolve.KEYS):
            before |= (k[left] > number) & np.logical_and.reduce([same[c] for c in key])
        keep = np.flatnonzero(~before)
        if not keep.size:
            continue
        left, partner = left[keep], partner[keep]
        same = {c: v[keep] for c, v in same.items()}
        (a, b), back = _once(code["norm_address"][left], code["norm_address"][partner], len(texts))
        place = ratios(texts, a, b)[back]
        (a, b), back = _once(code["norm_name"][left], code["norm_name"][partner], len(named))
        score, starts_so = (v[back] for v in _names(named, a, b))
        family = same["last"] & same["first"]
        initials = (starts_so == 2) | ((starts_so == 1) & family)
        columns = [id_.take(pa.array(left)), id_.take(pa.array(partner)), score, place, same["phone"], same["city"], same["last"], same["first"], initials]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["left_id", "right_id", "name_score", "address_score", *_FLAGS])


def _distinct(rows: pa.Table, code: np.ndarray, column: str) -> list[str]:
    """The text of each number."""
    where = np.zeros(code.max() + 1, np.int64)
    where[code] = np.arange(code.size)
    return rows[column].take(pa.array(where)).to_pylist()


def _once(a: np.ndarray, b: np.ndarray, n: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The distinct pairs of numbers under ``n``, and which of them each pair is."""
    pair = a.astype(np.int64) * n + b
    if n * n > 8 * pair.size:
        pair, back = np.unique(pair, return_inverse=True)
        return np.divmod(pair, n), back
    met = np.zeros(n * n, bool)
    met[pair] = True
    once = np.flatnonzero(met)
    number = np.empty(n * n, np.int64)
    number[once] = np.arange(once.size)
    return np.divmod(once, n), number[pair]


@lru_cache(maxsize=1 << 14)
def _profile(name: str, aliases: str, codes: str) -> tuple[frozenset, frozenset, Counter, float]:
    grams = Counter(f"  {name}  "[i : i + 3] for i in range(len(name) + 2)) if name else Counter()
    return frozenset(aliases.split()), frozenset(codes.split()), grams, math.sqrt(sum(n * n for n in grams.values()))


#: Scores of pairs of names, made when first met; emptied when full.
_KNOWN: dict = {}


def _names(named: list[tuple[str, str, str, str]], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of names (name, aliases, codes, initials) by number: the score, and whether the initials of one begin the
    other's (2) or not (1), 0 where one has none."""
    out = [_KNOWN.get((named[a][0], named[b][0])) for a, b in zip(left.tolist(), right.tolist())]
    new = np.array([x for x, found in enumerate(out) if found is None], np.int64)
    if new.size:
        if len(_KNOWN) + new.size > 1 << 18:
            _KNOWN.clear()
        a, b = left[new], right[new]
        sequence = ratios([n[1] for n in named], a, b).tolist()
        for x, p, q, seq in zip(new.tolist(), a.tolist(), b.tolist(), sequence):
            (name, aliases, codes, li), (other, more, sounds, ri) = named[p], named[q]
            out[x] = _KNOWN[name, other] = _name_score(_profile(name, aliases, codes), _profile(other, more, sounds), seq), 0 if not (li and ri) else 2 if li.startswith(ri) or ri.startswith(li) else 1
    return np.array([o[0] for o in out]), np.array([o[1] for o in out], np.int8)


def _name_score(one: tuple, two: tuple, sequence: float) -> float:
    """As ``resolve`` has it for columns."""
    (a, c, g, n), (b, d, h, m) = one, two
    jaccard = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    if len(h) < len(g):
        g, h = h, g
    norm = n * m
    soft = max(0.92 * jaccard(c, d), 0.9 * (sum(v * h[w] for w, v in g.items() if w in h) / norm if norm > 0 else 0.0))
    return max(jaccard(a, b), sequence, soft) if a and b else soft
