"""What the matches of ``resolve`` connect, without their pairs.

Which records are one entity doesn't need the pairs that match, only what they connect, and that is never more than the
records. So the rows of a block come to one place, are compared there as arrays, and give at most a link for each.

Without the phone, a pair of other surname or first initial needs addresses of 0.9 and names of 0.72 for a match, and
all pairs of one surname and first initial are candidates. These come first (``_families``); every record gets the
smallest one that it is connected with there. The other keys (``_others``) then look only at names that are
similar and at records not connected yet, and tie their smallest ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.functions import text as T
from daftar.functions.similarity import _letters, ratios
from daftar.operators import scores
from daftar.operators.components import connected, stars, undirected
from daftar.runtime import cut, small, spread, width

#: Rows of a block that meet others at once, pairs that are looked at in one step, addresses whose scores a worker keeps.
PIECE, AT_ONCE, KEPT = 2048, 1 << 20, 4096
#: The least confidence before rounding that a match has (the binary value is above 71.95, so it is rounded up).
MATCH = 71.95
#: What the names of a pair without a common phone, surname and initial have at least, a little less.
NAMES = 0.7199
_TEXTS = ("norm_name", "words", "norm_address", "city", "block_key")
_ROW = "number long, x string, y string, record_id string, phone string, " + ", ".join(f"{c} string" for c in _TEXTS)
_KEYS = ["k", "x", "y"]


def clusters(prints: DataFrame) -> DataFrame:
    """(record_id, component) of every id: records connected by matches have one component, the number of the smallest id;
    numbers are in the order of ids."""
    rows = prints.filter("record_id is not null").select("record_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("phone", "norm_name", "norm_address", "city", "block_key")])
    tokens = T.name_tokens(F.col("norm_name"))
    named = cut(spread(rows.select("norm_name").distinct()).select("norm_name", F.array_join(tokens, " ").alias("words"), T.surname(tokens).alias("last"), T.first_initial(tokens).alias("first")))
    wide = width(prints.sparkSession)
    ordered = rows.join(small(named), "norm_name").repartitionByRange(wide, "record_id").sortWithinPartitions("record_id")
    numbered = ordered.select(F.col("last").alias("x"), F.col("first").alias("y"), "record_id", "phone", *_TEXTS).mapInArrow(_numbered, _ROW)
    met = numbered.repartition(wide, "x", "y").sortWithinPartitions("x", "y", "number")
    labelled = cut(met.mapInArrow(_families, f"{_ROW}, label long"))
    own = cut(labelled.groupBy("record_id").agg(F.min("label").alias("label"), F.max("label").alias("most")))
    # A phone that one row has makes no pair; most are such.
    phones = cut(labelled.filter("phone <> ''").groupBy("phone").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("phone").alias("_shared")))
    rows = labelled.join(small(phones), F.col("phone") == F.col("_shared"), "left").withColumn("phone", F.coalesce("_shared", F.lit("")))
    key = lambda k, x, y=F.lit(""): F.when((x != "") & (y != "") if k < 2 else x != "", F.struct(F.lit(k).alias("k"), x.alias("x"), y.alias("y")))
    city, last, first = F.col("city"), F.col("x"), F.col("y")
    keys = F.array_compact(F.array(key(0, city, first), key(1, city, last), key(2, F.col("block_key")), key(3, F.col("phone"))))
    others = rows.select(F.explode(keys).alias("key"), "number", "label", "norm_name", "words", "norm_address", "city").select("key.*", "*").drop("key")
    others = others.repartition(wide, *_KEYS).sortWithinPartitions(*_KEYS, "number")
    ties = others.mapInArrow(_others, "a long, b long").unionByName(own.filter("label < most").select(F.col("label").alias("a"), F.col("most").alias("b")))
    found = stars(undirected(ties, "a", "b"))
    of = own.select("record_id", "label").join(found.select(F.col("u").alias("label"), "v"), "label", "left")
    return of.select("record_id", F.coalesce("v", "label").alias("component"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with numbers in the order of their ids; equal ids have one number."""
    number, last = TaskContext.get().partitionId() << 33, None
    for batch in batches:
        ids = batch["record_id"].to_pylist()
        new = np.array([a != b for a, b in zip(ids, [last, *ids])], np.int64)
        numbers = number + np.cumsum(new)
        if len(ids):
            number, last = int(numbers[-1]), ids[-1]
        yield pa.RecordBatch.from_arrays([pa.array(numbers), *batch.columns], ["number", *batch.schema.names])


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Whole groups of sorted rows, one at a time."""
    held: list[pa.Table] = []
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not rows.num_rows:
            continue
        codes = [rows[c].combine_chunks() for c in by]
        codes = [(c if pa.types.is_integer(c.type) else c.dictionary_encode().indices).to_numpy(zero_copy_only=False) for c in codes]
        starts = np.flatnonzero(np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in codes])))
        if held and any(held[-1][c][-1] != rows[c][0] for c in by):
            yield pa.concat_tables(held)
            held = []
        for at, to in zip(starts, np.append(starts[1:], rows.num_rows)):
            held.append(rows.slice(at, to - at))
            if to < rows.num_rows:
                yield pa.concat_tables(held)
                held = []
    if held:
        yield pa.concat_tables(held)


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, list[str]]:
    """Each value as its number among the distinct ones, and these."""
    made = column.combine_chunks().dictionary_encode()
    return made.indices.to_numpy(zero_copy_only=False).astype(np.int64), made.dictionary.to_pylist()


class _Bounds:
    """Letters of texts, and what the score of two can be at most by them."""

    def __init__(self) -> None:
        self.once = self.twice = self.thrice = self.rest = self.length = np.zeros(0, np.int64)

    def add(self, texts: list[str]) -> None:
        more = _letters(pd.Series(texts, dtype="object"))
        for c in ("once", "twice", "thrice", "rest"):
            setattr(self, c, np.append(getattr(self, c), more[c].to_numpy()))
        self.length = np.append(self.length, np.array([len(t) for t in texts], np.int64))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.minimum(self.rest[a], self.rest[b])
        for bits in (self.once, self.twice, self.thrice):
            out = out + np.bitwise_count(bits[a] & bits[b])
        return out

    def most(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        la, lb = self.length[a], self.length[b]
        return np.where((la > 0) & (lb > 0), 2.0 * self.common(a, b) / np.maximum(la + lb, 1), 0.0)


class _Places:
    """Scores of addresses as a worker meets them: 0 where not known yet, less than 0 for the bound by letters,
    more for the score itself. What is none is there as ``NONE``. Begun anew when full."""

    NONE = 1e-300

    def __init__(self) -> None:
        self.size = 0
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.texts: list[str] = []
        self.letters = _Bounds()
        self.scores = np.zeros((self.size, self.size))

    def codes(self, texts: list[str]) -> np.ndarray:
        new = [t for t in texts if t not in self.index]
        if len(self.texts) + len(new) > self.size:
            self.size, new = max(KEPT, len(texts)), texts
            self.clear()
        self.index |= {t: i for i, t in enumerate(new, len(self.texts))}
        self.texts += new
        self.letters.add(new)
        return np.array([self.index[t] for t in texts], np.int64)

    def bounded(self, a: np.ndarray, b: np.ndarray) -> None:
        if a.size:
            self.scores[a, b] = -np.maximum(self.letters.most(a, b), self.NONE)

    def exact(self, a: np.ndarray, b: np.ndarray) -> None:
        if not a.size:
            return
        a, b = np.divmod(np.unique(a * self.size + b), self.size)
        used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        got = ratios([self.texts[i] for i in used], at[: a.size], at[a.size :])
        self.scores[a, b] = np.maximum(got, self.NONE)

    def reach(self, a: np.ndarray, b: np.ndarray, least: np.ndarray, look: Callable) -> np.ndarray:
        """Where the score of a and b is ``least`` or more; ``look`` takes it from ``scores``, (a, b) in its shape."""
        got = look(self.scores)
        new = (got == 0) & (least <= 1)
        if new.any():
            at = np.nonzero(new)
            x, y = (np.broadcast_to(c, new.shape)[at] for c in (a, b))
            self.bounded(x, y)
            got = look(self.scores)
        open_ = (got < 0) & (-got >= least) & (least <= 1)
        if open_.any():
            at = np.nonzero(open_)
            self.exact(*(np.broadcast_to(c, open_.shape)[at] for c in (a, b)))
            got = look(self.scores)
        return (np.maximum(got, 0) >= least) & (least <= 1)


class _Apart:
    """Which pairs of names a worker knows to be no match whatever their addresses, without a common phone. Begun anew when full."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.never = np.zeros((0, 0), bool)

    def codes(self, names: list[str]) -> np.ndarray | None:
        """Numbers of the names of a block; none if they are more than are kept."""
        if len(names) > KEPT:
            return None
        new = [n for n in names if n not in self.index]
        if len(self.index) + len(new) > len(self.never):
            self.index, self.never, new = {}, np.zeros((KEPT, KEPT), bool), names
        self.index |= {n: i for i, n in enumerate(new, len(self.index))}
        return np.array([self.index[n] for n in names], np.int64)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.never[a, b] = self.never[b, a] = True


_PLACES, _APART = _Places(), _Apart()


def _score(name: float, address: float, close: bool, city: bool, phone: bool) -> float:
    """As ``resolve`` has it for columns; a common surname and first initial are also compatible initials and the reverse
    holds where the surname is common."""
    if close:
        name = max(name, 0.82)
        if address >= 0.82:
            name = max(name, 0.86)
    bonus = 0.08 if close else 0.0
    if close and address >= 0.7:
        bonus = bonus + 0.16
    if close and address >= 0.86:
        bonus = max(bonus, 0.18)
    if address >= 0.9 and name >= 0.72:
        bonus = max(bonus, 0.10)
    if address >= 0.9 and name >= 0.88 and city:
        bonus = max(bonus, 0.14)
    total = 0.48 * name + 0.22 * address + (0.18 if phone else 0.0) + (0.04 if city else 0.0) + bonus
    if name < 0.42 and not close:
        total = min(total, 0.68)
    return 100 * max(0.0, min(1.0, total))


@lru_cache(maxsize=1 << 18)
def least_address(name: float, close: bool, city: bool, phone: bool) -> float:
    """The least score of addresses with which a pair is a match, 2 if there is none. A score never falls when an
    address's rises, so it is found by halving, to the last bit."""
    fits = lambda a: _score(name, a, close, city, phone) >= MATCH
    if fits(0.0):
        return 0.0
    if not fits(1.0):
        return 2.0
    low, high = 0.0, 1.0
    while True:
        mid = (low + high) / 2
        if mid in (low, high):
            return high
        low, high = (low, mid) if fits(mid) else (mid, high)


def _code(word: str) -> str:
    """``text.phonetic_code`` of a normalized word."""
    base = word.translate(str.maketrans("qczv", "kksw")).replace("x", "ks")
    return re.sub(r"(.)\1+", r"\1", base[:1] + re.sub("[aeiouhwy]", "", base[1:]))


@lru_cache(maxsize=1 << 15)
def _named(name: str, words: str) -> tuple[str, str, str, str]:
    """Name, sorted words with their equivalents, sounds, initials, as ``scores`` takes them."""
    tokens = words.split()
    aliases = sorted({a for t in tokens for a in T.TOKEN_EQUIVALENTS.get(t, [t])})
    return name, " ".join(aliases), " ".join(sorted({c for c in map(_code, tokens) if c})), "".join(t[0] for t in tokens)


def _names(rows: pa.Table) -> tuple[np.ndarray, list[tuple[str, str, str, str]], np.ndarray]:
    """The number of each row's name, the names, and of each the number of its surname and initial (-1 for none)."""
    of, names = _coded(rows["norm_name"])
    where = np.zeros(len(names), np.int64)
    where[of] = np.arange(of.size)
    words = rows["words"].take(pa.array(where)).to_pylist()
    families: dict = {}
    family = np.array([families.setdefault((w[0], w.rsplit(" ", 1)[-1]), len(families)) if w else -1 for w in words], np.int64)
    return of, [_named(n, w) for n, w in zip(names, words)], family


def _least(named: list, p: np.ndarray, q: np.ndarray, close: np.ndarray, phone: bool) -> tuple[np.ndarray, np.ndarray]:
    """``least_address`` of pairs of names, in one city and in two."""
    known = scores._names(named, p, q)[0].tolist() if p.size else []
    rows = list(zip(known, close.tolist()))
    return tuple(np.array([least_address(n, c, city, phone) for n, c in rows], np.float64) for city in (True, False))


def _roots(number: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return connected(*[np.concatenate(c) for c in zip(*held)]) if held else (number[:0], number[:0])


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the smallest number that each is connected with within its surname and initial."""
    done: list[pa.Table] = []
    n = 0
    for rows in _groups(batches, ["x", "y"]):
        number = rows["number"].combine_chunks().to_numpy()
        label = number.copy()
        if rows.num_rows > 1 and rows["x"][0].as_py() and rows["y"][0].as_py():
            at, root = _family(rows, number)
            # Rows of one number are one record.
            found = np.minimum(np.searchsorted(at, number), max(len(at) - 1, 0))
            if len(at):
                label = np.where(at[found] == number, root[found], number)
        done.append(rows.append_column("label", pa.array(label)))
        n += rows.num_rows
        if n >= 10_000:
            yield from pa.concat_tables(done).combine_chunks().to_batches()
            done, n = [], 0
    if done:
        yield from pa.concat_tables(done).combine_chunks().to_batches()


def _family(rows: pa.Table, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The connected numbers of a group, which are all close by surname and initial, and the smallest of each."""
    of, named, _ = _names(rows)
    place, texts = _coded(rows["norm_address"])
    city, cities = _coded(rows["city"])
    city = np.where(np.array([c != "" for c in cities])[city], city, -1)
    # Records without an address are no matches by their names alone.
    some = np.flatnonzero(np.array([t != "" for t in texts])[place])
    of, place, city, number = of[some], place[some], city[some], number[some]
    held: list = []
    for i in range(0, some.size, PIECE):
        for j in range(i, some.size, PIECE):
            left, right = np.arange(i, min(i + PIECE, some.size)), np.arange(j, min(j + PIECE, some.size))
            used, at = np.unique(place[np.append(left, right)], return_inverse=True)
            codes = _PLACES.codes([texts[u] for u in used])[at]
            pl, pr = codes[: left.size], codes[left.size :]
            names, at = np.unique(of[np.append(left, right)], return_inverse=True)
            nl, nr = at[: left.size], at[left.size :]
            p, q = (c.ravel() for c in np.divmod(np.arange(names.size**2), names.size))
            same, other = (t.reshape(names.size, names.size) for t in _least(named, names[p], names[q], np.ones(p.size, bool), False))
            step = max(1, AT_ONCE // right.size)
            for s in range(0, left.size, step):
                l = slice(s, s + step)  # noqa: E741
                alike = (city[left[l]][:, None] == city[right]) & (city[right] >= 0)
                least = np.where(alike, same[nl[l]][:, nr], other[nl[l]][:, nr])
                least[number[left[l]][:, None] >= number[right]] = 2.0
                a, b = np.nonzero(_PLACES.reach(pl[l][:, None], pr[None, :], least, lambda m: m[pl[l]][:, pr]))
                if a.size:
                    held.append(connected(number[left[l]][a], number[right][b]))
    return _roots(number, held)


def _others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels that are connected by another key than surname and initial: each with the smallest of its block."""
    done: list = []
    n = 0
    for rows in _groups(batches, _KEYS):
        if rows.num_rows > 1:
            for a, b in _met(rows):
                done.append((a, b))
                n += a.size
        if n >= AT_ONCE:
            done, n = [connected(*[np.concatenate(c) for c in zip(*done)])], 0
    if done:
        a, b = connected(*[np.concatenate(c) for c in zip(*done)])
        yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])


def _bits(sets: list[list[str]]) -> np.ndarray:
    """Which items each has, as bits."""
    known = {g: i for i, g in enumerate(sorted({g for s in sets for g in s}))}
    out = np.zeros((len(sets), len(known) // 64 + 1), np.uint64)
    for row, items in zip(out, sets):
        for i in {known[g] for g in items}:
            row[i >> 6] |= np.uint64(1 << (i & 63))
    return out


def _similar(named: list, family: np.ndarray, phone: bool, code: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of names p <= q that may be a match: with a common phone all of them, else those not close that a bound
    leaves at ``NAMES`` at least. ``code``: their numbers in ``_APART``."""
    n = len(named)
    if not phone:
        aliases, whole = _Bounds(), _Bounds()
        sorted_aliases = [x[1] for x in named]
        aliases.add(sorted_aliases)
        whole.add([x[0] for x in named])
        number = lambda c: np.unique([x[c] for x in named], return_inverse=True)[1]
        size = lambda c: np.array([len(x[c].split()) for x in named])
        alias, sound, words, heard = number(1), number(2), size(1), size(2)
        grams = [[f"  {x[0]}  "[i : i + 3] for i in range(len(x[0]) + 2)] for x in named]
        times = [Counter(g) for g in grams]
        top = np.array([max(t.values()) for t in times], np.float64)
        norm = np.sqrt([sum(v * v for v in t.values()) for t in times])
        # Where an n-gram repeats, letters are no bound of the cosine.
        again = top > 1
        bits = _bits(grams)
    step = max(1, AT_ONCE // max(n, 1))
    for s in range(0, n, step):
        left = np.arange(s, min(s + step, n))
        a, b = left[:, None], np.arange(n)[None, :]
        keep = a <= b
        if not phone:
            keep &= (family[a] != family[b]) | (family[a] < 0)
        if code is not None:
            keep &= ~_APART.never[code[left]][:, code]
        p, q = np.nonzero(keep)
        p += s
        if not phone:
            cosine = (whole.common(p, q) + 2) / np.sqrt((whole.length[p] + 2.0) * (whole.length[q] + 2.0))
            # Of two sets of up to three words (of up to four sounds), only equal ones are similar enough.
            may = (alias[p] == alias[q]) | (sound[p] == sound[q]) | ((words[p] > 2) & (words[q] > 2)) | ((heard[p] > 3) & (heard[q] > 3))
            open_ = np.flatnonzero(~may & (again[p] | again[q] | (0.9 * cosine >= NAMES)))
            both = np.bitwise_count(bits[p[open_]] & bits[q[open_]]).sum(axis=1, dtype=np.int64)
            may[open_] = 0.9 * both * (top[p[open_]] / norm[p[open_]]) * (top[q[open_]] / norm[q[open_]]) >= NAMES
            # What is left is similar in sequence, one way round or the other, or not at all.
            for x, y in ((p, q), (q, p)):
                open_ = np.flatnonzero(~may & (aliases.most(x, y) >= NAMES))
                may[open_] = ratios(sorted_aliases, x[open_], y[open_]) >= NAMES
            if code is not None:
                _APART.add(code[p[~may]], code[q[~may]])
            p, q = p[may], q[may]
        yield p, q


def _met(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (a, b) of the labels of one block."""
    phone = rows["k"][0].as_py() == 3
    label = rows["label"].combine_chunks().to_numpy()
    if label.min() == label.max():
        return
    number = rows["number"].combine_chunks().to_numpy()
    of, named, family = _names(rows)
    place, texts = _coded(rows["norm_address"])
    city, cities = _coded(rows["city"])
    city = np.where(np.array([c != "" for c in cities])[city], city, -1)
    kept = len(texts) <= KEPT
    codes = _PLACES.codes(texts)[place] if kept else None
    order = np.argsort(of, kind="stable")
    count = np.bincount(of, minlength=len(named))
    first = np.cumsum(count) - count
    code = None if phone else _APART.codes([n[0] for n in named])
    for p, q in _similar(named, family, phone, code):
        close = (family[p] == family[q]) & (family[p] >= 0)
        least = np.stack([*_least(named, p, q, close, phone), *_least(named, q, p, close, phone)])
        some = (least <= 1).any(axis=0)
        if code is not None:
            _APART.add(code[p[~some]], code[q[~some]])
        p, q, least = p[some], q[some], least[:, some]
        upto = np.cumsum(count[p] * count[q])
        for at in range(0, int(upto[-1]) if upto.size else 0, AT_ONCE):
            flat = np.arange(at, min(at + AT_ONCE, upto[-1]))
            pair = np.arange(np.searchsorted(upto, flat[0], "right"), np.searchsorted(upto, flat[-1], "right") + 1)
            pair = np.repeat(pair, np.minimum(upto[pair], flat[-1] + 1) - np.maximum(upto[pair] - count[p[pair]] * count[q[pair]], at))
            i, j = np.divmod(flat - (upto[pair] - count[p[pair]] * count[q[pair]]), count[q[pair]])
            i, j = order[first[p[pair]] + i], order[first[q[pair]] + j]
            keep = np.flatnonzero((label[i] != label[j]) & ((p[pair] != q[pair]) | (i < j)))
            i, j, pair = i[keep], j[keep], pair[keep]
            turned = number[i] > number[j]
            two = (city[i] != city[j]) | (city[i] < 0)
            need = least[2 * turned + two, pair]
            i, j = np.where(turned, j, i), np.where(turned, i, j)
            a, b = place[i], place[j]
            if kept:
                x, y = codes[i], codes[j]
                hit = _PLACES.reach(x, y, need, lambda m: m[x, y])
            else:
                hit = _apart(texts, a, b, need)
            if hit.any():
                yield connected(label[i[hit]], label[j[hit]])


def _apart(texts: list[str], a: np.ndarray, b: np.ndarray, need: np.ndarray) -> np.ndarray:
    """As ``reach`` of places, of more texts than are kept."""
    once, back = np.unique(a * len(texts) + b, return_inverse=True)
    x, y = np.divmod(once, len(texts))
    lowest = np.full(once.size, 2.0)
    np.minimum.at(lowest, back, need)
    used, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    letters = _Bounds()
    own = [texts[u] for u in used]
    letters.add(own)
    l, r = at[: x.size], at[x.size :]  # noqa: E741
    open_ = np.flatnonzero((letters.most(l, r) >= lowest) & (lowest <= 1))
    got = np.zeros(once.size)
    got[open_] = ratios(own, l[open_], r[open_])
    return (got[back] >= need) & (need <= 1)
