"""Variant spellings of names typed by people: names in canonical words.

Method: a trie join. The distinct words of all names, folded by sound, are put into shards such that two
words within the bounded distance share one; in each shard a trie is traversed with the bit-parallel
Levenshtein automaton of every word (insertion, deletion, substitution, swap of neighbours), which yields
all neighbours within the bound; for a bound of one edit they are looked up by the word without a letter. Each word points to its most frequent neighbour, pointers are followed to
their root. A name is then the multiset of its canonical words: order doesn't count, which checks all
permutations of its words at once, and initials stay open until a full name takes them.

Shards: words of 4 to 6 letters go by their first two and last two letters (up to 4 also by one), words of 6
and more by three; one edit cannot touch both ends. From 9 letters on two edits are allowed; then the
three letters in the middle, at a shift of up to two, are a third key, and two edits touch two of the
three keys at most (except where a swap straddles two of them and another edit hits the third).

Nothing here is per pair of names: what moves is distinct names, distinct words and neighbours of words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm.unify import by_table
from daftar.runtime import cut, to_roots, width

#: Words that make a name stand for nobody in particular.
NOBODY = set("family heir heirs seller sellers buyer buyers tenant tenants occupied occupant vacant unknown unnamed tbd none nil na various legal".split())
#: Titles.
TITLES = set("mr mrs ms miss mst dr engr eng er ch chaudhry haji hajj mian sardar syed syeda sayed sayeda begum bibi col capt maj brig retd prof justice adv advocate hafiz".split())
#: Words of organisations, legal forms first.
FORMS = set("pvt ltd limited private company regd ho head office unit".split())
TRADES = (
    "mills mls mill", "flour flr", "textile textiles tex", "steel steels", "works wks", "motors motor mtrs", "traders trading trdrs", "welfare welf", "trust tr", "school", "public pub", "services svcs", "engineering engg eng",
    "builders bldrs", "developers dev", "pharma pharm pharmaceuticals", "enterprises", "industries", "foundation", "sons",
)
TRADE = {w: "#" + t.split()[0] for t in TRADES for w in t.split()}
KINDS = set(TRADE) - {"tr", "dev", "eng", "sons"}
SMALL = set("and co tr dev eng p sons".split())
#: Spellings of one given name that are too short or too far for a distance.
MUHAMMAD = set("muhammad mohammad mohd mhd md muhd mohamed mohammed muhammed muhamad mohamad".split())
#: Urdu letters by sound.
URDU = {
    "ا": "a", "آ": "a", "ب": "b", "پ": "p", "ت": "t", "ٹ": "t", "ث": "s", "ج": "j", "چ": "ch", "ح": "h", "خ": "k", "د": "d", "ڈ": "d", "ذ": "z", "ر": "r", "ڑ": "r", "ز": "z", "ژ": "z", "س": "s", "ش": "sh",
    "ص": "s", "ض": "z", "ط": "t", "ظ": "z", "ع": "a", "غ": "g", "ف": "f", "ق": "k", "ک": "k", "گ": "g", "ل": "l", "م": "m", "ن": "n", "ں": "n", "و": "u", "ی": "i", "ے": "i", "ھ": "h", "ہ": "h", "ۃ": "t", "ئ": "i", "ء": "", "ؤ": "u", "أ": "a",
}

_GLUED = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_WORD = re.compile(r"[a-z]+|[؀-ۿ]+")
_CHILD = re.compile(r"(?<=\w)\s+[sdw]\s?/\s?o\b.*", re.IGNORECASE | re.DOTALL)
_FIRM = re.compile(r"\bm\s?/\s?s\b\.?|\(\s*r\s*\)", re.IGNORECASE)
_ORGANISED, _FORMAL = FORMS | KINDS, FORMS | KINDS | SMALL


def from_urdu(word: str) -> str:
    """Letters by sound; waw is v before or between vowels."""
    out = "".join(URDU.get(c, "") for c in word)
    if word.endswith("ہ") and len(word) > 2:
        out = out[:-1] + "a"
    return re.sub(r"(?:^u(?=[^u])|(?<=[ai])u(?=[ai])|(?<=[^aiu])u(?=[ai]))", "v", out)


def fold(word: str) -> str:
    """A word as it sounds: spellings that are usual for one sound become equal."""
    for a, b in (("kh", "k"), ("gh", "g"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("ph", "f"), ("ck", "k"), ("q", "k"), ("w", "v"), ("x", "ks"), ("ou", "u"), ("oo", "u"), ("ee", "i"), ("y", "i"), ("ai", "i"), ("ei", "i"), ("e", "i"), ("o", "u")):
        word = word.replace(a, b)
    word = re.sub(r"(.)\1+", r"\1", re.sub(r"c(?!h)", "k", word))
    return word[:-1] if word.endswith("h") and len(word) > 3 and word[-2] in "aiu" else word


def skeleton(folded: str) -> str:
    """Consonants that Urdu script always writes as such."""
    return re.sub("[aiuvh]", "", folded.replace("sh", "S").replace("ch", "C")) or folded


@lru_cache(maxsize=1 << 16)
def _latin(word: str) -> str:
    """Look-alikes unified, accents gone; Urdu script stays."""
    word = by_table(word)
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c) or "؀" <= c <= "ۿ"))


def _sound(word: str) -> str:
    if "؀" <= word[0] <= "ۿ":
        return "~" + fold(from_urdu(word))
    return "muhamad" if word in MUHAMMAD else word if len(word) == 1 else fold(word)


class _Sounds(dict):
    """What a word is: its sound, or what it does to a name (``!`` nobody, ``#`` an organisation, ``.`` a title). Made when
    first met; emptied when full. Familiar forms sound as the given name that they stand for."""

    def __init__(self, short: tuple[tuple[str, str], ...]) -> None:
        super().__init__()
        self.short = dict(short)

    def __missing__(self, word: str) -> str:
        if len(self) > 1 << 17:
            self.clear()
        out = "!" if word in NOBODY else "#" if word in _ORGANISED else "." if word in TITLES else _sound(self.short.get(word, word))
        self[word] = out
        return out


@lru_cache(maxsize=4)
def sounds_of(short: tuple[tuple[str, str], ...] = ()) -> _Sounds:
    """One table for each list of familiar forms, kept by a worker."""
    return _Sounds(short)


def read_name(text: str | None, table: _Sounds | None = None) -> tuple[str, list[str]] | None:
    """(kind, words): ``org`` with the words of its own name joined and its words of trade (marked ``#``), ``person``
    with folded words, initials and Urdu words (marked ``~``). None where a name stands for nobody in particular."""
    if not text:
        return None
    if not text.isascii():
        text = " ".join([w if w.isascii() else _latin(w) for w in text.split(" ")])
    if "/" in text:
        # Whose child or wife somebody is doesn't say who it is.
        text = _FIRM.sub(" ", _CHILD.sub("", text))
    elif "(" in text:
        text = _FIRM.sub(" ", text)
    if not (text.istitle() or text.isupper() or text.islower()):
        text = _GLUED.sub(" ", text)
    words = _WORD.findall(text.lower())
    if not words or words == ["n", "a"] or words == ["owner"]:
        return None
    table = sounds_of() if table is None else table
    sounds = [table[w] for w in words]
    if min(sounds) > "A":
        return "person", sounds
    # Words that stand for nobody do so beside a person's name; in that of an organisation they are a part of it.
    if "#" in sounds and not any(w[0] >= "؀" for w in words):
        own = "".join([w for w in words if w not in _FORMAL])
        trade = sorted({TRADE[w] for w in words if w in TRADE})
        # What has neither a name nor a trade of its own is a placeholder (a vacant unit).
        if not own or not trade and all(w in NOBODY for w in words if w not in _FORMAL):
            return None
        return "org", [own, *trade]
    if "!" in sounds:
        return None
    return "person", [s for s in sounds if s > "A"] or [_sound(w) for w in words]


def keys(word: str, most: int = 2) -> list[tuple[str, bool, bool]]:
    """(shard, is searched, searches) of a folded word."""
    n, out = len(word), []
    for size, shortest, longest in ((1, 3, 4), (2, 4, 6), (3, 6, n)):
        if shortest <= n <= longest:
            out += [(f"p{word[:size]}", True, True), (f"s{word[-size:]}", True, True)]
    if n >= 9 and most > 1:
        c = n // 2 - 1
        out += [(f"m{word[k : k + 3]}", k == c, True) for k in range(c - 2, c + 3) if 0 <= k <= n - 3]
    return out


def bound(a: int, b: int, most: int) -> int:
    """Edits allowed between words of such lengths."""
    return 0 if min(a, b) < 3 else 1 if min(a, b) < 9 else most


def traverse(trie: dict, word: str, most: int) -> list[tuple[str, int]]:
    """Words of the trie within ``most`` (1 or 2) edits of ``word``, with their distance.

    The automaton's state is a bit per matched prefix length for each number of edits."""
    n = len(word)
    mask: dict[str, int] = {}
    for i, c in enumerate(word):
        mask[c] = mask.get(c, 0) | 1 << i
    end, out = 1 << n, []
    start = tuple((1 << (k + 1)) - 1 for k in range(most + 1))
    # (node, states, states before the last letter, the last letter's mask)
    stack = [(trie, start, (0,) * (most + 1), 0)]
    while stack:
        node, now, before, last = stack.pop()
        for c, child in node.items():
            if c == "":
                for k in range(most + 1):
                    if now[k] & end:
                        out.append((child, k))
                        break
                continue
            m = mask.get(c, 0)
            r0 = (now[0] & m) << 1
            r1 = ((now[1] & m) << 1) | now[0] | (now[0] << 1) | (r0 << 1) | ((before[0] & m & (last >> 1)) << 2 if last else 0)
            if most == 2:
                r2 = ((now[2] & m) << 1) | now[1] | (now[1] << 1) | (r1 << 1) | ((before[1] & m & (last >> 1)) << 2 if last else 0)
                if r2 & (2 * end - 1):
                    stack.append((child, (r0, r1, r2), now, _shifted(mask, c)))
            elif r1 & (2 * end - 1):
                stack.append((child, (r0, r1), now, _shifted(mask, c)))
    return out


def _shifted(mask: dict[str, int], c: str) -> int:
    return mask.get(c, 0)


def lacking(word: str) -> set[str]:
    """The word, and what is left of it without one of its letters: words one edit or one swap apart share one."""
    return {word, *[word[:i] + word[i + 1 :] for i in range(len(word))]}


def one_apart(a: str, b: str) -> bool:
    """Whether two different words that share one of their ``lacking`` are one edit or one swap of neighbours apart."""
    if len(a) != len(b):
        return True
    i = next(k for k, (x, y) in enumerate(zip(a, b)) if x != y)
    return a[i + 1 :] == b[i + 1 :] or a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :]


def search(rows: list[tuple[str, bool, bool]], most: int) -> list[tuple[str, str, int]]:
    """(word, other, edits) of a shard, given as (word, is searched, searches). One edit needs no trie: words are looked up
    by what they lack."""
    if most == 1:
        index: dict[str, list[str]] = {}
        for w, searched, _ in rows:
            if searched and len(w) > 2:
                for k in lacking(w):
                    index.setdefault(k, []).append(w)
        if not index:
            return []
        found = []
        for w, _, searches in rows:
            if searches and len(w) > 2:
                met = {o for k in lacking(w) for o in index.get(k, ())}
                found += [(w, o, 1) for o in met if o != w and one_apart(w, o)]
        return found
    trie: dict = {}
    for w, searched, _ in rows:
        if searched:
            node = trie
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
    if not trie:
        return []
    return [(w, o, k) for w, _, searches in rows if searches for o, k in traverse(trie, w, bound(len(w), len(w), most) or 1) if o != w and k <= bound(len(w), len(o), most)]


def neighbours(words: DataFrame, most: int = 2, into: DataFrame | None = None) -> DataFrame:
    """(word, other, edits): for each of ``words`` all words of ``into`` (``words`` themselves by default) within
    the bound: ``most`` edits from 9 letters on, one below."""
    wide = width(words.sparkSession)

    def batch(rows: list[tuple], **columns: pa.DataType) -> pa.RecordBatch:
        values = zip(*rows) if rows else [()] * len(columns)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, columns.values())], list(columns))

    def place(searched: bool, searches: bool):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                rows = [(s, w, a and searched, b and searches) for w in part.column(0).to_pylist() for s, a, b in keys(w, most) if a and searched or b and searches]
                yield batch(rows, shard=pa.string(), word=pa.string(), searched=pa.bool_(), searches=pa.bool_())

        return run

    def sweep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards one after another, sorted; a shard holds distinct words of one key only."""
        kinds = {"word": pa.string(), "other": pa.string(), "edits": pa.int32()}
        now, held, out = None, [], []
        for part in parts:
            for s, w, a, b in zip(*[c.to_pylist() for c in part.columns]):
                if s != now:
                    out += search(held, most) if len(held) > 1 else []
                    now, held = s, []
                held.append((w, a, b))
            if len(out) > 50_000:
                yield batch(out, **kinds)
                out = []
        out += search(held, most) if len(held) > 1 else []
        yield batch(out, **kinds)

    schema = "shard string, word string, searched boolean, searches boolean"
    of = words.select("word").repartition(wide)
    shards = of.mapInArrow(place(into is None, True), schema)
    if into is not None:
        shards = shards.unionAll(into.select("word").repartition(wide).mapInArrow(place(True, False), schema))
    found = shards.repartition(wide, "shard").sortWithinPartitions("shard").mapInArrow(sweep, "word string, other string, edits int")
    # The middle key is searched one way only, so both ways are united where a list is joined with itself.
    both = found.unionAll(found.select(F.col("other").alias("word"), F.col("word").alias("other"), "edits")) if into is None else found
    return both.groupBy("word", "other").agg(F.min("edits").alias("edits"))


def canonical_words(words: DataFrame, anchors: DataFrame, ratio: int = 4, few: int = 5) -> DataFrame:
    """(word, root, given, n of the root) of each word of ``words`` (word, n). ``anchors``: folded words known to be given names;
    they keep their spelling. A word needs a neighbour ``ratio`` times as frequent; a long one that is typed
    by ``few`` names or less, any that is more frequent."""
    marked = cut(words.join(anchors.select(F.col("word"), F.lit(True).alias("given")).distinct(), "word", "left").select("word", "n", F.coalesce("given", F.lit(False)).alias("given")))
    latin, urdu = marked.filter(~F.col("word").startswith("~")), marked.filter(F.col("word").startswith("~"))
    # Two edits between rare words are as often two names as one, so they are left to what a place or phone says.
    # First every word looks among usual ones; what finds none there, and is long, looks among its like.
    same_bones = F.regexp_replace("word", "[aiuvh]", "") == F.regexp_replace("other", "[aiuvh]", "")
    rank = F.struct((-F.col("edits")).alias("e"), same_bones.alias("b"), F.col("m"), F.col("other"))
    open_words = latin.filter((F.length("word") >= 3) & ~F.col("given"))
    b = marked.select(F.col("word").alias("other"), F.col("n").alias("m"))
    usual = latin.filter((F.length("word") >= 3) & (F.col("n") >= ratio))
    near = neighbours(open_words, 1, usual).join(open_words.select("word", "n"), "word").join(b, "other").filter(F.col("m") >= ratio * F.col("n"))
    parents = cut(near.groupBy("word").agg(F.max_by("other", rank).alias("parent")))
    left = cut(latin.filter(F.length("word") >= 7).join(parents, "word", "left_anti"))
    better = (F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("other") < F.col("word")))
    few_left = left.filter((F.col("n") <= few) & ~F.col("given"))
    rare = neighbours(few_left, 1, left).join(few_left.select("word", "n"), "word").join(b, "other").filter(better)
    parents = to_roots(parents.unionAll(rare.groupBy("word").agg(F.max_by("other", rank).alias("parent"))), "word", "parent")
    # Urdu words: the written consonants find the candidates, the sound and the frequency choose.
    consonants = F.regexp_replace(F.replace(F.replace(F.regexp_replace(F.col("word"), "^~", ""), F.lit("sh"), F.lit("S")), F.lit("ch"), F.lit("C")), "[aiuvh]", "")
    roots = latin.join(parents, "word", "left").filter("parent is null and n > 0").select(F.col("word").alias("parent"), "n", "given", consonants.alias("bones"))
    sounds = F.levenshtein(F.regexp_replace(F.col("word"), "^~", ""), F.col("parent"))
    heard = urdu.select("word", consonants.alias("bones")).filter("bones <> ''").join(roots, "bones").filter(sounds <= F.greatest(F.lit(1), (F.length("parent") / 2).cast("int")))
    spoken = heard.groupBy("word").agg(F.max_by("parent", F.struct("given", -sounds, F.log1p("n"), "parent")).alias("parent"))
    to = parents.unionAll(spoken)
    out = marked.join(to, "word", "left").select("word", F.coalesce("parent", F.regexp_replace("word", "^~", "")).alias("root"), F.col("n").alias("own"))
    kinds = marked.select(F.col("word").alias("root"), "given", "n")
    return out.join(kinds, "root", "left").select("word", "root", F.coalesce("given", F.lit(False)).alias("given"), F.coalesce("n", "own").alias("n"))


def familiar(short_names: DataFrame) -> dict[str, str]:
    """Given name by short form. The table is fixed and small, 56 rows; one of more than 100,000 is refused."""
    rows = short_names.filter("short_name is not null and given_name is not null").select(F.lower("short_name").alias("s"), F.lower("given_name").alias("g")).distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("the table of short names isn't small")
    return {r["s"]: r["g"] for r in sorted(rows)}


def vocabulary(read: DataFrame, short: dict[str, str]) -> DataFrame:
    """(word, root, given, n) of the words of names; ``read``: kind, names (words with a space between them)."""
    exploded = read.select("kind", F.posexplode(F.split("names", " ")).alias("at", "word")).filter(F.length("word") > 1)
    counted = cut(exploded.groupBy("word").agg(F.count("*").alias("n"), F.avg((F.col("at") == 0).cast("double")).alias("first"), F.max((F.col("kind") == "person").cast("int")).alias("person")))
    # Given names without a familiar form stand first in most names, with many surnames.
    total = counted.agg(F.sum("n")).first()[0] or 0
    usual = counted.filter((F.col("person") == 1) & ~F.col("word").startswith("~") & (F.col("n") >= max(8, total / 600)) & (F.col("first") >= 0.6) & (F.length("word") <= 9)).select("word")
    anchors = read.sparkSession.createDataFrame([(fold(g),) for g in {*short.values(), "muhamad"}], "word string")
    return canonical_words(counted.select("word", "n"), anchors.unionAll(usual).distinct())


def compose(kind: str, words: list[tuple[str, bool, int]]) -> tuple[str, str]:
    """(surname, form) of a name from its words in order: (root, is a given name, how often typed).

    ``form``: given names in order of the alphabet joined by ``+``, a bar, initials likewise. The most usual
    word that is no given name is the surname, others beside it are given names beyond recognition and
    count by their first letter. Without such a word, the last one is the surname. The words of trade of an
    organisation stand in place of given names."""
    if kind == "org":
        return words[0][0], ("+".join(w for w, _, _ in words[1:]) or "#org") + "|"
    initials = [w for w, _, _ in words if len(w) == 1]
    own = [(n, len(w), at, w) for at, (w, given, n) in enumerate(words) if not given and len(w) > 1]
    given = {w for w, is_given, _ in words if is_given}
    if own:
        chosen = max(own)
        surname = chosen[3]
        initials += [x[3][0] for x in own if x is not chosen]
    elif words:
        surname = words[-1][0]
        given.discard(surname)
        if len(surname) == 1:
            initials.remove(surname)
    else:
        return "", "|"
    # Muhammad before another given name is as often left out as not.
    if len(given) > 1 or given and initials:
        given.discard("muhamad")
    if not given and initials.count("m") and len(initials) > 1 or given:
        initials = [i for i in initials if i != "m"]
    return surname, "+".join(sorted(given)) + "|" + "+".join(sorted(i.translate(_HEARD) for i in initials))


_HEARD = str.maketrans("qwceoy", "kvkiui")
