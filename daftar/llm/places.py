"""Same postal address written differently: which records denote the same place.

Method: an address is a vector of character n-grams, weighted by how much its words say, and its house, flat and
street numbers. Candidates come from an inverted index that holds only a prefix of each vector: its rarest
n-grams, as many as leave the others too light to reach the threshold alone, so no pair above it is missed.
Candidates are verified by cosine, and their numbers have to be compatible.

It is done in two steps, so that what is indexed grows with the vocabulary and with places, never with copies:

1. The distinct naming words of all addresses are indexed and compared with each other; each spelling gets the
   word that it stands for (cosine and edits, frequency decides).
2. The distinct addresses in such words are indexed within their house and street number and compared whole;
   what is alike beyond ``ALIKE`` and doesn't contradict in phase, block or city is one place.

City, phase and block are compatible or missing: where a word of the address settles them (nine of ten of its
addresses that name a city name this one), they add nothing and may be left out; where it doesn't, they tell
places apart. Words that mostly accompany another word of the address (a town unknown to the lists below)
add nothing either.

Up to ``runtime.BROADCAST_LIMIT`` bytes of spellings go to the workers, more are joined.

Defined results: null, blank or number-less addresses and such that refer elsewhere are no place; repeated
texts have the same place; extra columns don't matter.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm.unify import by_table
from daftar.operators.components import stars, undirected
from daftar.runtime import BROADCAST_LIMIT, cut, small, spread, to_roots, width

#: Words of form and their usual abbreviations.
HOUSE = set("house h hse makan hno houseno hous huose".split())
FLAT = set("flat flt apt apartment f appt aprtment".split())
STREET = set("street st str stret strt gali galli gly steet".split())
PHASE = set("phase ph phse fase pase".split())
BLOCK = set("block blk sector".split())
TALL = set("heights height hts hgts".split())
FORMS = set(
    "road rd raod rod colony col clny nagar nagr ngr town tn twn villas villa vls enclave encl enclv park pk scheme schm housing hsg society "
    "garden gardens gdn gdns number no near jamia masjid behind petrol pump opp opposite girls school main market old address pakistan abad co ro".split()
)
#: Cities with their usual short forms.
CITIES = {
    "islamabad": "isb islamabd", "rawalpindi": "rwp rpindi pindi", "lahore": "lhr lahor", "karachi": "khi karachee", "multan": "mux multn", "faisalabad": "fsd fabad faislabad", "peshawar": "pew pesh", "quetta": "qta queta",
    "hyderabad": "hyd", "sialkot": "skt", "gujranwala": "grw", "sargodha": "sgd", "bahawalpur": "bwp", "sukkur": "skr", "abbottabad": "abt",
}
#: Words and digits in Urdu script.
URDU = {
    "مکان": "house", "گلی": "street", "فلیٹ": "flat", "سڑک": "road", "فیز": "phase", "بلاک": "block", "لاہور": "lahore", "کراچی": "karachi", "ملتان": "multan", "راولپنڈی": "rawalpindi", "اسلام": "islam", "فیصل": "faisal", "آباد": "abad", "پشاور": "peshawar", "کوئٹہ": "quetta",
}
NUMBERS = {w: str(i) for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve".split(), 1)}
ROMAN = {tens + ones: str(10 * len(tens) + i) for tens in ("", "x", "xx", "xxx") for i, ones in enumerate(("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")) if tens + ones}
_TOKEN = re.compile(r"[0-9]+(?:(?:st|nd|rd|th)\b|[-/]?[a-z]\b)?|[a-z]+")
_SLASHED = ((re.compile(r"\bf\s?/\s?abad\b"), " fabad "), (re.compile(r"\bh\s?/\s?s\b|\b[cr]/o\b"), " "))
_APART = re.compile(r"\b(faisal|islam)\s+abad\b")
#: What a word of form is about.
_CITY = {name: city for city, short in CITIES.items() for name in (city, *short.split())}
_ROLE = dict.fromkeys(FORMS, "form") | dict.fromkeys(TALL, "tall") | dict.fromkeys(STREET, "street") | dict.fromkeys(HOUSE, "house") | dict.fromkeys(FLAT, "flat") | dict.fromkeys(PHASE, "phase") | dict.fromkeys(BLOCK, "block") | dict.fromkeys(_CITY, "city")


def plain(text: str) -> str:
    """Lower-case ASCII letters and digits as far as a text can be written so."""
    if text.isascii():
        return text.lower()
    return " ".join([w.lower() if w.isascii() else _plain_word(w) for w in text.split(" ")])


@lru_cache(maxsize=1 << 16)
def _plain_word(word: str) -> str:
    word = by_table(word)
    for urdu, latin in URDU.items():
        word = word.replace(urdu, latin)
    word = "".join(str(d) if (d := unicodedata.digit(c, None)) is not None else c for c in word)
    return "".join(c for c in unicodedata.normalize("NFKD", word.casefold()) if not unicodedata.combining(c))


def _classify(token: str) -> tuple[str, str]:
    """(class, value) of a token: a letter that says what it is, and how it is written in a place."""
    if token <= ":":
        if token.isdigit():
            return "9", token.lstrip("0") or "0"
        if token[-2:] in _ORDINAL:
            return "o", token[:-2].lstrip("0") or "0"
        return "9", (token[:-1].rstrip("-/").lstrip("0") or "0") + token[-1]
    role = _ROLE.get(token)
    if role == "city":
        return "c", _CITY[token]
    if token == "f":
        return "f", token
    if role is not None:
        return {"form": "n" if token in ("no", "number") else "x", "tall": "t", "street": "S", "house": "H", "flat": "F", "phase": "P", "block": "B"}[role], token
    if token in ROMAN:
        return "ijk"[min(len(token), 3) - 1], ROMAN[token] if len(token) > 1 else token
    if token in NUMBERS:
        return "m", token
    return ("w" if len(token) > 2 else "l" if len(token) == 1 else "y"), token


class _Tokens(dict):
    """Class and value by token, made when first met; emptied when full."""

    def __missing__(self, token: str) -> tuple[str, str]:
        if len(self) > 1 << 17:
            self.clear()
        self[token] = out = _classify(token)
        return out


_TOKENS = _Tokens()


@lru_cache(maxsize=1 << 16)
def _plan(classes: str) -> tuple | None:
    """Where an address of such tokens has its parts: (prefix of its number, house, street, phase, block, city, words).

    The form of an address is one of few, so it is worked out once for each."""
    house = street = phase = block = city = -1
    wants, flat, words, spare = "", False, [], []
    last = len(classes) - 1
    for k, c in enumerate(classes):
        if c in "9o":
            if c == "o" and k < last and classes[k + 1] == "S":
                street, wants = k, "o"
                continue
            if wants == "P":
                phase = k
            elif wants == "S":
                street = k if street < 0 else street
            elif wants == "B":
                block = k
            elif wants == "H" and house < 0:
                house = k
            else:
                spare.append(k)
            wants = ""
        elif c in "SPBH":
            wants = "" if c == "S" and wants == "o" else c
        elif c == "c":
            city, wants = k if city < 0 else city, ""
        elif c in "xt":
            flat, wants = flat or c == "t", ""
        elif c in "Ff":
            if c == "F" or k < last and classes[k + 1] in "9o":
                flat, wants = True, "H"
        elif c == "n":
            continue
        elif wants == "B" and c in "li":
            block, wants = k, ""
        elif wants in ("P", "S") and c in "ijkm":
            if wants == "P":
                phase = k
            elif street < 0:
                street = k
            wants = ""
        else:
            if c in "jk" and words:
                phase = k if phase < 0 else phase
            elif c in "wkm":
                words.append(k)
            wants = ""
    if house < 0 and spare:
        house = spare.pop(0)
    if house < 0 or not words:
        return None
    if spare and phase < 0:
        phase = spare[0]
    return "f" if flat else "h", house, -1 if flat else street, phase, block, city, tuple(words)


def read_address(text: str | None) -> tuple[str, str, str] | None:
    """(numbers, naming words in order of the alphabet, what tells equal ones apart: block ``b=``, city ``c=``, phase
    ``p=``), or None where a text denotes no place: what is blank, has no number, or names nothing only refers
    elsewhere."""
    if not text:
        return None
    text = plain(text)
    if "/" in text:
        for pattern, by in _SLASHED:
            text = pattern.sub(by, text)
    if " abad" in text:
        text = _APART.sub(r"\1abad", text)
    classes, values = zip(*[_TOKENS[t] for t in _TOKEN.findall(text)] or [("", "")])
    plan = _plan("".join(classes))
    if plan is None:
        return None
    kind, house, street, phase, block, city, words = plan
    # A lone number of five digits or more is a postal code.
    apart = f"b={values[block]}" if block >= 0 else ""
    if city >= 0:
        apart += f";c={values[city]}" if apart else f"c={values[city]}"
    if phase >= 0 and len(number := _number(values[phase])) < 5:
        apart += f";p={number}" if apart else f"p={number}"
    naming = values[words[0]] if len(words) == 1 else " ".join(sorted({values[k] for k in words}))
    return f"{kind}{values[house]}|{_number(values[street]) if street >= 0 else ''}", naming, apart


def _number(value: str) -> str:
    """A number in digits, written as a word or a Roman letter."""
    return value if value[0] <= ":" else NUMBERS.get(value) or ROMAN.get(value) or value


_ORDINAL = {"st", "nd", "rd", "th"}


def grams(word: str) -> Iterator[str]:
    """n-grams of a word, a repeated one with its number."""
    padded, seen = f"^{word}$", Counter()
    for i in range(len(padded) - 1):
        seen[padded[i : i + 2]] += 1
        yield f"{padded[i : i + 2]}{seen[padded[i : i + 2]]}"


def vector(words: str) -> Counter:
    return Counter(g for w in words.split() for g in grams(w))


def cosine(a: Counter, b: Counter) -> float:
    dot = sum(c * b[g] for g, c in a.items() if g in b)
    norm = math.sqrt(sum(c * c for c in a.values()) * sum(c * c for c in b.values()))
    return dot / norm if norm else 0.0


def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, older[j - 2] + 1)
            row.append(best)
    return row[-1]


def like(a: str, b: str, least: float) -> bool:
    """Whether two words can be one: one edit apart, or two where their n-grams are alike beyond ``least``. In
    Python, as the measure that ``alike`` is tested against."""
    return abs(len(a) - len(b)) < 3 and (k := edits(a, b)) <= 2 and (k < 2 or cosine(Counter(grams(a)), Counter(grams(b))) >= least + 0.05)


def _grams(word):
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substr(padded, i, F.lit(2)))


def _swapped(a, b):
    """Whether two words differ by one swap of neighbours."""
    at = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), F.lit(False)).cast("int")
    return (F.length(a) == F.length(b)) & (F.substr(a, at, F.lit(2)) == F.reverse(F.substr(b, at, F.lit(2)))) & (F.substr(a, at + 2) == F.substr(b, at + 2))


def vectors(words: DataFrame) -> DataFrame:
    """(word, n, v): the n-grams of each word, a repeated one with its number."""
    plain = _grams(F.col("word"))
    numbered = F.transform("g", lambda x, i: F.concat(x, F.size(F.filter(F.slice("g", 1, i + 1), lambda y: y == x)).cast("string")))
    return words.withColumn("g", plain).select("word", "n", numbered.alias("v"))


def gram_index(vectors: DataFrame, threshold: float) -> DataFrame:
    """(word, n, gram): the keys of each word that a word of cosine ``threshold`` or more, two letters longer or
    shorter at most, shares. Two such words have so many n-grams in common that, in the order of rarity, two of
    them stand in the prefix of each; a key is two n-grams of the prefix."""
    exploded = vectors.select("word", "n", F.explode("v").alias("gram"))
    frequency = exploded.groupBy("gram").agg(F.count("*").alias("df"))
    listed = exploded.join(frequency, "gram").groupBy("word", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "gram"))), lambda x: x["gram"]).alias("v"))
    size = F.size("v")
    common = F.ceil(F.sqrt(size * (size - 2)) * threshold - 1e-9).cast("int")
    prefix = listed.select("word", "n", F.slice("v", F.lit(1), F.least(size, size - common + 2)).alias("v"))
    twos = F.flatten(F.transform("v", lambda x, i: F.transform(F.slice("v", i + 2, F.size("v")), lambda y: F.concat(x, y))))
    return prefix.select("word", "n", F.explode(twos).alias("gram"))


def alike(words: DataFrame, to: DataFrame, threshold: float, allowed) -> DataFrame:
    """(word, other, m, near): verified pairs of the two lists for which ``allowed`` holds; near: one edit apart."""
    both = cut(vectors(words.unionByName(to).distinct()))
    # In a short word a swap of neighbours touches most n-grams; there the letters are the key.
    letters = F.concat(F.lit("="), F.array_join(F.array_sort(F.split("word", "")), ""))
    a = gram_index(both, threshold).unionAll(both.filter(F.length("word") < 7).select("word", "n", letters.alias("gram")))
    a = cut(a)
    b = a.join(to.select("word"), "word", "left_semi").select(F.col("word").alias("other"), F.col("n").alias("m"), "gram")
    wide = width(words.sparkSession)
    near = a.join(words.select("word"), "word", "left_semi").repartition(wide, "gram").join(b.repartition(wide, "gram"), "gram").filter((F.col("word") != F.col("other")) & allowed)
    pairs = near.select("word", "other", "m").distinct().filter(F.levenshtein("word", "other", 2) >= 0)
    one = (F.levenshtein("word", "other", 1) >= 0) | F.coalesce(_swapped(F.col("word"), F.col("other")), F.lit(False))
    pairs = cut(pairs.withColumn("near", one))
    other = both.select(F.col("word").alias("other"), F.col("v").alias("w"))
    far = pairs.filter(~F.col("near")).join(both.select("word", "v"), "word").join(other, "other")
    far = far.filter(F.size(F.array_intersect("v", "w")) >= (threshold + 0.05) * F.sqrt(F.size("v").cast("double") * F.size("w")) - 1e-9)
    return pairs.filter("near").unionByName(far.select("word", "other", "m", "near"))


def word_roots(words: DataFrame, threshold: float, ratio: int = 4) -> DataFrame:
    """(word, root) of the naming words (word, n) that are another spelling of a more frequent one.

    First every word looks among those ``ratio`` times as frequent; what finds none there is compared with what
    else found none, and takes the more frequent one, whatever the counts are."""
    words = cut(words)
    best = F.max_by("other", F.struct("near", "m", "other")).alias("root")
    usual = cut(alike(words, words.filter(F.col("n") >= ratio), threshold, F.col("m") >= ratio * F.col("n")).groupBy("word").agg(best))
    left = cut(words.join(usual, "word", "left_anti"))
    # Two words that stand in many addresses each are two names; how many is a share of all, so that it means the
    # same at every size.
    often = words.agg(F.sum("n").alias("total")).select((F.col("total") * RARE).alias("bound"))
    rare = left.crossJoin(F.broadcast(often)).filter("n <= greatest(bound, 5)").drop("bound")
    better = (F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("other") < F.col("word")))
    near = alike(rare, left, threshold, better).groupBy("word").agg(best)
    return to_roots(usual.unionAll(near), "word", "root")


def spellings(read: DataFrame) -> DataFrame:
    """(word, root, implied) of the naming words of addresses; ``read``: words, apart. ``implied`` lists what the root
    settles: ``c=`` and such, and ``w=`` with another word that adds nothing beside it."""
    combos = cut(read.filter("words is not null").groupBy("words", "apart").agg(F.count("*").alias("n")))
    words = combos.select(F.explode(F.split("words", " ")).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    # Long words of form and cities stand among the words, so that their misspellings lead to them.
    fixed = [(w,) for w in sorted((FORMS | TALL | STREET | HOUSE | FLAT | PHASE | set(CITIES)) - {"opposite", "girls", "school"}) if len(w) > 4]
    total = words.agg(F.greatest(F.lit(100), F.floor(F.sum("n") / 100)).alias("n"))
    formal = read.sparkSession.createDataFrame(fixed, "word string").crossJoin(F.broadcast(total))
    roots = word_roots(words.unionByName(formal), THRESHOLD)
    own = F.coalesce("root", "word")
    spelt = combos.select(F.monotonically_increasing_id().alias("id"), "apart", "n", F.explode(F.split("words", " ")).alias("word")).join(roots, "word", "left").select("id", "apart", "n", own.alias("root"))
    spelt = cut(spelt.filter(~F.col("root").isin(*sorted(_ROLE))))
    # What tells places apart, by word: settled where one value has nearly all of the rows that have one.
    values = spelt.filter("apart <> ''").select("root", "n", F.explode(F.split("apart", ";")).alias("value")).groupBy("root", "value").agg(F.sum("n").alias("n"))
    kinds = values.groupBy("root", F.substring("value", 1, 1).alias("kind")).agg(F.sum("n").alias("all"), F.max_by("value", F.struct("n", "value")).alias("value"), F.max("n").alias("n"))
    settled = kinds.filter(F.col("n") >= SETTLED * F.col("all")).select("root", "value")
    # Words that accompany another one: in at least half of its rows, while it is in few of theirs.
    times = spelt.groupBy("root").agg(F.sum("n").alias("all"))
    together = spelt.alias("a").join(spelt.alias("b"), "id").filter("a.root <> b.root").groupBy(F.col("a.root").alias("root"), F.col("b.root").alias("other")).agg(F.sum("a.n").alias("both"))
    beside = together.join(times.filter("all >= 20"), "root").filter("both >= 0.5 * all").join(times.select(F.col("root").alias("other"), F.col("all").alias("theirs")), "other").filter("both <= 0.25 * theirs")
    implied = settled.unionAll(beside.select("root", F.concat(F.lit("w="), "other").alias("value"))).groupBy("root").agg(F.sort_array(F.collect_set("value")).alias("implied"))
    known = words.select("word").join(roots, "word", "left").select("word", own.alias("root")).join(implied, "root", "left")
    # The same for what an address names as a whole, where no single word settles it (a building named as a quarter).
    named = spelt.filter("apart <> ''").groupBy("id", "apart", "n").agg(F.array_join(F.array_sort(F.collect_set("root")), " ").alias("root"), F.collect_set("root").alias("roots"))
    whole = named.select("root", "roots", "n", F.explode(F.split("apart", ";")).alias("value")).groupBy("root", "roots", "value").agg(F.sum("n").alias("n"))
    whole = whole.groupBy("root", "roots", F.substring("value", 1, 1).alias("kind")).agg(F.sum("n").alias("all"), F.max_by("value", F.struct("n", "value")).alias("value"), F.max("n").alias("n"))
    whole = whole.filter((F.col("n") > 1) & (F.col("n") >= SETTLED * F.col("all"))).select("root", "value", F.explode("roots").alias("member"))
    single = settled.select(F.col("root").alias("member"), "value", F.lit(1).alias("one"))
    whole = whole.join(single, ["member", "value"], "left").groupBy("root", "value").agg(F.max("one").alias("one")).filter("one is null")
    known = known.unionByName(whole.groupBy("root").agg(F.sort_array(F.collect_set("value")).alias("implied")).select(F.concat(F.lit("="), "root").alias("word"), F.concat(F.lit("="), "root").alias("root"), "implied"))
    return cut(known.filter("root <> word or implied is not null").select("word", "root", F.coalesce("implied", F.array().cast("array<string>")).alias("implied")))


def placed_rows(numbers, words, apart, known: dict) -> list[tuple[str | None, str | None]]:
    """``place_of`` of each row; equal words are looked up once."""
    met: dict = {}
    out = []
    for n, w, x in zip(numbers, words, apart):
        if not n:
            out.append((None, None))
            continue
        found = met.get((w, x))
        if found is None:
            found = met[w, x] = place_of("", w, x, known)
        out.append((n + found[0], found[1]))
    return out


def place_of(numbers: str, words: str, apart: str, known: dict[str, tuple[str, list[str]]]) -> tuple[str, str]:
    """(numbers with what isn't settled, words) of an address in words that stand for their spellings."""
    roots, settled, kept = set(), set(), {apart} if apart and ";" not in apart else set(apart.split(";")) if apart else set()
    for w in words.split(" "):
        root, implied = known.get(w) or (w, ())
        role = _ROLE.get(root)
        if role == "city":
            if not any(x[0] == "c" for x in kept):
                kept.add("c=" + _CITY[root])
        elif role is None:
            roots.add(root)
            settled.update(implied)
    if kept and not kept <= settled:
        whole = known.get("=" + " ".join(sorted(roots)))
        if whole:
            kept -= set(whole[1])
    if settled:
        kept -= settled
        if len(roots) > 1:
            roots = {r for r in roots if "w=" + r not in settled} or roots
    return f"{numbers}|{';'.join(sorted(kept))}", " ".join(sorted(roots)) or words


THRESHOLD = 0.55
#: Cosine of whole addresses from which they are one place.
ALIKE = 0.85
#: Share of a word's rows that has to agree on a city, phase or block to settle it.
SETTLED = 0.9
#: Share of all words up to which one is rare enough to be another spelling of a word hardly more frequent.
RARE = 1e-5


def shipped(known: DataFrame, *columns: str) -> dict | None:
    """The table as a dictionary by its first column if it has at most ``BROADCAST_LIMIT`` bytes, measured first."""
    size = known.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct(*columns)))), F.lit(0))).first()[0]
    if size > min(BROADCAST_LIMIT, SHIPPED):
        return None
    return {r[0]: r[1:] for r in zip(*[c.to_pylist() for c in known.select(*columns).toArrow().columns])}


#: Bytes of spellings that may be shipped to every worker, beside the limit of the runtime.
SHIPPED = BROADCAST_LIMIT


def places(read: DataFrame, known: DataFrame) -> DataFrame:
    """``read`` (key, numbers, words, apart, ...) with ``at`` and ``naming``, null where an address denotes no place."""
    by_word = shipped(known, "word", "root", "implied")
    if by_word is not None:
        sent = read.sparkSession.sparkContext.broadcast(by_word)

        def named(numbers, words, apart):
            return list(zip(*placed_rows(numbers, words, apart, sent.value))) or [(), ()]

        named = rowwise(named, "at", "naming")
        return read.withColumn("_p", named("numbers", "words", "apart")).select("*", "_p.*").drop("_p", "numbers", "words", "apart")
    return joined_places(read, known)


def joined_places(read: DataFrame, known: DataFrame) -> DataFrame:
    """The same by joining each distinct address's words; for vocabularies too large to ship."""

    @F.pandas_udf("at string, naming string")
    def named(numbers: pd.Series, words: pd.Series, apart: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = [place_of(n, w, x, {k["word"]: (k["root"], k["implied"]) for k in f}) for n, w, x, f in zip(numbers, words, apart, found)]
        return pd.DataFrame(rows, columns=["at", "naming"], dtype=object)

    keyed = read.withColumn("_id", F.xxhash64("numbers", "words", "apart"))
    distinct = keyed.filter("numbers is not null").select("_id", "numbers", "words", "apart").dropDuplicates(["_id"])
    exploded = distinct.select("*", F.explode(F.split("words", " ")).alias("word")).join(known.filter("not startswith(word, '=')"), "word", "left")
    own = F.struct("word", F.coalesce("root", "word").alias("root"), F.coalesce("implied", F.array().cast("array<string>")).alias("implied"))
    listed = exploded.groupBy("_id", "numbers", "words", "apart").agg(F.collect_list(own).alias("found"))
    roots = F.array_sort(F.array_distinct(F.filter(F.transform("found", lambda f: f["root"]), lambda r: ~r.isin(*sorted(_ROLE)))))
    whole = known.filter("startswith(word, '=')").select(F.col("word").alias("whole"), F.struct("word", "root", "implied").alias("w"))
    listed = listed.withColumn("whole", F.concat(F.lit("="), F.array_join(roots, " "))).join(whole, "whole", "left").withColumn("found", F.when(F.col("w").isNull(), F.col("found")).otherwise(F.concat("found", F.array("w")))).drop("whole", "w")
    out = listed.withColumn("p", named("numbers", "words", "apart", "found")).select("_id", "p.*")
    return keyed.join(out, "_id", "left").drop("_id", "numbers", "words", "apart")


#: What is read of an address that denotes no place.
NOWHERE = (None, None, None)


def rowwise(run, *fields: str):
    """An Arrow UDF of a function from lists of texts to as many lists as there are fields. It counts as not
    deterministic, so that a filter on a field doesn't run it a second time."""

    def batch(*columns):
        return pa.StructArray.from_arrays([pa.array(v, pa.string()) for v in run(*[c.to_pylist() for c in columns])], list(fields))

    batch.__annotations__ = {"return": pa.Array}
    return F.arrow_udf(batch, ", ".join(f"{f} string" for f in fields), F.ArrowUDFType.SCALAR).asNondeterministic()


def read_addresses(records: DataFrame, column: str) -> DataFrame:
    """``records`` with numbers, words and apart of their address, null where it denotes no place."""

    def read(texts):
        return list(zip(*[read_address(t) or NOWHERE for t in texts])) or [(), (), ()]

    read = rowwise(read, "numbers", "words", "apart")
    return spread(records).withColumn("_r", read(F.col(column))).select("*", "_r.*").drop("_r")


def usual_pairs(placed: DataFrame) -> DataFrame:
    """(a, b, x, y), a smaller: pairs of addresses (id, at, naming, usual) with the same numbers where the usual words of
    one, of which it has some, are among the other's; and their namings. So the other has the rarest one of them, which
    few share."""
    one = placed.filter(F.size("usual") > 0).select(F.col("id").alias("a"), "at", F.col("naming").alias("x"), F.col("usual").alias("ux"), F.get("usual", F.lit(0)).alias("word"))
    two = placed.select(F.col("id").alias("b"), "at", F.col("naming").alias("y"), F.col("usual").alias("uy"), F.explode("usual").alias("word"))
    within = one.join(two, ["at", "word"]).filter((F.col("a") != F.col("b")) & (F.size(F.array_except("ux", "uy")) == 0))
    turned = F.col("a") > F.col("b")
    swap = lambda p, q: F.when(turned, F.col(q)).otherwise(F.col(p)).alias(p)
    return within.select(swap("a", "b"), swap("b", "a"), swap("x", "y"), swap("y", "x")).distinct()


def alike_addresses(keys: DataFrame, threshold: float = ALIKE) -> DataFrame:
    """(a, b), a smaller: all pairs of distinct addresses (id, at, naming) with the same numbers whose vectors have a
    cosine of ``threshold`` or more and whose words don't contradict: they do where each address has a usual word
    that the other lacks (two colonies on one road), as two house numbers do. A word that isn't usual may be a spelling
    of any other. The weight of a word, shared by its n-grams, is its rarity among addresses.

    What contradicts is never paired: usual words are a key, and n-grams only where an address has no usual word. Vectors
    are made for the namings that are left, and each two of these are compared once, whatever their numbers."""
    words = keys.select(F.explode(F.split("naming", " ")).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("df"))
    total = counted.agg(F.sum("df").alias("total"))
    rarity = cut(counted.crossJoin(F.broadcast(total)).select("word", "df", (F.log1p(F.col("total") / F.col("df")) / F.sqrt(F.length("word") + 1.0)).alias("w"), (F.col("df") > F.greatest(F.lit(5), F.col("total") * RARE)).alias("often")))
    several = keys.groupBy("at").agg(F.min("id").alias("x"), F.max("id").alias("y")).filter("x <> y").select("at")
    near = cut(keys.join(several, "at", "left_semi").select("id", "at", "naming"))
    spelt = lambda named: named.distinct().select("naming", F.explode(F.split("naming", " ")).alias("word")).join(small(rarity), "word")
    listed = F.transform(F.array_sort(F.collect_set(F.when(F.col("often"), F.struct("df", "word")))), lambda u: u["word"])
    usual = cut(spelt(near.select("naming")).groupBy("naming").agg(listed.alias("usual")))
    placed = near.join(small(usual), "naming")
    within = cut(usual_pairs(placed))
    bare = cut(placed.filter(F.size("usual") == 0).select("at").distinct())
    beside = cut(placed.join(small(bare), "at", "left_semi").select("id", "at", "naming", (F.size("usual") == 0).alias("bare")))
    left = within.select(F.explode(F.array("x", "y")).alias("naming")).unionAll(beside.select("naming"))
    terms = spelt(left).select("naming", "w", F.explode(_grams(F.col("word"))).alias("gram")).groupBy("naming", "gram").agg(F.sum("w").alias("w"))
    # n-grams of two letters are at most 28 x 28.
    order = F.broadcast(terms.groupBy("gram").agg(F.count("*").alias("df")))
    listed = F.sort_array(F.collect_list(F.struct("df", "gram", "w")))
    vectors = cut(terms.join(order, "gram").groupBy("naming").agg(listed.alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")))
    rest = lambda i: F.aggregate(F.slice("v", i + 1, F.size("v")), F.lit(0.0), lambda s, y: s + y["w"] * y["w"])
    prefix = vectors.select("naming", F.explode(F.filter("v", lambda x, i: rest(i) >= F.col("norm") * F.col("norm") * threshold**2 - 1e-9)).alias("x")).select("naming", "x.gram")
    keyed = beside.join(prefix, "naming")
    one = keyed.select(F.col("id").alias("a"), "at", "gram", F.col("naming").alias("x"), F.col("bare").alias("bx"))
    two = keyed.select(F.col("id").alias("b"), "at", "gram", F.col("naming").alias("y"), F.col("bare").alias("by"))
    alone = one.join(two, ["at", "gram"]).filter((F.col("a") < F.col("b")) & (F.col("bx") | F.col("by"))).select("a", "b", "x", "y").distinct()
    # With a usual word, and without: no pair is in both.
    pairs = cut(within.unionAll(alone))
    one = vectors.select(F.col("naming").alias("x"), F.col("v").alias("vx"), F.col("norm").alias("nx"))
    two = vectors.select(F.col("naming").alias("y"), F.map_from_entries(F.transform("v", lambda e: F.struct(e["gram"], e["w"]))).alias("m"), F.col("norm").alias("ny"))
    dot = F.aggregate("vx", F.lit(0.0), lambda s, e: s + e["w"] * F.coalesce(F.try_element_at("m", e["gram"]), F.lit(0.0)))
    scored = pairs.select("x", "y").distinct().join(one, "x").join(two, "y").select("x", "y", (dot / (F.col("nx") * F.col("ny"))).alias("cosine"))
    return pairs.join(scored.filter(F.col("cosine") >= threshold).select("x", "y"), ["x", "y"], "left_semi").select("a", "b")


def place_ids(placed: DataFrame) -> DataFrame:
    """``placed`` (at, naming, ...) with ``place``, the number of each place as a 64-bit hash; null where there is none."""
    own = F.when(F.col("at").isNotNull(), F.xxhash64("at", "naming"))
    keys = cut(placed.filter("at is not null").select("at", "naming").distinct().withColumn("id", F.xxhash64("at", "naming")))
    labels = stars(undirected(alike_addresses(keys), "a", "b")).select(F.col("u").alias("_own"), "v")
    return placed.withColumn("_own", own).join(labels, "_own", "left").withColumn("place", F.coalesce("v", "_own")).drop("_own", "v", "at", "naming")


def same_place_pairs(records: DataFrame, column: str = "address", key: str = "record_id") -> DataFrame:
    """(left_record_id, right_record_id): records of one place whose texts differ, the smaller key first.

    A place that very many records share makes as many pairs as it has; its join is split by adaptive
    execution. ``place_members`` has the same result as one row per record."""
    placed = place_members(records, column, key)
    a, b = placed.alias("a"), placed.alias("b")
    pairs = a.join(b, (F.col("a.place") == F.col("b.place")) & (F.col(f"a.{key}") < F.col(f"b.{key}")) & (F.col("a.text") != F.col("b.text")))
    return pairs.select(F.col(f"a.{key}").alias("left_record_id"), F.col(f"b.{key}").alias("right_record_id"))


def place_members(records: DataFrame, column: str = "address", key: str = "record_id") -> DataFrame:
    """(key, text, place): the place of each record that has one; ``text`` is a hash of the address as typed."""
    read = cut(read_addresses(records.select(key, column), column).select(key, F.xxhash64(column).alias("text"), "numbers", "words", "apart").filter("numbers is not null"))
    return cut(place_ids(places(read, spellings(read))).select(key, "text", "place"))
