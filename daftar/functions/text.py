"""Normalization of names, addresses and phones as native column expressions.

Everything stays inside the JVM. Compatibility decomposition has no built-in function, so single
characters are folded by a table that is computed by rule when the module is loaded; characters that
decompose into several (ligatures, fractions) become blanks like other symbols.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and tables that results depend on.
HONORIFICS = ["mr", "mrs", "ms", "miss", "dr", "haji", "syed", "sayed"]
LEADING_TITLES = ["ch", "chaudhry", "chaudhary", "malik", "mian", "raja", "sardar"]
NAME_ALIASES = {
    "mohd": "muhammad", "mhd": "muhammad", "muhd": "muhammad", "mohamad": "muhammad", "mohammad": "muhammad", "muhamad": "muhammad", "muhammed": "muhammad", "mohammed": "muhammad", "mhmd": "muhammad", "mhmmd": "muhammad",
    "ahmd": "ahmed", "hmad": "ahmed", "aly": "ali", "rsa": "raza", "rza": "raza", "asman": "usman", "athman": "usman", "asmat": "usman", "tarq": "tariq", "tark": "tariq", "sarh": "sara", "mlk": "malik", "abd": "abdul",
}
TOKEN_EQUIVALENTS = {"m": ["m", "muhammad"], "muhammad": ["muhammad", "m"], "ahmad": ["ahmad", "ahmed"], "ahmed": ["ahmed", "ahmad"]}
ADDRESS_WORDS = {"road": "rd", "street": "st", "sector": "sec", "phase": "ph", "house": "h", "flat": "flt", "block": "blk", "apartment": "apt", "avenue": "ave", "mohalla": "moh", "colony": "col"}
CITIES = ["karachi", "lahore", "islamabad", "rawalpindi", "faisalabad", "multan", "peshawar", "quetta"]
URDU_LETTERS = {"ا": "a", "آ": "a", "ب": "b", "پ": "p", "ت": "t", "ٹ": "t", "ث": "s", "ج": "j", "ح": "h", "د": "d", "ڈ": "d", "ذ": "z", "ر": "r", "ڑ": "r", "ز": "z", "س": "s", "ص": "s", "ض": "z", "ط": "t", "ظ": "z", "ع": "a", "ف": "f", "ق": "q", "ک": "k", "گ": "g", "ل": "l", "م": "m", "ن": "n", "ں": "n", "و": "w", "ہ": "h", "ھ": "h", "ی": "y", "ے": "e"}
URDU_PAIRS = {"چ": "ch", "خ": "kh", "ژ": "zh", "ش": "sh", "غ": "gh"}
URDU_SILENT = "ء"


@lru_cache(maxsize=1)
def single_folds() -> tuple[str, str]:
    """Characters whose decomposition without marks is one ASCII character, and those characters."""
    source, target = [], []
    for code in range(0x80, 0x20000):
        if 0xD800 <= code < 0xE000:
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and 0x20 < ord(plain) < 0x7F:
            source.append(chr(code))
            target.append(plain)
    return "".join(source), "".join(target)


@lru_cache(maxsize=1)
def single_lowers() -> tuple[str, str]:
    """As ``single_folds``, in lower case; characters outside the BMP aside, which other engines don't translate alike."""
    a, b = single_folds()
    kept = [(x, y.lower()) for x, y in zip(a, b) if ord(x) < 0x10000]
    return "".join(x for x, _ in kept), "".join(y for _, y in kept)


def transliterate_urdu(text: Column) -> Column:
    out = F.translate(text, "".join(URDU_LETTERS) + URDU_SILENT, "".join(URDU_LETTERS.values()))
    for letter, pair in URDU_PAIRS.items():
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return out


def normalize_text(value: Column) -> Column:
    """Null becomes empty; lower-case ASCII letters, digits, dot, slash and hyphen, single blanks."""
    text = transliterate_urdu(F.coalesce(value.cast("string"), F.lit("")))
    text = F.regexp_replace(F.translate(text, *single_lowers()), r"\p{Mn}+", "")
    text = F.replace(F.lower(text), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9\s./-]", " "), r"\s+", " "))


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _split(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def name_tokens(value: Column) -> Column:
    """Words of a name without honorifics and a leading title, in their usual spelling."""
    raw = _split(F.replace(normalize_text(value), F.lit("."), F.lit(" ")))
    words = F.transform(raw, lambda t, i: F.struct(F.regexp_replace(t, "^[-/]+|[-/]+$", "").alias("w"), i.alias("i")))
    kept = F.filter(words, lambda x: (x["w"] != "") & ~x["w"].isin(HONORIFICS) & ~((x["i"] == 0) & x["w"].isin(LEADING_TITLES)))
    aliases = _map(NAME_ALIASES)
    return F.transform(kept, lambda x: F.coalesce(F.try_element_at(aliases, x["w"]), x["w"]))


def normalize_name(value: Column) -> Column:
    return F.array_join(name_tokens(value), " ")


def normalize_address(value: Column) -> Column:
    words = _map(ADDRESS_WORDS)
    return F.array_join(F.transform(_split(normalize_text(value)), lambda t: F.coalesce(F.try_element_at(words, t), t)), " ")


def normalize_phone(value: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[^0-9]", "")
    local = F.when(digits.startswith("92") & (F.length(digits) >= 12), F.concat(F.lit("0"), F.substr(digits, F.lit(3)))).otherwise(digits)
    return F.when(F.length(local) >= 11, F.right(local, F.lit(11))).otherwise(local)


def alias_tokens(tokens: Column) -> Column:
    """Distinct words, those with equivalents together with them."""
    same = F.create_map(*[x for k, v in TOKEN_EQUIVALENTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(same, t), F.array(t)))))


def initials(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.substring(t, 1, 1)), "")


def first_initial(tokens: Column) -> Column:
    return F.coalesce(F.substring(F.get(tokens, F.lit(0)), 1, 1), F.lit(""))


def surname(tokens: Column) -> Column:
    return F.coalesce(F.try_element_at(tokens, F.lit(-1)), F.lit(""))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """n-grams of normalized text with two blanks on either side; none for empty text."""
    padded = F.concat(F.lit("  "), text, F.lit("  "))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substr(padded, i, F.lit(n))))


def counts(items: Column) -> Column:
    """How often each item stands in a list, as a map."""
    return F.map_from_entries(F.transform(F.array_distinct(items), lambda x: F.struct(x, F.size(F.filter(items, lambda y: y == x)).cast("double"))))


def cosine_of_counts(a: Column, b: Column) -> Column:
    """Cosine of two maps of counts, 0 if one is empty."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.transform(F.array_intersect(F.map_keys(a), F.map_keys(b)), lambda k: F.try_element_at(a, k) * F.try_element_at(b, k)))
    norm = F.sqrt(total(F.transform(F.map_values(a), lambda x: x * x))) * F.sqrt(total(F.transform(F.map_values(b), lambda x: x * x)))
    return F.when(norm > 0, dot / norm).otherwise(0.0)


def phonetic_code(token: Column) -> Column:
    base = F.replace(F.translate(token, "qczv", "kksw"), F.lit("x"), F.lit("ks"))
    kept = F.concat(F.substring(base, 1, 1), F.regexp_replace(F.substr(base, F.lit(2)), "[aeiouhwy]", ""))
    return F.regexp_replace(kept, r"(.)\1+", "$1")


def phonetic_codes(tokens: Column) -> Column:
    return F.filter(F.array_distinct(F.transform(tokens, phonetic_code)), lambda c: c != "")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def initials_compatible(a: Column, b: Column) -> Column:
    """From token lists: one string of initials starts the other, or surname and first initial agree."""
    x, y = initials(a), initials(b)
    return (x != "") & (y != "") & (x.startswith(y) | y.startswith(x) | ((surname(a) == surname(b)) & (first_initial(a) == first_initial(b))))


def address_block(norm_address: Column) -> Column:
    """The first four words that hold a digit or more than two letters."""
    return F.array_join(F.slice(F.filter(_split(norm_address), lambda t: t.rlike("[0-9]") | (F.length(t) > 2)), 1, 4), " ")


def city_hint(norm_address: Column) -> Column:
    """The first known city that the address holds, else its last word."""
    found = F.coalesce(F.try_element_at(_split(norm_address), F.lit(-1)), F.lit(""))
    for city in reversed(CITIES):
        found = F.when(norm_address.contains(city), F.lit(city)).otherwise(found)
    return found


def stable_id(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha1(value), 1, 12))


def mask_phone(phone: Column) -> Column:
    return F.concat(F.lit("***"), F.right(phone, F.lit(4)))


def clean_number(value: Column) -> Column:
    """Digits and dots of a cell as a number, 0 where that is none; the sign is not kept."""
    digits = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[^0-9.]", "")
    return F.coalesce(digits.try_cast("double"), F.lit(0.0))


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def round_half_even(value: Column, digits: int) -> Column:
    """Rounding of the exact binary value, ties to even. Texts are made only of what is near a tie or large."""
    by = 10.0**digits
    exact = F.call_function("format_number", value, F.lit("0." + "0" * digits if digits else "0")).cast("double")
    scaled = value * by
    return F.when((F.abs(scaled - F.floor(scaled) - 0.5) > 1e-6) & (F.abs(scaled) < 1e9), F.rint(scaled) / by).otherwise(exact)
