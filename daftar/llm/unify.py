"""Visually identical text with different characters: all names in one consistent form.

Method: the words of all names that need no change form the vocabulary. Words with disguised characters
go to the shard of the vocabulary that their first letters can stand for, where a trie is traversed with a
weighted edit automaton: a look-alike costs nothing against each letter it can stand for, an ignorable
costs nothing to skip, everything else is refused. Of the spellings reached, the most frequent is taken.
Words that no spelling matches are normalized by table. Only distinct words move, and a shard holds the
words of one pair of first letters.

What must change: compatibility and presentation forms, decomposed accents, invisible characters, white
space other than U+0020, letters of other alphabets that stand for Latin ones, Arabic letters that stand
for Urdu ones. Composed accents, Urdu script, case, spelling and plain spaces stay.

Defined results: null stays null, empty stays empty; a name that needs nothing is returned unchanged;
repeated rows stay repeated; of equally frequent spellings the smaller one is taken.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.runtime import cut, distinct_wide, width

#: Letters of other alphabets and the Latin letters they can be taken for, the likeliest first.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ғ": "f", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ү": "y", "з": "z", "п": "n", "и": "u", "ь": "b", "я": "r", "б": "b", "д": "d", "л": "l", "э": "e", "ф": "f", "ш": "w", "ѡ": "w", "ԍ": "g", "ӡ": "z", "қ": "k", "ҝ": "k", "җ": "x", "ҳ": "x", "ӕ": "æ",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "З": "Z", "Ԝ": "W", "Ԁ": "D", "Ѵ": "V", "Ԛ": "Q", "Ӏ": "I", "Һ": "H", "Г": "R", "П": "N", "Ғ": "F", "Ԍ": "G", "Ь": "B",
    "α": "a", "β": "b", "ϲ": "c", "δ": "d", "ε": "e", "η": "n", "ι": "i", "ϳ": "j", "κ": "k", "μ": "u", "ν": "vn", "ο": "o", "ρ": "pr", "σ": "o", "ς": "s", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "ζ": "z", "θ": "o", "λ": "l", "π": "n", "φ": "f", "ξ": "e", "ψ": "y", "ϝ": "f",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "Γ": "T", "Δ": "D", "Λ": "A", "Σ": "E", "Π": "N", "Φ": "F", "Θ": "O", "Ω": "O",
    "ա": "w", "զ": "q", "է": "e", "ը": "n", "թ": "p", "ի": "h", "լ": "l", "խ": "l", "հ": "h", "ձ": "d", "ղ": "n", "յ": "j", "ն": "u", "ո": "no", "ռ": "n", "ս": "u", "վ": "u", "տ": "un", "ր": "n", "ց": "g", "ւ": "i", "փ": "f", "ք": "p", "օ": "o", "ֆ": "f", "գ": "q", "ե": "t", "կ": "y", "ճ": "z",
    "Ս": "U", "Օ": "O", "Տ": "S", "Լ": "L", "Հ": "Z", "Մ": "U", "Ո": "N", "Ա": "U", "Է": "E", "Ց": "G", "Ր": "R",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭵ": "i", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ʟ": "l", "ɴ": "n", "ʀ": "r", "ʏ": "y", "ᴀ": "a", "ʙ": "b", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ʜ": "h", "ɪ": "i", "ᴊ": "j", "ᴋ": "k", "ᴍ": "m", "ᴏ": "o", "ᴘ": "p", "ꜱ": "s", "ᴛ": "t", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ᴦ": "r", "ſ": "s", "ʋ": "v", "ɐ": "a", "ɛ": "e", "ɯ": "w", "ʂ": "s", "ɾ": "r",
}
#: Arabic letters and the Urdu letters they stand for.
ARABIC = {"ي": "ی", "ى": "ی", "ك": "ک", "ه": "ہ", "ة": "ۃ", "ە": "ہ", "ﮦ": "ہ", "ڪ": "ک", "ې": "ی", "ھ": "ھ"}
#: Invisible letters that aren't format characters.
FILLERS = "͏ᅟᅠㅤﾠ឴឵᠋᠌᠍᠎᠏"

IGNORED = regex.compile(rf"[\p{{Cf}}\p{{Cc}}\p{{Variation_Selector}}{FILLERS}--[\t\n\v\f\r\x1c-\x1f\x85]]", flags=regex.V1)
SPACE = regex.compile(r"[\s\x1c-\x1f]")
_ODD = regex.compile(r"[^\x20-\x7E]")
_UNIT = regex.compile(r".\p{M}*+", flags=regex.DOTALL)
_FOREIGN = regex.compile(r"[\p{L}--\p{Script=Latin}--\p{Script=Arabic}]", flags=regex.V1)


@lru_cache(maxsize=1 << 16)
def alternatives(unit: str) -> tuple[str, ...]:
    """What a character with its marks can stand for, the likeliest first."""
    plain = unicodedata.normalize("NFKC", unit)
    firsts = [""]
    for c in plain:
        low = LOOK_ALIKES.get(c)
        if low is None and unicodedata.decomposition(c) and _FOREIGN.match(c):
            parts = unicodedata.normalize("NFD", c)
            low = LOOK_ALIKES.get(parts[0])
            low = low and unicodedata.normalize("NFC", low[0] + parts[1:])
        if low is None and c in ARABIC:
            low = ARABIC[c]
        if low is None and _FOREIGN.match(c):
            # A letter that no table knows: what its public name ends in.
            low = unicodedata.name(c, "X").split(" WITH ")[0].split()[-1][:1]
            low = low if "CAPITAL" in unicodedata.name(c, "") else low.lower()
        options = [c] if low is None else [low] if len(low) == 1 else list(low)
        firsts = [f + o for f in firsts for o in options]
    return tuple(dict.fromkeys(unicodedata.normalize("NFC", f) for f in firsts))


def units(word: str) -> list[tuple[str, ...]]:
    """Alternatives of each visible character of a word, ignorables gone."""
    return [alternatives(u) for u in _UNIT.findall(IGNORED.sub("", word))]


def by_table(word: str) -> str:
    return unicodedata.normalize("NFC", "".join(x[0] for x in units(word)))


def must_change(text: str | None) -> bool:
    """Whether a text has a character that has to change."""
    if not text or not _ODD.search(text):
        return False
    return any(c != " " for c in SPACE.findall(text)) or by_table(text) != text


class Trie:
    """Spellings with their counts."""

    def __init__(self, spellings) -> None:
        self.root: dict = {}
        for spelling, count in spellings:
            node = self.root
            for c in spelling:
                node = node.setdefault(c, {})
            node[""] = (-count, spelling)

    def match(self, of: list[tuple[str, ...]]) -> tuple[str, str] | None:
        """(spelling, the same with the word's own case) at cost 0, the most frequent first."""
        states = [(self.root, "")]
        for options in of:
            states = [(node, cased + o) for start, cased in states for o in options if (node := self._walk(start, o.casefold())) is not None]
            if not states:
                return None
        ends = [(*node[""], cased) for node, cased in states if "" in node]
        return (min(ends)[1], min(ends)[2]) if ends else None

    @staticmethod
    def _walk(node: dict, letters: str):
        for c in letters:
            node = node.get(c)
            if node is None:
                return None
        return node


def _prefixes(word: str) -> list[str]:
    """The shards a word can be in: each reading of its first two characters."""
    out = [""]
    for options in units(word)[:2]:
        out = [p + o.casefold() for p in out for o in options]
    return sorted({p[:2] for p in out})


def _parts(names: DataFrame, column: str) -> DataFrame:
    """Words of names that aren't plain ASCII, by place."""
    return names.select(column, F.posexplode(F.split(column, r"(?U)[\s\x1C-\x1F]")).alias("at", "word"))


def canonical_words(names: DataFrame, column: str) -> DataFrame:
    """(word, canonical) of each distinct word of non-ASCII names that must change."""
    plain = names.filter(~F.col(column).rlike(r"[^\x20-\x7E]")).select(F.explode(F.split(F.lower(column), " ")).alias("word"))
    odd = _parts(names.filter(F.col(column).rlike(r"[^\x20-\x7E]")), column).select("word")
    counted = plain.groupBy("word").count().withColumn("plain", F.lit(True)).unionAll(odd.groupBy("word").count().withColumn("plain", F.lit(False))).filter("word <> ''")

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for word, count, plain in zip(part["word"], part["count"], part["plain"]):
                if plain:
                    rows.append((word[:2], word, count, False))
                elif must_change(word):
                    rows += [(p, word, count, True) for p in _prefixes(word)]
                else:
                    low = word.casefold()
                    rows.append((low[:2], low, count, False))
            yield pd.DataFrame(rows, columns=["shard", "word", "n", "odd"])

    placed = cut(counted.repartition(width(names.sparkSession)).mapInPandas(place, "shard string, word string, n bigint, odd boolean"))
    # Shards without a disguised word need no trie.
    wanted = placed.filter("odd").select("shard").distinct()
    vocabulary = placed.filter("not odd").join(wanted, "shard", "left_semi")

    def traverse(odd: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        counts = known.groupby("spelling")["times"].sum().to_dict()
        trie = Trie(counts.items())
        rows = [(w, *hit, int(counts[hit[0]])) for w in odd["word"] if (hit := trie.match(units(w)))]
        return pd.DataFrame(rows, columns=["word", "spelling", "canonical", "n"])

    vocabulary = vocabulary.select(F.col("shard").alias("of"), F.col("word").alias("spelling"), F.col("n").alias("times"))
    odd_words = placed.filter("odd").select("shard", "word")
    hits = odd_words.groupBy("shard").cogroup(vocabulary.groupBy("of")).applyInPandas(
        traverse, "word string, spelling string, canonical string, n bigint"
    )
    best = hits.groupBy("word").agg(F.min_by("canonical", F.struct(-F.col("n"), "spelling")).alias("canonical"))

    @F.pandas_udf("string")
    def table(words: pd.Series) -> pd.Series:
        return words.map(by_table)

    return odd_words.select("word").distinct().join(best, "word", "left").select("word", F.coalesce("canonical", table("word")).alias("canonical"), F.col("canonical").isNotNull().alias("in_vocabulary"))


def unify(rows: DataFrame, column: str, key: str = "record_id") -> DataFrame:
    """(key, name, canonical, changed) of each row; ``canonical`` has the name's words in consistent form,
    each white space character as a plain space."""
    names = rows.select(key, F.col(column).alias("name"))
    distinct = cut(distinct_wide(names, "name"))
    words = canonical_words(distinct, "name")
    parts = _parts(distinct.filter(F.col("name").rlike(r"[^\x20-\x7E]")), "name")
    rebuilt = parts.join(words, "word", "left").groupBy("name").agg(
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("canonical", "word").alias("w")))), lambda s: s["w"])).alias("canonical")
    )
    joined = names.join(rebuilt, "name", "left")
    canonical = F.coalesce("canonical", F.col("name"))
    return joined.select(key, "name", canonical.alias("canonical"), F.coalesce(canonical != F.col("name"), F.lit(False)).alias("changed"))
