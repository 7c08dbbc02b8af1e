"""Token ids of whole texts by a public byte-level vocabulary, without special tokens.

Method: prefix dynamic programming. For every byte prefix of a word there is exactly one token that can
stand last in its valid encoding; it is stored per prefix, so the ids of any prefix are read backwards
from the end. A candidate token is valid where it and the last token of the prefix before it would not be
merged otherwise; that is decided by undoing merges on both sides of the border. Appended bytes only add
prefixes, and an edit only redoes the words that it touches.

A text falls into words by the vocabulary's public pattern before any merge, and words repeat: each Python
worker remembers the ids of words that it met (a bounded memory, emptied when full). Time is linear in
the text, unbroken stretches included.

Defined results: null and empty texts have the empty list; strings of special tokens are ordinary text;
repeated rows and extra columns stay as they are.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.runtime import spread

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Words remembered by one worker; the memory is emptied when it is full.
WORDS = 200_000


class Vocabulary:
    """Ids by bytes, the pair that each token was merged from, and the ends of tokens."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
        self.bytes = {i: b for b, i in self.ids.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        #: Every beginning of a token, and the states of the automaton that finds tokens by their ends: a state is the
        #: longest end of what was read that begins a token. States are made when they are first met.
        self.beginnings = {b[:k] for b in self.ids for k in range(len(b) + 1)}
        self.states: dict[bytes, tuple[bytes, dict, list]] = {}
        for token in sorted(self.bytes):
            text = self.bytes[token]
            if len(text) == 1:
                self.halves[token] = (token, token)
                continue
            # The last merge of a token joins the two tokens that its bytes have with older merges only.
            for k in range(1, len(text)):
                a, b = self.ids.get(text[:k]), self.ids.get(text[k:])
                if a is not None and b is not None and a < token and b < token and self.fits(a, b):
                    self.halves[token], self.merged[a, b] = (a, b), token
                    break
            else:
                self.halves[token] = (token, token)
        self.words: dict[str, list[int]] = {}
        #: Pairs of tokens that were looked at (both ids in one number), with the answer.
        self.met: dict[int, bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether the encoding of both tokens' bytes together is just these two."""
        bound = 1 << 62
        while True:
            if self.merged.get((a, b), bound) < bound:
                return False
            if a > b:
                bound, a = a, self.halves[a][1]
                if a != bound:
                    continue
                bound, b = b + 1, self.halves[b][0]
                if b + 1 == bound:
                    return True
            else:
                bound, b = b + 1, self.halves[b][0]
                if b + 1 != bound:
                    continue
                bound, a = a, self.halves[a][1]
                if a == bound:
                    return True

    def extend(self, text: bytes, last: list[int]) -> list[int]:
        """Append to ``last`` the last token of each prefix of ``text`` that it lacks."""
        met, done, state = self.met, len(last), self.state(b"")
        for end, byte in enumerate(text, 1):
            state = state[1].get(byte) or self.step(state, byte)
            if end <= done:
                continue
            found = -1
            # The longest token that ends here comes first; only one can be right.
            for size, token in state[2]:
                if size == end:
                    found = token
                    break
                before = last[end - size - 1]
                fits = met.get(before << 20 | token)
                if fits is None:
                    if len(met) >= WORDS * 5:
                        met.clear()
                    fits = met[before << 20 | token] = self.fits(before, token)
                if fits:
                    found = token
                    break
            last.append(found)
        return last

    def state(self, read: bytes) -> tuple[bytes, dict, list]:
        """The state ``read``: the bytes, the next states by byte, and (length, id) of the tokens that end it."""
        known = self.states.get(read)
        if known is None:
            ends = [(len(read) - k, self.ids[read[k:]]) for k in range(len(read)) if read[k:] in self.ids]
            known = self.states[read] = (read, {}, ends)
        return known

    def step(self, state: tuple[bytes, dict, list], byte: int) -> tuple[bytes, dict, list]:
        read = state[0] + bytes((byte,))
        while read not in self.beginnings:
            read = read[1:]
        state[1][byte] = following = self.state(read)
        return following

    def read(self, last: list[int]) -> list[int]:
        """The ids of the longest prefix, read backwards."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes[last[end - 1]])
        return out[::-1]

    def word(self, word: str) -> list[int]:
        ids = self.words.get(word)
        if ids is None:
            text = word.encode("utf-8", "surrogatepass")
            whole = self.ids.get(text)
            ids = [whole] if whole is not None else self.read(self.extend(text, []))
            if len(self.words) >= WORDS:
                self.words.clear()
            if len(word) <= 64:
                self.words[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, out = self.words, []
        for word in words_of(text):
            out += known.get(word) or self.word(word)
        return out

    def count(self, text: str) -> int:
        known = self.words
        return sum([len(known.get(w) or self.word(w)) for w in words_of(text)]) if text else 0


PATTERN = regex.compile(public_tokenizers.PATTERN)
#: The same for ASCII text without control characters, by a faster engine.
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
_CONTROLS = re.compile("[\x1c-\x1f]")


def words_of(text: str) -> list[str]:
    """The words of a text by the vocabulary's pattern; together they are the text."""
    return PLAIN.findall(text) if text.isascii() and not _CONTROLS.search(text) else PATTERN.findall(text)


class Edited:
    """A text with its words and ids, to which near edits are made without encoding the rest again."""

    def __init__(self, vocabulary: Vocabulary, text: str = "") -> None:
        self.vocabulary, self.text = vocabulary, text
        self.spans = [m.span() for m in PATTERN.finditer(text)]
        self.ids = [vocabulary.word(text[a:b]) for a, b in self.spans]

    def flat(self) -> list[int]:
        return [i for word in self.ids for i in word]

    def replace(self, start: int, end: int, by: str) -> int:
        """Replace text[start:end]; returns how many words were encoded anew."""
        text, shift = self.text[:start] + by + self.text[end:], len(by) - (end - start)
        # The pattern looks one character ahead, so words that end before start - 1 stand as they are.
        keep = 0
        while keep < len(self.spans) and self.spans[keep][1] < start:
            keep += 1
        keep = max(0, keep - 1)
        old = {a + shift: k for k, (a, _) in enumerate(self.spans) if a >= end}
        at = self.spans[keep][0] if keep < len(self.spans) else 0
        spans, rest = [], len(self.spans)
        for m in PATTERN.finditer(text, at):
            if m.start() >= start + len(by) and m.start() in old:
                rest = old[m.start()]
                break
            spans.append(m.span())
        new = [self.vocabulary.word(text[a:b]) for a, b in spans]
        self.spans = self.spans[:keep] + spans + [(a + shift, b + shift) for a, b in self.spans[rest:]]
        self.ids, self.text = self.ids[:keep] + new + self.ids[rest:], text
        return len(new)

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)


@lru_cache(maxsize=2)
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """One per Python worker."""
    return Vocabulary(path)


def encode(documents: DataFrame, text: str = "text", path: str = VOCABULARY, ids: str = "ids") -> DataFrame:
    """``documents`` without ``text``, with the token ids of each row's whole text in ``ids``."""

    def tokens(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = vocabulary(path)
        for part in parts:
            flat, ends = array("i"), array("i", [0])
            for t in part:
                flat.extend(known.encode(t.as_py()))
                ends.append(len(flat))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

    rows = spread(documents)
    # Annotated here, since annotations in strings name nothing that Spark could read.
    tokens.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return rows.select(*[c for c in rows.columns if c not in (text, ids)], F.arrow_udf(tokens, "array<int>")(F.col(text)).alias(ids))
