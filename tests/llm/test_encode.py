import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from daftar.llm import encode


@pytest.fixture(scope="module")
def known():
    return encode.vocabulary()


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def texts():
    rng = random.Random(11)
    alphabet = list("abcdefghijklmnop  \n\t'.,0123") + ["سل", "ے", "é", "日本", "🙂", "​", " ", "'s", " the", "\r\n", "\x1c"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(400)] + ["a" * 5000, "<|endoftext|>", " " * 300, "ab" * 3000, "aAbB" * 500]


def test_same_ids(known, reference):
    for t in texts():
        assert known.encode(t) == reference(t), t[:50]


def test_prefixes_and_appends(known):
    last = known.extend(b"internationalization", [])
    for n in range(1, 20):
        assert known.read(last[:n]) == known.read(known.extend(b"internationalization"[:n], []))
    assert known.extend(b"internationalization", known.extend(b"international", [])) == last


def test_edits(known, reference):
    rng = random.Random(2)
    edited = encode.Edited(known, "The quick brown fox  jumps\nover it. " * 20)
    for _ in range(60):
        a = rng.randint(0, len(edited.text))
        b = min(len(edited.text), a + rng.randint(0, 6))
        redone = edited.replace(a, b, rng.choice(["", " ", "  ", "x", "'s", "fox", "\n\n", " 9"]))
        assert edited.flat() == reference(edited.text) and redone < 40
    edited.append(" end")
    assert edited.flat() == reference(edited.text)


def test_documents(spark, reference):
    df = spark.createDataFrame([(1, "hello world", "k"), (2, None, "k"), (3, "", "k"), (3, "hello world", "k")], "doc_id int, text string, ids string")
    got = encode.encode(df.drop("ids")).collect()
    assert sorted((r["doc_id"], list(r["ids"])) for r in got) == [(1, reference("hello world")), (2, []), (3, []), (3, reference("hello world"))]
    assert encode.encode(df).columns == ["doc_id", "ids"] and encode.encode(df.limit(0)).count() == 0
