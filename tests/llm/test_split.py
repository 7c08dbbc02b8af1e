import random

import pytest

from daftar.llm import split
from daftar.llm.encode import vocabulary


def samples():
    rng = random.Random(4)
    words = "tax meter deed owner clerk refund Lahore یہ مکان 5,000 🙂".split()
    out = []
    for _ in range(30):
        t = ""
        for _ in range(rng.randint(1, 60)):
            t += " ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) + rng.choice([". ", ".\n", "\n\n", "! ", " "])
        out.append(t)
    return [*out, "x" * 5000, "ے" * 1500, " " * 4000, "a b " * 2000, "🙂" * 900, "\n" * 3000]


@pytest.mark.parametrize(("limit", "overlap"), [(64, 0), (64, 15), (256, 32)])
def test_pieces(limit, overlap):
    known = vocabulary()
    for t in samples():
        got = split.pieces(t, known, limit, overlap)
        assert got[0][0] == 0 and got[-1][1] == len(t)
        for a, b, n in got:
            assert n == known.count(t[a:b]) <= limit
        for (a, b, _), (c, d, _) in zip(got, got[1:]):
            assert a < c <= b < d and known.count(t[c:b]) <= overlap + 2
        assert "".join(t[max(a, e) : b] for (a, b, _), e in zip(got, [0, *[x[1] for x in got]])) == t


def test_cuts_where_the_topic_changes():
    tax = "The tax return of the filer was sent to the tax office with the refund claim. "
    crop = "Wheat grows on the field near the river where farmers water their crop daily. "
    t = tax * 20 + crop * 20
    cuts = {b for _, b, _ in split.pieces(t, vocabulary(), 400, 0)}
    assert len(tax) * 20 - 1 in cuts


def test_words_of_three_letters_tell_topics():
    tax, cow = "The tax fee was due. ", "Our cow ate hay raw. "
    t = tax * 60 + cow * 60
    cuts = {b for _, b, _ in split.pieces(t, vocabulary(), 400, 0)}
    assert len(tax) * 60 - 1 in cuts


def test_overlap_is_used():
    t = "One two three four five six seven. " * 200
    got = split.pieces(t, vocabulary(), 128, 24)
    assert all(b > c for (_, b, _), (c, _, _) in zip(got, got[1:]))


def test_documents(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "short", 5), (4, "word " * 3000, 5), (4, "word " * 3000, 5)], "doc_id long, text string, piece_no int")
    got = split.split(df).collect()
    by = lambda k: [r for r in got if r["doc_id"] == k]
    assert [(r["piece"], r["n_tokens"]) for r in by(1) + by(2) + by(3)] == [(None, 0), ("", 0), ("short", 1)]
    assert len(by(4)) > 8 and split.split(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="quarter"):
        split.split(df, limit=100, overlap=50)
