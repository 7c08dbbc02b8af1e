import random
from itertools import combinations

import pytest

from daftar.llm import leakage


@pytest.mark.parametrize(("passage", "wrong"), [(15, 0), (15, 1), (20, 2), (12, 3)])
def test_masks_miss_nothing(passage, wrong):
    seeds = leakage.masks(passage, wrong)
    assert all(s[-1] < passage for s in seeds)
    for bad in map(set, combinations(range(passage), wrong)):
        assert any(not any(at + k in bad for k in s) for s in seeds for at in range(passage - s[-1]))


def brute(doc, item, passage, wrong):
    a, b = leakage.words(doc), leakage.words(item)
    return any(sum(x != y for x, y in zip(a[i : i + passage], b[j : j + passage])) <= wrong for i in range(len(a) - passage + 1) for j in range(len(b) - passage + 1))


@pytest.mark.parametrize(("wrong", "limit"), [(0, 10**6), (0, 0), (2, 10**6)])
def test_against_brute_force(spark, wrong, limit):
    rng = random.Random(wrong)
    word = lambda: rng.choice(["tax", "meter", "deed", "Rs.", "5,000", "owner", "file", "no", "a", "b"])
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 30)))) for i in range(12)] + [(90, None), (91, ""), (92, "short one")]
    docs = []
    for k in range(40):
        words = [word() for _ in range(rng.randint(0, 40))]
        t = (items[rng.randrange(12)][1] or "").split()
        n = rng.randint(6, 18)
        piece = t[:n]
        for _ in range(rng.randint(0, 3)):
            if piece:
                piece[rng.randrange(len(piece))] = "zzz"
        words[len(words) // 2 : len(words) // 2] = [w.upper() + rng.choice(["", ",", "​", "!"]) for w in piece]
        docs.append((k, rng.choice([" ", "  ", "\n"]).join(words)))
    docs += [(70, None), (71, ""), (72, "   "), (73, docs[0][1]), (73, docs[0][1])]
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(d, t, passage=10, substitutions=wrong, table_limit=limit).collect()}
    assert got == {(k, i) for k, x in docs for i, y in items if x and y and brute(x, y, 10, wrong)} and got


def test_forms_of_words():
    assert leakage.words("Ｒｓ． 5,000—the­ft  É́cole") == ["rs", "5000theft", "é́cole".replace("́", "")]
    assert leakage.words("A-1 b_2\n...c") == ["a1", "b2", "c"] and leakage.words(None) == []


def test_empty_tables(spark):
    d, t = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, item_text string")
    assert leakage.leaks(d, t).count() == 0
