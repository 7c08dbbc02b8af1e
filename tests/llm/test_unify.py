import pytest

from daftar.llm import unify


@pytest.mark.parametrize("text", ["Rafiq", "Rāfiq É.", "محمد خرم", "a  b", "", None, "قرۃ آمنہ نائلہ", "O'Neil & Sons—x", "Straße"])
def test_stays(text):
    assert not unify.must_change(text)


@pytest.mark.parametrize(
    ("text", "result"),
    [("Ｒａfiq", "Rafiq"), ("Ráfiq", "Ráfiq"), ("Raf​iq", "Rafiq"), ("Rаfiq", "Rafiq"), ("ﻥ", "ن"), ("علي", "علی"), ("كامران", "کامران"), ("فه", "فہ"), ("𝐁abar", "Babar"), ("ﬁda", "fida"), ("Οmаr", "Omar"), ("Λ️li", "Ali"), ("Jάn", "Ján")],
)
def test_changes(text, result):
    assert unify.must_change(text) and unify.by_table(text) == result


def test_spaces():
    assert unify.must_change("a b") and unify.must_change("a\tb") and unify.must_change("a　b") and not unify.must_change("a b")


def test_trie_takes_the_usual_spelling():
    trie = unify.Trie([("vani", 5), ("nani", 9), ("omar", 2)])
    assert trie.match(unify.units("νani")) == ("nani", "nani")
    assert trie.match(unify.units("Ο​mar")) == ("omar", "Omar") and trie.match(unify.units("xyz")) is None


def test_rows(spark):
    names = [("r1", "Nadeem Junaid"), ("r2", "Νаdeem Ju​naid"), ("r3", None), ("r4", ""), ("r5", "a  b"), ("r6", "Qzq Ｘｙ"), ("r6", "Qzq Ｘｙ"), ("r7", "یہ"), ("r8", "Јսոаіd N")]
    df = spark.createDataFrame([(*n, "c") for n in names], "record_id string, name string, canonical string")
    got = {(r["record_id"], r["canonical"], r["changed"]) for r in unify.unify(df, "name").collect()}
    assert got == {("r1", "Nadeem Junaid", False), ("r2", "Nadeem Junaid", True), ("r3", None, False), ("r4", "", False), ("r5", "a  b", True), ("r6", "Qzq Xy", True), ("r7", "یہ", False), ("r8", "Junaid N", True)}
    assert unify.unify(df, "name").count() == len(names) and unify.unify(df.limit(0), "name").count() == 0


def test_agrees_with_the_rule_on_whole_tables(spark, small):
    df = spark.read.parquet(f"{small}/fbr_tax_records_complex.parquet")
    for r in unify.unify(df, "full_name").collect():
        assert r["changed"] == unify.must_change(r["name"]) and not unify.must_change(r["canonical"])
