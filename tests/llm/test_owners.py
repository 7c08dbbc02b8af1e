import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from daftar.llm import names, owners, places
from daftar.runtime import cut, table

WAYS = [
    "House 194, Lalazar Road, Kogedita Colony, Islamabad", "194 - Lalazar Road - Kogedita Colony - Islamabd", "KOGEDITA COLONY LALAZAR RAOD H-194 ISLAMABAD", "مکان ۱۹۴، Lalazar Road.، Kogedita Col، اسلام آباد",
    "Behind Petrol Pump, Kogedita Colony,Lalazar Road,House No. 194", "h.194; lalazar rd; kogedita clny",
]


def test_addresses():
    assert {places.read_address(w)[:2] for w in WAYS} == {("h194|", "kogedita lalazar")} and {places.read_address(w)[2] for w in WAYS} == {"c=islamabad", ""}
    street = ["House 23-A, Street 32, Phase 6, Rutasodi Housing Scheme, Karachi", "H#23A,32nd St,Ph. VI,Rutasodi H/S", "Rutasodi,Phase Six,Street No. 32,House # 23-a,Khi", "R/o 23A St# 32 Rutasodi Scheme"]
    assert [places.read_address(w) for w in street] == [("h23a|32", "rutasodi", x) for x in ("c=karachi;p=6", "p=6", "c=karachi;p=6", "")]
    assert places.read_address("F-52 - Notedaku Hts - Magikedu, F/abad") == ("f52|", "magikedu notedaku", "c=faisalabad")
    assert places.read_address("Apt. No 52, Notedaku Heights, Magikedu Colony") == ("f52|", "magikedu notedaku", "")
    assert places.read_address("House 12/A, Street 5, Block C, Model Town, Lahore 54000") == ("h12a|5", "model", "b=c;c=lahore") and places.read_address("12-A Street 5 Model Town")[0] == "h12a|5"
    assert places.read_address("House 5 Gulberg III") == places.read_address("House 5, Gulberg 3") == ("h5|", "gulberg", "p=3")
    assert [places.read_address(x) for x in (None, "", "  ", "same", "as per record", "Lahore", "5", "x" * 100_000)] == [None] * 8
    assert places.read_address("House Five Street Two Bunniva") is None or places.read_address("House 5 Street Two Buneniva") == ("h5|2", "buneniva", "")


def test_edits():
    def brute(a, b):
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(60)]
    for a in words:
        for b in words:
            assert places.edits(a, b) == brute(a, b)


def test_index_misses_no_similar_words(spark):
    rng = random.Random(3)
    base = ["kogedita", "rutasodi", "buneniva", "lalazar", "qila", "sabeganu", "vikevima", "anarbagh"]
    typed = {w: 100 for w in base}
    for w in base:
        for _ in range(12):
            i = rng.randrange(len(w) - 1)
            t = rng.choice([w[:i] + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + w[i] + w[i:], w[:i] + rng.choice("aeiou") + w[i + 1 :]])
            typed.setdefault(t, 1)
    df = spark.createDataFrame(list(typed.items()), "word string, n long")
    got = {(r["word"], r["other"]) for r in places.alike(df, df, 0.55, F.lit(True)).collect()}
    similar = lambda a, b: places.cosine(places.vector(a), places.vector(b)) >= 0.55 and places.like(a, b, 0.55)
    plain = lambda a, b: len(a) + len(b) > 0 and levenshtein(a, b) <= 2
    assert {(a, b) for a in typed for b in typed if a != b and similar(a, b) and plain(a, b)} <= got
    roots = {r["word"]: r["root"] for r in places.word_roots(df, 0.55).collect()}
    assert all(any(roots.get(t) == w for w in base) for t in typed if t not in base and any(similar(t, w) for w in base))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_trie_join_finds_all_neighbours(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("kas") + rng.choice("iu") for _ in range(rng.randint(2, 5)))[: rng.randint(3, 10)] for _ in range(300)})
    got = {(r["word"], r["other"]): r["edits"] for r in names.neighbours(spark.createDataFrame([(w,) for w in words], "word string"), 1).collect()}
    expected = {(a, b): 1 for a in words for b in words if a != b and min(len(a), len(b)) >= 3 and places.edits(a, b) == 1}
    missing = {p for p in set(expected) - set(got) if min(map(len, p)) > 4}
    assert not missing and all(places.edits(*p) == k for p, k in got.items())


def test_one_edit_is_found_without_a_trie(monkeypatch):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(400)})
    monkeypatch.setattr(names, "traverse", None)
    got = names.search([(w, i % 3 > 0, i % 5 > 0) for i, w in enumerate(words)], 1)
    right = {(a, b, 1) for i, a in enumerate(words) for j, b in enumerate(words) if i % 5 and j % 3 and a != b and min(len(a), len(b)) > 2 and places.edits(a, b) == 1}
    assert len(got) == len(set(got)) and set(got) == right and len(right) > 300


def test_blocks_of_equally_long_names_are_not_looked_at(spark, monkeypatch):
    """What has as many given names can't stand for each other; before, such blocks were joined as others."""
    read = []
    monkeypatch.setattr(owners, "cut", lambda df, **k: read.append(cut(df, **k)) or read[-1])
    at = [(1, "khan", "amina|", 1), (2, "khan", "nigat|", 1), (3, "khan", "#org|", 2), (4, "khan", "#mills|", 2), (5, "khan", "|n", 3), (6, "khan", "nigat|", 3), (7, "khan", "ali+nigat|", 4), (8, "khan", "|a+n", 4)]
    people = spark.createDataFrame(at, "node long, surname string, form string, phone long").withColumn("place", F.lit(None).cast("long")).withColumn("family", F.lit(False))
    full = {r["node"]: r["form"] for r in owners.resolve_forms(people).collect()}
    assert full == {1: "amina|", 2: "nigat|", 3: "#mills|", 4: "#mills|", 5: "nigat|", 6: "nigat|", 7: "ali+nigat|", 8: "ali+nigat|"}
    assert read[1].columns == ["block"] and read[1].count() == 3


def test_two_edits(spark):
    words = ["sukusavalini", "sukusavalni", "sukusvalin", "usukasavalini", "sukusavalinixx"]
    got = {(r["word"], r["other"]): r["edits"] for r in names.neighbours(spark.createDataFrame([(w,) for w in words], "word string"), 2).collect()}
    assert {p for p in got if p[0] == words[0]} == {(words[0], w) for w in words[1:] if places.edits(words[0], w) <= 2}


@pytest.mark.parametrize(
    ("text", "result"),
    [
        ("Mr. J. Sukusavali", ("person", ["j", "sukusavali"])), ("JawadSukusavali", ("person", ["javad", "sukusavali"])), ("M/s Nego sibalena Pharma (Pvt) Ltd, HO", ("org", ["negosibalena", "#pharma"])), ("Legal Aid Trust", ("org", ["legalaid", "#trust"])), ("Punjab Textile Mills Ltd", ("org", ["punjab", "#mills", "#textile"])),
        ("Family Kazmi", None), ("N/A", None), ("-", None), ("TBD", None), ("Unnamed Seller", None), (None, None), ("", None), ("Omar Khan S/O Ali Khan", ("person", ["umar", "kan"])), ("جواد", ("person", ["~jvad"])),
        ("Jаwad K", ("person", ["javad", "k"])),
    ],
)
def test_names(text, result):
    assert names.read_name(text) == result


@pytest.mark.parametrize(("text", "result"), [("Vacant Unit", None), ("VACANT UNIT", None), ("Legal Heirs (Pvt) Ltd", None), ("Tenant Traders", ("org", ["tenant", "#traders"])), ("Kazmi Unit", ("org", ["kazmi"]))])
def test_placeholders_are_no_organisations(text, result):
    assert names.read_name(text) == result


def test_short_forms(spark):
    spark_forms = {r["f"]: set(r["s"]) for r in spark.createDataFrame([("nigat|",), ("amina+nigat|",), ("#mills+#steel|",)], "f string").select("f", owners.shorter(F.col("f")).alias("s")).collect()}
    assert spark_forms["nigat|"] == {"|n"} and spark_forms["amina+nigat|"] == {"amina|", "nigat|", "amina|n", "nigat|a", "|a", "|n", "|a+n"} and {"#mills|", "#steel|", "#org|"} <= spark_forms["#mills+#steel|"]
    at = [(i, "khan", f, 1, None, "person", False) for i, f in enumerate(["|n", "nigat|", "kiran|", "|k", "kasim|", "amina|", "amina+nigat|"])]
    people = spark.createDataFrame(at, "node long, surname string, form string, phone long, place long, kind string, family boolean")
    full = {r["node"]: r["form"] for r in owners.resolve_forms(people).collect()}
    # Two given names begin with k, so its initial stays open.
    assert full == {0: "amina+nigat|", 1: "amina+nigat|", 2: "kiran|", 3: "|k", 4: "kasim|", 5: "amina+nigat|", 6: "amina+nigat|"}


PEOPLE = [
    ("t:1", "tax", "Jawad Sukusavali", WAYS[0], "0393-3548454"), ("t:2", "tax", "Jawaad Sukusavali", WAYS[1], None), ("v:1", "veh", "J. Sukusavali", WAYS[2], "+92 393 3548454"), ("d:1", "dis", "Sukusavali, Jadi", "House 5, Street 2, Dutagilu", "03933548454"),
    ("p:1", "pro", "JAWAD SUKUSAVALI", None, None), ("v:2", "veh", "Kiran Sukusavali", WAYS[3], "03933548454"), ("d:2", "dis", "Family Sukusavali", WAYS[0], "03933548454"), ("t:3", "tax", None, WAYS[0], "03933548454"),
    ("v:3", "veh", "Tomemugukaba Traders", "Flat 136, Gitukive Heights, Rasamuga Park", None), ("d:3", "dis", "M/s Tomemugukaba Trdrs Pvt. Ltd.", "House 9, Street 3, Sabeganu", None), ("t:4", "tax", "Jawad Sukusavali", WAYS[0], "0393-3548454"),
]


def pairs_of(df):
    return {(r["left_record_id"], r["right_record_id"]) for r in df.collect()}


@pytest.fixture(scope="module")
def short(spark):
    return spark.createDataFrame([("Jadi", "Jawad"), ("Kinno", "Kiran"), (None, "x")], "short_name string, given_name string")


def expected(ids):
    return {tuple(sorted((a, b))) for a in ids for b in ids if a < b and a[0] != b[0]}


@pytest.mark.parametrize("shipped", [500_000, 0])
def test_owners(spark, short, monkeypatch, shipped):
    monkeypatch.setattr(places, "SHIPPED", shipped)
    df = spark.createDataFrame([(*p, 1) for p in PEOPLE], "record_id string, source string, name string, address string, phone string, owner int")
    owned = owners.owner_ids(df, short).cache()
    jawad = ["t:1", "t:2", "t:4", "v:1", "d:1", "p:1"]
    assert pairs_of(owners.owner_pairs(owned, True)) == expected(jawad) | {("d:3", "v:3")}
    assert pairs_of(owners.owner_pairs(owned, False)) == {("t:1", "t:2"), ("t:2", "t:4")}
    assert all(0 < r["confidence"] < 1 for r in owners.owner_pairs(owned, True).collect())
    assert owners.owner_pairs(owners.owner_ids(df.limit(0), short), True).count() == 0


@pytest.mark.parametrize("shipped", [500_000, 0])
def test_places(spark, monkeypatch, shipped):
    monkeypatch.setattr(places, "SHIPPED", shipped)
    rows = [(f"r{i}", w) for i, w in enumerate(WAYS)] + [("s1", "House 194, Lalazar Road, Kogeidta Colony"), ("s2", "House 195, Lalazar Road, Kogedita Colony"), ("s3", "same"), ("s4", None), ("s5", WAYS[0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "record_id string, address string, place string")
    same = [*[f"r{i}" for i in range(6)], "s1", "s5"]
    assert pairs_of(places.same_place_pairs(df)) == {(a, b) for a in same for b in same if a < b} - {("r0", "s5")}
    assert places.same_place_pairs(df.limit(0)).count() == 0


def test_taxpayers_are_found(spark, small):
    """Tax rows with one number are one owner: recall and precision over all rows of a table."""
    tax = table(spark, small, "fbr_tax_records_complex")
    records = owners.records_of({t: table(spark, small, t) for t in owners.CIVIC})
    rows = owners.owner_ids(records, table(spark, small, "short_names")).join(tax.select("record_id", "ntn"), "record_id").filter("ntn is not null and ntn <> 'NTN-AGT-0001'").collect()
    pairs = [(a["ntn"] == b["ntn"], a["owner"] == b["owner"]) for i, a in enumerate(rows) for b in rows[i + 1 :]]
    both = pairs.count((True, True))
    assert both > 0.9 * (both + pairs.count((True, False))) and both > 0.9 * (both + pairs.count((False, True)))


def test_full_names_spread_along_a_chain(spark):
    rows = [(i, "sukusavali", "amina|" if i < 7 else "amina+nigat|", (i + 1) // 2, i // 2, "person", False) for i in range(8)]
    people = spark.createDataFrame(rows, "node long, surname string, form string, phone long, place long, kind string, family boolean")
    assert {r["form"] for r in owners.resolve_forms(people).collect()} == {"amina+nigat|"}
    with pytest.raises(RuntimeError, match="stable"):
        owners.resolve_forms(people, rounds=3)


def test_long_chains_of_spellings_lead_to_their_root(spark):
    # One more letter differs from word to word.
    words = ["".join("z" if j < i else c for j, c in enumerate("kurabemidosalin")) for i in range(12)]
    typed = spark.createDataFrame([(w, 4 ** (12 - i)) for i, w in enumerate(words)], "word string, n long")
    known = {r["word"]: r["root"] for r in names.canonical_words(typed, typed.limit(0).select("word")).collect()}
    assert set(known.values()) == {words[0]}
    roots = {r["word"]: r["root"] for r in places.word_roots(typed, 0.7).collect()}
    assert len(roots) == 11 and set(roots.values()) == {words[0]}


@pytest.mark.parametrize("shipped", [500_000, 0])
def test_repeated_and_null_ids_keep_their_forms(spark, short, monkeypatch, shipped):
    monkeypatch.setattr(places, "SHIPPED", shipped)
    named = [("t:1", "Jawad Sukusavali"), ("t:1", "Jawad Sukusavali"), (None, "Kiran Sukusavali"), (None, "Jawad Rutasodi")]
    df = spark.createDataFrame([(i, "tax", n, None, None) for i, n in named], "record_id string, source string, name string, address string, phone string")
    got = sorted((r["surname"], r["form"]) for r in owners.described(df, short).collect())
    assert got == [("rutasudi", "javad|"), ("sukusavali", "javad|"), ("sukusavali", "javad|"), ("sukusavali", "kiran|")]


def test_vocabularies_are_worked_out_once(spark, short, monkeypatch):
    """What is measured and then shipped is a table, not a plan that would run for both."""
    asked, shipped = [], owners.shipped
    monkeypatch.setattr(owners, "shipped", lambda known, *columns: asked.append(known) or shipped(known, *columns))
    df = spark.createDataFrame([("t:1", "tax", "Jawad Sukusavali", WAYS[0], "0092-393-3548454"), ("t:2", "tax", "Kiran Rutasodi", None, "039"), ("t:3", "tax", "Kiran Rutasodi", None, "03333333333")], "record_id string, source string, name string, address string, phone string")
    assert {r["record_id"]: r["phone"] for r in owners.described(df, short).collect()} == {"t:1": 3933548454, "t:2": None, "t:3": None}
    assert [type(k).__name__ for k in asked] == ["DataFrame"] * 2 and all(hasattr(k, "_cut_folder") for k in asked)


def test_owners_of_a_surname_are_counted_exactly(spark):
    of = {f"s{i}": 150 * i for i in range(12)}
    rows = [(s, p) for s, n in of.items() for p in (*range(n), *range(n // 2), None)]
    people = spark.createDataFrame(rows, "surname string, phone long").withColumn("kind", F.lit("person")).withColumn("form", F.lit("a|"))
    assert {r["surname"]: r["owners"] for r in owners.surname_owners(people).collect()} == of


def test_parts_that_tell_places_apart(spark):
    """City, phase and block are compatible or missing where a name settles them, and tell places apart where not."""
    texts = {
        "lahore": "House 12, Street 5, Model Town, Lahore", "karachi": "House 12, Street 5, Model Town, Karachi", "phase2": "House 3, Street 1, DHA Phase 2", "phase6": "House 3, Street 1, DHA Phase 6",
        "blockb": "Flat 3, Block B, Askari Heights", "blockc": "Flat 3, Block C, Askari Heights", "a": "House 12/A, Street 5, Model Town, Lahore", "known": "House 9, Street 5, Sabeganu Colony, Phase 4, Quetta", "same": "H 9 St. 5 Sabeganu", "other": "House 9, Street 6, Sabeganu",
    }
    df = spark.createDataFrame(list(texts.items()), "record_id string, address string")
    assert pairs_of(places.same_place_pairs(df)) == {("known", "same")}


def test_every_alike_address_is_linked(spark):
    """All pairs of the threshold, not the nearest of each, except where each address has a usual word of its own."""
    usual = [(f"h{i}|", w) for i in range(2, 12) for w in ("kogeditasanuvi lalazarbagh", "rutasodimelanu lalazarbagh")]
    near = [("h1|", w) for w in ("kogeditasanuvi lalazarbagh", "kogeditasanuvo lalazarbagh", "kogeditasanuvos lalazarbagh", "kogeditasanuvi", "rutasodimelanu lalazarbagh", "rutasodimelanq lalazarbagh")]
    keys = [(i, *k) for i, k in enumerate(near + usual)]
    df = spark.createDataFrame(keys, "id long, at string, naming string")
    frequency = Counter(w for _, _, n in keys for w in n.split())
    total = sum(frequency.values())

    def vector(words):
        out = Counter()
        for w in words.split():
            for i in range(len(w) + 1):
                out[f"^{w}$"[i : i + 2]] += math.log1p(total / frequency[w]) / math.sqrt(len(w) + 1)
        return out

    own = lambda x, y: {w for w in x.split() if frequency[w] > 5} - set(y.split())
    for threshold, least in ((0.6, {(0, 1), (0, 2), (1, 2), (4, 5)}), (0.85, {(1, 2), (4, 5)})):
        hand = {(a, b) for a, p, x in keys for b, q, y in keys if a < b and p == q and not (own(x, y) and own(y, x)) and places.cosine(vector(x), vector(y)) >= threshold}
        assert {tuple(r) for r in places.alike_addresses(df, threshold).collect()} == hand
        assert least <= hand and (0, 4) not in hand


def test_contradicting_addresses_are_not_paired(spark):
    """At one number, of 400 namings in two usual words each only those are paired whose usual words are among another's."""
    words = [a + b for a in ("kogedi", "rutaso", "lalaza", "mehrab") for b in ("tasanu", "dimela", "rbaghu", "vinoro", "shisha")]
    named = [(i, "h1|", " ".join(sorted((x, y))), sorted((x, y))) for i, (x, y) in enumerate((x, y) for x in words for y in words if x < y)]
    named += [(900, "h1|", f"{words[0]}", [words[0]]), (901, "h2|", words[1], [words[1]]), (902, "h1|", "xyzzy", []), (903, "h1|", named[0][2] + " zzyzx", named[0][3])]
    placed = spark.createDataFrame(named, "id long, at string, naming string, usual array<string>")
    hand = {(i, j) for i, p, _, u in named for j, q, _, v in named if i < j and p == q and (u and set(u) <= set(v) or v and set(v) <= set(u))}
    got = [(r["a"], r["b"]) for r in places.usual_pairs(placed).collect()]
    assert len(got) == len(set(got)) and set(got) == hand and len(hand) == 21


def test_places_by_kind_of_variation(spark):
    """Recall of labelled variants, by kind, over invented places; precision over all of them."""
    rng = random.Random(5)
    name = lambda: "".join(rng.choice("bdgklmnrstv") + rng.choice("aeiou") for _ in range(4))
    areas = [(name(), rng.choice(["Colony", "Town", "Garden"]), rng.choice(["Lahore", "Peshawar", "Quetta"]), rng.randint(1, 9)) for _ in range(12)]
    short = {"Colony": "Col", "Town": "Twn", "Garden": "Gdn", "Lahore": "LHR", "Peshawar": "Pesh", "Quetta": "QTA"}

    def typo(w):
        i = rng.randrange(1, len(w) - 2)
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + w[i] + w[i:], w[:i] + "x" + w[i + 1 :]])

    kinds = {
        "plain": lambda h, s, a, f, c, p: f"House {h}, Street {s}, Phase {p}, {a} {f}, {c}", "short": lambda h, s, a, f, c, p: f"H# {h} St-{s} Ph {p} {a} {short[f]} {short[c]}", "order": lambda h, s, a, f, c, p: f"{c}, {a} {f}, Street {s}, House {h}",
        "missing": lambda h, s, a, f, c, p: f"{h} Gali {s} {a}", "typo": lambda h, s, a, f, c, p: f"House {h}, Street {s}, {typo(a)} {f}, {c}", "typo of city": lambda h, s, a, f, c, p: f"House {h}, Street {s}, {a} {f}, {typo(c)}", "ordinal": lambda h, s, a, f, c, p: f"{s}th Street, House No. {h}, {a.upper()}",
    }
    rows = []
    for i in range(150):
        a, f, c, p = rng.choice(areas)
        h, s = rng.randint(1, 60), rng.randint(4, 19)
        rows += [(f"{kind}:{i}", (h, s, a), make(h, s, a.title(), f, c, p)) for kind, make in kinds.items()]
    got = pairs_of(places.same_place_pairs(spark.createDataFrame([(k, t) for k, _, t in rows], "record_id string, address string")))
    place, text = {k: x for k, x, _ in rows}, {k: t for k, _, t in rows}
    for kind in kinds:
        true = {tuple(sorted((f"{kind}:{i}", f"plain:{i}"))) for i in range(150) if text[f"{kind}:{i}"] != text[f"plain:{i}"]}
        assert len(true & got) >= 0.95 * len(true), (kind, len(true & got) / max(1, len(true)))
    assert sum(place[x] == place[y] for x, y in got) >= 0.99 * len(got)
