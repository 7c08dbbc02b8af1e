import math
import random
import unicodedata
from collections import Counter
from decimal import ROUND_HALF_EVEN, Decimal
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from daftar.functions import text as T
from daftar.functions.similarity import letters, letters_bound, ratios, sequence_score
from daftar.operators import components, graph, ingest, links, resolve, scores
from daftar.plans import registry


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("f", "value", "result"),
    [
        (T.normalize_text, "  Café & Sons—No.7/b ", "cafe and sons no.7/b"),
        (T.normalize_text, None, ""),
        (T.normalize_text, "سارہ", "sarh"),
        (T.normalize_text, "ＡＢ", "ab"),
        (T.normalize_name, "Ch. Malik Asif", "malik asif"),
        (T.normalize_name, "malik asif", "asif"),
        (T.normalize_name, "Dr. Mohd. -Ali/", "muhammad ali"),
        (T.normalize_address, "House 5, Street 2 Phase 6", "h 5 st 2 ph 6"),
        (T.normalize_phone, "+92 300 1234567", "03001234567"),
        (T.normalize_phone, "00923001234567", "23001234567"),
        (T.normalize_phone, "12", "12"),
        (T.normalize_phone, None, ""),
        (T.clean_number, "Rs. 85000", 0.85),
        (T.clean_number, "-5000", 5000.0),
        (T.clean_number, "1.2.3", 0.0),
        (T.clean_number, None, 0.0),
        (T.phonetic_code, "qasim", "ksm"),
        (T.phonetic_code, "xx", "ksks"),
        (T.address_block, "h 5 st 22 gulberg block lahore", "5 22 gulberg block"),
        (T.city_hint, "h 5 lahore cantt", "lahore"),
        (T.city_hint, "h 5 sialkot", "sialkot"),
        (T.city_hint, "", ""),
        (T.mask_phone, "03001234567", "***4567"),
    ],
)
def test_text(spark, f, value, result):
    assert one(spark, f, value) == result


def test_tokens(spark):
    row = spark.createDataFrame([("m ahmad khan",)], "x string").select(T.name_tokens(F.col("x")).alias("t")).select(T.alias_tokens(F.col("t")), T.initials(F.col("t")), T.surname(F.col("t")), T.first_initial(F.col("t"))).first()
    assert (set(row[0]), *row[1:]) == ({"m", "muhammad", "ahmad", "ahmed", "khan"}, "mak", "khan", "m")


def test_rounding_like_python(spark):
    values = [random.Random(3).uniform(0, 100) for _ in range(500)] + [0.25, 0.35, 44.95, 44.96, 2.5]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(T.round_half_even(F.col("x"), 1)).collect()
    assert [r[0] for r in got] == [round(v, 1) for v in values]


def test_cosine_of_ngrams(spark):
    def hand(a, b):
        x, y = (Counter(f"  {s}  "[i : i + 3] for i in range(len(s) + 2)) for s in (a, b))
        return sum(c * y[g] for g, c in x.items()) / math.sqrt(sum(c * c for c in x.values()) * sum(c * c for c in y.values()))

    pairs = [("ahmed khan", "ahmad khan"), ("aaa aaa", "aaa"), ("x", "y")]
    df = spark.createDataFrame([*pairs, ("", "a")], "a string, b string")
    got = df.select(T.cosine_of_counts(T.counts(T.char_ngrams(F.col("a"))), T.counts(T.char_ngrams(F.col("b"))))).collect()
    assert [r[0] for r in got] == pytest.approx([*[hand(*p) for p in pairs], 0.0])


def test_sequence_score(spark):
    df = spark.createDataFrame([("abcd", "bcde"), ("", "x"), ("same", "same")], "a string, b string")
    assert [r[0] for r in df.select(sequence_score(F.col("a"), F.col("b"))).collect()] == [0.75, 0.0, 1.0]


def test_kinds_and_mapping():
    assert ingest.detect_kind(["owner_name", "engine"], "x") == "vehicle"
    assert ingest.detect_kind(["vehicle", "tax"], "x") == "tax"
    assert ingest.detect_kind(["a"], "b") == "generic"
    assert ingest.auto_mapping(["full_name", "reported_address", "account"])["engine_capacity_cc"] == "account"
    kind, mapping = ingest.settle(["citizen", "addr", "engine", "asset"], "x", {"_kind": "vehicle", "person_name": "citizen", "address": "", "engine_capacity_cc": "engine"})
    assert (kind, mapping["person_name"], mapping["engine_capacity_cc"], mapping.get("address")) == ("vehicle", "citizen", "engine", "addr")


def test_canonical_record(spark):
    df = spark.createDataFrame([(1, "M. Ahmed", "50,000", None, 7)], "source_row_id int, full_name string, declared_income string, filer_status string, extra int")
    row = ingest.canonicalize(df, "tax.csv", "source_row_id").first()
    assert (row["record_id"], row["record_type"], row["person_name"], row["declared_income"], row["filer_status"], row["property_value"]) == ("tax.csv:1", "tax", "M. Ahmed", 50000.0, "None", None)


def test_profile(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "a", " "), (3, "b", "x"), (4, "c", ""), (5, "d", None)], "_row int, full_name string, phone string")
    got = {r["column"]: r for r in ingest.profile(df, "tax", "_row").collect()}
    assert (got["full_name"]["samples"], got["phone"]["missing"], got["phone"]["missing_ratio"], got["phone"]["field"]) == ("b | a | c", 4, 0.8, "phone")
    empty = ingest.profile(df.limit(0), "tax", "_row").collect()
    assert {r["rows"] for r in empty} == {0}


def hand_components(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def graphs():
    rng = random.Random(5)
    name = lambda i: f"n{i:04d}"
    chain = [(name(i), name(i + 1)) for i in range(100, 220)]
    star = [(name(300), name(i)) for i in range(301, 380)]
    noise = [(name(rng.randint(400, 600)), name(rng.randint(400, 600))) for _ in range(150)]
    return [name(i) for i in range(700)], [*chain, *star, *noise, (name(5), name(5)), (None, name(6)), (name(7), name(8)), (name(8), name(7))]


def test_components(spark):
    nodes, pairs = graphs()
    n, p = spark.createDataFrame([(x,) for x in nodes], "id string"), spark.createDataFrame(pairs, "a string, b string")
    got = {r["id"]: r["component"] for r in components.components(n, p, "id", "a", "b").collect()}
    assert got == hand_components(nodes, pairs)
    assert {r["component"] for r in components.components(n, p.limit(0), "id", "a", "b").collect()} == set(nodes)


@pytest.fixture(scope="module")
def prints(spark):
    rows = [
        ("a:1", "Ali Raza", "House 5 Street 2 Lahore", "03001234567"), ("b:1", "A. Raza", "H 5 St 2 Lahore", None), ("b:2", "Ali Raza Sheikh", "House 9 Karachi", "0300-1234567"),
        ("c:1", "Kamran Butt", "House 5 Street 2 Lahore", None), ("c:2", None, "x", None), ("c:3", "Muhammad Ali", "", None), ("c:4", "M Ali", "Multan", None), ("c:5", "Kamran Butt", "Flat 5 Quetta", ""),
    ]
    df = spark.createDataFrame(rows, "record_id string, person_name string, address string, phone string").withColumns({"source_dataset": F.lit("d"), "source_kind": F.lit("tax")})
    return resolve.fingerprints(df).cache()


def test_blocking_equals_the_theta_join(prints):
    pairs = {tuple(r) for r in resolve.candidate_pairs(prints).collect()}
    assert pairs == {tuple(r) for r in resolve.should_compare(prints).collect()} and pairs
    stats = resolve.runtime_stats(prints, resolve.candidate_pairs(prints)).first()
    assert (stats["records"], stats["all_pairs"], stats["candidate_pairs"]) == (7, 21, len(pairs))


@pytest.mark.parametrize("piece", [3, 2048])
def test_pairs_of_rows_are_given_once_and_counted(spark, monkeypatch, piece):
    """Against all pairs of rows, with repeated, null and missing values, and blocks in several pieces."""
    monkeypatch.setattr(resolve, "PIECE", piece)
    rng = random.Random(7)
    pick = lambda *v: rng.choice(v)
    rows = [(pick(None, *[f"r:{i}" for i in range(60)]), pick("ali khan", "amir khan", "bilal khan", "ali butt", "bilal", "", "a|b khan"), pick("", None, "1", "2", "3"), pick("lahore", "multan", "", None, "lahore|a"), pick("", "5 gulberg", "6 gulberg", None)) for _ in range(90)]
    prints = spark.createDataFrame(rows, "record_id string, norm_name string, phone string, city string, block_key string")
    hand = Counter(map(tuple, resolve.should_compare(prints.fillna("", ["phone", "city", "block_key"])).collect()))
    assert max(hand.values()) > 1
    assert Counter(map(tuple, resolve.candidate_pairs(prints).collect())) == hand
    counted = resolve.runtime_stats(prints).first()
    assert (counted["records"], counted["candidate_pairs"]) == (90, sum(hand.values()))
    assert resolve.runtime_stats(prints.limit(0)).first()["candidate_pairs"] == 0 and resolve.candidate_pairs(prints.limit(0)).count() == 0


def test_scores_and_entities(prints):
    scored = resolve.compare(prints, resolve.candidate_pairs(prints)).cache()
    got = {(r["left_id"], r["right_id"]): r for r in scored.collect()}
    assert got["a:1", "b:1"]["decision"] == "match" and got["a:1", "b:1"]["confidence"] <= 100
    assert ("a:1", "c:1") not in got or got["a:1", "c:1"]["decision"] != "match"
    found = resolve.entities(prints, resolve.clusters(prints, scored)).collect()
    assert sum(r["size"] for r in found) == 7 and {"a:1", "b:1"} <= set(next(r for r in found if "a:1" in r["record_ids"])["record_ids"])
    assert sorted(r["entity_id"] for r in found) == [f"ENT-{i:04d}" for i in range(1, len(found) + 1)]
    assert next(r for r in found if r["entity_id"] == "ENT-0001")["size"] == max(r["size"] for r in found)


def test_matches_are_those_of_all_comparisons(spark, monkeypatch):
    """Pruned by bounds and compared by distinct texts, the matches are those of every pair compared in full; no pair is
    compared one by one."""
    more = "/root/testdata/sf0.01"
    of = registry._prints(spark, more)
    scored = resolve.compare(of, resolve.candidate_pairs(of), rejects=True).filter("decision = 'match'")
    full = {(r["left_id"], r["right_id"]) for r in scored.collect()}
    monkeypatch.setattr(resolve, "compare", None)
    assert Counter(map(tuple, resolve.matches(of).select("left_id", "right_id").collect())) == Counter(full) and len(full) > 5
    assert registry.queries()["entities"](spark, more).count() == len(set(hand_components([r["record_id"] for r in of.select("record_id").collect()], full).values()))


def test_rounding_is_of_the_exact_value(spark):
    rng = random.Random(4)
    values = [0.0, 0.05, 0.15, 0.25, -0.25, 57.95, 71.95, 100.0, 99.95, 1e12 + 0.05, *[rng.uniform(-5, 100) for _ in range(500)], *[k / 20 for k in range(2000)], *[math.nextafter(k / 20, 0) for k in range(1, 200)]]
    hand = [float(Decimal(v).quantize(Decimal("0.1"), ROUND_HALF_EVEN)) for v in values]
    df = spark.createDataFrame(list(zip(range(len(values)), values)), "i long, x double")
    assert [r[1] for r in df.select("i", T.round_half_even(F.col("x"), 1)).orderBy("i").collect()] == hand


def test_ratios_are_those_of_sequence_matcher():
    rng = random.Random(3)
    texts = ["", "é-ü", *["".join(rng.choice("aab c5") for _ in range(rng.choice((1, 5, 17, 62, 63, 64, 90, 230)))) for _ in range(70)]]
    left, right = np.divmod(np.arange(len(texts) ** 2), len(texts))
    hand = [SequenceMatcher(None, texts[a], texts[b]).ratio() if texts[a] and texts[b] else 0.0 for a, b in zip(left, right)]
    assert ratios(texts, left, right, 500).tolist() == hand


@pytest.mark.parametrize("piece", [7, 2048])
def test_pair_scores_are_those_of_single_comparisons(spark, monkeypatch, piece):
    """Scored as arrays within their blocks, all pairs have what comparing each of them gives; no pair is joined to texts."""
    more = "/root/testdata/sf0.001" if piece == 7 else "/root/testdata/sf0.01"
    of = registry._prints(spark, more)
    same = ["left_id", "right_id", "confidence", "decision", "name_score", "address_score", "same_phone", "same_city", "same_surname", "same_first", "initials_ok"]
    hand = Counter(map(tuple, resolve.compare(of, resolve.candidate_pairs(of), rejects=True).select(same).collect()))
    monkeypatch.setattr(resolve, "compare", None)
    monkeypatch.setattr(resolve, "PIECE", piece)
    monkeypatch.setattr(scores, "AT_ONCE", 1000)
    assert Counter(map(tuple, scores.scores(of).select(same).collect())) == hand and len(hand) > 50
    assert registry.queries()["pair_scores"](spark, more).count() == sum(hand.values()) and scores.scores(of.limit(0)).count() == 0


def test_pairs_of_repeated_ids_are_scored_once(spark, monkeypatch):
    monkeypatch.setattr(resolve, "PIECE", 3)
    rng = random.Random(9)
    rows = [(rng.choice([None, *[f"r:{i}" for i in range(30)]]), rng.choice(("ali khan", "amir khan", "ali butt", "", None)), rng.choice(("", None, "1", "2")), rng.choice(("lahore", "", None)), "", rng.choice(("h 5 st 2", None))) for _ in range(60)]
    prints = spark.createDataFrame(rows, "record_id string, norm_name string, phone string, city string, block_key string, norm_address string")
    assert Counter(map(tuple, scores.scores(prints).select("left_id", "right_id").collect())) == Counter(map(tuple, resolve.candidate_pairs(prints).collect()))


def test_letters_bound_the_score(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("aaaab c5é-ü") for _ in range(rng.randint(0, 14))) for _ in range(60)]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string").repartition(4)
    a, b = F.col("a"), F.col("b")
    got = df.select(letters_bound(letters(a), letters(b), F.length(a), F.length(b)).alias("bound"), sequence_score(a, b).alias("score")).collect()
    assert all(r["score"] <= r["bound"] <= 1 for r in got) and any(r["score"] == r["bound"] > 0 for r in got)


def test_pruning_keeps_decisions(prints):
    pairs = resolve.candidate_pairs(prints)
    scored = resolve.compare(prints, pairs).filter("decision <> 'reject'").select("left_id", "right_id").collect()
    loose = resolve.compare(prints, pairs, exact=False).filter("decision <> 'reject'").select("left_id", "right_id").collect()
    assert set(map(tuple, loose)) <= set(map(tuple, scored))


def test_quality_against_all_pairs(spark):
    rng = random.Random(1)
    rows = [(str(i), rng.choice("abc"), rng.choice("xyz")) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, truth string, entity string")
    got = resolve.evaluate_pairwise(df).first()
    pairs = [(a[1] == b[1], a[2] == b[2]) for i, a in enumerate(rows) for b in rows[i + 1 :]]
    assert [got["tp"], got["fp"], got["fn"], got["tn"]] == [pairs.count(x) for x in ((True, True), (False, True), (True, False), (False, False))]
    assert resolve.wrong_pairs(df, "k", "truth", "entity", True).count() == 10
    assert resolve.evaluate_pairwise(df.limit(0)).first()["tp"] == 0


def test_graph(spark):
    rows = [("t:1", "tax", "Ali Raza", "House 5 Lahore", "03001234567", "E1"), ("v:1", "vehicle", "Kamran Butt", "House 5 Lahore", None, "E2"), ("p:1", "property", "Ali Raza", "", None, "E1")]
    df = spark.createDataFrame(rows, "record_id string, record_type string, person_name string, address string, phone string, entity_id string").withColumns(
        {"vehicle_make_model": F.lit("Suzuki Alto"), "property_type": F.lit(""), "vehicle_reg_no": F.lit("LE-1"), "meter_ref_no": F.lit(None).cast("string"), "registry_no": F.lit(""), "filer_status": F.lit("Filer"), "declared_income": F.lit(5.0), "tax_paid": F.lit(1.0), "property_value": F.when(F.col("record_type") == "property", 100.0), "monthly_bill": F.lit(None).cast("double"), "engine_capacity_cc": F.lit(None).cast("double")}
    )
    of = graph.owned(df.drop("entity_id"), df.select("record_id", "entity_id"))
    links = graph.associations(of).collect()
    assert {(r["source"], r["target"], r["relation"]) for r in links} == {("E1", "E2", "SAME_ADDRESS_AS"), ("E2", "E1", "SAME_ADDRESS_AS")}
    edges = graph.edges(of)
    assert Counter(r["relation"] for r in edges.collect()) == {"USES_ADDRESS": 2, "USES_PHONE": 1, "FILED_IN": 1, "OWNS_VEHICLE": 1, "BOUGHT_PROPERTY": 1}
    nodes = graph.nodes(of, spark.createDataFrame([("E1", "Ali Raza"), ("E2", "Kamran Butt")], "entity_id string, canonical_name string"))
    assert {(r["node_type"], r["label"]) for r in nodes.filter("node_type in ('TaxReturn', 'Vehicle', 'Property')").collect()} == {("TaxReturn", "Return Filer"), ("Vehicle", "Suzuki Alto"), ("Property", "Property")}
    summary = graph.graph_summary(nodes, edges).first()
    assert (summary["nodes"], summary["persons"], summary["assets"], summary["edges"]) == (7, 2, 2, 6)
    exposure = graph.neighbour_exposure(graph.associations(of), graph.entity_aggregate(of), "property_value").collect()
    assert [(r["entity_id"], r["exposure"], r["links"]) for r in exposure] == [("E2", 75.0, 1)]
    assert graph.ego(edges, "E2").count() == 2


def test_folding_is_by_rule():
    a, b = T.single_folds()
    assert len(a) == len(b) and all(unicodedata.normalize("NFKD", x)[0] == y for x, y in zip(a, b) if not unicodedata.combining(unicodedata.normalize("NFKD", x)[0]))


def test_all_shared_values_associate(spark, small):
    rows = registry._owned(spark, small).select("entity_id", "norm_address", "norm_phone", "property_value").collect()
    worth, links = Counter(), Counter()
    for r in rows:
        worth[r["entity_id"]] += r["property_value"] or 0
    for column, relation in (("norm_address", "SAME_ADDRESS_AS"), ("norm_phone", "SHARES_PHONE_WITH")):
        shared = {(r[column], r["entity_id"]) for r in rows if r[column]}
        links.update((a, b, relation, v) for v, a in shared for w, b in shared if v == w and a != b)
    known = registry.queries()
    assert Counter((r["source"], r["target"], r["relation"], r["shared_value"]) for r in known["associations_all"](spark, small).collect()) == links
    assert any(x[2] == "SAME_ADDRESS_AS" and not any(c.isdigit() for c in x[3]) for x in links)
    counted = Counter(a for a, b, _, _ in links if worth[b] > 0)
    assert {r["entity_id"]: r["links"] for r in known["neighbour_exposure_all"](spark, small).collect()} == counted


def test_rejects_are_scored_in_full(spark, monkeypatch):
    rows = [(i, n, "House 5 Street 2 Lahore", None, "d", "tax") for i, n in (("x:1", "Bo"), ("x:2", "Kamran Inshulkumar Gulkhanzada"))]
    prints = resolve.fingerprints(spark.createDataFrame(rows, "record_id string, person_name string, address string, phone string, source_dataset string, source_kind string"))
    monkeypatch.setattr(registry, "_prints", lambda *_: prints)
    monkeypatch.setattr(resolve, "candidate_pairs", lambda _: spark.createDataFrame([("x:1", "x:2")], "left_id string, right_id string"))
    (got,) = registry.queries()["pair_scores"](spark, "").collect()
    assert (got["decision"], got["address_score"]) == ("reject", 1.0) and "addresses agree" in got["reasons"]


def test_gathered_pairs_are_connected_as_by_stars(spark, monkeypatch):
    """Partitions connect their own pairs; the rounds get only what several partitions have in common."""
    rng = random.Random(5)
    pairs = [(c * 1000 + i, c * 1000 + rng.randrange(i), c) for c in range(40) for i in range(1, 60)]
    pairs += [(-(i + 1), -i, i % 7) for i in range(1, 90)] + [(5, 5, 0), (None, 7, 1), (2003, 7004, 3), (2003, 7004, 8)]
    df = spark.createDataFrame(pairs, "a long, b long, c int")
    right = {(r["u"], r["v"]) for r in components.stars(components.undirected(df, "a", "b")).collect()}
    seen, stars = [], components.stars
    monkeypatch.setattr(components, "stars", lambda edges: seen.append(edges.count()) or stars(edges))
    got = [(r["u"], r["v"]) for r in components.gathered(df, "a", "b", "c").collect()]
    assert len(got) == len(set(got)) and set(got) == right and seen[0] < 120
    monkeypatch.setattr(components, "PIECE", 1)
    assert {(r["u"], r["v"]) for r in components.gathered(df, "a", "b", "c").collect()} == right
    assert components.gathered(df.limit(0), "a", "b", "c").count() == 0


def test_entities_are_linked_without_their_pairs(spark, monkeypatch):
    """What is connected is what all matches connect, with blocks in pieces, common phones, repeated and missing ids, names
    without words and in turned order; no pair of candidates is made or written."""
    rng = random.Random(8)
    names = ["ali khan", "amir khan", "khan ali", "alya khan", "m ali raza", "muhammad ali raza", "raza ali muhammad", "sara sara", "ali", "mr", "", None]
    places = ["h 12 canal rd lahore", "h 13 canal rd lahore", "h 12 canal view rd", "flt 9 st 2 multan", "flt 9 st 2 col multan", "x" * 70 + " 5", "x" * 70 + " 6", "", None]
    ids = [None, *[f"r:{i}" for i in range(230)]]
    rows = [(rng.choice(ids), rng.choice(names), *rng.choices(("", None, "1", "2", "3", f"9{i}"), (4, 2, 1, 1, 1, 9)), rng.choice(("lahore", "multan", "", None)), rng.choice(("12 canal", "", None)), rng.choice(places)) for i in range(260)]
    prints = spark.createDataFrame(rows, "record_id string, norm_name string, phone string, city string, block_key string, norm_address string").cache()
    pairs = [(r["left_id"], r["right_id"]) for r in resolve.matches(prints).collect()]
    nodes = sorted({r[0] for r in rows if r[0]})
    hand = hand_components(nodes, pairs)
    monkeypatch.setattr(resolve, "candidates", None)
    got = {r["record_id"]: r["component"] for r in links.clusters(prints).collect()}
    assert sorted(got) == nodes and len({(got[n], hand[n]) for n in nodes}) == len(set(got.values())) == len(set(hand.values())) > 20
    first = {c: min(n for n in nodes if got[n] == c) for c in got.values()}
    assert sorted(first, key=first.get) == sorted(first)
    assert registry.queries()["entities"](spark, "/root/testdata/sf0.001").count() > 20
    assert links.clusters(prints.limit(0)).count() == 0


def test_least_address_is_where_a_match_begins(spark):
    rng = random.Random(5)
    rows = [(n, c, p, s) for n in [0.3, 0.415, 0.72, 0.88, 1.0, *[rng.random() for _ in range(40)]] for c in (True, False) for p in (True, False) for s in (True, False)]
    for name, close, city, phone in rows:
        least = links.least_address(name, close, city, phone)
        assert least == 2.0 or links._score(name, least, close, city, phone) >= links.MATCH
        assert least == 0.0 or links._score(name, min(1.0, math.nextafter(least, 0)), close, city, phone) < links.MATCH
    cells = [(*r, a) for r in rows for a in [0.0, 0.7, 0.82, 0.86, 0.9, 1.0, rng.random()]]
    df = spark.createDataFrame(cells, "name double, close boolean, city boolean, phone boolean, address double")
    flags = {"phone": F.col("phone"), "city": F.col("city"), "surname": F.col("close"), "first": F.col("close"), "initials": F.col("close")}
    score = resolve._score(F.col("name"), F.col("address"), flags)
    for r in df.select("*", score.alias("score"), (T.round_half_even(score, 1) >= 72).alias("match")).collect():
        assert r["score"] == links._score(r["name"], r["address"], r["close"], r["city"], r["phone"])
        assert r["match"] == (r["address"] >= links.least_address(r["name"], r["close"], r["city"], r["phone"]))


def test_pieces_and_more_addresses_than_are_kept_give_the_same(monkeypatch):
    rng = random.Random(6)
    rows = [(2, "12 canal", "", i, i, n, n, f"h {rng.randint(1, 40)} {rng.choice(('canal', 'mall', 'kanal'))} rd", rng.choice(("lahore", ""))) for i, n in enumerate(rng.choices(["ali khan", "alya khan", "khan ali", "amir khan", "ali kahn"], k=150))]
    names = ["k", "x", "y", "number", "label", "norm_name", "words", "norm_address", "city"]
    table = pa.table({n: list(c) for n, c in zip(names, zip(*rows))})
    family = table.filter(pc.equal(table["norm_name"], "ali khan"))

    def found():
        for x in (links._PLACES, links._APART):
            x.__init__()
        met = links.connected(*[np.concatenate(c) for c in zip(*links._met(table))])
        return [c.tolist() for c in (*met, *links._family(family, family["number"].combine_chunks().to_numpy()))]

    whole = found()
    monkeypatch.setattr(links, "AT_ONCE", 97)
    monkeypatch.setattr(links, "PIECE", 10)
    monkeypatch.setattr(links, "KEPT", 20)
    assert found() == whole and len(whole[0]) > 50 and len(whole[2]) > 10
