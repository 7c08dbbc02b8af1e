"""Matching entities across sources without keys: who owns the records of several tables.

Method: collective graph linkage. Records and the attributes that they share (a phone, a place, a name
in canonical words) form a graph. An attribute is looked at together with the name, so a household's
address or a fleet's phone is split by who is named there. Each link has the weight of its rarity: the
chance that two owners share it, from how many owners a surname has and how frequent its given names are.
Meta-blocking drops the links whose weight is too small (frequent names alone). Similarity spreads to
neighbours until stable: a name in initials, or with a given name left out, takes the full name that it
alone can stand for among the names met at its phone, its place, or in its family, and what it took
counts for its neighbours in the next round. Owners are the components of what is left.

An attribute is linked as a star to its smallest record, never as all pairs: a phone that a third of the
records share costs as many links as records. Names met at an attribute are distinct, so their lists are
bounded by the names that exist, not by rows. Only the answer, the pairs of an owner's records, is as long
as it has to be.

Records, attributes and texts are compared by 64-bit hashes, which keeps what moves small; two of a billion
different ones agree by accident with a chance of some percent.

Defined results: names that stand for nobody belong to no owner; unusable phones and places link nothing;
repeated rows are records like others; extra columns don't matter; nulls link nothing.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm.names import compose, familiar, read_name, sounds_of, vocabulary
from daftar.llm.places import NOWHERE, joined_places, placed_rows, read_address, rowwise, shipped, spellings
from daftar.operators.components import gathered
from daftar.runtime import cut, small, spread

#: Expected owners beyond the one meant, up to which a name alone says who it is.
CHANCE = 0.25
#: Given names that a population is taken to have beyond those in the data, so that few rows don't look crowded.
UNSEEN = 100
#: What is read of a name that stands for nobody.
NOBODY = (None,) * 5
#: Phones up to which a surname is one family, whose short names may be told apart without a phone or place.
FAMILY = 3
#: Columns of the four tables.
CIVIC = {
    "fbr_tax_records_complex": ("full_name", "reported_address", "phone_number"),
    "excise_vehicles_complex": ("owner_name", "owner_address", "owner_phone"),
    "disco_consumption_complex": ("consumer_name", "installation_address", "phone_number"),
    "property_transfers_complex": ("buyer_name", "property_address", "buyer_phone"),
}


def records_of(tables: dict[str, DataFrame], columns: dict = CIVIC) -> DataFrame:
    """record_id, source, name, address, phone of all rows of the tables."""
    parts = [t.select("record_id", F.lit(s).alias("source"), F.col(columns[s][0]).alias("name"), F.col(columns[s][1]).alias("address"), F.col(columns[s][2]).alias("phone")) for s, t in tables.items()]
    return reduce(DataFrame.unionAll, parts)


def phone_digits(cell):
    """Digits of a number without the prefix of its country or network."""
    return F.regexp_replace(F.regexp_replace(cell, "[^0-9]+", ""), "^(?:0092|92|0)(?=3[0-9]{9}$)", "")


def usable_phone(digits):
    """Ten digits of a mobile number; null for what is none."""
    return F.when(digits.rlike("^3[0-9]{9}$") & ~digits.rlike(r"^3(\d)\1{8}$"), digits)


def shorter(full):
    """All shorter forms of a full one (``a+b|``), as a column: each given name stays, leaves its first letter, or
    is left out, but not all of them may stay or be left out."""
    start = F.array(F.struct(F.array().cast("array<string>").alias("g"), F.array().cast("array<string>").alias("i")))
    names = F.split(F.substring_index(full, "|", 1), r"\+")

    def longer(forms, name):
        stay = F.transform(forms, lambda x: F.struct(F.array_append(x["g"], name).alias("g"), x["i"].alias("i")))
        letter = F.transform(forms, lambda x: F.struct(x["g"].alias("g"), F.array_append(x["i"], heard(F.substring(name, 1, 1))).alias("i")))
        return F.concat(stay, letter, forms)

    forms = F.aggregate(names, start, longer)
    texts = F.transform(forms, lambda x: F.concat(F.array_join(F.array_sort(x["g"]), "+"), F.lit("|"), F.array_join(F.array_sort(x["i"]), "+")))
    texts = F.when(full.startswith("#"), F.array_append(texts, F.lit("#org|"))).otherwise(texts)
    return F.array_distinct(F.filter(texts, lambda t: (t != "|") & (t != full)))


def heard(letter):
    """An initial by its sound, as ``compose`` writes it."""
    return F.translate(letter, "qwceoy", "kvkiui")


def described(records: DataFrame, short_names: DataFrame) -> DataFrame:
    """record_id, source, text (hash of the name), phone, kind, place, surname, form of the records that
    name somebody. Names and addresses are read in one pass; their words are looked up in vocabularies that
    are shipped where they are small and joined where they aren't."""
    short = familiar(short_names)
    pairs = tuple(short.items())

    def read(names, addresses):
        table = sounds_of(pairs)
        rows = [(k[0], " ".join(k[1]), *(read_address(a) or NOWHERE)) if (k := read_name(n, table)) else NOBODY for n, a in zip(names, addresses)]
        return list(zip(*rows)) or [()] * 5

    read = rowwise(read, "kind", "names", "numbers", "words", "apart")
    # Digits are a column of their own, so that they are made once a row.
    base = spread(records.select("record_id", "source", "name", "address", phone_digits(F.col("phone")).alias("digits")))
    read_rows = base.select("record_id", "source", F.xxhash64("name").alias("text"), usable_phone(F.col("digits")).cast("bigint").alias("phone"), read("name", "address").alias("r"))
    rows = cut(read_rows.select("record_id", "source", "text", "phone", "r.*").filter("kind is not null"))
    roots = spellings(rows)
    known = cut(vocabulary(rows, short))
    words, spelt = shipped(known, "word", "root", "given", "n"), shipped(roots, "word", "root", "implied")
    if words is None or spelt is None:
        out = joined_places(joined_forms(rows, known), roots)
        return out.withColumn("place", F.when(F.col("at").isNotNull(), F.xxhash64("at", "naming"))).drop("at", "naming")
    sent = rows.sparkSession.sparkContext.broadcast((words, spelt))

    def look_up(kinds, names, numbers, naming, apart):
        by_word, by_place = sent.value
        met: dict = {}
        forms = []
        for k, name in zip(kinds, names):
            form = met.get((k, name))
            if form is None:
                form = met[k, name] = compose(k, [by_word.get(y) or (y, False, 0) for y in name.split(" ")])
            forms.append(form)
        return [*(zip(*placed_rows(numbers, naming, apart, by_place)) if forms else ((), ())), *(zip(*forms) if forms else ((), ()))]

    look_up = rowwise(look_up, "at", "naming", "surname", "form")
    found = rows.withColumn("l", look_up("kind", "names", "numbers", "words", "apart")).select("record_id", "source", "text", "phone", "kind", "l.*")
    return found.withColumn("place", F.when(F.col("at").isNotNull(), F.xxhash64("at", "naming"))).drop("at", "naming")


def joined_forms(rows: DataFrame, known: DataFrame) -> DataFrame:
    """surname and form of each row by joining its words; for vocabularies too large to ship."""

    @F.pandas_udf("surname string, form string")
    def composed(kinds: pd.Series, words: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([compose(k, [(w["root"], bool(w["given"]), int(w["n"])) for w in ws]) for k, ws in zip(kinds, words)], columns=["surname", "form"], dtype=object)

    # By the words and not by the record: ids may repeat or be null.
    keyed = rows.withColumn("_words", F.xxhash64("names"))
    distinct = keyed.select("_words", "names").dropDuplicates(["_words"])
    exploded = distinct.select("_words", F.posexplode(F.split("names", " ")).alias("at", "word")).join(known, "word", "left")
    listed = exploded.groupBy("_words").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("root", "word").alias("root"), F.coalesce("given", F.lit(False)).alias("given"), F.coalesce("n", F.lit(0)).alias("n")))).alias("w"))
    kept = keyed.drop("names").join(listed, "_words")
    return kept.withColumn("c", composed("kind", "w")).select(*[c for c in kept.columns if c not in ("w", "_words")], "c.*")


def _blocks():
    """Where names are met: at a phone, a place, and in a rare family; as hashes, in this order."""
    named = F.length("surname") > 2
    return F.array_compact(
        F.array(
            F.when(named & F.col("phone").isNotNull(), F.struct(F.xxhash64(F.lit("p"), "surname", "phone").alias("block"), F.lit(0).alias("k"))),
            F.when(named & F.col("place").isNotNull(), F.struct(F.xxhash64(F.lit("l"), "surname", "place").alias("block"), F.lit(1).alias("k"))),
            F.when(named & F.col("family"), F.struct(F.xxhash64(F.lit("f"), "surname").alias("block"), F.lit(2).alias("k"))),
        )
    )


FULL = r"^[^|]+\|$"


def given_names(form):
    """How many given names, or words of trade, a form has."""
    given = F.substring_index(form, "|", 1)
    return F.when(given == "", 0).otherwise(F.length(given) - F.length(F.translate(given, "+", "")) + 1)


def resolve_forms(people: DataFrame, rounds: int = 200) -> DataFrame:
    """Spread full names over short forms until nothing changes. ``people``: node, surname, form, phone, place, family.

    In each round a short form takes the full one that it alone can stand for in its block: of the full names of the
    block those count that aren't short for another one there. All is joins on (block, form), so a block of any
    size is spread over the cluster; from the second round on only blocks move that have got another full name. A
    form is replaced by one with more given names or fewer initials, so it ends. Raises if it isn't stable
    after ``rounds``."""
    at = cut(people.select("node", "form", F.explode(_blocks()).alias("x")).select("node", "form", "x.block", "x.k"))
    # A short form has fewer given names than what it stands for. Where all forms have as many, nothing can be taken, and
    # what comes in later looks the block up again.
    names = F.when(F.col("form") == "#org|", 0).otherwise(given_names(F.col("form")))
    several = cut(at.groupBy("block").agg(F.min(names).alias("a"), F.max(names).alias("b")).filter("a < b").select("block"))
    current = cut(at.join(small(several), "block", "left_semi"))
    changed = None
    for _ in range(rounds):
        met = current.select("block", "form").distinct()
        fulls = met.filter(F.col("form").rlike(FULL))
        # Worked out once for each form, however many blocks it is met in.
        shorts = cut(current.filter(F.col("form").rlike(FULL)).select(F.col("form").alias("full")).distinct().select("full", shorter(F.col("full")).alias("forms")))
        variants = fulls.withColumnRenamed("form", "full").join(small(shorts), "full").select("block", "full", F.explode("forms").alias("form"))
        fits = cut(met.select(F.xxhash64("block", "form").alias("key"), "block", "form").join(variants.select(F.xxhash64("block", "form").alias("key"), "full"), "key"))
        # A full name that is short for another one of its block stands back.
        inner = fits.filter(F.col("form").rlike(FULL)).select("block", F.col("form").alias("full"))
        top = fits.join(inner, ["block", "full"], "left_anti").groupBy("block", "form").agg(F.min("full").alias("full"), F.count("*").alias("n")).filter("n = 1")
        took = current.join(small(cut(top.select("block", "form", "full"))), ["block", "form"]).groupBy("node").agg(F.min_by("full", F.struct("k", "full")).alias("took"))
        took = cut(took)
        if took.isEmpty():
            break
        changed = took if changed is None else cut(changed.join(took, "node", "left_anti").unionByName(took), instead_of=changed)
        # What comes next: every member, in its present form, of the blocks that have got a full name they lacked.
        got = cut(at.join(small(took), "node").select("block", F.col("took").alias("form")).distinct())
        met = cut(current.join(small(got), ["block", "form"], "left_semi").select("block", "form").distinct())
        touched = cut(got.join(small(met), ["block", "form"], "left_anti").select("block").distinct())
        current = cut(at.join(small(touched), "block", "left_semi").join(small(changed), "node", "left").withColumn("form", F.coalesce("took", "form")).drop("took"))
    else:
        raise RuntimeError(f"forms of names aren't stable after {rounds} rounds")
    if changed is None:
        return people
    return people.join(small(changed), "node", "left").withColumn("form", F.coalesce("took", "form")).drop("took")


def surname_owners(people: DataFrame) -> DataFrame:
    """(surname, kind, owners): how many distinct phones the people of a surname have, and how many trades the
    organisations of one name, counted exactly in two combined groupings."""
    by = F.when(F.col("kind") == "person", F.col("phone")).otherwise(F.xxhash64("form"))
    return people.select("surname", "kind", by.alias("by")).distinct().groupBy("surname", "kind").agg(F.count("by").alias("owners"))


def crowd(people: DataFrame, attribute: str) -> DataFrame:
    """(attribute, at_...): how many different names are met at a phone or place, where there is more than one."""
    met = people.filter(F.col(attribute).isNotNull()).select(attribute, F.xxhash64("surname", "form").alias("name")).distinct()
    return cut(met.groupBy(attribute).agg(F.count("*").alias(f"at_{attribute}")).filter(f"at_{attribute} > 1"))


def owner_ids(records: DataFrame, short_names: DataFrame, chance: float = CHANCE) -> DataFrame:
    """record_id, source, text, owner, phone, place, named, kept of each record that has an owner.

    Records of one name, phone and place are one node. A node is linked to its name at its phone, its name at its
    place, and its name alone; the weight of a link is how many others are expected to share it by accident: those
    who are named at the phone or place, or have the surname, times the share of such names. Links above ``chance``
    are pruned."""
    rows = cut(described(records, short_names).withColumn("node", F.xxhash64("kind", "surname", "form", "phone", "place")))
    people = cut(rows.select("node", "kind", "surname", "form", "phone", "place").distinct())
    # Rarity: owners of a surname by its phones, shares of given names by families.
    phones = cut(surname_owners(people))
    people = cut(resolve_forms(cut(people.join(small(phones), ["surname", "kind"]).withColumn("family", F.col("owners") <= FAMILY))))
    forms = people.select("surname", "form").distinct()
    given = F.split(F.substring_index("form", "|", 1), r"\+")
    share = forms.select(F.explode(given).alias("w")).filter("w <> ''").groupBy("w").count()
    # Given names among people's, words of trade among organisations'.
    trade = F.col("w").startswith("#").alias("trade")
    known = share.groupBy(trade).agg((F.sum("count") + UNSEEN).alias("known"))
    weighed = forms.select("form").distinct().select("form", F.explode(given).alias("w")).join(share.withColumn("trade", trade).join(F.broadcast(known), "trade").select("w", (F.col("count") / F.col("known")).alias("p")), "w", "left")
    chances = cut(weighed.groupBy("form").agg(F.exp(F.sum(F.log(F.coalesce("p", F.lit(0.02))))).alias("p")))
    full = F.col("form").rlike(FULL) & (F.col("form") != "muhamad|")
    person = full & (F.col("kind") == "person")
    named = F.length("surname") >= 3
    weighted = people.join(small(chances), "form").join(small(crowd(people, "phone")), "phone", "left").join(small(crowd(people, "place")), "place", "left")
    others = lambda n: (F.coalesce(F.col(n), F.lit(1)) - 1) * F.col("p") <= chance
    # A given name at a phone is enough where few are named there; else the surname has to agree too.
    by_phone = F.when(person & others("at_phone"), F.xxhash64(F.lit("p"), "form", "phone")).when(named, F.xxhash64(F.lit("sp"), "surname", "form", "phone"))
    by_place = F.when(person & others("at_place"), F.xxhash64(F.lit("l"), "form", "place", F.substring("surname", 1, 1))).when(named, F.xxhash64(F.lit("sl"), "surname", "form", "place"))
    alone = (F.length("surname") >= 5) & F.col("form").rlike(FULL) & (F.greatest(F.col("owners"), F.lit(1)) * F.col("p") <= chance)
    links = F.array_compact(F.array(F.when(F.col("phone").isNotNull(), by_phone), F.when(F.col("place").isNotNull(), by_place), F.when(alone, F.xxhash64(F.lit("s"), "surname", "form"))))
    linked = cut(weighted.select("node", F.xxhash64("surname", "form").alias("named"), links.alias("links")))
    # The attributes themselves are what is connected: a node with two of them ties them together.
    ties = linked.filter(F.size("links") > 1).select("named", F.explode(F.transform(F.sequence(F.lit(2), F.size("links")), lambda i: F.struct(F.element_at("links", i - 1).alias("a"), F.element_at("links", i).alias("b")))).alias("t")).select("named", "t.*")
    labels = gathered(ties, "a", "b", "named")
    first = linked.select("node", "named", F.try_element_at("links", F.lit(1)).alias("u")).join(small(labels), "u", "left")
    owners = cut(first.select("node", "named", F.coalesce("v", "u", "node").alias("owner")))
    return rows.join(small(owners), "node").select("record_id", "source", "text", "phone", "place", "named", "owner")


def paired(owned: DataFrame, across: bool) -> DataFrame:
    """Two records ``a`` and ``b`` of one owner, of different sources (``across``) or of the same source with different
    name texts; the smaller id first."""
    a, b = owned.alias("a"), owned.alias("b")
    kind = F.col("a.source") != F.col("b.source") if across else (F.col("a.source") == F.col("b.source")) & (F.col("a.text") != F.col("b.text"))
    return a.join(b, (F.col("a.owner") == F.col("b.owner")) & kind & (F.col("a.record_id") < F.col("b.record_id")))


def owner_pairs(owned: DataFrame, across: bool) -> DataFrame:
    """(left_record_id, right_record_id, confidence) of the pairs."""
    # Chances that each agreement is an accident, taken as independent.
    doubt = (
        F.when(F.col("a.phone") == F.col("b.phone"), 0.05).otherwise(1.0) * F.when(F.col("a.place") == F.col("b.place"), 0.1).otherwise(1.0)
        * F.when(F.col("a.named") == F.col("b.named"), 0.2).otherwise(0.6)
    )
    return paired(owned, across).select(F.col("a.record_id").alias("left_record_id"), F.col("b.record_id").alias("right_record_id"), F.round(1 - F.coalesce(doubt, F.lit(0.6)), 3).alias("confidence"))
