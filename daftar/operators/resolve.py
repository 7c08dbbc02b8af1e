"""Entity resolution of canonical records: fingerprints, blocking, pair comparison, clusters, evaluation.

Blocking is one equi self-join on exploded keys, its large blocks in pieces; the theta condition that it stands
for is never evaluated over all pairs, and candidates are counted without being built. What a pair needs of each record is computed once per record. The costly character
comparison runs only for pairs that an upper bound leaves a chance of being more than rejects.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daftar.functions import text as T
from daftar.functions.similarity import letters, letters_bound, name_profile, sequence_bound, sequence_score
from daftar.operators.components import components
from daftar.runtime import cut, small, spread, width


def fingerprints(records: DataFrame) -> DataFrame:
    """One row per record with a name: normalized name, address, phone, block key, city."""
    named = records.filter(F.coalesce("person_name", F.lit("")) != "")
    base = named.select("record_id", "source_dataset", "source_kind", "person_name", F.coalesce("address", F.lit("")).alias("address"), F.col("phone"))
    normal = base.withColumns({"norm_name": T.normalize_name(F.col("person_name")), "norm_address": T.normalize_address(F.col("address")), "phone": T.normalize_phone(F.col("phone"))})
    return normal.withColumns({"block_key": T.address_block(F.col("norm_address")), "city": T.city_hint(F.col("norm_address"))})


def blocking_keys(tokens: Column) -> Column:
    """Up to five keys of a fingerprint, each only where its parts are there."""
    last, first = T.surname(tokens), T.first_initial(tokens)
    there = lambda *parts: F.lit(True) if not parts else (parts[0] != "") & there(*parts[1:])
    key = lambda name, *parts: F.when(there(*parts), F.concat_ws("|", F.lit(name), *parts))
    return F.array_compact(F.array(
        key("phone", F.col("phone")), key("city_surname", F.col("city"), last), key("address", F.col("block_key")), key("initial_surname", first, last), key("city_initial", F.col("city"), first),
    ))


#: Rows of a block that meet others at once; a larger block is dealt out in pieces of as many.
PIECE = 2048


def blocked(prints: DataFrame, *more: str) -> DataFrame:
    """record_id and what the blocking keys are made of, empty where it is missing, of the rows that have an id."""
    tokens = T.name_tokens(F.col("norm_name"))
    filled = [F.coalesce(c, F.lit("")).alias(c) for c in ("phone", "city", "block_key")]
    more = [c for c in more if c != "phone"]
    return prints.filter("record_id is not null").select("record_id", *filled, T.surname(tokens).alias("last"), T.first_initial(tokens).alias("first"), *more)


#: The blocking keys; a pair belongs to the first one that it shares, the largest blocks come first.
KEYS = (("city", "first"), ("first", "last"), ("city", "last"), ("block_key",), ("phone",))


def dealt(prints: DataFrame, of_a_task: int, *more: str) -> tuple[DataFrame, list[str], int]:
    """The rows of blocks of two and more (k, x, y), with their piece, the last piece and the carried columns; the names of
    these; and how many tasks to meet in."""
    spark = prints.sparkSession
    part = lambda key, i: F.col(key[i]) if i < len(key) else F.lit("")
    there = lambda key: reduce(Column.__and__, [F.col(c) != "" for c in key])
    keys = F.array_compact(F.array(*[F.when(there(key), F.struct(F.lit(k).alias("k"), part(key, 0).alias("x"), part(key, 1).alias("y"))) for k, key in enumerate(KEYS)]))
    block = Window.partitionBy("k", "x", "y")
    carried = ["record_id", "city", "block_key", "last", "first", *more]
    rows = blocked(prints, *more).select(*carried, F.explode(keys).alias("key")).select("*", "key.*").drop("key")
    # Equal ids have one rank, so they are never in two pieces.
    ranked = rows.withColumn("rank", F.rank().over(block.orderBy("record_id"))).withColumn("n", F.count("*").over(block)).filter("n > 1")
    piece = lambda c: F.floor((F.col(c) - 1) / PIECE).cast("int")
    blocks = cut(ranked.withColumns({"piece": piece("rank"), "pieces": piece("n")}).drop("rank"))
    met = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // 2
    return blocks, carried, max(width(spark), min(met // of_a_task, 10_000))


def candidate_pairs(prints: DataFrame) -> DataFrame:
    """(left_id, right_id), left smaller: every two rows that share a key, once."""
    return candidates(prints).select(F.col("l_record_id").alias("left_id"), F.col("r_record_id").alias("right_id"))


def candidates(prints: DataFrame, *more: str) -> DataFrame:
    """Every two rows that share a key, once: the columns of ``blocked`` but the phone, and ``more``, of both
    (l_..., r_...).

    A pair is given by the first key that it shares, so the pairs need not be made distinct and nothing as long as
    the result is shuffled. The rows of a block stand in pieces by order of their ids, and each two pieces meet in a
    place of their own: what moves beside the rows is a thousandth of the result, and no block is one task's."""
    blocks, carried, parts = dealt(prints, PAIRS_OF_A_TASK, *more)
    side = lambda s, i, j: blocks.select("k", "x", "y", i.alias("i"), j.alias("j"), *[F.col(c).alias(f"{s}_{c}") for c in carried]).repartition(parts, "k", "x", "y", "i", "j")
    a = side("l", F.col("piece"), F.explode(F.sequence("piece", "pieces")))
    b = side("r", F.explode(F.sequence(F.lit(0), F.col("piece"))), F.col("piece"))
    shared = lambda key: reduce(Column.__and__, [(F.col(f"l_{c}") == F.col(f"r_{c}")) & (F.col(f"l_{c}") != "") for c in key])
    first = reduce(lambda later, k: (F.col("k") == k) | (~shared(KEYS[k]) & later), range(len(KEYS) - 2, -1, -1), F.lit(True))
    return a.join(b, ["k", "x", "y", "i", "j"]).filter((F.col("l_record_id") < F.col("r_record_id")) & first)


#: Candidates that one task goes through.
PAIRS_OF_A_TASK = 20_000_000


def count_candidates(prints: DataFrame) -> DataFrame:
    """One row, ``candidate_pairs``: how many there are, from the sizes of groups; no pair is built.

    By inclusion and exclusion over the keys: of two of the three keys of city, surname and initial follows the
    third, so these together are each alone less twice all three."""
    names = [(1, ("city", "last")), (1, ("first", "last")), (1, ("city", "first")), (-2, ("city", "first", "last"))]
    alone = [(1, ("phone",)), (1, ("block_key",)), (-1, ("phone", "block_key"))]
    terms = alone + names + [(-c * d, k + m) for c, k in alone for d, m in names]
    columns = ["phone", "city", "block_key", "last", "first"]
    rows = blocked(prints).groupBy("record_id", *columns).agg(F.count("*").alias("m"))
    # A phone that one row has makes no pair; most are such.
    phones = rows.filter("phone <> ''").groupBy("phone").agg(F.sum("m").alias("n")).filter("n > 1").select(F.col("phone").alias("_shared"))
    rows = cut(rows.join(phones, F.col("phone") == F.col("_shared"), "left").withColumn("phone", F.coalesce("_shared", F.lit(""))).drop("_shared"))
    there = lambda key: reduce(Column.__and__, [F.col(c) != "" for c in key])
    of = lambda sign, key: F.when(there(key), F.struct(F.lit(sign).alias("sign"), *[(F.col(c) if c in key else F.lit(None).cast("string")).alias(c) for c in columns]))
    keyed = lambda df: df.select("record_id", "m", F.explode(F.array_compact(F.array(*[of(*t) for t in terms]))).alias("t")).select("record_id", "m", "t.*")

    def pairs(df, by):
        sizes = df.groupBy("sign", *columns, *by).agg(F.sum("m").alias("n"))
        return sizes.agg(F.coalesce(F.sum(F.expr("sign * (n * (n - 1) div 2)")), F.lit(0)).alias("pairs"))

    # Rows of one id are no pair.
    repeated = rows.groupBy("record_id").agg(F.sum("m").alias("n")).filter("n > 1").select("record_id")
    within = pairs(keyed(rows.join(repeated, "record_id", "left_semi")), ["record_id"])
    return pairs(keyed(rows), []).crossJoin(within.withColumnRenamed("pairs", "own")).select((F.col("pairs") - F.col("own")).alias("candidate_pairs"))


def should_compare(prints: DataFrame) -> DataFrame:
    """The theta-join that blocking stands for; for small tables and tests only."""
    t = T.name_tokens(F.col("norm_name"))
    p = prints.select("record_id", "phone", "city", "block_key", T.surname(t).alias("last"), T.first_initial(t).alias("first"))
    a, b = p.alias("a"), p.alias("b")
    same = lambda *cols: F.lit(True) if not cols else (F.col(f"a.{cols[0]}") == F.col(f"b.{cols[0]}")) & (F.col(f"a.{cols[0]}") != "") & same(*cols[1:])
    any_of = same("phone") | same("city", "last") | same("block_key") | same("first", "last") | same("city", "first")
    return a.join(b, (F.col("a.record_id") < F.col("b.record_id")) & any_of).select(F.col("a.record_id").alias("left_id"), F.col("b.record_id").alias("right_id"))


def _score(name: Column, address: Column, f: dict[str, Column]) -> Column:
    """Confidence from 0 to 100 before rounding; fixed weights and floors."""
    close, family = f["initials"] & f["surname"], f["first"] & f["surname"]
    name = F.when(close, F.greatest(name, F.lit(0.82))).otherwise(name)
    name = F.when(family & (address >= 0.82), F.greatest(name, F.lit(0.86))).otherwise(name)
    bonus = F.when(close, 0.08).otherwise(0.0)
    bonus = F.when(close & (address >= 0.7), bonus + 0.16).otherwise(bonus)
    bonus = F.when(family & (address >= 0.86), F.greatest(bonus, F.lit(0.18))).otherwise(bonus)
    bonus = F.when((address >= 0.9) & (name >= 0.72), F.greatest(bonus, F.lit(0.10))).otherwise(bonus)
    bonus = F.when((address >= 0.9) & (name >= 0.88) & f["city"], F.greatest(bonus, F.lit(0.14))).otherwise(bonus)
    one = lambda c, w: F.when(c, w).otherwise(0.0)
    total = 0.48 * name + 0.22 * address + one(f["phone"], 0.18) + one(f["city"], 0.04) + bonus
    total = F.when((name < 0.42) & ~close, F.least(total, F.lit(0.68))).otherwise(total)
    return 100 * T.clamp(total, 0.0, 1.0)


def compare(prints: DataFrame, pairs: DataFrame, exact: bool = True, rejects: bool = False) -> DataFrame:
    """left_id, right_id, confidence, decision and the similarities of each pair.

    Scores of pairs that a bound makes rejects are lower than they are, unless ``rejects`` asks for them in full.
    ``exact=False`` leaves the character comparison out (its term is 0), which SQL can follow."""
    described = prints.select("record_id", "norm_name", "norm_address", "phone", "city", *name_profile(F.col("norm_name")))
    side = lambda s: described.select(*[F.col(c).alias(f"{s}_{c}") for c in described.columns])
    joined = pairs.join(side("l"), F.col("left_id") == F.col("l_record_id")).join(side("r"), F.col("right_id") == F.col("r_record_id"))
    both = lambda c: (F.col(f"l_{c}") == F.col(f"r_{c}")) & (F.col(f"l_{c}") != "")
    li, ri = F.col("l_inits"), F.col("r_inits")
    features = joined.select(
        "left_id", "right_id", "l_sorted_aliases", "r_sorted_aliases", "l_norm_address", "r_norm_address",
        *_name_similarities(),
        both("phone").alias("same_phone"), both("city").alias("same_city"), both("surname").alias("same_surname"), both("first").alias("same_first"),
        ((li != "") & (ri != "") & (li.startswith(ri) | ri.startswith(li) | (both("surname") & both("first")))).alias("initials_ok"),
    )
    f = {"phone": F.col("same_phone"), "city": F.col("same_city"), "surname": F.col("same_surname"), "first": F.col("same_first"), "initials": F.col("initials_ok")}
    words, place = (F.col("l_sorted_aliases"), F.col("r_sorted_aliases")), (F.col("l_norm_address"), F.col("r_norm_address"))
    compared = {"seq": sequence_score(*words), "address_score": sequence_score(*place)}
    if exact and rejects:
        scored = features.withColumns(compared)
    elif exact:
        bound = _score(_name_score(sequence_bound(*words)), sequence_bound(*place), f)
        open_pairs = features.filter(bound >= 57.95)
        scored = open_pairs.withColumns(compared).unionByName(
            features.filter(~(bound >= 57.95)).withColumns({"seq": F.lit(0.0), "address_score": F.lit(0.0)})
        )
    else:
        scored = features.withColumns({"seq": F.lit(0.0), "address_score": F.when(both_equal(*place), 1.0).otherwise(0.0)})
    scored = scored.withColumn("name_score", _name_score(F.col("seq")))
    return decided(scored).select("left_id", "right_id", "confidence", "decision", "name_score", "address_score", "token_jaccard", "phonetic", "ngram", "same_phone", "same_city", "same_surname", "same_first", "initials_ok")


def decided(scored: DataFrame) -> DataFrame:
    """With the confidence and decision of each pair, from its two scores and what agrees."""
    f = {"phone": F.col("same_phone"), "city": F.col("same_city"), "surname": F.col("same_surname"), "first": F.col("same_first"), "initials": F.col("initials_ok")}
    out = scored.withColumn("_score", _score(F.col("name_score"), F.col("address_score"), f)).withColumn("confidence", T.round_half_even(F.col("_score"), 1)).drop("_score")
    return out.withColumn("decision", F.when(F.col("confidence") >= 72, "match").when(F.col("confidence") >= 58, "possible").otherwise("reject"))


#: Bound of a score from which a pair may be a match; matches begin at 71.95, the rest is for rounding.
OPEN = 71.9


def matches(prints: DataFrame) -> DataFrame:
    """(left_id, right_id, decision): the candidates that ``compare`` calls a match. Only what they connect is in
    ``links``, which writes no pairs.

    What can't be one is left early: by the letters that two addresses have in common, which bound their score, then by
    the exact score of the names. Names and addresses are compared once for each two distinct ones."""
    tokens = T.name_tokens(F.col("norm_name"))
    texts = prints.withColumns({"norm_name": F.coalesce("norm_name", F.lit("")), "norm_address": F.coalesce("norm_address", F.lit(""))})
    described = cut(spread(texts).withColumns({"inits": T.initials(tokens), "letters": letters(F.col("norm_address"))}))
    met = candidates(described, "phone", "norm_name", "norm_address", "inits", "letters")
    both = lambda c: both_equal(F.col(f"l_{c}"), F.col(f"r_{c}"))
    li, ri = F.col("l_inits"), F.col("r_inits")
    flags = {"same_phone": both("phone"), "same_city": both("city"), "same_surname": both("last"), "same_first": both("first")}
    flags["initials_ok"] = (li != "") & (ri != "") & (li.startswith(ri) | ri.startswith(li) | (flags["same_surname"] & flags["same_first"]))
    kinds = dict(zip(("phone", "city", "surname", "first", "initials"), flags))
    bound = letters_bound(F.col("l_letters"), F.col("r_letters"), F.length("l_norm_address"), F.length("r_norm_address"))
    # Without a common phone, surname and initials, and with addresses under 0.9, a score is 71.8 at most.
    some = met.filter(flags["same_phone"] | (flags["same_surname"] & flags["initials_ok"]) | (bound >= 0.89))
    some = cut(some.select(F.col("l_record_id").alias("left_id"), F.col("r_record_id").alias("right_id"), "l_norm_name", "r_norm_name", "l_norm_address", "r_norm_address", *[c.alias(n) for n, c in flags.items()], bound.alias("bound")))
    wide = 4 * width(prints.sparkSession)
    profiles = small(cut(described.select("norm_name").distinct().select("norm_name", *name_profile(F.col("norm_name")))))
    side = lambda s: profiles.select(*[F.col(c).alias(f"{s}_{c}") for c in ("norm_name", "aliases", "codes", "grams", "sorted_aliases")])
    pairs = some.select("l_norm_name", "r_norm_name").distinct().repartition(wide).join(side("l"), "l_norm_name").join(side("r"), "r_norm_name")
    alike = pairs.select("l_norm_name", "r_norm_name", *_name_similarities(), sequence_score(F.col("l_sorted_aliases"), F.col("r_sorted_aliases")).alias("seq"), "l_sorted_aliases", "r_sorted_aliases")
    named = small(cut(alike.select("l_norm_name", "r_norm_name", _name_score(F.col("seq")).alias("name_score"))))
    f = {k: F.col(c) for k, c in kinds.items()}
    left = cut(some.join(named, ["l_norm_name", "r_norm_name"]).drop("l_norm_name", "r_norm_name").filter(_score(F.col("name_score"), F.col("bound"), f) >= OPEN), instead_of=some)
    placed = left.select("l_norm_address", "r_norm_address").distinct().repartition(wide)
    placed = small(cut(placed.withColumn("address_score", sequence_score(F.col("l_norm_address"), F.col("r_norm_address")))))
    scored = left.join(placed, ["l_norm_address", "r_norm_address"]).filter(T.round_half_even(_score(F.col("name_score"), F.col("address_score"), f), 1) >= 72)
    return scored.select("left_id", "right_id", F.lit("match").alias("decision"))


def _name_similarities() -> list[Column]:
    """Of the profiles l_... and r_... of two names."""
    return [T.jaccard(F.col("l_aliases"), F.col("r_aliases")).alias("token_jaccard"), T.jaccard(F.col("l_codes"), F.col("r_codes")).alias("phonetic"), T.cosine_of_counts(F.col("l_grams"), F.col("r_grams")).alias("ngram")]


def _name_score(seq: Column) -> Column:
    named = (F.col("l_sorted_aliases") != "") & (F.col("r_sorted_aliases") != "")
    soft = F.greatest(0.92 * F.col("phonetic"), 0.9 * F.col("ngram"))
    return F.greatest(F.when(named, F.greatest(F.col("token_jaccard"), seq, soft)).otherwise(0.0), soft)


def both_equal(a: Column, b: Column) -> Column:
    return (a == b) & (a != "")


def reasons(compared: DataFrame) -> DataFrame:
    """Why a pair scored as it did, in fixed order."""
    texts = F.array_compact(F.array(
        F.when(F.col("same_phone"), "same phone"), F.when(F.col("name_score") >= 0.9, "names agree").when(F.col("name_score") >= 0.72, "names are similar"),
        F.when(F.col("address_score") >= 0.9, "addresses agree").when(F.col("address_score") >= 0.7, "addresses are similar"),
        F.when(F.col("initials_ok") & F.col("same_surname"), "initials and surname agree"), F.when(F.col("same_city"), "same city"),
    ))
    return compared.withColumn("reasons", F.when(F.size(texts) > 0, texts).otherwise(F.array(F.lit("weak evidence"))))


def clusters(prints: DataFrame, compared: DataFrame) -> DataFrame:
    """(record_id, component) by matches."""
    return components(prints.select("record_id"), compared.filter("decision = 'match'"), "record_id", "left_id", "right_id")


def entities(prints: DataFrame, of: DataFrame) -> DataFrame:
    """One row per component: entity_id by size and first member, name, members, addresses, phones."""
    joined = prints.join(of, "record_id")
    tokens = F.size(T.name_tokens(F.col("person_name")))
    best = F.struct((-tokens).alias("t"), (-F.length("person_name")).alias("l"), F.col("person_name").alias("n"))
    full = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    grouped = joined.groupBy("component").agg(F.count("*").alias("size"), F.min(best)["n"].alias("canonical_name"), F.sort_array(F.collect_list("record_id")).alias("record_ids"), full("address").alias("addresses"), full("phone").alias("phones"))
    return number(grouped, "size", "component")


def number(grouped: DataFrame, size: str, first: str) -> DataFrame:
    """entity_id ``ENT-0001``... by size downwards, then first member. Numbers come from range partitions
    and their offsets, so no task sees all rows."""
    ordered = cut(grouped.repartitionByRange(F.col(size).desc(), F.col(first)).sortWithinPartitions(F.col(size).desc(), F.col(first)).withColumn("_p", F.spark_partition_id()))
    sizes = ordered.groupBy("_p").agg(F.count("*").alias("_n"))
    # One row per partition.
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_p").orderBy(F.col(size).desc(), F.col(first)))
    n = within + F.col("_before")
    return ordered.join(before, "_p").withColumn("entity_no", n.cast("bigint")).withColumn("entity_id", F.concat(F.lit("ENT-"), F.when(n < 10000, F.lpad(n.cast("string"), 4, "0")).otherwise(n.cast("string")))).drop("_p", "_before")


def runtime_stats(prints: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Records, all pairs, candidates (``pairs`` counted, or without them by ``count_candidates``), and the share of pairs
    that blocking saves."""
    n = prints.agg(F.count("*").alias("records"))
    c = count_candidates(prints) if pairs is None else pairs.agg(F.count("*").alias("candidate_pairs"))
    every = (F.col("records") * (F.col("records") - 1) / 2).cast("bigint")
    return n.join(c).select("records", every.alias("all_pairs"), "candidate_pairs", F.when(every > 0, F.floor((1 - F.col("candidate_pairs") / every) * 10000 + 0.5)).otherwise(0).cast("bigint").alias("reduction_bp"))


def evaluate_pairwise(labels: DataFrame, truth: str = "truth", entity: str = "entity") -> DataFrame:
    """tp, fp, fn, tn of all pairs from group sizes; no pair is built. One row per labelled record."""
    c2 = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    both = labels.groupBy(truth, entity).count()
    cells = both.agg(c2("count").alias("tp"), F.sum("count").alias("n"))
    by_e = both.groupBy(entity).agg(F.sum("count").alias("count")).agg(c2("count").alias("same_entity"))
    by_t = both.groupBy(truth).agg(F.sum("count").alias("count")).agg(c2("count").alias("same_truth"))
    x = cells.join(by_e).join(by_t)
    long = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    counted = x.select(long(F.col("tp")).alias("tp"), long(F.col("same_entity") - F.col("tp")).alias("fp"), long(F.col("same_truth") - F.col("tp")).alias("fn"), long(F.col("n") * (F.col("n") - 1) / 2 - F.col("same_entity") - F.col("same_truth") + F.col("tp")).alias("tn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return counted.select("*", p.alias("precision"), r.alias("recall"), share(2 * p * r, p + r).alias("f1"))


def wrong_pairs(labels: DataFrame, key: str, truth: str, entity: str, false_positive: bool, most: int = 10) -> DataFrame:
    """The first examples of wrongly joined (or wrongly separated) pairs, by order of the keys."""
    inside, differ = (entity, truth) if false_positive else (truth, entity)
    a, b = labels.alias("a"), labels.alias("b")
    pairs = a.join(b, (F.col(f"a.{inside}") == F.col(f"b.{inside}")) & (F.col(f"a.{differ}") != F.col(f"b.{differ}")) & (F.col(f"a.{key}") < F.col(f"b.{key}")))
    return pairs.select(F.col(f"a.{key}").alias("left_id"), F.col(f"b.{key}").alias("right_id")).orderBy("left_id", "right_id").limit(most)


def top_possible(compared: DataFrame, most: int = 100) -> DataFrame:
    """The best ``possible`` pairs, a top-k report."""
    return compared.filter("decision = 'possible'").orderBy(F.desc("confidence"), "left_id", "right_id").limit(most)


def first_matches(compared: DataFrame, most: int = 100) -> DataFrame:
    """The first matches by ids, as a compact result shows them."""
    return compared.filter("decision = 'match'").orderBy("left_id", "right_id").limit(most)
