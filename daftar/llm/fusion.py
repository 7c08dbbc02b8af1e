"""Best representative of each duplicate group: Bayesian fusion of sources with copy detection.

Per group and field the distinct usable values are rivals. Each source that claims a value votes with the
log-odds of its accuracy; accuracies are estimated by iterating votes and agreement, starting from the
declared trust ranks. Sources that share *false* values more often than independence allows are taken as
copiers, and the vote of the less accurate of the two is discounted by the probability of copying. The
value of the highest posterior survives.

Where trust is declared as binding (``binding=True``), the prior of a better rank outweighs any number of
votes of worse ranks, and within a rank the latest statement is the source's own correction of earlier
ones. The posterior then decides only between values of equal rank and time.

All statistics are aggregates by source, pair of sources, or (group, field, value); the largest table that
leaves an aggregation has one row per group, field and value. Sources are few by nature (channels), so
accuracies and dependences are small tables, checked before they are shipped.

Defined results: null keys belong to no group; null and unusable cells never win; a group without a
usable value has no row for that field; equal claims fall to the smaller record id; an unknown or null
source ranks last.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.runtime import cut
from daftar.sources.rejects import missing, valid_amount

PHONE = r"^(?:03[0-9]{9}|923[0-9]{9}|00923[0-9]{9})$"
SPACES = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]+"


def usable_name(cell):
    """At least two words with letters and no word with exactly one letter."""
    letters = F.transform(F.split(cell, SPACES), lambda w: F.length(F.regexp_replace(w, r"\P{L}+", "")))
    return (F.size(F.filter(letters, lambda n: n > 0)) >= 2) & ~F.exists(letters, lambda n: n == 1)


def usable_phone(cell):
    return F.regexp_replace(cell, "[^0-9]+", "").rlike(PHONE)


def usable_amount(cell):
    return ~missing(cell) & valid_amount(cell)


#: Field and test of usability, for tax records.
TAX_FIELDS = {"full_name": usable_name, "phone_number": usable_phone, "declared_income_pkr": usable_amount}


def comparable(field: str, cell):
    """Equal claims in different notation compare equal."""
    if field == "phone_number":
        return F.right(F.regexp_replace(cell, "[^0-9]+", ""), F.lit(10))
    if field == "declared_income_pkr":
        return F.regexp_replace(F.regexp_replace(cell, r"(?i)rs\.|/-|[^0-9.]", ""), r"\.0*$", "")
    return F.lower(F.regexp_replace(F.trim(cell), SPACES, " "))


def claims(rows: DataFrame, ranks: DataFrame, key: str = "ntn", exclude: tuple = ("NTN-AGT-0001",), fields: dict = TAX_FIELDS) -> DataFrame:
    """One row per usable cell of groups of two or more rows: key, field_name, value, raw, source, rank, at, record_id."""
    kept = rows.filter(F.col(key).isNotNull() & ~F.col(key).isin(*exclude))
    last = ranks.groupBy("source_channel").agg(F.min("trust_rank").alias("rank"))
    cells = F.array(*[
        F.struct(F.lit(f).alias("field_name"), F.col(f).alias("raw"), comparable(f, F.col(f)).alias("value"), F.coalesce(test(F.col(f)), F.lit(False)).alias("usable"))
        for f, test in fields.items()
    ])
    listed = kept.select(key, "record_id", "received_at", "source_channel", cells.alias("cells")).join(last, "source_channel", "left")
    # Rows of a group count also where no cell is usable: two rows make a group.
    sizes = kept.groupBy(key).agg(F.count("*").alias("rows")).filter("rows > 1").select(key)
    out = listed.join(sizes, key, "left_semi").select(
        F.col(key), "record_id", F.col("received_at").alias("at"), F.coalesce("source_channel", F.lit("")).alias("source"), F.coalesce("rank", F.lit(2**31 - 1)).alias("rank"), F.inline("cells")
    )
    return out.filter("usable").drop("usable")


def _votes(stated: DataFrame, key: str) -> DataFrame:
    """Distinct claims by group, field, value and source, so repeats of one source vote once."""
    return stated.groupBy(key, "field_name", "value", "source").agg(F.min("rank").alias("rank"))


def _beliefs(votes: DataFrame, accuracy: DataFrame, copying: DataFrame | None, key: str, rivals: int) -> DataFrame:
    """Each voted value with its log posterior up to a constant, ``score``, and its share ``p`` in its group."""
    group = [key, "field_name"]
    known = votes.join(accuracy, "source").withColumn("vote", F.log(F.lit(float(rivals)) * F.col("accuracy") / (1 - F.col("accuracy"))))
    if copying is not None:
        # A vote counts by the chance that it isn't copied from a more accurate source of the same value.
        better = known.select(*group, "value", F.col("source").alias("b"), F.col("accuracy").alias("b_accuracy"))
        pairs = known.join(better, [*group, "value"]).join(copying.withColumnRenamed("a", "source"), ["source", "b"], "left")
        worse = F.struct("accuracy", "source") < F.struct("b_accuracy", "b")
        free = F.exp(F.sum(F.when(worse, F.log(1 - F.coalesce("copies", F.lit(0.0)))).otherwise(0.0)))
        known = pairs.groupBy(*group, "value", "source", "vote").agg(free.alias("free")).withColumn("vote", F.col("vote") * F.col("free"))
    scored = known.groupBy(*group, "value").agg(F.sum("vote").alias("score"))
    total = scored.groupBy(*group).agg(F.sum(F.exp(F.least("score", F.lit(300.0)))).alias("total"))
    return scored.join(total, group).withColumn("p", F.exp(F.least("score", F.lit(300.0))) / F.col("total")).drop("total")


def _copying(votes: DataFrame, beliefs: DataFrame, accuracy: DataFrame, key: str, rivals: int, rate: float = 0.8, prior: float = 0.1) -> DataFrame:
    """(a, b, copies): the probability that sources a and b depend on each other, from what they share.

    Agreement on a value believed false is strong evidence, agreement on a true one weak, difference speaks against."""
    group = [key, "field_name"]
    seen = votes.join(beliefs.select(*group, "value", "p"), [*group, "value"])
    one = seen.select(*group, F.col("source").alias("a"), F.col("value").alias("va"), "p")
    two = seen.select(*group, F.col("source").alias("b"), F.col("value").alias("vb"))
    # At most (number of sources) squared rows per group and pair of values; summed before they move.
    met = one.join(two, group).filter("a <> b").groupBy("a", "b").agg(
        F.sum(F.when(F.col("va") == F.col("vb"), F.col("p")).otherwise(0.0)).alias("same_true"),
        F.sum(F.when(F.col("va") == F.col("vb"), 1 - F.col("p")).otherwise(0.0)).alias("same_false"),
        F.sum(F.when(F.col("va") != F.col("vb"), 1.0).otherwise(0.0)).alias("differ"),
    )
    x = met.join(accuracy.select(F.col("source").alias("a"), F.col("accuracy").alias("x")), "a").join(accuracy.select(F.col("source").alias("b"), F.col("accuracy").alias("y")), "b")
    x = x.withColumn("t", F.col("x") * F.col("y")).withColumn("f", (1 - F.col("x")) * (1 - F.col("y")) / rivals).withColumn("d", F.greatest(1 - F.col("t") - F.col("f"), F.lit(1e-9)))
    gain = (
        F.col("same_true") * F.log((rate * F.col("y") + (1 - rate) * F.col("t")) / F.col("t"))
        + F.col("same_false") * F.log((rate * (1 - F.col("y")) + (1 - rate) * F.col("f")) / F.col("f"))
        + F.col("differ") * F.lit(math.log(1 - rate))
        + F.lit(math.log(prior / (1 - prior)))
    )
    return x.select("a", "b", F.least(1 / (1 + F.exp(-F.greatest(F.least(gain, F.lit(60.0)), F.lit(-60.0)))), F.lit(0.999)).alias("copies"))


def estimate(stated: DataFrame, key: str = "ntn", rivals: int = 20, rounds: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(beliefs, accuracy by source, copying by pair of sources) after so many rounds of voting."""
    votes = cut(_votes(stated, key))
    accuracy = votes.groupBy("source").agg(F.min("rank").alias("rank")).select("source", F.greatest(F.lit(0.55), 0.95 - 0.08 * (F.least("rank", F.lit(9)) - 1)).alias("accuracy"))
    copying = None
    for _ in range(rounds):
        beliefs = cut(_beliefs(votes, accuracy, copying, key, rivals))
        copying = cut(_copying(votes, beliefs, accuracy, key, rivals))
        agreed = votes.join(beliefs, [key, "field_name", "value"]).groupBy("source").agg(F.avg("p").alias("accuracy"))
        accuracy = cut(agreed.select("source", F.greatest(F.lit(0.05), F.least(F.lit(0.99), "accuracy")).alias("accuracy")))
    return _beliefs(votes, accuracy, copying, key, rivals), accuracy, copying


def fuse(rows: DataFrame, ranks: DataFrame, key: str = "ntn", exclude: tuple = ("NTN-AGT-0001",), fields: dict = TAX_FIELDS, binding: bool = False) -> DataFrame:
    """One row per group and field: key, field_name, value (as typed), record_id of the record that supplies
    it, posterior. See the module for ``binding`` and for nulls, ties and empty groups."""
    stated = cut(claims(rows, ranks, key, exclude, fields))
    beliefs, _, _ = estimate(stated, key)
    ranked = stated.join(beliefs, [key, "field_name", "value"])
    trust = F.struct((-F.col("rank").cast("bigint")).alias("trust"), F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(-(2**62))).alias("recency"))
    order = F.struct(trust, F.col("score")) if binding else F.struct(F.col("score"), trust)
    best = ranked.groupBy(key, "field_name").agg(F.max(order).alias("top"))
    top = ranked.withColumn("order", order).join(best, [key, "field_name"]).filter("order = top")
    return top.groupBy(key, "field_name").agg(F.min_by(F.struct("raw", "record_id", "p"), "record_id").alias("s")).select(key, "field_name", F.col("s.raw").alias("value"), "s.record_id", F.col("s.p").alias("posterior"))
