"""Queries of the ten training-data problems, and their SQL where SQL can say them on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from daftar.llm import encode, fusion, groups, leakage, owners, places, split, unify
from daftar.runtime import cut, table


def _civic(spark, d):
    return owners.records_of({t: table(spark, d, t) for t in owners.CIVIC})


def _owned(spark, d):
    return owners.owner_ids(_civic(spark, d), table(spark, d, "short_names"))


def p1_found(spark, d):
    owned = cut(_owned(spark, d).select("record_id", F.xxhash64("source").alias("source"), "owner"))
    return owners.paired(owned, across=True).select(F.col("a.record_id").alias("left_record_id"), F.col("b.record_id").alias("right_record_id"))


def p1_matches(spark, d):
    """The pairs with the confidence of each."""
    return owners.owner_pairs(cut(_owned(spark, d)), across=True)


def p1_members(spark, d):
    """The same owners as one row per record."""
    return _owned(spark, d).select("record_id", "owner")


def p2_found(spark, d):
    matches = table(spark, d, "match_pairs").filter("decision = 'match'")
    return groups.group_records(table(spark, d, "record_fingerprints"), matches)


def p4_found(spark, d):
    typed = ("fbr_tax_records_complex", "excise_vehicles_complex", "disco_consumption_complex")
    owned = cut(_owned(spark, d).filter(F.col("source").isin(*typed)).select("record_id", F.xxhash64("source").alias("source"), "text", "owner"))
    return owners.paired(owned, across=False).select(F.col("a.record_id").alias("left_record_id"), F.col("b.record_id").alias("right_record_id"))


def p5_found(spark, d):
    return places.same_place_pairs(_civic(spark, d))


def p5_members(spark, d):
    """The same places as one row per record."""
    return places.place_members(_civic(spark, d)).select("record_id", "place")


def _names(spark, d):
    tax = table(spark, d, "fbr_tax_records_complex").select("record_id", F.col("full_name").alias("name"))
    return tax.unionAll(table(spark, d, "property_transfers_complex").select("record_id", F.col("buyer_name").alias("name")))


def p6_found(spark, d):
    return unify.unify(_names(spark, d), "name").filter("changed").select("record_id")


def p6_names(spark, d):
    """Every name in consistent form."""
    return unify.unify(_names(spark, d), "name")


def p7_found(spark, d):
    best = fusion.fuse(table(spark, d, "fbr_tax_records_complex"), table(spark, d, "source_channels"), binding=True)
    return best.select("ntn", "field_name", "record_id")


def p7_fused(spark, d):
    """One row per taxpayer and field by estimated accuracies instead of declared trust."""
    best = fusion.fuse(table(spark, d, "fbr_tax_records_complex"), table(spark, d, "source_channels"))
    return best.select("ntn", "field_name", "value", "record_id", F.round("posterior", 3).alias("posterior"))


def p8_ids(spark, d):
    return encode.encode(table(spark, d, "documents").select("doc_id", "text"))


def p9_found(spark, d):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_substituted(spark, d):
    """Passages of 20 words and more with up to two words substituted."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), passage=20, substitutions=2)


def p10_pieces(spark, d):
    return split.split(table(spark, d, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_matches, p1_members, p2_found, p4_found, p5_found, p5_members, p6_found, p6_names, p7_found, p7_fused, p8_ids, p9_found, p9_substituted, p10_pieces)}


#: Names: what the operator calls usable, in SQL.
_P7 = r"""
WITH t AS (
  SELECT r.ntn, r.record_id, r.received_at, coalesce(c.trust_rank, 2147483647) AS trust_rank, full_name, phone_number, declared_income_pkr
  FROM fbr_tax_records_complex r LEFT JOIN source_channels c ON c.source_channel = r.source_channel
  WHERE r.ntn IS NOT NULL AND r.ntn <> 'NTN-AGT-0001'
), g AS (SELECT ntn FROM t GROUP BY ntn HAVING count(*) > 1),
w AS (
  SELECT t.*, list_transform(regexp_split_to_array(full_name, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}\x0B]+'), lambda x: length(regexp_replace(x, '\P{L}', '', 'g'))) AS letters
  FROM t JOIN g USING (ntn)
), u AS (
  SELECT ntn, 'full_name' AS field_name, record_id, trust_rank, received_at FROM w WHERE len(list_filter(letters, lambda n: n > 0)) >= 2 AND len(list_filter(letters, lambda n: n = 1)) = 0
  UNION ALL
  SELECT ntn, 'phone_number', record_id, trust_rank, received_at FROM w WHERE regexp_full_match(regexp_replace(phone_number, '[^0-9]', '', 'g'), '03[0-9]{9}|923[0-9]{9}|00923[0-9]{9}')
  UNION ALL
  SELECT ntn, 'declared_income_pkr', record_id, trust_rank, received_at FROM w WHERE regexp_full_match(trim(declared_income_pkr), '(?i)(?:(?:pkr|rs\.?)\s*)?[0-9][0-9,]*(?:\.[0-9]+)?\s*(?:/-)?')
), o AS (SELECT *, row_number() OVER (PARTITION BY ntn, field_name ORDER BY trust_rank, received_at DESC, record_id) AS n FROM u)
SELECT ntn, field_name, record_id FROM o WHERE n = 1
"""

_P2 = """
WITH RECURSIVE e AS (
  SELECT left_record_id AS a, right_record_id AS b FROM match_pairs WHERE decision = 'match'
  UNION SELECT right_record_id, left_record_id FROM match_pairs WHERE decision = 'match'
), walk AS (
  SELECT record_id AS a, record_id AS b FROM record_fingerprints
  UNION SELECT walk.a, e.b FROM walk JOIN e ON e.a = walk.b
)
SELECT min(b) AS group_id, a AS record_id FROM walk GROUP BY a
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": _P2, "p7_found": _P7}
