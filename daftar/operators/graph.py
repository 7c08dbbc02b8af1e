"""Evidence graph of entities: nodes and edges as tables, association by shared addresses and phones, and
aggregates over it.

Edges are a multigraph and stay so. Shared attributes join distinct (attribute, entity) rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.functions import text as T

#: Kind of asset to node type, id prefix, id column, relation, confidence.
ASSETS = {
    "tax": ("TaxReturn", "TAX-", None, "FILED_IN", 1.0),
    "vehicle": ("Vehicle", "VEH-", "vehicle_reg_no", "OWNS_VEHICLE", 0.9),
    "utility": ("Meter", "METER-", "meter_ref_no", "HAS_UTILITY_METER", 0.9),
    "property": ("Property", "PROP-", "registry_no", "BOUGHT_PROPERTY", 0.9),
}


#: What an asset is called: by which field, or else how.
LABELS = {"tax": ("filer_status", "Unknown"), "vehicle": ("vehicle_make_model", "Vehicle"), "utility": ("meter_ref_no", "Meter"), "property": ("property_type", "Property")}


def owned(records: DataFrame, record_entities: DataFrame) -> DataFrame:
    """Records that have an entity, with normalized address and phone."""
    joined = records.join(record_entities, "record_id")
    return joined.withColumns({"norm_address": T.normalize_address(F.col("address")), "norm_phone": T.normalize_phone(F.col("phone"))})


def edges(owned_records: DataFrame) -> DataFrame:
    """source, target, relation, confidence, record_id: one edge per record and evidence."""
    of = owned_records
    address = of.filter("norm_address <> ''").select("entity_id", T.stable_id("ADDR", F.col("norm_address")).alias("target"), F.lit("USES_ADDRESS").alias("relation"), F.lit(0.8).alias("confidence"), "record_id")
    phone = of.filter("norm_phone <> ''").select("entity_id", T.stable_id("PHONE", F.col("norm_phone")).alias("target"), F.lit("USES_PHONE").alias("relation"), F.lit(0.95).alias("confidence"), "record_id")
    parts = [address, phone]
    for kind, (_, prefix, column, relation, confidence) in ASSETS.items():
        own = F.coalesce(F.nullif(F.col(column), F.lit("")), F.col("record_id")) if column else F.col("record_id")
        parts.append(of.filter(F.col("record_type") == kind).select("entity_id", F.concat(F.lit(prefix), own).alias("target"), F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"), "record_id"))
    return reduce(DataFrame.unionAll, parts).withColumnRenamed("entity_id", "source")


def association(owned_records: DataFrame, column: str, relation: str, confidence: float) -> DataFrame:
    """Both directions of an edge for each two entities that share a value of ``column``."""
    shared = owned_records.filter(F.col(column) != "").select(F.col(column).alias("value"), F.col("entity_id")).distinct()
    a, b = shared.alias("a"), shared.alias("b")
    pairs = a.join(b, (F.col("a.value") == F.col("b.value")) & (F.col("a.entity_id") != F.col("b.entity_id")))
    return pairs.select(F.col("a.entity_id").alias("source"), F.col("b.entity_id").alias("target"), F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"), F.col("a.value").alias("shared_value"))


def associations(owned_records: DataFrame) -> DataFrame:
    return association(owned_records, "norm_address", "SAME_ADDRESS_AS", 0.75).unionAll(association(owned_records, "norm_phone", "SHARES_PHONE_WITH", 0.95))


def nodes(owned_records: DataFrame, names: DataFrame) -> DataFrame:
    """node_id, node_type, label; the first record (by id) that mentions a node gives its label."""
    of = owned_records
    persons = names.select(F.col("entity_id").alias("node_id"), F.lit("Person").alias("node_type"), F.col("canonical_name").alias("label"))
    address = of.filter("norm_address <> ''").select(T.stable_id("ADDR", F.col("norm_address")).alias("node_id"), F.lit("Address").alias("node_type"), F.col("address").alias("label"), "record_id")
    phone = of.filter("norm_phone <> ''").select(T.stable_id("PHONE", F.col("norm_phone")).alias("node_id"), F.lit("PhoneNumber").alias("node_type"), T.mask_phone(F.col("norm_phone")).alias("label"), "record_id")
    parts = [address, phone]
    for kind, (node, prefix, column, _, _) in ASSETS.items():
        own = F.coalesce(F.nullif(F.col(column), F.lit("")), F.col("record_id")) if column else F.col("record_id")
        field, otherwise = LABELS[kind]
        label = F.concat(F.lit("Return " if kind == "tax" else ""), F.coalesce(F.nullif(F.col(field), F.lit("")), F.lit(otherwise)))
        parts.append(of.filter(F.col("record_type") == kind).select(F.concat(F.lit(prefix), own).alias("node_id"), F.lit(node).alias("node_type"), label.alias("label"), "record_id"))
    firsts = reduce(DataFrame.unionAll, parts).groupBy("node_id", "node_type").agg(F.min_by("label", "record_id").alias("label"))
    return persons.unionAll(firsts)


def graph_summary(all_nodes: DataFrame, all_edges: DataFrame) -> DataFrame:
    kind = F.col("node_type")
    n = all_nodes.agg(F.count("*").alias("nodes"), F.count_if(kind == "Person").alias("persons"), F.count_if(kind.isin("Vehicle", "Property", "Meter")).alias("assets"))
    return n.join(all_edges.agg(F.count("*").alias("edges")))


def ego(all_edges: DataFrame, node: str) -> DataFrame:
    """Edges of one node."""
    return all_edges.filter((F.col("source") == node) | (F.col("target") == node))


def entity_aggregate(owned_records: DataFrame) -> DataFrame:
    """Counts and sums of each entity's records: one hash aggregate, combined before the shuffle."""
    kind = F.col("record_type")
    income = F.col("declared_income")
    return owned_records.groupBy("entity_id").agg(
        F.count("*").alias("records"), F.max(F.when(income > 0, income)).alias("declared_income"), F.coalesce(F.sum("tax_paid"), F.lit(0.0)).alias("tax_paid"),
        F.count_if(kind == "tax").alias("tax_records"), F.count_if(kind == "vehicle").alias("vehicles"), F.count_if(kind == "utility").alias("meters"), F.count_if(kind == "property").alias("properties"),
        F.coalesce(F.sum("property_value"), F.lit(0.0)).alias("property_value"), F.coalesce(F.sum("monthly_bill"), F.lit(0.0)).alias("monthly_bill"), F.coalesce(F.max("engine_capacity_cc"), F.lit(0.0)).alias("max_engine_cc"),
        F.array_join(F.array_sort(F.collect_set(F.lower("filer_status"))), ",").alias("filer_statuses"),
    )


def z_scores(aggregate: DataFrame, columns: list[str], key: str = "entity_id") -> DataFrame:
    """Distance of each value from the mean of all in population standard deviations; 0 for fewer than three
    rows or no spread. The statistics are one row."""
    stats = aggregate.agg(F.count("*").alias("_n"), *[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    z = lambda c: F.when((F.col("_n") >= 3) & (F.col(f"_s_{c}") > 0), (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0)
    return aggregate.join(F.broadcast(stats)).select(key, *[z(c).alias(f"z_{c}") for c in columns])


def neighbour_exposure(links: DataFrame, aggregate: DataFrame, measure: str, key: str = "entity_id") -> DataFrame:
    """For each entity the sum of its neighbours' measure weighted by the links' confidence, and the strongest link."""
    weighed = links.join(aggregate.select(F.col(key).alias("target"), F.col(measure).alias("m")), "target").filter("m > 0")
    return weighed.groupBy("source").agg(F.sum(F.col("m") * F.col("confidence")).alias("exposure"), F.max("confidence").alias("strongest"), F.count("*").alias("links")).withColumnRenamed("source", key)


def possible_of_entities(possible: DataFrame, record_entities: DataFrame, most: int = 8) -> DataFrame:
    """Possible matches between different entities, seen from both sides, the best first."""
    of = record_entities.select("record_id", "entity_id")
    both = possible.join(of.select(F.col("record_id").alias("left_id"), F.col("entity_id").alias("l")), "left_id").join(of.select(F.col("record_id").alias("right_id"), F.col("entity_id").alias("r")), "right_id").filter("l <> r")
    seen = both.select(F.col("l").alias("entity_id"), F.col("r").alias("other"), "confidence").unionAll(both.select(F.col("r").alias("entity_id"), F.col("l").alias("other"), "confidence"))
    listed = seen.groupBy("entity_id").agg(F.count("*").alias("possible"), F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "other"))).alias("x"))
    return listed.select("entity_id", "possible", F.transform(F.slice("x", 1, most), lambda s: s["other"]).alias("others"))


def lineage(owned_records: DataFrame) -> DataFrame:
    """The source rows behind each entity, in order of their ids."""
    return owned_records.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("record_id", "source_dataset", "record_type"))).alias("rows"))
