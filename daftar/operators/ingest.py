"""Profiling of tables, detection of their kind, mapping of columns, canonical records.

Decisions about column names are metadata and made on the driver; everything about rows is one aggregate
or one projection per table.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daftar.functions import text as T

# Canonical fields with the column names they go by, in order, and the words that tell kinds.
FIELD_SYNONYMS = {
    "person_name": ["full_name", "name", "owner_name", "consumer_name", "buyer_name", "taxpayer_name", "applicant_name"],
    "seller_name": ["seller_name", "seller", "previous_owner"],
    "address": ["address", "reported_address", "owner_address", "installation_address", "property_address", "service_address", "mailing_address"],
    "phone": ["phone", "phone_number", "mobile", "mobile_number", "contact_no", "cell"],
    "declared_income": ["declared_income_pkr", "declared_income", "income", "monthly_income", "annual_income"],
    "tax_paid": ["tax_paid_pkr", "tax_paid", "tax_amount"],
    "filer_status": ["filer_status", "status", "tax_status"],
    "vehicle_reg_no": ["vehicle_reg_no", "registration_no", "reg_no", "vehicle_no"],
    "engine_capacity_cc": ["engine_capacity_cc", "engine_cc", "cc", "vehicle_cc"],
    "vehicle_make_model": ["vehicle_make_model", "make_model", "model", "vehicle_model"],
    "registration_year": ["registration_year", "reg_year", "year"],
    "meter_ref_no": ["meter_ref_no", "meter_no", "reference_no", "consumer_no"],
    "monthly_bill": ["avg_monthly_bill_pkr", "monthly_bill", "bill_amount", "average_bill"],
    "connection_type": ["connection_type", "tariff", "meter_type"],
    "registry_no": ["registry_no", "property_reg_no", "transfer_id"],
    "property_value": ["property_value_pkr", "property_value", "declared_value", "transaction_value"],
    "transfer_date": ["transfer_date", "sale_date", "transaction_date"],
    "area_marla": ["area_marla", "marla", "area"],
    "property_type": ["property_type", "property_category", "land_use"],
}
KIND_WORDS = {
    "tax": ["tax", "fbr", "filer", "declared_income"],
    "vehicle": ["vehicle", "excise", "engine", "reg_no"],
    "utility": ["disco", "meter", "utility", "bill", "consumer"],
    "property": ["property", "registry", "transfer", "marla"],
}
#: Canonical columns of each kind beside the common ones; numbers are cleaned.
KIND_FIELDS = {
    "tax": ["phone", "declared_income", "tax_paid", "filer_status"],
    "vehicle": ["vehicle_reg_no", "engine_capacity_cc", "vehicle_make_model", "registration_year"],
    "utility": ["meter_ref_no", "monthly_bill", "connection_type"],
    "property": ["seller_name", "registry_no", "property_value", "transfer_date", "area_marla", "property_type"],
    "generic": ["phone"],
}
NUMBERS = {"declared_income", "tax_paid", "engine_capacity_cc", "monthly_bill", "property_value", "area_marla"}


def detect_kind(columns: list[str], name: str) -> str:
    seen = " ".join([*columns, name]).lower()
    return next((kind for kind, words in KIND_WORDS.items() if any(w in seen for w in words)), "generic")


def _column_key(column: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", column) if not unicodedata.combining(c)).lower().replace("&", " and ")
    return "_".join("".join(c if c.isascii() and (c.isalnum() or c in "./-") else " " for c in plain).split())


def auto_mapping(columns: list[str]) -> dict[str, str]:
    """Canonical field to column: an exact synonym first, else the first name that holds or is held by one."""
    keys = [(c, _column_key(c)) for c in columns]
    exact = {f: next((c for c, k in keys if k in names), None) for f, names in FIELD_SYNONYMS.items()}
    partial = {f: next((c for c, k in keys if any(n in k or k in n for n in names)), None) for f, names in FIELD_SYNONYMS.items()}
    return {f: c for f in FIELD_SYNONYMS if (c := exact[f] or partial[f])}


def settle(columns: list[str], name: str, override: dict[str, str] | None = None) -> tuple[str, dict[str, str]]:
    """(kind, mapping) after a user's override; an empty entry can't unmap."""
    override = override or {}
    kind = override.get("_kind") or override.get("detected_kind") or override.get("record_type") or detect_kind(columns, name)
    return str(kind), auto_mapping(columns) | {k: v for k, v in override.items() if v and not k.startswith("_")}


def profile(df: DataFrame, name: str, order: str | None = None, override: dict[str, str] | None = None, samples: int = 3) -> DataFrame:
    """One row per column: dataset, kind, column, rows, missing, missing_ratio, field (null if unmapped), samples
    (the first distinct values by ``order``; by value without one). One aggregate over the table, and one over
    its distinct values."""
    columns = [c for c in df.columns if c != order] if order and order.startswith("_") else df.columns
    kind, mapping = settle(columns, name, override)
    fields = {}
    for f, c in mapping.items():
        fields.setdefault(c, f)
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    counted = df.agg(F.count("*").alias("rows"), *[F.count_if(blank(c)).alias(f"m{i}") for i, c in enumerate(columns)])
    stacked = counted.select("rows", F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(c).alias("column"), F.lit(fields.get(c)).cast("string").alias("field"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(columns)])).alias("x")).select("rows", "x.*")
    place = F.col(order) if order else F.lit(0)
    values = df.select(place.alias("at_row"), F.posexplode(F.array(*[F.when(~blank(c), F.col(c).cast("string")) for c in columns])).alias("at", "value")).filter("value is not null")
    firsts = values.groupBy("at", "value").agg(F.min("at_row").alias("at_row"))
    top = firsts.withColumn("n", F.row_number().over(Window.partitionBy("at").orderBy("at_row", "value"))).filter(F.col("n") <= samples)
    listed = top.groupBy("at").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "value"))), lambda s: s["value"]), " | ").alias("samples"))
    ratio = F.round(F.col("missing") / F.greatest(F.col("rows"), F.lit(1)), 3)
    return stacked.join(listed, "at", "left").select(F.lit(name).alias("dataset"), F.lit(kind).alias("kind"), "column", "field", "rows", "missing", ratio.alias("missing_ratio"), F.coalesce("samples", F.lit("")).alias("samples"))


def canonicalize(df: DataFrame, name: str, row_id: str, override: dict[str, str] | None = None) -> DataFrame:
    """Canonical records of one table: the common columns and those of all kinds, null where a kind has none."""
    kind, mapping = settle(df.columns, name, override)
    known = kind if kind in KIND_FIELDS else "generic"
    value = lambda f: F.col(mapping[f]).cast("string") if f in mapping else F.lit("")

    def field(f: str):
        if f not in KIND_FIELDS[known]:
            return F.lit(None).cast("double" if f in NUMBERS else "string")
        if f in NUMBERS:
            return T.clean_number(value(f))
        return F.coalesce(F.trim(value(f)), F.lit("None")) if f == "filer_status" else value(f)

    every = list(dict.fromkeys(f for fields in KIND_FIELDS.values() for f in fields))
    return df.select(
        F.lit(name).alias("source_dataset"), F.col(row_id).cast("string").alias("source_row_id"), F.concat(F.lit(name + ":"), F.col(row_id).cast("string")).alias("record_id"),
        F.lit(kind).alias("source_kind"), F.lit(known).alias("record_type"), value("person_name").alias("person_name"), value("address").alias("address"), *[field(f).alias(f) for f in every],
    )


def canonical_records(tables: dict[str, DataFrame], row_id: str = "source_row_id", overrides: dict | None = None) -> DataFrame:
    """Canonical records of all tables; narrow, no shuffle."""
    out = None
    for name, df in tables.items():
        part = canonicalize(df, name, row_id, (overrides or {}).get(name))
        out = part if out is None else out.unionByName(part)
    return out


def strip_labels(df: DataFrame) -> DataFrame:
    """Without columns that hold labels or control data (names that start with an underscore)."""
    return df.select(*[c for c in df.columns if not c.startswith("_")])
