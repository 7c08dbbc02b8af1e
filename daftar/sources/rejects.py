"""Rows that fail to parse: bad lines and cells come out with their reason, good lines as typed rows.

Per file layout one anchored pattern accepts a whole good line. Lines that it refuses go through
patterns of growing field prefixes; the first prefix that no longer matches names the broken field.
All patterns run inside the JVM; nothing is collected.

Defined results: a null or empty line is ``columns``; a null, empty or blank amount is missing and
therefore good; a line of an unknown file has no layout and is checked for quoting only; a carriage
return at the line's end is dropped; repeated lines stay repeated; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Field order of the three raw files and the name of each file's amount.
LAYOUTS = {
    "fbr_tax_records_complex.csv": (
        "fbr_id full_name declared_income_pkr tax_paid_pkr filer_status reported_address phone_number ntn source_note".split(),
        "declared_income_pkr",
    ),
    "disco_consumption_complex.csv": (
        "meter_ref_no consumer_name installation_address avg_monthly_bill_pkr connection_type phone_number division source_note".split(),
        "avg_monthly_bill_pkr",
    ),
    "property_transfers_complex.csv": (
        "registry_no buyer_name seller_name property_address property_value_pkr transfer_date area_marla property_type buyer_phone source_note".split(),
        "property_value_pkr",
    ),
}

#: Stands for a doubled quote between two other characters, so that no pattern has to loop over them.
PAIR = "￿"
FIELD = f'(?:"[^"]*+(?:""[^"]*+)*+"|[^",{PAIR}]*+)'
AMOUNT = r"(?i)^\s*+(?:(?:pkr|rs\.?)\s*+)?[0-9][0-9,]*+(?:\.[0-9]++)?\s*+(?:/-)?\s*+$"
BLANK = r"(?U)^\s*+$"


def valid_amount(cell: Column) -> Column:
    """True for an amount that can be read: digits with commas, an optional decimal part, currency
    mark and ``/-``. Null for null."""
    return cell.rlike("(?U)" + AMOUNT)


def missing(cell: Column) -> Column:
    return cell.isNull() | cell.rlike(BLANK)


def bad_amount(cell: Column) -> Column:
    """True where an amount is neither missing nor valid; never null."""
    return ~missing(cell) & ~F.coalesce(valid_amount(cell), F.lit(False))


def amount(cell: Column) -> Column:
    """The amount as a number; null where it is missing or invalid."""
    digits = F.regexp_replace(F.regexp_replace(cell, r"/-\s*$", ""), r"(?i:rs\.)|[^0-9.]", "")
    return F.when(F.coalesce(valid_amount(cell), F.lit(False)), digits.try_cast("double"))


def _prepared(line: Column) -> Column:
    """Without a final carriage return, doubled quotes inside words replaced by ``PAIR``."""
    return F.regexp_replace(F.regexp_replace(line, r"\r\z", ""), r'(?<=[^,"])""(?=[^,"])', PAIR)


def whole_line(fields: int) -> str:
    """Pattern of a well-formed line of so many fields."""
    return "^" + FIELD + ("," + FIELD) * (fields - 1) + "$"


ANY_LINE = rf"\A{FIELD}(?:,{FIELD})*+\z"


def field_at(line: Column, index: int) -> Column:
    """The unquoted text of field ``index`` (from 0) of a well-formed prepared line."""
    raw = F.regexp_extract(line, r"\A(?:" + FIELD + ",)" + "{%d}(" % index + FIELD + ")", 1)
    inner = F.when(raw.startswith('"'), F.regexp_replace(raw, r'\A"|"\z', "")).otherwise(raw)
    return F.replace(F.replace(inner, F.lit('""'), F.lit('"')), F.lit(PAIR), F.lit('"'))


def broken_field(line: Column, fields: int) -> Column:
    """Number (from 1) of the first field that is not well formed, or the first missing or surplus one."""
    prefixes = [r"\A" + FIELD + ("," + FIELD) * k + r"(?=,|\z)" for k in range(fields)]
    return reduce(
        lambda rest, k: F.when(~line.rlike(prefixes[k]), F.lit(k + 1)).otherwise(rest),
        reversed(range(fields)),
        F.lit(fields + 1),
    )


def checked_lines(raw: DataFrame, layouts: dict = LAYOUTS) -> DataFrame:
    """record_id, file_name, line (prepared), reason (null for good lines), broken_field."""
    line = F.coalesce(_prepared(F.col("line")), F.lit(""))
    lines = raw.select("record_id", "file_name", line.alias("line"), F.col("line").isNull().alias("_none"))
    shape, value, broken = F.lit(None).cast("boolean"), F.lit(False), F.lit(None).cast("int")
    for name, (fields, number) in layouts.items():
        here = F.col("file_name") == name
        whole = r"\A" + whole_line(len(fields))[1:-1] + r"\z"
        at = fields.index(number)
        shape = F.when(here, F.col("line").rlike(whole)).otherwise(shape)
        value = F.when(here, bad_amount(field_at(F.col("line"), at))).otherwise(value)
        broken = F.when(here, broken_field(F.col("line"), len(fields))).otherwise(broken)
    known = F.coalesce(F.col("file_name").isin(*layouts), F.lit(False))
    reason = (
        F.when(F.col("_none") | (F.col("line") == ""), "columns")
        .when(known & F.coalesce(shape, F.lit(False)), F.when(value, "value"))
        .when(~F.col("line").rlike(ANY_LINE), "quoting")
        .when(known, "columns")
    )
    return lines.select(
        "record_id",
        "file_name",
        "line",
        reason.alias("reason"),
        F.when(reason.isin("quoting", "columns"), F.coalesce(broken, F.lit(1))).alias("broken_field"),
    )


def good_rows(raw: DataFrame, file_name: str, layouts: dict = LAYOUTS) -> DataFrame:
    """The good lines of one file as typed rows: every field as text, the amount as a double besides."""
    fields, number = layouts[file_name]
    lines = checked_lines(raw, layouts).filter((F.col("file_name") == file_name) & F.col("reason").isNull())
    cells = lines.select("record_id", *[field_at(F.col("line"), i).alias(f) for i, f in enumerate(fields)])
    return cells.withColumn(number, amount(F.col(number)))


def rejected_cells(rows: DataFrame, number: str) -> DataFrame:
    """record_id and reason of the rows of a table whose amount is neither missing nor valid."""
    return rows.filter(bad_amount(F.col(number))).select("record_id", F.lit("value").alias("reason"))
