"""Labelled civic tables made by rule: parallel, the same for the same seed, of any size.

Each draw is a hash of seed, person and purpose, so no task depends on another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names, streets and cities to draw from.
FIRST = "Ahmed Fatima Usman Sara Bilal Ayesha Hassan Zainab Imran Hina Kamran Nadia Tariq Sana Omar".split()
LAST = "Khan Malik Sheikh Butt Qureshi Siddiqui Raza Chaudhry Iqbal Hussain".split()
STREETS = ["Gulberg Road", "Model Town Road", "Clifton Block", "Satellite Town", "Johar Street"]
CITIES = ["Lahore", "Karachi", "Islamabad", "Multan", "Quetta"]
INCOME, HIGH_INCOME = [45000, 60000, 85000], [180000, 260000, 420000]
BILL, HIGH_BILL = [18000, 32000, 55000], [180000, 240000, 310000]
VALUE = [65_000_000, 92_000_000, 135_000_000]


def tables(spark: SparkSession, citizens: int = 12, seed: int = 42) -> dict[str, DataFrame]:
    """Four tables by name, with the columns ``_truth_person_id`` and ``_truth_scenario``."""
    person = F.col("id")
    draw = lambda purpose: F.pmod(F.xxhash64(F.lit(seed), person, F.lit(purpose)), F.lit(1_000_003)) / 1_000_003.0
    pick = lambda values, purpose: F.get(F.array(*map(F.lit, values)), F.floor(draw(purpose) * len(values)).cast("int"))
    every = lambda values, step: F.get(F.array(*map(F.lit, values)), F.pmod(F.floor(person / step), F.lit(len(values))).cast("int"))
    scenario = F.when(person.isin(1, 4), "direct_luxury").when(person.isin(5, 8), "cash_low_tax").otherwise("normal")
    first, last = every(FIRST, 1), every(LAST, len(FIRST))
    people = spark.range(1, citizens + 1).select(
        "id", scenario.alias("scenario"), F.concat_ws(" ", first, last).alias("name"), first.alias("first"), last.alias("last"),
        F.concat_ws(" ", F.lit("House"), (F.floor(person / 7) + 1).cast("string"), F.lit("Street"), (F.pmod(person, F.lit(97)) + 1).cast("string"), every(STREETS, 3), every(CITIES, 2)).alias("home"),
        F.concat(F.lit("03"), F.lpad((F.lit(100000000) + person * 7919 % 899999999).cast("string"), 9, "0")).alias("phone"),
    )

    def typed(purpose: str) -> Column:
        """One of six ways to type a name."""
        ways = F.array(F.col("name"), F.upper("name"), F.concat_ws(" ", F.concat(F.substring("first", 1, 1), F.lit(".")), "last"), F.concat_ws(" ", F.lit("Mr."), "name"), F.concat_ws(" ", "last", "first"), F.replace(F.col("name"), F.lit("a"), F.lit("aa")))
        return F.get(ways, F.floor(draw(purpose) * 6).cast("int"))

    def written(purpose: str) -> Column:
        out = F.col("home")
        for i, (a, b) in enumerate((("House", "H"), ("Street", "St"), ("Road", "Rd"), ("Block", "Blk"), ("Town", "Twn"))):
            out = F.when(draw(f"{purpose}{i}") < 0.45, F.replace(out, F.lit(a), F.lit(b))).otherwise(out)
        return out

    truth = [F.concat(F.lit("P"), F.lpad(person.cast("string"), 3, "0")).alias("_truth_person_id"), F.col("scenario").alias("_truth_scenario")]
    number = person.cast("string").alias("source_row_id")
    rich = F.col("scenario") == "direct_luxury"
    income = F.when(rich | (F.col("scenario") == "cash_low_tax"), pick(INCOME, "income")).otherwise(pick(HIGH_INCOME, "income"))
    tax = people.select(number, F.concat(F.lit("FBR-"), person.cast("string")).alias("fbr_id"), typed("tax").alias("full_name"), income.alias("declared_income_pkr"), F.floor(income * F.when(F.col("scenario") == "normal", 0.1).otherwise(0.01)).alias("tax_paid_pkr"), F.when(F.col("scenario") == "cash_low_tax", "Non-Filer").otherwise("Filer").alias("filer_status"), written("tax").alias("reported_address"), F.col("phone").alias("phone_number"), *truth)
    utility = people.select(number, F.concat(F.lit("MTR-"), person.cast("string")).alias("meter_ref_no"), typed("meter").alias("consumer_name"), written("meter").alias("installation_address"), F.when(rich, pick(HIGH_BILL, "bill")).otherwise(pick(BILL, "bill")).alias("avg_monthly_bill_pkr"), F.lit("Residential").alias("connection_type"), *truth)
    vehicle = people.filter(rich | (draw("car") < 0.75)).select(number, F.concat(F.lit("LE-"), person.cast("string")).alias("vehicle_reg_no"), typed("car").alias("owner_name"), F.when(rich, 3000).otherwise(1300).alias("engine_capacity_cc"), F.lit("Model").alias("vehicle_make_model"), F.lit(2020).alias("registration_year"), written("car").alias("owner_address"), *truth)
    deeds = people.filter(rich).select(number, F.concat(F.lit("REG-"), person.cast("string")).alias("registry_no"), typed("deed").alias("buyer_name"), F.lit("Unnamed Seller").alias("seller_name"), written("deed").alias("property_address"), pick(VALUE, "value").alias("property_value_pkr"), F.lit("2023-01-01").alias("transfer_date"), F.lit(10).alias("area_marla"), F.lit("House").alias("property_type"), *truth)
    return {"fbr_tax_records.csv": tax, "disco_consumption.csv": utility, "excise_vehicles.csv": vehicle, "property_transfers.csv": deeds}
