from datetime import datetime, timedelta

from pyspark.sql import functions as F

from daftar.llm import fusion

SCHEMA = "ntn string, record_id string, received_at timestamp, source_channel string, full_name string, phone_number string, declared_income_pkr string, extra string"
DAY = datetime(2024, 1, 1)


def rows(spark, data):
    return spark.createDataFrame([(*r, None) for r in data], SCHEMA)


def ranks(spark):
    return spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "source_channel string, trust_rank int")


def test_usable(spark):
    names = {"Ali Raza": True, "A. Raza": False, "Ali": False, "Ali  5 Raza": True, "علی رضا": True, "Ali R": False, "": False, None: None, "O'Neil Khan": True, "Ali Raza": True}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r[0]: r[1] for r in df.select("n", fusion.usable_name(F.col("n"))).collect()} == names
    phones = {"0391-1234567": True, "+92 391 1234567": True, "00923911234567": True, "3911234567": False, "042-3599": False}
    df = spark.createDataFrame([(n,) for n in phones], "n string")
    assert {r[0]: r[1] for r in df.select("n", fusion.usable_phone(F.col("n"))).collect()} == phones


def test_binding_rule(spark):
    at = lambda d: DAY + timedelta(days=d)
    data = [
        ("N1", "r1", at(1), "c", "Ali Raza", "03911234567", "-5"), ("N1", "r2", at(0), "a", "A. Raza", None, "5,000"), ("N1", "r3", at(9), "b", "Ali Rza", "03911234568", "7000"), ("N1", "r4", at(10), "b", "Ali Raaza", "x", "nil"),
        ("N2", "r5", at(1), "a", "Sara Malik", "03910000000", "1"), (None, "r6", at(1), "a", "X Yz", None, "1"), (None, "r7", at(1), "a", "X Yz", None, "1"),
        ("NTN-AGT-0001", "r8", at(1), "a", "Sara Malik", "03910000000", "1"), ("NTN-AGT-0001", "r9", at(1), "a", "Sara Malik", "03910000000", "1"),
        ("N3", "r10", at(1), None, "Hina Khan", None, None), ("N3", "r11", at(1), None, "Hina Khan", None, None), ("N3", "r12", None, "zz", "Hina Khaan", None, " "),
    ]
    got = fusion.fuse(rows(spark, data), ranks(spark), binding=True).collect()
    assert {(r["ntn"], r["field_name"]): r["record_id"] for r in got} == {("N1", "full_name"): "r4", ("N1", "phone_number"): "r3", ("N1", "declared_income_pkr"): "r2", ("N3", "full_name"): "r10"}
    assert fusion.fuse(rows(spark, []), ranks(spark), binding=True).count() == 0


def test_copies_are_discounted(spark):
    """Source b copies the false values of c; a, d and f are independent and right."""
    data, wrong = [], 0
    for i in range(60):
        true, false = f"100{i}", f"900{i}"
        lie = i % 3 == 0
        wrong += lie
        for s, v in (("a", true), ("d", true), ("f", true), ("b", false if lie else true), ("c", false if lie else true)):
            data.append((f"N{i}", f"{s}{i}", DAY, s, None, None, v))
    stated = fusion.claims(rows(spark, data), ranks(spark)).cache()
    _, accuracy, copying = fusion.estimate(stated)
    copies = {(r["a"], r["b"]): r["copies"] for r in copying.collect()}
    assert copies["b", "c"] > 0.9 and wrong == 20
    fused = {r["ntn"]: r["value"] for r in fusion.fuse(rows(spark, data), ranks(spark)).collect()}
    assert fused == {f"N{i}": f"100{i}" for i in range(60)}
    better = {r["source"]: r["accuracy"] for r in accuracy.collect()}
    assert min(better["a"], better["d"], better["f"]) > max(better["b"], better["c"])
