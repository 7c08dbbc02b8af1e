import csv
import io
import random
import re

from pyspark.sql import functions as F

from daftar.sources import rejects

LAYOUT = {"x.csv": (["a", "n", "c"], "n")}
GOOD = re.compile(r"\s*(?:(?:pkr|rs\.?)\s*)?[0-9][0-9,]*(?:\.[0-9]+)?\s*(?:/-)?\s*", re.I)


def by_hand(line):
    """A character machine that knows nothing of patterns."""
    if not line:
        return "columns"
    line = line[:-1] if line.endswith("\r") else line
    if not line:
        return "columns"
    cells, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            i, cell = i + 1, ""
            while True:
                j = line.find('"', i)
                if j < 0:
                    return "quoting"
                cell += line[i:j]
                if line[j + 1 : j + 2] == '"':
                    cell, i = cell + '"', j + 2
                    continue
                i = j + 1
                break
            if i < len(line) and line[i] != ",":
                return "quoting"
        else:
            j = line.find(",", i)
            j = len(line) if j < 0 else j
            cell, i = line[i:j], j
            if '"' in cell:
                return "quoting"
        cells.append(cell)
        if i >= len(line):
            break
        i += 1
    if len(cells) != 3:
        return "columns"
    return "value" if cells[1].strip() and not GOOD.fullmatch(cells[1]) else None


def test_lines_against_a_machine(spark):
    rng = random.Random(7)
    pieces = ['"', '""', ",", "a", "5", "Rs. 7", "x y", "\n", "\r", ""]
    lines = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + [None, "", "\r", "a,5,b", 'a,"5",b', 'a,"x""y",b', "a,-5,b", 'a,,"', "a,5,b,", 'a,"1,200/-","q""r"']
    df = spark.createDataFrame([(i, "x.csv", s) for i, s in enumerate(lines)], "record_id int, file_name string, line string")
    got = {r["record_id"]: r["reason"] for r in rejects.checked_lines(df, LAYOUT).collect()}
    assert {i: by_hand(s) for i, s in enumerate(lines)} == got


def test_long_and_many_quotes(spark):
    lines = ["a,5," + "z" * 300_000, 'a,5,"' + 'he said ""so"" ' * 20_000 + '"', 'a,5,"' + "z" * 300_000]
    df = spark.createDataFrame([(i, "x.csv", s) for i, s in enumerate(lines)], "record_id int, file_name string, line string")
    got = {r["record_id"]: r["reason"] for r in rejects.checked_lines(df, LAYOUT).collect()}
    assert got == {0: None, 1: None, 2: "quoting"}


def test_round_trip_of_good_rows(spark):
    rows = [["k,1", "1,200", 'say "so"'], ["k2", "", "two\nlines"], ["k3", " Rs. 85.50 /-", ""], ["", "PKR 7", "é"]]
    out = []
    for i, row in enumerate(rows):
        text = io.StringIO()
        csv.writer(text, lineterminator="").writerow(row)
        out.append((i, "x.csv", text.getvalue()))
    df = spark.createDataFrame(out, "record_id int, file_name string, line string").withColumn("reason", F.lit("clash"))
    got = rejects.good_rows(df, "x.csv", LAYOUT).orderBy("record_id").collect()
    assert [(r["a"], r["c"]) for r in got] == [(a, c) for a, _, c in rows]
    assert [r["n"] for r in got] == [1200.0, None, 85.5, 7.0]


def test_broken_field_and_unknown_file(spark):
    df = spark.createDataFrame([(1, "x.csv", 'a,"5"x,b'), (2, "x.csv", "a,5"), (3, "y.csv", "a,b"), (4, "y.csv", 'a"'), (5, "x.csv", "a,5,b,c"), (6, None, "a")], "record_id int, file_name string, line string")
    got = {r["record_id"]: (r["reason"], r["broken_field"]) for r in rejects.checked_lines(df, LAYOUT).collect()}
    assert got == {1: ("quoting", 2), 2: ("columns", 3), 3: (None, None), 4: ("quoting", 1), 5: ("columns", 4), 6: (None, None)}


def test_amounts(spark):
    good = ["5", " 1,234 ", "2,11,300", "Rs.5", "rs 5/-", "PKR 5.50", "878020.00", " 5"]
    bad = ["-5", "(5)", "5k", "1.2.3", ",", "Rs.", "/-", "5 $", "++5", "1e5", "5/5", "5-6", ".", "nil"]
    df = spark.createDataFrame([(s,) for s in [*good, *bad, None, "", "  "]], "n string")
    got = {r["n"]: r["b"] for r in df.select("n", rejects.bad_amount(F.col("n")).alias("b")).collect()}
    assert {s for s, b in got.items() if b} == set(bad)
    assert rejects.rejected_cells(df.withColumn("record_id", F.lit("r")), "n").count() == len(bad)


def test_empty_table(spark):
    df = spark.createDataFrame([], "record_id int, file_name string, line string")
    assert rejects.checked_lines(df).count() == 0
