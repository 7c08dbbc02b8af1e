import json

import pytest

from daftar.plans import pipeline
from daftar.sources import files, synthetic
from daftar.streaming import incremental


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('name,note\r\n Ali ,"x ""y"", z"\r\n,\r\n"two\nlines", \r\n', encoding="utf-8")
    got = files.read_csv(spark, str(path)).collect()
    assert [(r["source_row_id"], r["name"], r["note"]) for r in got] == [("1", "Ali", 'x "y", z'), ("2", "two\nlines", "")]


def test_json_and_requests(spark, tmp_path):
    tables, mappings = files.from_request(spark, {"datasets": {"tax.csv": [{"full_name": "M Ahmed", "income": 5}, {"full_name": None, "id": "x"}], "empty": []}, "mappings": {"tax.csv": {"_kind": "tax"}}})
    assert {r["source_row_id"]: r["full_name"] for r in tables["tax.csv"].collect()} == {"1": "M Ahmed", "x": None}
    assert tables["empty"].count() == 0 and mappings == {"tax.csv": {"_kind": "tax"}}
    for bad in (None, {"datasets": []}, {"datasets": {"a": {}}}, {"datasets": {"a": [1]}}):
        with pytest.raises(ValueError, match="must be"):
            files.from_request(spark, bad)
    files.write_report(tables["tax.csv"].select("full_name"), str(tmp_path / "r"), "2024-01-01T00:00:00Z")
    assert {r["generated_at"] for r in files.read_jsonl(spark, str(tmp_path / "r")).collect()} == {"2024-01-01T00:00:00Z"}
    assert json.loads(files.as_json(tables["tax.csv"]).first()["json"])


def test_synthetic_is_repeatable_and_resolves(spark):
    tables = synthetic.tables(spark, 12, 42)
    again = synthetic.tables(spark, 12, 42)
    assert all(sorted(map(str, tables[n].collect())) == sorted(map(str, again[n].collect())) for n in tables)
    result = pipeline.run(tables)
    quality = result.quality.first()
    assert quality["precision"] >= 0.9 and quality["f1"] >= 0.85
    assert result.records.count() > 24 and result.entities.count() > 5
    assert pipeline.compact(result)["entities"].count() == result.entities.count()
    assert result.nodes.filter("node_type = 'Person'").count() == result.entities.count()


def test_benchmark(spark):
    out = pipeline.benchmark(spark, 30)
    assert out["records"] > 60 and out["records_per_s"] > 0 and set(out["timings_ms"]) == {"ingestion", "entity_resolution", "graph", "aggregation"}


def test_arriving_records_make_the_same_entities(spark, tmp_path):
    result = pipeline.run(synthetic.tables(spark, 10, 1))
    records = result.records
    schema = records.schema
    for i, (low, high) in enumerate((("a", "e"), ("e", "z"))):
        records.filter(f"source_dataset >= '{low}' and source_dataset < '{high}'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        incremental.follow(stream, str(tmp_path / "state"), str(tmp_path / "ck")).awaitTermination(120)
    parts = lambda df: {tuple(r["record_ids"]) for r in df.collect()}
    assert parts(incremental.entities_so_far(spark, str(tmp_path / "state"))) == parts(result.entities)
