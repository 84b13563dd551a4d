import json

import pytest
from pyspark.sql import functions as F

from chronolith.sources import config, markdown, tables
from chronolith.streaming import events


def test_config(tmp_path):
    (tmp_path / "list.yaml").write_text("- a\n")
    with pytest.raises(ValueError, match="mapping"):
        config.load_yaml(tmp_path / "list.yaml")
    with pytest.raises(FileNotFoundError):
        config.load_yaml(tmp_path / "none.yaml")
    with pytest.raises(ValueError, match="processed_dir"):
        config.storage_paths({"storage": {"raw_dir": "r"}})
    found = {"sources": [{"source_id": "s", "kind": "rss_feed", "allow": ["a"]}]}
    assert config.source_by_id(found, "s")["kind"] == "rss_feed" and config.source_rules(found)[0].allow == ("a",)
    with pytest.raises(KeyError):
        config.source_by_id(found, "t")
    (tmp_path / "o.yaml").write_text("scoring: {title_weight: 3}\nontology: {X: {positive_patterns: [a], min_score: 2}}\n")
    rules = config.load_ontology(tmp_path / "o.yaml")
    assert rules.title_weight == 3 and rules.rules[0].min_score == 2


def test_round_trips(spark, tmp_path):
    rows = spark.createDataFrame([("2019-01", 'a "b", c\nd'), ("2019-02", None)], "month_id string, v string")
    tables.write_csv(rows, str(tmp_path / "csv"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "csv"), "month_id string, v string").collect())) == sorted(map(tuple, rows.collect()))
    good = {"pdf_url": "u", "saved_path": "p", "status": "success"}
    (tmp_path / "m.jsonl").write_text("\n{broken\n" + json.dumps(good) + "\n" + json.dumps(good | {"saved_path": ""}) + "\n")
    assert tables.succeeded(tables.read_manifest(spark, str(tmp_path / "m.jsonl"))).count() == 1
    (tmp_path / "d.md").write_text("# x\n- 2024-01\n- other\n- 2024-02 \n")
    assert sorted(r[0] for r in tables.listed_months(spark, str(tmp_path / "d.md")).collect()) == ["2024-01", "2024-02"]
    (tmp_path / "snap").mkdir()
    (tmp_path / "snap" / "a.html").write_bytes(b"abc")
    got = tables.snapshot_files(spark, str(tmp_path / "snap")).first()
    assert got["sha256"].startswith("ba7816bf") and got["bytes"] == 3
    text = markdown.dictionary({"t": (rows, "month_id")})
    assert "| v | string | 1 | 50.0 |" in text


def test_streaming_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(k, "a" if k % 2 else "b", float(k)) for k in range(40)], "k long, event_type string, value double")
    rows = rows.withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("k") * 10_000)).drop("k")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    live = events.day_counts(events.stream(spark, str(tmp_path / "in"), "event_type string, value double, ts timestamp"))
    events.run_once(live, "days", str(tmp_path / "ck"))
    assert sorted(map(tuple, spark.table("days").collect())) == sorted(map(tuple, events.day_counts(rows).collect()))
    batch = spark.createDataFrame([("u", 1), ("u", 2), ("v", 1)], "pdf_url string, n int")
    for _ in range(2):
        events.append_new(batch, str(tmp_path / "log"), "pdf_url")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
