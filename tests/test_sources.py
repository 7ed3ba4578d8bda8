"""Readers and writers on temporary files."""

from __future__ import annotations

import json

import pyarrow as pa
import pytest
from millrace.sources import readers, writers
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "b.json").write_text('[{"x": 1},\n {"x": 3}]')
    (tmp_path / "c.json").write_text(json.dumps({"k1": {"v": 1}, "k2": {"v": 2}}, indent=1))
    (tmp_path / "d.csv").write_text("Unnamed: 0,net\n0,a\n1,b\n")
    assert sorted(r["x"] for r in readers.json_rows(spark, str(tmp_path / "a.jsonl")).collect()) == [1, 2]
    assert sorted(r["x"] for r in readers.json_rows(spark, str(tmp_path / "b.json")).collect()) == [1, 3]
    assert sorted(map(tuple, readers.json_objects(spark, str(tmp_path / "c.json"), "struct<v:int>").collect())) == [("k1", 1), ("k2", 2)]
    assert readers.csv(spark, str(tmp_path / "d.csv")).columns == ["net"]


def test_logs_and_arrow(spark, tmp_path):
    (tmp_path / "log.txt").write_text("noise\n{'loss': 1.5, 'step': 3}\n{'loss': 1.0, 'step': 4}\n")
    log = readers.literal_log(spark, str(tmp_path / "log.txt"), "{'loss'", "loss double, step int")
    assert sorted(map(tuple, log.collect())) == [(1.0, 4), (1.5, 3)]
    table = pa.table({"a": [1, 2, 3], "b": ["x", "y", "z"]})
    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as sink, pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    spark.dataSource.register(readers.ArrowStreamSource)
    got = spark.read.format("arrow_stream").schema("b string").load(str(tmp_path / "*.arrow"))
    assert sorted(r["b"] for r in got.collect()) == ["x", "y", "z"]


def test_checkpoints(spark, tmp_path):
    for step, files in ((10, 2), (20, 1)):
        (tmp_path / f"checkpoint-{step}").mkdir()
        for i in range(files):
            (tmp_path / f"checkpoint-{step}" / f"f{i}").write_text("x")
    found = readers.checkpoints(spark, str(tmp_path))
    assert sorted((r["step"], r["n_files"]) for r in found.collect()) == [(10, 2), (20, 1)]
    assert readers.latest(found, least_files=2).first()["step"] == 10


def test_synthetic_labels(spark):
    for kind in ("uniform", "zipf", "few"):
        counts = {r["label"]: r["count"] for r in readers.synthetic_labels(spark, 10, 1000, kind).groupBy("label").count().collect()}
        assert 900 <= sum(counts.values()) <= 1100 and len(counts) == (3 if kind == "few" else 10)


def test_sinks(spark, tmp_path):
    df = spark.range(10).select("id", F.when(F.col("id") < 7, "train").otherwise("test").alias("split"), F.lit(1).alias("_hidden"))
    path = str(tmp_path / "shards")
    writers.shards(df, path, rows=3)
    writers.shards(df.where("split = 'test'").withColumn("id", F.col("id") + 100), path, rows=3)
    back = readers.parquet(spark, path, ["id"], "train")
    assert back.count() == 7 and sorted(r["id"] for r in readers.parquet(spark, path, ["id"], "test").collect()) == [107, 108, 109]
    writers.snapshot(df, str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap")).columns == ["id", "split"]
    with pytest.raises(AnalysisException):
        writers.snapshot(df, str(tmp_path / "snap"))
    writers.json_lines(df, str(tmp_path / "lines"))
    writers.json_lines(df, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 20
    writers.report(df.withColumn("m", F.create_map(F.lit("a"), F.lit(1))), str(tmp_path / "report"), [F.desc("id")])
    assert spark.read.option("header", True).csv(str(tmp_path / "report" / "table")).count() == 10
    union = writers.union_of_columns([spark.range(1), spark.range(1).withColumn("extra", F.lit(2))])
    assert sorted(union.columns) == ["extra", "id"] and union.count() == 2


def test_trial_store(spark):
    url = "jdbc:derby:memory:trials;create=true"
    rows = [(1, "COMPLETE", 0.5), (2, "RUNNING", None), (3, "COMPLETE", None), (4, "COMPLETE", 0.9)]
    spark.createDataFrame(rows, "number int, state string, value double").write.format("jdbc").option("url", url).option("dbtable", "trials").option("createTableColumnTypes", "state VARCHAR(20)").save()
    assert sorted(r["number"] for r in readers.trials(spark, url, "trials").collect()) == [1, 4]
    assert sorted(r["number"] for r in readers.trials(spark, url, "trials", "number", (1, 5, 2)).collect()) == [1, 4]


def test_named_shards(spark, tmp_path):
    rows = spark.range(10).coalesce(1).select("id", F.when(F.col("id") < 7, "train").otherwise("test").alias("split"))
    path = str(tmp_path / "named")
    assert writers.named_shards(rows, path, rows=3) == ["test-00000.parquet", "train-00000.parquet", "train-00001.parquet", "train-00002.parquet"]
    assert writers.named_shards(rows.where("id < 2"), path, rows=3) == ["train-00000.parquet"]
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [0, 1, 7, 8, 9]
