"""Operators that must hold on tables of many partitions and with one hot group."""

from __future__ import annotations

import pytest
from millrace.operators import records, strategies
from millrace.sources import staging
from pyspark.sql import functions as F


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_ranks_of_a_large_table(spark, coalesce):
    rows = 1_200_000
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        table = spark.range(rows).select(F.xxhash64("id").alias("k"), (F.col("id") % 7).alias("label"))
        out = staging.stage_table(records.ranked(table, ["k"]), "test").agg(F.countDistinct("rank").alias("d"), F.min("rank").alias("a"), F.max("rank").alias("b")).first()
        assert (out["d"], out["a"], out["b"]) == (rows, 1, rows)
        assert records.window_distinct(table, "label", ["k"], 64).agg(F.count("*"), F.min("n_rows")).first() == (rows // 64, 64)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_ranks_within_groups_of_any_size(spark):
    table = spark.range(50_000).select("id", F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 11).cast("string")).alias("g"))
    out = records.group_ranked(table, ["g"], ["id"])
    wrong = out.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.min("rank").alias("a"), F.max("rank").alias("b"), F.corr("id", "rank").alias("c"))
    assert wrong.where("n <> d or a <> 1 or b <> n or c < 0.9").count() == 0 and out.count() == 50_000
    assert records.ranked(table.limit(0), ["id"]).count() == 0


def test_samples_of_too_few_rows(spark):
    table = spark.range(5).select("id", F.lit("s").alias("g"))
    assert records.stratified_sample(table, ["g"], "id", 1, 10).count() == 5
    with pytest.raises(ValueError):
        records.stratified_sample(table, ["g"], "id", 1, 10, exact=True).count()


def test_running_sums(spark):
    table = spark.range(100_000).select(F.xxhash64("id").alias("k"), F.when(F.col("id") % 10 > 0, F.col("id") % 5).alias("v"))
    out = records.running_sum(table, ["k"], "v", "total")
    rows = out.orderBy("k").select("v", "total").collect()
    total = 0
    for r in rows:
        total += r["v"] or 0
        assert r["total"] == total


def test_orders_by_name(spark):
    table = spark.range(60).select("id", F.when(F.col("id") < 40, "a").when(F.col("id") < 55, "b").otherwise("c").alias("g"))
    for name in strategies.ORDERS:
        rows = strategies.ordered(table, name, "g", "id", 3).orderBy("position").collect()
        assert [r["position"] for r in rows] == list(range(1, 61)) and set(rows[0].asDict()) == {"id", "g", "position"}
        if name == "round_robin":
            assert [r["g"] for r in rows[:6]] == ["a", "b", "c"] * 2
        if name == "even":
            assert {r["g"] for r in rows[:12]} == {"a", "b", "c"}
    with pytest.raises(ValueError):
        strategies.ordered(table, "other", "g", "id")
    with pytest.raises(ValueError):
        strategies.register(strategies.ORDERS, "even", None)
