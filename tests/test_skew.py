"""Two-level sums and split joins against plain ones."""

import random

from pyspark.sql import functions as F

from lintmill.operators import skew
from tests.conftest import rows


def _ordered(spark):
    rng = random.Random(3)
    data = []
    for key in ("a", "b", "c"):
        for pos in rng.sample(range(500), 120 if key == "a" else 7):
            data.append((key, pos, rng.randint(0, 9), rng.choice([None, None, "x", "y"])))
    return data, spark.createDataFrame(data, "key string, pos int, v int, mark string")


def test_running_total(spark):
    data, df = _ordered(spark)
    expected = sorted(
        (k, p, sum(v for k2, p2, v, _ in data if k2 == k and p2 < p)) for k, p, _, _ in data
    )
    for size in (1, 7, 10_000):
        chunk = skew.chunk_of(F.col("pos"), df.schema["pos"].dataType, size)
        out = skew.running_total(df, ["key"], "pos", "v", "total", chunk)
        assert rows(out, "key", "pos", "total") == expected


def test_carry_forward(spark):
    data, df = _ordered(spark)
    expected = {}
    last = {}
    for k, p, _, mark in sorted(data, key=lambda r: (r[0], r[1])):
        last[k] = mark or last.get(k)
        expected[k, p] = last[k]
    for size in (1, 7, 10_000):
        chunk = skew.chunk_of(F.col("pos"), df.schema["pos"].dataType, size)
        out = skew.carry_forward(df, ["key"], "pos", "mark", "seen", chunk)
        assert {(r.key, r.pos): r.seen for r in out.collect()} == expected


def test_split_joins_equal_plain_join(spark):
    big = spark.range(1000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key")
    )
    other = big.select("key").distinct().union(spark.createDataFrame([("hot",)], "key string")).withColumn(
        "value", F.length("key"))
    plain = rows(big.join(other, "key"), "id", "key", "value")
    counts = big.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    for hot_rows in (5, 100, 10**6):
        assert rows(skew.spread_join(big, other, ["key"], "id", counts, hot_rows), "id", "key", "value") == plain
    assert rows(skew.salted_join(big, other, ["key"], "id"), "id", "key", "value") == plain


def test_hot_key_is_spread_over_partitions(spark):
    big = spark.range(4000).select("id", F.lit("hot").alias("key"))
    other = spark.createDataFrame([("hot", 1)], "key string, value int")
    counts = big.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = skew.spread_join(big, other, ["key"], "id", counts, hot_rows=100)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 4000 and max(sizes) < 2000


def test_grid_join_equals_plain_join(spark):
    def side(n, shift):
        key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 20 + shift))
        return spark.range(n).select(key.alias("key"), F.col("id").alias(f"v{shift}"))

    left, right = side(600, 0), side(400, 10)
    count = lambda df: df.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    plain = rows(left.join(right, "key"), "key", "v0", "v10")
    assert len(plain) > 200 * 130
    for hot_rows in (10, 50, 150, 10**6):  # hot on both sides, on one, on none
        out = skew.grid_join(left, right, ["key"], "v0", ["v10"], count(left), count(right), hot_rows)
        assert out.columns == ["key", "v0", "v10"] and rows(out) == plain
    none = left.limit(0)
    assert skew.grid_join(none, right, ["key"], "v0", "v10", count(none), count(right), 5).count() == 0


def test_key_hot_on_both_sides_is_spread_over_partitions(spark):
    left = spark.range(1000).select(F.lit("hot").alias("key"), F.col("id").alias("a"))
    right = spark.range(1000).select(F.lit("hot").alias("key"), F.col("id").alias("b"))
    count = lambda df: df.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
                "spark.sql.shuffle.partitions": "200"}
    kept = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = skew.grid_join(left, right, ["key"], "a", "b", count(left), count(right), hot_rows=100)
        seen = out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("a").alias("a"), F.count_distinct("b").alias("b")).collect()
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(r.n for r in seen) == 1_000_000
    assert len(seen) > 50 and max(r.n for r in seen) < 60_000  # a cell has about 10,000 pairs


def test_first_rows_are_limited_before_the_shuffle(spark):
    df = spark.range(100).select("id", (F.col("id") % 4).alias("key"))
    out = skew.first_rows(df, ["key"], ["id"], 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan
    assert out.count() == 12
