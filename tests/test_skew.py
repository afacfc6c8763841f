"""A key holding a third of all rows: joins on it are split by adaptive
execution (skew join) and aggregates stay exact."""

import pytest
from pyspark.sql import functions as F

from plotline.operators import encode as E
from plotline.operators import profile as PR

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.fixture
def skewed_orders(spark, tmp_dir):
    n = 60_000
    df = spark.range(n).select(
        F.col("id").alias("o_orderkey"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000 + 10).alias("o_custkey"),
        (F.col("id") % 97).cast("double").alias("o_totalprice"))
    path = f"{tmp_dir}/orders"
    df.repartition(8).write.parquet(path)
    return spark.read.parquet(path)


def test_hot_key_join_is_split_and_exact(spark, skew_conf, skewed_orders):
    levels = E.fit_activity_levels(skewed_orders, "o_custkey")
    out = E.apply_activity_levels(skewed_orders, levels, "o_custkey", keep_input=True)
    rows = out.collect()                                                  # run this plan, then read its final form
    assert len(rows) == 60_000 and len({r.o_orderkey for r in rows}) == 60_000   # nothing lost or duplicated
    assert {r.o_custkey_level for r in rows if r.o_custkey == 7} == {4.0}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan                                           # AQE split the hot partition


def test_hot_key_group_share_is_exact(spark, skew_conf, skewed_orders):
    shares = {r.hot: (r.n, r.share) for r in PR.group_share(
        skewed_orders.withColumn("hot", F.col("o_custkey") == 7), ["hot"], digits=6).collect()}
    assert shares[True] == (20_000, pytest.approx(1 / 3, abs=1e-6))
    assert shares[False][0] == 40_000


def test_group_counts_join_and_anti_join_split_hot_key(spark, skew_conf, skewed_orders):
    from plotline.operators import frontier as FR
    from plotline.operators import joins as J
    counted = J.join_group_counts(skewed_orders, "o_custkey")
    rows = counted.collect()
    assert len(rows) == 60_000 and {r["count"] for r in rows if r.o_custkey == 7} == {20_000}
    assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    previous = skewed_orders.where(F.col("o_custkey") != 7).select(F.col("o_custkey").alias("url"))
    current = skewed_orders.select(F.col("o_custkey").alias("url"), "o_orderkey")
    fresh = FR.new_urls(current, previous)
    assert fresh.count() == 20_000
