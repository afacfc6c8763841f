"""Join and partitioning helpers."""

from plotline.operators import joins as J
from plotline.operators.partitioning import by_key


def test_lookup_join_takes_no_size_check_job(spark):
    fact = spark.range(0, 1000).withColumnRenamed("id", "k")
    dim = spark.range(0, 10).withColumnRenamed("id", "k")
    out = J.lookup_join(fact, dim, "k")
    assert "ResolvedHint" not in out._jdf.queryExecution().analyzed().toString()   # the strategy is Spark's choice
    assert out.count() == 1000


def test_join_group_counts_drops_null_keys(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    got = sorted((r.k, r["count"]) for r in J.join_group_counts(df, "k").collect())
    assert got == [("a", 2), ("a", 2), ("b", 1)]


def test_layout_follows_keys_only(spark):
    rows = spark.range(0, 100, 1, 1)
    dealt = by_key(rows, "id")
    assert dealt.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    other = by_key(spark.range(0, 100, 1, 5), "id")
    assert [sorted(p) for p in dealt.rdd.glom().collect()] == [sorted(p) for p in other.rdd.glom().collect()]
