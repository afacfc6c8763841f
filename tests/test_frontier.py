"""URL frontier (H7–H9, J4, J5, P7, P8); trap G21."""

import datetime as dt

from pyspark.sql import functions as F


from plotline.operators import frontier as FR
from tests.pages_fixtures import LISTING_PAGE

URLS = [f"https://nha.example.vn/tin-{i}-16575278{i:02d}" for i in range(6)]


def frontier(spark):
    return FR.urls_to_frontier(spark.createDataFrame([(u,) for u in URLS], "url string"))


def test_urls_to_frontier_defaults(spark):
    rows = frontier(spark).orderBy("url").collect()
    assert rows[0].id == 1657527800 and rows[0].crawled == 0 and rows[0].status == "available"
    assert rows[0].crawlingDate is None


def test_only_uncrawled_and_slice(spark):
    f = frontier(spark).withColumn("crawled", F.when(F.col("id") % 2 == 0, 1).otherwise(0))
    assert FR.only_uncrawled(f).count() == 3
    assert FR.only_uncrawled(f, recrawl=True).count() == 6
    s = FR.slice_rows(f, ["id"], 1, 4).orderBy("id").collect()
    assert [r.id % 100 for r in s] == [1, 2, 3]
    assert FR.slice_rows(f, ["id"]) is f                      # default: whole table, no job


def test_row_range_over_many_partitions(spark):
    f = (spark.range(1000).repartition(7)
         .select(F.when(F.col("id") > 2, F.col("id") % 10).alias("g"), F.col("id").alias("n"), F.lit("x").alias("wide")))
    rows = sorted(((r.g is not None, r.g or 0, r.n) for r in f.collect()))
    for a, b in ((1, 4), (0, 3), (250, 700), (998, None), (999, 5000), (1000, None), (5, 5), (7, 3)):
        got = sorted(((r.g is not None, r.g or 0, r.n) for r in FR.slice_rows(f, ["g", "n"], a, b).collect()))
        assert got == rows[a:b], (a, b)
    assert FR.slice_rows(f.where("n < 0"), ["g", "n"], 0, 3).count() == 0


def test_tied_attempts_give_one_record_and_no_body_in_the_update(spark, tmp_path):
    at = dt.datetime(2022, 7, 11, 15, 0)
    other = LISTING_PAGE.replace("88123", "88999")
    log = [(URLS[0], 200, at, p) for p in (LISTING_PAGE, other, LISTING_PAGE, other)]
    seen = set()
    for parts in (1, 3):
        fetched = spark.createDataFrame(log, "url string, status_code int, fetched_at timestamp, html string")
        fetched.repartition(parts).write.parquet(str(tmp_path / str(parts)))
        records, updated = FR.crawl_pass(frontier(spark), spark.read.parquet(str(tmp_path / str(parts))))
        seen.add(tuple(r.MaTin for r in records.collect()))
        assert "html" not in updated._jdf.queryExecution().executedPlan().toString()
    assert len(seen) == 1 and len(next(iter(seen))) == 1


def test_merge_never_overwrites_with_null(spark):
    old = spark.createDataFrame([("u1", "a", 1), ("u2", "b", 2)], "url string, status string, n int")
    new = spark.createDataFrame([("u1", None, 5), ("u3", "zz", 9)], "url string, status string, n int")
    got = {r.url: (r.status, r.n) for r in FR.merge_frontier(old, new).collect()}
    assert got == {"u1": ("a", 5), "u2": ("b", 2)}           # G21; unknown URL ignored


def test_new_urls(spark):
    prev = spark.createDataFrame([(URLS[0],), (URLS[1],)], "url string")
    cur = frontier(spark)
    assert sorted(r.url for r in FR.new_urls(cur, prev).collect()) == sorted(URLS[2:])


def test_crawl_pass(spark):
    f = frontier(spark).withColumn("crawled", F.when(F.col("url") == URLS[5], 1).otherwise(0))
    at = dt.datetime(2022, 7, 11, 15, 24, 32)
    fetched = spark.createDataFrame(
        [(URLS[0], 200, at, LISTING_PAGE), (URLS[1], 404, at, None), (URLS[5], 200, at, LISTING_PAGE)],
        "url string, status_code int, fetched_at timestamp, html string")
    records, updated = FR.crawl_pass(f, fetched)
    rec = records.collect()
    assert len(rec) == 1 and rec[0].id == 1657527800 and rec[0].MaTin == "88123"
    got = {r.url: r for r in updated.collect()}
    assert got[URLS[0]].crawled == 1 and got[URLS[0]].status == "available" and got[URLS[0]].crawlingDate == at
    assert got[URLS[1]].crawled == 1 and got[URLS[1]].status == "unavailable" and got[URLS[1]].crawlingDate is None
    assert got[URLS[2]].crawled == 0                          # not fetched: unchanged
    assert got[URLS[5]].crawlingDate is None                  # already crawled: skipped (recrawl=False)
    assert updated.count() == 6


def test_page_range_urls_chunked(spark):
    df = spark.createDataFrame([(1, "https://x.vn/a", 25), (2, "https://x.vn/b", 0), (3, "https://x.vn/c", 3)],
                               "k long, base string, last long")
    out = FR.page_range_urls(df, ["k"], "base", "last", chunk=10).collect()
    pages = sorted((r.k, r.page) for r in out)
    assert pages == [(1, p) for p in range(1, 26)] + [(3, p) for p in range(1, 4)]
    assert {r.url for r in out if r.k == 3} == {f"https://x.vn/c?page={p}" for p in (1, 2, 3)}


def test_retried_fetches_use_latest_attempt(spark):
    f = frontier(spark)
    early, late = dt.datetime(2022, 7, 11, 9, 0), dt.datetime(2022, 7, 11, 10, 0)
    fetched = spark.createDataFrame(
        [(URLS[0], 500, early, None), (URLS[0], 200, late, LISTING_PAGE), (URLS[1], 200, early, LISTING_PAGE),
         (URLS[1], 404, late, None)], "url string, status_code int, fetched_at timestamp, html string")
    records, updated = FR.crawl_pass(f, fetched)
    got = {r.url: r for r in updated.collect()}
    assert updated.count() == 6                                   # no duplicated frontier rows
    assert got[URLS[0]].status == "available" and got[URLS[0]].crawlingDate == late
    assert got[URLS[1]].status == "unavailable"
    assert [r.id for r in records.collect()] == [1657527800]


def test_huge_range_is_expanded_by_many_tasks(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1, "https://x.vn/hot", 50_000), (2, "https://x.vn/cold", 2)],
                               "k long, base string, last long")
    out = FR.page_range_urls(df, ["k"], "base", "last", chunk=1_000)
    per_task = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in per_task) == 50_002
    assert len(per_task) > 1 and max(r["count"] for r in per_task) < 50_000


def test_crawl_pass_slice_updates_only_the_slice(spark):
    f = frontier(spark)
    at = dt.datetime(2022, 7, 11, 15, 0)
    fetched = spark.createDataFrame([(u, 200, at, LISTING_PAGE) for u in URLS],
                                    "url string, status_code int, fetched_at timestamp, html string")
    records, updated = FR.crawl_pass(f, fetched, from_idx=1, to_idx=3)     # ordered by (id, url)
    crawled = sorted(r.id % 100 for r in updated.where("crawled = 1").collect())
    assert crawled == [1, 2] and updated.count() == 6
    assert sorted(r.id % 100 for r in records.collect()) == [1, 2]


def test_attempt_without_status_and_missing_time(spark):
    old = dt.datetime(2022, 7, 1, 8, 0)
    f = (frontier(spark).withColumn("crawlingDate", F.when(F.col("url") == URLS[2], F.lit(old)))
         .withColumn("crawled", F.lit(0)))
    fetched = spark.createDataFrame(
        [(URLS[0], None, dt.datetime(2022, 7, 11, 9, 0), None), (URLS[2], 200, None, LISTING_PAGE)],
        "url string, status_code int, fetched_at timestamp, html string")
    _, updated = FR.crawl_pass(f, fetched)
    got = {r.url: r for r in updated.collect()}
    assert got[URLS[0]].crawled == 1 and got[URLS[0]].status == "unavailable"   # an attempt, even without status
    assert got[URLS[2]].crawled == 1 and got[URLS[2]].crawlingDate == old      # null time never overwrites
