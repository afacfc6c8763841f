"""Queries for the source and sink operators (S2, S3, S6, S8, S9, S10) and
the URL predicates as separate entries (P6, F7).

Sink queries write a whole driver table into a fresh folder under the
session's shared checkpoint folder, read it back with the matching reader
and return what was read, so the oracle compares the round trip with the
source table.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as PF
from ..operators import clean as C
from ..operators import joins as J
from ..operators import profile as PR
from ..operators import select as S
from ..sources import (parse_json_column, read_csv, read_json_array, read_json_lines, read_lookup, read_table, rows_to_df,
                       write_batches, write_csv, write_json)
from ..streaming.scoring import scratch_paths
from .driver_queries import _URL_PARTS_SQL, _URL_VARIANT, query

_PROPS_SCHEMA = T.StructType([T.StructField("k", T.IntegerType())])


@query("event_props", """
SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def event_props(spark, d):
    ev = read_table(spark, d, "events").select("event_id", "event_type", "props")
    parsed = ev.select("event_id", "event_type", F.from_json("props", _PROPS_SCHEMA).alias("p"))
    return parsed.select("event_id", "event_type", "p.k")


@query("event_props_rows", """
SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def event_props_rows(spark, d):
    """S6 distributed form: a column of JSON objects becomes typed columns."""
    return parse_json_column(read_table(spark, d, "events"), "props", _PROPS_SCHEMA)


@query("csv_roundtrip", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders""")
def csv_roundtrip(spark, d):
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    out_dir, _ = scratch_paths(spark, "csv_roundtrip")
    path = write_csv(read_table(spark, d, "orders").select(*cols), out_dir, "orders", overwrite=True)
    schema = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderpriority STRING"
    return read_csv(spark, path, schema=schema)


@query("json_roundtrip", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def json_roundtrip(spark, d):
    out_dir, _ = scratch_paths(spark, "json_roundtrip")
    path = write_json(read_table(spark, d, "customer"), out_dir, "customer", overwrite=True)
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
                           T.StructField("c_nationkey", T.IntegerType()), T.StructField("c_acctbal", T.DoubleType()),
                           T.StructField("c_mktsegment", T.StringType())])
    return read_json_lines(spark, path, schema)


@query("json_array", """
SELECT o_orderkey, o_totalprice, o_orderpriority || ' "}{[\\' || o_orderstatus AS note, o_custkey AS nested_key FROM orders""")
def json_array(spark, d):
    """S1 in byte ranges: arrays of 1,000 nested objects, with braces and quotes inside their strings."""
    note = F.concat("o_orderpriority", F.lit(' "}{[\\'), "o_orderstatus")
    rows = read_table(spark, d, "orders").select(
        F.expr("o_orderkey div 1000").alias("part"),
        F.to_json(F.struct("o_orderkey", "o_totalprice", note.alias("note"), F.struct(F.col("o_custkey").alias("key")).alias("nested"))).alias("j"))
    arrays = rows.groupBy("part").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("j"), ",\n"), F.lit("\n]")).alias("value"))
    out_dir, _ = scratch_paths(spark, "json_array")
    arrays.select("value").write.mode("overwrite").text(out_dir + "/orders")
    schema = T.StructType.fromDDL("o_orderkey BIGINT, o_totalprice DOUBLE, note STRING, nested STRUCT<key: BIGINT>")
    got = read_json_array(spark, out_dir + "/orders", schema)
    return got.select("o_orderkey", "o_totalprice", "note", F.col("nested.key").alias("nested_key"))


@query("batch_output", """
SELECT o_orderkey, o_totalprice, o_orderkey // 10000 AS batch FROM orders""")
def batch_output(spark, d):
    out_dir, _ = scratch_paths(spark, "batch_output")
    path = write_batches(read_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), out_dir,
                         "o_orderkey", batch_size=10_000, fmt="parquet")
    return spark.read.parquet(path).select("o_orderkey", "o_totalprice", F.col("batch").cast("bigint"))


@query("url_valid", f"""{_URL_PARTS_SQL}
SELECT page_id, u, coalesce(valid, false) AS valid FROM c""")
def url_valid(spark, d):
    u = read_table(spark, d, "pages").select("page_id", F.expr(_URL_VARIANT).alias("u"))
    return u.select("page_id", "u", PF.is_valid_url("u").alias("valid"))


@query("url_id", """
SELECT page_id, url, right(url, 10) AS url_id FROM pages""")
def url_id(spark, d):
    return read_table(spark, d, "pages").select("page_id", "url", PF.url_id("url").alias("url_id"))


@query("lookup_csv", """
SELECT c_custkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def lookup_csv(spark, d):
    """A dimension written as CSV, read with inferred types and joined to the fact table."""
    out_dir, _ = scratch_paths(spark, "lookup_csv")
    nations = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    dim = read_lookup(spark, write_csv(nations, out_dir, "nation", overwrite=True))
    fact = read_table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return J.lookup_join(fact, dim, "c_nationkey").select("c_custkey", "n_name", "n_regionkey")


_STATUS_NAMES = (("F", "finished"), ("O", "open"), ("P", "partly"))


@query("rows_lookup", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partly' END AS status_name
FROM orders""")
def rows_lookup(spark, d):
    """Rows given in the program, with an explicit schema, look up every order."""
    names = rows_to_df(spark, _STATUS_NAMES, "o_orderstatus string, status_name string")
    return J.lookup_join(read_table(spark, d, "orders"), names, "o_orderstatus").select("o_orderkey", "status_name")


@query("prefixed_columns", """
SELECT l_extendedprice AS num_l_extendedprice, l_discount AS num_l_discount, l_tax AS num_l_tax FROM lineitem""")
def prefixed_columns(spark, d):
    """The columns that match a pattern, renamed with a prefix; only they are read from the scan."""
    items = read_table(spark, d, "lineitem")
    return S.prefixed(items, S.columns_matching(items, "l_(extendedprice|discount|tax)"), "num_")


@query("zero_fill", """
SELECT coalesce(nullif(p_size, 7), 0) AS p_size, coalesce(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END, 0) AS price,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS name FROM part""")
def zero_fill(spark, d):
    """Nulls of numeric columns become 0, those of text columns stay."""
    parts = read_table(spark, d, "part").select(
        F.expr("nullif(p_size, 7)").alias("p_size"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END").alias("price"),
        F.expr("CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END").alias("name"))
    return C.fill_numeric_zero(parts)


@query("above_threshold", """
SELECT o_custkey, round(avg(o_totalprice), 4) AS score FROM orders GROUP BY o_custkey HAVING round(avg(o_totalprice), 4) > 150000""")
def above_threshold(spark, d):
    """T5: customers whose mean order value passes a threshold."""
    means = PR.group_mean(read_table(spark, d, "orders"), ["o_custkey"], "o_totalprice", "score")
    return PR.above_threshold(means.select("o_custkey", F.round("score", 4).alias("score")), "score", 150_000)
