"""Queries over the driver's tables, one per operator group of the inventory.

Every query reads whole tables from a scale-factor folder.  Where an
operator needs dirty listing-style input (unit text, sentinels, nulls), that
input is *derived inside the query* from numeric columns, with the same SQL
expression text on both sides of the oracle check, so the operator itself
is what gets compared.

Each entry is ``Q(spark_fn, oracle_sql)``; ``oracle_sql`` is DuckDB SQL over
the pre-registered views, or ``None`` where SQL cannot state the rows.
Fitted trees and scores, which SQL cannot compute, are returned as their gap
from a recomputation over every row, which SQL expects to be zero.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as PF
from ..operators import clean as C
from ..operators import counted as N
from ..operators import encode as E
from ..operators import evaluate as V
from ..operators import frontier as FR
from ..operators import pages as PG
from ..operators import profile as PR
from ..operators import select as S
from ..operators.models import fit_regressor
from ..operators.partitioning import by_key
from ..schema import ListingColumns
from ..sources import read_table


@dataclass(frozen=True)
class Q:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Q] = {}


def query(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = Q(fn, sql)
        return fn
    return deco


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, d, name)


# ---------------------------------------------------------------------------
# Dashboard aggregates
# ---------------------------------------------------------------------------

def _orders_per_customer(spark, d) -> DataFrame:
    """Orders pre-aggregated per customer, then joined to the customer row.

    Aggregating before the join means a customer with a third of all orders
    contributes one row per map task to the shuffle, and the join moves
    #customers rows instead of #orders rows.
    """
    per_cust = (_t(spark, d, "orders").groupBy("o_custkey")
                .agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("price_sum"),
                     F.count("o_totalprice").alias("n_price")))
    cust = _t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return per_cust.join(cust, per_cust.o_custkey == cust.c_custkey, "inner")


@query("dash_totals", """
SELECT count(*)::BIGINT AS n_rows,
       round_even(avg(o_totalprice) * 1000, 0)::BIGINT AS avg_price_scaled,
       format('{:,}', round_even(avg(o_totalprice) * 1000, 0)::BIGINT) AS avg_price_text
FROM orders""")
def dash_totals(spark, d):
    return PR.totals(_t(spark, d, "orders"), "o_totalprice", 1000.0)


@query("dash_grid", """
SELECT n_name, c_mktsegment, count(*)::BIGINT AS n
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name, c_mktsegment""")
def dash_grid(spark, d):
    nation = _t(spark, d, "nation").select("n_nationkey", "n_name")
    j = _orders_per_customer(spark, d).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "c_mktsegment").agg(F.sum("n").cast("bigint").alias("n"))


@query("dash_avg", """
SELECT c_mktsegment, round(avg(o_totalprice), 2) AS avg_price
FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY c_mktsegment""")
def dash_avg(spark, d):
    j = _orders_per_customer(spark, d)
    return j.groupBy("c_mktsegment").agg(F.round(F.sum("price_sum") / F.sum("n_price"), 2).alias("avg_price"))


@query("dash_share", """
SELECT c_mktsegment, count(*)::BIGINT AS n,
       round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY c_mktsegment""")
def dash_share(spark, d):
    j = _orders_per_customer(spark, d)
    counts = j.groupBy("c_mktsegment").agg(F.sum("n").cast("bigint").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.round(F.col("n") / total, 6))


# ---------------------------------------------------------------------------
# Missing data
# ---------------------------------------------------------------------------

_DIRTY_CUSTOMER = {
    "name_s": "CASE WHEN c_custkey % 7 = 0 THEN '--' WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END",
    "seg_s": "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END",
    "bal": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END",
    "nation_s": "CASE WHEN c_nationkey = 0 THEN '--' ELSE CAST(c_nationkey AS STRING) END",
}


def _sel(df: DataFrame, keep, derived: dict) -> DataFrame:
    return df.select(*keep, *[F.expr(e).alias(n) for n, e in derived.items()])


def _sql_cols(derived: dict) -> str:
    return ",\n       ".join(f"{e} AS {n}" for n, e in derived.items())


@query("null_profile", f"""
WITH d AS (SELECT c_custkey, {_sql_cols(_DIRTY_CUSTOMER)} FROM customer)
SELECT count(*) FILTER (WHERE c_custkey IS NULL)::BIGINT AS c_custkey,
       count(*) FILTER (WHERE name_s IS NULL OR name_s IN ('--', ''))::BIGINT AS name_s,
       count(*) FILTER (WHERE seg_s IS NULL OR seg_s IN ('--', ''))::BIGINT AS seg_s,
       count(*) FILTER (WHERE bal IS NULL)::BIGINT AS bal,
       count(*) FILTER (WHERE nation_s IS NULL OR nation_s IN ('--', ''))::BIGINT AS nation_s
FROM d""")
def null_profile(spark, d):
    dirty = _sel(_t(spark, d, "customer"), ["c_custkey"], _DIRTY_CUSTOMER)
    return C.count_nulls(C.blank_to_null(dirty))


@query("null_profile_long", f"""
WITH d AS (SELECT c_custkey, {_sql_cols(_DIRTY_CUSTOMER)} FROM customer),
w AS (SELECT count(*) FILTER (WHERE c_custkey IS NULL)::BIGINT AS c_custkey,
             count(*) FILTER (WHERE name_s IS NULL OR name_s IN ('--', ''))::BIGINT AS name_s,
             count(*) FILTER (WHERE seg_s IS NULL OR seg_s IN ('--', ''))::BIGINT AS seg_s,
             count(*) FILTER (WHERE bal IS NULL)::BIGINT AS bal,
             count(*) FILTER (WHERE nation_s IS NULL OR nation_s IN ('--', ''))::BIGINT AS nation_s
      FROM d)
UNPIVOT w ON c_custkey, name_s, seg_s, bal, nation_s INTO NAME "column" VALUE n_null""")
def null_profile_long(spark, d):
    dirty = _sel(_t(spark, d, "customer"), ["c_custkey"], _DIRTY_CUSTOMER)
    return C.count_nulls_long(C.blank_to_null(dirty))


_IMPUTE_INPUT = {
    "NamXayDung": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 1990 + p_size % 7 END",
    "ChieuDai": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_retailprice / 100 END",
    "DienTich": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) * 2 END",
    "DienTichDat": "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) * 3 END",
    "PhongNgu": "CASE WHEN p_size % 6 = 0 THEN NULL ELSE CAST(p_size % 4 AS STRING) END",
    "SoTang": "CASE WHEN p_size % 8 = 0 THEN NULL ELSE '2' END",
    "LoaiBDS": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END",
}


@query("impute_stats", f"""
WITH d AS (SELECT p_partkey, {_sql_cols(_IMPUTE_INPUT)} FROM part),
d2 AS (SELECT *, coalesce(DienTich, DienTichDat) AS area FROM d),
m AS (SELECT avg(ChieuDai) AS m_len, avg(area) AS m_area FROM d2),
md AS (SELECT NamXayDung AS y FROM d2 WHERE NamXayDung IS NOT NULL
       GROUP BY NamXayDung ORDER BY count(*) DESC, NamXayDung ASC LIMIT 1)
SELECT p_partkey,
       coalesce(NamXayDung, (SELECT y FROM md)) AS year,
       round(coalesce(ChieuDai, (SELECT m_len FROM m)), 6) AS length,
       round(coalesce(area, (SELECT m_area FROM m)), 6) AS area,
       coalesce(PhongNgu, '0') AS rooms,
       coalesce(SoTang, '1') AS floors,
       coalesce(LoaiBDS, 'Unknowns') AS kind
FROM d2""")
def impute_stats(spark, d):
    df = _sel(_t(spark, d, "part"), ["p_partkey"], _IMPUTE_INPUT)
    cols = ListingColumns()
    prepared = C.area_fallback(df, cols)
    stats = C.fit_imputer(prepared, cols)
    out = C.apply_imputer(prepared, stats)
    return out.select("p_partkey", F.col("NamXayDung").alias("year"),
                      F.round("ChieuDai", 6).alias("length"), F.round("DienTich", 6).alias("area"),
                      F.col("PhongNgu").alias("rooms"), F.col("SoTang").alias("floors"),
                      F.col("LoaiBDS").alias("kind"))


_INCOMPLETE = {
    "code": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderkey AS STRING) END",
    "posted": "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END",
    "price": "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_totalprice END",
    "land": "o_totalprice / 2",
    "depth": "CAST(1 AS DOUBLE)",
}


@query("drop_incomplete", f"""
WITH d AS (SELECT o_orderstatus, {_sql_cols(_INCOMPLETE)} FROM orders)
SELECT o_orderstatus, code, posted, price FROM d
WHERE code IS NOT NULL AND posted IS NOT NULL AND price IS NOT NULL""")
def drop_incomplete(spark, d):
    df = _sel(_t(spark, d, "orders"), ["o_orderstatus"], _INCOMPLETE)
    cols = ListingColumns(identifier="code", post_date="posted", label="price",
                          dropped_after_clean=("land", "depth"))
    return C.drop_records(df, cols, is_train=True)


@query("binarize", """
WITH d AS (SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS size_n FROM part),
f AS (SELECT p_partkey, coalesce(size_n, (SELECT avg(size_n) FROM d)) AS s FROM d)
SELECT p_partkey, round(s, 6) AS size_filled, CAST(CASE WHEN s > 25 THEN 1 ELSE 0 END AS DOUBLE) AS size_bin FROM f""")
def binarize(spark, d):
    df = _t(spark, d, "part").select(
        "p_partkey", F.expr("CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END").alias("size_n"))
    filled = C.fill_with_mean(df, "size_n")
    out = E.binarize(filled, "size_n", 25.0, "size_bin")
    return out.select("p_partkey", F.round("size_n", 6).alias("size_filled"), "size_bin")


# ---------------------------------------------------------------------------
# Unit text and casts
# ---------------------------------------------------------------------------

_PRICE_TEXT = {
    "price_text": """CASE o_orderkey % 6
        WHEN 0 THEN concat(CAST(CAST(floor(o_totalprice / 100000) AS BIGINT) AS STRING), '.',
                           CAST(CAST(floor(o_totalprice / 10000) AS BIGINT) % 10 AS STRING), ' tỷ')
        WHEN 1 THEN concat(CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING), ' triệu')
        WHEN 2 THEN concat(CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), ' nghìn')
        WHEN 3 THEN concat(CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING), ' USD')
        WHEN 4 THEN CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING)
        ELSE 'Thỏa thuận' END""",
    "ppm_text": """CASE o_orderkey % 4
        WHEN 0 THEN concat(CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) % 100 AS STRING), ' triệu/m²')
        WHEN 1 THEN concat('0.', CAST(CAST(floor(o_totalprice) AS BIGINT) % 10 AS STRING), ' tỷ/m²')
        WHEN 2 THEN concat(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS STRING), ' nghìn/m²')
        ELSE '--' END""",
}


def _f1_sql(t: str, suffix: str = "") -> str:
    num = f"try_cast(split_part({t}, ' ', 1) AS DOUBLE)"
    return (f"CASE split_part({t}, ' ', 2) WHEN 'tỷ{suffix}' THEN {num} * 1000.0 "
            f"WHEN 'triệu{suffix}' THEN {num} * 1.0 "
            f"WHEN 'nghìn{suffix}' THEN round({num} * 0.001, 3) END")


@query("price_units", f"""
WITH d AS (SELECT o_orderkey, {_sql_cols(_PRICE_TEXT)} FROM orders)
SELECT o_orderkey, price_text,
       round({_f1_sql('price_text')}, 3) AS price_m,
       round({_f1_sql("CASE WHEN ppm_text IN ('--', '') THEN NULL ELSE ppm_text END", '/m²')}, 3) AS ppm_m
FROM d""")
def price_units(spark, d):
    df = _sel(_t(spark, d, "orders"), ["o_orderkey"], _PRICE_TEXT)
    df = C.blank_to_null(df, ["ppm_text"])
    return df.select("o_orderkey", "price_text",
                     F.round(PF.price_to_millions("price_text"), 3).alias("price_m"),
                     F.round(PF.price_per_m2_to_millions("ppm_text"), 3).alias("ppm_m"))


_SUFFIX_TEXT = {
    "DienTich": "CASE WHEN p_partkey % 9 = 0 THEN 'm' ELSE concat(CAST(p_size AS STRING), ' m²') END",
    "ChieuDai": "concat(CAST(p_size % 7 AS STRING), '.5 m')",
    "NamXayDung": """CASE p_partkey % 4 WHEN 0 THEN concat(CAST(1980 + p_size % 40 AS STRING), '.0')
                     WHEN 1 THEN 'không rõ' ELSE CAST(1980 + p_size % 40 AS STRING) END""",
}


def _drop_suffix_sql(t: str, n: int) -> str:
    return f"CASE WHEN length({t}) > {n} THEN left({t}, length({t}) - {n}) ELSE '' END"


@query("suffix_numbers", f"""
WITH d AS (SELECT p_partkey, {_sql_cols(_SUFFIX_TEXT)} FROM part)
SELECT p_partkey,
       CAST(try_cast(try_cast({_drop_suffix_sql('DienTich', 3)} AS DOUBLE) AS FLOAT) AS DOUBLE) AS area,
       CAST(try_cast(try_cast({_drop_suffix_sql('ChieuDai', 2)} AS DOUBLE) AS FLOAT) AS DOUBLE) AS length,
       try_cast(floor(try_cast(NamXayDung AS DOUBLE)) AS INTEGER) AS year
FROM d""")
def suffix_numbers(spark, d):
    df = _sel(_t(spark, d, "part"), ["p_partkey"], _SUFFIX_TEXT)
    typed = C.type_cast(C.strip_units(df))
    return typed.select("p_partkey", F.col("DienTich").cast("double").alias("area"),
                        F.col("ChieuDai").cast("double").alias("length"), F.col("NamXayDung").alias("year"))


# ---------------------------------------------------------------------------
# Filters and lookups
# ---------------------------------------------------------------------------

@query("filter_eq_df", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'""")
def filter_eq_df(spark, d):
    return S.where_equals(_t(spark, d, "orders"), "o_orderstatus", "F").select(
        "o_orderkey", "o_custkey", "o_totalprice")


@query("filter_eq_sql", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'""")
def filter_eq_sql(spark, d):
    return S.sql_where_equals(_t(spark, d, "orders"), "plotline_orders", "o_orderstatus", "F",
                              ["o_orderkey", "o_custkey", "o_totalprice"])


@query("key_lookup", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def key_lookup(spark, d):
    keys = S.where_equals(_t(spark, d, "orders"), "o_orderpriority", "1-URGENT").select("o_orderkey")
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return S.pick_rows(li, "l_orderkey", keys)


@query("extract_tag", """
SELECT c_custkey, c_name, regexp_extract(c_name, '#0*([0-9]+)', 1) AS tag FROM customer""")
def extract_tag(spark, d):
    cust = _t(spark, d, "customer").select("c_custkey", "c_name")
    return S.sql_transform(cust, "SELECT c_custkey, c_name, regexp_extract(c_name, '#0*([0-9]+)', 1) AS tag "
                                 "FROM __THIS__")


# ---------------------------------------------------------------------------
# Text (F5, F6, F11, F12)
# ---------------------------------------------------------------------------

def _dirty_docs(spark, d) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", "text")
    t = F.replace(F.replace("text", F.lit(", "), F.lit(",\u00a0 ")), F.lit("e "), F.lit('e  "'))
    t = F.concat(t, F.when(F.col("doc_id") % 4 == 0, F.lit("\\")).otherwise(F.lit("")))
    return docs.select("doc_id", t.alias("t"))


_DIRTY_DOCS_SQL = """SELECT doc_id,
       replace(replace(text, ', ', ',' || chr(160) || ' '), 'e ', 'e  "')
         || CASE WHEN doc_id % 4 = 0 THEN '\\' ELSE '' END AS t
FROM documents"""


def _f5_sql(x: str) -> str:
    y = f"regexp_replace(replace(replace({x}, chr(160), ' '), '\"', ''''), ' +', ' ', 'g')"
    return f"CASE WHEN suffix({y}, '\\') THEN {y} || '.' ELSE {y} END"


@query("text_preclean", f"""
WITH d AS ({_DIRTY_DOCS_SQL}),
c AS (SELECT doc_id, {_f5_sql('t')} AS pre, trim(regexp_replace(t, '[\\s\\x{{00A0}}]+', ' ', 'g')) AS squashed FROM d)
SELECT doc_id, md5(pre) AS pre_md5, length(pre)::BIGINT AS pre_len,
       md5(squashed) AS squashed_md5, length(squashed)::BIGINT AS squashed_len FROM c""")
def text_preclean(spark, d):
    df = _dirty_docs(spark, d).select("doc_id", PF.pre_clean("t").alias("pre"),
                                      PF.squash_whitespace("t").alias("squashed"))
    return df.select("doc_id", F.md5("pre").alias("pre_md5"), F.length("pre").cast("bigint").alias("pre_len"),
                     F.md5("squashed").alias("squashed_md5"),
                     F.length("squashed").cast("bigint").alias("squashed_len"))


def _f6_sql(x: str) -> str:
    folded = f"strip_accents(replace({x}, 'ß', 'ss'))"
    words = f"string_split(trim(regexp_replace({folded}, '[\\s\\x{{00A0}}]+', ' ', 'g')), ' ')"
    return f"array_to_string(list_transform({words}, lambda w: upper(w[1]) || lower(w[2:])), '')"


@query("attr_names", f"""
WITH n AS (SELECT doc_id, {_f6_sql('text')} AS name FROM documents)
SELECT doc_id, md5(name) AS name_md5, length(name)::BIGINT AS name_len FROM n""")
def attr_names(spark, d):
    n = _t(spark, d, "documents").select("doc_id", PF.attribute_name("text").alias("name"))
    return n.select("doc_id", F.md5("name").alias("name_md5"), F.length("name").cast("bigint").alias("name_len"))


# Latin letters and signs → look-alikes that transliterate back to them
_LATIN = "abgdezklmnoprstufixjqABGDEZKLMNOPRSTUFIX-'"
_OTHER_SCRIPTS = "абгдезклмнопрстуфιξјқАБГДЕЗКЛМНОПРСТУФΙΞ–’"


@query("attr_names_scripts", f"""
WITH n AS (SELECT doc_id, {_f6_sql("replace(replace(text, 'q', 'k'), 'Q', 'K')")} AS name FROM documents)
SELECT doc_id, md5(name) AS name_md5, length(name)::BIGINT AS name_len FROM n""")
def attr_names_scripts(spark, d):
    """F6 outside Latin: every text is written in Cyrillic and Greek letters first; its names must be those of the Latin text."""
    text = F.replace("text", F.lit("Q"), F.lit("K"))
    n = _t(spark, d, "documents").select("doc_id", PF.attribute_name(F.translate(text, _LATIN, _OTHER_SCRIPTS)).alias("name"))
    return n.select("doc_id", F.md5("name").alias("name_md5"), F.length("name").cast("bigint").alias("name_len"))


@query("sentence_join", f"""
WITH j AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)),
             lambda p: CASE WHEN suffix(p, '.') THEN p ELSE p || '.' END), ' ') AS joined FROM documents),
c AS (SELECT doc_id, {_f5_sql('joined')} AS body FROM j)
SELECT doc_id, md5(body) AS body_md5, length(body)::BIGINT AS body_len FROM c""")
def sentence_join(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text")
    body = PF.pre_clean(PF.paragraphs_to_text(PF.split_lines("text")))
    return docs.select("doc_id", F.md5(body).alias("body_md5"), F.length(body).cast("bigint").alias("body_len"))


# ---------------------------------------------------------------------------
# URLs and pages
# ---------------------------------------------------------------------------

_URL_VARIANT = """CASE page_id % 4 WHEN 0 THEN url
    WHEN 1 THEN replace(url, '://', ':/')
    WHEN 2 THEN concat('ftp://localhost:8080/', CAST(page_id AS STRING))
    ELSE concat('http://10.0.0.', CAST(page_id % 256 AS STRING), ':8080/x?y=1') END"""


# the URL rule stated part by part, not with the engine's pattern: scheme, host, port, rest without blanks
_URL_PARTS_SQL = f"""
WITH u AS (SELECT page_id, {_URL_VARIANT} AS u FROM pages),
p AS (SELECT *, split_part(lower(u), '://', 1) AS scheme, substr(lower(u), strpos(u, '://') + 3) AS after FROM u),
h AS (SELECT *, split_part(split_part(after, '/', 1), '?', 1) AS host_port FROM p),
a AS (SELECT *, split_part(host_port, ':', 1) AS host, string_split(split_part(host_port, ':', 1), '.') AS labels,
             substr(after, length(host_port) + 1) AS rest FROM h),
c AS (SELECT *, strpos(u, '://') > 0 AND scheme IN ('http', 'https', 'ftp', 'ftps')
             AND (host = 'localhost'
                  OR (len(labels) = 4 AND len(list_filter(labels, lambda x: length(x) BETWEEN 1 AND 3 AND try_cast(x AS INTEGER) >= 0)) = 4)
                  OR (len(labels) > 1 AND len(list_filter(labels, lambda x:
                  length(x) = 0 OR length(x) > 63 OR translate(x, 'abcdefghijklmnopqrstuvwxyz0123456789-', '') <> ''
                  OR prefix(x, '-') OR suffix(x, '-'))) = 0 AND length(labels[-1]) > 1))
             AND (host = host_port OR try_cast(split_part(host_port, ':', 2) AS BIGINT) >= 0)
             AND strpos(rest, ' ') = 0 AS valid FROM a)"""


@query("url_checks", f"""{_URL_PARTS_SQL}
SELECT page_id, u, coalesce(valid, false) AS valid, right(u, 10) AS url_id,
       CASE WHEN strpos(u, 'example.') > 0 THEN substr(u, strpos(u, 'example.') + 8) ELSE '' END AS tail
FROM c""")
def url_checks(spark, d):
    u = _t(spark, d, "pages").select("page_id", F.expr(_URL_VARIANT).alias("u"))
    return u.select("page_id", "u", PF.is_valid_url("u").alias("valid"), PF.url_id("u").alias("url_id"),
                    PF.seller_id_from_profile("u", "example.").alias("tail"))


@query("page_urls", """
WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey),
p AS (SELECT o_custkey, unnest(generate_series(1, (n + 4) // 5)) AS page FROM n)
SELECT o_custkey AS c_custkey, page::BIGINT AS page,
       'https://shop.example.com/c/' || CAST(o_custkey AS VARCHAR) || '?page=' || CAST(page AS VARCHAR) AS url
FROM p""")
def page_urls(spark, d):
    n = _t(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    sites = n.select(F.col("o_custkey").alias("c_custkey"),
                     F.concat(F.lit("https://shop.example.com/c/"), F.col("o_custkey").cast("string")).alias("base"),
                     F.expr("(n + 4) div 5").alias("last"))
    return FR.page_range_urls(sites, ["c_custkey"], "base", "last")


def _unescape_sql(x: str) -> str:
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", "' || chr(160) || '"),
                    ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{ent}', '{ch}')"
    return x


def _squash_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\x{{00A0}}]+', ' ', 'g'))"


def _field_sql(pattern: str) -> str:
    v = _squash_sql(_unescape_sql(f"regexp_extract(html, '{pattern}', 1)"))
    return f"nullif({v}, '')"


@query("page_fields", f"""
WITH b AS (SELECT page_id, html,
                  regexp_extract_all(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p>(?:<b>)?([^<]*)', 1) AS paras
           FROM pages),
t AS (SELECT page_id, html, paras,
             array_to_string(list_transform(paras, lambda p: CASE WHEN suffix({_unescape_sql('p')}, '.')
                 THEN {_unescape_sql('p')} ELSE {_unescape_sql('p')} || '.' END), ' ') AS joined FROM b),
c AS (SELECT *, {_f5_sql('joined')} AS description FROM t)
SELECT page_id,
       {_field_sql('<html lang="([^"]*)"')} AS lang,
       {_field_sql('(?s)<title>(.*?)</title>')} AS title,
       {_field_sql('(?s)<h1>(.*?)</h1>')} AS h1,
       {_field_sql('(?s)<div class="ad">(.*?)</div>')} AS ad,
       len(paras)::BIGINT AS n_paragraphs,
       md5(description) AS description_md5, length(description)::BIGINT AS description_len
FROM c""")
def page_fields(spark, d):
    p = PG.page_fields(_t(spark, d, "pages").select("page_id", "html"), "html")
    return p.select("page_id", "lang", "title", "h1", "ad", F.col("n_paragraphs").cast("bigint").alias("n_paragraphs"),
                    F.md5("description").alias("description_md5"),
                    F.length("description").cast("bigint").alias("description_len"))


_NAV = '<a href="([^"]*)">([^<]*)</a>'
_NAV_TEXT = '<a href="[^"]*">([^<]*)</a>'    # group 1: link text
_NAV_HREF = '<a href="([^"]*)">[^<]*</a>'    # group 1: link target


@query("page_links", f"""
WITH l AS (SELECT page_id, regexp_extract_all(html, '{_NAV}', 1) AS hrefs,
                  regexp_extract_all(html, '{_NAV}', 2) AS texts FROM pages),
x AS (SELECT page_id, hrefs, texts, unnest(range(len(hrefs))) AS i0 FROM l)
SELECT page_id, i0::BIGINT AS pos, hrefs[i0 + 1] AS href, {_unescape_sql('texts[i0 + 1]')} AS text FROM x""")
def page_links(spark, d):
    return PG.nav_links(_t(spark, d, "pages").select("page_id", "html"), "page_id", "html")


# pagination bars with plain, nested, highlighted, elided and missing entries, added to every page
_PAGINATION = """concat(html, '<ul class="pagination">',
  CASE WHEN page_id % 7 = 0 THEN '' WHEN page_id % 3 = 0
       THEN concat('<li class="page-item"><a>1</a></li><li class="last page-item"><a> <b>', CAST(page_id % 90 + 2 AS STRING),
                   '</b> </a></li>')
       ELSE concat('<li class="page-item"><a>1</a></li><li class="page-item active"><a>', CAST(page_id % 90 + 2 AS STRING),
                   '</a></li>') END,
  CASE WHEN page_id % 5 = 0 THEN '<li class="page-item"><span>...</span></li>' ELSE '' END,
  '<li class="page-item"><a>&rsaquo;</a></li></ul>')"""


@query("page_last", """
SELECT page_id, CASE WHEN page_id % 7 <> 0 AND page_id % 5 <> 0 THEN (page_id % 90 + 2)::INTEGER END AS last_page
FROM pages""")
def page_last(spark, d):
    pages = _t(spark, d, "pages").select("page_id", F.expr(_PAGINATION).alias("html"))
    return pages.select("page_id", PG.last_page("html").alias("last_page"))


@query("page_details", f"""
WITH l AS (SELECT page_id, regexp_extract_all(html, '{_NAV}', 1) AS hrefs,
                  regexp_extract_all(html, '{_NAV}', 2) AS texts FROM pages),
x AS (SELECT page_id, hrefs, texts, unnest(range(len(hrefs))) AS i0 FROM l),
kv AS (SELECT page_id, i0, {_f6_sql(_unescape_sql('texts[i0 + 1]'))} AS key,
              {_squash_sql(_unescape_sql('hrefs[i0 + 1]'))} AS value FROM x),
last AS (SELECT *, max(i0) OVER (PARTITION BY page_id, key) AS last_i FROM kv),
kept AS (SELECT * FROM last WHERE i0 = last_i AND key <> 'The')
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i0) - 1)::BIGINT AS pos, key, value FROM kept""")
def page_details(spark, d):
    pages = _t(spark, d, "pages").select("page_id", "html")
    return PG.detail_pairs(pages, "page_id", "html", block=r"(?s)(.*)", key_pattern=_NAV_TEXT,
                           value_pattern=_NAV_HREF, removed=("The",))


# listing markup of every part: details with a repeated and a removed key, an amenity list
# after headings without one, listing links beside an advert
_LISTING_HTML = """concat('<div id="content-tab-info"><div><ul><li><span><span>Năm xây dựng</span></span><span> ',
  CAST(p_size AS STRING), ' </span></li><li><span><span>Diện tích sử dụng</span></span><span>1 m²</span><ul><li>x</li></ul></li>',
  '<li><span><span>Năm  xây dựng</span></span><span>', CAST(p_size + 1 AS STRING), '</span></li></ul></div></div>',
  '<div class="row tabs-product"><h2>Mô tả</h2><h2> Tiện ích </h2><ul class="product-other-utilities wide"><li><span>',
  split_part(p_name, ' ', 1), '</span><ul class="n"></ul></li><li><span class="s"> ', split_part(p_name, ' ', 2), '&nbsp;x </span></li></ul></div>',
  '<p class="hot name-product"><a class="l" href="https://nha.example.vn/a-', CAST(p_partkey AS STRING), '">A</a></p>',
  '<p class="other"><a href="https://nha.example.vn/ad">ad</a></p><p class="name-product">',
  '<a href="https://nha.example.vn/b-', CAST(p_partkey AS STRING), '">B</a></p>')"""


def _dealt_parts(spark, d) -> DataFrame:
    """Parts dealt by key before pages are made of them: pages cost far more to read than parts, whose file may be one task."""
    return by_key(_t(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size"), "p_partkey")


def _listing_pages(spark, d) -> DataFrame:
    return _dealt_parts(spark, d).select("p_partkey", F.expr(_LISTING_HTML).alias("html"))


@query("listing_details", """
SELECT p_partkey, 'NamXayDung' AS key, CAST(p_size + 1 AS VARCHAR) AS value FROM part""")
def listing_details(spark, d):
    return PG.detail_pairs(_listing_pages(spark, d), "p_partkey").where("key <> ''").select("p_partkey", "key", "value")


@query("listing_amenities", """
SELECT p_partkey, 'TienIch' AS heading, concat(split_part(p_name, ' ', 1), '|', split_part(p_name, ' ', 2), ' x') AS items
FROM part""")
def listing_amenities(spark, d):
    groups = PG.amenity_groups(_listing_pages(spark, d), "p_partkey")
    return groups.select("p_partkey", F.col("group").alias("heading"), F.array_join("items", "|").alias("items"))


@query("listing_links", """
SELECT p_partkey, 0::INTEGER AS pos, concat('https://nha.example.vn/a-', p_partkey) AS url FROM part
UNION ALL SELECT p_partkey, 1::INTEGER, concat('https://nha.example.vn/b-', p_partkey) FROM part""")
def listing_links(spark, d):
    return PG.outbound_links(_listing_pages(spark, d), "p_partkey")


# the record part of a listing page: classes in any order, elements nested in elements of their kind,
# a breadcrumb item without text, a missing price per square metre
_RECORD_HTML = """concat('<div class="text-100 text-gray"> ', CAST(p_size % 28 + 1 AS STRING), '/07/2022 </div>',
  '<div class="x user-info-name"><a href="https://nha.example.vn/user/ ', CAST(p_partkey % 97 AS STRING), '"> Anh  ',
  split_part(p_name, ' ', 1), ' </a></div><ul class="crumb crumb-text text-medium"><li><i></i><ul></ul></li><li><a><span> ',
  p_type, ' </span></a></li><li><span>Tỉnh ', CAST(p_size AS STRING), '</span></li><li><span>Quận &amp; 3</span></li><li>',
  CASE WHEN p_partkey % 6 = 0 THEN '<b>x</b>' ELSE '<span>Phường 7</span>' END, '</li></ul>',
  '<div class="product-title-price"><div><div><span> ', CAST(p_size AS STRING), ' Đường Số 5 </span></div><div>',
  '<div class="price-box big"><div><div></div></div><span>', CAST(p_size AS STRING), '.5 tỷ</span>',
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '<span>104 triệu/m²</span>' END, '</div>',
  '<div class="product-status"><div><div></div><span>Mã tin</span><span>', CAST(p_partkey AS STRING),
  '</span></div></div></div></div></div><div class="row product-infomation"><div></div><ul><li><span><i class="a"></i> ',
  CAST(p_size AS STRING), ' m²</span></li><li><span><i></i>10 m</span></li><li><span><i></i> 5 m</span></li>',
  '<li><span><i></i>Nam</span></li><li><span><i></i>3</span></li><li><span><i></i>2</span></li></ul></div>',
  '<div id="content-tab-custom"><div class="note"><div></div></div><p>', split_part(p_name, ' ', 1),
  ' nhà<br>mới</p><ul><li>Gần <b>', split_part(p_name, ' ', 2), '</b></li><li>Sổ.</li></ul></div>')"""
_RECORD_SQL = """CAST(p_size % 28 + 1 AS VARCHAR) || '/07/2022' AS NgayDangBan, CAST(p_partkey % 97 AS VARCHAR) AS Id_NguoiDangban,
       'Anh ' || split_part(p_name, ' ', 1) AS NguoiDangban, p_type AS LoaiBDS, concat('Tỉnh ', p_size) AS Tinh,
       'Quận & 3' AS Huyen, CASE WHEN p_partkey % 6 <> 0 THEN 'Phường 7' END AS Xa, concat(p_size, ' Đường Số 5') AS DiaChi,
       concat(p_size, '.5 tỷ') AS TongGia, CASE WHEN p_partkey % 4 = 0 THEN '--' ELSE '104 triệu/m²' END AS Gia_m2,
       CAST(p_partkey AS VARCHAR) AS MaTin, concat(p_size, ' m²') AS DienTich, '10 m' AS ChieuDai, '5 m' AS ChieuRong,
       'Nam' AS Huong, '3' AS PhongNgu, '2' AS PhongTam,
       concat(split_part(p_name, ' ', 1), ' nhà mới. Gần ', split_part(p_name, ' ', 2), '. Sổ.') AS MoTa"""


@query("listing_records", f"SELECT p_partkey AS id, {_RECORD_SQL} FROM part")
def listing_records(spark, d):
    pages = _dealt_parts(spark, d).select(F.col("p_partkey").alias("id"), F.expr(_RECORD_HTML).alias("html"))
    return PG.listing_fields(pages, "html").drop("html").withColumnRenamed("Gia/m2", "Gia_m2")


# ---------------------------------------------------------------------------
# Frontier (H7, H8, H9, J4, J5, P7)
# ---------------------------------------------------------------------------

@query("frontier_new", """
SELECT p.page_id, p.url FROM pages p
WHERE NOT EXISTS (SELECT 1 FROM pages q WHERE q.url LIKE 'https%' AND q.url = p.url)""")
def frontier_new(spark, d):
    pages = _t(spark, d, "pages").select("page_id", "url")
    previous = pages.where(F.col("url").startswith("https"))
    return FR.new_urls(pages, previous, "url")


@query("frontier_merge", """
WITH f AS (SELECT url, page_id AS id, CASE WHEN url LIKE '%#top' THEN 1 ELSE 0 END AS crawled,
                  'available' AS status, CAST(NULL AS BIGINT) AS crawled_at FROM pages),
fx AS (SELECT url, CASE WHEN url LIKE '%utm_source%' THEN 404 ELSE 200 END AS code,
              1657500000 + page_id AS fetched_at FROM pages),
u AS (SELECT f.url, 1 AS crawled, CASE WHEN code = 200 THEN f.status ELSE 'unavailable' END AS status,
             CASE WHEN code = 200 THEN fetched_at ELSE f.crawled_at END AS crawled_at
      FROM f JOIN fx ON f.url = fx.url WHERE f.crawled = 0)
SELECT f.url, f.id, coalesce(u.crawled, f.crawled) AS crawled, coalesce(u.status, f.status) AS status,
       coalesce(u.crawled_at, f.crawled_at) AS crawled_at
FROM f LEFT JOIN u ON f.url = u.url""")
def frontier_merge(spark, d):
    pages = _t(spark, d, "pages").select("page_id", "url", "html")
    frontier = FR.urls_to_frontier(pages, "url", id_col="page_id").withColumn(
        "crawled", F.when(F.col("url").endswith("#top"), F.lit(1)).otherwise(F.lit(0)))
    fetched = pages.select(
        "url", "html",
        F.when(F.col("url").contains("utm_source"), F.lit(404)).otherwise(F.lit(200)).alias("status_code"),
        F.timestamp_seconds(F.lit(1657500000) + F.col("page_id")).alias("fetched_at"))
    _records, updated = FR.crawl_pass(frontier, fetched, recrawl=False)
    return updated.select("url", "id", "crawled", "status",
                          F.unix_seconds("crawlingDate").alias("crawled_at"))


# One crawl pass from row 100 on over the parts' pages: every third page was fetched once; the others twice,
# first an empty page, later the page itself or (every fifth) a failure; every seventh was crawled before.
_CRAWL_FROM = 100
_CRAWL_SQL = f"""WITH f AS (SELECT *, p_partkey % 7 = 0 AS was, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part),
o AS (SELECT *, NOT was AND i >= {_CRAWL_FROM} AS due, p_partkey % 3 = 0 OR p_partkey % 5 <> 0 AS ok FROM f)"""


def _crawled_parts(spark, d):
    part = _t(spark, d, "part").withColumn("url", F.concat(F.lit("https://nha.example.vn/tin-"), F.col("p_partkey")))
    frontier = FR.urls_to_frontier(part, "url", id_col="p_partkey").withColumn(
        "crawled", F.when(F.col("id") % 7 == 0, 1).otherwise(0))
    key, page = F.col("p_partkey"), F.expr(_RECORD_HTML)
    twice = key % 3 != 0
    first = part.select("url", F.lit(200).alias("status_code"), F.timestamp_seconds(1657500000 + key).alias("fetched_at"),
                        F.when(twice, F.lit("")).otherwise(page).alias("html"))
    second = part.where(twice).select(
        "url", F.when(key % 5 == 0, 404).otherwise(200).alias("status_code"),
        F.timestamp_seconds(1657600000 + key).alias("fetched_at"), page.alias("html"))
    return FR.crawl_pass(frontier, first.unionByName(second), from_idx=_CRAWL_FROM)


@query("crawl_records", f"""{_CRAWL_SQL}
SELECT p_partkey AS id, {_RECORD_SQL} FROM o WHERE due AND ok""")
def crawl_records(spark, d):
    return _crawled_parts(spark, d)[0].withColumnRenamed("Gia/m2", "Gia_m2")


@query("crawl_frontier", f"""{_CRAWL_SQL}
SELECT p_partkey AS id, concat('https://nha.example.vn/tin-', p_partkey) AS url, (due OR was)::INTEGER AS crawled,
       CASE WHEN due AND NOT ok THEN 'unavailable' ELSE 'available' END AS status,
       CASE WHEN due AND ok THEN p_partkey + CASE WHEN p_partkey % 3 = 0 THEN 1657500000 ELSE 1657600000 END END::BIGINT AS crawled_at
FROM o""")
def crawl_frontier(spark, d):
    return _crawled_parts(spark, d)[1].select("id", "url", "crawled", "status", F.unix_seconds("crawlingDate").alias("crawled_at"))


# ---------------------------------------------------------------------------
# Encoders (M1, M2, M3, M4, M6, M7, M11)
# ---------------------------------------------------------------------------

@query("label_index", """
WITH c AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1),
r AS (SELECT v, CAST(row_number() OVER (ORDER BY n DESC, v ASC) - 1 AS DOUBLE) AS idx FROM c)
SELECT o_orderkey, idx AS o_orderpriority_idx FROM orders JOIN r ON o_orderpriority = v""")
def label_index(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    labels = E.label_table(orders, "o_orderpriority")
    return E.index_by_table(orders, "o_orderpriority", labels).select("o_orderkey", "o_orderpriority_idx")


@query("dropped_rows", """
WITH s AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'),
l AS (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'),
j AS (SELECT o.*, s.o_custkey IS NOT NULL AS known FROM orders o LEFT JOIN s ON o.o_custkey = s.o_custkey)
SELECT 'levels' AS step, count(*)::BIGINT AS n_rows, (count(*) FILTER (WHERE NOT known))::BIGINT AS n_dropped FROM j
UNION ALL
SELECT 'labels', count(*)::BIGINT, (count(*) FILTER (WHERE l.o_orderpriority IS NULL))::BIGINT
FROM j LEFT JOIN l ON j.o_orderpriority = l.o_orderpriority WHERE known""")
def dropped_rows(spark, d):
    """What the seller join and the label index of a fitted plan lose, counted while the result is written."""
    orders = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    done = orders.where(F.col("o_orderstatus") == "F")
    with_level, levels = N.join_levels_counted(orders, E.fit_activity_levels(done, "o_custkey"), "o_custkey", "levels")
    labels = E.label_table(done.where(F.col("o_orderpriority") != "1-URGENT"), "o_orderpriority")
    indexed, lost = N.index_counted(with_level, "o_orderpriority", labels, name="labels")
    indexed.write.format("noop").mode("overwrite").save()
    rows = [(name, seen.get["rows"], seen.get["dropped"]) for name, seen in (("levels", levels), ("labels", lost))]
    return spark.createDataFrame(rows, "step string, n_rows long, n_dropped long")


@query("one_hot", """
WITH c AS (SELECT p_type AS v, count(*) AS n FROM part GROUP BY 1),
r AS (SELECT v, row_number() OVER (ORDER BY n DESC, v ASC) - 1 AS idx FROM c),
j AS (SELECT p_partkey, idx FROM part JOIN r ON p_type = v)
SELECT p_partkey,
       (idx = 0)::INTEGER::DOUBLE AS t_0, (idx = 1)::INTEGER::DOUBLE AS t_1, (idx = 2)::INTEGER::DOUBLE AS t_2,
       (idx = 3)::INTEGER::DOUBLE AS t_3, (idx = 4)::INTEGER::DOUBLE AS t_4
FROM j""")
def one_hot(spark, d):
    part = _t(spark, d, "part").select("p_partkey", "p_type")
    idx = E.index_by_table(part, "p_type", E.label_table(part, "p_type"))
    model = E.fit_one_hot(idx, ["p_type_idx"], ["p_type_ohe"])
    ohe = model.transform(idx).select("p_partkey", "p_type_ohe")
    return E.vector_columns(ohe, "p_type_ohe", [f"t_{i}" for i in range(model.categorySizes[0] - 1)])


_WORDS_EXPR = ("CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE string_split(concat(p_name, CASE WHEN p_size > 40 "
               "THEN concat(' ', split_part(p_name, ' ', 2), '.') ELSE '' END), ' ') END")
_WORDS_SPARK = _WORDS_EXPR.replace("string_split(", "split(")   # the one spelling that differs in Spark SQL
# vocabulary of part-name words in the driver tables (checked by the fitted vocabulary)
_PART_WORDS = ("anvil", "blue", "bolt", "cold", "gear", "gizmo", "hot", "large", "new", "old", "plate", "red",
               "ring", "rod", "small", "widget")
_FIXED_WORDS = ("blue", "gear", "ring", "zinc")


def _multi_hot_sql(words) -> str:
    cols = ",\n       ".join(
        f"len(list_filter(coalesce(list_transform(w, lambda x: replace(x, '.', '')), []), lambda x: x = '{w}'))::BIGINT AS w_{w}"
        for w in words)
    return f"WITH d AS (SELECT p_partkey, {_WORDS_EXPR} AS w FROM part)\nSELECT p_partkey,\n       {cols}\nFROM d"


def _part_words(spark, d) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", F.expr(_WORDS_SPARK).alias("w"))


@query("multi_hot_auto", _multi_hot_sql(_PART_WORDS))
def multi_hot_auto(spark, d):
    df = _part_words(spark, d)
    vocab = E.fit_multi_hot(df, ["w"])
    return E.multi_hot_columns(df, "w", vocab.vocab["w"], prefix="w_")


@query("multi_hot_fixed", _multi_hot_sql(_FIXED_WORDS))
def multi_hot_fixed(spark, d):
    return E.multi_hot_columns(_part_words(spark, d), "w", list(_FIXED_WORDS), prefix="w_")


@query("word_rows", f"""
WITH d AS (SELECT p_partkey, {_WORDS_EXPR} AS w FROM part)
SELECT p_partkey, unnest(CASE WHEN w IS NULL OR len(w) = 0 THEN [NULL::VARCHAR]
                              ELSE list_transform(w, lambda x: replace(x, '.', '')) END) AS value
FROM d""")
def word_rows(spark, d):
    return E.values_long(_part_words(spark, d), "p_partkey", "w")


def _crosstab_sql(words) -> str:
    cols = ", ".join(f"count(*) FILTER (WHERE v = '{w}')::BIGINT AS \"{w}\"" for w in words)
    return (f"WITH d AS (SELECT p_partkey, {_WORDS_EXPR} AS w FROM part), "
            f"l AS (SELECT p_partkey, unnest(list_transform(w, lambda x: replace(x, '.', ''))) AS v FROM d) "
            f"SELECT p_partkey, {cols} FROM l WHERE v IS NOT NULL GROUP BY p_partkey")


@query("word_crosstab", _crosstab_sql(_PART_WORDS))
def word_crosstab(spark, d):
    return E.value_crosstab(_part_words(spark, d), "p_partkey", "w")


@query("activity_level", """
WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT o_orderkey, o.o_custkey,
       CAST(CASE WHEN n < 2 THEN 0 WHEN n < 5 THEN 1 WHEN n < 8 THEN 2 WHEN n < 16 THEN 3 ELSE 4 END AS DOUBLE)
         AS o_custkey_level
FROM orders o JOIN c ON o.o_custkey = c.o_custkey""")
def activity_level(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    levels = E.fit_activity_levels(orders, "o_custkey")          # materialised fitted table
    return E.apply_activity_levels(orders, levels, "o_custkey", keep_input=True)


_TIER_TEXT = ("CASE r_regionkey WHEN 0 THEN 'Đặc biệt' WHEN 1 THEN 'loại I' WHEN 2 THEN 'loại II' "
              "WHEN 3 THEN 'loại III' END")
_DISTRICT_TEXT = ("CASE c_mktsegment WHEN 'BUILDING' THEN 'TP. Thủ Đức' WHEN 'AUTOMOBILE' THEN 'Quận 1' "
                  "WHEN 'MACHINERY' THEN 'Thị xã Dĩ An' WHEN 'HOUSEHOLD' THEN 'Huyện Củ Chi' ELSE 'Khu khác' END")
_WARD_TEXT = ("CASE c_custkey % 4 WHEN 0 THEN 'Phường 5' WHEN 1 THEN 'Thị trấn Cần Thạnh' "
              "WHEN 2 THEN 'Xã An Phú' ELSE 'Ấp 3' END")


@query("tier_ordinal", f"""
WITH tiers AS (SELECT n_name AS Tinh, {_TIER_TEXT} AS PhanLoaiTinh
               FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 4),
f AS (SELECT c_custkey, n_name AS Tinh, {_DISTRICT_TEXT} AS Huyen, {_WARD_TEXT} AS Xa
      FROM customer JOIN nation ON c_nationkey = n_nationkey),
j AS (SELECT f.*, PhanLoaiTinh FROM f LEFT JOIN tiers USING (Tinh))
SELECT c_custkey,
       CASE WHEN contains(PhanLoaiTinh, 'Đặc biệt') THEN 4 WHEN contains(PhanLoaiTinh, 'III') THEN 3
            WHEN contains(PhanLoaiTinh, 'II') THEN 2 WHEN contains(PhanLoaiTinh, 'I') THEN 1 END AS Tinh_idx,
       CASE WHEN contains(lower(Huyen), 'tp') THEN 3 WHEN contains(lower(Huyen), 'quận') THEN 3
            WHEN contains(lower(Huyen), 'thị xã') THEN 2 WHEN contains(lower(Huyen), 'huyện') THEN 1 END AS Huyen_idx,
       CASE WHEN contains(lower(Xa), 'phường') THEN 3 WHEN contains(lower(Xa), 'thị trấn') THEN 2
            WHEN contains(lower(Xa), 'xã') THEN 1 END AS Xa_idx
FROM j""")
def tier_ordinal(spark, d):
    nation = _t(spark, d, "nation")
    region = _t(spark, d, "region").where(F.col("r_regionkey") != 4)
    tiers = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("Tinh"), F.expr(_TIER_TEXT).alias("PhanLoaiTinh"))
    cust = _t(spark, d, "customer").join(
        nation.select("n_nationkey", "n_name"),
        F.col("c_nationkey") == F.col("n_nationkey"))
    fact = cust.select("c_custkey", F.col("n_name").alias("Tinh"), F.expr(_DISTRICT_TEXT).alias("Huyen"),
                       F.expr(_WARD_TEXT).alias("Xa"))
    return E.administrative_ordinals(fact, tiers).select("c_custkey", "Tinh_idx", "Huyen_idx", "Xa_idx")


@query("standardize", """
SELECT p_partkey, round(p_retailprice / (SELECT stddev_samp(p_retailprice) FROM part), 6) AS scaled FROM part""")
def standardize(spark, d):
    part = _t(spark, d, "part").select("p_partkey", "p_retailprice")
    vec = E.assemble(part, ["p_retailprice"], "price_vec")
    scaled = E.fit_standard_scaler(vec, "price_vec", "standardized").transform(vec)
    out = E.vector_columns(scaled.select("p_partkey", "standardized"), "standardized", ["scaled"])
    return out.select("p_partkey", F.round("scaled", 6).alias("scaled"))


# ---------------------------------------------------------------------------
# Ordered reports
# ---------------------------------------------------------------------------

@query("top_mode", """
SELECT event_type, count(*)::BIGINT AS n FROM events WHERE event_type IS NOT NULL
GROUP BY event_type ORDER BY n DESC, event_type ASC LIMIT 1""")
def top_mode(spark, d):
    return PR.top_by_count(_t(spark, d, "events"), "event_type", k=1)


@query("preview", """
SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 5""")
def preview(spark, d):
    return PR.preview(_t(spark, d, "events").select("event_id", "event_type", "value"), ["event_id"], 5)


# ---------------------------------------------------------------------------
# Models and metrics
# ---------------------------------------------------------------------------

@query("linreg_one", """
SELECT count(*)::BIGINT AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem""")
def linreg_one(spark, d):
    li = _t(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    data = E.assemble(li, ["l_quantity"], "features")
    m = fit_regressor("linear", data, "features", "l_extendedprice")
    n = m.summary.numInstances
    return spark.createDataFrame([(n, round(float(m.coefficients[0]), 4), round(float(m.intercept), 4))],
                                 "n bigint, slope double, intercept double")


def _log_price_frame(spark, d, features=("log_qty",)) -> DataFrame:
    li = _t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.log("l_extendedprice").alias("label"),
        F.log("l_quantity").alias("log_qty"), "l_discount", "l_tax", "l_quantity",
        F.col("l_linenumber").cast("double").alias("line_no"))
    return E.assemble(li, list(features), "features")


@query("metrics", """
WITH d AS (SELECT ln(l_extendedprice) AS y, ln(l_quantity) AS x FROM lineitem),
c AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d),
p AS (SELECT exp(y) AS yy, exp(a + b * x) AS pp FROM d, c)
SELECT count(*)::BIGINT AS n, round(sqrt(avg((yy - pp) * (yy - pp))), 4) AS rmse,
       round(avg(abs(yy - pp)), 4) AS mae,
       round(1 - sum((yy - pp) * (yy - pp)) / (var_pop(yy) * count(*)), 6) AS r2
FROM p""")
def metrics(spark, d):
    data = _log_price_frame(spark, d)
    model = fit_regressor("linear", data, "features", "label")
    scored = V.predict_back_transformed(model, data, "label", "prediction")
    m = V.regression_metrics(scored, "label", "prediction")
    return m.select("n", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"),
                    F.round("r2", 6).alias("r2"))


_TREE_FEATURES = ("l_quantity", "l_discount", "l_tax", "line_no")


def _tree_data(spark, d) -> DataFrame:
    return by_key(_log_price_frame(spark, d, _TREE_FEATURES), "l_orderkey", "l_linenumber")


def _ensemble_gap(spark, d, kind: str) -> DataFrame:
    """Every line scored by the ensemble, and how far that is from the weighted sum of its trees' own scores."""
    data = _tree_data(spark, d)
    model = fit_regressor(kind, data, "features", "label")
    scored = model.transform(data)
    weights = model.treeWeights if kind == "gbt" else [1.0 / model.getNumTrees] * model.getNumTrees
    total = F.lit(0.0)
    for i, (weight, one) in enumerate(zip(weights, model.trees)):
        scored = one.setFeaturesCol("features").setPredictionCol(f"tree_{i}").transform(scored)
        total = total + F.lit(float(weight)) * F.col(f"tree_{i}")
    return scored.select("l_orderkey", "l_linenumber", F.round(F.exp("label"), 2).alias("price"),
                         F.round(F.abs(F.col("prediction") - total), 6).alias("score_gap"))


_GAP_SQL = """
SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price, 0.0::DOUBLE AS score_gap FROM lineitem"""


@query("forest", _GAP_SQL)
def forest(spark, d):
    return _ensemble_gap(spark, d, "forest")


@query("gbt", _GAP_SQL)
def gbt(spark, d):
    return _ensemble_gap(spark, d, "gbt")


# a leaf predicts the mean of its rows, so each prediction is the mean label of the rows that share it
@query("tree", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price, 0.0::DOUBLE AS leaf_gap FROM lineitem""")
def tree(spark, d):
    data = _tree_data(spark, d)
    scored = fit_regressor("tree", data, "features", "label").transform(data)
    leaves = scored.groupBy("prediction").agg(F.avg("label").alias("mean"))      # at most 32 rows
    return scored.join(leaves, "prediction", "left").select(
        "l_orderkey", "l_linenumber", F.round(F.exp("label"), 2).alias("price"),
        F.round(F.abs(F.col("prediction") - F.col("mean")), 6).alias("leaf_gap"))


# the isotonic fit at a value is the largest, over block starts up to it, of the smallest block mean from there on
@query("isotonic", """
WITH g AS (SELECT l_quantity AS x, count(*) AS w, sum(ln(l_extendedprice)) AS s FROM lineitem GROUP BY 1),
r AS (SELECT x, w, s, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS cw,
             sum(s) OVER (ORDER BY x) AS cs FROM g),
m AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS mean FROM r a JOIN r b ON a.i <= b.i),
lo AS (SELECT r.x, m.a, min(m.mean) AS mean FROM r JOIN m ON m.a <= r.i AND m.b >= r.i GROUP BY 1, 2),
p AS (SELECT x, max(mean) AS y FROM lo GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price, round(exp(y), 2) AS prediction
FROM lineitem JOIN p ON l_quantity = x""")
def isotonic(spark, d):
    data = _log_price_frame(spark, d, ("l_quantity",))
    model = fit_regressor("isotonic", data, "features", "label")
    scored = V.predict_back_transformed(model, data, "label", "prediction")
    return scored.select("l_orderkey", "l_linenumber", F.round("label", 2).alias("price"),
                         F.round("prediction", 2).alias("prediction"))


# every line's vector cut to the two most important features, held against the columns they came from
@query("importance_topk", """
SELECT l_orderkey, l_linenumber, 2::INTEGER AS n_kept, 1.0::DOUBLE AS importance_total, true AS top_kept,
       0.0::DOUBLE AS slice_gap FROM lineitem""")
def importance_topk(spark, d):
    data = _tree_data(spark, d)
    slicer, table = V.select_features(data, "forest", "top", n_features=2, features_col="features",
                                      label_col="label")
    scores = {r["idx"]: r["score"] for r in table.collect()}       # one row per feature
    kept = list(slicer.getIndices())
    top = min(scores[i] for i in kept) >= max(v for i, v in scores.items() if i not in kept)
    out = slicer.transform(data).withColumn("kept", vector_to_array("features_slice"))
    gap = sum((F.abs(F.col("kept")[n] - F.col(_TREE_FEATURES[i])) for n, i in enumerate(kept)), F.lit(0.0))
    return out.select("l_orderkey", "l_linenumber", F.size("kept").alias("n_kept"),
                      F.lit(round(sum(scores.values()), 6)).alias("importance_total"), F.lit(top).alias("top_kept"),
                      F.round(gap, 6).alias("slice_gap"))
