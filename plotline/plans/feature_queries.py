"""Queries for the composite listing plans: N12 cleaning (training and
serving halves) and the M9 feature vector, on listing-shaped rows derived
from orders ⋈ customer ⋈ nation.

Finished orders (status 'F') play the labelled history the statistics and
encoders are fitted on; the other orders are the new listings to serve.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions._util import quote
from ..schema import ListingColumns
from ..sources import read_table
from .driver_queries import _DISTRICT_TEXT, _PRICE_TEXT, _TIER_TEXT, _WARD_TEXT, _f1_sql, query
from .listing import ListingFit, clean_listings

# listing field → expression over orders ⋈ customer ⋈ nation (same text in Spark and DuckDB,
# except that Spark spells string_split as split)
RAW_LISTING = {
    "MaTin": "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(o_orderkey AS STRING) END",
    "NgayDangBan": "CASE WHEN o_orderkey % 31 = 0 THEN '--' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END",
    "TongGia": "CASE WHEN o_orderkey % 37 = 0 THEN '--' ELSE " + _PRICE_TEXT["price_text"] + " END",
    "Gia/m2": _PRICE_TEXT["ppm_text"],
    "DienTich": "CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat(CAST(o_orderkey % 300 + 20 AS STRING), ' m²') END",
    "DienTichDat": "concat(CAST(o_orderkey % 500 + 30 AS STRING), ' m²')",
    "ChieuDai": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat(CAST(o_orderkey % 20 + 3 AS STRING), ' m') END",
    "ChieuRong": "CASE WHEN o_orderkey % 9 = 0 THEN '--' ELSE concat(CAST(o_orderkey % 8 + 2 AS STRING), '.5 m') END",
    "ChieuSau": "'1 m'",
    "DuongVao": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat(CAST(o_orderkey % 12 AS STRING), ' m') END",
    "NamXayDung": """CASE o_orderkey % 5 WHEN 0 THEN NULL
        WHEN 1 THEN concat(CAST(1995 + o_orderkey % 25 AS STRING), '.0')
        ELSE CAST(1995 + o_custkey % 25 AS STRING) END""",
    "Id_NguoiDangban": "CAST(o_custkey AS STRING)",
    "LoaiBDS": "o_orderpriority",
    "Tinh": "n_name",
    "Huyen": _DISTRICT_TEXT,
    "Xa": "CASE WHEN c_custkey % 6 = 0 THEN '--' ELSE " + _WARD_TEXT + " END",
    "PhongNgu": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 5 AS STRING) END",
    "PhongTam": "CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE CAST(o_orderkey % 3 AS STRING) END",
    "SoTang": "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderkey % 4 + 1 AS STRING) END",
    "Huong": "CASE WHEN o_orderkey % 3 = 0 THEN '--' ELSE c_mktsegment END",
    "GiayToPhapLy": "CASE WHEN o_orderkey % 6 = 0 THEN '--' ELSE concat('Sổ ', CAST(o_custkey % 4 AS STRING)) END",
    "ViTri": "CASE WHEN o_orderkey % 2 = 0 THEN 'Ngõ' ELSE 'Mặt tiền' END",
    "HienTrangNha": "CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE n_name END",
    "TrangThaiSuDung": "CASE WHEN o_orderkey % 15 = 0 THEN '' ELSE concat('t', CAST(o_orderkey % 3 AS STRING)) END",
    "HuongBanCong": "c_mktsegment",
    "KetCau": "CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 'Bê tông' END",
    "TienIchToaNha": """CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE string_split(concat(lower(c_mktsegment), ' gym.',
        CASE WHEN o_orderkey % 2 = 0 THEN ' pool' ELSE '' END, CASE WHEN o_orderkey % 4 = 0 THEN ' pool.' ELSE '' END), ' ') END""",
    "TienIchLanCan": "string_split(concat('park ', CASE WHEN o_orderkey % 3 = 0 THEN 'park.' ELSE 'school' END), ' ')",
    "NoiThat,TienNghi": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE string_split(concat('bed', CAST(o_orderkey % 4 AS STRING), ' sofa'), ' ') END",
    "HangXom": "string_split(concat('n', CAST(c_custkey % 3 AS STRING)), ' ')",
    "AnNinh": "CASE WHEN o_custkey % 2 = 0 THEN string_split('camera guard', ' ') ELSE string_split('camera.', ' ') END",
    "DuongVaoBds": "string_split(CASE WHEN o_orderkey % 8 = 0 THEN 'car car' ELSE 'foot' END, ' ')",
    "TienIchGanDat": "CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE string_split('river', ' ') END",
}
_ARRAYS = [*ListingColumns().arrays]
_STRING_FIELDS = [k for k in RAW_LISTING if k not in _ARRAYS]
_FLOATS = ["TongGia", "Gia/m2", "DienTich", "ChieuDai", "ChieuRong", "DuongVao"]
_CATEGORICAL_FILL = {"PhongNgu": "0", "PhongTam": "0", "SoTang": "1"}
_CATEGORICALS = ["Id_NguoiDangban", "LoaiBDS", "Tinh", "Xa", "Huyen", "Huong", "PhongNgu", "PhongTam", "GiayToPhapLy", "SoTang",
                 "ViTri", "HienTrangNha", "TrangThaiSuDung", "HuongBanCong", "KetCau"]


def _q(name: str) -> str:
    return '"' + name + '"'


def raw_listings(spark, d) -> DataFrame:
    """Listing-shaped raw rows (strings with units, sentinels, nulls, arrays)."""
    return raw_listings_from(read_table(spark, d, "orders"), read_table(spark, d, "customer"),
                             read_table(spark, d, "nation"))


def raw_listings_from(orders: DataFrame, customers: DataFrame, nations: DataFrame) -> DataFrame:
    """As ``raw_listings`` over given frames; ``orders`` may be a stream
    (stream-static joins with the customer and nation tables)."""
    cust = customers.select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = nations.select("n_nationkey", "n_name")
    j = (orders.join(cust, F.col("o_custkey") == F.col("c_custkey"))
         .join(nation, F.col("c_nationkey") == F.col("n_nationkey")))
    return j.select("o_orderstatus", *[F.expr(e.replace("string_split(", "split(")).alias(k)
                                       for k, e in RAW_LISTING.items()])


def _raw_sql() -> str:
    cols = ",\n    ".join(f"{e} AS {_q(k)}" for k, e in RAW_LISTING.items())
    return (f"SELECT o_orderstatus,\n    {cols}\nFROM orders JOIN customer ON o_custkey = c_custkey "
            f"JOIN nation ON c_nationkey = n_nationkey")


def _blank(c: str) -> str:
    return f"CASE WHEN {c} IN ('--', '') THEN NULL ELSE {c} END"


def _num_sql(c: str, n: int) -> str:
    x = _blank(c)
    return f"try_cast(CASE WHEN length({x}) > {n} THEN left({x}, length({x}) - {n}) ELSE '' END AS DOUBLE)"


def _prepared_sql() -> str:
    """N2 → F1–F4 → N6 (area from land area) as one SELECT over `raw`."""
    sel = ["o_orderstatus"]
    for k in _STRING_FIELDS:
        if k == "TongGia":
            e = _f1_sql(_blank(_q(k)))
        elif k == "Gia/m2":
            e = _f1_sql(_blank(_q(k)), "/m²")
        elif k == "DienTich":
            e = f"coalesce({_num_sql(_q('DienTich'), 3)}, {_num_sql(_q('DienTichDat'), 3)})"
        elif k == "DienTichDat":
            continue
        elif k in ("ChieuDai", "ChieuRong", "DuongVao"):
            e = _num_sql(_q(k), 2)
        elif k == "ChieuSau":
            continue
        elif k == "NamXayDung":
            e = f"try_cast(floor(try_cast({_blank(_q(k))} AS DOUBLE)) AS INTEGER)"
        else:
            e = _blank(_q(k))
        sel.append(f"{e} AS {_q(k)}")
    sel += [_q(a) for a in _ARRAYS]
    return "SELECT " + ",\n       ".join(sel) + " FROM raw"


def _clean_sql(train: bool) -> str:
    means = ["ChieuDai", "ChieuRong", "DuongVao", "DienTich"]
    stat_cols = ", ".join(f"avg({_q(m)}) AS m_{m}" for m in means)
    filled = ["o_orderstatus"]
    for k in ["MaTin", "NgayDangBan", "TongGia", "Gia/m2"]:
        filled.append(_q(k))
    for m in means:
        filled.append(f"coalesce({_q(m)}, (SELECT m_{m} FROM st)) AS {_q(m)}")
    filled.append('coalesce("NamXayDung", (SELECT y FROM md)) AS "NamXayDung"')
    for k in _CATEGORICALS:
        filled.append(f"coalesce({_q(k)}, '{_CATEGORICAL_FILL.get(k, 'Unknowns')}') AS {_q(k)}")
    filled += [f"coalesce({_q(a)}, []) AS {_q(a)}" for a in _ARRAYS]
    out = ['"MaTin"', '"NgayDangBan"']
    out += [f"CAST(CAST({_q(f)} AS FLOAT) AS DOUBLE) AS {_q(f.replace('/', '_'))}" for f in _FLOATS]
    out += ['"NamXayDung"'] + [_q(k) for k in _CATEGORICALS]
    out.append("(" + " + ".join(f"len({_q(a)})" for a in _ARRAYS) + ")::BIGINT AS n_amenities")
    where = '"MaTin" IS NOT NULL AND "NgayDangBan" IS NOT NULL'
    if train:
        where += ' AND CAST("TongGia" AS FLOAT) IS NOT NULL'
    part = "o_orderstatus = 'F'" if train else "o_orderstatus <> 'F'"
    return f"""WITH raw AS ({_raw_sql()}),
prep AS ({_prepared_sql()}),
tr AS (SELECT * FROM prep WHERE o_orderstatus = 'F'),
st AS (SELECT {stat_cols} FROM tr),
md AS (SELECT "NamXayDung" AS y FROM tr WHERE "NamXayDung" IS NOT NULL
       GROUP BY "NamXayDung" ORDER BY count(*) DESC, "NamXayDung" ASC LIMIT 1),
filled AS (SELECT {", ".join(filled)} FROM prep WHERE {part})
SELECT {", ".join(out)} FROM filled WHERE {where}"""


def _clean_output(df: DataFrame) -> DataFrame:
    cols = [F.col("MaTin"), F.col("NgayDangBan")]
    cols += [F.col(f"`{f}`").cast("double").alias(f.replace("/", "_")) for f in _FLOATS]
    cols += [F.col("NamXayDung")] + [F.col(k) for k in _CATEGORICALS]
    cols.append(sum((F.size(F.col(quote(a))) for a in _ARRAYS), F.lit(0)).cast("bigint").alias("n_amenities"))
    return df.select(*cols)


def _cleaned(spark, d):
    raw = raw_listings(spark, d)
    train = raw.where(F.col("o_orderstatus") == "F").drop("o_orderstatus")
    serve = raw.where(F.col("o_orderstatus") != "F").drop("o_orderstatus")
    return clean_listings(train, serve, ListingColumns())


@query("clean_listing", _clean_sql(train=True))
def clean_listing(spark, d):
    clean_train, _serve, _stats = _cleaned(spark, d)
    return _clean_output(clean_train)


@query("clean_listing_serving", _clean_sql(train=False))
def clean_listing_serving(spark, d):
    _train, clean_serve, _stats = _cleaned(spark, d)
    return _clean_output(clean_serve)


def tier_lookup(spark, d) -> DataFrame:
    """Province → tier text lookup derived from nation ⋈ region (region 4 left out)."""
    nation = read_table(spark, d, "nation")
    region = read_table(spark, d, "region").where(F.col("r_regionkey") != 4)
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("Tinh"), F.expr(_TIER_TEXT).alias("PhanLoaiTinh"))


# vector slots of the fitted plan on the driver tables (checked against slot_names())
_FEATURE_WORDS = {
    "TienIchToaNha": ("automobile", "building", "furniture", "gym", "household", "machinery", "pool"),
    "TienIchLanCan": ("park", "school"), "NoiThat,TienNghi": ("bed0", "bed1", "bed2", "bed3", "sofa"),
    "HangXom": ("n0", "n1", "n2"), "AnNinh": ("camera", "guard"), "DuongVaoBds": ("car", "foot"), "TienIchGanDat": ("river",)}
# labels of each indexed categorical on the driver tables; one-hot encoding gives the rarest no slot
_LABEL_COUNTS = {"LoaiBDS": 5, "Huong": 6, "PhongNgu": 5, "PhongTam": 3, "GiayToPhapLy": 5, "SoTang": 4, "ViTri": 2,
                 "HienTrangNha": 26, "TrangThaiSuDung": 4, "HuongBanCong": 5, "KetCau": 2}


def _features_sql(one_hot: bool = False) -> str:
    clean, train_clean = (_clean_sql(train=t).replace(
        'SELECT "MaTin", "NgayDangBan"', 'SELECT "MaTin", "NgayDangBan", ' + ", ".join(map(_q, _ARRAYS)), 1) for t in (False, True))
    idx_cols = list(_LABEL_COUNTS)
    slots = [f'r_{c}.idx AS "f_{c}_idx"' for c in idx_cols]
    if one_hot:
        slots = [f'(r_{c}.idx = {i})::INTEGER::DOUBLE AS "f_{c}_ohe_{i}"'
                 for c, n in _LABEL_COUNTS.items() for i in range(n - 1)]
    ranks = ",\n".join(
        f"""r_{c} AS (SELECT v, CAST(row_number() OVER (ORDER BY n DESC, v ASC) - 1 AS DOUBLE) AS idx
          FROM (SELECT {_q(c)} AS v, count(*) AS n FROM tr GROUP BY 1))""" for c in idx_cols)
    joins = " ".join(f"JOIN r_{c} ON s.{_q(c)} = r_{c}.v" for c in idx_cols)
    words = ",\n       ".join(
        f"len(list_filter(list_transform(s.{_q(a)}, lambda x: replace(x, '.', '')), lambda x: x = '{w}'))"
        f"::DOUBLE AS \"f_{a.replace(',', '_')}_{w}\"" for a, own in _FEATURE_WORDS.items() for w in own)
    return f"""WITH tr AS ({train_clean}),
sv AS ({clean}),
lv AS (SELECT "Id_NguoiDangban" AS k, count(*) AS n FROM tr GROUP BY 1),
tiers AS (SELECT n_name AS t, {_TIER_TEXT} AS tier FROM nation JOIN region ON n_regionkey = r_regionkey
          WHERE r_regionkey <> 4),
{ranks}
SELECT s."MaTin",
       coalesce(CASE WHEN lv.n < 2 THEN 0 WHEN lv.n < 5 THEN 1 WHEN lv.n < 8 THEN 2
                     WHEN lv.n < 16 THEN 3 WHEN lv.n IS NOT NULL THEN 4 END, 0)::DOUBLE AS "f_Id_NguoiDangban_level",
       coalesce(CASE WHEN contains(tier, 'Đặc biệt') THEN 4 WHEN contains(tier, 'III') THEN 3
            WHEN contains(tier, 'II') THEN 2 WHEN contains(tier, 'I') THEN 1 END::DOUBLE, 0.0::DOUBLE) AS "f_Tinh_idx",
       coalesce(CASE WHEN contains(lower(s."Huyen"), 'tp') THEN 3 WHEN contains(lower(s."Huyen"), 'quận') THEN 3
            WHEN contains(lower(s."Huyen"), 'thị xã') THEN 2 WHEN contains(lower(s."Huyen"), 'huyện') THEN 1 END::DOUBLE,
            0.0::DOUBLE) AS "f_Huyen_idx",
       coalesce(CASE WHEN contains(lower(s."Xa"), 'phường') THEN 3 WHEN contains(lower(s."Xa"), 'thị trấn') THEN 2
            WHEN contains(lower(s."Xa"), 'xã') THEN 1 END::DOUBLE, 0.0::DOUBLE) AS "f_Xa_idx",
       {", ".join(slots)},
       {words}
FROM sv s LEFT JOIN lv ON s."Id_NguoiDangban" = lv.k LEFT JOIN tiers ON s."Tinh" = tiers.t {joins}"""


@query("feature_vectors", _features_sql())
def feature_vectors(spark, d):
    return _feature_slots(spark, d)


@query("feature_vectors_one_hot", _features_sql(one_hot=True))
def feature_vectors_one_hot(spark, d):
    return _feature_slots(spark, d, one_hot=True)


def _feature_slots(spark, d, **options) -> DataFrame:
    raw = raw_listings(spark, d)
    train = raw.where(F.col("o_orderstatus") == "F").drop("o_orderstatus")
    serve = raw.where(F.col("o_orderstatus") != "F").drop("o_orderstatus")
    with ListingFit(train, ListingColumns(), tier_lookup(spark, d), handle_invalid="keep",
                    index_invalid="skip", fill_missing=0.0, **options) as fit:
        out = fit.fitted.transform(fit.clean(serve))
        names = fit.fitted.slot_names()
    arr = vector_to_array("features")
    wide = out.select("MaTin", arr.alias("__f"))
    return wide.select("MaTin", *[F.col("__f")[i].alias(f"f_{n.replace(',', '_')}") for i, n in enumerate(names)])
