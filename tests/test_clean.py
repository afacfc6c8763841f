"""Missing data, unit stripping and casting (N1–N12, P12) and traps G3–G7, G13, G15."""

import pytest
from pyspark.sql import functions as F

from plotline.operators import clean as C
from plotline.schema import ListingColumns
from tests.listing_fixtures import listing, listing_df

COLS = ListingColumns()


def test_count_nulls_wide_and_long(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, None), (None, 3.0, "c")], "a int, b double, c string")
    wide = C.count_nulls(df).collect()[0].asDict()
    assert wide == {"a": 1, "b": 2, "c": 1}
    long = {r["column"]: r["n_null"] for r in C.count_nulls_long(df).collect()}
    assert long == wide


def test_blank_to_null_only_strings(spark):
    df = spark.createDataFrame([(1, "--", ["--"]), (2, "", []), (3, "x", None)], "id long, s string, arr array<string>")
    out = C.blank_to_null(df).orderBy("id").collect()
    assert [r.s for r in out] == [None, None, "x"]
    assert out[0].arr == ["--"]           # arrays untouched
    assert [r.id for r in out] == [1, 2, 3]  # integer column never compared with text (G15)


def test_strip_units_and_cast(spark):
    df = listing_df(spark)
    typed = C.type_cast(C.strip_units(C.blank_to_null(df)))
    rows = {r.MaTin: r for r in typed.collect()}
    assert rows["1001"].TongGia == pytest.approx(5200.0)
    assert rows["1004"].TongGia == pytest.approx(0.95)
    assert rows["1003"].TongGia is None
    assert rows["1002"].NamXayDung == 2021
    assert rows["1001"]["Gia/m2"] == pytest.approx(104.0)
    assert rows["1004"].ChieuRong is None
    assert dict(typed.dtypes)["TongGia"] == "float" and dict(typed.dtypes)["NamXayDung"] == "int"


def test_mode_tie_breaks_to_smallest(spark):
    df = spark.createDataFrame([(2020,), (2019,), (2020,), (2019,), (None,), (None,), (None,)], "y int")
    assert C.column_mode(df, "y") == 2019


def test_clean_raw_training(spark):
    out, stats = C.clean_raw(listing_df(spark), COLS, is_train=True)
    rows = {r.MaTin: r for r in out.collect()}
    assert sorted(rows) == ["1001", "1002", "1004", "1007"]     # no label / id / date rows dropped
    assert stats.modes["NamXayDung"] == 2019
    assert stats.means["DienTich"] == pytest.approx(340 / 7)
    r2 = rows["1002"]
    assert r2.DienTich == pytest.approx(40.0)                   # N6 area from land area
    assert r2.ChieuDai == pytest.approx(10.0)                   # N4 mean
    assert r2.PhongNgu == "0" and r2.SoTang == "1"              # N5 constants win over 'Unknowns' (G13)
    assert r2.Huong == "Unknowns"
    assert r2.TienIchToaNha == []                               # N7
    assert rows["1004"].Id_NguoiDangban == "Unknowns"
    assert rows["1004"].ChieuRong == pytest.approx(5.0)
    assert "DienTichDat" not in out.columns and "ChieuSau" not in out.columns


def test_clean_raw_serving_uses_training_stats(spark):
    _, stats = C.clean_raw(listing_df(spark), COLS, is_train=True)
    one = listing_df(spark, [listing(MaTin="9", TongGia=None, NamXayDung=None, ChieuDai=None, DienTich=None,
                                     DienTichDat=None, PhongNgu=None, Tinh=None)])
    out, same = C.clean_raw(one, COLS, is_train=False, stats=stats)
    r = out.collect()[0]
    assert same is stats
    assert r.NamXayDung == 2019 and r.ChieuDai == pytest.approx(10.0)      # G4: not the batch's own stats
    assert r.DienTich == pytest.approx(340 / 7, rel=1e-6)
    assert r.TongGia is None                                                # serving keeps unpriced rows (G5)
    assert r.Tinh == "Unknowns" and r.PhongNgu == "0"


def test_serving_keeps_rows_training_drops(spark):
    train, _ = C.clean_raw(listing_df(spark), COLS, is_train=True)
    _, stats = C.clean_raw(listing_df(spark), COLS, is_train=True)
    serve, _ = C.clean_raw(listing_df(spark), COLS, is_train=False, stats=stats)
    assert train.count() == 4 and serve.count() == 5


def test_fill_numeric_zero_and_mean(spark):
    df = spark.createDataFrame([(None, None, None), (2.0, "a", [])], "x double, s string, arr array<string>")
    z = C.fill_numeric_zero(df).orderBy("x").collect()
    assert z[0].x == 0.0 and z[0].s is None and z[0].arr is None
    m = C.fill_with_mean(spark.createDataFrame([(None,), (2.0,), (4.0,)], "x double"), "x")
    assert sorted(r.x for r in m.collect()) == [2.0, 3.0, 4.0]


def test_drop_incomplete(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (None, "b", 2.0), (3, None, 3.0)], "k int, d string, x double")
    out = C.drop_incomplete(df, ["k", "d"], ["x"])
    assert out.columns == ["k", "d"] and out.count() == 1


def test_empty_arrays_for_null(spark):
    df = spark.createDataFrame([(1, None), (2, ["a"])], "k int, arr array<string>")
    assert [r.arr for r in C.empty_arrays_for_null(df, ["arr"]).orderBy("k").collect()] == [[], ["a"]]


def test_text_constants_skip_numeric_categoricals(spark):
    df = spark.createDataFrame([("1", None, "2 tỷ", "x"), ("2", 3, "1 tỷ", None)],
                               "MaTin string, PhongNgu int, TongGia string, LoaiBDS string")
    cols = ListingColumns(post_date="MaTin")
    out, _ = C.clean_raw(df, cols, is_train=False)
    rows = {r.MaTin: r for r in out.collect()}                 # no cast error under ANSI
    assert rows["1"].PhongNgu is None and rows["2"].LoaiBDS == "Unknowns"
