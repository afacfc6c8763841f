"""The listing application end to end on own data: raw JSON → clean →
features → train → evaluate → persist → reload → score one submitted record."""

import json
import os

import pytest
from pyspark.ml.regression import RandomForestRegressionModel

from plotline import sources as SRC
from plotline.operators import evaluate as V
from plotline.operators.models import fit_regressor
from plotline.plans.listing import ListingFit, label_log
from plotline.schema import ListingColumns, raw_listing_schema
from plotline.streaming.scoring import predicted_vs_actual
from tests.listing_fixtures import TIER_SCHEMA, TIERS, listing

PROVINCES = ["TP. Trung Tâm", "Tỉnh Một", "Tỉnh Hai", "Tỉnh Ba"]
KINDS = ["Nhà riêng", "Căn hộ", "Đất nền"]


def generated_listings(n=60):
    """Listings built by rule: price grows with area, rooms and province tier."""
    rows = []
    for i in range(n):
        area = 30 + (i * 7) % 90
        rooms = 1 + i % 4
        tier = i % 4
        price = round((area * 0.04 + rooms * 0.3 + (3 - tier) * 0.5), 1)
        rows.append(listing(
            MaTin=str(5000 + i), TongGia=f"{price} tỷ", DienTich=f"{area} m²", PhongNgu=str(rooms),
            Tinh=PROVINCES[tier], LoaiBDS=KINDS[i % 3], Id_NguoiDangban=str(i % 9),
            NamXayDung=str(2000 + i % 20) if i % 5 else None,
            TienIchToaNha=(["Thang máy", "Hồ bơi."] if i % 2 else ["Bảo vệ"]),
            ChieuDai=None if i % 7 == 0 else f"{5 + i % 10} m"))
    return rows


def test_listing_application_flow(spark, tmp_dir):
    cols = ListingColumns()
    raw_path = os.path.join(tmp_dir, "raw_0.json")
    with open(raw_path, "w", encoding="utf-8") as fh:
        json.dump(generated_listings(), fh, ensure_ascii=False, indent=2)
    raw = SRC.read_listing_json(spark, raw_path)
    tiers = spark.createDataFrame(TIERS, TIER_SCHEMA)

    numeric = (cols.area, *cols.lengths[:2])
    with ListingFit(raw, cols, tiers, index_invalid="keep", fill_missing=0.0, numeric_cols=numeric) as fit:
        train = label_log(fit.fitted.transform(fit.clean_train), cols.label)
        model = fit_regressor("forest", train, "features", "label")
        scored = V.predict_back_transformed(model, train, "label")
        m = V.regression_metrics(scored, "label").collect()[0]
        slicer, table = V.select_features(train, "forest", "top", n_features=3, label_col="label")
        stats, fitted = fit.stats, fit.fitted
    assert m.n == 60 and m.r2 > 0.8                      # prices follow the rule closely
    names = [r.name for r in table.collect()]
    assert len(names) == len(fitted.slot_names()) and len(slicer.getIndices()) == 3

    path = SRC.save_model(model, os.path.join(tmp_dir, "rf"))
    reloaded = RandomForestRegressionModel.load(path)

    form = {"MaTin": "9999", "NgayDangBan": "05/07/2022, 10:00", "TongGia": "3.1 tỷ", "DienTich": "60 m²",
            "PhongNgu": "2", "Tinh": "Tỉnh Một", "Huyen": "Quận 1", "Xa": "Phường 2", "LoaiBDS": "Căn hộ",
            "Id_NguoiDangban": "3", "TienIchToaNha": ["Hồ bơi"]}
    one = SRC.json_records_to_df(spark, [form], raw_listing_schema(cols))
    row = predicted_vs_actual(one, stats, fitted, reloaded, cols).collect()[0]
    assert row.MaTin == "9999" and row.actual == pytest.approx(3100.0)
    assert 300.0 < row.predicted < 20000.0                # millions, within the training range


def test_source_feature_plan_has_no_continuous_columns(spark, tmp_dir):
    """Faithful default: area and lengths are not in the assembled vector."""
    cols = ListingColumns()
    raw = spark.createDataFrame(generated_listings(12), raw_listing_schema(cols))
    with ListingFit(raw, cols, spark.createDataFrame(TIERS, TIER_SCHEMA), index_invalid="keep") as fit:
        names = fit.fitted.slot_names()
    assert cols.area not in names and names[0] == "Id_NguoiDangban_level"
