"""Encoders (M1–M11) and the feature plan (M9); traps G8, G10, G12, G16, G20."""

from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from plotline.operators import clean as C
from plotline.operators import encode as E
from plotline.operators import slots as S
from plotline.plans.listing import fit_features
from plotline.schema import ListingColumns
from tests.listing_fixtures import TIER_SCHEMA, TIERS, listing, listing_df


def test_label_index_frequency_then_alpha_and_skip(spark):
    train = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), ("a",), ("d",)], "v string")
    m = E.fit_label_indexer(train, ["v"])
    assert E.index_labels(m) == ["a", "b", "c", "d"]             # ties alphabetical
    new = spark.createDataFrame([("b",), ("zz",), (None,)], "v string")
    out = m.transform(new).collect()
    assert [r.v_idx for r in out] == [1.0]                        # unseen and null rows skipped (G10)


def test_one_hot_drop_last(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "k_idx double")
    m = E.fit_one_hot(df, ["k_idx"])
    arr = m.transform(df).select(vector_to_array("k_ohe").alias("a")).collect()
    assert [r.a for r in arr] == [[1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]


def test_multi_hot_counts_dots_repeats_nulls(spark):
    df = spark.createDataFrame([(1, ["Chợ", "Chợ.", "Trường"]), (2, None), (3, [None, "Công viên"]), (4, [])],
                               "k int, arr array<string>")
    vocab = E.fit_multi_hot(df, ["arr"])
    assert vocab.vocab["arr"] == ["Chợ", "Công viên", "Trường"]        # sorted, dots stripped, no null (G8)
    wide = {r.k: r for r in E.multi_hot_columns(df, "arr", vocab.vocab["arr"]).collect()}
    assert wide[1]["arr_Chợ"] == 2 and wide[1]["arr_Trường"] == 1       # repeats count 2+
    assert wide[2]["arr_Chợ"] == 0 and wide[3]["arr_Công viên"] == 1
    fixed = E.multi_hot_columns(df, "arr", ["Chợ", "Hồ bơi"], prefix="x_")
    assert fixed.columns == ["k", "x_Chợ", "x_Hồ bơi"]
    assert fixed.agg(F.sum("x_Hồ bơi")).collect()[0][0] == 0           # missing category -> 0 column (M4)
    # sums of the wide counts equal the array sizes after normalisation (invariant)
    vec = E.multi_hot_vectors(df, vocab, output_col="v")
    sums = vec.select("k", F.aggregate(vector_to_array("v"), F.lit(0.0), lambda a, x: a + x).alias("s")).collect()
    assert {r.k: r.s for r in sums} == {1: 3.0, 2: 0.0, 3: 1.0, 4: 0.0}
    assert vec.count() == df.count()                                   # no rows gained or lost


def test_activity_levels(spark):
    rows = [("a",)] * 1 + [("b",)] * 3 + [("c",)] * 9 + [("d",)] * 20 + [(None,)]
    df = spark.createDataFrame(rows, "s string")
    lv = {r.s: r.s_level for r in E.fit_activity_levels(df, "s").collect()}
    assert lv == {"a": 0.0, "b": 1.0, "c": 3.0, "d": 4.0, None: 0.0}
    joined = E.apply_activity_levels(df, E.fit_activity_levels(df, "s"), "s", keep_input=True)
    assert joined.count() == 33                                       # null key dropped by the inner join


def test_administrative_ordinals(spark):
    tiers = spark.createDataFrame(TIERS, TIER_SCHEMA)
    df = spark.createDataFrame([("TP. Trung Tâm", "TP. Thủ Đức", "Phường 5"), ("Tỉnh Một", "Huyện Ba Bể", "Xã X"),
                                ("Nowhere", "Thị xã Y", "Thị trấn Z"), ("Tỉnh Hai", "Khu A", "Ấp 2")],
                               "Tinh string, Huyen string, Xa string")
    out = E.administrative_ordinals(df, tiers, keep_input=True).orderBy("Tinh").collect()
    got = {r.Tinh: (r.Tinh_idx, r.Huyen_idx, r.Xa_idx) for r in out}
    assert got == {"TP. Trung Tâm": (4, 3, 3), "Tỉnh Một": (3, 1, 1), "Nowhere": (None, 2, 2),
                   "Tỉnh Hai": (2, None, None)}
    with pytest.raises(Exception):   # assembling a null ordinal fails by default (G12)
        E.assemble(E.administrative_ordinals(df, tiers), ["Tinh_idx"], "v").collect()
    kept = E.assemble(E.administrative_ordinals(df, tiers), ["Tinh_idx"], "v", handle_invalid="keep")
    assert kept.count() == 4


def test_binarize_and_standardize(spark):
    df = spark.createDataFrame([(10.0,), (50.0,), (50.5,)], "age double")
    assert [r.b for r in E.binarize(df, "age", 50, "b").collect()] == [0.0, 0.0, 1.0]   # strictly greater
    vec = E.assemble(df, ["age"], "v")
    out = E.fit_standard_scaler(vec, "v", "s").transform(vec).select(vector_to_array("s")[0].alias("x")).collect()
    std = (sum((x - 36.833333) ** 2 for x in (10, 50, 50.5)) / 2) ** 0.5
    assert out[0].x == pytest.approx(10 / std, rel=1e-5)


def test_feature_plan_fit_once_serve_later(spark):
    cols = ListingColumns()
    clean, stats = C.clean_raw(listing_df(spark), cols, is_train=True)
    tiers = spark.createDataFrame(TIERS, TIER_SCHEMA)
    fitted = fit_features(clean, cols, tiers, index_invalid="keep")
    out = fitted.transform(clean)
    width = len(fitted.slot_names())
    arrs = out.select(vector_to_array("features").alias("a")).collect()
    assert all(len(r.a) == width for r in arrs) and len(arrs) == clean.count()
    # a single served row: seller level is looked up from training counts, not the batch
    one = listing_df(spark, [listing(MaTin="5000", Id_NguoiDangban="77")])
    served, _ = C.clean_raw(one, cols, is_train=False, stats=stats)
    vec = fitted.transform(served).select(vector_to_array("features").alias("a")).collect()[0].a
    assert vec[0] == 1.0                # seller 77 has 2 training rows -> level 1
    again = fitted.transform(clean).select(vector_to_array("features").alias("a")).collect()
    def norm(rows):
        return sorted(repr([None if x != x else x for x in r.a]) for r in rows)
    assert norm(again) == norm(arrs)                                  # fit then transform is stable


def test_values_long_and_crosstab(spark):
    df = spark.createDataFrame([(1, ["a.", "b", "a"]), (2, None), (3, [])], "k int, arr array<string>")
    long = sorted((r.k, r.value) for r in E.values_long(df, "k", "arr").collect())
    assert long == [(1, "a"), (1, "a"), (1, "b"), (2, None), (3, None)]   # explode_outer keeps empty rows
    ct = {r.k: (r.a, r.b, r.z) for r in E.value_crosstab(df, "k", "arr", ["a", "b", "z"]).collect()}
    assert ct == {1: (2, 1, 0)}


def test_one_hot_explicit_inputs(spark):
    """Only the listed index columns are one-hot encoded, never every `_idx` name."""
    df = spark.createDataFrame([(0.0, 2.0), (1.0, 3.0)], "a_idx double, Tinh_idx double")
    out = E.fit_one_hot(df, ["a_idx"]).transform(df)
    assert "a_ohe" in out.columns and "Tinh_ohe" not in out.columns


def test_wide_form_takes_any_named_vocabulary(spark):
    df = spark.createDataFrame([(1, ["w7", "a\u0001b", "\u0002", None])], "k int, arr array<string>")
    row = E.multi_hot_columns(df, "arr", [*[f"w{i}" for i in range(300)], "a\u0001b", "\u0002"]).first()
    assert len(row) == 303 and row["arr_w7"] == row["arr_a\u0001b"] == row["arr_\u0002"] == 1 and row["arr_w8"] == 0


def test_value_table_matches_the_indexer_and_vocabulary(spark):
    df = spark.createDataFrame([("b", ["x.", "y"], "u"), ("a", None, "u"), ("b", ["y", None], "v"), ("c", [], "u"), (None, ["z"], None)],
                               "v string, arr array<string>, `w,1` string")
    values, sizes = S.fit_value_table(df, ["v", "w,1"], ["arr"])
    got = {(r["column"], r.value): r.place for r in values.collect()}
    want = {("v", x): i for i, x in enumerate(E.index_labels(E.fit_label_indexer(df, ["v"])))}
    want |= {("arr", x): i for i, x in enumerate(E.fit_multi_hot(df, ["arr"]).vocab["arr"])} | {("w,1", "u"): 0, ("w,1", "v"): 1}
    assert got == want and sizes == {"v": 3, "w,1": 2, "arr": 3}
    assert S.fit_value_table(df.limit(0), ["v"], ["arr"])[1] == {"v": 0, "arr": 0}


@pytest.mark.parametrize("invalid", ["keep", "skip"])
@pytest.mark.parametrize("one_hot", [False, True])
def test_sparse_features_equal_brute_force(spark, invalid, one_hot):
    train = [("b", ["x.", "y", "y"], 1.0), ("a", None, 2.0), ("b", ["y", None], None), ("c", [], 0.0)]
    # more words than fit a plan, a hot row, nulls and unseen values
    train += [("b", [f"w{i}" for i in range(k, k + 40)], float(k)) for k in range(0, 3000, 40)]
    serve = train + [("new", ["zz", "x"], 5.0), (None, ["y"], None)] + [("a", ["y"], 1.0)] * 300
    schema = "v string, arr array<string>, n double"
    df = spark.createDataFrame(train, schema).repartition(3)
    values, sizes = S.fit_value_table(df, ["v"], ["arr"])
    out = S.sparse_features(spark.createDataFrame(serve, schema).repartition(4), values, sizes, ["n"], ["v"], ["arr"], "f",
                            index_invalid=invalid, one_hot=one_hot)
    words = sorted({w.replace(".", "") for _, ws, _ in train for w in ws or [] if w})
    labels = ["b", "a", "c"]
    want = Counter()
    for v, ws, n in serve:
        if invalid == "skip" and v not in labels:
            continue
        i = labels.index(v) if v in labels else len(labels)
        own = Counter(w.replace(".", "") for w in ws or [] if w)
        last = len(labels) - (invalid == "skip")
        idx = [float(i == k) for k in range(last)] if one_hot else [float(i)]
        full = [n if n is not None else "nan", *idx, *[float(own[w]) for w in words]]
        want[(v, tuple(full))] += 1
    got = Counter((r.v, tuple("nan" if x != x else float(x) for x in r.f.toArray())) for r in out.select("v", "f").collect())
    assert got == want
    names = [r.name for r in S.slot_names(values, sizes, ["n"], ["v"], ["arr"], invalid, one_hot).orderBy("slot").collect()]
    assert len(names) == len(next(iter(want))[1]) and names[-len(words):] == [f"arr_{w}" for w in words]
    with pytest.raises(Exception, match="unseen or null label"):
        S.sparse_features(spark.createDataFrame(serve, schema), values, sizes, ["n"], ["v"], ["arr"], "f", index_invalid="error")


def test_pipeline_saves_loads_and_scores(spark, tmp_dir):
    from pyspark.ml import PipelineModel
    from plotline.operators.models import fit_regressor
    from plotline.plans.listing import ListingFit, label_log
    cols, tiers = ListingColumns(), spark.createDataFrame(TIERS, TIER_SCHEMA)
    with ListingFit(listing_df(spark), cols, tiers, index_invalid="keep", fill_missing=0.0, standardize=True) as fit:
        model = fit_regressor("linear", label_log(fit.fitted.transform(fit.clean_train), cols.label), "standardized", "label")
        pipe = fit.pipeline(model)
    pipe.write().overwrite().save(f"{tmp_dir}/p")
    back = PipelineModel.load(f"{tmp_dir}/p")
    new = listing_df(spark, [listing(MaTin=str(i), PhongNgu=str(i % 4), KetCau=f"k{i}") for i in range(8)])
    a, b = ({r.MaTin: r.prediction for r in p.transform(new).collect()} for p in (pipe, back))
    assert a == b and len(a) == 8 and back.stages[1].slot_names() == pipe.stages[1].slot_names()


def test_feature_plan_with_standardization(spark):
    cols = ListingColumns()
    clean, _ = C.clean_raw(listing_df(spark), cols, is_train=True)
    fitted = fit_features(clean, cols, spark.createDataFrame(TIERS, TIER_SCHEMA), index_invalid="keep",
                          fill_missing=0.0, standardize=True)
    out = fitted.transform(clean).select(vector_to_array("features").alias("f"),
                                         vector_to_array("standardized").alias("s")).collect()
    std = fitted.scaler.std.toArray()
    for r in out:
        assert all((s == pytest.approx(f / d) if d > 0 else s == 0.0) for f, s, d in zip(r.f, r.s, std))


def test_label_table_matches_the_indexer_over_many_partitions(spark):
    rows = [(f"v{i * i % 173}",) for i in range(2000)] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "v string").repartition(5)
    got = {r.label: r.idx for r in E.label_table(df, "v").collect()}
    assert got == {v: float(i) for i, v in enumerate(E.index_labels(E.fit_label_indexer(df, ["v"])))}
    fresh = spark.createDataFrame([("v1",), ("new",), (None,)], "v string")
    assert [r.v for r in E.index_by_table(fresh, "v", E.label_table(df, "v")).collect()] == ["v1"]
    kept = E.index_by_table(fresh, "v", E.label_table(df, "v"), how="left").collect()
    assert {r.v: r.v_idx for r in kept} == {"v1": got["v1"], "new": None, None: None}
    assert E.label_table(df.where("v = 'none'"), "v").count() == 0


def test_rows_find_their_values_without_a_join(spark, monkeypatch):
    train = [("b", ["x.", "y", "y"], 1.0, 1), ("a", None, 2.0, 2), ("b", ["y", None], None, 3), ("c", [], 0.0, 4)]
    serve = train + [("new", ["zz", "x"], 5.0, 5), (None, ["y"], None, 6), ("a", ["x", "y", "x."], 0.0, 7), ("a", ["y"], 1.0, 7)]
    schema = "v string, `w,1` array<string>, n double, id long"
    values, sizes = S.fit_value_table(spark.createDataFrame(train, schema), ["v"], ["w,1"])
    df, limit = spark.createDataFrame(serve, schema), spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    for invalid, missing, one_hot in (("keep", "keep", False), ("skip", "keep", True), ("keep", "skip", True), ("skip", "skip", False)):
        def features():
            return S.sparse_features(df, values, sizes, ["n"], ["v"], ["w,1"], "f", invalid, missing, one_hot, keep_inputs=False)
        alone = features()
        with monkeypatch.context() as m:
            m.setattr(S, "FEW_VALUES", 0)                          # as if there were many values
            joined = features()
        plan = alone._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
        assert alone.columns == joined.columns == ["id", "f"] and alone.schema["f"].metadata == joined.schema["f"].metadata
        assert sorted(map(str, alone.collect())) == sorted(map(str, joined.collect()))
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == limit
