"""Readers and writers (S1–S11) as round trips on own files."""

import json
import os

from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotline import sources as SRC
from plotline.operators import select as S
from tests.listing_fixtures import listings


def test_multiline_json_listing(spark, tmp_dir):
    path = os.path.join(tmp_dir, "raw_0.json")
    with open(path, "w", encoding="utf-8") as fh:
        json.dump(listings()[:3], fh, ensure_ascii=False, indent=2)
    df = SRC.read_listing_json(spark, path)
    assert df.count() == 3
    assert dict(df.dtypes)["TienIchToaNha"] == "array<string>" and dict(df.dtypes)["id"] == "bigint"
    assert df.where(F.col("MaTin") == "1002").select("`Gia/m2`").collect()[0][0] == "104 triệu/m²"


def test_json_lines_and_sinks(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    p1 = SRC.write_json(df, tmp_dir, "raw", overwrite=True)
    assert p1.endswith("/raw") and SRC.read_json_lines(spark, p1).count() == 2
    p2 = SRC.write_json(df, tmp_dir, "raw", overwrite=False)
    assert os.path.basename(p2).startswith("raw_")
    p3 = SRC.write_csv(df, tmp_dir, "url", overwrite=True)
    back = SRC.read_csv(spark, p3)
    assert sorted(back.columns) == ["k", "v"] and dict(back.dtypes)["k"] == "int"


def test_batches(spark, tmp_dir):
    df = spark.range(0, 2500).withColumn("v", F.col("id") * 2)
    path = SRC.write_batches(df, os.path.join(tmp_dir, "temp"), "id", 1000)
    back = spark.read.json(path)
    assert back.count() == 2500 and sorted(r.batch for r in back.select("batch").distinct().collect()) == [0, 1, 2]


def test_batches_written_again_keep_the_others(spark, tmp_dir):
    path = os.path.join(tmp_dir, "again")
    SRC.write_batches(spark.range(30_000), path, "id", 1000, fmt="parquet")
    SRC.write_batches(spark.range(5_000, 6_000), path, "id", 1000, fmt="parquet")
    back = spark.read.parquet(path)
    assert back.count() == 30_000 and back.select("id").distinct().count() == 30_000


def test_lookup_rows_json_and_views(spark, tmp_dir):
    p = os.path.join(tmp_dir, "tiers.csv")
    with open(p, "w", encoding="utf-8") as fh:
        fh.write("Tinh,PhanLoaiTinh\nTỉnh Một,III\nTỉnh Hai,II\n")
    lk = SRC.read_lookup(spark, p)
    assert lk.count() == 2
    schema = T.StructType([T.StructField("ID", T.StringType()), T.StructField("letter", T.StringType())])
    demo = SRC.rows_to_df(spark, [("1", "a"), ("2", "b")], schema)
    SRC.register_view(demo, "demo_letters")
    assert spark.sql("SELECT letter FROM demo_letters WHERE ID = '2'").collect()[0][0] == "b"
    rec = SRC.json_records_to_df(spark, [{"MaTin": "7", "TongGia": "2 tỷ"}],
                                 T.StructType([T.StructField("MaTin", T.StringType()),
                                               T.StructField("TongGia", T.StringType())]))
    assert rec.collect()[0].asDict() == {"MaTin": "7", "TongGia": "2 tỷ"}


def test_filters_and_sql_transformer(spark):
    df = spark.createDataFrame([("Braund, Mr. Owen", 22.0, 0), ('Cumings, "Mr" John', None, 1),
                                ("Heikkinen, Miss Laina", 26.0, 1)], "Name string, Age double, Survived int")
    assert S.where_equals(df, "Survived", 1).count() == 2
    assert S.sql_where_equals(df, "titanic_demo", "Survived", 1).count() == 2
    tagged = S.sql_transform(df, "SELECT *, regexp_extract(Name, '\"(Mr)\"', 1) AS Civility FROM __THIS__")
    assert sorted(r.Civility for r in tagged.collect()) == ["", "", "Mr"]
    assert S.pick_rows(df, "Survived", [0]).count() == 1
    keys = spark.createDataFrame([(1,)], "s int")
    assert S.pick_rows(df, "Survived", keys).count() == 2
    assert S.columns_matching(df.withColumn("a_idx", F.lit(1)), r".*_idx.*") == ["a_idx"]
    assert S.prefixed(df, ["Age", "Name"], "p_").columns == ["p_Age", "p_Name"]


def test_model_save_load(spark, tmp_dir):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "v string")
    model = Pipeline(stages=[StringIndexer(inputCol="v", outputCol="v_idx")]).fit(df)
    path = SRC.save_model(model, os.path.join(tmp_dir, "str_idx"))
    again = SRC.load_pipeline(path)
    assert [r.v_idx for r in again.transform(df).collect()] == [0.0, 1.0, 0.0]


def test_sql_filter_value_is_bound_not_spliced(spark):
    df = spark.createDataFrame([("a'b\\c",), ("x",)], "v string")
    assert S.sql_where_equals(df, "quoted_demo", "v", "a'b\\c").count() == 1


def test_large_json_array_is_read_in_ranges(spark, tmp_dir):
    """One array, many tasks: strings with braces, quotes and escapes, nested objects, any layout."""
    rows = [{"k": i, "t": ["}{", '"}', "\\", '\\"{', "é}\n,{", "", None][i % 7], "o": {"a": "}" * (i % 5), "b": [{"c": i}, {"c": None}]}}
            for i in range(3000)]
    schema = T.StructType.fromDDL("k BIGINT, t STRING, o STRUCT<a: STRING, b: ARRAY<STRUCT<c: BIGINT>>>")
    want = sorted(repr(r) for r in [Row(k=r["k"], t=r["t"], o=Row(a=r["o"]["a"], b=[Row(c=r["k"]), Row(c=None)])) for r in rows])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for indent, size in ((None, "7000"), (2, "20011"), (None, before)):
            path = f"{tmp_dir}/a{indent}{size}.json"
            with open(path, "w", encoding="utf-8") as f:
                json.dump(rows, f, indent=indent, ensure_ascii=indent is None)
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            if size != before:
                assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 5
            assert sorted(repr(r) for r in SRC.read_json_array(spark, path, schema).collect()) == want
        for text, n in (("[]", 0), ("", 0), (" [ ]\n", 0), ('{"k": 1}', 1), ('[{"k": 1}, {"k": "x', 2)):
            path = f"{tmp_dir}/b{n}{len(text)}.json"
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
            assert SRC.read_json_array(spark, path, schema).count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
