import pytest
from pyspark.sql import functions as F

from foldyard.errors import ConfigDataError
from foldyard.plans.dataset import Dataset, spread_arrays
from foldyard.sources.tables import (
    align_folds,
    drop_missing_target,
    project,
    read_folds,
    read_metadata,
    read_table,
)


def _write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_and_parquet_files_and_folders(spark, tmp_path):
    csv = _write(tmp_path / "a.csv", "x,name\n1.5,a\n2.5,b\n")
    frame = read_table(spark, csv)
    assert frame.dtypes == [("x", "double"), ("name", "string")]
    assert read_table(spark, csv, "x float, name string").dtypes[0] == ("x", "float")
    folder = str(tmp_path / "b.parquet")
    frame.write.parquet(folder)
    assert read_table(spark, folder).count() == 2


def test_missing_and_unsupported_files(spark, tmp_path):
    with pytest.raises(ConfigDataError, match="not found"):
        read_table(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ConfigDataError, match="Unsupported"):
        read_table(spark, _write(tmp_path / "a.txt", "x\n1\n"))


@pytest.mark.parametrize(
    "text,expected",
    [
        ("row_id,fold_id\n2,9\n0,7\n1,8\n", [7, 8, 9]),
        ("row_id,fold_id\n20,9\n0,7\n10,8\n", [7, 8, 9]),
        ("fold_id\n2\n1\n0\n", [2, 1, 0]),
        ("anything\n4\n5\n6\n", [4, 5, 6]),
    ],
)
def test_fold_file_forms(spark, tmp_path, text, expected):
    folds = read_folds(spark, _write(tmp_path / "f.csv", text), 3)
    rows = folds.orderBy("_row_id").collect()
    assert [r["_row_id"] for r in rows] == [0, 1, 2]
    assert [r["fold_id"] for r in rows] == expected


def test_bad_fold_files(spark, tmp_path):
    with pytest.raises(ConfigDataError, match="must be named fold_id"):
        read_folds(spark, _write(tmp_path / "f.csv", "a,b\n1,2\n"), 1)
    with pytest.raises(ConfigDataError, match="folds for 2 rows"):
        read_folds(spark, _write(tmp_path / "g.csv", "fold_id\n0\n1\n"), 3)


def test_metadata_is_optional(spark, tmp_path):
    assert read_metadata(spark, None) == {}
    path = _write(tmp_path / "m.json", '{\n "target": "y",\n "columns": ["a", "y"]\n}')
    assert read_metadata(spark, path)["target"] == "y"
    with pytest.raises(ConfigDataError, match="not found"):
        read_metadata(spark, str(tmp_path / "none.json"))


def test_alignment_needs_every_row(spark):
    data = spark.range(4).withColumnRenamed("id", "_row_id")
    folds = data.withColumn("fold_id", F.col("_row_id").cast("int") % 2)
    joined = align_folds(data, folds)
    assert sorted((r["_row_id"], r["fold"]) for r in joined.collect()) == [(0, 0), (1, 1), (2, 0), (3, 1)]
    for given in (folds.where("_row_id < 3"), folds.withColumn("_row_id", F.col("_row_id") + 1)):
        found = Dataset.build(align_folds(data, given), ["_row_id"], "_row_id", "regression", "fold", 4)
        with pytest.raises(ConfigDataError, match="folds fit 3 rows"):
            found.profile


def test_projection_contract(spark):
    frame = spark.createDataFrame([(1, 2, 3)], "a int, b int, y int")
    assert project(frame, "y", None) == ["a", "b"]
    assert project(frame, "y", None, ["b"]) == ["a"]
    with pytest.raises(ConfigDataError, match="No target column"):
        project(frame, "missing", None)
    with pytest.raises(ConfigDataError, match="at least one column name"):
        project(frame, "y", "a")
    with pytest.raises(ConfigDataError, match="named as features"):
        project(frame, "y", ["a", "z"])


def test_hook_and_negative_check(spark):
    frame = spark.createDataFrame(
        [(1.0, 1.0), (float("nan"), None), (0.0, float("nan"))], "x double, y double"
    )
    kept = drop_missing_target(frame, {"drop_na_target": True, "target_column": "y"})
    assert kept.count() == 1
    assert drop_missing_target(frame, {}).count() == 3
    tagged = frame.withColumns({"z": F.lit(-1), "fold": F.lit(0)})
    assert not Dataset.build(tagged, ["x", "y"], "x", "regression", "fold").profile.any_negative
    assert Dataset.build(tagged, ["x", "z"], "x", "regression", "fold").profile.any_negative


def test_array_features_spread_over_columns(spark):
    frame = spark.createDataFrame([([1.0, 2.0], 5.0), (None, 6.0), ([3.0, 4.0], 7.0)], "v array<double>, x double")
    spread, features = spread_arrays(frame, ["x", "v"])
    assert features == ["x", "v_0", "v_1"]
    assert [tuple(r) for r in spread.select(*features).collect()] == [(5.0, 1.0, 2.0), (6.0, None, None), (7.0, 3.0, 4.0)]
    assert spread_arrays(frame, ["x"])[1] == ["x"]
    uneven = frame.union(spark.createDataFrame([([1.0], 1.0)], frame.schema))
    with pytest.raises(ConfigDataError, match="one length"):
        spread_arrays(uneven, ["v"])
