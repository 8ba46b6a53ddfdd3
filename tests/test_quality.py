from tsforge.operators.quality import (
    missing_profile,
    nan_count,
    null_cells_total,
    row_counts,
    rows_with_any_null,
    split_covers_all,
)

NAN = float("nan")


def frame(spark):
    return spark.createDataFrame([(1.0, "a"), (NAN, None), (None, "c"), (NAN, "d")], "x double, s string")


def test_nan_and_null_are_told_apart(spark):
    assert nan_count(frame(spark), "x").first().x_NaN_count == 2
    assert {tuple(r) for r in missing_profile(frame(spark)).collect()} == {("x", 1, 2), ("s", 1, 0)}


def test_null_cells_and_rows(spark):
    assert null_cells_total(frame(spark)).first().null_cells == 2
    assert rows_with_any_null(frame(spark)).count() == 2
    assert rows_with_any_null(frame(spark).select("s")).count() == 1
    assert null_cells_total(frame(spark).limit(0)).first().null_cells == 0


def test_counts(spark):
    rows = spark.createDataFrame([("train",), ("train",), ("test",)], "split string")
    assert {tuple(r) for r in row_counts(rows, "split").collect()} == {("train", 2), ("test", 1)}
    assert tuple(split_covers_all(rows).first()) == (2, 1, 3, True)
