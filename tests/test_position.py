import hashlib

import pytest
from pyspark.sql import functions as F

from tsforge.operators.position import (
    chronological_split,
    every_kth,
    global_position,
    seeded_shuffle,
    split_fractions,
    tail_holdout,
)


def test_positions_with_null_keys_and_a_hot_bucket(spark):
    rows = [(d, i, t) for d, i, n in ((1, "a", 50), (1, None, 2), (None, "a", 3), (2, "b", 1)) for t in range(n)]
    df = spark.createDataFrame(rows, "d int, i string, t int")
    out = global_position(df, ["d", "i"], ["t"]).collect()
    expected = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", r[2]))
    assert [(r.d, r.i, r.t) for r in sorted(out, key=lambda r: r.position)] == expected
    assert sorted(r.position for r in out) == list(range(len(rows)))


def test_positions_restart_within_groups(spark):
    df = spark.createDataFrame([("x", 1, 5), ("x", 2, 1), ("y", 1, 9), ("x", 1, 2)], "g string, d int, t int")
    out = {(r.g, r.d, r.t): r.p for r in global_position(df, ["d"], ["t"], "p", ["g"]).collect()}
    assert out == {("x", 1, 2): 0, ("x", 1, 5): 1, ("x", 2, 1): 2, ("y", 1, 9): 0}


def test_shuffle_is_the_order_of_the_hash(spark):
    df = spark.range(500).withColumn("name", F.concat(F.lit("n"), F.col("id")))
    order = sorted(range(500), key=lambda i: hashlib.md5(f"7#{i}#n{i}".encode()).hexdigest())
    for parts in (1, 4, 33):
        out = seeded_shuffle(df.repartition(parts), 7, ["id", "name"]).orderBy("position").collect()
        assert [r.id for r in out] == order
    other = seeded_shuffle(df, 8, ["id", "name"]).orderBy("position").collect()
    assert [r.id for r in other] != order


def test_every_kth(spark):
    df = spark.range(100).withColumnRenamed("id", "position")
    assert [r.position for r in every_kth(df, 30).orderBy("position").collect()] == [0, 30, 60, 90]


def test_fractions_leave_the_rest_out(spark):
    df = spark.range(21).withColumnRenamed("id", "position")
    out = split_fractions(df, {"train": 0.75, "val": 0.125, "test": 0.125}, F.lit(21)).orderBy("position").collect()
    assert [r.split for r in out] == ["train"] * 15 + ["val"] * 2 + ["test"] * 2 + [None] * 2


@pytest.mark.parametrize("n, n_train", [(5, 4), (15, 14), (90, 81), (25, 22)])
def test_chronological_split_rounds_half_to_even(spark, n, n_train):
    df = spark.range(n).select(F.lit(None).cast("string").alias("s"), F.col("id").alias("bin"))
    out = chronological_split(df, 0.9, ["s"]).orderBy("bin").collect()
    assert [r.split for r in out] == ["train"] * n_train + ["test"] * (n - n_train)


def test_tail_holdout(spark):
    df = spark.range(11).withColumnRenamed("id", "position")
    out = tail_holdout(df, 0.2, F.lit(11)).orderBy("position").collect()
    assert [r.split for r in out] == ["train"] * 8 + ["val"] * 3
