import pytest

from kelpline.operators.skew import salted_join


def test_salted_join_equals_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}", "x") for i in range(300)] + [(None, None, "n")], "i int, k string, v string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("gone", 3), (None, 4)], "k string, w int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = salted_join(left, right, ["k"], how, by="i")
        want = left.join(right, "k", how).select(*got.columns)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert salted_join(left.limit(0), right, ["k"], "inner", by="i").isEmpty() and salted_join(left, right.limit(0), ["k"], "left_anti", by="i").count() == 301
    with pytest.raises(ValueError):
        salted_join(left, right, ["k"], "full_outer", by="i")


def test_release_deletes_what_was_materialized(spark):
    import os

    from kelpline.session import materialize, release, shared_dir

    materialize(spark.range(3), "gone").count()
    folder = f"{shared_dir(spark).removeprefix('file://')}/kelpline/{spark.sparkContext.applicationId}"
    assert os.path.isdir(folder)
    release(spark)
    assert not os.path.exists(folder)
