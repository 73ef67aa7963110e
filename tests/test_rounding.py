import random

import pytest

from tsspark.functions.rounding import round_stored


def test_ties_follow_the_stored_value(spark):
    rng = random.Random(4)
    values = [3.125, 2.675, 2.665, 0.5, 1.5, -2.675, -3.125, 1.005, 0.0, -0.0, 1e15, 123456.785, 1e300, 0.1 + 0.2, 99.995]
    values += [round(rng.uniform(-1000, 1000), 3) for _ in range(2000)] + [k / 8 for k in range(-80, 80)] + [rng.uniform(-1, 1) * 10 ** rng.randint(-6, 9) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 4, 6):
        for v, got in df.select("v", round_stored(df["v"], digits)).collect():
            assert got == round(v, digits), (v, digits)


def test_missing_and_bounds(spark):
    df = spark.createDataFrame([(None,), (float("inf"),)], "v double")
    assert [r[0] for r in df.select(round_stored(df["v"], 2)).collect()] == [None, float("inf")]
    with pytest.raises(ValueError):
        round_stored(df["v"], 7)
