import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.functions import arrays, ranges

CASES = [
    ("6,2-4,1:3:^2", 12, [6, 2, 3, 4, 1, 4, 7]),
    ("^4-^2,0:5:9", 10, [5, 6, 7, 0, 5]),
    ("/0-2,7", 9, [3, 4, 5, 6, 8]),
    ("0-3/2;5-6/0", 8, [0, 1, 3, 5, 6]),
    ("4,3,1,0", 5, [4, 3, 1, 0]),
    ("all", 3, [0, 1, 2]),
    ("nil", 3, []),
    ("3-1", 5, [3, 2, 1]),
    ("2,2", 5, [2, 2]),
]


@pytest.mark.parametrize(("spec", "n", "want"), CASES)
def test_range_language(spec, n, want):
    assert ranges.parse(spec, n) == want


@pytest.mark.parametrize("spec", ["5", "a", "1--2", "^5"])
def test_range_errors(spec):
    with pytest.raises(ValueError):
        ranges.parse(spec, 5)


@given(st.integers(1, 50), st.data())
def test_steps_are_pythons(n, data):
    a, b, s = data.draw(st.integers(0, n - 1)), data.draw(st.integers(0, n - 1)), data.draw(st.integers(1, 7))
    if a <= b:
        assert ranges.parse(f"{a}:{s}:{b}", n) == list(range(a, b + 1, s))


def test_select_keeps_order_and_repeats(spark):
    df = spark.createDataFrame([(i, f"r{i}") for i in range(5)], "n int, v string")
    rows = ranges.select(df, "n", "4,1,4", 5, "place").orderBy("place").collect()
    assert [r["v"] for r in rows] == ["r4", "r1", "r4"]


@pytest.mark.parametrize(("spec", "n", "want"), CASES)
def test_named_places_are_the_lists(spark, spec, n, want):
    """The arithmetic form names the same numbers in the same order as the list."""
    rows = ranges.select(spark.range(n), "id", spec, n, "place").orderBy("place").collect()
    assert [r["id"] for r in rows] == want


def test_labels_out_of_range(spark):
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([(3,)], "x int").select(arrays.one_hot(F.col("x"), 3)).collect()


def test_row_transforms(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([0.0, 0.0, 0.0],)], "x array<double>")
    x = df.x
    rows = df.select(arrays.softmax(x).alias("s"), arrays.l2(x).alias("l"), arrays.dct(x, 3).alias("d"), arrays.one_hot(arrays.argmax(x), 3).alias("o"), arrays.entropy(arrays.softmax(x)).alias("h")).collect()
    assert math.isclose(sum(rows[0]["s"]), 1) and rows[1]["l"] == [0, 0, 0] and rows[0]["o"] == [0, 0, 1]
    assert rows[0]["d"] == pytest.approx([(1 + 3 + 4) / 2, (1 - 3) / 2, (1 + 3 - 4) / 2])
    assert rows[1]["h"] == pytest.approx(math.log2(3))
