"""Places and first rows against plain sorting: ties, nulls, one hot group, more slices than rows, no rows."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators.order import group_places, places, top


def rows(n=400, seed=3):
    r = random.Random(seed)
    return [(r.choice([1, 1, 1, 2, 3, None]), r.choice([None, *range(20)]), i) for i in range(n)]


@pytest.mark.parametrize("slices", [1, 3, 16])
def test_places(spark, slices):
    d = spark.createDataFrame(rows(), "g int, x int, i int")
    got = {r.i: r.place for r in places(d, F.desc_nulls_last("x"), "i", slices=slices).collect()}
    want = sorted(rows(), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
    assert got == {r[2]: k for k, r in enumerate(want)}


def test_group_places(spark):
    d = spark.createDataFrame(rows(), "g int, x int, i int")
    got = {r.i: r.place for r in group_places(d, ["g"], "x", "i", slices=5).collect()}
    want = {}
    for g in (1, 2, 3, None):
        own = sorted((r for r in rows() if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: k for k, r in enumerate(own)}
    assert got == want


def test_top(spark):
    d = spark.createDataFrame(rows(), "g int, x int, i int")
    got = sorted((r.g or 0, r["rank"], r.i) for r in top(d, ["g"], 7, "x", "i", lanes=4).collect())
    want = []
    for g in (1, 2, 3, None):
        own = sorted((r for r in rows() if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want += [(g or 0, k + 1, r[2]) for k, r in enumerate(own[:7])]
    assert got == sorted(want)


def test_no_rows(spark):
    d = spark.createDataFrame([], "g int, x int, i int")
    assert places(d, "x").count() == group_places(d, ["g"], "x").count() == top(d, ["g"], 2, "x").count() == 0
