"""Running totals over blocks give what one window gives."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from streamloom.operators.order import numbered, running


@pytest.mark.parametrize("levels", [1, 2])
@pytest.mark.parametrize("how", ["sum", "max", "last"])
def test_running_equals_a_window(spark, how, levels):
    rng = random.Random(7)
    rows = [(rng.choice([1, 1, 1, 2, None]), p, rng.choice([None, rng.randrange(100)])) for p in rng.sample(range(400), 150)]
    t = spark.createDataFrame(rows, "k long, pos long, v long").repartition(3)
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    fold = {"sum": F.sum("v"), "max": F.max("v"), "last": F.last("v", ignorenulls=True)}[how]
    got = running(t, "r", F.col("v"), how, keys=("k",), levels=levels, bits=3)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, t.withColumn("r", fold.over(w)).collect()))


def test_numbers_over_ties(spark):
    t = spark.createDataFrame([(9, 2), (0, 1), (9, 1), (9, 3), (2**40, 1)], "pos long, rank long")
    got = numbered(t, "id", ties=("rank",), levels=2).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1), (9, 1, 2), (9, 2, 3), (9, 3, 4), (2**40, 1, 5)]
    assert numbered(t.limit(0), "id").collect() == []
