"""Sliced ordered passes equal plain windows, whatever the slice width."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cuemill.operators.ordered import Ordered


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_matches_plain_window(spark, width):
    rng = random.Random(4)
    rows = [(rng.choice("aab"), rng.randrange(60), i, rng.choice([None, rng.randrange(9)])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v long")
    got = (
        Ordered(df, ["k"], "t", width, ties=["i"]).row_number("rn").running_sum("s", F.coalesce("v", F.lit(0))).running_max("m", "v")
        .running_max("mx", "v", inclusive=False).lag("p", "i").lead("n", "i").last_value("lv", "v").next_value("nv", "v").result())
    w = Window.partitionBy("k").orderBy("t", "i")
    upto, before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    want = df.select(
        "*", F.row_number().over(w).cast("long").alias("rn"), F.sum(F.coalesce("v", F.lit(0))).over(upto).alias("s"), F.max("v").over(upto).alias("m"), F.max("v").over(before).alias("mx"),
        F.lag("i").over(w).alias("p"), F.lead("i").over(w).alias("n"), F.last("v", True).over(upto).alias("lv"), F.first("v", True).over(after).alias("nv"))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
