"""Nearest-neighbour joins on one time axis, without pairwise comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.config import CHUNK_MS
from cuemill.operators.ordered import Ordered


def nearest(points: DataFrame, reference: DataFrame, keys, t: str = "t", chunk: int = CHUNK_MS) -> DataFrame:
    """Distinct points with the reference time nearest to each (the earlier one on a tie).

    Both sides are reduced to distinct times and laid on one axis; the last reference at or before
    and the next at or after a point come from one ordered pass.
    """
    axis = (
        points.select(*keys, t, F.lit(1).alias("p"), F.lit(0).alias("r"))
        .unionByName(reference.select(*keys, t, F.lit(0).alias("p"), F.lit(1).alias("r")))
        .groupBy(*keys, t).agg(F.max("p").alias("p"), F.max("r").alias("r"))
    )
    mark = F.when(F.col("r") == 1, F.col(t))
    seen = Ordered(axis, keys, t, chunk).last_value("before", mark).next_value("after", mark).result()
    before, after = F.col("before"), F.col("after")
    chosen = F.when(
        after.isNull() | (F.col(t) - before <= after - F.col(t)), before
    ).otherwise(after)
    return (
        seen.filter("p = 1").withColumn("nearest", F.coalesce(chosen, after))
        .select(*keys, t, "nearest", F.abs(F.col(t) - F.col("nearest")).alias("distance"))
    )


def share_alignment(candidate: DataFrame, anchor: DataFrame, keys) -> DataFrame:
    """Do the cue starts of two tracks sit on one clock?

    Every start is looked at; at least 20 cues on both sides, 55 % within 1.5 s and a median distance
    of at most 0.8 s.
    """
    sizes = candidate.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_candidate")).join(
        anchor.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_anchor")), keys
    )
    measured = candidate.select(*keys, "cue_id", "t").join(sizes, keys).join(nearest(candidate, anchor, keys), [*keys, "t"])
    folded = measured.groupBy(*keys).agg(
        F.first("n_candidate").alias("n_candidate"), F.first("n_anchor").alias("n_anchor"),
        F.count(F.lit(1)).alias("sampled"), F.count_if(F.col("distance") <= 1_500).alias("close"),
        F.median("distance").alias("median_ms"),
    )
    return folded.withColumn(
        "aligned",
        (F.col("n_candidate") >= 20) & (F.col("n_anchor") >= 20)
        & (F.col("close") / F.col("sampled") >= 0.55) & (F.col("median_ms") <= 800),
    )


def mutual_nearest(left: DataFrame, right: DataFrame, keys, tolerance: int = 500) -> DataFrame:
    """Starts that are each other's nearest neighbour within the tolerance.

    `left`, `right`: (keys, start_ms, end_ms). Of intervals with one start the shortest stands for
    the start.
    """
    a = left.groupBy(*keys, F.col("start_ms").alias("t")).agg(F.min("end_ms").alias("left_end"))
    b = right.groupBy(*keys, F.col("start_ms").alias("t")).agg(F.min("end_ms").alias("right_end"))
    forward = nearest(a, b, keys).filter(F.col("distance") <= tolerance)
    reverse = nearest(b, a, keys).filter(F.col("distance") <= tolerance)
    pairs = forward.select(*keys, F.col("t").alias("left_start"), F.col("nearest").alias("right_start")).join(
        reverse.select(*keys, F.col("nearest").alias("left_start"), F.col("t").alias("right_start")),
        [*keys, "left_start", "right_start"],
    )
    return pairs.join(a.withColumnRenamed("t", "left_start"), [*keys, "left_start"]).join(
        b.withColumnRenamed("t", "right_start"), [*keys, "right_start"]
    )


def anchor_evidence(left, right, windows, keys) -> DataFrame:
    """Is a window backed by mutual-nearest starts? `windows(keys, low_ms, high_ms)`."""
    def inside(df):
        return df.join(windows, keys).filter(
            (F.col("start_ms") > F.col("low_ms")) & (F.col("start_ms") < F.col("high_ms"))
        ).select(*keys, "start_ms", "end_ms")

    a, b = inside(left).distinct(), inside(right).distinct()
    sizes = (
        a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_left"))
        .join(b.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_right")), keys)
    )
    d_start = F.col("left_start") - F.col("right_start")
    d_end = F.col("left_end") - F.col("right_end")
    quarter = F.least(F.lit(3), F.floor(
        (F.col("left_start") - F.col("low_ms")) * 4 / (F.col("high_ms") - F.col("low_ms")))).cast("int")
    folded = mutual_nearest(a, b, keys).join(windows, keys).withColumn("_q", quarter).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.bit_count(F.bit_or(F.expr("shiftleft(1, _q)"))).cast("long").alias("quarters"),
        F.median(d_start).alias("start_error_ms"),
        F.median(d_end - d_start).alias("duration_error_ms"),
    )
    ratio = F.col("pairs") / F.least("n_left", "n_right")
    return sizes.join(folded, keys).withColumn(
        "sufficient",
        (F.col("pairs") >= 15) & (ratio >= 0.75) & (F.col("quarters") >= 3) & (F.abs("duration_error_ms") <= 1_000),
    )
