"""Interval algebra on media time. All times are integer milliseconds (or frames), half open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.config import CHUNK_MS
from cuemill.operators.ordered import Ordered


def _edges(df: DataFrame, keys, start, end, depth: str, bridge: int = 0) -> DataFrame:
    """One +1 row at every start and one -1 row at every end (+ bridge)."""
    long = df.filter(F.col(end) > F.col(start)).select(
        *keys,
        F.explode(F.array(
            F.struct(F.col(start).cast("long").alias("t"), F.lit(1).alias("d")),
            F.struct((F.col(end) + bridge).cast("long").alias("t"), F.lit(-1).alias("d")),
        )).alias("e"),
    )
    return long.select(*keys, F.col("e.t").alias("t"), F.col("e.d").cast("long").alias(depth))


def _spans(edges: DataFrame, keys, depths: dict[str, str], inside, chunk: int) -> DataFrame:
    """Maximal spans (a, b) on which `inside(depths)` holds.

    Equal times are summed before the shuffle, so a key never holds more rows than it has distinct
    times; the running depth is then taken slice by slice.
    """
    summed = edges.groupBy(*keys, "t").agg(*[F.sum(d).alias(d) for d in depths])
    sweep = Ordered(summed, keys, "t", chunk)
    for d, run in depths.items():
        sweep = sweep.running_sum(run, d)
    after = inside({d: F.col(run) for d, run in depths.items()})
    before = inside({d: F.col(run) - F.col(d) for d, run in depths.items()})
    turns = sweep.result().select(*keys, "t", after.alias("after"), before.alias("before"))
    turns = turns.filter(F.col("after") != F.col("before"))
    paired = Ordered(turns, keys, "t", chunk).lead("b", "t").result()
    return paired.filter("after").select(*keys, F.col("t").alias("a"), "b")


def merge_intervals(df, keys, bridge: int = 0, start="start_ms", end="end_ms", chunk: int = CHUNK_MS) -> DataFrame:
    """Union of intervals per key; gaps of at most `bridge` are closed."""
    edges = _edges(df, keys, start, end, "d", bridge)
    spans = _spans(edges, keys, {"d": "depth"}, lambda v: v["d"] > 0, chunk)
    return spans.select(*keys, F.col("a").alias(start), (F.col("b") - bridge).alias(end))


def subtract_intervals(requested, existing, keys, start="start_ms", end="end_ms", chunk: int = CHUNK_MS) -> DataFrame:
    """Parts of the union of `requested` that `existing` does not cover."""
    edges = _edges(requested, keys, start, end, "d").withColumn("x", F.lit(0).cast("long")).unionByName(
        _edges(existing, keys, start, end, "x").withColumn("d", F.lit(0).cast("long"))
    )
    spans = _spans(
        edges, keys, {"d": "d_depth", "x": "x_depth"}, lambda v: (v["d"] > 0) & (v["x"] == 0), chunk
    )
    return spans.select(*keys, F.col("a").alias(start), F.col("b").alias(end))


def gaps(merged: DataFrame, keys, start="start_ms", end="end_ms", chunk: int = CHUNK_MS) -> DataFrame:
    """Gaps between consecutive merged intervals."""
    following = Ordered(merged, keys, start, chunk).lead("gap_end", start).result()
    return following.filter("gap_end is not null").select(
        *keys, F.col(end).alias("gap_start"), "gap_end", (F.col("gap_end") - F.col(end)).alias("gap_ms")
    )


def _buckets(start: Column, end: Column, width: int) -> Column:
    first = F.floor(start / width).cast("long")
    last = F.floor((end - 1) / width).cast("long")
    return F.sequence(first, F.greatest(first, last))


def interval_join(
    left, right, keys, left_span, right_span, slack: int = 0, width: int = 60_000, closed: bool = False
) -> DataFrame:
    """Pairs whose spans overlap (right spans widened by `slack`), as a bucketed equi-join.

    A pair meets in every bucket both spans touch; only the first common bucket emits it, so no
    de-duplication shuffle is needed. Columns other than `keys` must have distinct names.
    """
    ls, le = F.col(left_span[0]), F.col(left_span[1])
    rs, re = F.col(right_span[0]) - slack, F.col(right_span[1]) + slack
    edge = 1 if closed else 0
    a = left.withColumn("_bucket", F.explode(_buckets(ls, le + edge, width)))
    b = right.withColumn("_bucket", F.explode(_buckets(rs, re + edge, width)))
    joined = a.join(b, [*keys, "_bucket"])
    if closed:
        met = (le >= rs) & (ls <= re)
    else:
        met = (le > rs) & (ls < re)
    first_common = F.greatest(F.floor(ls / width), F.floor(rs / width))
    return joined.filter(met & (F.col("_bucket") == first_common)).drop("_bucket")


def contained(cues: DataFrame, spans: DataFrame, keys, guard_ms: int) -> DataFrame:
    """Cues wholly inside their key's span shrunk by the guard, re-based to the span's start."""
    s, e = F.col("span_start"), F.col("span_end")
    return (
        cues.join(spans.select(*keys, "span_start", "span_end"), keys)
        .filter((F.col("start_ms") >= s + guard_ms) & (F.col("end_ms") <= e - guard_ms))
        .withColumns({"start_ms": F.col("start_ms") - s, "end_ms": F.col("end_ms") - s})
        .drop("span_start", "span_end")
    )


def frame_spans(intervals: DataFrame, keys, start="start_ms", end="end_ms") -> DataFrame:
    """Active 10 ms frames of intervals as spans [frame, until): runs of frames need not be listed one by one."""
    first, last = F.floor(F.col(start) / 10), F.floor(F.col(end) / 10)
    return intervals.filter(last > first).select(*keys, first.alias("frame"), last.alias("until"))


def frames_to_intervals(frames: DataFrame, keys, frame: str = "frame", until: str | None = None) -> DataFrame:
    """Active 10 ms frames to intervals: gaps up to 150 ms closed, pieces under 100 ms dropped.

    A row is one frame, or with `until` the frames from `frame` up to it, which costs two edges whatever its length.
    """
    end = F.col(until) if until else F.col(frame) + 1
    unit = frames.select(*keys, F.col(frame).alias("start_f"), end.alias("end_f"))
    runs = merge_intervals(unit, keys, bridge=15, start="start_f", end="end_f", chunk=CHUNK_MS // 10)
    return runs.filter("end_f - start_f >= 10").select(
        *keys, (F.col("start_f") * 10).alias("start_ms"), (F.col("end_f") * 10).alias("end_ms")
    )


def keyframe_attempts(intervals: DataFrame, points: DataFrame, keys, top: int = 3) -> DataFrame:
    """Per interval the earliest point inside it, else the latest point before it; first `top` per key.

    `intervals(keys, interval_id, start_ms, end_ms)`, `points(keys, t)`. Both choices are neighbour
    look-ups in one ordered pass: the next point at or after the start, the last one at or before.
    """
    from pyspark.sql import Window

    asks = intervals.select(*keys, F.col("start_ms").alias("t"), F.lit(1).alias("ask"), "interval_id", "end_ms")
    marks = points.select(*keys, "t").distinct().select(
        *keys, "t", F.lit(0).alias("ask"), F.lit(None).cast("long").alias("interval_id"), F.lit(None).cast("long").alias("end_ms")
    )
    mark = F.when(F.col("ask") == 0, F.col("t"))
    seen = (
        Ordered(asks.unionByName(marks), keys, "t", CHUNK_MS, ties=["ask", "interval_id"])
        .last_value("before", mark).next_value("after", mark).result().filter("ask = 1")
    )
    inside = F.when(F.col("before") == F.col("t"), F.col("t")).when(F.col("after") <= F.col("end_ms"), F.col("after"))
    chosen = seen.withColumn("point", F.coalesce(inside, "before")).filter("point is not null")
    place = Window.partitionBy(*keys).orderBy("t", "interval_id")
    return (
        chosen.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= top)
        .select(*keys, "interval_id", F.col("t").alias("start_ms"), "end_ms", "point", "place")
    )


def centered_ranges(media: DataFrame, key: str = "media_id") -> DataFrame:
    """Centered 50/60/75 % sample ranges in 10 ms frames, each end rounded once, ties up."""
    d = F.col("duration_s").cast("decimal(18,6)")
    share = F.explode(F.array(*[F.lit(v).cast("decimal(4,2)") for v in ("0.50", "0.60", "0.75")]))
    ranged = media.select(key, d.alias("d"), share.alias("coverage")).filter("d > 0")
    return ranged.select(
        key,
        (F.col("coverage") * 100).cast("long").alias("coverage_pct"),
        F.expr("cast(round(d * (1 - coverage) * 50, 0) as bigint)").alias("start_frame"),
        F.expr("cast(round(d * (1 + coverage) * 50, 0) as bigint)").alias("end_frame"),
        F.expr("cast(ceil(d * 100) as bigint)").alias("movie_frames"),
    )


def extension_segments(ranges: DataFrame, key: str = "media_id", context: int = 200) -> DataFrame:
    """New left and right parts of every coverage step, with the decoding context around them.

    Together with the previous range the owned parts must tile the wider one: `tiles` says so.
    """
    step = F.col("coverage_pct")
    wider = ranges.select(
        key, F.when(step == 60, 50).when(step == 75, 60).cast("long").alias("base_pct"), step.alias("target_pct"),
        F.col("start_frame").alias("t0"), F.col("end_frame").alias("t1"), "movie_frames",
    ).filter("base_pct is not null")
    base = ranges.select(
        key, step.alias("base_pct"), F.col("start_frame").alias("b0"), F.col("end_frame").alias("b1")
    )
    side = F.explode(F.array(
        F.struct(F.lit("left").alias("side"), F.col("t0").alias("o0"), F.col("b0").alias("o1")),
        F.struct(F.lit("right").alias("side"), F.col("b1").alias("o0"), F.col("t1").alias("o1")),
    ))
    parts = wider.join(base, [key, "base_pct"]).withColumn("s", side)
    return parts.select(
        key, "base_pct", "target_pct", F.col("s.side").alias("side"),
        F.col("s.o0").alias("owned_start"), F.col("s.o1").alias("owned_end"),
        F.greatest(F.lit(0).cast("long"), F.col("s.o0") - context).alias("decode_start"),
        F.least(F.col("movie_frames"), F.col("s.o1") + context).alias("decode_end"),
        ((F.col("t0") <= F.col("b0")) & (F.col("b1") <= F.col("t1"))).alias("tiles"),
    ).filter("owned_start < owned_end")


def expand_window(start: Column, end: Column, low: Column, high: Column, width: int) -> tuple[Column, Column]:
    """Widen a window around its centre inside [low, high]."""
    size = F.least(F.lit(width), high - low)
    left = F.greatest(low, F.least((start + end - size) / 2, high - size))
    return left, left + size


# Fixed values of the bounded search, in milliseconds.
SUBWINDOW_LENGTHS = (120_000, 180_000)
SUBWINDOW_SHIFTS = (-150_000, -75_000, 0, 75_000, 150_000)


def _span_of(length: int):
    return lambda s: F.struct(s.cast("long").alias("start_ms"), (s + length).cast("long").alias("end_ms"))


def bounded_subwindows(windows: DataFrame, keys, low="low_ms", high="high_ms") -> DataFrame:
    """At most ten sub-windows per window: two lengths at five centre shifts, clamped, distinct."""
    centre = (F.col(low) + F.col(high)) / 2
    grids = []
    for length in SUBWINDOW_LENGTHS:
        starts = F.array(*[
            F.least(F.col(high) - length, F.greatest(F.col(low), centre + shift - length / 2))
            for shift in SUBWINDOW_SHIFTS
        ])
        grids.append(F.when(
            F.col(high) - F.col(low) >= length,
            F.transform(F.array_sort(F.array_distinct(starts)), _span_of(length)),
        ))
    both = F.explode(F.concat(*[F.coalesce(g, F.array().cast("array<struct<start_ms:bigint,end_ms:bigint>>")) for g in grids]))
    return windows.select(*keys, both.alias("w")).select(*keys, "w.start_ms", "w.end_ms")
