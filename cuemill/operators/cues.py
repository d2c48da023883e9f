"""Track-level jobs over cue tables (track_id, cue_ix, start_ms, end_ms, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill import config as C
from cuemill.functions import text as T
from cuemill.functions.timecode import format_ms
from cuemill.operators.ordered import Ordered

FINGERPRINT_SLICE = 1_000


def completeness(cues: DataFrame, durations: DataFrame, key: str = "track_id") -> DataFrame:
    """Coverage, distribution and density of every track, and whether it is a complete track.

    `durations(key, duration_ms)`; a missing or non-positive duration falls back to the last cue
    end. The ten occupied tenths are a ten-bit mask, so one partial aggregation is enough.
    """
    ends = cues.groupBy(key).agg(F.max("end_ms").alias("last_end"))
    length = ends.join(durations, key, "left").select(
        key,
        F.when(F.col("duration_ms") > 0, F.col("duration_ms")).otherwise(F.col("last_end")).alias("length_ms"),
    )
    tenth = F.least(F.lit(9), F.greatest(F.lit(0), F.floor(F.col("start_ms") * 10 / F.col("length_ms")))).cast("int")
    early = F.col("start_ms") <= F.col("length_ms") * C.LATE_START_RATIO
    # F.shiftleft takes a Python int only
    bit = F.when(early & (F.col("length_ms") > 0), F.expr("shiftleft(1, _tenth)"))
    span = F.greatest(F.lit(0), F.least(F.lit(C.MAX_ACTIVE_MS), F.col("end_ms") - F.col("start_ms")))
    stats = (
        cues.select(key, "start_ms", "end_ms")
        .join(length, key)
        .withColumn("_tenth", tenth)
        .groupBy(key)
        .agg(
            F.first("length_ms").alias("length_ms"),
            F.count(F.lit(1)).alias("events"),
            F.max("end_ms").alias("last_end_ms"),
            F.coalesce(F.bit_count(F.bit_or(bit)), F.lit(0)).cast("long").alias("bins"),
            F.sum(span).alias("active_ms"),
        )
    )
    return stats.select(key, "length_ms", "events", "last_end_ms", "bins", *_completeness_columns())


def _completeness_columns() -> list[Column]:
    length, n = F.col("length_ms"), F.col("events")
    positive = length > 0
    minutes = F.greatest(F.lit(1.0), length / 60_000)
    coverage = F.when(positive, F.least(F.lit(C.MAX_COVERAGE), F.col("last_end_ms") / length)).otherwise(0.0)
    density = F.when(positive, n / minutes).otherwise(0.0)
    active = F.when(positive, F.least(F.lit(1.0), F.col("active_ms") / length)).otherwise(0.0)
    needed = F.greatest(F.lit(C.MIN_EVENTS), F.floor(minutes * C.MIN_EVENTS_PER_MINUTE_SHARE))
    accepted = (
        positive
        & (n >= needed)
        & (coverage >= C.MIN_COVERAGE)
        & (F.col("bins") >= C.MIN_BINS)
        & (density >= C.MIN_EVENTS_PER_MINUTE)
        & (active >= C.MIN_ACTIVE_RATIO)
    )
    # Weights of the five terms are fixed values.
    score = (
        F.least(F.lit(1.0), n / (needed * 2)) * 30
        + F.least(F.lit(1.0), coverage) * 25
        + F.least(F.lit(1.0), F.col("bins") / 8) * 20
        + F.least(F.lit(1.0), density / 4) * 15
        + F.least(F.lit(1.0), active / 0.18) * 10
    )
    return [
        coverage.alias("coverage"),
        density.alias("events_per_minute"),
        active.alias("active_ratio"),
        F.when(positive, score).otherwise(0.0).alias("score"),
        accepted.alias("accepted"),
    ]


def structure_conflict(profile: DataFrame, duration: str = "length_ms") -> DataFrame:
    """Reason why a track cannot be the film's subtitle (empty if none), and the endpoint check."""
    d, end, n = F.col(duration), F.col("last_end_ms"), F.col("events")
    reason = (
        F.when((d >= 900_000) & (n < 20), "fragment")
        .when((d > 0) & (end < d * 0.55), "incomplete")
        .when((d > 0) & (end > d + F.greatest(F.lit(180_000), d * 0.12)), "overlong")
        .otherwise("")
    )
    return profile.withColumn("conflict", reason).withColumn(
        "endpoint_ok", (d > 0) & (F.abs(d - end) <= 840_000)
    )


def fingerprints(cues: DataFrame, key: str = "track_id") -> DataFrame:
    """Content and timeline fingerprint per track.

    Each cue is hashed, the digests are hashed in slices of cue order, and the slice digests are
    hashed per track, so that a long track never sits whole in one task. Two tracks agree exactly
    if their ordered canonical cues do.
    """
    body = T.casefold(T.collapse(F.regexp_replace("text", r"<[^>]+>|\{\\[^}]+\}", "")))
    clock = F.concat_ws("|", format_ms(F.col("start_ms")), format_ms(F.col("end_ms")))
    rows = cues.select(
        key,
        F.floor((F.col("cue_ix") - 1) / FINGERPRINT_SLICE).alias("part"),
        "cue_ix",
        F.sha2(F.concat_ws("|", clock, body), 256).alias("content"),
        F.sha2(clock, 256).alias("timeline"),
    )

    def chained(order: str, column: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct(order, column)))
        return F.sha2(F.array_join(F.transform(ordered, lambda s: s[column]), "\n"), 256).alias(column)

    slices = rows.groupBy(key, "part").agg(
        chained("cue_ix", "content"), chained("cue_ix", "timeline"), F.count(F.lit(1)).alias("n")
    )
    return slices.groupBy(key).agg(
        chained("part", "content"), chained("part", "timeline"), F.sum("n").alias("events")
    )


def duplicate_groups(prints: DataFrame, column: str = "content", key: str = "track_id") -> DataFrame:
    """Tracks that share a fingerprint: first track of the group and number of copies."""
    return (
        prints.groupBy(column)
        .agg(F.min(key).alias("first_track"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )


def drop_repeated_cues(cues: DataFrame, key: str = "track_id") -> DataFrame:
    """Keep the first of cues equal in start, end and payload."""
    return cues.groupBy(key, "start_ms", "end_ms", "text").agg(
        F.min("cue_ix").alias("cue_ix"), F.count(F.lit(1)).alias("copies")
    )


def reading_load(cues: DataFrame, key: str = "track_id", top: int = 10) -> DataFrame:
    """The `top` cues of every track with the most characters per second."""
    from pyspark.sql import Window

    chars = F.length(F.regexp_replace("text", r"\s", "")).cast("long")
    ms = F.greatest(F.lit(0).cast("long"), F.col("end_ms") - F.col("start_ms"))
    rate = F.when(ms > 0, F.bround(chars * 1000 / ms, 2))
    rows = cues.select(key, "cue_ix", chars.alias("characters"), ms.alias("ms"), rate.alias("rate"))
    place = Window.partitionBy(key).orderBy(F.coalesce("rate", F.lit(0.0)).desc(), "cue_ix")
    return rows.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= top)


def subtitle_blocks(cues: DataFrame, key: str = "track_id") -> DataFrame:
    """Numbered text blocks of a subtitle file: empty cues dropped, the others renumbered from 1."""
    kept = cues.withColumn("text", F.trim("text")).filter(F.length("text") > 0)
    numbered = Ordered(kept, [key], "cue_ix", FINGERPRINT_SLICE).row_number("cue_no").result()
    clock = F.concat(format_ms(F.col("start_ms")), F.lit(" --> "), format_ms(F.col("end_ms")))
    block = F.concat(F.col("cue_no").cast("string"), F.lit("\n"), clock, F.lit("\n"), F.col("text"))
    return numbered.select(key, F.col("cue_no").cast("long").alias("cue_no"), block.alias("block"))


def write_subtitles(cues: DataFrame, path: str, key: str = "track_id") -> None:
    """Write subtitle text, one folder per track; part files of a long track follow in order."""
    blocks = subtitle_blocks(cues, key)
    value = F.when(F.col("cue_no") > 1, F.concat(F.lit("\n"), "block")).otherwise(F.col("block"))
    (
        blocks.withColumn("value", value)
        .repartitionByRange(key, "cue_no")
        .sortWithinPartitions(key, "cue_no")
        .select(key, "value")
        .write.partitionBy(key)
        .text(path)
    )


# Timeline transforms -----------------------------------------------------------------------


def shift(cues: DataFrame, offset: Column) -> DataFrame:
    """Fixed shift; starts clamp at zero and every cue keeps at least one millisecond."""
    start = F.greatest(F.lit(0).cast("long"), F.col("start_ms") + offset)
    end = F.greatest(start + 1, F.col("end_ms") + offset)
    return cues.withColumns({"start_ms": start, "end_ms": end})


def strict_shift(cues: DataFrame, offset: Column, key: str = "track_id") -> DataFrame:
    """Fixed shift that refuses a whole track if any of its times would become negative."""
    moved = cues.withColumns({"start_ms": F.col("start_ms") + offset, "end_ms": F.col("end_ms") + offset})
    refused = moved.groupBy(key).agg(F.min(F.least("start_ms", "end_ms")).alias("low")).filter("low < 0")
    return moved.join(refused.select(key), key, "left_anti")


def affine(cues: DataFrame, offset_ms: Column, scale: Column) -> DataFrame:
    """`offset + scale * t`, rounded half to even."""
    def moved(name: str) -> Column:
        return F.bround(offset_ms + F.col(name) * scale).cast("long")

    return cues.withColumns({"start_ms": moved("start_ms"), "end_ms": moved("end_ms")})


def shift_integrity(before: DataFrame, after: DataFrame, key: str = "track_id") -> DataFrame:
    """Same cues, same texts in the same order, one delta on every start and end."""
    a = before.select(key, "cue_ix", F.col("start_ms").alias("s0"), F.col("end_ms").alias("e0"), F.col("text").alias("t0"))
    b = after.select(key, "cue_ix", F.col("start_ms").alias("s1"), F.col("end_ms").alias("e1"), F.col("text").alias("t1"))
    d_start, d_end = F.col("s1") - F.col("s0"), F.col("e1") - F.col("e0")
    folded = (
        a.join(b, [key, "cue_ix"], "full_outer")
        .groupBy(key)
        .agg(
            F.bool_and(F.col("t0").eqNullSafe(F.col("t1"))).alias("same_text"),
            F.min(F.least(d_start, d_end)).alias("low"),
            F.max(F.greatest(d_start, d_end)).alias("high"),
            F.bool_and(d_start.isNotNull()).alias("same_count"),
        )
    )
    return folded.select(
        key, "same_count", "same_text", F.coalesce(F.col("low") == F.col("high"), F.lit(False)).alias("uniform"),
        F.when(F.col("low") == F.col("high"), F.col("low")).alias("delta_ms"),
    )
