"""Offset estimation between two timelines. Times are integer milliseconds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill import config as C
from cuemill.operators.intervals import interval_join, merge_intervals


def unique_text_pairs(left: DataFrame, right: DataFrame, keys, text_key: str = "text_key") -> DataFrame:
    """Start pairs of texts that occur exactly once on either side.

    Both sides are counted per text first, so a text repeated a million times costs one row.
    """
    def once(df, name):
        return df.groupBy(*keys, text_key).agg(
            F.count(F.lit(1)).alias("n"), F.min("start_ms").alias(name)
        ).filter("n = 1").drop("n")

    return once(left, "left_ms").join(once(right, "right_ms"), [*keys, text_key])


def _pair_support(pairs: DataFrame, durations: DataFrame, keys) -> DataFrame:
    quarter = F.least(F.lit(3), F.greatest(F.lit(0), F.floor(
        F.col("left_ms") * 4 / F.greatest(F.col("duration_ms"), F.lit(1_000))))).cast("int")
    return pairs.join(durations, keys).withColumn("_q", quarter).groupBy(*keys).agg(
        F.first("duration_ms").alias("duration_ms"),
        F.count(F.lit(1)).alias("pairs"),
        ((F.max("left_ms") - F.min("left_ms")) / F.first("duration_ms")).alias("span"),
        F.bit_count(F.bit_or(F.expr("shiftleft(1, _q)"))).cast("long").alias("quarters"),
    ).withColumn(
        "supported",
        (F.col("pairs") >= C.FIT_MIN_PAIRS) & (F.col("span") >= C.FIT_MIN_SPAN)
        & (F.col("quarters") >= C.FIT_MIN_QUARTERS),
    )


def _residual_summary(rows: DataFrame, keys, residual: str, weight: str) -> DataFrame:
    """Median and 90th percentile (an observed value) of counted residuals."""
    counted = rows.groupBy(*keys, residual).agg(F.sum(weight).alias("n"))
    upto = Window.partitionBy(*keys).orderBy(residual)
    whole = Window.partitionBy(*keys)
    ranked = counted.withColumns({"seen": F.sum("n").over(upto), "total": F.sum("n").over(whole)})
    return ranked.groupBy(*keys).agg(
        F.first("total").alias("inliers"),
        F.percentile(residual, F.lit(0.5), F.col("n")).alias("median_residual"),
        F.min(F.when(F.col("seen") >= F.ceil(F.col("total") * 9 / 10), F.col(residual))).alias("p90_residual"),
    )


def fixed_offset(pairs: DataFrame, durations: DataFrame, keys) -> DataFrame:
    """One constant offset from start pairs, refitted on its inliers.

    Only the distribution of `right - left` matters after the support test, so it is counted per
    offset value before any second pass.
    """
    pairs = pairs.select(*keys, "left_ms", "right_ms").distinct()
    support = _pair_support(pairs, durations, keys)
    counted = pairs.groupBy(*keys, (F.col("right_ms") - F.col("left_ms")).alias("offset")).agg(F.count(F.lit(1)).alias("n"))

    def centre(df, name):
        return df.groupBy(*keys).agg(F.percentile("offset", F.lit(0.5), F.col("n")).alias(name))

    near = counted.join(centre(counted, "first"), keys).filter(F.abs(F.col("offset") - F.col("first")) <= C.FIT_INLIER_MS)
    fitted = near.select(*keys, "offset", "n").join(centre(near, "offset_ms"), keys)
    residual = F.abs(F.col("offset") - F.col("offset_ms"))
    summary = _residual_summary(fitted.withColumn("residual", residual), keys, "residual", "n")
    return support.join(centre(near, "offset_ms"), keys, "left").join(summary, keys, "left").withColumn(
        "accepted",
        F.coalesce(
            F.col("supported") & (F.col("inliers") >= C.FIT_MIN_PAIRS)
            & (F.col("inliers") >= F.ceil(F.col("pairs") * C.FIT_MIN_SPAN))
            & (F.abs("offset_ms") <= C.MAX_AUTOMATIC_OFFSET_MS)
            & (F.col("median_residual") <= C.FIT_MEDIAN_MS) & (F.col("p90_residual") <= C.FIT_P90_MS),
            F.lit(False),
        ),
    )


def _median_slope(x: np.ndarray, y: np.ndarray, gap: float, hold: int = 4_000_000) -> float:
    """Median of (y_j - y_i) / (x_j - x_i) over pairs at least `gap` apart, one row of pairs at a time."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    first = np.searchsorted(x, x + gap, side="left")
    total = int((len(x) - first).sum())
    if total == 0:
        return float("nan")

    def row(i):
        return (y[first[i]:] - y[i]) / (x[first[i]:] - x[i])

    if total <= hold:
        return float(np.median(np.concatenate([row(i) for i in range(len(x))])))
    # Too many slopes to hold: pick the middle ones by bisection on the ordered bit patterns.
    def at(rank):
        low, high = -(1 << 63), (1 << 63) - 1
        while low < high:
            middle = (low + high) // 2
            bound = np.int64(middle if middle >= 0 else middle ^ 0x7FFFFFFFFFFFFFFF).view(np.float64)
            below = 0 if np.isnan(bound) and middle < 0 else total if np.isnan(bound) else sum(
                int(np.count_nonzero(row(i) <= bound)) for i in range(len(x))
            )
            low, high = (low, middle) if below >= rank else (middle + 1, high)
        return float(np.int64(low if low >= 0 else low ^ 0x7FFFFFFFFFFFFFFF).view(np.float64))

    return (at((total + 1) // 2) + at(total // 2 + 1)) / 2


def affine_offset(pairs: DataFrame, durations: DataFrame, keys, gap_ms: int = 60_000) -> DataFrame:
    """`right = offset + scale * left`: median pairwise slope, inliers, least squares, known scale.

    The slope median of one film needs all its pairs of cues; it is taken inside the task that
    holds the film's matched cues, row by row, so no pair ever becomes a DataFrame row.
    """
    from cuemill.operators.grouped import spread

    pairs = pairs.select(*keys, "left_ms", "right_ms")
    support = _pair_support(pairs, durations, keys)
    schema = ", ".join(f"{k} {dict(pairs.dtypes)[k]}" for k in keys) + ", slope double"

    def slope(pdf: pd.DataFrame) -> pd.DataFrame:
        value = _median_slope(pdf["left_ms"].to_numpy(float), pdf["right_ms"].to_numpy(float), float(gap_ms))
        return pdf.iloc[:1][keys].assign(slope=value)

    slopes = spread(pairs, *keys).groupBy(*keys).applyInPandas(slope, schema).filter(~F.isnan("slope"))
    with_slope = pairs.join(slopes, keys)
    lead = with_slope.groupBy(*keys).agg(F.median(F.col("right_ms") - F.col("slope") * F.col("left_ms")).alias("intercept"))
    near = with_slope.join(lead, keys).filter(
        F.abs(F.col("right_ms") - (F.col("intercept") + F.col("slope") * F.col("left_ms"))) <= C.FIT_INLIER_MS
    )
    line = near.groupBy(*keys).agg(
        F.regr_slope("right_ms", "left_ms").alias("scale"), F.regr_intercept("right_ms", "left_ms").alias("offset_ms")
    )
    residual = F.abs(F.col("right_ms") - (F.col("offset_ms") + F.col("scale") * F.col("left_ms")))
    summary = near.select(*keys, "left_ms", "right_ms").join(line, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("inliers"), F.median(residual).alias("median_residual"),
        F.expr("percentile_disc(0.9) within group (order by abs(right_ms - (offset_ms + scale * left_ms)))").alias("p90_residual"),
    )
    known = F.least(*[F.abs(F.col("scale") - s) for _, s in C.TIMELINE_SCALES]) <= 0.002
    return support.join(line, keys, "left").join(summary, keys, "left").withColumn(
        "accepted",
        F.coalesce(
            F.col("supported") & (F.col("inliers") >= C.FIT_MIN_PAIRS)
            & (F.col("inliers") >= F.ceil(F.col("pairs") * C.FIT_MIN_SPAN)) & known
            & (F.abs("offset_ms") <= C.MAX_AUTOMATIC_OFFSET_MS)
            & (F.col("median_residual") <= C.FIT_MEDIAN_MS) & (F.col("p90_residual") <= C.FIT_P90_MS),
            F.lit(False),
        ),
    )


# Activity correlation ----------------------------------------------------------------------


def activity_runs(intervals: DataFrame, keys, cell_ms: int) -> DataFrame:
    """Merged runs [a, b) of active cells; an interval fills at least one cell."""
    a = F.greatest(F.lit(0).cast("long"), F.bround(F.col("start_ms") / cell_ms).cast("long"))
    b = F.greatest(a + 1, F.bround(F.col("end_ms") / cell_ms).cast("long"))
    cells = intervals.select(*keys, a.alias("a"), b.alias("b"))
    return merge_intervals(cells, keys, start="a", end="b", chunk=C.CHUNK_MS // cell_ms)


def run_overlap(reference: DataFrame, candidate: DataFrame, keys, width: int) -> DataFrame:
    """Common cells of two sets of merged runs, summed per key."""
    right = reference.select(*keys, F.col("a").alias("ra"), F.col("b").alias("rb"))
    met = interval_join(candidate, right, keys, ("a", "b"), ("ra", "rb"), width=width)
    common = F.least("b", "rb") - F.greatest("a", "ra")
    return met.groupBy(*keys).agg(F.sum(common).alias("overlap"))


def _edges(runs: DataFrame, keys, weight: int) -> DataFrame:
    both = F.explode(F.array(
        F.struct(F.col("a").alias("at"), F.lit(weight).alias("w")),
        F.struct(F.col("b").alias("at"), F.lit(-weight).alias("w")),
    ))
    return runs.select(*keys, both.alias("e")).select(*keys, "e.at", F.col("e.w").cast("long").alias("w"))


def curve_steps(ref_edges, cand_edges, keys, low: int, high: int) -> DataFrame:
    """(keys, k, x): sums of products of edge weights at distance k in [low, high], where there are any."""
    width = max(64, high - low)

    def summed(edges):
        return edges.groupBy(*keys, "at").agg(F.sum("w").alias("w")).filter("w <> 0")

    left = summed(cand_edges).withColumn("_bucket", F.explode(F.sequence(
        F.floor((F.col("at") + low) / width), F.floor((F.col("at") + high) / width))))
    right = summed(ref_edges).select(*keys, F.col("at").alias("rt"), F.col("w").alias("rw")).withColumn(
        "_bucket", F.floor(F.col("rt") / width))
    k = F.col("rt") - F.col("at")
    return (
        left.join(right.hint("merge"), [*keys, "_bucket"]).filter(k.between(low, high))
        .groupBy(*keys, k.alias("k")).agg(F.sum(F.col("w") * F.col("rw")).alias("x"))
    )


def _cells(at: np.ndarray, until: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Active cells [a, b) of spans in milliseconds; a span fills at least one cell."""
    a = np.maximum(0, np.rint(at / size))
    return a, np.maximum(a + 1, np.rint(until / size))


def _added(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each span [a, b) adds to the union of those before it, in the order of their starts."""
    reached = np.maximum.accumulate(b, axis=-1)
    first = np.maximum(a, np.concatenate((np.full((*b.shape[:-1], 1), -1.0), reached[..., :-1]), axis=-1))
    return first, np.maximum(first, b)


def _union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint runs [a, b) in order that cover the same cells."""
    order = np.argsort(a, kind="stable")
    a, b = _added(a[order], b[order])
    return a[b > a], b[b > a]


def _common(edges: np.ndarray, below: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cells of the runs [a, b) that a union covers; `below` counts its cells up to each of its `edges`."""
    return np.rint((np.interp(b, edges, below) - np.interp(a, edges, below)).sum(axis=-1))


def _counted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of disjoint runs, and the number of cells up to each."""
    edges = np.stack((a, b), 1).ravel()
    return edges, np.concatenate(([0], np.cumsum(np.stack((b - a, 0 * a), 1).ravel())[:-1]))


def _overlaps(reference: tuple, candidate: tuple, shifts: np.ndarray, hold: int = 1_000_000) -> np.ndarray:
    """Common cells of two sets of disjoint runs at every shift of the candidate; `hold` numbers are held at a time."""
    (edges, below), (a, b) = _counted(*reference), candidate
    found = np.zeros(len(shifts))
    for part in np.array_split(np.arange(len(shifts)), min(len(shifts), 1 + len(shifts) * len(a) // hold)):
        move = shifts[part][:, None]
        found[part] = _common(edges, below, a + move, b + move)
    return found


# Cells of the coarse and the fine grid, and the shifts that are tried on each, in its own cells.
COARSE_MS, COARSE_SHIFTS, FINE_MS, FINE_SHIFTS = 500, np.arange(-240, 241), 100, np.arange(-10, 11)


def _film_shift(r_at, r_until, c_at, c_until) -> tuple[int, int, int]:
    """Best shift of one film in fine cells, its overlap, and the smaller number of active fine cells."""
    def grid(size):
        return _union(*_cells(r_at, r_until, size)), _union(*_cells(c_at, c_until, size))

    coarse = COARSE_SHIFTS[np.argmax(_overlaps(*grid(COARSE_MS), COARSE_SHIFTS))] * (COARSE_MS // FINE_MS)
    reference, candidate = grid(FINE_MS)
    curve = _overlaps(reference, candidate, FINE_SHIFTS + coarse)
    best = int(np.argmax(curve))
    return int(coarse + FINE_SHIFTS[best]), int(curve[best]), int(min((b - a).sum() for a, b in (reference, candidate)))


def best_shift(reference: DataFrame, candidate: DataFrame, keys) -> DataFrame:
    """Shift of the candidate with the largest activity overlap.

    2 Hz over +-120 s, then 10 Hz within one second of the coarse winner; the smallest shift wins
    a tie; the score is the overlap over the smaller number of active cells.

    All shifts are tried inside the row of a film, on runs of cells; no cell is a row. Of spans that start in the same
    cells only the longest is kept there, so a row has at most ten a second of its film.
    """
    at = F.greatest(F.lit(0).cast("long"), F.col("start_ms"))
    until = F.coalesce("end_ms", at)

    def longest(df, name):
        starts = df.select(*keys, at.alias("at"), until.alias("until"), *[F.bround(at / size).alias(f"_{size}") for size in (COARSE_MS, FINE_MS)])
        kept = starts.groupBy(*keys, f"_{COARSE_MS}", f"_{FINE_MS}").agg(F.min("at").alias("at"), F.max("until").alias("until"))
        return kept.groupBy(*keys).agg(F.collect_list("at").alias(f"{name}_at"), F.collect_list("until").alias(f"{name}_until"))

    rows = longest(reference, "r").join(longest(candidate, "c").hint("merge"), keys)
    types = dict(rows.dtypes)
    columns = [*keys, "shift_ms", "overlap", "score"]
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["shift_ms long", "overlap long", "score double"])

    def judged(parts):
        for part in parts:
            found = []
            for row in part.itertuples(index=False):
                shift, overlap, least = _film_shift(*[np.asarray(x, np.int64) for x in (row.r_at, row.r_until, row.c_at, row.c_until)])
                found.append((*(getattr(row, k) for k in keys), FINE_MS * shift, overlap, overlap / least))
            yield pd.DataFrame(found, columns=columns)

    return rows.mapInPandas(judged, schema)


# The three regions, as tenths of a percent of the film.
REGIONS = (("early", 0.10, 0.35), ("middle", 0.40, 0.65), ("late", 0.70, 0.95))


# The moves about the whole-film shift that a region tries, in cells of 100 ms.
REGION_STEPS = np.arange(-20, 21)


def _clipped_cells(at: np.ndarray, until: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Cells [a, b) of spans clipped to a region, at least one each; spans outside it, or empty, end before they begin."""
    start, end = np.maximum(at, low), np.minimum(until, high)
    a = np.maximum(0, np.rint(start / 100))
    b = np.maximum(a + 1, np.rint(end / 100))
    return a, np.where((until > low) & (at < high) & (end > start), b, -1)


def _region_scores(r_at, r_until, c_at, c_until, low: float, high: float, hold: int = 4_000_000) -> np.ndarray:
    """Common active cells over the smaller number of active cells, for every step of one region of one film.

    Spans are ordered by their start, so what each adds to the union of those before it follows from the latest end so far.
    """
    def added(at, until):
        return _added(*_clipped_cells(at, until, low, high))

    scores = np.zeros(len(REGION_STEPS))
    if not len(r_at) or not len(c_at):
        return scores
    order = np.argsort(r_at, kind="stable")
    a, b = added(r_at[order], r_until[order])
    a, b = a[b > a], b[b > a]
    n_ref = (b - a).sum()
    if not n_ref:
        return scores
    edges, below = _counted(a, b)
    order = np.argsort(c_at, kind="stable")
    for part in np.array_split(np.arange(len(REGION_STEPS)), min(len(REGION_STEPS), 1 + len(REGION_STEPS) * len(c_at) // hold)):
        move = 100 * REGION_STEPS[part][:, None]
        a, b = added(c_at[order] + move, c_until[order] + move)
        n_cand = (b - a).sum(axis=1)
        scores[part] = _common(edges, below, a, b) / np.where(n_cand > 0, np.minimum(n_ref, n_cand), 1)
    return scores


def regional_overlap(reference, candidate, shifts, durations, keys) -> DataFrame:
    """Best local shift within two seconds of the whole-film shift, in three regions.

    `shifts(keys, shift_ms)`. Spans meet their region once, and all moves are tried inside its row. Of spans that start
    together only the longest is kept there, so a row has at most one a millisecond of its region.
    """
    label = F.explode(F.array(*[
        F.struct(F.lit(n).alias("region"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for n, a, b in REGIONS
    ]))
    films = durations.select(*keys, "duration_ms").join(shifts.select(*keys, "shift_ms"), keys)

    def regions(df, *kept):
        return df.withColumn("r", label).select(
            *keys, "r.region", (F.col("duration_ms") * F.col("r.lo")).alias("low_ms"), (F.col("duration_ms") * F.col("r.hi")).alias("high_ms"), *kept)

    slot = [*keys, "region"]
    both = reference.select(*keys, "start_ms", "end_ms", F.lit(False).alias("moved")).unionByName(
        candidate.select(*keys, "start_ms", "end_ms", F.lit(True).alias("moved"))).join(films, keys)
    move = F.when(F.col("moved"), F.col("shift_ms")).otherwise(0)
    near = regions(both, "moved", (F.col("start_ms") + move).alias("at"), (F.col("end_ms") + move).alias("until"))
    reach = F.when(F.col("moved"), 100 * int(REGION_STEPS[-1])).otherwise(0)
    inside = (F.col("until") > F.col("low_ms")) & (F.col("at") < F.col("high_ms"))
    starts = near.filter((F.col("until") + reach > F.col("low_ms")) & (F.col("at") - reach < F.col("high_ms"))).groupBy(*slot, "moved", "at").agg(
        F.max("until").alias("until"), F.count_if(inside).alias("n"))

    def listed(own):
        return F.collect_list(F.when(own, F.struct("at", "until")))

    def counted(own):
        return F.sum(F.when(own, F.col("n")).otherwise(0))

    own = F.col("moved")
    met = starts.groupBy(*slot).agg(
        listed(~own).alias("r"), listed(own).alias("c"), counted(~own).alias("reference_count"), counted(own).alias("candidate_count"))
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")
    rows = regions(films, "shift_ms").join(met, slot, "left").select(
        *slot, "low_ms", "high_ms", "shift_ms", *[F.coalesce(c, zero).alias(c) for c in ("reference_count", "candidate_count")],
        *[F.coalesce(f"{side}.{c}", none).alias(f"{side}_{c}") for side in "rc" for c in ("at", "until")])
    types = dict(rows.dtypes)
    columns = [*slot, "offset_ms", "score", "reference_count", "candidate_count"]
    schema = ", ".join([f"{k} {types[k]}" for k in slot] + ["offset_ms long", "score double", "reference_count long", "candidate_count long"])

    def judged(parts):
        for part in parts:
            found = []
            for row in part.itertuples(index=False):
                spans = [np.asarray(x, np.int64) for x in (row.r_at, row.r_until, row.c_at, row.c_until)]
                scores = _region_scores(*spans, row.low_ms, row.high_ms)
                best = int(np.argmax(scores))
                found.append((*(getattr(row, k) for k in slot), int(row.shift_ms + 100 * REGION_STEPS[best]), float(scores[best]), row.reference_count, row.candidate_count))
            yield pd.DataFrame(found, columns=columns)

    return rows.mapInPandas(judged, schema)


def structure_verdict(whole: DataFrame, regional: DataFrame, keys) -> DataFrame:
    """Is the whole-film shift strongly confirmed by its regions?"""
    folded = regional.groupBy(*keys).agg(
        F.min("score").alias("low_score"), (F.max("offset_ms") - F.min("offset_ms")).alias("spread_ms"),
        F.min(F.least("reference_count", "candidate_count")).alias("low_count"))
    return whole.join(folded, keys).withColumn(
        "strong",
        (F.abs("shift_ms") <= C.MAX_AUTOMATIC_OFFSET_MS) & (F.col("score") >= 0.85) & (F.col("low_score") >= 0.80)
        & (F.col("spread_ms") <= 500) & (F.col("low_count") >= 10))


# Version offsets, clip medians, robust statistics --------------------------------------------


def version_offset(before: DataFrame, after: DataFrame, keys, ordinal: str = "cue_ix", text_key: str = "text_key") -> DataFrame:
    """Constant shift between two versions of one track, or the reason why there is none."""
    a = before.select(*keys, ordinal, F.col("start_ms").alias("s0"), F.col(text_key).alias("k0"))
    b = after.select(*keys, ordinal, F.col("start_ms").alias("s1"), F.col(text_key).alias("k1"))
    pairs = a.join(b, [*keys, ordinal], "full_outer")
    sizes = pairs.groupBy(*keys).agg(F.count("s0").alias("n_before"), F.count("s1").alias("n_after"))
    same = pairs.filter("k0 = k1").withColumn("d", F.col("s1") - F.col("s0"))
    middle = same.groupBy(*keys).agg(F.median("d").alias("median_ms"), F.count(F.lit(1)).alias("matched"))
    clamped = (F.col("median_ms") < 0) & (F.col("s0") + F.col("median_ms") < 0)
    spread = same.join(middle, keys).filter(~clamped).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("comparable"), F.max(F.abs(F.col("d") - F.col("median_ms"))).alias("deviation_ms"))
    zero = F.lit(0).cast("long")
    joined = sizes.join(middle, keys, "left").join(spread, keys, "left").withColumns({
        "matched": F.coalesce("matched", zero), "comparable": F.coalesce("comparable", zero)})
    reason = (
        F.when((F.col("n_before") < 3) | (F.col("n_before") != F.col("n_after")), "structure_changed")
        .when(F.col("matched") < F.greatest(F.lit(3), F.floor(F.col("n_before") / 2)), "unmatched")
        .when(F.col("comparable") < 3, "all_clamped").when(F.col("deviation_ms") > 250, "not_fixed").otherwise(""))
    return joined.select(*keys, "n_before", "matched", "comparable", reason.alias("reason"),
                         F.when(reason == "", F.bround("median_ms").cast("long")).alias("offset_ms"))


def clip_offsets(values: DataFrame, keys, clip: str = "clip_ix", value: str = "value", spread: int = 1_000) -> DataFrame:
    """Median offset of every clip; a clip that contradicts itself is flagged, one out of range unusable."""
    return values.groupBy(*keys, clip).agg(
        F.median(value).alias("offset_ms"), F.count(F.lit(1)).alias("n"),
        (F.max(value) - F.min(value) > spread).alias("conflict"),
    ).withColumn("usable", ~F.col("conflict") & (F.abs("offset_ms") <= C.MAX_AUTOMATIC_OFFSET_MS))


def region_offsets(clips: DataFrame, keys, region: str = "region") -> DataFrame:
    return clips.filter("usable").groupBy(*keys, region).agg(
        F.median("offset_ms").alias("offset_ms"), F.count(F.lit(1)).alias("clips"),
        (F.max("offset_ms") - F.min("offset_ms") > 1_000).alias("conflict"))


def robust_summary(values: DataFrame, keys, value: str, at: str, length: str) -> DataFrame:
    """Median, MAD, leave-one-out shift, span, covered thirds and widest gap of measurements in time.

    Removing one of n sorted values can only move the median to its neighbours; the largest such
    move comes from three order statistics, not from n recomputed medians.
    """
    from cuemill.operators.ordered import Ordered

    centre = values.groupBy(*keys).agg(F.median(value).alias("median"))
    third = F.least(F.lit(2), F.greatest(F.lit(0), F.floor(F.col(at) * 3 / F.col(length)))).cast("int")
    spread = values.join(centre, keys).withColumn("_t", third).groupBy(*keys).agg(
        F.first("median").alias("median"), F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"),
        F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.bit_count(F.bit_or(F.expr("shiftleft(1, _t)"))).cast("long").alias("thirds"))
    gaps = Ordered(values, keys, at, C.CHUNK_MS, ties=[value]).lag("previous", at).result().groupBy(*keys).agg(
        F.max(F.col(at) - F.col("previous")).alias("widest_gap"))
    counted = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(*keys).orderBy(value)
    placed = counted.withColumn("seen", F.sum("c").over(upto)).join(spread.select(*keys, "n"), keys)

    def at_rank(rank: Column) -> Column:
        return F.min(F.when(F.col("seen") >= rank, F.col(value)))

    n = F.col("n")
    middle = placed.groupBy(*keys).agg(
        at_rank(F.floor(n / 2)).alias("m0"), at_rank(F.floor(n / 2) + 1).alias("m1"), at_rank(F.floor(n / 2) + 2).alias("m2"))
    odd = n % 2 == 1
    # Odd n: dropping a value leaves the mean of two neighbours. Even n: it leaves one middle value.
    moves = F.when(
        odd, F.greatest(
            F.abs((F.col("m1") + F.col("m2")) / 2 - F.col("median")),
            F.abs((F.col("m0") + F.col("m1")) / 2 - F.col("median")),
            F.abs((F.col("m0") + F.col("m2")) / 2 - F.col("median")))
    ).otherwise(F.greatest(F.abs(F.col("m0") - F.col("median")), F.abs(F.col("m1") - F.col("median"))))
    return spread.join(gaps, keys).join(middle, keys).select(
        *keys, "n", "median", "mad", "low", "high", "thirds", "widest_gap", F.when(n >= 2, moves).alias("loo_shift"))
