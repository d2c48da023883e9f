"""Speech evidence: is a cue track backed by the film's voice activity?

Speech and cues are intervals on 10 ms frames; nothing is exploded to frames.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.operators.intervals import merge_intervals
from cuemill.operators.offsets import _common, _counted, _union
from cuemill.session import ensure_checkpoint_dir

# Fixed values.
REGION_COUNT = 5
MUSIC = "[♪♫♬♩🎵🎶]"


def dialogue_flag(text: str = "text", edge: str = "edge"):
    """Spoken dialogue: not empty, not fully bracketed, no music mark, no credit-like first or last cue."""
    bare = F.trim(F.regexp_replace(F.col(text), r"<[^>]+>", ""))
    pairs = r"^(\(.*\)|\{.*\}|\[.*\]|（.*）|【.*】|「.*」)$"
    credit = F.col(edge) & (F.lower(bare).contains("english") | bare.contains(" - "))
    spoken = F.trim(F.regexp_replace(F.col(text), r"<[^>]+>|\{\\[^}]*\}", ""))
    return ~((F.length(bare) == 0) | bare.rlike("(?s)" + pairs) | credit) & ~spoken.rlike(MUSIC)


def precheck(cues: DataFrame, speech: DataFrame, media: DataFrame, keys) -> DataFrame:
    """Is there enough evidence to correlate at all? Reasons in order.

    `cues(keys, start_ms, end_ms, dialogue)`, `media(keys, duration_ms)`.
    """
    voiced = merge_intervals(speech, keys).groupBy(*keys).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("spoken_ms"))
    d = F.col("duration_ms")
    capped = F.least("end_ms", F.col("start_ms") + 10_000)
    region = F.least(F.lit(REGION_COUNT - 1), F.floor((F.col("start_ms") + F.least(capped, d)) * REGION_COUNT / (d * 2)))
    counted = cues.join(media, keys).filter((F.col("start_ms") < d) & F.col("dialogue")).groupBy(*keys).agg(
        *[F.count_if(region == i).alias(f"r{i}") for i in range(REGION_COUNT)])
    zero = F.lit(0).cast("long")
    rows = media.join(voiced, keys, "left").join(counted, keys, "left").withColumns(
        {"spoken_ms": F.coalesce("spoken_ms", zero), **{f"r{i}": F.coalesce(f"r{i}", zero) for i in range(REGION_COUNT)}})
    cue_count = sum((F.col(f"r{i}") for i in range(REGION_COUNT)), zero)
    covered = sum((F.when(F.col(f"r{i}") >= 5, 1).otherwise(0) for i in range(REGION_COUNT)), F.lit(0))
    reasons = F.array_compact(F.array(
        F.when(cue_count < 40, "too_few_dialogue_cues"), F.when(F.col("spoken_ms") < 30_000, "too_little_speech"),
        F.when(d - F.col("spoken_ms") < 30_000, "too_little_quiet"), F.when(covered < 3, "dialogue_concentrated")))
    return rows.select(*keys, "spoken_ms", (d - F.col("spoken_ms")).alias("quiet_ms"), cue_count.alias("cue_count"),
                       covered.cast("long").alias("covered_regions"), F.array_join(reasons, ",").alias("reasons"))


def frame_runs(intervals: DataFrame, keys) -> DataFrame:
    """Merged runs [a, b) of 10 ms frames; duration and start are rounded separately."""
    a = F.bround(F.col("start_ms") / 10).cast("long")
    n = F.bround((F.col("end_ms") - F.col("start_ms")) / 10).cast("long")
    frames = intervals.select(*keys, a.alias("a"), (a + n).alias("b"))
    return merge_intervals(frames, keys, start="a", end="b", chunk=60_000)


# Fixed values, in frames: shifts that may be applied, shifts that are looked at besides, and from which length on.
APPLIED, LOOKED_AT, LOOKED_AT_FROM = 1_000, 6_000, 20_000


def correlation_peaks(reference, candidate, domain, keys, narrow: int = APPLIED, wide: int = LOOKED_AT, wide_from: int = LOOKED_AT_FROM) -> DataFrame:
    """Peak of the +-1 correlation of two binary signals over shifts in (-narrow, +narrow] frames, and for references of
    `wide_from` frames or more whether a stronger one lies outside, in (-wide, +wide].

    `reference`, `candidate`: merged runs; `domain(keys, n_ref, n_cand)`: frames of either signal. Outside its own frames a
    signal is zero, inside it is +1 or -1. A peak outside counts if it is a second or more away and the one inside gains
    at most 0.95 as much over the median of all shifts; both ranges are slices of one curve.
    """
    # The runs are read several times below and are far smaller than what they were merged from.
    ensure_checkpoint_dir(reference.sparkSession)
    reference, candidate, domain = (df.checkpoint() for df in (reference, candidate, domain))
    short, long = domain.filter(F.col("n_ref") < wide_from), domain.filter(F.col("n_ref") >= wide_from)
    peaks = peak_metrics(signal_curve(reference, candidate, long, keys, wide), keys, wide, narrow).unionByName(
        peak_metrics(signal_curve(reference, candidate, short, keys, narrow), keys, narrow), allowMissingColumns=True)
    gain = F.col("top") - F.col("level")
    ratio = F.when(gain > 1e-6, (F.col("near") - F.col("level")) / gain)
    rows = peaks.withColumn("ratio", ratio)
    apart = ~F.col("at").between(1 - narrow, narrow) & (F.abs(F.col("at") - F.col("offset_ms") / 10) >= 100)
    return rows.select(
        *keys, "offset_ms", "rival_ratio", "width_ms", "contrast", (F.col("at") * 10).cast("long").alias("wide_offset_ms"),
        F.col("ratio").alias("outside_ratio"), F.coalesce(apart & (F.col("ratio") <= 0.95), F.lit(False)).alias("outside_peak"))


def signal_curve(reference, candidate, domain, keys, radius: int) -> DataFrame:
    """(keys, n_cand, c0, c1, ks, xs): the +-1 correlation of every key of `domain` over shifts in (-radius, +radius], as its
    values at the lowest two shifts, which come from interval overlaps, and the products of edges `xs` at the shifts `ks` where
    its slope changes. That is a row for each key, and far fewer numbers than shifts."""
    rows = domain.select(*keys, "n_ref", "n_cand")
    for runs, name in ((reference, "r"), (candidate, "c")):
        rows = rows.join(_listed(runs, keys, name, "a", "b"), keys, "left")
    return _curves(_filled(rows, "r_a", "r_b", "c_a", "c_b"), keys, radius)


def _filled(rows: DataFrame, *lists: str) -> DataFrame:
    """Empty lists where a key had no rows."""
    return rows.withColumns({c: F.coalesce(c, F.array().cast("array<bigint>")) for c in lists})


def _listed(rows, keys, name: str, *columns: str) -> DataFrame:
    """The columns of a key's rows as lists of one row, in one order."""
    listed = rows.groupBy(*keys).agg(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in columns])).alias("v"))
    return listed.select(*keys, *[F.col(f"v.{c}").alias(f"{name}_{c}") for c in columns])


def _mapped(rows: DataFrame, keys, columns: str, of) -> DataFrame:
    """The rows that `of` gives for each row (values of `columns`), behind its keys."""
    types = dict(rows.dtypes)
    names = [*keys, *[c.split()[0] for c in columns.split(", ")]]

    def each(parts):
        for part in parts:
            yield pd.DataFrame([(*(getattr(row, k) for k in keys), *found) for row in part.itertuples(index=False) for found in of(row)], columns=names)

    return rows.mapInPandas(each, ", ".join([f"{k} {types[k]}" for k in keys] + [columns]))


def _long(*lists) -> list[np.ndarray]:
    return [np.asarray(x, np.int64) for x in lists]


def _bends(r_at, r_w, c_at, c_w, low: int, high: int, hold: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Sums of products of edge weights at the distances low .. high, where they are not zero; `hold` pairs are held at a time."""
    sums = np.zeros(high - low + 1)
    order = np.argsort(r_at, kind="stable")
    r_at, r_w = r_at[order], r_w[order]
    first, end = np.searchsorted(r_at, c_at + low), np.searchsorted(r_at, c_at + high, side="right")
    pairs = np.cumsum(end - first)
    for part in np.split(np.arange(len(c_at)), np.flatnonzero(np.diff(pairs // hold)) + 1):
        n = (end - first)[part]
        at = np.repeat(first[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        sums += np.bincount(r_at[at] - np.repeat(c_at[part], n) - low, r_w[at] * np.repeat(c_w[part], n), len(sums))
    ks = np.flatnonzero(sums)
    return ks + low, np.rint(sums[ks]).astype(np.int64)


def _curves(rows: DataFrame, keys, radius: int) -> DataFrame:
    """`signal_curve` of rows that hold both signals: n_ref, n_cand, and the runs [r_a, r_b), [c_a, c_b)."""
    low, high = 1 - radius, radius

    def edges(a, b, n):
        return np.concatenate((a, b, [0, n])), np.concatenate((np.full(len(a), 2), np.full(len(b), -2), [-1, 1]))

    def curve(row):
        r_a, r_b, c_a, c_b = _long(row.r_a, row.r_b, row.c_a, row.c_b)
        values = []
        order = np.argsort(r_a)
        at, below = _counted(r_a[order], r_b[order]) if len(r_a) else (np.zeros(1), np.zeros(1))
        for k in (low, low + 1):
            lo = max(0, k)
            hi = max(lo, min(row.n_ref, row.n_cand + k))
            inside = lambda a, b: int(np.maximum(0, np.minimum(b, hi) - np.maximum(a, lo)).sum())  # noqa: E731, B023
            values.append(4 * int(_common(at, below, c_a + k, c_b + k)) - 2 * inside(r_a, r_b) - 2 * inside(c_a + k, c_b + k) + hi - lo)
        ks, xs = _bends(*edges(r_a, r_b, row.n_ref), *edges(c_a, c_b, row.n_cand), low, high)
        yield row.n_cand, *values, ks.tolist(), xs.tolist()

    return _mapped(rows, keys, "n_cand long, c0 long, c1 long, ks array<long>, xs array<long>", curve)


def restored(low: int, high: int, c0: int, c1: int, ks: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """The curve at the shifts low .. high from its first two values and the changes of its slope."""
    bend = np.zeros(high - low + 1, dtype=np.int64)
    bend[ks - low] = xs
    bend[0] = 0
    slope = c1 - c0 - np.cumsum(bend)
    return c0 + np.concatenate(([0], np.cumsum(slope[:-1])))


def _peak(k: np.ndarray, c: np.ndarray, apart: int) -> tuple:
    """Best shift (the largest on a tie), rival peak ratio, peak width and contrast of one curve."""
    peak, middle = int(c.max()), float(np.median(c))
    at = len(c) - 1 - int(np.argmax(c[::-1] == peak))
    contrast = peak - middle
    far = c[np.abs(k - k[at]) >= apart]
    low = np.flatnonzero(c < peak - 0.05 * max(contrast, 0.0))
    right = k[low[low > at][0]] - 1 if (low > at).any() else k[-1]
    left = k[low[low < at][-1]] + 1 if (low < at).any() else k[0]
    rival = (int(far.max()) - middle) / contrast if contrast > 1e-6 and len(far) else np.nan
    return int(k[at]) * 10, rival, int(right - left) * 10, contrast


def peak_metrics(curves: DataFrame, keys, radius: int, narrow: int | None = None, apart: int = 100) -> DataFrame:
    """Best shift (the largest on a tie), rival peak ratio, peak width and contrast of `signal_curve(..., radius)`.

    With `narrow` they are those of the shifts in (-narrow, +narrow], and `top`, `level`, `at` and `near` tell of the whole
    curve: its peak, its median, the shift of the peak and the highest value inside. A key's curve is restored, read and
    dropped row by row, so only its outcome is written.
    """
    types = dict(curves.dtypes)
    names = ["offset_ms long", "rival_ratio double", "width_ms long", "contrast double"]
    names += ["top long", "level double", "at long", "near long"] if narrow else []
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + names)
    columns = [*keys, *[x.split()[0] for x in names]]

    def metrics(parts):
        for part in parts:
            found = []
            for row in part.itertuples(index=False):
                low = max(1 - radius, -row.n_cand)
                c = restored(1 - radius, radius, row.c0, row.c1, np.asarray(row.ks, np.int64), np.asarray(row.xs, np.int64))[low - (1 - radius):]
                k = np.arange(low, radius + 1)
                inside = np.abs(2 * k - 1) < 2 * (narrow or radius)
                values = _peak(k[inside], c[inside], apart)
                if narrow:
                    top = int(c.max())
                    values += (top, float(np.median(c)), int(k[np.flatnonzero(c == top)[-1]]), int(c[inside].max()))
                found.append((*(getattr(row, x) for x in keys), *values))
            yield pd.DataFrame(found, columns=columns)

    return curves.mapInPandas(metrics, schema)


def _fifths(n: int) -> list[tuple[int, int]]:
    """The five regions of a film of `n` frames."""
    return [(n * r // REGION_COUNT, n * (r + 1) // REGION_COUNT) for r in range(REGION_COUNT)]


def region_rows(cues, voiced, media, keys) -> DataFrame:
    """(keys, n, c_start_ms, c_end_ms, c_n, r_a, r_b): a row for each film with its dialogue cues, alike ones counted, and the
    merged runs of its speech. It is read several times, so it is written."""
    ensure_checkpoint_dir(cues.sparkSession)
    spoken = cues.filter("dialogue").withColumn("end_ms", F.least("end_ms", F.col("start_ms") + 10_000)).groupBy(*keys, "start_ms", "end_ms").agg(F.count(F.lit(1)).alias("n"))
    rows = media.select(*keys, F.floor(F.col("duration_ms") / 10).alias("n"))
    rows = rows.join(_listed(spoken, keys, "c", "start_ms", "end_ms", "n"), keys, "left").join(_listed(voiced, keys, "r", "a", "b"), keys, "left")
    return _filled(rows, "c_start_ms", "c_end_ms", "c_n", "r_a", "r_b").checkpoint()


def _local(row, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dialogue cues that lie in a region with ten seconds to spare on either side."""
    start, end, n = _long(row.c_start_ms, row.c_end_ms, row.c_n)
    inside = (start >= (first + 1_000) * 10) & (end <= (last - 1_000) * 10)
    return start[inside], end[inside], n[inside]


def _frames(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As `frame_runs`, of one key."""
    a = np.rint(start / 10)
    return _union(a, a + np.rint((end - start) / 10))


def _clipped(a: np.ndarray, b: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.maximum(a, first), np.minimum(b, last)
    order = np.flatnonzero(b > a)
    order = order[np.argsort(a[order], kind="stable")]
    return a[order], b[order]


def _regions_at(rows, offsets, keys) -> DataFrame:
    """Counts and overlap of every region of `region_rows` under `offsets(keys [, region], offset_ms)`."""
    region = F.col("region") if "region" in offsets.columns else F.explode(F.sequence(F.lit(0), F.lit(REGION_COUNT - 1)))
    moves = offsets.select(*keys, region.alias("region"), F.bround(F.col("offset_ms") / 10).alias("d"))
    met = _filled(rows.join(_listed(moves, keys, "o", "region", "d"), keys, "left"), "o_region", "o_d")

    def counted(row):
        moved = dict(zip(row.o_region, row.o_d))
        for region, (first, last) in enumerate(_fifths(row.n)):
            start, end, n = _local(row, first, last)
            r_a, r_b = _clipped(*_long(row.r_a, row.r_b), first, last)
            a, b = np.zeros(0), np.zeros(0)
            if region in moved:
                a, b = _clipped(*_frames(start + 10 * moved[region], end + 10 * moved[region]), first, last)
            overlap = _common(*_counted(r_a, r_b), a, b) if len(r_a) else 0
            yield region, first, last, int(n.sum()), len(np.unique(start)), int((r_b - r_a).sum()), int((b - a).sum()), int(overlap)

    rows = _mapped(met, keys, "region int, first long, last long, cue_count long, starts long, voiced long, shown long, overlap long", counted)
    size = F.col("last") - F.col("first")
    smaller, expected = F.least("voiced", "shown"), F.col("voiced") * F.col("shown") / size
    ratio = F.col("overlap") / F.greatest(F.lit(1), smaller)
    gain = (F.col("overlap") - expected) / F.greatest(F.lit(1.0), smaller - expected)
    return rows.withColumns({"ratio": ratio, "gain": gain, "enough": (F.col("starts") >= 8) & (F.least(F.col("voiced"), size - F.col("voiced")) >= 500)})


def regional_support(cues, speech, media, offsets, keys, rows: DataFrame | None = None) -> DataFrame:
    """Does a proposed shift hold in disjoint fifths of the film, beyond chance occupancy?

    `offsets(keys, offset_ms)`; cues need `dialogue`. Two supporting regions are asked for later. `rows` are `region_rows` of
    the same tables, if they are at hand.
    """
    enough = F.col("enough")
    return _regions_at(region_rows(cues, frame_runs(speech, keys), media, keys) if rows is None else rows, offsets, keys).select(
        *keys, "region", "cue_count", "enough", F.when(enough, F.col("ratio")).alias("overlap_ratio"), F.when(enough, F.col("gain")).alias("overlap_gain"),
        F.coalesce(enough & (F.col("ratio") >= 0.65) & (F.col("gain") >= 0.35), F.lit(False)).alias("supported"))


def regional_offsets(cues, speech, media, keys, rows: DataFrame | None = None) -> DataFrame:
    """(keys, region, offset_ms, overlap_ratio, overlap_gain, trusted): the shift that each fifth of a film would choose by
    itself. A region is judged if it has 8 different dialogue starts and 5 s of speech and of quiet; its shift is trusted
    if its peak is inside the range, distinct, narrow and without a rival of 0.8, and the cues moved by it overlap speech
    well beyond chance."""
    ensure_checkpoint_dir(cues.sparkSession)
    slot = [*keys, "region"]
    rows = region_rows(cues, frame_runs(speech, keys), media, keys) if rows is None else rows

    def judged(row):
        for region, (first, last) in enumerate(_fifths(row.n)):
            start, end, _ = _local(row, first, last)
            a, b = _clipped(*_long(row.r_a, row.r_b), first, last)
            voiced = int((b - a).sum())
            if len(np.unique(start)) >= 8 and min(voiced, last - first - voiced) >= 500:
                runs = [(x - first).astype(np.int64).tolist() for x in (a, b, *_frames(start, end))]
                yield region, last - first, last - first, *runs

    signals = _mapped(rows, keys, "region int, n_ref long, n_cand long, r_a array<long>, r_b array<long>, c_a array<long>, c_b array<long>", judged)
    peaks = peak_metrics(_curves(signals, slot, APPLIED), slot, APPLIED)
    clear = (F.abs("offset_ms") < 9_900) & (F.col("contrast") > 1e-6) & (F.col("rival_ratio") < 0.8) & (F.col("width_ms") < 1_000)
    peaks = peaks.withColumn("clear", F.coalesce(clear, F.lit(False))).select(*slot, "offset_ms", "clear").checkpoint()
    moved = _regions_at(rows, peaks.filter("clear").select(*slot, "offset_ms"), keys).select(*slot, "ratio", "gain")
    found = peaks.join(moved, slot, "left")
    return found.select(*slot, "offset_ms", F.when(F.col("clear"), F.col("ratio")).alias("overlap_ratio"), F.when(F.col("clear"), F.col("gain")).alias("overlap_gain"),
                        F.coalesce(F.col("clear") & (F.col("ratio") >= 0.65) & (F.col("gain") >= 0.35), F.lit(False)).alias("trusted"))


def evidence_verdict(pre, peaks, support, tool, keys, regional: DataFrame | None = None) -> DataFrame:
    """Ordered reasons for and against a tool's shift, and whether more coverage could help.

    `pre` from `precheck`, `peaks` from `correlation_peaks`, `support` from `regional_support`, `tool(keys, tool_ms)`,
    `regional` from `regional_offsets`. Shifts at the limit of the range, a tool that does not agree with the curve, a
    stronger peak outside the range and trusted regions that contradict are errors, which more coverage does not mend.
    """
    backed = support.groupBy(*keys).agg(F.count_if("supported").alias("supporting"))
    rows = pre.join(tool, keys).join(peaks, keys, "left").join(backed, keys, "left")
    if regional is None:
        rows = rows.withColumns({"trusted": F.lit(0), "spread": F.lit(None).cast("long"), "off": F.lit(None).cast("long")})
    else:
        each = regional.filter("trusted").join(tool, keys).groupBy(*keys).agg(
            F.count(F.lit(1)).alias("trusted"), (F.max("offset_ms") - F.min("offset_ms")).alias("spread"), F.max(F.abs(F.col("offset_ms") - F.col("tool_ms"))).alias("off"))
        rows = rows.join(each, keys, "left")
    limited = F.abs("tool_ms") >= 9_900
    known = F.col("offset_ms").isNotNull()
    invalid = ~limited & known & (F.abs(F.col("offset_ms") - F.col("tool_ms")) > 50)
    measured = ~limited & known & ~invalid
    outside = measured & F.coalesce("outside_peak", F.lit(False))
    conflict = measured & ~outside & F.coalesce((F.col("trusted") >= 2) & ((F.col("spread") > 1_000) | (F.col("off") > 1_000)), F.lit(False))
    peak = F.when(F.col("contrast") <= 1e-6, "no_distinct_peak").when(F.col("rival_ratio") >= 0.95, "alternative_peak")
    reasons = F.array_compact(F.concat(
        F.filter(F.split("reasons", ","), lambda r: r != ""),
        F.array(
            F.when(limited, "range_limited"), F.when(invalid, "tool_coordinate_invalid"), F.when(outside, "outside_range_peak"), F.when(measured, peak),
            F.when(measured & (F.col("width_ms") >= 1_000), "broad_peak"), F.when(conflict, "regional_offset_conflict"),
            F.when(measured & ~outside & ~conflict & (F.coalesce("supporting", F.lit(0)) < 2), "insufficient_independent_regional_support"))))
    return rows.select(*keys, "tool_ms", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("sufficient"),
                       ((F.size(reasons) > 0) & ~limited & ~invalid & ~outside & ~conflict).alias("expandable"))


# The coverage ladder --------------------------------------------------------------------------

#: Parts of the film around its middle that are tried one after another, in hundredths.
RUNGS = ((50,), (60,), (75,))


def spoken_flag(text: str = "text", edge: str = "edge"):
    """Cues that take part in the signal: as `dialogue_flag`, but lyrics with words stay."""
    bare = F.trim(F.regexp_replace(F.col(text), r"<[^>]+>", ""))
    pairs = r"^(\(.*\)|\{.*\}|\[.*\]|（.*）|【.*】|「.*」)$"
    credit = F.col(edge) & (F.lower(bare).contains("english") | bare.contains(" - "))
    return ~((F.length(bare) == 0) | bare.rlike("(?s)" + pairs) | credit | bare.rlike(r"^(?:\s|" + MUSIC + ")*$"))


def middle_samples(cues, speech, media, keys, rungs) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cues, speech and length of the middle of each film at each rung (`coverage`), on the sample's own clock. Cues are
    whole and keep ten seconds from its ends, or seventy where it is long enough for shifts of a minute; its ends are on
    10 ms, halves up."""
    end = lambda part: F.floor((F.col("duration_ms") * (100 + part) + 1_000) / 2_000).cast("long") * 10
    tried = media.select(*keys, "duration_ms", F.explode(F.array(*[F.lit(r) for r in rungs])).alias("coverage"))
    span = tried.select(*keys, "coverage", end(-F.col("coverage")).alias("low_ms"), end(F.col("coverage")).alias("high_ms"))
    size = F.col("high_ms") - F.col("low_ms")
    guard = F.when(size >= LOOKED_AT_FROM * 10, 70_000).otherwise(10_000)
    kept = cues.join(span, keys).filter((F.col("start_ms") >= F.col("low_ms") + guard) & (F.col("end_ms") <= F.col("high_ms") - guard))
    own = lambda df: df.withColumns({"start_ms": F.col("start_ms") - F.col("low_ms"), "end_ms": F.col("end_ms") - F.col("low_ms")}).drop("low_ms", "high_ms")
    heard = speech.join(span, keys).withColumns({"start_ms": F.greatest("start_ms", "low_ms"), "end_ms": F.least("end_ms", "high_ms")})
    return own(kept), own(heard.filter("end_ms > start_ms")), span.select(*keys, "coverage", size.alias("duration_ms"))


def sample_verdict(cues, speech, media, tool, keys, order: str) -> DataFrame:
    """`evidence_verdict` over one sample: `cues(keys, order, start_ms, end_ms, text)`, the first and last of which by start
    and `order` may be credits, `speech(keys, start_ms, end_ms)`, `media(keys, duration_ms)`, `tool(keys, tool_ms)`."""
    place = F.struct("start_ms", order)
    ends = cues.groupBy(*keys).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    edged = cues.join(ends, keys).withColumn("edge", (place == F.col("first")) | (place == F.col("last")))
    ensure_checkpoint_dir(cues.sparkSession)
    marked = edged.select(*keys, "start_ms", F.least("end_ms", F.col("start_ms") + 10_000).alias("end_ms"), dialogue_flag().alias("dialogue"), spoken_flag().alias("signal")).checkpoint()
    length = marked.groupBy(*keys).agg((F.floor(F.max("end_ms") / 10) + 2).alias("n_cand"))
    tried = tool.filter(F.abs("tool_ms") < 9_900).select(*keys)
    domain = media.select(*keys, F.floor(F.col("duration_ms") / 10).alias("n_ref")).join(length, keys).join(tried, keys, "left_semi")
    voiced = frame_runs(speech, keys).checkpoint()
    peaks = correlation_peaks(voiced, frame_runs(marked.filter("signal"), keys), domain, keys)
    rows = region_rows(marked, voiced, media, keys)
    support = regional_support(marked, speech, media, tool.select(*keys, F.col("tool_ms").alias("offset_ms")), keys, rows)
    return evidence_verdict(precheck(marked, speech, media, keys), peaks, support, tool, keys, regional_offsets(marked, speech, media, keys, rows))


def evidence_ladder(cues, speech, media, tool, keys, order: str, rungs=RUNGS) -> DataFrame:
    """(keys, coverage, reasons, outcome): each film is judged on its middle half, and only films whose evidence is
    insufficient without being wrong on a wider middle. Outcomes: `accepted`, `invalid` (no wider sample would mend it),
    `manual` (at the widest, all that lacks is support in two regions) and `rejected`.

    `rungs` are groups of parts in rising order. A group's samples are judged in the same jobs, and the first that ends a
    film counts; a group's verdicts are a written table, so the next group reads only the films still in question. One group
    saves jobs where films are few, single rungs save work where they are many.
    """
    ensure_checkpoint_dir(cues.sparkSession)
    open_, judged, slot, widest = media.select(*keys), None, [*keys, "coverage"], rungs[-1][-1]
    for group in rungs:
        part = [df.join(open_, keys, "left_semi") for df in (cues, speech, media, tool)]
        samples = middle_samples(*part[:3], keys, group)
        shifts = part[3].join(samples[2].select(*slot), keys)
        found = sample_verdict(*samples, shifts, slot, order).filter(~F.col("expandable") | (F.col("coverage") == widest))
        first = F.min_by(F.struct("coverage", "reasons", "sufficient", "expandable"), "coverage").alias("v")
        done = found.groupBy(*keys).agg(first).select(*keys, "v.*").checkpoint()
        judged = done if judged is None else judged.unionByName(done)
        open_ = open_.join(done, keys, "left_anti")
    alone = F.col("reasons") == "insufficient_independent_regional_support"
    outcome = F.when(F.col("sufficient"), "accepted").when(~F.col("expandable"), "invalid").when(alone, "manual").otherwise("rejected")
    return judged.select(*keys, "coverage", "reasons", outcome.alias("outcome"))
