"""Track selection, reconciliation and library plans.

`tracks(media_id, track_id, type, language, name, codec, is_default, is_forced, frames, span_s)`.
Picks are minima of a ranking struct, so they combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions import tracks as tr


def ordinal_zip(a: DataFrame, b: DataFrame, keys, order: str) -> DataFrame:
    """Pair the k-th row of either side; unpaired rows stay, with the missing side null. Groups are the tracks of a film."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    def numbered(side, name):
        return side.withColumn("ordinal", place).select(*keys, "ordinal", F.struct(*[c for c in side.columns if c not in keys]).alias(name))

    return numbered(a, "a").join(numbered(b, "b"), [*keys, "ordinal"], "full_outer")


TYPES = (("video", "video"), ("audio", "audio"), ("subtitles", "subtitle"))


def reconcile(source: DataFrame, output: DataFrame, source_media: DataFrame, output_media: DataFrame) -> DataFrame:
    """Does an output file carry the source's video, audio and subtitles at the same length? Reasons in order.

    Tracks are paired by their place among those of their type, so ids may change; codecs are compared pair by pair.
    """
    pairs = ordinal_zip(source.select("media_id", "type", "track_id", "codec"), output.select("media_id", "type", "track_id", "codec"), ["media_id", "type"], "track_id")
    def of(kind, what):
        return (F.col("type") == kind) & what

    folded = pairs.groupBy("media_id").agg(*[x for kind, _ in TYPES for x in (
        (F.count_if(of(kind, F.col("a").isNotNull())) != F.count_if(of(kind, F.col("b").isNotNull()))).alias(f"{kind}_count"),
        F.bool_or(of(kind, ~F.col("a.codec").eqNullSafe(F.col("b.codec")))).alias(f"{kind}_codecs"))])
    lengths = source_media.select("media_id", F.col("duration_s").alias("src_s")).join(
        output_media.select("media_id", F.col("duration_s").alias("out_s")), "media_id", "full_outer")
    joined = lengths.join(folded, "media_id", "full_outer")
    drift = F.abs(F.col("src_s") - F.col("out_s")) > F.greatest(F.lit(3.0), F.col("src_s") * 0.001)
    reasons = F.array_compact(F.array(
        F.when(F.col("out_s").isNull(), "missing_output"), F.when(F.col("src_s").isNull(), "missing_source"),
        *[F.when(F.col(f"{kind}_count"), f"{name}_count").when(F.col(f"{kind}_codecs"), f"{name}_codecs") for kind, name in TYPES],
        F.when(drift, "duration")))
    return joined.select("media_id", F.array_join(reasons, ",").alias("reasons"))


def preserved_audit(before: DataFrame, after: DataFrame, replaced: DataFrame, columns: list[str], header: list[str]) -> DataFrame:
    """Differences of tracks that a rewrite had to leave alone, paired by their place in the file.

    `replaced(media_id, track_id)` names tracks whose content was exchanged: only their `header` columns may differ;
    order, codec, name, language, flags and uid (`columns`) must not.
    """
    own = ["media_id", "track_id", *columns, *header]
    pairs = ordinal_zip(before.select(*own), after.select(*own), ["media_id"], "track_id")
    rows = pairs.withColumn("track_id", F.coalesce("a.track_id", "b.track_id")).join(
        replaced.select("media_id", "track_id", F.lit(True).alias("_r")), ["media_id", "track_id"], "left")
    def differs(c):
        return ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))

    changed = F.array_compact(F.array(*[F.when(differs(c), c) for c in columns], *[F.when(differs(c) & F.col("_r").isNull(), c) for c in header]))
    diff = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").otherwise(F.array_join(changed, ","))
    return rows.select("media_id", "track_id", diff.alias("diff")).filter("diff <> ''")


def media_health(video: DataFrame, audio: DataFrame) -> DataFrame:
    """Audio against video: start within 2 s, length within max(8 s, 0.5 %)."""
    joined = audio.join(video, "media_id").groupBy("media_id").agg(
        F.max(F.abs(F.col("audio_start_ms") - F.col("video_start_ms"))).alias("start_gap_ms"),
        F.max(F.abs(F.col("audio_ms") - F.col("video_ms"))).alias("length_gap_ms"), F.first("video_ms").alias("video_ms"))
    return joined.withColumn("healthy", (F.col("start_gap_ms") <= 2_000) & (F.col("length_gap_ms") <= F.greatest(F.lit(8_000), F.col("video_ms") * 0.005)))


def resolve_duration(media: DataFrame, tracks: DataFrame) -> DataFrame:
    """Length of a film: the first video track's tag, else the container, else the longest track."""
    tag = tracks.groupBy("media_id").agg(
        F.min_by("tag_ms", F.when((F.col("type") == "video") & (F.col("tag_ms") > 0), F.col("track_id"))).alias("video_ms"),
        F.max("tag_ms").alias("longest_ms"))
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    joined = media.join(tag, "media_id", "left")
    return joined.select(
        "media_id", F.coalesce(positive("video_ms"), positive("container_ms"), positive("longest_ms")).alias("duration_ms"),
        F.when(positive("video_ms").isNotNull(), "video").when(positive("container_ms").isNotNull(), "container")
        .when(positive("longest_ms").isNotNull(), "tracks").otherwise("none").alias("source"))


def profiled(tracks: DataFrame, media: DataFrame) -> DataFrame:
    """Tracks with language, purpose and completeness from their headers."""
    rows = tracks.join(media.select("media_id", "duration_s"), "media_id")
    return tr.labelled(rows).withColumn("dialogue", F.when(F.col("type") == "audio", F.col("role") == "").otherwise(F.col("role").isin("main", "sdh")))


def subtitle_rank(of=F.col) -> list[Column]:
    return [
        F.when(of("incomplete"), 1).otherwise(0).alias("r1"), F.when(of("role") == "sdh", 1).otherwise(0).alias("r2"),
        F.when(of("is_default"), 0).otherwise(1).alias("r3"), of("track_id").alias("r4")]


def _dialect() -> Column:
    return F.when(F.col("lang").startswith("zh"), tr.dialect_rank(F.col("language"), F.col("name"), F.col("lang"))).otherwise(0)


def best_tracks(rows: DataFrame) -> DataFrame:
    """Best subtitle per film and language: complete, not SDH, default, lowest id; dialect first for Chinese."""
    return rows.filter("type = 'subtitles'").groupBy("media_id", "lang").agg(
        F.min_by(F.struct("track_id", "incomplete"), F.struct(_dialect().alias("r0"), *subtitle_rank())).alias("t")).select(
        "media_id", "lang", F.col("t.track_id").alias("track_id"), F.col("t.incomplete").alias("incomplete"))


def _films(rows: DataFrame, *columns: Column) -> DataFrame:
    """One row per film with its dialogue audio, its subtitles, and the main audio (default first).

    A film's tracks, which are few, meet once, where they were numbered; all else is array work in its row.
    """
    kept = F.struct("type", "track_id", "lang", "role", "incomplete", "dialogue", "is_default", *columns)
    films = rows.groupBy("media_id").agg(F.collect_list(kept).alias("tracks"))
    films = films.select(
        "media_id", F.filter("tracks", lambda t: (t["type"] == "audio") & t["dialogue"]).alias("audio"),
        F.filter("tracks", lambda t: t["type"] == "subtitles").alias("subs"))
    main = F.array_min(F.transform("audio", lambda t: F.struct(F.when(t["is_default"], 0).otherwise(1).alias("r"), t["track_id"].alias("track_id"), t["lang"].alias("lang"))))
    return films.withColumn("main", main)


def main_audio(rows: DataFrame) -> DataFrame:
    """Main dialogue audio (default first) and the cheapest track of its language to decode."""
    def cost(t):
        return F.struct(
            tr.decode_cost(t["codec"]).alias("c"), (t["track_id"] != F.col("main.track_id")).alias("o"), (~t["is_default"]).alias("d"), t["track_id"].alias("id"))

    same = F.filter("audio", lambda t: t["lang"] == F.col("main.lang"))
    return _films(rows, F.col("codec")).filter("main is not null").select(
        "media_id", F.col("main.track_id").alias("main_id"), F.col("main.lang").alias("main_lang"), F.array_min(F.transform(same, cost))["id"].alias("reference_id"))


def _anchored(films: DataFrame) -> DataFrame:
    """Films with `ranked`, their complete subtitles by tier (dialogue language, English, others) and rank, and `useful`, the
    first two of each of the first two tiers, each of which is one language."""
    main = F.col("main.lang")

    def row(t):
        tier = F.when((main != "und") & (t["lang"] == main), 0).when(t["lang"] == "en", 1).otherwise(2)
        return F.struct(tier.alias("tier"), *subtitle_rank(lambda c: t[c]), t["track_id"].alias("track_id"), t["lang"].alias("lang"))

    ranked = F.array_sort(F.transform(F.filter("subs", lambda t: ~t["incomplete"]), row))
    def two(k):
        return F.slice(F.filter("ranked", lambda t: t["tier"] == k), 1, 2)

    return films.withColumn("ranked", ranked).withColumn("useful", F.concat(two(0), two(1)))


def source_anchors(rows: DataFrame) -> DataFrame:
    """Complete subtitles that may carry the film's clock: dialogue language, English, else one other; two per language."""
    anchors = F.when(F.size("useful") > 0, F.col("useful")).otherwise(F.slice("ranked", 1, 1))
    picked = _anchored(_films(rows)).select("media_id", F.explode(anchors).alias("t"))
    return picked.select("media_id", "t.track_id", "t.lang", "t.tier")


def _covered(desired: list[str], script_equivalent: bool) -> tuple[Column, Column]:
    """Covered and missing preference languages, from the set `found`."""
    scripts = F.array(F.lit("zh-CN"), F.lit("zh-TW"))
    wanted = F.array(*[F.lit(x) for x in desired])
    both = F.array_contains("found", "zh") | (F.lit(script_equivalent) & F.arrays_overlap("found", scripts))
    covered = F.when(both, F.array_union("found", F.array_intersect(wanted, scripts))).otherwise(F.col("found"))
    return F.array_intersect(wanted, covered), F.array_except(wanted, covered)


def coverage(rows: DataFrame, desired: list[str], script_equivalent: bool) -> DataFrame:
    """Covered and missing preference languages per film; one Chinese script may stand for the other."""
    found = rows.groupBy("media_id").agg(F.collect_set(F.when((F.col("type") == "subtitles") & F.col("dialogue"), F.col("lang"))).alias("found"))
    covered, missing = _covered(desired, script_equivalent)
    return found.select("media_id", covered.alias("covered"), missing.alias("missing"))


def default_subtitle(tracks: DataFrame, preferences: list[str]) -> DataFrame:
    """Default subtitle among retained and generated tracks by preference order."""
    place = F.array_position(F.array(*[F.lit(p) for p in preferences]), F.col("lang"))
    rank = F.struct(F.when(place > 0, place).otherwise(99).alias("p"), F.when(F.col("generated"), 0).otherwise(1).alias("g"), *subtitle_rank())
    return tracks.filter("dialogue").groupBy("media_id").agg(F.min_by(F.struct("track_id", "lang"), rank).alias("t")).select(
        "media_id", F.col("t.track_id").alias("track_id"), F.col("t.lang").alias("lang"))


def inspect(rows: DataFrame, required: list[str]) -> DataFrame:
    """Film status against the required languages: accepted, needs_processing or needs_review."""
    best = best_tracks(rows)
    ok = best.filter("not incomplete").groupBy("media_id").agg(F.collect_set("lang").alias("ok"))
    rejected = rows.filter("type = 'subtitles'").groupBy("media_id").agg(
        F.count_if("incomplete").alias("rejected"), F.count_if(F.col("lang") == "und").alias("untagged"))
    wanted = F.array(*[F.lit(x) for x in required])
    joined = rows.select("media_id").distinct().join(ok, "media_id", "left").join(rejected, "media_id", "left")
    missing = F.array_except(wanted, F.coalesce("ok", F.array().cast("array<string>")))
    zero = F.lit(0).cast("long")
    status = F.when(F.size(missing) == 0, "accepted").when(F.coalesce("untagged", zero) > 0, "needs_review").otherwise("needs_processing")
    return joined.select("media_id", F.array_join(missing, ",").alias("missing"), F.coalesce("rejected", zero).alias("rejected"), status.alias("status"))


def inspected_tracks(rows: DataFrame, profiles: DataFrame, required: list[str]) -> DataFrame:
    """Subtitle tracks with what speaks against each, in order.

    `rows` from `profiled` with `format` (text, image, or anything else); `profiles(media_id, track_id, events, accepted,
    end_s)` of the texts that could be read. A text without a profile could not be read; forced tracks and parts are not
    read at all, nor are images. Unknown lengths (null or 0) judge no end.
    """
    subs = rows.filter("type = 'subtitles'").join(profiles, ["media_id", "track_id"], "left")
    text, part = F.col("format") == "text", F.col("is_forced") | (F.col("role") == "partial")
    unread, d = F.col("events").isNull(), F.coalesce("duration_s", F.lit(0.0))
    late = (d > 0) & (F.col("end_s") > d + F.greatest(F.lit(180.0), d * 0.12))
    lacking = F.when(F.col("events") == 0, "subtitle_text_empty").when(~F.col("accepted"), "subtitle_incomplete")
    content = F.when(~text, F.array(F.lit("image_subtitle_not_allowed"))).when(part, F.array(F.lit("forced_or_fragment_subtitle"))).when(
        unread, F.array(F.lit("subtitle_extraction_failed"))).otherwise(F.array_compact(F.array(lacking, F.when(late, "subtitle_timeline_too_long"))))
    reasons = F.concat(content, F.array_compact(F.array(F.when(~F.col("lang").isin(*required), "subtitle_language_not_required"))))
    complete = text & ~part & ~unread & (F.size(content) == 0)
    return subs.select(
        "media_id", "track_id", "lang", "format", "is_default", part.alias("part"), (F.col("role") == "sdh").alias("accessible"), complete.alias("complete"),
        (complete & (F.col("lang") == "en")).alias("translatable"), F.coalesce("events", F.lit(0).cast("long")).alias("events"), F.array_join(reasons, ",").alias("reasons"))


def inspect_library(rows: DataFrame, tracks: DataFrame, films: DataFrame, required: list[str]) -> DataFrame:
    """Status of every film of `films(media_id, has_video, burned)` with the selected track of each required language,
    what is missing and forbidden, and the reasons in order.

    `tracks` from `inspected_tracks`. `burned` (detected, uncertain, absent, or null where the check failed) counts only
    for films without a usable subtitle. A film's tracks, which are few, meet once; all else is array work in its row.
    """
    kept = F.struct("track_id", "lang", "format", "is_default", "part", "accessible", "complete")
    subs = tracks.groupBy("media_id").agg(F.array_sort(F.collect_list(kept)).alias("subs"))
    heard = rows.groupBy("media_id").agg(F.bool_or(F.col("type") == "audio").alias("has_audio"))
    none = F.array().cast(subs.schema["subs"].dataType)
    film = films.join(subs, "media_id", "left").join(heard, "media_id", "left").withColumns(
        {"subs": F.coalesce("subs", none), "has_audio": F.coalesce("has_audio", F.lit(False))})

    def choice(lang):
        fit = F.filter("subs", lambda t: (t["lang"] == lang) & t["complete"])
        rank = F.transform(fit, lambda t: F.struct(t["accessible"].cast("int").alias("a"), (~t["is_default"]).cast("int").alias("d"), t["track_id"].alias("id")))
        return F.array_min(rank)["id"]

    film = film.withColumns({f"_s{k}": choice(lang) for k, lang in enumerate(required)})
    picks = [F.col(f"_s{k}") for k in range(len(required))]
    usable = F.exists("subs", lambda t: ~t["part"] & t["format"].isin("text", "image"))
    burned = F.when(usable | (F.col("burned") == "absent"), "").when(F.col("burned") == "detected", "burned_confirmed").otherwise("burned_check_failed")
    missing = F.array_compact(F.array(*[F.when(p.isNull(), lang) for p, lang in zip(picks, required)]))
    chosen = F.array_compact(F.array(*picks))
    forbidden = F.transform(F.filter("subs", lambda t: ~F.array_contains(chosen, t["track_id"])), lambda t: t["track_id"])
    defaults = F.filter("subs", lambda t: t["is_default"])
    english = picks[required.index("en")] if "en" in required else F.lit(None).cast("long")
    led = F.coalesce((F.size(defaults) == 1) & (defaults[0]["track_id"] == english), F.lit(False))
    film = film.withColumns({"burn": burned, "missing": missing, "forbidden": forbidden, "led": F.when(F.size(defaults) == 0, False).otherwise(led)})
    review = (F.col("burn") != "") | ~F.col("has_video") | ~F.col("has_audio")
    lacks, more = F.size("missing") > 0, F.size("forbidden") > 0
    reasons = F.concat(
        F.array_compact(F.array(F.when(~F.col("has_video"), "video_track_missing"), F.when(~F.col("has_audio"), "audio_track_missing"), F.nullif("burn", F.lit("")))),
        F.transform("missing", lambda x: F.concat(F.lit("missing_complete_text_subtitle:"), x)),
        F.array_compact(F.array(F.when(more, "forbidden_or_extra_subtitle_tracks_present"), F.when(~lacks & ~F.col("led"), "default_subtitle_must_be_english"))))
    named = F.array_compact(F.array(*[F.when(p.isNotNull(), F.concat(F.lit(lang + ":"), p.cast("string"))) for p, lang in zip(picks, required)]))
    return film.select(
        "media_id", F.when(review, "needs_review").when(lacks | more | ~F.col("led"), "needs_processing").otherwise("accepted").alias("status"),
        F.array_join(named, ",").alias("selected"), F.array_join("missing", ",").alias("missing"), F.array_join(F.transform("forbidden", lambda x: x.cast("string")), ",").alias("forbidden"),
        F.array_join(reasons, ",").alias("reasons"))


def library_plan(rows: DataFrame, desired: list[str], script_equivalent: bool = True) -> DataFrame:
    """What to keep and what to make per film: audio, subtitles, conversion and translation source, status.

    The source is the best of the two complete subtitles kept per language; a script to convert is the best of its language.
    """
    films = _anchored(_films(rows, _dialect().alias("dialect")))
    found = F.array_distinct(F.transform(F.filter("subs", lambda t: t["dialogue"]), lambda t: t["lang"]))
    films = films.withColumn("found", found)
    _, missing = _covered(desired, script_equivalent)

    def script(lang):
        rank = F.transform(F.filter("subs", lambda t: t["lang"] == lang), lambda t: F.struct(t["dialect"].alias("r0"), *subtitle_rank(lambda c: t[c])))
        best = F.array_min(rank)
        return F.when(best["r1"] == 0, best["r4"])

    source = F.array_min(F.transform("useful", lambda t: F.struct(t["tier"].alias("tier"), t["track_id"].alias("track_id"))))["track_id"]
    plan = films.select(
        "media_id", F.size("audio").cast("long").alias("kept_audio"),
        F.size(F.filter("subs", lambda t: ~t["incomplete"] & t["lang"].isin(*desired))).cast("long").alias("kept_subtitles"), missing.alias("missing"),
        F.col("main.track_id").alias("main_id"), F.coalesce(source, F.get("ranked", F.lit(0))["track_id"]).alias("source_id"),
        F.least(script("zh-CN"), script("zh-TW")).alias("script_id"))
    need = F.size("missing") > 0
    convert = need & F.array_contains("missing", "zh-CN") & F.col("script_id").isNotNull()
    status = (
        F.when(F.col("main_id").isNull(), "no_dialogue_audio").when(~need, "complete").when(convert, "convert")
        .when(F.col("source_id").isNotNull(), "translate").otherwise("search"))
    return plan.select("media_id", "kept_audio", "kept_subtitles", F.array_join("missing", ",").alias("missing"), "main_id",
                       F.when(need, F.col("source_id")).alias("source_id"), status.alias("status"))


def complete_source(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Keep the requested track if accepted, else the best accepted one of its language.

    `requests(media_id, track_id, lang)`, `profiles(media_id, track_id, lang, is_default, score, accepted)`.
    """
    own = requests.join(profiles.select("media_id", "track_id", "accepted"), ["media_id", "track_id"], "left")
    rank = F.struct(F.col("score"), F.col("is_default").cast("int"), -F.col("track_id"))
    best = profiles.filter("accepted").groupBy("media_id", "lang").agg(F.max_by("track_id", rank).alias("best_id"))
    keep = F.coalesce("accepted", F.lit(False))
    return own.join(best, ["media_id", "lang"], "left").select(
        "media_id", "track_id", F.when(keep, F.col("track_id")).otherwise(F.col("best_id")).alias("selected_id"),
        F.when(keep, "kept").when(F.col("best_id").isNotNull(), "replaced").otherwise("no_complete_track").alias("outcome"))


def replacement_plan(rows: DataFrame, failures: DataFrame, preferences: list[str]) -> DataFrame:
    """Replace only tracks proved misaligned; then which preference languages still lack a main track.

    `failures(media_id, track_id, kind)`. The kinds that prove it are fixed values; any other failure proves nothing.
    """
    proved = failures.filter(F.col("kind").isin("non_fixed_offset", "outside_automatic_offset_range")).select("media_id", "track_id")
    kept = rows.join(proved, ["media_id", "track_id"], "left_anti")
    counts = proved.groupBy("media_id").agg(F.count(F.lit(1)).alias("replaced"))
    have = coverage(kept, preferences, False)
    return have.join(counts, "media_id", "left").select(
        "media_id", F.coalesce("replaced", F.lit(0).cast("long")).alias("replaced"), F.array_join("missing", ",").alias("targets"))


def purpose_gate(rows: DataFrame) -> DataFrame:
    """Every output subtitle must be main dialogue or SDH."""
    return rows.filter("type = 'subtitles'").groupBy("media_id").agg(
        F.bool_and("dialogue").alias("passed"), F.count_if(~F.col("dialogue")).alias("offending"))
