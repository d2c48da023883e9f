"""Timeline models from offset anchors, and the verdicts built on them.

`anchors(keys, clip_ix, anchor_id, movie_ms, subtitle_ms, score, margin)`, times in milliseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuemill import config as C
from cuemill.operators.grouped import spread

# Fixed values.
FIXED_TOLERANCE_MS = 850
AFFINE_TOLERANCE_MS = 1_200


#: Width of the blocks of offsets in which anchors and models meet.
BLOCK_MS = 24_000


def _rounded(value, digits: int):
    """Rounded as a product. Medians of thousandths lie half way between two of them again and again, and there
    `round(value, digits)` goes by the shortest decimal of a double, other engines by its product."""
    return F.round(F.col(value) * 10**digits) / 10**digits


def _once(df: DataFrame, **values) -> DataFrame:
    """Adds columns that are evaluated once for each row; in a plain projection they would be copied into the lambda
    functions that read them."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def _select(models: DataFrame, offset: str, name: str) -> DataFrame:
    """Adds `name`: per clip the best anchor of `near` that lies near the model's line."""
    tolerance = F.when(F.col("scale_ix") == 0, FIXED_TOLERANCE_MS).otherwise(AFFINE_TOLERANCE_MS)

    def ranked(a):
        residual = F.abs(a["own"] - F.col(offset))
        # Weights are fixed values (per second of residual).
        goal = a["score"] + 0.10 * a["margin"] - 0.08 * residual / 1_000
        return F.struct(a["clip_ix"].alias("clip_ix"), (-F.round(goal, 9)).alias("goal"), residual.alias("residual"), a["anchor_id"].alias("anchor_id"),
                        a["own"].alias("own"), a["movie_ms"].alias("movie_ms"), a["score"].alias("score"))

    met = F.filter("near", lambda a: F.abs(a["own"] - F.col(offset)) <= F.col("tolerance"))
    rows = _once(_once(models, tolerance=tolerance), _ranked=F.array_sort(F.transform(met, ranked)))
    first = F.filter("_ranked", lambda a, i: (i == 0) | (F.get("_ranked", i - 1)["clip_ix"] != a["clip_ix"]))
    return _once(rows.filter(F.size("_ranked") >= 2), **{name: first}).drop("_ranked", "tolerance").filter(F.size(name) >= 2)


def _middle(name: str):
    """Median of a sorted array."""
    n = F.size(name)
    return (F.element_at(name, F.floor((n + 1) / 2).cast("int")) + F.element_at(name, (F.floor(n / 2) + 1).cast("int"))) / 2


def _refit(models: DataFrame, picks: str, offset: str) -> DataFrame:
    """Adds `offset`: the median of the anchors' own offsets."""
    owns = _once(models, _owns=F.array_sort(F.transform(picks, lambda a: a["own"])))
    return _once(owns, **{offset: _middle("_owns")}).drop("_owns")


def timeline_models(anchors: DataFrame, keys) -> DataFrame:
    """For every known scale the distinct consensus models, ranked.

    Every anchor proposes an offset per scale (equal proposals once); the offset is refitted as the
    median of the selected anchors, the anchors are selected again, and models with the same
    anchors are one model.

    Offsets are cut into blocks. A refit moves a model by a tolerance at most, so all its anchors lie within two of its
    start: a block holds the anchors that far beyond its ends too, and a model is one row that is fitted inside its block.
    Pairs of models and anchors are neither shuffled nor sorted.
    """
    slot = [*keys, "scale_ix"]
    block, width, reach = [*slot, "_block"], BLOCK_MS, 2 * AFFINE_TOLERANCE_MS + 1
    scales = F.explode(F.array(*[
        F.struct(F.lit(i).alias("scale_ix"), F.lit(s).alias("scale")) for i, (_, s) in enumerate(C.TIMELINE_SCALES)
    ]))
    own = F.round(F.col("movie_ms") - F.col("s.scale") * F.col("subtitle_ms"), 3)
    scaled = anchors.withColumn("s", scales).select(*keys, "s.scale_ix", "clip_ix", "anchor_id", "movie_ms", "score", "margin", own.alias("own"))
    held = F.explode(F.sequence(F.floor((F.col("own") - reach) / width), F.floor((F.col("own") + reach) / width)))
    blocks = spread(scaled.withColumn("_block", held), *block).groupBy(*block).agg(
        F.collect_list(F.struct("clip_ix", "anchor_id", "movie_ms", "score", "margin", "own")).alias("near")).filter(F.size("near") >= 2)
    inside = F.filter("near", lambda a: F.floor(a["own"] / width) == F.col("_block"))
    start = blocks.select("*", F.explode(F.array_distinct(F.transform(inside, lambda a: a["own"]))).alias("model"))
    first = _refit(_select(start, "model", "picks"), "picks", "first").drop("picks")
    models = _refit(_select(first, "first", "picks"), "picks", "offset_ms").drop("near", "first")
    models = _once(models, residuals=F.array_sort(F.transform("picks", lambda a: F.abs(a["own"] - F.col("offset_ms")))),
                   times=F.transform("picks", lambda a: a["movie_ms"]), scores=F.transform("picks", lambda a: a["score"]),
                   strong_scores=F.transform(F.filter("picks", lambda a: a["score"] >= 0.60), lambda a: a["score"]),
                   ids=F.array_sort(F.transform("picks", lambda a: a["anchor_id"])))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda total, x: total + x) / F.size(c)
    models = _once(models, probes=F.size("picks").cast("long"), median_residual=_middle("residuals"), max_residual=F.element_at("residuals", -1),
                   span_ms=F.array_max("times") - F.array_min("times"), mean_score=mean("scores"), strong=F.size("strong_scores").cast("long"),
                   strong_mean=F.when(F.size("strong_scores") > 0, mean("strong_scores")),
                   corroborating=F.size(F.filter("scores", lambda x: x >= 0.50)).cast("long"), anchors=F.array_join("ids", ","))
    order = F.struct((-F.col("probes")).alias("o1"), _rounded("median_residual", 3).alias("o2"), (-F.col("span_ms")).alias("o3"),
                     (-F.round("mean_score", 9)).alias("o4"), _rounded("max_residual", 3).alias("o5"), F.col("model").alias("o6"))
    kept = ["model", "offset_ms", "probes", "median_residual", "max_residual", "span_ms", "mean_score", "strong", "strong_mean", "corroborating", "order"]
    best = F.min_by(F.struct(*kept), "order").alias("m")
    # Nearly all equal models share a block, so few are left to be dealt out by film.
    local = models.withColumn("order", order).groupBy(*block, "anchors").agg(best).select(*slot, "anchors", "m.*")
    distinct = local.repartition(*slot).groupBy(*slot, "anchors").agg(best).select(*slot, "m.*", "anchors")
    place = Window.partitionBy(*slot).orderBy("order")
    return distinct.withColumn("place", F.row_number().over(place)).select(
        *slot, "model", "offset_ms", "probes", "median_residual", "max_residual", "span_ms", "mean_score", "strong", "strong_mean", "corroborating", "anchors", "place")


def accept_models(models: DataFrame, anchors: DataFrame, durations: DataFrame, keys) -> DataFrame:
    """Reasons against every first-placed model, in order; no reason means accepted."""
    strong_probes = anchors.groupBy(*keys, "clip_ix").agg(F.max("score").alias("top")).groupBy(*keys).agg(
        F.count_if(F.col("top") >= 0.60).alias("strong_probes"))
    d = F.col("duration_ms")
    fixed = F.col("scale_ix") == 0
    needed = F.greatest(F.lit(2), F.ceil(F.col("strong_probes") * 0.70))
    strong_needed = F.when(fixed, 2).otherwise(3)
    reasons = F.array_compact(F.array(
        F.when(F.col("probes") < needed, "consensus"),
        F.when(~fixed & (F.col("probes") < 3), "anchors"),
        F.when(F.col("strong") < strong_needed, "strong_anchors")
        .when(F.round("strong_mean", 9) < F.when(fixed, 0.70).otherwise(0.68), "mean_score"),
        F.when(fixed & (F.col("corroborating") < 2), "corroboration"),
        F.when(F.col("span_ms") < F.when(fixed, F.greatest(F.lit(300_000), d * 0.25)).otherwise(F.greatest(F.lit(900_000), d * 0.20)), "span"),
        F.when(_rounded("max_residual", 3) > F.when(fixed, FIXED_TOLERANCE_MS).otherwise(AFFINE_TOLERANCE_MS), "residual"),
    ))
    return models.filter("place = 1").join(strong_probes, keys).join(durations, keys).withColumn(
        "reasons", F.array_join(reasons, ","))


def choose_model(accepted: DataFrame, keys) -> DataFrame:
    """The model of every film: most evidence first, but a fixed offset before invented drift."""
    kept = accepted.filter("reasons = ''")
    order = Window.partitionBy(*keys).orderBy(
        F.col("probes").desc(), _rounded("median_residual", 3), F.col("span_ms").desc(), F.round("mean_score", 9).desc(), "scale_ix")
    whole = Window.partitionBy(*keys)
    row = F.struct("scale_ix", "offset_ms", "probes", "median_residual", "span_ms")
    best = kept.withColumn("_r", F.row_number().over(order)).groupBy(*keys).agg(
        F.min_by(row, "_r").alias("b"), F.first(F.when(F.col("scale_ix") == 0, row), True).alias("f"))
    b, f = F.col("b"), F.col("f")
    same = (f["probes"] == b["probes"]) & (f["median_residual"] <= b["median_residual"] + 250)
    core = (f["probes"] != b["probes"]) & (f["probes"] >= 3) & (f["probes"] >= F.ceil(b["probes"] * 0.80)) & (
        f["span_ms"] >= b["span_ms"] * 0.80) & (f["median_residual"] <= 200) & (b["median_residual"] >= f["median_residual"] + 250)
    pick = F.when(f.isNotNull() & (same | core), f).otherwise(b)
    return best.select(*keys, pick.alias("m")).select(*keys, "m.*")


def production_safety(chosen: DataFrame, models: DataFrame, anchors: DataFrame, keys) -> DataFrame:
    """May the chosen offset be written without review? First failing rule wins.

    `anchors` carries `quality`: the anchor passed the content rules (see `anchor_quality`).
    """
    own = models.select(*keys, "scale_ix", "offset_ms", "place", "probes", "median_residual", "max_residual", "anchors")
    picked = chosen.select(*keys, "scale_ix", "offset_ms").join(
        own.filter("place = 1").drop("offset_ms", "place"), [*keys, "scale_ix"])
    used = picked.select(*keys, F.explode(F.split("anchors", ",").cast("array<bigint>")).alias("anchor_id")).join(
        anchors.select(*keys, "anchor_id", "quality"), [*keys, "anchor_id"]).groupBy(*keys).agg(F.count_if("quality").alias("good"))
    rival = own.filter("scale_ix = 0 and place between 2 and 3").select(
        *keys, F.col("offset_ms").alias("r_offset"), F.col("probes").alias("r_probes"),
        F.col("median_residual").alias("r_median"), F.col("max_residual").alias("r_max"))
    gap = F.col("probes") - F.col("r_probes")
    tighter = (F.col("r_median") <= F.col("median_residual")) & (F.col("r_max") <= F.col("max_residual")) & (
        (F.col("r_median") < F.col("median_residual")) | (F.col("r_max") < F.col("max_residual")))
    fragile = picked.filter("scale_ix = 0").join(rival, keys).filter(
        gap.between(0, 1) & (F.abs(F.col("r_offset") - F.col("offset_ms")) > 150) & tighter).groupBy(*keys).agg(
        F.min_by("r_offset", F.struct(-F.col("r_probes"), "r_median", "r_max")).alias("competing_ms"))
    joined = picked.join(used, keys, "left").join(fragile, keys, "left")
    reason = (
        F.when(F.col("scale_ix") > 0, "affine").when(F.abs("offset_ms") > C.MAX_AUTOMATIC_OFFSET_MS, "out_of_range")
        .when(F.col("probes") < 3, "few_anchors").when(F.col("max_residual") > FIXED_TOLERANCE_MS, "residual")
        .when(F.coalesce("good", F.lit(0)) < 2, "few_quality_anchors").when(F.col("competing_ms").isNotNull(), "fragile_rival").otherwise(""))
    return joined.select(*keys, "scale_ix", "offset_ms", "probes", "competing_ms", reason.alias("reason"),
                         F.when(reason == "", "HIGH").otherwise("BORDERLINE").alias("status"))


def micro_offset(anchors: DataFrame, keys, value="micro_ms", score="score", probability="probability", residual="residual_ms") -> DataFrame:
    """Weighted-median fine correction after MAD filtering, with its verdict.

    `anchors` are the few fine anchors of one film (values in milliseconds).
    """
    centre = anchors.groupBy(*keys).agg(F.median(value).alias("centre"), F.count(F.lit(1)).alias("n"))
    mad = anchors.join(centre, keys).groupBy(*keys).agg(
        F.first("centre").alias("centre"), F.first("n").alias("n"), F.median(F.abs(F.col(value) - F.col("centre"))).alias("mad"))
    kept = anchors.join(mad, keys).filter(F.abs(F.col(value) - F.col("centre")) <= F.greatest(F.lit(180.0), F.col("mad") * 3))
    weight = F.round(F.greatest(F.lit(0.01), F.col(score) * F.col(probability) / (1 + F.abs(F.col(residual)) / 1_000)), 9)
    weighed = kept.withColumn("weight", weight).groupBy(*keys, value).agg(
        F.sum("weight").alias("weight"), F.sum(score).alias("score_sum"), F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(*keys).orderBy(value)
    half = weighed.withColumns({"seen": F.sum("weight").over(upto), "total": F.sum("weight").over(Window.partitionBy(*keys))})
    up, down = F.col(value) > 80, F.col(value) < -80
    folded = half.groupBy(*keys).agg(
        F.min(F.when(F.round("seen", 6) >= F.round(F.col("total") / 2, 6), F.col(value))).alias("micro_ms"),
        (F.max(value) - F.min(value)).alias("spread_ms"), F.sum("c").alias("kept"),
        F.sum(F.when(up, F.col("c")).otherwise(0)).alias("up"), F.sum(F.when(down, F.col("c")).otherwise(0)).alias("down"),
        (F.sum("score_sum") / F.sum("c")).alias("mean_score"))
    signed = F.col("up") + F.col("down")
    agreed = (signed == 0) | (F.greatest("up", "down") >= F.ceil(signed * 0.67))
    status = (
        F.when(F.col("n") < 3, "NONE").when((F.col("kept") < 3) | (F.abs(F.col("micro")) > 800) | (F.col("spread_ms") > 350) | ~agreed, "LOW")
        .when((F.col("spread_ms") <= 150) & (F.round("mean_score", 9) >= 0.82), "HIGH").otherwise("MEDIUM"))
    rows = mad.join(folded.withColumnRenamed("micro_ms", "micro"), keys)
    return rows.select(*keys, "n", "kept", "mad", "spread_ms", status.alias("confidence"),
                       F.when(status.isin("HIGH", "MEDIUM"), F.col("micro")).alias("micro_ms"))


def offset_guard(clips: DataFrame, clusters: DataFrame, proposals: DataFrame, keys) -> DataFrame:
    """Keep the original clock, apply the proposal, or neither.

    `clips(keys, region, offset_ms, conflict, usable)` from clip medians, `clusters(keys, size)` the
    largest consensus cluster of the region offsets, `proposals(keys, proposal_ms)`.
    """
    from cuemill.operators.offsets import region_offsets

    regions = region_offsets(clips, keys)
    conflict = clips.groupBy(*keys).agg(F.bool_or("conflict").alias("clip_conflict"))
    value, proposal = F.col("offset_ms"), F.col("proposal_ms")
    folded = regions.join(proposals, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("regions"), F.bool_or("conflict").alias("region_conflict"),
        F.max(F.abs(value)).alias("worst_ms"), F.median(F.abs(value)).alias("baseline_ms"),
        F.median(F.abs(value - proposal)).alias("shifted_ms"), F.median(value).alias("centre_ms"))
    rows = proposals.join(conflict, keys, "left").join(folded, keys, "left").join(clusters.select(*keys, "size"), keys, "left")
    n, base, shifted = F.coalesce("regions", F.lit(0)), F.col("baseline_ms"), F.col("shifted_ms")
    gain = base - shifted
    status = (
        F.when(F.coalesce("clip_conflict", F.lit(False)) | F.coalesce("region_conflict", F.lit(False)), "TIMING_UNRESOLVED")
        .when((n >= 2) & (F.col("worst_ms") <= 800), "KEEP_ORIGINAL").when(n < 3, "NEED_MORE")
        .when(F.col("size") != n, "TIMING_UNRESOLVED")
        .when((base <= 800) & ((shifted >= base * 0.75) | (gain < 250)), "KEEP_ORIGINAL")
        .when((shifted <= 900) & (gain >= 250) & (F.when(base > 0, gain / base).otherwise(0.0) >= 0.5)
              & (F.abs(F.col("centre_ms") - proposal) <= 850), "APPLY_OFFSET").otherwise("REJECTED"))
    return rows.select(*keys, "proposal_ms", n.alias("regions"), status.alias("status"),
                       F.when(status == "APPLY_OFFSET", proposal).when(status == "KEEP_ORIGINAL", 0).cast("long").alias("selected_ms"))
