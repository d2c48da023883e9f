"""Queries: rules that walk one small group."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuemill.functions import text as T
from cuemill.operators import grouped as gr
from cuemill.operators import windows as wn
from cuemill.operators.intervals import bounded_subwindows
from cuemill.plans.registry import query
from cuemill.sources.tables import doc_cue, shifted_cue, speech

KEY = ["media_id"]


@query("e3_packet_intervals", "speech", """
p as (select media_id, event_id, event_id%2 as stream, start_ms as pts, row_number() over (partition by media_id, event_id%2 order by start_ms, event_id) as i, event_id%7=0 as clear, case when event_id%5=0 and event_id%7<>0 then (event_id%40)*500+1 else 0 end as dur from speech),
s as (select *, -1::bigint as since, -1::bigint as a, -1::bigint as b from p where 1=0 union all select * from p where 1=0),
w as (select media_id, stream, i, pts, clear, dur from p),
r as (select media_id, stream, i, case when clear then null when dur>0 then null else pts end as since, case when not clear and dur>0 then pts end as a, case when not clear and dur>0 then pts+least(dur,15000) end as b from w where i=1
 union all select w.media_id, w.stream, w.i,
  case when clear then case when since is not null and w.pts>since then null else since end when dur>0 then null when since is null then w.pts when w.pts-since>250 then w.pts else since end,
  case when clear then case when since is not null and w.pts>since then since end when dur>0 then w.pts when since is not null and w.pts-since>250 then since end,
  case when clear then case when since is not null and w.pts>since then least(w.pts, since+15000) end when dur>0 then w.pts+least(dur,15000) when since is not null and w.pts-since>250 then least(w.pts, since+8000) end
 from r join w on w.media_id=r.media_id and w.stream=r.stream and w.i=r.i+1)
select media_id, stream, a as start_ms, b as end_ms from r where a is not null
 union all select media_id, stream, since, since+4000 from (select *, max(i) over (partition by media_id, stream) as m from r) where i=m and since is not null""".replace("""s as (select *, -1::bigint as since, -1::bigint as a, -1::bigint as b from p where 1=0 union all select * from p where 1=0),
""", ""))
def packet_intervals(spark, sf_dir):
    e = F.col("event_id")
    packets = speech(spark, sf_dir).select(
        "media_id", (e % 2).alias("stream"), F.col("start_ms").alias("pts_ms"), F.when((e % 5 == 0) & (e % 7 != 0), e % 40 * 500 + 1).otherwise(0).cast("long").alias("duration_ms"),
        F.when(e % 7 == 0, 20).otherwise(900).alias("size"))
    return gr.packet_intervals(packets, ["media_id", "stream"])


def _words(spark, sf_dir):
    """Four spoken words per speech interval, spread over it."""
    tokens = F.array(F.lit("line"), F.lit("number"), F.col("event_id").cast("string"), F.lit("spoken"))
    rows = speech(spark, sf_dir).select("media_id", F.floor(F.col("start_ms") / 400_000).alias("clip_ix"), "event_id", "start_ms", "end_ms", F.posexplode(tokens).alias("k", "token"))
    step = F.floor((F.col("end_ms") - F.col("start_ms")) / 4)
    return rows.select("media_id", "clip_ix", (F.col("start_ms") + F.col("k") * step).alias("start_ms"), (F.col("start_ms") + (F.col("k") + 1) * step).alias("end_ms"), "token",
                       (0.5 + (F.col("event_id") + F.col("k")) % 50 / 100).alias("conf"))


@query("c14_cue_word_offsets")
def cue_word_offsets(spark, sf_dir):
    cues = shifted_cue(spark, sf_dir).select("media_id", F.col("event_id").alias("cue_id"), "start_ms", "end_ms", F.split("text", " ").alias("tokens"))
    proposals = cues.select("media_id").distinct().withColumn("proposal_ms", (F.col("media_id") % 7 - 3) * 700)
    return gr.cue_word_offsets(cues, _words(spark, sf_dir), proposals, KEY)


@query("c15_phrase_matches")
def phrase_matches(spark, sf_dir):
    at = F.floor((F.col("start_ms") + (F.col("media_id") % 7 - 3) * 700) / 400_000)
    cues = shifted_cue(spark, sf_dir).select("media_id", at.alias("clip_ix"), F.col("event_id").alias("cue_id"), "start_ms", "end_ms", F.col("text").alias("words"))
    clips = cues.select("media_id", "clip_ix").distinct().withColumns({"clip_start_ms": F.col("clip_ix") * 400_000, "clip_end_ms": (F.col("clip_ix") + 1) * 400_000})
    found = gr.phrase_matches(cues, _words(spark, sf_dir), clips, KEY)
    return found.withColumns({c: F.round(c, 6) for c in ("score", "margin", "probability")})


def _thirds(spark, sf_dir):
    # The clock runs ten times faster here, so that an eight-minute window holds enough of the sparse starts.
    fast = lambda df: df.select("media_id", F.floor(F.col("start_ms") / 10).alias("start_ms"))
    reference = fast(speech(spark, sf_dir))
    image = fast(shifted_cue(spark, sf_dir))
    films = reference.groupBy("media_id").agg(F.max("start_ms").alias("duration_ms"))
    return reference, image, wn.third_bounds(films).select("media_id", "region", "low_ms", "high_ms")


@query("d19_local_alignment")
def local_alignment(spark, sf_dir):
    reference, image, windows = _thirds(spark, sf_dir)
    return gr.local_alignment(gr.start_curves(reference, image, windows, KEY), KEY)


@query("d19_bounded_alignment")
def bounded_alignment(spark, sf_dir):
    reference, image, windows = _thirds(spark, sf_dir)
    parts = bounded_subwindows(windows.select("media_id", "region", "low_ms", "high_ms"), ["media_id", "region"])
    small = parts.select("media_id", F.concat_ws("/", "region", "start_ms", "end_ms").alias("region"), F.col("start_ms").alias("low_ms"), F.col("end_ms").alias("high_ms"))
    # the best of a window is told among all shifts that can still round to its largest value
    curves = gr.start_curves(reference, image, small, KEY, within=1e-11)
    return curves.groupBy("media_id", "region").agg(
        F.max_by("offset_ms", F.struct(F.round("value", 12), -F.col("offset_ms"))).alias("best_ms"), F.round(F.max("value"), 6).alias("value"), F.first("n_image").alias("n_image"))




@query("b5_style_view", "doc_cue", r"""
select track_id, cue_ix, translate(text,'<>{}&','')||chr(10)||translate(text,'<>{}&','')||chr(10)||'x {note} & end' as plain, '<i>'||translate(text,'<>{}&','')||'</i>'||chr(10)||'tail<b><u>end</u></b>' as markup from doc_cue""")
def style_view(spark, sf_dir):
    rows = doc_cue(spark, sf_dir).withColumn("text", F.translate("text", "<>{}&", ""))
    styled = F.concat(F.lit("{y:i}"), "text", F.lit("\n{\\b1\\c&HFFFFFF&}"), "text", F.lit("<br/><font color=red>x</font> {note} &amp; {Y:bu}end"))
    tokens = F.concat(F.lit("{y:i}"), "text", F.lit("\ntail{Y:bu}end"))
    return rows.select("track_id", "cue_ix", T.plain_view(styled).alias("plain"), T.style_markup(tokens).alias("markup"))
