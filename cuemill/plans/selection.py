"""Queries: track features, selection, reconciliation, library plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuemill.functions import titles as tt
from cuemill.functions import tracks as tr
from cuemill.operators import selection as sl
from cuemill.plans.foundations import _D1_SQL, _profile
from cuemill.plans.registry import query
from cuemill.sources.tables import candidate, media, track

DESIRED = ["zh-CN", "en", "de"]
LANG_SQL = """case when type='audio' then case language when 'chi' then 'zh-CN' when 'zh-Hant' then 'zh-TW' when 'eng' then 'en' when 'ger' then 'de' when 'fre' then 'fr' else 'und' end
 when language='chi' then case when name='Simplified' then 'zh-CN' else 'zh' end when language='zh-Hant' then 'zh-TW' when language='eng' then 'en' when language='ger' then 'de' when language='fre' then 'fr' else 'und' end"""
ROLE_SQL = "case when name='Commentary' then 'commentary' when name='Forced only' or is_forced then 'partial' when name='English SDH' then 'sdh' else 'main' end"
ROWS_SQL = f"""rw as materialized (select t.*, duration_s, {LANG_SQL} as lang, case when type='audio' then case when name='Commentary' then 'commentary' else '' end else {ROLE_SQL} end as role,
 type='subtitles' and ({ROLE_SQL} not in ('main','sdh') or (duration_s>=900 and (frames<20 or (frames<100 and span_s<duration_s*0.20::double)))) as incomplete from track t join media m on m.media_id=t.media_id),
rx as materialized (select *, case when type='audio' then role='' else role in ('main','sdh') end as dialogue,
 case when starts_with(lang,'zh') then 1 else 0 end as r0 from rw)"""
RANK_SQL = "case when incomplete then 1 else 0 end, case when role='sdh' then 1 else 0 end, case when is_default then 0 else 1 end, track_id"


def _rows(spark, sf_dir):
    return sl.profiled(track(spark, sf_dir), media(spark, sf_dir))


@query("b6_subtitle_language", "track", f"select media_id, track_id, {LANG_SQL} as lang, case when starts_with(language,'zh') or language='chi' then 1 else 1 end as dialect from track")
def subtitle_language(spark, sf_dir):
    lang, name = F.col("language"), F.col("name")
    value = F.when(F.col("type") == "audio", tr.normalize_language(lang)).otherwise(tr.subtitle_language(lang, name))
    return track(spark, sf_dir).select("media_id", "track_id", value.alias("lang"), tr.dialect_rank(lang, name).alias("dialect"))


@query("b8_subtitle_role", "track", f"select media_id, track_id, {ROLE_SQL} as role from track where type='subtitles'")
def subtitle_role(spark, sf_dir):
    rows = track(spark, sf_dir).filter("type = 'subtitles'")
    return rows.select("media_id", "track_id", tr.subtitle_role(F.col("name"), F.col("is_forced")).alias("role"))


_NAMED_SQL = """
nm as (select file_id, 'Trailer '||feature_title||' CAM' as title, replace(feature_title,' ','.') as dotted, file_id%8 as kind from candidate),
lb as (select *, case kind when 0 then 'trailer.'||dotted||'.cam.1999.BluRay' when 1 then 'Trailer_'||dotted||'_CAM_1999_Forced' when 2 then 'Trailer.'||dotted||'.CAM.1999.Trailer' when 3 then 'Trailer.'||dotted||'.CAMERA.1999'
 when 4 then '- Trailer: '||replace(dotted,'.',' ')||' (CAM) HDTS' when 5 then 'The.Trailer.'||dotted||'.CAM.1999' when 6 then 'Trailer.'||dotted||'.CAM' else 'Trailer.'||dotted||'.CAM.1999.CAM' end as label from nm)
"""


@query("b8_title_removed", "candidate", _NAMED_SQL + """
select file_id, case kind when 0 then '.1999.BluRay' when 1 then '_1999_Forced' when 2 then '.1999.Trailer' when 4 then ') HDTS' when 6 then '' when 7 then '.1999.CAM' else label end as metadata,
 case when kind=1 then 'partial' when kind in (2,3,5) then 'trailer' else 'main' end as role, 'trailer' as role_untitled,
 case when kind in (4,5,7) then 'theatrical_source' else '' end as source from lb""")
def title_removed(spark, sf_dir):
    """Labels of films whose title has words of a purpose and of a source, before and after the title is taken off."""
    f = F.col("file_id") % 8
    dotted, plain = F.replace("feature_title", F.lit(" "), F.lit(".")), F.col("feature_title")
    named = [
        F.concat(F.lit("trailer."), dotted, F.lit(".cam.1999.BluRay")), F.concat(F.lit("Trailer_"), dotted, F.lit("_CAM_1999_Forced")),
        F.concat(F.lit("Trailer."), dotted, F.lit(".CAM.1999.Trailer")), F.concat(F.lit("Trailer."), dotted, F.lit(".CAMERA.1999")),
        F.concat(F.lit("- Trailer: "), plain, F.lit(" (CAM) HDTS")), F.concat(F.lit("The.Trailer."), dotted, F.lit(".CAM.1999")),
        F.concat(F.lit("Trailer."), dotted, F.lit(".CAM")), F.concat(F.lit("Trailer."), dotted, F.lit(".CAM.1999.CAM")),
    ]
    label = F.get(F.array(*named), f.cast("int"))
    # the shorter title is known as well; the longest that fits goes
    titles = F.array(F.lit("Trailer"), F.concat(F.lit("Trailer "), plain, F.lit(" CAM")), F.lit(None), F.lit("..."))
    rows = candidate(spark, sf_dir).select("file_id", label.alias("label"), F.when(f.isin(3, 5), F.slice(titles, 2, 3)).otherwise(titles).alias("titles"))
    disc = F.lit("Other.Film.2001.BluRay.x264")
    return rows.select("file_id", tt.release_metadata(F.col("label"), F.col("titles")).alias("metadata"), tr.subtitle_role(F.col("label"), titles=F.col("titles")).alias("role"),
                       tr.subtitle_role(F.col("label")).alias("role_untitled"), tt.source_conflict(disc, F.col("label"), F.col("titles")).alias("source"))


@query("b9_audio_exclusion", "track", "select media_id, track_id, case when name='Commentary' then 'commentary' else '' end as reason from track where type='audio'")
def audio_exclusion(spark, sf_dir):
    return track(spark, sf_dir).filter("type = 'audio'").select("media_id", "track_id", tr.audio_exclusion(F.col("name")).alias("reason"))


@query("b15_codec_class", "track", """select media_id, track_id, case codec when 'AAC' then 'AAC' when 'AC-3' then 'AC-3' else codec end as format,
 cast(case codec when 'TrueHD' then 3 when 'DTS-HD Master Audio' then 2 when 'AAC' then 0 when 'AC-3' then 0 else 2 end as int) as decode_cost from track""")
def codec_class(spark, sf_dir):
    return track(spark, sf_dir).select("media_id", "track_id", tr.audio_format(F.col("codec")).alias("format"), tr.decode_cost(F.col("codec")).alias("decode_cost"))


@query("d2_header_incomplete", "track media", """select t.media_id, track_id, frames, duration_s>=900 and (frames<20 or (frames<100 and span_s<duration_s*0.20::double)) as incomplete
 from track t join media m on m.media_id=t.media_id where type='subtitles'""")
def header_incomplete(spark, sf_dir):
    rows = track(spark, sf_dir).filter("type = 'subtitles'").join(media(spark, sf_dir), "media_id")
    return rows.select("media_id", "track_id", "frames", tr.header_incomplete(F.col("frames"), F.col("span_s"), F.col("duration_s")).alias("incomplete"))


@query("c11_ordinal_zip", "track", """
a as (select media_id, type, row_number() over (partition by media_id, type order by track_id) as ordinal, track_id from track),
b as (select media_id, type, row_number() over (partition by media_id, type order by track_id) as ordinal, track_id from track where track_id%4<>0)
select coalesce(a.media_id,b.media_id) as media_id, coalesce(a.type,b.type) as type, coalesce(a.ordinal,b.ordinal) as ordinal, a.track_id as track_a, b.track_id as track_b
 from a full join b on a.media_id=b.media_id and a.type=b.type and a.ordinal=b.ordinal""")
def ordinal_zip(spark, sf_dir):
    rows = track(spark, sf_dir).select("media_id", "type", "track_id")
    return sl.ordinal_zip(rows, rows.filter("track_id % 4 <> 0"), ["media_id", "type"], "track_id").select(
        "media_id", "type", F.col("ordinal").cast("long").alias("ordinal"), F.col("a.track_id").alias("track_a"), F.col("b.track_id").alias("track_b"))


@query("c12_reconciliation", "track media", """
o as (select media_id, track_id, type, case when media_id%17=0 and track_id=1 then 'Opus' else codec end as codec from track where not (media_id%13=0 and track_id=2)),
om as (select media_id, duration_s+media_id%9 as duration_s from media where media_id%101<>0),
s as (select m.media_id, duration_s, count(track_id) filter (type='audio') as a, count(track_id) filter (type='subtitles') as b, string_agg(codec,',' order by track_id) filter (type='audio') as ac, string_agg(codec,',' order by track_id) filter (type='subtitles') as bc from media m left join track t on t.media_id=m.media_id group by 1,2),
p as (select k.media_id, m.duration_s, count(track_id) filter (type='audio') as a, count(track_id) filter (type='subtitles') as b, string_agg(codec,',' order by track_id) filter (type='audio') as ac, string_agg(codec,',' order by track_id) filter (type='subtitles') as bc
  from (select media_id from om union select media_id from o) k left join om m on m.media_id=k.media_id left join o t on t.media_id=k.media_id group by 1,2)
select s.media_id, array_to_string(list_filter([case when p.duration_s is null then 'missing_output' end, case when s.a<>coalesce(p.a,0) then 'audio_count' when coalesce(s.ac,'')<>coalesce(p.ac,'') then 'audio_codecs' end,
 case when s.b<>coalesce(p.b,0) then 'subtitle_count' when coalesce(s.bc,'')<>coalesce(p.bc,'') then 'subtitle_codecs' end, case when abs(s.duration_s-p.duration_s)>greatest(3, s.duration_s*0.001::double) then 'duration' end], lambda x: x is not null), ',') as reasons
 from s left join p on p.media_id=s.media_id""")
def reconciliation(spark, sf_dir):
    rows, films = track(spark, sf_dir), media(spark, sf_dir)
    m, t = F.col("media_id"), F.col("track_id")
    output = rows.filter(~((m % 13 == 0) & (t == 2))).withColumn("codec", F.when((m % 17 == 0) & (t == 1), "Opus").otherwise(F.col("codec")))
    out_media = films.filter("media_id % 101 <> 0").withColumn("duration_s", F.col("duration_s") + m % 9)
    return sl.reconcile(rows, output, films, out_media)


@query("c21_preserved_tracks", "track", """
a as (select *, row_number() over (partition by media_id order by track_id) as place from track),
b as (select media_id, track_id, language, case when media_id%19=0 then name||'!' else name end as name, codec, is_default, case when media_id%23=0 then not is_forced else is_forced end as is_forced,
 frames+case when media_id%31=0 then 1 else 0 end as frames, row_number() over (partition by media_id order by track_id) as place from track where not (media_id%29=0 and track_id=1)),
j as (select coalesce(a.media_id,b.media_id) as media_id, coalesce(a.track_id,b.track_id) as track_id, b.media_id is null as gone, array_to_string(list_filter([case when a.language is distinct from b.language then 'language' end, case when a.name is distinct from b.name then 'name' end, case when a.codec is distinct from b.codec then 'codec' end,
 case when a.is_default is distinct from b.is_default then 'is_default' end, case when a.is_forced is distinct from b.is_forced then 'is_forced' end, case when (a.media_id+a.track_id)%4<>0 and a.frames is distinct from b.frames then 'frames' end], lambda x: x is not null), ',') as d
 from a full join b on b.media_id=a.media_id and b.place=a.place),
k as (select media_id, track_id, case when gone then 'missing' else d end as diff from j)
select * from k where diff<>''""")
def preserved_tracks(spark, sf_dir):
    rows, m = track(spark, sf_dir), F.col("media_id")
    after = rows.filter(~((m % 29 == 0) & (F.col("track_id") == 1))).withColumns({
        "name": F.when(m % 19 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name")), "is_forced": F.when(m % 23 == 0, ~F.col("is_forced")).otherwise(F.col("is_forced")),
        "frames": F.col("frames") + F.when(m % 31 == 0, 1).otherwise(0)})
    replaced = rows.filter("(media_id + track_id) % 4 = 0").select("media_id", "track_id")
    return sl.preserved_audit(rows, after, replaced, ["language", "name", "codec", "is_default", "is_forced"], ["frames"])


@query("d33_media_health", "track media", """
v as (select media_id, cast(media_id%5*100 as bigint) as vs, cast(floor(duration_s*1000) as bigint) as vm from media), a as (select media_id, frames*3 as as_, cast(floor(span_s*500) as bigint)+track_id as am from track where type='audio'),
g as (select a.media_id, max(abs(as_-vs)) as start_gap_ms, max(abs(vm-vm%9000-vm+am%9000)) as length_gap_ms, any_value(vm) as video_ms from a join v on v.media_id=a.media_id group by 1)
select *, start_gap_ms<=2000 and length_gap_ms<=greatest(8000, video_ms*0.005::double) as healthy from g""")
def media_health(spark, sf_dir):
    video = media(spark, sf_dir).select("media_id", (F.col("media_id") % 5 * 100).alias("video_start_ms"), F.floor(F.col("duration_s") * 1_000).alias("video_ms"))
    sound = track(spark, sf_dir).filter("type = 'audio'").join(video.select("media_id", F.col("video_ms").alias("v")), "media_id").select(
        "media_id", (F.col("frames") * 3).alias("audio_start_ms"), (F.col("v") - F.col("v") % 9_000 + (F.floor(F.col("span_s") * 500) + F.col("track_id")) % 9_000).alias("audio_ms"))
    return sl.media_health(video, sound)


@query("d35_duration", "track media", """
t as (select media_id, track_id, case when track_id%3=0 then 'video' else type end as type, case when media_id%4=0 then 0 else cast(floor(span_s*1000) as bigint) end as tag_ms from track),
m as (select media_id, case when media_id%3=0 then 0 else cast(floor(duration_s*1000) as bigint) end as c from media),
g as (select media_id, arg_min(tag_ms, track_id) filter (type='video' and tag_ms>0) as v, max(tag_ms) as l from t group by 1)
select m.media_id, coalesce(case when v>0 then v end, case when c>0 then c end, case when l>0 then l end) as duration_ms, case when v>0 then 'video' when c>0 then 'container' when l>0 then 'tracks' else 'none' end as source from m left join g on g.media_id=m.media_id""")
def duration(spark, sf_dir):
    tracks = track(spark, sf_dir).select(
        "media_id", "track_id", F.when(F.col("track_id") % 3 == 0, "video").otherwise(F.col("type")).alias("type"),
        F.when(F.col("media_id") % 4 == 0, 0).otherwise(F.floor(F.col("span_s") * 1_000)).alias("tag_ms"))
    films = media(spark, sf_dir).select("media_id", F.when(F.col("media_id") % 3 == 0, 0).otherwise(F.floor(F.col("duration_s") * 1_000)).alias("container_ms"))
    return sl.resolve_duration(films, tracks)


@query("e11_best_track", "track media", ROWS_SQL + f"""
select media_id, lang, track_id, incomplete from (select *, row_number() over (partition by media_id, lang order by r0, {RANK_SQL}) as n from rx where type='subtitles') where n=1""")
def best_track(spark, sf_dir):
    return sl.best_tracks(_rows(spark, sf_dir))


AUDIO_SQL = """
au as (select *, row_number() over (partition by media_id order by case when is_default then 0 else 1 end, track_id) as n from rx where type='audio' and dialogue),
mn as (select media_id, track_id as main_id, lang as main_lang from au where n=1),
rf as (select au.media_id, au.track_id, row_number() over (partition by au.media_id order by case codec when 'TrueHD' then 3 when 'DTS-HD Master Audio' then 2 when 'AAC' then 0 when 'AC-3' then 0 else 2 end, au.track_id<>main_id, not is_default, au.track_id) as k from au join mn on mn.media_id=au.media_id and lang=main_lang),
ma as (select mn.*, rf.track_id as reference_id from mn join rf on rf.media_id=mn.media_id and k=1)"""
ANCHOR_SQL = f"""
sb as (select rx.*, case when main_lang<>'und' and lang=main_lang then 0 when lang='en' then 1 else 2 end as tier from rx left join ma on ma.media_id=rx.media_id where type='subtitles' and not incomplete),
us as (select media_id, track_id, lang, tier from (select *, row_number() over (partition by media_id, lang order by {RANK_SQL}) as n from sb where tier<2) where n<=2),
ot as (select media_id, track_id, lang, tier from (select *, row_number() over (partition by media_id order by tier, {RANK_SQL}) as n, min(tier) over (partition by media_id) as best from sb) where n=1 and best=2),
sa as (select * from us union all select * from ot)"""


@query("e11_main_audio", "track media", ROWS_SQL + "," + AUDIO_SQL + "select * from ma")
def main_audio(spark, sf_dir):
    return sl.main_audio(_rows(spark, sf_dir))


@query("e11_source_anchors", "track media", ROWS_SQL + "," + AUDIO_SQL + "," + ANCHOR_SQL + "select media_id, track_id, lang, cast(tier as int) as tier from sa")
def source_anchors(spark, sf_dir):
    return sl.source_anchors(_rows(spark, sf_dir))


@query("e12_default_subtitle", "track media", ROWS_SQL + f"""
select media_id, track_id, lang from (select *, row_number() over (partition by media_id order by case lang when 'zh-CN' then 1 when 'en' then 2 when 'de' then 3 else 99 end, case when track_id%5=0 then 0 else 1 end, {RANK_SQL}) as n from rx where type='subtitles' and dialogue) where n=1""")
def default_subtitle(spark, sf_dir):
    rows = _rows(spark, sf_dir).filter("type = 'subtitles'").withColumn("generated", F.col("track_id") % 5 == 0)
    return sl.default_subtitle(rows, DESIRED)


COVER_SQL = """
fd as (select media_id, list(distinct lang) filter (type='subtitles' and dialogue) as f from rx group by 1),
cv as (select media_id, list_filter(['zh-CN','en','de'], lambda x: list_contains(coalesce(f,[]),x) or (x='zh-CN' and {eq})) as covered, list_filter(['zh-CN','en','de'], lambda x: not (list_contains(coalesce(f,[]),x) or (x='zh-CN' and {eq}))) as missing from fd)"""
EQ = "list_has_any(coalesce(f,[]), ['zh','zh-CN','zh-TW'])"
NOT_EQ = "list_contains(coalesce(f,[]),'zh')"


@query("g2_language_coverage", "track media", ROWS_SQL + "," + COVER_SQL.format(eq=EQ) + "select media_id, array_to_string(covered,',') as covered, array_to_string(missing,',') as missing from cv")
def language_coverage(spark, sf_dir):
    return sl.coverage(_rows(spark, sf_dir), DESIRED, True).select("media_id", F.array_join("covered", ",").alias("covered"), F.array_join("missing", ",").alias("missing"))


@query("h4_track_inspection", "track media", ROWS_SQL + f""",
bt as (select media_id, lang, incomplete from (select *, row_number() over (partition by media_id, lang order by r0, {RANK_SQL}) as n from rx where type='subtitles') where n=1),
ok as (select media_id, list(distinct lang) as ok from bt where not incomplete group by 1), rj as (select media_id, count(*) filter (incomplete) as rejected, count(*) filter (lang='und') as untagged from rx where type='subtitles' group by 1),
k as (select m.media_id, list_filter(['en','zh-TW'], lambda x: not list_contains(coalesce(ok,[]),x)) as missing, coalesce(rejected,0) as rejected, coalesce(untagged,0) as untagged from (select distinct media_id from rx) m left join ok on ok.media_id=m.media_id left join rj on rj.media_id=m.media_id)
select media_id, array_to_string(missing,',') as missing, rejected, case when len(missing)=0 then 'accepted' when untagged>0 then 'needs_review' else 'needs_processing' end as status from k""")
def track_inspection(spark, sf_dir):
    return sl.inspect(_rows(spark, sf_dir), ["en", "zh-TW"])


_INSPECT_SQL = ROWS_SQL + """,
it as (select *, case when codec in ('SubRip/SRT','AAC') then 'text' when codec='TrueHD' then 'image' else 'other' end as format, is_forced or role='partial' as part,
 case when track_id%17>0 then frames end as events, frames>=100 as accepted, span_s/3 as end_s, case when media_id%13=0 then 0 else duration_s end as d from rx where type='subtitles'),
ir as (select *, case when format<>'text' then ['image_subtitle_not_allowed'] when part then ['forced_or_fragment_subtitle'] when events is null then ['subtitle_extraction_failed']
 else list_filter([case when events=0 then 'subtitle_text_empty' when not accepted then 'subtitle_incomplete' end, case when d>0 and end_s>d+greatest(180, d*0.12::double) then 'subtitle_timeline_too_long' end], lambda x: x is not null) end as content from it),
ic as (select *, format='text' and not part and events is not null and len(content)=0 as complete, list_concat(content, case when lang in ('en','zh-CN') then []::varchar[] else ['subtitle_language_not_required'] end) as why from ir)"""


def _inspected(spark, sf_dir):
    m, t = F.col("media_id"), F.col("track_id")
    format_ = F.when(F.col("codec").isin("SubRip/SRT", "AAC"), "text").when(F.col("codec") == "TrueHD", "image").otherwise("other")
    rows = _rows(spark, sf_dir).withColumns({"format": format_, "duration_s": F.when(m % 13 == 0, 0.0).otherwise(F.col("duration_s"))})
    profiles = track(spark, sf_dir).filter((F.col("type") == "subtitles") & (t % 17 > 0)).select(
        "media_id", "track_id", F.col("frames").alias("events"), (F.col("frames") >= 100).alias("accepted"), (F.col("span_s") / 3).alias("end_s"))
    return rows, sl.inspected_tracks(rows, profiles, ["en", "zh-CN"])


@query("h4_inspected_tracks", "track media", _INSPECT_SQL + """
select media_id, track_id, lang, format, is_default, part, role='sdh' as accessible, complete, complete and lang='en' as translatable, coalesce(events,0) as events, array_to_string(why,',') as reasons from ic""")
def inspected_tracks(spark, sf_dir):
    return _inspected(spark, sf_dir)[1]


@query("h4_inspected_library", "track media", _INSPECT_SQL + """,
rk as (select *, row_number() over (partition by media_id, lang order by (role='sdh')::int, (not is_default)::int, track_id) as n from ic where complete and lang in ('en','zh-CN')),
pk as (select media_id, max(track_id) filter (lang='en') as en, max(track_id) filter (lang='zh-CN') as zh from rk where n=1 group by 1),
fl as (select media_id, media_id%19>0 as has_video, case media_id%5 when 0 then 'detected' when 1 then 'uncertain' when 2 then null else 'absent' end as burned from media),
ag as (select media_id, bool_or(not part and format in ('text','image')) as usable, count(*) filter (is_default) as defaults, max(track_id) filter (is_default) as led from ic group by 1),
au as (select distinct media_id from track where type='audio'),
fb as (select ic.media_id, string_agg(cast(track_id as varchar), ',' order by track_id) as forbidden from ic left join pk on pk.media_id=ic.media_id where track_id is distinct from en and track_id is distinct from zh group by 1),
al as (select fl.media_id, has_video, au.media_id is not null as has_audio, case when coalesce(usable,false) or burned='absent' then '' when burned='detected' then 'burned_confirmed' else 'burned_check_failed' end as burn,
 en, zh, coalesce(forbidden,'') as forbidden, coalesce(defaults=1 and led=en, false) as led from fl left join ag on ag.media_id=fl.media_id left join au on au.media_id=fl.media_id left join pk on pk.media_id=fl.media_id left join fb on fb.media_id=fl.media_id)
select media_id, case when burn<>'' or not has_video or not has_audio then 'needs_review' when en is null or zh is null or forbidden<>'' or not led then 'needs_processing' else 'accepted' end as status,
 concat_ws(',', 'en:'||en, 'zh-CN:'||zh) as selected, concat_ws(',', case when en is null then 'en' end, case when zh is null then 'zh-CN' end) as missing, forbidden,
 concat_ws(',', case when not has_video then 'video_track_missing' end, case when not has_audio then 'audio_track_missing' end, nullif(burn,''), case when en is null then 'missing_complete_text_subtitle:en' end,
 case when zh is null then 'missing_complete_text_subtitle:zh-CN' end, case when forbidden<>'' then 'forbidden_or_extra_subtitle_tracks_present' end, case when en is not null and zh is not null and not led then 'default_subtitle_must_be_english' end) as reasons from al""")
def inspected_library(spark, sf_dir):
    rows, tracks = _inspected(spark, sf_dir)
    m = F.col("media_id")
    burned = F.when(m % 5 == 0, "detected").when(m % 5 == 1, "uncertain").when(m % 5 > 2, "absent")
    films = media(spark, sf_dir).select("media_id", (m % 19 > 0).alias("has_video"), burned.alias("burned"))
    return sl.inspect_library(rows, tracks, films, ["en", "zh-CN"])


@query("h5_library_plan", "track media", ROWS_SQL + "," + AUDIO_SQL + "," + ANCHOR_SQL + "," + COVER_SQL.format(eq=EQ) + f""",
kp as (select media_id, count(*) filter (type='audio' and dialogue) as kept_audio, count(*) filter (type='subtitles' and not incomplete and lang in ('zh-CN','en','de')) as kept_subtitles from rx group by 1),
sr as (select media_id, arg_min(track_id, tier*1000+track_id) as source_id from sa group by 1),
bt as (select media_id, lang, track_id, incomplete from (select *, row_number() over (partition by media_id, lang order by r0, {RANK_SQL}) as n from rx where type='subtitles') where n=1),
sc as (select media_id, min(track_id) as script_id from bt where not incomplete and lang in ('zh-CN','zh-TW') group by 1)
select kp.media_id, kept_audio, kept_subtitles, array_to_string(missing,',') as missing, main_id, case when len(missing)>0 then source_id end as source_id,
 case when main_id is null then 'no_dialogue_audio' when len(missing)=0 then 'complete' when list_contains(missing,'zh-CN') and script_id is not null then 'convert' when source_id is not null then 'translate' else 'search' end as status
 from kp join cv on cv.media_id=kp.media_id left join ma on ma.media_id=kp.media_id left join sr on sr.media_id=kp.media_id left join sc on sc.media_id=kp.media_id""")
def library_plan(spark, sf_dir):
    return sl.library_plan(_rows(spark, sf_dir), DESIRED)


@query("h7_complete_source", "doc_cue", _D1_SQL + """,
pf as (select track_id//4 as media_id, track_id, case when track_id%2=0 then 'en' else 'fr' end as lang, track_id%3=0 as is_default, round(score,6) as score, bins>=6 and coverage>=0.3::double as accepted from p),
rq as (select track_id//4 as media_id, min(track_id) as track_id, case when min(track_id)%2=0 then 'en' else 'fr' end as lang from pf group by 1),
bs as (select media_id, lang, track_id as best_id from (select *, row_number() over (partition by media_id, lang order by score desc, is_default desc, track_id) as n from pf where accepted) where n=1)
select rq.media_id, rq.track_id, case when coalesce(pf.accepted,false) then rq.track_id else best_id end as selected_id, case when coalesce(pf.accepted,false) then 'kept' when best_id is not null then 'replaced' else 'no_complete_track' end as outcome
 from rq left join pf on pf.media_id=rq.media_id and pf.track_id=rq.track_id left join bs on bs.media_id=rq.media_id and bs.lang=rq.lang""")
def complete_source(spark, sf_dir):
    # Short documents never reach the film thresholds, so this query judges them by spread and coverage.
    t = F.col("track_id")
    lang = lambda x: F.when(x % 2 == 0, "en").otherwise("fr")
    profiles = _profile(spark, sf_dir).select(
        F.floor(t / 4).alias("media_id"), "track_id", lang(t).alias("lang"), (t % 3 == 0).alias("is_default"), F.round("score", 6).alias("score"),
        ((F.col("bins") >= 6) & (F.col("coverage") >= 0.3)).alias("accepted"))
    requests = profiles.groupBy("media_id").agg(F.min("track_id").alias("track_id")).withColumn("lang", lang(t))
    return sl.complete_source(requests, profiles)


@query("h8_replacement_plan", "track media", ROWS_SQL.replace("rx as materialized (select *,", "rx0 as materialized (select *,") + """,
fl as (select media_id, track_id, case (media_id+track_id)%6 when 0 then 'non_fixed_offset' when 1 then 'outside_automatic_offset_range' when 2 then 'timeout' else 'none' end as kind from rw where type='subtitles'),
pv as (select media_id, track_id from fl where kind in ('non_fixed_offset','outside_automatic_offset_range')),
rx as (select rx0.* from rx0 where not exists (select 1 from pv where pv.media_id=rx0.media_id and pv.track_id=rx0.track_id)),""" + COVER_SQL.format(eq=NOT_EQ) + """,
ct as (select media_id, count(*) as replaced from pv group by 1)
select cv.media_id, coalesce(replaced,0) as replaced, array_to_string(missing,',') as targets from cv left join ct on ct.media_id=cv.media_id""")
def replacement_plan(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    kind = F.expr("case (media_id + track_id) % 6 when 0 then 'non_fixed_offset' when 1 then 'outside_automatic_offset_range' when 2 then 'timeout' else 'none' end")
    failures = rows.filter("type = 'subtitles'").select("media_id", "track_id", kind.alias("kind"))
    return sl.replacement_plan(rows, failures, DESIRED)


@query("h9_purpose_gate", "track media", ROWS_SQL + "select media_id, bool_and(dialogue) as passed, count(*) filter (not dialogue) as offending from rx where type='subtitles' group by 1")
def purpose_gate(spark, sf_dir):
    return sl.purpose_gate(_rows(spark, sf_dir))
