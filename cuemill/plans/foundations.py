"""Queries: time codec, dialogue text, completeness, fingerprints, shifts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuemill.functions import text as T
from cuemill.functions import timecode as tc
from cuemill.operators import cues as ops
from cuemill.plans.registry import query
from cuemill.sources.tables import doc_cue, load

CLEAN_SQL = (
    r"trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(text, '\{\\[^}]*\}', ' ', 'g'),"
    r" '<[^>]+>', ' ', 'g'), '\[[^\]]{0,80}\]|\([^)]{0,80}\)', ' ', 'g')), '[^\p{L}\p{N}_'']+', ' ', 'g'))"
)
KEY_SQL = CLEAN_SQL.replace("_'']+", "_]+")
GENERIC_SQL = "[" + ",".join(f"'{w}'" for w in T.GENERIC_WORDS) + "]"
WORDS_SQL = "regexp_extract_all({0}, '[a-z0-9'']{{2,}}')"


def clock_sql(ms: str) -> str:
    return (
        f"printf('%02d:%02d:%02d,%03d', greatest({ms},0)//3600000, greatest({ms},0)%3600000//60000, "
        f"greatest({ms},0)%60000//1000, greatest({ms},0)%1000)"
    )


@query("b1_time_codec", "doc_cue", f"""
raw as (select track_id, cue_ix, start_ms, end_ms, {clock_sql('start_ms - 20000')} as formatted,
  (start_ms//3600000)||':'||lpad(cast(start_ms%67 as varchar),2,'0')||':'||lpad(cast(end_ms%61 as varchar),2,'0')
  ||(case when cue_ix%2=0 then ',' else '.' end)||(start_ms%997) as clock from doc_cue)
select track_id, cue_ix, formatted, clock,
  case when start_ms%67<60 and end_ms%61<60 then (start_ms//3600000)*3600000+(start_ms%67)*60000+(end_ms%61)*1000
    + cast(rpad(cast(start_ms%997 as varchar),3,'0') as bigint) end as strict_ms,
  (start_ms//3600000)*3600000+(start_ms%67)*60000+(end_ms%61)*1000
    + cast(rpad(cast(start_ms%997 as varchar),3,'0') as bigint) as lenient_ms,
  case when start_ms%67<60 and end_ms%61<60 then -((start_ms//3600000)*3600000+(start_ms%67)*60000+(end_ms%61)*1000
    + cast(rpad(cast(start_ms%997 as varchar),3,'0') as bigint)) end as signed_ms,
  greatest(start_ms-20000,0) as round_trip from raw""")
def time_codec(spark, sf_dir):
    clock = F.concat(
        F.floor(F.col("start_ms") / 3_600_000), F.lit(":"),
        F.lpad((F.col("start_ms") % 67).cast("string"), 2, "0"), F.lit(":"),
        F.lpad((F.col("end_ms") % 61).cast("string"), 2, "0"),
        F.when(F.col("cue_ix") % 2 == 0, ",").otherwise("."), F.col("start_ms") % 997,
    )
    rows = doc_cue(spark, sf_dir).select(
        "track_id", "cue_ix", tc.format_ms(F.col("start_ms") - 20_000).alias("formatted"), clock.alias("clock")
    )
    return rows.select(
        "track_id", "cue_ix", "formatted", "clock",
        tc.parse_ms(F.col("clock")).alias("strict_ms"),
        tc.parse_ms_or_zero(F.col("clock")).alias("lenient_ms"),
        tc.parse_signed_ms(F.concat(F.lit("-"), "clock")).alias("signed_ms"),
        tc.parse_ms(F.col("formatted")).alias("round_trip"),
    )


@query("b2_clean_dialogue", "doc_cue", f"""
select track_id, cue_ix, {CLEAN_SQL} as clean, {KEY_SQL} as clean_key from doc_cue""")
def clean_dialogue(spark, sf_dir):
    return doc_cue(spark, sf_dir).select(
        "track_id", "cue_ix", T.clean_dialogue(F.col("text")).alias("clean"),
        T.clean_dialogue_key(F.col("text")).alias("clean_key"),
    )


@query("b3_tokens", "doc_cue", f"""
a as (select track_id, cue_ix, {WORDS_SQL.format(CLEAN_SQL)} as w,
  regexp_extract_all(replace(replace(lower(text),'’',''''),'‘',''''), '[a-z0-9]+(?:''[a-z]+)?') as c from doc_cue)
select track_id, cue_ix, cast(len(w) as bigint) as n_words,
  array_to_string(list_filter(w, lambda x: not list_contains({GENERIC_SQL}, x)), ' ') as content,
  array_to_string(list_transform(c, lambda x: coalesce(map_extract(MAP {{{
      ",".join("'" + k.replace("'", "''") + "': '" + v + "'" for k, v in T.CONTRACTIONS.items())}}}, x)[1], x)), ' ')
   as clause from a""")
def tokens(spark, sf_dir):
    clean = T.clean_dialogue(F.col("text"))
    return doc_cue(spark, sf_dir).select(
        "track_id", "cue_ix", F.size(T.words(clean)).cast("long").alias("n_words"),
        F.array_join(T.content_words(clean), " ").alias("content"),
        F.array_join(T.clause_tokens(F.col("text")), " ").alias("clause"),
    )


_DURATION = "n_chars*45"


def _durations(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("track_id"), F.expr(f"cast({_DURATION} as bigint)").alias("duration_ms")
    )


_D1_SQL = f"""
d as (select doc_id as track_id, {_DURATION} as duration_ms from documents),
e as (select track_id, max(end_ms) as last_end from doc_cue group by 1),
l as (select e.track_id, case when d.duration_ms>0 then d.duration_ms else e.last_end end as length_ms
      from e left join d on d.track_id=e.track_id),
s as (select c.track_id, any_value(length_ms) as length_ms, count(*) as events, max(end_ms) as last_end_ms,
  count(distinct case when start_ms <= length_ms*1.12::double and length_ms>0
        then least(9, greatest(0, cast(floor(start_ms*10.0::double/length_ms) as bigint))) end) as bins,
  sum(greatest(0, least(12000, end_ms-start_ms))) as active_ms
  from doc_cue c join l on l.track_id=c.track_id group by 1),
m as (select *, least(1.5::double, last_end_ms/length_ms) as coverage,
  events/greatest(1.0::double, length_ms/60000) as events_per_minute,
  least(1.0::double, active_ms/length_ms) as active_ratio,
  greatest(100, floor(greatest(1.0::double, length_ms/60000)*0.8::double)) as needed from s),
p as (select track_id, length_ms, events, last_end_ms, bins, coverage, events_per_minute, active_ratio,
  least(1.0::double, events/(needed*2))*30 + least(1.0::double, coverage)*25 + least(1.0::double, bins/8)*20
  + least(1.0::double, events_per_minute/4)*15 + least(1.0::double, active_ratio/0.18::double)*10 as score,
  events>=needed and coverage>=0.65::double and bins>=6 and events_per_minute>=0.9::double
  and active_ratio>=0.04::double as accepted from m)
"""
_ROUNDED = ("coverage", "events_per_minute", "active_ratio", "score")


def _profile(spark, sf_dir):
    return ops.completeness(doc_cue(spark, sf_dir), _durations(spark, sf_dir))


@query("d1_completeness", "doc_cue", _D1_SQL + """
select track_id, length_ms, events, last_end_ms, bins, round(coverage,6) as coverage,
 round(events_per_minute,6) as events_per_minute, round(active_ratio,6) as active_ratio,
 round(score,6) as score, accepted from p""")
def completeness(spark, sf_dir):
    return _profile(spark, sf_dir).withColumns({c: F.round(c, 6) for c in _ROUNDED})


@query("d3_structure_conflict", "doc_cue", _D1_SQL + """
select track_id, events, length_ms, last_end_ms,
 case when length_ms>=900000 and events<20 then 'fragment' when length_ms>0 and last_end_ms<length_ms*0.55::double
 then 'incomplete' when length_ms>0 and last_end_ms>length_ms+greatest(180000, length_ms*0.12::double)
 then 'overlong' else '' end as conflict, length_ms>0 and abs(length_ms-last_end_ms)<=840000 as endpoint_ok from p""")
def structure_conflict(spark, sf_dir):
    return ops.structure_conflict(_profile(spark, sf_dir)).select(
        "track_id", "events", "length_ms", "last_end_ms", "conflict", "endpoint_ok"
    )


_FP_SQL = f"""
c as (select track_id, cue_ix, (cue_ix-1)//1000 as part, {clock_sql('start_ms')}||'|'||{clock_sql('end_ms')} as clock,
  replace(lower(trim(regexp_replace(regexp_replace(text, '<[^>]+>|\\{{\\\\[^}}]+\\}}', '', 'g'), '\\s+', ' ', 'g'))),'ß','ss')
  as body from doc_cue),
s as (select track_id, part, sha256(string_agg(sha256(clock||'|'||body), chr(10) order by cue_ix)) as content,
  sha256(string_agg(sha256(clock), chr(10) order by cue_ix)) as timeline, count(*) as n from c group by 1,2),
f as (select track_id, sha256(string_agg(content, chr(10) order by part)) as content,
  sha256(string_agg(timeline, chr(10) order by part)) as timeline, cast(sum(n) as bigint) as events from s group by 1)
"""


@query("d4_fingerprint", "doc_cue", _FP_SQL + "select track_id, content, timeline, events from f")
def fingerprint(spark, sf_dir):
    return ops.fingerprints(doc_cue(spark, sf_dir))


# Copies of a document keep its text but not its clock, so the group key here is the re-based text.
@query("d4_duplicate_groups", "doc_cue", _FP_SQL.replace("from doc_cue", "from (select track_id, cue_ix, cue_ix*3000 as start_ms, cue_ix*3000+1500 as end_ms, text from doc_cue)") + """
select content, min(track_id) as first_track, count(*) as copies from f group by 1 having count(*)>1""")
def duplicate_groups(spark, sf_dir):
    cues = doc_cue(spark, sf_dir).withColumns({
        "start_ms": (F.col("cue_ix") * 3000).cast("long"), "end_ms": (F.col("cue_ix") * 3000 + 1500).cast("long"),
    })
    return ops.duplicate_groups(ops.fingerprints(cues))


@query("d27_reading_load", "doc_cue", r"""
r as (select track_id, cue_ix, length(regexp_replace(text,'\s','','g')) as characters,
  greatest(0,end_ms-start_ms) as ms from doc_cue),
q as (select *, case when ms>0 then round_even(characters*1000/ms,2) end as rate from r)
select track_id, cue_ix, characters, ms, rate, place from (select *, cast(row_number() over
 (partition by track_id order by coalesce(rate,0) desc, cue_ix) as int) as place from q) where place<=10""")
def reading_load(spark, sf_dir):
    return ops.reading_load(doc_cue(spark, sf_dir))


@query("d28_repeated_cues", "doc_cue", """
select track_id, start_ms, end_ms, text, min(cue_ix) as cue_ix, count(*) as copies
from (select *  replace (start_ms//60000*60000 as start_ms, end_ms//60000*60000 as end_ms) from doc_cue)
group by 1,2,3,4""")
def repeated_cues(spark, sf_dir):
    coarse = {c: (F.floor(F.col(c) / 60_000) * 60_000).cast("long") for c in ("start_ms", "end_ms")}
    return ops.drop_repeated_cues(doc_cue(spark, sf_dir).withColumns(coarse))


@query("d28_repeated_block", "", r"""
l as (select doc_id as track_id, string_split(case doc_id%4 when 0 then text||chr(10)||text when 1 then text||chr(10)||text||chr(10)||text when 2 then text||chr(10)||text||chr(10)||'end' else text end, chr(10)) as a from documents),
p as (select track_id, len(a) as n, case when not list_contains(a,'') then
 list_filter(range(1, greatest(len(a)//2,1)+1), lambda k: len(a)>=2 and len(a)%k=0 and a[k+1:]=a[:len(a)-k])[1] end as period from l)
select track_id, n as lines, period as block_lines, n//period as copies from p where period is not null""")
def repeated_block(spark, sf_dir):
    # texts as they are, doubled, trebled, and doubled with a line more
    k, once = F.col("doc_id") % 4, F.col("text")
    copied = F.when(k == 0, F.concat_ws("\n", once, once)).when(k == 1, F.concat_ws("\n", once, once, once)).when(k == 2, F.concat_ws("\n", once, once, F.lit("end"))).otherwise(once)
    lines = load(spark, sf_dir, "documents").filter(once.isNotNull()).select(F.col("doc_id").alias("track_id"), F.split(copied, "\n").alias("a"))
    return (
        lines.select("track_id", F.size("a").cast("long").alias("lines"), T.repeated_block(F.col("a")).cast("long").alias("block_lines"))
        .filter("block_lines is not null")
        .withColumn("copies", F.floor(F.col("lines") / F.col("block_lines")))
    )


@query("a9_subtitle_blocks", "doc_cue", f"""
k as (select track_id, cue_ix, start_ms, end_ms, trim(text) as text from doc_cue where length(trim(text))>0),
n as (select *, row_number() over (partition by track_id order by cue_ix) as cue_no from k)
select track_id, cue_no, cue_no||chr(10)||{clock_sql('start_ms')}||' --> '||{clock_sql('end_ms')}||chr(10)||text as block from n""")
def subtitle_blocks(spark, sf_dir):
    return ops.subtitle_blocks(doc_cue(spark, sf_dir))


@query("f1_shift", "doc_cue", """
select track_id, cue_ix, greatest(0,start_ms-4000) as start_ms,
 greatest(greatest(0,start_ms-4000)+1, end_ms-4000) as end_ms from doc_cue""")
def shift(spark, sf_dir):
    return ops.shift(doc_cue(spark, sf_dir), F.lit(-4000)).select("track_id", "cue_ix", "start_ms", "end_ms")


@query("f2_strict_shift", "doc_cue", """
select track_id, cue_ix, start_ms-900 as start_ms, end_ms-900 as end_ms from doc_cue
where track_id not in (select track_id from doc_cue group by 1 having min(start_ms)<900)""")
def strict_shift(spark, sf_dir):
    return ops.strict_shift(doc_cue(spark, sf_dir), F.lit(-900)).select("track_id", "cue_ix", "start_ms", "end_ms")


@query("f3_affine", "doc_cue", """
select track_id, cue_ix, cast(round_even(250 + start_ms*(25.0::double/24.0::double),0) as bigint) as start_ms,
 cast(round_even(250 + end_ms*(25.0::double/24.0::double),0) as bigint) as end_ms from doc_cue""")
def affine(spark, sf_dir):
    return ops.affine(doc_cue(spark, sf_dir), F.lit(250), F.lit(25.0 / 24.0)).select(
        "track_id", "cue_ix", "start_ms", "end_ms"
    )


@query("f4_shift_integrity", "doc_cue", """
b as (select track_id, cue_ix, greatest(0,start_ms-800) as s1, greatest(greatest(0,start_ms-800)+1,end_ms-800) as e1 from doc_cue),
j as (select a.track_id, s1-start_ms as ds, e1-end_ms as de from doc_cue a join b on b.track_id=a.track_id and b.cue_ix=a.cue_ix)
select track_id, true as same_count, true as same_text, min(least(ds,de))=max(greatest(ds,de)) as uniform,
 case when min(least(ds,de))=max(greatest(ds,de)) then min(ds) end as delta_ms from j group by 1""")
def shift_integrity(spark, sf_dir):
    before = doc_cue(spark, sf_dir)
    return ops.shift_integrity(before, ops.shift(before, F.lit(-800)))


@query("b20_dialogue_quality", "doc_cue", f"""
w as (select track_id, unnest({WORDS_SQL.format(CLEAN_SQL)}) as word from doc_cue),
f as (select track_id, word, count(*) as n from w group by 1,2),
g as (select track_id, sum(n) as total, count(*) as uniq, max(n) as top,
  count(*) filter (not list_contains({GENERIC_SQL}, word)) as distinctive from f group by 1),
q as (select track_id, cast(total as bigint) as words, uniq, distinctive, case when total<4 then 0.0::double else
 greatest(0.0::double, least(1.0::double, 0.38::double*least(1.0::double,total/10) + 0.25::double*least(1.0::double, uniq/greatest(1.0::double,total*0.7::double))
 + 0.37::double*least(1.0::double, distinctive/5) - greatest(0.0::double,(top/total-0.28::double)*1.2::double))) end as quality from g)
select track_id, words, uniq, distinctive, round(quality,6) as quality,
 words>=5 and distinctive>=2 and quality>=0.18::double as usable from q""")
def dialogue_quality(spark, sf_dir):
    from cuemill.operators.matching import dialogue_quality as job

    return job(doc_cue(spark, sf_dir), ["track_id"]).withColumn("quality", F.round("quality", 6))
