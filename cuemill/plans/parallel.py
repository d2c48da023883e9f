"""Queries: parallel-text checks, logs, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuemill.functions import redaction as rd
from cuemill.operators import parallel as pl
from cuemill.plans.registry import query
from cuemill.sources.tables import cache_log, doc_cue, documents, speech

WORDS = "['" + "','".join(w.replace("'", "''") for w in pl.DIALOGUE_WORDS) + "']"
_PAIR = """select track_id, cue_ix, text as source, case cue_ix%3 when 0 then 'zh-CN' when 1 then 'de' else 'es' end as target,
 case cue_ix%7 when 0 then '' when 1 then text when 2 then '这是译文 the end' when 3 then '译文' when 4 then 'Übersetzung 译' else 'Zeile '||cue_ix end as translation from {0}"""


def _tpairs(spark, sf_dir):
    return spark.sql(_PAIR.format("{t}"), t=doc_cue(spark, sf_dir))


@query("i1_pair_issue", "doc_cue", "tp as (" + _PAIR.format("doc_cue") + f"""),
w as (select *, list_transform(regexp_extract_all(source,'[A-Za-z]+(?:[''’][A-Za-z]+)?'), lambda x: lower(x)) as sw, regexp_extract_all(source,'[A-Za-z]+(?:[''’][A-Za-z]+)?') as so,
 list_transform(regexp_extract_all(translation,'[A-Za-z]+(?:[''’][A-Za-z]+)?'), lambda x: lower(x)) as tw from tp),
c as (select *, list_has_any(list_intersect(sw, {WORDS}), tw) as kept, lower(regexp_replace(source,'[^\\p{{L}}\\p{{N}}_]','','g'))=lower(regexp_replace(translation,'[^\\p{{L}}\\p{{N}}_]','','g')) as same from w)
select track_id, cue_ix, target, case when trim(source)='' then '' when trim(translation)='' then 'empty' when target<>'zh-CN' then case when regexp_matches(translation,'[一-鿿]') then 'foreign_script' else '' end
 when kept then 'source_words_kept' when regexp_matches(translation,'[㐀-鿿]') then '' when len(so)=0 and not regexp_matches(source,'\\p{{L}}') then ''
 when len(so)>0 and same and not list_has_any(sw, {WORDS}) and len(so)<=3 and len(list_filter(so, lambda x: not regexp_matches(x,'^[A-Z]')))=0 then '' else 'untranslated' end as issue from c""")
def pair_issue(spark, sf_dir):
    return _tpairs(spark, sf_dir).select("track_id", "cue_ix", "target", pl.pair_issue(F.col("source"), F.col("translation"), F.col("target")).alias("issue"))


@query("i2_identifier_roles", "doc_cue", """
select track_id, cue_ix, 'label|gate|B,formula|A+B'||case when cue_ix%3=0 then ',initialism|U.S.' else '' end as kept_sorted, 0 as dummy from doc_cue
""".replace("'label|gate|B,formula|A+B'||case when cue_ix%3=0 then ',initialism|U.S.' else '' end as kept_sorted, 0 as dummy", "case when cue_ix%3=0 then 'formula|A+B,initialism|U.S.,label|gate|B' else 'formula|A+B,label|gate|B' end as kept"))
def identifier_roles(spark, sf_dir):
    rows = doc_cue(spark, sf_dir).withColumn("text", F.translate("text", "+*=/", ""))
    initial = F.when(F.col("cue_ix") % 3 == 0, " U.S. ").otherwise(" ")
    source = F.concat(F.lit("to gate B, "), F.lower("text"), initial, F.lit("A plus B"))
    # The second gate B and the second U.S. have no source occurrence left.
    translation = F.concat(F.lit("登机口B 登机口B U.S."), initial, F.lit("A加B"))
    roles = rows.select("track_id", "cue_ix", pl.identifier_roles(source, False).alias("a"), pl.identifier_roles(translation, True).alias("b"))
    kept = pl.within_budget(F.col("a"), F.col("b"))
    return roles.select("track_id", "cue_ix", F.array_join(F.array_sort(kept), ",").alias("kept"))


@query("i3_kept_names")
def kept_names(spark, sf_dir):
    rows = doc_cue(spark, sf_dir).withColumn("source", F.concat(F.lit("I met Darth Vader and Dr. Strange. "), "text"))
    found = pl.kept_names(F.col("source"), F.concat(F.lit("我见了Darth Vader和Dr. Strange，"), "text"))
    return rows.select("track_id", "cue_ix", F.array_join(F.transform(found, lambda k: F.concat(k["name"], F.lit("*"), k["n"])), "|").alias("kept"))


@query("i4_batch_reconciliation", "doc_cue", """
g as (select track_id, (cue_ix-1)//3 as win, string_agg(text,' ' order by cue_ix) as w, count(*) as n, string_agg(regexp_replace(text,'[^\\p{L}\\p{N}]','','g'),'' order by cue_ix) as flat from doc_cue group by 1,2)
select track_id, win, n as parts, case when win%5=4 then 'count' when regexp_replace(case when win%5=3 then w||' x' else w end,'[^\\p{L}\\p{N}]','','g')<>flat then 'text' else '' end as reason from g""")
def batch_reconciliation(spark, sf_dir):
    rows = doc_cue(spark, sf_dir).withColumn("win", F.floor((F.col("cue_ix") - 1) / 3))
    whole = rows.groupBy("track_id", "win").agg(F.array_sort(F.collect_list(F.struct("cue_ix", "text"))).alias("c")).select(
        "track_id", "win", F.array_join(F.transform("c", lambda x: x["text"]), " ").alias("w"), F.size("c").alias("n"))
    batch = rows.join(whole, ["track_id", "win"]).select(
        "track_id", "win", F.col("cue_ix").alias("ix"), F.col("text").alias("part"),
        F.when(F.col("win") % 5 == 3, F.concat("w", F.lit(" x"))).otherwise(F.col("w")).alias("whole"), F.when(F.col("win") % 5 == 4, F.col("n") + 1).otherwise(F.col("n")).alias("expected"))
    return pl.reconcile_batch(batch, ["track_id", "win"])


@query("i5_review_fold", "doc_cue", "tp as (" + _PAIR.replace("'zh-CN'", "'fr'").format("doc_cue") + """)
select track_id, cue_ix, case when cue_ix%4=0 then 'user_approved' when trim(source)='' then 'resolved' when cue_ix%7=0 then 'needs_review' when cue_ix%7 in (2,3,4) then 'needs_review' else 'resolved' end as state from tp""")
def review_fold(spark, sf_dir):
    rows = spark.sql(_PAIR.replace("'zh-CN'", "'fr'").format("{t}"), t=doc_cue(spark, sf_dir)).withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
    reviews = rows.withColumns({"seq": F.col("n"), "status": F.when((F.col("cue_ix") % 4 == 0) & (F.col("n") == 1), "user_approved").otherwise("needs_review")})
    return pl.recheck_reviews(reviews, ["track_id", "cue_ix"]).select("track_id", "cue_ix", "state")


@query("e13_continuation", "doc_cue", r"""
n as (select track_id, cue_ix, text, lag(text) over w as b, lead(text) over w as a from doc_cue window w as (partition by track_id order by cue_ix)),
f as (select *, coalesce(trim(b)<>'' and trim(text)<>'' and (not regexp_matches(trim(b),'[.!?。！？]["”’'']?$') or ends_with(trim(b),'...') or ends_with(trim(b),'…')) and regexp_matches(trim(text),'^[a-z]'),false) as kb,
 coalesce(trim(text)<>'' and trim(a)<>'' and (not regexp_matches(trim(text),'[.!?。！？]["”’'']?$') or ends_with(trim(text),'...') or ends_with(trim(text),'…')) and regexp_matches(trim(a),'^[a-z]'),false) as ka from n)
select track_id, cue_ix, cast(1+kb::int+ka::int as bigint) as lines, case when kb then b||' ' else '' end||text||case when ka then ' '||a else '' end as window from f""".replace(" as window from f", ' as "window" from f'))
def continuation(spark, sf_dir):
    return pl.continuation_windows(doc_cue(spark, sf_dir), "track_id")


@query("e14_log_compaction", "cache_log", """
select cue_ix, target, seq, translation from (select *, row_number() over (partition by cue_ix, target order by seq desc) as r from cache_log) where r=1 and is_valid""")
def log_compaction(spark, sf_dir):
    return pl.compact_log(cache_log(spark, sf_dir), ["cue_ix", "target"], "seq", F.col("is_valid")).select("cue_ix", "target", "seq", "translation")


@query("e14_stale_counts", "cache_log", """
select target, count(*) filter (is_valid) as current, count(*) filter (not is_valid) as stale from (select *, row_number() over (partition by cue_ix, target order by seq desc) as r from cache_log) where r=1 group by 1""")
def stale_counts(spark, sf_dir):
    return pl.stale_counts(cache_log(spark, sf_dir), ["cue_ix", "target"], "seq", F.col("is_valid"), "target")


@query("c20_current_translations", "doc_cue", """
lg as (select track_id, cue_ix, n, case cue_ix%3 when 0 then 'de' when 1 then 'es' else 'fr' end as target, track_id*100000+cue_ix*2+n as seq, case when (cue_ix+n)%5=0 then text||' old' else text end as cached_source, case when (cue_ix+n)%4=0 then '译' else 'Zeile' end as translation,
 case when (cue_ix+n)%6=0 then 'old' else 'explicit-numbering-v2' end as pv, text as source from doc_cue, (select unnest([0,1]) as n)),
v as (select *, cached_source=source and (trim(source)='' or translation<>'译' or contains(source,'译')) and (pv='explicit-numbering-v2' or not regexp_matches(source,'[0-9]')) as ok from lg)
select track_id, cue_ix, target, seq, translation from v where n=1 and ok""")
def current_translations(spark, sf_dir):
    i, n = F.col("cue_ix"), F.col("n")
    cues = doc_cue(spark, sf_dir).select("track_id", "cue_ix", F.col("text").alias("source"))
    log = cues.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "track_id", "cue_ix", F.expr("case cue_ix % 3 when 0 then 'de' when 1 then 'es' else 'fr' end").alias("target"), (F.col("track_id") * 100_000 + i * 2 + n).alias("seq"),
        F.when((i + n) % 5 == 0, F.concat("source", F.lit(" old"))).otherwise(F.col("source")).alias("cached_source"),
        F.when((i + n) % 4 == 0, "译").otherwise("Zeile").alias("translation"), F.when((i + n) % 6 == 0, "old").otherwise(pl.PARSER_VERSION).alias("parser_version"))
    return pl.current_translations(cues, log, ["track_id", "cue_ix"])


@query("d21_job_metrics", "speech", """
r as (select case media_id%3 when 0 then 'zh-CN' when 1 then 'de' else 'es' end as target, case event_id%11 when 0 then 'failed' when 1 then 'cancelled' else 'completed' end as outcome, 1+event_id%4//3 as attempt,
 case when event_id%13=0 then null when event_id%17=0 then -1 else (end_ms-start_ms)/1000 end as s from speech)
select target, count(*) as requests, count(*) filter (outcome='completed') as completed, count(*) filter (outcome='failed') as failed, count(*) filter (attempt>1) as retries, count(*) filter (s>=0) as samples,
 round(coalesce(sum(s) filter (s>=0 and outcome='completed'),0),3) as completed_s, round(coalesce(sum(s) filter (s>=0 and outcome='failed'),0),3) as failed_s, round(coalesce(sum(s) filter (s>=0 and outcome='cancelled'),0),3) as cancelled_s from r group by 1""")
def job_metrics(spark, sf_dir):
    e = F.col("event_id")
    requests = speech(spark, sf_dir).select(
        F.expr("case media_id % 3 when 0 then 'zh-CN' when 1 then 'de' else 'es' end").alias("target"), F.expr("case event_id % 11 when 0 then 'failed' when 1 then 'cancelled' else 'completed' end").alias("outcome"),
        (1 + F.floor(e % 4 / 3)).alias("attempt"), F.when(e % 13 == 0, F.lit(None)).when(e % 17 == 0, -1.0).otherwise((F.col("end_ms") - F.col("start_ms")) / 1_000).alias("elapsed_s"))
    return pl.job_metrics(requests, "target").withColumns({c: F.round(c, 3) for c in ("completed_s", "failed_s", "cancelled_s")})


@query("d34_mixed_timeline", "speech", "select media_id, bool_or(event_id%53=0 or event_id%97=1) as mixed, count(*) as windows from speech group by 1")
def mixed_timeline(spark, sf_dir):
    e = F.col("event_id")
    flags = F.create_map(F.lit("regional_offset_conflict"), e % 53 == 0, F.lit("other"), e % 2 == 0, F.lit("conflict"), e % 97 == 1)
    return pl.mixed_timeline(speech(spark, sf_dir).select("media_id", flags.alias("flags")), "media_id")


_SECRET = "case cue_ix%5 when 0 then 'GET http://x.io/a?api_key=abc'||cue_ix||'&page=2' when 1 then 'https://bob:pw'||cue_ix||'@host/x' when 2 then 'Authorization: Bearer t.'||cue_ix when 3 then 'reason: access_token=\"s'||cue_ix||'\" signature=ok' else 'password = p'||cue_ix||', done' end"


@query("b18_redaction", "doc_cue", """
select track_id, cue_ix, case cue_ix%5 when 0 then 'GET http://x.io/a?api_key=[REDACTED]&page=2' when 1 then 'https://[REDACTED]@host/x' when 2 then 'Authorization: Bearer [REDACTED]' when 3 then 'reason: access_token="[REDACTED]" signature=[REDACTED]' else 'password = [REDACTED], done' end as text from doc_cue""")
def redaction(spark, sf_dir):
    return doc_cue(spark, sf_dir).select("track_id", "cue_ix", rd.redact(F.expr(_SECRET)).alias("text"))


@query("b18_redacted_documents", "", r"""
select doc_id, regexp_replace(text, '(?i)(\btoken\s*=\s*)"[^"\r\n]*"', '\1"[REDACTED]"', 'g') as text from documents""")
def redacted_documents(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", rd.redact(F.col("text")).alias("text"))


_ERROR = "case event_id%7 when 0 then 'retained track 4 unverified' when 1 then 'insufficient evidence in region 2' when 2 then 'request timed out' when 3 then 'tool error 7' when 4 then 'offset conflict between regions' when 5 then '证据不足' else 'no match' end"


@query("b19_failure_kind", "speech", """
k as (select event_id, case event_id%7 when 0 then 'retained_track_unverified' when 1 then 'insufficient_evidence' when 2 then 'timeout' when 3 then 'infrastructure' when 4 then 'timing_conflict' when 5 then 'insufficient_evidence' else 'rejected' end as kind from speech)
select event_id, kind, case kind when 'retained_track_unverified' then 'review' when 'insufficient_evidence' then 'listen' when 'timeout' then 'retry' when 'infrastructure' then 'check_tools' else 'replace' end as advice from k""")
def failure_kind(spark, sf_dir):
    return speech(spark, sf_dir).select("event_id", rd.failure_kind(F.expr(_ERROR)).alias("kind")).withColumn("advice", rd.failure_advice(F.col("kind")))


def audit_events(spark, sf_dir):
    return spark.sql("""select media_id as candidate_id, event_id as seq, case event_id%4 when 0 then 'role' when 1 then 'identity' when 2 then 'timeline' else 'download' end as stage,
     case event_type when 'error' then 'rejected' when 'view' then 'checking' when 'click' then 'queued' else 'verified' end as state, 'token=abc'||event_id||' at '||event_id as reason from {s}""", s=speech(spark, sf_dir))


AUDIT_SQL = """
ae as (select media_id as candidate_id, event_id as seq, case event_id%4 when 0 then 'role' when 1 then 'identity' when 2 then 'timeline' else 'download' end as stage, case event_type when 'error' then 'rejected' when 'view' then 'checking' when 'click' then 'queued' else 'verified' end as state from speech),
sg as (select candidate_id, stage, arg_max(state, seq) as v, max(seq) as seq from ae group by 1,2),
fo as (select candidate_id, string_agg(stage||'='||v, ',' order by stage) as stages, arg_max(v, seq) as last, arg_max(stage, seq) as stage, max(seq) as seq from sg group by 1)"""


@query("s3_stage_fold", "speech", AUDIT_SQL + "select candidate_id, case when last in ('queued','downloaded','checking','not_examined') then 'not_examined' else last end as state, stage, stages from fo")
def stage_fold(spark, sf_dir):
    folded = pl.fold_stages(audit_events(spark, sf_dir), "candidate_id")
    stages = F.array_join(F.transform(F.map_entries("stages"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return folded.select("candidate_id", "state", "stage", stages.alias("stages"))


@query("a10_redacted_report", "speech", AUDIT_SQL + """
select candidate_id, stage, 'token=[REDACTED] at '||seq as reason, stages from fo""")
def redacted_report(spark, sf_dir):
    report = pl.redacted_report(audit_events(spark, sf_dir), "candidate_id")
    stages = F.array_join(F.transform(F.map_entries("stages"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return report.select("candidate_id", "stage", "reason", stages.alias("stages"))
