"""Queries: consensus models, verdicts, speech evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuemill import config as C
from cuemill.operators import consensus as cs
from cuemill.operators import evidence as ev
from cuemill.operators import offsets as of
from cuemill.operators import windows as wn
from cuemill.plans.intervals import union_sql
from cuemill.plans.offsets import _CLIP_SQL, clip_values
from cuemill.plans.registry import query
from cuemill.session import ensure_checkpoint_dir
from cuemill.sources.tables import shifted_cue, speech

KEY = ["media_id"]
SCALE_VALUES = ",".join(f"({i},{s!r}::double)" for i, (_, s) in enumerate(C.TIMELINE_SCALES))

_ANCHOR_SQL = """
an as (select media_id, start_ms//400000 as clip_ix, event_id as anchor_id, start_ms as movie_ms, start_ms-(media_id%7-3)*700
  + case when event_id%6=0 then (event_id*7919)%40000-20000 else event_id%5*60 end as subtitle_ms,
  0.5::double+(event_id%45)/100 as score, (event_id%10)/100 as margin, event_id%4<>0 as quality from speech),
sc(scale_ix, scale) as (values """ + SCALE_VALUES + """),
al as materialized (select media_id, scale_ix, clip_ix, anchor_id, movie_ms, score, margin, round(movie_ms-scale*subtitle_ms,3) as own from an, sc),
"""


def _pick_sql(name: str, models: str) -> str:
    return f"""{name} as materialized (select media_id, scale_ix, model, clip_ix, anchor_id, own, movie_ms, score from (
 select m.media_id, m.scale_ix, m.model, a.clip_ix, a.anchor_id, a.own, a.movie_ms, a.score, row_number() over (partition by m.media_id, m.scale_ix, m.model, a.clip_ix
  order by round(a.score+0.10::double*a.margin-0.08::double*abs(a.own-m.o)/1000,9) desc, abs(a.own-m.o), a.anchor_id) as rn
 from {models} m join al a on a.media_id=m.media_id and a.scale_ix=m.scale_ix and abs(a.own-m.o)<=case when m.scale_ix=0 then 850 else 1200 end) where rn=1)"""


_MODEL_SQL = _ANCHOR_SQL + "m0 as (select distinct media_id, scale_ix, own as model, own as o from al)," + _pick_sql("p1", "m0") + """,
m1 as (select media_id, scale_ix, model, median(own) as o from p1 group by 1,2,3 having count(*)>=2),""" + _pick_sql("p2", "m1") + """,
m2 as (select media_id, scale_ix, model, median(own) as o from p2 group by 1,2,3 having count(*)>=2),
md as (select p2.media_id, p2.scale_ix, p2.model, any_value(o) as offset_ms, count(*) as probes, median(abs(own-o)) as median_residual, max(abs(own-o)) as max_residual,
 max(movie_ms)-min(movie_ms) as span_ms, avg(score) as mean_score, count(*) filter (score>=0.60::double) as strong, avg(score) filter (score>=0.60::double) as strong_mean,
 count(*) filter (score>=0.50::double) as corroborating, string_agg(cast(anchor_id as varchar), ',' order by anchor_id) as anchors
 from p2 join m2 on m2.media_id=p2.media_id and m2.scale_ix=p2.scale_ix and m2.model=p2.model group by 1,2,3),
dm as (select * from (select *, row_number() over (partition by media_id, scale_ix, anchors order by probes desc, round(median_residual,3), span_ms desc, round(mean_score,9) desc, round(max_residual,3), model) as r from md) where r=1),
tm as (select * exclude (r), cast(row_number() over (partition by media_id, scale_ix order by probes desc, round(median_residual,3), span_ms desc, round(mean_score,9) desc, round(max_residual,3), model) as int) as place from dm)"""


def _anchors(spark, sf_dir):
    e = F.col("event_id")
    noise = F.when(e % 6 == 0, e * 7919 % 40_000 - 20_000).otherwise(e % 5 * 60)
    return speech(spark, sf_dir).select(
        "media_id", F.floor(F.col("start_ms") / 400_000).alias("clip_ix"), e.alias("anchor_id"), F.col("start_ms").alias("movie_ms"),
        (F.col("start_ms") - (F.col("media_id") % 7 - 3) * 700 + noise).alias("subtitle_ms"),
        (0.5 + e % 45 / 100).alias("score"), (e % 10 / 100).alias("margin"), (e % 4 != 0).alias("quality"))


def _durations(spark, sf_dir):
    return speech(spark, sf_dir).groupBy("media_id").agg(F.max("end_ms").alias("duration_ms"))


def _models(spark, sf_dir):
    return cs.timeline_models(_anchors(spark, sf_dir).drop("quality"), KEY)


@query("d9_timeline_models", "speech", _MODEL_SQL + """
select media_id, cast(scale_ix as int) as scale_ix, place, probes, round(offset_ms,4) as offset_ms, round(median_residual,4) as median_residual, round(max_residual,4) as max_residual, span_ms, anchors from tm where place<=3""")
def timeline_models(spark, sf_dir):
    r = {c: F.round(c, 4) for c in ("offset_ms", "median_residual", "max_residual")}
    return _models(spark, sf_dir).filter("place <= 3").withColumns(r).select(
        "media_id", "scale_ix", "place", "probes", "offset_ms", "median_residual", "max_residual", "span_ms", "anchors")


_ACCEPT_SQL = _MODEL_SQL + """,
sp as (select media_id, count(*) filter (top>=0.60::double) as strong_probes from (select media_id, clip_ix, max(score) as top from an group by 1,2) group by 1),
du as (select media_id, max(end_ms) as duration_ms from speech group by 1),
ac as (select tm.*, strong_probes, array_to_string(list_filter([
 case when probes<greatest(2,ceil(strong_probes*0.7::double)) then 'consensus' end,
 case when scale_ix<>0 and probes<3 then 'anchors' end,
 case when strong<case when scale_ix=0 then 2 else 3 end then 'strong_anchors' when round(strong_mean,9)<case when scale_ix=0 then 0.70::double else 0.68::double end then 'mean_score' end,
 case when scale_ix=0 and corroborating<2 then 'corroboration' end,
 case when span_ms<case when scale_ix=0 then greatest(300000,duration_ms*0.25::double) else greatest(900000,duration_ms*0.20::double) end then 'span' end,
 case when round(max_residual,3)>case when scale_ix=0 then 850 else 1200 end then 'residual' end], lambda x: x is not null), ',') as reasons
 from tm join sp on sp.media_id=tm.media_id join du on du.media_id=tm.media_id where place=1)"""


def _accepted(spark, sf_dir):
    return cs.accept_models(_models(spark, sf_dir), _anchors(spark, sf_dir), _durations(spark, sf_dir), KEY)


@query("d10_model_acceptance", "speech", _ACCEPT_SQL + "select media_id, cast(scale_ix as int) as scale_ix, probes, strong, strong_probes, reasons from ac")
def model_acceptance(spark, sf_dir):
    return _accepted(spark, sf_dir).select("media_id", "scale_ix", "probes", "strong", "strong_probes", "reasons")


_CHOICE_SQL = _ACCEPT_SQL + """,
kp as (select *, row_number() over (partition by media_id order by probes desc, round(median_residual,3), span_ms desc, round(mean_score,9) desc, scale_ix) as r from ac where reasons=''),
ch as (select b.media_id, case when f.media_id is not null and ((f.probes=b.probes and f.median_residual<=b.median_residual+250) or (f.probes<>b.probes and f.probes>=3
 and f.probes>=ceil(b.probes*0.8::double) and f.span_ms>=b.span_ms*0.8::double and f.median_residual<=200 and b.median_residual>=f.median_residual+250)) then f.scale_ix else b.scale_ix end as scale_ix
 from kp b left join kp f on f.media_id=b.media_id and f.scale_ix=0 where b.r=1),
cm as (select ac.media_id, ac.scale_ix, ac.offset_ms, ac.probes, ac.median_residual, ac.max_residual, ac.span_ms, ac.anchors from ac join ch on ch.media_id=ac.media_id and ch.scale_ix=ac.scale_ix)"""


@query("d10_chosen_model", "speech", _CHOICE_SQL + "select media_id, cast(scale_ix as int) as scale_ix, round(offset_ms,4) as offset_ms, probes, round(median_residual,4) as median_residual, span_ms from cm")
def chosen_model(spark, sf_dir):
    return cs.choose_model(_accepted(spark, sf_dir), KEY).withColumns(
        {c: F.round(c, 4) for c in ("offset_ms", "median_residual")})


@query("h2_production_safety", "speech", _CHOICE_SQL + """,
us as (select cm.media_id, count(*) filter (quality) as good from cm join an on an.media_id=cm.media_id and list_contains(string_split(cm.anchors,','), cast(an.anchor_id as varchar)) group by 1),
rv as (select cm.media_id, tm.offset_ms as ro, row_number() over (partition by cm.media_id order by tm.probes desc, tm.median_residual, tm.max_residual) as r
 from cm join tm on tm.media_id=cm.media_id and tm.scale_ix=0 and tm.place between 2 and 3 where cm.scale_ix=0 and cm.probes-tm.probes between 0 and 1 and abs(tm.offset_ms-cm.offset_ms)>150
 and tm.median_residual<=cm.median_residual and tm.max_residual<=cm.max_residual and (tm.median_residual<cm.median_residual or tm.max_residual<cm.max_residual)),
re as (select cm.media_id, scale_ix, offset_ms, probes, ro as competing_ms, case when scale_ix>0 then 'affine' when abs(offset_ms)>10000 then 'out_of_range' when probes<3 then 'few_anchors'
 when max_residual>850 then 'residual' when coalesce(good,0)<2 then 'few_quality_anchors' when ro is not null then 'fragile_rival' else '' end as reason
 from cm left join us on us.media_id=cm.media_id left join rv on rv.media_id=cm.media_id and r=1)
select media_id, cast(scale_ix as int) as scale_ix, round(offset_ms,4) as offset_ms, probes, round(competing_ms,4) as competing_ms, reason, case when reason='' then 'HIGH' else 'BORDERLINE' end as status from re""")
def production_safety(spark, sf_dir):
    anchors = _anchors(spark, sf_dir)
    ensure_checkpoint_dir(spark)
    models = _models(spark, sf_dir).filter("place <= 3").checkpoint()  # read three times
    accepted = cs.accept_models(models, anchors, _durations(spark, sf_dir), KEY)
    verdict = cs.production_safety(cs.choose_model(accepted, KEY), models, anchors, KEY)
    return verdict.withColumns({c: F.round(c, 4) for c in ("offset_ms", "competing_ms")})


@query("d12_micro_offset", "speech", """
an as (select media_id, start_ms//1500000 as clip, event_id*53%500-250+case when event_id%7=0 then 900 else 0 end as micro_ms, 0.70::double+(event_id%30)/100 as score, 0.5::double+(event_id%40)/100 as probability, event_id%700 as residual_ms from speech),
c as (select media_id, clip, median(micro_ms) as centre, count(*) as n from an group by 1,2),
m as (select an.media_id, an.clip, any_value(centre) as centre, any_value(n) as n, median(abs(micro_ms-centre)) as mad from an join c on c.media_id=an.media_id and c.clip=an.clip group by 1,2),
k as (select an.*, round(greatest(0.01::double, score*probability/(1+abs(residual_ms)/1000)),9) as weight from an join m on m.media_id=an.media_id and m.clip=an.clip where abs(micro_ms-centre)<=greatest(180, mad*3)),
h as (select *, sum(weight) over (partition by media_id, clip order by micro_ms) as seen, sum(weight) over (partition by media_id, clip) as total from k),
f as (select media_id, clip, min(micro_ms) filter (round(seen,6)>=round(total/2,6)) as micro, max(micro_ms)-min(micro_ms) as spread_ms, count(*) as kept,
 count(*) filter (micro_ms>80) as up, count(*) filter (micro_ms<-80) as down, avg(score) as mean_score from h group by 1,2),
v as (select m.media_id, m.clip, n, kept, mad, spread_ms, micro, case when n<3 then 'NONE' when kept<3 or abs(micro)>800 or spread_ms>350 or not (up+down=0 or greatest(up,down)>=ceil((up+down)*0.67::double)) then 'LOW'
 when spread_ms<=150 and round(mean_score,9)>=0.82::double then 'HIGH' else 'MEDIUM' end as confidence from m join f on f.media_id=m.media_id and f.clip=m.clip)
select media_id, clip, n, kept, mad, spread_ms, confidence, case when confidence in ('HIGH','MEDIUM') then micro end as micro_ms from v""")
def micro_offset(spark, sf_dir):
    e = F.col("event_id")
    anchors = speech(spark, sf_dir).select(
        "media_id", F.floor(F.col("start_ms") / 1_500_000).alias("clip"),
        (e * 53 % 500 - 250 + F.when(e % 7 == 0, 900).otherwise(0)).alias("micro_ms"),
        (0.70 + e % 30 / 100).alias("score"), (0.5 + e % 40 / 100).alias("probability"), (e % 700).alias("residual_ms"))
    return cs.micro_offset(anchors, ["media_id", "clip"])


@query("h1_offset_guard", "speech", _CLIP_SQL.replace("case when event_id%29=0 then 3000 else 0 end", "case when event_id%29=0 and media_id%3=0 then 3000 when media_id%8=1 and start_ms>6000000 then 1800 else 0 end").replace("event_id*37%1200 - 600", "event_id*37%400 - 200") + """,
rg as (select media_id, clip_ix//5 as region, median(offset_ms) as o, max(offset_ms)-min(offset_ms)>1000 as conflict from cu where usable group by 1,2),
pr as (select media_id, (media_id%7-3)*700 + case when media_id%5=0 then 1200 else 0 end as proposal_ms from speech group by 1),
cc as (select media_id, bool_or(conflict) as clip_conflict from cu group by 1),
fo as (select rg.media_id, count(*) as regions, bool_or(conflict) as region_conflict, max(abs(o)) as worst, median(abs(o)) as base, median(abs(o-proposal_ms)) as shifted, median(o) as centre from rg join pr on pr.media_id=rg.media_id group by 1),
cx as (select media_id, max(n) as size from (select a.media_id, a.o, count(*) as n from (select distinct media_id, o from rg) a join rg b on b.media_id=a.media_id and b.o between a.o-1000 and a.o group by 1,2) group by 1),
st as (select pr.media_id, proposal_ms, coalesce(regions,0) as regions, case when coalesce(clip_conflict,false) or coalesce(region_conflict,false) then 'TIMING_UNRESOLVED' when regions>=2 and worst<=800 then 'KEEP_ORIGINAL'
 when coalesce(regions,0)<3 then 'NEED_MORE' when size<>regions then 'TIMING_UNRESOLVED' when base<=800 and (shifted>=base*0.75::double or base-shifted<250) then 'KEEP_ORIGINAL'
 when shifted<=900 and base-shifted>=250 and case when base>0 then (base-shifted)/base else 0 end>=0.5::double and abs(centre-proposal_ms)<=850 then 'APPLY_OFFSET' else 'REJECTED' end as status
 from pr left join cc on cc.media_id=pr.media_id left join fo on fo.media_id=pr.media_id left join cx on cx.media_id=pr.media_id)
select media_id, proposal_ms, regions, status, case when status='APPLY_OFFSET' then proposal_ms when status='KEEP_ORIGINAL' then 0 end as selected_ms from st""")
def offset_guard(spark, sf_dir):
    e, m = F.col("event_id"), F.col("media_id")
    odd = F.when((e % 29 == 0) & (m % 3 == 0), 3000).when((m % 8 == 1) & (F.col("start_ms") > 6_000_000), 1800).otherwise(0)
    rows = speech(spark, sf_dir)
    values = rows.select("media_id", F.floor(F.col("start_ms") / 400_000).alias("clip_ix"), ((m % 7 - 3) * 700 + e * 37 % 400 - 200 + odd).alias("value"))
    clips = of.clip_offsets(values, KEY).withColumn("region", F.floor(F.col("clip_ix") / 5))
    proposals = rows.select("media_id").distinct().withColumn("proposal_ms", (m % 7 - 3) * 700 + F.when(m % 5 == 0, 1200).otherwise(0))
    regions = of.region_offsets(clips, KEY).join(proposals, "media_id").withColumn("offset_ms", F.col("offset_ms").cast("double"))
    clusters = wn.consensus_cluster(regions.withColumn("v", (F.col("offset_ms") * 2).cast("long")).withColumn("p", F.col("proposal_ms") * 2), KEY, "v", "p", spread=2_000)
    return cs.offset_guard(clips, clusters, proposals, KEY)


def _cue_dialogue(spark, sf_dir):
    """Cues of the shifted copy with a dialogue flag (the first and last cue of a film are edges)."""
    cues = shifted_cue(spark, sf_dir)
    ends = cues.groupBy("media_id").agg(
        F.min_by("event_id", F.struct("start_ms", "event_id")).alias("first"), F.max_by("event_id", F.struct("start_ms", "event_id")).alias("last"))
    text = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("♪ "), "text")).when(F.col("event_id") % 10 == 1, F.concat(F.lit("("), "text", F.lit(")"))).when(
        F.col("event_id") % 10 == 2, F.concat(F.lit("English - "), "text")).otherwise(F.col("text"))
    edged = cues.withColumn("text", text).join(ends, "media_id").withColumn("edge", (F.col("event_id") == F.col("first")) | (F.col("event_id") == F.col("last")))
    return edged.select("media_id", "event_id", "start_ms", "end_ms", ev.dialogue_flag().alias("dialogue"))


_CUE_SQL = """
cd as (select media_id, event_id, start_ms, end_ms, not (event_id%10 in (0,1) or (event_id%10=2 and (row_number() over (partition by media_id order by start_ms, event_id)=1 or row_number() over (partition by media_id order by start_ms desc, event_id desc)=1))) as dialogue from shifted_cue),
du as (select media_id, max(end_ms) as duration_ms from speech group by 1),
""" + union_sql("u", "speech") + """,
vo as (select media_id, cast(sum(end_ms-start_ms) as bigint) as spoken_ms from u group by 1),
rc as (select cd.media_id, least(4, floor((start_ms+least(least(end_ms,start_ms+10000),duration_ms))*5/(duration_ms*2))) as r from cd join du on du.media_id=cd.media_id where start_ms<duration_ms and dialogue),
rr as (select media_id, r, count(*) as n from rc group by 1,2),
rs as (select media_id, cast(sum(n) as bigint) as cue_count, count(*) filter (n>=5) as covered_regions from rr group by 1),
pc as (select du.media_id, duration_ms, spoken_ms, duration_ms-spoken_ms as quiet_ms, coalesce(cue_count,0) as cue_count, coalesce(covered_regions,0) as covered_regions from du left join vo on vo.media_id=du.media_id left join rs on rs.media_id=du.media_id),
pk as (select media_id, spoken_ms, quiet_ms, cue_count, covered_regions, array_to_string(list_filter([case when cue_count<40 then 'too_few_dialogue_cues' end, case when spoken_ms<30000 then 'too_little_speech' end,
 case when quiet_ms<30000 then 'too_little_quiet' end, case when covered_regions<3 then 'dialogue_concentrated' end], lambda x: x is not null), ',') as reasons from pc)"""


@query("d6_evidence_precheck", "speech shifted_cue", _CUE_SQL + "select * from pk")
def evidence_precheck(spark, sf_dir):
    return ev.precheck(_cue_dialogue(spark, sf_dir), speech(spark, sf_dir), _durations(spark, sf_dir), KEY)


def _peaks(spark, sf_dir):
    reference = ev.frame_runs(speech(spark, sf_dir), KEY)
    candidate = ev.frame_runs(shifted_cue(spark, sf_dir), KEY)
    domain = reference.groupBy("media_id").agg(F.max("b").alias("n_ref")).join(
        candidate.groupBy("media_id").agg((F.max("b") + 2).alias("n_cand")), "media_id")
    return ev.correlation_peaks(reference, candidate, domain, KEY)


@query("d17_correlation_peaks")
def correlation_peaks(spark, sf_dir):
    return _peaks(spark, sf_dir).withColumns({"rival_ratio": F.round("rival_ratio", 6), "outside_ratio": F.round("outside_ratio", 6)})


_SUPPORT_SQL = """
rg as (select media_id, r as region, (duration_ms//10)*r//5 as f0, (duration_ms//10)*(r+1)//5 as f1 from du, (select unnest([0,1,2,3,4]) as r)),
lc as (select cd.media_id, region, f0, f1, start_ms, least(end_ms,start_ms+10000) as end_ms, cd.media_id%7-3 as d from cd join rg on rg.media_id=cd.media_id where dialogue and start_ms>=(f0+1000)*10 and least(end_ms,start_ms+10000)<=(f1-1000)*10),
ct as (select media_id, region, count(*) as cue_count, count(distinct start_ms) as starts from lc group by 1,2),
vf as materialized (select distinct media_id, unnest(range(cast(round_even(start_ms/10,0) as bigint), cast(round_even(start_ms/10,0) as bigint)+cast(round_even((end_ms-start_ms)/10,0) as bigint))) as f from speech),
vr as (select rg.media_id, region, f from vf join rg on rg.media_id=vf.media_id and f>=f0 and f<f1),
sf as (select distinct media_id, region, f0, f1, unnest(range(cast(round_even((start_ms+d*700)/10,0) as bigint), cast(round_even((start_ms+d*700)/10,0) as bigint)+cast(round_even((end_ms-start_ms)/10,0) as bigint))) as f from lc),
sr as (select media_id, region, f from sf where f>=f0 and f<f1),
nv as (select media_id, region, count(*) as voiced from vr group by 1,2), ns as (select media_id, region, count(*) as shown from sr group by 1,2),
no as (select sr.media_id, sr.region, count(*) as overlap from sr join vr on vr.media_id=sr.media_id and vr.region=sr.region and vr.f=sr.f group by 1,2),
aa as (select rg.media_id, rg.region, f1-f0 as size, coalesce(cue_count,0) as cue_count, coalesce(starts,0) as starts, coalesce(voiced,0) as voiced, coalesce(shown,0) as shown, coalesce(overlap,0) as overlap from rg
 left join ct on ct.media_id=rg.media_id and ct.region=rg.region left join nv on nv.media_id=rg.media_id and nv.region=rg.region left join ns on ns.media_id=rg.media_id and ns.region=rg.region left join no on no.media_id=rg.media_id and no.region=rg.region),
bb as (select *, starts>=8 and least(voiced, size-voiced)>=500 as enough, overlap/greatest(1,least(voiced,shown)) as ra, (overlap-voiced*shown/size)/greatest(1.0::double, least(voiced,shown)-voiced*shown/size) as ga from aa),
su as (select media_id, cast(region as int) as region, cue_count, enough, case when enough then ra end as overlap_ratio, case when enough then ga end as overlap_gain, enough and ra>=0.65::double and ga>=0.35::double as supported from bb)"""


def _support(spark, sf_dir):
    films = _durations(spark, sf_dir)
    offsets = films.select("media_id", ((F.col("media_id") % 7 - 3) * 700).alias("offset_ms"))
    return ev.regional_support(_cue_dialogue(spark, sf_dir), speech(spark, sf_dir), films, offsets, KEY)


@query("d18_regional_support", "speech shifted_cue", _CUE_SQL + "," + _SUPPORT_SQL + """
select media_id, region, cue_count, enough, round(overlap_ratio,6) as overlap_ratio, round(overlap_gain,6) as overlap_gain, supported from su""")
def regional_support(spark, sf_dir):
    return _support(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("overlap_ratio", "overlap_gain")})


@query("h3_evidence_verdict")
def evidence_verdict(spark, sf_dir):
    films = _durations(spark, sf_dir)
    pre = ev.precheck(_cue_dialogue(spark, sf_dir), speech(spark, sf_dir), films, KEY)
    tool = films.select("media_id", ((F.col("media_id") % 7 - 3) * 700 + F.when(F.col("media_id") % 10 == 9, 9_000).otherwise(0)).alias("tool_ms"))
    regional = ev.regional_offsets(_cue_dialogue(spark, sf_dir), speech(spark, sf_dir), films, KEY)
    return ev.evidence_verdict(pre, _peaks(spark, sf_dir), _support(spark, sf_dir), tool, KEY, regional)


@query("d18_regional_offsets")
def regional_offsets(spark, sf_dir):
    found = ev.regional_offsets(_cue_dialogue(spark, sf_dir), speech(spark, sf_dir), _durations(spark, sf_dir), KEY)
    return found.withColumns({c: F.round(c, 6) for c in ("overlap_ratio", "overlap_gain")})


@query("h3_coverage_ladder")
def coverage_ladder(spark, sf_dir):
    films = _durations(spark, sf_dir)
    tool = films.select("media_id", ((F.col("media_id") % 7 - 3) * 700).alias("tool_ms"))
    cues = shifted_cue(spark, sf_dir).select("media_id", "event_id", "start_ms", "end_ms", "text")
    return ev.evidence_ladder(cues, speech(spark, sf_dir), films, tool, KEY, "event_id", rungs=((50, 60, 75),))
