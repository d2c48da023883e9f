"""Queries: offset estimation on speech and its shifted copy."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuemill import config as C
from cuemill.functions import text as T
from cuemill.operators import offsets as of
from cuemill.plans.registry import query
from cuemill.sources.tables import doc_cue, shifted_cue, speech

KEY = ["media_id"]
PAIR_SQL = """
l as (select media_id, text as text_key, min(start_ms) as left_ms from shifted_cue where length(text)>=12 group by 1,2 having count(*)=1),
r as (select media_id, text_key, min(start_ms) as right_ms from (select media_id, 'line number '||(event_id - event_id%13//12)||' spoken' as text_key, start_ms from speech) where length(text_key)>=12 group by 1,2 having count(*)=1),
p as (select l.media_id, l.text_key, left_ms, right_ms from l join r on l.media_id=r.media_id and l.text_key=r.text_key),
du as (select media_id, max(end_ms) as duration_ms from speech group by 1)
"""


def _pairs(spark, sf_dir):
    key = T.clean_dialogue_key(F.col("text"), unicode=False)
    left = shifted_cue(spark, sf_dir).withColumn("text_key", key)
    # Some lines are said twice on this side, so they cannot serve as anchors.
    twice = (F.col("event_id") % 13 / 12).cast("long")
    right = speech(spark, sf_dir).withColumn(
        "text_key", F.concat(F.lit("line number "), F.col("event_id") - twice, F.lit(" spoken")))
    long_enough = F.length("text_key") >= 12
    return of.unique_text_pairs(left.filter(long_enough), right.filter(long_enough), KEY)


def _durations(spark, sf_dir):
    return speech(spark, sf_dir).groupBy("media_id").agg(F.max("end_ms").alias("duration_ms"))


@query("c1_unique_text_pairs", "speech shifted_cue", PAIR_SQL + "select media_id, text_key, left_ms, right_ms from p")
def unique_text_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


_SUPPORT_SQL = """
su as (select p.media_id, any_value(duration_ms) as duration_ms, count(*) as pairs, (max(left_ms)-min(left_ms))/any_value(duration_ms) as span,
 count(distinct least(3, greatest(0, floor(left_ms*4.0::double/greatest(duration_ms,1000))))) as quarters from p join du on du.media_id=p.media_id group by 1)
"""


@query("d7_fixed_offset", "speech shifted_cue", PAIR_SQL + ", q as (select distinct media_id, left_ms, right_ms+left_ms%40 as right_ms from p)," + _SUPPORT_SQL.replace("from p join", "from q p join") + """,
f as (select media_id, median(right_ms-left_ms) as m from q group by 1),
i as (select q.*, right_ms-left_ms as o from q join f on f.media_id=q.media_id where abs(right_ms-left_ms-m)<=1500),
g as (select media_id, median(o) as offset_ms from i group by 1),
s as (select i.media_id, count(*) as inliers, median(abs(o-offset_ms)) as median_residual, quantile_disc(abs(o-offset_ms), 0.9) as p90_residual from i join g on g.media_id=i.media_id group by 1)
select su.media_id, pairs, round(span,6) as span, quarters, offset_ms, inliers, median_residual, p90_residual,
 coalesce(pairs>=20 and span>=0.55::double and quarters>=3 and inliers>=20 and inliers>=ceil(pairs*0.55::double) and abs(offset_ms)<=10000 and median_residual<=350 and p90_residual<=800, false) as accepted
 from su left join g on g.media_id=su.media_id left join s on s.media_id=su.media_id""")
def fixed_offset(spark, sf_dir):
    pairs = _pairs(spark, sf_dir).withColumn("right_ms", F.col("right_ms") + F.col("left_ms") % 40)
    return of.fixed_offset(pairs, _durations(spark, sf_dir), KEY).select(
        "media_id", "pairs", F.round("span", 6).alias("span"), "quarters", "offset_ms", "inliers", "median_residual", "p90_residual", "accepted")


@query("d8_affine_offset", "speech shifted_cue", PAIR_SQL + ", q as (select media_id, left_ms, cast(round_even(right_ms*(25.0::double/24.0::double),0) as bigint) as right_ms from p)," + _SUPPORT_SQL.replace("from p join", "from q p join") + """,
sl as (select a.media_id, median((b.right_ms-a.right_ms)/(b.left_ms-a.left_ms)) as slope from q a join q b on a.media_id=b.media_id and b.left_ms-a.left_ms>=60000 group by 1),
f as (select q.media_id, any_value(slope) as slope, median(right_ms-slope*left_ms) as m from q join sl on sl.media_id=q.media_id group by 1),
i as (select q.* from q join f on f.media_id=q.media_id where abs(right_ms-(m+slope*left_ms))<=1500),
g as (select media_id, regr_slope(right_ms, left_ms) as scale, regr_intercept(right_ms, left_ms) as offset_ms from i group by 1),
s as (select i.media_id, count(*) as inliers, median(abs(right_ms-(offset_ms+scale*left_ms))) as median_residual, quantile_disc(abs(right_ms-(offset_ms+scale*left_ms)), 0.9) as p90_residual from i join g on g.media_id=i.media_id group by 1)
select su.media_id, pairs, quarters, round(offset_ms,2) as offset_ms, round(scale,7) as scale, inliers, round(median_residual,3) as median_residual, round(p90_residual,3) as p90_residual,
 coalesce(pairs>=20 and span>=0.55::double and quarters>=3 and inliers>=20 and inliers>=ceil(pairs*0.55::double) and abs(offset_ms)<=10000
 and least(abs(scale-1),abs(scale-24/23.976::double),abs(scale-23.976::double/24),abs(scale-25/24.0::double),abs(scale-24/25.0::double),abs(scale-25/23.976::double),abs(scale-23.976::double/25))<=0.002::double
 and median_residual<=350 and p90_residual<=800, false) as accepted
 from su left join g on g.media_id=su.media_id left join s on s.media_id=su.media_id""")
def affine_offset(spark, sf_dir):
    pairs = _pairs(spark, sf_dir).withColumn("right_ms", F.bround(F.col("right_ms") * (25.0 / 24.0)).cast("long"))
    return of.affine_offset(pairs, _durations(spark, sf_dir), KEY).select(
        "media_id", "pairs", "quarters", F.round("offset_ms", 2).alias("offset_ms"), F.round("scale", 7).alias("scale"), "inliers",
        F.round("median_residual", 3).alias("median_residual"), F.round("p90_residual", 3).alias("p90_residual"), "accepted")


def bins_sql(name: str, source: str, cell: int, keys: str = "media_id") -> str:
    a = f"greatest(0, cast(round_even(start_ms/{cell}::double,0) as bigint))"
    return (f"{name} as materialized (select distinct {keys}, unnest(range({a}, greatest({a}+1, cast(round_even(end_ms/{cell}::double,0) as bigint)))) as b from {source})")


_D15_SQL = bins_sql("rc", "speech", 500) + "," + bins_sql("cc", "shifted_cue", 500) + "," + bins_sql("rf", "speech", 100) + "," + bins_sql("cf", "shifted_cue", 100) + """,
k as (select distinct c.media_id from cc c join rc r on r.media_id=c.media_id),
h as (select c.media_id, r.b-c.b as k, count(*) as c from cc c join rc r on r.media_id=c.media_id and r.b-c.b between -240 and 240 group by 1,2),
g as (select k.media_id, s.k, coalesce(h.c,0) as c from k cross join (select unnest(range(-240,241)) as k) s left join h on h.media_id=k.media_id and h.k=s.k),
co as (select media_id, k as coarse from (select *, row_number() over (partition by media_id order by c desc, k) as rn from g) where rn=1),
fh as (select c.media_id, r.b-c.b-coarse*5 as k, count(*) as c from cf c join co on co.media_id=c.media_id join rf r on r.media_id=c.media_id and r.b-c.b between coarse*5-10 and coarse*5+10 group by 1,2),
fg as (select co.media_id, coarse, s.k, coalesce(fh.c,0) as c from co cross join (select unnest(range(-10,11)) as k) s left join fh on fh.media_id=co.media_id and fh.k=s.k),
bs as (select media_id, (coarse*5+k)*100 as shift_ms, c as overlap from (select *, row_number() over (partition by media_id order by c desc, k) as rn from fg) where rn=1),
sh as (select bs.media_id, shift_ms, overlap, overlap/least(nr,nc) as score from bs join (select media_id, count(*) as nr from rf group by 1) a on a.media_id=bs.media_id
 join (select media_id, count(*) as nc from cf group by 1) b on b.media_id=bs.media_id)
"""


def _best_shift(spark, sf_dir):
    return of.best_shift(speech(spark, sf_dir), shifted_cue(spark, sf_dir), KEY)


@query("d15_best_shift", "speech shifted_cue", _D15_SQL + "select media_id, shift_ms, overlap, round(score,6) as score from sh")
def best_shift(spark, sf_dir):
    return _best_shift(spark, sf_dir).withColumn("score", F.round("score", 6))


_D16_SQL = """
sx as (select media_id, (media_id%7-3)*700 as shift_ms from speech group by 1),
rg as (select media_id, region, duration_ms*lo as low_ms, duration_ms*hi as high_ms from (select media_id, max(end_ms) as duration_ms from speech group by 1),
 (values ('early',0.10::double,0.35::double),('middle',0.40::double,0.65::double),('late',0.70::double,0.95::double)) v(region,lo,hi)),
st as (select unnest(range(-20,21)) as step),
ri as (select s.media_id, region, low_ms, high_ms, start_ms, end_ms from speech s join rg on rg.media_id=s.media_id where end_ms>low_ms and start_ms<high_ms),
ca as (select c.media_id, region, low_ms, high_ms, shift_ms, start_ms, end_ms from shifted_cue c join rg on rg.media_id=c.media_id join sx on sx.media_id=c.media_id),
rcnt as (select media_id, region, count(*) as reference_count from ri group by 1,2),
ccnt as (select media_id, region, count(*) as candidate_count from ca where end_ms+shift_ms>low_ms and start_ms+shift_ms<high_ms group by 1,2),
rcut as (select media_id, region, greatest(start_ms,low_ms) as start_ms, least(end_ms,high_ms) as end_ms from ri where least(end_ms,high_ms)>greatest(start_ms,low_ms)),
ccut as (select media_id, region, step, greatest(start_ms+shift_ms+step*100,low_ms) as start_ms, least(end_ms+shift_ms+step*100,high_ms) as end_ms from ca, st
 where end_ms+shift_ms+step*100>low_ms and start_ms+shift_ms+step*100<high_ms and least(end_ms+shift_ms+step*100,high_ms)>greatest(start_ms+shift_ms+step*100,low_ms)),
""" + bins_sql("rb", "rcut", 100, "media_id, region") + "," + bins_sql("cb", "ccut", 100, "media_id, region, step") + """,
rn as (select media_id, region, count(*) as nr from rb group by 1,2), cn as (select media_id, region, step, count(*) as nc from cb group by 1,2,3),
ov as (select cb.media_id, cb.region, step, count(*) as o from cb join rb on rb.media_id=cb.media_id and rb.region=cb.region and rb.b=cb.b group by 1,2,3),
sc as (select rg.media_id, rg.region, st.step, case when nr is null or nc is null then 0 else coalesce(o,0)/least(nr,nc) end as score from rg cross join st
 left join rn on rn.media_id=rg.media_id and rn.region=rg.region left join cn on cn.media_id=rg.media_id and cn.region=rg.region and cn.step=st.step
 left join ov on ov.media_id=rg.media_id and ov.region=rg.region and ov.step=st.step),
bt as (select * from (select *, row_number() over (partition by media_id, region order by score desc, step) as k from sc) where k=1),
re as (select bt.media_id, bt.region, shift_ms+step*100 as offset_ms, score, coalesce(reference_count,0) as reference_count, coalesce(candidate_count,0) as candidate_count
 from bt join sx on sx.media_id=bt.media_id left join rcnt on rcnt.media_id=bt.media_id and rcnt.region=bt.region left join ccnt on ccnt.media_id=bt.media_id and ccnt.region=bt.region)
"""


def _regional(spark, sf_dir):
    # The true shift of the fixture stands in for the whole-film answer, so this query is independent of D15.
    rows = speech(spark, sf_dir)
    shifts = rows.select("media_id").distinct().withColumn("shift_ms", (F.col("media_id") % 7 - 3) * 700)
    return of.regional_overlap(rows, shifted_cue(spark, sf_dir), shifts, _durations(spark, sf_dir), KEY)


@query("d16_regional_overlap", "speech shifted_cue", _D16_SQL + "select media_id, region, offset_ms, round(score,6) as score, reference_count, candidate_count from re")
def regional_overlap(spark, sf_dir):
    return _regional(spark, sf_dir).withColumn("score", F.round("score", 6))


@query("d16_structure_verdict", "speech shifted_cue", _D15_SQL + "," + _D16_SQL.strip().replace("rn as (select media_id, region", "rn2 as (select media_id, region").replace("left join rn on rn.media_id=rg.media_id and rn.region", "left join rn2 on rn2.media_id=rg.media_id and rn2.region") + """,
fo as (select media_id, min(score) as low_score, max(offset_ms)-min(offset_ms) as spread_ms, min(least(reference_count,candidate_count)) as low_count from re group by 1)
select sh.media_id, shift_ms, round(score,6) as score, round(low_score,6) as low_score, spread_ms, low_count,
 abs(shift_ms)<=10000 and score>=0.85::double and low_score>=0.80::double and spread_ms<=500 and low_count>=10 as strong from sh join fo on fo.media_id=sh.media_id""")
def structure_verdict(spark, sf_dir):
    return of.structure_verdict(_best_shift(spark, sf_dir), _regional(spark, sf_dir), KEY).select(
        "media_id", "shift_ms", F.round("score", 6).alias("score"), F.round("low_score", 6).alias("low_score"), "spread_ms", "low_count", "strong")


@query("d32_version_offset", "doc_cue", """
b as (select track_id, cue_ix, greatest(0,start_ms+(track_id%9-4)*600+case when track_id%5=0 then cue_ix%4*150 else 0 end) as s1, case when cue_ix%17=0 then text||' x' else text end as k1 from doc_cue where not (track_id%11=0 and cue_ix=1)),
j as (select coalesce(a.track_id,b.track_id) as track_id, start_ms as s0, text as k0, s1, k1 from doc_cue a full join b on a.track_id=b.track_id and a.cue_ix=b.cue_ix),
n as (select track_id, count(s0) as n_before, count(s1) as n_after from j group by 1),
s as (select track_id, s0, s1-s0 as d from j where k0=k1),
m as (select track_id, median(d) as med, count(*) as matched from s group by 1),
c as (select s.track_id, count(*) as comparable, max(abs(d-med)) as dev from s join m on m.track_id=s.track_id where not (med<0 and s0+med<0) group by 1),
r as (select n.track_id, n_before, coalesce(matched,0) as matched, coalesce(comparable,0) as comparable, med,
 case when n_before<3 or n_before<>n_after then 'structure_changed' when coalesce(matched,0)<greatest(3,n_before//2) then 'unmatched' when coalesce(comparable,0)<3 then 'all_clamped' when dev>250 then 'not_fixed' else '' end as reason
 from n left join m on m.track_id=n.track_id left join c on c.track_id=n.track_id)
select track_id, n_before, matched, comparable, reason, case when reason='' then cast(round_even(med,0) as bigint) end as offset_ms from r""")
def version_offset(spark, sf_dir):
    before = doc_cue(spark, sf_dir).withColumn("text_key", F.col("text"))
    track, ix = F.col("track_id"), F.col("cue_ix")
    wobble = F.when(track % 5 == 0, ix % 4 * 150).otherwise(0)
    after = before.filter(~((track % 11 == 0) & (ix == 1))).withColumns({
        "start_ms": F.greatest(F.lit(0).cast("long"), F.col("start_ms") + (track % 9 - 4) * 600 + wobble),
        "text_key": F.when(ix % 17 == 0, F.concat("text", F.lit(" x"))).otherwise(F.col("text"))})
    return of.version_offset(before, after, ["track_id"])


_CLIP_SQL = """
v as (select media_id, start_ms//400000 as clip_ix, (media_id%7-3)*700 + event_id*37%1200 - 600 + case when event_id%29=0 then 3000 else 0 end as value from speech),
cl as (select media_id, clip_ix, median(value) as offset_ms, count(*) as n, max(value)-min(value)>1000 as conflict from v group by 1,2),
cu as (select *, not conflict and abs(offset_ms)<=10000 as usable from cl)
"""


def clip_values(spark, sf_dir):
    value = (F.col("media_id") % 7 - 3) * 700 + F.col("event_id") * 37 % 1200 - 600 + F.when(F.col("event_id") % 29 == 0, 3000).otherwise(0)
    return speech(spark, sf_dir).select(
        "media_id", F.floor(F.col("start_ms") / 400_000).alias("clip_ix"), value.cast("long").alias("value"))


@query("d13_clip_offsets", "speech", _CLIP_SQL + "select media_id, clip_ix, offset_ms, n, conflict, usable from cu")
def clip_offsets(spark, sf_dir):
    return of.clip_offsets(clip_values(spark, sf_dir), KEY)


@query("d13_region_offsets", "speech", _CLIP_SQL + """
select media_id, clip_ix//5 as region, median(offset_ms) as offset_ms, count(*) as clips, max(offset_ms)-min(offset_ms)>1000 as conflict from cu where usable group by 1,2""")
def region_offsets(spark, sf_dir):
    clips = of.clip_offsets(clip_values(spark, sf_dir), KEY).withColumn("region", F.floor(F.col("clip_ix") / 5))
    return of.region_offsets(clips, KEY)


@query("d11_robust_summary", "speech", """
v as (select media_id, start_ms as at_ms, event_id*37%1200-600 as value, max(end_ms) over (partition by media_id) as len from speech),
c as (select media_id, median(value) as median, count(*) as n from v group by 1),
s as (select v.media_id, any_value(c.median) as median, median(abs(value-c.median)) as mad, count(*) as n, min(value) as low, max(value) as high, count(distinct least(2,greatest(0,floor(at_ms*3.0::double/len)))) as thirds from v join c on c.media_id=v.media_id group by 1),
g as (select media_id, max(at_ms-p) as widest_gap from (select media_id, at_ms, lag(at_ms) over (partition by media_id order by at_ms, value) as p from v) group by 1),
i as (select media_id, value, row_number() over (partition by media_id order by value) as i from v),
x as (select a.media_id, a.i, median(b.value) as m from i a join i b on a.media_id=b.media_id and a.i<>b.i group by 1,2),
l as (select x.media_id, max(abs(m-c.median)) as loo_shift from x join c on c.media_id=x.media_id group by 1)
select s.media_id, n, s.median, mad, low, high, thirds, widest_gap, loo_shift from s join g on g.media_id=s.media_id left join l on l.media_id=s.media_id""")
def robust_summary(spark, sf_dir):
    rows = speech(spark, sf_dir)
    values = rows.join(_durations(spark, sf_dir), "media_id").select(
        "media_id", F.col("start_ms").alias("at_ms"), (F.col("event_id") * 37 % 1200 - 600).alias("value"), "duration_ms")
    return of.robust_summary(values, KEY, "value", "at_ms", "duration_ms")
