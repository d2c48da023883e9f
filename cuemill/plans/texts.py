"""Queries: dialogue features, text matching, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuemill.functions import similarity as sim
from cuemill.functions import text as T
from cuemill.operators import matching as mt
from cuemill.operators.intervals import interval_join
from cuemill.plans.foundations import CLEAN_SQL, KEY_SQL, WORDS_SQL
from cuemill.plans.registry import query
from cuemill.sources.tables import doc_cue, load, shifted_cue, speech

# Marks are planted by cue number so that every rule is met on plain text.
_MARKED = """case cue_ix%7 when 0 then '♪ '||text||' ♪' when 1 then '[door opens] '||text when 2 then 'JOHN: '||text when 3 then text||' (laughs softly)' when 4 then '('||text||' you see)'
 when 5 then '<i>'||text||'</i>' else text||chr(10)||'♪ la la' end"""
MK_SQL = f"mk as (select track_id, cue_ix, start_ms, end_ms, {_MARKED} as text from (select * replace (translate(text, '[]()<>{{}}♪:', '') as text) from doc_cue))"


def _marked(spark, sf_dir):
    rows = doc_cue(spark, sf_dir).withColumn("text", F.translate("text", "[]()<>{}♪:", ""))
    return rows.withColumn("text", F.expr(_MARKED))


@query("b4_dialogue_text", "doc_cue", MK_SQL + r""",
dl as (select track_id, cue_ix, case cue_ix%7 when 0 then '' when 2 then trim(regexp_replace(text,'^JOHN: ','')) when 1 then trim(regexp_replace(text,'^\[door opens\] ','')) when 3 then trim(regexp_replace(text,' \(laughs softly\)$',''))
 when 4 then trim(regexp_replace(text,'[()]','','g')) when 5 then trim(regexp_replace(text,'</?i>','','g')) else trim(string_split(text,chr(10))[1]) end as r from mk)
select track_id, cue_ix, case when regexp_matches(r,'[\p{L}\p{N}]') then r else '' end as dialogue from dl""")
def dialogue_text(spark, sf_dir):
    return _marked(spark, sf_dir).select("track_id", "cue_ix", T.dialogue_text(F.col("text")).alias("dialogue"))


@query("b7_language_detection", "doc_cue", """
w as (select track_id, unnest(regexp_extract_all(lower(text), '[A-Za-zÀ-ÿ]+')) as w from doc_cue),
c as (select d.track_id, count(*) filter (w in ('the','and','you','that','this','what','with','have','not','are','for')) as en, count(*) filter (w in ('que','los','las','una','por','para','con','como','pero','está','del')) as es,
 count(*) filter (w in ('les','des','une','est','pas','pour','avec','dans','mais','vous','que')) as fr, count(*) filter (w in ('der','die','das','und','ist','nicht','mit','für','auf','ich','sie')) as de,
 count(*) filter (w in ('que','uma','não','por','para','com','como','mas','você','está','dos')) as pt from (select distinct track_id from doc_cue) d left join w on w.track_id=d.track_id group by 1),
k as (select track_id, bool_or(regexp_matches(text,'[぀-ヿ]')) as ja, bool_or(regexp_matches(text,'[가-힯]')) as ko, bool_or(regexp_matches(text,'[Ѐ-ӿ]')) as ru, bool_or(regexp_matches(text,'[㐀-鿿]')) as zh from doc_cue group by 1),
m as (select c.*, ja, ko, ru, zh, greatest(en,es,fr,de,pt) as top from c join k on k.track_id=c.track_id)
select track_id, case when ja then 'ja' when ko then 'ko' when ru then 'ru' when zh then 'zh-CN' when top<3 then 'und' when en=top then 'en' when es=top then 'es' when fr=top then 'fr' when de=top then 'de' else 'pt' end as language, top as evidence from m""")
def language_detection(spark, sf_dir):
    return mt.detect_language(doc_cue(spark, sf_dir))


@query("b17_text_validity", "doc_cue", r"""
v as (select track_id, cue_ix, case cue_ix%6 when 0 then '  ' when 1 then text||chr(7) when 2 then text||chr(10)||' '||chr(10)||text when 3 then text||chr(10)||'1:02:03,4 --> 1:02:05,6' else text end as text, trim(text)='' as bare from doc_cue)
select track_id, cue_ix, case when cue_ix%6=0 or (bare and cue_ix%6 in (2,4,5)) then 'empty' when cue_ix%6=1 then 'control' when cue_ix%6=2 then 'blank_line' when cue_ix%6=3 then 'timing_line' else '' end as reason from v""")
def text_validity(spark, sf_dir):
    broken = F.expr(r"""case cue_ix % 6 when 0 then '  ' when 1 then text || chr(7) when 2 then text || chr(10) || ' ' || chr(10) || text
        when 3 then text || chr(10) || '1:02:03,4 --> 1:02:05,6' else text end""")
    return doc_cue(spark, sf_dir).select("track_id", "cue_ix", T.invalid_reason(broken).alias("reason"))


@query("b21_targeted_score", "doc_cue", f"""
w as (select track_id, cue_ix, start_ms, end_ms, text, regexp_extract_all({KEY_SQL}, '[A-Za-z'']{{2,}}') as w, (end_ms-start_ms)/1000 as span from doc_cue),
s as (select *, len(w) as n, len(list_distinct(w)) as u, len(regexp_extract_all(text,'[.!?]')) as p, len(regexp_extract_all(text,'[,;:]')) as c from w)
select track_id, cue_ix, case when n between 7 and 24 and not contains(text,'♪') and not contains(text,'...') and span between 1.0::double and 7.5::double then
 round(least(n,18)*0.30::double+p*1.40::double+c*0.30::double-(n-u)*0.30::double-abs(span-3.5::double)*0.12::double-abs((start_ms+end_ms)/2-30000)/greatest(60000, 90000*0.10::double),6) end as score from s""")
def targeted_score(spark, sf_dir):
    score = T.targeted_score(F.col("text"), F.col("start_ms"), F.col("end_ms"), F.lit(30_000), F.lit(90_000))
    return doc_cue(spark, sf_dir).select("track_id", "cue_ix", F.round(score, 6).alias("score"))


_BI = "case when doc_id%3=0 then text||chr(10)||'这是一个双语字幕样例' else text end"


@query("b22_variant_keys", "", f"""
c as (select conv_id, turn, {_BI.replace('doc_id', 'conv_id')} as t from conversations),
p as (select conv_id, turn, t as text from c union select conv_id, turn, unnest(string_split(t,chr(10))) from c),
k as (select conv_id, turn, {KEY_SQL} as clean from p),
r as (select conv_id, turn, unnest(regexp_extract_all(clean, '[a-z0-9'']+(?:\\s+[a-z0-9'']+)*')) as run from k)
select conv_id, turn, clean as key from k where length(clean)>=12 union select conv_id, turn, run from r where length(run)>=12 and len(string_split(run,' '))>=3
 union select conv_id, turn, regexp_replace(clean,'[^㐀-鿿぀-ヿ가-힯]','','g') from k where length(regexp_replace(clean,'[^㐀-鿿぀-ヿ가-힯]','','g'))>=6""")
def variant_keys(spark, sf_dir):
    text = F.expr(_BI.replace("doc_id", "conv_id"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(T.variant_keys(text)).alias("key")).distinct()


@query("b23_fine_cues", "doc_cue", f"""
w as (select track_id, cue_ix, end_ms-start_ms as d, regexp_replace(text,'<[^>]+>|\\{{\\\\[^}}]*\\}}',' ','g') as raw, {WORDS_SQL.format(CLEAN_SQL)} as w from doc_cue)
select track_id, cue_ix, array_to_string(w,' ') as words from w where not regexp_matches(raw,'[♪♫\\[\\]()]') and len(w) between 4 and 14 and d between 600 and 6000 and len(regexp_extract_all(raw,'[.!?]'))<=1""")
def fine_cues(spark, sf_dir):
    return doc_cue(spark, sf_dir).select("track_id", "cue_ix", T.fine_cue(F.col("text"), F.col("start_ms"), F.col("end_ms")).alias("words")).filter("words is not null")


@query("b24_meaningful_lines", "doc_cue", """
w as (select track_id, cue_ix, text, regexp_extract_all(text,'[A-Za-zÀ-ÿ]{2,}') as w, len(regexp_extract_all(text,'[㐀-鿿぀-ヿ가-힯]')) as c from doc_cue)
select track_id, cue_ix, c>=3 or (len(w)>=3 and length(array_to_string(w,''))>=8) as meaningful, lower(regexp_replace(text,'[^0-9A-Za-z㐀-鿿]+','','g')) as key from w""")
def meaningful_lines(spark, sf_dir):
    return doc_cue(spark, sf_dir).select("track_id", "cue_ix", T.meaningful_line(F.col("text")).alias("meaningful"), T.evidence_key(F.col("text")).alias("key"))


@query("b25_hard_breaks", "", r"""
l as (select conv_id, turn, string_split(text,chr(10)) as a from conversations),
s as (select conv_id, turn, a, 1 as i, a[1] as cur, a[1] as out from l union all
 select conv_id, turn, a, i+1, case when k then a[i+1] else cur||g||a[i+1] end, case when k then out||chr(10)||a[i+1] else out||g||a[i+1] end from (
  select *, trim(cur)='' or trim(a[i+1])='' or regexp_matches(trim(cur),'^(?:[-–—>]|[\[(（【]|[\p{L}\p{N}][^:：\n]{0,31}[:：])') or regexp_matches(trim(a[i+1]),'^(?:[-–—>]|[\[(（【]|[\p{L}\p{N}][^:：\n]{0,31}[:：])')
   or regexp_matches(trim(cur)||trim(a[i+1]),'[♩♪♫♬]') or regexp_matches(trim(cur),'[.!?。！？:：;；…\-]["”’'']?$') or len(list_filter(regexp_extract_all(trim(cur)||trim(a[i+1]),'\p{L}'), lambda c: not regexp_matches(c,'[\p{Latin}\p{Han}]')))>0 as k,
   case when regexp_matches(cur,'\s$') or regexp_matches(a[i+1],'^\s') then '' else ' ' end as g from s where i<len(a)))
select conv_id, turn, out as joined from s where i=len(a)""")
def hard_breaks(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", T.join_hard_breaks(F.col("text")).alias("joined"))


@query("b26_numbered_response", "doc_cue", """
l as (select track_id, row_number() over (partition by track_id order by cue_ix) as i, 'x '||trim(text) as t from doc_cue where length(trim(text))>0),
r as (select track_id, string_agg(t, '|' order by i) as joined, count(*) as n from l group by 1)
select track_id, case when track_id%4 in (0,1) or (track_id%4=2 and n=1) then joined end as lines from r""")
def numbered_response(spark, sf_dir):
    # Answers are built from the lines of a document: numbered, plain, all with the same number, one line short.
    kept = doc_cue(spark, sf_dir).filter(F.length(F.trim("text")) > 0).withColumn("t", F.concat(F.lit("x "), F.trim("text")))
    t = kept.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("cue_ix", "t"))).alias("c"), F.count(F.lit(1)).cast("int").alias("n"))
    k = F.col("track_id") % 4
    lines = F.transform("c", lambda x, i: F.when(k == 0, F.concat((i + 1).cast("string"), F.lit(". "), x["t"])).when(
        k == 2, F.concat(F.lit("1) "), x["t"])).otherwise(x["t"]))
    parsed = T.numbered_response(F.array_join(lines, "\n"), F.when(k == 3, F.col("n") + 1).otherwise(F.col("n")))
    return t.select("track_id", F.array_join(parsed, "|").alias("lines"))


_C2_SQL = f"""
wd as (select cast(track_id*100000+cue_ix as bigint) as window_id, text from doc_cue),
wt as materialized (select distinct window_id, unnest({WORDS_SQL.format(CLEAN_SQL)}) as word from wd),
pt as materialized (select distinct item_id as probe_id, unnest({WORDS_SQL.format(CLEAN_SQL)}) as word from benchmark),
df as (select word, count(*) as df from wt group by 1),
rk as (select probe_id, pt.word, row_number() over (partition by probe_id order by df, pt.word) as rank from pt join df on df.word=pt.word),
mt as (select probe_id, window_id, min(rank) as rank from rk join wt on wt.word=rk.word where rank<=16 group by 1,2),
fn as (select probe_id, count(*) filter (rank<=8) as found from mt group by 1),
sl as materialized (select mt.probe_id, window_id from mt join fn on fn.probe_id=mt.probe_id where rank<=8 or found<12)"""


def _windows(spark, sf_dir):
    return doc_cue(spark, sf_dir).select((F.col("track_id") * 100_000 + F.col("cue_ix")).alias("window_id"), "track_id", "start_ms", "end_ms", "text")


def _probes(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("probe_id"), "text")


def _shortlist(spark, sf_dir):
    return mt.shortlist(_probes(spark, sf_dir), _windows(spark, sf_dir).select("window_id", "text"))


@query("c2_rare_word_shortlist", "doc_cue", _C2_SQL + "select probe_id, window_id from sl")
def rare_word_shortlist(spark, sf_dir):
    return _shortlist(spark, sf_dir)


def _paired(spark, sf_dir, made):
    """Shortlisted pairs with what is made of the probe's text (`a`) and the window's (`b`), once for each text."""
    probes = _probes(spark, sf_dir).select("probe_id", made(F.col("text")).alias("a"))
    windows = mt.by_window(_shortlist(spark, sf_dir), _windows(spark, sf_dir).select("window_id", "text"))
    texts = windows.select("window_id", "probe_ids", made(F.col("text")).alias("b"))
    return texts.select("window_id", "b", F.explode("probe_ids").alias("probe_id")).join(probes, "probe_id")


_F1_SQL = _C2_SQL + f""",
pw as materialized (select probe_id, word, count(*) as n from (select item_id as probe_id, unnest({WORDS_SQL.format(CLEAN_SQL)}) as word from benchmark) group by 1,2),
ww as materialized (select window_id, word, count(*) as n from (select window_id, unnest({WORDS_SQL.format(CLEAN_SQL)}) as word from wd) group by 1,2),
cm as (select sl.probe_id, sl.window_id, sum(least(pw.n, ww.n)) as common from sl join pw on pw.probe_id=sl.probe_id join ww on ww.window_id=sl.window_id and ww.word=pw.word group by 1,2),
f1 as materialized (select cm.probe_id, cm.window_id, round(2*common/(a.n+b.n),6) as score from cm join (select probe_id, sum(n) as n from pw group by 1) a on a.probe_id=cm.probe_id join (select window_id, sum(n) as n from ww group by 1) b on b.window_id=cm.window_id)"""


@query("u1_bag_f1", "doc_cue", _F1_SQL + "select probe_id, window_id, score from f1")
def bag_f1(spark, sf_dir):
    windows = _windows(spark, sf_dir).select("window_id", "text")
    return mt.bag_scores(_shortlist(spark, sf_dir), _probes(spark, sf_dir), windows).withColumn("score", F.round("score", 6))


@query("u1_dialogue_score")
def dialogue_score(spark, sf_dir):
    scored = _paired(spark, sf_dir, T.clean_dialogue).withColumn("s", sim.text_scores("a", "b"))
    return scored.select("probe_id", "window_id", F.round("s.dialogue", 6).alias("dialogue"), F.round("s.semantic", 6).alias("semantic"))


@query("u1_bigram_f1", "doc_cue", _C2_SQL + f"""
,pk as (select item_id as probe_id, {KEY_SQL} as a from benchmark), wk as (select window_id, {KEY_SQL} as b from wd),
pb as (select probe_id, list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) as x from pk), wb as (select window_id, list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) as y from wk)
select sl.probe_id, sl.window_id, round(2*len(list_intersect(x,y))/(len(x)+len(y)),6) as score from sl join pb on pb.probe_id=sl.probe_id join wb on wb.window_id=sl.window_id""")
def bigram_f1(spark, sf_dir):
    # Pairs of letters are made of a window where it has met its probes, as they are many times as large as the text.
    met = _paired(spark, sf_dir, lambda text: T.bigrams(T.clean_dialogue_key(text)))
    return met.select("probe_id", "window_id", F.round(T.set_f1(F.col("a"), F.col("b")), 6).alias("score"))


@query("e9_anchor_ranking", "doc_cue", _F1_SQL + """,
sc as (select probe_id, track_id as axis, (start_ms+end_ms)//2 as place_ms, max(least(1.0::double, score*2.5::double)) as score from f1 join doc_cue on track_id*100000+cue_ix=window_id group by 1,2,3),
rk9 as (select *, row_number() over (partition by probe_id order by score desc, axis, place_ms) as r, max(score) over (partition by probe_id) as best, lead(score) over (partition by probe_id order by score desc, axis, place_ms) as nxt from sc where score>=0.5::double),
od as (select probe_id, list({'a':axis,'p':place_ms,'s':score} order by r) as l, any_value(best) as best from rk9 group by 1),
st as (select probe_id, l, best, 1 as i, [l[1]] as acc from od union all
 select probe_id, l, best, i+1, case when len(acc)<6 and l[i+1].s>=best-0.20::double and len(list_filter(acc, lambda y: y.a=l[i+1].a and abs(y.p-l[i+1].p)<400))=0 then list_append(acc, l[i+1]) else acc end from st where i<len(l) and len(acc)<6 and l[i+1].s>=best-0.20::double),
fi as (select probe_id, arg_max(acc, i) as acc from st group by 1),
ch as (select probe_id, unnest(range(1,len(acc)+1)) as place, unnest(acc) as x from fi),
rv as (select ch.probe_id, place, max(sc.score) as rival from ch join sc on sc.probe_id=ch.probe_id and (sc.axis<>x.a or abs(sc.place_ms-x.p)>=15000) group by 1,2)
select ch.probe_id, cast(ch.place as int) as place, x.a as axis, x.p as place_ms, x.s as score, round(case when ch.place=1 then greatest(0.0::double, x.s-coalesce((select nxt from rk9 where rk9.probe_id=ch.probe_id and r=1),0)) else 0.0::double end,6) as margin,
 round(greatest(0.0::double, x.s-coalesce(rival,0)),6) as distinct_margin from ch left join rv on rv.probe_id=ch.probe_id and rv.place=ch.place""")
def anchor_ranking(spark, sf_dir):
    # The bag score of one cue against a long probe is low by construction; it is scaled to use the ranking rules.
    scored = bag_f1(spark, sf_dir).withColumn("score", F.least(F.lit(1.0), F.col("score") * 2.5)).join(
        _windows(spark, sf_dir).drop("text"), "window_id")
    places = scored.select("probe_id", F.col("track_id").alias("axis"), F.floor((F.col("start_ms") + F.col("end_ms")) / 2).alias("place_ms"), "score")
    return mt.rank_anchors(places, ["probe_id"]).select(
        "probe_id", "place", "axis", "place_ms", "score", F.round("margin", 6).alias("margin"), F.round("distinct_margin", 6).alias("distinct_margin"))


@query("c13_common_subsequence")
def common_subsequence(spark, sf_dir):
    generic = F.array(*[F.lit(w) for w in T.GENERIC_WORDS])
    rows = _paired(spark, sf_dir, lambda text: F.filter(T.clause_tokens(text), lambda w: ~F.array_contains(generic, w)))
    found = rows.filter((F.size("a") > 0) & (F.size("b") > 0)).withColumn("e", sim.common_subsequence("a", "b")).filter("e.matched > 0")
    return found.select(
        "probe_id", "window_id", "e.matched", "e.longest", "e.gaps", F.round(F.col("e.matched") / F.size("a"), 6).alias("probe_coverage"),
        F.round(F.col("e.matched") / F.size("b"), 6).alias("window_coverage"))


@query("c7_temporal_corroboration")
def temporal_corroboration(spark, sf_dir):
    heard = speech(spark, sf_dir).select(
        "media_id", F.floor(F.col("start_ms") / 400_000).alias("clip_ix"), ((F.col("start_ms") + F.col("end_ms")) / 2).alias("movie_ms"), "start_ms", "end_ms",
        F.concat_ws(" ", F.lit("line number"), "event_id", F.lit("spoken"), "event_type").alias("heard"))
    cues = shifted_cue(spark, sf_dir).select("media_id", F.col("start_ms").alias("cs"), F.col("end_ms").alias("ce"), "text")
    pairs = interval_join(heard, cues, ["media_id"], ("start_ms", "end_ms"), ("cs", "ce"), slack=10_000)
    clean = lambda c: T.clean_dialogue(F.col(c), unicode=False)
    scored = pairs.select("media_id", "clip_ix", "movie_ms", (F.col("movie_ms") - (F.col("cs") + F.col("ce")) / 2).alias("offset_ms"),
                          sim.dialogue_score(clean("text"), clean("heard")).alias("similarity"))
    films = speech(spark, sf_dir).groupBy("media_id").agg(F.max("end_ms").alias("duration_ms"))
    return mt.corroborate(scored, films, ["media_id"])


_D5 = {"fr": "avec dans elle est mais nous pas pour que une vous", "de": "aber das der die ein eine ich ist nicht und wir", "es": "como con ella esta los para pero por que una",
       "it": "che con della non per sono una", "pt": "com ela não para por que uma"}
_IN = {k: "('" + "','".join(v.split()) + "')" for k, v in _D5.items()}


@query("d5_content_conflict", "doc_cue", f"""
n as (select track_id, count(*) as n, count(*) filter (regexp_matches(text,'�|锟斤拷|脡|脿|â€')) as mk, sum(len(regexp_extract_all(text,'[ÃÂ]'))) as lm,
 sum(len(regexp_extract_all(text,'[㐀-鿿぀-ヿ가-힯Ѐ-ӿ]'))) as os, bool_or(regexp_matches(lower(text),'\\b(?:audio|director(?:''s)?|filmmaker) commentary\\b|\\bwelcome to (?:the|this) commentary\\b') or (regexp_matches(lower(text),'\\b(?:my name is|i am|i''m)\\b') and regexp_matches(lower(text),'\\bwriter\\b')::int+regexp_matches(lower(text),'\\bdirector\\b')::int+regexp_matches(lower(text),'\\bproducer\\b')::int+regexp_matches(lower(text),'\\bexecutive producer\\b')::int>=2)) as o from doc_cue group by 1),
w as (select track_id, unnest(regexp_extract_all(lower(text),'[A-Za-zÀ-ÿ]+')) as w from doc_cue),
c as (select n.track_id, count(w) as letters, count(*) filter (w in ('the','and','you','that','this','what','with','have','not','are','for','your','was','but','they','his','her','she','he','we','to','of','in','is','it','on','be','as','at','do','my','there','here','know','get','go','come','will','would','could','should')) as english,
 {",".join(f"count(*) filter (w in {v}) as s_{k}, count(distinct case when w in {v} then w end) as k_{k}" for k, v in _IN.items())} from n left join w on w.track_id=n.track_id group by 1),
t as (select c.*, n, mk, lm, os, o, list_sort([{",".join(f"{{'s':s_{k},'k':k_{k}}}" for k in _IN)}])[-1] as top from c join n on n.track_id=c.track_id)
select track_id, n as cues, english, top.s as foreign, case when n<20 then '' when o then 'commentary' when mk>0 or lm>=3 then 'mojibake'
 when os>=greatest(12, letters//20) then 'foreign_script' when top.s>=greatest(18, floor(english*0.18::double)) and top.k>=3 then 'foreign_language' else '' end as reason from t""")
def content_conflict(spark, sf_dir):
    return mt.content_conflict(doc_cue(spark, sf_dir))


@query("d26_glyph_gaps", "", r"""
u as (select distinct unnest(string_split(text,'')) as char from documents),
f as (select distinct unnest(string_split(text,'')) as char from documents where lang='en'), b1 as (select distinct unnest(string_split(text,'')) as char from documents where lang='de'), b2 as (select distinct unnest(string_split(text,'')) as char from documents where lang='fr')
select char, case when char in (select char from b1) then 'second' when char in (select char from b2) then 'third' end as font_id from u where char<>'' and not regexp_matches(char,'[\s\p{Cc}\p{Cf}]') and char not in (select char from f)""")
def glyph_gaps(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("lang", "text")
    chars = lambda lang: docs.filter(F.col("lang") == lang).select(F.explode(F.array_distinct(F.split("text", ""))).alias("char")).distinct()
    fallbacks = chars("de").select(F.lit("second").alias("font_id"), F.lit(1).alias("rank"), "char").unionByName(
        chars("fr").select(F.lit("third").alias("font_id"), F.lit(2).alias("rank"), "char"))
    return mt.glyph_gaps(docs.select("text"), chars("en"), fallbacks)


_EVID_SQL = """
ev as (select track_id, cue_ix%5 as position, start_ms as at_ms, text, cue_ix%3<>0 as stable, lower(regexp_replace(text,'[^0-9A-Za-z㐀-鿿]+','','g')) as key from doc_cue),
pr as (select a.track_id, bool_or(a.key<>b.key and (abs(a.at_ms-b.at_ms)>=12000 or (a.position=b.position and abs(a.at_ms-b.at_ms) between 1500 and 6000 and a.stable and b.stable))) as ind from ev a join ev b on b.track_id=a.track_id where a.key<>'' and b.key<>'' group by 1),
nt as (select track_id, count(distinct key) as texts from ev where key<>'' group by 1)"""


@query("d30_independent_evidence", "doc_cue", _EVID_SQL + "select nt.track_id, texts, ind as independent from nt join pr on pr.track_id=nt.track_id")
def independent_evidence(spark, sf_dir):
    rows = doc_cue(spark, sf_dir).select(
        "track_id", (F.col("cue_ix") % 5).alias("position"), F.col("start_ms").alias("at_ms"), "text", (F.col("cue_ix") % 3 != 0).alias("stable"))
    return mt.independent_evidence(rows, ["track_id"])


@query("d36_burn_in_verdict", "doc_cue", _EVID_SQL + """,
po as (select track_id, count(*) filter (cue_ix%9<>0) as valid, bool_or(cue_ix%41=0) as unresolved from doc_cue group by 1), er as (select track_id, count(*) as n from ev group by 1)
select po.track_id, valid, case when coalesce(ind,false) then 'detected' when coalesce(n,0)>0 or unresolved or valid<12 then 'uncertain' else 'not_detected' end as status from po left join pr on pr.track_id=po.track_id left join er on er.track_id=po.track_id""")
def burn_in_verdict(spark, sf_dir):
    cues = doc_cue(spark, sf_dir)
    positions = cues.select("track_id", (F.col("cue_ix") % 9 != 0).alias("valid"), (F.col("cue_ix") % 41 == 0).alias("unresolved"))
    evidence = cues.select(
        "track_id", (F.col("cue_ix") % 5).alias("position"), F.col("start_ms").alias("at_ms"), "text", (F.col("cue_ix") % 3 != 0).alias("stable"))
    return mt.burn_in_verdict(positions, evidence, ["track_id"])


@query("d31_sampling_verdict", "speech", """
s as (select media_id, start_ms//900000 as clip, event_id as ix, case when event_id%5=0 then null else 0.40::double+(event_id*17%60)/100 end as score from speech),
a as (select media_id, clip, count(*)+media_id%4 as planned, count(score) as valid, count(*) filter (score>=0.50::double) as passed, avg(score) as mean, coalesce(sum(score),0) as total, count(*) as tried from s group by 1,2),
h as (select media_id, clip, count(*) as hn, min(score) as hm, avg(score) as ha from (select *, row_number() over (partition by media_id, clip order by ix) as r from s where score is not null) where r<=2 group by 1,2)
select a.media_id, a.clip, valid, passed, coalesce(valid>=greatest(3,ceil(planned*0.5::double)) and passed>=greatest(2,ceil(valid*0.75::double)) and round(mean,9)>=0.55::double,false) as accepted, coalesce(hn>=2 and hm>=0.60::double and round(ha,9)>=0.65::double,false) as fast,
 len(list_filter(range(0, planned-tried+1), lambda k: valid+k>=greatest(3,ceil(planned*0.5::double)) and passed+k>=greatest(2,ceil((valid+k)*0.75::double)) and round((total+k)/(valid+k),9)>=0.55::double))>0 as possible from a left join h on h.media_id=a.media_id and h.clip=a.clip""")
def sampling_verdict(spark, sf_dir):
    e = F.col("event_id")
    rows = speech(spark, sf_dir).select(
        "media_id", F.floor(F.col("start_ms") / 900_000).alias("clip"), e.alias("ix"), F.when(e % 5 != 0, 0.40 + e * 17 % 60 / 100).alias("score"))
    planned = rows.groupBy("media_id", "clip").agg((F.count(F.lit(1)) + F.first(F.col("media_id") % 4)).alias("planned"))
    return mt.sampling_verdict(rows.join(planned, ["media_id", "clip"]), ["media_id", "clip"])
