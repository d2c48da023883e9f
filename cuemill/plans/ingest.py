"""Queries: subtitle text, headers, provider results, entities, packets, manifests, pages.

The landed documents are built by Spark from the given tables, then read back by the source under test.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cuemill.functions.timecode import format_ms
from cuemill.plans.catalogue import _claims
from cuemill.plans.registry import query
from cuemill.session import ensure_checkpoint_dir
from cuemill.sources import headers as hd
from cuemill.sources.subtitles import parse_subtitles
from cuemill.sources.tables import candidate, documents, load, media, shifted_cue, speech, track


def subtitle_files(spark, sf_dir):
    """One subtitle text per document: SRT, WebVTT or ASS by document number."""
    # Markup signs are taken out of the text, so that only the markup planted here is markup.
    docs = documents(spark, sf_dir).select("doc_id", F.split(F.translate("text", "<>{}\\", ""), "\n").alias("l"))
    start = lambda i: (i * 2_000).cast("long")
    srt = F.transform("l", lambda s, i: F.concat((i + 1).cast("string"), F.lit("\n"), format_ms(start(i)), F.lit(" --> "), format_ms(start(i) + 1_500), F.lit("\n<i>"), s, F.lit("</i>")))
    vtt = F.transform("l", lambda s, i: F.concat(F.replace(format_ms(start(i)), F.lit(","), F.lit(".")), F.lit(" --> "), F.replace(format_ms(start(i) + 1_500), F.lit(","), F.lit(".")), F.lit("\n"), s))
    ass = F.transform("l", lambda s, i: F.concat(F.lit("Dialogue: 0,"), F.replace(format_ms(start(i)), F.lit(","), F.lit(".")), F.lit(","), F.replace(format_ms(start(i) + 1_500), F.lit(","), F.lit(".")), F.lit(r",{\i1}"), s))
    kind = F.col("doc_id") % 3
    text = F.when(kind == 0, F.array_join(srt, "\r\n\r\n")).when(kind == 1, F.concat(F.lit("WEBVTT\n\n"), F.array_join(vtt, "\n\n"))).otherwise(
        F.concat(F.lit("[Script Info]\nTitle: x\n[Events]\nFormat: Layer, Start, End, Text\n"), F.array_join(ass, "\n")))
    return docs.select(F.col("doc_id").alias("track_id"), F.when(kind == 0, "srt").when(kind == 1, "vtt").otherwise("ass").alias("format"), text.alias("text"))


@query("a1_parse_subtitles", "", r"""
d as (select doc_id, string_split(translate(text,'<>{}\',''),chr(10)) as l from documents),
c as (select doc_id as track_id, unnest(range(0,len(l))) as i, unnest(l) as s from d)
select track_id, i*2000 as start_ms, i*2000+1500 as end_ms, trim(regexp_replace(s,'\s+',' ','g')) as text from c""")
def parse_subtitle_files(spark, sf_dir):
    return parse_subtitles(subtitle_files(spark, sf_dir))[0].select("track_id", "start_ms", "end_ms", "text")


@query("a2_explode_tracks", "track", """
select media_id, track_id, type, codec, language, name, is_default, is_forced, codec='SubRip/SRT' as text_subtitle, case when frames%7=0 then null else frames end as frames, floor(span_s) as span_s from track""")
def explode_tracks(spark, sf_dir):
    span = F.floor("span_s").cast("long")
    clock = F.format_string("%02d:%02d:%02d.000000000", F.floor(span / 3600), F.floor(span % 3600 / 60), span % 60)
    item = F.struct(
        F.col("track_id").alias("id"), "type", "codec", F.struct(
            F.when(F.col("track_id") % 2 == 0, F.col("language")).alias("language_ietf"), F.col("language"), F.col("name").alias("track_name"), F.col("is_default").alias("default_track"),
            F.col("is_forced").alias("forced_track"), F.when(F.col("frames") % 7 == 0, "-1").otherwise(F.col("frames").cast("string")).alias("tag_number_of_frames"), clock.alias("tag_duration")).alias("properties"))
    docs = track(spark, sf_dir).groupBy("media_id").agg(F.to_json(F.struct(F.collect_list(item).alias("tracks"))).alias("json"))
    return hd.explode_tracks(docs).select(
        "media_id", F.col("track_id").cast("int").alias("track_id"), "type", "codec", "language", "name", "is_default", "is_forced", "text_subtitle", "frames", "span_s")


@query("a3_read_candidates", "candidate", """
a as (select file_id%50 as media_id, 'a' as provider, cast(file_id//100*100 as varchar) as file_id, '' as url, arg_max(release, file_id) as release, arg_max(author, file_id) as author, max(file_id)%9>=99 as trusted from candidate where provider='a' group by 1,2,3,4),
b as (select file_id%50 as media_id, 'b' as provider, 'n'||file_id as file_id, 'http://s/'||file_id||'.zip' as url, release, author, file_id>=1000 as trusted from candidate where provider='b')
select * from a union all select * from b""")
def read_candidates(spark, sf_dir):
    rows = candidate(spark, sf_dir).withColumn("media_id", F.col("file_id") % 50)
    a_item = F.struct(F.col("file_id").alias("k"), F.struct(F.struct(
        "release", F.struct(F.col("author").alias("name")).alias("uploader"), F.array(F.struct((F.floor(F.col("file_id") / 100) * 100).alias("file_id"), F.concat("release", F.lit(".srt")).alias("file_name"))).alias("files")).alias("attributes")).alias("v"))
    json_a = rows.filter("provider = 'a'").groupBy("media_id").agg(F.array_sort(F.collect_list(a_item)).alias("x")).select(
        "media_id", F.to_json(F.struct(F.transform("x", lambda i: i["v"]).alias("data"))).alias("json"))
    child = F.struct(F.concat(F.lit("n"), "file_id").alias("n_id"), F.concat(F.lit("http://s/"), "file_id", F.lit(".zip")).alias("url"), F.col("release").alias("release_name"))
    b_item = F.struct(F.col("author"), F.col("file_id").alias("download_count"), F.array(child).alias("unpack_files"))
    json_b = rows.filter("provider = 'b'").groupBy("media_id").agg(F.to_json(F.struct(F.collect_list(b_item).alias("subtitles"))).alias("json"))
    return hd.read_candidates(json_a, json_b).select("media_id", "provider", "file_id", "url", "release", "author", "trusted")


@query("a4_explode_claims", "", """
select l_orderkey as entity, case l_linenumber%5 when 0 then 'imdb' when 1 then 'tmdb' when 2 then 'year' when 3 then 'type' else 'runtime' end as property, case when l_returnflag='R' and l_suppkey%7=0 then 'deprecated' else 'normal' end as rank,
 case when l_linenumber%5=4 and l_partkey%23=0 then 'version' end as qualifier, count(*) as n from lineitem group by 1,2,3,4""")
def explode_claims(spark, sf_dir):
    claim = F.struct("rank", "value", "unit", "precision", F.when(F.col("qualifier").isNotNull(), F.create_map("qualifier", F.array(F.lit("x")))).alias("qualifiers"))
    listed = _claims(spark, sf_dir).groupBy("entity", "property").agg(F.collect_list(claim).alias("c"))
    docs = listed.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("property", "c"))).alias("claims")).select(
        F.to_json(F.struct(F.col("entity").cast("string").alias("id"), "claims")).alias("json"))
    return hd.explode_claims(docs).groupBy(F.col("entity").cast("long").alias("entity"), "property", "rank", "qualifier").agg(F.count(F.lit(1)).alias("n"))


@query("a5_read_packets", "speech shifted_cue", """
r as (select media_id, start_ms, end_ms+20000 as end_ms from shifted_cue where event_id%3=0)
select distinct s.media_id, event_id%2 as stream_index, s.start_ms as pts_ms, event_id%200 as size from speech s where exists (select 1 from r where r.media_id=s.media_id and s.start_ms>=r.start_ms and s.start_ms<r.end_ms)""")
def read_packets(spark, sf_dir):
    packet = F.struct((F.col("event_id") % 2).alias("stream_index"), F.format_string("%.3f", F.col("start_ms") / 1_000).alias("pts_time"), (F.col("event_id") % 200).cast("string").alias("size"))
    twice = speech(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    docs = twice.groupBy("media_id").agg(F.to_json(F.struct(F.collect_list(packet).alias("packets"))).alias("json"))
    ranges = shifted_cue(spark, sf_dir).filter("event_id % 3 = 0").select("media_id", "start_ms", (F.col("end_ms") + 20_000).alias("end_ms"))
    return hd.read_packets(docs, ranges).select("media_id", "stream_index", "pts_ms", "size")


@query("a6_page_works", "", r"""
select page_id, trim(regexp_replace(regexp_extract(html,'(?is)<title[^>]*>(.*?)</title>',1),'\s+',' ','g')) as page_title, 'no_movie_record' as reject_reason from pages""")
def page_works(spark, sf_dir):
    return hd.read_public_pages(load(spark, sf_dir, "pages")).select("page_id", "page_title", "reject_reason")


@query("a6_public_works", "", r"""
k as (select page_id, page_id%8 as kind, cast(1950+page_id%60 as varchar) as y, trim(regexp_replace(regexp_extract(html,'(?is)<title[^>]*>(.*?)</title>',1),'\s+',' ','g')) as page_title from pages where html is not null),
r as (select *, case kind when 0 then 'no_movie_record' when 2 then 'several_movie_records' when 3 then 'header_year' when 4 then 'year_conflict' when 5 then 'address_conflict' else '' end as reject_reason from k)
select page_id, page_title, reject_reason, case when reject_reason='' then 'Work '||page_id end as title, case when reject_reason='' then y end as year, case when reject_reason='' then 'About '||page_id end as tagline,
 case when reject_reason='' then case kind when 6 then 'First name|Second name' when 7 then 'Other|First name' else '' end end as aliases from r""")
def public_works(spark, sf_dir):
    """The given pages with records, header years, addresses and names put in, eight kinds of them."""
    n, kind = F.col("page_id").cast("string"), F.col("page_id") % 8
    year = (F.lit(1950) + F.col("page_id") % 60).cast("string")
    script = lambda type_, more="": F.concat(F.lit('<script type="application/ld+json">{"@type":"' + type_ + '","name":"Work '), n, F.lit('","datePublished":"'), F.when(kind == 4, "1931").otherwise(year), F.lit('-05-01","description":"About '), n, F.lit('"' + more + "}</script>"))
    address = lambda own, other: F.lit(f'<link rel="canonical" href="/w/{own}"><meta property="og:url" content="/w/{other}">')
    names = F.lit('<table class="x aliases"><tr><td><b>First</b> name</td><td>de</td></tr><tr><td>Second\n name</td></tr></table>')
    put = F.when(kind == 0, F.lit("")).when(kind == 2, F.concat(script("Movie"), script("Movie"))).when(kind == 5, F.concat(script("Movie"), address("a", "b"))).when(
        kind == 6, F.concat(address("a", "a"), script("Movie"), names)).when(
        kind == 7, F.concat(script("Person"), script("Movie", ',"alternateName":["Other","First name"]'), F.lit("<table class='aliases'><tr><td>First name</td></tr></table>"))).otherwise(script("Movie"))
    head = F.regexp_replace("html", "</head>", "\u0001</head>")
    html = F.replace(F.replace(head, F.lit("\u0001"), put), F.lit("</h1>"), F.when(kind == 3, "</h1>").otherwise(F.concat(F.lit(" ("), year, F.lit(")</h1>"))))
    found = hd.read_public_pages(load(spark, sf_dir, "pages").filter("html is not null").select("page_id", html.alias("html")))
    return found.select("page_id", "page_title", "reject_reason", "title", "year", "tagline", F.array_join("aliases", "|").alias("aliases"))


@query("a7_incremental_manifest", "media", """
select 'm/'||media_id||'.mkv' as path, cast(floor(duration_s*1000) as bigint) as size, media_id*10 as mtime_ns from media where media_id%5 in (0,1)""")
def incremental_manifest(spark, sf_dir):
    files = media(spark, sf_dir).select(
        "media_id", F.concat(F.lit("m/"), "media_id", F.lit(".mkv")).alias("path"), F.floor(F.col("duration_s") * 1_000).alias("size"), (F.col("media_id") * 10).alias("mtime_ns"))
    k = F.col("media_id") % 5
    known = files.filter(k != 0).withColumn("size", F.when(k == 1, F.col("size") + 1).otherwise(F.col("size")))
    return hd.incremental_manifest(files.drop("media_id"), known)


@query("a7_manifest_runs", "media", """
f as (select media_id, 'm/'||media_id||'.mkv' as path, cast(floor(duration_s*1000) as bigint) as size, media_id*10 as mtime_ns from media)
select 1 as run, path, size, mtime_ns from f where media_id%3=0 union all select 2, path, size+case when media_id%5=0 then 1 else 0 end, mtime_ns from f where media_id%3>0 or media_id%5=0
union all select 3, path, size, mtime_ns from f where media_id%5=0""")
def manifest_runs(spark, sf_dir):
    """What three listings leave to analyse, each recorded before the next: a third of the files; all, of which some
    changed; all again, with those changed back."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/manifest-{uuid.uuid4().hex}"
    m = F.col("media_id")
    files = media(spark, sf_dir).select("media_id", F.concat(F.lit("m/"), "media_id", F.lit(".mkv")).alias("path"), F.floor(F.col("duration_s") * 1_000).alias("size"), (m * 10).alias("mtime_ns"))
    listings = [files.filter(m % 3 == 0), files.withColumn("size", F.col("size") + F.when(m % 5 == 0, 1).otherwise(0)), files]
    found = []
    for run, listed in enumerate(listings, 1):
        new = hd.incremental_manifest(listed.drop("media_id"), hd.read_manifest(spark, folder)).checkpoint()
        hd.record_manifest(folder, new, run, buckets=8)
        found.append(new.select(F.lit(run).alias("run"), "path", "size", "mtime_ns"))
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("a11_file_fingerprint")
def file_fingerprint(spark, sf_dir):
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(sf_dir)
    prints = hd.file_fingerprint(listed.select("path", F.col("length").alias("size")))
    return prints.withColumn("path", F.regexp_extract("path", "([^/]+)$", 1))
