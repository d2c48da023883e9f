"""Landed JSON and file listings: track headers, provider results, catalogue entities, packets, pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions.text import collapse
from cuemill.operators.intervals import interval_join, merge_intervals
from cuemill.streaming.progress import current_log, merge_log

TRACK_JSON = """tracks array<struct<id:bigint,type:string,codec:string,properties:struct<language_ietf:string,language:string,track_name:string,
 default_track:boolean,forced_track:boolean,text_subtitles:boolean,codec_id:string,tag_number_of_frames:string,tag_duration:string,
 tag_number_of_bytes:string,flag_commentary:boolean,flag_visual_impaired:boolean,flag_original:boolean,audio_channels:string>>>"""


def _count(text: Column) -> Column:
    value = text.try_cast("bigint")
    return F.when(value >= 0, value)


def explode_tracks(media_json: DataFrame, key: str = "media_id", text: str = "json") -> DataFrame:
    """Header JSON to one row per track; unreadable or negative statistics are null."""
    rows = media_json.select(key, F.explode(F.from_json(text, TRACK_JSON)["tracks"]).alias("t")).select(key, "t.*")
    p = F.col("properties")
    codecs = F.lower(F.concat_ws(" ", F.col("codec"), p["codec_id"]))
    clock = r"^(\d+):(\d+):(\d+)(?:\.(\d+))?$"
    span = F.when(F.trim(p["tag_duration"]).rlike(clock), F.regexp_extract(F.trim(p["tag_duration"]), clock, 1).cast("bigint") * 3600
                  + F.regexp_extract(F.trim(p["tag_duration"]), clock, 2).cast("bigint") * 60 + F.regexp_extract(F.trim(p["tag_duration"]), clock, 3).cast("bigint")
                  + F.concat(F.lit("0."), F.regexp_extract(F.trim(p["tag_duration"]), clock, 4), F.lit("0")).cast("double"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    empty = F.lit("")
    return rows.select(
        key, F.col("id").alias("track_id"), "type", F.coalesce("codec", empty).alias("codec"),
        F.coalesce(F.nullif(p["language_ietf"], empty), F.nullif(p["language"], empty), F.lit("und")).alias("language"), F.coalesce(p["track_name"], empty).alias("name"),
        flag(p["default_track"]).alias("is_default"), flag(p["forced_track"]).alias("is_forced"),
        (flag(p["text_subtitles"]) | codecs.rlike("s_text|subrip|ass|ssa|utf8|webvtt|text")).alias("text_subtitle"), codecs.rlike("pgs|hdmv").alias("pgs_subtitle"),
        codecs.rlike("vobsub|dvd_subtitle").alias("vobsub_subtitle"), _count(p["tag_number_of_frames"]).alias("frames"), span.alias("span_s"),
        _count(p["tag_number_of_bytes"]).alias("bytes"), flag(p["flag_commentary"]).alias("commentary"), flag(p["flag_visual_impaired"]).alias("visual_impaired"),
        flag(p["flag_original"]).alias("original"), _count(p["audio_channels"]).alias("channels"))


PROVIDER_A = """data array<struct<attributes:struct<release:string,language:string,download_count:bigint,ratings:double,from_trusted:boolean,hearing_impaired:boolean,
 moviehash_match:boolean,uploader:struct<name:string>,feature_details:struct<movie_name:string,title:string,name:string,year:string,feature_id:string,feature_type:string,
 imdb_id:string,tmdb_id:string,season_number:string,episode_number:string,parent_imdb_id:string,parent_tmdb_id:string>,files:array<struct<file_id:bigint,file_name:string>>>>>"""
# Names under which provider b gives a value, in order of preference (fixed values).
B_NAMES = {
    "url": ("url", "download_url"), "file_id": ("file_n_id", "n_id", "id"), "name": ("name", "file_name"), "release": ("release_name",), "language": ("language", "lang"),
    "downloads": ("download_count", "downloads", "downloaded"), "rating": ("rating", "rate", "score"), "hearing": ("hi", "hearing_impaired"), "author": ("author",),
}
_B_ITEM = ",".join(f"{n}:string" for names in B_NAMES.values() for n in names) + ",releases:array<string>"
PROVIDER_B = f"subtitles array<struct<{_B_ITEM},unpack_files:array<struct<{_B_ITEM}>>>>"
_FEATURE = ("feature_id", "imdb_id", "tmdb_id", "feature_type", "season_number", "episode_number", "parent_imdb_id", "parent_tmdb_id")


def read_candidates(json_a: DataFrame, json_b: DataFrame, key: str = "media_id", text: str = "json", language: str = "") -> DataFrame:
    """Two providers' results as one candidate table; `language` stands for a missing one.

    Provider a gives its first file; provider b's unpacked files inherit from their parent. Of equal
    ids the last record counts, at the place (`seq`: item, file) of the first.
    """
    empty, none = F.lit(""), F.lit(False)
    def given(*values):
        return F.coalesce(*[F.nullif(v, empty) for v in values])

    a = json_a.select(key, F.posexplode(F.from_json(text, PROVIDER_A)["data"]).alias("i", "d")).select(key, "i", "d.attributes.*")
    f, d = F.get("files", F.lit(0)), F.col("feature_details")
    feature = {n if n.startswith("feature") else f"feature_{n}": F.coalesce(d[n], empty) for n in _FEATURE}
    feature["feature_imdb_id"] = F.regexp_replace(feature["feature_imdb_id"], "^tt", "")
    rows_a = a.filter(f["file_id"].isNotNull()).select(
        key, F.lit("a").alias("provider"), F.struct(F.col("i").cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("j")).alias("seq"),
        f["file_id"].cast("string").alias("file_id"), F.coalesce(given(f["file_name"]), F.concat(F.lit("subtitle-"), f["file_id"], F.lit(".srt"))).alias("file_name"),
        F.coalesce(given("release", f["file_name"]), empty).alias("release"), F.coalesce(given("language"), F.lit(language)).alias("language"),
        F.coalesce("download_count", F.lit(0).cast("bigint")).alias("downloads"), F.coalesce("ratings", F.lit(0.0)).alias("rating"), F.coalesce("from_trusted", none).alias("trusted"),
        F.coalesce("hearing_impaired", none).alias("hearing_impaired"), F.coalesce("moviehash_match", none).alias("moviehash_match"),
        F.coalesce(F.col("uploader.name"), empty).alias("author"), empty.alias("url"), F.coalesce(given(d["movie_name"], d["title"], d["name"]), empty).alias("feature_title"),
        F.coalesce(d["year"], empty).alias("feature_year"), *[v.alias(n) for n, v in feature.items()])
    b = json_b.select(key, F.posexplode(F.from_json(text, PROVIDER_B)["subtitles"]).alias("i", "p")).select(
        key, F.col("i").cast("bigint").alias("i"), "p", F.posexplode_outer("p.unpack_files").alias("j", "c"))
    def inherited(what):
        return given(*[F.coalesce(F.col(f"c.{n}"), F.col(f"p.{n}")) for n in B_NAMES[what]])

    url, j = F.coalesce(inherited("url"), empty), F.coalesce("j", F.lit(0)).cast("bigint")
    number = (F.col("i") * 100 + j).cast("string")  # stands in names only; the order goes by (i, j)
    name = F.coalesce(inherited("name"), given(F.regexp_extract(url, "([^/?]+)(?:\\?.*)?$", 1)), F.concat(F.lit("subtitle-"), number, F.lit(".zip")))
    listed = F.array_join(F.slice(F.coalesce(F.col("c.releases"), F.col("p.releases")), 1, 3), " / ")  # the rule names three
    downloads, rating = F.coalesce(inherited("downloads").try_cast("bigint"), F.lit(0).cast("bigint")), F.coalesce(inherited("rating").try_cast("double"), F.lit(0.0))
    rows_b = b.select(
        key, F.lit("b").alias("provider"), F.struct("i", j.alias("j")).alias("seq"), F.coalesce(inherited("file_id"), given(url), number).alias("file_id"), name.alias("file_name"),
        F.coalesce(inherited("release"), given(listed), name).alias("release"), F.coalesce(inherited("language"), F.lit(language)).alias("language"), downloads.alias("downloads"),
        rating.alias("rating"), ((rating >= 8) | (downloads >= 1000)).alias("trusted"), F.coalesce(~F.lower(inherited("hearing")).isin("false", "0"), none).alias("hearing_impaired"),
        none.alias("moviehash_match"), F.coalesce(inherited("author"), empty).alias("author"), url.alias("url"), empty.alias("feature_title"), empty.alias("feature_year"),
        *[empty.alias(n) for n in feature])
    rows = rows_a.unionByName(rows_b)
    kept = [c for c in rows.columns if c not in (key, "provider", "file_id", "url", "seq")]
    return rows.groupBy(key, "provider", "file_id", "url").agg(F.min("seq").alias("seq"), F.max_by(F.struct(*kept), "seq").alias("r")).select(
        key, "provider", "file_id", "url", "seq", "r.*")


CLAIM_JSON = "id string, claims map<string,array<struct<id:string,rank:string,value:string,unit:string,precision:int,qualifiers:map<string,array<string>>>>>"


def explode_claims(entities: DataFrame, text: str = "json") -> DataFrame:
    """Catalogue entities to one row per claim and qualifier; claims without qualifiers give one row."""
    e = entities.select(F.from_json(text, CLAIM_JSON).alias("e")).select(F.col("e.id").alias("entity"), F.explode("e.claims").alias("property", "list"))
    c = e.select("entity", "property", F.explode("list").alias("c"))
    q = c.select("entity", "property", "c", F.explode_outer("c.qualifiers").alias("qualifier", "values"))
    return q.select("entity", "property", F.col("c.id").alias("statement"), F.col("c.rank").alias("rank"), F.col("c.value").alias("value"), F.col("c.unit").alias("unit"),
                    F.col("c.precision").alias("precision"), "qualifier", F.explode_outer("values").alias("qualifier_value"))


PACKET_JSON = "packets array<struct<stream_index:bigint,pts_time:string,duration_time:string,size:string,pos:string>>"


def read_packets(packet_json: DataFrame, ranges: DataFrame, key: str = "media_id", text: str = "json") -> DataFrame:
    """Packets inside the covered ranges, repeats of a seek removed. `ranges(key, start_ms, end_ms)`."""
    rows = packet_json.select(key, F.explode(F.from_json(text, PACKET_JSON)["packets"]).alias("p")).select(key, "p.*")
    pts = F.col("pts_time").try_cast("double")
    timed = rows.filter(pts.isNotNull() & F.col("stream_index").isNotNull()).withColumn("pts_ms", F.round(pts * 1_000).cast("bigint")).dropDuplicates(
        [key, "stream_index", "pos", "pts_time", "size", "duration_time"]).withColumn("pts_end", F.col("pts_ms") + 1)
    covered = merge_intervals(ranges, [key]).select(key, F.col("start_ms").alias("low"), F.col("end_ms").alias("high"))
    return interval_join(timed, covered, [key], ("pts_ms", "pts_end"), ("low", "high")).select(
        key, "stream_index", "pts_ms", F.col("size").try_cast("bigint").alias("size"), F.round(F.col("duration_time").try_cast("double") * 1_000).cast("bigint").alias("duration_ms"), "pos")


def incremental_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose path, size or modification time is not in the manifest yet."""
    return files.join(manifest.select("path", "size", "mtime_ns"), ["path", "size", "mtime_ns"], "left_anti")


def record_manifest(folder: str, analysed: DataFrame, run: int, buckets: int = 64) -> None:
    """Writes analysed files (path, size, mtime_ns) back to the manifest in `folder` as run `run`; a path's last run counts.
    Only the buckets of these paths are rewritten, and a run that was recorded to its end is not recorded again."""
    merge = merge_log(analysed.sparkSession, folder, ["path"], "run", buckets)
    merge(analysed.select("path", "size", "mtime_ns", F.lit(run).cast("long").alias("run"), F.lit(True).alias("is_valid")), run)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a manifest as last recorded; empty before the first run."""
    return current_log(spark, folder, "path string, size long, mtime_ns long, run long, is_valid boolean").select("path", "size", "mtime_ns")


_SLICE = 64 * 1024


def file_fingerprint(files: DataFrame) -> DataFrame:
    """Size plus the 64-bit words of the first and last 64 KiB; empty under 128 KiB. `files(path, size)`.

    Only the two slices of every file are read, inside the tasks, through the path's file system.
    """
    def hashes(batches):
        import numpy as np
        from pyarrow.fs import FileSystem

        def one(path, size):
            if size < 2 * _SLICE:
                return ""
            fs, inner = FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
            with fs.open_input_file(inner) as handle:
                head = handle.read(_SLICE)
                handle.seek(size - _SLICE)
                data = np.frombuffer(head + handle.read(_SLICE), dtype="<u8")
            return f"{(int(data.sum(dtype=np.uint64)) + size) & 0xFFFFFFFFFFFFFFFF:016x}"

        for pdf in batches:
            fixed = pdf["path"].str.replace(r"^file:/+", "file:///", regex=True)
            yield pd.DataFrame({"path": pdf["path"], "fingerprint": [one(p, s) for p, s in zip(fixed, pdf["size"])]})

    return files.select("path", "size").mapInPandas(hashes, "path string, fingerprint string")


def read_public_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(title, year, tagline, aliases) of work pages, or why a page is refused.

    The page must carry exactly one structured movie record; its year, the header year and the
    canonical and sharing addresses must agree.
    """
    text = F.col(html)
    title = collapse(F.regexp_extract(text, r"(?is)<title[^>]*>(.*?)</title>", 1))
    blocks = F.regexp_extract_all(text, F.lit(r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    record = "`@type` string, name string, datePublished string, description string, alternateName array<string>"
    movies = F.filter(F.transform(blocks, lambda b: F.from_json(b, record)), lambda r: r["@type"] == "Movie")
    header = F.array_distinct(F.regexp_extract_all(F.regexp_extract(text, r"(?is)<h1[^>]*>(.*?)</h1>", 1), F.lit(r"\(((?:19|20)\d{2})\)"), F.lit(1)))
    canonical = F.regexp_extract(text, r"(?i)<link[^>]*rel=[\"']canonical[\"'][^>]*href=[\"']([^\"']+)", 1)
    shared = F.regexp_extract(text, r"(?i)<meta[^>]*property=[\"']og:url[\"'][^>]*content=[\"']([^\"']+)", 1)
    table = F.regexp_extract(text, r"(?is)<table[^>]*class=[\"'][^\"']*aliases[^\"']*[\"'][^>]*>(.*?)</table>", 1)
    aliases = F.transform(F.regexp_extract_all(table, F.lit(r"(?is)<tr[^>]*>\s*<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: collapse(F.regexp_replace(c, "<[^>]+>", "")))
    rows = pages.select(key, title.alias("page_title"), movies.alias("m"), header.alias("h"), canonical.alias("c"), shared.alias("s"), aliases.alias("table_aliases"))
    movie = F.get("m", F.lit(0))
    year = F.regexp_extract(F.coalesce(movie["datePublished"], F.lit("")), r"^((?:19|20)\d{2})", 1)
    reason = (
        F.when(F.size("m") == 0, "no_movie_record").when(F.size("m") > 1, "several_movie_records").when(F.size("h") != 1, "header_year")
        .when(year != F.get("h", F.lit(0)), "year_conflict").when((F.col("c") != "") & (F.col("s") != "") & (F.col("c") != F.col("s")), "address_conflict").otherwise(""))
    good = reason == ""
    return rows.select(
        key, "page_title", reason.alias("reject_reason"), F.when(good, movie["name"]).alias("title"), F.when(good, year).alias("year"), F.when(good, movie["description"]).alias("tagline"),
        F.when(good, F.array_distinct(F.concat(F.coalesce(movie["alternateName"], F.array().cast("array<string>")), "table_aliases"))).alias("aliases"))
