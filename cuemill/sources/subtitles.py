"""Subtitle files to cues: SRT, WebVTT and ASS, any of four encodings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from cuemill.functions.text import collapse
from cuemill.functions.timecode import parse_ms

_TIMING = r"(\d+:\d{2}:\d{2}[,.]\d{1,3})\s*-->\s*(\d+:\d{2}:\d{2}[,.]\d{1,3})"
_VTT_SHORT = r"(?m)^(\s*)(\d{2}:\d{2}\.\d{3})(\s*-->)"
_VTT_SHORT_END = r"(?m)^(\s*(?:\d+:)?\d{2}:\d{2}\.\d{3}\s*-->\s*)(\d{2}:\d{2}\.\d{3})(?![\d:])"


@F.pandas_udf(t.StringType())
def decode(contents: pd.Series) -> pd.Series:
    """Text of a file: UTF-8, UTF-16 or GB 18030, else UTF-8 with replacement marks."""
    def one(data):
        if data is None:
            return None
        for encoding in ("utf-8-sig", "utf-8", "utf-16", "gb18030"):
            try:
                return bytes(data).decode(encoding)
            except UnicodeDecodeError:
                continue
        return bytes(data).decode("utf-8", errors="replace")

    return contents.map(one)


def _blocks(files: DataFrame) -> DataFrame:
    """Blank-line separated blocks of SRT and WebVTT text."""
    text = F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    vtt = F.regexp_replace(text, r"(?i)^\s*WEBVTT[^\n]*\n", "")
    vtt = F.regexp_replace(F.regexp_replace(vtt, _VTT_SHORT, "$100:$2$3"), _VTT_SHORT_END, "$100:$2")
    body = F.when(F.col("format") == "vtt", vtt).otherwise(text)
    lines = F.filter(F.transform(F.split("block", "\n"), lambda s: F.replace(s, F.lit("﻿"), F.lit(""))), lambda s: F.trim(s) != "")
    split = files.filter(F.col("format") != "ass").select("track_id", F.posexplode(F.split(body, r"\n\s*\n")).alias("pos", "block"))
    return split.withColumn("lines", lines).filter(F.size("lines") > 0)


def _cues_of_blocks(files: DataFrame) -> DataFrame:
    at = F.array_position(F.transform("lines", lambda s: s.rlike(_TIMING)), F.lit(True)).cast("int")
    rows = _blocks(files).withColumn("at", at)
    line = F.element_at("lines", F.greatest("at", F.lit(1)))
    rest = F.slice("lines", F.col("at") + 1, F.greatest(F.size("lines") - F.col("at"), F.lit(0)))
    body = collapse(F.regexp_replace(F.array_join(F.transform(rest, lambda s: F.trim(s)), " "), "<[^>]+>", ""))
    start, end = (parse_ms(F.regexp_extract(line, _TIMING, g)) for g in (1, 2))
    return rows.select("track_id", "pos", F.when(F.col("at") > 0, start).alias("start_ms"), F.when(F.col("at") > 0, end).alias("end_ms"),
                       body.alias("text"), F.when(F.col("at") == 0, "no_timing").alias("why"), F.col("block").alias("raw"))


def _cues_of_ass(files: DataFrame) -> DataFrame:
    """Dialogue rows of the events section, fields placed by its Format line."""
    section = F.regexp_extract(F.replace("text", F.lit("\r\n"), F.lit("\n")), r"(?is)(?:^|\n)\s*\[events\]\s*\n(.*?)(?=\n\s*\[[^\n]*\]\s*(?:\n|$)|$)", 1)
    rows = files.filter("format = 'ass'").select("track_id", F.split(section, "\n").alias("lines"))
    header = F.get(F.filter("lines", lambda s: s.startswith("Format:")), F.lit(0))
    fields = F.transform(F.split(F.regexp_replace(header, "^Format:", ""), ","), lambda s: F.trim(s))
    rows = rows.select("track_id", fields.alias("fields"), F.posexplode("lines").alias("pos", "line")).filter(F.col("line").startswith("Dialogue:") & F.col("fields").isNotNull())
    parts = F.split(F.ltrim(F.regexp_replace("line", "^Dialogue:", "")), ",", -1)
    n = F.size("fields")
    joined = F.concat(F.slice("parts", 1, n - 1), F.array(F.array_join(F.slice("parts", n, F.greatest(F.size("parts") - n + 1, F.lit(0))), ",")))
    rows = rows.withColumn("parts", parts).withColumn("row", F.when(F.size("parts") >= n, joined))

    def field(name: str) -> Column:
        place = F.array_position("fields", name).cast("int")
        return F.trim(F.when(place > 0, F.element_at("row", F.greatest(place, F.lit(1)))))

    clean = F.regexp_replace(F.regexp_replace(field("Text"), r"\{[^}]*\}", ""), r"\\[Nnh]", " ")
    return rows.select("track_id", "pos", parse_ms(field("Start")).alias("start_ms"), parse_ms(field("End")).alias("end_ms"), collapse(clean).alias("text"),
                       F.when(F.col("row").isNull(), "field_count").alias("why"), F.col("line").alias("raw"))


def parse_subtitles(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cues, quarantine) of decoded files: `files(track_id, format, text)`, format srt, vtt or ass.

    Cues are numbered by their place in the file.
    """
    rows = _cues_of_blocks(files).unionByName(_cues_of_ass(files))
    good = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    cues = rows.filter(good).select("track_id", (F.col("pos") + 1).alias("cue_ix"), "start_ms", "end_ms", "text")
    bad = rows.filter(~good).select("track_id", "pos", F.coalesce("why", F.lit("bad_time")).alias("reason"), "raw")
    return cues, bad


def read_subtitle_corpus(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """(cues, quarantine) of all subtitle files under a path pattern; `track_id` is the file path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(glob)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(suffix.isin("ass", "ssa"), "ass").when(suffix == "vtt", "vtt").otherwise("srt")
    return parse_subtitles(files.select(F.col("path").alias("track_id"), kind.alias("format"), decode("content").alias("text")))
