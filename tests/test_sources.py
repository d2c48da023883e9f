"""Subtitle files in three formats and several encodings; blocks that cannot be read."""

import tempfile
from pathlib import Path

from cuemill.operators.cues import write_subtitles
from cuemill.sources.headers import file_fingerprint, read_public_pages
from cuemill.sources.subtitles import read_subtitle_corpus

SRT = "1\n00:00:01,000 --> 00:00:02,500\n<i>Hello</i>\nthere\n\n2\n00:75:00,000 --> 00:76:00,000\nbad time\n\nno timing here\n"


def test_corpus(spark):
    folder = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    (folder / "a.srt").write_bytes(SRT.replace("\n", "\r\n").encode("utf-8-sig"))
    (folder / "b.srt").write_bytes("1\n00:00:01,0 --> 00:00:02,5\n你好\n".encode("gb18030"))
    (folder / "c.vtt").write_text("WEBVTT - x\n\n00:01.500 --> 00:02.000\nshort\n\nid\n01:00:00.000 --> 01:00:01.000\nlong\n")
    (folder / "d.ass").write_text("[Events]\nFormat: Layer, Start, End, Text\nDialogue: 0,0:00:01.00,0:00:02.50,{\\i1}One, two\\Nthree\nDialogue: 0,0:00\n[Fonts]\nDialogue: 0,0:00:01.00,0:00:02.50,no\n")
    (folder / "e.srt").write_bytes("1\n00:00:01,000 --> 00:00:02,000\nwide\n".encode("utf-16"))
    cues, bad = read_subtitle_corpus(spark, str(folder))
    got = {(r["track_id"][-5:], r["start_ms"], r["end_ms"], r["text"]) for r in cues.collect()}
    assert got == {
        ("a.srt", 1000, 2500, "Hello there"), ("b.srt", 1000, 2500, "你好"), ("c.vtt", 1500, 2000, "short"), ("c.vtt", 3600000, 3601000, "long"),
        ("d.ass", 1000, 2500, "One, two three"), ("e.srt", 1000, 2000, "wide")}
    assert {(r["track_id"][-5:], r["reason"]) for r in bad.collect()} == {("a.srt", "bad_time"), ("a.srt", "no_timing"), ("d.ass", "field_count")}


def test_written_file_reads_back(spark):
    rows = [(7, 1, 0, 900, "one"), (7, 2, 1000, 1900, "  "), (7, 3, 2000, 2900, "three")]
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    write_subtitles(spark.createDataFrame(rows, "track_id long, cue_ix long, start_ms long, end_ms long, text string"), f"{folder}/out")
    text = "".join(p.read_text() for p in sorted(Path(folder, "out", "track_id=7").glob("part-*")))
    assert text == "1\n00:00:00,000 --> 00:00:00,900\none\n\n2\n00:00:02,000 --> 00:00:02,900\nthree\n"


def test_fingerprint(spark):
    folder = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    data = bytes(range(256)) * 1024
    (folder / "x.bin").write_bytes(data)
    (folder / "s.bin").write_bytes(b"short")
    files = spark.createDataFrame([(str(folder / "x.bin"), len(data)), (str(folder / "s.bin"), 5)], "path string, size long")
    got = {r["path"][-5:]: r["fingerprint"] for r in file_fingerprint(files).collect()}
    words = [int.from_bytes(part[i:i + 8], "little") for part in (data[:65536], data[-65536:]) for i in range(0, 65536, 8)]
    assert got == {"x.bin": f"{(len(data) + sum(words)) % 2**64:016x}", "s.bin": ""}


def test_pages(spark):
    record = '<script type="application/ld+json">{"@type":"Movie","name":"Red","datePublished":"1999-02-01","alternateName":["Rot"]}</script>'
    table = '<table class="aliases"><tr><td>Rouge</td><td>fr</td></tr></table>'
    pages = [(1, f"<title>Red</title><h1>Red (1999)</h1>{record}{table}"), (2, f"<h1>Red (1998)</h1>{record}"), (3, f"<h1>Red (1999)</h1>{record}{record}"), (4, "<h1>x</h1>")]
    got = {r["page_id"]: (r["reject_reason"], r["title"], r["year"], r["aliases"]) for r in read_public_pages(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    assert got == {1: ("", "Red", "1999", ["Rot", "Rouge"]), 2: ("year_conflict", None, None, None), 3: ("several_movie_records", None, None, None), 4: ("no_movie_record", None, None, None)}
