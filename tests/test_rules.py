"""Rules on planted rows whose answers are written out."""

import random

import numpy as np
from pyspark.sql import functions as F

from cuemill.functions import redaction, similarity, titles
from cuemill.operators import matching, parallel, selection
from cuemill.sources import headers

SECRETS = {
    'token="abcdef': 'token="[REDACTED]',
    "u?a=1%3Btoken=abc": "u?a=1%3Btoken=[REDACTED]",
    "myAccessToken=abc": "myAccessToken=[REDACTED]",
    "userPassword: hunter2": "userPassword: [REDACTED]",
    "token=[abc]": "token=[REDACTED]",
    "reason: api_key=abc, done": "reason: api_key=[REDACTED], done",
    "GET /a?%61pi_key=abc&page=2": "GET /a?%61pi_key=[REDACTED]&page=2",
    "GET /a?x=1&amp;sort-key=abc#top": "GET /a?x=1&amp;sort-key=[REDACTED]#top",
    "media_signature=abc key: 5": "media_signature=abc key: 5",
    "--client-secret 'x' client-secret='a b'": "--client-secret 'x' client-secret='[REDACTED]'",
    "https://u:p@host/x": "https://[REDACTED]@host/x",
    "Authorization: Basic abc=": "Authorization: Basic [REDACTED]",
    "tokens are 5": "tokens are 5",
    "broken=1": "broken=1",
}


def column(spark, values, rule):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(rule(F.col("v"))).collect()]


def test_secrets_are_masked_once_and_nothing_else(spark):
    assert column(spark, SECRETS, redaction.redact) == list(SECRETS.values())
    assert column(spark, SECRETS.values(), redaction.redact) == list(SECRETS.values())


def test_sequel_numbers(spark):
    found = {"第2部 Part 3": "2", "流浪地球2": "2", "Part 3 第2部": "3", "Alien 3": "3", "Rocky IV": "4", "Blade Runner 2049": "", "I": "", "Chapter II": "2"}
    assert column(spark, found, titles.sequel_number) == list(found.values())


def test_runs_beyond_the_basic_plane(spark):
    rows = spark.createDataFrame([("Hello there", "Hallo \U00020010 da")], "s string, t string")
    assert rows.select(F.size(parallel._all(F.col("t"), parallel.CJK_RUN))).first()[0] == 1


def test_a_letter_has_one_role(spark):
    cases = {"区域A": ["label|section|A"], "“A” 计划": ["label|plan|A"], "A + “B” 等于 C": ["formula|A+B=C"], "第一 “A”": ["quoted|A"], "U.S. 门B": ["initialism|U.S.", "label|gate|B"]}
    assert column(spark, cases, lambda v: parallel.identifier_roles(v, True)) == list(cases.values())


def test_candidates_keep_what_providers_say(spark):
    a = '{"data":[{"attributes":{"release":"R","language":"en","moviehash_match":true,"feature_details":{"title":"T","imdb_id":"tt05","season_number":"2"},"files":[{"file_id":7}]}}]}'
    b = '{"subtitles":[{"id":"9","lang":"de","downloaded":"1500","hearing_impaired":true,"releases":["x","y"],"unpack_files":[{"file_name":"f1"},{"file_n_id":"10"}]}]}'
    found = {r.file_id: r for r in headers.read_candidates(spark.createDataFrame([(1, a)], "media_id int, json string"), spark.createDataFrame([(1, b)], "media_id int, json string")).collect()}
    assert set(found) == {"7", "9", "10"}
    assert (found["7"].language, found["7"].feature_imdb_id, found["7"].feature_season_number, found["7"].moviehash_match, found["7"].file_name) == ("en", "05", "2", True, "subtitle-7.srt")
    assert (found["9"].language, found["9"].downloads, found["9"].trusted, found["9"].hearing_impaired, found["9"].file_name, found["10"].release) == ("de", 1500, True, True, "f1", "x / y")


def test_common_subsequence_against_the_table(spark):
    draw = random.Random(1)
    rows = [([draw.choice("abcd") for _ in range(draw.randint(0, 12))], [draw.choice("abcd") for _ in range(draw.randint(0, 12))]) for _ in range(120)]
    for a, b in rows:
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in reversed(range(len(a))):
            for j in reversed(range(len(b))):
                best[i][j] = 1 + best[i + 1][j + 1] if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        pairs = similarity._alignment(*similarity._codes(a, b))
        assert len(pairs) == best[0][0] and all(a[i] == b[j] for i, j in pairs) and (np.diff(pairs, axis=0) > 0).all()
    df = spark.createDataFrame([(list("abxcd"), list("abcd"))], "a array<string>, b array<string>").select(similarity.common_subsequence("a", "b").alias("e"))
    assert tuple(df.first().e) == (4, 2, 1, 0, 0, 4, 3)


def test_shortlist_keeps_probes_without_latin_words(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice("天地人你我他来去") for _ in range(draw.randint(1, 14))) for _ in range(160)]
    probes = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts[:40])], "media_id int, probe_id int, text string")
    windows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts[20:])], "media_id int, window_id int, text string")
    found = {(r.probe_id, r.window_id) for r in matching.shortlist(probes, windows, ["media_id"]).collect()}
    for i, a in enumerate(texts[:40]):
        for j, b in enumerate(texts[20:]):
            if 0.7 * similarity._ratio(a, b) >= 0.5:
                assert (i, j) in found, (a, b)


def test_renumbered_tracks_are_the_same(spark):
    tracks = "media_id int, track_id int, type string, codec string"
    source = spark.createDataFrame([(1, 1, "video", "h264"), (1, 2, "audio", "AAC"), (1, 3, "audio", "DTS"), (2, 1, "video", "h264"), (2, 2, "audio", "AAC"), (3, 1, "video", "h264")], tracks)
    output = spark.createDataFrame([(1, 5, "video", "h264"), (1, 7, "audio", "AAC"), (1, 9, "audio", "DTS"), (2, 1, "video", "hevc"), (2, 2, "audio", "AAC"), (3, 1, "video", "h264"), (3, 2, "video", "h264")], tracks)
    media = spark.createDataFrame([(k, 100.0) for k in (1, 2, 3)], "media_id int, duration_s double")
    assert {r.media_id: r.reasons for r in selection.reconcile(source, output, media, media).collect()} == {1: "", 2: "video_codecs", 3: "video_count"}
