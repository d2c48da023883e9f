"""Plans of queries whose tables outgrow what a plan can tell of their size, and results that must not depend on the form."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuemill.functions import similarity
from cuemill.functions import text as T
from cuemill.operators import catalogue, evidence, grouped, intervals, matching, offsets, selection, windows
from cuemill.operators.evidence import restored
from cuemill.plans import all_queries
from cuemill.streaming import progress as st

SF = "/root/testdata/sf0.001"


def plan_of(spark, name):
    return all_queries()[name].build(spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["c9_title_year_join", "d25_identity_admission", "h6_screening", "b16_conflicts", "c8_multi_id_match", "c17_prefix_profiles", "d23_unique_resolution", "d15_best_shift"])
def test_nothing_exploded_goes_to_the_driver(spark, name):
    assert "BroadcastExchange" not in plan_of(spark, name)


@pytest.mark.parametrize("name", ["e2_frames_to_intervals", "s5_closed_intervals"])
def test_frames_are_not_listed_one_by_one(spark, name):
    assert "sequence(" not in plan_of(spark, name)


def test_spans_of_frames_give_what_their_frames_give(spark):
    rows = [(1, 0, 9), (1, 25, 40), (1, 41, 50), (1, 66, 67), (1, 200, 209), (2, 5, 900), (2, 10, 20), (2, 916, 917), (3, 0, 30), (3, 46, 60)]
    spans = spark.createDataFrame(rows, "media_id long, frame long, until long")
    frames = spans.selectExpr("media_id", "explode(sequence(frame, until - 1)) as frame")
    want = sorted(intervals.frames_to_intervals(frames, ["media_id"]).collect())
    assert sorted(intervals.frames_to_intervals(spans, ["media_id"], until="until").collect()) == want
    assert sorted(st.closed_intervals(spans, until="until").collect()) == want == sorted(st.closed_intervals(frames).collect())


def test_curves_are_not_listed_shift_by_shift(spark):
    assert "Window" not in plan_of(spark, "d17_correlation_peaks")


def test_curves_are_restored_from_bends():
    # one second of activity against itself, moved by three frames: a triangle about the shift 3
    ks, xs = np.array([-7, 3, 13]), np.array([-1, 2, -1])
    want = [max(0, 10 - abs(k - 3)) for k in range(-19, 21)]
    assert restored(-19, 20, 0, 0, ks, xs).tolist() == want


@pytest.mark.parametrize("name", ["d19_bounded_alignment", "d19_local_alignment", "c15_phrase_matches", "c14_cue_word_offsets"])
def test_windows_are_not_called_one_by_one(spark, name):
    assert "GroupsInPandas" not in plan_of(spark, name)


def test_shifts_near_the_best_hold_the_best(spark):
    rows = [(m, 13_000 + i * (700 + m) % 90_000) for m in range(3) for i in range(40)]
    starts = spark.createDataFrame(rows, "media_id long, start_ms long")
    windows = spark.createDataFrame([(m, r, r * 30_000, r * 30_000 + 70_000) for m in range(3) for r in range(2)], "media_id long, region long, low_ms long, high_ms long")
    whole = grouped.start_curves(starts, starts, windows, ["media_id"])
    near = grouped.start_curves(starts, starts, windows, ["media_id"], within=1e-11)
    best = lambda df: sorted(df.groupBy("media_id", "region").agg({"value": "max"}).collect())
    assert best(near) == best(whole) and 0 < near.count() < whole.count()


def test_titles_meet_once_for_all_their_films(spark):
    films = spark.createDataFrame([(n, "red ring", "1999") for n in range(30)] + [(30, "red rings", "1999"), (31, "red", "1999")], "file_id long, feature_title string, feature_year string")
    works = spark.createDataFrame([(n, "red ring", "1999") for n in range(20)] + [(20, "red ring", "2000")], "identity_id long, title string, year string")
    kinds = {(r["feature_title"], r["kind"]) for r in catalogue.title_year_kinds(films, works).collect()}
    assert kinds == {("red ring", "exact"), ("red rings", "typo"), ("red", "prefix")}
    assert catalogue.title_year_join(films, works).groupBy("kind").count().orderBy("kind").collect() == [("exact", 600), ("prefix", 20), ("typo", 20)]


def test_a_row_of_the_funnel_stands_for_its_weight(spark):
    rows = spark.createDataFrame([("a", "", 5), ("a", "role", 2), ("b", "pending", 3)], "provider string, reason string, n long")
    totals = spark.createDataFrame([("a", 9, False), ("b", 1, True)], "provider string, total long, truncated boolean")
    got = catalogue.funnel(rows, totals, weight="n").orderBy("provider").select("provider", "total", "loaded", "queued", "pending", "by_role", "filtered").collect()
    assert got == [("a", 9, 7, 5, 0, 2, 2), ("b", None, 3, 0, 3, 0, 0)]


def test_observations_that_are_alike_may_be_one_row(spark):
    rows = spark.createDataFrame([(1, "i", "t", False, 4), (1, "i", "", False, 3), (2, "", "t", False, 2)], "identity_id long, imdb_id string, tmdb_id string, conflict boolean, n long")
    got = catalogue.resolve_unique(rows, weight="n").orderBy("identity_id").select("observed", "complete", "reason").collect()
    assert got == [(7, 4, ""), (2, 0, "incomplete_ids")]


def test_candidates_are_ordered_once_for_all_works_of_a_name(spark):
    rows = spark.createDataFrame([("t", "1999", n, "a" if n % 2 else "b", "t.1999.x264", "t.1999.x264", False) for n in range(4)],
                                 "title string, year string, seq long, author string, own_name string, release string, hash_match boolean")
    got = catalogue.prioritise(rows, ["title", "year"]).orderBy("place").select("seq", "turn", "place").collect()
    assert got == [(0, 0, 1), (1, 0, 2), (2, 1, 3), (3, 1, 4)]


@pytest.mark.parametrize("name", ["u1_bigram_f1", "u1_bag_f1", "c13_common_subsequence", "u1_dialogue_score"])
def test_windows_are_read_twice_with_their_ids(spark, name):
    # for the meeting, and for the texts that have met
    assert plan_of(spark, name).count("FileScan parquet [doc_id") == 2


def test_bags_count_repeated_words_and_leave_out_pairs_without_one(spark):
    texts = lambda name, rows: spark.createDataFrame(rows, f"{name} long, text string")
    pairs = spark.createDataFrame([(1, 1), (2, 1), (1, 2)], "probe_id long, window_id long")
    got = matching.bag_scores(pairs, texts("probe_id", [(1, "go go go home"), (2, "stay here")]), texts("window_id", [(1, "home, go! Go"), (2, "else")]))
    assert got.collect() == [(1, 1, 6 / 7)]


def test_further_words_are_met_only_where_the_first_give_few_windows(spark):
    probes = spark.createDataFrame([(1, " ".join(f"word{c}" for c in "abcdefghij"))], "probe_id long, text string")
    rows = [(n, f"word{c}") for n, c in enumerate("abcdefgh" + "i" * 20 + "j" * 30)]
    few = spark.createDataFrame(rows, "window_id long, text string")
    many = few.unionByName(spark.createDataFrame([(100 + n, "worda wordb") for n in range(12)], "window_id long, text string"))
    assert matching.shortlist(probes, few).count() == 58 and matching.shortlist(probes, many).count() == 20


def test_letters_are_paired_by_code_points(spark):
    rows = spark.createDataFrame([("abab",), ("a",), ("",), ("é字😀x",)], "t string")
    assert [r.b for r in rows.select(T.bigrams(F.col("t")).alias("b")).collect()] == [["ab", "ba"], [], [], ["é字", "字😀", "😀x"]]


def test_long_texts_are_aligned_by_bits():
    draw = np.random.default_rng(3)
    for n, m in [(0, 4), (5, 0), *draw.integers(1, 90, (60, 2))]:
        a, b = (draw.integers(0, 8, k) for k in (n, m))
        lengths = np.zeros((n + 1, m + 1), int)
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                lengths[i, j] = 1 + lengths[i + 1, j + 1] if a[i] == b[j] else max(lengths[i + 1, j], lengths[i, j + 1])
        want, i, j = [], 0, 0
        while i < n and j < m:
            if a[i] == b[j]:
                want.append([i, j])
                i, j = i + 1, j + 1
            elif lengths[i + 1, j] >= lengths[i, j + 1]:
                i += 1
            else:
                j += 1
        assert similarity._alignment(a, b).tolist() == want


def test_scores_of_texts_that_stand_in_turn(spark):
    texts = ["go home now", "home you go", "字幕样例", "go home", ""]
    rows = spark.createDataFrame([(a, b) for b in texts for a in texts], "a string, b string").coalesce(1)
    for r in rows.withColumn("s", similarity.text_scores("a", "b")).collect():
        assert r.s.dialogue == similarity.dialogue_similarity(r.a, r.b)


def test_what_is_left_of_a_text_is_reckoned_once_for_each_pattern(spark):
    assert plan_of(spark, "i2_identifier_roles").count("regexp_replace(") < 150


def test_joined_cues_are_cleaned_again_only_with_brackets(spark):
    rows = [(1, 1, 0, 900, "a long opening line"), (1, 2, 1000, 1900, "one (two"), (1, 3, 2000, 2900, "three) four"), (1, 4, 3000, 3900, "...")]
    cues = spark.createDataFrame(rows, "track_id long, cue_ix int, start_ms long, end_ms long, text string")
    grown = windows.growing_windows(cues)
    assert "aggregate(" in grown._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.cue_ix, r.cues) for r in grown.collect()) == [(1, 1), (1, 2), (1, 3)]


def test_near_pairs_are_sought_only_where_films_are_open(spark):
    assert "LeftSemi" in plan_of(spark, "d30_independent_evidence")
    rows = [(1, 0, 0, "aa", True), (1, 0, 2000, "bb", True), (2, 0, 0, "aa", True), (2, 0, 20_000, "aa", True), (2, 0, 2000, "bb", False),
            (3, 0, 0, "aa", True), (3, 1, 2000, "bb", True), (4, 0, 0, "aa", True), (4, 0, 13_000, "aa", True), (4, 0, 4000, "bb", True), (5, 0, 0, "aa", True)]
    evidence = spark.createDataFrame(rows, "track_id long, position int, at_ms long, text string, stable boolean")
    got = matching.independent_evidence(evidence, ["track_id"]).orderBy("track_id").collect()
    assert [tuple(r) for r in got] == [(1, 2, True), (2, 2, True), (3, 2, False), (4, 2, True), (5, 1, False)]


@pytest.mark.parametrize("name", ["e11_source_anchors", "h5_library_plan", "e11_main_audio", "e11_best_track"])
def test_tracks_are_read_once_by_methods_the_jvm_compiles(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = all_queries()[name].build(spark, SF)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    code = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenString(plan)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8_000  # longer ones are interpreted
    assert plan.toString().count("FileScan parquet [l_orderkey") == 1


def test_films_choose_among_their_own_tracks(spark):
    rows = [(1, 1, "audio", "ger", "", False), (1, 2, "subtitles", "ger", "", False), (1, 3, "subtitles", "ger", "SDH", True), (1, 4, "subtitles", "ger", "Full", True), (1, 5, "subtitles", "eng", "", False),
            (1, 6, "subtitles", "fre", "", True), (2, 1, "audio", "eng", "Commentary", True), (2, 2, "subtitles", "fre", "Signs/Songs", True), (2, 3, "subtitles", "fre", "", False), (3, 1, "audio", None, "", True),
            (4, 1, "subtitles", "chi", "Simplified Hant", False), (4, 2, "video", "", None, True)]
    tracks = spark.createDataFrame(rows, "media_id long, track_id int, type string, language string, name string, is_default boolean").selectExpr(
        "*", "'AAC' as codec", "false as is_forced", "900L as frames", "900d as span_s")
    films = spark.createDataFrame([(n, 1000.0) for n in range(1, 5)], "media_id long, duration_s double")
    made = selection.profiled(tracks, films)
    assert sorted(map(tuple, selection.source_anchors(made).collect())) == [(1, 2, "de", 0), (1, 4, "de", 0), (1, 5, "en", 1), (2, 3, "fr", 2), (4, 1, "zh", 2)]
    assert sorted(map(tuple, selection.main_audio(made).collect())) == [(1, 1, "de", 1), (3, 1, "und", 1)]
    plan = sorted(tuple(r) for r in selection.library_plan(made, ["zh-CN", "en", "de"]).collect())
    assert plan == [(1, 1, 4, "zh-CN", 1, 2, "translate"), (2, 0, 0, "zh-CN,en,de", None, 3, "no_dialogue_audio"), (3, 1, 0, "zh-CN,en,de", 1, None, "search"), (4, 0, 0, "en,de", None, 1, "no_dialogue_audio")]


def test_moves_of_a_region_are_not_rows(spark):
    plan = plan_of(spark, "d16_regional_overlap")
    assert "Window" not in plan and "sequence(" not in plan


def test_regions_choose_what_their_cells_choose(spark):
    draw = np.random.default_rng(11)
    length, rows, moved = 40_000, [], []
    for film in range(6):
        for at in draw.integers(0, length // 50, 30) * 50 + (film > 3) * draw.integers(0, 50, 30):
            rows.append((film, int(at), int(at + draw.choice([0, 30, 50, 850, 2_450]))))
        moved += [(film, int(a - 300 + 100 * draw.integers(-1, 2)), int(b - 300)) for _, a, b in rows[-30:] if draw.random() < 0.8]
    rows += [(1, 20_000, 20_050)] * 3

    def cells(spans, low, high):
        found = set()
        for at, until in spans:
            if until > low and at < high and min(until, high) > max(at, low):
                a = max(0, round(max(at, low) / 100))
                found |= set(range(a, max(a + 1, round(min(until, high) / 100))))
        return found

    want = []
    for film in range(7):
        for name, lo, hi in offsets.REGIONS:
            low, high = length * lo, length * hi
            ref = [(a, b) for f, a, b in rows if f == film]
            cand = [(a + 300, b + 300) for f, a, b in moved if f == film]
            there, scores = cells(ref, low, high), []
            for step in range(-20, 21):
                here = cells([(a + step * 100, b + step * 100) for a, b in cand], low, high)
                scores.append(len(here & there) / min(len(here), len(there)) if here and there else 0.0)
            n = [sum(b > low and a < high for a, b in side) for side in (ref, cand)]
            want.append((film, name, 300 + 100 * (scores.index(max(scores)) - 20), max(scores), *n))
    frame = lambda own: spark.createDataFrame(own, "media_id long, start_ms long, end_ms long")
    films = spark.createDataFrame([(n, 300, length) for n in range(7)], "media_id long, shift_ms long, duration_ms long")
    got = offsets.regional_overlap(frame(rows), frame(moved), films.drop("duration_ms"), films.drop("shift_ms"), ["media_id"])
    assert sorted(map(tuple, got.collect())) == sorted(want)
    one = [np.array([a for f, a, _ in side if f == 0]) for side in (rows, moved)] + [np.array([b for f, _, b in side if f == 0]) for side in (rows, moved)]
    whole, parts = (offsets._region_scores(one[0], one[2], one[1], one[3], 4_000.0, 14_000.0, hold) for hold in (10**6, 50))
    assert whole.tolist() == parts.tolist()


def test_samples_are_chosen_by_lengths(spark):
    # texts are not sent on to the cue they were joined for
    assert not re.search(r"hashpartitioning\([^)]*centre", plan_of(spark, "e17_sample_windows"))


def test_samples_are_those_of_whole_texts(spark):
    draw = np.random.default_rng(5)
    lines = ["go home now", "wait (for", "me) there", "[door]", "one <i>two</i> three", "{\\an8}", "...", "ÉTÉ ﬁn", "a long line of words, said at once", "x"]
    rows = [(t, n, int(n * 2_500 + draw.integers(0, 4_000)), str(draw.choice(lines))) for t in range(12) for n in range(int(draw.integers(1, 60)))]
    rows = [(t, n, at, at + int(draw.integers(0, 9_000)), text) for t, n, at, text in rows]
    lengths = {t: int(draw.choice([0, 20_000, 90_000, 200_000])) for t in range(12)}
    cues = spark.createDataFrame(rows, "track_id long, cue_ix int, start_ms long, end_ms long, text string")
    clean = lambda texts: {r.t: r.n for r in spark.createDataFrame([(x,) for x in sorted(set(texts))], "t string").select("t", F.length(T.clean_dialogue_key(F.col("t"))).alias("n")).collect()}
    heard = clean(r[4] for r in rows)
    rows, found, want = [r for r in rows if heard[r[4]]], {}, []
    for track, given in lengths.items():
        spoken = [r for r in rows if r[0] == track]
        length = given or max((r[3] for r in spoken), default=0)
        for _, n, start, end, _ in spoken:
            low = max(0, start - 6_000)
            high = min(length, low + 12_000)
            found.setdefault((track, length), []).append((n, start + end, low, high, " ".join(r[4] for r in spoken if r[3] >= low and r[2] <= high)))
    density = clean(w[4] for own in found.values() for w in own)
    for (track, length), around in found.items():
        last = None
        for q in range(4):
            own = [w for w in around if w[1] * 2 // length == q]
            w = max(own, key=lambda w: (density[w[4]], -w[0])) if own else min(around, key=lambda w: (abs(w[1] - length * (q + 0.5) / 2), w[0]))
            begin = min(w[2], length - 12_000) if length > 30_000 else w[2]
            if last is None or begin - last >= 30_000:
                last = begin
                want.append((track, q, begin, max(8_000, min(12_000, w[3] - begin)), w[4]))
    durations = spark.createDataFrame(list(lengths.items()), "track_id long, duration_ms long")
    assert sorted(map(tuple, windows.sample_windows(cues, durations).collect())) == sorted(want)


def test_few_spans_are_compared_by_letters(monkeypatch):
    events = (123456, 123499, 150003, 150777)
    tokens = [word for e in events for word in ("line", "number", str(e), "spoken")]
    starts, compared = [100 * k for k in range(len(tokens))], []
    ratio = grouped.difflib.SequenceMatcher.ratio
    monkeypatch.setattr(grouped.difflib.SequenceMatcher, "ratio", lambda self: compared.append(isinstance(self.a, str)) or ratio(self))
    found = grouped.best_spans("line number 123499 spoken", tokens, starts, [s + 100 for s in starts])
    assert found[0] == (1.0, 4, 8) and sum(compared) <= 5


def test_spans_with_tokens_that_are_no_words_are_scored():
    # a single letter is no word and a token may be two, so a span may share more of its words than of its tokens
    tokens, starts, ends = ["5", "go", "ein wort", "go", "now"], [0, 800, 1300, 1300, 1800], [500, 1300, 1300, 1800, 2300]
    text = "a 5 ein wort x5 x5"
    first, second = grouped.best_spans(text, tokens, starts, ends)
    assert first == (similarity.dialogue_similarity(text, "5 go ein wort"), 0, 3)
    assert second == similarity.dialogue_similarity(text, "go ein wort go")


@pytest.mark.parametrize("name", ["d15_best_shift", "d16_structure_verdict"])
def test_activity_is_not_listed_cell_by_cell(spark, name):
    assert "sequence(" not in plan_of(spark, name)


def test_shifts_tried_on_runs_are_those_of_cells(spark):
    draw = np.random.default_rng(5)
    rows = [(m, int(s), int(s + d)) for m in range(6) for s, d in zip(draw.integers(-900, 300_000, 60), draw.integers(-50, 4_000, 60))]
    moved = [(m, s + 700 * (m - 3) + 41, e + 700 * (m - 3) + 90) for m, s, e in rows[::2]]
    reference, candidate = (spark.createDataFrame(r, "media_id long, start_ms long, end_ms long") for r in (rows, moved))

    def cells(spans, m, size):
        found = set()
        for _, s, e in (r for r in spans if r[0] == m):
            a = max(0, round(s / size))
            found.update(range(a, max(a + 1, round(e / size))))
        return found

    want = []
    for m in range(6):
        a, b = cells(rows, m, 500), cells(moved, m, 500)
        coarse = max(range(-240, 241), key=lambda k: (len(a & {x + k for x in b}), -k)) * 5
        a, b = cells(rows, m, 100), cells(moved, m, 100)
        overlap, k = max((len(a & {x + coarse + k for x in b}), -k) for k in range(-10, 11))
        want.append((m, (coarse - k) * 100, overlap, overlap / min(len(a), len(b))))
    assert [tuple(r) for r in offsets.best_shift(reference, candidate, ["media_id"]).orderBy("media_id").collect()] == want


def test_letters_are_not_compared_one_by_one(monkeypatch):
    draw = np.random.default_rng(11)
    texts = ["".join(draw.choice([*"abcdefgh ijklmnop"[:w]], n)) for w in (3, 9, 17) for n in (0, 1, 7, 40, 199, 200, 330)]
    texts += [t[5:60] + "rare Q" + t[:90] for t in texts]
    for a in texts:
        for b in texts:
            assert similarity.char_ratio(a, b) == similarity._ratio(a, b)
    ratio, compared = similarity.difflib.SequenceMatcher.ratio, []
    monkeypatch.setattr(similarity.difflib.SequenceMatcher, "ratio", lambda self: compared.append(isinstance(self.a, str)) or ratio(self))
    pair = pd.Series(["go home now", "we went home"]), pd.Series(["home you go", "go on " * 50])
    assert similarity.text_scores.func(*pair).dialogue.tolist() == [similarity.dialogue_similarity(a, b) for a, b in zip(*pair)]
    assert compared and not any(compared)


@pytest.mark.parametrize("name", ["d30_independent_evidence", "d36_burn_in_verdict"])
def test_evidence_keys_are_made_once(spark, name):
    assert "regexp_replace" not in plan_of(spark, name)  # but in the table that the plan reads
    rows = [(1, 0, 0, "...", True), (1, 0, 20_000, "aa", True), (2, 0, 0, "A a!", True), (2, 0, 20_000, "bb", False), (3, 0, 0, None, True)]
    evidence = spark.createDataFrame(rows, "track_id long, position int, at_ms long, text string, stable boolean")
    assert sorted(tuple(r) for r in matching.independent_evidence(evidence, ["track_id"]).collect()) == [(1, 1, False), (2, 2, True)]
    positions = spark.createDataFrame([(n, True, False) for n in (1, 2, 3, 4) for _ in range(12)], "track_id long, valid boolean, unresolved boolean")
    got = matching.burn_in_verdict(positions, evidence, ["track_id"]).orderBy("track_id").collect()
    assert [tuple(r) for r in got] == [(1, 12, "uncertain"), (2, 12, "detected"), (3, 12, "uncertain"), (4, 12, "not_detected")]


@pytest.mark.parametrize("name", ["d18_regional_support", "d18_regional_offsets"])
def test_regions_of_a_film_are_judged_inside_its_row(spark, name):
    plan = plan_of(spark, name)
    assert plan.count("Exchange hashpartitioning") <= 8 and plan.count("Join") <= 6


def test_bends_are_sums_over_pairs_of_edges():
    draw = np.random.default_rng(9)
    for n, m in [(0, 4), (5, 0), (40, 60)]:
        (r_at, r_w), (c_at, c_w) = ((draw.integers(0, 300, k), draw.integers(-2, 3, k)) for k in (n, m))
        want = {}
        for x, v in zip(r_at, r_w):
            for y, w in zip(c_at, c_w):
                if -19 <= x - y <= 20:
                    want[int(x - y)] = want.get(int(x - y), 0) + int(v * w)
        for hold in (7, 1_000_000):
            ks, xs = evidence._bends(r_at, r_w, c_at, c_w, -19, 20, hold)
            assert dict(zip(ks.tolist(), xs.tolist())) == {k: x for k, x in want.items() if x}
