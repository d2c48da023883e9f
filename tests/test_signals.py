"""Planted shifts are recovered; curves agree with brute force."""

import numpy as np
from pyspark.sql import functions as F

from cuemill.operators import evidence as ev
from cuemill.operators import grouped as gr
from cuemill.operators import offsets as of


def plant(seed=20261002, n=60, length=400_000):
    rng = np.random.default_rng(seed)
    starts = np.sort(rng.choice(np.arange(15_000, length - 15_000, 10), n, replace=False))
    return [(1, int(s), int(s + rng.integers(80, 300) * 10)) for s in starts]


def runs(rows, shift=0):
    return [(m, a + shift, b + shift) for m, a, b in rows]


def test_correlation_matches_arrays(spark):
    speech = plant()
    cues = runs(speech, 3_250)
    schema = "media_id long, start_ms long, end_ms long"
    ref, cand = (ev.frame_runs(spark.createDataFrame(r, schema), ["media_id"]) for r in (speech, cues))
    n_ref, n_cand = 42_000, 41_500
    domain = spark.createDataFrame([(1, n_ref, n_cand)], "media_id long, n_ref long, n_cand long")
    got = ev.correlation_peaks(ref, cand, domain, ["media_id"]).collect()[0]
    r, c = -np.ones(n_ref), -np.ones(n_cand)
    for rows, signal in ((speech, r), (cues, c)):
        for _, a, b in rows:
            signal[a // 10:b // 10] = 1
    shifts = np.arange(-999, 1001)
    values = np.array([np.dot(r[max(0, k):min(n_ref, n_cand + k)], c[max(0, -k):min(n_cand, n_ref - k)]) for k in shifts])
    best = shifts[len(values) - 1 - np.argmax(values[::-1])]
    assert got["offset_ms"] == best * 10 == -3_250
    assert abs(got["contrast"] - (values.max() - np.median(values))) < 1e-9
    far = np.abs(shifts - best) >= 100
    assert abs(got["rival_ratio"] - (values[far].max() - np.median(values)) / (values.max() - np.median(values))) < 1e-9


def test_best_shift_without_overlap_takes_lowest(spark):
    schema = "media_id long, start_ms long, end_ms long"
    a = spark.createDataFrame([(1, 0, 1_000)], schema)
    b = spark.createDataFrame([(1, 9_000_000, 9_001_000)], schema)
    row = of.best_shift(a, b, ["media_id"]).collect()[0]
    assert row["overlap"] == 0 and row["score"] == 0 and row["shift_ms"] == -121_000


def test_local_alignment_finds_planted_shift(spark):
    rng = np.random.default_rng(7)
    starts = sorted(int(x) for x in rng.choice(np.arange(0, 1_200_000, 40), 400, replace=False))
    ref = spark.createDataFrame([(1, s) for s in starts], "media_id long, start_ms long")
    img = ref.withColumn("start_ms", F.col("start_ms") - 1_500)
    windows = spark.createDataFrame([(1, i, i * 400_000, (i + 1) * 400_000) for i in range(3)], "media_id long, region int, low_ms long, high_ms long")
    row = gr.local_alignment(gr.start_curves(ref, img, windows, ["media_id"]), ["media_id"]).collect()[0]
    assert row["reason"] == "" and row["applied_ms"] == 1_500


def test_median_slope_bisection_equals_sorting():
    rng = np.random.default_rng(3)
    x = np.sort(rng.integers(0, 5_000_000, 200)).astype(float)
    y = 1.001 * x - 250 + rng.normal(0, 90, 200)
    assert of._median_slope(x, y, 60_000.0, hold=10) == of._median_slope(x, y, 60_000.0)
    assert of._median_slope(-x[::-1], y[::-1], 60_000.0, hold=10) == of._median_slope(-x[::-1], y[::-1], 60_000.0)
