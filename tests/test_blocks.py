"""Timeline models in blocks of offsets: the same models as from all pairs, and no pair is shuffled."""

import random
from statistics import median

import duckdb
import pytest
from pyspark.sql import functions as F

from cuemill import config as C
from cuemill.operators import consensus as cs

KEY = ["media_id"]


@pytest.fixture(scope="module")
def anchors():
    # Offsets gather about the ends of blocks (24 s) as well as at random.
    random.seed(7)
    rows = []
    for film in range(4):
        for i in range(40):
            movie = random.randrange(0, 4_000_000)
            shift = random.choice((24_000, -24_000, 0, 48_000)) + random.randrange(-1_500, 1_500)
            rows.append((film, movie // 400_000, 100 * film + i, movie, movie - shift, 0.5 + i % 45 / 100, i % 10 / 100))
    return rows


def plain(rows, scale_ix, scale):
    """Models of one film and scale from all pairs: {anchors: least model}."""
    tolerance = 850 if scale_ix == 0 else 1_200
    own = [(round(m - scale * s, 3), clip, a, score, margin) for _, clip, a, m, s, score, margin in rows]

    def pick(offset):
        best = {}
        for o, clip, a, score, margin in own:
            r = abs(o - offset)
            if r <= tolerance:
                rank = (round(score + 0.10 * margin - 0.08 * r / 1_000, 9), -r, -a)
                if clip not in best or rank > best[clip][0]:
                    best[clip] = (rank, o, a)
        return [(o, a) for _, o, a in best.values()]

    found = {}
    for start in sorted({o[0] for o in own}):
        first = pick(start)
        second = pick(median(o for o, _ in first)) if len(first) >= 2 else []
        if len(second) >= 2:
            found.setdefault(",".join(str(a) for a in sorted(a for _, a in second)), median(o for o, _ in second))
    return found


def test_models_are_those_of_all_pairs(spark, anchors):
    df = spark.createDataFrame(anchors, "media_id long, clip_ix long, anchor_id long, movie_ms long, subtitle_ms long, score double, margin double")
    got = {}
    for r in cs.timeline_models(df, KEY).collect():
        got.setdefault((r["media_id"], r["scale_ix"]), {})[r["anchors"]] = round(r["offset_ms"], 4)
    for film in range(4):
        for i, (_, scale) in enumerate(C.TIMELINE_SCALES):
            want = {k: round(v, 4) for k, v in plain([a for a in anchors if a[0] == film], i, scale).items()}
            assert got.get((film, i), {}) == want


def test_no_pair_is_shuffled(spark, anchors):
    df = spark.createDataFrame(anchors, "media_id long, clip_ix long, anchor_id long, movie_ms long, subtitle_ms long, score double, margin double")
    plan = cs.timeline_models(df, KEY)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("Initial Plan")[-1]


def test_ranks_round_as_the_sql_does(spark):
    values = [i + 0.0005 for i in range(1, 2_000)] + [i * 0.0005 + 0.3 for i in range(2_000)]
    con = duckdb.connect()
    con.execute("create table v as select unnest(?)::double as v", [values])
    want = dict(con.execute("select v, round(v, 3) from v").fetchall())
    got = spark.createDataFrame([(v,) for v in values], "v double").withColumn("r", cs._rounded("v", 3)).collect()
    assert {r["v"]: r["r"] for r in got} == want
    assert any(r["r"] != want[r["v"]] for r in spark.createDataFrame([(v,) for v in values], "v double").withColumn("r", F.round("v", 3)).collect())
