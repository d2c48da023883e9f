"""Quality, turn repair and source divergence against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuemill.llm import divergence, quality, turns

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def cheapest(rows):
    """(cost, audit) of (initial, must go, truncated) rows: every script by a plain search over grammar states."""
    best = {0: (0, "")}
    for k in range(len(rows) + 1):
        for _ in range(3):  # inserts
            for state, (cost, audit) in list(best.items()):
                for role, to in NEXT[state].items():
                    if role != "s":
                        best[to] = min(best.get(to, (10**9, "")), (cost + 2, audit + "I"))
        if k == len(rows):
            return min(best[s] for s in (0, 3) if s in best)
        initial, must, cut = rows[k]
        after = {}
        for state, (cost, audit) in best.items():
            ways = [(state, cost + 3, "D")]
            for role, to in NEXT[state].items():
                if not must and role == initial:
                    ways.append((to, cost + cut, "K"))
                elif not must and role != "s":
                    ways.append((to, cost + cut + 2, "R"))
            for to, c, op in ways:
                after[to] = min(after.get(to, (10**9, "")), (c, audit + op))
        best = after


def code(initial, must, cut):
    return chr(65 + 4 * (1 if must else 3 if cut else 0) + "suax".index(initial))


def test_alignment_is_the_cheapest_and_least_script():
    draw = random.Random(1)
    for k in range(3000):
        rows = [(draw.choice("suuaax"), draw.random() < 0.15, draw.random() < 0.2) for _ in range(draw.randrange(1, 14))]
        ((_, cost, audit),) = turns.align("".join(code(*r) for r in rows), turns.START, True)
        assert (cost, audit) == cheapest(rows), rows


def plain_repair(rows):
    """Summary and repaired texts of one conversation's (turn, role, text) rows."""
    key = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, key(r)))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    cost, audit = cheapest([(i if i and i in "sua" else "x", f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults)])
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    known = [r[0] for r in rows if r[0] is not None]
    gaps = min(2**63 - 1, max(known) - min(known) + 1 - len(set(known))) if known else 0
    out, at, state = [], 0, 0
    for op in audit:
        if op == "D":
            at += 1
            continue
        if op == "K" and state == 0 and initials[at] == "s":
            state = 1
        else:
            state = 3 if state == 2 else 2
        role = rows[at][1] if op == "K" else "user" if state == 2 else "assistant"
        out.append(role + ":" + ("" if op == "I" else rows[at][2]))
        at += op != "I"
    counts = collections.Counter(faults)
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def conversations(seed, n, longest):
    draw = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        at = draw.randrange(-5, 5)
        for _ in range(draw.randrange(1, longest)):
            at += draw.choice([0, 1, 1, 1, 2])
            role = draw.choice(["system", "user", "user", "assistant", "assistant", "tool", "User", "", None])
            text = draw.choice(["Yes.", "No!", "Is it?  ", "cut off", "", " \t", None, f"Word {draw.random()}.", "é漢 text. \n"])
            rows.append((conv, draw.choice([None, at, at, at, at, at]), role, text, "x", 1, "k"))
    rows += rows[:3]
    return rows


@pytest.mark.parametrize("segment", [512, 4])
def test_repair_against_a_plain_loop(spark, monkeypatch, segment):
    monkeypatch.setattr(turns, "SEGMENT", segment)
    rows = conversations(segment, 25, 30) + [(900, -(2**63), "user", "Hm.", "x", 1, "k"), (900, 2**63 - 1, "user", "Hm!", "x", 1, "k")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string, place int, head string")
    summary, repaired = turns.repair(table)
    found = summary.join(turns.digests(repaired), "head").collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[0]].append(r[1:4])
    assert len(found) == len(groups)
    for r in found:
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == plain_repair(groups[r.conv_id]), r.conv_id


def test_long_conversations_are_chained_over_segments(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(7, k, draw.choice(["user", "assistant", "assistant", "tool"]), draw.choice(["Yes.", f"Text {k}.", "no"]) + str(k % 50) + "."[: draw.randrange(2)]) for k in range(700)]
    monkeypatch.setattr(turns, "SEGMENT", 32)
    summary, repaired = turns.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    row = summary.join(turns.digests(repaired), "head").first()
    assert (row.gaps, row.blank, row.duplicate, row.truncated, row.illegal, row.cost, row.audit, row.repaired_sha256) == plain_repair([r[1:] for r in rows])


def test_damage_by_checksum_and_empty_tables(spark):
    rows = [(k, t, role, "One. Two! Three?") for k in range(60) for t, role in enumerate(["system", "user", None])] + [(None, None, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = collections.Counter(tuple(r) for r in turns.damage(table).collect())
    want = collections.Counter()
    for c, t, role, text in rows:
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text or " ") if draw == 2 else text or " "
        want[c, t, "user" if draw == 4 else role or " ", text] += (draw != 0) + (draw == 3)
    assert found == +want
    summary, repaired = turns.repair(table.limit(0))
    assert summary.count() == 0 and repaired.count() == 0 and turns.digests(repaired).count() == 0


def plain_audit(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {k: k + 32 for k in range(65, 91)}
    count, held, groups = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for text, lang, source in rows:
        words = term.findall((text or "").translate(lower))
        groups[lang or ""].add(source or "")
        count.update((lang or "", source or "", w) for w in words)
        held.update({(lang or "", w) for w in words})
    out = []
    for lang, sources in groups.items():
        kept = [w for (g, w), n in held.items() if g == lang and n >= least]
        share = lambda n, total: 1 + 1_000_000_000 * (n + 5) // (total + 5 * len(kept))
        p = {s: {w: share(count[lang, s, w], sum(count[lang, s, x] for x in kept)) for w in kept} for s in sources}
        whole = {w: sum(count[lang, s, w] for s in sources) for w in kept}
        q = {w: share(whole[w], sum(whole.values())) for w in kept}
        for s in sources:
            pair = [(-sum(abs(p[s][w] - p[x][w]) for w in kept), x.encode(), x) for x in sources if x != s]
            own = [(q[w] - p[s][w], w.encode(), w) for w in kept if count[lang, s, w] and p[s][w] > q[w]]
            for part, ranked in (("pair", sorted(pair)), ("term", sorted(own)[:top])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(ranked)]
    return out


@pytest.mark.parametrize("held,block", [(400_000, 256), (50, 2)])
def test_divergence_against_a_plain_loop(spark, monkeypatch, held, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "COUNTS", 256 if block > 2 else 30)
    draw = random.Random(held)
    vocabulary = ["the", "The", "und", "öl", "ÖL", "漢字", "don't", "x1y", "@", "é_b", "\x00q"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = [(" ".join(draw.choice(vocabulary) for _ in range(draw.randrange(0, 40))), draw.choice(["en", "en", "de", None]), draw.choice(["a", "b", "é", "漢", "z", None])) for _ in range(300)]
    rows += [(None, "xx", "a"), ("", "xx", "b"), ("lonely", "yy", "only"), ("the " * 500, "en", "a")] + rows[:20]
    table = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, total int, term string")
    found = [tuple(r) for r in divergence.audit(table, documents=6, top=7, limit=held).collect()]
    assert sorted(found) == sorted(plain_audit(rows, 6, 7))
    assert divergence.audit(table.limit(0)).count() == 0


def test_shares_are_exact_beyond_doubles():
    draw = random.Random(5)
    for _ in range(300):
        total = draw.randrange(1, 9 * 10**15)
        count = draw.randrange(0, total + 1)
        assert int(divergence.parts(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * count // total
    with pytest.raises(OverflowError):
        divergence.parts(np.array([1]), np.array([2**62]))


def test_quality_on_held_out_documents(spark):
    """Labels of documents that are not learned from are told from the text alone."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    found = quality.classify(some, labels).join(labels, "doc_id").toPandas()
    assert (found.held_out == [zlib.crc32(str(k).encode()) % 5 == 0 for k in found.doc_id]).all()
    test = found[found.held_out]
    good, bad = test[test.quality == 1], test[test.quality == 0]
    pairs = good.score.to_numpy()[:, None] - bad.score.to_numpy()
    assert len(bad) > 80 and ((pairs > 0) + 0.5 * (pairs == 0)).mean() > 0.98
    assert (good.predicted == 1).mean() > 0.99 and (bad.predicted == 0).mean() > 0.9
    # neither labels, languages, sources nor ids of a scored document take part
    moved = some.select((F.col("doc_id") + 10**7).alias("doc_id"), "text", F.lit("zz").alias("lang"), F.lit("s").alias("source"))
    again = quality.score(moved.limit(300), quality.fit(some, labels)).toPandas()
    first = found.set_index("doc_id").score
    assert np.abs(again.score.to_numpy() - first[again.doc_id - 10**7].to_numpy()).max() < 1e-6


def test_votes_are_those_of_all_labelled_vectors():
    """Against a loop over every labelled vector in double precision."""
    draw = random.Random(8)
    texts = [" ".join(draw.choice(["alpha", "beta", "gamma"] if k % 2 else ["ONE!!", "TWO%%", "SIX##"]) for _ in range(30)).encode() for k in range(80)]
    labels = np.array([k % 2 for k in range(80)])
    model = quality.learn([quality.term_counts(t) for t in texts], labels, {0: 0.2, 1: 0.8}, 12, 9)
    for text, score in zip(texts[:20] + [b"", b"x"], quality.votes(model, texts[:20] + [b"", b"x"], block=7)):
        at, weight = quality._weighted(*quality.term_counts(text), model.terms, model.rarity)
        row = weight @ model.projection[at].astype(float)
        size = np.sqrt(row @ row)
        near = sorted(((v.astype(float) @ row / size, y, w) for v, y, w in zip(model.vectors, model.labels, model.weights)), reverse=True)[:9] if size > 0 else []
        votes = [(max(0.0, c) ** 8 * w, y) for c, y, w in near]
        total = sum(v for v, _ in votes)
        assert abs(score - (sum(v * y for v, y in votes) / total if total > 1e-12 else 0.8)) < 1e-4


def test_quality_of_odd_rows(spark, make, monkeypatch):
    monkeypatch.setattr(quality, "PIECE", 64)
    long = "word " * 5000
    docs = make([(k, ("fine text number %d. " % k) * 5 if k % 2 else "JUNK!! %%% " * (k % 5 + 2)) for k in range(40)] + [(50, None), (51, ""), (52, long), (53, "\n \n"), (None, "x"), (1, "again"), (54, "x" * 1000)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(3, None), (None, 1), (5, 7), (999, 1), (2, 1)], "doc_id long, quality int")
    found = quality.classify(docs, labels).toPandas()
    assert len(found) == 47 and found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.3)).all()
    assert not found[found.doc_id.isna()].held_out.any()
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert (quality.classify(docs, labels.limit(0)).toPandas().score == 0.5).all()
    assert (quality.classify(docs, labels.where("quality = 1")).toPandas().score == 1).all()
    ids, counts = quality.term_counts(long.encode())
    assert ids[-1] == quality._REPEATED and counts[-1] > 0.8
