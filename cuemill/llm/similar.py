"""Documents of similar word shingles by long SimHash fingerprints.

Fingerprints of several 64-bit words are searched as in `simhash`, but their distance at a similarity is spread around
its mean, so the thresholds are chosen for a recall instead of a certainty: the dynamic programme finds the cheapest
thresholds under which a pair of exactly the asked similarity meets at least once with that probability (more similar
pairs meet more often). What meets and agrees in most bits is only a candidate: within each group of connected
candidates the shingle sets themselves are compared.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm import simhash
from cuemill.llm.shared import components, roots, saved

WORDS64, SEED = 4, 42
#: Texts of at most so many different shingles are also met by their shingles: their fingerprints scatter too much.
SHORT = 64
#: Rows under one key that are compared in one task; more are dealt block against block.
RUN = 16_384
RECALL = 0.98
#: Documents of a candidate group that are compared in one task, at most against as many others.
BLOCK = 512


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes that are independent of the given ones for each k > 0."""
    if not k:
        return hashes
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def long_fingerprints(docs: DataFrame, words: int, short: int) -> DataFrame:
    """(doc_id, w0, w1 .., shingles): WORDS64 fingerprints of each text over different hashes of its distinct shingles, and
    the shingles themselves where there are at most `short` of them."""

    def run(batches):
        for batch in batches:
            out, held = np.zeros((WORDS64, len(batch)), dtype=np.uint64), []
            for i, text in enumerate(batch["text"]):
                hashes = np.unique(simhash.shingle_hashes(text, words, SEED))
                if len(hashes):
                    out[:, i] = [simhash.majority(mixed(hashes, k)) for k in range(WORDS64)]
                held.append(hashes.view(np.int64) if len(hashes) <= short else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64")} | {f"w{k}": out[k].view(np.int64) for k in range(WORDS64)} | {"shingles": held})

    columns = ", ".join(f"w{k} long" for k in range(WORDS64))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInPandas(run, f"doc_id long, {columns}, shingles array<long>")


def bit_rate(similarity: float) -> float:
    """Share of bits that differ at a Jaccard similarity: the angle between the shingle sets."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def plan_recall(stats: list[tuple[int, np.ndarray]], similarity: float, recall: float) -> list[tuple[int, list[int], int]]:
    """(word, bits, threshold) of the partitions to probe, cheapest by estimated candidates for the recall."""
    rate, unit, best = bit_rate(similarity), 0.02, None
    need = math.ceil(-math.log(1 - recall) / unit)
    for parts in (3, 4, 5, 6):
        step = {0: (0.0, ())}
        for word, (n, counts) in enumerate(stats):
            for group in simhash.group_bits(n, counts, parts):
                expected, width, after = simhash.candidate_counts(n, counts, group), len(group), {}
                for t in (-1, 0, 1):
                    meets = sum(math.comb(width, r) * rate**r * (1 - rate) ** (width - r) for r in range(t + 1))
                    gain = int(-math.log(1 - meets) / unit)
                    more = 0 if t < 0 else expected[t] + 20 * n * (1 + t * width / 2)
                    for got, (cost, chosen) in step.items():
                        now = min(need, got + gain)
                        if now not in after or cost + more < after[now][0]:
                            after[now] = (cost + more, (*chosen, (word, group, t)) if t >= 0 else chosen)
                step = after
        if need in step and (best is None or step[need][0] < best[0]):
            best = step[need]
    if best is None:
        raise ValueError("no partition reaches the recall")
    return list(best[1])


def _probes(vertices: DataFrame, plan: list[tuple[int, list[int], int]]) -> DataFrame:
    """(part, key, id, w0, w1, away) as in `simhash.probes`."""
    live = [(k, word, np.uint64(sum(1 << b for b in g)), [np.uint64(1 << b) for b in g] if t else []) for k, (word, g, t) in enumerate(plan)]

    def run(batches):
        for batch in batches:
            ids, w0, w1 = batch["id"].to_numpy(np.int64), batch["w0"].to_numpy(np.int64), batch["w1"].to_numpy(np.int64)
            for k, word, mask, flips in live:
                own = batch[f"w{word}"].to_numpy(np.int64).view(np.uint64) & mask
                for flip in [np.uint64(0), *flips]:
                    up = (own ^ flip) >= own if flip == 0 else (own ^ flip) > own
                    yield pd.DataFrame({"part": np.int32(k), "key": (own ^ flip)[up].view(np.int64), "id": ids[up], "w0": w0[up], "w1": w1[up], "away": np.int32(flip != 0)})

    return vertices.mapInPandas(run, "part int, key long, id long, w0 long, w1 long, away int")


def _candidate_links(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """Spanning links of the rows under the keys of a bucket that differ in at most `most` of 128 bits."""
    rows = rows.sort_values(["part", "key", "away", "id"], kind="stable")
    w0, w1 = rows["w0"].to_numpy(np.int64).view(np.uint64), rows["w1"].to_numpy(np.int64).view(np.uint64)
    ids, away = rows["id"].to_numpy(np.int64), rows["away"].to_numpy()
    new = np.append(True, (np.diff(rows["part"].to_numpy()) != 0) | (np.diff(rows["key"].to_numpy()) != 0))
    ends = np.append(np.flatnonzero(new)[1:], len(ids))[np.cumsum(new) - 1]
    here, step, found, held = np.flatnonzero((away == 0) & (np.arange(len(ids)) + 1 < ends)), 1, [np.zeros((2, 0), np.int64)], 0
    while len(here):
        there = here + step
        near = np.bitwise_count(w0[here] ^ w0[there]).astype(np.int64) + np.bitwise_count(w1[here] ^ w1[there]) <= most
        found.append(np.stack([here[near], there[near]]))
        held += int(near.sum())
        if held > 1 << 21:
            a, b = np.concatenate(found, axis=1)
            label = roots(len(ids), a, b)
            moved = np.flatnonzero(label != np.arange(len(ids)))
            found, held = [np.stack([moved, label[moved]])], 0
        step += 1
        here = here[here + step < ends[here]]
    a, b = np.concatenate(found, axis=1)
    label = roots(len(ids), a, b)
    moved = np.flatnonzero((label != np.arange(len(ids))) & (ids != ids[label]))
    return pd.DataFrame({"a": ids[moved], "b": ids[label[moved]]})


def _similar_in_block(rows: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Spanning links among documents (id, group, side, shingles) of the same group whose sets are similar; with two sides
    only pairs across them are compared."""
    out_a, out_b = [], []
    for _, own in rows.groupby("group", sort=False):
        if len(own) < 2:
            continue
        sets, ids, side = list(own["shingles"]), own["id"].to_numpy(np.int64), own["side"].to_numpy()
        sizes = np.array([len(s) for s in sets])
        values, place = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        common = np.zeros((len(sets), len(sets)), dtype=np.float32)
        order = np.argsort(place, kind="stable")
        place, owner = place[order], owner[order]
        width = max(1, (1 << 22) // len(sets))
        for low in range(0, len(values), width):
            a, b = np.searchsorted(place, [low, low + width])
            part = np.zeros((len(sets), min(width, len(values) - low)), dtype=np.float32)
            part[owner[a:b], place[a:b] - low] = 1
            common += part @ part.T
        near = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-6
        if side.any():
            near &= side[:, None] != side[None, :]
        i, j = np.nonzero(np.triu(near, 1))
        label = roots(len(sets), i, j)
        moved = np.flatnonzero(label != np.arange(len(sets)))
        out_a.append(ids[moved])
        out_b.append(ids[label[moved]])
    none = np.array([], dtype=np.int64)
    return pd.DataFrame({"a": np.concatenate(out_a) if out_a else none, "b": np.concatenate(out_b) if out_b else none})


def short_links(held: DataFrame, similarity: float, n: int) -> DataFrame:
    """(a, b): spanning links of similarity among sets (id, shingles). None is lost: with shingles in one order, rare ones
    first, two similar sets share one of the first that either has to spare. Shingles that many sets begin with are
    compared block against block."""
    least = 1 - similarity + 1e-9
    each = held.select("id", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("texts")).where("texts > 1")
    # a shingle of one text alone leads its order and meets nothing; it takes up its place all the same
    ranked = each.join(often, "shingle", "left").groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("texts", F.lit(1)), "shingle"))).alias("order"))
    first = ranked.select("id", F.explode(F.slice("order", F.lit(1), F.floor(F.col("size") * least).cast("int") + 1)).alias("key")).where("key.col1 > 1").select("id", F.col("key.shingle").alias("key"))
    blocks = first.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("texts")).where("texts > 1").drop("texts")
    dealt = first.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(max(64, n // 20_000)))).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    dealt = dealt.select("id", F.col("key").alias("group"), task.alias("task"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    return dealt.join(held, "id").groupBy("task").applyInPandas(lambda x: _similar_in_block(x, similarity), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = RECALL, per_bucket: int = 200_000) -> DataFrame:
    """(doc_id, component_id): documents connected by steps of a Jaccard similarity of `similarity` or more between their
    sets of word shingles share the smallest doc_id of their group.

    Pairs of which one text has at most `SHORT` different shingles are found without loss. Longer ones are candidates with the probability
    `recall` at exactly that similarity and more often above; what is found is compared exactly. Texts with one and the same long fingerprint count as copies; they meet in an aggregate. Groups of
    more than BLOCK candidates are compared block against block, in as many tasks. Null texts count as empty, and
    documents without words are copies of each other; rows with a null doc_id are left out; repeated rows come back as
    often as they came; an empty table gives an empty result; further columns are ignored.
    """
    named = docs.where("doc_id is not null")
    prints = saved(long_fingerprints(named, words, math.ceil(SHORT / similarity)), "long-fingerprints")
    keys = [f"w{k}" for k in range(WORDS64)]
    vertices = saved(prints.groupBy(*keys).agg(F.min("doc_id").alias("id")), "fingerprint-classes")
    stats = [simhash.bit_counts(vertices.select(F.col(k).alias("fp"))) for k in keys]
    plan, n = plan_recall(stats, similarity, recall), stats[0][0]
    mean = 128 * bit_rate(similarity)
    most = int(mean + 3.5 * math.sqrt(mean * (1 - mean / 128)))
    total = n * sum(1 + t * len(g) // 2 for _, g, t in plan)
    rows = _probes(vertices, plan)
    # keys with more than RUN rows: at most one for each RUN rows there are, usually none, so this table stays small
    long_runs = saved(rows.groupBy("part", "key").count().where(F.col("count") > RUN).select("part", "key", F.ceil(F.col("count") / RUN).cast("int").alias("g")), "long-runs")
    rows = rows.join(long_runs, ["part", "key"], "left").withColumn("g", F.coalesce("g", F.lit(1))).withColumn("i", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    shared = F.pmod(F.xxhash64("part", "key"), F.lit(max(64, total // per_bucket)))
    bucket = F.when(F.col("g") == 1, shared).otherwise(F.xxhash64("part", "key", F.least("i", "j"), F.greatest("i", "j")))
    found = rows.select("part", "key", "id", "w0", "w1", "away", bucket.alias("bucket")).groupBy("bucket").applyInPandas(lambda x: _candidate_links(x, most), "a long, b long")
    groups = saved(components(found, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("group")), "candidate-groups")
    sizes = groups.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))

    def sets(batches):
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "group": batch["group"], "blocks": batch["blocks"], "shingles": [np.unique(simhash.shingle_hashes(x, words, SEED)).view(np.int64) for x in batch["text"]]})

    members = groups.join(sizes, "group")
    texts = named.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(members, "id").dropDuplicates(["id"])
    shingled = texts.select("id", "group", "blocks", "text").mapInPandas(sets, "id long, group long, blocks int, shingles array<long>")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = shingled.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # groups of one block share tasks; larger ones get a task for each pair of their blocks
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("group"), F.lit(max(64, n // 20_000)))).otherwise(F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")))
    dealt = dealt.select("id", "group", task.alias("task"), ((F.col("own") != F.col("other")) & (F.col("own") > F.col("other"))).cast("int").alias("side"), "shingles")
    links = dealt.groupBy("task").applyInPandas(lambda x: _similar_in_block(x, similarity), "a long, b long")
    held = prints.where(F.size("shingles") > 0).select(F.col("doc_id").alias("id"), "shingles").join(vertices.select("id"), "id", "left_semi").dropDuplicates(["id"])
    short = short_links(saved(held, "short-texts"), similarity, n)
    linked = components(links.unionByName(short), "a", "b").select(F.col("node").alias("id"), F.col("component").alias("component_id"))
    classes = vertices.join(linked, "id", "left").select(*keys, F.coalesce("component_id", "id").alias("component_id"))
    return prints.join(classes, keys).select("doc_id", "component_id")
