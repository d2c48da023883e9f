"""Near duplicates by SimHash fingerprints and a generalised pigeonhole search.

Bits that vary together are grouped into partitions, each partition gets its own threshold (some of them none at
all), and two fingerprints within the overall distance must agree within the threshold of at least one partition
when the thresholds plus one add up to the distance plus one. The thresholds, and the number of partitions, come
from a dynamic programme over candidate counts that are estimated from the bits of all fingerprints.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.shared import components, roots, saved

BITS = 64
#: Partition counts that are tried; with a distance of 4 none needs a threshold over 2.
PARTITIONS = (2, 3, 4, 5)
MOST = 2


def shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """XXH64 values of all word shingles of a text, repeats included; a short text is one shingle, an empty one none."""
    import xxhash

    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), seed)] if tokens else [], dtype=np.uint64)
    line = memoryview(b" ".join(tokens))
    starts = np.zeros(len(tokens) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1, out=starts[1:])
    ends = (starts[words:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends)), np.uint64, len(ends))


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as an unsigned integer; 0 without hashes."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[at : at + (1 << 15)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def text_fingerprint(text: str | None, words: int, seed: int) -> int:
    """Majority bits of all word shingles of a text, as an unsigned integer."""
    return majority(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, words: int = 5, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of every text as a signed long. A null or empty text, or one of white
    space only, has fingerprint 0; a text with fewer than `words` words is one shingle."""

    def run(batches):
        for batch in batches:
            values = [text_fingerprint(x, words, seed) for x in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": np.array(values, dtype=np.uint64).view(np.int64)})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, fp long")


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together, over all of them."""

    def run(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = batch["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)
            for at in range(0, len(bits), 1 << 16):
                total += bits[at : at + (1 << 16)].T @ bits[at : at + (1 << 16)]
            n += len(bits)
        if n:
            i, j = np.divmod(np.arange(BITS * BITS), BITS)
            yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "n": np.append(total.ravel(), n)})

    rows = distinct.select("fp").mapInPandas(run, "i long, j long, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    counts, n = np.zeros((BITS, BITS)), 0
    for row in rows:
        if row["i"] < 0:
            n = int(row["n"])
        else:
            counts[row["i"], row["j"]] = row["n"]
    return n, counts


def group_bits(n: int, counts: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of about equal width; each group grows by the bit most correlated with its last one,
    so what varies together stands together and the bits of a group form a chain."""
    p = np.diag(counts) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    related = np.abs(counts / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        width = (BITS + k) // parts
        chain = [max(sorted(left), key=lambda b: spread[b])]
        left.remove(chain[0])
        while len(chain) < width:
            chain.append(max(sorted(left), key=lambda b: related[chain[-1], b]))
            left.remove(chain[-1])
        groups.append(chain)
    return groups


def candidate_counts(n: int, counts: np.ndarray, group: list[int]) -> list[float]:
    """Expected pairs that differ in at most 0, 1 .. MOST bits of the group: differences as a Markov chain along it."""
    share = counts / max(n, 1)
    p = np.diag(share)

    def joint(a: int, b: int) -> np.ndarray:
        cells = np.array([[1 - p[a] - p[b] + share[a, b], p[b] - share[a, b]], [p[a] - share[a, b], share[a, b]]]).clip(0)
        out = np.zeros((2, 2))
        for u in (0, 1):
            for v in (0, 1):
                for du in (0, 1):
                    for dv in (0, 1):
                        out[du, dv] += cells[u, v] * cells[u ^ du, v ^ dv]
        return out

    differs = 2 * p[group[0]] * (1 - p[group[0]])
    state = np.zeros((2, MOST + 1))
    state[0, 0], state[1, 1] = 1 - differs, differs
    for a, b in zip(group, group[1:]):
        cell = joint(a, b)
        step = cell / np.maximum(cell.sum(axis=1, keepdims=True), 1e-12)
        state = np.stack([step[0, 0] * state[0] + step[1, 0] * state[1], np.append([0], (step[0, 1] * state[0] + step[1, 1] * state[1])[:-1])])
    return list(np.cumsum(state.sum(axis=0)) * n * n / 2)


def allocate(n: int, counts: np.ndarray, distance: int, parts: int) -> tuple[float, list[tuple[list[int], int]]]:
    """Cheapest thresholds (-1: the group is not probed) with sum(threshold + 1) = distance + 1."""
    groups = group_bits(n, counts, parts)
    best = {0: (0.0, ())}
    for group in groups:
        expected, step = candidate_counts(n, counts, group), {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, min(MOST, distance - used) + 1):
                # a probed row is sorted, moved and grouped, which weighs about as much as twenty comparisons
                more = 0 if t < 0 else expected[t] + 20 * n * sum(math.comb(len(group), r) for r in range(t + 1))
                if used + t + 1 not in step or cost + more < step[used + t + 1][0]:
                    step[used + t + 1] = (cost + more, (*chosen, t))
        best = step
    cost, chosen = best[distance + 1]
    return cost, list(zip(groups, chosen))


def plan_search(n: int, counts: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    return min((allocate(n, counts, distance, m) for m in PARTITIONS if m * (MOST + 1) > distance), key=lambda x: x[0])[1]


def _mask(group: list[int]) -> int:
    return sum(1 << b for b in group)


def probes(distinct: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, fp, away): each fingerprint under its own bits of each probed group (away 0), and under the
    values with a larger number within the threshold (away 1, 2), so each pair of values meets once."""
    live = [(k, np.uint64(_mask(g)), [np.uint64(_mask(c)) for r in range(1, t + 1) for c in combinations(g, r)]) for k, (g, t) in enumerate(plan) if t >= 0]

    def run(batches):
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64).view(np.uint64)
            for k, mask, flips in live:
                own = fp & mask
                yield pd.DataFrame({"part": np.int32(k), "key": own.view(np.int64), "fp": fp.view(np.int64), "away": np.int32(0)})
                for flip in flips:
                    up = (own ^ flip) > own
                    if up.any():
                        yield pd.DataFrame({"part": np.int32(k), "key": (own ^ flip)[up].view(np.int64), "fp": fp[up].view(np.int64), "away": np.int32(int(flip).bit_count())})

    return distinct.select("fp").mapInPandas(run, "part int, key long, fp long, away int")


def _links_in_bucket(rows: pd.DataFrame, distance: int) -> pd.DataFrame:
    """Spanning links of the keys of one bucket: rows are sorted by key, and each row is held against those after
    it under the same key, one step further at a time, so only rows of long keys stay in the later steps."""
    rows = rows.sort_values(["part", "key", "away", "fp"], kind="stable")
    fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
    away = rows["away"].to_numpy()
    new = np.append(True, (np.diff(rows["part"].to_numpy()) != 0) | (np.diff(rows["key"].to_numpy()) != 0))
    firsts = np.flatnonzero(new)
    ends = np.append(firsts[1:], len(fp))[np.cumsum(new) - 1]
    here, step, found = np.flatnonzero((away == 0) & (np.arange(len(fp)) + 1 < ends)), 1, []
    label = np.arange(len(fp))
    held = 0
    while len(here):
        near = np.bitwise_count(fp[here] ^ fp[here + step]) <= distance
        if near.any():
            found.append(np.stack([here[near], here[near] + step]))
            held += int(near.sum())
        if held > 1 << 21:  # forget all but a spanning tree
            edges = np.concatenate(found, axis=1)
            label = roots(len(fp), edges[0], edges[1])
            found, held = [np.stack([np.arange(len(fp)), label])[:, label != np.arange(len(fp))]], 0
        step += 1
        here = here[here + step < ends[here]]
    if not found:
        return pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64)})
    edges = np.concatenate(found, axis=1)
    root = roots(len(fp), edges[0], edges[1])
    moved = np.flatnonzero((root != np.arange(len(fp))) & (fp != fp[root]))
    return pd.DataFrame({"a": fp[moved].view(np.int64), "b": fp[root[moved]].view(np.int64)})


def _hot_links(hot: DataFrame, masks: dict[int, int], distance: int) -> DataFrame:
    """Links under very frequent keys without comparing their rows: two values within the distance share a middle
    value, at most half the distance from either (less for rows that already differ in the key), so each row is
    dealt out under its middle values; under one of those stand only values that link with each other."""

    def run(batches):
        for batch in batches:
            for (part, key, away), rows in batch.groupby(["part", "key", "away"]):
                mask = masks[part]
                free = [np.uint64(1 << b) for b in range(BITS) if not mask >> b & 1]
                fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
                base = (fp & ~np.uint64(mask)) | np.array([key], np.int64).view(np.uint64)[0]
                for r in range(0, distance // 2 - away + 1):
                    for c in combinations(free, r):
                        flip = np.uint64(sum(map(int, c)))
                        yield pd.DataFrame({"part": np.int32(part), "middle": (base ^ flip).view(np.int64), "fp": fp.view(np.int64)})

    dealt = hot.mapInPandas(run, "part int, middle long, fp long")
    groups = dealt.groupBy("part", "middle").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    return groups.select(F.array_min("all").alias("b"), F.explode("all").alias("a")).where("a <> b").select("a", "b").distinct()


def links(distinct: DataFrame, distance: int = 4, hot: int = 16_384, per_bucket: int = 200_000) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints of `distinct` (fp, without repeats) within `distance`
    bits, as spanning trees of what meets under a key: never all pairs of a group."""
    n, counts = bit_counts(distinct)
    plan = plan_search(n, counts, distance)
    rows = saved(probes(distinct, plan), "probes")
    sizes = rows.groupBy("part", "key").count().where(F.col("count") > hot).select("part", "key")
    total = n * sum(sum(math.comb(len(g), r) for r in range(t + 1)) for g, t in plan)
    buckets = max(64, total // per_bucket)
    usual = rows.join(sizes, ["part", "key"], "left_anti").withColumn("bucket", F.pmod(F.xxhash64("part", "key"), F.lit(buckets)))
    near = usual.groupBy("bucket").applyInPandas(lambda x: _links_in_bucket(x, distance), "a long, b long")
    frequent = rows.join(sizes, ["part", "key"], "left_semi")
    return near.unionByName(_hot_links(frequent, {k: _mask(g) for k, (g, _) in enumerate(plan)}, distance))


def near_duplicates(docs: DataFrame, words: int = 5, distance: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints are connected by steps of at most `distance` bits
    share the smallest doc_id of their group.

    Copies meet in an aggregate by fingerprint, so they are never paired. Nulls: a null text counts as empty, a null
    doc_id keeps its row with the smallest non-null id of its group (null if there is none). Repeated rows come back
    as often as they came. An empty table gives an empty result; further columns are ignored.
    """
    prints = saved(fingerprints(docs, words, seed), "fingerprints")
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    near = components(links(groups.select("fp"), distance), "a", "b").withColumnRenamed("node", "fp")
    joined = groups.join(near, "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    lowest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = joined.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")
