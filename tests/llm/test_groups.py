"""Near-duplicate jobs against all pairs."""

import re

import numpy as np
import pandas as pd
import xxhash

from cuemill.llm import similar, simhash, vectors
from cuemill.llm.shared import components


def closure(n, pairs):
    label = list(range(n))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        label[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def plain_fingerprint(text, words=4):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)] or ([" ".join(tokens)] if tokens else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_of_random_graphs(spark):
    draw = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in draw.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 440)] + [(500, x) for x in range(501, 560)]
    found = components(spark.createDataFrame([*pairs, (7, None)], "a long, b long"), "a", "b").toPandas().set_index("node").component
    expected = closure(600, pairs)
    assert {n: c for n, c in found.items()} == {n: expected[n] for p in pairs if p[0] != p[1] for n in p}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_simhash_groups_of_all_documents(small):
    rows = small.toPandas().sort_values("doc_id").reset_index(drop=True)
    found = simhash.near_duplicates(small, words=4).toPandas().set_index("doc_id").sort_index()
    prints = np.array([plain_fingerprint(t) for t in rows.text], dtype=np.uint64)
    assert (found.fp.to_numpy().view(np.uint64) == prints).all()
    near = np.argwhere(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4, 1))
    assert found.component_id.tolist() == [rows.doc_id[k] for k in closure(len(rows), near)]


def test_pigeonhole_search_loses_nothing(spark):
    draw = np.random.default_rng(3)
    centres = draw.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in draw.choice(64, draw.integers(0, 6), replace=False)) for _ in range(400)]
    prints = np.unique(np.array([int(centres[i % 60]) ^ f for i, f in enumerate(flips)], dtype=np.uint64))
    df = spark.createDataFrame(pd.DataFrame({"fp": prints.view(np.int64)}))
    near = np.argwhere(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4, 1))
    expected = closure(len(prints), near)
    place = {int(p): i for i, p in enumerate(prints.view(np.int64))}
    for hot in (16_384, 3):  # 3: nearly every key with company takes the way of very frequent keys
        links = simhash.links(df, 4, hot=hot).toPandas()
        assert closure(len(prints), [(place[a], place[b]) for a, b in zip(links.a, links.b)]) == expected


def test_simhash_edge_rows(make):
    rows = [(5, None), (3, ""), (9, " \t"), (None, ""), (1, "one two"), (1, "one two"), (2, "ONE two"), (None, "a b c d e f"), (8, "x " * 30_000)]
    found = simhash.near_duplicates(make(rows), words=4).toPandas()
    assert len(found) == len(rows)
    groups = found[found.doc_id.notna()].groupby("doc_id").component_id.first().to_dict()
    assert groups == {5: 3, 3: 3, 9: 3, 1: 1, 2: 1, 8: 8}
    assert simhash.near_duplicates(make([])).count() == 0


def test_similar_documents_against_all_pairs(small, make):
    rows = small.toPandas().sort_values("doc_id").reset_index(drop=True)
    found = similar.near_duplicates(small).toPandas().set_index("doc_id").component_id
    sets = [set(simhash.shingle_hashes(t, 5, 42).tolist()) for t in rows.text]
    near = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert found.sort_index().tolist() == [rows.doc_id[k] for k in closure(len(rows), near)]
    edge = similar.near_duplicates(make([(4, None), (2, ""), (7, "a b"), (7, "a b"), (None, "a b")])).toPandas()
    assert sorted(map(tuple, edge.to_numpy().tolist())) == [(2, 2), (4, 2), (7, 7), (7, 7)]
    assert similar.near_duplicates(make([])).count() == 0


def test_large_candidate_groups_meet_block_by_block(make, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 8)
    monkeypatch.setattr(similar, "RUN", 8)
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(base[: 100 + k] + [f"own{k}"] + base[100 + k :])) for k in range(40)] + [(90, "something else entirely " * 9)]
    found = similar.near_duplicates(make(rows)).toPandas().set_index("doc_id").component_id
    assert found[90] == 90 and set(found.drop(90)) == {0}


def test_recall_of_probes_at_the_limit():
    draw = np.random.default_rng(2)
    x = vectors._unit(draw.normal(size=(6000, 64)))
    z = draw.normal(size=x.shape)
    z = vectors._unit(z - (z * x).sum(axis=1, keepdims=True) * x)
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * z
    index = vectors.Index(x, 60)
    probes = index.probes(x[:2000], vectors.nearest(x[:2000], index.centres), np.sqrt(0.1) * vectors.DEVIATIONS / 8)
    there = vectors.nearest(y[:2000], index.centres)
    assert np.mean([b in p for b, p in zip(there, probes)]) > 0.99 and np.mean([len(p) for p in probes]) < 30


def test_vectors_against_all_pairs(spark):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(40, 16))
    rows = [(i, [float(v) for v in centres[i % 40] + draw.normal(scale=0.12, size=16)]) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(50)] + [(2000, [2.0 * v for v in rows[0][1]]), (7, rows[7][1])]
    odd = [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] * 16), (3004, [None] + [1.0] * 15), (3005, [float("inf")] + [1.0] * 15), (None, rows[0][1]), (3006, [1.0, 0.0]), (3007, [5.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd], "vec_id long, embedding array<double>, list string, label int")
    found = vectors.near_duplicates(df).toPandas()
    assert len(found) == len(rows) + len(odd)
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    ids = [i for i, _ in rows]
    order = np.argsort(ids, kind="stable")
    place = {k: p for p, k in enumerate(order)}
    top = closure(len(rows), [(place[a], place[b]) for a, b in np.argwhere(np.triu(near, 1))])
    expected = sorted((ids[k], int(near[k].sum()), ids[order[top[place[k]]]]) for k in range(len(rows)))
    got = found[found.vec_id.notna() & (found.vec_id < 3000)]
    assert sorted(zip(got.vec_id.astype(int), got.n_links, got.component_id.astype(int))) == expected
    rest = found[found.vec_id >= 3000].set_index("vec_id")
    assert rest.n_links.to_dict() == {k: int(k in (3006, 3007)) for k in range(3000, 3008)} and rest.kept.to_dict()[3007] == False  # noqa: E712
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_no_link_of_low_rank_vectors_is_lost_beside_a_longer_one(spark):
    draw = np.random.default_rng(8)
    x = vectors._unit(draw.normal(size=(3000, 6)) @ draw.normal(size=(6, 128)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i, x[i % 3000].tolist()) for i in range(3000, 3200)] + [(9000, [1.0] * 1024)]
    found = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas().set_index("vec_id")
    y = np.concatenate([x, x[:200]])
    near = y @ y.T >= 0.95
    assert near.sum() > 5000 and found.loc[range(3200)].n_links.tolist() == (near.sum(axis=1) - 1).tolist() and found.n_links[9000] == 0
    near[np.diag_indices(3200)] = False
    assert found.loc[range(3200)].component_id.tolist() == closure(3200, np.argwhere(np.triu(near, 1)))
