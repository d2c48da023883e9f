"""Language identification by a bidirectional gated recurrent network over bytes.

The network labels every byte of a text and a document's probabilities are the mean of its bytes'. It is trained in
numpy by backpropagation through time on a bounded sample of labelled documents. Gates and states are piecewise linear,
so that a whole corpus can be read at a few tenths of a microsecond a byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Bytes of a segment; the states of both directions begin at zero in each.
SEGMENT = 96


@dataclass
class Network:
    """Weights: per direction the input table (256 x 3 units: update, reset, candidate) and the recurrent matrix
    (units x 3 units); then the output matrix (2 units x labels) and its offset."""

    labels: list[str]
    tables: list[np.ndarray]
    matrices: list[np.ndarray]
    output: np.ndarray
    offset: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, *self.matrices, self.output, self.offset]


def new_network(labels: list[str], units: int, seed: int) -> Network:
    draw = np.random.default_rng(seed)
    f = np.float32
    tables = [draw.normal(0, 0.3, (256, 3 * units)).astype(f) for _ in range(2)]
    matrices = [draw.normal(0, 0.5 / np.sqrt(units), (units, 3 * units)).astype(f) for _ in range(2)]
    return Network(labels, tables, matrices, draw.normal(0, 0.3, (2 * units, len(labels))).astype(f), np.zeros(len(labels), f))


def states(table: np.ndarray, matrix: np.ndarray, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of one direction (time x segments x units) for codes (time x segments); `keep` gets what training needs."""
    units = len(matrix)
    out = np.empty((*codes.shape, units), np.float32)
    h = np.zeros((codes.shape[1], units), np.float32)
    gates_matrix, state_matrix = np.ascontiguousarray(matrix[:, : 2 * units]), np.ascontiguousarray(matrix[:, 2 * units :])
    for t in range(len(codes)):
        x = table.take(codes[t], axis=0)
        gates = h @ gates_matrix
        gates += x[:, : 2 * units]
        gates *= 0.25
        gates += 0.5
        open_gates = np.clip(gates, 0, 1)
        z, r = open_gates[:, :units], open_gates[:, units:]
        rh = r * h
        c = rh @ state_matrix
        c += x[:, 2 * units :]
        new = np.clip(c, -1, 1)
        if keep is not None:
            keep.append((h, gates, open_gates, rh, c, new))
        new = new - h
        new *= z
        h = np.add(h, new, out=out[t])
    return out


def _back(table, matrix, codes, keep, slope):
    """Gradients of one direction; slope: of the loss by each state (time x segments x units)."""
    units = len(matrix)
    g_table, g_matrix = np.zeros_like(table), np.zeros_like(matrix)
    down = np.zeros_like(slope[0])
    for t in range(len(codes) - 1, -1, -1):
        h, gates, opened, rh, c, new = keep[t]
        z, r = opened[:, :units], opened[:, units:]
        d = slope[t] + down
        d_c = d * z * ((c > -1) & (c < 1))
        d_z = d * (new - h)
        d_rh = d_c @ matrix[:, 2 * units :].T
        d_gates = np.concatenate([d_z, d_rh * h], axis=1) * ((gates > 0) & (gates < 1)) * np.float32(0.25)
        down = d * (1 - z) + d_rh * r + d_gates @ matrix[:, : 2 * units].T
        g_matrix[:, : 2 * units] += h.T @ d_gates
        g_matrix[:, 2 * units :] += rh.T @ d_c
        np.add.at(g_table, codes[t], np.concatenate([d_gates, d_c], axis=1))
    return g_table, g_matrix


def probabilities(net: Network, codes: np.ndarray) -> np.ndarray:
    """Label probabilities of every position (time x segments x labels) for codes (time x segments)."""
    ahead = states(net.tables[0], net.matrices[0], codes)
    back = states(net.tables[1], net.matrices[1], codes[::-1])[::-1]
    units = ahead.shape[2]
    scores = ahead.reshape(-1, units) @ net.output[:units]
    scores += np.ascontiguousarray(back).reshape(-1, units) @ net.output[units:]
    scores += net.offset
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores.reshape(*codes.shape, -1)


def train(segments: np.ndarray, truth: np.ndarray, labels: list[str], units: int, rounds: int, seed: int, batch: int = 128) -> Network:
    """Adam on the mean cross entropy of all positions. segments: (n x time) bytes; truth: label numbers."""
    net, draw = new_network(labels, units, seed), np.random.default_rng(seed + 1)
    weights = net.parameters()
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    total = rounds * -(-len(segments) // batch)
    for _ in range(rounds):
        order = draw.permutation(len(segments))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            codes = np.ascontiguousarray(segments[pick].T)
            keeps = [[], []]
            ahead = states(net.tables[0], net.matrices[0], codes, keeps[0])
            back = states(net.tables[1], net.matrices[1], codes[::-1], keeps[1])[::-1]
            both = np.concatenate([ahead, back], axis=2)
            scores = both @ net.output + net.offset
            scores -= scores.max(axis=2, keepdims=True)
            p = np.exp(scores)
            p /= p.sum(axis=2, keepdims=True)
            p[:, np.arange(len(pick)), truth[pick]] -= 1
            p /= p.shape[0] * p.shape[1]
            d = p @ net.output.T
            g = [
                _back(net.tables[0], net.matrices[0], codes, keeps[0], d[:, :, :units]),
                _back(net.tables[1], net.matrices[1], codes[::-1], keeps[1], d[::-1, :, units:]),
            ]
            flat = both.reshape(-1, 2 * units)
            slopes = [g[0][0], g[1][0], g[0][1], g[1][1], flat.T @ p.reshape(-1, len(labels)), p.sum(axis=(0, 1))]
            size = np.sqrt(sum(float((s * s).sum()) for s in slopes))
            step += 1
            rate = 0.02 * (1 - 0.9 * step / total)
            for w, s, m, v in zip(weights, slopes, first, second):
                s = s / max(1.0, size)
                m += 0.1 * (s - m)
                v += 0.01 * (s * s - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in segments (n x SEGMENT, filled up with spaces), the text of each segment and its own bytes."""
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    parts = np.maximum(1, -(-sizes // SEGMENT))
    owner = np.repeat(np.arange(len(texts)), parts)
    codes = np.full(int(parts.sum()) * SEGMENT, 32, np.uint8)
    starts = (np.cumsum(parts) - parts) * SEGMENT
    for x, at in zip(texts, starts):
        codes[at : at + len(x)] = np.frombuffer(x, np.uint8)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    own = np.minimum(SEGMENT, sizes[owner] - number * SEGMENT)
    return codes.reshape(-1, SEGMENT), owner, own


def pooled(net: Network, texts: list[bytes], batch: int = 4096) -> np.ndarray:
    """Mean label probabilities over all bytes of each text (texts x labels)."""
    codes, owner, own = cut(texts)
    total = np.zeros((len(texts), len(net.labels)))
    for at in range(0, len(codes), batch):
        p = probabilities(net, np.ascontiguousarray(codes[at : at + batch].T))
        short = np.flatnonzero(own[at : at + batch] < SEGMENT)
        for k in short:
            p[max(0, own[at + k]) :, k] = 0
        np.add.at(total, owner[at : at + batch], p.sum(axis=0, dtype=np.float64))
    return total / np.maximum(1, np.array([len(x) for x in texts]))[:, None]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, per_label: int = 320, chars: int = 480, units: int = 8, rounds: int = 8, seed: int = 7) -> Network | None:
    """Network of the labels of `docs` (doc_id, text, lang), from at most `per_label` documents of each label, chosen by
    hash, and `chars` characters of each from a place chosen by hash. These bounds are the sample's only limits. Held-out
    documents, null labels and texts without letters are not learned from; without any labelled text there is no model."""
    text = F.col("text").cast("string")
    pool = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & has_letter(text))
    # By hash, about four times as many as wanted of each label, before any are moved: a frequent label stays cheap. One
    # number for each label, of which the network has an output each, is known to the driver.
    sizes = {r["lang"]: r["count"] for r in pool.groupBy("lang").count().collect()}
    if not sizes:
        return None
    limits = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, 4.0 * per_label * (1 << 30) / n)])
    pool = pool.where(F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(1 << 30)) < limits[F.col("lang")])
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.char_length(text) - chars)).cast("int") + 1
    slices = pool.select("lang", F.xxhash64("doc_id").alias("_h"), F.col("doc_id").alias("_d"), text.substr(start, F.lit(chars)).alias("_t"))
    order = Window.partitionBy("lang").orderBy("_h", "_d", "_t")
    sample = slices.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_label).select("lang", "_t", "_k").collect()
    if not sample:
        return None
    sample.sort(key=lambda r: (r["lang"], r["_k"]))
    labels = sorted({r["lang"] for r in sample})
    codes, owner, own = cut([r["_t"].encode("utf-8", "replace") for r in sample])
    full = own >= SEGMENT // 4
    truth = np.array([labels.index(r["lang"]) for r in sample])[owner]
    return train(codes[full] if full.any() else codes, truth[full] if full.any() else truth, labels, units, rounds, seed)


def label(net: Network | None, texts: list[str | None], letters: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Label and score of each text; a few megabytes are read at a time, whatever the list holds."""
    lang, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
    known = [i for i, x in enumerate(letters) if x] if net else []
    at = 0
    while at < len(known):
        rows, held = [], []
        while at < len(known) and sum(map(len, held)) < 1 << 21:
            rows.append(known[at])
            held.append(texts[known[at]].encode("utf-8", "replace"))
            at += 1
        p = pooled(net, held)
        lang[rows] = np.array(net.labels, dtype=object)[p.argmax(axis=1)]
        score[rows] = p.max(axis=1).clip(0, 1)
    return lang, score


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row from its text alone: the label with the largest mean probability
    over all bytes, and that mean. Null texts and texts without a letter are `und` with score 0, as is everything without
    a model. A null doc_id is not held out; repeated rows stay; an empty table stays empty."""

    def run(batches):
        for batch in batches:
            lang, score = label(net, list(batch["text"]), list(batch["letters"]))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "lang_pred": lang, "score": score})

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), has_letter(text).alias("letters"), text.alias("text"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, net: Network | None, over_chance: float = 1.2) -> DataFrame:
    """The rows of `docs`, with their columns, whose language is told: texts that are null or without a letter go, and those
    whose score is not even `over_chance` times that of a guess. Short texts score low and stay. Without a model (nothing
    labelled to learn from) everything with a letter stays."""
    import pyarrow as pa

    least = over_chance / len(net.labels) if net and len(net.labels) > 1 else 0.0
    at, row = docs.columns.index("text"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])

    def run(batches):
        for batch in batches:
            letters = batch.column(1).to_pylist()
            _, score = label(net, batch.column(0).field(at).to_pylist(), letters)
            yield batch.filter(pa.array(np.array(letters, dtype=bool) & (score >= least), pa.bool_()))

    rows = docs.select(row.alias("row"), has_letter(F.col("text").cast("string")).alias("letters"))
    return rows.mapInArrow(run, rows.schema).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def identify(docs: DataFrame, **sample: int) -> DataFrame:
    """`predict` with a network fitted on the labelled part of `docs`. The labels are those of `lang` alone; nothing else
    of a row but its text takes part in its prediction."""
    return predict(docs, fit(docs, **sample))
