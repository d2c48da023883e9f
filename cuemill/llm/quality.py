"""Quality of documents by the votes of their nearest labelled neighbours in a latent-semantic space.

Terms are byte pairs and triples of character classes; a document is its logarithmic counts, weighted by rarity, and the
share of words that repeat the word before. The space is spanned by the leading singular vectors of a bounded sample of
labelled documents. Their vectors are broadcast, every document is held against all of them in blocks, and the labels of
the nearest are weighted by a power of their cosine.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a text that are counted at a time.
PIECE = 1 << 20
_PUNCTUATION = string.punctuation
#: Terms: byte pairs, then triples of the 38 classes, then repeated words, then texts without a byte.
_CLASSES = 6 + len(_PUNCTUATION)
_REPEATED = 65536 + _CLASSES**3
_EMPTY = _REPEATED + 1
TERMS = _EMPTY + 1
_KEPT = 1 << 14


def _class_of(byte: int) -> int:
    """Letters by case, digits, blanks, line ends, each mark, the rest."""
    c = chr(byte)
    if byte >= 128 or c in string.ascii_lowercase:
        return 0
    if c in string.ascii_uppercase:
        return 1
    if c in string.digits:
        return 2
    if c == "\n":
        return 3
    if c in string.whitespace:
        return 4
    return 6 + _PUNCTUATION.index(c) if c in _PUNCTUATION else 5


_CLASS = np.array([_class_of(b) for b in range(256)], np.int32)


def _pieces(text: bytes):
    """Pieces of at most `PIECE` bytes, cut after a blank or line end where the piece has one."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            end = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end)) + 1 or end
            end = end if end > at else at + PIECE
        yield np.frombuffer(text, np.uint8, end - at, at)
        at = end


def _repeats(b: np.ndarray) -> tuple[int, int]:
    """Words of a piece, and those that equal the word before (by a 64-bit sum of bytes by place)."""
    blank = (b == 32) | (b == 10)
    begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    if not len(begins):
        return 0, 0
    place = np.arange(len(b)) - np.repeat(begins, np.diff(np.append(begins, len(b)))) if begins[0] == 0 else None
    if place is None:
        b, blank = b[begins[0] :], blank[begins[0] :]
        begins = begins - begins[0]
        place = np.arange(len(b)) - np.repeat(begins, np.diff(np.append(begins, len(b))))
    value = (b.astype(np.uint64) + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))
    value[blank] = 0
    words = np.add.reduceat(value, begins)
    return len(words), int((words[1:] == words[:-1]).sum())


def term_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Terms of a text in order, and their counts; that of repeated words is their share. Long texts are counted piece by
    piece, and pairs, triples and repeats are taken inside a piece."""
    if not text:
        return np.array([_EMPTY]), np.array([1.0])
    parts, words, repeated = [], 0, 0
    for b in _pieces(text):
        c = _CLASS[b]
        pairs = b[:-1].astype(np.int32) * 256 + b[1:]
        triples = 65536 + (c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:]
        parts.append(np.unique(np.concatenate([pairs, triples]), return_counts=True))
        n, r = _repeats(b)
        words, repeated = words + n, repeated + r
    if len(parts) == 1:
        ids, counts = parts[0]
    else:
        ids, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([p[1] for p in parts]))
    if repeated:
        return np.append(ids, _REPEATED), np.append(counts, repeated / words)
    return ids, counts.astype(float)


@dataclass
class Neighbours:
    """Kept terms (in order) with their rarity, the projection (terms x dimensions), unit vectors of the labelled
    documents with their labels and vote weights, the share of label 1 among all labels, and how many vote."""

    terms: np.ndarray
    rarity: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    share: float
    voters: int


def _weighted(ids, counts, terms, rarity) -> tuple[np.ndarray, np.ndarray]:
    """Places among `terms` and weights of one document. The share of repeated words weighs against all other terms
    together, as it is one term among thousands."""
    at = np.minimum(np.searchsorted(terms, ids), len(terms) - 1)
    known = terms[at] == ids
    at, ids, counts = at[known], ids[known], counts[known]
    plain = ids != _REPEATED
    weight = np.log1p(counts) * rarity[at]
    weight[~plain] = counts[~plain] * max(1e-9, np.sqrt((weight[plain] ** 2).sum()))
    return at, weight


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(size > 0, size, 1)


def learn(counted: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, shares: dict[int, float], dimensions: int, voters: int) -> Neighbours:
    """Space and labelled vectors of counted documents. `shares`: the part of each label among all labels; votes are
    weighted so that the sample, which is even, speaks for them."""
    found, seen = np.unique(np.concatenate([c[0] for c in counted]), return_counts=True)
    often = seen >= min(2, len(counted))
    often = often if often.any() else seen > 0
    if often.sum() > _KEPT:
        often &= seen >= np.sort(seen)[-_KEPT]
    terms, rarity = found[often], np.log((1 + len(counted)) / seen[often]) + 1e-3
    table = np.zeros((len(counted), len(terms)), np.float32)
    for row, (ids, counts) in zip(table, counted):
        at, weight = _weighted(ids, counts, terms, rarity)
        row[at] = weight / max(1e-9, np.sqrt((weight**2).sum()))
    values, sides = np.linalg.eigh(table.astype(np.float64) @ table.T)
    order = [k for k in np.argsort(-values)[:dimensions] if values[k] > 1e-6] or [int(np.argmax(values))]
    projection = (table.T @ sides[:, order] / np.sqrt(np.maximum(values[order], 1e-12))).astype(np.float32)
    weights = np.array([shares[int(y)] / max(1e-12, (labels == y).mean()) for y in labels])
    return Neighbours(terms, rarity, projection, _unit(table @ projection), labels.astype(float), weights, shares.get(1, 0.0), min(voters, len(labels)))


def votes(model: Neighbours | None, texts: list[bytes], block: int = 256, power: int = 8) -> np.ndarray:
    """Share of label 1 among the nearest labelled documents of each text, exact cosines against all of them."""
    if model is None:
        return np.full(len(texts), 0.5)
    out = np.full(len(texts), model.share)
    for start in range(0, len(texts), block):
        rows = np.zeros((min(block, len(texts) - start), model.projection.shape[1]), np.float32)
        for row, text in zip(rows, texts[start : start + block]):
            at, weight = _weighted(*term_counts(text), model.terms, model.rarity)
            row[:] = weight.astype(np.float32) @ model.projection[at]
        cosines = _unit(rows) @ model.vectors.T
        near = np.argpartition(-cosines, model.voters - 1, axis=1)[:, : model.voters]
        weight = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** power * model.weights[near]
        total = weight.sum(axis=1)
        some = total > 1e-12
        out[start : start + len(rows)][some] = (weight * model.labels[near]).sum(axis=1)[some] / total[some]
    return out.clip(0, 1).round(9)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 1000, dimensions: int = 48, voters: int = 15) -> Neighbours | None:
    """Model of `labels` (doc_id, quality), from at most `per_label` labelled documents of each label, chosen by hash; that
    bound is the sample's only limit, and label shares are counted over all labels. Held-out documents are not learned
    from, nor are labels that are null or neither 0 nor 1; ids that no document has are passed over. Rows that repeat an
    id count each. Without any labelled document there is no model."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    usable = usable.select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    if not counts:
        return None
    order = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id", "quality"), "doc_id")
    chosen = usable.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_label)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").select("rank", "quality", "doc_id", "text")  # 2 x per_label rows

    def run(batches):
        for batch in batches:
            counted = [term_counts(bytes(x)) for x in batch["text"]]
            rows = {"rank": batch["rank"], "quality": batch["quality"], "doc_id": batch["doc_id"]}
            yield pd.DataFrame(rows | {"ids": [c[0].astype(np.int32) for c in counted], "counts": [c[1].astype(np.float32) for c in counted]})

    found = sample.mapInPandas(run, "rank int, quality int, doc_id long, ids array<int>, counts array<float>").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["quality"], r["rank"], r["doc_id"], r["ids"], r["counts"]))
    total = sum(counts.values())
    return learn(
        [(np.array(r["ids"]), np.array(r["counts"], float)) for r in found],
        np.array([r["quality"] for r in found]), {y: n / total for y, n in counts.items()}, dimensions, voters,
    )


def score(docs: DataFrame, model: Neighbours | None, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from its text alone.

    Null texts count as empty; a text that shares no term with the labelled documents gets the share of label 1 among
    all labels, and 0.5 without a model. A null doc_id is not held out; repeated rows stay; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            value = votes(shared.value, [bytes(x) for x in batch["text"]])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": value, "predicted": (value >= threshold).astype(np.int32)})

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text)
    scored = rows.mapInPandas(run, "doc_id string, held_out boolean, score double, predicted int")
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame, **sample: int) -> DataFrame:
    """`score` with a model fitted on `labels`; only `doc_id` and `quality` of these are read."""
    return score(docs, fit(docs, labels, **sample))
