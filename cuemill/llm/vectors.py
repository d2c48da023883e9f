"""Near-duplicate vectors by product quantisation over inverted lists.

Unit vectors are assigned to the nearest of some centroids and their residuals are coded by subspace; both codebooks
are fitted on a bounded sample, and every vector is indexed. With a the nearest centroid of a vector and b another, the
list of b can only hold a neighbour if the distances of both from the plane between a and b add up to no more than the
distance, so one of the two is within half of it. A vector searches the lists whose planes are within half the distance;
a link that only one end finds counts for both, so none is lost in any number of components. In a list, distances to the
coded vectors come from tables; those within the distance plus the coded vector's own error, which loses nothing either,
are held against the vectors themselves in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.llm.shared import components, roots, saved

#: Vectors that the codebooks are fitted on at most, chosen by hash, and the bounds of the index.
SAMPLE, MOST_LISTS, PER_LIST = 16_384, 4096, 256
SUBSPACES, CODES = 8, 256
#: Standard deviations of a random direction's share along a plane's normal within half a distance, for 64 components;
#: probes do not depend on it.
DEVIATIONS = 4.0
DATA_BLOCK, QUERY_BLOCK = 2048, 4096


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    half = (centres * centres).sum(axis=1) / 2
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = (half - x[at : at + 4096] @ centres.T).argmin(axis=1)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """At most k centres; fewer if there are fewer different rows."""
    draw = np.random.default_rng(seed)
    different = np.unique(x, axis=0)
    centres = different[draw.permutation(len(different))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        sums, sizes = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


class Index:
    """Centroids (lists x width) and subspace codebooks of the residuals, over zero-filled unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 5):
        self.width = sample.shape[1]
        self.centres = kmeans(sample, lists, 8, seed)
        rest = sample - self.centres[nearest(sample, self.centres)]
        self.cuts = np.linspace(0, self.width, min(SUBSPACES, self.width) + 1).astype(int)
        self.books = [kmeans(np.ascontiguousarray(rest[:, a:b]), CODES, 6, seed + 1) for a, b in zip(self.cuts, self.cuts[1:])]

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n x subspaces) and the distance of each vector from what its codes stand for."""
        rest = x - self.centres[own]
        codes = np.empty((len(x), len(self.books)), dtype=np.uint8)
        error = np.zeros(len(x))
        for m, book in enumerate(self.books):
            part = np.ascontiguousarray(rest[:, self.cuts[m] : self.cuts[m + 1]])
            codes[:, m] = nearest(part, book)
            error += ((part - book[codes[:, m]]) ** 2).sum(axis=1)
        return codes, np.sqrt(error)

    def probes(self, x: np.ndarray, own: np.ndarray, reach: float) -> list[np.ndarray]:
        """Lists that can hold a vector within `reach` of each of x, its own included, in order."""
        norms = (self.centres**2).sum(axis=1)
        out = []
        for at in range(0, len(x), 1024):
            rows, a = x[at : at + 1024], own[at : at + 1024]
            far = norms - 2 * rows @ self.centres.T
            far -= far[np.arange(len(rows)), a][:, None]
            between = np.sqrt(np.maximum(0, norms[a][:, None] + norms - 2 * self.centres[a] @ self.centres.T))
            out += [np.flatnonzero(row) for row in far <= 2 * reach * between + 1e-9]
        return out

    def tables(self, x: np.ndarray, list_: int) -> np.ndarray:
        """Squared distances from each of x to every code of each subspace (n x subspaces x codes)."""
        rest = x - self.centres[list_]
        out = np.full((len(x), len(self.books), CODES), np.inf, dtype=np.float32)
        for m, book in enumerate(self.books):
            part = rest[:, self.cuts[m] : self.cuts[m + 1]]
            out[:, m, : len(book)] = np.maximum(0, (part**2).sum(axis=1)[:, None] + (book**2).sum(axis=1) - 2 * part @ book.T)
        return out


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled first so that neither huge nor tiny components overflow."""
    x = raw / np.abs(raw).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _rows(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def usable(embedding: Column) -> Column:
    """Whether a vector can link: not null, no null or non-finite component, not zero."""
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(embedding, lambda v: v != 0), F.lit(False))


def _meet(index: Index, cosine: float):
    reach = np.sqrt(max(0.0, 2 - 2 * cosine))

    def run(key, held: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": np.array([], np.int64), "b": pd.array([], "Int64"), "n": np.array([], np.int64)})
        if not len(held) or not len(asks):
            return none
        y, x = _unit(_rows(held["embedding"], index.width)), _unit(_rows(asks["embedding"], index.width))
        codes = np.frombuffer(b"".join(held["codes"]), np.uint8).reshape(len(held), -1)
        limit = (reach + held["error"].to_numpy() + 1e-4) ** 2
        y_ids, x_ids = held["vec_id"].to_numpy(np.int64), asks["vec_id"].to_numpy(np.int64)
        y_copies, x_copies, x_own = held["copies"].to_numpy(np.int64), asks["copies"].to_numpy(np.int64), asks["own"].to_numpy(np.int64)
        lists = len(index.centres)
        back = np.repeat(np.arange(len(y)), [len(p) for p in held["probes"]]) * lists + np.concatenate(list(held["probes"]))  # in order
        counts, y_counts, pairs, kept = np.zeros(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64), [], 0
        label = np.arange(len(x) + len(y))
        for at in range(0, len(x), 256):
            lookup = index.tables(x[at : at + 256], key[1])
            far = lookup[:, 0, :].take(codes[:, 0], axis=1)
            for m in range(1, codes.shape[1]):
                far += lookup[:, m, :].take(codes[:, m], axis=1)
            i, j = np.nonzero(far <= limit)
            i += at
            near = np.empty(len(i), dtype=bool)
            for k in range(0, len(i), 1 << 16):
                near[k : k + (1 << 16)] = np.einsum("ij,ij->i", x[i[k : k + (1 << 16)]], y[j[k : k + (1 << 16)]]) >= cosine
            near &= x_ids[i] != y_ids[j]
            i, j = i[near], j[near]
            counts += np.bincount(i, weights=y_copies[j], minlength=len(x)).astype(np.int64)
            # a held vector that does not search the asker's list will not find the link itself
            asked = j * lists + x_own[i]
            once = back[np.minimum(np.searchsorted(back, asked), len(back) - 1)] != asked
            y_counts += np.bincount(j[once], weights=x_copies[i[once]], minlength=len(y)).astype(np.int64)
            pairs.append(np.stack([i, j + len(x)]))
            kept += len(i)
            if kept > 1 << 20:  # forget all but a spanning tree
                ends = np.concatenate(pairs, axis=1)
                label = roots(len(label), ends[0], ends[1])
                pairs, kept = [np.stack([np.arange(len(label)), label])[:, label != np.arange(len(label))]], 0
        ends = np.concatenate(pairs, axis=1)
        root, ids = roots(len(label), ends[0], ends[1]), np.concatenate([x_ids, y_ids])
        moved = np.flatnonzero((root != np.arange(len(root))) & (ids != ids[root]))
        counts = np.concatenate([counts, y_counts])
        linked = np.flatnonzero(counts)
        return pd.DataFrame({"a": np.concatenate([ids[moved], ids[linked]]), "b": pd.array([*ids[root[moved]], *[None] * len(linked)], "Int64"), "n": np.concatenate([np.zeros(len(moved), np.int64), counts[linked]])})

    return run


def linked(distinct: DataFrame, cosine: float) -> DataFrame:
    """(a, b, n) over `distinct` (vec_id, embedding, copies): rows with b are links, enough of them to connect what is
    linked; rows without b say that n vectors, copies counted, are linked with a, and add up over its rows."""
    n, width = distinct.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return distinct.sparkSession.createDataFrame([], "a long, b long, n long")
    sample = distinct.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()
    fitted = _unit(_rows(pd.Series([r[0] for r in sample]), width))
    index = Index(fitted, int(min(MOST_LISTS, max(1, n // PER_LIST), max(1, len(sample) // 4))))
    half = float(np.sqrt(max(0.0, 2 - 2 * cosine))) / 2

    def assign(batches):
        for batch in batches:
            for at in range(0, len(batch), 8192):
                rows = batch.iloc[at : at + 8192]
                x = _unit(_rows(rows["embedding"], index.width))
                own = nearest(x, index.centres)
                codes, error = index.encode(x, own)
                yield pd.DataFrame({"vec_id": rows["vec_id"], "copies": rows["copies"], "embedding": rows["embedding"], "size": rows["embedding"].map(len), "list": own, "codes": [c.tobytes() for c in codes], "error": error, "probes": index.probes(x, own, half)})

    kind = dict(distinct.dtypes)["embedding"]
    coded = saved(distinct.select("vec_id", "copies", "embedding").mapInPandas(assign, f"vec_id long, copies long, embedding {kind}, size int, list int, codes binary, error double, probes array<int>"), "coded-vectors")
    asks = coded.select("vec_id", "copies", "embedding", "size", F.col("list").alias("own"), F.explode("probes").alias("list"))
    # at most MOST_LISTS rows for each vector size: how many blocks a list's vectors and its askers are dealt into
    held = coded.groupBy("size", "list").agg(F.ceil(F.count("*") / DATA_BLOCK).cast("int").alias("held"))
    blocks = saved(held.join(asks.groupBy("size", "list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("asked")), ["size", "list"]), "list-blocks")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        sized = rows.join(blocks, ["size", "list"]).withColumn(f"_{own}", F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int"))
        return sized.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop(own, other)

    keys = ["size", "list", "_held", "_asked"]
    left, right = dealt(coded, "held", "asked"), dealt(asks, "asked", "held")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own beside those of `left`
    return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(_meet(index, cosine), "a long, b long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept): every row with the number of other rows whose cosine with it is `cosine` or
    more, and the smallest vec_id reachable over such links.

    Equal vectors meet in an aggregate by a 128-bit hash and search once. Vectors that are null, empty or zero, or hold
    null or non-finite components, and rows with a null vec_id, link with nothing and are kept. Only vectors with the
    same number of components are compared. Repeated rows count as so many vectors and come back as often; an empty
    table gives an empty result; further columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = rows.withColumn("ok", usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.withColumn("h1", F.when(F.col("ok"), F.xxhash64("embedding"))).withColumn("h2", F.when(F.col("ok"), F.xxhash64(F.lit(1), "embedding")))
    groups = saved(rows.where("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding")), "vector-classes")
    found = saved(linked(groups.select(F.col("first").alias("vec_id"), "embedding", "copies"), cosine), "vector-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("first")).agg(F.sum("n").alias("n"))
    near = components(found.where("b is not null"), "a", "b").withColumnRenamed("node", "first")
    classes = groups.select("h1", "h2", "first", "copies").join(counts, "first", "left").join(near, "first", "left")
    per_class = classes.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    out = rows.select("vec_id", "h1", "h2").join(per_class, ["h1", "h2"], "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))
