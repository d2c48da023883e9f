"""Line deduplication that can be taken back: sharded cuckoo filters over exact reference tables.

The reference table has a row for each document and each of its long lines (as a 128-bit key). Keys referenced by
enough documents are frequent; each shard's cuckoo filter holds the frequent keys of the shard, so most lines are
known to stay without looking them up, and the exact table decides the rest. Inserting or deleting documents adds or
removes reference rows and moves only the keys that cross the threshold into or out of the filters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.llm.shared import ASCII_SPACE, Carried, ascii_lower, saved

MIN_CHARS, MIN_DOCS = 40, 5
#: References of a shard that one filter screens, and of those in one task.
SHARD, TASK = 2_000_000, 250_000
SLOTS, KICKS = 4, 500
KEY = ["k1", "k2"]


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; a key has two buckets, either of which follows from the other and
    the fingerprint, so keys can move and be deleted. Never says no to a key that it holds."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / SLOTS / 0.8))))
        return cls(np.zeros((buckets, SLOTS), dtype=np.uint16))

    @classmethod
    def loads(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, dtype="<u2").reshape(-1, SLOTS).copy())

    def dumps(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def _places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        print_ = (k2.astype(np.int64).view(np.uint64) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (k1.astype(np.int64).view(np.uint64) % np.uint64(len(self.table))).astype(np.int64)
        return print_, first, self._other(first, print_)

    def _other(self, bucket, print_):
        return bucket ^ (np.asarray(print_, dtype=np.int64) * 0x5BD1E995 % len(self.table))

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        print_, first, second = self._places(k1, k2)
        return (self.table[first] == print_[:, None]).any(axis=1) | (self.table[second] == print_[:, None]).any(axis=1)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """False if a key found no place; the filter is then to be built larger from the exact table."""
        draw = np.random.default_rng(len(self.table))
        for p, a, b in zip(*self._places(k1, k2)):
            for bucket in (a, b):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = p
                    break
            else:
                bucket = a
                for _ in range(KICKS):
                    slot = draw.integers(SLOTS)
                    p, self.table[bucket, slot] = self.table[bucket, slot], p
                    bucket = self._other(bucket, p)
                    free = np.flatnonzero(self.table[bucket] == 0)
                    if len(free):
                        self.table[bucket, free[0]] = p
                        break
                else:
                    return False
        return True

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        for p, a, b in zip(*self._places(k1, k2)):
            for bucket in (a, b):
                held = np.flatnonzero(self.table[bucket] == p)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break

    @classmethod
    def of(cls, k1: np.ndarray, k2: np.ndarray) -> CuckooFilter:
        size = len(k1)
        while True:
            made = cls.sized(size)
            if made.insert(k1, k2):
                return made
            size = 2 * size + SLOTS


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def key_hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(1), key).alias("k2"))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


@dataclass(frozen=True)
class LineIndex:
    """references (doc_id, shard, k1, k2), counts (shard, k1, k2, n_docs, keep_doc), filters (shard, filter)."""

    references: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, k1, k2): each document row and each different key of its lines with at least `min_chars` code points."""
    keys = F.filter(F.transform(text_lines(F.col("text")), line_key), lambda k: F.char_length(k) >= min_chars)
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array_distinct(F.transform(keys, key_hashes))).alias("key"))
    return held.select("doc_id", "key.k1", "key.k2")


def _sharded(refs: DataFrame, shards: int) -> DataFrame:
    return refs.select("doc_id", F.pmod("k1", F.lit(shards)).cast("int").alias("shard"), *KEY)


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("shard", *KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keep_doc"))


def _filters(frequent: DataFrame) -> DataFrame:
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter.of(rows["k1"].to_numpy(), rows["k2"].to_numpy())
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "filter": [made.dumps()]})

    return frequent.select("shard", *KEY).groupBy("shard").applyInPandas(build, "shard int, filter binary")


def build_index(docs: DataFrame, shards: int | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
    """Index of a corpus, of one shard for each `SHARD` references there are (64 at least) unless `shards` says else."""
    refs = saved(references(docs, min_chars), "line-references")
    shards = shards or max(64, -(-refs.count() // SHARD))
    refs = _sharded(refs, shards)
    counts = saved(_counted(refs).where(F.col("n_docs") >= min_docs), "line-counts")
    return LineIndex(refs, counts, saved(_filters(counts), "line-filters"), shards, min_docs)


def _changed(index: LineIndex, refs: DataFrame, touched: DataFrame) -> LineIndex:
    """Index after the references became `refs`; only keys of `touched` (shard, k1, k2) are counted again."""
    touched = touched.select("shard", *KEY).distinct()
    fresh = saved(_counted(refs.join(touched, ["shard", *KEY], "left_semi")).where(F.col("n_docs") >= index.min_docs), "line-counts")
    old = index.counts.join(touched, ["shard", *KEY], "left_semi").select("shard", *KEY)
    new = fresh.select("shard", *KEY)
    moves = new.join(old, ["shard", *KEY], "left_anti").withColumn("added", F.lit(True)).unionByName(old.join(new, ["shard", *KEY], "left_anti").withColumn("added", F.lit(False)))
    counts = saved(index.counts.join(touched, ["shard", *KEY], "left_anti").unionByName(fresh), "line-counts")

    def move(held: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        shard = (held if len(held) else rows)["shard"].iloc[0]
        filter_ = CuckooFilter.loads(held["filter"].iloc[0]) if len(held) else CuckooFilter.sized(len(rows))
        gone, added = rows[~rows["added"].astype(bool)], rows[rows["added"].astype(bool)]
        filter_.delete(gone["k1"].to_numpy(), gone["k2"].to_numpy())
        fits = filter_.insert(added["k1"].to_numpy(), added["k2"].to_numpy())
        return pd.DataFrame({"shard": [shard], "filter": [filter_.dumps() if fits else None]})

    moved = saved(index.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(move, "shard int, filter binary"), "line-filters")
    full = moved.where("filter is null").select("shard")  # these no longer fit: built anew from the exact table
    filters = moved.where("filter is not null").unionByName(_filters(counts.join(full, "shard", "left_semi")))
    return LineIndex(refs, counts, saved(filters, "line-filters"), index.shards, index.min_docs)


def insert_documents(index: LineIndex, docs: DataFrame, min_chars: int = MIN_CHARS) -> LineIndex:
    more = _sharded(saved(references(docs, min_chars), "line-references"), index.shards)
    return _changed(index, index.references.unionByName(more), more)


def delete_documents(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """Index without the documents of `doc_ids` (doc_id), as if they had never been inserted."""
    ids = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    gone = index.references.join(ids, "doc_id", "left_semi")
    kept = saved(index.references.join(ids, "doc_id", "left_anti"), "line-references")
    return _changed(index, kept, gone)


def screened(refs: DataFrame, index: LineIndex, most: int = TASK) -> DataFrame:
    """References whose key the filter of their shard may hold. A shard, and one with a very frequent line more so, is
    dealt by document into parts of about `most` references, each with a copy of the filter."""
    # one row for each shard
    parts = saved(refs.groupBy("shard").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")), "line-parts")
    dealt = refs.join(parts, "shard").withColumn("salt", F.pmod(F.xxhash64("doc_id", "k2"), F.col("parts")).cast("int"))
    copies = index.filters.join(parts, "shard").select("shard", "filter", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))

    def pass_on(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        rows = rows[["doc_id", *KEY]]  # of about `most` references
        if not len(rows) or not len(filters):
            return rows[:0]
        return rows[CuckooFilter.loads(filters["filter"].iloc[0]).contains(rows["k1"].to_numpy(), rows["k2"].to_numpy())].astype({"doc_id": "Int64"})

    return dealt.drop("parts").groupBy("shard", "salt").cogroup(copies.toDF(*copies.columns).groupBy("shard", "salt")).applyInPandas(pass_on, "doc_id long, k1 long, k2 long")


def dedup_lines(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """`docs` with `text` less its repeated lines, and n_lines (before) and n_dropped.

    Lines whose key (stripped of ASCII white space, A-Z in lower case) has at least 40 code points and stands in at
    least 5 documents go from all documents but the one with the largest doc_id that holds it. A null or empty text is
    one empty line and comes back as ''. A row is a document: repeated rows count as often as they come, and a line
    stays in all rows with the largest doc_id; rows with a null doc_id never hold the largest unless no other does.
    An empty table stays empty; other columns pass through, columns named n_lines or n_dropped are replaced.
    """
    index = index or build_index(docs)
    suspects = screened(index.references, index)
    decided = suspects.join(index.counts.select(*KEY, "keep_doc"), KEY).where(~F.col("doc_id").eqNullSafe(F.col("keep_doc")))
    gone = decided.groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("gone")).withColumnRenamed("doc_id", "gone_doc")
    own = Carried(docs, "doc_id", "text")
    joined = own.df.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("gone_doc")), "left")
    lines = text_lines(F.col("text"))
    stays = F.filter(lines, lambda x: ~F.array_contains(F.col("gone"), key_hashes(line_key(x))))
    out = joined.withColumn("lines", lines).withColumn("left", F.when(F.col("gone").isNull(), lines).otherwise(stays))
    kept = own.restored(("n_lines", "n_dropped"), text=F.array_join("left", "\n"))
    return out.select(*kept, F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("left")).cast("long").alias("n_dropped"))
