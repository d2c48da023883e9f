"""Packing token sequences into windows by non-negative least squares on the histogram of lengths.

A text is cut into whole windows and one tail. The tails' lengths form a histogram with as many cells as the window
has tokens, whatever the corpus. Shallow combinations of lengths that fill a window are enumerated, their repeat
counts fitted to the histogram by non-negative least squares, rounded, and the tails that remain are packed greedily,
end to end and cut where a window ends. The result is a plan over (length, rank), so each tail finds its place from
its length and its rank among the tails of that length, without meeting any other tail.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuemill.llm.shared import saved

WINDOW = 1024
CACHE = 600_000
#: Where a cut before a space could change the tokens: inside a run of white space, or at a space that ends the text.
UNSAFE = re.compile(r"\s \s|\s $")


def byte_symbols() -> dict[str, int]:
    """Characters that byte-level vocabularies write for bytes: printable ones for themselves, the rest from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of whole texts, as little-endian 16-bit numbers, the same as the tokenizer's own.

    Pieces never cross a space that follows other text, so a text is split before its spaces and the ids of each
    part are kept; parts not seen yet are merged by the rank file's library over the same vocabulary. Texts in which
    the split could matter, or that hold a special token's string, go through the tokenizer as they are.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        vocabulary = json.loads(self.whole.to_str())["model"]["vocab"]
        symbols = byte_symbols()
        special = {t.content for t in self.whole.get_added_tokens_decoder().values()}
        ranks = {bytes(symbols[c] for c in piece): i for piece, i in vocabulary.items() if piece not in special}
        if max(vocabulary.values()) > 0xFFFF:
            raise ValueError("ids over 65,535 do not fit in 16 bits")
        from public_tokenizers import PATTERN

        self.parts = tiktoken.Encoding("parts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [x for x in special if x]
        self.seen: dict[str, bytes] = {}

    def _direct(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if UNSAFE.search(text) or any(x in text for x in self.special):
            return self._direct(text)
        first, *rest = text.split(" ")
        parts = [first, *map(" ".__add__, rest)] if first else [*map(" ".__add__, rest)]
        missing = set(parts).difference(self.seen)
        if missing:
            if len(self.seen) + len(missing) > CACHE:
                self.seen, missing = {}, set(parts)
            merge = self.parts.encode_ordinary
            for part in missing:
                self.seen[part] = array("H", merge(part)).tobytes()
        return b"".join(map(self.seen.__getitem__, parts))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process; its cache serves all its tasks."""
    return Encoder(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenised(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = 0, with_ids: bool = True) -> DataFrame:
    """(doc_id, doc_tokens, start, length, ids_crc32, ids): every text cut into whole windows and a tail; the end token
    stands after each text, so also an empty or null text has one piece. Ids are 16-bit little-endian; without
    `with_ids` only tails carry them, which may be cut again."""

    def run(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = np.append(np.frombuffer(encode(text or ""), dtype="<u2"), np.uint16(end))
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    rows.append((doc, len(ids), at, len(piece), crc(piece), piece.tobytes() if with_ids or len(piece) < window else None))
            yield pd.DataFrame(rows, columns=["doc_id", "doc_tokens", "start", "length", "ids_crc32", "ids"]).astype({"doc_id": "Int64"})

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return columns.mapInPandas(run, "doc_id long, doc_tokens long, start long, length long, ids_crc32 long, ids binary")


def combinations(window: int) -> np.ndarray:
    """Multisets of up to three lengths that fill a window exactly, as rows (a, b, c) with a >= b >= c, 0 for none."""
    two = [(a, window - a, 0) for a in range((window + 1) // 2, window)]
    a, b = np.meshgrid(np.arange(1, window), np.arange(1, window), indexing="ij")
    c = window - a - b
    keep = (a >= b) & (b >= c) & (c >= 1)
    return np.concatenate([np.array(two, dtype=np.int64).reshape(-1, 3), np.stack([a[keep], b[keep], c[keep]], axis=1)])


def repeat_counts(histogram: np.ndarray, window: int, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and their real repeat counts: min |A x - h|, x >= 0, by accelerated projected gradients; A is never
    built, as each of its columns has three entries at most."""
    combos = combinations(window)
    combos = combos[np.where(combos > 0, histogram[combos] > 0, True).all(axis=1)]
    if not len(combos):
        return combos, np.zeros(0)
    target = histogram.astype(float)
    weight = (combos > 0).astype(float)

    def apply(x):
        return np.bincount(combos.ravel(), (weight * x[:, None]).ravel(), minlength=window + 1)

    v = np.ones(len(combos))
    for _ in range(20):  # largest eigenvalue of A'A gives the step
        v = (weight * apply(v)[combos]).sum(axis=1)
        size = np.linalg.norm(v)
        v /= size
    x = y = np.zeros(len(combos))
    momentum = 1.0
    for _ in range(rounds):
        slope = (weight * (apply(y) - target)[combos]).sum(axis=1)
        new = np.maximum(0, y - slope / (1.05 * size))
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = new + (momentum - 1) / after * (new - x)
        x, momentum = new, after
    return combos, x


def pack_plan(histogram: np.ndarray, window: int = WINDOW) -> tuple[pd.DataFrame, np.ndarray, int]:
    """Where the tail of a length and a rank goes. Rows (length, first, last, sequence, offset): ranks first..last-1 go
    to sequence + rank - first at that offset. Second: position of the first remaining tail of each length in the
    stream of remaining tails, and (in row 1) the rank from which tails remain. Third: sequences planned before it."""
    left = histogram.astype(np.int64).copy()
    rows, used, sequences = [], np.zeros(window + 1, dtype=np.int64), 0
    combos, repeats = repeat_counts(histogram, window)
    # largest counts first; rounding never uses more tails than there are, what it leaves is tried once more greedily
    for extra in (0, 1):
        for k in np.argsort(-repeats, kind="stable"):
            lengths = combos[k][combos[k] > 0]
            values, times = np.unique(lengths, return_counts=True)
            most = int((left[values] // times).min())
            count = min(most, int(round(repeats[k]))) if not extra else most
            if count <= 0:
                continue
            at = 0
            for length in lengths:
                rows.append((length, used[length], used[length] + count, sequences, at))
                used[length] += count
                left[length] -= count
                at += length
            sequences += count
    stream = np.zeros((2, window + 1), dtype=np.int64)
    stream[1] = used
    at = 0
    for length in range(window - 1, 0, -1):
        stream[0, length] = at
        at += int(left[length]) * length
    plan = pd.DataFrame(rows, columns=["length", "first", "last", "sequence", "offset"], dtype="int64")
    return plan, stream, sequences


def ranked(tails: DataFrame, total: int, per_bucket: int = 100_000) -> DataFrame:
    """`tails` with `rank`, 0-based among those of a length. A frequent length is numbered in buckets by document and the
    buckets' sizes are summed, so no task holds a whole length."""
    buckets = max(256, total // per_bucket)
    dealt = tails.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    return dealt.withColumn("inside", F.row_number().over(inside) - 1).join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("inside")).drop("bucket", "base", "inside")


PIECES = "doc_id long, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary"


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = 0, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, doc_tokens, start, length, ids_crc32, sequence_id, offset, ids.

    Every token id of every text, and the end id after it, lies in exactly one piece; pieces of a sequence follow each
    other without gaps from offset 0; only the last sequence of the corpus can have padding. Null and empty texts are
    the end id alone; a null doc_id stays null; repeated rows are packed as often as they come; an empty table gives
    no pieces; further columns are ignored. The planner holds one count per length (at most `window`) on the driver.
    """
    pieces = saved(tokenised(docs, tokenizer, window, end, with_ids), "pieces")
    tails = pieces.where(F.col("length") < window)
    histogram = np.zeros(window + 1, dtype=np.int64)
    for length, n in tails.groupBy("length").count().collect():
        histogram[length] = n
    plan, stream, planned = pack_plan(histogram, window)
    first_whole = planned + -(-int((((histogram - stream[1]) * np.arange(window + 1))).sum()) // window)
    by_length = {int(k): (g["first"].to_numpy(), g["last"].to_numpy(), g["sequence"].to_numpy(), g["offset"].to_numpy()) for k, g in plan.groupby("length", sort=False)}

    def place(batches):
        for batch in batches:
            rows = []
            for doc, tokens, start, length, check, ids, rank in batch[["doc_id", "doc_tokens", "start", "length", "ids_crc32", "ids", "rank"]].itertuples(index=False):
                if rank < stream[1, length]:
                    first, _, sequence, offset = by_length[length]
                    k = np.searchsorted(first, rank, side="right") - 1
                    rows.append((doc, tokens, start, length, check, sequence[k] + rank - first[k], offset[k], ids))
                    continue
                at, token_ids, done = int(stream[0, length] + (rank - stream[1, length]) * length), np.frombuffer(ids, dtype="<u2"), 0
                while done < length:
                    offset = (at + done) % window
                    part = token_ids[done : done + window - offset]
                    rows.append((doc, tokens, start + done, len(part), crc(part), planned + (at + done) // window, offset, part.tobytes()))
                    done += len(part)
            yield pd.DataFrame(rows, columns=["doc_id", "doc_tokens", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]).astype({"doc_id": "Int64"})

    packed = ranked(tails, int(histogram.sum())).mapInPandas(place, PIECES)
    whole = pieces.where(F.col("length") == window).withColumn("sequence_id", F.lit(first_whole) + F.monotonically_increasing_id())
    return packed.unionByName(whole.withColumn("offset", F.lit(0).cast("long")).select(*[x.split()[0] for x in PIECES.split(", ")]))
