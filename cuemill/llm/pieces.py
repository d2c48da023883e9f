"""SentencePiece models as weighted finite-state transducers.

Three machines are compiled from a model file: the normaliser (spaces to the mark U+2581, one in front), the lexicon
(a trie that reads characters and writes piece ids, with byte ids for characters outside it), and the merge order (it
reads piece ids and forbids two pieces side by side whose characters the model would have merged otherwise). Composed
with a text they leave, for a model of merges, one path of finite weight, so the tropical shortest path is the first
one that reaches the end; it is found depth first over the lazily composed machine.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Parts of texts whose ids a worker keeps, and texts that it hands on at a time.
CACHE, TEXTS = 400_000, 256
RUN = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _fields(data: bytes):
    """(number, value) of the fields of an encoded message."""

    def number(i):
        shift = value = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = number(i)
        if key & 7 == 0:
            value, i = number(i)
        else:
            size, i = number(i) if key & 7 == 2 else (4 if key & 7 == 5 else 8, i)
            value, i = data[i : i + size], i + size
        yield key >> 3, value


class Transducer:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            parts = dict(_fields(f.read()))
        rules = dict(_fields(parts[3]))
        if rules.get(2):
            raise ValueError("only models without a character map are supported")
        if rules.get(4, 1):
            raise ValueError("models that drop extra white space are not supported")
        self.front = MARK if rules.get(3, 1) else ""
        self.piece = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(len(self.piece)) if model.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.silent = {i for i in range(len(self.piece)) if model.is_control(i) or model.is_unknown(i)}
        self.high = {i for i, b in self.of_byte.items() if b > 127}
        #: What an id writes by itself; bytes over 127 only write together.
        self.plain = ["" if i in self.silent or i in self.high else chr(self.of_byte[i]) if i in self.of_byte else p for i, p in enumerate(self.piece)]
        self.weight = {p: -model.get_score(i) for i, p in enumerate(self.piece) if i not in self.of_byte and i not in self.silent and not model.is_unused(i)}
        self.id = {p: i for i, p in enumerate(self.piece) if p in self.weight}
        self.unknown = model.unk_id()
        self.trie: dict = {}
        for piece, i in self.id.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("pieces across spaces are not supported")
        #: Length of each piece and the longest other piece that it begins with; last the characters outside the lexicon.
        self.width = [len(p) for p in self.piece] + [1]
        self.shorter = [-1] * (len(self.piece) + 1)
        for piece, i in self.id.items():
            self.shorter[i] = next((self.id[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.id), -1)
        self.allowed: dict[int, bool] = {}
        self.seen: dict[str, bytes] = {}

    def _stays(self, left: int, right: int) -> bool:
        """Whether the merge order leaves the boundary between two pieces: their characters, merged by weight and from
        the left, must end as these two pieces."""
        parts, weight, none = list(self.piece[left] + self.piece[right]), self.weight, float("inf")
        while len(parts) > 1:
            costs = [weight.get(a + b, none) for a, b in zip(parts, parts[1:])]
            least = min(costs)
            if least == none:
                break
            k = costs.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if len(self.allowed) > 2_000_000:
            self.allowed.clear()
        stays = self.allowed[left * len(self.piece) + right] = parts == [self.piece[left], self.piece[right]]
        return stays

    def path(self, text: str) -> list[int]:
        """Piece ids of normalised text: longest arcs first, and back over those that end in a dead state."""
        size, outside, width, shorter, allowed, trie = len(text), len(self.piece), self.width, self.shorter, self.allowed, self.trie
        longest: list = [None] * (size + 1)
        ids: list[int] = []
        dead: set[int] = set()
        at, last, piece = 0, -1, None
        while at < size:
            if piece is None:
                piece = longest[at]
                if piece is None:
                    node, k, piece = trie, at, outside
                    while k < size and (node := node.get(text[k])):
                        k += 1
                        if "" in node:
                            piece = node[""]
                    longest[at] = piece
            while piece >= 0:
                if last < 0 or piece == outside or last == outside:
                    ok = True
                else:
                    ok = allowed.get(last * outside + piece)
                    if ok is None:
                        ok = self._stays(last, piece)
                if ok and not (dead and (at + width[piece]) * outside + piece in dead):
                    break
                piece = shorter[piece]
            if piece >= 0:
                ids.append(piece)
                at, last, piece = at + width[piece], piece, None
            elif not ids:
                raise ValueError("no path: the model is not one of merges")
            else:
                piece = ids.pop()
                dead.add(at * outside + piece)
                at, last, piece = at - width[piece], ids[-1] if ids else -1, shorter[piece]
        if outside not in ids:
            return ids
        out, at = [], 0
        for piece in ids:
            if piece != outside:
                out.append(piece)
            elif self.byte:
                out.extend(self.byte[b] for b in text[at].encode("utf-8", "replace"))
            else:
                out.append(self.unknown)
            at += width[piece]
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit numbers; nothing for a null or empty text."""
        if not text:
            return b""
        if "  " in text or text[0] == " " or MARK in text or not self.front:
            parts = RUN.findall(self.front + text.replace(" ", MARK))
        else:
            parts = [MARK + x for x in text.split(" ")]
        missing = set(parts).difference(self.seen)
        if missing:
            if len(self.seen) + len(missing) > CACHE:
                self.seen, missing = {}, set(parts)
            for part in missing:
                self.seen[part] = array("i", self.path(part)).tobytes()
        return b"".join(map(self.seen.__getitem__, parts))

    def decode(self, ids) -> str:
        """Text of ids, through the same machines in the other direction; byte pieces that are no UTF-8 become U+FFFD."""
        if self.high.isdisjoint(ids):
            text = "".join(map(self.plain.__getitem__, ids)).replace(MARK, " ")
            return text[1:] if self.front and text[:1] == " " else text
        out, held = [], bytearray()
        for i in ids:
            b = self.of_byte.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i not in self.silent:
                out.append(self.piece[i])
        out.append(held.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if self.front and text[:1] == " " else text


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One machine per worker process; its caches serve all its tasks."""
    return Transducer(path)


def _slices(batches):
    for batch in batches:
        for at in range(0, len(batch), TEXTS):
            yield batch.iloc[at : at + TEXTS]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_ids, ids, ids_crc32): the pieces of every whole text; ids_crc32 is over little-endian 32-bit ids. A null
    or empty text has no ids; null doc_ids and repeated rows stay; an empty table stays empty."""

    def run(batches):
        machine = transducer(model)
        for batch in _slices(batches):
            ids = [machine.encode(x) for x in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_ids": [len(x) // 4 for x in ids], "ids": [np.frombuffer(x, "<i4") for x in ids], "ids_crc32": [zlib.crc32(x) for x in ids]})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, n_ids long, ids array<int>, ids_crc32 long")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text): the text of every row's `ids`; a null or empty array gives ''. A literal U+2581 comes back as a
    space, as in the model's own decoder."""

    def run(batches):
        machine = transducer(model)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": [machine.decode(() if x is None else x.tolist()) for x in batch["ids"]]})

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>").alias("ids")).mapInPandas(run, "doc_id long, text string")


def encode_and_decode(docs: DataFrame, model: str) -> DataFrame:
    """`encode` with `decoded`, the text that the ids give back, in one pass over the texts."""

    def run(batches):
        machine = transducer(model)
        for batch in _slices(batches):
            ids = [machine.encode(x) for x in batch["text"]]
            arrays = [np.frombuffer(x, "<i4") for x in ids]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_ids": [len(x) for x in arrays], "ids": arrays, "ids_crc32": [zlib.crc32(x) for x in ids], "decoded": [machine.decode(x.tolist()) for x in arrays]})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, n_ids long, ids array<int>, ids_crc32 long, decoded string")
