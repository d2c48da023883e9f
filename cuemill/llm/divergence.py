"""How far the sources of a language differ in their words, by stripes folded inside the map tasks.

A task folds whole documents into one stripe for each (language, term): the documents that hold the term and its count
in every source. A full table of stripes is spilled to the shuffle; stripes of a key meet in key order and are merged one
key at a time. Divergences are taken from the merged stripes.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuemill.llm.shared import saved

#: (term, source) counts that a task holds before it spills them.
HELD = 400_000
#: Parts in one, and what is added to every count.
SCALE, ADDED = 1_000_000_000, 5
#: Sources that meet in one block, and counts of merged stripes in it.
BLOCK, COUNTS = 256, 1 << 18
#: Bytes of terms: letters, in lower case, and everything beyond ASCII; all else parts them.
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_STRIPE = "lang string, term string, documents long, counts map<string,long>"


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8: runs of letters and non-ASCII characters, A-Z in lower case."""
    return text.translate(_LETTERS).split()


def _table(rows) -> pa.RecordBatch:
    """Arrow batch of (lang, term, documents, {source: count}) rows."""
    offsets, keys, items = [0], [], []
    langs, terms, documents = [], [], []
    for lang, term, n, counts in rows:
        langs.append(lang)
        terms.append(term)
        documents.append(n)
        keys.extend(counts.keys())
        items.extend(counts.values())
        offsets.append(len(keys))
    counts = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys, pa.string()), pa.array(items, pa.int64()))
    terms = pa.array(terms, pa.binary()).cast(pa.string()) if terms and isinstance(terms[0], bytes) else pa.array(terms, pa.string())
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), terms, pa.array(documents, pa.int64()), counts], ["lang", "term", "documents", "counts"])


def _batches(rows, size: int = 20_000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _table(held)
            held = []
    if held:
        yield _table(held)


def _fold(limit: int):
    def run(batches):
        stripes: dict[str, dict[bytes, list]] = {}
        held = 0
        for batch in batches:
            for text, lang, source in zip(batch.column("text"), batch.column("lang").to_pylist(), batch.column("source").to_pylist()):
                own = stripes.setdefault(lang, {})
                for term, n in Counter(terms_of(text.as_py())).items():
                    stripe = own.get(term)
                    if stripe is None:
                        own[term] = [1, {source: n}]
                        held += 1
                        continue
                    stripe[0] += 1
                    counts = stripe[1]
                    if source in counts:
                        counts[source] += n
                    else:
                        counts[source] = n
                        held += 1
                if held >= limit:
                    yield from _batches((lang, term, *stripe) for lang, own in stripes.items() for term, stripe in own.items())
                    stripes, held = {}, 0
        yield from _batches((lang, term, *stripe) for lang, own in stripes.items() for term, stripe in own.items())

    return run


def _merge(least: int):
    """Merges the stripes of a key, which come one after another; keeps those in `least` documents. Document counts are
    summed for whole batches, and counts by source are only read of keys that may be kept or go on in the next batch."""

    def merged(batches):
        key, n, counts = None, 0, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            lang, term, pairs = batch.column("lang"), batch.column("term"), batch.column("counts")
            same = pc.and_(pc.equal(lang[1:], lang[:-1]), pc.equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
            starts = np.append(0, np.flatnonzero(~same.astype(bool)) + 1)
            ends = np.append(starts[1:], batch.num_rows)
            sums = np.add.reduceat(batch.column("documents").to_numpy(), starts)
            sources, numbers, offsets = pairs.keys, pairs.items.to_numpy(), pairs.offsets.to_numpy()
            for k in np.unique(np.concatenate([[0, len(starts) - 1], np.flatnonzero(sums >= least)])):
                row = int(starts[k])
                own = (lang[row].as_py(), term[row].as_py())
                if own != key:
                    if key is not None and n >= least:
                        yield (*key, n, counts)
                    key, n, counts = own, 0, {}
                n += int(sums[k])
                first, last = int(offsets[row]), int(offsets[ends[k]])
                for source, count in zip(sources.slice(first, last - first).to_pylist(), numbers[first:last].tolist()):
                    counts[source] = counts.get(source, 0) + count
        if key is not None and n >= least:
            yield (*key, n, counts)

    return lambda batches: _batches(merged(batches))


def stripes(docs: DataFrame, documents: int = 30, limit: int = HELD) -> DataFrame:
    """(lang, term, documents, counts) of the terms in at least `documents` documents of a language; `counts` maps each
    source to the term's count there. Null texts, languages and sources count as ''."""
    empty = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), *empty)
    folded = rows.mapInArrow(_fold(limit), _STRIPE)
    return folded.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merge(documents), _STRIPE)


def parts(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total) in whole numbers, three digits at a time so that nothing overflows."""
    total = np.asarray(total, np.int64)
    if total.size and total.max() >= 2**63 // 1000:
        raise OverflowError("more than 9.2e15 terms in a language")
    rest, found = np.asarray(count, np.int64), 0
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // total
        rest = rest % total
    return found + 1


def _compare(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Sums over one block of stripes: left has the stripes' counts, right the block's sources with their totals."""
    right = right.sort_values("place", ignore_index=True)
    first, second = key[1], key[2]
    rows = {s: k for k, s in enumerate(right["source"])}
    totals = right["total"].to_numpy(np.int64)[:, None]
    value = np.zeros((len(right), len(right)), np.int64)
    for start in range(0, len(left), 1024):
        some = left["counts"].iloc[start : start + 1024]
        counts = np.full((len(right), len(some)), ADDED, np.int64)
        for k, stripe in enumerate(some):
            for source, n in stripe.items() if isinstance(stripe, dict) else stripe:
                if (at := rows.get(source)) is not None:
                    counts[at, k] += n
        share = parts(counts, totals)
        for i in range(len(right)):
            value[i] += np.abs(share - share[i]).sum(axis=1)
    tile = right["tile"].to_numpy()
    i, j = np.nonzero((tile[:, None] == first) & (tile == second) & (np.arange(len(right))[:, None] < np.arange(len(right))))
    names = right["source"].to_numpy(object)
    return pd.DataFrame({"lang": key[0], "source": names[i], "item": names[j], "value": value[i, j]})


def audit(docs: DataFrame, documents: int = 30, top: int = 50, limit: int = HELD) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` ranks the other sources of the language by the sum of
    differences over all kept terms, part `term` the source's own terms whose share exceeds the language's, the first
    `top` of them. Shares are whole billionths with `ADDED` added to every count; values descend, items ascend in UTF-8.

    Null texts, languages and sources count as ''. A group without terms takes part with counts of 0; a language without
    kept terms has values of 0; a language with one source has no pairs. Repeated rows count each. Other columns are not
    read; an empty table gives no rows. Sources of a language meet in blocks of `BLOCK`; what a task holds of them is
    about `COUNTS` counts."""
    kept = saved(stripes(docs, documents, limit), "stripes")
    group = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    each = kept.select("lang", "term", F.explode("counts").alias("source", "count"))
    own = each.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    whole = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    sizes = group.join(own, ["lang", "source"], "left").join(whole, "lang", "left")
    sizes = sizes.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    # one row for each source of each language from here on
    sizes = saved(sizes.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "sources")
    langs = sizes.groupBy("lang").agg(F.sum("total").alias("all"), F.first("terms").alias("terms"), F.max("place").alias("last"))

    share = "1 + cast(({0} + %d) as decimal(20,0)) * %d div cast({1} + %d * terms as decimal(20,0))" % (ADDED, SCALE, ADDED)
    stripe = kept.select("lang", "term", "counts", F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, x: a + x).alias("count"))
    lang_share = stripe.join(langs, "lang").select("lang", "term", "counts", F.expr(share.format("count", "all")).cast("long").alias("q"))
    of_term = lang_share.select("lang", "term", "q", F.explode("counts").alias("source", "count")).where("count > 0")
    of_term = of_term.join(sizes, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (F.expr(share.format("count", "total")).cast("long") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    of_term = of_term.where("value > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    # units of work of a language: pairs of source blocks, and salts so that none holds many stripes
    units = langs.select("lang", F.greatest(F.lit(1), F.ceil(F.col("terms") * (F.col("last") + 1) / COUNTS)).cast("int").alias("salts"), F.floor(F.col("last") / BLOCK).cast("int").alias("tiles"))
    first = F.explode(F.sequence(F.lit(0), F.col("tiles"))).alias("a")
    dealt = units.select("lang", "salts", "tiles", first).select("lang", "salts", "a", F.explode(F.sequence(F.col("a"), F.col("tiles"))).alias("b"))
    left = kept.join(dealt, "lang").select("lang", "a", "b", F.pmod(F.xxhash64("term"), F.col("salts")).cast("int").alias("salt"), "counts")
    tiled = sizes.withColumn("tile", F.floor(F.col("place") / BLOCK).cast("int"))
    right = tiled.join(dealt, "lang").where("tile = a or tile = b").select(
        "lang", "a", "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "source", "place", "tile",
        F.greatest(F.lit(1), F.col("total") + ADDED * F.col("terms")).cast("long").alias("total"),
    )
    by = ["lang", "a", "b", "salt"]
    blocks = left.groupBy(*by).cogroup(right.toDF(*right.columns).groupBy(*by)).applyInPandas(_compare, "lang string, source string, item string, value long")
    pair = blocks.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pair = pair.unionByName(pair.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pair = pair.withColumn("rank", F.row_number().over(order))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return columns(pair, "pair").unionByName(columns(of_term, "term"))
