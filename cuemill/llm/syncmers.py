"""Document fingerprints from closed syncmers of words.

A window of `k` words is an anchor if the smallest hash among its runs of `s` words stands at its first or last run.
Whether a window is one depends on its own words alone, so an edit moves no anchor beyond its reach, and the anchors
of two texts can be matched with their positions. A fingerprint holds all anchors of a text with their positions.
Words of scripts without spaces, and very long ones, are cut into their characters, which then count as words.
Everything is column expressions over arrays of a row; texts are moved once, in the neighbour search.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.llm.shared import ASCII_SPACE, saved

#: Words of a window, words of an inner run.
K, S = 4, 2
#: Ranges of ids in the neighbour search; their bounds are known to the driver.
MOST_RANGES = 16_384
#: Scripts that put no space between words: Thai, Lao, Tibetan, Burmese, Khmer, Chinese and Japanese characters.
UNSPACED = r"[\x{E00}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{312F}\x{31A0}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9D}\x{20000}-\x{3FFFF}]"
#: A word of more characters than any language writes together.
LONG = r"[^\x20\x09-\x0D]{65}"


def words(text: Column) -> Column:
    """Words of a text: what stands between ASCII white space, or its characters if it has more than 64 or any of a
    script without spaces."""
    inner = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(ASCII_SPACE))
    spaced = F.split(inner, r"[\x20\x09-\x0D]+", -1)
    cut = F.flatten(F.transform(spaced, lambda w: F.when((F.char_length(w) > 64) | w.rlike(UNSPACED), F.split(w, "")).otherwise(F.array(w))))
    uncommon = inner.rlike(LONG) | ((F.octet_length(inner) > F.char_length(inner)) & inner.rlike(UNSPACED))
    return F.when(inner == "", F.array().cast("array<string>")).when(uncommon, cut).otherwise(spaced)


def run_hashes(tokens: Column, length: int) -> Column:
    """Hash of each run of `length` words, as an array with one entry for each place where one fits."""
    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    out, rest = hashes, F.size(tokens)
    for step in range(1, length):
        out = F.zip_with(out, F.slice(hashes, F.lit(step + 1), F.greatest(F.lit(0), rest - step)), lambda a, b: F.xxhash64(a, b))
    return F.slice(out, F.lit(1), F.greatest(F.lit(0), rest - (length - 1)))


def anchors(runs: str, k: int = K, s: int = S) -> Column:
    """array<bigint> with an entry for each run of the column `runs`: the hash of the window that begins there if it is
    a closed syncmer, else null."""

    def pick(first: Column, i: Column) -> Column:
        inner = [first] + [F.get(F.col(runs), i + F.lit(j)) for j in range(1, k - s + 1)]
        smallest = F.least(*inner)
        return F.when(inner[-1].isNotNull() & ((first == smallest) | (inner[-1] == smallest)), F.xxhash64(*inner))

    return F.transform(F.col(runs), pick)


def fingerprinted(df: DataFrame, text: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """`df` with `out`: all anchor hashes of the text, each at its position, with null where there is none. A text with 1
    to k - 1 words has one anchor, of all its words; one without words has none."""
    spread = df.withColumn("_words", words(F.col(text))).withColumn("_runs", run_hashes(F.col("_words"), s))
    short = F.when(F.size("_words") > 0, F.array(F.xxhash64(F.lit("short"), F.array_join("_words", " ")))).otherwise(F.array().cast("array<bigint>"))
    return spread.withColumn(out, F.when(F.size("_words") >= k, anchors("_runs", k, s)).otherwise(short)).drop("_words", "_runs")


def anchor_positions(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """(doc_id, position, anchor): each anchor of each text with the number of its first word, for positional matching."""
    spread = docs.select("doc_id", words(F.col("text")).alias("_words")).withColumn("_runs", run_hashes(F.col("_words"), s))
    marks = spread.select("doc_id", F.posexplode(anchors("_runs", k, s)).alias("position", "anchor"))
    return marks.where("anchor is not null").select("doc_id", F.col("position").cast("long").alias("position"), "anchor")


def likeness(a: Column, b: Column) -> Column:
    """Share of two fingerprints' anchors that match, 0 to 1: the n-th place of an anchor in one text is matched with the
    n-th in the other, and twice the matches are divided by the anchors of both. Two texts without anchors are alike."""
    # sorted, the first text's places of an anchor (last bit 0) come right before the second's (last bit 1)
    sides = [F.transform(F.array_compact(a), lambda h: h.bitwiseAND(F.lit(-2))), F.transform(F.array_compact(b), lambda h: h.bitwiseOR(F.lit(1)))]

    def step(state: Column, mark: Column) -> Column:
        anchor, first = mark.bitwiseAND(F.lit(-2)), mark.bitwiseAND(F.lit(1)) == 0
        same, held = state["anchor"] == anchor, state["held"]
        hit = ~first & same & (held > 0)
        left = F.when(first & same, held + 1).when(first, F.lit(1)).when(hit, held - 1).otherwise(held)
        return F.struct(F.when(first, anchor).otherwise(state["anchor"]).alias("anchor"), left.alias("held"), (state["common"] + hit.cast("int")).alias("common"), (state["n"] + 1).alias("n"))

    start = F.struct(F.lit(1).cast("bigint").alias("anchor"), F.lit(0).alias("held"), F.lit(0).alias("common"), F.lit(0).alias("n"))
    return F.aggregate(F.sort_array(F.concat(*sides)), start, step, lambda x: F.when(x["n"] == 0, F.lit(1.0)).otherwise(2.0 * x["common"] / x["n"]))


def text_of(fingerprint: Column) -> Column:
    """Position (8 hexadecimal digits) and hash (16) of each anchor in the order of the text."""
    parts = F.transform(fingerprint, lambda h, i: F.when(h.isNotNull(), F.concat(F.lpad(F.hex(i), 8, "0"), F.lpad(F.hex(h), 16, "0"))))
    return F.lower(F.array_join(parts, ""))


def _ranges(docs: DataFrame, per_range: int | None) -> Column:
    """Number of the range of `doc_id` of each row, rising with the id, by approximate quantiles of the ids: a range holds
    about as many rows wherever the ids lie. An id that fills several ranges by itself is dealt among them by the hash of
    its text (small hashes to high numbers, as rows go by falling numbers). Null ids come below, by the same hash."""
    n = docs.count()
    wanted = min(MOST_RANGES, n // (per_range or max(256, math.isqrt(n))) + 1)
    points = [k / wanted for k in range(1, wanted)]
    found = docs.agg(F.percentile_approx("doc_id", points, 16 * wanted)).first()[0] if points else None
    times = Counter(found or ())
    bounds = sorted(times)
    text_hash, id_ = F.xxhash64("text"), F.col("doc_id")
    nulls = -1 - F.pmod(text_hash, F.lit(wanted))
    if not bounds:
        return F.when(id_.isNull(), nulls).otherwise(F.lit(0)).cast("long")
    step = math.isqrt(len(bounds)) + 1
    chunks = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= id_))
    array = lambda xs: F.lit(xs).cast("array<bigint>")
    chunk = below(array([c[0] for c in chunks]))
    place = F.when(chunk == 0, 0).otherwise((chunk - 1) * step + below(F.element_at(F.array(*[array(c) for c in chunks]), F.greatest(chunk, F.lit(1)))))
    width = max(times.values()) + 1
    many = {b: m for b, m in times.items() if m > 1}
    own = F.lit(width - 1)
    if many:
        share = F.create_map(*[F.lit(x).cast("bigint") for b, m in many.items() for x in (b, m)])[id_]
        part = F.shiftright((F.shiftright(text_hash, 32) + F.lit(1 << 31)) * share, 32)
        own = F.when(share.isNotNull(), share - 1 - part).otherwise(own)
    return F.when(id_.isNull(), nulls).otherwise(place.cast("long") * width + own).cast("long")


def with_next(docs: DataFrame, derive=None, carried: tuple[str, ...] = (), per_range: int | None = None) -> DataFrame:
    """`docs` (doc_id, text) with `next`, a struct of text and `carried` of the document that follows by descending doc_id;
    the first follows the last. `derive` adds the columns `carried` from the text once the rows are dealt out, so only
    ids and texts are moved, and those once.

    Ids are dealt into ranges of about `per_range` documents (the square root of their number, 256 at least; `MOST_RANGES`
    ranges at most), so no task orders more than a range or two. The last document of a range is followed by the first of
    the next range: those firsts are one row for each range, looked up by their ids and sent on to the range before. Null
    ids come last, in ranges by the hash of their text.
    """
    ranged = docs.withColumn("range", _ranges(docs, per_range))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    tops = saved(ranged.groupBy("range").agg(F.max("doc_id").alias("doc_id")), "range-tops")  # small, and of a size that is known
    before = tops.select("range", F.lag("range").over(Window.orderBy(F.col("range").desc())).alias("to"))
    lowest = tops.agg(F.min("range")).first()[0]
    sent_on = before.select("range", F.coalesce("to", F.lit(lowest)).alias("to"))
    found = ranged.join(tops.withColumnRenamed("doc_id", "top"), "range").where(F.col("doc_id").eqNullSafe(F.col("top")))
    firsts = found.groupBy("range").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    extra = firsts.join(sent_on, "range").select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("to").alias("range"), F.lit(True).alias("extra"))
    rows = ranged.withColumn("extra", F.lit(False)).unionByName(extra).repartition("range")
    rows = derive(rows) if derive else rows
    following = F.lead(F.struct("text", *carried)).over(Window.partitionBy("range").orderBy("extra", *order))
    return rows.withColumn("next", following).where("not extra").drop("extra", "range")


def edited(text: Column, other: Column) -> Column:
    """`text` with its last half (rounded down) replaced by as many code points from the start of `other`, or all."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def compare_with_edits(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """doc_id, n_chars, edited_text, fingerprint, edited_fingerprint (hexadecimal), near_edited, near_next.

    Null texts are empty; a text without words has the empty fingerprint, and two of these are fully alike. Equal texts
    have equal fingerprints. Rows with a null doc_id come after all others; repeated rows stay, and follow each other in
    the order of their texts. The only document of a table follows itself; an empty table stays empty; further columns
    are ignored. Long texts are read whole.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pairs = with_next(own, lambda rows: fingerprinted(rows, "text", "_own", k, s), ("_own",))
    pairs = pairs.withColumn("edited_text", edited(F.col("text"), F.col("next.text")))
    pairs = fingerprinted(pairs, "edited_text", "_edit", k, s)
    return pairs.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        "edited_text",
        text_of(F.col("_own")).alias("fingerprint"),
        text_of(F.col("_edit")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_edit")).alias("near_edited"),
        likeness(F.col("_own"), F.col("next._own")).alias("near_next"),
    )
