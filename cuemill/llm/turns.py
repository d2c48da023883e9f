"""Repair of the turn structure of conversations by alignment to the alternating grammar `(s?(ua)+)?`.

Turns are aligned to every feasible length of the grammar's string by Wagner and Fischer's table. Strings of one ending
are suffixes of one another, so one table over suffixes serves all lengths; Ukkonen's bands, from the cost of a greedy
repair, bound its cells. Lengths of equal cost are traced back and their audits compared.

A conversation is cut into segments of at most `SEGMENT` turns. Each is aligned from every grammar state to every other,
and the segments are chained by their costs, so a conversation of any length is repaired in parallel. An audit of a
segment ends with a turn of the segment, hence none is the beginning of another, and ties are told segment by segment.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.llm.shared import ASCII_SPACE, saved

#: Turns of a segment (a power of two); rows of a segment are neighbours in the sorted table.
SEGMENT = 512
#: Costs of an edit, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Grammar states: nothing yet, after the system turn, after a user's, after an assistant's; and any that may end.
START, SYSTEM, USER, ASSISTANT, DONE = 0, 1, 2, 3, 4
_FAR = 1 << 29


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of conversations with faults planted by a checksum of `conv_id:turn` modulo 20: 0 drops
    the row, 1 empties its text, 2 takes `.!?` out of it, 3 repeats it, 4 makes its role user. Null roles and texts become
    one space, as null ids and turns do in the checksum."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), blank).alias("role"),
        F.coalesce(F.col("text").cast("string"), blank).alias("text"), F.pmod(F.crc32(F.encode(name, "UTF-8")), F.lit(20)).alias("draw"),
    ).where("draw <> 0")
    text = F.when(F.col("draw") == 1, F.lit("")).when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


# Codes of turns: place in `_FAULTS` x 4 + place in "sua" (3: any other initial), as a letter from "A" on.
_FAULTS = ("none", "blank", "duplicate", "truncated")


def _decode(codes: str) -> tuple[list[int], list[bool], list[int]]:
    """Initials, whether a turn has to go, and what it costs to stay."""
    numbers = [ord(c) - 65 for c in codes]
    return [n % 4 for n in numbers], [n // 4 in (1, 2) for n in numbers], [TRUNCATED * (n // 4 == 3) for n in numbers]


def _greedy(initials, gone, stay, start: int) -> int:
    """Cost of a repair of no great thought: delete what has to go, keep what fits, insert before what would fit next."""
    cost, wanted = 0, ASSISTANT - 1 if start == USER else USER - 1
    for initial, has_to_go, extra in zip(initials, gone, stay):
        if has_to_go:
            cost += DELETE
        elif initial == wanted:
            cost, wanted = cost + extra, 3 - wanted
        elif initial == 3 - wanted:
            cost += INSERT + extra
        else:
            cost, wanted = cost + REROLE + extra, 3 - wanted
    return cost + INSERT + REROLE


def _suffix_table(initials, gone, stay, ending: int, last: bool, most: int):
    """cost[i][k]: least cost of aligning the turns from i on with the last k roles of the alternating string that ends in
    `ending` (1: user, 2: assistant), `_FAR` where that and the turns before cost over `most`. Inserts after the last turn
    are allowed in the last segment only."""
    n = len(initials)
    left = np.concatenate([np.cumsum(gone[::-1])[::-1], [0]]).astype(int)
    spare = max(0, most - DELETE * int(left[0]))
    width = n - int(left[0]) + spare // INSERT + 2
    cost = np.full((n + 1, width + 1), _FAR, np.int32)
    k = np.arange(width + 1, dtype=np.int32)
    role = np.where(k % 2 == 1, ending, 3 - ending)
    if last:
        stop = min(width, spare // INSERT)
        cost[n, : stop + 1] = INSERT * k[: stop + 1]
    else:
        cost[n, 0] = 0
    for i in range(n - 1, -1, -1):
        rest = n - i
        low = max(0, rest - int(left[i]) - spare // DELETE)
        high = min(width, rest - int(left[i]) + spare // INSERT)
        here = slice(low, high + 1)
        best = cost[i + 1, here] + DELETE
        if not gone[i]:
            before = np.concatenate([[_FAR] if low == 0 else [], cost[i + 1, max(0, low - 1) : high]]).astype(np.int32)
            best = np.minimum(best, before + np.where(role[here] == initials[i], 0, REROLE) + stay[i])
        best = np.minimum.accumulate(best - INSERT * k[here]) + INSERT * k[here]
        cost[i, here] = np.minimum(best, _FAR)
    return cost, role


def _trace(table, initials, gone, stay, i: int, k: int) -> str:
    """The ASCII-least cheapest edits from cell (i, k): at every cell the least letter that keeps its cost."""
    cost, role = table
    audit, n = [], len(initials)
    while i < n or k > 0:
        now = cost[i, k]
        if i < n and cost[i + 1, k] + DELETE == now:
            audit.append("D")
            i += 1
        elif k > 0 and cost[i, k - 1] + INSERT == now:
            audit.append("I")
            k -= 1
        else:
            audit.append("K" if role[k] == initials[i] else "R")
            i, k = i + 1, k - 1
    return "".join(audit)


@lru_cache(maxsize=65536)
def align(codes: str, start: int, last: bool) -> tuple[tuple[int, int, str], ...]:
    """(end state, cost, audit) of the best alignments of a segment's turns that begin in a state: to each state it can
    end in, or to any accepted end (`DONE`) in the last segment."""
    initials, gone, stay = _decode(codes)
    n, found = len(codes), []
    most = _greedy(initials, gone, stay, start)
    # a kept system turn, which only the first role may be
    system = [i for i in range(n) if start == START and initials[i] == 0 and not gone[i]]
    for ending in (2,) if last else (1, 2):
        table = _suffix_table(initials, gone, stay, ending, last, most)
        cost = table[0]
        # lengths whose first role may follow the state
        opens = 2 if start == USER else 1
        lengths = [k for k in range(cost.shape[1]) if (k > 0 and table[1][k] == opens) or (k == 0 and (start == ending + 1 or (last and start == START)))]
        ways = [(int(cost[0, k]), None, k) for k in lengths]
        ways += [(DELETE * i + stay[i] + int(cost[i + 1, k]), i, k) for i in system for k in lengths if k > 0]
        least = min((w[0] for w in ways), default=_FAR)
        if least < _FAR:
            audits = [
                _trace(table, initials, gone, stay, 0, k) if i is None else "D" * i + "K" + _trace(table, initials, gone, stay, i + 1, k)
                for c, i, k in ways if c == least
            ]
            found.append((DONE if last else ending + 1, least, min(audits)))
    if not last and start in (START, SYSTEM):
        found.append((start, DELETE * n, "D" * n))
    if not last and system:
        least = min(DELETE * (n - 1) + stay[i] for i in system)
        found.append((SYSTEM, least, min("D" * i + "K" + "D" * (n - 1 - i) for i in system if DELETE * (n - 1) + stay[i] == least)))
    return tuple(found)


def _ways(batches):
    """Every way through every segment: ranks order the audits of a segment and start."""
    for batch in batches:
        out = []
        for head, seg, codes, first, last in zip(batch["head"], batch["seg"], batch["codes"], batch["first"], batch["last"]):
            for start in (START,) if first else (START, SYSTEM, USER, ASSISTANT):
                ways = sorted(align(codes, start, bool(last)), key=lambda w: w[2])
                out += [(head, seg, start, end, cost, rank, audit) for rank, (end, cost, audit) in enumerate(ways)]
        yield pd.DataFrame(out, columns=["head", "seg", "start", "end", "cost", "rank", "audit"])


def _chain(ways: pd.DataFrame) -> pd.DataFrame:
    """The cheapest chain of ways through the segments of one conversation, the least by rank among equals."""
    after, picks = {DONE: (0, 0)}, []
    for seg, rows in reversed(list(ways.groupby("seg"))):
        best = {}
        for start, end, cost, rank in zip(rows["start"], rows["end"], rows["cost"], rows["rank"]):
            if end in after:
                best[start] = min(best.get(start, (_FAR * _FAR, 0, 0)), (cost + after[end][0], rank, end))
        picks.append((seg, best))
        after = best
    state, chosen = START, []
    for seg, best in reversed(picks):
        chosen.append((ways["head"].iloc[0], seg, state, best[state][2]))
        state = best[state][2]
    return pd.DataFrame(chosen, columns=["head", "seg", "start", "end"])


def _edits(batches):
    """One row for each edit of a segment: the turn it is made at (inserts: before `place`, or after the last one), its
    order there, and the role that the turn gets (null: its own, or none)."""
    for batch in batches:
        places, subs, ops, roles = [], [], [], []
        for place, codes, start, audit in zip(batch["place"], batch["codes"], batch["start"], batch["audit"]):
            at, sub, state = 0, 0, start
            for op in audit:
                sub = sub + 1
                role = None
                if op != "D":
                    if op == "K" and state == START and (ord(codes[at]) - 65) % 4 == 0:
                        state = SYSTEM
                    else:
                        state = ASSISTANT if state == USER else USER
                        role = None if op == "K" else "user" if state == USER else "assistant"
                places.append(place + min(at, len(codes) - 1))
                subs.append(sub)
                ops.append(op)
                roles.append(role)
                if op != "I":
                    at, sub = at + 1, 0 if at + 1 < len(codes) else sub
        yield pd.DataFrame({"place": places, "sub": pd.array(subs, "int32"), "op": ops, "new_role": roles})


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faults and repairs of conversations (conv_id, turn, role, text).

    Returns two tables. Summary: conv_id, head (the number of its first row), gaps, blank, duplicate, truncated, illegal,
    cost, audit. Turns: head, conv_id, place, sub (order), op (K, R, D, I), role, text; those without D are the repaired
    conversation. Turns are taken by `turn`, nulls first, and within one turn by the SHA-256 of role and text. Nulls of
    role and text count as one space; a null conv_id is a conversation of its own; repeated rows are duplicates; an empty
    table gives empty ones; gaps beyond a long are cut to the largest. Other columns are not read."""
    blank = F.lit(" ")
    role, text = F.coalesce(F.col("role").cast("string"), blank), F.coalesce(F.col("text").cast("string"), blank)
    taken = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    key = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    end = F.right(F.rtrim(F.col("text"), F.lit(ASCII_SPACE)), F.lit(1))
    initial = F.substring("role", 1, 1)
    marked = taken.select(
        "*", key.alias("key"), (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"),
    )
    order = ["conv_id", "turn", "key"]
    # ranges, not keys: a conversation of any length is spread, and rows of equal place in the order are equal rows
    placed = marked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = saved(placed, "turns")
    narrow = placed.drop("role", "text")
    first = narrow.groupBy("conv_id", "key").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("fresh"))
    fault = F.when(F.col("blank"), 1).when(F.col("fresh").isNull(), 2).when(F.col("cut"), 3).otherwise(0)
    coded = narrow.join(first, "place", "left").select("conv_id", "place", (fault * 4 + F.col("initial")).alias("code"), F.shiftright("place", SEGMENT.bit_length() - 1).alias("seg"))
    letter = lambda c: F.char(c["code"] + 65)
    segments = coded.groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("turns"))
    segments = segments.select("conv_id", "seg", F.col("turns")[0]["place"].alias("place"), F.array_join(F.transform("turns", letter), "").alias("codes"))
    segments = saved(segments, "segments")
    # one row for each conversation; of each segment only its ends and counts meet here
    count = lambda f: F.sum(F.char_length("codes") - F.char_length(F.translate("codes", "".join(chr(65 + 4 * f + i) for i in range(4)), ""))).alias(_FAULTS[f])
    kinds = F.translate("codes", "".join(chr(65 + i) for i in range(16)), "suax" * 4)
    inner = F.size(F.filter(F.sequence(F.lit(1), F.char_length("kinds")), lambda i: (i > 1) & ~F.substring(F.col("kinds"), i - 1, F.lit(2)).isin("su", "ua", "au")))
    ends = F.sort_array(F.collect_list(F.struct("seg", F.left("kinds", F.lit(1)).alias("a"), F.right("kinds", F.lit(1)).alias("b")))).alias("ends")
    convs = segments.withColumn("kinds", kinds).groupBy("conv_id").agg(
        F.min("place").alias("head"), F.min("seg").alias("first_seg"), F.max("seg").alias("last_seg"), count(1), count(2), count(3), F.sum(inner).alias("inner"), ends
    )
    joints = F.size(F.filter(F.zip_with(F.expr("slice(ends, 1, size(ends) - 1)"), F.expr("slice(ends, 2, size(ends))"), lambda a, b: F.concat(a["b"], b["a"])), lambda j: ~j.isin("su", "ua", "au")))
    convs = convs.withColumn("illegal", (F.col("inner") + F.when(F.size("ends") > 1, joints).otherwise(0)).cast("long")).drop("inner", "ends")
    wide = "decimal(38,0)"
    span = F.max("turn").cast(wide) - F.min("turn").cast(wide) + 1 - F.count("turn").cast(wide)
    gaps = narrow.select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.coalesce(F.least(span, F.lit(2**63 - 1).cast(wide)), F.lit(0)).cast("long").alias("gaps"))
    convs = saved(convs.alias("c").join(gaps.alias("g"), _same("c.conv_id", "g.conv_id")).select("c.*", "g.gaps"), "conversations")

    known = segments.alias("s").join(convs.alias("c"), _same("s.conv_id", "c.conv_id")).select(
        "c.head", "s.seg", "s.place", "s.codes", (F.col("s.seg") == F.col("c.first_seg")).alias("first"), (F.col("s.seg") == F.col("c.last_seg")).alias("last")
    )
    ways = known.drop("place").mapInPandas(_ways, "head long, seg long, start int, end int, cost long, rank int, audit string")
    ways = saved(ways, "ways")
    short = convs.where("first_seg = last_seg").select("head", F.col("first_seg").alias("seg"), F.lit(START).alias("start"), F.lit(DONE).alias("end"))
    long = ways.drop("audit").join(convs.where("first_seg < last_seg").select("head"), "head").groupBy("head").applyInPandas(_chain, "head long, seg long, start int, end int")
    chosen = saved(ways.drop("rank").join(short.unionByName(long), ["head", "seg", "start", "end"]), "chosen")
    audits = chosen.groupBy("head").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "audit"))), lambda s: s["audit"]), "").alias("audit"))
    summary = convs.join(audits, "head").select("conv_id", "head", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    edits = known.join(chosen.select("head", "seg", "start", "audit"), ["head", "seg"]).select("head", "place", "codes", "start", "audit")
    edits = edits.mapInPandas(_edits, "place long, sub int, op string, new_role string")
    own = placed.alias("p").join(convs.select("conv_id", "head").alias("c"), _same("p.conv_id", "c.conv_id")).select("c.head", "p.conv_id", "p.place", "p.role", "p.text")
    turns = edits.join(own, "place").select("head", "conv_id", "place", "sub", "op", F.coalesce("new_role", "role").alias("role"), F.when(F.col("op") == "I", "").otherwise(F.col("text")).alias("text"))
    return summary, turns


def digests(turns: DataFrame) -> DataFrame:
    """(head, repaired_sha256): SHA-256 of the `role:text` of every conversation's repaired turns, joined by line ends.
    A digest reads its text in order, so a conversation is read by one task, row by row and without being held."""
    import hashlib

    def run(batches):
        now, found = None, None
        for batch in batches:
            done = []
            for head, op, role, text in zip(batch["head"], batch["op"], batch["role"], batch["text"]):
                if head != now:
                    if now is not None:
                        done.append((now, found[0].hexdigest()))
                    now, found = head, [hashlib.sha256(), b""]
                if op != "D":
                    found[0].update(found[1] + role.encode() + b":" + text.encode())
                    found[1] = b"\n"
            yield pd.DataFrame(done, columns=["head", "repaired_sha256"])
        if now is not None:
            yield pd.DataFrame([(now, found[0].hexdigest())], columns=["head", "repaired_sha256"])

    ordered = turns.select("head", "place", "sub", "op", "role", "text").repartition("head").sortWithinPartitions("head", "place", "sub")
    return ordered.mapInPandas(run, "head long, repaired_sha256 string")
