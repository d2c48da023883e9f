"""Line dedup against a plain loop; its index can be taken back."""

import collections
import hashlib

import numpy as np

from cuemill.llm import lines

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain(rows):
    holders = collections.defaultdict(list)
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                holders[k].append(doc)
    out = {}
    for doc, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if len(holders.get(key(x), ())) < 5 or doc == max(holders[key(x)])]
        out[doc] = ("\n".join(kept), len(all_lines), len(all_lines) - len(kept))
    return out


LONG = "This line is long enough to count, as it has over forty characters"


def rows():
    out = [(k, f"own line number {k}\n  {LONG.upper() if k % 2 else LONG}\t\nshort\n\n{LONG} ") for k in range(7)]
    out += [(10 + k, f"{LONG} but not the same\nshort") for k in range(4)]
    return out + [(20, None), (21, ""), (22, "é" * 39), (23, LONG + "\n" + LONG), (24, "x y " * 30_000)]


def result(found):
    return {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in found.collect()}


def test_lines_against_a_plain_loop(make, small):
    found = lines.dedup_lines(make(rows()))
    assert result(found) == plain(rows()) and found.columns[:2] == ["doc_id", "text"] and "source" in found.columns
    docs = [(r.doc_id, r.text) for r in small.collect()]
    assert result(lines.dedup_lines(small)) == plain(docs)


def test_odd_rows(make):
    twice = [(1, LONG)] * 3 + [(None, LONG)] * 2 + [(5, None)]
    found = lines.dedup_lines(make(twice)).collect()
    assert sorted((r.doc_id is None, r.text) for r in found) == sorted([(False, LONG)] * 3 + [(True, "")] * 2 + [(False, "")])
    assert lines.dedup_lines(make([])).count() == 0


def table(index):
    return sorted(map(tuple, index.references.collect())), sorted(map(tuple, index.counts.collect()))


def test_documents_can_be_deleted_again(spark, make):
    base, more = rows()[:9], [(k, f"{LONG} but not the same\n{LONG}") for k in range(30, 36)]
    start = lines.build_index(make(base), shards=4)
    grown = lines.insert_documents(start, make(more))
    assert table(grown) == table(lines.build_index(make(base + more), shards=4))
    assert result(lines.dedup_lines(make(base + more), grown)) == plain(base + more)
    back = lines.delete_documents(grown, spark.createDataFrame([(k,) for k, _ in more], "doc_id long"))
    assert table(back) == table(start)
    assert result(lines.dedup_lines(make(base), back)) == plain(base)
    fewer = lines.delete_documents(grown, spark.createDataFrame([(35,), (34,)], "doc_id long"))
    left = [r for r in base + more if r[0] not in (34, 35)]
    assert result(lines.dedup_lines(make(left), fewer)) == plain(left)


def test_filter_never_misses_and_forgets():
    draw = np.random.default_rng(9)
    k1, k2 = draw.integers(-(2**62), 2**62, 3000), draw.integers(-(2**62), 2**62, 3000)
    held = lines.CuckooFilter.of(k1, k2)
    assert held.contains(k1, k2).all()
    other = lines.CuckooFilter.loads(held.dumps())
    other.delete(k1[:2000], k2[:2000])
    assert other.contains(k1[2000:], k2[2000:]).all() and other.contains(k1[:2000], k2[:2000]).mean() < 0.01
    assert hashlib.sha256(held.dumps()).hexdigest() != hashlib.sha256(other.dumps()).hexdigest()
