"""Jobs on single texts against plain versions."""

import collections
import hashlib
import json
import random
import re
import struct
import time

import numpy as np
import public_tokenizers
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cuemill.llm import language, maintext, packing, pieces, pii, sharding, syncmers

BPE, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a  b \n c ", " x", "\n \nq  ", "a<|endoftext|>b", "é 漢字 😀 ▁a   zz", "x" * 300, "tab\there nb", "aaaaaaa ▁▁", "it's\r\n  'quoted'", "a\n b \n", "  z", "0 " * 50]


def test_token_ids_are_the_tokenizers_own(small):
    texts = ODD + [r.text for r in small.limit(60).collect()]
    own, whole = packing.Encoder(BPE), Tokenizer.from_file(BPE)
    for text in texts:
        assert np.frombuffer(own(text), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids, text[:40]


def check_packing(pieces_, window=1024):
    rows = pieces_.sort_values(["sequence_id", "offset"])
    follows = (rows.offset + rows.length).shift().where(rows.sequence_id.eq(rows.sequence_id.shift()), 0)
    assert (rows.offset == follows).all() and (rows.offset + rows.length <= window).all()
    full = rows.groupby("sequence_id").length.sum()
    assert (full < window).sum() <= 1
    return rows


def test_packing_covers_every_token_once(small):
    rows = check_packing(packing.pack_documents(small, BPE).toPandas())
    whole = Tokenizer.from_file(BPE)
    for doc in small.limit(40).collect():
        ids = np.array(whole.encode(doc.text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        own = rows[rows.doc_id == doc.doc_id].sort_values("start")
        assert own.doc_tokens.eq(len(ids)).all() and own.start.tolist() == [0, *own.length.cumsum()[:-1]]
        assert (np.concatenate([np.frombuffer(x, "<u2") for x in own.ids]) == ids).all()
        assert [packing.crc(ids[s : s + n]) for s, n in zip(own.start, own.length)] == own.ids_crc32.tolist()


def test_packing_edge_rows(make):
    rows = check_packing(packing.pack_documents(make([(1, None), (2, ""), (2, ""), (None, "a b"), *[(k, "the " * 700) for k in range(10, 40)]]), BPE, with_ids=False).toPandas())
    assert rows.length.sum() == 3 + 3 + rows[rows.doc_id == 10].doc_tokens.iloc[0] * 30
    assert packing.pack_documents(make([]), BPE).count() == 0


def test_plan_fits_a_histogram_without_cuts():
    histogram = np.zeros(1025, dtype=np.int64)
    histogram[[700, 324, 512, 300, 412, 312]] = [50, 50, 40, 10, 10, 10]
    plan, stream, sequences = packing.pack_plan(histogram)
    assert sequences == 80 and (stream[1] == histogram).all()


def test_main_text_of_pages(spark):
    pages = {
        "<html><body><nav><a href=x>Menu</a></nav><article><h1>A &amp; B</h1><p>One <b>two</b>three<br>four</p><p>Five\n six</article><footer>f</footer></body></html>": "A & B One twothree four Five six",
        "<body><div class='ad'>Buy now, a lot of text that is an advert and nothing else</div><article><p>Text of the page.</p><div class=comments><p>I agree with all of it</p></div></article></body>": "Text of the page.",
        "<body><div id=main><p>A long paragraph with many words in it, so that it is dense.</p><p>And a second one, of about the same size, to follow it.</p></div><ul><li><a href=1>one</a><li><a href=2>two</a></ul></body>": "A long paragraph with many words in it, so that it is dense. And a second one, of about the same size, to follow it.",
        "<article><p>x &lt;b&gt; &#233;<script>var a='<p>no</p>'</script><style>p{}</style><form><input><label>Name</label></form></article>": "x <b> é",
        "<body><div id=page><div id=c><h1>Head</h1><div><p>Words of the first paragraph, quite a few of them here.</p><p>Words of the second paragraph, quite a few as well.</p></div></div><div><ul><li><a href=1>l</a></ul></div></div></body>": "Head Words of the first paragraph, quite a few of them here. Words of the second paragraph, quite a few as well.",
        "<body><div id=header><p>Site name and motto of the site</p></div><main><div class='article-header'><h1>Top</h1></div><p title='a hidden id'>Body text.</p><p hidden>Not seen</p></main></body>": "Top Body text.",
        "plain words only": "plain words only",
        "<body><nav>only a menu</nav></body>": "",
        "<!-- nothing --": "",
        "<article><p>never closed <i>and cut <a href='x": "never closed and cut <a href='x",
    }
    rows = [(i, None, h, "x") for i, h in enumerate(pages)] + [(90, "u", None, "x"), (91, "u", "", "x"), (None, "u", "<p>y</p>", "x"), (92, None, "<div>" * 5000 + "deep", "x")]
    found = maintext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).toPandas()
    assert found[found.page_id < 90].text.tolist() == list(pages.values())
    assert found.n_chars.tolist() == [len(t) for t in found.text] and found.text.tolist()[-4:] == ["", "", "y", "deep"]


def test_every_test_page_gives_its_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for row, page in zip(maintext.extract(pages).collect(), pages.collect()):
        body = page.html.split("<article>")[1].split("</article>")[0].split("<footer>")[0]
        import html

        assert row.text == " ".join(html.unescape(re.sub(r"<(/?)(\w+)[^>]*>", lambda m: "" if m[2] == "b" else " ", body)).split())


def test_main_text_without_telling_tags(spark):
    """The density alone finds the article: the given pages with article made div and h1 made h2 give the same text."""
    for page in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        want = maintext.main_text(page.html)
        plain = re.sub(r"<(/?)article", r"<\1div", page.html)
        assert maintext.main_text(plain) == want
        assert maintext.main_text(re.sub(r"<(/?)h1", r"<\1h2", plain)) == want


def test_main_text_in_named_wrappers():
    p = "<p>" + " ".join(["word"] * 100) + "</p>"
    words, links = " ".join(["word"] * 200), "<ul>" + "".join(f"<li><a href=x>link {i}</a></li>" for i in range(20)) + "</ul>"
    pages = {
        f'<article class="post has-sidebar"><h2>Head</h2>{p}{p}</article>': "Head " + words,
        f'<body><div class="layout has-sidebar">{p}{p}</div></body>': words,
        f'<div class="story share-price"><h2>Head</h2>{p}{p}</div>': "Head " + words,
        f"<body><article><h1>H</h1>{p}{links}{p}</article>": "H " + words,
        f"<body><form><div>{p}{p}</div><input></form>": words,
        f'<body><article><h1>H</h1><p>short one.</p></article><section class="comments">{p}{p}</section>': "H short one.",
        f'<body><header><nav><a href=1>x</a></nav></header><div id=w><h1>T</h1><div>{p}</div><div>{p}</div></div><div class="cookie-notice">We use cookies</div>': "T " + words,
        f"<body><div><section><h2>One</h2>{p}</section><section><h2>Two</h2>{p}</section><p>End.</p></div><div class=related><a href=1>q</a></div>": f"One {words[:499]} Two {words[:499]} End.",
    }
    for html, text in pages.items():
        assert maintext.main_text(html) == text, html[:60]


def test_main_text_of_broken_pages_in_linear_time():
    for part in ('<a "', "<!", "<a '\"", "<p><b><i>", "<li><div>", "<div>"):
        started = time.perf_counter()
        maintext.main_text(part * 40_000 + "</x></section></span>" * 10_000)
        assert time.perf_counter() - started < 8, part


def test_piece_paths_are_the_models_own(small):
    machine, model = pieces.Transducer(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    draw = random.Random(2)
    texts = ODD + [r.text for r in small.collect()] + ["".join(draw.choice("aabbab ▁") for _ in range(60)) for _ in range(300)]
    for text in texts:
        ids = np.frombuffer(machine.encode(text), "<i4").tolist()
        assert ids == model.encode(text) and machine.decode(ids) == model.decode(ids)
    broken = [machine.byte[0xE6], machine.byte[0x41], 300]
    assert machine.decode(broken) == model.decode(broken)


def test_piece_jobs(make):
    docs = make([(1, "hello  world"), (None, None), (2, ""), (3, "é漢"), (3, "é漢")])
    encoded = pieces.encode(docs, MODEL)
    assert sorted(r.text for r in pieces.decode(encoded, MODEL).collect()) == ["", "", "hello  world", "é漢", "é漢"]
    assert [r.decoded for r in pieces.encode_and_decode(docs, MODEL).collect()] == ["hello  world", "", "", "é漢", "é漢"]
    assert pieces.encode(make([]), MODEL).count() == 0


def test_lookup_table_shares_and_moves():
    names = [f"s{k}" for k in range(10)]
    before, after = sharding.lookup_table(names, 1009), sharding.lookup_table(names[:-1], 1009)
    sizes = np.bincount(before)
    assert sizes.max() - sizes.min() <= 1 and -1 not in before
    moved = sum(names[a] != names[b] for a, b in zip(before, after))
    assert moved <= 1009 * 0.25


def test_placement(make):
    docs = make([(k, "t") for k in range(2000)] + [(None, None), (5, "again")])
    names = [f"s{k}" for k in range(8)]
    found = sharding.place(docs, names)
    assert sorted(found.columns) == sorted(set(docs.columns) | {"shard"})
    owners = sharding.lookup_table(names)
    for row in found.collect():
        slot = int(hashlib.md5(str("" if row.doc_id is None else row.doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (row.slot, row.shard) == (slot, names[owners[slot]])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "Python" not in plan
    assert sharding.place(make([]), names).count() == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def passes(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
            return 12 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    kinds = list(PLAIN)
    spans = sorted((m.start(), kinds.index(k), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if passes(k, m[0]))
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def test_personal_data_base_spans(small, make):
    draw = random.Random(4)
    odd = ["".join(draw.choice("1234567890..--++ @@ab_%é😀()") for _ in range(120)) for _ in range(150)]
    odd += ["a@b.c_d@e.org", "x@y.z@q.w", "1.2.3.4.5.6.7.8", "001.02.3.255 1.2.3.256", "4111 1111 1111 1111-2", "+49 (30) 1234-567 89.", "+1 ((( 5", "é" * 40 + " a@b.co"]
    rows = [(i, t) for i, t in enumerate(odd + [r.text for r in small.limit(80).collect()])]
    found = pii.find(make([*rows, (None, None), (7000, "")])).toPandas()
    for (_, text), base in zip(rows, found.base):
        assert base == plain_spans(text), text[:60]
    assert found.base.tolist()[-2:] == ["", ""] and found.spans.tolist()[-2:] == ["", ""]
    plan = pii.find(make([]))
    assert plan.count() == 0 and "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def test_personal_data_time_grows_with_the_text(make):
    long = ["a" * 50_000, "1" * 50_000, "1 " * 25_000, "+1" + " " * 50_000, "a@" * 25_000, "1." * 5_000, "A1" * 25_000, "a-" * 25_000 + " at ", "aa: " * 9_000]
    start = time.time()
    pii.find(make(list(enumerate(long)))).collect()
    assert time.time() - start < 60


def test_redaction_and_added_spans(make):
    rows = [(1, "Mail a.b@c.org_x@d.com or +49 (30) 1234 5678, card 4111-1111 1111 1111. ok 10.0.0.1"), (2, None), (3, ""), (4, "plain words 12"), (5, 'login token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end')]
    found = pii.redact(make(rows)).toPandas().set_index("doc_id").text
    assert found[1] == "Mail [EMAIL][EMAIL] or [PHONE], card [CARD]. ok [IP]"
    assert found[2] is None and found[3] == "" and found[4] == "plain words 12" and found[5] == 'login [SECRET]" end'


def test_language_gradients():
    draw = np.random.default_rng(0)
    codes, truth = draw.integers(97, 105, (6, 12)).astype(np.uint8), np.array([0, 1, 0, 1, 0, 1])
    net = language.new_network(["x", "y"], 3, 1)

    def loss():
        p = language.probabilities(net, np.ascontiguousarray(codes.T))
        return -np.log(p[:, np.arange(6), truth]).mean()

    keep = []
    ahead = language.states(net.tables[0], net.matrices[0], np.ascontiguousarray(codes.T), keep)
    back = language.states(net.tables[1], net.matrices[1], np.ascontiguousarray(codes.T)[::-1])[::-1]
    scores = np.concatenate([ahead, back], axis=2) @ net.output + net.offset
    p = np.exp(scores - scores.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    p[:, np.arange(6), truth] -= 1
    p /= p.shape[0] * p.shape[1]
    slope = (p @ net.output.T)[:, :, :3]
    g_table, g_matrix = language._back(net.tables[0], net.matrices[0], np.ascontiguousarray(codes.T), keep, slope)
    for weights, slopes, at in ((net.matrices[0], g_matrix, (1, 2)), (net.matrices[0], g_matrix, (2, 7)), (net.tables[0], g_table, (int(codes[0, 3]), 8)), (net.tables[0], g_table, (int(codes[1, 5]), 1))):
        old = weights[at]
        weights[at] = old + 1e-2
        up = loss()
        weights[at] = old - 1e-2
        down = loss()
        weights[at] = old
        assert abs((up - down) / 2e-2 - slopes[at]) < 2e-4 + 0.05 * abs(slopes[at])


def test_language_on_held_out_documents(spark, make):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.97 and found.score.between(0, 1).all()
    net = language.fit(docs, rounds=2)
    odd = language.predict(make([(1, None), (2, ""), (3, "123 ,.!"), (None, "the and of"), (3, "123 ,.!"), (4, "the " * 30_000)]), net).toPandas()
    assert odd.lang_pred.tolist() == ["und", "und", "und", odd.lang_pred[3], "und", "en"] and odd.score[:3].eq(0).all()
    assert language.identify(make([(1, "words", None)])).collect()[0].lang_pred == "und"
    assert language.identify(make([])).count() == 0
    kept = language.accepted(make([(1, None, "en"), (2, "12"), (3, "the and"), (3, "the and")]), net)
    assert [r.doc_id for r in kept.collect()] == [3, 3] and len(kept.columns) == 9


def signed(data: bytes, seed: int) -> int:
    h = xxhash.xxh64_intdigest(data, seed)
    return h - (1 << 64) if h >> 63 else h


def chained(values) -> int:
    seed = 42
    for v in values:
        seed = signed(struct.pack("<q", v), seed % (1 << 64))
    return seed


def plain_anchors(text: str) -> list[tuple[int, int]]:
    """(place, hash) of the closed syncmers of a text, by a plain loop."""
    words = [x for w in re.findall(r"[^\x20\x09-\x0D]+", text) for x in (w if len(w) > 64 else [w])]
    if len(words) < 4:
        return [(0, None)] if words else []
    runs = [chained([signed(a.encode(), 42), signed(b.encode(), 42)]) for a, b in zip(words, words[1:])]
    return [(i, chained(runs[i : i + 3])) for i in range(len(words) - 3) if min(runs[i : i + 3]) in (runs[i], runs[i + 2])]


def plain_likeness(a: str, b: str) -> float | None:
    x, y = ([h if h is None else h & -2 for _, h in plain_anchors(t)] for t in (a, b))
    if None in x or None in y:
        return None
    return 2 * (collections.Counter(x) & collections.Counter(y)).total() / (len(x) + len(y)) if x or y else 1.0


def test_syncmers_are_closed_and_context_free(spark, make):
    draw = random.Random(6)
    vocabulary = [f"w{i}" for i in range(500)]
    text = [draw.choice(vocabulary) for _ in range(300)]
    changed = text[:150] + ["new"] + text[150:]
    rows = make([(1, " ".join(text)), (2, " ".join(changed))])
    runs = [r.h for r in spark.createDataFrame([(a, b) for a, b in zip(text, text[1:])], "a string, b string").select(F.xxhash64(F.xxhash64("a"), F.xxhash64("b")).alias("h")).collect()]
    expected = [i for i in range(len(text) - 3) if min(runs[i : i + 3]) in (runs[i], runs[i + 2])]
    found = syncmers.anchor_positions(rows).toPandas()
    first, second = found[found.doc_id == 1], found[found.doc_id == 2]
    assert first.position.tolist() == expected
    before, after = first[first.position <= 146], first[first.position >= 150]
    assert before.anchor.tolist() == second[second.position <= 146].anchor.tolist()
    assert after.anchor.tolist() == second[second.position >= 151].anchor.tolist()


def check_edits(docs, found):
    ordered = docs.sort_values("doc_id", ascending=False)
    texts = ordered.text.fillna("").tolist()
    for k, (doc, text) in enumerate(zip(ordered.doc_id, texts)):
        other, half = texts[(k + 1) % len(texts)], len(text) // 2
        edit = text[: len(text) - half] + other[:half]
        row = found[found.doc_id == doc].iloc[0]
        assert row.edited_text == edit and row.n_chars == len(text)
        for near, second in ((row.near_edited, edit), (row.near_next, other)):
            want = plain_likeness(text, second)
            assert want is None or abs(near - want) < 1e-9, doc


def test_edits_against_a_plain_loop(small):
    found = syncmers.compare_with_edits(small).toPandas()
    check_edits(small.toPandas(), found)
    long = found[found.n_chars > 300]
    assert long.near_edited.between(0.1, 1).all() and long.near_edited.mean() > 0.4 and found[["near_edited", "near_next"]].stack().between(0, 1).all()


def test_edits_over_many_ranges_and_odd_rows(make):
    rows = [(k * k * 7 - 900, f"text {k} " + "é😀 word " * (k % 7)) for k in range(120)] + [(10**15, "far away"), (-(10**15), None)]
    docs = make(rows)
    plain = docs.toPandas()
    check_edits(plain, syncmers.compare_with_edits(docs).toPandas())
    near = syncmers.with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), per_range=5).toPandas().set_index("doc_id")
    ordered = plain.sort_values("doc_id", ascending=False)
    texts = ordered.text.fillna("").tolist()
    assert [near.next[d]["text"] for d in ordered.doc_id] == texts[1:] + texts[:1]
    odd = syncmers.compare_with_edits(make([(1, "a b c d e"), (1, "a b c d e"), (None, None), (None, "x"), (2, "")])).toPandas()
    assert len(odd) == 5 and odd[odd.doc_id == 1].fingerprint.nunique() == 1
    alone = syncmers.compare_with_edits(make([(1, "one two three four five six")])).toPandas().iloc[0]
    assert alone.edited_text == "one two three " + "one two three"[:13] and alone.near_next == 1
    assert syncmers.compare_with_edits(make([])).count() == 0
    assert json.loads(json.dumps(alone.fingerprint))


def test_edits_of_ids_spread_over_all_longs(make):
    draw = random.Random(4)
    rows = [(draw.randrange(-(2**63), 2**63), f"some text {k} " + "word " * (k % 9)) for k in range(300)] + [(-9 * 10**18, "low"), (0, "zero"), (9 * 10**18, "high")]
    docs = make(rows)
    check_edits(docs.toPandas(), syncmers.compare_with_edits(docs).toPandas())
    hot = make(rows + [(77, f"hot {draw.random()}") for _ in range(400)]).select("doc_id", "text")
    plain = hot.withColumn("h", F.xxhash64("text")).toPandas().sort_values(["doc_id", "h"], ascending=[False, True])
    near = syncmers.with_next(hot, per_range=20).toPandas()
    follows = {r.text: r.next["text"] for r in near.itertuples()}
    texts = plain.text.tolist()
    assert [follows[t] for t in texts] == texts[1:] + texts[:1]
    spread = hot.select(syncmers._ranges(hot, 20).alias("range")).groupBy("range").count().toPandas()
    assert len(spread) > 20 and spread["count"].max() <= 60


def test_likeness_counts_all_anchors_and_texts_without_spaces(make):
    draw = random.Random(9)
    a, b = ([f"{c}{draw.randrange(300 if c == 'a' else 10**6)}" for _ in range(3000)] for c in "ab")
    b[1500:1520], b[2000:2600] = a[40:60], a[40:640]
    han = ["".join(chr(draw.randrange(0x4E00, 0x9000)) for _ in range(400)) for _ in range(2)]
    junk = "".join(draw.choice("0123456789abcdef") for _ in range(900))
    texts = {6: " ".join(a), 5: " ".join(b), 4: han[0], 3: han[0][:300] + han[1], 2: junk, 1: "😀 " + junk}
    docs = make(list(texts.items()))
    found = syncmers.compare_with_edits(docs).toPandas().set_index("doc_id")
    places = syncmers.anchor_positions(docs).toPandas()
    of = {k: collections.Counter(places[places.doc_id == k].anchor) for k in texts}
    for k in range(6, 1, -1):
        common = (of[k] & of[k - 1]).total()
        assert abs(found.near_next[k] - 2 * common / (of[k].total() + of[k - 1].total())) < 1e-9
        mine = places[places.doc_id == k].sort_values("position")
        assert found.fingerprint[k] == "".join(f"{p:08x}{h % 2**64:016x}" for p, h in zip(mine.position, mine.anchor))
    assert 0.15 < found.near_next[6] < 0.25 and found.near_next[4] > 0.5 and found.near_next[2] > 0.95
    assert found.near_edited[4] > 0.4 and found.near_edited[3] > 0.4


def test_long_secrets_and_addresses_are_redacted_whole(make):
    draw = random.Random(3)
    token = "".join(draw.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789_-") for _ in range(1000))
    rows = [(1, f'login token = "{token}" end'), (2, f"mail {'long.name' * 9}1 [at] {'host-' * 15}x [dot] org now")]
    found = pii.redact(make(rows)).toPandas().set_index("doc_id").text
    assert found[1] == 'login [SECRET]" end' and "long.name" not in found[2] and "host-" not in found[2]
