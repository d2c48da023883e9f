"""The pipeline and the registered queries of the subpackage."""

import random

import pytest

import corpus_pipeline
from cuemill.llm import language, lines, pii, queries, sharding, similar
from cuemill.llm.shared import saved
from tests.oracle import duck

SF = "/root/testdata/sf0.001"


def test_stages_hand_on_documents(spark, small):
    docs, before = small, small.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = saved(stage(spark, docs, SF), "stage")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == small.columns and 0.8 * before < docs.count() <= before
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} <= {r.doc_id for r in small.collect()}
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` < 1024").count() <= 1


def test_pipeline_on_an_empty_table(spark, small):
    docs = small.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF), "stage")
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    found = queries.QUERIES[name](spark, SF).toPandas()
    columns = sorted(found.columns)
    expected = duck(SF).sql(queries.ORACLES[name]).df()
    assert sorted(expected.columns) == columns
    assert sorted(map(tuple, found[columns].to_numpy().tolist())) == sorted(map(tuple, expected[columns].to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_returns_a_row_for_each_of_its_table(spark, name):
    rows = queries.QUERIES[name](spark, SF)
    of = {"op2_main_text": "pages", "op4_quantised_vectors": "embeddings"}.get(name, "documents")
    n = spark.read.parquet(f"{SF}/{of}.parquet").count()
    if name.startswith("op12_"):
        n = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    assert rows.count() >= n if name.startswith(("op1_", "op13_")) else rows.count() == n


CLASHING = ["_lines", "_left", "_gone", "_doc", "gone", "gone_doc", "lines", "left", "carried", "none", "_values", "_gaps", "_starts", "_sizes", "_reach", "_email",
            "_base", "_spans", "_loose", "_scored", "_slot", "_shard", "at", "key", "letters", "_letters", "row", "c0", "c1"]


def test_columns_of_any_name_pass_through_every_stage(spark):
    rows = [(k, f"A text number {k} with a mail a{k}@b.org in it, long enough to count.\nshared line that stands in every one of the documents", "en", *range(len(CLASHING))) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{c} int" for c in CLASHING))
    jobs = {
        "lines": lambda: lines.dedup_lines(docs), "pii": lambda: pii.redact(docs), "sharding": lambda: sharding.place(docs, ["a", "b"]),
        "language": lambda: language.accepted(docs, None),
    }
    for name, job in jobs.items():
        found = job().toPandas().sort_values("doc_id")
        assert list(found.columns[: len(docs.columns)]) == docs.columns, name
        assert (found[CLASHING].to_numpy() == list(range(len(CLASHING)))).all() and len(found) == 8, name
    assert "[EMAIL]" in jobs["pii"]().first().text and lines.dedup_lines(docs).where("doc_id < 7 and text like '%shared%'").count() == 0


def test_rows_that_share_an_id_or_have_none_are_documents_of_their_own(spark):
    words = [" ".join(f"w{d}x{k}" for k in range(60)) for d in range(5)]
    rows = [(1, words[0]), (1, words[1]), (1, words[0]), (2, words[1] + " more"), (None, words[2]), (None, words[2]), (None, words[0]), (3, words[3]), (None, words[4])]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == sorted([(1, words[0]), (1, words[1]), (-1, words[2]), (3, words[3]), (-1, words[4])])
    assert kept.columns == docs.columns


def test_near_copies_of_short_texts_are_all_found(spark):
    """Pairs of a similarity of just 0.8 or more, by number of words, beside other texts that share their passages."""
    draw = random.Random(12)
    rows, pairs = [], []
    for length in (8, 9, 13, 20, 40, 68):
        for _ in range(60):
            text = [f"w{draw.randrange(3000)}" for _ in range(length)]
            more = text + [f"z{draw.randrange(3000)}" for _ in range((length - 4) // 4)]
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(more))]
    hot = " ".join(f"licence{k}" for k in range(12))
    rows += [(len(rows) + k, hot + " " + " ".join(f"v{draw.randrange(10**6)}" for _ in range(5 + k % 3))) for k in range(700)]
    found = similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id").component_id
    assert all(found[a] == found[b] for a, b in pairs)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for _, t in rows]
    other = [k for k in found.index if found[k] != k]
    for k in other:  # and nothing is linked that is not similar to some member of its group
        group = [g for g in found.index[found == found[k]] if g != k]
        assert any(len(sets[k] & sets[g]) >= 0.8 * len(sets[k] | sets[g]) - 1e-9 for g in group)
