"""Near-duplicates of tables whose ids are repeated or null."""

from matchlake.llm import minhash, stages
from tests.llm.test_text_operators import prose

A, B, D, E, G = (prose(k) for k in (11, 12, 13, 14, 15))
NEAR_B = B + " more"
SCHEMA = "doc_id long, text string, lang string"


def test_links_of_all_sets_of_an_id(spark):
    rows = [(1, A), (1, B), (2, B), (3, NEAR_B), (4, D), (5, NEAR_B + " words"), (5, E), (6, E), (None, G)]
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 1, False), (6, 1, False), (None, None, True)}


def test_link_without_the_shared_id(spark):
    rows = [(2, B), (3, NEAR_B), (4, A), (4, B), (1, A)]
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1)}


def test_stage_decides_by_id_and_text(spark):
    rows = [(0, B), (1, A), (1, B), (5, D), (5, E), (5, E), (None, G), (None, G), (None, NEAR_B), (None, ""), (None, " "), (7, ""), (7, None), (8, NEAR_B)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], SCHEMA)
    got = stages.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    key = lambda r: (-1 if r[0] is None else r[0], (r[1] or "").strip())
    want = [(0, B), (1, A), (5, D), (5, E), (None, G), (None, ""), (None, ""), (7, "")]
    assert sorted(map(key, got.collect())) == sorted(map(key, want))
