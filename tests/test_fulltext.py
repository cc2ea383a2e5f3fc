"""Stems, web-style queries and ranks against plain definitions."""

import math
import random

import pytest

from matchlake.operators import fulltext, retrieval

STEMS = "consign consigned consigning consignment consistency consolation consolatory console consoled consoles consolingly conspicuously conspiracy conspirators constable constancy knackeries knavish kneaded knees knightly knitting knives knocker relational agreed flies dies generously hopping hoping skies news inning university"
WANT = "consign consign consign consign consist consol consolatori consol consol consol consol conspicu conspiraci conspir constabl constanc knackeri knavish knead knee knight knit knive knocker relat agre fli die generous hop hope sky news inning univers"


def test_stems():
    assert [fulltext.stem(w) for w in STEMS.split()] == WANT.split()
    assert fulltext.stem("de_x") == "de_x" and fulltext.stem("é") == "é" and fulltext.stem("0.73") == "0.73"


def test_parsing():
    q = fulltext.parse('running or "gradient of boosting" -logistic the')
    assert q.alternatives == ((fulltext.Word(("run",), (0,)),), (fulltext.Word(("gradient", "boost"), (0, 2)), fulltext.Word(("logist",), (0,), False)))
    assert not q.together and fulltext.parse("a b c").together and fulltext.parse('"x y"').together and not fulltext.parse("-x").together and fulltext.parse("-x").open
    assert fulltext.parse("the of").alternatives == () and fulltext.parse("").alternatives == () and fulltext.parse('"open quote').alternatives == ((fulltext.Word(("open", "quot"), (0, 1)),),)


def _brute(docs, query):
    """doc -> score by the formulas, over lists of terms."""
    q, out = fulltext.parse(query), {}
    for doc, text in docs:
        words = [w for w in (text or "").lower().replace(",", " ").split()]
        at = {}
        for k, w in enumerate(words):
            if w not in fulltext.STOP_WORDS:
                at.setdefault(fulltext.stem(w), []).append(k + 1)

        def holds(word):
            first = [p for p in at.get(word.terms[0], ()) if all(p + k in at.get(t, ()) for t, k in zip(word.terms, word.at, strict=True))]
            return bool(first) == word.wanted

        if not any(all(holds(w) for w in a) for a in q.alternatives):
            continue
        if q.together and len(q.terms) > 1:
            res = -1.0
            for i, a in enumerate(q.terms):
                for b in q.terms[:i]:
                    for x in at.get(a, ()):
                        for y in at.get(b, ()):
                            gap = abs(x - y)
                            c = math.sqrt(0.01 * (1e-30 if gap > 100 else 1 / (1.005 + 0.05 * math.exp(gap / 1.5 - 2))))
                            res = c if res < 0 else 1 - (1 - res) * (1 - c)
            out[doc] = res if res > 0 else 1e-20
        else:
            out[doc] = sum(0.1 / (j + 1) ** 2 for t in q.terms for j in range(len(at.get(t, ())))) / 1.64493406685 / len(q.terms)
    return out


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(1)
    words = "boosting boosted gradient gradients the of logistic running runs map maps side".split()
    return [(k, " ".join(rng.choice(words) for _ in range(rng.choice((3, 8, 150))))) for k in range(60)] + [(100, None), (101, ""), (102, "the of the"), (103, "Gradient, of boosting")]


@pytest.mark.parametrize("query", ["gradient", "boost gradient", '"gradient of boosting"', "run or map -side", "-boost", "maps -boost -gradient", '"gradient boosting" or logistic', "the", "nothing", "boost boosted"])
def test_matches_and_ranks(spark, tmp_path, docs, query):
    table = spark.createDataFrame(docs, "id long, body string")
    fulltext.write_index(fulltext.postings(table, ["id"], "body"), str(tmp_path))
    for index in (fulltext.postings(table, ["id"], "body"), spark.read.parquet(str(tmp_path))):
        got = {r.id: r.score for r in fulltext.matches(index, query, ["id"], table).collect()}
        want = _brute(docs, query)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_index_reads_only_the_buckets_of_its_terms(spark, tmp_path, docs):
    fulltext.write_index(fulltext.postings(spark.createDataFrame(docs, "id long, body string"), ["id"], "body"), str(tmp_path))
    plan = fulltext.matches(spark.read.parquet(str(tmp_path)), "logistic", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("\n", "") or "PartitionFilters: [bucket" in plan


def test_best_runs_with_a_given_index(spark):
    rows = spark.createDataFrame([("a", "m1", "boosting with trees", 1), ("a", "m2", "boosted boosting boosts", 2), ("b", "m1", "logistic", 3)], "run_id string, model_name string, search_text string, created_at int")
    index = fulltext.postings(rows, retrieval.RUN_KEY)
    best = retrieval.fts(rows, "boost", 5, index=index).orderBy("rank").collect()
    assert [(r.run_id, r.model_name, r["rank"]) for r in best] == [("a", "m2", 1), ("a", "m1", 2)]
    assert retrieval.fts(rows, "boost", 5, "m1").count() == 1 and retrieval.fts(rows, "zebra", 5).count() == 0
