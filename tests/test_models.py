"""Models that live as long as a worker."""

import os

from pyspark.sql import functions as F

from matchlake.operators import models, retrieval
from matchlake.sources import files


def _make(folder, dim):
    open(f"{folder}/{os.getpid()}-{len(os.listdir(folder))}", "w").close()
    return lambda texts: [[float(len(x))] * dim for x in texts]


def test_a_model_is_made_once_a_worker(spark, tmp_path):
    docs = spark.createDataFrame([(f"r:{i}", "x" * i, {"a": "b"}) for i in range(1, 41)], files.DOCUMENT).repartition(4)
    model = models.Model(f"m-{tmp_path}", _make, (str(tmp_path), 3))
    for _ in range(2):
        rows = retrieval.embed_documents(docs, "e", model, 3).collect()
        assert len(rows) == 40 and all(list(r.embedding) == [float(len(r.text))] * 3 for r in rows)
    made = [n.split("-")[0] for n in os.listdir(tmp_path)]
    assert made and len(made) == len(set(made))


def test_the_model_unused_for_longest_goes():
    made = []
    some = [models.Model(f"k{i}", lambda i=i: made.append(i) or (lambda texts: [[i]])) for i in range(models.KEPT + 1)]
    assert [m(["x"]) for m in some[: models.KEPT]] == [[[i]] for i in range(models.KEPT)]
    some[0](["x"])
    some[-1](["x"])
    some[0](["x"])
    some[1](["x"])
    assert made == [*range(models.KEPT + 1), 1]


def test_decoded_runs(spark):
    rows = spark.createDataFrame([('{"a": 0.5}', '{"m": {"f1": 1.0}}', "{}"), ("[1]", "no json", None)], "feature_importances string, map_segment_metrics string, half_segment_metrics string")
    a, b = retrieval.decoded(rows).collect()
    assert (a.feature_importances, a.map_segment_metrics, a.half_segment_metrics) == ({"a": 0.5}, {"m": {"f1": 1.0}}, {}) and tuple(b) == (None, None, None)


def test_vectors_that_are_not_finite_take_no_part(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [nan, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0]), (4, [float("inf"), 0.0]), (5, [0.0, 0.0]), (6, None)], "vec_id long, embedding array<double>")
    best = retrieval.top_k(rows, retrieval.cosine(F.col("embedding"), [1.0, 0.0]), 5, "vec_id").orderBy("rank").collect()
    assert [r.vec_id for r in best] == [0, 2, 3]
    asked = rows.where("vec_id IN (0, 1)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in retrieval.top_k_batch(rows, asked, 2, 2).collect())
    assert got == [(0, 1, 0), (0, 2, 2)]
