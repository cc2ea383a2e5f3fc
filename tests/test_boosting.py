"""Boosting on histograms against plain loops, and one partition against several."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlake.operators import boosting, learning


def table(spark, n=700, seed=1):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=n), rng.integers(0, 7, n).astype(float), rng.choice(["x", "y", "z"], n)
    y = (a + (b > 3) * 1.5 + (c == "y") + rng.normal(size=n) > 1.2).astype(int)
    return spark.createDataFrame(list(zip(a.tolist(), b.tolist(), c.tolist(), y.tolist(), rng.integers(0, 50, n).tolist(), strict=True)), "a double, b double, c string, y int, file long")


def test_a_level_splits_where_a_loop_does():
    rng = np.random.default_rng(2)
    bins, g, h = rng.integers(0, 9, (300, 4)).astype(np.uint8), rng.normal(size=300), rng.random(300) + 0.1
    node = rng.integers(0, 3, 300)
    s = boosting.Settings(min_rows=15)
    sums = boosting.histogram(bins, node, [1, 2], g, h, 9)
    grown = boosting._Growth(feature=[-1] * 3, bin=[0] * 3, left=[0] * 3, gain=[0.0] * 3, sums=[(0.0, 0.0)] * 3, open=[1, 2])
    grown.split(sums, s)
    for k in (1, 2):
        best = None
        for f in range(4):
            for b in range(9):
                left, right = (node == k) & (bins[:, f] <= b), (node == k) & (bins[:, f] > b)
                if min(left.sum(), right.sum()) < 15:
                    continue
                gain = sum(g[m].sum() ** 2 / h[m].sum() for m in (left, right)) - g[node == k].sum() ** 2 / h[node == k].sum()
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, f, b)
        assert (grown.feature[k], grown.bin[k]) == best[1:] and abs(grown.gain[k] - best[0]) < 1e-9


def test_leaves_take_newton_steps_and_the_greatest_gains_are_kept():
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 30, (2000, 5)).astype(np.uint8)
    y = ((bins[:, 0] > 12).astype(float) + (bins[:, 1] > 20) + rng.normal(size=2000) > 1).astype(float)
    g, h = boosting.gradients(y, np.zeros(2000))
    s = boosting.Settings(leaves=6)
    tree = boosting.grow(lambda t, open_: boosting.histogram(bins, t.leaves(bins), open_, g, h, 30), s)
    at = tree.leaves(bins)
    assert len(np.unique(at)) == 6 and (tree.feature >= 0).sum() == 5
    for leaf in np.unique(at):
        assert abs(tree.value[leaf] + s.rate * g[at == leaf].sum() / h[at == leaf].sum()) < 1e-9 and (at == leaf).sum() >= 20


def test_several_partitions_give_the_trees_of_one(spark, monkeypatch):
    monkeypatch.setattr(boosting, "KEPT_TREES", 2)
    rows, s = table(spark), boosting.Settings(rounds=5, depth=3)
    one = boosting.fit(rows, "y", ["a", "b"], ["c"], s)
    more = boosting.fit(rows, "y", ["a", "b"], ["c"], s, partition_rows=300)
    assert one.features.names == more.features.names == ["a", "b", "c=x", "c=y", "c=z"]
    for x, y in zip(one.trees, more.trees, strict=True):
        assert (x.feature.tolist(), x.bin.tolist(), x.left.tolist()) == (y.feature.tolist(), y.bin.tolist(), y.left.tolist()) and np.allclose(x.value, y.value)
    assert one.base == more.base


def test_as_good_as_boosted_trees_by_exact_rounds(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows, held = table(spark, 1500).coalesce(1).cache(), table(spark, 1500, 9).coalesce(1).cache()
    ours = boosting.fit(rows, "y", ["a", "b"], ["c"], boosting.Settings(rounds=60, depth=3))
    auc = learning.metrics(held.withColumn("p", ours.probability())).first().roc_auc
    index = StringIndexer(inputCol="c", outputCol="i").fit(rows)
    made = lambda df: VectorAssembler(inputCols=["a", "b", "i"], outputCol="v").transform(index.transform(df))
    other = GBTClassifier(featuresCol="v", labelCol="y", maxIter=15, maxDepth=3, stepSize=0.2, seed=1).fit(made(rows))
    theirs = learning.metrics(other.transform(made(held)).withColumn("p", vector_to_array("probability")[1])).first().roc_auc
    assert auc > 0.8 and abs(auc - theirs) < 0.02


def test_odd_tables(spark):
    rows = table(spark, 60)
    flat = boosting.fit(rows.withColumns({"a": F.lit(1.0), "b": F.lit(2.0), "c": F.lit("x")}), "y", ["a", "b"], ["c"], boosting.Settings(rounds=2))
    assert all((t.feature == -1).all() for t in flat.trees)
    mean = rows.agg(F.avg("y")).first()[0]
    assert {round(r.p, 9) for r in rows.select(flat.probability().alias("p")).collect()} == {round(mean, 9)}
    one_class = boosting.fit(rows.withColumn("y", F.lit(1)), "y", ["a"], [], boosting.Settings(rounds=2))
    assert rows.select(one_class.probability().alias("p")).where("p < 0.99").count() == 0
    new = rows.withColumns({"c": F.lit("unseen"), "a": F.lit(float("nan"))})
    assert new.select(boosting.fit(rows, "y", ["a", "b"], ["c"], boosting.Settings(rounds=2)).probability().alias("p")).where("p BETWEEN 0 AND 1").count() == 60
    with pytest.raises(ValueError, match="no rows"):
        boosting.fit(rows.limit(0), "y", ["a"], [])
    with pytest.raises(ValueError, match="categories"):
        boosting.fit(spark.range(2000).select(F.col("id").cast("string").alias("c"), (F.col("id") % 2).cast("int").alias("y")), "y", [], ["c"])
