"""What the third round found."""

from pyspark.sql import functions as F

from matchlake.plans import telemetry
from tests.compare import duck_rows, spark_rows


def _with(spark, data, tmp_path, **tables):
    """A folder with these tables, and links to the given ones for the rest."""
    import os

    for f in os.listdir(data):
        if f.removesuffix(".parquet") not in tables:
            os.symlink(f"{data}/{f}", tmp_path / f)
    for name, df in tables.items():
        df.toPandas().to_parquet(tmp_path / f"{name}.parquet", coerce_timestamps="us")
    return str(tmp_path)


def test_histogram_bins_at_their_edges(spark, data, tmp_path):
    """Every ten from below zero to beyond the last bin, and nothing."""
    events = spark.read.parquet(f"{data}/events.parquet")
    value = F.when(F.col("event_id") != 5, (F.col("event_id") % 800 - 100).cast("double"))
    folder = _with(spark, data, tmp_path, events=events.withColumn("value", value))
    assert spark_rows(telemetry.eda_hist(spark, folder)) == duck_rows(telemetry.ORACLES["eda_hist"], folder)


def test_hybrid_search_has_ten_rows_by_meaning_and_five_by_words(spark, data, tmp_path):
    """Among them copies, which are as near: the smaller number comes first, not the smaller text."""
    rows = spark.read.parquet(f"{data}/embeddings.parquet")
    folder = _with(spark, data, tmp_path, embeddings=rows.union(rows.withColumn("vec_id", F.col("vec_id") + 1000)))
    got = spark_rows(telemetry.hybrid_results(spark, folder))
    assert len(got[1]) == 15 and got == duck_rows(telemetry.ORACLES["hybrid_results"], folder)


def test_a_level_sums_the_smaller_of_two_nodes_alone():
    import numpy as np

    from matchlake.operators import boosting

    rng = np.random.default_rng(4)
    bins, y = rng.integers(0, 30, (3000, 4)).astype(np.uint8), rng.integers(0, 2, 3000).astype(float)
    g, h = boosting.gradients(y, rng.normal(size=3000))
    asked = []

    def sums(tree, nodes):
        at = tree.leaves(bins)
        asked.append((len(nodes), np.isin(at, nodes).mean()))
        return boosting.histogram(bins, at, nodes, g, h, 30)

    tree, whole = boosting.grow(sums, boosting.Settings()), boosting._Growth()
    assert asked[0] == (1, 1.0) and all(share <= 0.5 for _, share in asked[1:]) and len(asked) == 6
    for _ in range(6):  # every node summed by itself
        t = whole.routing()
        whole.split(boosting.histogram(bins, t.leaves(bins), whole.open, g, h, 30), boosting.Settings())
    other = whole.tree(boosting.Settings())
    assert tree.feature.tolist() == other.feature.tolist() and tree.bin.tolist() == other.bin.tolist() and np.allclose(tree.value, other.value)


def test_sums_of_many_partitions_are_added_by_an_aggregation(spark, monkeypatch):
    import numpy as np

    from matchlake.operators import boosting
    from tests.test_boosting import table

    rows, s = table(spark), boosting.Settings(rounds=3, depth=3)
    one = boosting.fit(rows, "y", ["a", "b"], ["c"], s, partition_rows=300)
    monkeypatch.setattr(boosting, "ADDED", 1)
    more = boosting.fit(rows, "y", ["a", "b"], ["c"], s, partition_rows=300)
    assert all(x.bin.tolist() == y.bin.tolist() and np.allclose(x.value, y.value) for x, y in zip(one.trees, more.trees, strict=True))


def test_postings_are_made_a_document_at_a_time(spark, monkeypatch):
    """No shuffle of words, whatever is held at a time; documents of one id are found together."""
    from matchlake.operators import fulltext

    docs = spark.createDataFrame([(1, "the kills kill 2.5 map"), (2, None), (1, "map " * 300 + "kill"), (3, "the of"), (4, "x " * 17_000)], "id long, body string").coalesce(1)
    whole = {(r.id, r.term, tuple(r.positions)) for r in fulltext.postings(docs, ["id"], "body").collect()}
    assert {(1, "kill", (2, 3)), (1, "2.5", (4,)), (1, "map", (5,)), (1, "kill", (301,)), (1, "map", tuple(range(1, 257))), (4, "x", tuple(range(1, 257)))} == whole
    monkeypatch.setattr(fulltext, "HELD_WORDS", 3)
    posted = fulltext.postings(docs, ["id"], "body")
    assert {(r.id, r.term, tuple(r.positions)) for r in posted.collect()} == whole
    assert "Exchange" not in posted._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in fulltext.matches(posted, '"map map" 2.5', ["id"]).collect()] == [1]


def test_files_are_read_with_the_columns_that_they_have(spark, tmp_path):
    from matchlake.sources import files

    (tmp_path / "a.csv").write_text("a,b\n1,2,3\n\n4\n")
    (tmp_path / "b.csv").write_text("b\n5\n")
    assert spark.read.text(str(tmp_path)).count() == 6
    scan = lambda: files.csv_cells(spark, [str(tmp_path)])._jdf.queryExecution().executedPlan().toString()
    assert "c2" in scan() and "c3" not in scan()
    whole = {tuple(r) for r in files.read_files(spark, [str(tmp_path)]).rows.select("a", "b").collect()}
    (tmp_path / "c.csv").write_text('a,"x\n,\ny",b\n7,8,9\n')
    got = {tuple(r) for r in files.read_files(spark, [str(tmp_path)]).rows.select("a", "b").collect()}
    assert whole == {("1", "2"), ("4", None), (None, "5")} and got == whole | {("7", "9")}


def _importance_plainly(trained, rows, repeats, buckets):
    """Every feature and repeat as rows that go through the whole model."""
    from pyspark.sql import Window

    from matchlake.operators import learning

    features, order = trained.preparation.numeric + trained.preparation.categorical, F.xxhash64("file", "round_number")
    keyed = rows.withColumn("_b", F.pmod(order, F.lit(buckets)))
    keyed = keyed.withColumn("_k", F.row_number().over(Window.partitionBy("_b").orderBy(order)))
    keyed = keyed.withColumn("_r", F.explode(F.array(*map(F.lit, range(repeats)))))
    mixed = Window.partitionBy("_b", "_r").orderBy(F.xxhash64(F.col("_r") + F.lit(42), "file", "round_number"))
    other = keyed.select("_b", "_r", F.row_number().over(mixed).alias("_k"), F.struct(*features).alias("_o"))
    dealt = keyed.join(other, ["_b", "_r", "_k"]).withColumn("_f", F.explode(F.array(*map(F.lit, features))))
    dealt = dealt.withColumns({c: F.when(F.col("_f") == c, F.col(f"_o.{c}")).otherwise(F.col(c)) for c in features}).drop("_o")
    base = learning.metrics(trained.predict(rows), learning.TARGET).first()["roc_auc"]
    aucs = learning.metrics(trained.predict(dealt), learning.TARGET, by=["_f", "_r"])
    return {r["_f"]: r["fall"] for r in aucs.groupBy("_f").agg((F.lit(base) - F.avg("roc_auc")).alias("fall")).collect()}


def test_importance_makes_every_prediction_in_the_tasks_that_have_the_rows(spark, data, monkeypatch):
    """No row goes through the model's plan once a feature and repeat, and falls are the same as if it did; with values
    that are missing, that are no known category and that are equal, in several buckets and ranges."""
    import math

    from matchlake.operators import learning

    frame = learning.written_split(telemetry.supervised_features(spark, data))
    test = frame.where("is_test").withColumn("map", F.when(F.col("round_number") % 5 != 0, F.when(F.col("round_number") % 5 == 1, F.lit("nowhere")).otherwise(F.col("map"))))
    test = learning.written(test.withColumn("eq_diff", F.when(F.col("round_number") % 3 != 0, F.col("eq_diff"))), "odd").cache()
    n, whole, asked = test.count(), learning.Trained.predict, []
    monkeypatch.setattr(learning, "DEALT_BUCKETS", 2)
    monkeypatch.setattr(learning, "DEALT_ROWS", n // 3 + 1)
    monkeypatch.setattr(learning, "RANKED_ROWS", n // 4)
    for name in learning.MODELS[1:]:
        trained = learning.train(frame.where("NOT is_test"), name, iterations=3)
        want = _importance_plainly(trained, test, 2, 3)
        with monkeypatch.context() as m:
            m.setattr(learning.Trained, "predict", lambda self, rows: asked.append(rows.count()) or whole(self, rows))
            got = {r.feature: r.importance for r in learning.permutation_importance(trained, test, repeats=2).collect()}
        assert got.keys() == want.keys() and any(got.values()) and all(abs(x - want[c]) < 1e-12 for c, x in got.items())
        assert sum(asked) <= 2 * n
    one_class = learning.permutation_importance(trained, test.where(F.col(learning.TARGET) == 1), repeats=1).collect()
    assert len(one_class) == len(got) and all(math.isnan(r.importance) for r in one_class)
