"""Queries work on whole tables, not on a part of them."""

from matchlake.operators import learning, rounds
from matchlake.plans import adapter, telemetry


def test_catalogue_has_all_customers(spark, data):
    customers = spark.read.parquet(f"{data}/customer.parquet").count()
    assert customers > 60
    assert adapter.view(spark, data, adapter.CATALOG).count() == 5 * customers
    assert telemetry.lineage_summary(spark, data).count() == customers
    assert telemetry.run_upsert(spark, data).count() == 5 * customers


def test_importance_of_every_feature_with_ten_repeats(spark, data, monkeypatch):
    seen = {}
    whole = learning.permutation_importance
    monkeypatch.setattr(learning, "permutation_importance", lambda model, rows, **k: seen.update(k) or whole(model, rows, **k))
    got = {r.feature for r in telemetry.permutation_importance(spark, data).collect()}
    numeric, categorical = rounds.feature_columns(telemetry.supervised_features(spark, data))
    assert len(numeric + categorical) > 30 and got == {*numeric, *categorical} and seen.get("repeats", 10) == 10


def test_models_are_trained_with_their_defaults(spark, data, monkeypatch):
    trained = []

    def train(rows, name, iterations=350):
        trained.append((name, iterations))
        return type("Said", (), {"predict": lambda self, test: test.withColumn("p", learning.baseline(test["winner_side_norm"]))})()

    monkeypatch.setattr(learning, "train", train)
    names = {r.model_name for r in telemetry.train_logreg(spark, data).collect()}
    assert names == set(learning.MODELS) and trained == [("logistic_regression", 350), ("hist_gradient_boosting", 350)]
    assert telemetry.train_gbt(spark, data).count() == 1 and trained[-1] == ("hist_gradient_boosting", 350)
