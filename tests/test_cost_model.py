import pytest
from pyspark.sql import functions as F

from wardline.operators import cost_model as M


def test_sample_and_split_do_not_depend_on_partitions(fact):
    def chosen(df):
        marked = M.split(M.hash_sample(df, 1500)).select("row_hash", "is_train").collect()
        return {tuple(r) for r in marked}

    first = chosen(fact)
    assert first == chosen(fact.repartition(13))
    assert abs(len(first) - 1500) < 200
    assert abs(sum(t for _, t in first) / len(first) - 0.8) < 0.05
    assert M.hash_sample(fact, 10**9).count() == fact.count()


def test_model_scores_every_row(fact):
    train, test = M.train_test(fact, 3000)
    model = M.fit(train, max_iter=5, max_depth=3)
    scored = M.score(model, fact.select("row_hash", *M.FEATURES))
    assert scored.count() == fact.count() and scored.where("predicted_cost is null").count() == 0
    metrics = M.evaluate(model, test)
    assert metrics["mae"] > 0 and metrics["rmse"] >= metrics["mae"]
    with pytest.raises(ValueError, match="total_charges"):
        M.score(model, fact.select("row_hash", "total_charges", *M.FEATURES))


def test_unseen_and_missing_categories_are_scored(fact):
    train, _ = M.train_test(fact, 2000)
    model = M.fit(train, max_iter=2, max_depth=2)
    odd = fact.select("row_hash", *M.FEATURES).limit(3).withColumn("gender", F.lit("new")).withColumn("age_group", F.lit(None).cast("string"))
    assert M.score(model, odd).where("predicted_cost is not null").count() == 3


def test_baseline(fact):
    train, test = M.train_test(fact, 1000)
    usable = fact.where("total_costs is not null").count()
    assert abs(train.count() - 1000) < 200 and abs(test.count() / usable - 0.2) < 0.03
    got = M.median_baseline(train, test).first()
    costs = sorted(float(r[0]) for r in train.select("total_costs").collect())
    half = len(costs) // 2
    median = costs[half] if len(costs) % 2 else (costs[half - 1] + costs[half]) / 2
    held = [float(r[0]) for r in test.select("total_costs").collect()]
    assert got["train_median"] == pytest.approx(median)
    assert got["baseline_mae"] == pytest.approx(sum(abs(c - median) for c in held) / len(held), abs=1e-3)


def test_metrics_rest_on_the_whole_sample(spark, fact):
    from conftest import SF

    from wardline.plans import registry

    got = registry.ml_cost_metrics(spark, SF).first()
    usable = fact.where("total_costs is not null")
    assert got.train_rows == M.split(usable).where("is_train").count() > 2500 and got.train_rows + got.test_rows == usable.count()
