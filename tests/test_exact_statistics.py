"""Order statistics, frequent values, sketches, hash trees and exact boosting against plain Python."""

import random
import statistics

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from wardline.functions import orderstat
from wardline.functions.identity import row_hash
from wardline.operators import boosting, cost_model, hashtree, sketches
from wardline.operators.profile import top_values
from wardline.schema import NAMES


@pytest.mark.parametrize("few", [0, 7, 10_000])
def test_kth_and_median(spark, monkeypatch, few):
    monkeypatch.setattr(orderstat, "FEW", few)
    draw = random.Random(few)
    for size in (1, 2, 9, 400):
        numbers = [draw.choice([draw.randint(-(10**12), 10**12), draw.randint(0, 3), 5]) for _ in range(size)]
        rows = spark.createDataFrame([(x,) for x in numbers] + [(None,)], "x long")
        for k in {1, size, size // 2 + 1}:
            assert orderstat.kth_smallest(rows, F.col("x"), k) == sorted(numbers)[k - 1]
        assert orderstat.median(rows, F.col("x")) == statistics.median(numbers)


def test_extreme_numbers_and_empty_columns(spark):
    rows = spark.createDataFrame([(-(2**62),), (2**62,), (0,), (1,)], "x long")
    assert [orderstat.kth_smallest(rows, F.col("x"), k) for k in (1, 2, 3, 4)] == [-(2**62), 0, 1, 2**62]
    assert orderstat.median(rows.where("x > 5 and x < 0"), F.col("x")) is None
    with pytest.raises(ValueError, match="place 5 of 4"):
        orderstat.kth_smallest(rows, F.col("x"), 5)


@pytest.mark.parametrize("few", [3, 10_000])
def test_exact_sample(spark, fact, monkeypatch, few):
    monkeypatch.setattr(orderstat, "FEW", few)
    rows = fact.select("row_hash")
    hashes = [r[0] for r in rows.collect()]
    import hashlib

    order = sorted(hashes, key=lambda h: hashlib.sha256(f"{h}:42".encode()).hexdigest())
    for size in (1, 10, 1234, len(hashes), 10**9):
        got = cost_model.exact_sample(rows.repartition(5), size)
        assert sorted(r[0] for r in got.collect()) == sorted(order[:size])


def test_heavy_hitters(spark, fact):
    assert rows_of(sketches.heavy_hitters(fact)) == rows_of(top_values(fact))
    # values that the summary cannot follow: the column is counted in full
    flat = spark.range(60_000).select((F.col("id") % 20_000).cast("string").alias("flat"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("two"), F.lit(None).cast("string").alias("none"))
    assert rows_of(sketches.heavy_hitters(flat, flat.columns)) == rows_of(top_values(flat, flat.columns))
    skewed = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, F.col("id") % 24).otherwise(F.col("id")).cast("string").alias("v"))
    assert rows_of(sketches.heavy_hitters(skewed, ["v"])) == rows_of(top_values(skewed, ["v"]))
    assert rows_of(sketches.heavy_hitters(skewed.where("v is null"), ["v"])) == []


def test_sketches_of_loads(spark, tmp_path):
    path = str(tmp_path / "s")
    a = spark.range(30_000).select(F.col("id").alias("id"), (F.col("id") % 7).cast("string").alias("few"), F.lit(None).cast("string").alias("none"))
    b = a.withColumn("id", F.col("id") + 20_000)
    sketches.store_sketches(a, path, "a", a.columns)
    sketches.store_sketches(b, path, "b", a.columns)
    sketches.store_sketches(b, path, "b", a.columns)
    got = {r.column_name: r for r in sketches.merged_profile(spark, path).collect()}
    assert (got["few"].distinct_estimate, got["few"].missing, got["none"].distinct_estimate, got["none"].missing) == (7, 0, 0, 60_000)
    assert abs(got["id"].distinct_estimate - 50_000) < 50_000 * 4 * 1.04 / 2**7
    assert sketches.merged_profile(spark, str(tmp_path / "nothing")).count() == 0


def test_hash_tree_opens_only_what_differs(spark, fact):
    assert hashtree.difference(fact, fact.repartition(3)).count() == 0
    one = fact.orderBy("row_hash").first()
    changed = fact.withColumn("facility_name", F.when(F.col("row_hash") == one.row_hash, "elsewhere").otherwise(F.col("facility_name"))).withColumn("row_hash", row_hash(NAMES))
    twice = changed.unionByName(changed.where(F.col("facility_name") == "elsewhere"))
    got = rows_of(hashtree.difference(fact, twice, ["facility_name"]).select("facility_name", "side", "times"))
    assert got == sorted([(one.facility_name, "left", 1), ("elsewhere", "right", 2)], key=repr)
    assert hashtree.differing(fact, changed, 3).count() <= 2
    assert hashtree.difference(fact.limit(0), fact).where("side = 'right'").count() == fact.count()


def brute_boost(rows, features, target, rounds=5):
    """The same rule in plain Python."""
    known = [r for r in rows if r[target] is not None]
    base = sum(r[target] for r in known) // len(known)
    left_of, residual = [], [r[target] - base for r in known]
    for _ in range(rounds):
        best = None
        for k, f in enumerate(features):
            sums = {}
            for r, x in zip(known, residual):
                n, s = sums.get(r[f] or "\x1e", (0, 0))
                sums[r[f] or "\x1e"] = (n + 1, s + x)
            order = sorted(sums, key=lambda c: (sums[c][1] // sums[c][0], c))
            n_all, s_all = len(known), sum(residual)
            n = s = 0
            for place, c in enumerate(order, 1):
                n, s = n + sums[c][0], s + sums[c][1]
                if n == n_all:
                    break
                gain = (s // n) * s + ((s_all - s) // (n_all - n)) * (s_all - s)
                if best is None or (-gain, k, place) < best[0]:
                    best = ((-gain, k, place), f, set(order[:place]), s // (2 * n), (s_all - s) // (2 * (n_all - n)))
        if best is None:
            break
        _, f, left, low, high = best
        left_of.append((f, left, low, high))
        residual = [x - (low if (r[f] or "\x1e") in left else high) for r, x in zip(known, residual)]
    return lambda r: base + sum(low if (r[f] or "\x1e") in left else high for f, left, low, high in left_of)


def test_boosting_is_the_plain_rule(spark):
    draw = random.Random(3)
    rows = [(draw.choice("abc"), draw.choice(["x", "y", None]), None if i == 7 else draw.randint(0, 99_999)) for i in range(300)]
    frame = spark.createDataFrame(rows, "f string, g string, cents long").withColumn("cost", (F.col("cents") / 100).cast("decimal(14,2)"))
    model = boosting.fit(frame, features=["f", "g"], target="cost")
    predict = brute_boost([{"f": a, "g": b, "c": c} for a, b, c in rows], ["f", "g"], "c")
    fresh = [*rows, ("new", "x", 1), (None, None, 2)]
    scored = boosting.score(model, spark.createDataFrame(fresh, "f string, g string, cents long"))
    assert rows_of(scored.select("f", "g", "cents", "predicted_cents")) == sorted(((a, b, c, predict({"f": a, "g": b})) for a, b, c in fresh), key=repr)


def test_boosting_edges(spark):
    frame = spark.createDataFrame([("a", 5)], "f string, c long").withColumn("cost", F.col("c").cast("decimal(14,2)"))
    one = boosting.fit(frame, features=["f"], target="cost")
    assert (one.base, one.trees) == (500, []) and boosting.score(one, frame).first().predicted_cents == 500
    empty = boosting.fit(frame.limit(0), features=["f"], target="cost")
    assert boosting.errors(boosting.score(empty, frame), "cost").first().error_cents == 500


def test_baseline_of_all_rows(fact):
    train, test = cost_model.train_test_whole(fact)
    costs = [int(r[0] * 100) for r in train.select("total_costs").collect()]
    middle = statistics.median(costs)
    held = [int(r[0] * 100) for r in test.select("total_costs").collect()]
    assert tuple(cost_model.exact_baseline(train, test).first()) == (len(costs), middle, len(held), sum(abs(2 * x - int(2 * middle)) for x in held))


def test_opened_buckets_are_found_without_a_shuffle_of_the_rows(spark):
    rows = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("row_hash"))
    buckets = rows.limit(40).select(F.substring("row_hash", 1, 6).alias("bucket"))
    found = hashtree._within_bits(rows, buckets, 6, "row_hash")
    expected = hashtree._within(rows, buckets, 6, "row_hash")
    assert found.exceptAll(expected).isEmpty() and found.count() == expected.count() >= 40
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
