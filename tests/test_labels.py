import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quarterdeck.operators import labels as lb
from quarterdeck.plans import learning as ml
from quarterdeck.operators.ranking import rank_within


def test_metrics_of_a_continuous_score_with_one_hot_value(spark):
    draw = random.Random(3)
    rows = [(hashlib.sha256(str(i).encode()).hexdigest(), draw.randint(0, 1), 0.625 if i % 3 == 0 else draw.random()) for i in range(900)]
    df = spark.createDataFrame(rows, "event_id string, label int, score double").withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    got = lb.binary_metrics(df).first()
    hits, parts = 0, []
    for place, (_, label, _) in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])), 1):
        hits += label
        parts += [hits / place] * label
    assert abs(got.pr_auc - sum(parts) / len(parts)) < 1e-9
    top = sorted(rows, key=lambda r: (-r[2], -r[1]))[:90]
    assert abs(got.precision_at_top_10_percent - sum(r[1] for r in top) / 90) < 1e-9
    assert lb._score_bands(df.withColumn("slice", F.lit(1)), ["slice"]).select("bucket", "part", "prefix").distinct().count() <= 1001 * 258
    xs, want = sorted(r[2] for r in rows), []
    for f in (0.2, 0.5, 0.8):
        at = f * (len(xs) - 1)
        want.append(xs[int(at)] + (at - int(at)) * (xs[int(at) + 1] - xs[int(at)]))
    assert all(abs(a - b) < 1e-9 for a, b in zip(lb.quantiles(df, "score", [0.2, 0.5, 0.8]).first().edges, want))


def test_ranks_keep_null_groups(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 1)], "k string, v int")
    ranked = rank_within(df, ["k"], [F.col("v")], [F.col("v")])
    assert {(r.k, r.v, r["rank"]) for r in ranked.collect()} == {("a", 1, 1), (None, 1, 1), (None, 2, 2)}


def test_average_precision_counts_equal_scores_as_one_threshold(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.5), (0, 0.5), (1, 0.1)]
    got = lb.average_precision(spark.createDataFrame(rows, "label int, score double")).first()[0]
    assert abs(got - (1 / 3 * 1 / 2 + 1 / 3 * 2 / 5 + 1 / 3 * 3 / 6)) < 1e-12
    assert lb.average_precision(spark.createDataFrame([(0, 0.5)], "label int, score double")).first()[0] == 0.0


def _changes(spark, odd: int):
    """Changes of three folds whose label follows one feature; ``odd`` distorts the rows of fold 2 only."""
    draw, rows = random.Random(8), []
    for i in range(240):
        fold = i % 3
        values = [draw.random() for _ in ml.CHANGE_FEATURES]
        label = int(values[2] > 0.5)
        if fold == 2:
            values = [v * (1 + 1000 * odd) for v in values]
        rows.append((f"a{i:04d}", str(i), label, *values, fold))
    columns = ", ".join(f"{c} double" for c in ml.CHANGE_FEATURES)
    df = spark.createDataFrame(rows, f"current_accession_number string, holding_key string, weak_label int, {columns}, fold int")
    return df.drop("fold"), df.select("current_accession_number", "fold")


def test_validation_rows_reach_no_fit(spark):
    """Scaling, weights and coefficients of a fold are the same whatever its validation rows hold."""
    told = []
    for odd in (0, 1):
        rows, folds = _changes(spark, odd)
        train = rows.join(folds, "current_accession_number").filter("fold <> 2")
        n, prepare = ml.training_part(train)
        estimator, grid = ml.candidate_models(n)["logistic_regression"]
        told.append((n, estimator.fit(prepare(train), grid[1]).coefficients.toArray().round(9).tolist()))
    assert told[0] == told[1] and told[0][0] == 160


def test_search_finds_the_feature(spark):
    rows, folds = _changes(spark, 0)

    def candidates(n):
        told = ml.candidate_models(n)
        return {"logistic_regression": told["logistic_regression"], "decision_tree": (told["decision_tree"][0], told["decision_tree"][1][:4:3])}

    found = {name: (cv, parameters, scored.count()) for name, cv, parameters, scored in ml.compare_classifiers(rows, folds, candidates)}
    assert set(found) == {"logistic_regression", "decision_tree"}
    assert all(cv > 0.9 and n == 240 for cv, _, n in found.values()) and "maxDepth" in found["decision_tree"][1]


def test_average_precision_of_groups(spark):
    rows = [(g, label, score) for g, some in ((1, [(1, 0.9), (0, 0.5), (1, 0.1)]), (2, [(0, 0.9), (1, 0.8)])) for label, score in some]
    got = {r["g"]: r["average_precision"] for r in lb.average_precision(spark.createDataFrame(rows, "g int, label int, score double"), ["g"]).collect()}
    assert got == {1: pytest.approx((1 + 2 / 3) / 2), 2: pytest.approx(0.5)}


def test_ranks_move_the_rows_once(spark):
    """With broadcasts off the rows are exchanged once: the histogram has exchanges of its own."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([("a", 1, 5), (None, 2, 6), ("a", 1, 7)], "k string, v int, carried int")
        ranked = rank_within(df, ["k"], [F.col("v"), F.col("carried")], [F.col("v")])
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert sum("__cell" in line for line in moved) == 1 and len(moved) == 4, plan
        assert sorted(tuple(r) for r in ranked.filter("k is not null").collect()) == [("a", 1, 5, 1), ("a", 1, 7, 2)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
