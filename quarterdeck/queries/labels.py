"""Registered queries: review queue, labelled evaluation, classifiers, fitted forecasts."""

from __future__ import annotations

import uuid
from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.keys import event_id
from ..operators import folds, forecasts as fc, labels as lb, validation
from ..plans import learning as ml, linear, model_store as store, search
from ..session import save_stage, shared_folder
from ..sources import driver_tables as given
from .changes import newest_alerts, training
from .gold import VALIDATION
from .silver import query
from .sql_twins import part
from .tables import Tables

RULE_THRESHOLD = 40
# a change has the label of the id that its absolute value points at; ids run up to the largest one of the table
LABEL_IDS_SQL = "(SELECT max(doc_id) + 1 FROM labels)"

part("reviewed", f"""
  SELECT alert_id AS event_id, a.*, quality AS label, score / 100.0::DOUBLE AS p, CASE WHEN score >= {RULE_THRESHOLD} THEN 1 ELSE 0 END AS prediction,
         CASE WHEN is_new_position THEN 'new_position' WHEN is_exited_position THEN 'exited_position' WHEN weight_delta > 0 THEN 'increased_position'
              ELSE 'decreased_position' END AS event_type
  FROM assessed a JOIN labels ON doc_id = abs_value_delta_thousands % {LABEL_IDS_SQL} WHERE quality IS NOT NULL
""")


def reviewed(t: Tables) -> DataFrame:
    """Every labelled change with its 0/1 truth from the given labels; changes without a label are left out."""
    truth = given.table(t.spark, t.source, "labels").select(F.col("doc_id").alias("label_id"), "quality").filter("quality is not null")
    ids = given.table(t.spark, t.source, "labels").agg(F.max("doc_id") + 1).scalar()
    rows = training(t).withColumn("label_id", F.col("abs_value_delta_thousands") % ids).join(truth, "label_id")
    return rows.withColumns({
        "event_id": event_id("current_accession_number", "holding_key"), "label": F.col("quality"),
        "score": F.col("rule_score") / F.lit(100.0), "prediction": (F.col("rule_score") >= RULE_THRESHOLD).cast("int"),
        "event_type": lb.event_type(),
    }).drop("label_id", "quality")


def rated(t: Tables) -> DataFrame:
    """What metrics read of the labelled changes, stored for their passes."""
    return t.workspace.saved("rated", lambda: reviewed(t).select("event_id", "label", "score", "prediction", "sector", "event_type"))


METRICS = ("accuracy", "precision", "recall", "f1", "pr_auc", "brier_score", "precision_at_top_10_percent")


def _metrics_sql(key: str, rows: str) -> str:
    return f"""
    SELECT c.*, round(CAST(true_positive + true_negative AS DOUBLE) / sample_count, 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall,
           round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1, round(coalesce(ap, 0), 6) AS pr_auc, round(brier, 6) AS brier_score,
           round(top, 6) AS precision_at_top_10_percent
    FROM (SELECT {key} AS slice, count(*) AS sample_count, count(*) FILTER (label = 1 AND prediction = 1) AS true_positive,
                 count(*) FILTER (label = 0 AND prediction = 0) AS true_negative, count(*) FILTER (label = 0 AND prediction = 1) AS false_positive,
                 count(*) FILTER (label = 1 AND prediction = 0) AS false_negative FROM {rows} GROUP BY 1) c
    JOIN (SELECT {key} AS slice, avg((p - label) * (p - label)) AS brier,
                 coalesce(CAST(count(*) FILTER (label = 1 AND prediction = 1) AS DOUBLE) / nullif(count(*) FILTER (prediction = 1), 0), 0) AS pr,
                 coalesce(CAST(count(*) FILTER (label = 1 AND prediction = 1) AS DOUBLE) / nullif(count(*) FILTER (label = 1), 0), 0) AS re
          FROM {rows} GROUP BY 1) d USING (slice)
    LEFT JOIN (SELECT slice, avg(hits / CAST(pos AS DOUBLE)) AS ap FROM (SELECT {key} AS slice, label, row_number() OVER w AS pos,
                 sum(label) OVER (w ROWS UNBOUNDED PRECEDING) AS hits FROM {rows} WINDOW w AS (PARTITION BY {key} ORDER BY p DESC, event_id))
               WHERE label = 1 GROUP BY 1) USING (slice)
    JOIN (SELECT slice, CAST(sum(label) AS DOUBLE) / count(*) AS top FROM (SELECT {key} AS slice, label, row_number() OVER (PARTITION BY {key} ORDER BY p DESC, label DESC) AS pos,
                 count(*) OVER (PARTITION BY {key}) AS n FROM {rows}) WHERE pos <= greatest(1, round_even(n * 0.1, 0)) GROUP BY 1) USING (slice)
    """


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({m: F.round(m, 6) for m in METRICS})


@query("label_metrics", _metrics_sql("'all'", "reviewed"))
def label_metrics(t: Tables) -> DataFrame:
    return _rounded(lb.binary_metrics(rated(t)))


@query("label_metrics_by_sector", _metrics_sql("sector", "reviewed"))
def label_metrics_by_sector(t: Tables) -> DataFrame:
    return _rounded(lb.binary_metrics(rated(t), ["sector"]).withColumnRenamed("sector", "slice"))


@query("label_metrics_by_event", _metrics_sql("event_type", "reviewed"))
def label_metrics_by_event(t: Tables) -> DataFrame:
    return _rounded(lb.binary_metrics(rated(t), ["event_type"]).withColumnRenamed("event_type", "slice"))


@query("calibration", """
SELECT bin, round(avg(p), 6) AS predicted_probability, round(avg(label), 6) AS observed_frequency FROM (
  SELECT p, label, len(list_filter((SELECT quantile_cont(p, [0.2, 0.4, 0.6, 0.8]) FROM reviewed), lambda e: e < p)) AS bin FROM reviewed) GROUP BY bin
""")
def calibration(t: Tables) -> DataFrame:
    return lb.calibration_curve(rated(t), 5).withColumns({
        c: F.round(c, 6) for c in ("predicted_probability", "observed_frequency")})


@query("review_queue", """
SELECT row_number() OVER (ORDER BY turn, weak_label DESC) AS position, alert_id AS event_id, weak_label, score AS rule_score
FROM (SELECT *, row_number() OVER (PARTITION BY weak_label ORDER BY score DESC, current_accession_number, holding_key) AS turn FROM assessed)
ORDER BY turn, weak_label DESC LIMIT 300
""")
def review_queue(t: Tables) -> DataFrame:
    return lb.review_queue(training(t), 300).select("position", "event_id", "weak_label", "rule_score")


@query("label_validation", """
SELECT event_id, CASE WHEN label = 0 AND is_new_position THEN 'manual_label must be 0 or 1' WHEN sector = 'Unknown' THEN 'review_reason is required'
                      ELSE 'reviewer_id is required' END AS reason
FROM reviewed WHERE (label = 0 AND is_new_position) OR sector = 'Unknown' OR is_exited_position
""")
def label_validation(t: Tables) -> DataFrame:
    """Reviewed rows with planted gaps: every kind of broken row is reported."""
    rows = reviewed(t).withColumns({
        "manual_label": F.when((F.col("label") == 0) & F.col("is_new_position"), "?").otherwise(F.col("label").cast("string")),
        "review_reason": F.when(F.col("sector") == "Unknown", " ").otherwise("seen"),
        "reviewer_id": F.when(F.col("is_exited_position"), "").otherwise("r1"), "reviewed_at": F.lit("2001-01-01"),
    })
    return validation.label_problems(rows)


@query("time_folds", """
SELECT current_accession_number, CAST(ntile(3) OVER (ORDER BY current_accession_number) - 1 AS INTEGER) AS fold
FROM (SELECT DISTINCT current_accession_number FROM assessed)
""")
def time_folds(t: Tables) -> DataFrame:
    return lb.time_folds(training(t), 3)


def baseline_predictions(t: Tables) -> DataFrame:
    def build() -> DataFrame:
        _, scored = ml.logistic_baseline(training(t))
        return scored.select(*store.KEYS, "label", "score", "prediction")
    return t.workspace.saved("baseline_predictions", build).withColumn("event_id", event_id(*store.KEYS))


@query("classifier_baseline")
def classifier_baseline(t: Tables) -> DataFrame:
    """Logistic baseline on weak labels with its metrics."""
    scored = baseline_predictions(t)
    loss = ml.log_loss(scored).scalar()
    return lb.binary_metrics(scored).withColumn("log_loss", loss)


def searched(t: Tables) -> DataFrame:
    """One row per candidate model: its best point of the grid and the metrics of its refit; the best one flagged."""
    def build() -> DataFrame:
        rows, told, scored = training(t), [], []
        for name, cv, parameters, scores in search.search(rows, lb.time_folds(rows, 3)):
            told.append((name, cv, parameters))
            scored.append(scores.select(F.lit(name).alias("model_name"), event_id("current_accession_number", "holding_key").alias("event_id"), *store.KEYS, "label", "prediction", "score"))
        metrics = lb.binary_metrics(t.workspace.saved("search_scored", lambda: reduce(DataFrame.unionByName, scored)), ["model_name"])
        best = t.spark.createDataFrame(told, "model_name string, cross_validated_pr_auc double, best_params map<string,string>")
        return mark_best(save_stage(best.join(metrics, "model_name").select(
            *best.columns, "sample_count", "accuracy", "precision", "recall", "f1", "pr_auc"), "comparison"))
    return t.workspace.saved("searched", build)


@query("classifier_comparison")
def classifier_comparison(t: Tables) -> DataFrame:
    """Candidate classifiers on time folds over the full grid of 26 points; best one flagged."""
    return searched(t).drop("sample_count")


_PARAMETERS = {model: "|".join(sorted(axes)) for model, axes in search.GRID.items()}
_POINTS = Counter(model for model, _ in search.grid_points())


@query("classifier_comparison_bounds", f"""
SELECT model_name, parameters, points, (SELECT count(*) FROM assessed) AS sample_count, TRUE AS in_bounds, TRUE AS on_grid, 1::BIGINT AS best_models
FROM (VALUES {', '.join(f"('{m}', '{_PARAMETERS[m]}', {_POINTS[m]}::BIGINT)" for m in search.GRID)}) g(model_name, parameters, points)
""")
def classifier_comparison_bounds(t: Tables) -> DataFrame:
    """What any comparison must hold: every model scored on all rows by a point of its grid, metrics in 0..1, one best model by PR-AUC."""
    metrics = ("cross_validated_pr_auc", "accuracy", "precision", "recall", "f1", "pr_auc")
    grids = t.spark.createDataFrame([(m, [{k: str(v) for k, v in p.items()} for n, p in search.grid_points() if n == m]) for m in search.GRID],
                                    "model_name string, listed array<map<string,string>>")
    rows = searched(t).join(grids, "model_name")
    best, highest = rows.agg(F.sum(F.col("is_best_model").cast("long"))).scalar(), rows.agg(F.max("pr_auc")).scalar()
    flagged = rows.withColumns({"best_models": best, "highest": highest})
    entries = F.array_sort(F.map_entries("best_params"))
    return flagged.select(
        "model_name", F.array_join(F.array_sort(F.map_keys("best_params")), "|").alias("parameters"), F.size("listed").cast("long").alias("points"), "sample_count",
        reduce(lambda a, b: a & b, [F.col(m).between(0, 1) for m in metrics] + [~F.col("is_best_model") | (F.col("pr_auc") == F.col("highest"))]).alias("in_bounds"),
        F.exists("listed", lambda p: F.array_sort(F.map_entries(p)) == entries).alias("on_grid"), "best_models")


def mark_best(comparison: DataFrame) -> DataFrame:
    """Flag the model with the highest PR-AUC (one row per model)."""
    best = comparison.agg(F.max_by("model_name", F.struct("pr_auc", "model_name"))).scalar()
    return comparison.withColumn("is_best_model", F.col("model_name") == best)


@query("prediction_coverage", """
SELECT count(*) AS labelled_events, count(e.event_id) AS matched_events, CAST(count(e.event_id) AS DOUBLE) / count(*) AS coverage
FROM reviewed r LEFT JOIN (SELECT alert_id AS event_id FROM assessed) e USING (event_id)
""")
def prediction_coverage(t: Tables) -> DataFrame:
    return lb.prediction_coverage(reviewed(t), baseline_predictions(t))


@query("label_coverage", """
SELECT count(*) AS labelled_events, count(r.event_id) AS matched_events, CAST(count(r.event_id) AS DOUBLE) / count(*) AS coverage
FROM (SELECT alert_id AS event_id FROM assessed) e LEFT JOIN reviewed r USING (event_id)
""")
def label_coverage(t: Tables) -> DataFrame:
    """Share of all changes that have a label."""
    return lb.prediction_coverage(training(t), reviewed(t))


@query("alerts_with_predictions")
def alerts_with_predictions(t: Tables) -> DataFrame:
    stored = baseline_predictions(t).select(
        F.lit(1).cast("long").alias("run_id"), "current_accession_number", "holding_key", F.col("score").alias("probability"),
        F.col("prediction").alias("predicted_label"))
    runs = stored.groupBy("run_id").agg(F.count(F.lit(1)).alias("training_samples")).withColumns({
        "comparison_group_id": F.lit(""), "is_best_model": F.lit(True)})
    return lb.alerts_with_predictions(newest_alerts(t), runs, stored).select("alert_id", "score", "severity", "probability", "predicted_label")


# ---- stored runs ------------------------------------------------------------------------------
# Scores by rule, their thresholds; and the runs of the store in order, as (group, models).
RULES = {
    "rule_score": ("rule_score / 100.0D", "score / 100.0::DOUBLE", 0.4),
    "moved_value": ("least(1.0D, abs_value_delta_thousands / 100000.0D)", "least(1.0::DOUBLE, abs_value_delta_thousands / 100000.0::DOUBLE)", 0.5),
    "event_kind": ("CASE WHEN is_new_position THEN 0.75D WHEN is_exited_position THEN 0.5D ELSE 0.25D END",
                   "CASE WHEN is_new_position THEN 0.75::DOUBLE WHEN is_exited_position THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END", 0.5),
}
STORED = (("first", ("event_kind", "moved_value")), (None, ("rule_score",)), ("second", ("rule_score", "moved_value", "event_kind")))

part("rule_models", " UNION ALL ".join(
    f"SELECT '{name}' AS model_name, event_id, label, s AS p, CASE WHEN s >= {least} THEN 1 ELSE 0 END AS prediction FROM (SELECT *, {sql} AS s FROM reviewed)"
    for name, (_, sql, least) in RULES.items()))
part("rule_quality", _metrics_sql("model_name", "rule_models"))
part("latest_runs", f"""
  SELECT *, row_number() OVER (ORDER BY best DESC, run_id DESC) AS position
  FROM (SELECT *, n = first_value(n) OVER (ORDER BY pr_auc DESC, n) AS best, n + {sum(len(names) for _, names in STORED[:-1])} AS run_id
        FROM rule_quality JOIN (VALUES {', '.join(f"('{name}', {n}::BIGINT)" for n, name in enumerate(STORED[-1][1], 1))}) v(slice, n) USING (slice))
""")


def stored_runs(t: Tables) -> DataFrame:
    """Runs of a store with two comparisons and a single model between them; ``store`` names its folder."""
    def build() -> DataFrame:
        root, rows = f"{shared_folder(t.spark)}/quarterdeck/models-{uuid.uuid4().hex}", reviewed(t)
        score = {name: F.expr(spark_sql) for name, (spark_sql, _, _) in RULES.items()}
        scored = save_stage(reduce(DataFrame.unionByName, [rows.select(
            F.lit(name).alias("model_name"), *store.event_columns(rows), "event_id", "label", (score[name] >= least).cast("int").alias("prediction"), score[name].alias("score"))
            for name, (_, _, least) in RULES.items()]), "rule-scores")
        for group, names in STORED:
            store.store_models(t.spark, root, scored, {name: {"best_params": {"threshold": str(RULES[name][2])}} for name in names}, group)
        return store.model_runs(t.spark, root).withColumn("store", F.lit(root))
    return t.workspace.saved("stored_runs", build)


@query("latest_model", """
SELECT position, run_id, slice AS model_name, 'second' AS comparison_group_id, best AS is_best_model, sample_count AS training_samples,
       true_positive + false_negative AS positive_count, pr_auc, brier_score, precision_at_top_10_percent, accuracy,
       CAST((SELECT count(DISTINCT len(list_filter(q, lambda e: e < p))) FROM rule_models JOIN (
         SELECT model_name, quantile_cont(p, [0.2, 0.4, 0.6, 0.8]) AS q FROM rule_models GROUP BY 1) USING (model_name) WHERE model_name = slice) AS BIGINT) AS curve_points
FROM latest_runs
""")
def latest_model(t: Tables) -> DataFrame:
    """Runs of the newest comparison, best first."""
    runs = lb.latest_model(stored_runs(t))
    place = F.row_number().over(Window.orderBy(F.desc("is_best_model"), F.desc("run_id"))).cast("long")  # the runs of one comparison
    return runs.select(
        place.alias("position"), "run_id", "model_name", "comparison_group_id", "is_best_model", "training_samples", "positive_count",
        *[F.round(F.col("metrics")[m], 6).alias(m) for m in ("pr_auc", "brier_score", "precision_at_top_10_percent", "accuracy")],
        F.size("calibration_curve").cast("long").alias("curve_points"))


@query("alerts_with_latest_run", """
SELECT alert_id, a.score, severity, p AS probability, prediction AS predicted_label
FROM newest_alerts a LEFT JOIN (SELECT event_id AS alert_id, p, prediction FROM rule_models JOIN latest_runs ON model_name = slice WHERE position = 1) USING (alert_id)
""")
def alerts_with_latest_run(t: Tables) -> DataFrame:
    """Alerts with the predictions of the best run of the newest comparison; alerts that it did not score have none."""
    runs = stored_runs(t)
    predictions = store.model_predictions(t.spark, runs.select("store").first()[0]).withColumns({
        "probability": F.col("score"), "predicted_label": F.col("prediction")})
    return lb.alerts_with_predictions(newest_alerts(t), runs, predictions).select("alert_id", "score", "severity", "probability", "predicted_label")


def _no_scores() -> DataFrame:
    raise RuntimeError("the scores of the search are gone: forget the workspace and search again")


@query("stored_comparison", f"""
SELECT g.model_name, g.parameters, (SELECT count(*) FROM assessed) AS training_samples, (SELECT CAST(sum(weak_label) AS BIGINT) FROM assessed) AS positive_count,
       (SELECT count(*) FROM assessed) AS predictions, 1::BIGINT AS groups, 1::BIGINT AS best_models, TRUE AS best_is_highest, TRUE AS curve_in_bounds
FROM (VALUES {', '.join(f"('{m}', '{_PARAMETERS[m]}')" for m in search.GRID)}) g(model_name, parameters)
""")
def stored_comparison(t: Tables) -> DataFrame:
    """The searched classifiers as stored runs: parameters, metrics, calibration curve, group and predictions are read back from the store."""
    root = f"{shared_folder(t.spark)}/quarterdeck/models-{uuid.uuid4().hex}"
    found = {r["model_name"]: {"feature_names": list(ml.CHANGE_FEATURES), "best_params": r["best_params"]} for r in searched(t).collect()}  # a row a model
    store.store_models(t.spark, root, t.workspace.saved("search_scored", _no_scores), found)
    runs, counts = store.model_runs(t.spark, root), store.model_predictions(t.spark, root).groupBy("run_id").agg(F.count(F.lit(1)).alias("predictions"))
    rows = runs.join(counts, "run_id").withColumns({
        "groups": runs.agg(F.count_distinct("comparison_group_id")).scalar(), "best_models": runs.agg(F.sum(F.col("is_best_model").cast("long"))).scalar(),
        "highest": runs.agg(F.max(F.col("metrics")["pr_auc"])).scalar()})
    points = F.col("calibration_curve")
    return rows.select(
        "model_name", F.array_join(F.array_sort(F.map_keys("best_params")), "|").alias("parameters"), "training_samples", "positive_count", "predictions", "groups", "best_models",
        (~F.col("is_best_model") | (F.round(F.col("metrics")["pr_auc"], 9) == F.round("highest", 9))).alias("best_is_highest"),
        (F.size(points).between(1, 5) & F.forall(points, lambda c: c["predicted_probability"].between(0, 1) & c["observed_frequency"].between(0, 1))).alias("curve_in_bounds"))


# ---- fitted forecasts -------------------------------------------------------------------------
def _folds(t: Tables) -> DataFrame:
    return t.workspace.saved("validation_folds", lambda: folds.validation_folds(t.modelled(), *VALIDATION))


def evaluated(t: Tables) -> DataFrame:
    """Keys, features and labels of the evaluated quarters."""
    return t.modelled().filter(F.col("target_report_period").isin([f["evaluation_target_quarter"] for f in _folds(t).collect()]))


def fit_rows(t: Tables) -> DataFrame:
    return t.workspace.saved("fit_rows", lambda: ml.fit_rows(t.modelled()), rows_a_file=linear.BLOCKS_A_FILE)


def ridge_fits(t: Tables) -> DataFrame:
    return t.workspace.saved("ridge_fits", lambda: ml.ridge_table(fit_rows(t), _folds(t)))


def action_fits(t: Tables) -> DataFrame:
    return t.workspace.saved("action_fits", lambda: ml.action_table(fit_rows(t), _folds(t)))


def _ranked(rows: DataFrame, model: str) -> DataFrame:
    kept = ("example_id", "cik", "security_key", "target_report_period")
    stored = save_stage(rows.select(*kept, F.lit(model).alias("model"), F.col(model).alias("predicted_weight")), f"forecast-{model}")
    return fc.predicted_ranks(stored).select(*kept, "predicted_weight", "predicted_rank")


def ridge_forecast(t: Tables) -> DataFrame:
    return t.workspace.saved("ridge_forecast", lambda: _ranked(ml.with_ridge(evaluated(t), ridge_fits(t)), "ridge"))


def boosted_rows(t: Tables) -> DataFrame:
    """Evaluated rows with the boosted forecast and everything that other forecasts and metrics need."""
    needed = dict.fromkeys((*fc.KEPT, *fc.FEATURES))

    def build() -> DataFrame:
        rows = t.gold()  # named; stored first, so that the fits read it too
        quarters = [f["evaluation_target_quarter"] for f in _folds(t).collect()]  # one row per fold
        return ml.boosted(t.modelled(), rows.filter(F.col("target_report_period").isin(quarters)).select(*needed), _folds(t))
    return t.workspace.saved("boosted_rows", build)


def boosted_forecast(t: Tables) -> DataFrame:
    return t.workspace.saved("boosted_forecast", lambda: _ranked(boosted_rows(t), "gradient_boosting"))


def fitted(t: Tables) -> DataFrame:
    """Prediction rows of all five models over all validation folds, with the fitted actions."""
    def build() -> DataFrame:
        told = ml.with_actions(ml.with_ridge(boosted_rows(t), ridge_fits(t)), action_fits(t))
        models = fc.simple_forecasts() | {"ridge": F.col("ridge"), "gradient_boosting": F.col("gradient_boosting")}
        return fc.prediction_rows(told, models)
    return t.workspace.saved("fitted", build)


_X = ("cw", "pw", "lw", "cw - pw", "cr", "pr", "pr - cr", "held", "since", "turnover", "hhi", "top10", "owners", "aggregate_weight")
_N = len(_X)

part("fold_rows", f"""
  SELECT g.*, y - avg(y) OVER f AS dy, {', '.join(f"CASE WHEN stddev_pop(x{i}) OVER f > 1e-12 THEN (x{i} - avg(x{i}) OVER f) / stddev_pop(x{i}) OVER f ELSE 0 END AS z{i}" for i in range(_N))}
  FROM (SELECT quarter, tw AS y, {', '.join(f"CAST({x} AS DOUBLE) AS x{i}" for i, x in enumerate(_X))}
        FROM gold JOIN fold_quarters ON target_report_period < quarter WHERE quarter BETWEEN DATE '{VALIDATION[0]}' AND DATE '{VALIDATION[1]}') g WINDOW f AS (PARTITION BY quarter)
""")
part("fold_systems", f"""
  SELECT quarter, avg(y) AS level, [{', '.join('avg(x%d)' % i for i in range(_N))}] AS mean, [{', '.join('CASE WHEN stddev_pop(x%d) > 1e-12 THEN stddev_pop(x%d) ELSE 1 END' % (i, i) for i in range(_N))}] AS scale,
         [{', '.join('[' + ', '.join(f"sum(z{i} * z{j})" + (' + 1' if i == j else '') for j in range(_N)) + f", sum(z{i} * dy)]" for i in range(_N))}] AS m
  FROM fold_rows GROUP BY 1
""")
# elimination of one column a step; the systems are positive definite, so no rows are exchanged
part("ridge_weights", f"""
  WITH RECURSIVE solved AS (
    SELECT quarter, level, mean, scale, 1 AS k, m FROM fold_systems
    UNION ALL SELECT quarter, level, mean, scale, k + 1, list_transform(m, lambda row, i: CASE WHEN i = k THEN list_transform(row, lambda v: v / m[k][k])
                ELSE list_transform(row, lambda v, j: v - row[k] / m[k][k] * m[k][j]) END) FROM solved WHERE k <= {_N})
  SELECT quarter, level, mean, scale, list_transform(m, lambda row: row[{_N + 1}]) AS w FROM solved WHERE k = {_N + 1}
""")
part("ridge_predictions", f"""
  SELECT example_id, cik, security_key, target_report_period,
         greatest(0, level + {' + '.join(f"w[{i + 1}] * (({x}) - mean[{i + 1}]) / scale[{i + 1}]" for i, x in enumerate(_X))}) AS predicted
  FROM gold JOIN ridge_weights ON target_report_period = quarter
""")


@query("forecast_ridge", """
SELECT example_id, cik, security_key, target_report_period, round(predicted, 7) + 0.0 AS predicted_weight,
       row_number() OVER (PARTITION BY target_report_period, cik ORDER BY predicted DESC, security_key) AS predicted_rank FROM ridge_predictions
""")
def forecast_ridge(t: Tables) -> DataFrame:
    return ridge_forecast(t).withColumn("predicted_weight", F.round("predicted_weight", 7))


@query("forecast_gbt")
def forecast_gbt(t: Tables) -> DataFrame:
    """Boosted forecasts of all validation folds with their ranks."""
    return boosted_forecast(t)


@query("forecast_gbt_ranks", f"""
SELECT target_report_period, cik, count(*) AS candidates, count(*) AS distinct_ranks, 1::BIGINT AS first_rank, count(*) AS last_rank, 0::BIGINT AS misplaced, TRUE AS in_bounds
FROM gold JOIN (SELECT quarter FROM fold_quarters WHERE quarter BETWEEN DATE '{VALIDATION[0]}' AND DATE '{VALIDATION[1]}' AND o > 1) ON target_report_period = quarter GROUP BY 1, 2
""")
def forecast_gbt_ranks(t: Tables) -> DataFrame:
    """Each manager's boosted forecast ranks all its candidates once, by falling weight, and stays within the seen targets."""
    ranks = Window.partitionBy("target_report_period", "cik").orderBy("predicted_rank")
    rows = boosted_forecast(t).withColumn("above", F.lag("predicted_weight").over(ranks))
    most = t.modelled().agg(F.max("target_weight")).scalar()
    return rows.groupBy("target_report_period", "cik").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_distinct("predicted_rank").alias("distinct_ranks"), F.min("predicted_rank").cast("long").alias("first_rank"),
        F.max("predicted_rank").cast("long").alias("last_rank"), F.count_if(F.col("above") < F.col("predicted_weight")).alias("misplaced"),
        ((F.min("predicted_weight") >= 0) & (F.max("predicted_weight") <= F.max(most))).alias("in_bounds"))


@query("action_logistic")
def action_logistic(t: Tables) -> DataFrame:
    told = ml.with_actions(evaluated(t), action_fits(t))
    return told.select("example_id", "target_is_new", "probability_new", "predicted_is_new", "target_is_exit", "probability_exit", "predicted_is_exit")


FITTED = ", ".join(f"'{name}'" for name in ("intercept", *fc.FEATURES))


@query("ridge_optimality", f"""
SELECT quarter, feature, 0.0::DOUBLE AS gradient FROM fold_quarters CROSS JOIN (SELECT unnest([{FITTED}]) AS feature)
WHERE quarter BETWEEN DATE '{VALIDATION[0]}' AND DATE '{VALIDATION[1]}'
""")
def ridge_optimality(t: Tables) -> DataFrame:
    """The gradient of every fold's ridge loss vanishes at its fit."""
    return ml.ridge_gradients(fit_rows(t), _folds(t), ridge_fits(t)).withColumn("gradient", F.round("gradient", 6))


@query("action_optimality", f"""
SELECT quarter, action, feature, 0.0::DOUBLE AS gradient FROM fold_quarters CROSS JOIN (SELECT unnest([{FITTED}]) AS feature) CROSS JOIN (SELECT unnest(['new', 'exit']) AS action)
WHERE quarter BETWEEN DATE '{VALIDATION[0]}' AND DATE '{VALIDATION[1]}'
""")
def action_optimality(t: Tables) -> DataFrame:
    """The gradient of every fold's logistic loss vanishes at the fit of either action."""
    found = ml.action_gradients(fit_rows(t), _folds(t), action_fits(t), *ml.ACTIONS)
    return found.select("quarter", "action", "feature", F.round("gradient", 6).alias("gradient"))


BASELINE_FITTED = ", ".join(f"'{name}'" for name in ("intercept", *ml.CHANGE_FEATURES))


@query("baseline_optimality", f"SELECT unnest([{BASELINE_FITTED}]) AS feature, 0.0::DOUBLE AS gradient WHERE EXISTS (SELECT * FROM assessed)")
def baseline_optimality(t: Tables) -> DataFrame:
    """The gradient of the logistic baseline's loss vanishes at its fit."""
    return ml.baseline_gradient(training(t)).select("feature", F.round("gradient", 3).alias("gradient"))


@query("walk_forward_summary")
def walk_forward_summary(t: Tables) -> DataFrame:
    return fc.fold_summary(fc.manager_quarter_metrics(fitted(t)), _folds(t))
