"""Registered queries: simple forecasts, metrics, forecast tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import folds, forecasts as fc
from .gold import VALIDATION
from .silver import query
from .sql_twins import part
from .tables import Tables

# The quarter and run of the materialised forecast.
TARGET_QUARTER = "2000-12-31"
RUN_ID = "persistence-2000q4"
SERVED_MANAGER = "0000000008"

part("predictions", """
  SELECT *, CASE WHEN predicted > 1e-8 AND cw <= 1e-8 THEN 1 ELSE 0 END AS p_new, CASE WHEN predicted <= 1e-8 AND cw > 1e-8 THEN 1 ELSE 0 END AS p_exit,
         row_number() OVER (PARTITION BY model, target_report_period, cik ORDER BY predicted DESC, security_key) AS predicted_rank
  FROM (SELECT 'persistence' AS model, cw AS predicted, * FROM gold
        UNION ALL SELECT 'ema', (0.6 * cw + 0.24 * pw + 0.096 * lw) / 0.936, * FROM gold
        UNION ALL SELECT 'institutional_popularity', aggregate_weight, * FROM gold)
""")
part("ranked_predictions", """
  SELECT *, row_number() OVER (g ORDER BY predicted DESC, security_key) AS bs, row_number() OVER (g ORDER BY tw DESC, security_key) AS bt,
         rank() OVER (g ORDER BY tw) + (count(*) OVER (PARTITION BY model, target_report_period, cik, tw) - 1) / 2.0 AS rt,
         rank() OVER (g ORDER BY predicted) + (count(*) OVER (PARTITION BY model, target_report_period, cik, predicted) - 1) / 2.0 AS rs
  FROM predictions WINDOW g AS (PARTITION BY model, target_report_period, cik)
""")
part("mq_metrics", """
  SELECT model, target_report_period, cik, examples, current_portfolio_candidates_held,
         CASE WHEN current_portfolio_candidates_held < 50 THEN 'small' WHEN current_portfolio_candidates_held < 200 THEN 'medium' ELSE 'large' END AS manager_cohort,
         coalesce(d10 / nullif(i10, 0), 0) AS ndcg_at_10, coalesce(d20 / nullif(i20, 0), 0) AS ndcg_at_20,
         coalesce(recalled / nullif(CAST(least(positives, 10) AS DOUBLE), 0), 0) AS recall_at_10,
         CASE WHEN flat OR examples < 2 THEN 0 ELSE coalesce(correlation, 0) END AS rank_correlation, weight_mae, weight_rmse,
         coalesce(ntp / nullif(CAST(ntp + nfp AS DOUBLE), 0), 0) AS new_precision, coalesce(ntp / nullif(CAST(ntp + nfn AS DOUBLE), 0), 0) AS new_recall,
         coalesce(etp / nullif(CAST(etp + efp AS DOUBLE), 0), 0) AS exit_precision, coalesce(etp / nullif(CAST(etp + efn AS DOUBLE), 0), 0) AS exit_recall
  FROM (SELECT model, target_report_period, cik, count(*) AS examples, count(*) FILTER (cw > 0) AS current_portfolio_candidates_held,
    sum(tw / log2(bs + 1)) FILTER (bs <= 10) AS d10, sum(tw / log2(bt + 1)) FILTER (bt <= 10) AS i10,
    sum(tw / log2(bs + 1)) FILTER (bs <= 20) AS d20, sum(tw / log2(bt + 1)) FILTER (bt <= 20) AS i20,
    count(*) FILTER (tw > 0) AS positives, count(*) FILTER (tw > 0 AND bt <= 10 AND bs <= 10) AS recalled, corr(rt, rs) AS correlation,
    min(tw) = max(tw) OR min(predicted) = max(predicted) AS flat, avg(abs(tw - predicted)) AS weight_mae, sqrt(avg((tw - predicted) * (tw - predicted))) AS weight_rmse,
    count(*) FILTER (action = 'new' AND p_new = 1) AS ntp, count(*) FILTER (action <> 'new' AND p_new = 1) AS nfp, count(*) FILTER (action = 'new' AND p_new = 0) AS nfn,
    count(*) FILTER (action = 'exit' AND p_exit = 1) AS etp, count(*) FILTER (action <> 'exit' AND p_exit = 1) AS efp, count(*) FILTER (action = 'exit' AND p_exit = 0) AS efn
    FROM ranked_predictions GROUP BY 1, 2, 3)
""")


def predictions(t: Tables) -> DataFrame:
    """Forecasts of all models, dealt by manager and never stored."""
    return fc.prediction_rows(t.build_gold(), fc.simple_forecasts())


def metrics(t: Tables) -> DataFrame:
    return t.workspace.saved("metrics", lambda: fc.manager_quarter_metrics(predictions(t)))


def _forecast(model: str):
    decimals = 6 if model == "institutional_popularity" else 8

    def run(t: Tables) -> DataFrame:
        ranked = fc.predicted_ranks(predictions(t).filter(F.col("model") == model))
        return ranked.select("example_id", "cik", "security_key", "target_report_period", "predicted_is_new", "predicted_is_exit",
                             F.round("predicted_weight", decimals).alias("predicted_weight"), "predicted_rank")

    return run, f"""
      SELECT example_id, cik, security_key, target_report_period, p_new AS predicted_is_new, p_exit AS predicted_is_exit,
             round(predicted, {decimals}) AS predicted_weight, predicted_rank FROM predictions WHERE model = '{model}'"""


for _name, _model in (("forecast_persistence", "persistence"), ("forecast_ema", "ema"), ("forecast_popularity", "institutional_popularity")):
    _run, _sql = _forecast(_model)
    query(_name, _sql)(_run)


GROUP = "model, target_report_period, cik"


def _columns(*names: str, digits: int = 6):
    def run(t: Tables) -> DataFrame:
        return metrics(t).select(*fc.GROUP, *[F.round(n, digits).alias(n) for n in names])

    return run, f"SELECT {GROUP}, {', '.join(f'round({n}, {digits}) AS {n}' for n in names)} FROM mq_metrics"


for _name, _names in (
    ("ndcg", ("ndcg_at_10", "ndcg_at_20")), ("recall_at_k", ("recall_at_10",)), ("rank_correlation", ("rank_correlation",)),
    ("action_pr", ("new_precision", "new_recall", "exit_precision", "exit_recall")),
):
    _run, _sql = _columns(*_names)
    query(_name, _sql)(_run)


@query("weight_errors", f"""
SELECT {GROUP}, examples, manager_cohort, round(weight_mae, 7) AS weight_mae, round(weight_rmse, 7) AS weight_rmse FROM mq_metrics
""")
def weight_errors(t: Tables) -> DataFrame:
    return metrics(t).select(*fc.GROUP, "examples", "manager_cohort", F.round("weight_mae", 7).alias("weight_mae"), F.round("weight_rmse", 7).alias("weight_rmse"))


@query("metric_slices", f"""
SELECT model, target_report_period, manager_cohort, count(*) AS manager_quarter_groups, {', '.join(f'round(avg({m}), 6) AS {m}' for m in fc.METRICS)}
FROM mq_metrics GROUP BY GROUPING SETS ((model), (model, target_report_period), (model, manager_cohort))
""")
def metric_slices(t: Tables) -> DataFrame:
    s = fc.metric_slices(metrics(t))
    return s.withColumns({m: F.round(m, 6) for m in fc.METRICS})


@query("fold_summary", f"""
SELECT model, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std_across_folds, count(*) AS folds FROM (
  {' UNION ALL '.join(f"SELECT model, target_report_period, '{m}' AS metric, avg({m}) AS value FROM mq_metrics GROUP BY 1, 2" for m in fc.METRICS)})
WHERE target_report_period BETWEEN DATE '{VALIDATION[0]}' AND DATE '{VALIDATION[1]}' GROUP BY 1, 2
""")
def fold_summary(t: Tables) -> DataFrame:
    # only names and quarters of the folds are read: the metrics of one model have the quarters of the examples
    split = folds.validation_folds(metrics(t).filter("model = 'persistence'"), *VALIDATION)
    s = fc.fold_summary(metrics(t), split)
    return s.withColumns({"mean": F.round("mean", 6), "std_across_folds": F.round("std_across_folds", 6)})


part("served", f"""
  SELECT '{RUN_ID}' AS run_id, example_id, p.cik, security_key, p.report_period AS feature_report_period, p.available_at AS feature_available_at, target_report_period,
         round(predicted, 8) AS predicted_weight, predicted_rank, coalesce(source_accession_numbers, '') AS source_accession_numbers
  FROM predictions p LEFT JOIN chain_lists c ON c.cik = p.cik AND c.report_period = p.report_period
  WHERE model = 'persistence' AND target_report_period = DATE '{TARGET_QUARTER}'
""")


def _materialised(t: Tables) -> DataFrame:
    return fc.materialised_forecast(t.build_quarter(TARGET_QUARTER), t.effective_filings(), TARGET_QUARTER, F.lit(RUN_ID))


def forecast_table(t: Tables) -> DataFrame:
    """Stored forecasts by quarter, ranges of managers sorted inside, so a page reads few row groups of one quarter."""
    def build() -> DataFrame:
        return _materialised(t).repartitionByRange("cik").sortWithinPartitions("cik", "predicted_rank", "security_key")
    return t.workspace.saved("forecast_table", build, ("target_report_period",))


def _served(df: DataFrame) -> DataFrame:
    return df.select("run_id", "example_id", "cik", "security_key", "feature_report_period", "feature_available_at", "target_report_period",
                     F.round("predicted_weight", 8).alias("predicted_weight"), "predicted_rank",
                     F.array_join("source_accession_numbers", "|").alias("source_accession_numbers"))


@query("forecast_materialisation", "SELECT * FROM served")
def forecast_materialisation(t: Tables) -> DataFrame:
    return _served(_materialised(t))


@query("forecast_page", f"SELECT * FROM served WHERE cik = '{SERVED_MANAGER}' ORDER BY cik, predicted_rank, security_key LIMIT 20 OFFSET 20")
def forecast_page(t: Tables) -> DataFrame:
    saved = forecast_table(t)
    return _served(fc.forecast_page(saved, SERVED_MANAGER, TARGET_QUARTER, limit=20, offset=20))


@query("forecast_total", f"SELECT count(*) AS prediction_count FROM served WHERE cik = '{SERVED_MANAGER}'")
def forecast_total(t: Tables) -> DataFrame:
    saved = forecast_table(t)
    return fc.forecast_total(saved, SERVED_MANAGER, TARGET_QUARTER)


# A run for each target quarter, generated when its last feature became available
@query("forecast_runs", """
SELECT *, count(*) OVER () AS run_count FROM (
  SELECT 'persistence-' || CAST(target_report_period AS VARCHAR) AS run_id, target_report_period, max(available_at) AS generated_at, count(*) AS prediction_count
  FROM predictions WHERE model = 'persistence' GROUP BY 1, 2)
QUALIFY row_number() OVER (ORDER BY generated_at DESC, run_id DESC) BETWEEN 3 AND 12
""")
def forecast_runs(t: Tables) -> DataFrame:
    """The second page of the list of runs."""
    rows = fc.prediction_rows(t.gold(), fc.simple_forecasts()).filter("model = 'persistence'")
    # a row per quarter
    generated = t.save(rows.groupBy("target_report_period").agg(F.max("feature_available_at").alias("generated_at")), "generated")
    stored = rows.join(generated, "target_report_period").withColumn("run_id", F.concat(F.lit("persistence-"), F.col("target_report_period").cast("string")))
    return fc.forecast_runs(stored, limit=10, offset=2)
