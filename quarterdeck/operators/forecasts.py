"""Forecast rows, ranking metrics and their summaries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.measures import ACTION_TOLERANCE, EMA_ALPHA, normalised_ema, share_of

GROUP = ("model", "target_report_period", "cik")

# Model features in order, metric names, cohort limits.
FEATURES = (
    "current_weight", "previous_weight", "lag2_weight", "weight_momentum", "current_rank", "previous_rank",
    "rank_momentum", "holding_history_quarters", "quarters_since_last_held", "manager_turnover",
    "manager_concentration_hhi", "manager_top10_share", "peer_owner_count", "peer_aggregate_weight",
)
METRICS = (
    "ndcg_at_10", "ndcg_at_20", "recall_at_10", "rank_correlation", "weight_mae", "weight_rmse",
    "new_precision", "new_recall", "exit_precision", "exit_recall",
)
SMALL_BELOW, MEDIUM_BELOW = 50, 200
KEPT = (
    "example_id", "cik", "security_key", "cusip", "issuer_name", "feature_report_period", "feature_available_at",
    "target_report_period", "current_weight", "target_weight", "target_is_new", "target_is_exit",
)


def simple_forecasts(alpha: float = EMA_ALPHA) -> dict[str, Column]:
    return {
        "persistence": F.col("current_weight"),
        "ema": normalised_ema(["current_weight", "previous_weight", "lag2_weight"], alpha),
        "institutional_popularity": F.col("peer_aggregate_weight"),
    }


def prediction_rows(examples: DataFrame, models: Mapping[str, Column]) -> DataFrame:
    """One row per example and model, from one pass over the examples."""
    stacked = F.explode(F.array(*[
        F.struct(F.lit(name).alias("model"), score.cast("double").alias("predicted_weight")) for name, score in models.items()
    ]))
    extra = [c for c in ("predicted_is_new", "predicted_is_exit") if c in examples.columns]
    rows = examples.select(*KEPT, *extra, stacked.alias("m")).select(*KEPT, *extra, "m.*")
    if extra:
        return rows
    held, forecast = F.col("current_weight") > ACTION_TOLERANCE, F.col("predicted_weight") > ACTION_TOLERANCE
    return rows.withColumns({
        "predicted_is_new": (forecast & ~held).cast("int"), "predicted_is_exit": (~forecast & held).cast("int"),
    })


def predicted_ranks(predictions: DataFrame) -> DataFrame:
    """Rank by forecast in each (model, quarter, manager): one manager's candidate list, as in ``manager_quarter_metrics``.

    Rows that are dealt by manager stay where they are.
    """
    order = Window.partitionBy(*GROUP).orderBy(F.desc("predicted_weight"), "security_key")
    return predictions.withColumn("predicted_rank", F.row_number().over(order).cast("long"))


def manager_quarter_metrics(predictions: DataFrame) -> DataFrame:
    """All metrics of each (model, quarter, manager).

    A group is one manager's candidate list: its holdings plus the candidate cap, so it is
    bounded by the listed securities. Every window shares one partitioning and there are two
    sorts, by score and by truth: average ranks count from the top, which leaves their
    correlation as it is.
    """
    group = Window.partitionBy(*GROUP)
    truth, score = F.col("target_weight"), F.col("predicted_weight")

    def place(c: Column) -> Column:
        return F.row_number().over(group.orderBy(c.desc(), F.col("security_key")))

    def average_rank(c: Column) -> Column:
        falling = group.orderBy(c.desc())
        ties = F.count(F.lit(1)).over(falling.rangeBetween(Window.currentRow, Window.currentRow))
        return F.rank().over(falling) + (ties - 1) / F.lit(2.0)

    # in this order the sort for a place serves the average rank as well
    placed = predictions.withColumn("by_score", place(score)).withColumn("r_score", average_rank(score))
    placed = placed.withColumn("by_truth", place(truth)).withColumn("r_truth", average_rank(truth))

    def gain(position: str, k: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col(position) <= k, truth / F.log2(F.col(position) + 1))), F.lit(0.0))

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(condition.cast("long")), F.lit(0))

    sums = placed.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("examples"),
        count(F.col("current_weight") > 0).alias("current_portfolio_candidates_held"),
        *[gain(p, k).alias(f"{n}{k}") for k in (10, 20) for n, p in (("dcg", "by_score"), ("ideal", "by_truth"))],
        count(truth > 0).alias("positives"),
        count((truth > 0) & (F.col("by_truth") <= 10) & (F.col("by_score") <= 10)).alias("recalled"),
        F.try_divide(
            F.covar_pop("r_truth", "r_score"), F.stddev_pop("r_truth") * F.stddev_pop("r_score")
        ).alias("correlation"),
        (F.min(truth) == F.max(truth)).alias("flat_truth"), (F.min(score) == F.max(score)).alias("flat_score"),
        F.avg(F.abs(truth - score)).alias("weight_mae"),
        F.sqrt(F.avg((truth - score) * (truth - score))).alias("weight_rmse"),
        *[
            count(c).alias(f"{action}_{n}")
            for action in ("new", "exit")
            for n, c in (
                ("tp", (F.col(f"target_is_{action}") == 1) & (F.col(f"predicted_is_{action}") == 1)),
                ("fp", (F.col(f"target_is_{action}") == 0) & (F.col(f"predicted_is_{action}") == 1)),
                ("fn", (F.col(f"target_is_{action}") == 1) & (F.col(f"predicted_is_{action}") == 0)),
            )
        ],
    )
    held = F.col("current_portfolio_candidates_held")
    flat = F.col("flat_truth") | F.col("flat_score") | (F.col("examples") < 2)
    return sums.select(
        *GROUP, "examples", "current_portfolio_candidates_held",
        F.when(held < SMALL_BELOW, "small").when(held < MEDIUM_BELOW, "medium").otherwise("large").alias("manager_cohort"),
        share_of("dcg10", "ideal10").alias("ndcg_at_10"), share_of("dcg20", "ideal20").alias("ndcg_at_20"),
        share_of("recalled", F.least("positives", F.lit(10))).alias("recall_at_10"),
        F.when(flat, 0.0).otherwise(F.coalesce("correlation", F.lit(0.0))).alias("rank_correlation"),
        "weight_mae", "weight_rmse",
        *[
            share_of(f"{action}_tp", F.col(f"{action}_tp") + F.col(f"{action}_{other}")).alias(f"{action}_{name}")
            for action in ("new", "exit") for name, other in (("precision", "fp"), ("recall", "fn"))
        ],
    )


def metric_slices(group_metrics: DataFrame) -> DataFrame:
    """Macro averages per model: overall, by target quarter and by manager cohort."""
    model, quarter, cohort = F.col("model"), F.col("target_report_period"), F.col("manager_cohort")
    sliced = group_metrics.groupingSets([[model], [model, quarter], [model, cohort]], "model", "target_report_period", "manager_cohort")
    return sliced.agg(
        F.count(F.lit(1)).alias("manager_quarter_groups"), *[F.avg(m).alias(m) for m in METRICS]
    )


def fold_summary(group_metrics: DataFrame, folds: DataFrame) -> DataFrame:
    """Mean and population deviation over validation folds, per model and metric."""
    per_fold = group_metrics.groupBy("model", F.col("target_report_period").alias("evaluation_target_quarter")).agg(
        *[F.avg(m).alias(m) for m in METRICS]
    )
    # one row per fold
    validation = folds.filter(F.col("role") == "validation").select("fold_id", "evaluation_target_quarter")
    tall = per_fold.join(validation, "evaluation_target_quarter").select(
        "model", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("x")
    ).select("model", "x.*")
    return tall.groupBy("model", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std_across_folds"), F.count(F.lit(1)).alias("folds")
    )


def materialised_forecast(examples: DataFrame, lineage: DataFrame, target_quarter: str, run_id: Column) -> DataFrame:
    """Persistence forecast of one quarter with source filings; truth columns are not selected."""
    columns = ["example_id", "cik", "security_key", "cusip", "issuer_name", "feature_report_period", "feature_available_at",
               "target_report_period", F.col("current_weight").alias("predicted_weight")]
    chosen = examples.filter(F.col("target_report_period") == F.lit(target_quarter).cast("date")).select(*columns)
    order = Window.partitionBy("cik").orderBy(F.desc("predicted_weight"), "security_key")
    ranked = chosen.withColumn("predicted_rank", F.row_number().over(order).cast("long"))
    sources = lineage.select("cik", F.col("report_period").alias("feature_report_period"), "source_accession_numbers")
    return ranked.join(sources, ["cik", "feature_report_period"], "left").withColumns({
        "run_id": run_id,
        "source_accession_numbers": F.coalesce("source_accession_numbers", F.array().cast("array<string>")),
    })


def forecast_page(predictions: DataFrame, cik: str | None = None, target_quarter: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    if limit < 1 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    rows = predictions
    if cik is not None:
        rows = rows.filter(F.col("cik") == cik)
    if target_quarter is not None:
        rows = rows.filter(F.col("target_report_period") == F.lit(target_quarter).cast("date"))
    return rows.orderBy("cik", "predicted_rank", "security_key").offset(offset).limit(limit)


def forecast_runs(predictions: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Stored runs, newest first: a page of one row per run, with its size and the number of all runs."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    runs = predictions.groupBy("run_id", "target_report_period", "generated_at").agg(F.count(F.lit(1)).alias("prediction_count"))
    total = runs.agg(F.count(F.lit(1)).alias("run_count"))
    page = runs.orderBy(F.desc("generated_at"), F.desc("run_id")).offset(offset).limit(limit)
    return page.withColumn("run_count", total.scalar())


def forecast_total(predictions: DataFrame, cik: str, target_quarter: str) -> DataFrame:
    return predictions.filter(
        (F.col("cik") == cik) & (F.col("target_report_period") == F.lit(target_quarter).cast("date"))
    ).agg(F.count(F.lit(1)).alias("prediction_count"))
