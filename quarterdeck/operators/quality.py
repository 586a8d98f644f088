"""Quality metrics of built tables, each in one pass, and the gates over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Mismatch counters of the prefix check, and the weight tolerance.
PREFIX_COUNTERS = (
    "missing_in_baseline", "missing_in_scaled", "value_mismatches", "shares_mismatches",
    "weight_mismatches", "rank_mismatches", "availability_mismatches", "accession_mismatches",
)
WEIGHT_TOLERANCE = 1e-12


def silver_metrics(silver: DataFrame, last_period: str) -> DataFrame:
    """Counts, distincts, period range, rows after the frozen end and the largest weight-sum error.

    Aggregated by manager-quarter first, so nothing but small rows reaches the last step.
    """
    per_portfolio = silver.groupBy("cik", "report_period").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("portfolio_weight").alias("weight_sum"),
        F.max("portfolio_value_usd").alias("portfolio_value_usd"),
    )
    expected = F.when(F.col("portfolio_value_usd") == 0, 0.0).otherwise(1.0)
    return per_portfolio.agg(
        F.sum("rows").alias("holding_rows"),
        F.count(F.lit(1)).alias("portfolios"),
        F.countDistinct("cik").alias("distinct_managers"),
        F.countDistinct("report_period").alias("distinct_report_periods"),
        F.min("report_period").alias("min_report_period"),
        F.max("report_period").alias("max_report_period"),
        F.coalesce(
            F.sum(F.when(F.col("report_period") > F.lit(last_period).cast("date"), F.col("rows"))), F.lit(0)
        ).alias("prospective_rows"),
        F.max(F.abs(F.col("weight_sum") - expected)).alias("portfolio_weight_max_abs_error"),
    )


def build_report(filings: DataFrame, effective: DataFrame, holdings: DataFrame, normalized: DataFrame, rejected: DataFrame) -> DataFrame:
    """Quality report of the last-line-wins build."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name))

    usable = filings.filter(F.col("reason").isNull())
    parts = [
        usable.agg(
            F.count(F.lit(1)).alias("submissions_processed"), F.countDistinct("package").alias("packages_processed"),
        ),
        effective.agg(F.count(F.lit(1)).alias("effective_filings"), F.countDistinct("cik").alias("unique_managers")),
        count(holdings, "raw_holdings"),
        normalized.agg(
            F.count(F.lit(1)).alias("normalized_holdings"), F.countDistinct("security_key").alias("unique_securities"),
            F.avg((F.col("cusip") != "").cast("double")).alias("identifier_coverage"),
        ),
        count(rejected, "invalid_rows_rejected"),
    ]
    # each side is a single row; stacking as one struct column avoids a cross join
    rows = None
    for p in parts:
        tall = p.select(F.explode(F.map_from_arrays(
            F.array(*[F.lit(c) for c in p.columns]), F.array(*[F.col(c).cast("double") for c in p.columns])
        )).alias("metric", "value"))
        rows = tall if rows is None else rows.unionByName(tall)
    return rows


def scale_gate(metrics: DataFrame) -> DataFrame:
    """Pass flag and ordered blocking reasons from one row of metrics."""
    def counter(name: str):
        return F.coalesce(F.col(name), F.lit(0)) if name in metrics.columns else F.lit(0)

    checks = [F.when(counter(n) != 0, n) for n in (*PREFIX_COUNTERS, "prospective_rows")]
    checks.append(F.when(counter("portfolio_weight_max_abs_error") > WEIGHT_TOLERANCE, "portfolio_weight_max_abs_error"))
    reasons = F.array_compact(F.array(*checks))
    return metrics.select((F.size(reasons) == 0).alias("passed"), reasons.alias("blocking_reasons"))
