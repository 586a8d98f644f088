"""Holdings -> point-in-time manager x security x quarter examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import digest_id
from ..functions.measures import ACTION_TOLERANCE, position_action
from ..functions.quarters import shift_quarter
from ..operators.portfolios import ELIGIBLE, history_features

NEGATIVE_LIMIT = 100
ACTIONS = ("new", "exit", "increase", "decrease", "unchanged")


def build_examples(
    held: DataFrame, negatives: DataFrame, history: DataFrame, tolerance: float = ACTION_TOLERANCE
) -> DataFrame:
    """One row per candidate: features known at the cut-off and the next quarter's target.

    Candidates already carry manager facts and peer statistics. The manager's whole
    history of the security arrives with the only large join, on (cik, security);
    current, previous, lag-2 and target values are lookups in it. ``peers.candidates_by_manager``
    brings all of it without that join.
    """
    return examples_of(held.unionByName(negatives).join(history, ["cik", "security_key"], "left"), tolerance)


def example_id() -> Column:
    return digest_id("cik", F.col("feature_report_period").cast("string"), "security_key").alias("example_id")


def examples_of(candidates: DataFrame, tolerance: float = ACTION_TOLERANCE) -> DataFrame:
    """Examples from candidates that carry the manager's history of the security as ``quarters``."""
    rows = candidates

    def at(quarters_away: int):
        return F.col("quarters")[shift_quarter("report_period", quarters_away) if quarters_away else F.col("report_period")]

    rows = rows.withColumns({"now": at(0), "before": at(-1), "lag2": at(-2), "then": at(1)})
    rows = history_features(rows, "quarters", "report_period").drop("quarters")

    def weight(name: str):
        return F.coalesce(F.col(name)["w"], F.lit(0.0))

    def rank(name: str, size: str):
        return F.coalesce(F.col(name)["r"], F.col(size) + 1)

    values = rows.withColumns({
        "current_weight": weight("now"), "previous_weight": weight("before"), "lag2_weight": weight("lag2"),
        "target_weight": weight("then"), "current_rank": rank("now", "holdings"),
        "previous_rank": rank("before", "previous_holdings"), "target_rank": rank("then", "target_holdings"),
        "target_action": position_action(weight("now"), weight("then"), tolerance),
    })
    return values.select(
        digest_id("cik", F.col("report_period").cast("string"), "security_key").alias("example_id"),
        "cik", "security_key",
        F.col("first_cusip").alias("cusip"),
        # a later quarter's name is not known at the cut-off
        F.coalesce(F.col("now.issuer"), F.col("before.issuer"), F.col("first_issuer_name")).alias("issuer_name"),
        F.col("report_period").alias("feature_report_period"),
        F.col("cutoff").alias("feature_available_at"),
        "target_report_period", "target_available_at",
        "security_first_seen_period", "security_first_seen_available_at",
        "current_weight", "previous_weight", "lag2_weight",
        (F.col("current_weight") - F.col("previous_weight")).alias("weight_momentum"),
        "current_rank", "previous_rank",
        (F.col("previous_rank") - F.col("current_rank")).alias("rank_momentum"),
        "holding_history_quarters", "quarters_since_last_held",
        F.coalesce("turnover", F.lit(0.0)).alias("manager_turnover"),
        F.col("concentration_hhi").alias("manager_concentration_hhi"),
        F.col("top10_share").alias("manager_top10_share"),
        "peer_owner_count", "peer_aggregate_weight",
        "target_weight", "target_rank", F.col("then").isNotNull().cast("int").alias("in_target"),
        "target_action",
        *[(F.col("target_action") == a).cast("int").alias(f"target_is_{a}") for a in ACTIONS],
    )


def coverage_by_manager_quarter(examples: DataFrame, quarters: DataFrame) -> DataFrame:
    """How much of each target portfolio lies inside the candidate set."""
    covered = examples.groupBy("cik", F.col("feature_report_period").alias("report_period")).agg(
        F.sum("in_target").alias("covered_target_holding_count"),
        F.sum("target_weight").alias("covered_target_weight"),
    )
    return quarters.filter(F.col("status") == ELIGIBLE).join(covered, ["cik", "report_period"], "left").select(
        "cik", F.col("report_period").alias("feature_report_period"), "target_report_period",
        F.col("target_holdings").alias("target_holding_count"),
        F.coalesce("covered_target_holding_count", F.lit(0)).alias("covered_target_holding_count"),
        F.col("target_weight_sum").alias("target_weight_mass_total"),
        F.coalesce("covered_target_weight", F.lit(0.0)).alias("target_weight_mass_in_candidate_universe"),
        F.coalesce(F.try_divide("covered_target_weight", "target_weight_sum"), F.lit(0.0)).alias("target_weight_mass_coverage"),
    )


def coverage_summary(per_manager_quarter: DataFrame) -> DataFrame:
    """Coverage by target quarter and overall (null quarter), with the mean of ratios."""
    grouped = per_manager_quarter.groupingSets([[F.col("target_report_period")], []], "target_report_period").agg(
        F.count(F.lit(1)).alias("manager_quarter_count"),
        F.sum("target_holding_count").alias("target_holdings"),
        F.sum("covered_target_holding_count").alias("target_holdings_in_candidate_universe"),
        F.sum("target_weight_mass_total").alias("target_weight_mass_total"),
        F.sum("target_weight_mass_in_candidate_universe").alias("target_weight_mass_in_candidate_universe"),
        F.avg("target_weight_mass_coverage").alias("mean_target_weight_mass_coverage"),
    )
    return grouped.withColumns({
        "target_candidate_coverage": F.coalesce(
            F.try_divide("target_holdings_in_candidate_universe", "target_holdings"), F.lit(0.0)),
        "target_weight_mass_coverage": F.coalesce(
            F.try_divide("target_weight_mass_in_candidate_universe", "target_weight_mass_total"), F.lit(0.0)),
    })


def coverage_by_cap(positions: DataFrame, quarters: DataFrame, caps: Sequence[int]) -> DataFrame:
    """Mean coverage under each candidate cap, all caps in one pass over the placed targets."""
    inside = positions.groupBy("cik", "report_period").agg(*[
        F.sum(F.when(F.col("position") <= cap, F.col("target_weight"))).alias(f"covered_{cap}") for cap in caps])
    every = quarters.filter(F.col("status") == ELIGIBLE).join(inside, ["cik", "report_period"], "left")
    means = every.agg(*[
        F.avg(F.coalesce(F.try_divide(f"covered_{cap}", "target_weight_sum"), F.lit(0.0))).alias(f"mean_{cap}") for cap in caps])
    return means.select(F.inline(F.array(*[F.struct(
        F.lit(cap).cast("long").alias("negative_candidate_limit"), F.col(f"mean_{cap}").alias("mean_target_weight_mass_coverage")) for cap in caps])))


def smallest_good_cap(reports: DataFrame, tolerance_percentage_points: float = 0.25) -> DataFrame:
    """Smallest candidate cap whose mean coverage is within the tolerance of the best."""
    # one row per studied cap
    best = F.max("mean_target_weight_mass_coverage")
    listed = reports.agg(
        best.alias("best_mean_target_weight_mass_coverage"),
        F.collect_list(F.struct("negative_candidate_limit", "mean_target_weight_mass_coverage")).alias("r"),
    )
    good = F.filter(
        "r",
        lambda x: F.col("best_mean_target_weight_mass_coverage") - x["mean_target_weight_mass_coverage"]
        <= F.lit(tolerance_percentage_points / 100),
    )
    return listed.select(
        F.array_min(F.transform(good, lambda x: x["negative_candidate_limit"])).alias("selected_negative_candidate_limit"),
        "best_mean_target_weight_mass_coverage",
    )
