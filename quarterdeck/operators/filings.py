"""Amendment chains of (cik, report_period).

Filings are ordered by (filing date, amendment number, accession). An original
filing or a non-additive amendment replaces what came before; an additive
amendment is added. So the effective filings of a manager-quarter are those at or
after its last replacing filing, or all of them when every filing is additive.
That is one map-side combined ``max`` per manager-quarter, with no window over
the filings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keys import ORIGINAL_FORM, is_additive
from .ranking import rank_within

MANAGER_QUARTER = ("cik", "report_period")


def filing_position() -> Column:
    """Sort key of a filing inside its manager-quarter."""
    return F.struct(
        F.col("filing_date").alias("d"),
        F.coalesce(F.col("amendment_number"), F.lit(0)).alias("a"),
        F.col("accession_number").alias("n"),
    )


def filing_order(filings: DataFrame) -> DataFrame:
    """1-based position of every filing in its manager-quarter, split by filing day."""
    order = [F.col("filing_date"), F.coalesce("amendment_number", F.lit(0)), F.col("accession_number")]
    return rank_within(filings, MANAGER_QUARTER, order, [F.col("filing_date")], "filing_order")


def effective_filing_rows(filings: DataFrame) -> DataFrame:
    """Filings that contribute to their manager-quarter, with ``position`` as sort key."""
    placed = filings.withColumn("position", filing_position())
    replacing = ~is_additive("submission_type", "amendment_type")
    last_replacement = placed.groupBy(*MANAGER_QUARTER).agg(
        F.max(F.when(replacing, F.col("position"))).alias("replaced_at")
    )
    return (
        placed.join(last_replacement, list(MANAGER_QUARTER))
        .filter(F.col("replaced_at").isNull() | (F.col("position") >= F.col("replaced_at")))
        .drop("replaced_at")
    )


def effective_filings(filings: DataFrame, label_amendment_only: bool = False) -> DataFrame:
    """One row per manager-quarter: selected filing, lineage lists and resolution label.

    ``label_amendment_only`` names additive chains without an original filing separately.
    """
    additive = is_additive("submission_type", "amendment_type")
    original = F.col("submission_type") == ORIGINAL_FORM
    at = F.col("position")
    facts = filings.withColumn("position", filing_position()).groupBy(*MANAGER_QUARTER).agg(
        F.max_by(
            F.struct("accession_number", "filing_date", "filer_name", "package", "submission_type", "amendment_type",
                     additive.alias("additive")), at).alias("last"),
        F.max_by(F.when(original, F.col("filer_name")), F.when(original, at)).alias("original_name"),
        F.min_by("filer_name", at).alias("first_name"),
        F.max(F.when(~additive, at)).alias("replaced_at"),
        F.max(original).alias("has_original"),
        F.sort_array(F.collect_list(at)).alias("chain"),
    )
    used = F.expr("filter(chain, p -> replaced_at is null or p >= replaced_at)")
    unused = F.expr("filter(chain, p -> replaced_at is not null and p < replaced_at)")
    last = F.col("last")
    additive_label = F.lit("initial_plus_additive_amendment")
    if label_amendment_only:
        additive_label = F.when(F.col("has_original"), additive_label).otherwise("amendment_only_additive_chain")
    return facts.select(
        *MANAGER_QUARTER,
        last["filing_date"].alias("selected_filing_date"),
        F.when(last["filer_name"] != "", last["filer_name"])
        .otherwise(F.coalesce("original_name", "first_name")).alias("filer_name"),
        last["accession_number"].alias("selected_accession_number"),
        F.transform(used, lambda p: p["n"]).alias("source_accession_numbers"),
        F.transform(unused, lambda p: p["n"]).alias("superseded_accession_numbers"),
        F.when(last["submission_type"] == ORIGINAL_FORM, "initial")
        .when(last["additive"], additive_label)
        .when(last["amendment_type"] != "", "restatement_amendment")
        .otherwise("unspecified_amendment_replacement").alias("resolution"),
        last["package"].alias("package"),
    )


def filing_totals(filings_with_total: DataFrame) -> DataFrame:
    """Manager-quarter totals from filing totals: replacements reset, additive ones add."""
    return (
        effective_filing_rows(filings_with_total)
        .groupBy(*MANAGER_QUARTER)
        .agg(F.sum("total_value_usd").alias("total_value_usd"))
    )


def latest_filings(filings: DataFrame, limit: int | None = None) -> DataFrame:
    """Best filing per (cik, period), newest first: original form, then latest, per manager ``limit``.

    Filings without a period count as their own period.
    """
    period = F.coalesce(F.col("report_period").cast("string"), F.col("accession_number"))
    better = F.struct((F.col("submission_type") == ORIGINAL_FORM).alias("o"), "filing_date", "accession_number")
    best = filings.groupBy("cik", period.alias("period_key")).agg(
        F.max_by(F.struct("accession_number", "report_period", "filing_date", "submission_type", "filer_name"), better).alias("f")
    ).select("cik", "f.*")
    newest = [F.desc_nulls_last("report_period"), F.desc("filing_date"), F.desc("accession_number")]
    # one row per manager and quarter, so a manager's group is no longer than its history
    ranked = best.withColumn("recency", F.row_number().over(Window.partitionBy("cik").orderBy(*newest)).cast("long"))
    return ranked if limit is None else ranked.filter(F.col("recency") <= limit)


def adjacent_pairs(latest: DataFrame) -> DataFrame:
    """Each latest filing with the next older one of the same manager."""
    history = Window.partitionBy("cik").orderBy("recency")
    return latest.select(
        "cik",
        F.col("accession_number").alias("current_accession_number"),
        F.col("report_period").alias("current_report_period"),
        F.lead("accession_number").over(history).alias("previous_accession_number"),
        F.lead("report_period").over(history).alias("previous_report_period"),
    ).filter(F.col("previous_accession_number").isNotNull())


def recent_filings(filings: DataFrame, limit: int = 20) -> DataFrame:
    """Newest filings first (a report with a row limit)."""
    return filings.orderBy(
        F.desc("report_period"), F.desc("filing_date"), F.desc("accession_number")
    ).limit(limit).select("accession_number", "cik", "filing_date", "report_period", "submission_type", "filer_name")
