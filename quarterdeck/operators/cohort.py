"""Manager cohort by filing-level totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.measures import UNIT_CHANGE_DATE, octave, to_dollars
from ..functions.text import parse_number, strip
from .filings import filing_totals
from .ranking import rank_within


def filings_with_totals(filings: DataFrame, summarypage: DataFrame, start: str, end: str, cutover: str = UNIT_CHANGE_DATE) -> DataFrame:
    """Filings of the selection window with their total in dollars; null where none was reported."""
    totals = summarypage.select(
        strip("ACCESSION_NUMBER").alias("accession_number"), parse_number("TABLEVALUETOTAL", "long").alias("reported_total")
    )
    window = filings.filter(F.col("report_period").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return window.join(totals, "accession_number", "left").withColumn(
        "total_value_usd", to_dollars("reported_total", "filing_date", cutover)
    )


def eligible_managers(with_totals: DataFrame, required_quarters: int, anchor_quarter: str) -> DataFrame:
    """Managers with enough quarters including the anchor, and their median quarter total."""
    usable = with_totals.filter(F.col("total_value_usd").isNotNull())
    per_quarter = filing_totals(usable)
    names = usable.filter(F.col("filer_name") != "").groupBy("cik").agg(
        F.max_by("filer_name", F.struct("report_period", "filing_date", "accession_number")).alias("filer_name")
    )
    # a manager has one row per quarter here, so the exact median is over its history only
    ranked = per_quarter.groupBy("cik").agg(
        F.count(F.lit(1)).alias("eligible_quarter_count"),
        F.max((F.col("report_period") == F.lit(anchor_quarter).cast("date")).cast("int")).alias("has_anchor"),
        F.median("total_value_usd").cast("long").alias("median_value_usd"),
    ).filter((F.col("eligible_quarter_count") >= required_quarters) & (F.col("has_anchor") == 1))
    return ranked.join(names, "cik", "left").select(
        "cik", F.coalesce("filer_name", F.lit("")).alias("filer_name"), "eligible_quarter_count", "median_value_usd"
    )


def ordered_cohort(eligible: DataFrame, target_count: int) -> DataFrame:
    """Managers by median value, largest first, with their position; the first ``target_count``."""
    everyone = eligible.withColumn("everyone", F.lit(1))
    ranked = rank_within(
        everyone, ["everyone"], [F.desc("median_value_usd"), F.col("cik")], [-octave("median_value_usd")], "cohort_rank"
    )
    return ranked.filter(F.col("cohort_rank") <= target_count).drop("everyone")


def cohort_checksum(cohort: DataFrame) -> DataFrame:
    """SHA-256 of the ordered CIK list as compact JSON (the list is the cohort, a top-N report)."""
    listed = cohort.agg(F.sort_array(F.collect_list(F.struct("cohort_rank", "cik"))).alias("r"))
    ciks = F.to_json(F.transform("r", lambda x: x["cik"]))
    return listed.select(F.size("r").cast("long").alias("main_actual_count"), F.sha2(ciks, 256).alias("ordered_ciks_sha256"))


def skipped_without_total(with_totals: DataFrame) -> DataFrame:
    return with_totals.agg(F.sum(F.col("total_value_usd").isNull().cast("long")).alias("skipped_filings_missing_total"))
