"""Rejected rows with reasons, and checks of client portfolios and labelled sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import strip
from ..session import save_stage


def rejected_rows(filings: DataFrame, holdings: DataFrame) -> DataFrame:
    """Rows kept out of the build: package, table, row key, reason.

    Row keys stand in for line numbers, which do not exist in split files. Holding
    lines count only when their filing is usable.
    """
    usable = filings.filter(F.col("reason").isNull()).select("accession_number", "package")
    bad_filings = filings.filter(F.col("reason").isNotNull()).select(
        "package", F.lit("SUBMISSION").alias("table_name"), F.col("accession_number").alias("accession_number"),
        F.lit("").alias("row_key"), "reason",
    )
    bad_lines = holdings.filter(F.col("reason").isNotNull()).join(usable, "accession_number").select(
        "package", F.lit("INFOTABLE").alias("table_name"), "accession_number",
        F.col("info_table_key").alias("row_key"), "reason",
    )
    return bad_filings.unionByName(bad_lines)


def portfolio_problems(client_holdings: DataFrame) -> DataFrame:
    """Client portfolios that break a rule, with the broken rules as a list."""
    name = ["client_id", "client_name", "strategy"]
    # one row per client and CUSIP first: a duplicate is a CUSIP with more than one line
    per_security = client_holdings.groupBy(*name, "cusip").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"),
        F.max(((F.col("weight") < 0) | (F.col("weight") > 1)).cast("int")).alias("outside"),
    )
    per_client = per_security.groupBy(*name).agg(
        F.sum(F.when(F.col("cusip").isNotNull(), F.col("n")).otherwise(0)).alias("lines"),
        F.max((F.col("cusip").isNotNull() & (F.col("n") > 1)).cast("int")).alias("repeated"),
        F.sum("w").alias("total"), F.max("outside").alias("outside"),
    )
    rules: list[tuple[Column, str]] = [
        (strip("client_id") == "", "client id is blank"),
        (strip("client_name") == "", "client name is blank"),
        (strip("strategy") == "", "strategy is blank"),
        (F.col("lines") == 0, "no holdings"),
        (F.col("repeated") == 1, "CUSIP listed twice"),
        ((F.col("lines") > 0) & (F.abs(F.coalesce("total", F.lit(0.0)) - 1) > 0.001), "weights do not sum to 1"),
        (F.col("outside") == 1, "weight outside 0..1"),
    ]
    broken = F.array_compact(F.array(*[F.when(condition, text) for condition, text in rules]))
    return per_client.select(*name, broken.alias("problems")).filter(F.size("problems") > 0)


# Columns of a review file.
EVENT_COLUMNS = (
    "event_id", "current_accession_number", "previous_accession_number", "holding_key", "issuer_name", "cusip",
    "sector", "current_weight", "previous_weight", "weight_delta", "value_delta_thousands", "is_new_position",
    "is_exited_position", "current_rank", "previous_rank", "turnover_ratio", "rule_score", "weak_label",
)
REVIEW_COLUMNS = ("manual_label", "review_reason", "reviewer_id", "reviewed_at")


def label_problems(labelled: DataFrame) -> DataFrame:
    """Labelled rows that cannot be evaluated: event id and first broken rule."""
    missing = [c for c in (*EVENT_COLUMNS, *REVIEW_COLUMNS) if c not in labelled.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    event = strip("event_id")
    blank = [(strip(c) == "", f"{c} is required") for c in REVIEW_COLUMNS[1:]]
    rules = [
        (event == "", "event_id is required"),
        (F.col("copies") > 1, "duplicate event_id"),
        (~strip("manual_label").isin("0", "1"), "manual_label must be 0 or 1"),
        *blank,
    ]
    reason = F.coalesce(*[F.when(condition, text) for condition, text in rules])
    # ids are long and seldom alike: short hashes find those that can repeat, and only they are counted and joined
    hashed = labelled.withColumn("event", event).withColumn("h", F.xxhash64("event"))
    suspects = save_stage(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "suspects")
    repeated = hashed.select("h", "event").join(suspects, "h", "left_semi").groupBy("event").agg(F.count(F.lit(1)).alias("copies"))
    repeated = save_stage(repeated.filter("copies > 1"), "repeated")
    return hashed.join(repeated, "event", "left").select("event_id", reason.alias("reason")).filter(F.col("reason").isNotNull())


def label_summary(labelled: DataFrame) -> DataFrame:
    positive = F.sum((strip("manual_label") == "1").cast("long"))
    return labelled.agg(
        F.count(F.lit(1)).alias("row_count"), positive.alias("positive_count"),
        (F.count(F.lit(1)) - positive).alias("negative_count"),
    )
