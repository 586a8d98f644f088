"""Manager-quarter facts, security histories and first observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.quarters import shift_quarter

ELIGIBLE, NO_NEXT_QUARTER, TARGET_KNOWN = "eligible", "no_next_quarter", "target_already_available"


def snapshots(silver: DataFrame) -> DataFrame:
    """Holdings of either build as point-in-time rows; the filing date is the security's availability."""
    available = "available_at" if "available_at" in silver.columns else "filing_date"
    return silver.select(
        "cik", "report_period", F.col(available).alias("filing_date"), "security_key", "cusip", "issuer_name",
        F.col("portfolio_weight").alias("weight"), F.col("holding_rank").cast("long").alias("rank"), "value_usd",
    )


def portfolio_facts(snaps: DataFrame) -> DataFrame:
    """One row per manager-quarter: size, availability, concentration, top-10 share."""
    return snaps.groupBy("cik", "report_period").agg(
        F.max("filing_date").alias("available_at"),
        F.count(F.lit(1)).alias("holdings"),
        F.sum("weight").alias("weight_sum"),
        F.sum(F.col("weight") * F.col("weight")).alias("concentration_hhi"),
        F.coalesce(F.sum(F.when(F.col("rank") <= 10, F.col("weight"))), F.lit(0.0)).alias("top10_share"),
    )


def listed(holdings: DataFrame) -> DataFrame:
    """One row per manager-quarter: availability and the keys of its holdings."""
    return holdings.groupBy("cik", "report_period").agg(
        F.max("available_at").alias("available_at"), F.collect_list("security_key").alias("securities"))


def listed_sizes(listed: DataFrame) -> DataFrame:
    """The facts of :func:`portfolio_facts` that follow from keys."""
    return listed.select("cik", "report_period", "available_at", F.size("securities").cast("long").alias("holdings"))


def manager_quarters(facts: DataFrame, turnovers: DataFrame | None = None) -> DataFrame:
    """Each manager-quarter with its turnover and its exact next and previous quarter; ``facts`` may lack weights.

    Neighbours are taken only when they are the adjacent quarter, so gaps are not
    bridged. A manager's group has one row per quarter.
    """
    history = Window.partitionBy("cik").orderBy("report_period")
    has_next = F.lead("report_period").over(history) == shift_quarter("report_period", 1)
    has_previous = F.lag("report_period").over(history) == shift_quarter("report_period", -1)
    neighbours = facts.select(
        "*",
        F.when(has_next, F.lead("available_at").over(history)).alias("target_available_at"),
        F.when(has_next, F.lead("holdings").over(history)).alias("target_holdings"),
        *([F.when(has_next, F.lead("weight_sum").over(history)).alias("target_weight_sum")] if "weight_sum" in facts.columns else []),
        F.coalesce(F.when(has_previous, F.lag("holdings").over(history)), F.lit(0)).alias("previous_holdings"),
    )
    status = (
        F.when(F.col("target_available_at").isNull(), NO_NEXT_QUARTER)
        .when(F.col("target_available_at") <= F.col("available_at"), TARGET_KNOWN)
        .otherwise(ELIGIBLE)
    )
    placed = neighbours.withColumns({"target_report_period": shift_quarter("report_period", 1), "status": status})
    return placed if turnovers is None else placed.join(turnovers, ["cik", "report_period"], "left")


def eligibility_counts(quarters: DataFrame) -> DataFrame:
    def counted(status: str):
        return F.coalesce(F.sum((F.col("status") == status).cast("long")), F.lit(0))

    return quarters.agg(
        counted(ELIGIBLE).alias("eligible_manager_quarters"),
        counted(NO_NEXT_QUARTER).alias("manager_quarters_without_exact_next_quarter"),
        counted(TARGET_KNOWN).alias("manager_quarters_target_already_available"),
    )


def turnover(snaps: DataFrame) -> DataFrame:
    """Half the absolute weight change against the previous quarter.

    Every holding adds its weight to its own quarter and takes it from the next one;
    what is left per security is the change. Quarters without a predecessor are 0.
    Holdings are dealt by manager once, before each adds its second row; the sums need no further exchange.
    """
    dealt = snaps.select("cik", "report_period", "security_key", "weight").repartition("cik")
    moves = dealt.select(
        "cik", "security_key",
        F.explode(F.array(
            F.struct(F.col("report_period").alias("q"), F.col("weight").alias("w"), F.lit(1).alias("now")),
            F.struct(shift_quarter("report_period", 1).alias("q"), (-F.col("weight")).alias("w"), F.lit(0).alias("now")),
        )).alias("m"),
    ).select("cik", "security_key", "m.*")
    changes = moves.groupBy("cik", "q", "security_key").agg(
        F.sum("w").alias("change"), F.max("now").alias("now"), F.min("now").alias("only_now")
    )
    per_quarter = changes.groupBy("cik", F.col("q").alias("report_period")).agg(
        F.sum(F.abs("change")).alias("moved"), F.max("now").alias("exists"), F.min("only_now").alias("no_previous"),
    )
    return per_quarter.filter(F.col("exists") == 1).select(
        "cik", "report_period", F.when(F.col("no_previous") == 1, 0.0).otherwise(F.col("moved") / 2).alias("turnover")
    )


def security_history(snaps: DataFrame) -> DataFrame:
    """Per manager and security: quarter -> (weight, rank, issuer). At most one entry per quarter."""
    entry = F.struct(
        F.col("report_period"),
        F.struct(F.col("weight").alias("w"), F.col("rank").alias("r"), F.col("issuer_name").alias("issuer")),
    )
    return snaps.groupBy("cik", "security_key").agg(F.map_from_entries(F.collect_list(entry)).alias("quarters"))


def history_features(rows: DataFrame, quarters: str, period: str) -> DataFrame:
    """Add quarters held through ``period`` and quarters since last held (-1 when never)."""
    held = F.filter(F.map_keys(quarters), lambda q: q <= F.col(period))
    last = F.array_max("__held")
    months = (F.year(period) - F.year(last)) * 12 + F.month(period) - F.month(last)
    return rows.withColumn("__held", held).withColumns({
        "holding_history_quarters": F.coalesce(F.when(F.col("__held").isNotNull(), F.size("__held")), F.lit(0)).cast("long"),
        "quarters_since_last_held": F.coalesce(F.floor(months / 3), F.lit(-1)).cast("long"),
    }).drop("__held")


def first_seen(snaps: DataFrame) -> DataFrame:
    """Earliest observation of each security by (filing date, period, manager)."""
    order = F.struct("filing_date", "report_period", "cik")
    return snaps.groupBy("security_key").agg(
        F.min_by(F.struct("report_period", "filing_date", "cusip", "issuer_name"), order).alias("f")
    ).select(
        "security_key",
        F.col("f.report_period").alias("security_first_seen_period"),
        F.col("f.filing_date").alias("security_first_seen_available_at"),
        F.col("f.cusip").alias("first_cusip"),
        F.col("f.issuer_name").alias("first_issuer_name"),
    )


def merge_snapshots(*datasets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Union of several builds: identical copies once with their count, conflicts apart."""
    columns = datasets[0].columns
    stacked = datasets[0]
    for d in datasets[1:]:
        stacked = stacked.unionByName(d)
    content = [c for c in columns if c != "holding_id"]
    copies = stacked.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    versions = copies.groupBy("holding_id").agg(F.count(F.lit(1)).alias("versions"))
    marked = copies.join(versions, "holding_id")
    merged = marked.filter("versions = 1").select("holding_id", *content, (F.col("copies") - 1).alias("duplicates"))
    return merged, marked.filter("versions > 1").select("holding_id", "versions").distinct()
