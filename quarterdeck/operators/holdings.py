"""Holdings of effective filings: duplicates, sums, weights and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.keys import detailed_key, digest_id, option_side, side_key
from ..functions.measures import UNIT_CHANGE_DATE, octave, share_of, to_dollars
from ..functions.text import is_valid_cusip, row_key_order
from .filings import MANAGER_QUARTER, effective_filing_rows
from .ranking import rank_whole, rank_within


def _lines_of(filings: DataFrame, holdings: DataFrame, cutover: str) -> DataFrame:
    """Holding lines joined to their filing, in dollars."""
    joined = holdings.join(filings, "accession_number")
    return joined.withColumn("value_usd", to_dollars("reported_value", "filing_date", cutover))


def _met_in_quarter(chain: DataFrame, holdings: DataFrame, cutover: str, dealt: int) -> DataFrame:
    """:func:`_lines_of` for lines that name their manager-quarter: they look their filing up among the few of the quarter."""
    filed = chain.groupBy(*MANAGER_QUARTER).agg(F.collect_list(F.struct("accession_number", "filing_date", "position")).alias("filed"))
    met = holdings.repartition(dealt, *MANAGER_QUARTER).join(filed.repartition(dealt, *MANAGER_QUARTER), list(MANAGER_QUARTER))
    own = F.filter("filed", lambda f: f["accession_number"] == F.col("accession_number"))
    lines = met.select(*holdings.columns, F.explode(own).alias("f")).select(*holdings.columns, "f.filing_date", "f.position")
    return lines.withColumn("value_usd", to_dollars("reported_value", "filing_date", cutover))


def summed_holdings(filings: DataFrame, holdings: DataFrame, cutover: str = UNIT_CHANGE_DATE, dealt: int | None = None) -> DataFrame:
    """Effective holdings by CUSIP and side: values and shares of all contributing lines summed.

    Duplicates inside a filing and additive filings fall into the same sum, so one
    partially aggregated group-by replaces aggregating per filing first. ``dealt``: the lines are
    dealt by manager-quarter over that many partitions, and so is the result. Lines that name their
    manager-quarter are dealt before they meet their filing, so they are exchanged once.
    """
    chain = effective_filing_rows(filings).select("accession_number", *MANAGER_QUARTER, "filing_date", "position")
    named = set(MANAGER_QUARTER) <= set(holdings.columns)
    valid = holdings.filter(is_valid_cusip("cusip")).select(
        "accession_number", "info_table_key", "issuer_name", "title_of_class", "cusip", "reported_value",
        "shares_or_principal", "put_call", *(MANAGER_QUARTER if named else ()),
    )
    # position first, then row key; value and shares settle rows with equal keys
    first = F.struct("position", row_key_order("info_table_key").alias("k"), "value_usd", "shares_or_principal", "issuer_name", "title_of_class")
    # grouped by CUSIP and side, whose key is told afterwards, so that no exchange carries the CUSIP twice
    # the position names filing and date: neither is exchanged beside it
    if dealt and named:
        lines = _met_in_quarter(chain, valid, cutover, dealt)
    else:
        lines = _lines_of(chain, valid, cutover)
    lines = lines.withColumn("side", option_side("put_call")).drop("put_call", "reported_value", "accession_number", "filing_date")
    if dealt and not named:
        lines = lines.repartition(dealt, *MANAGER_QUARTER)
    return lines.groupBy(*MANAGER_QUARTER, "cusip", "side").agg(
        F.sum("value_usd").alias("value_usd"),
        F.sum("shares_or_principal").alias("shares_or_principal"),
        F.min(first).alias("named"),  # names its line, so nothing is carried beside it
        F.max("position.d").alias("available_at"),
        F.sort_array(F.collect_set("position.n")).alias("source_accession_numbers"),
    ).select(
        *MANAGER_QUARTER, F.concat("cusip", F.lit("|"), "side").alias("security_key"), "cusip", "value_usd", "shares_or_principal", "available_at",
        "source_accession_numbers", "named.issuer_name", "named.title_of_class")


def last_holdings(filings: DataFrame, holdings: DataFrame, cutover: str = UNIT_CHANGE_DATE) -> DataFrame:
    """Effective holdings by detailed key where the last line wins, inside and across filings.

    ``filing_date`` and ``effective_accession_number`` are those of the manager-quarter's last filing.
    """
    chain = effective_filing_rows(filings).select("accession_number", *MANAGER_QUARTER, "filing_date", "position")
    valid = holdings.filter(F.col("reason").isNull()).drop("reason")
    lines = _lines_of(chain, valid, cutover).withColumn("security_key", detailed_key())
    last = F.struct("position", row_key_order("info_table_key").alias("k"), "value_usd", "shares_or_principal", "issuer_name")
    kept = [c for c in lines.columns if c not in (*MANAGER_QUARTER, "security_key", "position", "reported_value", "filing_date")]
    selected = chain.groupBy(*MANAGER_QUARTER).agg(
        F.max_by(F.struct("filing_date", F.col("accession_number").alias("effective_accession_number")), "position").alias("selected"))
    return lines.groupBy(*MANAGER_QUARTER, "security_key").agg(
        F.max_by(F.struct(*kept), last).alias("line")
    ).select(*MANAGER_QUARTER, "security_key", "line.*").withColumnRenamed("accession_number", "source_accession_number").join(
        selected, list(MANAGER_QUARTER)).select("*", "selected.*").drop("selected")


def weigh_and_rank(effective: DataFrame, row_key: str | None = None, whole: bool = False) -> DataFrame:
    """Portfolio value, weight and rank by value; hand in a saved stage (read twice).

    ``whole``: the rows are dealt by manager-quarter, none of which has more than ``ranking.WHOLE_ROWS``, and stay where they are.
    """
    order = [F.desc("value_usd"), F.col("security_key")] + ([F.col(row_key)] if row_key else [])
    totals = {"portfolio_value_usd": F.col("value_usd")}
    if whole:
        ranked = rank_whole(effective, MANAGER_QUARTER, order, "holding_rank", totals)
    else:
        ranked = rank_within(effective, MANAGER_QUARTER, order, [-octave("value_usd")], "holding_rank", totals)
    return ranked.withColumns({
        "portfolio_weight": share_of("value_usd", "portfolio_value_usd"),
        "report_year": F.year("report_period"),
        "report_quarter": F.quarter("report_period"),
    })


def with_holding_id(holdings: DataFrame) -> DataFrame:
    return holdings.withColumn(
        "holding_id", digest_id("cik", F.col("report_period").cast("string"), "security_key")
    )


def lines_in_universe(
    filings: DataFrame, holdings: DataFrame, managers: DataFrame | None = None, securities: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Restrict filings to a manager list and lines to a security list.

    Both are semi joins: Spark broadcasts a list that is small by its statistics
    and shuffles one that is not.
    """
    if managers is not None:
        filings = filings.join(managers.select("cik"), "cik", "left_semi")
    if securities is not None:
        holdings = holdings.join(securities.select("cusip"), "cusip", "left_semi")
    holdings = holdings.join(filings.select("accession_number"), "accession_number", "left_semi")
    return filings, holdings


def duplicate_counts(filings: DataFrame, holdings: DataFrame, dealt: int | None = None) -> DataFrame:
    """Duplicate lines: inside filings, and over whole effective chains.

    ``dealt``: lines are dealt by manager-quarter over that many partitions and counted there, so what a task holds
    follows the rows of a partition.
    """
    valid = holdings.filter(is_valid_cusip("cusip")).select("accession_number", side_key("cusip", "put_call").alias("security_key"))
    chain = effective_filing_rows(filings).select("accession_number", F.lit(1).alias("used")).distinct()
    told = filings.select("accession_number", *MANAGER_QUARTER).join(chain, "accession_number", "left")
    lines = valid.join(told, "accession_number")
    if dealt:
        lines = lines.repartition(dealt, *MANAGER_QUARTER)
    per_filing = lines.groupBy("accession_number", *MANAGER_QUARTER, "security_key", "used").agg(F.count(F.lit(1)).alias("lines"))
    per_chain = per_filing.groupBy(*MANAGER_QUARTER, "security_key").agg(
        F.sum(F.col("lines") - 1).alias("inside"),
        F.greatest(F.sum(F.coalesce("used", F.lit(0))) - 1, F.lit(0)).alias("across"),
    )
    return per_chain.agg(
        F.sum("inside").alias("duplicates_inside_filings"),
        F.sum("across").alias("duplicates_across_filings"),
    )
