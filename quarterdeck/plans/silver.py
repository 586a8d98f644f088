"""Raw tables -> amendment-resolved holdings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.keys import cusip_of_side_key
from ..functions.measures import UNIT_CHANGE_DATE
from ..operators.holdings import last_holdings, summed_holdings, weigh_and_rank, with_holding_id
from ..session import save_stage


def build_silver(
    filings: DataFrame, holdings: DataFrame, cutover: str = UNIT_CHANGE_DATE,
    save: Callable[[DataFrame, str], DataFrame] = save_stage, dealt: int | None = None,
) -> DataFrame:
    """Holdings by CUSIP and side; additive amendments are summed.

    ``dealt``: no manager-quarter has more than ``ranking.WHOLE_ROWS`` lines, so all lines are dealt by manager-quarter over
    that many partitions and summed, weighed and ranked there; otherwise the sums are stored and ranked in bands.
    """
    usable = filings.filter("reason is null")
    # the CUSIP is part of the key: it is neither stored nor exchanged beside it
    if dealt:
        ranked = weigh_and_rank(summed_holdings(usable, holdings, cutover, dealt).drop("cusip"), whole=True)
    else:
        ranked = weigh_and_rank(save(summed_holdings(usable, holdings, cutover).drop("cusip"), "effective"))
    return ranked.withColumn("cusip", cusip_of_side_key("security_key"))


def build_silver_last(
    filings: DataFrame, holdings: DataFrame, cutover: str = UNIT_CHANGE_DATE,
    save: Callable[[DataFrame, str], DataFrame] = save_stage,
) -> DataFrame:
    """Holdings by detailed key; the last line wins."""
    usable = filings.filter("reason is null")
    return with_holding_id(weigh_and_rank(save(last_holdings(usable, holdings, cutover), "effective_last"), "info_table_key"))
